"""Exact nearest neighbours of a query set by a block matrix join.

Queries and candidates are dealt into blocks; each pair of blocks is one cell of a grid and one task's work. In a cell, int8 codes of the vectors
give approximate inner products tile by tile, with a bound on the error of each. A pair whose upper bound is below the k-th best lower bound of
its query can't be among the nearest. The others are computed again from the original vectors in double precision; heaps of k merge the cells.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import table
from sparkloom.session import cut_table

K, QUERY_BLOCK, CANDIDATE_BLOCK, TILE = 20, 4_096, 32_768, 4_096
RESULT = "query bigint, query_id bigint, vec_id bigint, score double"


def usable(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(row, vec_id, v, dim): vectors that are not null or zero and have only finite components, and an id. Every row takes part, those of the same id too; row is its number."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    rows = rows.where(finite & F.exists("v", lambda x: x != 0)).select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", F.size("v").alias("dim"))
    return cut_table(rows)  # a row keeps its number as query and as candidate


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, and the norms of the vectors, of what the codes stand for, and of the difference."""
    scale = np.abs(v).max(axis=1) / 127
    scale = np.where(scale > 0, scale, 1)
    codes = np.rint(v / scale[:, None]).astype(np.int8)
    stood = codes * scale[:, None]
    return codes, scale, np.linalg.norm(v, axis=1), np.linalg.norm(stood, axis=1), np.linalg.norm(v - stood, axis=1)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, added in order of components, so that equal vectors have equal products."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def nearest_in(query: pd.DataFrame, cand: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best candidates of each query among those of a cell; both have row, vec_id and v."""
    qrow, qid, q = query.row.to_numpy(), query.vec_id.to_numpy(), np.stack(query.v.to_numpy())
    crow, cid, c = cand.row.to_numpy(), cand.vec_id.to_numpy(), np.stack(cand.v.to_numpy())
    out = []
    cc, cs, cn, cm, ce = quantise(c)
    with np.errstate(over="ignore", invalid="ignore"):
        for a in range(0, len(q), 512):
            own_row, ids, rows = qrow[a : a + 512], qid[a : a + 512], q[a : a + 512]
            qc, qs, _, qm, qe = quantise(rows)
            best = np.full((len(rows), k), -np.inf)  # lower bounds
            kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for b in range(0, len(c), TILE):
                tile = slice(b, b + TILE)
                # sums of up to 1,000 products of codes are exact in single precision
                dots = (qc.astype(np.float32) @ cc[tile].astype(np.float32).T).astype(np.float64) if q.shape[1] <= 1000 else qc.astype(np.float64) @ cc[tile].astype(np.float64).T
                near = dots * qs[:, None] * cs[tile][None, :]
                # q.c - q'.c' = (q - q').c + q'.(c - c')
                error = (qe[:, None] * cn[tile][None, :] + qm[:, None] * ce[tile][None, :]) * (1 + 1e-9) + 1e-12 * (1 + np.abs(near))
                lower, upper = near - error, near + error
                own = own_row[:, None] == crow[tile][None, :]
                lower[own], upper[own] = -np.inf, -np.inf
                both = np.concatenate([best, np.nan_to_num(lower, nan=-np.inf)], axis=1)
                best = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
                i, j = np.nonzero(((upper >= best.min(axis=1)[:, None]) | np.isnan(upper)) & ~own)
                kept.append((i, j + b, upper[i, j]))
            i, j, upper = (np.concatenate(x) for x in zip(*kept, strict=True))
            left = (upper >= best.min(axis=1)[i]) | np.isnan(upper)
            i, j = i[left], j[left]
            score = np.concatenate([inner(rows[i[s : s + 65_536]], c[j[s : s + 65_536]]) for s in range(0, len(i), 65_536)] or [np.zeros(0)])
            order = np.lexsort((cid[j], -score, i))
            i, j, score = i[order], j[order], score[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            top = place < k
            out.append(pd.DataFrame({"query": own_row[i[top]], "query_id": ids[i[top]], "vec_id": cid[j[top]], "score": score[top]}))
    return pd.concat(out)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k candidates of the largest inner product, its own row left out; ties to the smaller id.

    Both inputs are of usable(), queries among vectors. Only vectors of a query's length are its candidates; with fewer than k, all are returned; a query without any has no row.
    Rows of the same id are queries and candidates of their own. An empty table gives an empty one. Hot or repeated vectors are candidates like others, and a tie of any number of
    them is settled by id within the cells.
    """
    def blocks(df: DataFrame, size: int) -> int:
        return max(1, -(-df.count() // size))

    nq, nc = blocks(queries, query_block), blocks(vectors, candidate_block)
    deal = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("dim", deal(nq).alias("i"), every(nc).alias("j"), "row", "vec_id", "v")
    right = vectors.select("dim", every(nq).alias("i"), deal(nc).alias("j"), "row", "vec_id", "v")

    def cell(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query": np.zeros(0, np.int64), "query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        return nearest_in(q, c, k)

    found = left.groupBy("dim", "i", "j").cogroup(right.groupBy("dim", "i", "j")).applyInPandas(cell, RESULT)

    def merge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by query, so one heap is open at a time."""
        now, heap, rows = None, [], []

        def close() -> None:
            rows.extend((now[1], rank, -vec, score) for rank, (score, vec) in enumerate(sorted(heap, reverse=True), 1))

        def made() -> pd.DataFrame:
            return pd.DataFrame(rows, columns=["query_id", "rank", "vec_id", "score"])

        for pdf in parts:
            for query, query_id, vec, score in zip(pdf["query"].tolist(), pdf.query_id.tolist(), pdf.vec_id.tolist(), pdf.score.tolist(), strict=True):
                if (query, query_id) != now:
                    close()
                    now, heap = (query, query_id), []
                    if len(rows) >= 50_000:
                        yield made()
                        rows.clear()
                (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, (score, -vec))
        close()
        if rows:
            yield made()

    return found.repartition("query").sortWithinPartitions("query").mapInPandas(merge, "query_id bigint, rank int, vec_id bigint, score double")


def op8_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, among all."""
    vectors = usable(table(spark, sf_dir, "embeddings"))
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


ORACLE = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score, row_number() OVER (PARTITION BY q.r ORDER BY list_inner_product(q.v, c.v) DESC, c.vec_id) AS rank
  FROM e q JOIN e c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
WHERE rank <= 20
"""
