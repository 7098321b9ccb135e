"""SimHash fingerprints, and near-duplicates among them by anchor points of a covering code.

The 64 bits are cut into blocks: two fingerprints at 4 or fewer differing bits differ in at most 4 div blocks bits of some block. In a block, anchors are the words of a code: a Hamming code on
each of its segments of 15 bits, beside all words of the other bits, so every value is within R = (number of segments) of an anchor. A fingerprint goes to its home anchor and to every
anchor within R and that difference of its value. If x and y differ so little in the block, y is at the home anchor of x. Comparison happens at anchors only: homes with all there.

Up to ``WIDE`` fingerprints there are three blocks of 21, 21 and 22 bits with one segment each (about 45 anchors a fingerprint, 2^17 in a block); beyond, two of 32 bits with two segments
(about 320 anchors, 2^24 in a block), as what is compared at an anchor grows with the fingerprints for each. Links are the same either way.

An anchor with more than ``PAIRS`` combinations goes to cells of at most ``CELL`` homes by ``CELL`` fingerprints. A cell returns the edges of a
spanning forest of its links, so that a group of copies never becomes all its pairs.
"""

from __future__ import annotations

import json
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import table, unused
from sparkloom.llm.graph import components
from sparkloom.operators.graph import lookup
from sparkloom.session import cut

SHINGLE, DISTANCE = 4, 4
#: Bits of a Hamming code; first bit and bits of each block, and how many segments have such a code: for few fingerprints and for many.
CODE = 15
NARROW, BROAD, WIDE = (((0, 21), (21, 21), (42, 22)), 1), (((0, 32), (32, 32)), 2), 50_000_000
PAIRS, CELL = 16_384, 4_096
#: Fingerprints of a task that makes anchors.
SPREAD = 50_000


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    """The fingerprint of one text, unsigned."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False)) if len(words) >= n else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, 42) for s in shingles], dtype=np.uint64)
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 65_536):
        part = hashes[k : k + 65_536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint", n: int = SHINGLE) -> DataFrame:
    """Add the fingerprint of the whole text as a bigint (its bits). A null or wordless text has fingerprint zero."""

    @F.arrow_udf("bigint")
    def run(column: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t, n) for t in column.to_pylist()], dtype=np.uint64).view(np.int64))

    return df.withColumn(out, run(F.col(f"`{text}`").cast("string")))


def syndrome(value: int, segments: int) -> int:
    """Four bits for each segment: the xor of the numbers (from 1) of its set bits, which is 0 for words of the code, and else the number of the bit that leads to one."""
    out = 0
    for k in range(segments):
        own = value >> CODE * k & ((1 << CODE) - 1)
        out |= sum(((own & m).bit_count() & 1) << b for b, m in enumerate(PARITY)) << 4 * k
    return out


#: For each bit of a syndrome, the places whose parity it is.
PARITY = [sum(1 << (i - 1) for i in range(1, CODE + 1) if i >> b & 1) for b in range(4)]


@cache
def masks(bits: int, segments: int, apart: int) -> list[list[int]]:
    """For each syndrome, what a block's value is xored with to give the anchors within ``segments`` + ``apart`` bits of it, its home first."""
    out: list[list[int]] = []
    for s in range(16**segments):
        numbers = [s >> 4 * k & 15 for k in range(segments)]
        out.append([sum(1 << CODE * k + n - 1 for k, n in enumerate(numbers) if n)])
    for weight in range(segments + apart + 1):
        for places in combinations(range(bits), weight):
            mask = sum(1 << p for p in places)
            own = out[syndrome(mask, segments)]
            if mask != own[0]:
                own.append(mask)
    return out


def anchors_of(value: int, bits: int, segments: int = 1, apart: int = 1) -> list[int]:
    """The anchors of a block's value, its home first."""
    return [value ^ m for m in masks(bits, segments, apart)[syndrome(value, segments)]]


def _anchor_keys(fp: Column, layout: tuple, distance: int) -> Column:
    """Keys of the anchors of all blocks: 2 * (block, anchor), plus 1 at homes; by built-in functions."""
    blocks, segments = layout

    def of(block: int, first: int, bits: int) -> Column:
        value = F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1))
        parity = [F.pmod(F.bit_count(value.bitwiseAND(F.lit(m << CODE * k))), F.lit(2)) * (1 << b + 4 * k) for k in range(segments) for b, m in enumerate(PARITY)]
        listed = F.from_json(F.lit(json.dumps(masks(bits, segments, distance // len(blocks)))), "array<array<bigint>>")  # folded to a literal
        return F.transform(F.element_at(listed, sum(parity, F.lit(0)) + 1), lambda m, j: (value.bitwiseXOR(m) + (block << 33)) * 2 + F.when(j == 0, 1).otherwise(0))

    return F.concat(*(of(k, first, bits) for k, (first, bits) in enumerate(blocks)))


def _forest(pdf: pd.DataFrame, distance: int) -> pd.DataFrame:
    """Star edges of the components that the links between a cell's homes and its fingerprints make."""
    homes, all_ = pdf.fp[pdf.home].to_numpy(np.int64).view(np.uint64), pdf.fp[~pdf.home].to_numpy(np.int64).view(np.uint64)
    linked = np.empty((len(homes), len(all_)), dtype=bool)
    for k in range(0, len(homes), 256):
        linked[k : k + 256] = np.bitwise_count(homes[k : k + 256, None] ^ all_[None, :]) <= distance
    open_, edges = np.ones(len(homes), dtype=bool), []
    free = np.ones(len(all_), dtype=bool)
    for start in range(len(homes)):
        if not open_[start]:
            continue
        own, theirs, frontier = [start], [], np.array([start])
        open_[start] = False
        while len(frontier):
            reached = np.flatnonzero(linked[frontier].any(axis=0) & free)
            free[reached] = False
            theirs.append(reached)
            frontier = np.flatnonzero(linked[:, reached].any(axis=1) & open_) if len(reached) else reached
            open_[frontier] = False
            own += frontier.tolist()
        members = np.unique(np.concatenate([homes[own], *(all_[t] for t in theirs)])).view(np.int64)
        edges += [(int(members[0]), int(m)) for m in members[1:]]
    return pd.DataFrame(edges, columns=["u", "v"], dtype="int64")


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges (u, v) that connect what is linked among distinct fingerprints (column fp)."""
    if not 0 <= distance <= 4:
        raise ValueError("the codes cover distances up to 4")
    # a fingerprint becomes about 45 rows, or 320, so they are spread before
    many = distinct.count()
    spread = max(distinct.sparkSession.sparkContext.defaultParallelism, -(-many // SPREAD))
    at = distinct.repartition(spread).select("fp", F.explode(_anchor_keys(F.col("fp"), NARROW if many <= WIDE else BROAD, distance)).alias("k")).select("fp", F.shiftright("k", 1).alias("key"), (F.col("k") % 2 == 1).alias("home"))
    sizes = at.groupBy("key").agg(F.count_if("home").alias("h"), F.count("*").alias("p")).where("h > 0 and p > 1")
    hot = sizes.where(F.col("h") * F.col("p") > PAIRS).select("key", F.ceil(F.col("h") / CELL).alias("nh"), F.ceil(F.col("p") / CELL).alias("np"))
    # Spark sizes what an explode makes as its input, so a join by size would broadcast all anchors; these joins are merged, whatever their sizes are taken to be
    hot = cut(hot).hint("merge")
    x = at.where("home").join(hot, "key", "left_anti").select("key", F.col("fp").alias("u"))
    y = at.join(hot, "key", "left_anti").select(F.col("key").alias("key2"), F.col("fp").alias("v"))
    plain = x.join(y.hint("merge"), (F.col("key") == F.col("key2")) & (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance))
    there = at.join(hot, "key")
    part = lambda n: F.pmod(F.xxhash64("fp"), F.col(n))
    some = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    homes = there.where("home").select("key", "fp", F.lit(True).alias("home"), part("nh").alias("i"), some("np").alias("j"))
    others = there.select("key", "fp", F.lit(False).alias("home"), some("nh").alias("i"), part("np").alias("j"))
    cells = homes.union(others).groupBy("key", "i", "j").applyInPandas(lambda pdf: _forest(pdf, distance), "u bigint, v bigint")
    return plain.select("u", "v").union(cells)


def component_of(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, root) of every distinct fingerprint in column fp: root is the same for all that are linked, directly or by others."""
    distinct = cut(prints.select("fp").distinct())
    found = components(links(distinct, distance))
    return distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("label", "fp").alias("root"))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    fingerprint: 16 lowercase hex digits; component_id: the least doc_id reachable over links of ``distance`` or fewer differing
    bits, itself included. Null and wordless texts have fingerprint zero and are linked like any other. A null doc_id stays null and is never
    least, so a component of nulls alone has a null id. Repeated rows stay and share a component; an empty table gives an empty one; other columns play no part.
    """
    prints = cut(with_fingerprint(df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), out="fp").select("doc_id", "fp"))
    roots = cut(component_of(prints, distance))
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(roots, "fp")
    heads = least.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(lookup(roots, heads, "root").select("fp", "component_id"))
    return lookup(prints, named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """df with one row of each component: the least doc_id (nulls last), then the least hash of the whole row. Rows equal in all columns count as one."""
    name_h, name_id = unused(df, "row_hash", "row_id")
    marked = df.withColumn(name_h, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])).withColumn(name_id, F.col(f"`{doc_id}`"))
    prints = with_fingerprint(marked.select(F.col(name_id).alias("i"), F.col(name_h).alias("h"), F.col(f"`{text}`").alias("text")), out="fp")
    prints = cut(prints.select("i", "h", "fp"))
    rank = F.struct(F.col("i").isNull().alias("n"), "i", "h")
    best = prints.groupBy("fp").agg(F.min(rank).alias("r")).join(component_of(prints, distance), "fp").groupBy("root").agg(F.min("r").alias("r"))
    best = best.select(F.col("r.i").alias("i"), F.col("r.h").alias("h"))
    # rows are dealt by their hash alone, for the join and for what follows; ids are compared beside it
    same_id = F.coalesce(marked[name_id] == best.i, marked[name_id].isNull() & best.i.isNull())
    kept = marked.join(best, (marked[name_h] == best.h) & same_id, "left_semi")
    return kept.dropDuplicates([name_id, name_h]).drop(name_id, name_h)


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))
