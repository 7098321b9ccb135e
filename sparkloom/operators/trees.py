"""Boosted regression trees by histograms: every task holds its share of the rows as bins and residuals, and only histograms meet.

The model is MLlib's GBTRegressor's: squared error, its first tree on the target, the others on twice the residual, splits between at most ``BINS`` bins of a feature, taken from a sample of about ``SAMPLE`` rows as there;
all rows are learnt from. MLlib passes over its rows once for each level of each tree with objects for each row; here a row is a few bytes in the memory of one task of a barrier stage, about 25 in all with ten features.
"""

from __future__ import annotations

import json
import secrets
import socket
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most bins of a feature, rows from which splits are taken, most cells of features that are counted together, and rows at a time.
BINS, SAMPLE, CELLS, CHUNK = 32, 10_000, 2_048, 1 << 17
#: Seconds that a task waits for another one's histograms.
WAIT = 3600


def candidates(values: np.ndarray, bins: int = BINS) -> list[float]:
    """Thresholds (x <= t goes left): midpoints of all neighbours if they are few, else those at about equal steps of rows."""
    found, counts = np.unique(values[~np.isnan(values)], return_counts=True)
    middles = (found[:-1] + found[1:]) / 2
    if len(middles) < bins:
        return middles.tolist()
    step, target, out, total = counts.sum() / bins, counts.sum() / bins, [], int(counts[0])
    for k in range(1, len(found)):
        before = total
        total += int(counts[k])
        if abs(before - target) < abs(total - target):
            out.append(float(middles[k - 1]))
            target += step
    return out


def _groups(sizes: list[int]) -> list[list[int]]:
    """Features that are counted together, in order."""
    out: list[list[int]] = []
    for f, size in enumerate(sizes):
        if out and prod(sizes[g] for g in out[-1]) * size <= CELLS:
            out[-1].append(f)
        else:
            out.append([f])
    return out


def _bins(batch: pa.RecordBatch | list, thresholds: list[list[float]]) -> list[np.ndarray]:
    """Each feature's bins; what is null or not a number is in the last one."""
    return [np.searchsorted(np.array(t), c.to_numpy(zero_copy_only=False).astype(float), side="left") for t, c in zip(thresholds, batch, strict=False)]


def _split(counts: np.ndarray, sums: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each node its best (feature, bin), feature -1 for none, and the means left and right of it. counts, sums: nodes by all features' bins."""
    nodes, first = len(counts), sizes[0]
    n, s = counts[:, :first].sum(1, keepdims=True), sums[:, :first].sum(1, keepdims=True)
    gains, lefts, at = [], [], 0
    with np.errstate(divide="ignore", invalid="ignore"):
        whole = s * s / n
        for size in sizes:
            c, t = (np.cumsum(x[:, at : at + size], axis=1)[:, :-1] for x in (counts, sums))
            gains.append(np.where((c > 0) & (c < n), t * t / c + (s - t) ** 2 / (n - c) - whole, -np.inf))
            lefts.append(np.stack([c, t]))
            at += size
        gain, left = np.concatenate(gains, axis=1), np.concatenate(lefts, axis=2)
        mean = np.where(n > 0, s / n, 0.0)[:, 0]
        feature, bin_, means = np.full(nodes, -1), np.zeros(nodes, dtype=int), np.stack([mean, mean], axis=1)
        ends = np.cumsum([size - 1 for size in sizes])
        for k in range(nodes if gain.shape[1] else 0):
            b = int(np.argmax(gain[k]))
            if gain[k, b] > 1e-12 * abs(whole[k, 0]):
                f = int(np.searchsorted(ends, b, side="right"))
                feature[k], bin_[k] = f, b - (ends[f] - sizes[f] + 1)
                means[k] = left[1, k, b] / left[0, k, b], (s[k, 0] - left[1, k, b]) / (n[k, 0] - left[0, k, b])
    return feature, bin_, means


def _learn(codes: list[np.ndarray], res: np.ndarray, groups: list[list[int]], sizes: list[int], trees: int, depth: int, rate: float, meet) -> list[dict]:
    """The trees. codes: each group's cell of every row; res: the target, overwritten; meet(array) adds up what all tasks have."""
    cells = [prod(sizes[f] for f in g) for g in groups]
    node, out, tables, gone, roots = np.zeros(len(res), dtype=np.int32), [], None, None, None

    def pass_(nodes: int) -> np.ndarray:
        """Rows go where the last level's splits say (at a root: take what the last tree says from them); then counts and sums of the nodes' bins."""
        both = [np.zeros((2, nodes * c)) for c in cells]
        for at in range(0, len(res), CHUNK):
            part = slice(at, at + CHUNK)
            own = [c[part].astype(np.int64) for c in codes]
            if tables:
                here, right = node[part].astype(np.int64), 0
                for g, table in tables:
                    right = right + table[here * cells[g] + own[g]]
                node[part] = 2 * here + right
            if nodes == 1 and gone is not None:
                res[part] -= gone[node[part]]
                if len(out) == 1:
                    res[part] *= 2
                node[part] = 0
            here = node[part].astype(np.int64)
            for k, (c, code) in enumerate(zip(cells, own, strict=True)):
                where = code + here * c if nodes > 1 else code
                both[k][1] += np.bincount(where, weights=res[part], minlength=nodes * c)
                if nodes > 1 or roots is None:  # the roots' counts are always the same
                    both[k][0] += np.bincount(where, minlength=nodes * c)
        wide = []
        for g, x in zip(groups, both, strict=True):
            x = x.reshape(2, nodes, *(sizes[f] for f in g))
            wide += [x.sum(axis=tuple(2 + j for j in range(len(g)) if j != k)) for k in range(len(g))]
        return np.concatenate(wide, axis=2)

    for _ in range(trees):
        tree: dict = {"feature": [], "bin": []}
        for level in range(depth):
            counts, sums = meet(pass_(1 << level))
            if level == 0:
                counts = roots = counts if roots is None else roots
            feature, bin_, means = _split(counts, sums, sizes)
            tree["feature"].append(feature.tolist())
            tree["bin"].append(bin_.tolist())
            tables = []
            for g, own in enumerate(groups):
                if np.isin(feature, own).any():
                    table = np.zeros((1 << level, *(sizes[f] for f in own)), dtype=np.int8)
                    for k in np.flatnonzero(np.isin(feature, own)):
                        table[k][(slice(None),) * own.index(feature[k]) + (slice(bin_[k] + 1, None),)] = 1
                    tables.append((g, table.reshape(-1)))
            if not tables:  # nothing splits, but rows go a level down
                tables = [(0, np.zeros((1 << level) * cells[0], dtype=np.int8))]
        share = rate if out else 1.0
        tree["leaf"] = (means.reshape(-1) * share).tolist()
        gone = means.reshape(-1) * share * (2 if out else 1)
        out.append(tree)
    return out


@contextmanager
def _meeting(context) -> Iterator[Callable[[np.ndarray], np.ndarray]]:
    """A function that adds up an array over all tasks of a barrier stage, in their order, so that all have the very same sum.

    The first task takes connections of the others; its address and a secret go round by allGather, which itself waits a second each time.
    """
    me, everyone = context.partitionId(), context.getTaskInfos()
    server = socket.create_server(("", 0), backlog=len(everyone)) if me == 0 else None
    told = context.allGather(json.dumps([server.getsockname()[1], secrets.token_hex(16)]) if server else "")
    port, secret = json.loads(told[0])
    links: dict[int, socket.socket] = {}

    def take(link: socket.socket, size: int) -> bytes:
        out = bytearray()
        while len(out) < size:
            part = link.recv(size - len(out))
            if not part:
                raise ConnectionError("another task has ended")
            out += part
        return bytes(out)

    def meet(x: np.ndarray) -> np.ndarray:
        x = np.ascontiguousarray(x, dtype=float)
        if server:
            for k in range(1, len(everyone)):
                x = x + np.frombuffer(take(links[k], x.nbytes)).reshape(x.shape)
            for k in range(1, len(everyone)):
                links[k].sendall(x.tobytes())
            return x
        links[0].sendall(x.tobytes())
        return np.frombuffer(take(links[0], x.nbytes)).reshape(x.shape)

    try:
        if server:
            server.settimeout(WAIT)
            while len(links) < len(everyone) - 1:
                link = server.accept()[0]
                link.settimeout(WAIT)
                try:
                    known = secrets.compare_digest(take(link, len(secret)), secret.encode())
                    rank = int(take(link, 8)) if known else -1
                except OSError:
                    rank = -1
                if rank < 0:
                    link.close()
                else:
                    links[rank] = link
        else:
            links[0] = socket.create_connection((everyone[0].address.rsplit(":", 1)[0].strip("[]"), port), timeout=WAIT)
            links[0].sendall(f"{secret}{me:08d}".encode())
        for link in links.values():
            link.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
        yield meet
    finally:
        for link in [*links.values(), *([server] if server else [])]:
            link.close()


def learn(train: DataFrame, features: list[str], target: str, trees: int, depth: int, rate: float, seed: int = 1) -> dict:
    """The model: {"thresholds", "trees"}. Rows without a target play no part; train is read three times."""
    if depth < 1:
        raise ValueError("depth is at least 1")
    spark = train.sparkSession
    rows = train.select(*[F.col(f).cast("double").alias(f"f{k}") for k, f in enumerate(features)], F.col(target).cast("double").alias("y")).where("y IS NOT NULL")
    many = rows.count()
    if not many:
        raise ValueError("no rows to learn from")
    named = [f"f{k}" for k in range(len(features))]
    # by a hash of the row, so that it doesn't depend on how rows are dealt out
    some = rows.where(F.pmod(F.xxhash64(F.lit(seed), *named, "y"), F.lit(max(1, many // SAMPLE))) == 0) if many > SAMPLE else rows
    sample = some.select(*named).limit(20 * SAMPLE).toPandas()
    thresholds = [candidates(sample[f].to_numpy(dtype=float)) for f in named]
    sizes = [len(t) + 1 for t in thresholds]
    groups = _groups(sizes)
    bits, columns = [(prod(sizes[f] for f in g) - 1).bit_length() for g in groups], [[]]  # groups' cells go into whole numbers of 63 bits
    for g in range(len(groups)):
        if sum(bits[x] for x in columns[-1]) + bits[g] > 63:
            columns.append([])
        columns[-1].append(g)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            found, out = _bins(batch.columns, thresholds), []
            cell = [np.ravel_multi_index([found[f] for f in g], [sizes[f] for f in g]) for g in groups]
            for own in columns:
                whole = np.zeros(len(batch), dtype=np.int64)
                for g in own:
                    whole = (whole << bits[g]) | cell[g]
                out.append(whole)
            yield pa.RecordBatch.from_arrays([*map(pa.array, out), batch.column("y"), pa.array(np.arange(at, at + len(batch), dtype=np.int64))], [*(f"c{k}" for k in range(len(columns))), "y", "at"])
            at += len(batch)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import BarrierTaskContext

        context = BarrierTaskContext.get()
        codes, y = [[] for _ in groups], []
        for batch in batches:
            y.append(batch.column("y").to_numpy())
            for k, own in enumerate(columns):
                whole = batch.column(k).to_numpy()
                for g in reversed(own):
                    codes[g].append((whole & ((1 << bits[g]) - 1)).astype(np.uint16 if bits[g] <= 16 else np.uint32))
                    whole = whole >> bits[g]
        flat = [np.concatenate(c) if c else np.zeros(0, dtype=np.uint16) for c in codes]
        codes.clear()
        res = np.concatenate(y) if y else np.zeros(0)
        y.clear()

        with _meeting(context) as meet:
            found = _learn(flat, res, groups, sizes, trees, depth, rate, meet)
        if context.partitionId() == 0:
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(found)])], ["model"])

    context = spark.sparkContext._jsc.sc()
    slots = context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile())  # all tasks of a barrier stage run at once
    packed = rows.mapInArrow(pack, ", ".join([*(f"c{k} bigint" for k in range(len(columns))), "y double", "at bigint"]))
    model = packed.repartition(slots, "at").select(*(f"c{k}" for k in range(len(columns))), "y").mapInArrow(work, "model string", barrier=True).collect()
    return {"thresholds": thresholds, "trees": json.loads(model[0].model)}


def predict(df: DataFrame, model: dict, features: list[str], out: str = "m") -> DataFrame:
    """df with the model's prediction."""
    thresholds, trees = model["thresholds"], [([np.array(f) for f in t["feature"]], [np.array(b) for b in t["bin"]], np.array(t["leaf"])) for t in model["trees"]]

    @F.arrow_udf("double")
    def run(*columns: pa.Array) -> pa.Array:
        bins = np.stack(_bins(columns, thresholds))
        total, each = np.zeros(bins.shape[1]), np.arange(bins.shape[1])
        for feature, bin_, leaf in trees:
            node = np.zeros(bins.shape[1], dtype=np.int64)
            for f, b in zip(feature, bin_, strict=True):
                own = f[node]
                node = 2 * node + ((own >= 0) & (bins[own, each] > b[node]))
            total += leaf[node]
        return pa.array(total)

    return df.withColumn(out, run(*[F.col(f).cast("double") for f in features]))
