"""Stream sketches over stored streams, as joins and aggregations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.columns import hash_by, hash_terms, linear_hash, trailing_zeros
from sparkloom.session import cut


def bloom_hits(first: DataFrame, bits: int, hashes: int, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((id, fp), (bit, set_at)) of ids at their first places, (id, seq): whether each of an id's bits was set before, and the bits that are set now. known: bits (bit, set_at) of earlier places."""
    keyed = first.select("id", "seq", F.explode(F.array_distinct(F.array(*[linear_hash(F.col("id"), k, bits) for k in range(hashes)]))).alias("bit"))
    set_at = keyed.select("bit", F.col("seq").alias("set_at"))
    set_at = (set_at if known is None else set_at.unionByName(known)).groupBy("bit").agg(F.min("set_at").alias("set_at"))
    return keyed.join(set_at, "bit").groupBy("id").agg((F.max("set_at") < F.first("seq")).alias("fp")), set_at


def bloom_rows(each: DataFrame) -> DataFrame:
    """(batch, false_positives, seen, fpr), cumulative, of (batch, fp, n)."""
    w = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)  # one row a batch
    out = each.select("batch", F.sum("fp").over(w).alias("false_positives"), F.sum("n").over(w).alias("seen"))
    return out.withColumn("fpr", F.when(F.col("seen") == 0, 0.0).otherwise(F.col("false_positives") / F.col("seen")))


def bloom_fpr(stream: DataFrame, bits: int, hashes: int) -> DataFrame:
    """(batch, false_positives, seen, fpr), cumulative, for every batch. stream: (batch, seq, id).

    An id is a query once, at its first place. It is a false positive if each of its bits was set at an earlier first place of another id.
    """
    first = bloom_first(stream)
    hit, _ = bloom_hits(first, bits, hashes)
    return bloom_rows(bloom_each(stream, first, hit))


def bloom_first(stream: DataFrame) -> DataFrame:
    """(id, seq, batch): the first place of each id."""
    return stream.groupBy("id").agg(F.min("seq").alias("seq"), F.min_by("batch", "seq").alias("batch"))


def bloom_each(stream: DataFrame, first: DataFrame, hit: DataFrame) -> DataFrame:
    """(batch, fp, n) of every batch of the stream: false positives and queries among its first places."""
    each = hit.join(first, "id").groupBy("batch").agg(F.count_if("fp").alias("fp"), F.count("*").alias("n"))
    return stream.select("batch").distinct().join(each, "batch", "left").fillna(0)


def begun_windows(stream: DataFrame, length: int = 3, slide: int = 2) -> DataFrame:
    """stream with a column w for each window of ``length`` batches that a row is in, complete or not; windows begin every ``slide`` batches."""
    first = F.greatest(F.ceil((F.col("batch") - (length - 1)) / slide), F.lit(0)).cast("bigint")
    return stream.withColumn("w", F.explode(F.sequence(first, F.floor(F.col("batch") / slide).cast("bigint"))))


def in_windows(stream: DataFrame, length: int = 3, slide: int = 2) -> DataFrame:
    """stream with a column w for each complete window of ``length`` batches that a row is in; windows begin every ``slide`` batches."""
    last = stream.agg(F.max("batch").alias("last"))
    return begun_windows(stream, length, slide).join(F.broadcast(last)).where(F.col("w") * slide + length - 1 <= F.col("last")).drop("last")  # one row


def fm_estimates(seen: DataFrame, hashes: int = 100, rows: int = 2, modulus: int = 69_997) -> DataFrame:
    """(w, truth, estimate) of distinct (w, id): how many ids, and the estimate, which is the upper median of the groups' means.

    An id becomes a row for each hash, of which a task keeps one for each window and hash; aggregates of their own for all hashes would be more code than a JVM compiles.
    """
    terms = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b")) for k, (a, b) in enumerate(map(hash_terms, range(hashes)))])
    each = seen.select("w", "id", F.explode(terms).alias("h")).select("w", F.col("h.k").alias("k"), trailing_zeros(hash_by(F.col("id"), F.col("h.a"), F.col("h.b"), modulus)).alias("z"))
    most = each.groupBy("w", "k").agg(F.max("z").alias("r"), F.count("*").alias("truth"))
    power = most.groupBy("w").agg(F.max("truth").alias("truth"), F.array_sort(F.collect_list(F.struct("k", F.pow(F.lit(2.0), F.col("r")).alias("p")))).alias("p"))
    means = F.transform(F.sequence(F.lit(1), F.lit(hashes), F.lit(rows)), lambda k: F.aggregate(F.slice("p", k, rows), F.lit(0.0), lambda x, y: x + y.p) / rows)
    return power.select("w", "truth", F.element_at(F.array_sort(means), -(-hashes // rows) // 2 + 1).alias("estimate"))


def window_ids(rows: DataFrame) -> DataFrame:
    """The distinct (w, id) of rows, dealt over all cores, as each becomes many rows: by their own size, they would go to few tasks."""
    return rows.select("w", "id").repartition(rows.sparkSession.sparkContext.defaultParallelism, "w", "id").distinct()


def fm_windows(stream: DataFrame, hashes: int = 100, rows: int = 2, modulus: int = 69_997) -> DataFrame:
    """(w, truth, estimate): exact distinct ids and the estimate of each complete window. stream: (batch, id)."""
    return fm_estimates(window_ids(in_windows(stream)), hashes, rows, modulus)


def reservoir(stream: DataFrame, size: int, seed: int = 1) -> DataFrame:
    """(batch, id, seq): after each batch (0, 1, ...) the ``size`` rows of least priority so far; the priority is a hash of seq, so a sample is uniform and repeatable.

    Runs of 1, 2, 4, ... batches have samples, each made of the two half as long; all batches up to one are at most as many runs as the logarithm of their number.
    """
    p = F.pmod(F.col("seq") * 1_103_515_245 + seed * 12_345, F.lit(2_147_483_647))
    least = lambda df, key: df.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy("p", "seq"))).where(F.col("k") <= size).drop("k")
    own = stream.select("batch", "id", "seq", p.alias("p"))
    last = stream.agg(F.max("batch")).first()[0]
    if last is None:
        return stream.select("batch", "id", "seq")
    run, level, parts = least(own.withColumn("run", F.col("batch")), "run"), 0, []
    while True:
        # run r of 2^level batches is a part of the sample after batch b where b + 1 has that bit and b + 1 div 2^level = r + 1
        ends = F.sequence(F.shiftleft(F.col("run") + 1, level), F.least(F.shiftleft(F.col("run") + 1, level) + (1 << level) - 1, F.lit(last + 1)))
        parts.append(run.where(f"run % 2 = 0 AND shiftleft(run + 1, {level}) <= {last + 1}").select(F.explode(ends).alias("at"), "id", "seq", "p"))
        if 1 << level > last:
            break
        level += 1
        run = cut(least(run.withColumn("run", F.shiftright("run", 1)), "run"))
    there = reduce(DataFrame.union, parts).withColumn("at", F.col("at") - 1).join(stream.select(F.col("batch").alias("at")).distinct(), "at", "left_semi")
    return least(there, "at").select(F.col("at").alias("batch"), "id", "seq")


def sliding_distinct(events: DataFrame, ts: str, user: str, length: str = "3 hours", slide: str = "2 hours") -> DataFrame:
    """(start, users)."""
    return events.groupBy(F.window(ts, length, slide).alias("w")).agg(F.count_distinct(user).alias("users")).select(F.col("w.start").alias("start"), "users")
