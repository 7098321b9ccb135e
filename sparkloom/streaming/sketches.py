"""Structured Streaming forms of the windowed counts and of the sketches."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.operators import sketches
from sparkloom.session import shared_path

#: Batches that a micro-batch takes from a backlog: what a micro-batch costs beside its rows (logs, planning, jobs) is then shared by so many.
AT_ONCE = 128

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream; ts becomes a timestamp, as watermarks need one."""
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there now and return its result: the last batch's rows in mode complete, else the rows of all batches.

    Batches go to files in the shared folder, each to a place of its own, so that a batch that is run again replaces itself; the stream's state is kept there too.
    """
    spark, path = stream.sparkSession, shared_path(stream.sparkSession, "stream")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/{'all' if mode == 'complete' else f'batch={number}'}")

    query = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows/{'all' if mode == 'complete' else '*'}")


def windowed_counts(events: DataFrame, length: str = "3 hours", slide: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total), with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length, slide).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def reservoir_state(size: int, seed: int = 1) -> Callable:
    """For applyInPandasWithState: each key's ``size`` rows of least priority so far, with a count of all rows. The state is the sample alone."""

    def run(key, parts, state):
        kept, total = (list(zip(*state.get[:2], strict=True)), state.get[2]) if state.exists else ([], 0)
        for pdf in parts:
            total += len(pdf)
            kept += [((seq * 1_103_515_245 + seed * 12_345) % 2_147_483_647, seq) for seq in pdf.event_id.tolist()]
            kept = sorted(kept)[:size]
        state.update(([p for p, _ in kept], [s for _, s in kept], total))
        yield pd.DataFrame({"event_type": [key[0]] * len(kept), "event_id": [s for _, s in kept], "total": [total] * len(kept)})

    return run


def reservoirs(events: DataFrame, size: int = 20) -> DataFrame:
    """(event_type, event_id, total) after each batch."""
    return events.groupBy("event_type").applyInPandasWithState(reservoir_state(size), "event_type string, event_id bigint, total bigint", "p array<bigint>, s array<bigint>, n bigint", "update", "NoTimeout")


def batches_of(df: DataFrame, path: str, at_once: int = 1) -> DataFrame:
    """A stream of one micro-batch for every ``at_once`` values (0, 1, ...) of df's column batch. One job writes a file for each, and their times put them in that order."""
    spark = df.sparkSession
    made = df.withColumn("at_", F.expr(f"batch div {at_once}"))
    made.repartition("at_").sortWithinPartitions("batch").write.partitionBy("at_").parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    files = [f.getPath() for f in system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/at_=*/part-*"))]
    number = lambda p: int(p.getParent().getName().split("=")[1])
    files = sorted(((number(p), p) for p in files), key=lambda x: x[0])
    if [k for k, _ in files] != sorted({k for k, _ in files}):
        raise ValueError("a batch has several files")
    now = int(time.time()) * 1000
    for k, (_, p) in enumerate(files):
        system.setTimes(p, now - 1000 * (len(files) - k), -1)
    schema = T.StructType([f for f in df.schema.fields if f.name != "batch"] + [T.StructField("batch", T.LongType())])
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def _runs(start: int, stop: int) -> list[tuple[int, int]]:
    """The numbers from start to stop - 1 as the runs that _merged() makes: at most about twice the logarithm of their number."""
    out = []
    while start < stop:
        size = start & -start or 1 << stop.bit_length()
        while start + size > stop:
            size >>= 1
        out.append((start, start + size))
        start += size
    return out


def _merged(number: int) -> tuple[int, list[tuple[int, int]]]:
    """Where the run that micro-batch ``number`` closes begins, and the earlier runs that it takes in: after 1, 2, 4, ... micro-batches their rows are put together, so few files are read, and each row is written as often as the logarithm of their number."""
    begin = number + 1 - ((number + 1) & -(number + 1))
    return begin, _runs(begin, number)


def _before(spark: SparkSession, path: str, schema: str, runs: list[tuple[int, int]]) -> DataFrame:
    """What the micro-batches of some runs have put down. A batch that is run again does not see itself."""
    return spark.read.schema(schema).parquet(*[f"{path}/{a}-{b}" for a, b in runs]) if runs else spark.createDataFrame([], schema)


def bloom_stream(stream: DataFrame, bits: int, hashes: int) -> DataFrame:
    """As sketches.bloom_fpr(), for a stream (seq, id, batch) whose micro-batches are one or more whole batches each: one row a batch.

    The filter and the ids seen so far are files in the shared folder, to which a micro-batch adds its own; both are read by joins. One write puts down all that it finds.
    """
    path = shared_path(stream.sparkSession, "bloom")
    schema = "id bigint, bit bigint, set_at bigint, batch bigint, fp bigint, n bigint"

    def put(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        begin, taken = _merged(number)
        df = df.select(*[F.col(c).cast("bigint").alias(c) for c in ("seq", "id", "batch")])
        known = _before(spark, path, schema, _runs(0, number))
        ids, set_before = known.where("id IS NOT NULL").select("id"), known.where("bit IS NOT NULL").select("bit", "set_at")
        first = sketches.bloom_first(df).join(ids, "id", "left_anti")
        hit, set_at = sketches.bloom_hits(first, bits, hashes, set_before)
        none = lambda *names: [F.lit(None).cast("bigint").alias(x) for x in names]
        new = first.select("id", *none("bit", "set_at", "batch", "fp", "n"))
        new = new.union(set_at.join(set_before, "bit", "left_anti").select(*none("id"), F.col("bit").cast("bigint"), "set_at", *none("batch", "fp", "n")))
        new = new.union(sketches.bloom_each(df, first, hit).select(*none("id", "bit", "set_at"), "batch", "fp", "n"))
        new.union(_before(spark, path, schema, taken)).write.mode("overwrite").parquet(f"{path}/{begin}-{number + 1}")

    _run(stream, put, path)
    last = _last(stream.sparkSession, path)
    return sketches.bloom_rows(_before(stream.sparkSession, path, schema, _runs(0, last)).where("batch IS NOT NULL").select("batch", "fp", "n"))


def fm_stream(stream: DataFrame, hashes: int = 100, length: int = 3, slide: int = 2) -> DataFrame:
    """As sketches.fm_windows(), for a stream (id, batch) whose micro-batches are one or more whole batches each: a window's row when its last batch, or a later one, is there.

    Between micro-batches, the distinct ids of the batches whose windows are still open are kept, and the last batch.
    """
    path = shared_path(stream.sparkSession, "fm")
    after = lambda last: max(0, (last - length + 1) // slide + 1)  # the first window that ends after batch ``last``

    def put(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        rows, opened = df.select(F.col("batch").cast("bigint").alias("batch"), F.col("id").cast("bigint").alias("id")), 0
        last = rows.agg(F.max("batch")).first()[0]
        if number:
            kept = spark.read.schema("batch bigint, id bigint").parquet(f"{path}/open/{number - 1}")
            before = kept.agg(F.max("batch")).first()[0]
            rows, opened, last = rows.union(kept), after(before), max(before, last)
        still = after(last)
        rows.where(F.col("batch") >= min(still * slide, last)).distinct().write.mode("overwrite").parquet(f"{path}/open/{number}")
        seen = sketches.begun_windows(rows, length, slide).where(F.col("w").between(opened, still - 1))
        sketches.fm_estimates(sketches.window_ids(seen), hashes).write.mode("overwrite").parquet(f"{path}/rows/{number}")

    _run(stream, put, path)
    return stream.sparkSession.read.schema("w bigint, truth bigint, estimate double").parquet(f"{path}/rows/*")


def _last(spark: SparkSession, path: str) -> int:
    """How many micro-batches have put down their rows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/*-*")
    found = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(where)
    return max((int(f.getPath().getName().split("-")[1]) for f in found), default=0)


def _run(stream: DataFrame, put: Callable, path: str) -> None:
    stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
