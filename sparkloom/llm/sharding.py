"""Contiguous shards of near equal bytes, by global prefix sums.

Rows are put in one global order by a range partitioning of small keys and cut to the shared checkpoint folder once. Each
partition's total goes to the driver (one number a partition); from these come the offsets at which the partitions begin, and a
row's shard is where its first byte falls among the equal targets. The order is by the text's hash, so equal texts stand together and
are parted only where a cut falls into their group: sizes come first, as one group may be larger than a shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import table
from sparkloom.session import cut

SHARDS, OVERHEAD = 24, 8
SCHEMA = "doc_id {}, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int"


def shards_of(starts: np.ndarray, total: int, shards: int) -> np.ndarray:
    """The shard in which each first byte falls, without overflow."""
    cuts = np.array([total * k // shards for k in range(1, shards)], dtype=np.int64)
    return np.searchsorted(cuts, starts, side="right")


def shard_by_bytes(df: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row; law is 'bytes'.

    size: the text's UTF-8 bytes plus 8; null texts count as empty, with crc 0. slot: the place within the shard, gapless from 0. grown_shard is
    null. A shard's size is off its target by less than its largest row. Repeated rows, null ids and ties are kept, each in a place of its own; an
    empty table gives an empty one; other columns play no part.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), (F.octet_length(body).cast("bigint") + OVERHEAD).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("h"))
    rows = cut(rows.repartitionByRange("h", "text_crc32", "doc_id").sortWithinPartitions("h", "text_crc32", "doc_id"))
    rows = rows.drop("h").withColumn("pid", F.spark_partition_id())
    totals = sorted((r.pid, r.total) for r in rows.groupBy("pid").agg(F.sum("size").alias("total")).collect())
    offset, total = {}, 0
    for pid, t in totals:
        offset[pid], total = total, total + t

    def place(batches: Iterator[pa.RecordBatch], slots: dict | None = None) -> Iterator[pa.RecordBatch]:
        done, seen = {}, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            pid = batch.column(3)[0].as_py()
            size = batch.column(1).to_numpy()
            ends = np.cumsum(size) + done.get(pid, offset[pid])
            done[pid] = int(ends[-1])
            shard = shards_of(ends - size, total, shards)
            if slots is None:
                yield pa.RecordBatch.from_arrays([batch.column(3), pa.array(shard, type=pa.int32())], names=["pid", "shard"])
                continue
            slot = np.empty(len(shard), dtype=np.int64)
            for s in np.unique(shard):
                at = np.flatnonzero(shard == s)
                first = seen.get((pid, s), slots.get((pid, int(s)), 0))
                slot[at] = first + np.arange(len(at))
                seen[pid, s] = first + len(at)
            n = len(shard)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(["bytes"] * n), pa.array(shard, type=pa.int32()), pa.array(slot), pa.nulls(n, pa.int32())],
                names=["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
            )

    counts = rows.mapInArrow(place, "pid int, shard int").groupBy("pid", "shard").count().collect()
    slots, next_ = {}, [0] * shards
    for r in sorted(counts, key=lambda r: (r.shard, r.pid)):
        slots[r.pid, r.shard] = next_[r.shard]
        next_[r.shard] += r["count"]
    return rows.mapInArrow(lambda batches: place(batches, slots), SCHEMA.format(rows.schema["doc_id"].dataType.simpleString()))


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 24 shards."""
    return shard_by_bytes(table(spark, sf_dir, "documents"))
