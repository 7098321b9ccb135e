"""Benchmark decontamination by a broadcast hash set of normalised n-grams, with built-in functions only.

The benchmark's windows of ten words are hashed twice: a gate over three of their words, and a hash of all. Distinct gates are broadcast, after a count: at most
``SET_GATES`` of eight bytes at a time, and a larger set goes in shards, with one scan each. Every window of a document looks up its gate within the scan; what passes is
verified by a join on hash and words with the benchmark's windows. There is one plan for benchmarks of all sizes, and only what passes the gates is ever shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import spaced_words, table, unused
from sparkloom.session import cut, cut_table

WINDOW, SET_GATES = 10, 4_000_000
#: Most spans of found rows that go to every worker when hits are put back beside their rows; more meet them in a shuffled join.
SENT_BACK = 500_000
#: A window's place and length travel in one number; the place 0 stands for the row itself.
PLACE = 1_024


def windows_of(items: DataFrame, n: int = WINDOW, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, len, hash, words, gate) of each distinct window; gate is a hash of its length and its first, middle and last word; an item of fewer words, but not none, is one window."""
    if not 0 < n < PLACE:
        raise ValueError(f"windows have 1 to {PLACE - 1} words")
    words = F.split(F.trim(spaced_words(F.col(f"`{text}`").cast("string"))), " ")
    items = items.select(F.col(f"`{item_id}`").cast("string").alias("item_id"), words.alias("w")).where("w[0] <> ''")
    items = items.withColumn("len", F.least(F.size("w"), F.lit(n)))
    found = items.select("item_id", "len", "w", F.explode(F.expr("sequence(1, size(w) - len + 1)")).alias("at")).select("item_id", "len", F.slice("w", F.col("at"), F.col("len")).alias("g"))
    return found.select("item_id", "len", F.xxhash64("g").alias("hash"), F.array_join("g", " ").alias("words"), F.expr("xxhash64(len, g[0], g[len div 2], g[len - 1])").alias("gate")).distinct()


def _places(lengths: list[int], whole: bool) -> Column:
    """Places and lengths of all windows of the words w; with whole also the place of the row itself."""
    of = lambda k: f"CASE WHEN w[0] <> '' AND size(w) >= {k} THEN sequence({PLACE + k}L, {PLACE}L * (size(w) - {k} + 1) + {k}L, {PLACE}L) ELSE cast(array() AS array<bigint>) END"
    return F.expr(f"concat(cast(array({'0L' if whole else ''}) AS array<bigint>), {', '.join(map(of, lengths)) or 'cast(array() AS array<bigint>)'})")


def _verified(rows: DataFrame, windows: DataFrame, keys: list[str], set_gates: int, whole: bool) -> DataFrame:
    """The keys, head, spans (sorted, distinct, of words, end exclusive) and ids of rows (keys, head, w) with hits; with whole of all rows.

    Rows of equal keys count as one. A row's head travels once, whatever its hits.
    """
    windows = cut(windows)
    lengths = sorted(r.len for r in windows.select("len").distinct().collect())  # as many as a window has words
    gates = windows.select("gate").distinct()
    shards = max(1, -(-gates.count() // set_gates))
    if shards > 1:
        rows = cut_table(rows)  # its keys may be numbers that a second scan would give to other rows
    passed = []
    for shard in range(shards):
        own = gates if shards == 1 else gates.where(F.pmod(F.xxhash64("gate"), F.lit(shards)) == shard)
        here = whole and not shard
        if here:
            own = own.union(rows.sparkSession.sql("SELECT 0L AS gate"))
        at = rows.select(*keys, "head", "w", F.explode_outer(_places(lengths, here)).alias("p"))
        at = at.withColumn("gate", F.expr(f"CASE WHEN p = 0 THEN 0L ELSE xxhash64(cast(p % {PLACE} AS int), w[cast(p div {PLACE} AS int) - 1], w[cast(p div {PLACE} + (p % {PLACE}) div 2 AS int) - 1], w[cast(p div {PLACE} + p % {PLACE} AS int) - 2]) END"))
        at = at.join(F.broadcast(own), "gate")  # set_gates numbers at most
        slot = f"slice(w, cast(p div {PLACE} AS int), cast(p % {PLACE} AS int))"
        # the row itself has a hash of its own, so that such rows do not meet in one task, and no words, so that they match nothing
        passed.append(at.select(*keys, F.expr("CASE WHEN p = 0 THEN head END").alias("head"), "p", F.expr(f"CASE WHEN p = 0 THEN xxhash64({', '.join(keys)}) ELSE xxhash64({slot}) END").alias("hash"), F.expr(f"CASE WHEN p > 0 THEN array_join({slot}, ' ') END").alias("words")))
    told = windows.groupBy("hash", "words").agg(F.collect_set("item_id").alias("ids"))  # as many as items have the window
    joined = reduce(DataFrame.union, passed).join(told, ["hash", "words"], "left" if whole else "inner")
    span = F.when(F.col("ids").isNotNull(), F.expr(f"named_struct('start', cast(p div {PLACE} - 1 AS int), 'end', cast(p div {PLACE} - 1 + p % {PLACE} AS int))"))
    return joined.groupBy(*keys).agg(F.first("head", ignorenulls=True).alias("head"), F.array_sort(F.collect_set(span)).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("ids"))


def _merged(spans: Column) -> Column:
    """Sorted spans as ones without overlaps, in time proportional to their number.

    A word is a boundary where the number of spans that have begun there or before equals that of those that have ended before it.
    """
    starts = F.transform(spans, lambda s: s["start"])
    ends = F.array_sort(F.transform(spans, lambda s: s["end"]))
    n = F.size(spans)
    first = F.filter(F.arrays_zip(starts.alias("s"), F.concat(F.array(F.lit(-1)), F.slice(ends, 1, F.greatest(n - 1, F.lit(0)))).alias("e")), lambda x: (x["e"] < 0) | (x["s"] > x["e"]))
    last = F.filter(F.arrays_zip(F.concat(F.slice(starts, 2, F.greatest(n - 1, F.lit(0))), F.array(F.lit(2**31 - 1))).alias("s"), ends.alias("e")), lambda x: x["s"] > x["e"])
    kind = "array<struct<start:int,end:int>>"
    return F.when(n > 0, F.zip_with(first, last, lambda a, b: F.struct(a["s"].alias("start"), b["e"].alias("end")))).otherwise(F.array().cast(kind))


def _split(text: Column) -> Column:
    return F.split(F.trim(spaced_words(text.cast("string"))), " ")


ADDED = ("n_words", "n_hit", "hits", "items")


def scan(df: DataFrame, items: DataFrame, n: int = WINDOW, text: str = "text", item_id: str = "item_id", item_text: str = "text", set_gates: int = SET_GATES) -> DataFrame:
    """df's columns without its text, then n_words, n_hit, hits (spans of words, end exclusive) and items (sorted ids as strings), a row for each row of df.

    A word inside any occurrence of a window is hit. Null and wordless texts have no words and no hits, nor do items without words.
    Items with equal windows all count; repeated rows stay apart; an empty table or benchmark gives no hits. Columns of df by the names that
    are added are replaced; no other name clashes.
    """
    keep = [c for c in df.columns if c.lower() not in (*ADDED, text.lower())]
    head = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.lit(0).alias("none"))
    rows = df.select(F.monotonically_increasing_id().alias("row"), head.alias("head"), _split(F.col(f"`{text}`")).alias("w"))
    rows = rows.select("row", F.struct("head", F.expr("CASE WHEN w[0] = '' THEN 0L ELSE cast(size(w) AS bigint) END").alias("n_words")).alias("head"), "w")
    out = _verified(rows, windows_of(items, n, item_id, item_text), ["row"], set_gates, True).select("head", "ids", _merged(F.col("spans")).alias("hits"))
    hit = F.expr("cast(aggregate(hits, 0, (a, x) -> a + x.end - x.start) as bigint)")
    return out.select(*[F.col(f"head.head.c{i}").alias(c) for i, c in enumerate(keep)], F.col("head.n_words").alias("n_words"), hit.alias("n_hit"), "hits", F.col("ids").alias("items"))


def _with_hits(df: DataFrame, items: DataFrame, n: int, text: str, set_gates: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """df with keys of its rows, the hits by those keys, and the keys' names and that of the hits. Keys are hashes of the row: equal rows have equal hits."""
    key, other, hits = unused(df, "key_", "key2_", "hits_")
    cols = [F.col(f"`{c}`") for c in df.columns]
    keyed = df.withColumns({key: F.xxhash64(*cols), other: F.hash(*cols)})
    rows = keyed.select(F.col(key).alias("k1"), F.col(other).alias("k2"), F.lit(None).cast("int").alias("head"), _split(F.col(f"`{text}`")).alias("w"))
    found = _verified(rows, windows_of(items, n), ["k1", "k2"], set_gates, False)
    found = cut(found.select(F.col("k1").alias(key), F.col("k2").alias(other), _merged(F.col("spans")).alias(hits)))
    return keyed, found, [key, other, hits]


def _bounded(found: DataFrame, spans: str | None) -> DataFrame:
    """found, to be broadcast if it is small enough."""
    many = found.agg(F.coalesce(F.sum(F.size(spans) + 1 if spans else F.lit(1)), F.lit(0))).first()[0]
    return F.broadcast(found) if many <= SENT_BACK else found


def remove_documents(df: DataFrame, items: DataFrame, n: int = WINDOW, text: str = "text", set_gates: int = SET_GATES) -> DataFrame:
    """df without the rows that hold a window of the benchmark.

    Rows with null, empty or wordless texts stay, as do all with an empty benchmark; repeated rows stay or go alike; an empty table gives an empty one; no column name clashes.
    """
    keyed, found, (key, other, _) = _with_hits(df, items, n, text, set_gates)
    return keyed.join(_bounded(found.select(key, other), None), [key, other], "left_anti").drop(key, other)


def remove_spans(df: DataFrame, items: DataFrame, n: int = WINDOW, text: str = "text", set_gates: int = SET_GATES) -> DataFrame:
    """df with the hit words, and what stands before each, taken out of the texts; rows without hits stay as they are. Other cases are as in remove_documents()."""
    keyed, found, (key, other, hits) = _with_hits(df, items, n, text, set_gates)
    marked = keyed.join(_bounded(found, hits), [key, other], "left").drop(key, other)
    between, word = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    pieces = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"{between}*+{word}++"), F.lit(0))
    tail = F.regexp_extract(F.col(f"`{text}`"), f"(?<!{between}){between}++$", 0)
    left = F.filter(pieces, lambda p, i: ~F.exists(F.col(hits), lambda h: (i >= h["start"]) & (i < h["end"])))
    return marked.withColumn(text, F.when(F.size(hits) > 0, F.concat(F.array_join(left, ""), tail)).otherwise(F.col(f"`{text}`"))).select(*[F.col(f"`{c}`") for c in df.columns])


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    """All documents against the whole benchmark."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scan(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: Used for the driver's SQL check.
ORACLE = """
WITH w AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM w WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
h AS (SELECT r, i, p.n, item_id FROM p JOIN g ON p.n = g.n AND p.g = g.g),
k AS (SELECT r, count(DISTINCT i + j) AS n_hit FROM (SELECT r, i, unnest(range(n)) AS j FROM (SELECT DISTINCT r, i, n FROM h)) GROUP BY r),
m AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN k USING (r) LEFT JOIN m USING (r)
"""
