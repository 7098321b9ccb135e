"""Frequent item sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.session import cut_table, drop_table

#: Occurrences that all_frequent() counts in a turn.
TURN_ROWS = 25_000_000


def build_baskets(df: DataFrame, basket: str, item: str, more_than: int = 0) -> DataFrame:
    """Distinct (basket, item) of the baskets with more than ``more_than`` distinct items."""
    rows = df.select(F.col(basket).alias("basket"), F.col(item).alias("item")).where("basket IS NOT NULL AND item IS NOT NULL").distinct()
    if not more_than:
        return rows
    large = rows.groupBy("basket").count().where(F.col("count") > more_than).select("basket")
    return rows.join(large, "basket", "left_semi")


def frequent_itemsets(baskets: DataFrame, support: int, k: int) -> DataFrame:
    """(item1, ..., itemk, n): sets in at least ``support`` baskets. Each level extends only occurrences of the last level's frequent sets by frequent items."""
    single = baskets.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= support)
    if k == 1:
        return single.select(F.col("item").alias("item1"), "n")
    rows = baskets.join(single.select("item"), "item", "left_semi")
    found, held = None, rows.select("basket", F.col("item").alias("item1"))
    for level in range(2, k + 1):
        names = [f"item{i}" for i in range(1, level + 1)]
        more = rows.select(F.col("basket").alias("b"), F.col("item").alias(names[-1]))
        held = held.join(more, (held.basket == more.b) & (held[names[-2]] < more[names[-1]])).select("basket", *names)
        found = held.groupBy(*names).agg(F.count("*").alias("n")).where(F.col("n") >= support)
        if level < k:
            held = held.join(found.select(*names), names, "left_semi").select("basket", *names)
    return found


def all_frequent(baskets: DataFrame, support: int) -> DataFrame:
    """(items, freq) of every size, by pattern growth: FP-growth's conditional bases as rows, so that no tree has to fit a task's memory. Items are in order.

    A row is a frequent set, what follows it in a basket, and how many baskets have just that. Sets grow by one of the items that follow, and only occurrences of frequent sets go on. Each level is
    counted in turns of about TURN_ROWS occurrences by a hash of the set; a turn's shuffle files are removed before the next one's.
    """
    plain = cut_table(baskets.where("item IS NOT NULL").select("basket", "item").distinct())
    single = cut_table(plain.groupBy("item").agg(F.count("*").alias("freq")).where(F.col("freq") >= support))
    rest = plain.join(single.select("item"), "item", "left_semi").groupBy("basket").agg(F.array_sort(F.collect_list("item")).alias("rest"))
    held = cut_table(rest.where("size(rest) > 1").groupBy("rest").agg(F.count("*").alias("n")))
    drop_table(plain)
    out, names = [single.select(F.array("item").alias("items"), "freq")], ["item1"]
    follow = lambda rows, *own: rows.select(*own, "n", F.posexplode("rest").alias("k", "next"), "rest")
    less = F.slice("rest", F.col("k") + 2, F.size("rest")).alias("rest")
    rows = follow(held).select(F.col("next").alias("item1"), "n", less).where("size(rest) > 0")
    while True:
        turns = max(1, -(-(rows.agg(F.sum(F.size("rest"))).first()[0] or 0) // TURN_ROWS))
        parts = []
        for turn in range(turns):
            mine = rows.where(F.pmod(F.xxhash64(*names), F.lit(turns)) == turn).select(*names, "n", F.explode("rest").alias("next"))
            parts.append(cut_table(mine.groupBy(*names, "next").agg(F.sum("n").alias("freq")).where(F.col("freq") >= support)))
        found = cut_table(reduce(DataFrame.union, parts))
        for part in parts:
            drop_table(part)
        if found.isEmpty():
            return reduce(DataFrame.union, out)
        out.append(found.select(F.array(*names, "next").alias("items"), "freq"))
        on = follow(rows, *names).join(found.select(*names, "next"), [*names, "next"])
        names.append(f"item{len(names) + 1}")
        on = on.select(*names[:-1], F.col("next").alias(names[-1]), "n", less).where("size(rest) > 0")
        last, held = held, cut_table(on.groupBy(*names, "rest").agg(F.sum("n").alias("n")))
        drop_table(last)
        rows = held


def son_candidates(parted: DataFrame, support: int, k: int = 2) -> DataFrame:
    """(k, items) that are frequent in some part. parted: (part, basket, item). Singles are the globally frequent ones; the thresholds are compared as whole numbers."""
    rows = parted.select("part", "basket", "item").distinct()
    size = rows.groupBy("part").agg(F.count_distinct("basket").alias("size"))
    total = size.agg(F.sum("size").alias("total"))
    limits = size.join(F.broadcast(total))  # one row beside as many as there are parts
    single = rows.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= support).select("item")
    out = [single.select(F.lit(1).alias("k"), F.col("item").cast("string").alias("items"))]
    good, held = rows.join(single, "item", "left_semi"), None
    held = good.select("part", "basket", F.col("item").alias("item1"))
    for level in range(2, k + 1):
        names = [f"item{i}" for i in range(1, level + 1)]
        more = good.select(F.col("part").alias("p"), F.col("basket").alias("b"), F.col("item").alias(names[-1]))
        held = held.join(more, (held.part == more.p) & (held.basket == more.b) & (held[names[-2]] < more[names[-1]])).select("part", "basket", *names)
        local = held.groupBy("part", *names).agg(F.count("*").alias("n")).join(limits, "part").where(F.col("n") * F.col("total") >= support * F.col("size"))
        out.append(local.select(F.lit(level).alias("k"), F.concat_ws(",", *names).alias("items")).distinct())
        if level < k:
            held = held.join(local.select("part", *names), ["part", *names], "left_semi").select("part", "basket", *names)
    return reduce(DataFrame.union, out)


def count_candidates(baskets: DataFrame, candidates: DataFrame) -> DataFrame:
    """(k, items, n): in how many baskets each candidate lies whole. candidates: (k, items), members joined by commas, with no repeats.

    A candidate meets a basket at each of its members that the basket holds, and lies in it where there are k of them: one equi-join, no pass over all pairs.
    """
    members = candidates.select("k", "items", F.explode(F.split("items", ",")).alias("item"))
    met = baskets.select("basket", F.col("item").cast("string").alias("item")).join(members, "item").groupBy("k", "items", "basket").agg(F.count("*").alias("held"))
    return met.where("held = k").groupBy("k", "items").agg(F.count("*").alias("n"))


def son(parted: DataFrame, support: int, k: int = 3) -> DataFrame:
    """(k, items, n) of all sets of up to k items in at least ``support`` baskets: candidates of the parts, then their counts over all baskets."""
    found = count_candidates(parted.select("basket", "item").distinct(), son_candidates(parted, support, k))
    return found.where(F.col("n") >= support)
