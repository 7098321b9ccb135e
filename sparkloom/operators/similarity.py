"""Similar sets: exact Jaccard and MinHash with bands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.columns import linear_hash
from sparkloom.operators.graph import HOT_SHARE, LEAST_HOT, hot_values, lookup, spread_join
from sparkloom.session import cut, cut_table, drop_part, drop_table

PRIME = 2_147_483_647
#: Rows of bands that are joined in a turn, and groups in which the pairs of several turns are made distinct.
TURN_ROWS, GROUPS = 20_000_000, 8


def as_arrays(sets: DataFrame) -> DataFrame:
    """(id, items): each set as an array, rarest items first. sets: distinct (id, item)."""
    often = sets.groupBy("item").agg(F.count("*").alias("often"))
    ranked = lookup(sets, often, "item")
    return ranked.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("often", "item"))), lambda x: x["item"]).alias("items"))


def _jaccard(a: str, b: str) -> F.Column:
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def jaccard_join(sets: DataFrame, least: float = 0.5) -> DataFrame:
    """(id1, id2, similarity) with id1 < id2. sets: distinct (id, item).

    Sets that are similar enough share one of their rarest items: of n items, all but the ceil(least * n) - 1 most frequent. Only these meet in the join, so a popular item
    does not give the square of its sets; a pair counts at the first item that they share.
    """
    own = cut(as_arrays(sets))
    rare = F.expr(f"slice(items, 1, size(items) - cast(ceil({least} * size(items) - 1e-9) AS int) + 1)")
    met = own.select("id", "items", F.explode(rare).alias("item"))
    a, b = (met.select("item", F.col("id").alias(f"id{k}"), F.col("items").alias(f"items{k}")) for k in (1, 2))
    near = (F.size("items1") >= least * F.size("items2")) & (F.size("items2") >= least * F.size("items1"))
    first = F.element_at(F.array_intersect("items1", "items2"), 1) == F.col("item")
    pairs = spread_join(a, b, "item", hot_values(met, "item")).where((F.col("id1") < F.col("id2")) & near & first)
    return pairs.select("id1", "id2", _jaccard("items1", "items2").alias("similarity")).where(F.col("similarity") >= least)


def minhash(sets: DataFrame, hashes: int) -> DataFrame:
    """(id, sig): array of the least value of each hash over a set's items (whole numbers); one partial aggregation, no row for each hash."""
    agg = sets.groupBy("id").agg(*[F.min(linear_hash(F.col("item"), k, PRIME)).alias(f"h{k}") for k in range(hashes)])
    return agg.select("id", F.array(*[f"h{k}" for k in range(hashes)]).alias("sig"))


def least_hashes(k: int) -> F.Column:
    """Value k of minhash()'s signature, from a set as an array in column items."""
    return F.array_min(F.transform("items", lambda x: linear_hash(x, k, PRIME)))


def _met(own: DataFrame, hashes: int, rows: int, beside: list[str], value=least_hashes):
    """For one turn of bands after the other, the pairs that agree there: (id1, id2) with id1 < id2 and what is ``beside``, of either; a pair may come more than once. own: (id, items), or what value needs."""
    n, values = max(1, own.count()), ["band", *[f"h{r}" for r in range(rows)]]
    at_once = max(1, TURN_ROWS // n)
    # sets in a bucket share an item, so where none is in many sets, no bucket is hot
    often = own.select(F.explode("items").alias("item")).groupBy("item").count().agg(F.max("count")).first()[0] or 0 if "items" in own.columns else n
    for first in range(0, max(1, hashes // rows), at_once):
        turn = range(first, min(hashes // rows, first + at_once))
        # each value is made by itself: a whole signature would be made for every turn
        made = own.select("id", *beside, *[value(b * rows + r).alias(f"v{b}_{r}") for b in turn for r in range(rows)])
        kept = made.select("id", *beside, F.explode(F.array(*[F.struct(F.lit(b).alias("band"), *[F.col(f"v{b}_{r}").alias(f"h{r}") for r in range(rows)]) for b in turn])).alias("b")).select("id", *beside, "b.*")
        kept = kept.withColumn("key", F.xxhash64(*values))
        hot = hot_values(kept, "key") if often > max(LEAST_HOT, n * len(turn) // HOT_SHARE) else []
        a, b = (kept.select("key", *[F.col(x).alias(f"{x}{k}") for x in ("id", *beside, *values)]) for k in (1, 2))
        same = reduce(lambda x, y: x & y, [F.col(f"{x}1") == F.col(f"{x}2") for x in values])
        yield spread_join(a, b.hint("shuffle_hash"), "key", hot).where((F.col("id1") < F.col("id2")) & same).select("id1", "id2", *[f"{x}{k}" for x in beside for k in (1, 2)])


def lsh_candidates(signatures: DataFrame, rows: int = 2) -> DataFrame:
    """(id1, id2), id1 < id2, that agree on ``rows`` neighbouring values of their signatures somewhere. Buckets are joined by one number each, and their values compared."""
    signatures = cut_table(signatures)
    first = signatures.select(F.size("sig")).first()
    return _candidates(_met(signatures, first[0] if first else rows, rows, [], lambda k: F.col("sig")[k]))


def lsh_candidates_of(sets: DataFrame, hashes: int = 100, rows: int = 2) -> DataFrame:
    """lsh_candidates(minhash(sets, hashes), rows), where signatures are never held: each turn makes its own values of them."""
    return _candidates(_met(cut_table(sets.groupBy("id").agg(F.collect_list("item").alias("items"))), hashes, rows, []))


def _candidates(turns) -> DataFrame:
    """Distinct pairs of the turns of bands, which have about TURN_ROWS rows each; what several turns find is made distinct group by group of id1. So shuffle files are of one turn or group only."""
    tables = [cut_table(pairs.distinct().withColumn("g", F.pmod(F.xxhash64("id1"), F.lit(GROUPS)).cast("int")), "g") for pairs in turns]
    if len(tables) == 1:
        return tables[0].select("id1", "id2")
    out = []
    for g in range(GROUPS):
        out.append(cut_table(reduce(DataFrame.union, [t.where(F.col("g") == g).select("id1", "id2") for t in tables]).distinct()))
        for t in tables:
            drop_part(t, f"g={g}")
    for t in tables:
        drop_table(t)
    return reduce(DataFrame.union, out)


def lsh_jaccard(sets: DataFrame, hashes: int = 100, rows: int = 2, least: float = 0.5) -> DataFrame:
    """Candidates by bands, verified by exact Jaccard of the sets as arrays, which go with the bands: what is not similar enough is never written. Bands are taken in turns, as in lsh_candidates()."""
    own = cut_table(sets.groupBy("id").agg(F.collect_list("item").alias("items")))
    near = (F.size("items1") >= least * F.size("items2")) & (F.size("items2") >= least * F.size("items1"))
    found = [cut_table(pairs.where(near).select("id1", "id2", _jaccard("items1", "items2").alias("similarity")).where(F.col("similarity") >= least)) for pairs in _met(own, hashes, rows, ["items"])]
    drop_table(own)
    return reduce(DataFrame.union, found).distinct()
