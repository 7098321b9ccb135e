"""Item-based collaborative filtering, feature regression, blending and evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.columns import tiered_mean
from sparkloom.operators.graph import spread_join
from sparkloom.session import cut_table, drop_table

#: Pairs of items that similarity_turns() adds up in a turn, and the items that a user has in a list; users with more are joined with themselves.
TURN_PAIRS, LONG_LIST = 50_000_000, 2_048
#: Ratings whose users' lists are made at a time, and items of which the means are broadcast: with more, they are joined by a shuffle.
LIST_ROWS, FEW_ITEMS = 12_000_000, 200_000


def rounded_mean(x: str) -> F.Column:
    """Mean to four places; what is a tie but for the order of additions goes up."""
    return F.round(F.avg(x) + 1e-9, 4)


def ratings(df: DataFrame, user: str, item: str, value: str) -> DataFrame:
    """(u, i, x), one row for each user and item: repeated ratings are averaged."""
    return df.groupBy(F.col(user).alias("u"), F.col(item).alias("i")).agg(F.avg(value).alias("x"))


def item_means(r: DataFrame) -> DataFrame:
    """(i, mu, n, base): rounded mean, raters, and tiered mean."""
    return r.groupBy("i").agg(rounded_mean("x").alias("mu"), F.count("*").alias("n"), tiered_mean("x").alias("base"))


def few(items: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Marks what has a row for each of these items for a broadcast, if there are few."""
    return F.broadcast if items.count() <= FEW_ITEMS else lambda df: df


def similarity_turns(r: DataFrame, means: DataFrame, targets: DataFrame | None = None) -> Iterator[tuple[Callable[[str], Column], DataFrame]]:
    """(mine, rows) of each turn; rows: (i, j, ti, tj, w), each pair of positive correlation once, i being the item with the fewer raters, or else the lesser; ti and tj: whether it is a target. mine(x): whether column x, as i, is of this turn.

    A user's items are lists, those with the fewest raters first. Each item goes, with what follows it in the list, to the task that adds up all of its pairs: pairs are made there and never shuffled, and
    a popular item gets few. This is done in turns of about TURN_PAIRS pairs by a hash of the item. rows must be put down by cut_table() before the next turn, so that a turn's shuffle files are gone by then.
    """
    held = means.select("i", "mu", "n", F.lit(True).alias("t"))
    if targets is not None:
        held = held.drop("t").join(targets.select("i", F.lit(True).alias("t")), "i", "left").fillna(False, ["t"])
    d = cut_table(r.where("u IS NOT NULL").join(few(means)(held), "i").select("u", "i", "n", "t", (F.col("x") - F.col("mu")).alias("d")))
    long = cut_table(d.groupBy("u").agg(F.count("*").alias("items")).where(F.col("items") > LONG_LIST).select("u"))
    some = not long.isEmpty()
    of = max(1, -(-d.count() // LIST_ROWS))
    made = []
    for part in range(of):  # the shuffle files of one part of the users at a time
        own = d.where(F.pmod(F.xxhash64("u"), F.lit(of)) == part)
        listed = (own.join(long, "u", "left_anti") if some else own).groupBy("u").agg(F.array_sort(F.collect_list(F.struct("n", "i", "d", "t"))).alias("v"))
        made.append(cut_table(listed.where("size(v) > 1 AND exists(v, e -> e.t)").select(F.col("v.i").alias("js"), F.col("v.d").alias("ds"), F.col("v.t").alias("ts"))))
    lists = reduce(DataFrame.union, made)
    # where there are none, d must not be read here: what is left of an empty join's other side would still run when d's files go
    wide = cut_table(d.join(long, "u", "left_semi") if some else d.where(F.lit(False)))
    drop_table(d)
    drop_table(long)
    a, b = (wide.select("u", *[F.col(x).alias(f"{x}{k}") for x in ("i", "n", "t", "d")]) for k in (1, 2))
    pairs = sum(x.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0 for x in (lists.select(F.size("js").alias("n")), wide.groupBy("u").agg(F.count("*").alias("n"))))
    turns = max(1, int(-(-pairs // TURN_PAIRS)))
    for turn in range(turns):
        mine = lambda x, turn=turn: F.pmod(F.xxhash64(x), F.lit(turns)) == turn
        after = lambda x: F.slice(x, F.col("k") + 2, F.size(x))
        rows = lists.select(F.posexplode("js").alias("k", "i"), "js", "ds", "ts").where(mine("i") & (F.col("k") + 1 < F.size("js")))
        rows = rows.select("i", F.get("ds", F.col("k")).alias("di"), F.get("ts", F.col("k")).alias("ti"), after("js").alias("js"), after("ds").alias("ds"), after("ts").alias("ts")).where("ti OR array_contains(ts, true)")
        met = rows.repartition("i").select("i", "di", "ti", F.posexplode("js").alias("k", "j"), "ds", "ts").select("i", "j", "di", F.get("ds", F.col("k")).alias("dj"), "ti", F.get("ts", F.col("k")).alias("tj"))
        if some:
            both = spread_join(a.where(mine("i1")), b, "u").where("struct(n1, i1) < struct(n2, i2)")
            met = met.union(both.select(F.col("i1").alias("i"), F.col("i2").alias("j"), F.col("d1").alias("di"), F.col("d2").alias("dj"), F.col("t1").alias("ti"), F.col("t2").alias("tj")))
        sums = met.where("i <> j AND (ti OR tj)").groupBy("i", "j", "ti", "tj").agg(F.sum(F.col("di") * F.col("dj")).alias("p"), F.sum(F.col("di") * F.col("di")).alias("a"), F.sum(F.col("dj") * F.col("dj")).alias("b"))
        yield mine, sums.where("a > 0 AND b > 0 AND p > 0").select("i", "j", "ti", "tj", (F.col("p") / F.sqrt(F.col("a") * F.col("b"))).alias("w"))
    for x in (*made, wide):
        drop_table(x)


def item_similarity(r: DataFrame, means: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(i, j, w), both ways round, w > 0: correlation of the deviations from each item's own mean over common raters. targets: distinct i, to which the first item is held."""
    half = reduce(DataFrame.union, [cut_table(rows) for _, rows in similarity_turns(r, means, targets)])
    if targets is None:
        return half.select("i", "j", "w").union(half.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    return half.where("ti").select("i", "j", "w").union(half.where("tj").select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))


def item_cf(r: DataFrame, tests: DataFrame, discount: bool = True, least_neighbours: int = 0, cold: float = 3.0) -> DataFrame:
    """(u, i, cf, fallback) for distinct tests (u, i): cf is null where there are too few neighbours.

    Neighbours are the user's other rated items of positive similarity. With ``discount``, a neighbour counts less by the logarithm of its raters.
    A turn's similarities meet the tests' pairs at once and only sums of them are kept, so that they are never all there.
    fallback: the item's tiered mean; without one the user's mean; without both ``cold``.
    """
    means, tests = cut_table(item_means(r)), cut_table(tests)
    users = cut_table(r.groupBy("u").agg(rounded_mean("x").alias("user_mean")))
    raters = lambda k: means.select(F.col("i").alias(k), F.col("n").alias(f"n{k}"))
    beside = few(means)
    near = tests.join(beside(raters("i")), "i").join(r.select("u", F.col("i").alias("j"), "x"), "u").where("i <> j").join(beside(raters("j")), "j")
    held = cut_table(near.select("u", "i", "ni", "j", "nj", "x"))
    kind, first = r.schema["i"].dataType, (F.col("ni") < F.col("nj")) | ((F.col("ni") == F.col("nj")) & (F.col("i") < F.col("j")))
    low, high = F.when(first, F.col("i")).otherwise(F.col("j")).cast(kind).alias("low"), F.when(first, F.col("j")).otherwise(F.col("i")).cast(kind).alias("high")
    near = held.select("u", "i", "x", F.col("nj").alias("n"), low, high)
    weight, parts = F.col("w") / (1 + F.log("n")) if discount else F.col("w"), []
    for mine, rows in similarity_turns(r, means, tests.select("i").distinct()):
        pairs = rows.select(F.col("i").alias("low"), F.col("j").alias("high"), "w")
        met = near.where(mine("low")).join(pairs, ["low", "high"]).groupBy("u", "i")
        parts.append(cut_table(met.agg(F.count("*").alias("neighbours"), F.count_if(F.col("w") >= 0.3).alias("strong"), F.count_if(F.col("w") >= 0.5).alias("strongest"), F.sum(F.col("x") * weight).alias("above"), F.sum(weight).alias("below"))))
    drop_table(held)
    told = reduce(DataFrame.union, parts).groupBy("u", "i").agg(*[F.sum(c).alias(c) for c in ("neighbours", "strong", "strongest")], (F.sum("above") / F.sum("below")).alias("res"))
    rows = tests.join(told, ["u", "i"], "left").join(means.select("i", "base"), "i", "left").join(users, "u", "left")
    both = F.col("base").isNotNull() & F.col("user_mean").isNotNull()
    enough = (F.col("strong") > 0) & (F.col("neighbours") > least_neighbours)
    if least_neighbours:
        enough = enough & (F.col("strongest") > 0)
    blend = F.when(F.col("strongest") == 0, 0.2 * F.col("res") + 0.8 * F.col("base")).otherwise(0.4 * F.col("res") + 0.6 * F.col("base"))
    return rows.select("u", "i", F.when(both & enough, blend).alias("cf"), F.coalesce("base", "user_mean", F.lit(cold)).alias("fallback"))


def predict(r: DataFrame, tests: DataFrame) -> DataFrame:
    """(u, i, prediction)."""
    return item_cf(r, tests).select("u", "i", F.coalesce("cf", "fallback").alias("prediction"))


def hybrid(cf: DataFrame, model: DataFrame, share: float = 0.2) -> DataFrame:
    """(u, i, prediction), with what else model has between them: the model's where cf is null, else ``share`` of cf and the rest of the model. model: (u, i, m)."""
    mixed = F.when(F.col("cf").isNull(), F.col("m")).otherwise(share * F.col("cf") + (1 - share) * F.col("m")).alias("prediction")
    return model.join(cf.select("u", "i", "cf"), ["u", "i"], "left").select("u", "i", *[F.col(f"`{c}`") for c in model.columns if c not in ("u", "i", "m")], mixed)


def boosted_trees(train: DataFrame, test: DataFrame, features: list[str], target: str, trees: int = 500, depth: int = 5, rate: float = 0.1, seed: int = 1) -> DataFrame:
    """test with a column m, by gradient boosted trees. The trees come one after another, and each takes ``depth`` passes over what the tasks hold of train, which is read three times."""
    from sparkloom.operators.trees import learn, predict

    return predict(test, learn(train, features, target, trees, depth, rate, seed), features)


def evaluate(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """(bucket, n, rmse): rows by whole absolute error, 4 and more as one, beside the root mean square error of all."""
    e = df.select((F.col(truth) - F.col(prediction)).alias("e"))
    total = e.agg(F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"))
    return e.groupBy(F.least(F.floor(F.abs("e")), F.lit(4)).cast("int").alias("bucket")).agg(F.count("*").alias("n")).join(F.broadcast(total))  # one row
