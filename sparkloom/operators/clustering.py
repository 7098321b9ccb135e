"""Clustering by summaries (count, sum and sum of squares of each dimension), in rounds over parts of the data."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.session import cut

LEAST_VARIANCE = 1e-12


def summaries(points: DataFrame, group: str) -> DataFrame:
    """(group, dim, n, sum, sumsq), a row for each group and dimension. points: (group, features)."""
    return points.select(group, F.posexplode("features").alias("dim", "x")).groupBy(group, "dim").agg(F.count("*").alias("n"), F.sum("x").alias("sum"), F.sum(F.col("x") * F.col("x")).alias("sumsq"))


def collected(points: DataFrame, group: str) -> dict:
    """Summaries on the driver: {group: (n, sum, sumsq)}. As many numbers as there are groups times dimensions."""
    out: dict = {}
    for r in summaries(points, group).orderBy(group, "dim").collect():
        n, s, q = out.setdefault(r[group], (r.n, [], []))
        s.append(r["sum"])
        q.append(r["sumsq"])
    return {k: (n, np.array(s), np.array(q)) for k, (n, s, q) in out.items()}


def centre(summary) -> tuple[np.ndarray, np.ndarray]:
    n, s, q = summary
    c = s / n
    return c, np.maximum(q / n - c * c, LEAST_VARIANCE)


def nearest(known: dict, features: str = "features") -> Column:
    """Struct (distance, id) of the summary at the least Mahalanobis distance. Summaries are few and go with the plan; ties to the smaller id."""
    each = []
    for k in sorted(known):
        c, v = centre(known[k])
        z = F.zip_with(features, F.array(*map(F.lit, c.tolist())), lambda x, y: x - y)
        z = F.zip_with(z, F.array(*map(F.lit, v.tolist())), lambda d, s: d * d / s)
        each.append(F.struct(F.sqrt(F.aggregate(z, F.lit(0.0), lambda a, x: a + x)).alias("distance"), F.lit(k).alias("id")))
    return F.array_min(F.array(*each)) if each else F.lit(None).cast("struct<distance:double,id:int>")


def assign(points: DataFrame, known: dict, out: str = "cluster") -> DataFrame:
    """points and their nearest summary within 2 sqrt(dimensions), else -1."""
    near = nearest(known)
    return points.withColumn("near_", near).withColumn(out, F.when(F.col("near_.distance") < 2 * F.sqrt(F.size("features")), F.col("near_.id")).otherwise(-1)).drop("near_")


def _kmeans(points: DataFrame, k: int, seed: int) -> DataFrame:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = points.withColumn("v_", array_to_vector("features"))
    return KMeans(k=k, seed=seed, featuresCol="v_", predictionCol="c_").fit(v).transform(v).drop("v_")


def _merge(a, b):
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]


def _gap(a, b) -> float:
    (x, _), (y, v) = centre(a), centre(b)
    return math.sqrt(float((((x - y) ** 2) / v).sum()))


def bfr(points: DataFrame, k: int, loads: int = 5, seed: int = 1) -> tuple[DataFrame, list[list[int]]]:
    """((id, cluster), rounds): clusters 0.., -1 for outliers; each round's points in clusters, compressed sets, their points, and points left.

    points: (id, features). Loads are dealt by a hash of the id. Points stay in Spark; the driver holds summaries only.
    """
    parts = [cut(points.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(loads)) == j)) for j in range(loads)]
    limit = 2 * math.sqrt(len(parts[0].first().features)) if parts[0].take(1) else 0.0
    firsts = _kmeans(parts[0], min(5 * k, max(2, parts[0].count())), seed)
    sizes = firsts.groupBy("c_").count()
    left = cut(firsts.join(sizes.where("count = 1"), "c_", "left_semi").select("id", "features"))
    main = cut(_kmeans(firsts.join(sizes.where("count > 1"), "c_", "left_semi").select("id", "features"), k, seed).withColumnRenamed("c_", "cluster"))
    discard, placed = collected(main, "cluster"), main.select("id", F.col("cluster").cast("int").alias("cluster"))
    compressed: dict = {}
    member = left.select("id", F.lit(-1).alias("set")).limit(0)
    rounds, next_set = [], 0

    def regroup(left, member):
        nonlocal next_set
        if left.count() <= 5 * k:
            return left, member
        again = cut(_kmeans(left, 5 * k, seed))
        sizes = again.groupBy("c_").count()
        many = cut(again.join(sizes.where("count > 1"), "c_", "left_semi").withColumn("set", F.col("c_") + next_set))
        compressed.update(collected(many, "set"))
        next_set += 5 * k
        return cut(again.join(sizes.where("count = 1"), "c_", "left_semi").select("id", "features")), member.union(many.select("id", "set"))

    for j in range(loads):
        if j:
            near = cut(assign(assign(parts[j], discard), compressed, "set"))
            for key, s in collected(near.where("cluster >= 0"), "cluster").items():
                discard[key] = _merge(discard[key], s)
            for key, s in collected(near.where("cluster < 0 AND set >= 0"), "set").items():
                compressed[key] = _merge(compressed[key], s)
            placed = placed.union(near.where("cluster >= 0").select("id", "cluster"))
            member = member.union(near.where("cluster < 0 AND set >= 0").select("id", "set"))
            left = cut(left.union(near.where("cluster < 0 AND set < 0").select("id", "features")))
        left, member = regroup(left, member)
        moved: dict = {}
        while len(compressed) > 1:
            d, a, b = min((_gap(compressed[a], compressed[b]), a, b) for a in compressed for b in compressed if a != b)
            if d >= limit:
                break
            compressed[b] = _merge(compressed.pop(a), compressed[b])
            moved = {x: b if y == a else y for x, y in moved.items()} | {a: b}
        member = cut(_renamed(member, moved))
        rounds.append([placed.count(), len(compressed), member.count(), left.count()])
    final = {}
    for key, s in compressed.items():
        d, to = min((_gap(s, t), c) for c, t in discard.items())
        final[key] = to if d < limit else -1
    out = placed.union(_renamed(member, final).select("id", F.col("set").alias("cluster"))).union(left.select("id", F.lit(-1).alias("cluster")))
    return out, rounds


def _renamed(member: DataFrame, to: dict) -> DataFrame:
    if not to:
        return member
    table = F.create_map(*[F.lit(int(x)) for pair in to.items() for x in pair])
    return member.select("id", F.coalesce(F.element_at(table, F.col("set").cast("int")), F.col("set").cast("int")).alias("set"))
