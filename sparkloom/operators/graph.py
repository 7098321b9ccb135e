"""Graphs in DataFrames: edges (src, dst) with src < dst, once each."""

from __future__ import annotations

from collections import defaultdict, deque
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.session import cut

#: Most edges of a graph whose communities are split in one task.
GROUP_EDGES = 5_000
#: A key is hot with over LEAST_HOT rows and over one in HOT_SHARE of all; so fewer than HOT_SHARE keys are.
LEAST_HOT, HOT_SHARE = 64, 1_024


def cooccurrence_edges(pairs: DataFrame, least: int) -> DataFrame:
    """(src, dst, common) of users with at least ``least`` items in common. pairs: distinct (user, item). Users with too few items go first."""
    enough = pairs.groupBy("user").count().where(F.col("count") >= least).select("user")
    rows = cut(pairs.join(enough, "user", "left_semi"))
    a, b = rows.select(F.col("user").alias("src"), "item"), rows.select(F.col("user").alias("dst"), "item")
    return spread_join(a, b, "item").where("src < dst").groupBy("src", "dst").agg(F.count("*").alias("common")).where(F.col("common") >= least)


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def hot_values(df: DataFrame, key: str) -> list:
    """Values of a column that over LEAST_HOT rows and over one in HOT_SHARE of all rows have: fewer than HOT_SHARE, whatever the size of df. df is read twice."""
    least = max(LEAST_HOT, df.count() // HOT_SHARE)
    return [r[0] for r in df.groupBy(key).agg(F.count("*").alias("rows")).where(F.col("rows") > least).select(key).collect()]


def lookup(left: DataFrame, right: DataFrame, key: str, hot: list | None = None) -> DataFrame:
    """left.join(right, key), for a right side with each key once. Rows of left with a hot key stay where they are; the few matches are broadcast."""
    hot = hot_values(left, key) if hot is None else hot
    if not hot:
        return left.join(right, key)
    warm = left.where(F.col(key).isin(hot)).join(F.broadcast(right.where(F.col(key).isin(hot))), key)
    return warm.unionByName(left.where(~F.col(key).isin(hot)).join(right, key))


def spread_join(left: DataFrame, right: DataFrame, key: str, hot: list | None = None, parts: int = 32) -> DataFrame:
    """left.join(right, key), where both sides may have a key often. A hot key's rows of left are dealt over ``parts`` tasks, and each of these has all of right's.

    Such a key's pairs are then made in many tasks. Other keys are joined as ever. left should be cut, as it is read to find the hot ones.
    """
    hot = hot_values(left, key) if hot is None else hot
    if not hot:
        return left.join(right, key)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    dealt = left.where(is_hot).withColumn("cell_", F.pmod(F.xxhash64(*left.columns), F.lit(parts)).cast("int"))
    copied = right.where(is_hot).withColumn("cell_", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return left.where(~is_hot).join(right.where(~is_hot), key).unionByName(dealt.join(copied, [key, "cell_"]).drop("cell_"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node reachable, for each node that has an edge.

    Every round a node takes the least label of itself and its neighbours, then its label's label, until nothing changes:
    about as many rounds as the logarithm of the longest path. Each round is cut in the shared checkpoint folder. The edges of a
    star meet at its centre, and its nodes at their label: such hot keys are looked up by broadcast.
    """
    both = cut(both_ways(edges.where("src <> dst")).distinct())
    hot = hot_values(both, "dst")
    labels = cut(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = lookup(both, labels.withColumnRenamed("node", "dst"), "dst", hot).groupBy(F.col("src").alias("node")).agg(F.min("label").alias("near"))
        new = cut(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        onward = new.select(F.col("node").alias("label"), F.col("label").alias("onward"))
        labels = cut(lookup(new, onward, "label").select("node", "old", F.least("label", "onward").alias("label")))
        if labels.where("label <> old").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, label) after synchronous rounds; a node takes its neighbours' most frequent label, the least of equals."""
    both = cut(both_ways(edges))
    hot = hot_values(both, "dst")
    labels = both.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node"))
    for _ in range(rounds):
        votes = lookup(both, labels.withColumnRenamed("node", "dst"), "dst", hot).groupBy("src", "label").agg(F.count("*").alias("n"))
        labels = cut(votes.groupBy(F.col("src").alias("node")).agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label")))
    return labels


def modularity(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """One row q: the textbook modularity. groups: (node, label)."""
    m = edges.count()
    if not m:
        return edges.sparkSession.sql("SELECT CAST(0 AS DOUBLE) AS q")
    a = groups.select(F.col("node").alias("src"), F.col("label").alias("a"))
    b = groups.select(F.col("node").alias("dst"), F.col("label").alias("b"))
    inner = edges.join(a, "src").join(b, "dst").where("a = b").groupBy(F.col("a").alias("label")).agg(F.count("*").alias("inside"))
    total = degrees(edges).join(groups, "node").groupBy("label").agg(F.sum("degree").alias("d"))
    each = total.join(inner, "label", "left").select((F.coalesce("inside", F.lit(0)) / m - F.pow(F.col("d") / (2.0 * m), 2)).alias("q"))
    return each.agg(F.sum("q").alias("q"))


def root_credits(near: dict, root, credit: str) -> dict:
    """What one root's shortest paths give each edge. credit: 'paths' shares by the number of shortest paths, 'indegree' by the number of parents."""
    level, sigma, parents, order, queue = {root: 0}, {root: 1.0}, {root: []}, [], deque([root])
    while queue:
        v = queue.popleft()
        order.append(v)
        for w in near[v]:
            if w not in level:
                level[w], sigma[w], parents[w] = level[v] + 1, 0.0, []
                queue.append(w)
            if level[w] == level[v] + 1:
                sigma[w] += sigma[v]
                parents[w].append(v)
    share = sigma if credit == "paths" else {v: max(1, len(p)) for v, p in parents.items()}
    flow, out = dict.fromkeys(order, 1.0), {}
    for w in reversed(order):
        total = sum(share[v] for v in parents[w])
        for v in parents[w]:
            part = flow[w] * share[v] / total
            out[min(v, w), max(v, w)] = part
            flow[v] += part
    return out


def _adjacency(pairs) -> dict:
    near = defaultdict(list)
    for a, b in pairs:
        near[a].append(b)
        near[b].append(a)
    return near


def edge_betweenness(edges: DataFrame, credit: str = "paths", roots_at_once: int | None = None) -> DataFrame:
    """(src, dst, betweenness), by joins of frontiers alone: no node's, root's or edge's rows meet on the driver or in one task.

    From every root at once, a level's nodes are the neighbours of the last one's that are in neither of the two levels before; sigma is the number of shortest paths from the root (or, with
    credit 'indegree', of parents). Backwards, a node passes 1 and what it got on to its parents by their shares. That is nodes times edges rows in all; with
    ``roots_at_once``, so many roots are taken at a time, which bounds what is held between levels.
    """
    both = cut(both_ways(edges.where("src <> dst").select("src", "dst").distinct()))
    roots = cut(both.select(F.col("src").alias("root")).distinct())
    turns = 1 if roots_at_once is None else max(1, -(-roots.count() // roots_at_once))
    parts = [_credits(both, roots if turns == 1 else roots.where(F.pmod(F.xxhash64("root"), F.lit(turns)) == k), credit) for k in range(turns)]
    return reduce(DataFrame.union, parts).groupBy("src", "dst").agg((F.sum("x") / 2).alias("betweenness"))


def _credits(both: DataFrame, roots: DataFrame, credit: str) -> DataFrame:
    """(src, dst, x): what the shortest paths from the given roots give each edge."""
    near = both.select(F.col("src").alias("node"), F.col("dst").alias("next"))
    levels = [cut(roots.select("root", F.col("root").alias("node"), F.lit(1.0).alias("sigma")))]
    while True:
        seen = reduce(DataFrame.union, [x.select("root", F.col("node").alias("next")) for x in levels[-2:]])
        on = levels[-1].join(near, "node").join(seen, ["root", "next"], "left_anti")
        level = cut(on.groupBy("root", F.col("next").alias("node")).agg((F.sum("sigma") if credit == "paths" else F.count("*").cast("double")).alias("sigma")))
        if level.isEmpty():
            break
        levels.append(level)
    out, flow = [], None
    for k in range(len(levels) - 1, 0, -1):
        here = levels[k].withColumn("flow", F.lit(1.0)) if flow is None else levels[k].join(flow, ["root", "node"], "left").withColumn("flow", 1 + F.coalesce("flow", F.lit(0.0)))
        parents = levels[k - 1].select("root", F.col("node").alias("parent"), F.col("sigma").alias("above"))
        steps = here.join(near.withColumnRenamed("next", "parent"), "node").join(parents, ["root", "parent"])
        share = F.col("above") / F.col("sigma") if credit == "paths" else 1 / F.col("sigma")
        if credit != "paths":  # shares by the parents' own numbers of parents
            total = steps.groupBy("root", "node").agg(F.sum("above").alias("all"))
            steps, share = steps.join(total, ["root", "node"]), F.col("above") / F.col("all")
        steps = cut(steps.select("root", "node", "parent", (F.col("flow") * share).alias("x")))
        out.append(steps.select(F.least("node", "parent").alias("src"), F.greatest("node", "parent").alias("dst"), "x").groupBy("src", "dst").agg(F.sum("x").alias("x")))
        flow = steps.groupBy("root", F.col("parent").alias("node")).agg(F.sum("x").alias("flow"))
    if not out:
        return both.select("src", "dst", F.lit(0.0).alias("x")).limit(0)
    return reduce(DataFrame.union, out)


def most_between(betweenness: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """The edges of the greatest betweenness, equal ones included, up to a relative tolerance: what a step of a split takes away."""
    most = betweenness.agg(F.max("betweenness").alias("most_"))
    return betweenness.join(F.broadcast(most)).where(F.col("betweenness") >= F.col("most_") * (1 - tolerance)).drop("most_")  # one row


def split_graph(pairs: list[tuple], patience: int = 20, credit: str = "paths", current: bool = False) -> list[list]:
    """Communities of the best modularity while the edges of highest betweenness are removed, all equal ones at a time."""
    near, m = _adjacency(pairs), len(pairs)
    degree = {v: len(x) for v, x in near.items()}
    live, best, found, waited = {v: set(x) for v, x in near.items()}, None, [], 0
    while True:
        seen, groups = set(), []
        for v in live:
            if v not in seen:
                own, queue = [], [v]
                seen.add(v)
                while queue:
                    own.append(x := queue.pop())
                    fresh = [w for w in live[x] if w not in seen]
                    seen.update(fresh)
                    queue += fresh
                groups.append(own)
        of = {v: k for k, g in enumerate(groups) for v in g}
        inside = [0] * len(groups)
        for a, b in pairs:
            if of[a] == of[b] and (not current or b in live[a]):
                inside[of[a]] += 1
        q = sum(inside[k] / m - (sum(degree[v] for v in g) / (2 * m)) ** 2 for k, g in enumerate(groups)) if m else 0.0
        if best is None or q > best + 1e-12:
            best, found, waited = q, groups, 0
        else:
            waited += 1
        sums = defaultdict(float)
        for root in live:
            for edge, x in root_credits(live, root, credit).items():
                sums[edge] += x
        if waited >= patience or not sums:
            return [sorted(g) for g in found]
        most = max(sums.values())
        for (a, b), x in sums.items():
            if x >= most * (1 - 1e-9):
                live[a].discard(b)
                live[b].discard(a)


def girvan_newman(edges: DataFrame, patience: int = 20, credit: str = "paths", current: bool = False) -> DataFrame:
    """(node, community): community is its least node. One task does the whole loop, so the graph is checked to be small."""
    if edges.limit(GROUP_EDGES + 1).count() > GROUP_EDGES:
        raise ValueError(f"more than {GROUP_EDGES} edges")
    kind = edges.schema["src"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        groups = split_graph(sorted(zip(pdf.src.tolist(), pdf.dst.tolist(), strict=True)), patience, credit, current)
        return pd.DataFrame([(v, g[0]) for g in groups for v in g], columns=["node", "community"])

    return edges.select("src", "dst", F.lit(1).alias("all")).groupBy("all").applyInPandas(run, f"node {kind}, community {kind}")
