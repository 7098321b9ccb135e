"""Operators on hand-sized tables with known results."""

from __future__ import annotations

import json
import math
import random
import time
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import columns
from sparkloom.operators import baskets, clustering, features, graph, recommend, similarity, sketches
from sparkloom.plans import catalog
from sparkloom.session import CLEANUP, cut_table
from sparkloom.sources import readers, sinks
from sparkloom.streaming import sketches as streams


def edges(spark, text):
    return spark.createDataFrame([tuple(sorted(e)) for e in text.split()], "src string, dst string")


A = "AB AC BC BD DE DF DG EF FG"
B = "ra rb ac bc cd af fe dg eg"


def between(spark, text, credit="paths"):
    return {r.src + r.dst: r.betweenness for r in graph.edge_betweenness(edges(spark, text), credit).collect()}


def test_betweenness(spark):
    want = {"AB": 5, "AC": 1, "BC": 5, "BD": 12, "DE": 4.5, "DF": 4, "DG": 4.5, "EF": 1.5, "FG": 1.5}
    assert between(spark, A) == pytest.approx(want) and between(spark, A, "indegree") == pytest.approx(want)
    paths, parents = between(spark, B), between(spark, B, "indegree")
    assert [round(paths[k], 5) for k in ("ac", "br", "eg", "af")] == [7.16667, 3.66667, 5.16667, 8.5]
    assert [round(parents[k], 5) for k in ("ac", "br", "eg", "af")] == [7.08333, 3.58333, 5.33333, 8.5]
    some = {r.src + r.dst: r.betweenness for r in graph.edge_betweenness(edges(spark, A), roots_at_once=3).collect()}
    assert some == pytest.approx(want) and graph.edge_betweenness(edges(spark, A).limit(0)).count() == 0


def test_communities(spark):
    e = edges(spark, A)
    q = lambda groups: graph.modularity(e, spark.createDataFrame([(v, g) for g in groups for v in g], "node string, label string")).first().q
    assert q(["ABCDEFG"]) == pytest.approx(0) and q(["ABC", "DEFG"]) == pytest.approx(0.364198, abs=1e-6)
    found = {r.node: r.community for r in graph.girvan_newman(e).collect()}
    assert found == {v: "A" for v in "ABC"} | {v: "D" for v in "DEFG"}
    both = edges(spark, A + " XY YZ")
    assert {r.node: r.label for r in graph.connected_components(both).collect()} == {v: "A" for v in "ABCDEFG"} | {v: "X" for v in "XYZ"}
    assert graph.connected_components(e.limit(0)).count() == 0 and graph.modularity(e.limit(0), e.select(F.col("src").alias("node"), F.col("dst").alias("label"))).first().q == 0
    assert {r.node: r.label for r in graph.label_propagation(edges(spark, "ab"), 5).collect()} == {"a": "b", "b": "a"}


def test_communities_do_not_depend_on_the_path(spark, tmp_path):
    """Equal tables give equal communities, whatever the folder is called."""
    (tmp_path / "sf0.1").symlink_to("/root/testdata/sf0.01")
    found = [Counter(tuple(r) for r in catalog.QUERIES["girvan_newman"](spark, d).collect()) for d in (str(tmp_path / "sf0.1"), "/root/testdata/sf0.01")]
    assert found[0] == found[1] and len(found[1]) == 233


def test_betweenness_has_the_edges_of_the_other_graph_queries(spark):
    pairs = lambda name: {(r.src, r.dst) for r in catalog.QUERIES[name](spark, "/root/testdata/sf0.01").collect()}
    want = pairs("cooc_edges")
    assert len(want) == 879 and pairs("edge_betweenness") == want and pairs("edge_betweenness_indegree") == want


def test_hot_keys(spark):
    star = [(1, k) for k in range(100, 400)] + [(399, 500), (500, 501), (501, 502), (600, 601)]
    e = spark.createDataFrame(star + star[:9] + [(7, 7)], "src bigint, dst bigint")
    assert graph.hot_values(graph.both_ways(e), "dst") == [1]
    want = {1: 1, **dict.fromkeys(range(100, 400), 1), 500: 1, 501: 1, 502: 1, 600: 600, 601: 600}
    assert {r.node: r.label for r in graph.connected_components(e).collect()} == want
    left = spark.createDataFrame([(5, k) for k in range(90)] + [(6, 0), (8, 0), (None, 1)], "key bigint, x bigint")
    right = spark.createDataFrame([(5, "a"), (6, "b"), (7, "c")], "key bigint, y string")
    assert graph.hot_values(left, "key") == [5] and graph.hot_values(left.limit(0), "key") == []
    rows = lambda df: sorted(tuple(r) for r in df.select("key", "x", "y").collect())
    assert rows(graph.lookup(left, right, "key")) == rows(left.join(right, "key")) and len(rows(graph.lookup(left, right, "key"))) == 91


def test_spread_join(spark, monkeypatch):
    monkeypatch.setattr(graph, "LEAST_HOT", 5)
    left = spark.createDataFrame([(k % 7 if k % 3 else 1, k) for k in range(120)] + [(None, 0)], "key int, x int")
    right = spark.createDataFrame([(k % 9, k) for k in range(60)] + [(None, 1)], "key int, y int")
    assert graph.hot_values(left, "key")
    assert Counter(map(tuple, graph.spread_join(left, right, "key").select("key", "x", "y").collect())) == Counter(map(tuple, left.join(right, "key").select("key", "x", "y").collect()))
    sets = spark.createDataFrame([(i, x) for i in range(40) for x in {0, i % 5 + 1, i % 4 + 10, 20 + i // 3}], "id int, item bigint")
    exact = Counter()
    items = {}
    for r in sets.collect():
        items.setdefault(r.id, set()).add(r.item)
    for a in items:
        for b in items:
            j = len(items[a] & items[b]) / len(items[a] | items[b])
            if a < b and j >= 0.5:
                exact[a, b] = round(j, 6)
    for f in (similarity.jaccard_join, similarity.lsh_jaccard):
        assert {(r.id1, r.id2): round(r.similarity, 6) for r in f(sets).collect()} == exact


def test_itemsets(spark):
    rows = [(k, i) for k, b in enumerate(["abc", "ab", "ac", "bc", "abcd", "d"]) for i in b]
    b = baskets.build_baskets(spark.createDataFrame(rows + rows[:3], "b int, i string"), "b", "i")
    found = lambda k: {tuple(r) for r in baskets.frequent_itemsets(b, 3, k).collect()}
    assert found(1) == {("a", 4), ("b", 4), ("c", 4)} and found(2) == {("a", "b", 3), ("a", "c", 3), ("b", "c", 3)} and found(3) == set()
    assert {(tuple(sorted(r["items"])), r.freq) for r in baskets.all_frequent(b, 3).collect()} == {(tuple(x[:-1]), x[-1]) for k in (1, 2) for x in found(k)}
    assert {(r["items"], r.n) for r in baskets.son(b.withColumn("part", F.col("basket") % 2), 3).collect()} == {(",".join(map(str, x[:-1])), x[-1]) for k in (1, 2) for x in found(k)}
    some = {r["items"] for r in baskets.son_candidates(b.withColumn("part", F.col("basket") % 2), 3, 3).collect()}
    assert {"a", "b", "c", "a,b", "a,c", "b,c"} <= some


@pytest.mark.parametrize("turn_rows", [20, 1_000_000])
def test_all_frequent_grows_patterns(spark, monkeypatch, turn_rows):
    """As a plain count of all subsets has it, with groups of equal baskets, in one turn or many; no FP-tree, which has to fit a task's memory."""
    import pyspark.ml.fpm

    rng = random.Random(5)
    some = [tuple(sorted(rng.sample(range(14), rng.randrange(7)))) for _ in range(60)] + [tuple(range(3, 10))] * 25
    want = Counter(s for b in some for k in range(1, len(b) + 1) for s in combinations(b, k))
    b = spark.createDataFrame([(k, i) for k, items in enumerate(some) for i in items] + [(0, None)] + [(70, 4)], "basket int, item bigint")
    monkeypatch.setattr(pyspark.ml.fpm, "FPGrowth", None)
    monkeypatch.setattr(baskets, "TURN_ROWS", turn_rows, raising=False)
    for support in (3, 26, 1000):
        found = [(tuple(r["items"]), r.freq) for r in baskets.all_frequent(b, support).collect()]
        assert len(found) == len(set(found)) and dict(found) == {s: n for s, n in want.items() if n >= support}
    assert baskets.all_frequent(b.limit(0), 2).count() == 0


def test_similarity(spark):
    sets = spark.createDataFrame([(i, ord(x)) for i, s in enumerate(["abc", "bcd", "ab", "xyz"]) for x in s], "id int, item bigint")
    want = {(0, 1): 0.5, (0, 2): 0.666667}
    for f in (similarity.jaccard_join, similarity.lsh_jaccard):
        assert {(r.id1, r.id2): round(r.similarity, 6) for r in f(sets).collect()} == want


def test_lsh_in_turns(spark, monkeypatch):
    """Turns of bands find what all bands at once do, and a pair once."""
    rng = random.Random(5)
    sets = spark.createDataFrame([(b, i) for b in range(60) for i in {rng.randrange(25) for _ in range(5)}], "id bigint, item bigint")
    own = sets.groupBy("id").agg(F.collect_list("item").alias("items"))
    sig = {r.id: r.sig for r in similarity.minhash(sets, 12).collect()}
    assert {r.id: list(r[1:]) for r in own.select("id", *[similarity.least_hashes(k) for k in range(12)]).collect()} == sig
    want = sorted((a, b) for a in sig for b in sig if a < b and any(sig[a][k : k + 2] == sig[b][k : k + 2] for k in range(0, 12, 2)))
    of = {r.id: set(r["items"]) for r in own.collect()}
    close = [(a, b) for a, b in want if len(of[a] & of[b]) >= 0.5 * len(of[a] | of[b])]
    for rows in (1, 150, 10_000):
        monkeypatch.setattr(similarity, "TURN_ROWS", rows)
        assert sorted(map(tuple, similarity.lsh_candidates_of(sets, 12).collect())) == want
        assert sorted((r.id1, r.id2) for r in similarity.lsh_jaccard(sets, 12).collect()) == close
    assert sorted(map(tuple, similarity.lsh_candidates(similarity.minhash(sets, 12)).collect())) == want
    assert similarity.lsh_jaccard(sets.limit(0), 12).count() == 0 and similarity.lsh_candidates(similarity.minhash(sets.limit(0), 12)).count() == 0


def test_recall_of_registered_lsh(spark, tmp_path):
    """At Jaccard 0.5 the registered query finds the pairs of the exact join: 10 bands of two lost about one in eighteen, 50 lose one in a million."""
    items = random.Random(7).sample(range(10**9), 1200)
    rows = [(2 * k + side, items[4 * k + i]) for k in range(300) for side in (0, 1) for i in ((0, 1, 2) if side else (0, 1, 3))]
    spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint").write.parquet(str(tmp_path / "lineitem.parquet"))
    pairs = lambda name: {(r.id1, r.id2) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()}
    exact = pairs("jaccard_pairs")
    assert len(exact) == 300 and pairs("lsh_jaccard") == exact
    assert catalog.FM == catalog.HASHES == 100


def test_features(spark):
    user = spark.createDataFrame([("u", 10, 3, 1, 2, 4, 1, 2, 3, 4, 5, 6, 4.5, "2010-05-06", "2012, 2013"), ("v", 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 1.0, "2019-01-01", "None")], readers.SCHEMAS["user"])
    business = spark.createDataFrame([("b", "x", 4.0, 7), ("c", None, 2.0, 1)], readers.SCHEMAS["business"])
    checkin = spark.createDataFrame([("b", {"Mon-1": 3, "Tue-2": 4})], readers.SCHEMAS["checkin"])
    tip = spark.createDataFrame([("u", "b", 1), ("u", "b", 5), ("v", "c", 2)], readers.SCHEMAS["tip"])
    photo = spark.createDataFrame([("b", x) for x in ("food", "menu", "inside", "other")], readers.SCHEMAS["photo"])
    pairs = spark.createDataFrame([("u", "b"), ("v", "b"), ("u", "c"), ("w", "b")], "user_id string, business_id string")
    made = features.pair_features(pairs, features.user_features(user), features.business_features(business, checkin, photo), features.tip_features(tip))
    got = {(r.user_id, r.business_id): r for r in made.collect()}
    of = lambda u, b, names: [got[u, b][c] for c in names]
    assert of("u", "b", features.V1) == [10, 4.5, 2010, 3, 1, 7, 2, 21, 4.0, 7, 7, 5, 2, 1] and of("u", "b", features.V2) == [10, 4.5, 9, 3, 7, 2, 9, 2.1, 4.0, 7, 2, 7, 2, 2, 1]
    assert of("v", "b", features.V2) == [0, 1.0, 0, 0, 0, 0, 0, 0.0, 4.0, 7, 2, 7, 0, 2, 1] and of("u", "c", features.V1)[8:] == [2.0, 1, 0, 0, 0, 0] and got["w", "b"].u_reviews is None


def test_dense_ids(spark):
    df = spark.createDataFrame([(f"k{k % 37}", k) for k in range(300)] + [(None, 0)], "v string, n int").repartition(5)
    ids = readers.dense_ids(df, "v")
    assert {r.value: r.id for r in ids.collect()} == {v: k for k, v in enumerate(sorted(f"k{k}" for k in range(37)))}
    back = readers.decoded(df.join(ids, df.v == ids.value).select("n", F.col("id").alias("v")), "v", ids)
    assert Counter((r.v, r.n) for r in back.collect()) == Counter((f"k{k % 37}", k) for k in range(300))
    assert readers.dense_ids(df.limit(0), "v").count() == 0


def test_item_cf(spark):
    rows = {"i1": {"u1": 5, "u2": 3, "u3": 4}, "i2": {"u1": 4, "u2": 2, "u3": 5, "u4": 3}, "i3": {"u1": 1, "u2": 5, "u4": 4}}
    r = spark.createDataFrame([(u, i, float(x)) for i, us in rows.items() for u, x in us.items()], "u string, i string, x double")
    means = recommend.item_means(r)
    assert {m.i: m.mu for m in means.collect()} == {"i1": 4.0, "i2": 3.5, "i3": 3.3333}
    assert {(s.i, s.j): round(s.w, 6) for s in recommend.item_similarity(r, means).where("i < j").collect()} == {("i1", "i2"): 0.648886}
    tests = spark.createDataFrame([("u4", "i1"), ("new", "i1"), ("u4", "new"), ("new", "new")], "u string, i string")
    got = {(p.u, p.i): p.prediction for p in recommend.predict(r, tests).collect()}
    assert got[("u4", "i1")] == pytest.approx(3.6) and got[("new", "i1")] == 4.0 and got[("u4", "new")] == 3.5 and got[("new", "new")] == 3.0


def test_tables_leave_no_shuffle_files(spark):
    there = lambda: {x for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}
    before = there()
    made = cut_table(spark.range(1000).groupBy(F.col("id") % 7).count())
    for _ in range(50):  # they go in the background
        if not (left := there() - before):
            break
        time.sleep(0.2)
    assert not left and made.count() == 7 and spark.conf.get(CLEANUP) == "false"


@pytest.mark.parametrize("long_list", [3, 100])
def test_item_similarity_in_turns(spark, monkeypatch, long_list):
    """As a plain loop has it, in one turn or many, with users whose items are lists or not."""
    rng = random.Random(3)
    rows = sorted({(u, rng.randrange(12)) for u in range(30) for _ in range(rng.randrange(9))})
    r = spark.createDataFrame([(u, i, float(rng.randrange(1, 6))) for u, i in rows], "u bigint, i bigint, x double")
    means, mu = recommend.item_means(r), {m.i: m.mu for m in recommend.item_means(r).collect()}
    of = {(x.u, x.i): x.x - mu[x.i] for x in r.collect()}
    want = {}
    for i in mu:
        for j in mu:
            both = [(of[u, i], of[u, j]) for u in range(30) if i != j and (u, i) in of and (u, j) in of]
            p, a, b = (sum(f(x, y) for x, y in both) for f in (lambda x, y: x * y, lambda x, y: x * x, lambda x, y: y * y))
            if p > 1e-9:
                want[i, j] = pytest.approx(p / math.sqrt(a * b))
    monkeypatch.setattr(recommend, "LONG_LIST", long_list, raising=False)
    for pairs in (40, 10_000):
        monkeypatch.setattr(recommend, "TURN_PAIRS", pairs, raising=False)
        for only in (None, [2, 5]):
            found = recommend.item_similarity(r, means, None if only is None else spark.createDataFrame([(i,) for i in only], "i bigint"))
            assert {(s.i, s.j): s.w for s in found.collect() if s.w > 1e-9} == {k: w for k, w in want.items() if only is None or k[0] in only}


@pytest.mark.parametrize("few_items", [0, 1_000])
def test_item_cf_makes_lists_in_parts(spark, monkeypatch, few_items):
    """The lists of a part of the users at a time, each user once, and the same predictions; nothing but tables, whose shuffle files go, is put down."""
    rows = [(u, i, float((u * 7 + i * i + u * i) % 5 + 1)) for u in range(20) for i in range(9) if (u + i) % 4]
    r = spark.createDataFrame(rows, "u bigint, i bigint, x double").cache()
    tests = spark.createDataFrame([(u, i) for u in range(20) for i in range(9) if (u + 2 * i) % 5 == 0] + [(-1, 3), (-1, -1)], "u bigint, i bigint")
    want = {(p.u, p.i): pytest.approx(p.prediction) for p in recommend.predict(r, tests).collect()}
    put, lists = recommend.cut_table, []

    def counted(df, *by):
        made = put(df, *by)
        if made.columns == ["js", "ds", "ts"]:
            lists.append(made.count())
        return made

    monkeypatch.setattr(recommend, "cut_table", counted)
    monkeypatch.setattr(recommend, "cut", None, raising=False)  # a checkpoint's shuffle files would stay
    monkeypatch.setattr(recommend, "LIST_ROWS", 40)
    monkeypatch.setattr(recommend, "FEW_ITEMS", few_items)
    assert {(p.u, p.i): p.prediction for p in recommend.predict(r, tests).collect()} == want
    assert len(lists) == -(-len(rows) // 40) > 2 and max(lists) < sum(lists) == 20


def test_hybrid_keeps_the_models_columns(spark):
    """So that the truth needs no join of its own."""
    cf = spark.createDataFrame([(1, 1, 5.0, 3.0), (1, 2, None, 3.0)], "u bigint, i bigint, cf double, fallback double")
    model = spark.createDataFrame([(1, 1, 2.5, 1.0), (1, 2, 3.5, 2.0)], "u bigint, i bigint, x double, m double")
    assert recommend.hybrid(cf, model.drop("x")).columns == ["u", "i", "prediction"]
    assert {(p.u, p.i, p.x): p.prediction for p in recommend.hybrid(cf, model).collect()} == {(1, 1, 2.5): pytest.approx(1.8), (1, 2, 3.5): 2.0}


def test_features_of_few_items_are_broadcast(spark, monkeypatch):
    """The rows of all ratings are not dealt out again, with all their features, to meet some items."""
    from sparkloom.plans import catalog

    plans, rows = [], []
    for few_items in (0, 1_000):
        monkeypatch.setattr(recommend, "FEW_ITEMS", few_items)
        df = catalog._features(spark, "/root/testdata/sf0.001")
        rows.append(sorted(map(tuple, df.collect())))
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
    assert rows[0] == rows[1] and "strategy=broadcast" not in plans[0] and "strategy=broadcast" in plans[1]


@pytest.mark.parametrize("pairs", [40, 100_000_000])
def test_item_cf_keeps_sums_of_similarities_only(spark, monkeypatch, pairs):
    rows = [(u, i, float((u * 7 + i * i + u * i) % 5 + 1)) for u in range(12) for i in range(9) if (u + i) % 4]
    r = spark.createDataFrame(rows, "u bigint, i bigint, x double").cache()
    wanted = [(u, i) for u in range(12) for i in range(10) if (u + 2 * i) % 5 == 0] + [(-1, 3), (-1, -1)]
    tests = spark.createDataFrame(wanted, "u bigint, i int")
    means = recommend.item_means(r)
    w = {(s.i, s.j): s.w for s in recommend.item_similarity(r, means).collect()}
    n = {m.i: m.n for m in means.collect()}
    put, kept = recommend.cut_table, []
    monkeypatch.setattr(recommend, "cut_table", lambda df, *by: kept.append(df.columns) or put(df, *by))
    monkeypatch.setattr(recommend, "TURN_PAIRS", pairs)
    base = {m.i: m.base for m in means.collect()}
    found = {(c.u, c.i): c.cf for c in recommend.item_cf(r, tests).collect()}
    assert set(found) == set(wanted) and not [c for c in kept if "w" in c]
    some = 0
    for u, i in wanted:
        near = [(w[i, j], x / (1 + math.log(n[j]))) for v, j, x in rows if v == u and j != i and (i, j) in w]
        weights = [w[i, j] / (1 + math.log(n[j])) for v, j, x in rows if v == u and j != i and (i, j) in w]
        if not any(a >= 0.3 for a, _ in near):
            assert found[u, i] is None
            continue
        share = 0.4 if any(a >= 0.5 for a, _ in near) else 0.2
        some += 1
        assert found[u, i] == pytest.approx(share * sum(a * b for a, b in near) / sum(weights) + (1 - share) * base[i])
    assert some > 5


@pytest.mark.parametrize("rows", [900, 1])
def test_boosted_trees_are_mllibs(spark, monkeypatch, rows):
    """Equal to MLlib's on a table that is its own sample; where values repeat, are missing, or there is one row."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rng = random.Random(1)
    own = [(k, rng.random() * 9, float(rng.randrange(4)), rng.gauss(0, 3)) for k in range(rows)]
    df = spark.createDataFrame([(k, a, b, c, (a * b if c > 0 else a - c) + rng.random()) for k, a, b, c in own], "k int, a double, b double, c double, y double").cache()
    packed = VectorAssembler(inputCols=["a", "b", "c"], outputCol="v").transform(df)
    model = GBTRegressor(featuresCol="v", labelCol="y", predictionCol="m", maxIter=6, maxDepth=4, stepSize=0.1, seed=1).fit(packed)
    want = {r.k: pytest.approx(r.m) for r in model.transform(packed).collect()}
    import pyspark.ml.regression

    monkeypatch.setattr(pyspark.ml.regression, "GBTRegressor", None)  # its passes over objects take too long on large tables
    assert {r.k: r.m for r in recommend.boosted_trees(df, df, ["a", "b", "c"], "y", trees=6, depth=4).collect()} == want
    gone = df.select("k", F.lit(None).cast("double").alias("a"), "b", "c", "y").limit(3)
    assert all(math.isfinite(r.m) for r in recommend.boosted_trees(df.unionByName(gone), gone, ["a", "b", "c"], "y", trees=2).collect())


def test_columns(spark):
    one = lambda *c: tuple(spark.range(1).select(*c).first())
    assert one(*[columns.trailing_zeros(F.lit(x)) for x in (0, 1, 8, 12, 65536)]) == (16, 0, 3, 2, 16)
    assert one(*[columns.text_hash(F.lit(x), 69_997) for x in ("x", "aé", "")]) == (120, 37354, 0)
    assert one(*[columns.elite_years(F.lit(x)) for x in ("None", "2012", "2012, 2013")]) == (0, 1, 2)
    assert one(columns.strip_zeros(F.lit('"00012"')), columns.strip_zeros(F.lit('"000"'))) == ("12", "")
    groups = {"a": [5], "b": [5, 4], "c": [5, 4, 3], "d": [1, 5, 5, 5, 5, 5, 5, 4]}
    df = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v], "k string, x double")
    got = {r.k: round(r.m, 6) for r in df.groupBy("k").agg(columns.tiered_mean("x").alias("m")).collect()}
    assert got == {"a": 4.0, "b": 3.75, "c": 4.0, "d": 4.833333}


def test_bloom_against_a_loop(spark):
    ids = [1, 2, 3, 1, 9, 4, 6, 2, 77, 1000, 31, 5, 8, 12]
    s = spark.createDataFrame([(k // 4, k, x) for k, x in enumerate(ids)], "batch int, seq int, id int")
    bits, seen, want = set(), set(), {}
    fp = 0
    for k, x in enumerate(ids):
        if x not in seen:
            own = {(a * (x % 8) + b) % 8 for a, b in map(columns.hash_terms, range(2))}
            fp += own <= bits
            bits |= own
            seen.add(x)
        want[k // 4] = (fp, len(seen))
    assert {r.batch: (r.false_positives, r.seen) for r in sketches.bloom_fpr(s, 8, 2).collect()} == want


def test_reservoir(spark):
    s = spark.range(1000).select((F.col("id") / 100).cast("int").alias("batch"), F.col("id"), F.col("id").alias("seq"))
    got = sketches.reservoir(s, 50).collect()
    assert Counter(r.batch for r in got) == {b: 50 for b in range(10)} and all(r.seq < (r.batch + 1) * 100 for r in got)
    for b in range(10):
        want = sorted((s_ * 1_103_515_245 + 12_345) % 2_147_483_647 for s_ in range(100 * (b + 1)))[:50]
        assert sorted((r.seq * 1_103_515_245 + 12_345) % 2_147_483_647 for r in got if r.batch == b) == want
    assert sketches.reservoir(s.limit(0), 5).count() == 0
    chi = sum((n - 5) ** 2 / 5 for n in (sum(r.batch == 9 and r.seq // 100 == k for r in got) for k in range(10)))
    assert chi < 28


def test_clustering(spark):
    c, v = clustering.centre((4, __import__("numpy").array([4.0, 8.0]), __import__("numpy").array([8.0, 20.0])))
    assert c.tolist() == [1, 2] and v.tolist() == [1, 1]
    known = {0: (4, __import__("numpy").array([4.0, 8.0]), __import__("numpy").array([8.0, 20.0]))}
    got = clustering.assign(spark.createDataFrame([(1, [2.0, 4.0]), (2, [3.0, 5.0])], "id int, features array<double>"), known).collect()
    assert {r.id: r.cluster for r in got} == {1: 0, 2: -1}
    r = __import__("numpy").random.default_rng(1)
    rows = [(i, (r.normal(size=3) + 30 * (i % 3)).tolist()) for i in range(600)] + [(600, [500.0, -500.0, 0.0])]
    out, rounds = clustering.bfr(spark.createDataFrame(rows, "id bigint, features array<double>"), 3)
    found = {x.id: x.cluster for x in out.collect()}
    assert len(found) == 601 and found[600] == -1 and len(rounds) == 5
    best = sum(Counter(found[i] for i in range(600) if i % 3 == k).most_common(1)[0][1] for k in range(3))
    assert best >= 560


def test_readers_and_sinks(spark, tmp_path, capsys):
    (tmp_path / "r.json").write_text('{"review_id": "a", "stars": 4.0, "date": "2018-01-01"}\n')
    assert readers.json_lines(spark, str(tmp_path / "r.json"), "review").first().stars == 4.0
    (tmp_path / "bad.json").write_text('{"review_id": "a", "stars"')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.json_lines(spark, str(tmp_path / "bad.json"), "review").collect()
    (tmp_path / "b.csv").write_text('"d","c","x","x","x","p"\n"11/1/2000","00012","","","","000345"\n')
    assert tuple(readers.retail_baskets(spark, str(tmp_path / "b.csv")).first()) == ("11/1/00-12", "345")
    (tmp_path / "n.csv").write_text("0,1,1.5,2.5\n1,0,3,4\n")
    assert readers.numeric_points(spark, str(tmp_path / "n.csv"), 2).orderBy("id").first().features == [1.5, 2.5]
    drawn = readers.drawn_stream(spark.createDataFrame([(x,) for x in "abc"], "id string"), 10, 4)
    assert drawn.count() == 40 and {r.id for r in drawn.collect()} == set("abc")
    df = spark.createDataFrame([("x", 1), ("y", 2)], "a string, b int").coalesce(1)
    sinks.csv_text(df, str(tmp_path / "o.csv"))
    assert (tmp_path / "o.csv").read_text() == "a,b\nx,1\ny,2"
    sinks.csv_text(df, str(tmp_path / "o2.csv"), newline_at_end=True)
    assert (tmp_path / "o2.csv").read_text() == "a,b\nx,1\ny,2\n"
    pairs = spark.createDataFrame([(3, 4, 0.5), (1, 9, 0.75), (1, 2, 1.0)], "id1 int, id2 int, similarity double")
    sinks.csv_text(pairs.orderBy("id1", "id2"), str(tmp_path / "p.csv"))
    assert (tmp_path / "p.csv").read_text() == "id1,id2,similarity\n1,2,1.0\n1,9,0.75\n3,4,0.5"
    assert sinks.timed(sinks.print_table, df, 1) is None and capsys.readouterr().out.startswith("a,b\nx,1\nDuration: ")
    sinks.itemset_report([("b",), ("a", "c")], [("b",)], str(tmp_path / "i.txt"))
    assert (tmp_path / "i.txt").read_text() == "Candidates:\n('b')\n\n('a', 'c')\n\nFrequent Itemsets:\n('b')"
    sinks.community_lines([["b", "a"], ["c"]], str(tmp_path / "c.txt"))
    assert (tmp_path / "c.txt").read_text() == "'c'\n'a', 'b'\n"
    sinks.betweenness_lines(spark.createDataFrame([("a", "b", 1.5)], "src string, dst string, betweenness double"), str(tmp_path / "e.txt"))
    assert (tmp_path / "e.txt").read_text() == "('a', 'b'),1.5\n"
    sinks.json_report({"n": 1}, str(tmp_path / "j.json"))
    assert json.loads((tmp_path / "j.json").read_text()) == {"n": 1}
    sinks.cluster_report([[1, 2, 3, 4]], spark.createDataFrame([(0, 5)], "id int, cluster int"), str(tmp_path / "k.txt"))
    assert (tmp_path / "k.txt").read_text().endswith("Round 1: 1,2,3,4\n\nThe clustering results:\n0,5\n")


def test_runs_of_micro_batches(spark, tmp_path):
    """Runs hold every earlier micro-batch once, were made before, and are few; one job writes all batches, and they come in order."""
    made = set()
    for n in range(300):
        runs = streams._runs(0, n)
        assert [k for a, b in runs for k in range(a, b)] == list(range(n)) and set(runs) <= made and len(runs) <= 9
        begin, taken = streams._merged(n)
        assert set(taken) <= made and [k for a, b in taken for k in range(a, b)] == list(range(begin, n))
        made.add((begin, n + 1))
    df = spark.range(120).select("id", (F.col("id") * 7 % 12).alias("batch"))
    seen, came = streams.batches_of(df, f"{tmp_path}/in"), []
    streams._run(seen, lambda b, k: came.append(sorted({r.batch for r in b.collect()})), f"{tmp_path}/out")
    assert came == [[k] for k in range(12)]
    got = streams.bloom_stream(streams.batches_of(df.withColumn("seq", F.col("batch") * 1000 + F.col("id")).withColumn("id", F.col("id") % 50), f"{tmp_path}/in2"), 53, 3)
    want = sketches.bloom_fpr(df.withColumn("seq", F.col("batch") * 1000 + F.col("id")).withColumn("id", F.col("id") % 50), 53, 3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize(("at_once", "batches"), [(1, 6), (4, 11), (5, 12), (64, 3)])
def test_micro_batches_of_several_batches(spark, tmp_path, at_once, batches):
    """A micro-batch takes as many batches as it is told; rows are the same, also where batches are missing or bring nothing new."""
    df = spark.range(240).select((F.col("id") * 31 % 53).alias("id"), (F.col("id") * 7 % batches).alias("batch"), F.col("id").alias("n")).where("batch <> 3 AND batch <> 4")
    df = df.select("id", "batch", (F.col("batch") * 1000 + F.col("n")).alias("seq"))
    came = []
    streams._run(streams.batches_of(df, f"{tmp_path}/in", at_once), lambda b, k: came.append(sorted({r.batch for r in b.collect()})), f"{tmp_path}/out")
    there = [k for k in range(batches) if k not in (3, 4)]
    assert came == [own for n in range(batches) if (own := [k for k in there if k // at_once == n])]
    rows = lambda x: sorted(map(tuple, x.collect()))
    assert rows(streams.bloom_stream(streams.batches_of(df, f"{tmp_path}/in2", at_once), 53, 3)) == rows(sketches.bloom_fpr(df, 53, 3))
    got = rows(streams.fm_stream(streams.batches_of(df.select("id", "batch"), f"{tmp_path}/in3", at_once)))
    assert got == rows(sketches.fm_windows(df.select("batch", "id"))) and got


def test_streams_equal_batch(spark):
    d = "/root/testdata/sf0.001"
    batch = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    want = batch.groupBy(F.window("ts", "3 hours", "2 hours").alias("w"), "event_type").count().count()
    assert streams.drain(streams.windowed_counts(streams.event_stream(spark, d)), "complete").count() == want
    got = streams.drain(streams.reservoirs(streams.event_stream(spark, d)), "update").collect()
    totals = {r.event_type: r["count"] for r in batch.groupBy("event_type").count().collect()}
    assert {r.event_type: r.total for r in got} == totals and not math.isnan(len(got))
