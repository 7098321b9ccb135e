"""Every registered query of the core library with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.columns import hash_terms, text_hash, tiered_mean
from sparkloom.operators import baskets, clustering, features, graph, recommend, similarity, sketches
from sparkloom.session import cut, cut_table, shared_path
from sparkloom.sources import readers, sinks
from sparkloom.streaming import sketches as streams

QUERIES: dict = {}
ORACLES: dict = {}


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def city_avg_top10(spark, d):
    """Average quantity by the supplier's nation, best ten, rounded after ordering."""
    lines, suppliers, nations = (table(spark, d, n) for n in ("lineitem", "supplier", "nation"))
    return (
        lines.join(suppliers, lines.l_suppkey == suppliers.s_suppkey)
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .where(F.col("n_name").isNotNull())
        .groupBy(F.col("n_name").alias("city"))
        .agg(F.avg("l_quantity").alias("a"))
        .orderBy(F.desc("a"), "city")
        .limit(10)
        .select("city", F.round("a", 1).alias("stars"))
    )


QUERIES["city_avg_top10"] = city_avg_top10
ORACLES["city_avg_top10"] = """
SELECT city, round(a, 1) AS stars FROM (
  SELECT n_name AS city, avg(l_quantity) AS a
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  WHERE n_name IS NOT NULL GROUP BY n_name ORDER BY a DESC, city LIMIT 10)
"""


def register(sql: str | None = None):
    """Add a query under its function's name, and its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


# Exploration -------------------------------------------------------------------------------------------------------


@register("""SELECT (SELECT count(*) FROM orders) AS n_review, (SELECT count(*) FROM orders WHERE year(o_orderdate) = 1998) AS n_review_1998,
  (SELECT count(DISTINCT o_custkey) FROM orders) AS n_user, (SELECT count(DISTINCT l_partkey) FROM lineitem) AS n_business""")
def review_summary(spark, d):
    o = table(spark, d, "orders").agg(F.count("*").alias("n_review"), F.count_if(F.year("o_orderdate") == 1998).alias("n_review_1998"), F.count_distinct("o_custkey").alias("n_user"))
    return o.join(F.broadcast(table(spark, d, "lineitem").agg(F.count_distinct("l_partkey").alias("n_business"))))  # one row each


@register("SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, id LIMIT 10")
def top10_users(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(10)


@register("SELECT l_partkey AS id, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, id LIMIT 10")
def top10_items(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(10)


@register("SELECT 5 AS n_partition, CAST((o_custkey * 1103515245 + 12345) % 2147483647 % 5 AS INTEGER) AS part, count(*) AS n_items FROM orders GROUP BY 2")
def partition_stats(spark, d):
    """(n_partition, part, n_items): how many partitions the plan has, and the rows of each that has some, as they lie, after dealing rows to partitions by a stated hash."""
    part = F.pmod(F.pmod(F.col("o_custkey") * 1_103_515_245 + 12_345, F.lit(2_147_483_647)), F.lit(5)).cast("int")
    dealt = table(spark, d, "orders").select("o_custkey").repartitionById(5, part)
    return dealt.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n_items")).select(F.lit(dealt.rdd.getNumPartitions()).alias("n_partition"), "part", "n_items")


@register("SELECT o_orderkey, coalesce(n, 0) AS n_lines FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def left_join_default(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    o = table(spark, d, "orders")
    return o.join(n, o.o_orderkey == n.l_orderkey, "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n_lines"))


@register("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey IS NOT NULL)")
def unmatched_orders(spark, d):
    """Orders without lines."""
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")
    return o.join(l, o.o_orderkey == l.l_orderkey, "left_anti").select("o_orderkey")


@register("SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total, round(avg(CAST(json_extract_string(props, '$.k') AS BIGINT)), 6) AS mean FROM events GROUP BY 1")
def props_json(spark, d):
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.round(F.avg(k), 6).alias("mean"))


TIERS = "CASE WHEN count(x) < 3 THEN avg(x) - (avg(x) - 3) * 0.5 WHEN count(x) < 8 THEN avg(x) ELSE (sum(x) - max(x) - min(x)) / (count(x) - 2) END"


@register(f"SELECT l_partkey, round({TIERS}, 6) AS base FROM (SELECT l_partkey, l_quantity AS x FROM lineitem) GROUP BY 1")
def robust_avg(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.round(tiered_mean("l_quantity"), 6).alias("base"))


@register("SELECT l_suppkey, string_agg(l_linenumber, ',' ORDER BY l_linenumber) AS lines FROM lineitem GROUP BY 1")
def value_lists(spark, d):
    """All values of a key as a list, in order."""
    lists = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("v"))
    return lists.select("l_suppkey", F.array_join("v", ",").alias("lines"))


# Baskets -----------------------------------------------------------------------------------------------------------

BASKETS = "SELECT DISTINCT l_orderkey AS b, l_partkey AS i FROM lineitem"


def _baskets(spark, d, more_than=0):
    return baskets.build_baskets(table(spark, d, "lineitem"), "l_orderkey", "l_partkey", more_than)


@register(f"SELECT b AS basket, count(*) AS n FROM ({BASKETS}) GROUP BY 1 HAVING count(*) > 4")
def set_sizes(spark, d):
    return _baskets(spark, d).groupBy("basket").agg(F.count("*").alias("n")).where("n > 4")


@register(f"SELECT i AS item, count(*) AS n FROM ({BASKETS}) GROUP BY 1")
def reverse_baskets(spark, d):
    return _baskets(spark, d).groupBy("item").agg(F.count("*").alias("n"))


@register(f"SELECT i AS item1, count(*) AS n FROM ({BASKETS}) GROUP BY 1 HAVING count(*) >= 3")
def itemsets_k1(spark, d):
    return baskets.frequent_itemsets(_baskets(spark, d), 3, 1)


@register(f"WITH t AS ({BASKETS}) SELECT a.i AS item1, b.i AS item2, count(*) AS n FROM t a JOIN t b ON a.b = b.b AND a.i < b.i GROUP BY 1, 2 HAVING count(*) >= 3")
def itemsets_k2(spark, d):
    return baskets.frequent_itemsets(_baskets(spark, d), 3, 2)


@register(f"WITH t AS ({BASKETS}) SELECT a.i AS item1, b.i AS item2, c.i AS item3, count(*) AS n FROM t a JOIN t b ON a.b = b.b AND a.i < b.i JOIN t c ON c.b = b.b AND b.i < c.i GROUP BY 1, 2, 3 HAVING count(*) >= 2")
def itemsets_k3(spark, d):
    return baskets.frequent_itemsets(_baskets(spark, d), 2, 3)


@register(f"WITH t AS (SELECT * FROM ({BASKETS}) QUALIFY count(*) OVER (PARTITION BY b) > 4) SELECT a.i AS item1, b.i AS item2, count(*) AS n FROM t a JOIN t b ON a.b = b.b AND a.i < b.i GROUP BY 1, 2 HAVING count(*) >= 2")
def itemsets_filtered(spark, d):
    return baskets.frequent_itemsets(_baskets(spark, d, 4), 2, 2)


@register(f"""WITH t AS (SELECT b % 4 AS p, b, i FROM ({BASKETS})), n AS (SELECT p, count(DISTINCT b) AS size FROM t GROUP BY 1),
  s AS (SELECT i FROM t GROUP BY 1 HAVING count(*) >= 8), g AS (SELECT * FROM t WHERE i IN (SELECT i FROM s))
SELECT 1 AS k, CAST(i AS VARCHAR) AS items FROM s UNION ALL
SELECT DISTINCT 2, a.i || ',' || b.i FROM g a JOIN g b ON a.p = b.p AND a.b = b.b AND a.i < b.i JOIN n ON n.p = a.p GROUP BY a.p, a.i, b.i, size
HAVING count(*) * (SELECT sum(size) FROM n) >= 8 * size""")
def son_candidates(spark, d):
    return baskets.son_candidates(_baskets(spark, d).withColumn("part", F.pmod("basket", F.lit(4))), 8)


SETS = f"""WITH t AS ({BASKETS}), s AS (SELECT i FROM t GROUP BY 1 HAVING count(*) >= 4), g AS (SELECT * FROM t WHERE i IN (SELECT i FROM s)),
  a AS (SELECT 1 AS k, CAST(i AS VARCHAR) AS items, count(*) AS n FROM g GROUP BY i UNION ALL
    SELECT 2, a.i || ',' || b.i, count(*) FROM g a JOIN g b ON a.b = b.b AND a.i < b.i GROUP BY a.i, b.i UNION ALL
    SELECT 3, a.i || ',' || b.i || ',' || c.i, count(*) FROM g a JOIN g b ON a.b = b.b AND a.i < b.i JOIN g c ON c.b = b.b AND b.i < c.i GROUP BY a.i, b.i, c.i)"""


@register(SETS + " SELECT k, items, n FROM a WHERE n >= 4")
def son_frequent(spark, d):
    """Both passes: candidates of two parts, then their counts over all baskets."""
    return baskets.son(_baskets(spark, d).withColumn("part", F.pmod("basket", F.lit(2))), 4)


@register(SETS + " SELECT k, items, n FROM a WHERE n >= 4")
def all_frequent(spark, d):
    """By pattern growth."""
    found = baskets.all_frequent(_baskets(spark, d), 4)
    return found.select(F.size("items").alias("k"), F.array_join(F.array_sort("items"), ",").alias("items"), F.col("freq").alias("n"))


# Similar sets ------------------------------------------------------------------------------------------------------


def _sets(spark, d):
    return _baskets(spark, d).select(F.col("basket").alias("id"), "item")


JACCARD = f"""WITH t AS ({BASKETS}), n AS (SELECT b, count(*) AS n FROM t GROUP BY 1),
  c AS (SELECT x.b AS id1, y.b AS id2, count(*) AS c FROM t x JOIN t y ON x.i = y.i AND x.b < y.b GROUP BY 1, 2)
SELECT id1, id2, round(c / (p.n + q.n - c), 6) AS similarity FROM c JOIN n p ON p.b = id1 JOIN n q ON q.b = id2 WHERE c / (p.n + q.n - c) >= 0.5"""


@register(JACCARD)
def jaccard_pairs(spark, d):
    return similarity.jaccard_join(_sets(spark, d)).withColumn("similarity", F.round("similarity", 6))


HASHES = 100
SIGNATURES = f"WITH t AS ({BASKETS}), h AS (" + " UNION ALL ".join(f"SELECT b AS id, {k} AS k, min(({hash_terms(k)[0]} * i + {hash_terms(k)[1]}) % 2147483647) AS h FROM t GROUP BY 1" for k in range(HASHES)) + ")"


@register(SIGNATURES + " SELECT id, k, h FROM h WHERE k < 8")
def minhash_signature(spark, d):
    return similarity.minhash(_sets(spark, d), 8).select("id", F.posexplode("sig").alias("k", "h"))


CANDIDATES = ", p AS (SELECT a.id, a.k // 2 AS band, a.h AS h1, b.h AS h2 FROM h a JOIN h b ON a.id = b.id AND b.k = a.k + 1 WHERE a.k % 2 = 0), q AS (SELECT DISTINCT x.id AS id1, y.id AS id2 FROM p x JOIN p y ON x.band = y.band AND x.h1 = y.h1 AND x.h2 = y.h2 AND x.id < y.id)"


@register(SIGNATURES + CANDIDATES + " SELECT id1, id2 FROM q")
def lsh_candidates(spark, d):
    return similarity.lsh_candidates_of(_sets(spark, d), HASHES)


@register(SIGNATURES + CANDIDATES + """, n AS (SELECT b, count(*) AS n FROM t GROUP BY 1),
  c AS (SELECT id1, id2, count(*) AS c FROM q JOIN t x ON x.b = id1 JOIN t y ON y.b = id2 AND x.i = y.i GROUP BY 1, 2)
SELECT id1, id2, round(c / (n1.n + n2.n - c), 6) AS similarity FROM c JOIN n n1 ON n1.b = id1 JOIN n n2 ON n2.b = id2 WHERE c / (n1.n + n2.n - c) >= 0.5""")
def lsh_jaccard(spark, d):
    return similarity.lsh_jaccard(_sets(spark, d), HASHES).withColumn("similarity", F.round("similarity", 6))


# Recommendation ----------------------------------------------------------------------------------------------------

RATINGS = "r AS (SELECT o_custkey AS u, l_suppkey AS i, avg(l_quantity / 10) AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"
MEANS = f"m AS (SELECT i, round(avg(x) + 1e-9, 4) AS mu, count(*) AS n, {TIERS} AS base FROM r GROUP BY 1)"
SIMILAR = """d AS (SELECT r.u, r.i, x - mu AS d FROM r JOIN m ON r.i = m.i),
  s AS (SELECT a.i, b.i AS j, sum(a.d * b.d) / sqrt(sum(a.d * a.d) * sum(b.d * b.d)) AS w FROM d a JOIN d b ON a.u = b.u AND a.i <> b.i GROUP BY 1, 2 HAVING sum(a.d * a.d) > 0 AND sum(b.d * b.d) > 0 AND sum(a.d * b.d) > 0)"""
TESTS = "t AS (SELECT u, i FROM r WHERE (u * 31 + i) % 97 = 0 UNION SELECT -1, i FROM m UNION SELECT u, -1 FROM r WHERE u % 50 = 0 UNION SELECT -1, -1)"


def cf_sql(weight, enough):
    return f"""WITH {RATINGS}, {MEANS}, {SIMILAR}, {TESTS}, v AS (SELECT u, round(avg(x) + 1e-9, 4) AS um FROM r GROUP BY 1),
  g AS (SELECT t.u, t.i, count(*) AS c, count(*) FILTER (w >= 0.3) AS c3, count(*) FILTER (w >= 0.5) AS c5, sum(r.x * {weight}) / sum({weight}) AS res
    FROM t JOIN r ON r.u = t.u AND r.i <> t.i JOIN s ON s.i = t.i AND s.j = r.i JOIN m ON m.i = r.i GROUP BY 1, 2),
  f AS (SELECT t.u, t.i, coalesce(m.base, um, 3.0) AS fb, CASE WHEN m.base IS NOT NULL AND um IS NOT NULL AND {enough}
    THEN CASE WHEN c5 = 0 THEN 0.2 * res + 0.8 * m.base ELSE 0.4 * res + 0.6 * m.base END END AS cf
    FROM t LEFT JOIN m ON m.i = t.i LEFT JOIN v ON v.u = t.u LEFT JOIN g ON g.u = t.u AND g.i = t.i)"""


def _ratings(spark, d):
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    return cut_table(recommend.ratings(lines.join(orders, lines.l_orderkey == orders.o_orderkey).withColumn("x", F.col("l_quantity") / 10), "o_custkey", "l_suppkey", "x"))


def _tests(r):
    """Some known pairs, and cold starts of either side and of both."""
    known = r.where(F.pmod(F.col("u") * 31 + F.col("i"), F.lit(97)) == 0).select("u", "i")
    cold = r.select(F.lit(-1).cast("bigint").alias("u"), "i").union(r.where("u % 50 = 0").select("u", F.lit(-1).cast("bigint").alias("i")))
    return known.union(cold).union(r.sparkSession.sql("SELECT -1L AS u, -1L AS i")).distinct()


@register(f"WITH {RATINGS}, {MEANS} SELECT i, mu, n, round(base, 6) AS base FROM m")
def item_means(spark, d):
    return recommend.item_means(_ratings(spark, d)).withColumn("base", F.round("base", 6))


@register(f"WITH {RATINGS}, {MEANS}, {SIMILAR} SELECT i, j, round(w, 6) AS w FROM s WHERE i < j")
def item_similarity(spark, d):
    r = _ratings(spark, d)
    return recommend.item_similarity(r, recommend.item_means(r)).where("i < j").withColumn("w", F.round("w", 6))


@register(cf_sql("w / (1 + ln(n))", "c3 > 0") + " SELECT u, i, round(coalesce(cf, fb), 6) AS prediction FROM f")
def item_cf_predict(spark, d):
    r = _ratings(spark, d)
    return recommend.predict(r, _tests(r)).withColumn("prediction", F.round("prediction", 6))


@register(cf_sql("w", "c3 > 0 AND c > 7 AND c5 > 0") + " SELECT u, i, round(CASE WHEN cf IS NULL THEN fb ELSE 0.2 * cf + 0.8 * fb END, 6) AS prediction FROM f")
def hybrid_blend(spark, d):
    """With the tiered mean in the model's place, so that SQL can follow."""
    r = _ratings(spark, d)
    cf = recommend.item_cf(r, _tests(r), discount=False, least_neighbours=7)
    return recommend.hybrid(cf, cf.select("u", "i", F.col("fallback").alias("m"))).withColumn("prediction", F.round("prediction", 6))


@register(f"""WITH {RATINGS}, {MEANS}, e AS (SELECT r.x - m.base AS e FROM r JOIN m ON r.i = m.i)
SELECT CAST(least(floor(abs(e)), 4) AS INTEGER) AS bucket, count(*) AS n, round((SELECT sqrt(avg(e * e)) FROM e), 6) AS rmse FROM e GROUP BY 1""")
def rmse_hist(spark, d):
    r = _ratings(spark, d)
    return recommend.evaluate(r.join(recommend.item_means(r), "i"), "x", "base").withColumn("rmse", F.round("rmse", 6))


def _features(spark, d):
    """(u, i, x) with features of the user (orders, spending, years) and the item (supplier and its parts)."""
    c, o, s, l = (table(spark, d, n) for n in ("customer", "orders", "supplier", "lineitem"))
    spent = o.groupBy(F.col("o_custkey").alias("u")).agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("spent"), F.min(F.year("o_orderdate")).alias("since"), F.count_distinct(F.year("o_orderdate")).alias("years"), F.count_if(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("n_urgent"))
    sold = l.groupBy(F.col("l_suppkey").alias("i")).agg(F.count("*").alias("n_lines"), F.count_distinct("l_partkey").alias("n_parts"), F.count_if(F.col("l_returnflag") == "R").alias("n_returned"))
    users = c.select(F.col("c_custkey").alias("u"), F.col("c_acctbal").alias("u_balance")).join(spent, "u", "left")
    items = s.select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("i_balance")).join(sold, "i", "left")
    return _ratings(spark, d).join(users, "u").join(recommend.few(s)(items), "i").fillna(0)


FEATURES = ["n_orders", "spent", "since", "years", "n_urgent", "n_lines", "n_parts", "n_returned", "u_balance", "i_balance"]
FEATURE_SQL = f"""WITH {RATINGS}, a AS (SELECT o_custkey AS u, count(*) AS n_orders, round(sum(o_totalprice), 2) AS spent, min(year(o_orderdate)) AS since, count(DISTINCT year(o_orderdate)) AS years,
    count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS n_urgent FROM orders GROUP BY 1),
  b AS (SELECT l_suppkey AS i, count(*) AS n_lines, count(DISTINCT l_partkey) AS n_parts, count(*) FILTER (l_returnflag = 'R') AS n_returned FROM lineitem GROUP BY 1),
  f AS (SELECT r.u, r.i, x, n_orders, spent, CAST(since AS INTEGER) AS since, years, n_urgent, n_lines, n_parts, n_returned, c_acctbal AS u_balance, s_acctbal AS i_balance
    FROM r JOIN a ON r.u = a.u JOIN b ON r.i = b.i JOIN customer ON c_custkey = r.u JOIN supplier ON s_suppkey = r.i)"""


@register(FEATURE_SQL + " SELECT u, i, n_orders, spent, since, years, n_urgent, n_lines, n_parts, n_returned, u_balance, i_balance FROM f")
def features_v1(spark, d):
    return _features(spark, d).select("u", "i", *FEATURES)


@register(FEATURE_SQL + """ SELECT u, i, CAST(2019 - since AS INTEGER) AS age, round(CASE WHEN n_orders = 0 THEN 0 ELSE n_urgent / n_orders END, 6) AS urgent_share,
  round(CASE WHEN n_lines = 0 THEN 0 ELSE n_returned / n_lines END, 6) AS returned_share, n_parts, years FROM f""")
def features_v2(spark, d):
    share = lambda a, b: F.round(F.when(F.col(b) == 0, 0.0).otherwise(F.col(a) / F.col(b)), 6)
    return _features(spark, d).select("u", "i", (2019 - F.col("since")).alias("age"), share("n_urgent", "n_orders").alias("urgent_share"), share("n_returned", "n_lines").alias("returned_share"), "n_parts", "years")


#: Trees of the registered models; 500, the operator's default, take as many times longer as they are more.
TREES = 50


def _split(spark, d):
    """Features of known pairs, for training and for tests."""
    rows = cut_table(_features(spark, d))
    test = F.pmod(F.col("u") * 31 + F.col("i"), F.lit(10)) == 0
    return rows.where(~test), rows.where(test)


@register()
def gbt_predict(spark, d):
    """(u, i, x, prediction, rmse): the model on the tests, beside its root mean square error over all of them."""
    train, test = _split(spark, d)
    found = cut_table(recommend.boosted_trees(train, test, FEATURES, "x", trees=TREES).select("u", "i", "x", "m"))
    return found.join(F.broadcast(recommend.evaluate(found, "x", "m").select("rmse").distinct())).select("u", "i", "x", F.round("m", 6).alias("prediction"), F.round("rmse", 6).alias("rmse"))  # one row


@register()
def hybrid_model(spark, d):
    """(u, i, x, prediction, rmse): item CF where it has enough neighbours, blended with the boosted trees; the trees alone elsewhere."""
    train, test = _split(spark, d)
    known = train.select("u", "i", "x")
    model = recommend.boosted_trees(train, test, FEATURES, "x", trees=TREES).select("u", "i", "x", "m")
    cf = recommend.item_cf(known, test.select("u", "i"), discount=False, least_neighbours=7)
    found = cut_table(recommend.hybrid(cf, model))
    return found.join(F.broadcast(recommend.evaluate(found, "x", "prediction").select("rmse").distinct())).select("u", "i", "x", F.round("prediction", 6).alias("prediction"), F.round("rmse", 6).alias("rmse"))  # one row


def _side_tables(spark, d):
    """The tables in the form of the review data's side tables, each by its own schema: users are customers, businesses are suppliers."""
    c, o, s, l, e = (table(spark, d, n) for n in ("customer", "orders", "supplier", "lineitem", "events"))
    n = F.col("c_custkey")
    marks = [(n * (k + 3) % (7 + k)).alias(f"compliment_{x}") for k, x in enumerate(features.COMPLIMENTS)]
    elite = F.when(n % 3 == 0, "None").when(n % 3 == 1, "2012").otherwise("2012, 2015")
    user = c.select(n.cast("string").alias("user_id"), (n % 11).alias("review_count"), (n % 5).alias("fans"), (n % 13).alias("useful"), (n % 4).alias("funny"), (n % 6).alias("cool"), *marks, (n % 50 / 10).alias("average_stars"), F.concat((2005 + n % 12).cast("string"), F.lit("-01-02")).alias("yelping_since"), elite.alias("elite"))
    business = s.select(F.col("s_suppkey").cast("string").alias("business_id"), F.lit("x").alias("city"), (F.col("s_suppkey") % 5).cast("double").alias("stars"), F.col("s_suppkey").alias("review_count"))
    slots = l.groupBy(F.col("l_suppkey").cast("string").alias("business_id"), F.month("l_shipdate").cast("string").alias("m")).agg(F.count("*").alias("n")).where("cast(business_id AS bigint) % 4 > 0")
    checkin = slots.groupBy("business_id").agg(F.map_from_entries(F.collect_list(F.struct("m", "n"))).alias("time"))  # twelve months
    tip = e.select((F.col("user_id") % 100 + 1).cast("string").alias("user_id"), (F.col("event_id") % 20 + 1).cast("string").alias("business_id"), (F.col("event_id") % 9).alias("likes"), "event_id")
    label = F.element_at(F.array(*map(F.lit, ("food", "drink", "menu", "inside", "outside", "other"))), (F.col("l_linenumber") % 6 + 1).cast("int"))
    photo = l.where("l_suppkey % 5 > 0").select(F.col("l_suppkey").cast("string").alias("business_id"), label.alias("label"))
    pairs = o.join(l, o.o_orderkey == l.l_orderkey).select(F.col("o_custkey").cast("string").alias("user_id"), F.col("l_suppkey").cast("string").alias("business_id")).distinct()
    return user, business, checkin, tip, photo, pairs


PAIR_SQL = """WITH u AS (SELECT CAST(c_custkey AS VARCHAR) AS user_id, c_custkey AS n FROM customer),
  k AS (SELECT l_suppkey AS s, month(l_shipdate) AS m, count(*) AS n FROM lineitem WHERE l_suppkey % 4 > 0 GROUP BY 1, 2), kk AS (SELECT s, count(*) AS slots, sum(n) AS total FROM k GROUP BY 1),
  p AS (SELECT l_suppkey AS s, count(*) FILTER (l_linenumber % 6 IN (0, 1, 2)) AS food, count(*) FILTER (l_linenumber % 6 IN (3, 4)) AS place FROM lineitem WHERE l_suppkey % 5 > 0 GROUP BY 1),
  t AS (SELECT user_id % 100 + 1 AS u, event_id % 20 + 1 AS s, count(*) AS tips, max_by(event_id % 9, event_id) AS likes FROM events GROUP BY 1, 2),
  q AS (SELECT DISTINCT o_custkey AS u, l_suppkey AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
  x AS (SELECT u AS c, q.s, n % 11 AS u_reviews, n % 50 / 10 AS u_stars, 2005 + n % 12 AS since, n % 5 AS u_fans, n % 13 AS u_useful, n % 13 + n % 4 + n % 6 AS u_votes,
    CASE n % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS u_elite, CASE n % 3 WHEN 0 THEN 0 WHEN 1 THEN 8 ELSE 11 END AS last,
    n * 3 % 7 + n * 4 % 8 + n * 5 % 9 + n * 6 % 10 + n * 7 % 11 + n * 8 % 12 AS compliments FROM q JOIN (SELECT c_custkey AS u, c_custkey AS n FROM customer) USING (u)),
  f AS (SELECT CAST(c AS VARCHAR) AS user_id, CAST(x.s AS VARCHAR) AS business_id, x.*, CAST(x.s % 5 AS DOUBLE) AS b_stars, x.s AS b_reviews, CAST(coalesce(slots, 0) AS BIGINT) AS b_slots, CAST(coalesce(total, 0) AS BIGINT) AS b_checkins,
    coalesce(tips, 0) AS tips, coalesce(likes, 0) AS tip_likes, coalesce(food, 0) AS photo_food, coalesce(place, 0) AS photo_place
    FROM x LEFT JOIN kk ON kk.s = x.s LEFT JOIN p ON p.s = x.s LEFT JOIN t ON t.u = x.c AND t.s = x.s)"""


def _pair_features(spark, d):
    user, business, checkin, tip, photo, pairs = _side_tables(spark, d)
    return features.pair_features(pairs, features.user_features(user), features.business_features(business, checkin, photo), features.tip_features(tip, "event_id"))


@register(PAIR_SQL + " SELECT user_id, business_id, u_reviews, u_stars, CAST(since AS INTEGER) AS u_since, u_fans, u_useful, u_votes, u_elite, compliments AS u_compliments, b_stars, b_reviews, b_checkins, tip_likes, photo_food, photo_place FROM f")
def review_features_v1(spark, d):
    """The first feature list, from tables in the side tables' own schemas."""
    return _pair_features(spark, d).select("user_id", "business_id", *features.V1)


@register(PAIR_SQL + " SELECT user_id, business_id, u_reviews, u_stars, CAST(2019 - since AS INTEGER) AS u_years, u_fans, u_votes, u_elite, last AS u_last_elite, round(CASE WHEN u_reviews = 0 THEN 0 ELSE compliments / u_reviews END, 6) AS u_compliment_share, b_stars, b_reviews, b_slots, b_checkins, tips, photo_food, photo_place FROM f")
def review_features_v2(spark, d):
    """The later feature list."""
    return _pair_features(spark, d).select("user_id", "business_id", *features.V2).withColumn("u_compliment_share", F.round("u_compliment_share", 6))


@register("SELECT c_custkey, list_reduce(list_transform(range(1, CAST(length(c_name) AS BIGINT) + 1), lambda k: CAST(ord(substr(c_name, k, 1)) AS BIGINT)), lambda a, x: (a * 256 + x) % 69997) AS h FROM customer")
def text_hashes(spark, d):
    return table(spark, d, "customer").select("c_custkey", text_hash(F.col("c_name"), 69_997).alias("h"))


@register("SELECT p_type AS value, row_number() OVER (ORDER BY p_type) - 1 AS id FROM (SELECT DISTINCT p_type FROM part WHERE p_type IS NOT NULL)")
def dense_ids(spark, d):
    return readers.dense_ids(table(spark, d, "part"), "p_type")


@register("SELECT p_partkey, p_type FROM part WHERE p_type IS NOT NULL")
def decoded_ids(spark, d):
    """Types go to numbers and back by name."""
    p = table(spark, d, "part").select("p_partkey", "p_type")
    ids = cut(readers.dense_ids(p, "p_type"))
    return readers.decoded(p.join(ids, F.col("p_type") == F.col("value")).select("p_partkey", F.col("id").alias("p_type")), "p_type", ids).select("p_partkey", "p_type")


# Graphs ------------------------------------------------------------------------------------------------------------


def edges_sql(least):
    return f"""p AS (SELECT DISTINCT o_custkey AS u, l_partkey AS i FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  e AS (SELECT a.u AS src, b.u AS dst, count(*) AS common FROM p a JOIN p b ON a.i = b.i AND a.u < b.u GROUP BY 1, 2 HAVING count(*) >= {least}),
  w AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)"""


def _edges(spark, d, least=6):
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    pairs = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item")).distinct()
    return graph.cooccurrence_edges(pairs, least)


@register(f"WITH {edges_sql(6)} SELECT src, dst, common FROM e")
def cooc_edges(spark, d):
    return _edges(spark, d)


@register(f"WITH {edges_sql(6)} SELECT src AS node, count(*) AS degree FROM w GROUP BY 1")
def graph_degrees(spark, d):
    return graph.degrees(_edges(spark, d))


@register(f"""WITH {edges_sql(6)}, k AS (SELECT c_nationkey AS g, count(*) AS d FROM w JOIN customer ON c_custkey = src GROUP BY 1),
  a AS (SELECT x.c_nationkey AS g, count(*) AS c FROM e JOIN customer x ON x.c_custkey = src JOIN customer y ON y.c_custkey = dst AND x.c_nationkey = y.c_nationkey GROUP BY 1)
SELECT round(coalesce(sum(coalesce(c, 0) / (SELECT count(*) FROM e) - pow(d / (2.0 * (SELECT count(*) FROM e)), 2)), 0), 6) AS q FROM k LEFT JOIN a ON a.g = k.g""")
def modularity(spark, d):
    groups = table(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.col("c_nationkey").alias("label"))
    return graph.modularity(cut(_edges(spark, d)), groups).select(F.round(F.coalesce("q", F.lit(0.0)), 6).alias("q"))


@register(f"WITH RECURSIVE {edges_sql(6)}, c(v, l) AS (SELECT DISTINCT src, src FROM w UNION SELECT w.dst, c.l FROM c JOIN w ON w.src = c.v WHERE c.l < w.dst) SELECT v AS node, min(l) AS label FROM c GROUP BY 1")
def connected_components(spark, d):
    return graph.connected_components(_edges(spark, d))


ROUNDS = ", ".join(
    f"l{k} AS (SELECT src AS node, first(label ORDER BY n DESC, label) AS label FROM (SELECT src, label, count(*) AS n FROM w JOIN l{k - 1} ON node = dst GROUP BY 1, 2) GROUP BY 1)" for k in range(1, 6)
)


@register(f"WITH {edges_sql(6)}, l0 AS (SELECT DISTINCT src AS node, src AS label FROM w), {ROUNDS} SELECT node, label FROM l5")
def label_propagation(spark, d):
    return graph.label_propagation(_edges(spark, d))


#: Levels that the SQL of betweenness goes down to: more than the test graphs have, which the last one, left empty, shows.
LEVELS = 24


def between_sql(credit: str) -> str:
    """All shortest paths level by level, then credits back up."""
    sigma = "sum(s)" if credit == "paths" else "CAST(count(*) AS DOUBLE)"
    parts = [f"{edges_sql(6)}, v0 AS (SELECT DISTINCT src AS r, src AS n, 1.0::DOUBLE AS s FROM w)"]
    for k in range(1, LEVELS):
        seen = " AND ".join(f"NOT EXISTS (SELECT 1 FROM v{j} x WHERE x.r = v.r AND x.n = w.dst)" for j in range(max(0, k - 2), k))
        parts.append(f"v{k} AS MATERIALIZED (SELECT v.r, w.dst AS n, {sigma} AS s FROM v{k - 1} v JOIN w ON w.src = v.n WHERE {seen} GROUP BY 1, 2)")
    parts.append(f"f{LEVELS - 1} AS (SELECT r, n, s, 1.0::DOUBLE AS f FROM v{LEVELS - 1})")
    for k in range(LEVELS - 1, 0, -1):
        parts.append(f"c{k} AS MATERIALIZED (SELECT f.r, f.n, p.n AS up, f * p.s / sum(p.s) OVER (PARTITION BY f.r, f.n) AS x FROM f{k} f JOIN w ON w.src = f.n JOIN v{k - 1} p ON p.r = f.r AND p.n = w.dst)")
        parts.append(f"f{k - 1} AS MATERIALIZED (SELECT v.r, v.n, s, 1 + coalesce(x, 0) AS f FROM v{k - 1} v LEFT JOIN (SELECT r, up, sum(x) AS x FROM c{k} GROUP BY 1, 2) c ON c.r = v.r AND c.up = v.n)")
    every = " UNION ALL ".join(f"SELECT least(n, up) AS src, greatest(n, up) AS dst, x FROM c{k}" for k in range(1, LEVELS))
    return f"WITH {', '.join(parts)} SELECT src, dst, round(sum(x) / 2, 5) AS betweenness FROM ({every}) GROUP BY 1, 2"


@register(between_sql("paths"))
def edge_betweenness(spark, d):
    return graph.edge_betweenness(cut(_edges(spark, d))).withColumn("betweenness", F.round("betweenness", 5))


@register(f"SELECT * FROM ({between_sql('paths')}) QUALIFY betweenness >= max(betweenness) OVER () * (1 - 1e-9)")
def most_between(spark, d):
    """Edges of the greatest betweenness."""
    return graph.most_between(cut(edge_betweenness(spark, d)))


@register(between_sql("indegree"))
def edge_betweenness_indegree(spark, d):
    return graph.edge_betweenness(cut(_edges(spark, d)), "indegree").withColumn("betweenness", F.round("betweenness", 5))


@register()
def girvan_newman(spark, d):
    return graph.girvan_newman(cut(_edges(spark, d, 7)))


# Sketches ----------------------------------------------------------------------------------------------------------

BITS, BLOOM = 2039, 3
bloom_bits = " UNION ".join(f"SELECT id, seq, batch, ({hash_terms(k)[0]} * (id % {BITS}) + {hash_terms(k)[1]}) % {BITS} AS bit FROM f" for k in range(BLOOM))


def bloom_sql(size):
    return f"""WITH s AS (SELECT o_orderkey // {size} AS batch, o_orderkey AS seq, o_custkey AS id FROM orders), f AS (SELECT id, min(seq) AS seq, min(seq) // {size} AS batch FROM s GROUP BY 1),
  k AS ({bloom_bits}), t AS (SELECT bit, min(seq) AS t FROM k GROUP BY 1), h AS (SELECT id, batch, max(t) < seq AS fp FROM k JOIN t ON k.bit = t.bit GROUP BY id, batch, seq),
  a AS (SELECT b.batch, count(*) FILTER (fp) AS fp, count(id) AS n FROM (SELECT DISTINCT batch FROM s) b LEFT JOIN h ON h.batch = b.batch GROUP BY 1),
  c AS (SELECT batch, sum(fp) OVER w AS fp, sum(n) OVER w AS n FROM a WINDOW w AS (ORDER BY batch))
SELECT batch, CAST(fp AS BIGINT) AS false_positives, CAST(n AS BIGINT) AS seen, round(CASE WHEN n = 0 THEN 0 ELSE fp / n END, 6) AS fpr FROM c"""


@register(bloom_sql(1000))
def bloom_fpr(spark, d):
    s = table(spark, d, "orders").select(F.expr("o_orderkey div 1000").alias("batch"), F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("id"))
    return sketches.bloom_fpr(s, BITS, BLOOM).withColumn("fpr", F.round("fpr", 6))


FM = 100
fm_zeros = " UNION ALL ".join(f"SELECT w, {k // 2} AS g, {k} AS k, ({hash_terms(k)[0]} * (id % 69997) + {hash_terms(k)[1]}) % 69997 AS v FROM s" for k in range(FM))
WINDOWS = "b AS (SELECT event_id // {size} AS batch, user_id AS id FROM events), s AS (SELECT DISTINCT w, id FROM b, (SELECT unnest(range(0, 1 + (SELECT max(batch) FROM b) // 2)) AS w) WHERE batch BETWEEN 2 * w AND 2 * w + 2 AND 2 * w + 2 <= (SELECT max(batch) FROM b))"


def fm_sql(size):
    return f"""WITH {WINDOWS.format(size=size)}, h AS ({fm_zeros}), r AS (SELECT w, g, k, max(CASE WHEN v = 0 THEN 16 ELSE length(bin(v)) - length(rtrim(bin(v), '0')) END) AS r FROM h GROUP BY 1, 2, 3),
  m AS (SELECT w, g, avg(pow(2, r)) AS m FROM r GROUP BY 1, 2), o AS (SELECT w, m, row_number() OVER (PARTITION BY w ORDER BY m, g) AS n FROM m)
SELECT o.w, (SELECT count(*) FROM s WHERE s.w = o.w) AS truth, m AS estimate FROM o WHERE n = {FM // 4 + 1}"""


@register(fm_sql(300))
def fm_windows(spark, d):
    s = table(spark, d, "events").select(F.expr("event_id div 300").alias("batch"), F.col("user_id").alias("id"))
    return sketches.fm_windows(s, FM)


@register("""WITH s AS (SELECT event_id // 1000 AS batch, user_id AS id, event_id AS seq, (event_id * 1103515245 + 12345) % 2147483647 AS p FROM events)
SELECT a.batch, s.id, s.seq FROM (SELECT DISTINCT batch FROM s) a JOIN s ON s.batch <= a.batch QUALIFY row_number() OVER (PARTITION BY a.batch ORDER BY p, seq) <= 20""")
def reservoir(spark, d):
    s = table(spark, d, "events").select(F.expr("event_id div 1000").alias("batch"), F.col("user_id").alias("id"), F.col("event_id").alias("seq"))
    return sketches.reservoir(s, 20)


@register("""SELECT CAST(to_timestamp(s) AT TIME ZONE 'UTC' AS TIMESTAMP) AS start, count(DISTINCT user_id) AS users
FROM (SELECT user_id, epoch(ts) AS t, unnest([floor(epoch(ts) / 7200) * 7200, floor(epoch(ts) / 7200) * 7200 - 7200]) AS s FROM events) WHERE t < s + 10800 GROUP BY 1""")
def sliding_distinct(spark, d):
    return sketches.sliding_distinct(table(spark, d, "events"), "ts", "user_id").select(F.col("start").cast("timestamp_ntz").alias("start"), "users")


# Clustering --------------------------------------------------------------------------------------------------------

SUMMARY = "x AS (SELECT vec_id, label, unnest(range(0, len(embedding))) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings), s AS (SELECT label, dim, count(*) AS n, sum(v) AS s, sum(v * v) AS q FROM x GROUP BY 1, 2)"


def _points(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("features"))


@register(f"WITH {SUMMARY} SELECT label, CAST(dim AS INTEGER) AS dim, n, round(s, 6) AS sum, round(q, 6) AS sumsq FROM s")
def bfr_summary(spark, d):
    return clustering.summaries(_points(spark, d), "label").select("label", "dim", "n", F.round("sum", 6).alias("sum"), F.round("sumsq", 6).alias("sumsq"))


@register(f"""WITH {SUMMARY}, m AS (SELECT vec_id, s.label, sqrt(sum(pow(v - s / n, 2) / greatest(q / n - pow(s / n, 2), 1e-12))) AS dist, count(*) AS d FROM x JOIN s ON x.dim = s.dim GROUP BY 1, 2)
SELECT vec_id AS id, CASE WHEN min(dist) < 2 * sqrt(max(d)) THEN first(label ORDER BY dist, label) ELSE -1 END AS cluster FROM m GROUP BY 1""")
def bfr_assign(spark, d):
    p = _points(spark, d)
    return clustering.assign(p, clustering.collected(p, "label")).select("id", "cluster")


@register()
def bfr(spark, d):
    return clustering.bfr(_points(spark, d).select("id", "features"), 8)[0]


# Readers and writers: tables go out in a format and come back ------------------------------------------------------


def _files(spark):
    return shared_path(spark, "files")


@register("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_round_trip(spark, d):
    path = _files(spark)
    sinks.csv_files(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), path)
    return readers.csv(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@register("SELECT CAST(c_custkey AS VARCHAR) AS business_id, c_mktsegment AS city, c_acctbal AS stars, CAST(c_nationkey AS BIGINT) AS review_count FROM customer")
def json_round_trip(spark, d):
    path = _files(spark)
    out = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("business_id"), F.col("c_mktsegment").alias("city"), F.col("c_acctbal").alias("stars"), F.col("c_nationkey").cast("bigint").alias("review_count"))
    out.write.json(path)
    return readers.json_lines(spark, path, "business")


@register("SELECT p_name AS value, count(*) AS n FROM part GROUP BY 1")
def text_round_trip(spark, d):
    path = _files(spark)
    table(spark, d, "part").select("p_name").write.text(path)
    return readers.lines(spark, path).groupBy("value").agg(F.count("*").alias("n"))


@register("SELECT vec_id AS id, CAST(dim AS INTEGER) AS dim, round(v, 5) AS x FROM (SELECT vec_id, unnest(range(0, len(embedding))) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings)")
def numeric_round_trip(spark, d):
    """Points without a header: id, label, components."""
    path, e = _files(spark), table(spark, d, "embeddings")
    size = e.agg(F.max(F.size("embedding"))).first()[0] or 1
    e.select("vec_id", "label", *[F.col("embedding")[k].cast("double").alias(f"f{k}") for k in range(size)]).write.csv(path)
    return readers.numeric_points(spark, path, size).select("id", F.posexplode("features").alias("dim", "x")).withColumn("x", F.round("x", 5))


@register("SELECT strftime(o_orderdate, '%-m/%-d/%y') || '-' || ltrim(CAST(o_custkey AS VARCHAR), '0') AS basket, ltrim(CAST(l_partkey AS VARCHAR), '0') AS item, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2")
def retail_round_trip(spark, d):
    """Quoted fields, dates as M/D/YYYY, ids with leading zeros."""
    path, lines, orders = _files(spark), table(spark, d, "lineitem"), table(spark, d, "orders")
    x = F.lit("x")
    rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(F.date_format("o_orderdate", "M/d/yyyy").alias("day"), F.lpad(F.col("o_custkey").cast("string"), 12, "0").alias("customer"), x.alias("a"), x.alias("b"), x.alias("c"), F.lpad(F.col("l_partkey").cast("string"), 12, "0").alias("product"))
    rows.write.option("header", True).option("quoteAll", True).csv(path)
    return readers.retail_baskets(spark, path).groupBy("basket", "item").agg(F.count("*").alias("n"))


@register("SELECT strftime(o_orderdate, '%-m/%-d/%y') || '-' || o_custkey AS basket, l_partkey + 1 AS item FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def preprocessed_round_trip(spark, d):
    """Baskets out as DATE-CUSTOMER_ID,PRODUCT_ID and back."""
    path, lines, orders = _files(spark), table(spark, d, "lineitem"), table(spark, d, "orders")
    rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    sinks.preprocessed_csv(rows.select(F.concat_ws("-", F.date_format("o_orderdate", "M/d/yy"), F.col("o_custkey").cast("string")).alias("basket"), (F.col("l_partkey") + 1).alias("item")), path)
    return readers.csv(spark, path, "basket string, item bigint")


@register("SELECT 40 * 25 AS n, (SELECT count(DISTINCT c_mktsegment) FROM customer) AS kinds, 40 AS asks")
def drawn_ids(spark, d):
    """Facts of a stream of draws: rows, the ids that occur, and the asks."""
    drawn = readers.drawn_stream(table(spark, d, "customer").select(F.col("c_mktsegment").alias("id")), 25, 40)
    return drawn.agg(F.count("*").cast("int").alias("n"), F.count_distinct("id").alias("kinds"), F.count_distinct("ask").cast("int").alias("asks"))


# Streams -----------------------------------------------------------------------------------------------------------


@register("""SELECT CAST(to_timestamp(s) AT TIME ZONE 'UTC' AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total
FROM (SELECT event_type, value, epoch(ts) AS t, unnest([floor(epoch(ts) / 7200) * 7200, floor(epoch(ts) / 7200) * 7200 - 7200]) AS s FROM events) WHERE t < s + 10800 GROUP BY 1, 2""")
def stream_window_counts(spark, d) -> DataFrame:
    found = streams.drain(streams.windowed_counts(streams.event_stream(spark, d)), "complete")
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@register("""SELECT event_type, event_id, count(*) OVER (PARTITION BY event_type) AS total FROM events
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY (event_id * 1103515245 + 12345) % 2147483647, event_id) <= 20""")
def stream_reservoir(spark, d) -> DataFrame:
    """Each type's sample after the last batch (here one)."""
    return streams.drain(streams.reservoirs(streams.event_stream(spark, d)), "update")


@register(bloom_sql(4000))
def stream_bloom(spark, d) -> DataFrame:
    """Orders in batches of 4,000 keys, of which a micro-batch takes up to ``AT_ONCE``."""
    s = table(spark, d, "orders").select(F.expr("o_orderkey div 4000").alias("batch"), F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("id"))
    return streams.bloom_stream(streams.batches_of(s, shared_path(spark, "input"), streams.AT_ONCE), BITS, BLOOM).withColumn("fpr", F.round("fpr", 6))


@register(fm_sql(2000))
def stream_fm(spark, d) -> DataFrame:
    """Events in batches of 2,000, of which a micro-batch takes up to ``AT_ONCE``."""
    s = table(spark, d, "events").select(F.expr("event_id div 2000").alias("batch"), F.col("user_id").alias("id"))
    return streams.fm_stream(streams.batches_of(s, shared_path(spark, "input"), streams.AT_ONCE), FM)
