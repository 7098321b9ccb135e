"""Readers: every schema is stated, so no input is scanned for inference."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.columns import strip_zeros
from sparkloom.session import cut

#: Fields of the JSON inputs.
SCHEMAS = {
    "review": "review_id string, user_id string, business_id string, stars double, date string",
    "business": "business_id string, city string, stars double, review_count bigint",
    "checkin": "business_id string, time map<string,bigint>",
    "tip": "user_id string, business_id string, likes bigint",
    "photo": "business_id string, label string",
    "user": "user_id string, review_count bigint, fans bigint, useful bigint, funny bigint, cool bigint, compliment_hot bigint, compliment_more bigint, compliment_plain bigint, "
    "compliment_cool bigint, compliment_funny bigint, compliment_writer bigint, average_stars double, yelping_since string, elite string",
}


def lines(spark: SparkSession, path: str) -> DataFrame:
    """One column ``value``."""
    return spark.read.text(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A malformed line raises. schema: DDL or a name of SCHEMAS."""
    return spark.read.schema(SCHEMAS.get(schema, schema)).option("mode", "FAILFAST").json(path)


def csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """Blanks beside commas are dropped."""
    return spark.read.schema(schema).csv(path, header=header, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def numeric_points(spark: SparkSession, path: str, dimensions: int) -> DataFrame:
    """(id, features) of a CSV without header: id, an ignored label, then the components."""
    names = [f"f{i}" for i in range(dimensions)]
    rows = csv(spark, path, ", ".join(["id bigint", "label string", *(f"{n} double" for n in names)]), header=False)
    return rows.select("id", F.array(*names).alias("features"))


def retail_baskets(spark: SparkSession, path: str) -> DataFrame:
    """(basket, item) of a quoted CSV: column 0 a date M/D/YYYY, 1 a customer and 5 a product, both with leading zeros."""
    rows = spark.read.csv(path, header=True, quote='"').toDF(*[f"c{i}" for i in range(len(spark.read.csv(path, header=True).columns))])
    day = F.date_format(F.to_date("c0", "M/d/yyyy"), "M/d/yy")
    return rows.select(F.concat_ws("-", day, strip_zeros(F.col("c1"))).alias("basket"), strip_zeros(F.col("c5")).alias("item"))


def dense_ids(df: DataFrame, column: str) -> DataFrame:
    """(value, id): the distinct values of a column that are not null, numbered 0, 1, ... in order.

    The sort is by ranges; a value's number is its place in its partition, after the rows of the partitions before, whose counts alone reach the driver.
    """
    rows = cut(df.select(F.col(column).alias("value")).where("value IS NOT NULL").distinct().orderBy("value").withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    counts = {r.part: r.n for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    before = dict(zip(sorted(counts), accumulate([0, *(counts[p] for p in sorted(counts))]), strict=False))
    if not before:
        return rows.select("value", F.col("place").alias("id"))
    offset = F.element_at(F.create_map(*[F.lit(x).cast("bigint") for pair in before.items() for x in pair]), part)
    return rows.select("value", (offset + F.col("place") - F.shiftleft(part, 33)).alias("id"))


def decoded(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """df with the ids of a column replaced by their values. ids: of dense_ids()."""
    names = ids.select(F.col("id").alias(column), "value")
    return df.join(names, column).withColumn(column, F.col("value")).drop("value")


def drawn_stream(ids: DataFrame, size: int, asks: int, seed: int = 1) -> DataFrame:
    """(ask, seq, id): each ask draws ``size`` of the distinct ids uniformly with replacement. ids: one column id, which is numbered by dense_ids()."""
    numbered = dense_ids(ids, "id").select(F.col("id").alias("at"), F.col("value").alias("id"))
    n = numbered.count()
    draws = ids.sparkSession.range(size * asks).select((F.col("id") / size).cast("bigint").alias("ask"), F.col("id").alias("seq"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(n, 1))).alias("at"))
    return draws.join(numbered, "at").select("ask", "seq", "id")
