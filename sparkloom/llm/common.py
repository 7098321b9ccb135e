"""What the operators of this subpackage share."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_thread() -> None:
    """The tokenizers library keeps to the worker's own thread, unless the environment says otherwise: with as many workers as cores, its threads mostly wait for work and use up time."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def lower_ascii(text: Column) -> Column:
    """A-Z become a-z; all other characters stay."""
    return F.translate(text, UPPER, LOWER)


def spaced_words(text: Column) -> Column:
    """The words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with one space before and after each; no words: two spaces."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), F.lit(" "))


def count_words(spaced: Column) -> Column:
    """How many words spaced_words() holds."""
    return F.when(spaced == "  ", 0).otherwise(F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit(""))) - 1).cast("bigint")


def words_sql(text: str) -> str:
    """SQL for the array of those words of column ``text``; no words: one empty string."""
    return f"split(trim(regexp_replace(translate(coalesce(cast(`{text}` AS string), ''), '{UPPER}', '{LOWER}'), r'[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ')), ' ')"


def crc_mod(column: Column, m: int) -> Column:
    """crc32 of the value as text, modulo m; a null counts as the empty string."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(m))


def bind(value: Column, f) -> Column:
    """f(value), where value is made once a row, however often f uses it."""
    return F.transform(F.array(value), f)[0]


#: Elements that running values are made of at a time.
RUN = 128


def _running(numbers: Column, first: int, join) -> Column:
    """For each of an array of whole numbers, all those before it joined (``first`` for none); in time near proportional to their number."""
    first_ = F.lit(first).cast("bigint")
    along = lambda values, start: F.slice(F.aggregate(values, F.array(start), lambda a, x: F.concat(a, F.array(join(F.element_at(a, -1), x)))), 1, F.size(values))
    whole = lambda values: F.aggregate(values, first_, join)
    parts = lambda own: F.transform(F.sequence(F.lit(0), ((F.size(own) - 1) / RUN).cast("int")), lambda b: F.slice(own, b * RUN + 1, RUN))
    many = lambda own: bind(parts(own), lambda p: F.flatten(F.zip_with(p, along(F.transform(p, whole), first_), along)))
    return bind(numbers.cast("array<bigint>"), lambda own: F.when(F.size(own) > 0, many(own)).otherwise(F.array().cast("array<bigint>")))


def running_totals(numbers: Column) -> Column:
    """For each element, the sum of those before it."""
    return _running(numbers, 0, lambda a, x: a + x)


def running_greatest(numbers: Column) -> Column:
    """For each element, the greatest of those before it, or -1."""
    return _running(numbers, -1, lambda a, x: F.greatest(a, x))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have, made from the given ones."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
