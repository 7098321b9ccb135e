"""Scalar expressions that several operators use; all built in, none a Python function."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trailing_zeros(value: Column, zero: int = 16) -> Column:
    """Trailing zeros of the binary form of a value from 0 on; the value 0 counts as ``zero``."""
    return F.when(value == 0, zero).otherwise(F.bit_count(F.bitwise_not(value).bitwiseAND(value - 1)))


def text_hash(text: Column, modulus: int) -> Column:
    """The text's UTF-8 bytes as one big-endian number, modulo ``modulus``; empty: 0."""
    digits = F.split(F.hex(F.encode(text, "UTF-8")), "(?<=\\G..)")
    value = lambda pair: F.conv(pair, 16, 10).cast("bigint")
    return F.aggregate(F.filter(digits, lambda p: p != ""), F.lit(0).cast("bigint"), lambda acc, p: (acc * 256 + value(p)) % modulus)


def linear_hash(value: Column, k: int, modulus: int) -> Column:
    """The k-th hash of a family of linear ones; see hash_terms()."""
    return hash_by(value, *map(F.lit, hash_terms(k)), modulus)


def hash_by(value: Column, a: Column, b: Column, modulus: int) -> Column:
    """The linear hash of slope a and offset b."""
    return F.pmod(a * F.pmod(value.cast("bigint"), F.lit(modulus)) + b, F.lit(modulus))


def hash_terms(k: int) -> tuple[int, int]:
    """Slope and offset of hash k, from a rule."""
    return (1_103_515_245 * (k + 1) + 12_345 * k * k) % 2_147_483_647, 15_485_863 % (1009 * (k + 3)) + 31 * k


def tiered_mean(x: str) -> Column:
    """Group average that leans to 3 in groups under 3, and leaves out one lowest and one highest value from 8 on."""
    n, mean = F.count(x), F.avg(x)
    return F.when(n < 3, mean - (mean - 3) * 0.5).when(n < 8, mean).otherwise((F.sum(x) - F.max(x) - F.min(x)) / (n - 2))


def elite_years(elite: Column) -> Column:
    """Years in 'None' or '2012, 2013'."""
    return F.when(elite.isNull() | elite.isin("", "None"), 0).otherwise(F.size(F.split(elite, ",")))


def strip_zeros(quoted: Column) -> Column:
    """An id without its quotes and leading zeros."""
    return F.regexp_replace(F.regexp_replace(quoted, '"', ""), "^0+", "")


def last_elite_year(elite: Column) -> Column:
    """The last year in '2012, 2013'; null for none."""
    return F.when(~(elite.isNull() | elite.isin("", "None")), F.right(elite, F.lit(4)).cast("int"))


def total_of(*names: str) -> Column:
    """Sum of columns, nulls as zeros."""
    return sum((F.coalesce(F.col(n), F.lit(0)) for n in names[1:]), F.coalesce(F.col(names[0]), F.lit(0)))


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, or 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / b)


def map_total(values: Column) -> Column:
    """Sum of a map's values."""
    return F.aggregate(F.map_values(values), F.lit(0).cast("bigint"), lambda a, x: a + x)
