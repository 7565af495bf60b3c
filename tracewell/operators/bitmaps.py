"""Indexes of values as bitmaps over object numbers: counts, intersections and merging without a row for each object.

A value of a column has one bitmap of 32,768 bits for each block of numbers that
it occurs in. Filters on several columns intersect bitmaps block by block, so
what crosses the network is 4 KB a block and value, compressed, however many
objects it stands for. Indexes over the same numbers merge by bitwise or.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 32_768


def bitmap_index(numbered: DataFrame, columns: list[str], number: str = "no") -> DataFrame:
    """numbered: number (from 1, unique) and the columns. column, value, block, bits: one row a value and block; null is a value."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))
    each = numbered.select(F.col(number).alias("n"), F.explode(pairs).alias("p"))
    return each.groupBy("p.column", "p.value", F.bitmap_bucket_number("n").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("bits"))


def merged(indexes: list[DataFrame]) -> DataFrame:
    """Indexes over the same numbers, say of the runs of a graph, as one."""
    return reduce(DataFrame.unionByName, indexes).groupBy("column", "value", "block").agg(F.bitmap_or_agg("bits").alias("bits"))


def value_counts(index: DataFrame) -> DataFrame:
    """column, value, n: how many objects hold each value."""
    return index.groupBy("column", "value").agg(F.sum(F.bitmap_count("bits")).alias("n"))


def selected(index: DataFrame, wanted: dict[str, list[str | None]]) -> DataFrame:
    """block, bits of the objects that hold one of the values given for each column; a value may be null."""
    rows = None
    for column, values in wanted.items():
        some = [v for v in values if v is not None]
        held = F.col("value").isin(some) if some else F.lit(False)
        if None in values:
            held = held | F.col("value").isNull()
        one = index.where((F.col("column") == column) & held).groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits"))
        rows = one if rows is None else rows.unionByName(one)
    both = rows.groupBy("block").agg(F.count(F.lit(1)).alias("k"), F.bitmap_and_agg("bits").alias("bits"))
    return both.where((F.col("k") == len(wanted)) & (F.bitmap_count("bits") > 0)).select("block", "bits")


def count_selected(index: DataFrame, wanted: dict[str, list[str | None]]) -> DataFrame:
    """One row, n: how many objects ``selected`` marks."""
    return selected(index, wanted).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n"))


def cross_counts(index: DataFrame, one: str, other: str) -> DataFrame:
    """one, other, n: how many objects hold each pair of values that occurs; a null value pairs as well."""
    a = index.where(F.col("column") == one).select("block", F.col("value").alias(one), F.col("bits").alias("a"))
    b = index.where(F.col("column") == other).select("block", F.col("value").alias(other), F.col("bits").alias("b"))
    pairs = a.join(b, "block").select("block", one, other, F.explode(F.array("a", "b")).alias("bits"))
    both = pairs.groupBy("block", one, other).agg(F.bitmap_count(F.bitmap_and_agg("bits")).alias("n"))
    return both.groupBy(one, other).agg(F.sum("n").alias("n")).where(F.col("n") > 0)


def _bit(bits: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (position % 8).cast("int")).bitwiseAND(F.lit(1))


def marked(numbered: DataFrame, bits: DataFrame, number: str = "no") -> DataFrame:
    """The rows of numbered whose number is set in bits (block, bits)."""
    asked = bits.withColumnRenamed("block", "bitmap_block").withColumnRenamed("bits", "bitmap_bits")
    near = numbered.join(asked, F.bitmap_bucket_number(number) == F.col("bitmap_block"))
    return near.where(_bit(F.col("bitmap_bits"), F.bitmap_bit_position(number)) == 1).select(*numbered.columns)
