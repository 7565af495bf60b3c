"""Mixing sources to target weights by hash-threshold histograms.

Every document has a place on a hash line. For each source the sizes are
summed in 1024 hash buckets; the running sum shows in which bucket the budget
ends, and only that bucket is split into 1024 again, three levels deep. The
resulting threshold is a plain filter: nothing is sorted, and a smaller budget
selects a subset of what a larger one selects.

A source whose target exceeds its size is taken whole as often as it fits (at
most ``cap`` times) and the threshold decides over the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, park

LEVEL_BITS, LEVELS = 10, 3
BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_cell(id_col: Column, text: Column) -> Column:
    """A cell of 30 bits from the md5 of id and text, so rows without an id or with the same one are cut apart too; nulls count as empty."""
    both = F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit("\x01"), F.coalesce(text, F.lit("")))
    digits = F.substring(F.md5(both.cast("binary")), 1, 15)
    return F.shiftright(F.conv(digits, 16, 10).cast("long"), 60 - LEVEL_BITS * LEVELS)


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source (null is one): source_size and target.

    Sources sorted by code point, null last, take the weights in turn. The
    share of all sizes is dealt by weight; a target stops at cap times its
    source's size and the excess is dealt again, which is filling to one level:
    sources in the order of cap * size / weight are full up to the first that
    the level does not reach.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (turn + 1).cast("int"))
    everything = Window.partitionBy(F.lit(0))
    per = per.withColumn("weight", w).withColumn("full", F.col("source_size") * F.lit(float(cap)))
    per = per.withColumn("reach", F.col("full") / F.col("weight"))
    earlier = everything.orderBy("reach", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(earlier), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))
    per = per.withColumn("level", left / open_weight).withColumn("is_full", F.col("reach") <= F.col("level"))
    water = F.min_by(F.when(~F.col("is_full"), F.col("level")), F.when(~F.col("is_full"), F.col("reach"))).over(everything)
    per = per.withColumn("target", F.when(F.col("is_full"), F.col("full")).otherwise(F.col("weight") * water))
    return per.select("source", "source_size", F.round("target", 6).alias("target"))


def _cuts(sized: DataFrame, sources: DataFrame, near) -> DataFrame:
    """source, cut: cells below the cut are taken once more."""
    open_ = sources.select("source", (F.col("target") - F.col("copies") * F.col("source_size")).alias("rest")).where(F.col("rest") > 0)
    state = open_.select("source", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"))
    for level in range(LEVELS):
        shift = LEVEL_BITS * (LEVELS - 1 - level)
        s = state.withColumnRenamed("source", "s")
        inside = F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("cell", shift + LEVEL_BITS) == F.col("prefix"))
        histogram = sized.join(near(s), inside).groupBy("source", "rest", "before", F.shiftright("cell", shift).alias("bucket")).agg(F.sum("size").alias("sum"))
        upto = F.col("before") + F.sum("sum").over(Window.partitionBy("source").orderBy("bucket"))
        buckets = histogram.withColumn("upto", upto).where(F.col("upto") >= F.col("rest"))
        state = buckets.groupBy("source").agg(
            F.first("rest").alias("rest"), F.min("bucket").alias("prefix"), F.min_by(F.col("upto") - F.col("sum"), "bucket").alias("before"), F.min("upto").alias("upto")
        )
        state = park(state, "mix-cut")  # one row per source
    closer = (F.col("upto") - F.col("rest")) < (F.col("rest") - F.col("before"))
    return state.select("source", (F.col("prefix") + F.when(closer, 1).otherwise(0)).alias("cut"))


def mix_plan(sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sized (source, size, cell): a row for each source with source_size, target, whole (times it is taken whole) and cut.

    Hinted for broadcast where the sources were counted and are few.
    """
    sources = source_targets(sized, weights, share, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = park(sources.withColumn("copies", whole), "mix-sources")
    few = sources.count() <= BROADCAST_SOURCES

    def near(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if few else df

    cuts = _cuts(sized, sources, near).withColumnRenamed("source", "c")
    plan = sources.join(near(cuts), F.col("source").eqNullSafe(F.col("c")), "left")
    return near(plan.select(F.col("source").alias("mix_source"), "source_size", "target", F.col("copies").alias("whole"), F.coalesce("cut", F.lit(0)).alias("cut")))


def _sized(docs: DataFrame) -> DataFrame:
    return park(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), hash_cell(F.col("doc_id"), F.col("text")).alias("cell")), "mix-sized")


def _copies() -> Column:
    return F.col("whole") + F.when(F.col("cell") < F.col("cut"), 1).otherwise(0)


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """For each row of docs (doc_id, text, source): size, source_size, target, copies and taken.

    copies is how often the mix takes the document, at most ceil(cap); taken is
    size times copies. Empty and null texts have size 0. Rows that agree in
    doc_id and text share a hash cell and are taken alike. An empty table gives
    no rows.
    """
    sized = _sized(docs)
    out = sized.join(mix_plan(sized, weights, share, cap), F.col("source").eqNullSafe(F.col("mix_source"))).withColumn("copies", _copies())
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The rows of docs, each as often as ``mix`` says in copies; texts without words have a hash cell as any other."""
    plan = mix_plan(_sized(docs), weights, share, cap)
    packed = docs.select(F.struct(*docs.columns).alias("doc"), F.col("source").alias("own"), hash_cell(F.col("doc_id"), F.col("text")).alias("cell"))
    dealt = packed.join(plan, F.col("own").eqNullSafe(F.col("mix_source")))
    return dealt.select("doc", F.explode(F.array_repeat(F.lit(1), _copies().cast("int")))).select(*(F.col("doc")[c].alias(c) for c in docs.columns))


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || chr(1) || coalesce(text, '')), 1, 15))::BIGINT >> 30) AS cell
  FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
      source_size * 2.0::DOUBLE AS full_size FROM per),
r AS (SELECT *, full_size / weight AS reach FROM w),
l AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM r)::DOUBLE
             - coalesce(sum(full_size) OVER (ORDER BY reach, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / ((SELECT sum(weight) FROM r)
             - coalesce(sum(weight) OVER (ORDER BY reach, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM r),
t AS (SELECT source, source_size, round(CASE WHEN reach <= level THEN full_size
             ELSE weight * (SELECT min_by(level, reach) FROM l WHERE reach > level) END, 6) AS target FROM l),
c AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
cells AS (SELECT source, cell, sum(size)::BIGINT AS s FROM sized GROUP BY source, cell),
runs AS (SELECT cells.source, cell, s, c.target - c.whole * c.source_size AS rest,
                sum(s) OVER (PARTITION BY cells.source ORDER BY cell) AS upto
         FROM cells JOIN c ON cells.source IS NOT DISTINCT FROM c.source),
edge AS (SELECT source, min(cell) AS cell, min(rest) AS rest, min(upto) AS upto, min_by(upto - s, cell) AS before_
         FROM runs WHERE rest > 0 AND upto >= rest GROUP BY source),
cut AS (SELECT source, cell + CASE WHEN upto - rest < rest - before_ THEN 1 ELSE 0 END AS cut FROM edge)
SELECT doc_id, size, c.source_size, c.target,
       (size * (whole + CASE WHEN cell < coalesce(cut.cut, 0) THEN 1 ELSE 0 END))::BIGINT AS taken,
       (whole + CASE WHEN cell < coalesce(cut.cut, 0) THEN 1 ELSE 0 END)::BIGINT AS copies
FROM sized JOIN c ON sized.source IS NOT DISTINCT FROM c.source
LEFT JOIN cut ON sized.source IS NOT DISTINCT FROM cut.source
"""
