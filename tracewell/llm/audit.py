"""Filter interaction audit by mask histogram: what each order of the quality filters removes, wastes and loses.

Every document gets a mask with one bit for each filter it fails. A
document's fate under any order of the filters depends on its mask alone, so
the corpus is reduced to one histogram of 2**k cells a part, and all orders are
counted from the cells.

Whether a text is identical to that of a smaller id is told by the smallest id
of its text (by SHA-256). It isn't joined back: documents of one text, part and
labels are counted together with how many of them hold their smallest id, and
these counts meet under the digest once more. Each grouping is combined before
its shuffle, so a text, a part or an id that a third of all rows share costs a
row a task.

Nulls: a null text is empty, a null part is the empty string, a document whose
id is null has no labels and is no copy of a smaller id. A document counts as
good or toxic if any label row of its id says so. Repeated rows count each.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The filters in the order of their letters; the last is the copy filter.
FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 200, 50, 3, r"[#$%&*|]"
COUNTS = ("n", "good", "toxic")


def text_failures(text: Column) -> dict[str, Column]:
    """Whether a text (never null) fails each of the filters that look at the text alone."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    return {
        "A": n < MIN_WORDS,
        "B": 100 * distinct < DISTINCT_PERCENT * n,
        "C": 100 * (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))) > CAPITAL_PERCENT * F.length(text),
        "D": text.rlike(SYMBOLS),
    }


def _bits(failures: dict[str, Column], letters: str = FILTERS) -> Column:
    return sum((F.when(failed, F.lit(1 << letters.index(x))).otherwise(F.lit(0)) for x, failed in failures.items()), F.lit(0))


def masked(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """docs: doc_id, text and the column part. part, mask, good, toxic, n: documents alike in all of these, counted.

    More than one row can have the same part, mask and labels; histogram() adds them.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    judged = docs.select(
        F.col("doc_id"), F.coalesce(F.col(part), F.lit("")).alias("part"), F.sha2(text.cast("binary"), 256).alias("digest"), _bits(text_failures(text)).alias("bits")
    )
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("label_id")).agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic")
    )
    flagged = judged.join(marks, F.col("doc_id") == F.col("label_id"), "left").select(
        "doc_id", "part", "digest", "bits", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")
    )
    alike = ["digest", "bits", "part", "good", "toxic"]
    each = flagged.groupBy(*alike, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    cells = each.groupBy(*alike).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least"))
    texts = cells.groupBy("digest").agg(F.min("least.doc_id").alias("first"), F.collect_list(F.struct(*alike[1:], "n", "no_id", "least")).alias("cells"))
    return _copies(texts)


def _copies(texts: DataFrame) -> DataFrame:
    """Split the cells of a text in those that fail the copy filter and those that don't."""
    cell = texts.select("first", F.explode("cells").alias("c")).select("first", "c.*")
    firsts = F.col("no_id") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    both = F.array(F.struct(F.col("bits").alias("mask"), firsts.alias("n")), F.struct((F.col("bits") + (1 << FILTERS.index("E"))).alias("mask"), (F.col("n") - firsts).alias("n")))
    return cell.select("part", "good", "toxic", F.explode(both).alias("m")).select("part", "m.mask", "good", "toxic", "m.n").where(F.col("n") > 0)


def histogram(masks: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: a row for each cell that has documents."""
    return masks.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def orders(cells: DataFrame, letters: str = FILTERS) -> DataFrame:
    """All orders of the filters over a histogram: part, filter_order, step and the seven counts, zeros included.

    A part's cells become three arrays of 2**k numbers (k filters), and every order and step sums over them; nothing is
    shuffled but the cells. redundant fail the step's filter but were removed before it; unique_fails fail no other.
    """
    size = 1 << len(letters)
    packed = cells.groupBy("part").agg(*(F.map_from_entries(F.collect_list(F.struct("mask", c))).alias(c) for c in COUNTS))

    def row(column: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda m: F.coalesce(F.element_at(F.col(column), m), F.lit(0)).cast("long"))

    dense = {c: row(c) for c in COUNTS}
    plan = F.array(*(F.lit("".join(p)) for p in permutations(letters)))
    steps = packed.select("part", *(v.alias(c) for c, v in dense.items())).withColumn("filter_order", F.explode(plan))
    steps = steps.withColumn("step", F.explode(F.array(*(F.lit(k) for k in range(1, len(letters) + 1)))))
    letter_bit = F.create_map(*(x for i, a in enumerate(letters) for x in (F.lit(a), F.lit(1 << i))))
    own = letter_bit[F.substring(F.col("filter_order"), F.col("step"), F.lit(1))]
    before = F.aggregate(
        F.sequence(F.lit(1), F.lit(len(letters))), F.lit(0), lambda total, k: total + F.when(k < F.col("step"), letter_bit[F.substring(F.col("filter_order"), k, F.lit(1))]).otherwise(0)
    )
    steps = steps.select("*", own.alias("own"), before.alias("before"))
    places = F.sequence(F.lit(0), F.lit(size - 1))
    turns = 1
    for k in range(2, len(letters) + 1):
        turns *= k

    def over(column: str, keep) -> Column:
        weigh = lambda total, m: total + keep(m) * F.element_at(F.col(column), m + 1)
        return F.aggregate(places, F.lit(0).cast("long"), weigh)

    def flag(condition: Column) -> Column:
        return F.when(condition, F.lit(1)).otherwise(F.lit(0)).cast("long")

    fails = lambda m: m.bitwiseAND(F.col("own")) != 0
    gone = lambda m: m.bitwiseAND(F.col("before")) != 0
    now = lambda m: flag(fails(m) & ~gone(m))
    share = lambda m: flag(fails(m)) * F.floor(F.lit(turns) / F.greatest(F.bit_count(m), F.lit(1)))
    return steps.select(
        "part", "filter_order", "step",
        over("n", lambda m: flag(~fails(m) & ~gone(m))).alias("kept"), over("n", now).alias("removed"), over("n", lambda m: flag(fails(m) & gone(m))).alias("redundant"),
        over("n", lambda m: flag(m == F.col("own"))).alias("unique_fails"), over("good", now).alias("good_lost"), over("toxic", now).alias("toxic_lost"), over("n", share).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """All orders of the five filters over whole documents, a row for each part, order and step; no documents, no rows."""
    return orders(histogram(masked(docs, labels, part)))


ORACLE_SQL = r"""
WITH base AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
marks AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
firsts AS (SELECT t, min(doc_id) AS first_id FROM base GROUP BY t),
fails AS (
  SELECT b.part, coalesce(m.good, false) AS good, coalesce(m.toxic, false) AS toxic,
         len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
         100 * (length(b.t) - length(regexp_replace(b.t, '[A-Z]', '', 'g'))) > 3 * length(b.t) AS c,
         regexp_matches(b.t, '[#$%&*|]') AS d, coalesce(b.doc_id > f.first_id, false) AS e
  FROM base b JOIN firsts f ON b.t = f.t LEFT JOIN marks m ON b.doc_id = m.doc_id),
masks AS (
  SELECT part, good, toxic, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END) AS failed FROM fails),
cells AS (SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM masks GROUP BY part, failed),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
plans AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM letters p, letters q, letters r, letters s, letters t
          WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
steps AS (SELECT filter_order, k AS step, substr(filter_order, k, 1) AS own, string_split(substr(filter_order, 1, k - 1), '') AS before FROM plans, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
each_ AS (SELECT c.*, s.*, list_contains(failed, own) AS fails, list_has_any(failed, before) AS gone FROM cells c, steps s)
SELECT part, filter_order, step::INT AS step,
       coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
       coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails AND len(failed) = 1), 0)::BIGINT AS unique_fails,
       coalesce(sum(good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost,
       sum(coalesce(CASE WHEN fails THEN n * (120 // len(failed)) END, 0))::BIGINT AS shapley
FROM each_ GROUP BY part, filter_order, step
"""
