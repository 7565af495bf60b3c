"""Line dedup by site-relative frequency.

A line is boilerplate of a host when the pages of the host that contain it,
divided by all pages of the host, exceed a ratio. It must be on two pages at
least: what is on one page alone is no boilerplate, and without that a host of
fewer than ten pages would lose every line. Lines are counted by two
independent 64-bit hashes, so only hashes are shuffled, and counts are summed
before the shuffle. What is known as boilerplate has at most
lines-per-page / ratio entries for each host.

Documents take their source as the host. A source holds many authors, so a line
that a licence or a template puts into a few of a hundred documents is
boilerplate there already; near duplicates within a source count as one, so that
a group of edited copies does not turn its own text into boilerplate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import park
from .simhash import keep_first

BROADCAST_ROWS = 20_000
MAX_RATIO, MIN_PAGES = 0.1, 2
SOURCE_RATIO, SOURCE_PAGES = 0.005, 4  # what three documents of a small source share can't be told from chance


def _hashes(line: Column) -> Column:
    """128 bits: two XXH64 of the trimmed line, the second salted."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def boilerplate(pages: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """pages: host, lines. host, bad (array of line hashes) for each host with boilerplate."""
    lines = F.array_remove(F.array_distinct(F.transform("lines", lambda x: F.trim(x))), "")
    keyed = pages.select("host", F.transform(lines, _hashes).alias("h"))
    totals = keyed.groupBy("host").agg(F.count(F.lit(1)).alias("total")).withColumnRenamed("host", "t")
    counts = keyed.select("host", F.explode("h").alias("h")).groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    bad = counts.join(totals, F.col("host").eqNullSafe(F.col("t"))).where(F.col("n") / F.col("total") > max_ratio)
    return bad.groupBy("host").agg(F.collect_list("h").alias("bad"))


def drop_boilerplate(pages: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, counted: DataFrame | None = None) -> DataFrame:
    """pages: host, lines and more columns; adds kept (lines that stay, in order) and n_dropped.

    Lines are counted in ``counted`` (host, lines), or else in the pages themselves.

    A null host is a host of its own. Null lines give null kept and 0 dropped;
    empty lines always stay. A line on fewer than min_pages pages stays. Columns
    of any other name are carried along.
    """
    found = park(boilerplate((pages if counted is None else counted).select("host", "lines"), max_ratio, min_pages), "line-bad").withColumnRenamed("host", "bad_host")
    small = found.agg(F.coalesce(F.sum(F.size("bad")), F.lit(0)) + F.count(F.lit(1))).first()[0] <= BROADCAST_ROWS
    packed = pages.select(F.struct(*pages.columns).alias("page"))
    joined = packed.join(F.broadcast(found) if small else found, F.col("page.host").eqNullSafe(F.col("bad_host")), "left")
    lines = F.col("page.lines")
    kept = F.when(F.col("bad").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(F.col("bad"), _hashes(F.trim(x)))))
    out = joined.select("page", kept.alias("kept"))
    carried = [F.col("page")[c].alias(c) for c in pages.columns if c not in ("kept", "n_dropped")]
    return out.select(*carried, "kept", F.coalesce(F.size(lines) - F.size("kept"), F.lit(0)).alias("n_dropped"))


def dedup_document_lines(docs: DataFrame, max_ratio: float = SOURCE_RATIO, min_pages: int = SOURCE_PAGES) -> DataFrame:
    """docs with the columns of documents, source taken as the host; text and n_chars are those of the lines that stay."""
    host, lines = F.col("source").alias("host"), F.split("text", "\n").alias("lines")
    packed = docs.select(host, lines, F.struct(*docs.columns).alias("doc"))
    single = keep_first(docs.select("doc_id", "text", "source"), within="source")
    kept = drop_boilerplate(packed, max_ratio, min_pages, counted=single.select(host, lines))
    text = F.array_join("kept", "\n")
    new = {"text": text, "n_chars": F.when(F.col("n_dropped") > 0, F.length(text).cast("long")).otherwise(F.col("doc.n_chars"))}
    return kept.select(*(new[c].alias(c) if c in new else F.col("doc")[c].alias(c) for c in docs.columns))


def page_lines(html: Column) -> Column:
    """The text between tags, one line for each piece; null html gives null, empty html one empty line."""
    return F.split(F.regexp_replace(html, "<[^>]*>", "\n"), "\n")


def page_host(url: Column) -> Column:
    """Lower-case host of a URL; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1)), F.lit(""))


ORACLE_SQL = r"""
WITH pages_ AS (
  SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)), '') AS host,
         string_split(regexp_replace(html, '<[^>]*>', chr(10), 'g'), chr(10)) AS lines
  FROM pages),
each_ AS (SELECT DISTINCT page_id, host, trim(x, ' ') AS line FROM (SELECT page_id, host, unnest(lines) AS x FROM pages_) WHERE trim(x, ' ') <> ''),
totals AS (SELECT host, count(*) AS total FROM pages_ GROUP BY host),
bad AS (SELECT e.host, e.line FROM each_ e JOIN totals t ON e.host IS NOT DISTINCT FROM t.host
        GROUP BY e.host, e.line, t.total HAVING count(*) >= 2 AND count(*) / t.total > 0.1),
flags AS (SELECT p.page_id, p.host, p.i, p.x, b.line IS NOT NULL AS dropped
          FROM (SELECT page_id, host, unnest(lines) AS x, unnest(range(len(lines))) AS i FROM pages_
                UNION ALL SELECT page_id, host, NULL, NULL FROM pages_ WHERE lines IS NULL) p
          LEFT JOIN bad b ON p.host IS NOT DISTINCT FROM b.host AND trim(p.x, ' ') = b.line)
SELECT page_id, host, count(i)::BIGINT AS n_lines, count(*) FILTER (dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM flags GROUP BY page_id, host
"""
