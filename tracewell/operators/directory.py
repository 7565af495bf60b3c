"""A catalog in id order on disk: pages, single objects and substring search that read only the files they need.

``build`` deals the objects by ranges of ids into parts of about
``ROWS_PER_PART`` rows and counts each part's schemas and types. A page is found
by adding up the counts, and read from the one or two parts it lies in; an
object from the part whose bounds hold its id.

Search has postings: for each gram of one, two or three characters in the
lower-cased name, schema or id of an object, a row for each part with the places
of the objects there. Postings lie in hash buckets of the gram. A query of up to
three characters is one gram and its postings are the answer; a longer one
intersects those of its ``RAREST`` rarest trigrams, part by part, and compares
the candidates with the text, from the smallest ids on until enough are found.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracewell.operators.catalog import filtered, matches
from tracewell.shipping import ship
from tracewell.storage import new_path, read_text, write_text

ROWS_PER_PART, MOST_BUCKETS = 50_000, 4096
RAREST = 3
TEXTS = ("name", "schema", "id")
_PLACE = (1 << 33) - 1  # the low bits of monotonically_increasing_id: the row's place in its partition


@dataclass(frozen=True)
class Directory:
    """Objects by parts of an id order, their counts, and the postings; immutable, and open to any session that has the path."""

    spark: SparkSession
    path: str
    buckets: int
    schema: StructType

    @classmethod
    def build(cls, objects: DataFrame, path: str | None = None, rows_per_part: int = ROWS_PER_PART) -> Directory:
        """Write the parts, the counts and the postings of objects (id, schema, name, type, and whatever else they have)."""
        spark = objects.sparkSession
        path = path or new_path(spark, "directory")
        parts = max(1, -(-objects.count() // rows_per_part))
        dealt = objects.repartitionByRange(parts, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first())
        placed = dealt.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE)).cast("int"))
        placed.sortWithinPartitions("part", "place").write.partitionBy("part").option("compression", "zstd").parquet(f"{path}/objects")
        stored = spark.read.schema(placed.schema).parquet(f"{path}/objects")
        counts = stored.groupBy("part", "schema", "type").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
        counts.repartition(1 + parts // 1000, "part").write.option("compression", "zstd").parquet(f"{path}/counts")
        ship(spark)
        text = [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in TEXTS]
        postings = stored.select("part", "place", *text).groupBy("part").applyInArrow(_postings, "gram string, part int, places array<int>, n int")
        buckets = min(MOST_BUCKETS, max(8, parts))
        dealt = postings.withColumn("bucket", _bucket("gram", buckets)).hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram", "part")
        dealt.write.partitionBy("bucket").option("compression", "zstd").parquet(f"{path}/postings")
        write_text(spark, f"{path}/directory.json", json.dumps({"buckets": buckets, "schema": placed.schema.jsonValue()}))
        return cls(spark, path, buckets, placed.schema)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Directory:
        known = json.loads(read_text(spark, f"{path}/directory.json"))
        return cls(spark, path, known["buckets"], StructType.fromJson(known["schema"]))

    @cached_property
    def objects(self) -> DataFrame:
        """All objects with part and place, which together are the order of ids."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/objects")

    @cached_property
    def _counts(self) -> DataFrame:
        return self.spark.read.schema("part int, schema string, type string, n long, first_id string, last_id string").parquet(f"{self.path}/counts")

    def _per_part(self, schema: str | None, type_: str | None) -> list[tuple[int, int]]:
        """Part and how many of the asked-for objects it holds; one row for each part that holds any."""
        rows = filtered(self._counts, schema, type_).groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
        return [(r.part, r.n) for r in rows]

    def total(self, schema: str | None = None, type_: str | None = None) -> int:
        return sum(n for _, n in self._per_part(schema, type_))

    def page(self, number: int, size: int, schema: str | None = None, type_: str | None = None) -> DataFrame:
        """The objects of a page in the order of ids, from the parts they lie in; no rows beyond the last page."""
        first, seen, parts, skip = (number - 1) * size, 0, [], 0
        for part, n in self._per_part(schema, type_):
            if seen + n > first and seen < first + size:
                skip = first - seen if not parts else skip
                parts.append(part)
            seen += n
        rows = filtered(self.objects.where(F.col("part").isin(parts)), schema, type_)
        return rows.orderBy("part", "place").offset(max(0, skip)).limit(size).drop("part", "place")

    @cached_property
    def _bounds(self) -> tuple[list[int], list[str]]:
        rows = self._counts.groupBy("part").agg(F.min("first_id").alias("low")).where(F.col("low").isNotNull()).orderBy("part").collect()
        return [r.part for r in rows], [r.low for r in rows]

    def get(self, id_: str) -> DataFrame:
        """The object of an id, from the part whose ids lie around it."""
        parts, lows = self._bounds
        # Spark orders strings by their UTF-8 bytes, Python by code points: the same order
        at = bisect_right(lows, id_) - 1
        return self.objects.where((F.col("part") == (parts[at] if at >= 0 else -1)) & (F.col("id") == id_)).drop("part", "place")

    def postings(self, grams: list[str]) -> DataFrame:
        """gram, part, places, n of some grams, from their buckets."""
        wanted = self.spark.createDataFrame([(g,) for g in grams], "gram string")
        buckets = sorted({r[0] for r in wanted.select(_bucket("gram", self.buckets)).collect()})
        return self._stored_postings.where(F.col("bucket").isin(buckets) & F.col("gram").isin(grams)).select("gram", "part", "places", "n")

    @cached_property
    def _stored_postings(self) -> DataFrame:
        """All postings; their folders are listed once."""
        return self.spark.read.schema("gram string, part int, places array<int>, n int, bucket int").parquet(f"{self.path}/postings")

    def candidates(self, query: str) -> DataFrame | None:
        """part, places of the objects that can match; None where a gram of the query occurs nowhere."""
        q = query.lower()
        grams = [q] if len(q) <= 3 else sorted({q[k : k + 3] for k in range(len(q) - 2)})
        sizes = {r.gram: r.n for r in self.postings(grams).groupBy("gram").agg(F.sum("n").alias("n")).collect()}
        if len(sizes) < len(grams):
            return None
        rare = sorted(grams, key=lambda g: (sizes[g], g))[:RAREST]
        lists = self.postings(rare).groupBy("part").agg(F.collect_list("places").alias("lists")).where(F.size("lists") == len(rare))  # at most RAREST a part
        both = F.aggregate(F.slice("lists", 2, RAREST), F.col("lists")[0], lambda a, b: F.array_intersect(a, b))
        return lists.select("part", both.alias("places")).where(F.size("places") > 0)

    def search(self, query: str, limit: int = 20, schema: str | None = None, type_: str | None = None) -> DataFrame:
        """The first matches by id, as ``catalog.search`` gives them."""
        found = self.candidates(query)
        if found is None:
            return self.objects.where(F.lit(False)).drop("part", "place")
        here = found.select("part", F.size("places").alias("n")).orderBy("part").collect()  # a row for each part
        if schema is not None or type_ is not None:
            holds = {p for p, _ in self._per_part(schema, type_)}
            here = [r for r in here if r.part in holds]

        def among(parts: list[int]) -> DataFrame:
            """The matches in some parts: candidates compared with the text."""
            rows = self.objects.where(F.col("part").isin(parts))
            picked = found.where(F.col("part").isin(parts)).select(F.col("part").alias("p"), F.explode("places").alias("at"))
            near = rows.join(picked, (F.col("part") == F.col("p")) & (F.col("place") == F.col("at")), "left_semi")
            return filtered(near, schema, type_).where(matches(query))

        used, seen, step = 0, 0, 1
        while used < len(here) and seen < limit:
            upto = used
            while upto < len(here) and (upto - used < step or sum(r.n for r in here[used:upto]) < limit):
                upto += 1
            if upto == len(here) and used == 0:
                used = upto  # all there is
                break
            seen += among([r.part for r in here[used:upto]]).limit(limit).count()
            used, step = upto, step * 4
        return among([r.part for r in here[:used]]).orderBy("part", "place").limit(limit).drop("part", "place")


def _postings(part: pa.Table) -> pa.Table:
    """gram, part, places, n of the objects of one part. A gram is a number of 21 bits a character, so one sort finds all places of all grams."""
    part = part.sort_by("place")
    found, rows = [], []
    for name in TEXTS:
        texts = part[name].to_pylist()
        row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64) + 1
        for size in (1, 2, 3):
            starts = max(0, len(chars) - size + 1)
            inside = row[:starts] == row[size - 1 :]
            gram = sum(chars[k : starts + k] << (21 * k) for k in range(size))
            found.append(gram[inside])
            rows.append(row[:starts][inside])
    grams, number = np.unique(np.concatenate(found), return_inverse=True)
    pairs = np.unique(number * len(part) + np.concatenate(rows))
    number, row = np.divmod(pairs, len(part))
    ends = np.searchsorted(number, np.arange(len(grams) + 1))
    places = pa.array(part["place"].to_numpy()[row], pa.int32())
    text = ["".join(chr(c - 1) for c in (g & 0x1FFFFF, g >> 21 & 0x1FFFFF, g >> 42) if c) for g in grams.tolist()]
    return pa.table({"gram": pa.array(text, pa.string()), "part": pa.array([part["part"][0].as_py()] * len(grams), pa.int32()), "places": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), places), "n": pa.array(np.diff(ends), pa.int32())})


def _bucket(gram: str, buckets: int):
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")
