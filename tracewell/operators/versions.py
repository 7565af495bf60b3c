"""A graph that grows by runs: immutable files, a manifest for each version, readers that stay on theirs.

Version 0 is a base run. ``append`` adds a delta run of objects and edges and
rewrites nothing; ``compact`` merges the runs of a version into a new base;
``collect_garbage`` deletes what no kept version names. All runs have the same
hash buckets, by source and by target, so a walk reads the frontier's buckets of
each run and settles there which edge of a pair holds: that of the latest run
that ``wins`` "last", or else of the earliest run; inside a run the highest seq.

A version begins to exist when its manifest is created, which only one writer
can do; who comes second tries again with the next number. What a version names
is never changed, so a reader needs no lock.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import cached_property

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.traverse import EDGE_KEYS, EDGE_REST, Snapshot, Stored, buckets_for, store_at, store_last
from tracewell.storage import delete, names, park, read_text, write_text

EDGE = "source_id string, target_id string, dependency_type string, reference_type string, bucket int"


@dataclass(frozen=True)
class StoredRuns(Stored):
    """Rows of several runs in the same buckets; ``rank`` tells which of the rows of one pair holds."""

    @property
    def _pair(self) -> list[str]:
        return ["id"] if self.key == "id" else ["source_id", "target_id"]

    def settled(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (*self._pair, "rank", "bucket")]
        if not rest:
            return rows.select(*self._pair).distinct()
        return rows.groupBy(*self._pair).agg(F.max_by(F.struct(*rest), "rank").alias("r")).select(*self._pair, "r.*")

    def beside(self, frontier: DataFrame) -> DataFrame:
        rows, near = self.met(self.rows, frontier)
        ids = near.select("id").distinct().withColumnRenamed("id", self.key)
        mine = self.settled(rows.join(ids, self.key, "left_semi"))
        if self.key == "id":
            mine = mine.withColumn("known", F.lit(True))
        return mine.withColumnRenamed(self.key, "id").join(near, "id").withColumnRenamed("id", self.key)


@dataclass(frozen=True)
class Version:
    """One version of a graph, whatever happens to the graph later."""

    spark: SparkSession
    path: str
    number: int
    buckets: int
    runs: tuple[dict, ...]  # name and wins, oldest first

    def _ranked(self) -> list[tuple[str, int]]:
        """Runs with a rank: later ones above, unless they give way to what is there."""
        return [(r["name"], k if r["wins"] == "last" else -k) for k, r in enumerate(self.runs)]

    def _run(self, name: str, folder: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/runs/{name}/{folder}")

    def _side(self, folder: str, key: str, schema: str) -> Stored:
        if len(self.runs) == 1:  # a run has one row for each pair
            rows = self._run(self.runs[0]["name"], folder, schema)
            return Stored(rows.withColumn("known", F.lit(True)) if key == "id" else rows, key, self.buckets)
        rows = None
        for name, rank in self._ranked():
            run = self._run(name, folder, schema).withColumn("rank", F.lit(rank))
            rows = run if rows is None else rows.unionByName(run)
        return StoredRuns(rows, key, self.buckets)

    @cached_property
    def snapshot(self) -> Snapshot:
        """For ``traverse`` and all that walks."""
        return Snapshot(self._side("ids", "id", "id string, bucket int"), self._side("by_source", "source_id", EDGE), self._side("by_target", "target_id", EDGE))

    @property
    def edges(self) -> DataFrame:
        """The edge that holds for each pair. The first run, which is the large one, meets what later runs leave without being sorted."""
        if len(self.runs) == 1:
            return self.snapshot.by_source.rows.select(*EDGE_KEYS, *EDGE_REST)
        runs = self.snapshot.by_source
        later = runs.settled(runs.rows.where("rank != 0").withColumn("later", F.col("rank"))).select(*(F.col(c).alias(f"l_{c}") for c in [*EDGE_KEYS, *EDGE_REST]), "later")
        first = self._run(self.runs[0]["name"], "by_source", EDGE).withColumn("first", F.lit(True))
        same = [F.col(c).eqNullSafe(F.col(f"l_{c}")) for c in EDGE_KEYS]
        both = first.join(later.hint("shuffle_hash"), same[0] & same[1], "full_outer")
        stays = F.col("later").isNull() | (F.col("first").isNotNull() & (F.col("later") < 0))
        return both.select(*(F.when(stays, F.col(c)).otherwise(F.col(f"l_{c}")).alias(c) for c in [*EDGE_KEYS, *EDGE_REST]))

    @property
    def ids(self) -> DataFrame:
        side = self.snapshot.ids
        return (side.settled(side.rows) if isinstance(side, StoredRuns) else side.rows).select("id")


class GraphStore:
    """The versions of a graph under a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def create(cls, spark: SparkSession, path: str, objects: DataFrame, table_deps: DataFrame, buckets: int | None = None) -> GraphStore:
        """Write version 0; where another writer was first, its version holds."""
        store = cls(spark, path)
        deps = park(table_deps.select(*EDGE_KEYS, *EDGE_REST, "seq"), "edges")
        rows = deps.count()
        buckets = buckets or buckets_for(rows)
        name = store._write(objects, deps, buckets, rows)
        if not store._commit(0, buckets, [{"name": name, "wins": "last"}]):
            delete(spark, f"{path}/runs/{name}")
        return store

    def exists(self) -> bool:
        return bool(self.versions())

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in names(self.spark, f"{self.path}/versions") if n.endswith(".json")]

    def at(self, number: int) -> Version:
        known = json.loads(read_text(self.spark, f"{self.path}/versions/{number:012d}.json"))
        return Version(self.spark, self.path, number, known["buckets"], tuple(known["runs"]))

    def latest(self) -> Version:
        return self.at(self.versions()[-1])

    def append(self, objects: DataFrame, table_deps: DataFrame, wins: str = "last") -> Version:
        """A new version with more objects and edges; wins is last (they replace edges of the same pair) or first (they give way)."""
        if wins not in ("last", "first"):
            raise ValueError("wins is last or first")
        name = self._write(objects, table_deps, self.latest().buckets)
        while True:
            before = self.latest()
            if self._commit(before.number + 1, before.buckets, [*before.runs, {"name": name, "wins": wins}]):
                return self.at(before.number + 1)

    def compact(self) -> Version:
        """A new version of one run with the same rows; runs appended meanwhile follow it."""
        merged = self.latest()
        name = self._write(merged.ids, merged.edges, merged.buckets)
        while True:
            before = self.latest()
            if before.runs[: len(merged.runs)] != merged.runs:  # another writer has compacted these
                delete(self.spark, f"{self.path}/runs/{name}")
                return before
            if self._commit(before.number + 1, before.buckets, [{"name": name, "wins": "last"}, *before.runs[len(merged.runs) :]]):
                return self.at(before.number + 1)

    def collect_garbage(self, keep: int = 2) -> None:
        """Forget all but the latest versions and delete the runs that only forgotten ones name. Not while others append, whose runs no version names yet."""
        numbers = self.versions()
        for number in numbers[:-keep]:
            delete(self.spark, f"{self.path}/versions/{number:012d}.json")
        named = {r["name"] for number in numbers[-keep:] for r in self.at(number).runs}
        for name in names(self.spark, f"{self.path}/runs"):
            if name not in named:
                delete(self.spark, f"{self.path}/runs/{name}")

    def _write(self, objects: DataFrame, deps: DataFrame, buckets: int, rows: int = 0) -> str:
        """A run of objects and edges. Edges with seq are reduced, those without are one a pair already."""
        name = uuid.uuid4().hex
        at = f"{self.path}/runs/{name}"
        store_at(objects.select("id").distinct(), "id", buckets, f"{at}/ids")
        if "seq" in deps.columns:
            by_source = store_last(deps, EDGE_KEYS, EDGE_REST, buckets, f"{at}/by_source", rows)
        else:
            by_source = store_at(deps.select(*EDGE_KEYS, *EDGE_REST), "source_id", buckets, f"{at}/by_source")
        store_at(by_source.rows.drop("bucket"), "target_id", buckets, f"{at}/by_target")
        return name

    def _commit(self, number: int, buckets: int, runs: list[dict]) -> bool:
        """Create a version's manifest; False where it exists."""
        try:
            write_text(self.spark, f"{self.path}/versions/{number:012d}.json", json.dumps({"buckets": buckets, "runs": runs}), overwrite=False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        return True
