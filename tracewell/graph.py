"""LineageGraph: the questions one asks of a graph, with the bounds of the service."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators import catalog, traverse
from tracewell.operators.closure import closure
from tracewell.operators.directory import Directory
from tracewell.operators.traverse import BACKWARD, FORWARD, Lineage


def _bounded(name: str, value: int, low: int, high: int) -> int:
    if not low <= value <= high:
        raise ValueError(f"{name} is between {low} and {high}, not {value}")
    return value


@dataclass(frozen=True)
class LineageGraph:
    """An immutable snapshot; reload by reading the tables again.

    The first walk reduces and stores the edges; later ones read only what they meet. With a directory of the objects
    (``Directory.build``) pages, searches and single objects read only the files they need.
    """

    objects_: DataFrame
    table_deps: DataFrame
    column_deps: DataFrame
    directory: Directory | None = None

    @cached_property
    def walked(self) -> traverse.Snapshot:
        return traverse.snapshot(self.objects_, self.table_deps)

    @cached_property
    def walked_columns(self) -> traverse.ColumnSnapshot:
        return traverse.column_snapshot(self.column_deps)

    @cached_property
    def _totals(self) -> dict:
        return {}

    def object(self, id_: str) -> DataFrame:
        """The object of an id; KeyError where there is none."""
        found = self.directory.get(id_) if self.directory else self.objects_.where(F.col("id") == id_)
        if found.isEmpty():
            raise KeyError(id_)
        return found

    def objects(self, page: int = 1, page_size: int = 50, schema: str | None = None, type_: str | None = None) -> dict:
        """items (a DataFrame), total, page, page_size, total_pages."""
        _bounded("page", page, 1, 1 << 31)
        _bounded("page_size", page_size, 1, 200)
        if (schema, type_) not in self._totals:
            self._totals[schema, type_] = self.directory.total(schema, type_) if self.directory else catalog.filtered(self.objects_, schema, type_).count()
        total = self._totals[schema, type_]
        items = self.directory.page(page, page_size, schema, type_) if self.directory else catalog.page(self.objects_, page, page_size, schema, type_)
        return {"items": items, "total": total, "page": page, "page_size": page_size, "total_pages": catalog.total_pages(total, page_size)}

    def search(self, q: str, limit: int = 20, schema: str | None = None, type_: str | None = None) -> DataFrame:
        if not q:
            raise ValueError("the query is empty")
        _bounded("limit", limit, 1, 100)
        return self.directory.search(q, limit, schema, type_) if self.directory else catalog.search(self.objects_, q, limit, schema, type_)

    def schemas(self) -> DataFrame:
        return catalog.distinct_sorted(self.objects_, "schema")

    def types(self) -> DataFrame:
        return catalog.distinct_sorted(self.objects_, "type")

    def statistics(self) -> DataFrame:
        return catalog.statistics(self.objects_, self.table_deps, self.column_deps)

    def _seed(self, id_: str) -> DataFrame:
        return self.object(id_).select(F.col("id").alias("seed"), "id").limit(1)

    def forward_lineage(self, id_: str, depth: int = 1) -> Lineage:
        return traverse.traverse(self.walked, self._seed(id_), _bounded("depth", depth, 1, 5), FORWARD)

    def backward_lineage(self, id_: str, depth: int = 1) -> Lineage:
        return traverse.traverse(self.walked, self._seed(id_), _bounded("depth", depth, 1, 5), BACKWARD)

    def full_lineage(self, id_: str, upstream_depth: int = 2, downstream_depth: int = 2) -> Lineage:
        up, down = _bounded("upstream_depth", upstream_depth, 0, 10), _bounded("downstream_depth", downstream_depth, 0, 10)
        return traverse.full(self.walked, self._seed(id_), up, down)

    def lineage_of(self, seeds: DataFrame, depth: int, direction: str = FORWARD) -> Lineage:
        """Many roots at once: seeds has seed and id."""
        return traverse.traverse(self.walked, seeds, depth, direction)

    def reach(self, seeds: DataFrame, direction: str = FORWARD) -> DataFrame:
        """seed, id of all that seeds (seed, id) reach, at any depth."""
        return closure(self.walked, seeds, direction)

    def object_column_lineage(self, id_: str) -> DataFrame:
        self.object(id_)
        return traverse.object_columns(self.column_deps, id_)

    def column_lineage(self, id_: str, column: str, direction: str = "both", depth: int = 3) -> DataFrame:
        """The column of that exact name, else the one that differs in case only."""
        asked = self.object(id_).select(F.col("id").alias("object_id"), F.lit(column).alias("column")).limit(1)
        at = traverse.resolve_columns(asked, self.column_dependencies(id_))
        seeds = at.select(F.col("object_id").alias("seed"), "object_id", F.coalesce("found", "column").alias("column"))
        return traverse.column_lineage(self.walked_columns, seeds, direction, _bounded("depth", depth, 1, 10))

    def column_dependencies(self, id_: str) -> DataFrame:
        return traverse.touching_columns(self.column_deps, id_)

    def columns_with_lineage(self) -> DataFrame:
        return traverse.columns_with_lineage(self.column_deps)

    def has_column_lineage(self, id_: str) -> bool:
        return not self.column_dependencies(id_).isEmpty()
