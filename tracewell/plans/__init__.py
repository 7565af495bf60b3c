"""Registered queries with their SQL twins."""

from tracewell.plans import building, lineage

QUERIES = {**lineage.QUERIES, **building.QUERIES}
ORACLES = {**lineage.ORACLES, **building.ORACLES}
