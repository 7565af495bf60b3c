"""Unbounded reachability against a plain search, and its number of rounds."""

import random

import pytest

from tracewell.operators import closure as module
from tracewell.operators.traverse import BACKWARD, FORWARD, levels, snapshot


def graph_of(spark, pairs, known=None):
    edges = spark.createDataFrame([(a, b, "ETL", "SELECT", 0) for a, b in pairs], "source_id string, target_id string, dependency_type string, reference_type string, seq long")
    ids = sorted({x for p in pairs for x in p}) if known is None else known
    return snapshot(spark.createDataFrame([(i,) for i in ids], "id string"), edges)


def seeds_of(spark, *ids):
    return spark.createDataFrame([(i, i) for i in ids], "seed string, id string")


def brute(pairs, seeds, known, direction):
    step = {}
    for a, b in pairs:
        a, b = (a, b) if direction == FORWARD else (b, a)
        if a in known:
            step.setdefault(a, set()).add(b)
    out = set()
    for s in seeds:
        seen, todo = {s}, [s]
        while todo:
            for b in step.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        out |= {(s, x) for x in seen}
    return out


def found(rows):
    got = [(r.seed, r.id) for r in rows.select("seed", "id").collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.fixture
def rounds(monkeypatch):
    names, park = [], module.park
    monkeypatch.setattr(module, "park", lambda df, name: (names.append(name), park(df, name))[1])
    return names


def test_a_long_chain_takes_few_rounds(spark, rounds):
    pairs = [(f"n{k:05d}", f"n{k + 1:05d}") for k in range(10_000)]
    g = graph_of(spark, pairs)
    assert found(module.closure(g, seeds_of(spark, "n00000"))) == {("n00000", f"n{k:05d}") for k in range(10_001)}
    assert len(rounds) <= 20
    assert found(module.closure(g, seeds_of(spark, "n09990", "n03000"), BACKWARD)) == {(s, f"n{k:05d}") for s in ("n09990", "n03000") for k in range(int(s[1:]) + 1)}


def test_a_long_ring_and_a_tail(spark, rounds):
    """The ring is entered from outside, so one of its nodes has two predecessors until the rest is merged into it."""
    pairs = [(f"r{k:04d}", f"r{(k + 1) % 3000:04d}") for k in range(3000)] + [("in", "r0007"), ("r0100", "out"), ("out", "end")] + [(f"q{k}", f"q{(k + 1) % 40}") for k in range(40)] + [("q3", "behind")]
    g = graph_of(spark, pairs)
    assert found(module.closure(g, seeds_of(spark, "in"))) == {("in", x) for x in ["in", "out", "end", *(f"r{k:04d}" for k in range(3000))]}
    assert len(rounds) <= 24
    assert found(module.closure(g, seeds_of(spark, "q5"))) == {("q5", x) for x in ["behind", *(f"q{k}" for k in range(40))]}


@pytest.mark.parametrize("seed", [1, 3])
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = 60
    pairs = {(f"x{rng.randrange(n)}", f"x{rng.randrange(n)}") for _ in range([40, 70, 110, 160][seed])} | {(f"x{k}", f"x{k + 1}") for k in range(20, 40)}
    known = [f"x{k}" for k in range(n) if k % 9]
    g = graph_of(spark, sorted(pairs), known)
    seeds = ["x1", "x9", "x21", "x33", "nowhere"]
    for direction in (FORWARD, BACKWARD):
        got = found(module.closure(g, seeds_of(spark, *seeds), direction))
        assert got == brute(pairs, seeds, set(known), direction)
        assert got == found(levels(g, seeds_of(spark, *seeds), None, direction))


def test_no_edges_and_no_seeds(spark):
    g = graph_of(spark, [("a", "a")])
    assert found(module.closure(g, seeds_of(spark, "a"))) == {("a", "a")}
    assert found(module.closure(g, seeds_of(spark, "a").limit(0))) == set()


def test_a_shallow_graph_is_only_walked(spark, monkeypatch):
    """Five levels or fewer need no merging of all nodes (F21)."""
    monkeypatch.setattr(module, "_merged", lambda *a: pytest.fail("merged"))
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "a"), ("d", "gone"), ("gone", "x"), ("q", "a")]
    known = [*"abcdexq"]
    assert found(module.closure(graph_of(spark, pairs, known), seeds_of(spark, "a", "none"))) == brute(pairs, ["a", "none"], set(known), FORWARD)
