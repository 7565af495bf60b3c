"""Suffix-array dedup, the filter audit and fill-in-middle against brute force, and on awkward tables."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from tests.llm.test_operators import AWKWARD, SCHEMA, awkward
from tracewell.llm import audit, fim, queries, suffix

SF = "/root/testdata/sf0.001"


def sha(b):
    return hashlib.sha256(b).hexdigest()


# --- suffix arrays ---


@pytest.mark.parametrize("letters,seed", [(1, 0), (2, 1), (3, 2), (26, 3), (256, 4)])
def test_two_stage_suffix_array(letters, seed):
    rng = random.Random(seed)
    for n in [1, 2, 3, 17, 200, 1500]:
        d = bytes(rng.randrange(letters) for _ in range(n))
        d += d[: n // 2] + bytes(n % 7)
        got = suffix.two_stage_suffix_array(np.frombuffer(d, dtype=np.uint8), len(d))
        assert got.tolist() == sorted(range(len(d)), key=lambda i: d[i:])
    assert len(suffix.two_stage_suffix_array(np.zeros(0, dtype=np.uint8), 4)) == 0


@pytest.mark.parametrize("letters", [1, 2, 26])
def test_wanted_suffixes(letters):
    rng = random.Random(letters)
    for n in [1, 5, 300]:
        d = bytes(rng.randrange(letters) for _ in range(n))
        wanted = np.array([rng.random() < 0.2 for _ in range(n)])
        got = suffix.two_stage_suffix_array(np.frombuffer(d, dtype=np.uint8), n, wanted).tolist()
        assert got == [i for i in sorted(range(n), key=lambda i: d[i:]) if i in set(got)] and set(np.flatnonzero(wanted)) <= set(got)
        assert letters < 3 or n < 300 or len(got) < 0.7 * n


def test_adjacent_prefixes():
    rng = random.Random(5)
    d = bytes(rng.randrange(2) for _ in range(3000))
    d = np.frombuffer(d + d[500:900] + d[:1000], dtype=np.uint8)
    s = suffix.two_stage_suffix_array(d, 300)
    s = s[s + 300 <= len(d)]
    b = d.tobytes()
    want = [next((k for k in range(300) if b[p + k] != b[q + k]), 300) for p, q in zip(s[:-1].tolist(), s[1:].tolist())]
    assert suffix.adjacent_prefixes(d, s, 300).tolist() == want and 300 in want


def brute_suffix(docs, window=suffix.WINDOW):
    data = [(d[0], (d[1] or "").encode()) for d in docs]
    seen = Counter(t[s : s + window] for _, t in data for s in range(len(t) - window + 1))
    out = Counter()
    for i, t in data:
        gone = np.zeros(len(t), dtype=bool)
        for s in range(len(t) - window + 1):
            if seen[t[s : s + window]] > 1:
                gone[s : s + window] = True
        kept = bytes(np.frombuffer(t, dtype=np.uint8)[~gone])
        spans = len(re.findall(b"\x01+", gone.tobytes()))
        out[(i, len(t), int(gone.sum()), spans, sha(kept))] += 1
    return out


def suffix_rows(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def letters(rng, n, alphabet="abcdefgh né🙂"):
    return "".join(rng.choice(alphabet) for _ in range(n))


def repeating_docs(seed, n=60):
    """Passages at several places, inside one text too, edges that match in part, periods, copies and near copies."""
    rng = random.Random(seed)
    passage, other = letters(rng, 700), letters(rng, 380)
    docs = []
    for k in range(n):
        t = letters(rng, rng.choice([0, 50, 399, 400, 900]))
        if k % 3 == 0:
            a = rng.randrange(300)
            t = t[:200] + passage[a : a + rng.choice([350, 400, 690])] + t[200:]
        if k % 5 == 0:
            t += other + letters(rng, 5)
        if k % 7 == 0:
            t += letters(rng, rng.choice([1, 3, 90])) * 12
        if k % 11 == 0:
            t += passage + "-" + passage
        if k % 6 == 5:
            t = docs[-2][1]
        if k % 10 == 9:
            t = docs[-1][1][:300] + "#" + docs[-1][1][301:]
        docs.append((k, t, "en", "a", len(t)))
    return docs


@pytest.mark.parametrize("seed,group,part", [(0, 512, 1 << 20), (1, 512, 3000), (2, 1, 1 << 20), (3, 3, 3000)])
def test_suffix_dedup(spark, seed, group, part, monkeypatch):
    """With small groups all keys of several contexts are counted by hashes; with small parts every few keys are sorted apart."""
    monkeypatch.setattr(suffix, "GROUP", group)
    monkeypatch.setattr(suffix, "PART", part)
    docs = repeating_docs(seed)
    assert suffix_rows(suffix.suffix_dedup(spark.createDataFrame(docs, SCHEMA))) == brute_suffix(docs)


def test_suffix_pieces(spark, monkeypatch):
    """Long texts are looked at in pieces, which cut contexts; the result is the same."""
    monkeypatch.setattr(suffix, "PIECE", 777)
    found = []
    for docs in (repeating_docs(4), [(0, letters(random.Random(1), 900) * 3, "en", "a", 2700)]):
        rows = [(i, i, r) for i, (_, r, *_) in enumerate(docs)]
        import pyarrow as pa

        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["r1", "r2", "text"])
        records = [r for b in suffix._cut_records(iter([batch])) for r in b.to_pylist()]
        for r in records:
            text = docs[r["r1"]][1].encode()
            for s, z in zip(r["starts"], r["sizes"]):
                found += [(r["r1"], k, text[k : k + 400], r["key"]) for k in range(s, s + z)]
        want = Counter((i, k, d[1].encode()[k : k + 400]) for i, d in enumerate(docs) for k in range(len(d[1].encode()) - 399))
        assert Counter(x[:3] for x in found) == want  # every window lies in one record
        keys = {}
        assert all(keys.setdefault(x[2], x[3]) == x[3] for x in found)  # equal windows have one key
        found = []


def test_suffix_awkward(spark):
    table = AWKWARD + [(20, "ab" * 5000, "en", "a", 1), (20, "cd" * 300, "en", "a", 1), (None, "ab" * 300, None, None, 1), (None, None, None, None, 1)]
    docs = awkward(spark).limit(0).unionByName(spark.createDataFrame(table, SCHEMA), allowMissingColumns=True)
    got = suffix.suffix_dedup(docs)
    assert suffix_rows(got) == brute_suffix(table)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got.collect())
    assert suffix_rows(suffix.suffix_dedup(awkward(spark))) == brute_suffix(AWKWARD)
    assert suffix.suffix_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_suffix_registered(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = suffix_rows(queries.op11_suffix_dedup(spark, SF))
    assert got == brute_suffix(docs) and sum(r[2] > 0 for r in got) > 10


# --- filter audit ---

LETTERS = "ABCDE"


def brute_audit(docs, labels):
    """docs: (doc_id, text, part). Rows as the query gives, by running each order over each document."""
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    fails = []
    for i, t, p in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        fails.append((p or "", {x for x in LETTERS if f[x]}, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {f[0] for f in fails}:
        for order in map("".join, itertools.permutations(LETTERS)):
            for step, x in enumerate(order):
                c, before = Counter(), set(order[:step])
                for p, failed, g, bad in fails:
                    if p == part:
                        now = x in failed and not failed & before
                        c["removed"] += now
                        c["kept"] += not failed & (before | {x})
                        c["redundant"] += x in failed and bool(failed & before)
                        c["unique"] += failed == {x}
                        c["good"] += now and g
                        c["toxic"] += now and bad
                out[part, order, step + 1] = [c[k] for k in ("kept", "removed", "redundant", "unique", "good", "toxic")]
                shapley[part, x] += c["removed"]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit_rows(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def audit_docs():
    rng = random.Random(7)
    docs = [
        (None, "no id", "en"), (1, None, None), (2, "", "en"), (2, "", "en"), (3, "", ""), (4, "TWO words", "fr"), (4, "other text # of one id", "fr"), (None, "TWO words", "en"),
        (5, "x" * 70_000, "en"), (6, "w " * 30_000, "en"), (7, "É À \x85 " * 300, None), (8, " \t\n", "fr"), (9, "no id", "fr"),
    ]
    for k in range(40):
        n = rng.choice([5, 199, 200, 201, 400])
        t = " ".join(f"{rng.choice(['w', 'W', 'v'])}{rng.randrange(rng.choice([20, 100, 900]))}" for _ in range(n)) + rng.choice(["", "&", " |"])
        docs.append((100 + k, t if k % 4 or k < 8 else docs[-3][1], rng.choice(["en", "fr", None])))
    docs += [(500, "hot text " * 40, "en")] * 3 + [(501 + k, "hot text " * 40, "en" if k % 2 else None) for k in range(20)]
    labels = [(d[0], int(k % 3 > 0), int(k % 4 == 0)) for k, d in enumerate(docs)] + [(4, None, 1), (4, 1, None), (7, None, None), (9999, 1, 1)]
    return docs, labels


def test_filter_audit(spark):
    docs, labels = audit_docs()
    d = spark.createDataFrame([(*x, "c", 1) for x in docs], "doc_id long, text string, lang string, mask string, n int")
    t = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.filter_audit(d, t)
    want = brute_audit(docs, labels)
    assert audit_rows(got) == want and got.count() == len(want) == 3 * 600
    failing = audit.masked(d, t).groupBy("mask").sum("n").count()
    assert failing > 8
    assert audit.filter_audit(d.limit(0), t).count() == 0
    assert audit_rows(audit.filter_audit(d, t.limit(0))) == brute_audit(docs, [])


def test_audit_is_native(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    plan = audit.filter_audit(docs, labels)._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


# --- fill in middle ---


def brute_fim(i, t, seed=1):
    t = t or ""
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(t)
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, t
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = t[:a], t[a:b], t[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


FIM_TEXTS = [None, "", "a", "é", "🙂", "<P>", "a<S>b", "<M", "x<S", "<P<S<M", "né à l’été 🙂" * 50, "🙂" * 3000, "a" * 100_000 + "é" * 5, "\x00\n \x0b", "é" * 7]


@pytest.mark.parametrize("chunk", [1, 3, 64, 4096])
def test_fill_in_middle(spark, chunk):
    docs = [(i * 7 - 3, t) for i, t in enumerate(FIM_TEXTS * (2 if chunk > 3 else 1)) if chunk > 3 or len(t or "") < 5000] + [(None, "no id"), (None, None), (4, "same"), (4, "same")]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, output string, n int")
    got = fim.restore(fim.fill_in_middle(df, chunk=chunk)).collect()
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == Counter((d[0], *brute_fim(*d)) for d in docs)
    assert Counter((r.doc_id, r.restored) for r in got) == Counter((d[0], d[1] or "") for d in docs)
    assert fim.restore(fim.fill_in_middle(df.limit(0))).count() == 0


def test_units_by_any_adjacent_predicate():
    """Units may begin wherever two adjacent bytes say so: here words, that is where a letter follows a space."""
    rows = [b"two words", b"", b" lead", b"a  b c", b"x" * 50]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    begins = lambda before, here: (before == 32) & (here != 32)
    for chunk in (1, 2, 5, 1000):
        units = fim.Units(np.frombuffer(b"".join(rows), dtype=np.uint8), offsets, begins, chunk)
        assert units.sizes.tolist() == [2, 0, 2, 3, 1]
        assert units.locate(np.array([0, 0, 0, 3, 3, 1]), np.array([0, 1, 2, 2, 3, 0])).tolist() == [0, 4, 9, 5, 6, 0]


def test_fim_registered(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.op13_fim(spark, SF).toPandas().astype(object)
    got = got.where(pd.notna(got), None)
    want = []
    for i, t in docs:
        *rest, output = brute_fim(i, t)
        want.append((i, *rest, sha(output.encode()), sha((t or "").encode())))
    assert Counter(got.itertuples(index=False, name=None)) == Counter(want)
    assert len({w[2] for w in want}) == 3
