"""The training-data operators against brute force, exact round trips and held-out accuracy, and on awkward tables."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from tracewell.llm import bpe, graph, hnsw, langid, line_dedup, mixing, quality, queries, simhash, substring, toxicity, webp
from tracewell.llm.common import in_fold

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = [f"w{k}" for k in range(40)]


def sentence(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def sample_docs(seed=0, n=60):
    rng = random.Random(seed)
    passage, docs = sentence(rng, 45), []
    for k in range(n):
        t = sentence(rng, rng.choice([1, 3, 19, 20, 21, 60, 150]))
        if k % 4 == 0:
            t = f"{sentence(rng, 7)}\t{passage}\n{sentence(rng, 5)}"
        if k % 7 == 3 and docs:
            t = docs[rng.randrange(len(docs))][1]
        if k % 11 == 5 and docs:
            t = docs[-1][1] + " Tail"
        docs.append((k, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", None, "Z"]), len(t)))
    return docs


AWKWARD = [
    (0, None, None, None, None), (1, "", "en", "a", 0), (2, " \t\n\x0b", "en", "a", 4), (3, "One two three.", "en", "a", 14), (3, "One two three.", "en", "a", 14),
    (4, "1234 !!", None, "b", 7), (None, "no id here", "fr", None, 10), (5, "né à l’été \U0001f642", "fr", "b", 12), (6, "long " * 30_000, "en", "b", 150_000), (7, "x" * 200_000, "en", "a", 200_000),
    (8, "same words " * 15, "en", "a", 165), (9, "same words " * 15, "en", "a", 165),
]
CLASHING = ["score", "key", "cell", "host", "lines", "bad", "kept", "copies", "fp", "ids", "doc", "size", "mix_source", "packed", "at"]


def awkward(spark):
    df = spark.createDataFrame(AWKWARD, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASHING})


def labels_of(spark, docs):
    rows = [(d[0], int(k % 3 > 0), int(k % 4 == 0)) for k, d in enumerate(docs) if d[0] is not None]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def brute_substrings(docs, window=20):
    seen, out = set(), {}
    for i, t in sorted((d[0], d[1]) for d in docs):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if k in seen:
                gone[s : s + window] = [True] * window
            seen.add(k)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("batches,fanout", [(1, 4), (2, 4), (5, 1)])
def test_substring_dedup(spark, batches, fanout):
    docs = sample_docs(batches)
    got = substring.substring_dedup(spark.createDataFrame(docs, SCHEMA), batches, fanout).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_substrings(docs) and len(got) == len(docs)


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(points, distance=4):
    parent = list(range(len(points)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(points)):
        for b in range(a):
            if (points[a] ^ points[b]).bit_count() <= distance:
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return [find(k) for k in range(len(points))]


def test_simhash_documents(spark):
    docs = sample_docs(3) + [(100, None, None, None, 0), (101, "", None, None, 0)]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(docs, SCHEMA)).collect()}
    points = [brute_fingerprint(d[1]) for d in docs]
    assert [got[d[0]].fp & (1 << 64) - 1 for d in docs] == points
    assert [got[d[0]].component_id for d in docs] == [docs[k][0] for k in brute_components(points)]


@pytest.mark.parametrize("cell", [simhash.CELL, 12])
def test_simhash_links_of_dense_clusters(spark, cell):
    rng = random.Random(1)
    points = set()
    for _ in range(8):
        c = rng.getrandbits(64)
        for _ in range(60):
            c ^= 1 << rng.randrange(64) | 1 << rng.randrange(64) | 1 << rng.randrange(64)
            points.add(c)
    points = sorted(points)
    rows = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, k) for k, p in enumerate(points)], "fp long, rep long")
    labels = {r.node: r.label for r in graph.components(simhash.similar_links(rows, cell=cell)).collect()}
    assert [labels.get(k, k) for k in range(len(points))] == brute_components(points)


def brute_sets(texts, words=5):
    split = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split() for t in texts]
    return [{" ".join(w[i : i + words]) for i in range(len(w) - words + 1)} or ({" ".join(w)} if w else set()) for w in split]


def brute_first(docs, similarity=0.8):
    """Smallest doc_id of each group over all pairs."""
    sets = brute_sets([d[1] for d in docs])
    parent = list(range(len(docs)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {docs[find(k)][0] for k in range(len(docs))}


def edited_copies(seed=0, n=60):
    """Texts of ever new words, and copies with one to six of their words replaced."""
    rng = random.Random(seed)
    docs = [[f"x{rng.randrange(5000)}" for _ in range(rng.choice([40, 90, 200]))] for _ in range(n)]
    for k in range(2 * n):
        words = list(docs[rng.randrange(n if k < n else len(docs))])
        for _ in range(rng.randrange(1, 7)):
            words[rng.randrange(len(words))] = f"y{rng.randrange(5000)}"
        docs.append(words)
    return [(k, " ".join(w), "en", "s", 0) for k, w in enumerate(docs)]


@pytest.mark.parametrize("block", [simhash.BLOCK, 3])
def test_edited_copies_go(spark, block, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", block)
    docs = edited_copies()
    kept = {r.doc_id for r in simhash.keep_first(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert kept == brute_first(docs) and len(kept) <= len(docs) - 30


def test_unary_embedding_bounds_the_distance():
    rng = np.random.default_rng(0)
    a, b = (rng.integers(0, 1 << 63, 2000, dtype=np.uint64) for _ in range(2))
    counts = lambda x: np.stack([x >> np.uint64(2 * k) & np.uint64(1) for k in range(32)]).astype(int) + np.stack([x >> np.uint64(2 * k + 1) & np.uint64(1) for k in range(32)]).astype(int)
    manhattan = np.abs(counts(a) - counts(b)).sum(axis=0)
    assert (np.bitwise_count(simhash._unary(a) ^ simhash._unary(b)) == manhattan).all() and (manhattan <= np.bitwise_count(a ^ b)).all()


def test_components_of_long_chains(spark):
    edges = [(k, k + 1) for k in range(70)] + [(200, 201), (201, 200), (5, 5)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 71)} | {201: 200}


def test_mixing_matches_sql_and_hits_targets(spark):
    got = queries.op3_mixing(spark, SF).toPandas()
    per = got.merge(pd.read_parquet(f"{SF}/documents.parquet", columns=["doc_id", "source"]), on="doc_id").groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"), most=("size", "max"))
    assert ((per.taken - per.target).abs() <= per.most).all() and (per.target <= 2 * per["size"]).all()
    assert math.isclose(per.target.sum(), 1.5 * per["size"].sum(), rel_tol=1e-6)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLES[name]).df()
    rows = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).values.tolist()), key=str)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("ids", ["null", "two"])
def test_mixing_without_ids(spark, ids):
    """Rows without an id, or of two ids, are still cut near the target."""
    rng = random.Random(1)
    rows = [(None if ids == "null" else k % 2, f"t{k} " + sentence(rng, rng.randint(1, 9)), "big" if k < 600 else "small") for k in range(900)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    for _, g in got.groupby("source_size"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 10 and (g.taken <= 2 * g["size"]).all()


def test_mixing_of_nulls_and_ties(spark):
    rows = spark.createDataFrame([(k, "a b c", None if k % 5 == 0 else "ab"[k % 2]) for k in range(200)], "doc_id long, text string, source string")
    got = mixing.mix(rows).toPandas()
    assert len(got) == 200 and (got.taken <= 2 * got["size"]).all()
    assert mixing.mixed_documents(rows).count() == got.copies.sum()


def test_line_dedup(spark):
    pages = [(k, "h" if k < 20 else None, ["Menu ", f"line {k}", "", "rare" if k < 2 else f"own {k}"]) for k in range(24)] + [(50, "h", None)]
    got = {r.id: r for r in line_dedup.drop_boilerplate(spark.createDataFrame(pages, "id long, host string, lines array<string>")).collect()}
    assert got[0].kept == ["line 0", "", "rare"] and got[0].n_dropped == 1
    assert got[21].kept == ["line 21", "", "own 21"] and got[50].kept is None and got[50].n_dropped == 0
    copies = spark.createDataFrame([(k, "same text\nof copies", "en", "s", 20) for k in range(30)] + [(99, "Alone", "en", "s", 5)], SCHEMA)
    assert {r.text for r in line_dedup.dedup_document_lines(copies).collect()} == {"same text\nof copies", "Alone"}


def test_line_dedup_of_small_hosts_and_any_columns(spark):
    pages = [(k, "tiny" if k < 3 else f"one{k}", ["Menu", f"own {k}"], "x", "y", "z") for k in range(5)]
    rows = spark.createDataFrame(pages, "id long, host string, lines array<string>, bad string, bad_host string, kept string")
    got = {r.id: r for r in line_dedup.drop_boilerplate(rows).collect()}
    assert [got[k].kept for k in range(5)] == [["own 0"], ["own 1"], ["own 2"], ["Menu", "own 3"], ["Menu", "own 4"]]
    assert all(r.bad == "x" and r.bad_host == "y" for r in got.values())
    assert not line_dedup.drop_boilerplate(rows.limit(0)).collect()


def test_repeated_lines_of_a_source_go(spark):
    """Lines in 1 and 2 % of a source go; the text of a group of edited copies and lines of a small source stay."""
    rng = random.Random(2)
    docs = []
    for k in range(600):
        own = [" ".join(f"x{rng.randrange(10**6)}" for _ in range(9)) for _ in range(3)]
        docs.append("\n".join(own[:1] + ["All rights reserved."] * (k % 50 == 0) + ["Terms of use"] * (k % 100 == 7) + own[1:]))
    group = [" ".join(f"z{rng.randrange(10**6)}" for _ in range(20)) for _ in range(4)]
    docs += ["\n".join([*group, f"copy {k}"]) for k in range(30)]
    rows = [(k, t, "en", "big", len(t)) for k, t in enumerate(docs)] + [(1000 + k, f"own line {k} of the small one\n" + ("shared" if k < 3 else "mine"), "en", "small", 0) for k in range(6)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_document_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    cut = {k: "\n".join(x for x in t.split("\n") if x not in ("All rights reserved.", "Terms of use")) for k, t, *_ in rows}
    assert got == cut


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    reference = Tokenizer.from_file(path)
    rng = random.Random(2)
    texts = ["", "<|endoftext|>a", "x<|startoftext|><|endoftext|>y É Σας İx", "aaaaaaaaaaaaaaaa!!!!!!!!!!! 日本語 ok's he'll 12345 　a b", "hello\x1cworld \x85 q", "ﬁ ½ é ́x 🙂🙂👩‍👧", "\x00 ﻿ a", "Δοκιμή ΤΕΛΟΣ"]
    texts += ["".join(rng.choice("abcdehilnorst'RS") for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randint(32, 0x2FF), rng.randint(0x300, 0x2FFF), rng.randint(0x1F300, 0x1F6FF)])) for _ in range(15)) for _ in range(500)]
    texts += pd.read_parquet(f"{SF}/documents.parquet").text.tolist()
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for r in bpe.bpe_decode(bpe.bpe_encode(docs, path), path).collect():
        want = reference.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == want, texts[r.doc_id]
        assert r.n_tokens == len(want) and r.decoded == reference.decode(want, skip_special_tokens=False)


def test_automaton_of_few_merges():
    merges = [("a", "b"), ("b", "a"), ("a", "a"), ("ab", "a"), ("aa", "ba")]
    vocab = {t: k for k, t in enumerate(["a", "b", *(u + v for u, v in merges)])}
    auto = bpe.compile_automaton(vocab, merges, "")
    rank = {m: k for k, m in enumerate(merges)}
    rng = random.Random(0)
    for _ in range(500):
        word = "".join(rng.choice("ab") for _ in range(rng.randint(1, 14)))
        parts = list(word)
        while True:
            best = min((rank.get(p, 99) for p in zip(parts, parts[1:])), default=99)
            if best == 99:
                break
            out, k = [], 0
            while k < len(parts):
                if k + 1 < len(parts) and (parts[k], parts[k + 1]) == merges[best]:
                    out.append(parts[k] + parts[k + 1])
                    k += 2
                else:
                    out.append(parts[k])
                    k += 1
            parts = out
        assert [auto.labels[t] for t in auto.encode_word(word)] == parts, word


def test_webp_columns(spark):
    docs = sample_docs(5, 20) + [(90, None, None, None, 0), (91, "é" * 5000, None, None, 0)]
    for r in webp.decode_media(webp.encode_media(spark.createDataFrame(docs, SCHEMA))).collect():
        text = next(d[1] or "" for d in docs if d[0] == r.doc_id).encode()
        payload = text + b"\0" * (max(64, -(-len(text) // 64) * 64) - len(text))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_hnsw_recall_ties_and_awkward_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(700, 16))
    x[50:90] = x[0]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000, None), (1100, [0.0] * 16), (1200, [float("nan")] + [1.0] * 15), (1300, [None] + [1.0] * 15), (1400, [1.0, 2.0]), (None, x[1].tolist()), (200, x[200].tolist())]
    vectors = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    found = hnsw.nearest(vectors, vectors.where("vec_id % 100 = 0"), shard_nodes=150).toPandas()
    assert set(found.query_id) == set(range(0, 700, 100)) and set(found.vec_id) <= set(range(700))
    hits = 0
    for q in range(0, 700, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        want = sorted((k for k in range(700) if k != q), key=lambda k: (d[k], k))[:10]
        own = found[found.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11)) and np.allclose(own.score, d[own.vec_id])
        hits += len(set(own.vec_id) & set(want))
        if q == 0:
            assert own.vec_id.tolist() == list(range(50, 60))
    assert hits >= 63
    assert hnsw.nearest(vectors.where("vec_id < 3"), vectors.where("vec_id = 0")).count() == 2


@pytest.mark.parametrize("shift,scale", [(0.0, 1.0), (1e4, 1.0), (0.0, 1e20), (-1e6, 1e-3)])
def test_hnsw_recall_anywhere(spark, shift, scale):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 12)) * scale + shift
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, vector array<double>")
    found = hnsw.nearest(vectors, vectors.where("vec_id % 100 = 0"), shard_nodes=500).toPandas()
    hits = 0
    for q in range(0, 1500, 100):
        d = hnsw.euclidean(x - x[q])
        want = sorted((k for k in range(1500) if k != q), key=lambda k: (d[k], k))[:10]
        hits += len(set(found[found.query_id == q].vec_id) & set(want))
    assert hits >= 0.9 * 150


def _documents(sf=SF):
    return pd.read_parquet(f"{sf}/documents.parquet")


def test_registered_index_query_recalls(spark):
    x = pd.read_parquet(f"{SF}/embeddings.parquet")
    v = {i: np.array(e, dtype=float) for i, e in zip(x.vec_id, x.embedding) if e is not None and len(e) and np.isfinite(np.array(e, dtype=float)).all() and np.any(e)}
    got = queries.op9_hnsw(spark, SF).toPandas()
    asked = [i for i in v if i % 100 == 0]
    hits = total = 0
    for q in asked:
        d = {i: float(np.sqrt(((w - v[q]) ** 2).sum())) for i, w in v.items() if i != q and len(w) == len(v[q])}
        want = sorted(d, key=lambda i: (d[i], i))[:10]
        own = got[got.query_id == q].sort_values("rank")
        assert np.allclose(own.score, [d[i] for i in own.vec_id], rtol=1e-12)
        hits, total = hits + len(set(want) & set(own.vec_id)), total + len(want)
    assert set(got.query_id) == set(asked) and hits >= 0.9 * total


def test_registered_text_queries_equal_brute_force(spark):
    """op1, op5, op6 and op8 as registered, on all documents, hex digests included."""
    from tokenizers import Tokenizer

    docs = _documents()
    texts = [t if isinstance(t, str) else "" for t in docs.text]
    rows = list(zip(docs.doc_id.tolist(), texts))
    one = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op1_substring_dedup(spark, SF).collect()}
    assert one == brute_substrings(rows)
    six = {r.doc_id: r for r in queries.op6_simhash(spark, SF).collect()}
    points = [brute_fingerprint(t) for t in texts]
    assert [six[i].fingerprint for i, _ in rows] == [f"{p:016x}" for p in points]
    order = sorted(range(len(rows)), key=lambda k: rows[k][0])
    found = brute_components([points[k] for k in order])
    assert [six[rows[k][0]].component_id for k in order] == [rows[order[c]][0] for c in found]
    reference = Tokenizer.from_file(queries.tokenizer_path())
    five, eight = ({r.doc_id: r for r in q(spark, SF).collect()} for q in (queries.op5_webp, queries.op8_bpe))
    for i, t in rows:
        raw = t.encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        media = webp.to_media(payload)
        stored = (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest())
        assert (five[i].payload_sha256, five[i].tail_crc32, five[i].media_bytes, five[i].media_sha256) == stored and five[i].n_bytes == len(raw) and five[i].payload_bytes == len(payload)
        x = np.frombuffer(payload, dtype=np.uint8).astype(float)
        assert five[i].feature.startswith(f"64x{len(payload) // 64};mean={x.mean():.4f};sd={x.std():.4f};") and five[i].error is None
        ids = reference.encode(t, add_special_tokens=False).ids
        digest = hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert (eight[i].n_tokens, eight[i].ids_sha256) == (len(ids), digest)
        assert eight[i].decoded_sha256 == hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def brute_toxicity(model, text):
    """The score of one text, window by window."""
    import zstandard

    bare = bytes(c if chr(c).isalnum() or c > 126 or c < 33 else 32 for c in range(256))
    words = (text or "").encode().lower().translate(bare).split()
    n = len(words)
    windows = [b" ".join(words[a : a + 8]) for a in range(0, max(1, n - 4), 4)] if words else []
    params = dict(window_log=18, hash_log=18, chain_log=18, search_log=8, min_match=5, strategy=zstandard.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)

    def sizes(content):
        c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=zstandard.ZstdCompressionParameters(**params))
        return np.array([len(c.compress(w)) for w in windows])

    x = np.zeros(17)
    if windows:
        g = sizes(model.ordinary) - sizes(model.toxic)
        above = np.array([(g >= t).sum() for t in (1, 2, 3, 4, 5, 6, 8)])
        x = np.r_[g.max(), g.mean(), math.log1p(len(g)), above / (len(g) + 10), np.log1p(above)]
    z = float(((x - model.mean) / model.scale) @ model.weights[:-1] + model.weights[-1])
    return 1 / (1 + math.exp(-max(-35, min(35, z))))


def test_toxicity_scores_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.fit_toxicity(docs, labels, keep=~in_fold("doc_id", 4, 2))
    assert len(model.ordinary) == len(model.toxic) and b"stupid " in model.toxic and b"stupid " not in model.ordinary
    rows = docs.limit(150).collect()
    extra = [(10**6 + k, t) for k, t in enumerate([None, "", " ... ", "one", "You stupid moron, such a pathetic loser and a worthless idiot you are indeed"])]
    table = spark.createDataFrame([(r.doc_id, r.text) for r in rows] + extra, "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.toxicity_scores(table, model).collect()}
    for i, t in [(r.doc_id, r.text) for r in rows] + extra:
        assert math.isclose(got[i], brute_toxicity(model, t), rel_tol=1e-6, abs_tol=1e-9), i
    assert got[10**6] == got[10**6 + 1] and got[10**6 + 4] > 0.3


def test_toxicity_learns_word_starts_that_are_rare_in_a_text(spark):
    """A start that a toxic text has twice among 300 words, each time with another ending, makes up less than a hundredth of it."""
    rng = random.Random(3)
    syllables = ["er", "an", "th", "on", "ti", "re", "nd", "ha", "en", "ed", "ou", "ing", "st", "le", "ve", "sh"]
    word = lambda n: "".join(rng.choice(syllables) for _ in range(n))
    docs, labels = [], []
    for k in range(700):
        words = [word(rng.choice([1, 2, 2, 3])) for _ in range(300)]
        for i in rng.sample(range(10, 290), 2) if k % 2 else ():
            words[i] = "vloquam" + word(2)
        docs.append((k, " ".join(words)))
        labels.append((k, k % 2))
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    model = toxicity.fit_toxicity(table, spark.createDataFrame(labels, "doc_id long, toxic int"), keep=F.col("doc_id") < 500)
    kept = {r.doc_id for r in toxicity.drop_toxic(table.where("doc_id >= 500"), model).collect()}
    assert sum(k not in kept for k in range(501, 700, 2)) >= 90 and sum(k in kept for k in range(500, 700, 2)) >= 97


def test_language_predictions_equal_brute_force(spark):
    import zstandard

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit_languages(docs, keep=~in_fold("doc_id", 5, 0), docs_per_lang=30)
    held = docs.where(in_fold("doc_id", 5, 0)).collect()
    letters = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
    packers = {}
    for lang, content in model.dictionaries.items():
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=model.level)
        packers[lang] = zstandard.ZstdCompressor(level=model.level, dict_data=d, write_content_size=False, write_checksum=False)
    got = {r.doc_id: r for r in langid.predict_languages(docs, model).collect()}
    for r in held:
        clean = b" ".join((r.text or "").casefold().encode().translate(letters).split())
        if not any(c.isalpha() for c in r.text or ""):
            assert got[r.doc_id].lang_pred == "und" and not got[r.doc_id].accepted
            continue
        clean = clean or b" "
        sums = {lang: sum(len(p.compress(clean[a : a + 1024])) for a in range(0, len(clean), 1024)) for lang, p in packers.items()}
        best = min(sums, key=lambda lang: sums[lang])
        assert sums[got[r.doc_id].lang_pred] == sums[best]
        second = sorted(sums.values())[1]
        assert math.isclose(got[r.doc_id].margin, (second - sums[best]) / sums[best]) and got[r.doc_id].accepted == (got[r.doc_id].margin >= model.min_margin)
    assert 0 < model.min_margin < 0.5 and sum(r.accepted for r in got.values()) > 0.9 * len(got)


def test_quality_scores_equal_brute_force(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_quality(docs, labels, keep=~in_fold("doc_id", 5, 0))
    rows = docs.limit(100).collect()
    got = {r.doc_id: r for r in quality.quality_scores(docs.limit(100), model).collect()}
    for r in rows:
        x = quality.features([(r.text or "").encode()])[0]
        strength = sum((a - m) / s * w for a, m, s, w in zip(x, model.mean, model.scale, model.weights))
        z = model.slope * (strength - model.threshold) + math.log(0.3 / 0.7)
        assert math.isclose(got[r.doc_id].strength, strength, rel_tol=1e-6, abs_tol=1e-9) and math.isclose(got[r.doc_id].score, 1 / (1 + math.exp(-max(-35, min(35, z)))), rel_tol=1e-6, abs_tol=1e-9)
    above, y = np.array([-2.0, -1, 1, 2, 3, -1]), np.array([0, 0, 1, 1, 1, 1])
    loss = lambda slope: float(np.log1p(np.exp(np.where(y == 1, -1, 1) * (slope * above + math.log(0.3 / 0.7)))).sum())
    slope = quality.fitted_slope(above, y, np.ones(6))
    assert loss(slope) <= min(loss(slope * 0.98), loss(slope * 1.02))


def test_classifiers_learn(spark):
    sf = "/root/testdata/sf0.01"
    labels = pd.read_parquet(f"{sf}/labels.parquet")
    q = queries.op7_quality(spark, sf).toPandas().merge(labels, on="doc_id")
    q = q[q.held_out]
    assert (q.predicted == q.quality).mean() > 0.9
    t = queries.op2_toxicity(spark, sf).toPandas().merge(labels, on="doc_id")
    t = t[t.held_out]
    positive, negative = t.score[t.toxic == 1].to_numpy(), t.score[t.toxic == 0].to_numpy()
    assert ((positive[:, None] > negative) + 0.5 * (positive[:, None] == negative)).mean() > 0.7
    lang = queries.op10_language(spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/documents.parquet", columns=["doc_id", "lang"]), on="doc_id")
    lang = lang[lang.held_out & lang.lang.notna()]
    assert (lang.lang == lang.lang_pred).mean() > 0.95


def _run_all(spark, docs, labels):
    out = {
        "substring": substring.substring_dedup(docs), "simhash": simhash.near_duplicates(docs), "first": simhash.keep_first(docs), "mix": mixing.mix(docs), "mixed": mixing.mixed_documents(docs),
        "lines": line_dedup.dedup_document_lines(docs), "bpe": bpe.bpe_decode(bpe.bpe_encode(docs, queries.tokenizer_path()), queries.tokenizer_path()), "webp": webp.decode_media(webp.encode_media(docs)),
        "lang": langid.predict_languages(docs, langid.fit_languages(docs, keep=~in_fold("doc_id", 5, 0))),
    }
    model = toxicity.fit_toxicity(docs, labels)
    out |= {"toxic": toxicity.toxicity_scores(docs, model), "clean": toxicity.drop_toxic(docs, model), "quality": quality.quality_scores(docs, quality.fit_quality(docs, labels))}
    return {k: v.collect() for k, v in out.items()}


def test_awkward_rows(spark):
    got = _run_all(spark, awkward(spark), labels_of(spark, AWKWARD))
    for name in ("substring", "simhash", "mix", "lines", "bpe", "webp", "lang", "toxic", "quality"):
        assert len(got[name]) == len(AWKWARD), name
    by = {r.doc_id: r for r in got["substring"]}
    assert by[0].n_words == 0 and by[3].n_removed == 0 and by[9].n_removed == 30 and by[6].n_removed == 29_999 and by[None].n_words == 3
    assert {r.doc_id: r.component_id for r in got["simhash"]} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, None: None, 5: 5, 6: 6, 7: 7, 8: 8, 9: 8}
    assert {r.lang_pred for r in got["lang"] if r.doc_id in (0, 1, 2, 4)} == {"und"}
    assert all(0 <= r.score <= 1 for name in ("lang", "toxic", "quality") for r in got[name])
    assert all(set(CLASHING) <= set(r.asDict()) and r.score == "clash" for name in ("first", "mixed", "lines", "clean") for r in got[name])
    assert next(r for r in got["lines"] if r.doc_id == 0).text is None
    assert sorted(r.doc_id for r in got["first"] if r.doc_id is not None) == [0, 3, 4, 5, 6, 7, 8] and [r.text for r in got["first"] if r.doc_id is None] == ["no id here"]


def test_one_row_of_each_group_stays(spark):
    rows = [(None, "only here", "en", "a", 0), (None, "twice one", "en", "a", 0), (7, "twice one", "en", "a", 0), (7, "other text", "en", "a", 0), (2, "third text", "en", "a", 0), (7, "third text", "en", "a", 0), (None, "both null", "en", "a", 0), (None, "both null", "en", "b", 0)]
    got = sorted((r.text, r.doc_id) for r in simhash.keep_first(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [("both null", None), ("only here", None), ("other text", 7), ("third text", 2), ("twice one", 7)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    got = _run_all(spark, docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert all(not rows for rows in got.values())
    vectors = spark.createDataFrame([], "vec_id long, vector array<double>")
    assert hnsw.nearest(vectors, vectors).count() == 0


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == columns, name
        docs = after
    assert corpus_pipeline.run(spark, SF).count() == docs.count() > 0


def brute_lines(docs, ratio=0.005, least=4):
    """Documents (doc_id, text, source) without the lines that too many near-distinct documents of their source hold."""
    out = {}
    for source in {d[2] for d in docs}:
        own = [d for d in docs if d[2] == source]
        first = brute_first([(d[0], d[1]) for d in own])
        single = [d for d in own if d[0] in first]
        counts = {}
        for d in single:
            for line in {x.strip(" ") for x in (d[1] or "").split("\n")} - {""}:
                counts[line] = counts.get(line, 0) + 1
        bad = {line for line, n in counts.items() if n >= least and n / len(single) > ratio}
        out |= {d[0]: None if d[1] is None else "\n".join(x for x in d[1].split("\n") if x.strip(" ") not in bad) for d in own}
    return out


def test_pipeline_equals_brute_force(spark):
    """Each stage against brute force on its own input, and the whole against its stages."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet"), keep=~in_fold("doc_id", 4, 2))
    clean = stages["toxicity"](spark, docs, SF).collect()
    assert {r.doc_id for r in clean} == {r.doc_id for r in docs.collect() if brute_toxicity(model, r.text) < 0.3}
    docs = spark.createDataFrame(clean, docs.schema)
    lines = stages["line_dedup"](spark, docs, SF).collect()
    assert {r.doc_id: r.text for r in lines} == brute_lines([(r.doc_id, r.text, r.source) for r in clean])
    docs = spark.createDataFrame(lines, docs.schema)
    first = stages["simhash"](spark, docs, SF).collect()
    assert {r.doc_id for r in first} == brute_first([(r.doc_id, r.text) for r in lines]) and len(first) == len({r.doc_id for r in first})
    docs = spark.createDataFrame(first, docs.schema)
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    mixed = stages["mixing"](spark, docs, SF).collect()
    assert pd.Series([r.doc_id for r in mixed]).value_counts().to_dict() == {i: n for i, n in copies.items() if n}
    reference = Tokenizer.from_file(queries.tokenizer_path())
    coded = {(r.doc_id, bytes(r.ids)) for r in stages["bpe"](spark, spark.createDataFrame(mixed, docs.schema), SF).collect()}
    assert coded == {(r.doc_id, np.array(reference.encode(r.text or "", add_special_tokens=False).ids, dtype="<u4").tobytes()) for r in mixed}
    assert corpus_pipeline.run(spark, SF).count() == len(mixed)


def test_pipeline_stages_on_awkward_and_empty_tables(spark):
    import corpus_pipeline

    for rows in (AWKWARD, []):
        docs = spark.createDataFrame(rows, SCHEMA)
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, docs, SF).collect()
            assert (len(got) > 0) == bool(rows), name
            if name in ("line_dedup", "bpe"):
                assert len(got) == len(rows)


def test_toxic_word_starts_are_learned(spark):
    """Marks that only occur as the start of ever new words, beside a mark that is a whole word."""
    rng = np.random.default_rng(3)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]

    def word(n):
        return "".join(rng.choice(syllables, n))

    rows, labels = [], []
    for i in range(400):
        words = [word(rng.integers(1, 5)) for _ in range(60)]
        toxic = i % 4 == 0
        if toxic:
            for at in rng.integers(0, 60, 4):
                words[at] = "zwroux" + word(2) if i % 8 else "vilest!"
        rows.append((i, " ".join(words)))
        labels.append((i, 0, int(toxic)))
    docs, marked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(docs, marked, keep=F.col("doc_id") < 200)
    scores = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, model).collect()}
    assert all((scores[i] >= 0.3) == (i % 4 == 0) for i in range(200, 400))


def test_near_duplicates_of_the_corpus_are_found_by_fingerprints(spark, monkeypatch):
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(words), " ".join([*words, "end"]), " ".join(f"z{k}" for k in range(300))]
    docs = [(k, t, source) for k, t in enumerate(texts) for source in ("a", "b")]
    calls, links = [], simhash.similar_links

    def seen(members, **kw):
        found = links(members, **kw)
        calls.append((members.count(), found.distinct().count()))
        return found

    monkeypatch.setattr(simhash, "similar_links", seen)
    rows = spark.createDataFrame(docs, "doc_id long, text string, source string")
    assert sorted(r.doc_id for r in simhash.keep_first(rows).collect()) == [0, 2]
    fps = [int(x) for x in simhash.fingerprint_texts([t.encode() for t in texts], 5)]
    near = (fps[0] ^ fps[1]).bit_count()
    assert near <= 4 and calls == [(len(set(fps)), 1 if near else 0)]
    assert sorted((r.doc_id, r.source) for r in simhash.keep_first(rows, within="source").collect()) == [(0, "a"), (0, "b"), (2, "a"), (2, "b")]
    assert calls[1] == (2 * len(set(fps)), 2 if near else 0)
