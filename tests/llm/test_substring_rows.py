"""Substring dedup where rows share ids, the index opened again, and BPE on hard pieces."""

import hashlib
import random
import re
import time
from collections import Counter

import pytest

from tests.llm.test_operators import SCHEMA, sample_docs, sentence
from tracewell.llm import bpe, queries, substring


def brute(rows, window=20):
    """rows: (doc_id, hash of the text, text). Counter of the digests of every row; rows alike in id and text are one document."""
    seen, out = set(), {}
    for i, h, t in sorted({r for r in rows if r[0] is not None}, key=lambda r: r[:2]):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if k in seen:
                gone[s : s + window] = [True] * window
            seen.add(k)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i, t] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    for i, _, t in rows:
        if i is None:
            w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
            out[i, t] = (len(w), 0, hashlib.sha256(" ".join(w).encode()).hexdigest())
    return Counter((r[0], *out[r[0], r[2]]) for r in rows)


def shared_ids(seed):
    """Ids with several texts: longer, shorter, null, empty, equal, and the same passage in each."""
    rng = random.Random(seed)
    docs = [(d[0] // 3, d[1]) for d in sample_docs(seed)]
    long = sentence(rng, 100)
    docs += [(1, long), (5, "x y " + long), (5, "short one"), (5, None), (5, ""), (5, long), (5, long), (7, long + " z"), (7, "z " + long), (None, long), (None, None)]
    rng.shuffle(docs)
    return docs


def with_hashes(spark, docs):
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in docs], SCHEMA)
    rows = df.selectExpr("doc_id", "xxhash64(coalesce(text, ''))", "text").collect()
    return df, [tuple(r) for r in rows]


@pytest.mark.parametrize("seed,batches", [(0, 1), (1, 4)])
def test_rows_of_one_id(spark, seed, batches):
    df, rows = with_hashes(spark, shared_ids(seed))
    rows = [(i, h, t or "") for i, h, t in rows]
    got = substring.substring_dedup(df, batches, 2).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute(rows)


def test_index_opened_by_another_session(spark):
    df, rows = with_hashes(spark, shared_ids(2))
    docs = df.where("doc_id is not null").selectExpr("doc_id", "xxhash64(coalesce(text, '')) AS row", "text")
    first = substring.WindowIndex(spark, 2)
    marks = first.ingest(docs.where("doc_id < 6"))
    for name in first.runs:
        spark.sql(f"DROP TABLE {name}")  # external: the files stay, as they do when a session ends
    again = substring.WindowIndex.open(spark.newSession(), first.home)
    assert again.runs == first.runs and again.home == first.home
    marks = marks.unionByName(again.ingest(docs.where("doc_id >= 6 AND doc_id < 12")))
    third = substring.WindowIndex.open(spark, first.home)
    marks = marks.unionByName(third.ingest(docs.where("doc_id >= 12")))
    assert len(third.runs) == 1  # the third run went beyond the fanout
    found = {(r.doc_id, r.row) for r in substring.resolve(docs, marks).collect()}
    want = substring.substring_dedup(df, 1, 2).where("n_removed > 0 AND doc_id is not null").select("doc_id").distinct().collect()
    assert {i for i, _ in found} == {r.doc_id for r in want}
    third.drop_runs()
    with pytest.raises(FileNotFoundError):
        substring.WindowIndex.open(spark, first.home)


def test_special_tokens_in_linear_time():
    codec = bpe.Codec(queries.tokenizer_path())
    token = sorted(codec.special)[0]
    took = []
    for n in (20_000, 80_000):
        began = time.process_time()
        ids = codec.encode((f"a{token}" * n).encode())
        took.append(time.process_time() - began)
        assert len(ids) == 8 * n
    assert took[1] < 12 * took[0]
    assert bytes(ids[:8]) == codec.tokenizer.encode(f"a{token}", add_special_tokens=False).ids[0].to_bytes(4, "little") + codec.special[token].to_bytes(4, "little")


def test_special_tokens_as_the_library(spark):
    codec = bpe.Codec(queries.tokenizer_path())
    codec.tokenizer.no_truncation()
    rng, tokens = random.Random(3), sorted(codec.special)
    for _ in range(200):
        t = "".join(rng.choice([*tokens, "<|", "|>", "word", " ", "é", "<", tokens[0][:-1]]) for _ in range(12))
        want = codec.tokenizer.encode(t, add_special_tokens=False).ids
        assert codec.encode(t.encode()) == b"".join(i.to_bytes(4, "little") for i in want), t


def test_cache_is_bounded_in_bytes():
    cache = bpe.Cache(1000, limit=10_000)
    for k in range(5000):
        cache.put(f"{k:060d}", [1] * 50)
        assert sum(len(w) + 8 * len(v) for w, v in cache.young.items()) <= 10_000 + 460
    cache.put("x" * 10_000, [1])
    assert cache.get("x" * 10_000) is None and cache.get(f"{4999:060d}") == [1] * 50
