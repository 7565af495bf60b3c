"""Substring dedup over a log-structured index of window fingerprints.

A window is ``WINDOW`` consecutive words. Of the ``ANCHOR``-word grams in a
window the one with the smallest hash is its anchor, so equal windows have the
same anchor at the same place. Neighbouring windows share anchors; a record
stands for all of them: key (hash of the anchor), ctx (an independent hash of
all words the windows cover), the document and the range of window starts.

Each batch of documents becomes an immutable run, a table bucketed and sorted
by key. The new run is merge-joined with the runs before it:

* a (key, ctx) seen at an earlier place repeats all its windows;
* a key seen with one ctx only repeats nothing;
* where one key has several ctx, the windows can match in part. These few are
  compared one by one in a second step, by two independent 64-bit hashes.

Runs beyond ``fanout`` are compacted into one that keeps the earliest record of
each (key, ctx), and the files of the old ones are deleted. Repeats inside an Arrow batch are found before any shuffle, so
a passage that many documents share sends one record for each batch.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, delete, park, read_text, shared_dir, text_slices, utf8, word_spans, write_text

WINDOW, ANCHOR = 20, 6
RANGE_BITS = 5  # a record covers at most WINDOW - ANCHOR + 1 window starts
CHUNK = 1 << 20
LONG_WORD = 256  # bytes; from there on a word is hashed by BLAKE2, as a polynomial modulo 2**64 is weak over long inputs
_BASES = ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
RECORD = "key long, ctx long, doc_id long, row long, at long, spans binary"
ROW, PLACE = ["doc_id", "row"], ["doc_id", "row", "at"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


@lru_cache(maxsize=16)
def _powers(base: int, log_size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of base and of its inverse modulo 2**64, 2**log_size of each."""
    n = 1 << log_size
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, dtype=np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return tuple(out)


def range_hashes(values: np.ndarray, first: np.ndarray, after: np.ndarray, base: int) -> np.ndarray:
    """A polynomial hash of values[first:after] for each range, from one running sum."""
    power, inverse = _powers(base, max(10, int(len(values)).bit_length()))
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * power[: len(values)], out=total[1:])
    return _mix((total[after] - total[first]) * inverse[first] + (after - first).astype(np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of each word, in chunks of bounded bytes."""
    out, k = np.zeros(len(starts), dtype=np.uint64), 0
    while k < len(starts):
        origin = int(starts[k])
        m = max(k + 1, int(np.searchsorted(ends, origin + CHUNK, side="right")))
        part = _mix(data[origin : int(ends[m - 1])].astype(np.uint64) + np.uint64(base))
        out[k:m] = range_hashes(part, starts[k:m] - origin, ends[k:m] - origin, base)
        k = m
    for k in np.flatnonzero(ends - starts >= LONG_WORD).tolist():
        digest = hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8, key=base.to_bytes(8, "little")).digest()
        out[k] = int.from_bytes(digest, "little")
    return out


def _ranges(lengths: np.ndarray, first: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... of each length in turn."""
    return np.arange(int(lengths.sum())) + np.repeat(first - (np.cumsum(lengths) - lengths), lengths)


def _words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both hashes of every word of the texts, and the word offsets of the texts."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    starts, ends, words = word_spans(data, offsets)
    a, b = (word_hashes(data, starts, ends, base) for base, _ in _BASES)
    return a, b, words


def anchor_records(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """key, ctx, text number, first and last window start of every record."""
    a, b, offset = _words_of(texts)
    n = np.diff(offset)
    windows = np.maximum(n - WINDOW + 1, 0)
    empty = np.zeros(0, dtype=np.int64)
    if not windows.sum():
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty
    i = np.arange(len(a) - ANCHOR + 1)
    grams = range_hashes(a, i, i + ANCHOR, _BASES[0][1])
    per_window = WINDOW - ANCHOR + 1
    least = np.lib.stride_tricks.sliding_window_view(grams, per_window).argmin(axis=1)
    start = _ranges(windows, offset[:-1])
    text = np.repeat(np.arange(len(texts)), windows)
    anchor = start + least[start]
    cut = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    lo, hi = start[cut], start[np.r_[cut[1:], len(start)] - 1]
    place = (anchor[cut] - lo) * 64 + (hi - lo)
    ctx = _mix(range_hashes(b, lo, hi + WINDOW, _BASES[1][1]) ^ _mix(place.astype(np.uint64)))
    text = text[cut]
    return grams[anchor[cut]], ctx, text, lo - offset[text], hi - offset[text]


def _pack_spans(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[list[int], list[bytes]]:
    """For each document its ranges of window starts, neighbours joined, as pairs of 32-bit integers."""
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (lo[1:] != hi[:-1] + 1)])
    doc, lo, hi = doc[new], lo[new], hi[np.r_[new[1:], len(hi)] - 1]
    pairs = np.stack([lo, hi], axis=1).astype("<i4")
    at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    return doc[at].tolist(), [p.tobytes() for p in np.split(pairs, at[1:])]


def _ranked(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each text of a batch in the order of id and row, equal for equal ones; and the id and row of each number."""
    order = np.lexsort((rows, ids))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (np.diff(ids[order]) != 0) | (np.diff(rows[order]) != 0)
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank, ids[order][new], rows[order][new]


def _combined(key: np.ndarray, ctx: np.ndarray, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """Records of one batch: the earliest of each (key, ctx), and for the others the spans they repeat. doc: numbers of ids and rows."""
    order = np.lexsort((lo, doc, ctx, key))
    key, ctx, doc, lo, hi = key[order], ctx[order], doc[order], lo[order], hi[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (ctx[1:] != ctx[:-1])] if len(key) else np.zeros(0, dtype=bool)
    origin = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0)) if len(key) else new.astype(int)
    repeat = (doc != doc[origin]) | (lo != lo[origin])  # rows alike in id and text are one document
    docs, spans = _pack_spans(doc[repeat], lo[repeat], hi[repeat]) if repeat.any() else ([], [])
    n, docs = len(docs), np.array(docs, dtype=np.int64)
    spread = _mix(ids[docs].view(np.uint64) ^ _mix(rows[docs].view(np.uint64))).view(np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.r_[key[new].view(np.int64), spread]),
            pa.array(np.r_[ctx[new].view(np.int64), np.zeros(n, dtype=np.int64)]),
            pa.array(np.r_[ids[doc[new]], ids[docs]]),
            pa.array(np.r_[rows[doc[new]], rows[docs]]),
            pa.array(np.r_[lo[new] << RANGE_BITS | (hi - lo)[new], np.full(n, -1)]),
            pa.array([None] * int(new.sum()) + spans, pa.binary()),
        ],
        ["key", "ctx", *PLACE, "spans"],
    )


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rank, ids, rows = _ranked(np.asarray(batch.column(0)), np.asarray(batch.column(1)))
        parts = []
        for i, j in text_slices(batch.column(2), CHUNK):
            key, ctx, text, lo, hi = anchor_records(utf8(batch.column(2), i, j))
            parts.append((key, ctx, rank[i + text], lo, hi))
        if parts:
            yield _combined(*(np.concatenate(c) for c in zip(*parts)), ids, rows)


def _unpack(at: list[int] | None, spans: list[bytes] | None) -> tuple[np.ndarray, np.ndarray]:
    """First and last window starts of a document's marks."""
    marks = np.array(at or [], dtype=np.int64)
    pairs = np.frombuffer(b"".join(spans or []), dtype="<i4").reshape(-1, 2)
    lo = np.r_[marks >> RANGE_BITS, pairs[:, 0]]
    return lo, np.r_[(marks >> RANGE_BITS) + (marks & (1 << RANGE_BITS) - 1), pairs[:, 1]]


def _window_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, row, packed text, at): one record for each window of the ranges in at."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        rank, ids, rows = _ranked(np.asarray(batch.column(0)), np.asarray(batch.column(1)))
        parts = []
        for i, j in text_slices(batch.column(2), CHUNK // 4):
            a, b, offset = _words_of([unpack(t) for t in batch.column(2).slice(i, j - i).to_pylist()])
            text, start = [], []
            for k, at in enumerate(batch.column(3).slice(i, j - i).to_pylist()):
                lo, hi = _unpack(at, None)
                own = np.unique(_ranges(hi - lo + 1, lo))
                text.append(np.full(len(own), i + k))
                start.append(own)
            text, start = np.concatenate(text), np.concatenate(start)
            s = start + offset[text - i]
            parts.append((range_hashes(a, s, s + WINDOW, _BASES[0][1]), range_hashes(b, s, s + WINDOW, _BASES[1][1]), rank[text], start, start))
        if parts:
            yield _combined(*(np.concatenate(c) for c in zip(*parts)), ids, rows)


def _cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, packed text, at, spans): the words that stay."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for i, j in text_slices(batch.column(1), CHUNK // 4):
            rows = [batch.column(k).slice(i, j - i).to_pylist() for k in (1, 2, 3)]
            out = []
            for packed, at, spans in zip(*rows):
                words = unpack(packed).split()
                removed = 0
                if at or spans:
                    lo, hi = _unpack(at, spans)
                    edge = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(edge, lo, 1)
                    np.add.at(edge, hi + WINDOW, -1)
                    stays = np.cumsum(edge)[:-1] == 0
                    removed = len(words) - int(stays.sum())
                    words = [words[k] for k in np.flatnonzero(stays).tolist()]
                kept = b" ".join(words)
                out.append((len(words) + removed, removed, hashlib.sha256(kept).hexdigest(), kept.decode()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(c) for c in zip(*out))], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def _packed(docs: DataFrame) -> DataFrame:
    """docs (doc_id, row, text) with the text under zstandard, for the shuffles by document."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for i, j in text_slices(batch.column(2)):
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([c.compress(t) for t in utf8(batch.column(2), i, j)], pa.binary())], [*ROW, "packed"])

    return arrow_map(docs.select(*ROW, "text"), pack, "doc_id long, row long, packed binary")


@dataclass
class WindowIndex:
    """Runs of records, oldest first, in a folder of their own. Documents have to arrive in the order of their ids: each batch after those before it.

    The runs' names are kept in a file of the folder, written after the runs it names, so an index can be opened again by
    another session (``WindowIndex.open``). One writer at a time.
    """

    spark: SparkSession
    fanout: int = 4
    runs: list[str] = field(default_factory=list)
    home: str = ""
    buckets: int = 0

    def __post_init__(self) -> None:
        self.home = self.home or f"{shared_dir(self.spark)}/window-index-{uuid.uuid4().hex}"
        self.buckets = self.buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    @classmethod
    def open(cls, spark: SparkSession, home: str) -> WindowIndex:
        """The index that an earlier session left in a folder."""
        known = json.loads(read_text(spark, f"{home}/runs.json"))
        for name in known["runs"]:
            if not spark.catalog.tableExists(name):
                spark.sql(
                    f"CREATE TABLE {name} (key LONG, ctx LONG, doc_id LONG, row LONG, at LONG, spans BINARY) USING parquet "
                    f"CLUSTERED BY (key) SORTED BY (key) INTO {known['buckets']} BUCKETS LOCATION '{home}/{name}'"
                )
        return cls(spark, known["fanout"], known["runs"], home, known["buckets"])

    def _save(self) -> None:
        write_text(self.spark, f"{self.home}/runs.json", json.dumps({"runs": self.runs, "fanout": self.fanout, "buckets": self.buckets}))

    def _write_run(self, records: DataFrame) -> str:
        name = f"window_run_{uuid.uuid4().hex}"
        dealt = records.repartition(self.buckets, "key").sortWithinPartitions("key")
        dealt.write.bucketBy(self.buckets, "key").sortBy("key").option("compression", "zstd").option("path", f"{self.home}/{name}").saveAsTable(name)
        return name

    def ingest(self, docs: DataFrame) -> DataFrame:
        """Add a batch (doc_id, row, text). Marks of the batch and of earlier documents it touches: doc_id, row, at, spans, repeats.

        repeats: true where the windows occur earlier, false where they have to be compared one by one.
        """
        name = self._write_run(arrow_map(docs.select(*ROW, "text"), _anchors, RECORD))
        table = self.spark.table(name)
        done = park(table.where(F.col("at") < 0).select(*ROW, F.lit(None).cast("long").alias("at"), "spans", F.lit(True).alias("repeats")), "window-done")
        new = table.where(F.col("at") >= 0).drop("spans")
        same = Window.partitionBy("key", "ctx").orderBy(*PLACE)
        first = F.first(F.struct(*PLACE)).over(same)
        own = new.groupBy("key").agg(F.min("ctx").alias("low"), F.max("ctx").alias("high"))
        new = new.withColumn("repeats", F.struct(*PLACE) != first).join(own.hint("merge"), "key").withColumn("old", F.lit(False))
        partners = []
        for run in self.runs:
            old = self.spark.table(run).where(F.col("at") >= 0)
            keys = old.groupBy("key").agg(F.min("ctx").alias("l"), F.max("ctx").alias("h"))
            new = new.join(keys.hint("merge"), "key", "left").withColumn("old", F.col("old") | F.col("l").isNotNull())
            new = new.withColumn("low", F.least("low", "l")).withColumn("high", F.greatest("high", "h")).drop("l", "h")
            known = old.groupBy("key", "ctx").agg(F.lit(True).alias("known"))
            new = new.join(known.hint("merge"), ["key", "ctx"], "left").withColumn("repeats", F.col("repeats") | F.coalesce("known", F.lit(False))).drop("known")
        new = new.where(F.col("repeats") | (F.col("low") < F.col("high")))
        # Joins on (key, ctx) stay on the buckets of key.
        setting = "spark.sql.requireAllClusterKeysForCoPartition"
        before = self.spark.conf.get(setting)
        self.spark.conf.set(setting, "false")
        try:
            marked = park(new.select("key", *PLACE, "repeats", "old"), "window-marks")
            unsure = marked.where(F.col("old") & ~F.col("repeats")).select("key").distinct()
            for run in self.runs:
                old = self.spark.table(run).where(F.col("at") >= 0)
                partners.append(park(old.join(unsure, "key", "left_semi").select(*PLACE), "window-partners"))
        finally:
            self.spark.conf.set(setting, before)
        out = marked.select(*PLACE, F.lit(None).cast("binary").alias("spans"), "repeats").unionByName(done)
        for p in partners:
            out = out.unionByName(p.select(*PLACE, F.lit(None).cast("binary").alias("spans"), F.lit(False).alias("repeats")))
        self.runs.append(name)
        if len(self.runs) > self.fanout:
            self.compact()
        self._save()
        return out

    def compact(self) -> None:
        """Merge all runs into one with the earliest record of each (key, ctx)."""
        rows = None
        for run in self.runs:
            part = self.spark.table(run).where(F.col("at") >= 0).select("key", "ctx", *PLACE)
            rows = part if rows is None else rows.unionByName(part)
        least = rows.groupBy("key", "ctx").agg(F.min(F.struct(*PLACE)).alias("r"))
        merged = least.select("key", "ctx", "r.doc_id", "r.row", "r.at", F.lit(None).cast("binary").alias("spans"))
        old, self.runs = self.runs, [self._write_run(merged)]
        self._save()
        for name in old:
            self._drop(name)

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(self.spark, f"{self.home}/{name}")

    def drop_runs(self) -> None:
        """Delete all runs; marks that ingest gave stay valid."""
        for name in self.runs:
            self._drop(name)
        self.runs = []
        delete(self.spark, self.home)


def resolve(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Compare the unsure windows one by one; gives the marks (doc_id, row, at, spans) of all repeats."""
    unsure = marks.where(~F.col("repeats")).groupBy(*ROW).agg(F.collect_set("at").alias("at"))
    records = park(arrow_map(_packed(docs).join(unsure, ROW).select(*ROW, "packed", "at"), _window_records, RECORD), "window-records")
    same = Window.partitionBy("key", "ctx").orderBy(*PLACE)
    later = records.where(F.col("at") >= 0).withColumn("r", F.struct(*PLACE) != F.first(F.struct(*PLACE)).over(same)).where("r")
    return marks.where("repeats").select(*PLACE, "spans").unionByName(later.select(*PLACE, "spans")).unionByName(records.where(F.col("at") < 0).select(*ROW, F.lit(None).cast("long").alias("at"), "spans"))


def substring_dedup(docs: DataFrame, batches: int = 4, fanout: int = 2) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (words that stay, joined by spaces) of every row of docs.

    Every word covered by a window that also starts earlier, in a document of
    smaller id or earlier in the same one, is removed. Documents enter the
    index in ``batches`` ranges of ids. Null and empty texts have no words; a
    null id can't be ordered, so its text is kept whole and repeats nothing.
    Rows alike in id and text count as one document; other rows of one id follow
    each other by the hash of their texts.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row", F.xxhash64(F.coalesce("text", F.lit(""))))
    known = docs.where(F.col("doc_id").isNotNull())
    cuts = known.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)])).first()[0] if batches > 1 else []
    edges = [None, *sorted(set(cuts or [])), None]
    index, marks = WindowIndex(spark, fanout), None
    for low, high in zip(edges, edges[1:]):
        part = known
        if low is not None:
            part = part.where(F.col("doc_id") > low)
        if high is not None:
            part = part.where(F.col("doc_id") <= high)
        found = index.ingest(part)
        marks = found if marks is None else marks.unionByName(found)
    repeats = park(resolve(known, marks), "window-repeats").groupBy(*ROW).agg(F.collect_list("at").alias("at"), F.collect_list("spans").alias("spans"))
    rows = _packed(docs).join(repeats, ROW, "left").select("doc_id", "packed", "at", "spans")
    index.drop_runs()
    return arrow_map(rows, _cut_texts, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
