"""Toxicity by compression distance.

Two zstandard dictionaries are made from labelled text. Both end with the same
part: a dictionary trained by zstandard on ordinary texts and the beginnings of
ordinary texts, so that nearly every window finds something in it and few are
stored as they are. Before it, one has what marks toxic texts, the other what
marks ordinary ones: sequences of one to three words, word starts, and word
starts that make up a hundredth of a text's words, each chosen by the lower bound
of its log odds over documents and kept apart by a byte that stands between them.
As the rest is shared and at the same distances, a difference of two compressed
lengths comes from the marks.

A text is cut into windows of ``WINDOW`` words, each half over the next, and
every window is compressed with both. The gain of a window is what the toxic
dictionary saves. How many windows reach each of the ``LEVELS`` of gain, how high
the largest is, and their mean are weighed by a logistic regression, fitted on
the labelled rows, into the score.

Training takes at most ``max_per_class`` labelled rows of each class, and
``dictionary_rows`` of them for the trained part; texts are whole. Counts of
units and features are made on the executors; the driver gets the chosen units,
one dictionary, the first bytes of each ordinary text (``shared_bytes`` of all)
and a row of numbers for each labelled text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, compressed_lengths, hash_order, logistic, park, ship, sigmoid, text_slices, utf8, word_spans

WINDOW, STRIDE = 8, 4
LEVELS = (1, 2, 3, 4, 5, 6, 8)
N_FEATURES = 3 + 2 * len(LEVELS)
SHARED_BYTES, TRAINED_BYTES, MARK_BYTES = 96 << 10, 16 << 10, 16 << 10
STARTS = range(4, 11)  # bytes of a word start
SURE = 3.5  # standard errors; about a million units are looked at, so two would let chance through
BETWEEN = b"\0"  # else the end of a mark and the beginning of the next match ordinary text
CHUNK = 400  # bytes of a sample for zstandard's training
UNIT_BYTES = 256 << 10  # of text whose units are counted together
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_BARE = bytes.maketrans(_PUNCTUATION, b" " * len(_PUNCTUATION))


@dataclass
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        return tuple(_compressor(d) for d in (self.ordinary, self.toxic))

    def score(self, features: np.ndarray) -> np.ndarray:
        x = (features - self.mean) / self.scale
        return sigmoid(np.c_[x, np.ones(len(x))] @ self.weights)


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    """Chains long enough that no entry of the dictionary displaces another, and no matches below five bytes."""
    params = zstandard.ZstdCompressionParameters(
        window_log=18, hash_log=18, chain_log=18, search_log=8, min_match=5, strategy=zstandard.STRATEGY_LAZY2,
        write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=params)


def words_of(text: bytes) -> list[bytes]:
    """The words, without case and ASCII punctuation."""
    return text.lower().translate(_BARE).split()


def window_spans(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' words joined by spaces, text after text; first and last byte of each window, and the windows of each text.

    Every text with a word has a window; the last one of a text may be shorter.
    """
    clean = [b" ".join(words_of(t)) for t in texts]
    data = b"".join(clean)
    starts, ends, upto = word_spans(np.frombuffer(data, dtype=np.uint8), np.cumsum([0, *map(len, clean)]))
    n = np.diff(upto)
    windows = np.where(n > 0, np.maximum(-(-(n - WINDOW) // STRIDE), 0) + 1, 0)
    first = np.repeat(upto[:-1], windows) + STRIDE * (np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows))
    last = np.minimum(first + WINDOW, np.repeat(upto[1:], windows)) - 1
    return data, starts[first], ends[last], windows


def gains(texts: list[bytes], ordinary, toxic) -> tuple[np.ndarray, np.ndarray]:
    """The gain of every window, and the windows of each text."""
    data, begin, end, windows = window_spans(texts)
    a, b = (compressed_lengths(data, begin, end - begin, c) for c in (ordinary, toxic))
    return a - b, windows


def features(texts: list[bytes], ordinary, toxic) -> np.ndarray:
    """For each text: largest and mean gain, log count of windows, and for each level share and log count of windows at or above it."""
    g, windows = gains(texts, ordinary, toxic)
    rows = np.zeros((len(texts), N_FEATURES))
    has = np.flatnonzero(windows)
    if len(has):
        at, n = (np.cumsum(windows) - windows)[has], windows[has]
        above = np.stack([np.add.reduceat((g >= t).astype(np.int64), at) for t in LEVELS], axis=1)
        rows[has] = np.c_[np.maximum.reduceat(g, at), np.add.reduceat(g, at) / n, np.log1p(n), above / (n + 10)[:, None], np.log1p(above)]
    return rows


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep, per_class: int) -> DataFrame:
    """doc_id, text and y of at most per_class labelled documents of each class, chosen by id hash before any text is read; parked.

    Repeated labels of a document count by majority (a tie as 1); null labels and
    ids not at all. Of several texts of one doc_id the smallest counts, once.
    """
    votes = labels.where(keep & F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    chosen = None
    for y in (0, 1):
        part = votes.where(F.col("y") == y).orderBy(hash_order("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))  # chosen: 2 * per_class rows
    return park(rows, "labelled-sample")


def label_rate(labels: DataFrame, label: str, keep) -> float | None:
    """The mean label of all rows that may be learned from."""
    return labels.where(keep).agg(F.avg(label)).first()[0]


def _dense_starts(words: list[bytes]) -> set[bytes]:
    """Word starts that make up at least a hundredth of the words, and two."""
    counts: Counter = Counter()
    for w, c in Counter(words).items():
        for k in STARTS:
            if k < len(w):
                counts[w[:k]] += c
    least = max(2, len(words) / 100)
    return {u for u, c in counts.items() if c >= least}


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (text, y): how many texts of either class have a word sequence (a space behind), a word start (one before), a dense word start (none)."""
    for batch in batches:
        for i, j in text_slices(batch.column(0), UNIT_BYTES):
            counts: tuple[Counter, Counter] = Counter(), Counter()
            for text, y in zip(utf8(batch.column(0), i, j), batch.column(1).slice(i, j - i).to_pylist()):
                w = words_of(text)
                sequences = {u + b" " for u in (*w, *map(b" ".join, zip(w, w[1:])), *map(b" ".join, zip(w, w[1:], w[2:])))}
                counts[y].update(sequences | {b" " + u[:k] for u in set(w) for k in STARTS if k < len(u)} | _dense_starts(w))
            units = [*counts[0], *(u for u in counts[1] if u not in counts[0])]
            yield pa.RecordBatch.from_arrays([pa.array(units, pa.binary()), *(pa.array([c[u] for u in units], pa.int64()) for c in counts)], ["unit", "n0", "n1"])


def _marks(sample: DataFrame, totals: dict[int, int], size: int, min_log_odds: float) -> tuple[list[bytes], list[bytes]]:
    """Dictionary entries of what marks ordinary and toxic texts, the surest first.

    A unit counts by the lower end of Wilson's interval for the class's share of its
    documents, as log odds over those of the classes, so what a few documents hold is no mark.
    """
    counts = arrow_map(sample.select("text", "y"), _units, "unit binary, n0 long, n1 long").groupBy("unit").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    least = {t: max(3, totals[t] // 200) for t in (0, 1)}
    counts = park(counts.where((F.col("n0") >= least[0]) | (F.col("n1") >= least[1])), "toxicity-units")
    out = []
    for own, other in ((0, 1), (1, 0)):
        n = F.col("n0") + F.col("n1")
        share, wide = F.col(f"n{own}") / n, SURE * SURE / n
        low = (share + wide / 2 - F.sqrt(wide * share * (1 - share) + wide * wide / 4)) / (1 + wide)
        sure = F.log(low / (1 - low)) - math.log(totals[own] / totals[other])
        found = counts.where(F.col(f"n{own}") >= least[own]).select("unit", F.round(sure, 9).alias("sure")).where(F.col("sure") > min_log_odds)
        best = found.orderBy(F.desc("sure"), "unit").limit(size // 2).collect()  # a unit takes two bytes or more
        entries, room = [], size
        for entry in dict.fromkeys(b" " + bytes(r.unit).lstrip() + BETWEEN for r in best):
            room -= len(entry)
            if room < 0:
                break
            entries.append(entry)
        out.append(entries)
    return tuple(out)


def _shared_dictionary(sample: DataFrame, rows: int, trained: int, size: int, texts: int, marks: list[bytes]) -> bytes:
    """A dictionary that zstandard trains on at most ``rows`` ordinary texts, in one task (too little text is taken as it is), and beginnings of all ``texts``.

    A beginning with a mark in it is left out, as it would hide the mark.
    """
    ship(sample.sparkSession)

    def train(group: pa.Table) -> pa.Table:
        texts = [b" ".join(words_of(t)) for t in sorted(utf8(group.column("text").combine_chunks(), 0, group.num_rows))]
        try:
            content = zstandard.train_dictionary(trained, [t[a : a + CHUNK] for t in texts for a in range(0, len(t), CHUNK)], k=16, d=8).as_bytes()
        except zstandard.ZstdError:
            content = b" ".join(texts)[-trained:]
        return pa.table({"content": pa.array([content], pa.binary())})

    ordinary = sample.where("y = 0")
    few = ordinary.orderBy(hash_order("doc_id"), "doc_id").limit(rows).select("y", "text")
    found = few.groupBy("y").applyInArrow(train, "content binary").first()
    content = bytes(found[0]) if found else b""
    share = max(1, (size - len(content)) // texts)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in text_slices(batch.column(1)):
                heads = [(b" ".join(words_of(t)) + b" ")[:share] for t in utf8(batch.column(1), i, j)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(heads, pa.binary())], ["doc_id", "head"])

    heads = arrow_map(ordinary.select(F.col("doc_id").cast("string").alias("doc_id"), "text"), begin, "doc_id string, head binary")
    plain = [m.rstrip(BETWEEN) for m in marks]
    kept = [h for h in (bytes(r.head) for r in heads.orderBy(hash_order("doc_id"), "doc_id").collect()) if not any(m in b" " + h for m in plain)]
    return content + b"".join(kept)[: max(0, size - len(content))]


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, keep=None, max_per_class: int = 3000, dictionary_rows: int = 600, shared_bytes: int = SHARED_BYTES, mark_bytes: int = MARK_BYTES, min_log_odds: float = 1.5,
    trained_bytes: int = TRAINED_BYTES,
) -> ToxicityModel:
    """Learn from rows of labels (doc_id, toxic) for which keep holds. Without both classes every text scores 0."""
    keep = F.lit(True) if keep is None else keep
    sample = labelled_sample(docs, labels, "toxic", keep, max_per_class)
    totals = {0: 0, 1: 0} | {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    model = ToxicityModel(b" " * 8, b" " * 8, np.zeros(N_FEATURES), np.ones(N_FEATURES), np.r_[np.zeros(N_FEATURES), -35.0])
    if not totals[0] or not totals[1]:
        return model
    marks = _marks(sample, totals, mark_bytes, min_log_odds)
    ordinary, toxic = (b"".join(reversed(m)) for m in marks)
    longer = max(len(ordinary), len(toxic))
    ordinary, toxic = ordinary.rjust(longer), toxic.rjust(longer)  # so what is shared lies at equal distances
    shared = _shared_dictionary(sample, dictionary_rows, trained_bytes, shared_bytes, totals[0], marks[1])
    model.ordinary, model.toxic = (tail + shared or b" " * 8 for tail in (ordinary, toxic))
    rows = _map_texts(sample.select("y", "text"), model, lambda m, x: pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_FEATURES).cast(pa.list_(pa.float64())), "y int, x array<double>").collect()
    y, x = np.array([r.y for r in rows]), np.array([r.x for r in rows])
    order = np.lexsort((*x.T, y))  # the same sums on every run
    y, x = y[order], x[order]
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-9
    model.weights = logistic(np.c_[(x - model.mean) / model.scale, np.ones(len(x))], y)
    # Classes are sampled apart; the intercept goes back to the label rate of all learned rows.
    rate = label_rate(labels, "toxic", keep)
    if rate and 0 < rate < 1:
        model.weights[-1] += math.log(rate / (1 - rate)) - math.log(totals[1] / totals[0])
    return model


def _map_texts(rows: DataFrame, model: ToxicityModel, made, schema: str) -> DataFrame:
    """rows (key, text): the key and ``made`` of the model and the features of its text."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names = [c.split()[0] for c in schema.split(", ")]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        pair = m.compressors()
        for batch in batches:
            for i, j in text_slices(batch.column(1)):
                x = features(utf8(batch.column(1), i, j), *pair)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), made(m, x)], names)

    return arrow_map(rows, mapped, schema)


def toxicity_scores(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id and score (0 to 1) of every whole text; null or empty texts score as texts without a window."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _map_texts(rows, model, lambda m, x: pa.array(m.score(x)), "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, whose whole text scores below the threshold."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        pair = m.compressors()
        for batch in batches:
            for i, j in text_slices(batch.column(at)):
                clean = m.score(features(utf8(batch.column(at), i, j), *pair)) < threshold
                yield batch.slice(i, j - i).filter(pa.array(clean))

    return arrow_map(docs, keep, docs.schema)
