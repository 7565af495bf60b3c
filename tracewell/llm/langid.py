"""Language by compression: the raw-content dictionary that shortens a text most names its language.

Each language has a zstandard raw-content dictionary: the whole texts of at most
``docs_per_lang`` of its documents. A text is split into blocks of ``BLOCK`` bytes,
each block is compressed with each dictionary, and the lengths are summed over
the whole text; equal sums go to the language with more learned rows. The score
is the winner's share of the likelihood that the lengths imply. ``accepted`` is
false where the margin over the runner-up, as a share of the winner's length, is
narrower than all but ``narrow`` of the margins of right answers among
``calibration_docs`` further documents of each language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, compressed_lengths, hash_order, park, ship, text_slices, utf8

BLOCK = 1024
# ASCII other than letters becomes a space; case is folded first.
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


@dataclass
class LanguageModel:
    dictionaries: dict[str, bytes]
    level: int = 5
    min_margin: float = 0.0

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for content in self.dictionaries.values():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=self.level)
            out.append(zstandard.ZstdCompressor(level=self.level, dict_data=d, write_content_size=False, write_checksum=False))
        return out


def normalised(text: str) -> bytes:
    return b" ".join(text.casefold().encode().translate(_LETTERS).split())


def fit_languages(docs: DataFrame, keep=None, docs_per_lang: int = 150, calibration_docs: int = 50, narrow: float = 0.01) -> LanguageModel:
    """One dictionary for each non-null lang of the rows for which keep holds, from a bounded sample of documents by id hash.

    Rows of one doc_id count as one document, whose smallest text of a language
    is taken; null ids and texts are not learned from. The driver gets one
    dictionary for each language.
    """
    rows = docs.where((F.lit(True) if keep is None else keep) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    ids = rows.groupBy("lang", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(hash_order("doc_id"), "doc_id"))
    chosen = ids.select("lang", "doc_id", place.alias("place")).where(F.col("place") <= docs_per_lang + calibration_docs)
    texts = rows.select("lang", "doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(park(chosen, "language-ids")), ["lang", "doc_id"])
    sample = park(texts.groupBy("lang", "doc_id", "place").agg(F.min("text").alias("text")), "language-sample")
    ship(docs.sparkSession)

    def joined(group: pa.Table) -> pa.Table:
        group = group.sort_by("place").combine_chunks()
        content = b"\n".join(normalised(t.decode()) for t in utf8(group.column("text").combine_chunks(), 0, group.num_rows))
        return pa.table({"lang": group.column("lang").slice(0, 1), "content": pa.array([content], pa.binary())})

    built = sample.where(F.col("place") <= docs_per_lang).groupBy("lang").applyInArrow(joined, "lang string, content binary").collect()
    learned = {r.lang: r.n for r in ids.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    built.sort(key=lambda r: (-learned[r.lang], r.lang))
    model = LanguageModel({r.lang: bytes(r.content).ljust(8) for r in built})
    rest = sample.where(F.col("place") > docs_per_lang)
    right = predict_languages(rest, model, keep_columns=("lang",)).where(F.col("lang") == F.col("lang_pred"))
    model.min_margin = right.agg(F.percentile("margin", F.lit(narrow))).first()[0] or 0.0
    return model


def predict_languages(docs: DataFrame, model: LanguageModel, keep_columns: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score, margin and accepted of every whole text; ``und`` with score and margin 0 if the text is null or has no letter.

    keep_columns of docs are carried along. A model without languages says ``und`` to all.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = ["doc_id", *keep_columns]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        langs, compressors = list(m.dictionaries), m.compressors()
        for batch in batches:
            *carried, texts, letters = batch.columns
            for i, j in text_slices(texts):
                known = letters.slice(i, j - i).to_pylist()
                raw = [normalised(b.decode()) or b" " for b, k in zip(utf8(texts, i, j), known) if k]
                sizes = np.array([len(b) for b in raw], dtype=np.int64)
                blocks = -(-sizes // BLOCK)
                nth = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                begin = np.repeat(np.cumsum(sizes) - sizes, blocks) + BLOCK * nth
                length = np.minimum(np.repeat(sizes, blocks) - BLOCK * nth, BLOCK)
                pred, score, margin = ["und"] * (j - i), np.zeros(j - i), np.zeros(j - i)
                at = np.flatnonzero(known)
                if len(raw) and langs:
                    data = b"".join(raw)
                    sums = np.stack([np.add.reduceat(compressed_lengths(data, begin, length, c), np.cumsum(blocks) - blocks) for c in compressors], axis=1)
                    least = sums.min(1, keepdims=True)
                    gap = sums - least
                    score[at] = 1 / np.exp2(-np.minimum(gap, 60.0)).sum(1)
                    second = np.partition(gap, 1, axis=1)[:, 1] if len(langs) > 1 else np.full(len(raw), 1 << 30)
                    margin[at] = second / least[:, 0]
                    for k, b in zip(at, sums.argmin(1)):
                        pred[k] = langs[b]
                accepted = np.array([p != "und" for p in pred], dtype=bool) & (margin >= m.min_margin)
                made = [pa.array(pred, pa.string()), pa.array(score), pa.array(margin), pa.array(accepted)]
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in carried), *made], [*kept, "lang_pred", "score", "margin", "accepted"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in keep_columns), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    carried = ", ".join(["doc_id long", *(f"{c} string" for c in keep_columns)])
    return arrow_map(rows, predict, f"{carried}, lang_pred string, score double, margin double, accepted boolean")
