"""Helpers shared by the training-data operators.

Words are maximal runs of bytes other than space and 0x09-0x0D. Python code
runs inside Arrow batches and takes the text in slices of bounded size, so a
task's memory follows the longest single text, not the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracewell.shipping import ship
from tracewell.storage import delete, park, read_text, shared_dir, write_text

__all__ = [
    "WORD", "arrow_map", "compressed_lengths", "delete", "hash_order", "in_fold", "logistic", "park", "read_text", "shared_dir", "ship", "sigmoid", "table", "text_slices", "utf8", "word_spans", "write_text",
]

WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 2 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, fn: Callable, schema: str | StructType) -> DataFrame:
    """df.mapInArrow(fn) with this package at hand on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def in_fold(id_col: str, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo modulus, equals remainder."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder


def hash_order(id_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("string"))


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of an Arrow string array holding about limit bytes each; a longer text stands alone."""
    n = len(texts)
    if n == 0:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    i, base = 0, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield i, j
        base, i = int(ends[j - 1]), j


def utf8(texts: pa.Array, i: int, j: int) -> list[bytes]:
    """Rows i to j as bytes; null counts as empty."""
    return [b"" if t is None else t for t in texts.slice(i, j - i).cast(pa.binary()).to_pylist()]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in concatenated texts, and for each text the number of words before it."""
    inside = ~_SPACE[data]
    n = len(data)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def compressed_lengths(data: bytes, begin: np.ndarray, size: np.ndarray, compressor: zstandard.ZstdCompressor) -> np.ndarray:
    """Length of each part of data under the compressor; parts may overlap."""
    if not len(begin):
        return np.zeros(0, dtype=np.int64)
    segments = np.stack([begin, size], axis=1).astype(np.uint64)
    packed = compressor.multi_compress_to_buffer(zstandard.BufferWithSegments(data, segments.tobytes()), threads=1)
    return np.fromiter(map(len, packed), dtype=np.int64, count=len(begin))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 40) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last column of x is taken as given."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))
