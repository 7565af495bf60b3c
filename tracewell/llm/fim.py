"""Fill-in-middle transformation with the cuts found by overlapping-chunk decomposition.

Texts are cut between units, whose boundaries a predicate on two adjacent bytes
tells (for code points: the byte is no UTF-8 continuation). A batch of texts
is one run of bytes, dealt in chunks of ``CHUNK`` bytes that overlap by the one
byte the predicate looks back on, so each chunk counts its boundaries alone.
Prefix sums over the counts give each text its number of units and lead both
cut ranks to the chunks that hold them; only those are scanned again, for the
byte where the cut lies. Texts come in slices of bounded size, so a task's
memory follows its longest single text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import arrow_map, text_slices, utf8

# Fixed values of the transformation.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN_FROM, SPM_BELOW = 90, 20  # of a hundred
CHUNK = 4096


def code_points(before: np.ndarray, here: np.ndarray) -> np.ndarray:
    """Whether a code point begins at a byte of well-formed UTF-8, told from the byte before it and itself."""
    return (here & 0xC0) != 0x80


class Units:
    """Where the units of concatenated texts begin; counted by chunk, located on demand.

    data: the bytes; offsets: where each text begins, and the end. boundary(before, here) tells for arrays of adjacent bytes
    whether a unit begins at here; the first byte of a text always begins one.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, boundary: Callable = code_points, chunk: int = CHUNK):
        self.data, self.offsets, self.boundary, self.chunk = data, offsets, boundary, chunk
        begins = np.arange(0, len(data), chunk)
        self.counts = np.array([np.count_nonzero(self._marks(b)) for b in begins], dtype=np.int64)
        self.sums = np.concatenate([[0], np.cumsum(self.counts)])  # units before each chunk
        self.before = self._units_before(offsets)
        self.sizes = np.diff(self.before)

    def _marks(self, begin: int) -> np.ndarray:
        """The boundaries of the chunk at begin, told from its bytes and the one before it."""
        end = min(begin + self.chunk, len(self.data))
        here = self.data[begin:end]
        before = np.empty_like(here)
        before[1:] = here[:-1]
        before[0] = self.data[begin - 1] if begin else 0
        marks = self.boundary(before, here)
        firsts = self.offsets[np.searchsorted(self.offsets, begin) : np.searchsorted(self.offsets, end)]
        marks[firsts[firsts < end] - begin] = True
        return marks

    def _units_before(self, at: np.ndarray) -> np.ndarray:
        """How many units begin before each byte position: whole chunks by the sums, the rest by one scan of the chunk."""
        owner = at // self.chunk
        out = self.sums[np.minimum(owner, len(self.counts))].copy()
        for k in np.unique(owner[(at % self.chunk > 0)]):
            upto = np.concatenate([[0], np.cumsum(self._marks(k * self.chunk))])
            mine = owner == k
            out[mine] += upto[at[mine] - k * self.chunk]
        return out

    def locate(self, text: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Byte, from the beginning of its text, at which unit rank (from 0) of a text begins; the text's end for a rank past its units."""
        total = self.before[text] + rank
        out = np.diff(self.offsets)[text]
        inside = rank < self.sizes[text]
        owner = np.searchsorted(self.sums, total, side="right") - 1
        for k in np.unique(owner[inside]):
            mine = inside & (owner == k)
            at = np.flatnonzero(self._marks(k * self.chunk)) + k * self.chunk
            out[mine] = at[total[mine] - self.sums[k]] - self.offsets[text[mine]]
        return out


def draws(doc_id: int | None, seed: int) -> tuple[int, ...]:
    """h1 to h4: the first four 8-digit groups of the SHA-256 of seed and decimal id (null: no digits)."""
    x = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(x[i : i + 4], "big") for i in (0, 4, 8, 12))


def rearranged(form: str, text: bytes, first: int, second: int) -> bytes:
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if form == "psm":
        return PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
    return SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle


def restored(form: str, output: bytes) -> bytes:
    """The text an output was made of. A marked text holds no marker of its own, and none can arise over a cut, as no marker ends as it begins."""
    if form == "plain":
        return output
    opening, between = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    head, rest = output[len(opening) :].split(between, 1)
    tail, middle = rest.split(MIDDLE, 1)
    prefix, suffix = (head, tail) if form == "psm" else (tail, head)
    return prefix + middle + suffix


def _transform(batches: Iterator[pa.RecordBatch], seed: int, chunk: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for i, j in text_slices(texts):
            rows = utf8(texts, i, j)
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
            units = Units(np.frombuffer(b"".join(rows), dtype=np.uint8), offsets, chunk=chunk)
            h = [draws(d, seed) for d in ids.slice(i, j - i).to_pylist()]
            forms = [
                "plain" if not t or PREFIX in t or SUFFIX in t or MIDDLE in t or x[2] % 100 >= PLAIN_FROM else "spm" if x[3] % 100 < SPM_BELOW else "psm" for t, x in zip(rows, h)
            ]
            marked = np.array([k for k, f in enumerate(forms) if f != "plain"], dtype=np.int64)
            n = units.sizes
            cuts = np.sort(np.array([[h[k][0] % (int(n[k]) + 1), h[k][1] % (int(n[k]) + 1)] for k in marked], dtype=np.int64).reshape(-1, 2), axis=1)
            first, second = units.locate(marked, cuts[:, 0]), units.locate(marked, cuts[:, 1])
            outputs, prefix, middle = list(rows), [None] * len(rows), [None] * len(rows)
            for m, k in enumerate(marked):
                outputs[k] = rearranged(forms[k], rows[k], int(first[m]), int(second[m]))
                prefix[k], middle[k] = int(cuts[m, 0]), int(cuts[m, 1] - cuts[m, 0])
            yield pa.RecordBatch.from_arrays(
                [ids.slice(i, j - i), pa.array(n, pa.int64()), pa.array(forms), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(outputs, pa.binary()).cast(pa.string())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )


def fill_in_middle(docs: DataFrame, seed: int = 1, chunk: int = CHUNK) -> DataFrame:
    """docs: doc_id, text. doc_id, n (code points), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output.

    The cuts and the form come from seed and id alone, so reruns and repeated rows agree; a null id draws like an empty one.
    A null text is empty; empty texts and those that hold a marker stay plain. Other columns of docs are left out.
    """
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), lambda b: _transform(b, seed, chunk), schema)


def _restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        forms, outputs = batch.column(batch.schema.get_field_index("form")), batch.column(batch.schema.get_field_index("output"))
        for i, j in text_slices(outputs):
            texts = [restored(f, o) for f, o in zip(forms.slice(i, j - i).to_pylist(), utf8(outputs, i, j))]
            kept = batch.slice(i, j - i)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(texts, pa.binary()).cast(pa.string())], [*kept.schema.names, "restored"])


def restore(transformed: DataFrame) -> DataFrame:
    """transformed (form, output and any other columns) with the exact text in front of the transformation as restored."""
    schema = StructType([*transformed.schema, StructField("restored", StringType())])
    return arrow_map(transformed, _restore, schema)


def sha256_text(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


ORACLE_SQL = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM base),
cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM cut),
made AS (
  SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS o FROM parts),
back AS (
  SELECT *, strpos(o, CASE form WHEN 'psm' THEN '<S>' ELSE '<P>' END) AS x, strpos(o, '<M>') AS y FROM made)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END::BIGINT AS middle_chars,
       sha256(o) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN o WHEN 'psm' THEN substr(o, 4, x - 4) || substr(o, y + 3) || substr(o, x + 3, y - x - 3)
                        ELSE substr(o, x + 3, y - x - 3) || substr(o, y + 3) || substr(o, 4, x - 4) END) AS restored_sha256
FROM back
"""
