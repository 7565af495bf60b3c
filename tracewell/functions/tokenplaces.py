"""Running sums over the tokens of a batch of texts, in numpy: what Spark's array functions can't give in linear time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

# Words that begin a part of a query.
PARTS = [
    "FROM", "JOIN", "ON", "USING", "SELECT", "WHERE", "GROUP", "ORDER", "HAVING", "QUALIFY", "WINDOW", "LIMIT", "UNION", "INTERSECT", "EXCEPT", "MINUS", "SET", "VALUES", "INTO", "WITH",
]
# Words behind which a name can stand for a table, or one that WITH defines.
_LEADS = ["FROM", "JOIN", ",", "INTO", "UPDATE", "USING", "TABLE", "EXISTS", "WITH", "RECURSIVE"]
_WORDS = pa.array(list(dict.fromkeys(["(", ")", ";", *PARTS, *_LEADS, "DISTINCT", "DELETE"])))
_CODES = {w: k for k, w in enumerate(_WORDS.to_pylist())}

SCRIPT_KINDS = ["literal", "operand", "open", "close", "join", "end"]
LITERAL, OPERAND, OPEN, CLOSE, JOIN, END = range(6)
LINE, PYTHON = 8, 16


def _rows(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of lists (a null one: 0), and the list each value belongs to."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return sizes, np.repeat(np.arange(len(sizes)), sizes)


def _running(step: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of step up to each value, of each list by itself."""
    total = np.cumsum(step)
    begin = np.cumsum(sizes) - sizes
    before = np.r_[0, total][begin]
    return total - np.repeat(before, sizes)


def _levels(row: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of values by list and depth that keeps theirs otherwise, and the level (list and depth) of each in it."""
    low = depth.min() if len(depth) else 0
    level = row * (int(depth.max()) - int(low) + 1 if len(depth) else 1) + (depth - low)
    order = np.argsort(level, kind="stable")
    return order, level[order]


def _last(values: np.ndarray, known: np.ndarray, level: np.ndarray, default: int) -> np.ndarray:
    """The last known value so far of the same level, or default."""
    at = np.maximum.accumulate(np.where(known, np.arange(len(known)), -1))
    return np.where((at >= 0) & (level[at] == level), values[at], default)


def place_codes(tokens: pa.ListArray) -> pa.ListArray:
    """For each token, in capitals, of each text: depth * 256, 128 if it stands behind one that may lead to a name, 64 if
    its parentheses (or the statement) hold a query, and the part it is in: 0 none, 1 none since the last ``(`` or ``;``,
    else two more than its index in PARTS.
    """
    sizes, row = _rows(tokens)
    code = pc.fill_null(pc.index_in(tokens.flatten(), value_set=_WORDS), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    opens, closes, ends = code == _CODES["("], code == _CODES[")"], code == _CODES[";"]
    depth = _running(opens.astype(np.int64) - closes, sizes)
    at = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    before = np.where(at > 0, np.r_[-1, code[:-1]] if len(code) else code, -1)
    extract = (code == _CODES["FROM"]) & (before == _CODES["DISTINCT"]) & (at > 1)  # IS DISTINCT FROM
    part = np.zeros(len(_WORDS) + 1, dtype=np.int64)
    part[[_CODES[p] for p in PARTS]] = np.arange(len(PARTS)) + 2
    part = np.where(opens | ends, 1, np.where(extract, 0, part[code]))
    asks = ends | np.isin(code, [_CODES["SELECT"], _CODES["DELETE"]])
    led = np.isin(before, [_CODES[w] for w in _LEADS])
    order, level = _levels(row, depth)
    out = np.empty(len(code), dtype=np.int64)
    if len(code):
        out[order] = _last(part[order], part[order] > 0, level, 0) + 64 * _last(asks[order].astype(np.int64), (opens | asks)[order], level, 1)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array((out + 128 * led + 256 * depth).astype(np.int32)))


def chain_indexes(kinds: pa.ListArray) -> pa.ListArray:
    """Of tokens of scripts the chains that hold a literal, each as the indexes of its literals, operands and openings.

    A value is an index of SCRIPT_KINDS, with LINE where a line ends before the token and PYTHON in Python.
    """
    sizes, row = _rows(kinds)
    value = kinds.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    kind, line, python = value & 7, (value & LINE) > 0, (value & PYTHON) > 0
    at = np.arange(len(kind)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    depth = _running((kind == OPEN).astype(np.int64) - (kind == CLOSE), sizes) - (kind == OPEN)
    line = line & python & (depth <= 0)
    # an opening also ends what stood before it one level deeper, so that two pairs of parentheses are two groups
    again = np.repeat(np.arange(len(kind)), 1 + (kind == OPEN))
    second = np.r_[False, again[1:] == again[:-1]] if len(again) else np.zeros(0, dtype=bool)
    order, level = _levels(row[again], depth[again] + second)
    source = again[order]
    k, lines, py = np.where(second[order], END, kind[source]), line[source], python[source]
    begins = np.r_[True, level[1:] != level[:-1]] if len(level) else np.zeros(0, dtype=bool)
    before = np.where(begins, -1, np.r_[-1, k[:-1]] if len(k) else k)
    joined = before == JOIN
    linked = np.select(
        [lines | (k == END), k == LITERAL, k == JOIN, k == OPERAND, k == OPEN],
        [False, joined | (py & (before == LITERAL)), np.isin(before, [LITERAL, OPERAND, CLOSE]), joined, np.isin(before, [JOIN, OPERAND, CLOSE])],
        True,
    )
    chain = np.cumsum(begins | ~linked) - 1
    says = np.bincount(chain[k == LITERAL], minlength=int(chain[-1]) + 1 if len(chain) else 0) > 0
    kept = np.isin(k, [LITERAL, OPERAND, OPEN]) & (says[chain] if len(chain) else False)
    chain, source = chain[kept], source[kept]
    starts = np.flatnonzero(np.r_[True, chain[1:] != chain[:-1]]) if len(chain) else np.zeros(0, dtype=np.int64)
    inner = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(chain)].astype(np.int32)), pa.array(at[source].astype(np.int32)))
    counts = np.bincount(row[source[starts]], minlength=len(sizes))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), inner)


@F.arrow_udf(ArrayType(IntegerType()))
def places(tokens: pa.Array) -> pa.Array:
    return place_codes(tokens)


@F.arrow_udf(ArrayType(ArrayType(IntegerType())))
def chains(kinds: pa.Array) -> pa.Array:
    return chain_indexes(kinds)
