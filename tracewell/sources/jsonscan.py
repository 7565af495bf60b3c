"""The parts of one large JSON document, found by many tasks.

A document of any size on one line is read in byte ranges: records end at a
closing brace, so a range (a block of the file) begins right behind one. What a
block means depends on what stands before it, and that is told by little:

1. the number of quotes in each block gives whether the next one begins inside
   a string;
2. each block's unmatched brackets, with the keys of those it opens, give the
   path on which the next one begins;
3. with both at hand a block gives the elements of the wanted containers that
   lie in it whole, and its share of the one that reaches over its edge.

Steps 1 and 2 bring one small row a block to the driver; texts stay in the tasks.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.shipping import ship
from tracewell.storage import park

# A string may end with the text at hand; then it goes on in the next.
_TOKEN = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*(?:"|\Z)|[{}\[\]:,]', re.S)
ROOT = "root"
FOUND = "kind string, path string, key string, block long, owner long, place long, text string"


class _Pieces:
    """Tokens of a text that comes in pieces; a string that a piece doesn't end is held back for the next."""

    def __init__(self, in_string: bool):
        self.carried, self.artificial = ('"', True) if in_string else ("", False)

    def tokens(self, text: str) -> Iterator[tuple[str, int, str]]:
        """Sets text and skip (what of text came before or isn't the document's), then gives each token's first character, place and itself."""
        self.text, self.skip, self.end = self.carried + text, int(self.artificial), len(self.carried) + len(text)
        self.carried = ""
        for m in _TOKEN.finditer(self.text):
            c = self.text[m.start()]
            if c == '"':
                if m.end() == len(self.text) and not _closed(m[0]):
                    self.carried, self.end = m[0], m.start()
                    return
                self.artificial = False
            yield c, m.start(), m[0]
        self.artificial = False


class Scanner:
    """Reads a block's text piece by piece; stack holds the brackets open before it, each with its key.

    rows gets kind, path, key, place and text of what is found; see ``scan``.
    """

    def __init__(self, containers: frozenset[str], stack: list[tuple[str, str | None]], in_string: bool = False):
        self.containers, self.stack, self.pieces = containers, list(stack), _Pieces(in_string)
        self.commas: dict[str, int] = {}
        self.rows: list[tuple[str, str, str | None, int, str | None]] = []
        self.key = self.last = None
        # how many brackets are open inside the element at hand, what of it was read before, and its path, key and place
        self.element, self.parts, self.named = None, [], ("", None, -1)
        for depth in range(3, len(self.stack) + 1):
            if self._path(depth - 1) in containers and self._path(depth) not in containers:
                self.element = depth
                break

    def _path(self, depth: int) -> str:
        return ".".join(k or "" for _, k in self.stack[1:depth])

    def feed(self, text: str) -> None:
        begin = None
        for c, at, token in self.pieces.tokens(text):
            begin = self.pieces.skip if begin is None else begin
            if c == '"':
                self.last = token
            elif c in "{[":
                if self._opens_element(c):
                    begin = at
            elif c in "}]":
                if self.element == len(self.stack):
                    path, key, place = self.named
                    self.rows.append(("element" if path else "edge", path, key, place, "".join(self.parts) + self.pieces.text[begin : at + 1]))
                    self.element, self.parts = None, []
                self.stack.pop()
                self.key = None
            elif self.element is None:
                if c == ":":
                    self.key = _loaded(self.last)
                    if len(self.stack) == 1 and not self.pieces.text[at + 1 : at + 40].lstrip().startswith("null"):
                        self.rows.append(("key", ROOT, self.key, 0, None))
                else:
                    self.key = None
                    path = self._path(len(self.stack))
                    if path in self.containers:
                        self.commas[path] = self.commas.get(path, 0) + 1
        if self.element is not None:
            self.parts.append(self.pieces.text[self.pieces.skip if begin is None else begin : self.pieces.end])

    def _opens_element(self, bracket: str) -> bool:
        path, key, self.key = self._path(len(self.stack)), self.key, None
        self.stack.append((bracket, key))
        if self.element is not None:
            return False
        here = self._path(len(self.stack))
        if len(self.stack) > 1 and key is not None and here in self.containers:
            self.rows.append(("container", here, None, 0, None))
            return False
        if len(self.stack) < 3 or path not in self.containers:
            return False
        self.element, self.parts, self.named = len(self.stack), [], (path, key, self.commas.get(path, 0))
        return True

    def finish(self) -> None:
        if self.element is not None:
            path, key, place = self.named
            rest = self.pieces.carried[int(self.pieces.artificial) :]
            self.rows.append(("edge", path, key, place, "".join(self.parts) + rest))
        self.rows += [("commas", path, None, n, None) for path, n in self.commas.items()]


def _closed(token: str) -> bool:
    """Whether a string token that reaches the end of the text ends with its quote."""
    if len(token) < 2 or token[-1] != '"':
        return False
    body = token[1:-1]
    return (len(body) - len(body.rstrip("\\"))) % 2 == 0


def _loaded(token: str | None) -> str | None:
    try:
        return json.loads(token) if token else None
    except ValueError:
        return None  # the key began in an earlier block: no key of a wanted path does


def _texts(batches: Iterator[pa.RecordBatch], bare: int | None) -> Iterator[tuple[int, str]]:
    """Block and text, with the braces back that ended the records; none ended the last record of block bare."""
    held = None
    for batch in batches:
        blocks, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        begin = 0
        for k in range(1, len(blocks) + 1):
            if k == len(blocks) or blocks[k] != blocks[begin]:
                if held:
                    yield held[0], held[1] + ("" if held[0] == bare != blocks[begin] else "}")
                held = blocks[begin], "}".join(values[begin:k])
                begin = k
    if held:
        yield held[0], held[1] + ("" if held[0] == bare else "}")


def records(spark: SparkSession, path: str) -> DataFrame:
    """block, value, file, size: the document up to each closing brace, by blocks of the file."""
    text = spark.read.option("lineSep", "}").text(path)
    return text.select(F.col("_metadata.file_block_start").alias("block"), "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))


def scan(spark: SparkSession, path: str, containers: list[str]) -> DataFrame:
    """The elements of containers (dotted paths of keys) in one JSON document whose root is an object.

    kind "element": path, key (null in lists), place (in its container, from 0) and text of each element that is an
    object or a list; "container": a container that is there; "key": a key of the root whose value isn't null. Raises
    ValueError where brackets or quotes don't match. One file; its keys on wanted paths occur once and hold no braces.
    """
    wanted = frozenset(containers)
    pieces = records(spark, path)
    bare = F.regexp_replace("value", r"\\.", "")
    odd = F.sum(F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit("")))) % 2
    read = F.sum(F.octet_length("value") + 1)
    blocks = pieces.groupBy("block").agg(odd.alias("odd"), read.alias("read"), F.min("file").alias("low"), F.max("file").alias("high"), F.max("size").alias("size")).orderBy("block").collect()
    if not blocks:
        raise ValueError("the document is empty")
    if len({f for r in blocks for f in (r.low, r.high)}) > 1:
        raise ValueError("the document is in several files")
    # a last record that no brace ends: the space behind the document
    bare_end = blocks[-1].block if sum(r.read for r in blocks) > blocks[-1].size else None
    inside, parity = {}, 0
    for r in blocks:
        inside[r.block] = bool(parity)
        parity ^= int(r.odd)
    if parity:
        raise ValueError("a string doesn't end")
    pieces = pieces.select("block", "value")
    ship(spark)

    def brackets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, at = {}, None
        for block, text in _texts(batches, bare_end):
            s = found.get(block)
            if s is None:
                s = found[block] = _Brackets(inside[block])
            s.feed(text)
        for at, s in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([s.closes]), pa.array([json.dumps(s.stack)])], ["block", "closes", "opens"])

    stacks, owners, stack, owner = {}, {}, [], None
    for r in sorted(pieces.mapInArrow(brackets, "block long, closes long, opens string").collect(), key=lambda r: r.block):
        stacks[r.block], owners[r.block] = list(stack), owner
        if r.closes > len(stack):
            raise ValueError("a bracket closes that none opened")
        element = Scanner(wanted, stack).element
        runs_on = element is not None and len(stack) - r.closes >= element
        stack = [*stack[: len(stack) - r.closes], *map(tuple, json.loads(r.opens))]
        owner = owner if runs_on else r.block
    if stack:
        raise ValueError("a bracket isn't closed")

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanners: dict[int, Scanner] = {}
        for block, text in _texts(batches, bare_end):
            s = scanners.get(block)
            if s is None:
                s = scanners[block] = Scanner(wanted, stacks[block], inside[block])
            s.feed(text)
            if s.rows:
                yield _rows(block, owners[block], s)
        for block, s in scanners.items():
            s.finish()
            if s.rows:
                yield _rows(block, owners[block], s)

    found = park(pieces.mapInArrow(elements, FOUND), "json-elements")
    return _placed(found)


class _Brackets:
    """What a block closes and leaves open, told without knowing where it stands."""

    def __init__(self, in_string: bool):
        self.pieces, self.closes, self.stack = _Pieces(in_string), 0, []
        self.last = self.key = None

    def feed(self, text: str) -> None:
        for c, _, token in self.pieces.tokens(text):
            if c == '"':
                self.last = token
                continue
            if c in "{[":
                self.stack.append((c, _loaded(self.key)))
            elif c in "}]" and self.stack:
                self.stack.pop()
            elif c in "}]":
                self.closes += 1
            self.key = self.last if c == ":" else None


def _rows(block: int, owner: int | None, s: Scanner) -> pa.RecordBatch:
    rows, s.rows = s.rows, []
    # an edge without a path goes on with what an earlier block began; one with a path begins here
    columns = [(kind, path, key, block, None if kind != "edge" else block if path else owner, place, text) for kind, path, key, place, text in rows]
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*columns), types)], [f.split()[0] for f in FOUND.split(", ")])


def _placed(found: DataFrame) -> DataFrame:
    """Edges put together, and places counted from the beginning of the container."""
    shares = found.where("kind = 'edge'").groupBy("owner").agg(
        F.max(F.when(F.col("path") != "", F.struct("path", "key", "block", "place"))).alias("h"), F.array_sort(F.collect_list(F.struct("block", "text"))).alias("parts")
    )
    whole = shares.select(F.lit("element").alias("kind"), "h.path", "h.key", "h.block", "h.place", F.array_join("parts.text", "").alias("text"))
    rows = found.where("kind <> 'edge' AND kind <> 'commas'").select("kind", "path", "key", "block", "place", "text").unionByName(whole)
    # a row a block and container, so the sums are short
    commas = found.where("kind = 'commas'").groupBy("path", F.col("block").alias("b")).agg(F.sum("place").alias("n"))
    blocks = found.select("path", F.col("block").alias("at")).where("path <> ''").distinct()
    before = blocks.join(commas.withColumnRenamed("path", "p"), (F.col("path") == F.col("p")) & (F.col("b") < F.col("at")), "left").groupBy("path", "at").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("before"))
    placed = rows.join(before.withColumnRenamed("path", "p"), (F.col("path") == F.col("p")) & (F.col("block") == F.col("at")), "left")
    return placed.select("kind", "path", "key", (F.col("place") + F.coalesce("before", F.lit(0))).alias("place"), "text")
