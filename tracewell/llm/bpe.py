"""BPE encoding and decoding by a token automaton.

``compile_automaton`` applies the merges in order. Each merge (u, v) -> w is a
gadget on the automaton that accepts correct token sequences: the state reached
by u is cloned without its arc v, every state with an arc u gains an arc w, and
w leads where v led. At any time all arcs of one label end in one state, so a
state is named by the token just read, and it differs from the state of that
token's right half only by the arcs its own merges took away. The compiled table
keeps these arcs with the rank at which they were taken, as flat keys of state and
token; an arc t out of state s is open unless, down the right halves of s and
the left halves of t, some merge came before the token above it was made (in the
gadget of v = u itself the arc is taken away first, so w is not added where u is
gone).

A word is read from left to right. After each symbol exactly one state can have
been reached, as every start of a word has one correct tokenization: the token
that ends here and whose arc is open in the state where it begins. So a run is
deterministic, with a table look-up for each token that ends at a place, and its
path is read off backwards. Decoding emits the labels of the ids in turn.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, text_slices, utf8

CACHE_WORDS, CACHE_BYTES, CACHED_LENGTH = 200_000, 24 << 20, 64  # for a generation of a cache; longer words are not kept
TABLE_ARCS = 1_500_000  # looked-up transitions kept
_NEVER = 1 << 60
_BITS = 20  # of a token in a key of the table
# The pre-splitter's classes over Latin letters below U+0250, which no normal form changes; U+0130 lowers to two characters.
_LATIN = re.compile(r"[\x00-\u012f\u0131-\u024f]*")
_SPACES = "\\x09-\\x0d\\x20\\x85\\xa0"


class Cache:
    """A dict of bounded size, in entries and bytes, in two generations: what was used since the last turn survives the next."""

    def __init__(self, size: int, limit: int = CACHE_BYTES):
        self.size, self.limit, self.held, self.young, self.old = size, limit, 0, {}, {}

    def get(self, key):
        value = self.young.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(key) > CACHED_LENGTH:
            return
        if len(self.young) >= self.size or self.held >= self.limit:
            self.old, self.young, self.held = self.young, {}, 0
        self.held += len(key) + 8 * len(value)
        self.young[key] = value


@dataclass
class Automaton:
    ids: dict[str, int]  # of the tokens that the merges build
    labels: list[str]
    left: list[int]
    right: list[int]
    made: list[int]  # rank of the merge that made the token, -1 for a base symbol
    removed: dict[int, int]  # state << _BITS | token -> rank of the merge that took the arc away
    suffix: str
    longest: int = 1  # symbols of the longest token
    table: dict[int, bool] = field(default_factory=dict)  # transitions looked up so far

    def open(self, state: int, token: int) -> bool:
        """Whether the state reached by one token has an arc for the next."""
        known = self.table.get(state << _BITS | token)
        if known is None:
            if len(self.table) >= TABLE_ARCS:
                self.table.clear()
            known = self.table[state << _BITS | token] = self.compiled(state, token)
        return known

    def compiled(self, state: int, token: int) -> bool:
        """What the compiled table says of an arc."""
        removed, made, left, right = self.removed, self.made, self.left, self.right
        before_state = _NEVER
        while state >= 0:
            t, before_token, row = token, _NEVER, state << _BITS
            while t >= 0:
                rank = removed.get(row | t)
                if rank is not None and rank < before_state and rank <= before_token:
                    return False
                before_token, t = made[t], left[t]
            before_state, state = made[state], right[state]
        return True

    def encode_word(self, symbols: str) -> list[int]:
        """Ids of the only accepted path over the symbols, the last of which carries the suffix.

        Symbols without a token are left out, as there is no unknown token.
        """
        n, suffix = len(symbols), self.suffix
        ids, opens, known, longest = self.ids.get, self.open, self.table.get, self.longest
        whole = ids(symbols + suffix)
        if whole is not None:  # a token is the accepted path over its own symbols
            return [whole]
        states, begins = [-1] * (n + 1), [0] * (n + 1)  # the state at each place and where its token begins
        for end in range(1, n + 1):
            ending = symbols if end < n else symbols + suffix
            stop = end if end < n else len(ending)
            for begin in range(end - longest if end > longest else 0, end):
                token = ids(ending[begin:stop])
                if token is not None:
                    if begin:
                        state = states[begin]
                        free = known(state << _BITS | token)
                        if not (opens(state, token) if free is None else free):
                            continue
                    states[end], begins[end] = token, begin
                    break
            else:
                return self._encode_known(symbols)
        path = []
        while n:
            path.append(states[n])
            n = begins[n]
        return path[::-1]

    def _encode_known(self, symbols: str) -> list[int]:
        """For words with symbols outside the vocabulary: the known symbols, each for itself."""
        n, ids = len(symbols), self.ids
        known = [s + (self.suffix if i == n - 1 else "") in ids for i, s in enumerate(symbols)]
        if all(known):
            raise ValueError("no accepted path: the merges don't build every token from earlier ones")
        return [ids[s + (self.suffix if i == n - 1 else "")] for i, s in enumerate(symbols) if known[i]]


def compile_automaton(vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str) -> Automaton:
    """A merge whose arc is closed by then has no gadget, and its token is on no path; nor is a token that no merge builds."""
    size = max(vocab.values()) + 1
    labels = [""] * size
    for token, i in vocab.items():
        labels[i] = token
    bare = [t.removesuffix(suffix) if suffix else t for t in labels]
    auto = Automaton(vocab, labels, [-1] * size, [-1] * size, [-1] * size, {}, suffix)
    live = {i for i, t in enumerate(bare) if len(t) == 1}
    for rank, (first, second) in enumerate(merges):
        u, v, w = vocab[first], vocab[second], vocab.get(first + second)
        if w in live:
            raise ValueError(f"two merges build {first + second!r}")
        if w is None or u not in live or v not in live or not auto.compiled(u, v):
            continue
        auto.left[w], auto.right[w], auto.made[w] = u, v, rank
        auto.removed[u << _BITS | v] = rank
        live.add(w)
    auto.ids = {labels[i]: i for i in live}
    auto.longest = max(len(bare[i]) for i in live)
    return auto


class Codec:
    """A tokenizer file: its normalizer and pre-splitter, and the automaton compiled from its merges."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        unknown = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        if model.get("type", "BPE") != "BPE" or unknown:
            raise ValueError(f"not a plain BPE model: {model.get('type')}, {unknown}")
        self.tokenizer = Tokenizer.from_file(path)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = compile_automaton(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # The leftmost special token; of those that begin at one place the first in order.
        self.any_special = re.compile("|".join(map(re.escape, sorted(self.special))) or r"(?!)")
        # Every special token holds this mark, and array's unsigned int has the four bytes of the ids.
        self.latin_specials = all("<|" in t for t in self.special) and sys.byteorder == "little" and array("I").itemsize == 4
        labels = dict(enumerate(self.automaton.labels)) | {i: s for s, i in self.special.items()}
        self.labels = np.array([labels.get(i, "") for i in range(max(labels) + 1)], dtype=object)
        self.words, self.chunks = Cache(CACHE_WORDS), Cache(CACHE_WORDS)
        self.split = self._latin_splitter(spec)
        self.by_space = self.split is not None  # that file's pieces never cross white space
        self.plain_labels = spec.get("decoder") is None  # the library then joins labels by spaces

    def _latin_splitter(self, spec: dict):
        """A quick pre-splitter for Latin text, where the file has the normalizer and split that it knows."""
        steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        known = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        if steps != ["NFC", "Replace", "Lowercase"] or len(parts) != 2 or parts[0].get("pattern") != {"Regex": known} or parts[1]["type"] != "ByteLevel":
            return None
        import regex

        own = re.compile(known.replace(r"\p{L}", _latin_class(regex.compile(r"\p{L}"))).replace(r"\p{N}", _latin_class(regex.compile(r"\p{N}"))).replace(r"\s", _SPACES))
        shown = {b: piece[0] for b in range(128) for piece in [self._shown(chr(b))]}
        high = {chr(c): self._shown(chr(c)) for c in range(128, 0x250)}
        table = str.maketrans({**{chr(b): p for b, p in shown.items()}, **high})
        return lambda text: [p.translate(table) for p in own.findall(text.lower())]

    def _shown(self, character: str) -> str:
        """The byte-level symbols of a character."""
        from tokenizers.pre_tokenizers import ByteLevel

        return ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(character)[0][0]

    def _pieces(self, text: str) -> list[int]:
        if self.split and _LATIN.fullmatch(text):
            pieces = self.split(text)
        else:
            t = self.tokenizer
            clean = t.normalizer.normalize_str(text) if t.normalizer else text
            pieces = [p for p, _ in t.pre_tokenizer.pre_tokenize_str(clean)] if t.pre_tokenizer else [clean] * bool(clean)
        out: list[int] = []
        for piece in pieces:
            ids = self.words.get(piece)
            if ids is None:
                ids = self.automaton.encode_word(piece)
                self.words.put(piece, ids)
            out += ids
        return out

    def _chunk(self, chunk: bytes) -> bytes:
        text, out, at = chunk.decode(), [], 0
        if "<|" not in text and self.latin_specials:
            return array("I", self._pieces(text)).tobytes()
        for found in self.any_special.finditer(text):
            out += [*self._pieces(text[at : found.start()]), self.special[found[0]]]
            at = found.end()
        out += self._pieces(text[at:])
        return np.array(out, dtype="<u4").tobytes()

    def encode(self, text: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit integers. Where the file's pieces never cross white space, chunks between it are encoded alone."""
        if not self.by_space:
            return self._chunk(text)
        chunks, words = self.chunks, text.split()
        quick = chunks.young.get
        out = [quick(c) for c in words]
        if None in out:
            for k, ids in enumerate(out):
                if ids is None:
                    ids = chunks.get(words[k])
                    if ids is None:
                        ids = self._chunk(words[k])
                        chunks.put(words[k], ids)
                    out[k] = ids
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        labels = self.labels[np.frombuffer(ids, dtype="<u4")].tolist()
        return " ".join(labels) if self.plain_labels else self.tokenizer.decoder.decode(labels)


def _latin_class(pattern) -> str:
    """The characters below U+0250 that pattern matches, as the inside of a class."""
    return "".join(f"\\u{c:04x}" for c in range(0x250) if pattern.match(chr(c)))


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One compiled codec for each Python worker and file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def bpe_encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and ids (binary, little-endian unsigned 32-bit) of every whole text; null counts as empty.

    path is the tokenizer file, present on every node.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for i, j in text_slices(texts):
                ids = [c.encode(t) for t in utf8(texts, i, j)]
                n = pa.array([len(b) // 4 for b in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([keys.slice(i, j - i), n, pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, encode, "doc_id long, n_tokens long, ids binary")


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded (doc_id, n_tokens, ids) with decoded, the labels of the ids put together as the file's decoder does; null ids count as none."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for i, j in text_slices(batch.column(2)):
                part = batch.slice(i, j - i)
                decoded = [c.decode(b or b"") for b in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return arrow_map(encoded.select("doc_id", "n_tokens", "ids"), decode, "doc_id long, n_tokens long, ids binary, decoded string")
