"""Suffix-array dedup: every byte covered by a string of ``WINDOW`` bytes that also starts elsewhere goes.

A window's anchor is its ``GRAM``-byte gram of smallest hash (the leftmost of
equals), so equal windows have equal anchors at the same place. Windows that
follow each other on one anchor form a record: the anchor's key, a hash of the
bytes the windows cover (the context), and where the windows start. Keys that
occur once are done. For the others each different context is fetched once,
twice over if it occurs more than once, and the contexts of a key come together
in one task, where

* two-stage sorting makes the suffix array of up to ``PART`` bytes of contexts:
  only suffixes smaller than their successors are sorted directly, one scan of
  the buckets of first bytes induces all others;
* common prefixes of neighbours tell which windows occur at two places.

What is found for a context holds for every place of it. So a group of copies
is sorted as one or two texts however large it is, and only contexts that
differ take room. A key with more than ``GROUP`` different contexts (a common
passage in as many surroundings) isn't sorted in one task: its contexts are cut
into ever shorter pieces, down to single windows, which are compared by hashes.

Rows are told apart by two hashes of id and text. Two rows alike in both are
two documents, so they remove each other; nulls count as empty texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, park, text_slices, utf8

WINDOW, GRAM = 400, 32
GROUP = 512
PART = 1 << 20
PIECE = 1 << 22  # window starts looked at together; longer texts are cut here, at the price of contexts that end early
_BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15

RECORD = "r1 long, r2 long, key long, ctx long, width int, n long, starts array<long>, sizes array<long>"
CONTEXT = "key long, ctx long, twice boolean, big boolean, width int, body binary"
FOUND = "key long, ctx long, at array<int>, len array<int>"


def two_stage_suffix_array(data: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Suffixes of data (bytes) in the order of their first depth bytes; the end of data is smaller than any byte.

    wanted marks the suffixes asked for (else all). Those that they are induced from, up to the next one that is sorted
    directly, are in the result as well; no others are looked at.

    A suffix that is smaller than its successor is sorted directly. Any other begins with a byte not below that of its
    successor, so when the buckets of first bytes are read from the smallest on, each suffix read puts the one before it
    behind those already in its bucket. Within a bucket these come first, those of longer runs of its byte later.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    heads = np.concatenate([[0], np.flatnonzero(data[1:] != data[:-1]) + 1])
    rises = np.zeros(len(heads), dtype=bool)
    rises[:-1] = data[heads[1:]] > data[heads[:-1]]
    smaller = np.repeat(rises, np.diff(np.append(heads, n)))
    needed = np.ones(n, dtype=bool)
    if wanted is not None:
        sorted_ones = np.append(np.flatnonzero(smaller), n - 1)
        change = np.zeros(n + 1, dtype=np.int32)
        asked = np.flatnonzero(wanted)
        np.add.at(change, asked, 1)
        np.add.at(change, sorted_ones[np.searchsorted(sorted_ones, asked)] + 1, -1)
        needed = np.cumsum(change[:-1]) > 0
    direct = np.flatnonzero(smaller & needed)
    pairs = data[direct].astype(np.uint16) << 8 | data[direct + 1]
    order = np.argsort(pairs, kind="stable")
    direct, pairs = direct[order], pairs[order]
    text = data.tobytes()
    edges = np.flatnonzero(np.diff(pairs)) + 1
    for a, b in zip(np.concatenate([[0], edges]).tolist(), np.append(edges, len(direct)).tolist()):
        if b - a > 1:
            direct[a:b] = sorted(direct[a:b].tolist(), key=lambda p: text[p : p + depth])
    limits = np.searchsorted(pairs >> 8, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if needed[n - 1]:
        waiting[data[n - 1]].append(np.array([n - 1]))
    buckets = []
    for c in range(256):
        level = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, dtype=np.int64)
        waiting[c] = []
        mine = []
        while len(level):
            mine.append(level)
            before = level[level > 0] - 1
            level = before[(data[before] == c) & needed[before]]
        mine.append(direct[limits[c] : limits[c + 1]])
        bucket = np.concatenate(mine)
        if not len(bucket):
            continue
        buckets.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[(data[before] > c) & needed[before]]
        first = data[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        edges = np.flatnonzero(np.diff(first)) + 1
        for part in np.split(before, edges) if len(before) else ():
            waiting[data[part[0]]].append(part)
    return np.concatenate(buckets) if buckets else np.zeros(0, dtype=np.int64)


def adjacent_prefixes(data: np.ndarray, suffixes: np.ndarray, limit: int, rows: int = 8192, block: int = 80) -> np.ndarray:
    """Common prefix of each suffix with the next one, up to limit bytes. No suffix may end before limit bytes."""
    out = np.full(max(0, len(suffixes) - 1), limit, dtype=np.int64)
    if not len(out):
        return out
    views = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(block, dtype=np.uint8)]), block)
    for i in range(0, len(out), rows):
        alive = np.arange(i, min(i + rows, len(out)))
        for k in range(0, limit, block):
            same = views[suffixes[alive] + k] == views[suffixes[alive + 1] + k]
            whole = same.all(axis=1)
            ended = alive[~whole]
            out[ended] = np.minimum(limit, k + np.argmin(same[~whole], axis=1))
            alive = alive[whole]
            if not len(alive):
                break
    return out


def repeated_windows(contexts: list[tuple[bytes, int, bool]], window: int = WINDOW) -> list[np.ndarray]:
    """contexts: body, number of windows (they start at its first bytes), whether it stands at two places. The starts of windows that also start elsewhere."""
    bodies = [body for body, _, twice in contexts for _ in range(2 if twice else 1)]
    lengths = np.array([len(b) for b in bodies])
    begins = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]  # a byte that no UTF-8 holds stands between
    data = np.frombuffer(b"\xff".join(bodies), dtype=np.uint8)
    widths = np.array([width for _, width, twice in contexts for _ in range(2 if twice else 1)])
    starts = np.zeros(len(data) + 1, dtype=np.int32)
    np.add.at(starts, begins, 1)
    np.add.at(starts, begins + widths, -1)
    valid = np.cumsum(starts[:-1]) > 0
    suffixes = two_stage_suffix_array(data, window, valid)
    suffixes = suffixes[valid[suffixes]]
    equal = adjacent_prefixes(data, suffixes, window) >= window
    twofold = np.zeros(len(data), dtype=bool)
    twofold[suffixes[:-1][equal]] = True
    twofold[suffixes[1:][equal]] = True
    out, k = [], 0
    for _, width, twice in contexts:
        out.append(np.flatnonzero(twofold[begins[k] : begins[k] + width]))
        k += 2 if twice else 1
    return out


def _runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and lengths of the runs of consecutive numbers."""
    cut = np.flatnonzero(np.diff(at) != 1) + 1
    begins = np.concatenate([[0], cut])
    return at[begins], np.diff(np.append(begins, len(at)))


def _gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of the gram bytes (a power of two) from each position on."""
    h, base, span = data.astype(np.uint64) + np.uint64(1), _BASE, 1
    while span < gram:
        h = h[:-span] * np.uint64(base) + h[span:]
        base, span = base * base % (1 << 64), span * 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def anchors(data: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """For each window of data the position of its anchor, and the anchor's hash."""
    count, spots = len(data) - window + 1, window - gram + 1
    where, keys = np.empty(max(count, 0), dtype=np.int64), np.empty(max(count, 0), dtype=np.int64)
    for b in range(0, count, _BLOCK):
        size = min(_BLOCK, count - b)
        h = _gram_hashes(data[b : b + size + window - 1], gram)
        low = (h & ~np.uint64(0x1FFFFF)) | np.arange(len(h), dtype=np.uint64)  # smallest hash, then leftmost
        span = 1
        while span * 2 <= spots:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        low = np.minimum(low[:size], low[spots - span : spots - span + size]) & np.uint64(0x1FFFFF)
        where[b : b + size] = low.astype(np.int64) + b
        keys[b : b + size] = h[low.astype(np.int64)].view(np.int64)
    return where, keys


def _cut_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["r1", "r2", "key", "ctx", "width", "n", "starts", "sizes"]
    for batch in batches:
        texts = batch.column(2)
        for i, j in text_slices(texts):
            rows = utf8(texts, i, j)
            data = b"".join(rows)
            ends = np.cumsum([len(r) for r in rows]).astype(np.int64)
            for b in range(0, max(0, len(data) - WINDOW + 1), PIECE):
                piece = np.frombuffer(data, dtype=np.uint8)[b : b + PIECE + WINDOW - 1]
                where, keys = anchors(piece)
                owner = np.searchsorted(ends, np.arange(b, b + len(where)), side="right")
                inside = np.arange(b, b + len(where)) + WINDOW <= ends[np.minimum(owner, len(ends) - 1)]
                turn = np.ones(len(where), dtype=bool)
                turn[1:] = (where[1:] != where[:-1]) | (owner[1:] != owner[:-1])
                first = np.flatnonzero(turn & inside)
                if not len(first):
                    continue
                stop = np.append(np.flatnonzero(turn), len(where))
                width = np.searchsorted(np.flatnonzero(~inside), first)
                outside = np.append(np.flatnonzero(~inside), len(where))
                width = np.minimum(stop[np.searchsorted(stop, first, side="right")], outside[width]) - first
                view = memoryview(data)
                digest = xxhash.xxh3_64_intdigest
                ctx = np.array([digest(view[s : s + w + WINDOW - 1]) for s, w in zip((first + b).tolist(), width.tolist())], dtype=np.uint64).view(np.int64)
                row, key = owner[first], keys[first]
                order = np.lexsort((first, ctx, key, row))
                first, width, ctx, key, row = first[order] + b, width[order], ctx[order], key[order], row[order]
                new = np.ones(len(first), dtype=bool)
                new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1]) | (ctx[1:] != ctx[:-1])
                joined = np.zeros(len(first), dtype=bool)
                joined[1:] = ~new[1:] & (first[1:] == first[:-1] + width[:-1])
                heads, spans = np.flatnonzero(new), np.flatnonzero(~joined)
                sizes = np.add.reduceat(width, spans)
                offsets = pa.array(np.append(np.searchsorted(spans, heads), len(spans)), pa.int32())
                at = first[spans] - (ends[row[spans]] - np.array([len(rows[r]) for r in row[spans].tolist()]))
                picked = pa.array(row[heads] + i)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(picked), batch.column(1).take(picked), pa.array(key[heads]), pa.array(ctx[heads]), pa.array(width[heads], pa.int32()),
                        pa.array(np.diff(np.append(heads, len(first))), pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(at, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(sizes, pa.int64())),
                    ],
                    names,
                )


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, needs: the contexts that the needs name, for each row once."""
    schema = pa.schema([("key", pa.int64()), ("ctx", pa.int64()), ("twice", pa.bool_()), ("big", pa.bool_()), ("width", pa.int32()), ("body", pa.binary())])
    for batch in batches:
        texts, needs = batch.column(0), batch.column(1)
        for i, j in text_slices(texts):
            rows, wanted = utf8(texts, i, j), needs.slice(i, j - i)
            flat = wanted.flatten()
            owner = np.repeat(np.arange(j - i), np.asarray(wanted.value_lengths()))
            starts, widths = flat.field("start").to_pylist(), flat.field("width").to_pylist()
            bodies = [rows[r][s : s + w + WINDOW - 1] for r, s, w in zip(owner.tolist(), starts, widths)]
            for k in range(0, len(bodies), 4096):
                f = flat.slice(k, 4096)
                yield pa.RecordBatch.from_arrays([f.field("key"), f.field("ctx"), f.field("twice"), f.field("big"), f.field("width"), pa.array(bodies[k : k + 4096], pa.binary())], schema=schema)


def _found_batch(keys: list[int], ctxs: list[int], windows: list[np.ndarray]) -> pa.RecordBatch:
    kept = [(k, c, *_runs(w)) for k, c, w in zip(keys, ctxs, windows) if len(w)]
    lists = [pa.array([x[m].tolist() for x in kept], pa.list_(pa.int32())) for m in (2, 3)]
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in kept], pa.int64()), pa.array([x[1] for x in kept], pa.int64()), *lists], ["key", "ctx", "at", "len"])


def _sort_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts ordered by key: whole keys are gathered up to PART bytes and sorted together."""
    keys, ctxs, contexts, held = [], [], [], 0
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in (0, 1, 2, 4, 5)]
        for key, ctx, twice, width, body in zip(*columns):
            if keys and key == keys[-1] and ctx == ctxs[-1]:
                continue  # of a row that is there twice
            if held >= PART and key != keys[-1]:
                yield _found_batch(keys, ctxs, repeated_windows(contexts))
                keys, ctxs, contexts, held = [], [], [], 0
            keys.append(key)
            ctxs.append(ctx)
            contexts.append((body, width, twice))
            held += len(body) * (1 + twice)
    if keys:
        yield _found_batch(keys, ctxs, repeated_windows(contexts))


def _cut_finer(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[pa.RecordBatch]:
    """Contexts or pieces of such, cut where the distance of a window's start from its anchor is a multiple of step.

    kin1, kin2: a hash of the bytes that all windows of such a piece share, c: of the piece.
    """
    for batch in batches:
        out = []
        for key, ctx, at, anchor, weight, width, body in zip(*(c.to_pylist() for c in batch.columns)):
            if anchor < 0:
                anchor = int(anchors(np.frombuffer(body, dtype=np.uint8))[0][0])
            for g in range((anchor - width + 1) // step, anchor // step + 1):
                first, last = max(0, anchor - (g + 1) * step + 1), min(width - 1, anchor - g * step)
                core = body[anchor - g * step : anchor - (g + 1) * step + 1 + WINDOW] if step > 1 else body[first : first + WINDOW]
                piece = body[first : last + WINDOW]
                kin = np.frombuffer(xxhash.xxh3_128_digest(core, g), dtype=np.int64)
                out.append((key, ctx, at + first, anchor - first, weight, last - first + 1, piece, int(kin[0]), int(kin[1]), xxhash.xxh3_64_intdigest(piece, last - first) - (1 << 63)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _PIECE_TYPES)], [n for n, _ in _PIECE])


_PIECE = [("key", "long"), ("ctx", "long"), ("at", "int"), ("anchor", "int"), ("weight", "long"), ("width", "int"), ("body", "binary"), ("kin1", "long"), ("kin2", "long"), ("c", "long")]
_PIECE_TYPES = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[t] for _, t in _PIECE]
FINER = (48, 6, 1)


def _row_hashes(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("r1"), F.xxhash64(F.lit("row"), text, "doc_id").alias("r2"))


def repeats(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. r1, r2 (a row's hashes), starts, sizes: runs of window starts whose windows also start elsewhere."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = _row_hashes(docs)
    records = park(arrow_map(named.select("r1", "r2", "text"), _cut_records, RECORD), "suffix-records")
    again = records.groupBy("key").agg(F.sum("n").alias("total")).where(F.col("total") > 1).select("key")
    places = park(records.join(again, "key", "left_semi"), "suffix-places")
    place = F.struct("r1", "r2", F.col("starts")[0].alias("start"), "width")
    contexts = places.groupBy("key", "ctx").agg((F.sum("n") > 1).alias("twice"), F.min(place).alias("p"))
    many = contexts.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > GROUP).select(F.col("key").alias("big_key"))
    contexts = contexts.join(many, F.col("key") == F.col("big_key"), "left").select("key", "ctx", "twice", F.col("big_key").isNotNull().alias("big"), "p.*")
    needs = contexts.groupBy("r1", "r2").agg(F.collect_list(F.struct("key", "ctx", "twice", "big", "start", "width")).alias("needs"))  # no more than a text has
    fetched = park(arrow_map(named.join(needs, ["r1", "r2"]).select("text", "needs"), _fetch, CONTEXT), "suffix-contexts")
    grouped = fetched.where(~F.col("big")).repartition(parts, "key").sortWithinPartitions("key", "ctx")
    found = arrow_map(grouped, _sort_groups, FOUND).unionByName(_by_finer_pieces(fetched.where("big").dropDuplicates(["key", "ctx"])))
    # what holds for a context holds at each of its places; where not all of its windows are found, it has one place
    hits = places.join(found, ["key", "ctx"])
    everywhere = (F.size("at") == 1) & (F.col("len")[0] == F.col("width"))
    starts = F.when(everywhere, F.col("starts")).otherwise(F.transform("at", lambda t: F.col("starts")[0] + t))
    sizes = F.when(everywhere, F.col("sizes")).otherwise(F.transform("len", lambda n: n.cast("long")))
    hits = hits.select("r1", "r2", starts.alias("starts"), sizes.alias("sizes"))
    return hits.groupBy("r1", "r2").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("sizes")).alias("sizes"))


def _by_finer_pieces(contexts: DataFrame) -> DataFrame:
    """The same as the sorted groups give, for keys of any number of contexts.

    Contexts are cut into pieces of a few neighbouring windows. A piece whose shared bytes occur once goes; one that
    occurs as a whole again is found, and stays once for others to be compared with; what is left matches others in part
    and is cut finer, down to single windows. So a passage in many surroundings costs some pieces at its edges.
    """
    name = [n for n, _ in _PIECE]
    pending = contexts.select("key", "ctx", F.lit(0).alias("at"), F.lit(-1).alias("anchor"), F.when(F.col("twice"), 2).otherwise(1).cast("long").alias("weight"), "width", "body")
    found = None
    for step in FINER:
        cut = park(arrow_map(pending.select(*name[:7]), lambda b, step=step: _cut_finer(b, step), ", ".join(f"{n} {t}" for n, t in _PIECE)), "suffix-pieces")
        alike = cut.groupBy("kin1", "kin2", "c").agg(F.sum("weight").alias("total"), F.min(F.struct("key", "ctx", "at")).alias("first"))
        kin = alike.groupBy("kin1", "kin2").agg(F.sum("total").alias("kin_total"), F.min("c").alias("low"), F.max("c").alias("high")).where(F.col("kin_total") > 1)
        told = alike.join(kin, ["kin1", "kin2"]).select("kin1", "kin2", "c", "total", "first", (F.col("low") < F.col("high")).alias("mixed"))
        judged = cut.join(told, ["kin1", "kin2", "c"])
        whole = judged.where(F.col("total") > 1).select("key", "ctx", "at", F.col("width").alias("len"))
        found = whole if found is None else found.unionByName(whole)
        pending = judged.where(F.col("mixed") & ((F.col("total") == 1) | (F.col("first") == F.struct("key", "ctx", "at"))))
    each = F.array_sort(F.collect_list(F.struct("at", "len")), lambda x, y: x["at"] - y["at"])
    return found.groupBy("key", "ctx").agg(each.alias("runs")).select("key", "ctx", *_joined(F.col("runs")))


def _joined(runs: Column) -> tuple[Column, Column]:
    """Neighbouring or overlapping runs as one, so that a context whose windows are all found is told by one run."""
    none = F.array().cast("array<struct<at:int,len:int>>")

    def add(done: Column, run: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(last["at"].alias("at"), (F.greatest(last["at"] + last["len"], run["at"] + run["len"]) - last["at"]).alias("len"))
        meets = F.coalesce(last["at"] + last["len"] >= run["at"], F.lit(False))
        return F.when(meets, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(run)))

    merged = F.aggregate(runs, none, add)
    return F.transform(merged, lambda r: r["at"]).alias("at"), F.transform(merged, lambda r: r["len"]).alias("len")


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1)
        for i, j in text_slices(texts):
            rows, kept, spans = utf8(texts, i, j), [], []
            starts, sizes = batch.column(2).slice(i, j - i).to_pylist(), batch.column(3).slice(i, j - i).to_pylist()
            for text, s, z in zip(rows, starts, sizes):
                if not s:
                    kept.append(text)
                    spans.append(0)
                    continue
                change = np.zeros(len(text) + 1, dtype=np.int32)
                begin = np.array(s)
                np.add.at(change, begin, 1)
                np.add.at(change, begin + np.array(z) + WINDOW - 1, -1)
                gone = np.cumsum(change[:-1]) > 0
                kept.append(np.frombuffer(text, dtype=np.uint8)[~gone].tobytes())
                spans.append(int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1])))
            n = [len(r) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array([a - len(k) for a, k in zip(n, kept)], pa.int64()), pa.array(spans, pa.int64()),
                    pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array(kept, pa.binary()),
                ],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text; other columns are left out. A row for each row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes, as a cut may part a character)."""
    found = repeats(docs)
    marked = _row_hashes(docs).join(found, ["r1", "r2"], "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "starts", "sizes")
    return arrow_map(marked, _keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
