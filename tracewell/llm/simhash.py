"""SimHash near-dedup by a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits; its embedding is the
vector of their bit counts. The Manhattan distance of two embeddings never
exceeds the Hamming distance of the fingerprints. Counts are written in unary
(0, 01, 11), so that the distance is the bit count of one XOR and a projection
of the grid is one AND.

Range join: within distance d, of g groups of segments at least g - d agree, so
two fingerprints meet in a cell of one of the C(g, d) projections onto g - d
groups. Inside a cell the Manhattan distance filters and the Hamming distance
verifies. A cell gives a spanning forest of its links, not its pairs; cells
above ``CELL`` members are dealt in pairs of blocks. Equal fingerprints are one
member throughout.

Near duplicates of the corpus (``keep_first``) are texts whose sets of five-word
shingles have a Jaccard similarity of 0.8 or more. Candidates are texts whose
fingerprints link as above. Fingerprints of pairs near 0.8 can differ in too many
bits for a projection, so texts that share one of ``BANDS`` hashes of ``ROWS``
MinHash values are candidates, too; a pair of similarity 0.8 fails to share one
with a probability of 0.0001. Whatever candidates connect is compared by the
sets themselves, in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, park, text_slices, utf8
from .graph import components

SEED, BITS, SEGMENTS = 42, 64, 32
CELL, FEW = 4096, 8
BANDS, ROWS = 30, 6
BLOCK, BLOCK_BYTES = 512, 16 << 20
_PAIRS = 0x5555555555555555


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, fp (64 bits as a long). Null, empty and blank texts have fingerprint 0; repeated shingles count each time."""

    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in text_slices(batch.column(1)):
                fps = fingerprint_texts(utf8(batch.column(1), i, j), words)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, fingerprint, "doc_id long, fp long")


def shingle_hashes(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of the shingles of all texts one after another, and the number of each text's. A text of fewer words is one shingle."""
    split = [t.lower().split() for t in texts]
    n = np.array([len(w) for w in split], dtype=np.int64)
    flat = [w for ws in split for w in ws]
    shingles = np.where(n >= words, n - words + 1, (n > 0).astype(int))
    if not flat:
        return np.zeros(0, dtype="<u8"), shingles
    joined = b" ".join(flat)
    sizes = np.fromiter(map(len, flat), dtype=np.int64, count=len(flat))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    offset = np.cumsum(n) - n
    upto = np.cumsum(shingles)
    first = np.arange(int(upto[-1])) + np.repeat(offset - (upto - shingles), shingles)
    last = first + np.repeat(np.minimum(n, words), shingles) - 1
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[first].tolist(), ends[last].tolist())], dtype="<u8"), shingles


def fingerprint_texts(texts: list[bytes], words: int) -> np.ndarray:
    return fold(*shingle_hashes(texts, words))


def fold(h: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """The fingerprint of each text from the hashes of its shingles."""
    fps = np.zeros(len(shingles), dtype=np.uint64)
    if not len(h):
        return fps
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    has = np.flatnonzero(shingles)
    counts = np.add.reduceat(bits, (np.cumsum(shingles) - shingles)[has], axis=0, dtype=np.int32)
    majority = counts * 2 > shingles[has][:, None]
    fps[has] = np.packbits(majority, axis=1, bitorder="little").view("<u8").ravel()
    return fps


def unary(fp: Column) -> Column:
    """The embedding: in each two-bit segment its bit count as 00, 01 or 11."""
    pairs = F.lit(_PAIRS)
    shifted = F.shiftrightunsigned(fp, 1)
    either, both = fp.bitwiseOR(shifted).bitwiseAND(pairs), fp.bitwiseAND(shifted).bitwiseAND(pairs)
    return either.bitwiseOR(F.shiftleft(both, 1))


def _unary(fp: np.ndarray) -> np.ndarray:
    pairs, one = np.uint64(_PAIRS), np.uint64(1)
    return ((fp | fp >> one) & pairs) | ((fp & fp >> one) & pairs) << one


def projections(groups: int, distance: int) -> list[int]:
    """Masks of the segments that all but ``distance`` of the groups hold, as signed longs."""
    edges = np.linspace(0, SEGMENTS, groups + 1).round().astype(int)
    masks = []
    for kept in combinations(range(groups), groups - distance):
        mask = sum(((1 << 2 * int(edges[g + 1])) - 1) ^ ((1 << 2 * int(edges[g])) - 1) for g in kept)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def grid_groups(n: int, distance: int) -> int:
    """Groups of segments such that n fingerprints leave about 64 in a cell; a segment of two bits tells 1.5 bits."""
    groups = distance + 2
    while groups < SEGMENTS and n > 64 * 2 ** (1.5 * SEGMENTS * (groups - distance) / groups):
        groups += 1
    return groups


def _linked(fp: np.ndarray, u: np.ndarray, a, b, distance: int) -> np.ndarray:
    near = np.bitwise_count(u[a] ^ u[b]) <= distance
    return near & (np.bitwise_count(fp[a] ^ fp[b]) <= distance)


def _forest(fp: np.ndarray, u: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the members."""
    left, edges = np.arange(len(fp)), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = _linked(fp, u, i, left, distance)
            if hit.any():
                found = left[hit].tolist()
                edges += [(i, j) for j in found]
                queue += found
                left = left[~hit]
    return edges


def _cell_links(distance: int, cell: int | None):
    """Over rows (key, fp, rep) sorted by key: links (a, b) of reps, and the members of cells above ``cell`` with their key."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = np.zeros(0, dtype=np.int64)
        carry, oversized = (empty, empty, empty), None

        def emit(a, b, key=None):
            keys = pa.nulls(len(a), pa.int64()) if key is None else pa.array(key)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), keys], ["a", "b", "key"])

        def batches_then_end():
            for batch in batches:
                yield tuple(np.concatenate([c, np.asarray(batch.column(k))]) for k, c in enumerate(carry)), False
            yield carry, True

        for (key, fp, rep), last in batches_then_end():
            if not len(key):
                continue
            cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[cuts, len(key)])
            whole = len(cuts) if last else len(cuts) - 1
            if cell is not None:  # an oversized cell goes on as it comes; its members need not be held
                for k in np.flatnonzero((sizes > cell) | (key[cuts] == oversized) if oversized is not None else sizes > cell):
                    span = slice(cuts[k], cuts[k] + sizes[k])
                    yield emit(fp[span], rep[span], key[span])
                    oversized = key[cuts[k]]
                    sizes[k] = -sizes[k]
            tail = slice(cuts[whole], None) if whole < len(cuts) and sizes[whole] > 0 else slice(0, 0)
            carry = (key[tail], fp[tail], rep[tail])
            x = fp.view(np.uint64)
            u = _unary(x)
            a_out, b_out = [], []
            few = np.flatnonzero((sizes[:whole] > 1) & (sizes[:whole] <= FEW))
            for d in range(1, FEW):
                few = few[sizes[few] > d]
                if not len(few):
                    break
                n = sizes[few] - d
                a = np.repeat(cuts[few], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                a = a[_linked(x, u, a, a + d, distance)]
                a_out.append(rep[a])
                b_out.append(rep[a + d])
            for k in np.flatnonzero(sizes[:whole] > FEW):
                span = slice(cuts[k], cuts[k] + sizes[k])
                found = _forest(x[span], u[span], distance)
                if found:
                    pairs = np.array(found)
                    a_out.append(rep[span][pairs[:, 0]])
                    b_out.append(rep[span][pairs[:, 1]])
            if a_out:
                yield emit(np.concatenate(a_out), np.concatenate(b_out))

    return links


def similar_links(members: DataFrame, distance: int = 4, cell: int = CELL, within: str | None = None) -> DataFrame:
    """members (fp distinct, rep): links (a, b) of reps that connect exactly what lies within the Hamming distance; with within, of one value of that column."""
    masks = projections(grid_groups(members.count(), distance), distance)
    u = unary(F.col("fp"))
    own = [within] if within else []
    cells = members.select(F.explode(F.array(*(F.xxhash64(F.lit(t), u.bitwiseAND(F.lit(m)), *own) for t, m in enumerate(masks)))).alias("key"), "fp", "rep")
    schema = "a long, b long, key long"
    found = park(arrow_map(cells.repartition("key").sortWithinPartitions("key"), _cell_links(distance, cell), schema), "sim-links")
    links = found.where(F.col("key").isNull()).select("a", "b")
    large = found.where(F.col("key").isNotNull()).select("key", F.col("a").alias("fp"), F.col("b").alias("rep"))
    if large.isEmpty():
        return links
    blocks = large.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / max(1, cell // 2)).cast("int").alias("blocks"))
    dealt = large.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = dealt.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp", "rep")
    more = arrow_map(pair.repartition("key").sortWithinPartitions("key"), _cell_links(distance, None), schema)
    return links.unionByName(more.select("a", "b"))


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable over links, itself included) of every row.

    Fingerprints link at ``distance`` or fewer differing bits. Rows of one
    doc_id with different texts keep their own fingerprints. Null ids get null
    components unless linked to others.
    """
    fps = park(fingerprints(docs, words), "sim-fps")
    members = park(fps.where(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("rep")), "sim-members")
    labels = components(similar_links(members, distance))
    groups = members.join(labels, members["rep"] == labels["node"], "left").select("fp", F.coalesce("label", "rep").alias("component_id"))
    return fps.join(groups, "fp", "left").select("doc_id", "fp", "component_id")


def distinct_hashes(h: np.ndarray, shingles: np.ndarray) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    return [np.unique(x) for x in np.split(h, np.cumsum(shingles)[:-1])] if len(shingles) else []


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    return distinct_hashes(*shingle_hashes(texts, words))


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """BANDS keys of each set (none empty): hashes of ROWS minima of the set under random multiplications."""
    rng = np.random.default_rng(SEED)
    odd, add = rng.integers(0, 1 << 64, (2, BANDS * ROWS), dtype=np.uint64)
    flat = np.concatenate(sets)
    begin = np.cumsum([0, *map(len, sets[:-1])])
    keys = np.empty((len(sets), BANDS), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for band in range(BANDS):
            key = np.full(len(sets), band + 1, dtype=np.uint64)
            for k in range(band * ROWS, (band + 1) * ROWS):
                x = flat * (odd[k] | np.uint64(1)) + add[k]
                x ^= x >> np.uint64(32)
                x *= np.uint64(0x9E3779B97F4A7C15)
                key = (key ^ np.minimum.reduceat(x, begin)) * np.uint64(0xC2B2AE3D27D4EB4F)
                key ^= key >> np.uint64(29)
            keys[:, band] = key
    return keys.view(np.int64)


def _row_keys(words: int):
    """Over rows (tag, doc_id, text, part): tag, doc_id, part, digest of the text and of its shingle set, band keys (none for an empty set), fingerprint."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in text_slices(batch.column(2)):
                texts = utf8(batch.column(2), i, j)
                hashes = shingle_hashes(texts, words)
                sets = distinct_hashes(*hashes)
                has = np.array([len(x) > 0 for x in sets])
                keys = band_keys([x for x in sets if len(x)]) if has.any() else np.zeros((0, BANDS), dtype=np.int64)
                ends = np.cumsum(np.r_[0, has * BANDS]).astype(np.int32)
                columns = [
                    batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), batch.column(3).slice(i, j - i), pa.array([xxhash.xxh3_128_digest(t) for t in texts], pa.binary()),
                    pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel())),
                    pa.array(fold(*hashes).view(np.int64)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["tag", "doc_id", "part", "text_hash", "shingles", "keys", "fp"])

    return keyed


def _sets(words: int):
    """Over rows (label, rep, text): label, rep and the shingle set as bytes."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in text_slices(batch.column(2)):
                sets = shingle_sets(utf8(batch.column(2), i, j), words)
                columns = [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array([x.tobytes() for x in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["label", "rep", "members"])

    return made


def jaccard_forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets (none empty) whose Jaccard similarity is at least ``similarity``."""
    size = np.array(list(map(len, sets)))
    start = np.cumsum(size) - size
    known, ids = np.unique(np.concatenate(sets), return_inverse=True)
    mark, left, edges = np.zeros(len(known), dtype=bool), np.arange(len(sets)), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            fits = np.flatnonzero(np.minimum(size[left], size[i]) >= similarity * np.maximum(size[left], size[i]) - 1e-9)
            if not len(fits):
                continue
            own = ids[start[i] : start[i] + size[i]]
            mark[own] = True
            other = left[fits]
            n = size[other]
            at = np.arange(int(n.sum())) + np.repeat(start[other] - (np.cumsum(n) - n), n)
            shared = np.add.reduceat(mark[ids[at]], np.cumsum(n) - n, dtype=np.int64)
            mark[own] = False
            hit = fits[shared >= similarity * (n + size[i] - shared) - 1e-9]
            found = left[hit].tolist()
            edges += [(i, j) for j in found]
            queue += found
            left = np.delete(left, hit)
    return edges


def _verified_links(similarity: float):
    """Over rows (key, rep, members) sorted by key: links (a, b) that connect the similar sets of each key."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, reps, sets = None, [], []

        def closed() -> list[tuple[int, int]]:
            return [(reps[i], reps[j]) for i, j in jaccard_forest(sets, similarity)] if len(sets) > 1 else []

        def emit(edges: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            edges = []
            for k, rep, members in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if k != key:
                    edges += closed()
                    key, reps, sets = k, [], []
                reps.append(rep)
                sets.append(np.frombuffer(members, dtype="<u8"))
            yield emit(edges)
        yield emit(closed())

    return links


def keep_first(docs: DataFrame, words: int = 5, similarity: float = 0.8, within: str | None = None) -> DataFrame:
    """docs with exactly one row of each near-duplicate group.

    Texts are linked when the sets of their ``words``-word shingles (ASCII
    case ignored) have a Jaccard similarity of at least ``similarity``; what
    links connect is a group; with ``within``, only rows that agree in that
    column are linked. The row that stays has the smallest doc_id, null
    ids last, then the smallest digest of its text; rows that agree in both
    leave any one. So a row without an id stays where no other row is like it,
    and rows that share an id count one by one. Null, empty and blank texts are
    one group.
    """
    packed = docs.select(F.monotonically_increasing_id().alias("tag"), F.struct(*docs.columns).alias("doc"))
    tagged = park(packed, "near-docs")
    text = F.col("doc.text").cast("string").alias("text")
    part = (F.xxhash64(F.col("doc")[within]) if within else F.lit(0).cast("long")).alias("part")
    schema = "tag long, doc_id long, part long, text_hash binary, shingles binary, keys array<long>, fp long"
    rows = arrow_map(tagged.select("tag", F.col("doc.doc_id").cast("long").alias("doc_id"), text, part), _row_keys(words), schema)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "tag", "keys", "fp")
    members = park(rows.groupBy("part", "shingles").agg(F.min(order).alias("m")).select("part", "m.*"), "near-members")

    said = members.where(F.size("keys") > 0)
    prints = park(said.groupBy("part", "fp").agg(F.min("tag").alias("rep")), "near-prints")
    alike = said.join(prints, ["part", "fp"]).where(F.col("tag") != F.col("rep")).select(F.col("tag").alias("a"), F.col("rep").alias("b"))
    alike = alike.unionByName(similar_links(prints, within="part"))
    banded = members.select("part", F.explode("keys").alias("key"), "tag").select(F.xxhash64("key", "part").alias("key"), "tag")
    shared = banded.groupBy("key").agg(F.min("tag").alias("b"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).drop("n")
    candidates = _grouped(components(alike.unionByName(banded.join(shared, "key").select(F.col("tag").alias("a"), "b"))))
    sets = arrow_map(tagged.join(candidates, F.col("tag") == F.col("node")).select("label", F.col("tag").alias("rep"), text), _sets(words), "label long, rep long, members binary")
    sets = park(sets, "near-sets")
    sizes = sets.groupBy("label").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum(F.length("members")) / BLOCK_BYTES)).cast("int").alias("blocks"))
    dealt = sets.join(sizes, "label").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = dealt.select(F.xxhash64("label", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "rep", "members")
    links = arrow_map(pairs.repartition("key").sortWithinPartitions("key"), _verified_links(similarity), "a long, b long")

    groups = _grouped(components(links))
    labelled = members.drop("keys", "fp").join(groups, F.col("tag") == F.col("node"), "left").withColumn("label", F.coalesce("label", "tag"))
    first = labelled.groupBy("label").agg(F.min(F.struct("no_id", "doc_id", "text_hash", "tag")).alias("m")).select(F.col("m.tag").alias("first"))
    return tagged.join(first, F.col("tag") == F.col("first"), "left_semi").select("doc.*")


def _grouped(labels: DataFrame) -> DataFrame:
    """labels (node, label) with the smallest nodes, which are their own labels, too."""
    return labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())
