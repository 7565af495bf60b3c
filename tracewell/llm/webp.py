"""Lossless WebP: decoder and encoder of still VP8L images, and the column operators over them.

``decode_webp`` reads any VP8L image, also within an extended file: prefix codes
(grouped by an entropy image too), back-references, the colour cache, and the
predictor, cross-colour, subtract-green and palette transforms, into ARGB pixels.

``encode_webp`` takes the transforms and the colour cache whose symbols have the
least entropy and refers back to earlier pixels. ``to_media`` stores bytes as the
green samples of pictures 64 pixels wide; long payloads become a series of files.
There, back-references pay for nearly every text and the palette for texts of up
to sixteen byte values; the other steps pay for pictures.

``to_media_many`` and ``samples_of_many`` do the same for many payloads at once.
Pictures of samples that need no transform go together: one sort finds the
matches of all, and one symbol of each is decoded per step. Every other picture
goes through ``encode_webp`` and ``decode_webp``, and the bytes are the same.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import arrow_map, text_slices, utf8

WIDTH, TILE_ROWS = 64, 64
TILE = WIDTH * TILE_ROWS
MAX_CODE = 10  # bits of the encoder's codes; the decoder takes the format's 15
LONGEST = 48  # pixels of the encoder's back-references
LEAST_COLOUR, LEAST_GREY = 3, 12  # shorter ones hardly pay
TOGETHER_TILES, TOGETHER = 4096, 1 << 20  # pictures, and samples, that are encoded together
DECODED_TILES = 1024  # pictures that are decoded together

# Fixed values of the format.
CODE_LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
DISTANCE_MAP = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]
CACHE_FACTOR = 0x1E35A7BD
ALPHABETS = (256 + 24, 256, 256, 256, 40)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3


class Bits:
    """Bits of a byte string, least significant first; zeros follow the end."""

    def __init__(self, data: bytes):
        self.at, self.end = 0, 8 * len(data)
        self.data = data + b"\0" * 8

    def words(self) -> list[int]:
        """The 32 bits from each byte on."""
        d = np.frombuffer(self.data, dtype=np.uint8).astype(np.uint32)
        return (d[:-3] | d[1:-2] << 8 | d[2:-1] << 16 | d[3:] << 24).tolist()

    def peek(self, n: int) -> int:
        byte = self.at >> 3
        return int.from_bytes(self.data[byte : byte + 5], "little") >> (self.at & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        if self.at + n > self.end:
            raise ValueError("the image data ends early")
        v = self.peek(n)
        self.at += n
        return v


_REVERSED = sum((np.arange(1 << 15) >> k & 1) << (14 - k) for k in range(15)).tolist()


def _reversed(code: int, length: int) -> int:
    return _REVERSED[code] >> (15 - length)


class PrefixCode:
    """A canonical prefix code as a table over the next ``width`` bits."""

    def __init__(self, lengths: list[int]):
        used = [(n, s) for s, n in enumerate(lengths) if n]
        self.only = used[0][1] if len(used) == 1 else 0 if not used else None
        self.width, self.lists = 0, None
        if self.only is not None:
            return
        used.sort()
        self.width = used[-1][0]
        if sum(1 << (self.width - n) for n, _ in used) != 1 << self.width:
            raise ValueError("the prefix code is not complete")
        self.entry = np.zeros(1 << self.width, dtype=np.int32)  # symbol, and above it 4 bits of length
        code = last = 0
        for n, s in used:
            code <<= n - last
            last = n
            self.entry[_REVERSED[code] >> (15 - n) :: 1 << n] = s << 4 | n
            code += 1
        self.most = max(s for _, s in used)

    def read(self, bits: Bits) -> int:
        if not self.width:
            return self.only
        if self.lists is None:
            self.lists = self.entry.tolist()
        entry = self.lists[bits.peek(self.width)]
        bits.at += entry & 15
        if bits.at > bits.end:
            raise ValueError("the image data ends early")
        return entry >> 4


def read_prefix_code(bits: Bits, alphabet: int) -> PrefixCode:
    lengths = [0] * alphabet
    if bits.read(1):
        two = bits.read(1)
        if not two:
            code = PrefixCode([])
            code.only = bits.read(8 if bits.read(1) else 1)
            if code.only >= alphabet:
                raise ValueError("no such symbol")
            return code
        pair = (bits.read(8 if bits.read(1) else 1), bits.read(8))
        if max(pair) >= alphabet:
            raise ValueError("no such symbol")
        for symbol in pair:
            lengths[symbol] = 1
        return PrefixCode(lengths)
    code_lengths = [0] * 19
    for k in range(4 + bits.read(4)):
        code_lengths[CODE_LENGTH_ORDER[k]] = bits.read(3)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    code, s, previous = PrefixCode(code_lengths), 0, 8
    entries = code.entry.tolist() if code.width else [code.only << 4]
    mask, data = (1 << code.width) - 1, bits.data
    while s < alphabet and left:
        left -= 1
        at = bits.at
        entry = entries[(data[at >> 3] | data[(at >> 3) + 1] << 8) >> (at & 7) & mask]
        bits.at = at + (entry & 15)
        if bits.at > bits.end:
            raise ValueError("the image data ends early")
        n = entry >> 4
        if n < 16:
            lengths[s] = n
            s += 1
            previous = n or previous
        else:
            run = 3 + bits.read(2) if n == 16 else 3 + bits.read(3) if n == 17 else 11 + bits.read(7)
            if s + run > alphabet:
                raise ValueError("code lengths run past the alphabet")
            lengths[s : s + run] = [previous if n == 16 else 0] * run
            s += run
    return PrefixCode(lengths)


# The extra bits of each length or distance prefix, and its least value.
_EXTRA = [max(0, (p - 2) >> 1) for p in range(40)]
_LEAST = [p + 1 if p < 4 else ((2 + (p & 1)) << _EXTRA[p]) + 1 for p in range(40)]


def _subsampled(size: int, bits: int) -> int:
    return (size + (1 << bits) - 1) >> bits


def read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """Entropy-coded ARGB pixels (uint32, row by row); only the main image may have an entropy image."""
    try:
        return _read_image(bits, width, height, main)
    except IndexError as e:
        raise ValueError("the image data ends early") from e


def _read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    groups_of, group_bits, n_groups = None, 0, 1
    if main and bits.read(1):
        group_bits = bits.read(3) + 2
        across = _subsampled(width, group_bits)
        entropy = read_image(bits, across, _subsampled(height, group_bits), False)
        groups_of = ((entropy >> 8) & 0xFFFF).tolist()
        n_groups = max(groups_of) + 1
    sizes = (ALPHABETS[0] + (1 << cache_bits if cache_bits else 0), *ALPHABETS[1:])
    groups = [[read_prefix_code(bits, n) for n in sizes] for _ in range(n_groups)]
    total = width * height
    green, red, blue, alpha, distance = groups[0]
    if n_groups == 1 and not any(c.width for c in (green, red, blue, alpha)) and green.only < 256:
        return np.full(total, alpha.only << 24 | red.only << 16 | green.only << 8 | blue.only, dtype=np.uint32)
    for group in groups:
        for code in group:
            code.lists = code.lists or (code.entry.tolist() if code.width else [code.only << 4])
    out = array("I")
    put, words, at, end = out.append, bits.words(), bits.at, bits.end
    cache, shift, cached = [0] * (1 << cache_bits), 32 - cache_bits, 0
    group, many = None, groups_of is not None
    while len(out) < total:
        done = len(out)
        chosen = groups[groups_of[(done // width >> group_bits) * across + (done % width >> group_bits)]] if many else groups[0]
        if chosen is not group:
            group = chosen
            green, red, blue, alpha, distance = group
            g_list, g_mask = green.lists, (1 << green.width) - 1
            plain = not (red.width or blue.width or alpha.width)
            constant = alpha.only << 24 | red.only << 16 | blue.only if plain else 0
        for _ in range(1 if many or not plain else total - done):  # literals of one channel up to the next other symbol
            entry = g_list[words[at >> 3] >> (at & 7) & g_mask]
            at += entry & 15
            if entry >= 4096 or not plain:
                break
            put(constant | entry >> 4 << 8)
        else:
            if at > end:
                raise ValueError("the image data ends early")
            continue
        s, done = entry >> 4, len(out)
        if s < 256:
            pixel = s << 8
            for code, place in ((red, 16), (blue, 0), (alpha, 24)):
                entry = code.lists[words[at >> 3] >> (at & 7) & ((1 << code.width) - 1)]
                at += entry & 15
                pixel |= entry >> 4 << place
                if at > end:
                    raise ValueError("the image data ends early")
            put(pixel)
        elif s < 280:
            extra = _EXTRA[s - 256]
            run = _LEAST[s - 256] + (words[at >> 3] >> (at & 7) & ((1 << extra) - 1))
            at += extra
            if at > end:
                raise ValueError("the image data ends early")
            entry = distance.lists[words[at >> 3] >> (at & 7) & ((1 << distance.width) - 1)]
            at += entry & 15
            if at > end:
                raise ValueError("the image data ends early")
            extra = _EXTRA[entry >> 4]
            far = _LEAST[entry >> 4] + (words[at >> 3] >> (at & 7) & ((1 << extra) - 1))
            at += extra
            if far > 120:
                far -= 120
            else:
                dx, dy = DISTANCE_MAP[far - 1]
                far = max(1, dx + dy * width)
            if far > done or done + run > total:
                raise ValueError("a back-reference leaves the image")
            if far >= run:
                out += out[done - far : done - far + run]
            else:
                out += (out[done - far :] * (run // far + 1))[:run]
        else:
            while cached < done:
                cache[(CACHE_FACTOR * out[cached] & 0xFFFFFFFF) >> shift] = out[cached]
                cached += 1
            if s - 280 >= len(cache):
                raise ValueError("no such place in the colour cache")
            put(cache[s - 280])
        if at > end:
            raise ValueError("the image data ends early")
    bits.at = at
    return np.frombuffer(out, dtype=np.uint32)


def _planes(argb: np.ndarray) -> np.ndarray:
    """Channels a, r, g, b of ARGB pixels."""
    return np.stack([(argb >> s & 0xFF).astype(np.int32) for s in (24, 16, 8, 0)], axis=-1)


def _packed(planes: np.ndarray) -> np.ndarray:
    p = planes.astype(np.uint32) & 0xFF
    return p[..., 0] << 24 | p[..., 1] << 16 | p[..., 2] << 8 | p[..., 3]


def _predict(mode: int, left: np.ndarray, top: np.ndarray, top_left: np.ndarray, top_right: np.ndarray) -> np.ndarray:
    if mode == 0 or mode > 13:
        return np.broadcast_to(np.array([255, 0, 0, 0]), left.shape)
    if mode < 5:
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return (((left + top_right) >> 1) + top) >> 1
    if mode < 10:
        a, b = ((left, top_left), (left, top), (top_left, top), (top, top_right))[mode - 6]
        return (a + b) >> 1
    if mode == 10:
        return (((left + top_left) >> 1) + ((top + top_right) >> 1)) >> 1
    if mode == 11:
        to_left, to_top = np.abs(top - top_left).sum(-1, keepdims=True), np.abs(left - top_left).sum(-1, keepdims=True)
        return np.where(to_left < to_top, left, top)
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    mean = (left + top) >> 1
    return np.clip(mean + np.sign(mean - top_left) * (np.abs(mean - top_left) >> 1), 0, 255)


def undo_predictor(argb: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    """Add each pixel's prediction. Pixels along an anti-diagonal need only earlier ones, so rows whose modes don't use the left pixel go at once."""
    height, width = argb.shape
    px = _planes(argb)
    mode_of = (modes >> 8 & 0xF).astype(int)
    px[0, 0] = (px[0, 0] + [255, 0, 0, 0]) & 0xFF
    px[0] = np.cumsum(px[0], axis=0) & 0xFF
    for y in range(1, height):
        px[y, 0] = (px[y, 0] + px[y - 1, 0]) & 0xFF
        row = np.repeat(mode_of[y >> bits], 1 << bits)[:width]
        top, top_left = px[y - 1], np.roll(px[y - 1], 1, axis=0)
        top_right = np.concatenate([px[y - 1, 1:], px[y, :1]])  # of the last pixel it is the first of its own row
        free = ~np.isin(row, (1, 5, 6, 7, 10, 11, 12, 13))
        free[0] = False
        for mode in np.unique(row[free]):
            at = np.flatnonzero(free & (row == mode))
            px[y, at] = (px[y, at] + _predict(int(mode), top[at], top[at], top_left[at], top_right[at])) & 0xFF
        for x in np.flatnonzero(~free[1:]) + 1:
            px[y, x] = (px[y, x] + _predict(int(row[x]), px[y, x - 1], top[x], top_left[x], top_right[x])) & 0xFF
    return _packed(px)


def _signed(x: np.ndarray) -> np.ndarray:
    return ((x & 0xFF) ^ 0x80) - 0x80


def undo_cross_colour(argb: np.ndarray, elements: np.ndarray, bits: int) -> np.ndarray:
    height, width = argb.shape
    e = _planes(elements).repeat(1 << bits, axis=0).repeat(1 << bits, axis=1)[:height, :width]
    px = _planes(argb)
    green = _signed(px[..., 2])
    red = (px[..., 1] + (_signed(e[..., 3]) * green >> 5)) & 0xFF
    blue = (px[..., 3] + (_signed(e[..., 2]) * green >> 5) + (_signed(e[..., 1]) * _signed(red) >> 5)) & 0xFF
    return _packed(np.stack([px[..., 0], red, px[..., 2], blue], axis=-1))


def undo_subtract_green(argb: np.ndarray) -> np.ndarray:
    px = _planes(argb)
    px[..., 1] += px[..., 2]
    px[..., 3] += px[..., 2]
    return _packed(px)


def undo_palette(argb: np.ndarray, colours: np.ndarray, width: int) -> np.ndarray:
    """Indices, packed several to a green sample where the palette is small, become colours; others are transparent black."""
    step = _pack_bits(len(colours))
    index = (argb >> 8 & 0xFF).astype(np.int64)
    if step:
        each = 8 >> step
        index = np.stack([index >> (k * each) & ((1 << each) - 1) for k in range(1 << step)], axis=-1).reshape(len(argb), -1)[:, :width]
    table = np.zeros(256, dtype=np.uint32)
    table[: len(colours)] = colours
    return table[index]


def _pack_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def vp8l_payload(data: bytes) -> bytes:
    """The VP8L chunk of a WebP file, simple or extended; ValueError where there is none."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while at + 8 <= len(data):
        size = struct.unpack("<I", data[at + 4 : at + 8])[0]
        if data[at : at + 4] == b"VP8L":
            if at + 8 + size > len(data):
                raise ValueError("the file ends early")
            return data[at + 8 : at + 8 + size]
        if data[at : at + 4] in (b"VP8 ", b"ANMF"):
            raise ValueError("a lossy or animated file")
        at += 8 + size + (size & 1)
    raise ValueError("no lossless image in the file")


def _header(bits: Bits) -> tuple[int, int]:
    if bits.read(8) != 0x2F:
        raise ValueError("no VP8L signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    return width, height


def decode_webp(data: bytes) -> np.ndarray:
    """ARGB pixels, height by width, uint32."""
    bits = Bits(vp8l_payload(data))
    width, height = _header(bits)
    transforms, inner = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (k for k, *_ in transforms):
            raise ValueError("a transform occurs twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = bits.read(3) + 2
            across, down = _subsampled(inner, block), _subsampled(height, block)
            transforms.append((kind, read_image(bits, across, down, False).reshape(down, across), block))
        elif kind == SUBTRACT_GREEN:
            transforms.append((kind, None, 0))
        else:
            n = bits.read(8) + 1
            colours = _packed(np.cumsum(_planes(read_image(bits, n, 1, False)), axis=0) & 0xFF)
            transforms.append((kind, colours, inner))
            inner = _subsampled(inner, _pack_bits(n))
    argb = read_image(bits, inner, height, True).reshape(height, inner)
    for kind, what, size in reversed(transforms):
        if kind == PREDICTOR:
            argb = undo_predictor(argb, what, size)
        elif kind == CROSS_COLOUR:
            argb = undo_cross_colour(argb, what, size)
        elif kind == SUBTRACT_GREEN:
            argb = undo_subtract_green(argb)
        else:
            argb = undo_palette(argb, what, size)
    return argb


def code_lengths(counts: np.ndarray, limit: int = MAX_CODE) -> list[int]:
    """Lengths of a prefix code over the counted symbols, none above limit; rare symbols gain weight until it holds."""
    symbols = np.flatnonzero(counts).tolist()
    lengths = [0] * len(counts)
    if len(symbols) < 2:
        for s in symbols:
            lengths[s] = 1
        return lengths
    weights, least = counts[symbols].tolist(), 1
    while True:
        heap = [(max(w, least), k, k) for k, w in enumerate(weights)]
        heapq.heapify(heap)
        parent, n = [0] * (2 * len(symbols) - 1), len(symbols)
        for node in range(n, 2 * n - 1):
            a = heapq.heappop(heap)
            b = heap[0]
            parent[a[2]] = parent[b[2]] = node
            heapq.heapreplace(heap, (a[0] + b[0], node, node))
        depth = [0] * (2 * n - 1)
        for node in range(2 * n - 3, -1, -1):
            depth[node] = depth[parent[node]] + 1
        if max(depth[:n]) <= limit:
            for s, d in zip(symbols, depth):
                lengths[s] = d
            return lengths
        least *= 2


def codes_of(lengths: list[int]) -> list[int]:
    """Canonical codes with their bits reversed, ready for least-significant-first writing."""
    out, code, last = [0] * len(lengths), 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        last = n
        out[s] = _reversed(code, n)
        code += 1
    return out


class BitWriter:
    def __init__(self):
        self.value, self.at = 0, 0

    def write(self, value: int, n: int) -> None:
        self.value |= value << self.at
        self.at += n

    def extend(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """Write each value with its number of bits."""
        sizes = sizes.astype(np.int64)
        ends = np.cumsum(sizes)
        if not len(ends) or not ends[-1]:
            return
        bit = np.arange(int(ends[-1])) - np.repeat(ends - sizes, sizes)
        stream = (np.repeat(values.astype(np.int64), sizes) >> bit & 1).astype(np.uint8)
        self.write(int.from_bytes(np.packbits(stream, bitorder="little").tobytes(), "little"), int(ends[-1]))

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.at + 7) // 8, "little")


def write_prefix_code(out: BitWriter, lengths: list[int]) -> None:
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) < 2 and max(used, default=0) < 256:
        s = used[0] if used else 0
        out.write(1, 1)
        out.write(0, 1)
        out.write(int(s > 1), 1)
        out.write(s, 8 if s > 1 else 1)
        return
    runs: list[tuple[int, int, int]] = []  # symbol, extra bits, their number
    s, end = 0, len(lengths)
    while s < end:
        if lengths[s]:
            runs.append((lengths[s], 0, 0))
            s += 1
            continue
        zeros = s
        while zeros < end and not lengths[zeros] and zeros - s < 138:
            zeros += 1
        run = zeros - s
        runs += [(18, run - 11, 7)] if run > 10 else [(17, run - 3, 3)] if run > 2 else [(0, 0, 0)] * run
        s = zeros
    counts = np.bincount([r[0] for r in runs], minlength=19)
    inner = code_lengths(counts, 7)
    codes = codes_of(inner)
    single = sum(1 for n in inner if n) == 1
    out.write(0, 1)
    stored = max(k for k in range(19) if inner[CODE_LENGTH_ORDER[k]] or k < 4) + 1
    out.write(stored - 4, 4)
    for k in range(stored):
        out.write(inner[CODE_LENGTH_ORDER[k]], 3)
    out.write(0, 1)
    for symbol, extra, n in runs:
        if not single:
            out.write(codes[symbol], inner[symbol])
        out.write(extra, n)


def riff(chunk: bytes) -> bytes:
    padded = chunk + b"\0" * (len(chunk) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(padded)) + b"WEBPVP8L" + struct.pack("<I", len(chunk)) + padded


def write_header(out: BitWriter, width: int, height: int, alpha: int = 0) -> None:
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (alpha, 1), (0, 3)):
        out.write(value, n)


def _prefixed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix, extra bits and their number of lengths or distances."""
    x = np.asarray(x, dtype=np.int64) - 1
    high = np.frexp(np.maximum(x, 1).astype(np.float64))[1] - 1
    size = np.where(x < 4, 0, high - 1)
    return np.where(x < 4, x, 2 * high + (x >> np.maximum(high - 1, 0) & 1)), x & ((1 << size) - 1), size


def _matches(px: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each pixel the length of the match with the nearest earlier place that begins alike (0: none), and how far that is."""
    n = len(px)
    length, far = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    if n <= least:
        return length, far
    key = np.zeros(n - least + 1, dtype=np.uint64)
    pair = px[:-1].astype(np.uint64) << np.uint64(32) | px[1:]
    for k in range(0, least, 2):
        key = key * np.uint64(0x9E3779B97F4A7C15) + (pair[k : n - least + 1 + k] if k + 1 < least else px[k:].astype(np.uint64))
    placed = np.sort(key)
    if not (placed[1:] == placed[:-1]).any():
        return length, far
    order = np.argsort(key)
    twice = key[order[1:]] == key[order[:-1]]
    order = np.sort(order[np.r_[False, twice] | np.r_[twice, False]])  # what occurs again, in its order
    order = order[np.argsort(key[order], kind="stable")]
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    live, before = order[same + 1], order[same]
    far[live] = live - before
    for k in range(least):
        alike = px[live + k] == px[before + k]
        if not alike.all():  # two beginnings of one key
            live, before = live[alike], before[alike]
    length[live] = least
    for k in range(least, LONGEST):
        inside = live + k < n
        live, before = live[inside], before[inside]
        alike = px[live + k] == px[before + k]
        live, before = live[alike], before[alike]
        if not len(live):
            break
        length[live] += 1
    return length, far


def _bits_of(symbols: np.ndarray) -> float:
    """Bits of the symbols under a code of their own."""
    counts = np.bincount(symbols.ravel())
    counts = counts[counts > 0]
    return float((counts * np.log2(counts.sum() / counts)).sum())


def _cache_hits(px: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each pixel's place in the colour cache, and whether it stands there when its turn comes."""
    slot = (px.astype(np.uint64) * CACHE_FACTOR & 0xFFFFFFFF) >> np.uint64(32 - bits)
    order = np.argsort(slot, kind="stable")
    hit = np.zeros(len(px), dtype=bool)
    again = (slot[order[1:]] == slot[order[:-1]]) & (px[order[1:]] == px[order[:-1]])
    hit[order[1:][again]] = True
    return slot.astype(np.int64), hit


@lru_cache(maxsize=2048)
def _one_symbol(symbol: int) -> tuple[int, int]:
    """Bits of the code of one symbol, and how many they are."""
    out = BitWriter()
    write_prefix_code(out, [int(s == symbol) for s in range(max(2, symbol + 1))])
    return out.value, out.at


@lru_cache(maxsize=64)
def _near(width: int) -> dict[int, int]:
    """The short code of each distance that has one."""
    return {max(1, dx + dy * width): k + 1 for k, (dx, dy) in reversed(list(enumerate(DISTANCE_MAP)))}


def write_image(out: BitWriter, px: np.ndarray, width: int, main: bool) -> None:
    """Entropy-coded pixels (uint32): the colour cache that pays, back-references, one prefix code group."""
    differs = int(np.bitwise_or.reduce(px ^ px[0]))
    varied = bool(differs & 0xFFFF00FF)
    channels = [(px if varied or s == 8 else px[:1]) >> s & 0xFF for s in (8, 16, 0, 24)]
    channels = [c.astype(np.int64) for c in channels]
    cache_bits, slot, hit = 0, None, np.zeros(len(px), dtype=bool)
    if varied:
        least = sum(map(_bits_of, channels))
        for bits in (4, 8):
            s, h = _cache_hits(px, bits)
            cost = _bits_of(np.where(h, 280 + s, channels[0])) + sum(_bits_of(c[~h]) for c in channels[1:] if not h.all())
            if cost < least:
                least, cache_bits, slot, hit = cost, bits, s, h
    run = far = np.zeros(len(px), dtype=np.int64)
    inside = np.zeros(len(px) + 1, dtype=np.int64)
    if differs:
        length, far = _matches(px, LEAST_COLOUR if varied else LEAST_GREY)
        run, at = np.zeros_like(length), 0
        starts, taken = np.flatnonzero(length).tolist(), []
        while (k := bisect_left(starts, at)) < len(starts):
            taken.append(starts[k])
            at = starts[k] + int(length[starts[k]])
        if taken:
            run[taken] = length[taken]
            inside[np.array(taken) + 1] = 1
            np.add.at(inside, taken + run[taken], -1)
    at = np.flatnonzero(np.cumsum(inside[:-1]) == 0)  # where symbols begin
    run, hit = run[at], hit[at]
    back = run > 0
    hit &= ~back
    pixel = ~back & ~hit
    symbol = channels[0][at]
    more, more_bits, further, further_bits, place = (np.zeros(len(at), dtype=np.int64) for _ in range(5))
    if back.any():
        prefix, more[back], more_bits[back] = _prefixed(run[back])
        symbol[back] = 256 + prefix
        near = _near(width)
        code = np.array([near.get(d, d + 120) for d in far[at][back].tolist()])
        place[back], further[back], further_bits[back] = _prefixed(code)
    if cache_bits:
        symbol[hit] = 280 + slot[at][hit]
    out.write(int(cache_bits > 0), 1)
    if cache_bits:
        out.write(cache_bits, 4)
    if main:
        out.write(0, 1)
    sizes = (ALPHABETS[0] + (1 << cache_bits if cache_bits else 0), *ALPHABETS[1:])
    used = [symbol, *(c[at][pixel] if varied else c for c in channels[1:]), place[back]]
    values, widths = np.zeros((len(at), 6), dtype=np.int64), np.zeros((len(at), 6), dtype=np.int64)
    which = [slice(None), pixel, pixel, pixel, back]
    for column, rows, symbols, size in zip((0, 2, 3, 4, 2), which, used, sizes):
        if len(symbols) < 2 or (symbols == symbols[0]).all():
            out.write(*_one_symbol(int(symbols[0]) if len(symbols) else 0))
            continue
        lengths = code_lengths(np.bincount(symbols, minlength=size))
        write_prefix_code(out, lengths)
        values[rows, column] = np.array(codes_of(lengths))[symbols]
        widths[rows, column] = np.array(lengths)[symbols]
    values[back, 1], widths[back, 1] = more[back], more_bits[back]
    values[back, 3], widths[back, 3] = further[back], further_bits[back]
    filled = widths.ravel() > 0
    out.extend(values.ravel()[filled], widths.ravel()[filled])


def _residual(px: np.ndarray, mode: int) -> np.ndarray:
    """Planes (all four, or green alone) less their prediction under one mode."""
    h, w, _ = px.shape
    flat = np.concatenate([np.zeros((w + 1, px.shape[2]), dtype=px.dtype), px.reshape(h * w, -1)])
    at = np.arange(h * w) + w + 1
    guess = _predict(mode, flat[at - 1], flat[at - w], flat[at - w - 1], flat[at - w + 1]).reshape(px.shape).copy()
    guess[1:, 0] = px[:-1, 0]
    guess[0, 1:] = px[0, :-1]
    guess[0, 0] = (255, 0, 0, 0) if px.shape[2] == 4 else 0
    return (px - guess) & 0xFF


def _cost(planes: np.ndarray) -> float:
    return sum(_bits_of(planes[..., k]) for k in range(planes.shape[2]))


def _multiplier(own: np.ndarray, other: np.ndarray) -> int:
    """The multiplier (32nds, signed byte) that takes most of other out of own."""
    own, other = _signed(own).ravel().astype(np.float64), _signed(other).ravel().astype(np.float64)
    return int(np.clip(round(32 * float(own @ other) / max(1.0, float(other @ other))), -128, 127))


def _cross_coloured(planes: np.ndarray) -> tuple[np.ndarray, int]:
    """Planes less what green tells of red, and green and red of blue; and the element (one for all blocks)."""
    a, r, g, b = (planes[..., k] for k in range(4))
    g2r, g2b = _multiplier(r, g), _multiplier(b, g)
    rest = (b - (g2b * _signed(g) >> 5)) & 0xFF
    r2b = _multiplier(rest, r)
    red = (r - (g2r * _signed(g) >> 5)) & 0xFF
    blue = (rest - (r2b * _signed(r) >> 5)) & 0xFF
    return np.stack([a, red, g, blue], axis=-1), (r2b & 255) << 16 | (g2b & 255) << 8 | g2r & 255


def _without_green(planes: np.ndarray) -> np.ndarray:
    out = planes.copy()
    out[..., 1] -= planes[..., 2]
    out[..., 3] -= planes[..., 2]
    return out & 0xFF


def encode_webp(argb: np.ndarray) -> bytes:
    """A WebP file of ARGB pixels (height by width, uint32, sides of at most 16384)."""
    h, w = argb.shape
    out = BitWriter()
    write_header(out, w, h, int((argb >> 24 != 255).any()))
    grey = not ((argb ^ argb[0, 0]) & np.uint32(0xFFFF00FF)).any()  # only green varies
    planes = (argb >> 8 & 0xFF).astype(np.int64)[..., None] if grey else _planes(argb)
    colours = argb[0, 0] & np.uint32(0xFFFF00FF) | np.flatnonzero(np.bincount(planes.ravel())).astype(np.uint32) << 8 if grey else np.unique(argb)
    options = [(_cost(planes), ())]
    if len(colours) <= (16 if grey else 256):
        index = np.searchsorted(colours, argb)
        step = _pack_bits(len(colours))
        each = 8 >> step
        packed = np.zeros((h, _subsampled(w, step)), dtype=np.int64)
        for k in range(1 << step):
            part = index[:, k :: 1 << step]
            packed[:, : part.shape[1]] |= part << (k * each)
        options.append((_bits_of(packed) + 32.0 * len(colours), (PALETTE,)))
    if len(colours) > 1:
        if grey:  # the differences themselves, without the border
            g = planes[..., 0]
            least, mode = min((_bits_of((g[:, 1:] - g[:, :-1]) & 0xFF), 1), (_bits_of((g[1:] - g[:-1]) & 0xFF), 2)) if h > 1 and w > 1 else (options[0][0], 1)
            options.append((least + 64 + 8 * max(h, w), (PREDICTOR,)))
        else:
            least, mode, predicted = min(((_cost(r), m, r) for m in (1, 2, 7, 11, 12) for r in (_residual(planes, m),)), key=lambda x: x[:2])
            options.append((least + 64, (PREDICTOR,)))
            crossed, element = _cross_coloured(predicted)
            options += [(_cost(crossed) + 160, (PREDICTOR, CROSS_COLOUR)), (_cost(_without_green(predicted)) + 68, (PREDICTOR, SUBTRACT_GREEN)), (_cost(_without_green(planes)) + 4, (SUBTRACT_GREEN,))]
    _, plan = min(options)
    for kind in plan:
        out.write(1, 1)
        out.write(kind, 2)
        if kind == PALETTE:
            out.write(len(colours) - 1, 8)
            steps = np.diff(_planes(colours), axis=0, prepend=np.zeros((1, 4), dtype=np.int64))
            write_image(out, _packed(steps), len(colours), False)
            argb = (packed.astype(np.uint32) << 8) | np.uint32(0xFF000000)
            w = argb.shape[1]
        elif kind == SUBTRACT_GREEN:
            argb = _packed(_without_green(_planes(argb)))
        else:
            out.write(7, 3)  # blocks of 512
            across, down = _subsampled(w, 9), _subsampled(h, 9)
            value = mode << 8 if kind == PREDICTOR else element
            write_image(out, np.full(across * down, 0xFF000000 | value, dtype=np.uint32), across, False)
            argb = _packed(_residual(_planes(argb), mode) if kind == PREDICTOR else crossed)
    out.write(0, 1)
    write_image(out, argb.ravel(), w, True)
    return riff(out.bytes())


def split_files(media: bytes) -> list[bytes]:
    """The WebP files of a series."""
    files, at = [], 0
    while at < len(media):
        if at + 8 > len(media):
            raise ValueError("the series ends early")
        size = 8 + struct.unpack("<I", media[at + 4 : at + 8])[0]
        files.append(media[at : at + size])
        at += size
    return files


def samples_of(media: bytes) -> np.ndarray:
    """The green samples of a series of files, row by row."""
    files = split_files(media)
    if not files:
        raise ValueError("no file")
    return np.concatenate([(decode_webp(f) >> 8 & 0xFF).astype(np.uint8).ravel() for f in files])


def payload_of(text: bytes) -> bytes:
    """The text with zero bytes up to a positive multiple of 64."""
    return text + b"\0" * (max(64, -(-len(text) // 64) * 64) - len(text))


def to_media(payload: bytes) -> bytes:
    """A series of WebP files of width 64 whose green samples are the payload, a multiple of 64 bytes."""
    return b"".join(encode_webp(_grey(payload[a : a + TILE])) for a in range(0, len(payload), TILE))


def _costs(counts: np.ndarray) -> np.ndarray:
    """Bits of the symbols counted in each row under a code of its own."""
    total = counts.sum(axis=1, keepdims=True)
    return (counts * np.log2(np.maximum(total, 1) / np.maximum(counts, 1))).sum(axis=1)


def _plain_tiles(data: np.ndarray, first: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which tiles of samples (of so many rows each) neither a palette nor a predictor makes smaller, as ``encode_webp`` judges."""
    tiles = len(rows)
    of_row = np.repeat(np.arange(tiles), rows)
    grid = data.reshape(-1, WIDTH)

    def counted(samples: np.ndarray, tile: np.ndarray) -> np.ndarray:
        return np.bincount((tile[:, None] * 256 + samples).ravel(), minlength=256 * tiles).reshape(tiles, 256)

    counts = counted(grid, of_row)
    below = np.ones(len(grid), dtype=bool)
    below[first // WIDTH] = False
    below = np.flatnonzero(below)
    step = np.minimum(_costs(counted(grid[:, 1:] - grid[:, :-1], of_row)), _costs(counted(grid[below] - grid[below - 1], of_row[below])))
    return ((counts > 0).sum(axis=1) > 16) & ((rows == 1) | (_costs(counts) <= step + 64 + 8 * np.maximum(rows, WIDTH)))


def _tile_matches(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, in order, that match an earlier place of their tile, with the length and distance of the nearest such match.

    Keys hold tile, hash of the first samples and place, so one sort serves all
    tiles and a tile's matches depend on nothing but the tile.
    """
    n = len(data)
    eight = np.ndarray(n + LONGEST + 8, "<u8", data.tobytes() + bytes(LONGEST + 16), 0, (1,)).copy()  # the 8 samples from each place on
    size = end - first
    tile = np.repeat(np.arange(len(first)), size)
    place = np.arange(n) - first[tile]
    begins = np.flatnonzero(place + LEAST_GREY <= size[tile])
    h = eight[begins] * np.uint64(0x9E3779B97F4A7C15)
    h = ((h ^ h >> np.uint64(32)) + eight[begins + LEAST_GREY - 8]) * np.uint64(0xC2B2AE3D27D4EB4F)
    keys = tile[begins].astype(np.uint64) << np.uint64(52) | h >> np.uint64(24) << np.uint64(12) | place[begins].astype(np.uint64)
    keys.sort()
    again = np.flatnonzero(keys[1:] >> np.uint64(12) == keys[:-1] >> np.uint64(12))
    base = first[(keys[again] >> np.uint64(52)).astype(np.int64)]
    at, before = (base + (keys[k] & np.uint64(4095)).astype(np.int64) for k in (again + 1, again))
    alike = (eight[at] == eight[before]) & (eight[at + LEAST_GREY - 8] == eight[before + LEAST_GREY - 8])
    at, before = at[alike], before[alike]
    length = np.full(len(at), LEAST_GREY)
    live = np.arange(len(at))
    for k in range(LEAST_GREY, LONGEST, 8):
        differs = eight[at[live] + k] ^ eight[before[live] + k]
        lowest = differs & (~differs + np.uint64(1))
        length[live] = k + np.where(differs == 0, 8, (np.frexp(lowest.astype(np.float64))[1] - 1) >> 3)
        live = live[differs == 0]
    length = np.minimum(np.minimum(length, LONGEST), end[tile[at]] - at)
    order = np.argsort(at)
    return at[order], length[order], (at - before)[order]


def _taken(start: np.ndarray, length: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which matches a reader from left to right takes, for all tiles side by side."""
    start, length = np.r_[start, end.max()], np.r_[length, 0]
    at, chosen = first, []
    while len(at):
        k = np.searchsorted(start, at)
        more = start[k] < end
        k, end = k[more], end[more]
        chosen.append(k)
        at = start[k] + length[k]
    return np.sort(np.concatenate(chosen))


@lru_cache(maxsize=1)
def _distance_codes() -> np.ndarray:
    """The code of each distance within a tile."""
    codes = np.arange(TILE + 1) + 120
    for far, code in _near(WIDTH).items():
        if far <= TILE:
            codes[far] = code
    return codes


def _encode_together(data: np.ndarray, size: np.ndarray) -> list[bytes]:
    """The files of tiles of so many samples each that take no transform, as ``encode_webp`` makes them."""
    tiles, end = len(size), np.cumsum(size)
    first = end - size
    start, length, far = _tile_matches(data, first, end)
    k = _taken(start, length, first, end)
    start, length, far = start[k], length[k], far[k]
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    inside[start + 1] = 1
    inside[start + length] = -1
    refers = np.zeros(len(data), dtype=bool)
    refers[start] = True
    at = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8) == 0)  # where symbols begin
    tile = np.repeat(np.arange(tiles), size)[at]
    symbol, back = data[at].astype(np.int64), np.flatnonzero(refers[at])
    prefix, more, more_bits = _prefixed(length)
    symbol[back] = 256 + prefix
    place, further, further_bits = _prefixed(_distance_codes()[far])
    symbols = np.bincount(tile * ALPHABETS[0] + symbol, minlength=tiles * ALPHABETS[0]).reshape(tiles, -1)
    places = np.bincount(tile[back] * ALPHABETS[4] + place, minlength=tiles * ALPHABETS[4]).reshape(tiles, -1)
    tables = [np.zeros((2, tiles, n), dtype=np.int64) for n in (ALPHABETS[0], ALPHABETS[4])]  # codes and their lengths
    heads = []
    for t in range(tiles):
        out = BitWriter()
        write_header(out, WIDTH, int(size[t]) // WIDTH)
        out.write(0, 3)  # no transform, no colour cache, no entropy image
        for counts, table, constant in ((symbols[t], tables[0], (0, 0, 255)), (places[t], tables[1], ())):
            used = np.flatnonzero(counts)
            if len(used) < 2:
                out.write(*_one_symbol(int(used[0]) if len(used) else 0))
            else:
                lengths = code_lengths(counts)
                write_prefix_code(out, lengths)
                table[0, t], table[1, t] = codes_of(lengths), lengths
            for s in constant:
                out.write(*_one_symbol(s))
        heads.append((out.bytes(), out.at))
    value, width = tables[0][0, tile, symbol], tables[0][1, tile, symbol]
    v, w, of = value[back], width[back], tile[back]
    for part, bits in ((more, more_bits), (tables[1][0, of, place], tables[1][1, of, place]), (further, further_bits)):
        v |= part << w
        w += bits
    value[back], width[back] = v, w
    written = np.r_[0, np.cumsum(width)]
    edge = np.searchsorted(tile, np.arange(tiles + 1))
    head = np.array([n for _, n in heads])
    n_bytes = (head + np.diff(written[edge]) + 7) // 8
    base = np.cumsum(n_bytes) - n_bytes
    bit = written[:-1] - written[edge[:-1]][tile] + (8 * base + head)[tile]
    value <<= bit & 7
    byte, buffer = bit >> 3, np.zeros(int(n_bytes.sum()) + 8, dtype=np.uint8)
    while len(value):  # bits of different symbols never meet, so their sum is their union
        buffer |= np.bincount(byte, weights=value & 255, minlength=len(buffer)).astype(np.uint8)
        value, byte = value >> 8, byte + 1
        left = value > 0
        value, byte = value[left], byte[left]
    for at, (bits, _) in zip(base.tolist(), heads):
        buffer[at : at + len(bits)] |= np.frombuffer(bits, dtype=np.uint8)
    stored = buffer.tobytes()
    return [riff(stored[a : a + n]) for a, n in zip(base.tolist(), n_bytes.tolist())]


def _encode_tiles(tiles: list[bytes]) -> list[bytes]:
    """The file of each tile of samples."""
    data, size = np.frombuffer(b"".join(tiles), dtype=np.uint8), np.array([len(t) for t in tiles])
    plain = _plain_tiles(data, np.cumsum(size) - size, size // WIDTH)
    together = iter(_encode_together(data[np.repeat(plain, size)], size[plain]) if plain.any() else [])
    return [next(together) if p else encode_webp(_grey(t)) for p, t in zip(plain.tolist(), tiles)]


def _grey(samples: bytes) -> np.ndarray:
    """A picture of samples."""
    return (np.frombuffer(samples, dtype=np.uint8).astype(np.uint32) << 8 | np.uint32(0xFF000000)).reshape(-1, WIDTH)


def to_media_many(payloads: list[bytes]) -> list[bytes]:
    """``to_media`` of each payload, a bounded number of samples at a time."""
    tiles = [p[a : a + TILE] for p in payloads for a in range(0, len(p), TILE)]
    ends = np.cumsum([len(t) for t in tiles]) if tiles else np.zeros(0)
    files: list[bytes] = []
    while (i := len(files)) < len(tiles):
        base = ends[i - 1] if i else 0
        j = max(i + 1, min(i + TOGETHER_TILES, int(np.searchsorted(ends, base + TOGETHER, side="right"))))
        files += _encode_tiles(tiles[i:j])
    made = iter(files)
    return [b"".join(next(made) for _ in range(0, len(p), TILE)) for p in payloads]


def _grey_start(data: bytes) -> tuple[Bits, int, PrefixCode, PrefixCode] | None:
    """Where the symbols of a picture of samples without transforms begin, its size, and its two codes; None for any other file."""
    try:
        bits = Bits(vp8l_payload(data))
        width, height = _header(bits)
        if width != WIDTH or height > TILE_ROWS or bits.read(3):  # a transform, a colour cache or an entropy image
            return None
        green, red, blue, alpha, distance = (read_prefix_code(bits, n) for n in ALPHABETS)
    except (ValueError, IndexError):
        return None
    return None if not green.width or red.width or blue.width or alpha.width else (bits, width * height, green, distance)


def _code_table(codes: list[PrefixCode]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The codes' tables one after the other, where each begins, and the mask of the bits it looks at."""
    tables = [c.entry if c.width else np.array([c.only << 4], dtype=np.int32) for c in codes]
    size = np.array([len(t) for t in tables])
    return np.concatenate(tables).astype(np.int64), np.cumsum(size) - size, size - 1


def _decode_together(started: list[tuple[Bits, int, PrefixCode, PrefixCode]]) -> list[np.ndarray | None]:
    """The samples of each picture, None for broken ones: a symbol of every picture a step, then all back-references at once."""
    data = [s[0].data for s in started]
    byte = np.cumsum([0, *map(len, data)])
    words = np.ndarray(int(byte[-1]) + 8, "<i8", b"".join(data) + bytes(16), 0, (1,)).copy()
    at, end = (np.array([getattr(s[0], f) for s in started]) + 8 * byte[:-1] for f in ("at", "end"))
    stop = np.cumsum([s[1] for s in started])
    start = stop - [s[1] for s in started]
    table, offset, mask = _code_table([s[2] for s in started])
    far_table, far_offset, far_mask = _code_table([s[3] for s in started])
    extra, least = np.array(_EXTRA), np.array(_LEAST)
    short = np.array([0, *(max(1, dx + dy * WIDTH) for dx, dy in DISTANCE_MAP)])
    out, broken, copies = np.zeros(int(stop[-1]), dtype=np.uint8), np.zeros(len(started), dtype=bool), []
    lane, pos, first, last = np.arange(len(started)), start.copy(), start, stop
    while len(lane):
        entry = table[offset + (words[at >> 3] >> (at & 7) & mask)]
        at += entry & 15
        symbol = entry >> 4
        out[pos] = symbol & 255
        pos += 1
        back = np.flatnonzero(symbol > 255)
        if len(back):
            a, begin, p = at[back], pos[back] - 1, symbol[back] - 256
            run = least[p] + (words[a >> 3] >> (a & 7) & ((1 << extra[p]) - 1))
            a += extra[p]
            entry = far_table[far_offset[back] + (words[a >> 3] >> (a & 7) & far_mask[back])]
            a += entry & 15
            p = entry >> 4
            code = least[p] + (words[a >> 3] >> (a & 7) & ((1 << extra[p]) - 1))
            at[back] = a + extra[p]
            far = np.where(code > 120, code - 120, short[np.minimum(code, 120)])
            wrong = (far > begin - first[back]) | (begin + run > last[back])
            if wrong.any():
                broken[lane[back[wrong]]] = True
                run[wrong], far[wrong] = (last[back] - begin)[wrong], 0
            copies.append((begin, run, far))
            pos[back] = begin + run
        gone = (pos >= last) | (at > end)
        if gone.any():
            broken[lane[at > end]] = True
            lane, at, end, pos, first, last, offset, mask, far_offset, far_mask = (x[~gone] for x in (lane, at, end, pos, first, last, offset, mask, far_offset, far_mask))
    if copies:
        begin, run, far = (np.concatenate(c) for c in zip(*copies))
        copied = np.arange(int(run.sum())) + np.repeat(begin - np.cumsum(run) + run, run)
        source = np.arange(len(out))
        source[copied] -= np.repeat(far, run)
        while True:  # a copy of a copy: twice as far back each time
            nearer = source[copied]
            further = source[nearer]
            if (nearer == further).all():
                break
            source[copied] = further
        out[copied] = out[nearer]
    return [None if b else out[i:j] for b, i, j in zip(broken.tolist(), start.tolist(), stop.tolist())]


def samples_of_many(media: list[bytes]) -> Iterator[np.ndarray | ValueError]:
    """``samples_of`` of each series of files in turn, or its error."""

    def samples(files: list[list[bytes] | ValueError]) -> Iterator[np.ndarray | ValueError]:
        flat = [f for series in files if isinstance(series, list) for f in series]
        found: list[np.ndarray | None] = []
        for i in range(0, len(flat), DECODED_TILES):
            started = [_grey_start(f) for f in flat[i : i + DECODED_TILES]]
            together = iter(_decode_together([s for s in started if s]) if any(started) else [])
            found += [next(together) if s else None for s in started]
        at = 0
        for series in files:
            if isinstance(series, ValueError):
                yield series
                continue
            parts = found[at : at + len(series)]
            at += len(series)
            try:
                yield np.concatenate([(decode_webp(f) >> 8 & 0xFF).astype(np.uint8).ravel() if p is None else p for f, p in zip(series, parts)])
            except ValueError as e:
                yield e

    held: list[list[bytes] | ValueError] = []
    n_files = 0
    for m in media:
        try:
            files = split_files(m)
            held.append(files or ValueError("no file"))
        except ValueError as e:
            held.append(e)
        n_files += len(held[-1]) if isinstance(held[-1], list) else 1
        if n_files >= DECODED_TILES:
            yield from samples(held)
            held, n_files = [], 0
    yield from samples(held)


def feature_of(samples: np.ndarray, width: int = WIDTH) -> str:
    """Size, mean, deviation, entropy and mean vertical step of the samples."""
    x = samples.astype(np.float64)
    p = np.bincount(samples, minlength=256) / len(samples)
    p = p[p > 0]
    step = float(np.abs(np.diff(x.reshape(-1, width), axis=0)).mean()) if len(x) > width else 0.0
    return f"{width}x{len(x) // width};mean={x.mean():.4f};sd={x.std():.4f};entropy={-(p * np.log2(p)).sum() + 0.0:.4f};dy={step:.4f}"


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (a series of WebP files) of every whole text; null counts as empty."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in text_slices(batch.column(1)):
                texts = utf8(batch.column(1), i, j)
                media = to_media_many([payload_of(t) for t in texts])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"]
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, encode, "doc_id long, n_bytes long, media binary")


def decode_media(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, the digests of payload and media, the feature, and error, all of what the stored files decode to.

    Null or broken media give a row with the reason in error and nulls in what
    could not be read.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def read(m: bytes | None, samples: np.ndarray | ValueError) -> tuple:
        if m is None:
            return (None, None, None, None, None, None, "null media")
        stored = (len(m), hashlib.sha256(m).hexdigest())
        if isinstance(samples, ValueError):
            return (None, None, None, *stored, None, str(samples))
        payload = samples.tobytes()
        return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), *stored, feature_of(samples), None)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in text_slices(batch.column(2)):
                stored = batch.column(2).slice(i, j - i).to_pylist()
                rows = list(map(read, stored, samples_of_many([m or b"" for m in stored])))
                made = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), *made], [c.split()[0] for c in schema.split(", ")])

    return arrow_map(media.select("doc_id", "n_bytes", "media"), decode, schema)


def pixel_arrays(images: DataFrame, media: str = "media") -> DataFrame:
    """images with width, height, pixels (ARGB as 32-bit little-endian integers, row by row) and error of one WebP file a row.

    Null or broken files give null pixels and the reason in error; columns of
    these four names in images are replaced.
    """
    kept = [c for c in images.columns if c not in ("width", "height", "pixels", "error")]
    rows = images.select(*kept)
    at = kept.index(media)
    schema = StructType([*rows.schema.fields, *StructType.fromDDL("width int, height int, pixels binary, error string").fields])

    def read(m: bytes | None) -> tuple:
        if m is None:
            return (None, None, None, "null media")
        try:
            argb = decode_webp(bytes(m))
        except ValueError as e:
            return (None, None, None, str(e))
        return (argb.shape[1], argb.shape[0], argb.astype("<u4").tobytes(), None)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):  # a picture can be large
                made = [pa.array([v], t) for v, t in zip(read(batch.column(at)[r].as_py()), (pa.int32(), pa.int32(), pa.binary(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.slice(r, 1).columns, *made], schema.names)

    return arrow_map(rows, decode, schema)
