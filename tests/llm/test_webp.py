"""The decoder against an encoder of its own, written from the format, with every transform; and exact round trips."""

import numpy as np
import pytest

from tracewell.llm import webp as W


def _prefix(x):
    """Prefix, extra bits and their number of a length or distance."""
    x -= 1
    if x < 4:
        return x, 0, 0
    h = x.bit_length() - 1
    return 2 * h + (x >> (h - 1) & 1), x & ((1 << (h - 1)) - 1), h - 1


def _write_image(out, argb, width, main, cache_bits=0, groups=None):
    """Literals, runs of the pixel before, and colour-cache hits; groups: block bits and group of each block."""
    px = [int(p) for p in argb.ravel()]
    out.write(int(cache_bits > 0), 1)
    if cache_bits:
        out.write(cache_bits, 4)
    block, group_of = groups or (0, np.zeros((1, 1), dtype=int))
    if main:
        out.write(int(groups is not None), 1)
        if groups:
            out.write(block - 2, 3)
            _write_image(out, (group_of.astype(np.uint32) << 8), group_of.shape[1], False)
    events, cache, k = [], {}, 0

    def group(at):
        return int(group_of[at // width >> block, at % width >> block]) if groups else 0

    while k < len(px):
        run = 0
        while k and k + run < len(px) and px[k + run] == px[k - 1] and run < 4000:
            run += 1
        slot = (0x1E35A7BD * px[k] & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else None
        if run >= 4:
            events.append((group(k), "run", run))
            step = run
        else:
            hit = cache_bits and cache.get(slot) == px[k]
            events.append((group(k), "hit", slot) if hit else (group(k), "pixel", px[k]))
            step = 1
        for p in px[k : k + step]:
            if cache_bits:
                cache[(0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
        k += step
    n_groups = int(group_of.max()) + 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    counts = [[np.zeros(s, dtype=int) for s in sizes] for _ in range(n_groups)]
    for g, kind, v in events:
        c = counts[g]
        if kind == "pixel":
            for table, shift in zip(c, (8, 16, 0, 24)):
                table[v >> shift & 255] += 1
        elif kind == "run":
            c[0][256 + _prefix(v)[0]] += 1
            c[4][_prefix(2)[0]] += 1  # code 2 is the pixel to the left
        else:
            c[0][280 + v] += 1
    lengths = [[W.code_lengths(t, 15) for t in c] for c in counts]
    codes = [[W.codes_of(n) for n in c] for c in lengths]
    for c in lengths:
        for n in c:
            W.write_prefix_code(out, n)

    def put(g, table, symbol):
        if sum(map(bool, lengths[g][table])) > 1:
            out.write(codes[g][table][symbol], lengths[g][table][symbol])

    for g, kind, v in events:
        if kind == "pixel":
            for table, shift in enumerate((8, 16, 0, 24)):
                put(g, table, v >> shift & 255)
        elif kind == "run":
            p, extra, n = _prefix(v)
            put(g, 0, 256 + p)
            out.write(extra, n)
            put(g, 4, _prefix(2)[0])
        else:
            put(g, 0, 280 + v)


def _bytes(p):
    return [p >> s & 255 for s in (24, 16, 8, 0)]


def _pack(c):
    return (c[0] & 255) << 24 | (c[1] & 255) << 16 | (c[2] & 255) << 8 | c[3] & 255


def _guess(mode, left, top, tl, tr):
    avg = lambda a, b: [(x + y) // 2 for x, y in zip(a, b)]
    clamp = lambda v: max(0, min(255, v))
    if mode == 11:
        pl = sum(abs(t - c) for t, c in zip(top, tl))
        pt = sum(abs(a - c) for a, c in zip(left, tl))
        return left if pl < pt else top
    if mode == 12:
        return [clamp(a + t - c) for a, t, c in zip(left, top, tl)]
    if mode == 13:
        return [clamp(m + int((m - c) / 2)) for m, c in zip(avg(left, top), tl)]
    return [
        [255, 0, 0, 0], left, top, tr, tl, avg(avg(left, tr), top), avg(left, tl), avg(left, top), avg(tl, top), avg(top, tr), avg(avg(left, tl), avg(top, tr)),
    ][mode]


def _predicted(argb, modes, bits):
    h, w = argb.shape
    out = argb.copy()
    for y in range(h):
        for x in range(w):
            at = lambda j, i: _bytes(int(argb.ravel()[j * w + i]))
            if y == 0:
                guess = [255, 0, 0, 0] if x == 0 else at(0, x - 1)
            elif x == 0:
                guess = at(y - 1, 0)
            else:
                guess = _guess(int(modes[y >> bits, x >> bits]), at(y, x - 1), at(y - 1, x), at(y - 1, x - 1), at(y - 1, x + 1))
            out[y, x] = _pack([a - b for a, b in zip(_bytes(int(argb[y, x])), guess)])
    return out


def _delta(t, c):
    s = lambda v: (v & 255) - 256 if v & 128 else v & 255
    return s(t) * s(c) >> 5


def _image(rng, h, w, colours=None):
    if colours is not None:
        img = colours[rng.integers(0, len(colours), (h, w))]
        img[h // 2] = img[h // 2, 0]
        return img
    y, x = np.mgrid[:h, :w]
    img = (0xFF000000 | (x * 7 % 256) << 16 | (y * 5 % 256) << 8 | (x * y % 256)).astype(np.uint32)
    img[2 : h // 2, 1] = 0x80402010
    img[h - 3 :] = img[0, 0]
    return img


def _file(argb, transforms, cache_bits=0, groups=None):
    h, w = argb.shape
    out, inner = W.BitWriter(), w
    W.write_header(out, w, h, 1)
    for kind, what, bits in transforms:
        out.write(1, 1)
        out.write(kind, 2)
        if kind == W.PREDICTOR:
            out.write(bits - 2, 3)
            _write_image(out, what.astype(np.uint32) << 8, what.shape[1], False)
            argb = _predicted(argb, what, bits)
        elif kind == W.CROSS_COLOUR:
            out.write(bits - 2, 3)
            _write_image(out, what, what.shape[1], False)
            new = argb.copy()
            for y in range(argb.shape[0]):
                for x in range(argb.shape[1]):
                    a, r, g, b = _bytes(int(argb[y, x]))
                    _, r2b, g2b, g2r = _bytes(int(what[y >> bits, x >> bits]))
                    new[y, x] = _pack([a, r - _delta(g2r, g), g, b - _delta(g2b, g) - _delta(r2b, r)])
            argb = new
        elif kind == W.SUBTRACT_GREEN:
            argb = np.vectorize(lambda p: _pack([_bytes(int(p))[0], _bytes(int(p))[1] - _bytes(int(p))[2], _bytes(int(p))[2], _bytes(int(p))[3] - _bytes(int(p))[2]]))(argb).astype(np.uint32)
        else:
            out.write(len(what) - 1, 8)
            steps = [_pack([a - b for a, b in zip(_bytes(int(c)), _bytes(int(p)))]) for c, p in zip(what, [0, *what[:-1]])]
            _write_image(out, np.array(steps, dtype=np.uint32), len(what), False)
            index = np.searchsorted(what, argb)
            pack = 3 if len(what) <= 2 else 2 if len(what) <= 4 else 1 if len(what) <= 16 else 0
            each, inner = 8 >> pack, -(-inner // (1 << pack))
            packed = np.zeros((h, inner), dtype=np.uint32)
            for x in range(w):
                packed[:, x >> pack] |= (index[:, x] << (each * (x & ((1 << pack) - 1)))).astype(np.uint32)
            argb = packed << 8 | 0xFF000000
    out.write(0, 1)
    _write_image(out, argb, inner, True, cache_bits, groups)
    return W.riff(out.bytes())


@pytest.mark.parametrize("cache_bits", [0, 1, 6])
@pytest.mark.parametrize("grouped", [False, True])
def test_entropy_coding(cache_bits, grouped):
    rng = np.random.default_rng(1)
    img = _image(rng, 21, 19)
    groups = (2, rng.integers(0, 3, (6, 5))) if grouped else None
    assert (W.decode_webp(_file(img, [], cache_bits, groups)) == img).all()


@pytest.mark.parametrize("mode", range(14))
def test_predictor(mode):
    img = np.random.default_rng(mode).integers(0, 1 << 32, (9, 11), dtype=np.uint32)
    modes = np.full((3, 3), mode)
    modes[1, 1] = (mode + 5) % 14
    assert (W.decode_webp(_file(img, [(W.PREDICTOR, modes, 2)])) == img).all()


@pytest.mark.parametrize("n", [1, 2, 3, 4, 11, 16, 17, 200])
def test_palette(n):
    rng = np.random.default_rng(n)
    colours = np.unique(rng.integers(0, 1 << 32, n, dtype=np.uint32))
    img = _image(rng, 7, 13, colours)
    assert (W.decode_webp(_file(img, [(W.PALETTE, colours, 0)])) == img).all()


def test_all_transforms_together():
    rng = np.random.default_rng(5)
    img = _image(rng, 16, 18)
    cross = rng.integers(0, 1 << 24, (4, 5), dtype=np.uint32)
    plan = [(W.PREDICTOR, rng.integers(0, 14, (4, 5)), 2), (W.CROSS_COLOUR, cross, 2), (W.SUBTRACT_GREEN, None, 0)]
    assert (W.decode_webp(_file(img, plan, 4)) == img).all()


def test_broken_files():
    good = _file(_image(np.random.default_rng(0), 12, 12), [])
    for bad in (b"", good[:15], good[:-6], b"RIFX" + good[4:]):
        with pytest.raises(ValueError):
            W.decode_webp(bad)


def test_extended_files():
    img = _image(np.random.default_rng(0), 12, 12)
    chunk = _file(img, [])[12:]
    extended = b"WEBPVP8X" + (10).to_bytes(4, "little") + bytes(10) + b"EXIF" + (3).to_bytes(4, "little") + b"abc\0" + chunk
    assert (W.decode_webp(b"RIFF" + len(extended).to_bytes(4, "little") + extended) == img).all()


def test_round_trip_of_bytes():
    rng = np.random.default_rng(3)
    texts = [b"", b"a", b"x" * 64, b"ab" * 5000, bytes(rng.integers(0, 256, 9000, dtype=np.uint8)), *(bytes(rng.integers(97, 110, n, dtype=np.uint8)) for n in range(60, 160, 3))]
    for t in texts:
        payload = W.samples_of(W.to_media(W.payload_of(t))).tobytes()
        assert len(payload) % 64 == 0 and payload == t + b"\0" * (len(payload) - len(t)) and len(payload) >= 64


def _payloads():
    """Texts of all lengths, with repeats, few and many byte values, steps that a predictor takes, and none."""
    rng = np.random.default_rng(5)
    words = [bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in rng.integers(2, 12, 300)]
    prose = [b" ".join(words[k] for k in rng.integers(0, 300, n)) for n in (3, 10, 60, 61, 400, 3000)]
    steep = (np.cumsum(rng.integers(-2, 3, 8192)) & 255).astype(np.uint8).tobytes()
    return [W.payload_of(t) for t in (b"", b"a", b"x" * 9000, b"ab" * 5000, bytes(range(256)) * 40, bytes(rng.integers(0, 256, 9000, dtype=np.uint8)), steep, *prose, *prose)]


@pytest.mark.parametrize("tiles, samples, decoded", [(4096, 1 << 20, 1024), (2, 1 << 20, 1), (4096, 5000, 3)])
def test_many_at_once_are_what_one_is(monkeypatch, tiles, samples, decoded):
    for name, value in (("TOGETHER_TILES", tiles), ("TOGETHER", samples), ("DECODED_TILES", decoded)):
        monkeypatch.setattr(W, name, value)
    payloads = _payloads()
    media = W.to_media_many(payloads)
    assert media == [W.to_media(p) for p in payloads]
    together = [W._grey_start(f) is not None for m in media for f in W.split_files(m)]
    assert any(together) and not all(together)
    assert [s.tobytes() for s in W.samples_of_many(media)] == payloads == [W.samples_of(m).tobytes() for m in media]
    assert W.to_media_many([]) == [] == list(W.samples_of_many([]))


def test_broken_files_among_others():
    """Each damaged file gives what a decode of it alone gives, and leaves its neighbours alone."""
    rng = np.random.default_rng(6)
    good = W.to_media_many(_payloads())
    media = []
    for m in good:
        bad = bytearray(m)
        for k in rng.integers(20, len(m), 3):
            bad[k] ^= 1 << int(rng.integers(8))
        media += [m, bytes(bad), m[: len(m) // 2]]
    for m, got in zip(media, W.samples_of_many(media)):
        try:
            assert (got == W.samples_of(m)).all()
        except ValueError as e:
            assert str(got) == str(e)


def _steps(monkeypatch, media):
    """What a general decode of the files runs: transforms, back-references, colour cache."""
    seen = set()
    for name in ("undo_predictor", "undo_cross_colour", "undo_subtract_green", "undo_palette"):
        monkeypatch.setattr(W, name, lambda *a, f=getattr(W, name), n=name: seen.add(n) or f(*a))
    read = W.read_image

    def watched(bits, width, height, main):
        seen.update(["cache"] if bits.peek(1) else [])
        return read(bits, width, height, main)

    class Lengths(list):
        def __getitem__(self, k):
            seen.add("back-reference")
            return super().__getitem__(k)

    monkeypatch.setattr(W, "read_image", watched)
    monkeypatch.setattr(W, "_LEAST", Lengths(W._LEAST))
    return [W.decode_webp(f) for f in W.split_files(media)], seen


def test_every_step_is_stored_where_it_pays(monkeypatch):
    rng = np.random.default_rng(4)
    y, x = np.mgrid[:96, :80]
    noise = rng.integers(0, 4, (3, 96, 80))
    smooth = (0xFF000000 | (x + noise[0]) << 16 | (y + noise[1]) << 8 | ((x + y) // 2 + noise[2])).astype(np.uint32)
    g = rng.integers(0, 64, (96, 80))
    tied = (0xFF000000 | (g + noise[0]) << 16 | g << 8 | (g + noise[1])).astype(np.uint32)
    steep = np.cumsum(rng.integers(-3, 4, (96, 80)), axis=1)
    crossed = (0xFF000000 | (steep * 2 & 255) << 16 | (steep & 255) << 8 | (steep * 3 & 255)).astype(np.uint32)
    few = np.array([0xFF102030, 0xFFA0B0C0, 0x80FF0000], dtype=np.uint32)[rng.integers(0, 3, (50, 47))]
    many = rng.integers(0, 1 << 32, 2000, dtype=np.uint32)
    cached = many[(rng.integers(0, 12, 96 * 80) + np.arange(96 * 80) // 10).reshape(96, 80) % 2000]
    text = (b"the same passage comes again and " * 60)[: 64 * 30]
    images = [smooth, tied, crossed, few, cached, (np.frombuffer(text, dtype=np.uint8).astype(np.uint32) << 8 | 0xFF000000).reshape(-1, 64)]
    media = b"".join(W.encode_webp(i) for i in images)
    got, seen = _steps(monkeypatch, media)
    assert all((a == b).all() for a, b in zip(got, images))
    assert seen == {"undo_predictor", "undo_cross_colour", "undo_subtract_green", "undo_palette", "cache", "back-reference"}


@pytest.mark.parametrize("shape", [(1, 1), (1, 9), (9, 1), (5, 600), (513, 3)])
def test_encoder_on_odd_shapes(shape):
    rng = np.random.default_rng(shape[0])
    for top in (1, 2, 3, 20, 1 << 32):
        img = rng.integers(0, top, shape, dtype=np.uint32)
        assert (W.decode_webp(W.encode_webp(img)) == img).all()


def test_media_columns(spark):
    good = W.encode_webp(np.arange(12, dtype=np.uint32).reshape(3, 4))
    rows = [(1, 2, good), (2, 2, None), (3, 2, good[:-5]), (4, 2, b"RIFF"), (5, 2, b"")]
    media = spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in W.decode_media(media).collect()}
    assert len(got) == 5 and got[1].error is None and got[1].payload_bytes == 12
    assert all(got[k].error and got[k].payload_sha256 is None for k in (2, 3, 4, 5))
    px = {r.doc_id: r for r in W.pixel_arrays(media.withColumn("width", media.doc_id)).collect()}
    assert (px[1].width, px[1].height) == (4, 3) and np.frombuffer(px[1].pixels, "<u4").tolist() == list(range(12))
    assert all(px[k].pixels is None and px[k].error for k in (2, 3, 4, 5))
    assert W.decode_media(media.limit(0)).count() == 0
