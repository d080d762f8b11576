import numpy as np
import pytest

from leafmill.functions import imaging as I
from leafmill.functions import pixels as K

rng = np.random.default_rng(1)
NOISE = rng.integers(0, 256, (40, 60, 3)).astype(np.uint8)
WHITE = np.full((40, 60, 3), 255, np.uint8)


def flood(mask):
    h, w = mask.shape
    out, n = np.zeros((h, w), int), 0
    for y in range(h):
        for x in range(w):
            if mask[y, x] and not out[y, x]:
                n += 1
                todo, out[y, x] = [(y, x)], n
                while todo:
                    a, b = todo.pop()
                    for c in range(max(a - 1, 0), min(a + 2, h)):
                        for d in range(max(b - 1, 0), min(b + 2, w)):
                            if mask[c, d] and not out[c, d]:
                                out[c, d] = n
                                todo.append((c, d))
    return out


@pytest.mark.parametrize("seed", range(8))
def test_labels_against_flood_fill(seed):
    r = np.random.default_rng(seed)
    for _ in range(25):
        mask = r.random((r.integers(1, 15), r.integers(1, 15))) > r.random()
        assert (K.labels(mask) == flood(mask)).all()


def test_regions_and_their_least_size():
    img = WHITE.copy()
    img[2:5, 3:10] = 0
    img[20:40, 30:60] = 10
    assert K.regions(img) == [(3, 2, 7, 3), (30, 20, 30, 20)]
    assert K.regions(WHITE) == []
    page = np.full((400, 300, 3), 255, np.uint8)
    page[100:200, 50:150] = 0
    page[300:350, 10:60] = 0
    (got,) = K.region_crops(page, 150, 200)
    assert got[:4] == (25, 50, 75, 100) and got[4].shape == (100, 100, 3)


@pytest.mark.parametrize("shape", [(1, 1), (7, 5), (7, 5, 3), (7, 5, 4)])
def test_png_round_trip(shape):
    img = rng.integers(0, 256, shape).astype(np.uint8)
    assert (K.png_decode(K.png_encode(img)) == img).all()


@pytest.mark.parametrize("data", [b"", b"\x89PNG\r\n\x1a\n", b"GIF89a"])
def test_png_that_is_none(data):
    assert K.png_decode(data) is None


def test_lab_round_trip():
    assert np.abs(I.from_lab(I.to_lab(NOISE)).astype(int) - NOISE).max() <= 1


def test_gaussian_and_unsharp():
    flat = np.full((9, 9), 77, np.uint8)
    assert np.allclose(K.gaussian(flat, 1.3), 77) and (K.unsharp(flat) == 77).all()
    point = np.zeros((21, 21))
    point[10, 10] = 1
    g = K.gaussian(point, 1.0)
    assert abs(g.sum() - 1) < 1e-9 and abs(g[10, 11] / g[10, 10] - np.exp(-0.5)) < 1e-9


def test_box_mean():
    a = rng.random((8, 9))
    p = np.pad(a, 1, mode="reflect")
    want = sum(p[i : i + 8, j : j + 9] for i in range(3) for j in range(3)) / 9
    assert np.allclose(I.box(a, 3), want)


@pytest.mark.parametrize("factor", [2, 3])
def test_bicubic_keeps_flat_and_linear(factor):
    flat = np.full((4, 5), 9, np.uint8)
    assert (K.bicubic(flat, factor) == 9).all()
    assert I.resize(NOISE, 30, 20).shape == (20, 30, 3) and (I.resize(NOISE, 60, 40) == NOISE).all()


def test_morphology():
    m = np.zeros((9, 9), bool)
    m[4, 4] = True
    assert I.dilate(m).sum() == 5 and not I.opened(m).any() and I.erode(np.ones((3, 3), bool)).all()


def test_postprocess_rules():
    dark = np.full((6, 6, 3), 2, np.uint8)
    assert (K.postprocess(dark) == dark).all()
    red = np.zeros((6, 6, 3), np.uint8)
    red[..., 0] = 200
    red[..., 1] = 40
    assert K.postprocess(red)[..., 2].mean() > K.postprocess(red)[..., 0].mean()


def test_marks_are_filled_and_colour_and_edges_stay():
    img = np.full((80, 80, 3), 230, np.uint8)
    y, x = np.mgrid[:80, :80]
    spot = 90 * np.exp(-((y - 40) ** 2 + (x - 40) ** 2) / 60.0)
    marked = (img - spot[..., None]).astype(np.uint8)
    assert np.abs(I.remove_marks(marked).astype(int) - 230).sum() < np.abs(marked.astype(int) - 230).sum()
    assert (I.remove_marks(img) == img).all()


def test_denoise_and_clahe():
    noisy = np.clip(128 + rng.normal(0, 10, (32, 32, 3)), 0, 255).astype(np.uint8)
    assert I.non_local_means(noisy, 15).std() < noisy.std()
    assert I.bilateral(noisy).std() < noisy.std()
    ramp = np.tile(np.linspace(100, 140, 64), (64, 1))
    assert I.clahe(ramp, 40.0, 4).std() > ramp.std()


def test_otsu_parts_two_levels():
    a = np.array([[10] * 5 + [200] * 5] * 4, np.uint8)
    assert 10 <= I.otsu(a) < 200 and I.otsu(np.full((3, 3), 7, np.uint8)) == 0


@pytest.mark.parametrize("seed", range(5))
def test_trace_and_rasterise_are_inverse(seed):
    ink = np.random.default_rng(seed).random((17, 23)) > 0.6
    assert ((I.rasterise(I.trace(ink, 1))[..., 0] == 0) == ink).all()


def test_trace_leaves_specks_out():
    ink = np.zeros((30, 30), bool)
    ink[2, 2] = True
    ink[10:20, 10:20] = True
    got = I.rasterise(I.trace(ink, 50))[..., 0] == 0
    assert got.sum() == 100 and I.trace(np.zeros((4, 4), bool)) is None and I.trace(ink, 500) is None


@pytest.mark.parametrize("w, h, want", [(6, 6, True), (5, 9, False), (200, 101, False), (120, 9, False), (72, 6, True), (6, 76, False)])
def test_small_text_rule(w, h, want):
    assert I.is_small_text(w, h) is want


def test_enhance_undecodable_gives_a_white_picture():
    e = I.enhance(b"junk", 20, 10)
    img = I.decode(e.data)
    # one grey all over: the paper step takes 0.85 of white
    assert (e.width, e.height, e.ext) == (80, 40, "png") and img.std() == 0 and img.min() >= 215


def test_enhance_hooks_and_their_failures():
    I.HOOKS["super_resolution"] = lambda img: 1 / 0
    I.HOOKS["faces"] = lambda img: img[:4, :4]
    try:
        e = I.enhance(K.png_encode(NOISE), photo=True)
        assert (e.width, e.height) == (4, 4)
    finally:
        I.HOOKS.clear()


def test_normalise_takes_the_first_that_is_a_picture():
    assert I.normalise(None, b"junk") is None
    assert I.normalise(b"junk", NOISE) == K.png_encode(NOISE)
    jpeg = b"\xff\xd8 some \xff\xd9"
    assert I.normalise(jpeg, NOISE) == jpeg
    rgba = np.zeros((2, 2, 4), np.uint8)
    assert (I.decode(K.png_encode(rgba)) == 255).all()


def test_crop_by_points():
    assert I.crop(NOISE, 0, 0, 30, 20, 60, 40).shape == (20, 30, 3)
    assert I.crop(NOISE, 10, 10, 10, 20, 60, 40) is None


def walk(seg, mask):
    """Step by step, as the rule says."""
    import math

    x1, y1, x2, y2 = seg
    a = math.atan2(y2 - y1, x2 - x1)
    h, w = mask.shape

    def go(x, y, dx, dy):
        while 0 <= int(x) < w and 0 <= int(y) < h and x > -1 and y > -1 and mask[int(y), int(x)]:
            x, y = x + dx, y + dy
        return x, y

    b, f = go(x1, y1, -math.cos(a), -math.sin(a)), go(x2, y2, math.cos(a), math.sin(a))
    return int(max(0, b[0])), int(max(0, b[1])), int(min(w - 1, f[0])), int(min(h - 1, f[1]))


@pytest.mark.parametrize("seed", range(10))
def test_extend_against_single_steps(seed):
    r = np.random.default_rng(seed)
    mask = r.random((20, 30)) > 0.15
    off = 0
    for _ in range(30):
        seg = tuple(float(v) for v in (r.integers(0, 30), r.integers(0, 20), r.integers(0, 30), r.integers(0, 20)))
        got, want = K.extend(seg, mask), walk(seg, mask)
        off += max(abs(a - b) for a, b in zip(got, want)) > 1
    # steps added up and steps multiplied may fall on either side of a pixel's edge
    assert off <= 1


def test_ssim_of_equal_pictures():
    g = NOISE[..., 0]
    assert K.ssim(g, g) == pytest.approx(1) and K.ssim(g, 255 - g) < 0.1


def test_edges_of_a_step():
    a = np.zeros((20, 20), np.uint8)
    a[:, 10:] = 255
    e = K.edges(a)
    assert e[:, 8:12].any(1).all() and not e[:, :7].any() and not e[:, 13:].any()


def png(w, h, depth, kind, raw, extra=b""):
    """A PNG of given scan lines (filter bytes included)."""
    import struct
    import zlib

    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    img = rng.integers(0, 256, (6, 7, 3)).astype(int)
    raw = b""
    for y in range(6):
        line = b""
        for i in range(21):
            x, c = divmod(i, 3)
            a, b = img[y, x - 1, c] if x else 0, img[y - 1, x, c] if y else 0
            d = img[y - 1, x - 1, c] if x and y else 0
            e = a + b - d
            p = (0, a, b, (a + b) // 2, min((a, b, d), key=lambda v: abs(e - v)))[kind]
            line += bytes([(img[y, x, c] - p) & 255])
        raw += bytes([kind]) + line
    assert (K.png_decode(png(7, 6, 8, 2, raw)) == img).all()


def test_png_kinds():
    import struct
    import zlib

    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    assert K.png_decode(png(10, 1, 1, 0, b"\0\xaa\x80")).tolist() == [[255, 0, 255, 0, 255, 0, 255, 0, 255, 0]]
    assert K.png_decode(png(2, 1, 16, 0, b"\0\x12\xff\xab\x00")).tolist() == [[0x12, 0xAB]]
    assert K.png_decode(png(1, 1, 8, 4, b"\0\x07\x09")).tolist() == [[[7, 7, 7, 9]]]
    palette = chunk(b"PLTE", bytes([1, 2, 3, 4, 5, 6]))
    assert K.png_decode(png(2, 1, 4, 3, b"\0\x10", palette)).tolist() == [[[4, 5, 6], [1, 2, 3]]]
    assert K.png_decode(png(2, 1, 8, 3, b"\0\x01\x00", palette + chunk(b"tRNS", b"\x80"))).tolist() == [[[4, 5, 6, 255], [1, 2, 3, 128]]]
    assert K.png_decode(png(1, 1, 8, 3, b"\0\0")) is None
