"""Kernels on pixel arrays (numpy, H x W or H x W x 3 unless said otherwise) and a PNG codec on the standard library."""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np


def gaussian(img: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian blur with mirrored edges; the kernel reaches three sigma."""
    r = max(1, math.ceil(3 * sigma))
    x = np.arange(-r, r + 1)
    k = np.exp(-(x**2) / (2 * sigma**2))
    k /= k.sum()
    out = img.astype(np.float64)
    for axis in (0, 1):
        n = out.shape[axis]
        at = np.abs((np.arange(n)[:, None] + x[None, :]))
        period = max(2 * (n - 1), 1)
        at = at % period
        at = np.where(at >= n, period - at, at)
        moved = np.moveaxis(out, axis, 0)
        out = np.moveaxis(np.tensordot(moved[at], k, axes=([1], [0])) if out.ndim == 2 else np.einsum("nk...,k->n...", moved[at], k), 0, axis)
    return out


def to_uint8(img: np.ndarray) -> np.ndarray:
    """Clipped to 0..255 and truncated."""
    return np.clip(img, 0, 255).astype(np.uint8)


def unsharp(img: np.ndarray, sigma: float = 1.0, amount: float = 0.6) -> np.ndarray:
    """(1 + amount) image - amount blurred image."""
    return to_uint8((1 + amount) * img.astype(np.float64) - amount * gaussian(img, sigma))


def bicubic(img: np.ndarray, factor: int, a: float = -0.75) -> np.ndarray:
    """Enlarged by a whole factor by cubic convolution, edges repeated."""
    out = img.astype(np.float64)
    for axis in (0, 1):
        n = out.shape[axis]
        pos = (np.arange(n * factor) + 0.5) / factor - 0.5
        base = np.floor(pos).astype(int)
        t = np.abs(pos[:, None] - (base[:, None] + np.arange(-1, 3)))
        w = np.where(t <= 1, (a + 2) * t**3 - (a + 3) * t**2 + 1, np.where(t < 2, a * t**3 - 5 * a * t**2 + 8 * a * t - 4 * a, 0.0))
        at = np.clip(base[:, None] + np.arange(-1, 3), 0, n - 1)
        moved = np.moveaxis(out, axis, 0)
        out = np.moveaxis(np.einsum("nk...,nk->n...", moved[at], w), 0, axis)
    return to_uint8(np.rint(out))


def luma(img: np.ndarray) -> np.ndarray:
    """Grey values of an RGB image; a grey image stays."""
    return img.astype(np.float64) if img.ndim == 2 else img.astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def postprocess(img: np.ndarray, saturation: float = 1.05, brightness: float = 1.02, sigma: float = 0.8, amount: float = 0.6, dark: float = 6.0) -> np.ndarray:
    """Channels swapped where red outweighs blue by half, colour and brightness raised, sharpened; the input where the result is near black."""
    before = img
    if img.ndim == 3 and img[..., 0].mean() > 1.5 * img[..., 2].mean():
        img = img[..., ::-1]
    if img.ndim == 3:
        grey = np.rint(luma(img))[..., None]
        img = to_uint8(grey + max(0.95, saturation) * (img - grey))
    img = to_uint8(img * max(0.98, brightness))
    img = unsharp(img, sigma, amount)
    return to_uint8(before) if img.mean() < dark else img


def ssim(a: np.ndarray, b: np.ndarray, window: int = 7, peak: float = 255.0) -> float:
    """Mean structural similarity of two grey images over full windows, sample covariance."""
    w = min(window, *a.shape)
    x, y = (np.lib.stride_tricks.sliding_window_view(v.astype(np.float64), (w, w)) for v in (a, b))
    n = w * w
    mx, my = x.mean((-1, -2)), y.mean((-1, -2))
    norm = n / max(n - 1, 1)
    vx, vy = (x**2).mean((-1, -2)) - mx**2, (y**2).mean((-1, -2)) - my**2
    cxy = (x * y).mean((-1, -2)) - mx * my
    c1, c2 = (0.01 * peak) ** 2, (0.03 * peak) ** 2
    s = ((2 * mx * my + c1) * (2 * norm * cxy + c2)) / ((mx**2 + my**2 + c1) * (norm * (vx + vy) + c2))
    return float(s.mean())


def edges(img: np.ndarray, low: float = 50.0, high: float = 150.0) -> np.ndarray:
    """Edge mask: Sobel magnitude (sum of both directions), thinned along the gradient, weak edges kept where they touch strong ones."""
    g = np.pad(luma(img), 1, mode="edge")
    dx = (g[:-2, 2:] + 2 * g[1:-1, 2:] + g[2:, 2:]) - (g[:-2, :-2] + 2 * g[1:-1, :-2] + g[2:, :-2])
    dy = (g[2:, :-2] + 2 * g[2:, 1:-1] + g[2:, 2:]) - (g[:-2, :-2] + 2 * g[:-2, 1:-1] + g[:-2, 2:])
    mag = np.abs(dx) + np.abs(dy)
    m = np.pad(mag, 1)
    horizontal, vertical = np.abs(dy) <= 0.4142 * np.abs(dx), np.abs(dy) > 2.4142 * np.abs(dx)
    same = dx * dy >= 0
    c = m[1:-1, 1:-1]
    near = lambda a, b: (c > a) & (c >= b)
    peak = np.where(horizontal, near(m[1:-1, :-2], m[1:-1, 2:]), np.where(vertical, near(m[:-2, 1:-1], m[2:, 1:-1]), np.where(same, near(m[:-2, :-2], m[2:, 2:]), near(m[:-2, 2:], m[2:, :-2]))))
    weak, out = peak & (mag > low), peak & (mag > high)
    while True:
        p = np.pad(out, 1)
        grown = weak & (p[:-2, :-2] | p[:-2, 1:-1] | p[:-2, 2:] | p[1:-1, :-2] | p[1:-1, 1:-1] | p[1:-1, 2:] | p[2:, :-2] | p[2:, 1:-1] | p[2:, 2:])
        if (grown == out).all():
            return out
        out = grown | out


def labels(mask: np.ndarray) -> np.ndarray:
    """Number of each set pixel's connected region (8 neighbours), from 1 in order of its first pixel; 0 elsewhere.

    Runs of each row are joined with those they touch in the next; the smallest number spreads over all runs of a region.
    """
    h, w = mask.shape
    flat = np.zeros((h, w + 2), np.int8)
    flat[:, 1:-1] = mask
    step = np.diff(flat, axis=1)
    row, start = np.nonzero(step == 1)
    stop = np.nonzero(step == -1)[1]
    n = len(row)
    out = np.zeros((h, w), np.int64)
    if not n:
        return out
    # the runs of the next row that a run touches are neighbours in row order
    wide = w + 2
    first = np.searchsorted(row * wide + stop, (row + 1) * wide + start)
    last = np.searchsorted(row * wide + start, (row + 1) * wide + stop, "right")
    count = np.maximum(last - first, 0)
    a = np.repeat(np.arange(n), count)
    b = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    own = np.arange(n)
    while len(a):
        low = np.minimum(own[a], own[b])
        new = own.copy()
        np.minimum.at(new, own[a], low)
        np.minimum.at(new, own[b], low)
        new = new[new]
        if (new == own).all() and (own[a] == own[b]).all():
            break
        own = new
    number = np.unique(own, return_inverse=True)[1] + 1
    out[mask.astype(bool)] = np.repeat(number, stop - start)
    return out


def regions(img: np.ndarray, below: int = 250) -> list[tuple[int, int, int, int]]:
    """Boxes (x, y, w, h) of the connected dark regions (8 neighbours), in order of their first pixel."""
    label = labels(luma(img) <= below)
    ys, xs = np.nonzero(label)
    if not len(ys):
        return []
    at = label[ys, xs]
    n = int(at.max()) + 1
    x0, y0, x1, y1 = np.full(n, img.shape[1]), np.full(n, img.shape[0]), np.zeros(n, int), np.zeros(n, int)
    np.minimum.at(x0, at, xs)
    np.minimum.at(y0, at, ys)
    np.maximum.at(x1, at, xs)
    np.maximum.at(y1, at, ys)
    return [(int(x0[i]), int(y0[i]), int(x1[i] - x0[i] + 1), int(y1[i] - y0[i] + 1)) for i in range(1, n)]


def region_crops(img: np.ndarray, width: float, height: float, below: int = 250) -> list[tuple[float, float, float, float, np.ndarray]]:
    """(x0, y0, x1, y1 in points, crop) of the dark regions of a page's render that are large enough to be figures.

    A region counts from max(5000, 0.005 of the page in square points) pixels of its box.
    """
    h, w = img.shape[:2]
    least = max(5000.0, 0.005 * width * height)
    return [(x * width / w, y * height / h, (x + a) * width / w, (y + b) * height / h, img[y : y + b, x : x + a]) for x, y, a, b in regions(img, below) if a * b > least]


def over_white(img: np.ndarray) -> np.ndarray:
    """An RGBA picture laid over white."""
    a = img[..., 3:].astype(np.float64) / 255
    return to_uint8(np.rint(img[..., :3] * a + 255 * (1 - a)))


def extend(seg: tuple[float, float, float, float], mask: np.ndarray) -> tuple[int, int, int, int]:
    """A segment lengthened at both ends as long as the mask is set there.

    Each end is followed along a ray of unit steps, all sampled at once, up to its first sample that is unset or outside.
    """
    h, w = mask.shape[:2]
    x1, y1, x2, y2 = seg
    direction = np.array([x2 - x1, y2 - y1], float)
    length = np.hypot(*direction)
    unit = direction / length if length else np.array([1.0, 0.0])
    steps = np.arange(h + w + 2)[:, None]

    def reach(end: tuple[float, float], unit: np.ndarray) -> np.ndarray:
        ray = np.array(end) + steps * unit
        at = ray.astype(int)
        inside = (at >= 0).all(1) & (at[:, 0] < w) & (at[:, 1] < h)
        clipped = np.clip(at, 0, [w - 1, h - 1])
        on = inside & (mask[clipped[:, 1], clipped[:, 0]] != 0)
        return ray[int(np.argmin(on))]

    back, ahead = reach((x1, y1), -unit), reach((x2, y2), unit)
    return int(max(0, back[0])), int(max(0, back[1])), int(min(w - 1, ahead[0])), int(min(h - 1, ahead[1]))


def png_encode(img: np.ndarray) -> bytes:
    """An 8-bit grey, RGB or RGBA image as PNG."""
    h, w = img.shape[:2]
    kind = {1: 0, 3: 2, 4: 6}[1 if img.ndim == 2 else img.shape[2]]
    raw = np.concatenate([np.zeros((h, 1), np.uint8), img.reshape(h, -1).astype(np.uint8)], axis=1).tobytes()

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def _unfilter(rows: np.ndarray, step: int) -> np.ndarray:
    """The filters of all rows undone; step: bytes a pixel."""
    h, width = rows.shape[0], rows.shape[1] - 1
    out = np.zeros((h, width), np.uint8)
    up = np.zeros(width, np.uint8)
    for y in range(h):
        kind, line = int(rows[y, 0]), rows[y, 1:]
        if kind == 0:
            now = line
        elif kind == 1:
            pad = (-width) % step
            now = np.cumsum(np.pad(line, (0, pad)).reshape(-1, step), axis=0, dtype=np.uint64).astype(np.uint8).ravel()[:width]
        elif kind == 2:
            now = line + up
        else:
            # each byte needs the one before it, so these two run byte by byte
            src, above, got = line.tolist(), up.tolist(), [0] * width
            for i in range(width):
                left, corner = (got[i - step], above[i - step]) if i >= step else (0, 0)
                if kind == 3:
                    p = (left + above[i]) // 2
                else:
                    e = left + above[i] - corner
                    dl, du, dc = abs(e - left), abs(e - above[i]), abs(e - corner)
                    p = left if dl <= du and dl <= dc else above[i] if du <= dc else corner
                got[i] = (src[i] + p) & 255
            now = np.array(got, np.uint8)
        out[y] = up = now
    return out


def png_decode(data: bytes) -> np.ndarray | None:
    """The pixels of a PNG without interlacing, as 8-bit grey, RGB or RGBA; None for anything else.

    Palettes become RGB (RGBA where they have transparency), grey with transparency RGBA; 16-bit samples keep their upper byte,
    samples of fewer bits are spread over 0..255.
    """
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    at, idat, head, palette, clear = 8, [], None, None, b""
    while at + 8 <= len(data):
        n, name = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"IDAT":
            idat.append(body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"tRNS":
            clear = body
        at += n + 12
    if head is None or head[6] or head[2] not in (1, 2, 4, 8, 16) or head[3] not in (0, 2, 3, 4, 6) or head[3] == 3 and palette is None:
        return None
    w, h, depth, kind = head[:4]
    ch = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    width = (w * ch * depth + 7) // 8
    rows = np.frombuffer(zlib.decompress(b"".join(idat)), np.uint8)[: h * (1 + width)].reshape(h, 1 + width)
    raw = _unfilter(rows, max(1, ch * depth // 8))
    if depth == 16:
        raw = raw[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(raw, axis=1).reshape(h, -1, depth)
        raw = (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint8)[:, : w * ch]
        if kind != 3:
            raw = (raw.astype(np.int64) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    if kind == 3:
        colors = palette
        if clear:
            alpha = np.full(len(palette), 255, np.uint8)
            alpha[: len(clear)] = np.frombuffer(clear, np.uint8)[: len(palette)]
            colors = np.concatenate([palette, alpha[:, None]], 1)
        return colors[np.minimum(raw, len(colors) - 1)]
    if kind == 0:
        return raw.copy()
    out = raw.reshape(h, w, ch)
    return out[..., [0, 0, 0, 1]] if kind == 4 else out.copy()
