"""The enhancement chain on pixel arrays: marks, noise, contrast, small text, tracing, and the steps in order.

All kernels are numpy over whole arrays (H x W x 3, uint8).  ``HOOKS`` takes what needs a trained model.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from leafmill.config import Enhancement
from leafmill.functions import pixels as K

#: Steps that need a model: 'super_resolution' and 'faces', each a function of an image; without one the step is the plain fallback.
HOOKS: dict[str, Callable[[np.ndarray], np.ndarray]] = {}

# Conversion from linear RGB to XYZ with its white, and limits of the mark mask, the paper texture and the diagram threshold.
_XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
_WHITE = np.array([0.950456, 1.0, 1.088754])
MARK_DIFF, MARK_SATURATION, MARK_SHARE = 18, 30, 0.0005
PAPER_WEIGHT, PAPER_DIFF = 0.85, 0.15


def to_lab(img: np.ndarray) -> np.ndarray:
    """8-bit L*a*b* of an 8-bit RGB image, as floats (L scaled to 255, a and b shifted by 128)."""
    c = img.astype(np.float64) / 255
    c = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)
    t = c @ _XYZ.T / _WHITE
    f = np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16 / 116)
    light = np.where(t[..., 1] > 0.008856, 116 * f[..., 1] - 16, 903.3 * t[..., 1])
    return np.stack([light * 2.55, 500 * (f[..., 0] - f[..., 1]) + 128, 200 * (f[..., 1] - f[..., 2]) + 128], -1)


def from_lab(lab: np.ndarray) -> np.ndarray:
    """The inverse of ``to_lab``."""
    light = lab[..., 0] / 2.55
    fy = (light + 16) / 116
    f = np.stack([fy + (lab[..., 1] - 128) / 500, fy, fy - (lab[..., 2] - 128) / 200], -1)
    t = np.where(f > 0.206893, f**3, (f - 16 / 116) / 7.787)
    t[..., 1] = np.where(light > 7.9996, fy**3, light / 903.3)
    c = (t * _WHITE) @ np.linalg.inv(_XYZ).T
    c = np.clip(c, 0, None)
    return K.to_uint8(np.rint(255 * np.where(c <= 0.0031308, 12.92 * c, 1.055 * c ** (1 / 2.4) - 0.055)))


def saturation(img: np.ndarray) -> np.ndarray:
    """8-bit HSV saturation."""
    v = img.astype(np.float64)
    top, low = v.max(-1), v.min(-1)
    return np.where(top > 0, 255 * (top - low) / np.maximum(top, 1), 0.0)


def box(a: np.ndarray, k: int) -> np.ndarray:
    """Mean over k x k with mirrored edges, by running sums."""
    r = k // 2
    out = a.astype(np.float64)
    for axis in (0, 1):
        n = out.shape[axis]
        pad = [(0, 0)] * out.ndim
        pad[axis] = (r, k - 1 - r)
        p = np.pad(out, pad, mode="reflect" if n > max(r, k - 1 - r) else "symmetric")
        s = np.cumsum(p, axis)
        zero = np.zeros_like(np.take(s, [0], axis))
        s = np.concatenate([zero, s], axis)
        out = (np.take(s, range(k, k + n), axis) - np.take(s, range(n), axis)) / k
    return out


def _moved(mask: np.ndarray, offsets: list[tuple[int, int]], outside: bool) -> list[np.ndarray]:
    p = np.pad(mask, 1, constant_values=outside)
    h, w = mask.shape
    return [p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy, dx in offsets]


CROSS, SQUARE = [(0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)], [(0, 0), (0, -1), (-1, 0), (-1, -1)]


def dilate(mask: np.ndarray, shape: list[tuple[int, int]] = CROSS, times: int = 1) -> np.ndarray:
    """The mask grown by a shape."""
    for _ in range(times):
        mask = np.logical_or.reduce(_moved(mask, shape, False))
    return mask


def erode(mask: np.ndarray, shape: list[tuple[int, int]] = CROSS, times: int = 1) -> np.ndarray:
    """The mask shrunk by a shape."""
    for _ in range(times):
        mask = np.logical_and.reduce(_moved(mask, shape, True))
    return mask


def opened(mask: np.ndarray, shape: list[tuple[int, int]] = CROSS) -> np.ndarray:
    """Shrunk, then grown by the mirrored shape."""
    return dilate(erode(mask, shape), [(-y, -x) for y, x in shape])


def inpaint(img: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Masked pixels filled from their rim inwards by the mean of the known neighbours; a mask over everything changes nothing."""
    out, known = img.astype(np.float64), ~mask
    if not known.any():
        return img
    around = [(y, x) for y in (-1, 0, 1) for x in (-1, 0, 1) if y or x]
    while not known.all():
        n = sum(m.astype(np.float64) for m in _moved(known, around, False))
        rim = ~known & (n > 0)
        for c in range(out.shape[2]):
            s = sum(_moved(np.where(known, out[..., c], 0.0), around, 0))
            out[..., c][rim] = (s[rim] / n[rim])
        known = known | rim
    return K.to_uint8(np.rint(out))


def remove_marks(img: np.ndarray, diff: float = MARK_DIFF, low: float = MARK_SATURATION, share: float = MARK_SHARE) -> np.ndarray:
    """Stains and pencil marks filled: where lightness departs from its surroundings, colour is weak and no edge is near. Colour stays."""
    lab = to_lab(img)
    soft = K.gaussian(lab[..., 0], 1.7)
    mask = (np.abs(soft - box(soft, 31)) > diff) & (saturation(img) <= low)
    mask = dilate(opened(mask), times=2) & ~dilate(K.edges(img), times=2)
    if 255 * mask.sum() < share * mask.size:
        return img
    filled = to_lab(inpaint(img, mask))
    filled[mask, 1:] = lab[mask, 1:]
    return from_lab(filled)


def _shifts(img: np.ndarray, r: int):
    p = np.pad(img, ((r, r), (r, r), (0, 0)), mode="symmetric")
    h, w = img.shape[:2]
    for y in range(2 * r + 1):
        for x in range(2 * r + 1):
            yield y - r, x - r, p[y : y + h, x : x + w]


def bilateral(img: np.ndarray, r: int = 4, color: float = 75.0, space: float = 75.0) -> np.ndarray:
    """Smoothed where colours are alike."""
    a = img.astype(np.float64)
    total, weight = np.zeros_like(a), np.zeros(a.shape[:2])
    for y, x, s in _shifts(a, r):
        w = np.exp(-(np.abs(s - a).sum(-1) ** 2) / (2 * color**2) - (y * y + x * x) / (2 * space**2))
        total += w[..., None] * s
        weight += w
    return K.to_uint8(np.rint(total / weight[..., None]))


def non_local_means(img: np.ndarray, h: float, patch: int = 7, search: int = 21) -> np.ndarray:
    """Every pixel the mean of those with like surroundings, weighted by how like they are."""
    a = img.astype(np.float64)
    total, weight = np.zeros_like(a), np.zeros(a.shape[:2])
    for _, _, s in _shifts(a, search // 2):
        w = np.exp(-box(((s - a) ** 2).mean(-1), patch) / max(h * h, 1e-9))
        total += w[..., None] * s
        weight += w
    return K.to_uint8(np.rint(total / weight[..., None]))


def clahe(light: np.ndarray, clip: float = 3.0, tiles: int = 8) -> np.ndarray:
    """Equalized in tiles with clipped histograms, mappings blended between tile centres. light: 0..255."""
    h, w = light.shape
    ty, tx = min(tiles, h), min(tiles, w)
    v = np.clip(np.rint(light), 0, 255).astype(np.int64)
    ys, xs = np.minimum(np.arange(h) * ty // h, ty - 1), np.minimum(np.arange(w) * tx // w, tx - 1)
    tile = ys[:, None] * tx + xs[None, :]
    hist = np.bincount((tile * 256 + v).ravel(), minlength=ty * tx * 256).reshape(-1, 256).astype(np.float64)
    size = hist.sum(1, keepdims=True)
    most = np.maximum(clip * size / 256, 1.0)
    over = np.maximum(hist - most, 0).sum(1, keepdims=True)
    maps = np.cumsum(np.minimum(hist, most) + over / 256, 1) * 255 / size
    fy, fx = (np.arange(h) + 0.5) * ty / h - 0.5, (np.arange(w) + 0.5) * tx / w - 0.5
    y0, x0 = np.clip(np.floor(fy).astype(int), 0, ty - 1), np.clip(np.floor(fx).astype(int), 0, tx - 1)
    y1, x1 = np.minimum(y0 + 1, ty - 1), np.minimum(x0 + 1, tx - 1)
    wy, wx = np.clip(fy - y0, 0, 1)[:, None], np.clip(fx - x0, 0, 1)[None, :]
    at = lambda y, x: maps[y[:, None] * tx + x[None, :], v]
    return (1 - wy) * ((1 - wx) * at(y0, x0) + wx * at(y0, x1)) + wy * ((1 - wx) * at(y1, x0) + wx * at(y1, x1))


def _on_light(img: np.ndarray, change: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    lab = to_lab(img)
    lab[..., 0] = change(lab[..., 0])
    return from_lab(lab)


def adaptive(grey: np.ndarray, block: int, c: float) -> np.ndarray:
    """Mask of the pixels above the Gaussian mean of their block, less c."""
    return grey > K.gaussian(grey, 0.3 * ((block - 1) * 0.5 - 1) + 0.8) - c


def preprocess(img: np.ndarray, diagram: bool = False, photo: bool = False, cfg: Enhancement | None = None) -> np.ndarray:
    """Smoothed (diagrams), denoised, equalized, paper texture softened (but in photos), sharpened, background whitened (diagrams)."""
    cfg = cfg or Enhancement()
    img = np.repeat(img[..., None], 3, -1) if img.ndim == 2 else img
    img = K.to_uint8(img)
    if diagram:
        img = bilateral(img)
    if cfg.enable_denoising:
        img = non_local_means(img, min(cfg.denoise_strength * 1.2, 20.0) if diagram else cfg.denoise_strength)
    if cfg.enable_clahe:
        img = _on_light(img, lambda v: clahe(v, cfg.clahe_clip_limit, cfg.clahe_grid_size))
    if not photo:
        a = img.astype(np.float64)
        img = K.to_uint8(np.rint(PAPER_WEIGHT * a + PAPER_DIFF * np.clip(a - K.gaussian(a, 8.0), 0, 255)))
    if cfg.enable_sharpening:
        img = K.unsharp(img, cfg.sharpen_sigma, cfg.sharpen_amount)
    if diagram:
        img = _on_light(img, lambda v: np.where(adaptive(v, 15, 9), 255.0, v))
    return img


def resize(img: np.ndarray, width: int, height: int, a: float = -0.75) -> np.ndarray:
    """To any size by cubic convolution, edges repeated."""
    out = img.astype(np.float64)
    for axis, size in ((0, height), (1, width)):
        n = out.shape[axis]
        pos = (np.arange(size) + 0.5) * n / size - 0.5
        base = np.floor(pos).astype(int)
        t = np.abs(pos[:, None] - (base[:, None] + np.arange(-1, 3)))
        w = np.where(t <= 1, (a + 2) * t**3 - (a + 3) * t**2 + 1, np.where(t < 2, a * t**3 - 5 * a * t**2 + 8 * a * t - 4 * a, 0.0))
        at = np.clip(base[:, None] + np.arange(-1, 3), 0, n - 1)
        out = np.moveaxis(np.einsum("nk...,nk->n...", np.moveaxis(out, axis, 0)[at], w), 0, axis)
    return K.to_uint8(np.rint(out))


def is_small_text(w: int, h: int) -> bool:
    """Whether a region's size is that of small text."""
    return w >= 6 and h >= 6 and w * h <= 20000 and 0.08 <= w / max(h, 1) <= 12


def sharpen_small_text(img: np.ndarray) -> np.ndarray:
    """Regions of the size of small text enlarged, equalized, sharpened and put back."""
    grey = K.luma(img)
    ink = ~adaptive(grey, 15, 9)
    out = img.copy()
    for x, y, w, h in K.regions(np.where(dilate(ink, times=1), 0, 255).astype(np.uint8), 128):
        if not is_small_text(w, h):
            continue
        big = resize(img[y : y + h, x : x + w], 2 * w, 2 * h)
        big = K.unsharp(_on_light(big, lambda v: clahe(v, 2.0, max(4, min(w, h) // 4))), 0.6, 0.6)
        out[y : y + h, x : x + w] = resize(big, w, h)
    return out


def otsu(grey: np.ndarray) -> int:
    """The threshold with the largest variance between the parts, the smallest on ties."""
    n = np.bincount(np.clip(np.rint(grey), 0, 255).astype(int).ravel(), minlength=256).astype(np.float64)
    n0, s0 = np.cumsum(n), np.cumsum(n * np.arange(256))
    d = s0 * n0[-1] - s0[-1] * n0
    between = np.divide(d * d, n0 * (n0[-1] - n0), out=np.zeros(256), where=(n0 > 0) & (n0 < n0[-1]))
    return int(np.argmax(np.round(between, 6)))


def trace(ink: np.ndarray, least: int = 50) -> bytes | None:
    """The mask as an SVG path of maximal rectangles of equal rows; regions of fewer than ``least`` pixels are left out; None for no ink."""
    h, w = ink.shape
    label = K.labels(ink)
    if not label.any():
        return None
    kept = ink & (np.bincount(label.ravel())[label] >= least)
    rows = np.zeros((h, w + 2), np.int8)
    rows[:, 1:-1] = kept
    edge = np.diff(rows, axis=1)
    open_: dict[tuple[int, int], int] = {}
    path = []
    for y in range(h + 1):
        now = set(zip(np.flatnonzero(edge[y] == 1).tolist(), np.flatnonzero(edge[y] == -1).tolist())) if y < h else set()
        for run in [r for r in open_ if r not in now]:
            top = open_.pop(run)
            path.append(f"M{run[0]} {top}h{run[1] - run[0]}v{y - top}h{run[0] - run[1]}z")
        for run in now:
            open_.setdefault(run, y)
    if not path:
        return None
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{w}" height="{h}" viewBox="0 0 {w} {h}"><path d="{"".join(path)}"/></svg>'.encode()


def vectorise(img: np.ndarray, local: bool = False, least: int = 50) -> bytes | None:
    """SVG of the dark parts: by one threshold for the picture, or (local) by that of each pixel's surroundings, specks opened away."""
    grey = K.luma(img)
    ink = ~opened(adaptive(grey, 11, 2), SQUARE) if local else grey <= otsu(grey)
    return trace(ink, least)


def rasterise(svg: bytes, scale: int = 1) -> np.ndarray:
    """Pixels of an SVG of ``trace``, black on white."""
    import re

    text = svg.decode()
    w, h = (int(v) for v in re.search(r'width="(\d+)" height="(\d+)"', text).groups())
    out = np.full((h * scale, w * scale, 3), 255, np.uint8)
    for x, y, dx, dy in re.findall(r"M(\d+) (\d+)h(\d+)v(\d+)", text):
        x, y, dx, dy = int(x) * scale, int(y) * scale, int(dx) * scale, int(dy) * scale
        out[y : y + dy, x : x + dx] = 0
    return out


def accepts_raster(mean: float, top: float) -> bool:
    """Whether a raster made from a vector picture is more than nearly empty."""
    return top > 1 and mean > 1.0


def super_resolve(img: np.ndarray, scale: float = 4.0) -> np.ndarray:
    """By the hook; else, or where it fails, by cubic convolution."""
    if hook := HOOKS.get("super_resolution"):
        try:
            return hook(img)
        except Exception:
            pass
    return resize(img, max(1, round(img.shape[1] * scale)), max(1, round(img.shape[0] * scale)))


def restore_faces(img: np.ndarray) -> np.ndarray:
    """By the hook; else, or where it fails, the image as it is."""
    if hook := HOOKS.get("faces"):
        try:
            return hook(img)
        except Exception:
            pass
    return img


@dataclass
class Enhanced:
    """A picture after the chain."""

    data: bytes
    ext: str
    width: int
    height: int
    is_diagram: bool
    is_photo: bool


def enhance(data: bytes | None, width: int | None = None, height: int | None = None, diagram: bool = False, photo: bool = False, cfg: Enhancement | None = None) -> Enhanced:
    """The chain on one picture: marks, preprocessing, small text, tracing, super-resolution, faces, last touch.

    Bytes that cannot be decoded become a white picture of the size given (512 where none is).  A step that fails ends the
    chain with what there is.
    """
    cfg = cfg or Enhancement()
    img = decode(data)
    if img is None:
        img = np.full((height or 512, width or 512, 3), 255, np.uint8)
    try:
        img = remove_marks(img)
        img = preprocess(img, diagram, photo, cfg)
        img = sharpen_small_text(img)
        if cfg.enable_vectorization and (diagram or not photo) and (svg := vectorise(img)):
            drawn = rasterise(svg)
            if accepts_raster(float(drawn.mean()), float(drawn.max())):
                img, diagram = drawn, True
        if cfg.enable_super_resolution:
            img = super_resolve(img, cfg.sr_outscale)
        if cfg.enable_face_restoration and photo and not diagram:
            img = restore_faces(img)
        img = K.postprocess(img)
    except Exception:
        pass
    return Enhanced(K.png_encode(img), "png", int(img.shape[1]), int(img.shape[0]), diagram, photo)


def enhance_render(img: np.ndarray, cfg: Enhancement | None = None) -> np.ndarray:
    """The chain on a page's render: no tracing, no small text, no faces."""
    cfg = cfg or Enhancement()
    img = preprocess(remove_marks(img), cfg=cfg)
    if cfg.enable_super_resolution:
        img = super_resolve(img, cfg.sr_outscale)
    return K.postprocess(img)


#: Decoders for formats beside PNG: functions from bytes to pixels or None, tried in order.
DECODERS: list[Callable[[bytes], np.ndarray | None]] = []


def registered() -> tuple[dict, list]:
    """Hooks and decoders as they are now, to be taken along to workers."""
    return dict(HOOKS), list(DECODERS)


def register(kept: tuple[dict, list]) -> None:
    """Sets hooks and decoders as ``registered`` gave them."""
    HOOKS.clear()
    HOOKS.update(kept[0])
    DECODERS[:] = kept[1]


def decode(data: bytes | None) -> np.ndarray | None:
    """RGB pixels of an encoded picture, transparency laid over white; None where no decoder reads it."""
    if not data:
        return None
    for read in (K.png_decode, *DECODERS):
        try:
            img = read(bytes(data))
        except Exception:
            continue
        if img is not None and img.size:
            if img.ndim == 2:
                return np.repeat(img[..., None], 3, -1)
            return K.over_white(img) if img.shape[2] == 4 else img[..., :3]
    return None


def normalise(*candidates: bytes | np.ndarray | None) -> bytes | None:
    """The first candidate that is a picture, as PNG (JPEG bytes stay): pixels are encoded, PNG is checked, others are decoded. None where none is."""
    for c in candidates:
        if c is None:
            continue
        if isinstance(c, np.ndarray):
            if c.size and c.ndim in (2, 3):
                return K.png_encode(K.to_uint8(c))
            continue
        if bytes(c[:2]) == b"\xff\xd8" and bytes(c[-2:]) == b"\xff\xd9":
            return bytes(c)
        if (img := decode(bytes(c))) is not None:
            return K.png_encode(img)
    return None


def crop(render: np.ndarray, x0: float, y0: float, x1: float, y1: float, width: float, height: float) -> np.ndarray | None:
    """The part of a page's render under a box in points; None where it has no area."""
    h, w = render.shape[:2]
    a, b = max(0, round(x0 * w / width)), max(0, round(y0 * h / height))
    c, d = min(w, round(x1 * w / width)), min(h, round(y1 * h / height))
    return render[b:d, a:c] if a < c and b < d else None
