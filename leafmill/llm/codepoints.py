"""One consistent form for text that looks the same (problem 5).

Arrow text is copied to numpy code-point arrays; a lookup table gives each code point an offset and a length in an
expansion pool (0: invisible, dropped; 1: itself or its twin; more: joined letters and decomposed accents); marks are
put in canonical order and composed with their base by sorted-key search.  No string call is made per row.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Letters of other scripts that have the shape of a Latin letter (as pairs, other script first), then
# Greek letters with the shape of a Cyrillic one.
TWINS = (
    "аa еe оo рp сc уy хx іi ѕs јj һh ԁd ԛq ԝw ӏl ɡg ıı "
    "АA ВB ЕE КK МM НH ОO РP СC ТT ХX ІI ЅS ЈJ ҮY ԚQ ԜW "
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo ϳj ϲc ϹC "
    "ΓГ ΠП ΦФ μµ"
)
# Joined letters that stand for several.
JOINED = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ĳ": "ij", "Ĳ": "IJ", "ǆ": "dž", "ǉ": "lj", "ǌ": "nj"}
# Kinds of blank (the line breaks and the tab are not among them), and hyphens of one shape.
BLANKS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
HYPHENS = "\u2010\u2011\ufe63\uff0d\u2043"
# Ranges of code points without ink, beside the format characters of Unicode.
UNSEEN = ((0xFE00, 0xFE0F), (0xE0100, 0xE01EF), (0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFFA0, 0xFFA0))


@functools.lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, ...]:
    """(offset, length) by code point, the pool, combining class, and the sorted composition keys with their results."""
    size = sys.maxunicode + 1
    twin = {ord(p[0]): p[1] for p in TWINS.split(" ")}
    twin |= {ord(c): " " for c in BLANKS} | {ord(c): "-" for c in HYPHENS} | {ord(k): v for k, v in JOINED.items()}
    unseen = np.zeros(size, bool)
    for a, b in UNSEEN:
        unseen[a : b + 1] = True
    offset, length = np.arange(size, dtype=np.int64), np.ones(size, np.int64)
    pool = [np.arange(size, dtype=np.uint32)]
    at, ccc, pairs = size, np.zeros(size, np.uint8), {}

    def wide(c: str) -> bool:
        return unicodedata.decomposition(c).startswith(("<wide>", "<narrow>"))

    for cp in range(0x80, 0x30000):
        if 0xD800 <= cp < 0xE000:
            continue
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind == "Cn" or 0x3400 <= cp < 0xA000 or 0xAC00 <= cp < 0xD7A4:
            continue
        ccc[cp] = unicodedata.combining(c)
        if kind == "Cf" or unseen[cp]:
            length[cp] = 0
            continue
        full = unicodedata.normalize("NFKC", c) if wide(c) else c
        parts = "".join(twin.get(ord(x), x) for x in unicodedata.normalize("NFD", "".join(twin.get(ord(x), x) for x in full)))
        if parts != c:
            cps = np.array([ord(x) for x in parts], np.uint32)
            offset[cp], length[cp] = at, len(cps)
            pool.append(cps)
            at += len(cps)
        two = unicodedata.decomposition(c)
        if two and "<" not in two and len(two.split()) == 2 and unicodedata.normalize("NFC", c) == c:
            a, b = (int(x, 16) for x in two.split())
            pairs[(ord(twin.get(a, chr(a))) << 21) | b] = cp
            pairs.setdefault((a << 21) | b, cp)
    keys = np.array(sorted(pairs), np.int64)
    # a composite of a twin base is the composite of the Latin base: Latin ones win over the other scripts'
    best = {k: v for k, v in pairs.items()}
    for k in list(best):
        a, b = chr(k >> 21), chr(k & 0x1FFFFF)
        got = unicodedata.normalize("NFC", a + b)
        if len(got) == 1:
            best[k] = ord(got)
    return offset, length, np.concatenate(pool), ccc, keys, np.array([best[k] for k in keys], np.uint32)


def to_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows in one array, and the row starts (one more than rows); null is as empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1] if off and len(column) else np.zeros(len(column) + 1, np.int64)
    raw = memoryview(data)[off[0] : off[-1]] if data else b""
    b = np.frombuffer(raw, np.uint8)
    points = np.frombuffer(bytes(raw).decode("utf-8").encode("utf-32-le"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])
    return points, heads[off - off[0]]


def to_column(points: np.ndarray, starts: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """The inverse of ``to_points``: an Arrow string column; rows where ``null`` holds are null."""
    raw = points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    width = 1 + (points > 0x7F) + (points > 0x7FF).astype(np.int64) + (points > 0xFFFF)
    off = np.concatenate([[0], np.cumsum(width)])[starts].astype(np.int64)
    bits = None if null is None or not null.any() else pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
    return pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(off.tobytes()), pa.py_buffer(raw), bits, int(null.sum()) if bits else 0).cast(pa.string())


# The first and number of leading, vowel and trailing letters of Korean, and the first syllable.
_L, _V, _T, _S = (0x1100, 19), (0x1161, 21), (0x11A8, 27), 0xAC00


def syllables(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Korean letters that follow one another in a row composed to syllables."""
    if not ((points >= _L[0]) & (points < 0x1200)).any():
        return points, starts
    p = np.concatenate([points.astype(np.int64), [0, 0]])
    first = np.zeros(len(p) + 1, bool)
    first[starts] = True
    among = lambda x, r: (x >= r[0]) & (x < r[0] + r[1])
    n = len(points)
    a, b, c = p[:n], p[1 : n + 1], p[2 : n + 2]
    open_ = (a >= _S) & (a < _S + 11172) & ((a - _S) % 28 == 0)
    pair = among(a, _L) & among(b, _V) & ~first[1 : n + 1]
    tail = pair & among(c, _T) & ~first[2 : n + 2]
    late = open_ & among(b, _T) & ~first[1 : n + 1]
    out = np.where(pair, _S + ((a - _L[0]) * 21 + b - _V[0]) * 28 + np.where(tail, c - _T[0] + 1, 0), np.where(late, a + b - _T[0] + 1, a))
    gone = np.zeros(n + 2, bool)
    gone[1 : n + 1] |= pair | late
    gone[2 : n + 2] |= tail
    kept = ~gone[:n]
    return out[kept].astype(np.uint32), np.concatenate([[0], np.cumsum(kept)])[starts]


def unify(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The one form of every row, as code points and row starts."""
    return syllables(*_unify(points, starts))


def _unify(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    offset, length, pool, ccc, keys, results = tables()
    n = length[points]
    ends = np.cumsum(n)
    out_starts = np.concatenate([[0], ends])[starts]
    total = int(ends[-1]) if len(ends) else 0
    begin = ends - n
    out = pool[np.repeat(offset[points] - begin, n) + np.arange(total)] if total else np.zeros(0, np.uint32)
    row = np.repeat(np.arange(len(starts) - 1), np.diff(out_starts))
    mark = ccc[out]
    if not mark.any():
        return out, out_starts
    # a cluster begins at each starter and at each row's first point; marks are sorted by class within it
    head = mark == 0
    head[out_starts[:-1][np.diff(out_starts) > 0]] = True
    cluster = np.cumsum(head)
    order = np.lexsort((mark, cluster))
    out, mark = out[order], mark[order]
    # composition: starters that have marks try theirs one after the other
    base = np.maximum.accumulate(np.where(head, np.arange(total), 0))
    alive = np.ones(total, bool)
    place = np.arange(total) - base
    for step in range(1, int(place.max()) + 1 if total else 1):
        at = np.flatnonzero((place == step) & (mark > 0))
        if not len(at):
            break
        b = base[at]
        free = (at == b + 1) | ~alive[at - 1] | (mark[at - 1] < mark[at])
        key = (out[b].astype(np.int64) << 21) | out[at]
        hit = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        ok = (keys[hit] == key) & free & (mark[b] == 0)
        out[b[ok]] = results[hit[ok]]
        alive[at[ok]] = False
    kept = np.concatenate([[0], np.cumsum(np.bincount(row[alive], minlength=len(starts) - 1))])
    return out[alive], kept


def unify_column(column: pa.Array) -> pa.Array:
    """One form of an Arrow string column; null stays null."""
    points, starts = to_points(column)
    null = np.asarray(column.is_null())
    return to_column(*unify(points, starts), null)


def unify_text(df: DataFrame, column: str, to: str) -> DataFrame:
    """``df`` with column ``to``: the one form of ``column``. Null gives null, a text of invisible points only ''."""
    schema = T.StructType([f for f in df.schema.fields if f.name != to] + [T.StructField(to, T.StringType())])
    names = [f.name for f in schema.fields[:-1]]

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(x)) for x in names] + [unify_column(b.column(b.schema.get_field_index(column)))], names=[*names, to])

    return df.mapInArrow(run, schema)
