"""Text decoded with the wrong code page (problem 1): swaps as substitution ciphers, learnt by expectation-maximization.

Observed text is a cipher of the true one: each byte of the true page, read with another page, stands for a letter.
Which cipher, if any, made a word is hidden.  The expectation step gives every distinct word a probability for each
cipher of its source from the letter bigrams of the corpus; the maximization step counts the share of each cipher,
takes garbled words out of the bigrams, and fits each cipher's table of symbols to letters (``fit``).  A cipher may
start from a public page, whose letters then count as KAPPA occurrences each, or, for the words that no public page
explains, from an even table.  UTF-8 read byte by byte is no substitution and is undone by its own rule.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np

from leafmill.llm.codepoints import TWINS

# Public code pages that text is wrongly read with, or was written in.
READ_AS = ("cp1252", "latin_1", "cp1251", "mac_roman", "cp437", "cp850", "koi8_r", "cp1250", "iso8859_2", "cp866", "mac_cyrillic")
WRITTEN = ("cp1252", "cp1251", "koi8_r", "mac_roman", "cp1250", "iso8859_2", "cp850", "cp437", "cp866", "mac_cyrillic")
# What a word may hold beside letters, where each byte stands for a character of its own.
MARKS = "–—’‘“”„…•·°±µ√─├└│§©®«»¿¡º²³"

#: Letters above this code point count as one; tables over code points end at TOP.
HIGH, TOP = 0x3000, 0xFFFF
#: Prior share of clean words, smoothing of the bigrams, rounds, and the log odds from which a word counts as garbled.
CLEAN, ALPHA, WIDTH, ROUNDS, ODDS = 0.99, 0.3, 150.0, 3, 1.5
#: Share of all bigrams from which one is too usual to speak for a swap.
USUAL = 2e-5
#: Occurrences that a public page's letter counts for, steps of a fit, its starts, and occurrences from which a symbol is fitted.
KAPPA, STEPS, STARTS, LEAST = 8.0, 120, 3, 3
#: Steps and bigrams of symbols from which a cipher that starts from a public page is fitted; below, the page stays as it is.
PUBLIC_STEPS, PUBLIC_LEAST = 20, 40
#: Bigrams of symbols from which a cipher is fitted from an even start, and the share of all bigrams that makes a script.
FREE_LEAST, SCRIPT = 150, 1e-3
#: Free ciphers by source: words with and without an ASCII letter.
MIXED, WHOLE = "?mixed", "?whole"
#: A free cipher holds if this share and this number of its distinct words decode to words of the corpus.
KNOWN_SHARE, KNOWN_WORDS = 0.5, 12

# A word ends at blanks of any kind, but for U+00A0 after a character that may be a byte's (0xA0 is a letter or part of one on many pages).
_INK = "\x80-\x9f\xa1-\u167f\u1681-\u1fff\u200b-\u202e\u2030-\u205e\u2060-\u2fff\u3001-\U0010ffff"
WORD = re.compile(f"[A-Za-z]*[{_INK}](?:[A-Za-z{_INK}]|(?<=[\x80-\U0010ffff])\xa0)*")
_TWINS = {ord(p[0]): p[1] for p in TWINS.split(" ")}
_TWIN = re.compile("[A-Za-z]")
_BAD = re.compile("[\x80-\x9f�]")

#: A symbol outside ASCII right before a letter: no joiner or dash, and at the start of a word no quote or bullet.
_SYMBOL = "[^\\w\\s\\x00-\\x7f\\xad·’‘\u02bc\u2010-\u2015…\u200b-\u200f\u2060\ufeff\ufffd]"
_INSIDE = re.compile(f"(?<=[^\\W\\d_]){_SYMBOL}+(?=[^\\W\\d_])|^(?![„“”‚«»‹›¿¡°•§©®±µ²³¹]){_SYMBOL}+(?=[^\\W\\d_])")


def _pages() -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    back, forth = {}, {}
    for name in {*READ_AS, *WRITTEN}:
        # undefined bytes keep their own number, as lenient decoders have it
        chars = [bytes([i]).decode(name, "ignore") or chr(i) for i in range(256)]
        forth[name] = np.array([ord(c) for c in chars], np.int64)
        back[name] = np.full(TOP + 1, -1, np.int64)
        back[name][forth[name][::-1]] = np.arange(255, -1, -1)
    return back, forth


#: Byte by code point (-1: none), code point by byte.
BACK, FORTH = _pages()


def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    low, lower, upper, plain = np.arange(TOP + 1), np.zeros(TOP + 1, bool), np.zeros(TOP + 1, bool), np.zeros(TOP + 1, bool)
    for i in range(TOP + 1):
        c = chr(i)
        lower[i], upper[i] = c.islower(), c.isupper()
        plain[i] = c.isalpha() or 32 <= i < 127 or c in MARKS
        if i < 0x80 and not c.isalpha():
            low[i] = 0
        elif len(c.lower()) == 1:
            low[i] = ord(c.lower())
    return np.minimum(low, HIGH), lower, upper, plain


#: By code point: its letter (0: a boundary), is it a small letter, a capital, a plain part of a word.
LOW, LOWER, UPPER, PLAIN = _letters()


def flat(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words (TOP for those above) in one array, and where each word begins (one more than words)."""
    raw = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.minimum(raw, TOP).astype(np.int64), np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)


def pairs(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, second letter) of every bigram, a boundary on both sides of each word, and where each word's bigrams begin.

    A capital outside ASCII right after a small letter is no ordinary capital and stays what it is.
    """
    words = len(starts) - 1
    low = LOW[points]
    odd = np.zeros(len(points), bool)
    odd[1:] = UPPER[points[1:]] & LOWER[points[:-1]] & (points[1:] > 0x7F)
    odd[starts[:-1][np.diff(starts) > 0]] = False
    low = np.where(odd, np.minimum(points, HIGH), low)
    seq = np.zeros(len(points) + words + 1, np.int64)
    seq[np.arange(len(points)) + 1 + np.repeat(np.arange(words), np.diff(starts))] = low
    return seq[:-1], seq[1:], (starts[:-1] + np.arange(words)).astype(np.int64)


class Model:
    """Bigram counts, shares of the ciphers by source, and their tables of symbols to letters."""

    def __init__(self, counts: dict[int, float], shares: dict | None = None, tables: dict | None = None):
        #: counts: by first letter * (HIGH + 1) + second; tables: by (source, cipher), code point of symbol to code point of letter
        self.counts, self.shares, self.tables = counts, shares or {}, tables or {}
        self.memo: dict[tuple[str, str], tuple] = {}
        key = np.fromiter(counts, np.int64, len(counts))
        n = np.maximum(np.fromiter(counts.values(), float, len(counts)), 0.0)
        letters = np.unique(np.concatenate([[0], key // (HIGH + 1), key % (HIGH + 1)]))
        #: 0 is the boundary, the last index stands for letters that never occur
        self.index = np.full(HIGH + 1, len(letters), np.int64)
        self.index[letters] = np.arange(len(letters))
        size = len(letters) + 1
        self.size, self.letters = size, letters
        a, b = self.index[key // (HIGH + 1)], self.index[key % (HIGH + 1)]
        first = np.bincount(a, n, size)
        order = np.argsort(a * size + b)
        self.keys = (a * size + b)[order]
        self.logs = np.log((n + ALPHA) / (first[a] + ALPHA * WIDTH))[order]
        self.unseen = np.log(ALPHA / (first + ALPHA * WIDTH))
        self.often = (n >= max(USUAL * n.sum(), 5.0))[order]

    def _at(self, points, starts):
        a, b, begin = pairs(points, starts)
        both = (a == 0) & (b == 0)
        a, b = self.index[a], self.index[b]
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        hit = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
        return a, at, hit, both, begin

    def logp(self, points: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Log probability of each word."""
        a, at, hit, both, begin = self._at(points, starts)
        p = np.where(hit, self.logs[at], self.unseen[a]) if len(self.keys) else self.unseen[a]
        return np.add.reduceat(np.where(both, 0.0, p), begin)

    def usual(self, points: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Every bigram of the word is at least USUAL of all bigrams, garbled words having left them."""
        _, at, hit, both, begin = self._at(points, starts)
        ok = both | (hit & self.often[at]) if len(self.keys) else both
        return np.logical_and.reduceat(ok, begin)

    def strange(self, words: list[str]) -> np.ndarray:
        """Whether a symbol stands in the word as a letter, or at least half of its bigrams with a character outside ASCII are not usual."""
        if not words:
            return np.zeros(0, bool)
        points, starts = flat(words)
        a, at, hit, both, begin = self._at(points, starts)
        first, second, _ = pairs(points, starts)
        high = ((first > 0x7F) | (second > 0x7F)).astype(np.int64)
        often = (hit & self.often[at]) if len(self.keys) else hit
        rare = 2 * np.add.reduceat(high * ~often, begin) >= np.add.reduceat(high, begin)
        return rare | np.array([bool(_INSIDE.search(w)) for w in words])

    def spells(self, text: str) -> bool:
        """Whether every letter of the text occurs in the corpus."""
        return bool((self.index[LOW[flat([text])[0]]] < self.size - 1).all())

    def judge(self, sources: list[str], words: list[str], start: bool = False) -> list[tuple[str | None, str, float]]:
        """For each word: (likeliest cipher or None, text, log odds of being garbled).

        ``start``: the bigrams still hold garbled words, so a word that decodes as UTF-8 into letters of the corpus counts as garbled by that alone.
        """
        if not words:
            return []
        points, starts = flat(words)
        count = len(words)
        bad = np.array([bool(_BAD.search(w)) for w in words])
        twin = np.array([bool(_TWIN.search(w)) and w.translate(_TWINS).isascii() for w in words])
        clean = self.logp(points, starts)
        skip = twin if start else twin | (self.usual(points, starts) & ~bad)
        todo = np.flatnonzero(~skip)
        names = list(dict.fromkeys(sources))
        of = np.array([names.index(s) for s in sources]) if len(names) < 50 else np.array([{s: i for i, s in enumerate(names)}[s] for s in sources])
        priors: dict[str, np.ndarray] = {}

        def prior(k: str) -> np.ndarray:
            if k not in priors:
                base = (1 - CLEAN) / (len(READ_AS) * (len(WRITTEN) + 1)) if k else 0.0
                priors[k] = np.log([max(self.shares.get(s, {}).get(k, 0.0 if k else CLEAN) + base, 1e-300) for s in names])
            return priors[k]

        clean = clean + prior("")[of]
        total, top = np.full(count, -np.inf), np.full(count, -np.inf)
        kinds: list[str] = []
        best = np.full(count, -1)
        undone: dict[tuple[int, str], str] = {}

        def offer(which: np.ndarray, k: str, value: np.ndarray) -> None:
            value = value + prior(k)[of[which]]
            total[which] = np.logaddexp(total[which], value - clean[which])
            more = value > top[which]
            top[which[more]] = value[more]
            best[which[more]] = len(kinds)
            kinds.append(k)

        for x in READ_AS:
            raw = BACK[x][points]
            mine = todo[np.logical_and.reduceat(raw >= 0, starts[:-1])[todo]]
            if len(mine):
                self._unpack(x, mine, points, starts, raw, undone, offer)
                self._ciphers(x, mine, names, of, points, starts, raw, offer)
        self._free(todo, names, of, words, offer)
        spell: dict[tuple[str, str], dict] = {}
        lo = np.where(np.isneginf(total), -1e9, total)
        out = []
        for i in range(count):
            if skip[i]:
                out.append((None, words[i], -20.0))
                continue
            odds, k = float(lo[i]), kinds[best[i]] if best[i] >= 0 else None
            text = words[i] if k is None else undone.get((i, k))
            if text is None:
                at = sources[i], k
                if at not in spell:
                    spell[at] = self.table(*at)
                text = words[i].translate(spell[at])
            if start and k and "utf_8" in k and self.spells(text):
                odds = max(odds, 10.0)
            if bad[i]:
                odds = max(odds, 20.0)
            out.append((k, text, odds))
        return out

    def _unpack(self, x, mine, points, starts, raw, undone, offer) -> None:
        """Words whose bytes are UTF-8, which is undone as often as it was done, three times at most."""
        lead = (raw[:-1] >= 0xC2) & (raw[:-1] < 0xF5) & (raw[1:] >= 0x80) & (raw[1:] < 0xC0)
        mark = np.zeros(len(points), bool)
        mark[:-1] = lead
        left = []
        for w in mine[np.logical_or.reduceat(mark, starts[:-1])[mine]].tolist():
            try:
                left.append((w, bytes(raw[starts[w] : starts[w + 1]].tolist()).decode("utf-8")))
            except UnicodeDecodeError:
                continue
        k = f"{x}<utf_8"
        for _ in range(3):
            if not left:
                return
            undone.update(((w, k), t) for w, t in left)
            p, s = flat([t for _, t in left])
            offer(np.array([w for w, _ in left]), k, self.logp(p, s))
            more = []
            for (w, _), a, b in zip(left, s, s[1:]):
                for z in dict.fromkeys((x, "cp1252", "latin_1")):
                    r = BACK[z][p[a:b]]
                    if (r < 0).any() or not (r > 127).any():
                        continue
                    try:
                        more.append((w, bytes(r.tolist()).decode("utf-8")))
                        break
                    except UnicodeDecodeError:
                        continue
            left, k = more, k + "+"

    def _ciphers(self, x, mine, names, of, points, starts, raw, offer) -> None:
        """Words as each cipher read with page x spells them."""
        part = np.concatenate([np.arange(starts[w], starts[w + 1]) for w in mine])
        begin = np.concatenate([[0], np.cumsum(starts[mine + 1] - starts[mine])])
        byte, seen = raw[part], points[part]
        owner = np.repeat(of[mine], np.diff(begin))
        for y in WRITTEN:
            if y == x:
                continue
            k = f"{x}<{y}"
            now = FORTH[y][byte]
            for s, name in enumerate(names):
                if own := self.tables.get((name, k)):
                    to = np.arange(TOP + 1)
                    to[list(own)] = list(own.values())
                    use = (owner == s) & (to[seen] != seen)
                    now = np.where(use, to[seen], now)
            ok = np.logical_and.reduceat(PLAIN[now], begin[:-1]) & np.logical_or.reduceat(now != seen, begin[:-1])
            if ok.any():
                value = np.where(ok, self.logp(now, begin), -np.inf)
                keep = np.flatnonzero(ok)
                offer(mine[keep], k, value[keep])

    def _free(self, todo, names, of, words, offer) -> None:
        """Words as the ciphers spell them that were learnt from an even start."""
        for s, name in enumerate(names):
            for k in (MIXED, WHOLE):
                own = self.tables.get((name, k))
                if not own:
                    continue
                which = np.array([w for w in todo if of[w] == s and kind(words[w]) == k], np.int64)
                spelt = [words[w].translate(own) for w in which]
                keep = [i for i, (w, t) in enumerate(zip(which, spelt)) if all(c.isalpha() or c.isascii() for c in t) and t != words[w]]
                if keep:
                    offer(which[keep], k, self.logp(*flat([spelt[i] for i in keep])))

    def table(self, source: str, k: str) -> dict[int, int]:
        """For ``str.translate``: letters by symbol of a cipher, as learnt for the source."""
        if k.startswith("?"):
            return self.tables[source, k]
        x, y = k.split("<")
        base = {int(FORTH[x][b]): int(FORTH[y][b]) for b in range(128, 256)}
        return base | self.tables.get((source, k), {})

    def verdicts(self, keys: set[tuple[str, str]]) -> dict[tuple[str, str], tuple]:
        """``judge`` of (source, word), remembered."""
        if len(self.memo) > 500_000:
            self.memo.clear()
        new = [k for k in keys if k not in self.memo]
        self.memo.update(zip(new, self.judge([k[0] for k in new], [k[1] for k in new])))
        return self.memo

    def undo(self, source: str, k: str, word: str) -> str | None:
        """The word as cipher k has it; None if k cannot have made it."""
        if "<utf_8" not in k:
            if "<" in k and any(BACK[k.split("<")[0]][min(ord(c), TOP)] < 0 for c in word):
                return None
            got = word.translate(self.table(source, k))
            return got if got != word and all(PLAIN[min(ord(c), TOP)] for c in got) else None
        x, times = k.split("<")[0], 1 + k.count("+")
        for z in (x,) * times:
            raw = BACK[z][flat([word])[0]]
            if (raw < 0).any() or not (raw > 127).any():
                return None
            try:
                word = bytes(raw.tolist()).decode("utf-8")
            except UnicodeDecodeError:
                return None
        return word

    def repair(self, source: str, text: str) -> tuple[str, bool, bool]:
        """(text with garbled words restored, any garbled, all of them restored).

        In a text with garbled words the other words are tried with the cipher that made most of these, at even odds.
        """
        words = dict.fromkeys(WORD.findall(text))
        known = self.verdicts({(source, w) for w in words})
        spelt, by = {}, Counter()
        whole = True
        for w in words:
            k, t, lo = known[source, w]
            if lo < ODDS:
                continue
            if k is None or _BAD.search(t):
                whole, spelt[w] = False, w
            else:
                spelt[w] = t
                by[k] += len(w)
        if not spelt:
            return text, False, False
        if by:
            k = by.most_common(1)[0][0]
            other = {w: t for w in words if w not in spelt and (t := self.undo(source, k, w))}
            if other:
                better = self.logp(*flat(list(other.values()))) > self.logp(*flat(list(other)))
                spelt |= {w: t for (w, t), ok in zip(other.items(), better) if ok}
        return WORD.sub(lambda m: spelt.get(m.group(), m.group()), text), True, whole


def kind(word: str) -> str:
    """The free cipher that a word can belong to; an empty name for none (marks of other ends: forms, joiners, twins)."""
    for c in word:
        if ord(c) > 0x2FFF or unicodedata.category(c) in ("Mn", "Cf") and c != "\xad" or c == "�":
            return ""
    return MIXED if any(c.isascii() for c in word) else WHOLE


def lettered(counts: dict[int, float]) -> dict[int, float]:
    """The bigrams without those of a letter and a symbol outside ASCII: before the first step these may all be garbled."""
    # spacing accents are letters by category, and HIGH stands for joined forms too: neither is a letter beside others here
    letter = {c: c < HIGH and (chr(c).isalpha() and unicodedata.category(chr(c)) != "Lm" or unicodedata.combining(chr(c)) > 0) for key in counts for c in divmod(key, HIGH + 1)}
    return {key: n for key, n in counts.items() if letter[key // (HIGH + 1)] == letter[key % (HIGH + 1)] or key < HIGH + 1 or key % (HIGH + 1) == 0}


def expect(model: Model, rows: list[tuple[str, str, int]], start: bool) -> tuple[Counter, Counter, Counter]:
    """Of (source, word, count): expected counts of ciphers by source, changes of bigrams, and bigrams of symbols by (source, cipher)."""
    shares: Counter = Counter()
    symbols: Counter = Counter()
    moved: list[tuple[str, float]] = []
    judged = model.judge([r[0] for r in rows], [r[1] for r in rows], start)
    strange = model.strange([r[1] for r in rows])
    for (source, word, n), (k, text, lo), odd in zip(rows, judged, strange):
        p = 1 / (1 + math.exp(-min(max(lo, -500), 500)))
        if odd and (k is None or p < 0.5) and (free := kind(word)):
            _symbols(symbols, source, free, word, n)
        if k is None:
            shares[source, "" if lo < 0 else "?"] += n
            if lo > 0:
                moved.append((word, -n))
            continue
        shares[source, ""] += n * (1 - p)
        shares[source, k] += n * p
        if p < 1e-6:
            continue
        moved.append((word, -n * p))
        if not _BAD.search(text):
            moved.append((text, n * p))
        if p > 0.5 and "utf_8" not in k:
            _symbols(symbols, source, k, word, n)
    return shares, bigrams(moved), symbols


def bigrams(words: list[tuple[str, float]]) -> Counter:
    """Counts of letter bigrams (first * (HIGH + 1) + second) of weighted words."""
    if not words:
        return Counter()
    points, starts = flat([w for w, _ in words])
    a, b, begin = pairs(points, starts)
    weight = np.repeat([n for _, n in words], np.diff(np.concatenate([begin, [len(a)]])))
    keep = (a > 0) | (b > 0)
    key, at = np.unique(a[keep] * (HIGH + 1) + b[keep], return_inverse=True)
    return Counter(dict(zip(key.tolist(), np.bincount(at, weight[keep], len(key)).tolist())))


def _symbols(symbols: Counter, source: str, k: str, word: str, n: float) -> None:
    seq = [0, *(ord(c.lower()) if c.isascii() and c.isalpha() else 0 if c.isascii() else ord(c) for c in word), 0]
    for p, q in zip(seq, seq[1:]):
        if p > 0x7F or q > 0x7F:
            symbols[source, k, p, q] += n


def scripts(counts: dict[int, float]) -> dict[str, dict[int, float]]:
    """Bigram counts by script: both letters of it, or one and a boundary. ASCII letters are Latin."""
    out: dict = defaultdict(dict)
    names: dict[int, str] = {0: ""}
    for key, n in counts.items():
        ab = key // (HIGH + 1), key % (HIGH + 1)
        for c in ab:
            if c not in names:
                names[c] = unicodedata.name(chr(c), "?").split(" ")[0] if chr(c).isalpha() and c < HIGH else "?"
        got = {names[c] for c in ab if c}
        if len(got) == 1 and n > 0 and "?" not in got:
            out[got.pop()][key] = n
    total = sum(sum(b.values()) for b in out.values())
    return {name: b for name, b in out.items() if sum(b.values()) >= SCRIPT * total}


def fit(observed: dict[tuple[int, int], float], bigrams: dict[int, float], public: dict[int, int] | None = None) -> tuple[dict[int, int], float]:
    """(letter by symbol, log likelihood a bigram) of one cipher by expectation-maximization over bigrams of symbols.

    A pair of symbols (s, t) was made by a pair of letters (l, m) with probability B(l, m) E(l, s) E(m, t); B are the
    bigrams of the language, E the cipher.  Boundaries and ASCII letters stand for themselves and hold the rest in place.
    With ``public`` each of its letters counts as KAPPA occurrences more; otherwise E starts even, and again from STARTS
    random tables, of which the likeliest is taken.  Of two symbols of one letter the rarer is its capital.
    """
    seen: Counter = Counter()
    for (a, b), n in observed.items():
        seen[a] += n
        seen[b] += n
    high = sorted(s for s in seen if s > 0x7F and seen[s] >= LEAST)
    letters = sorted({c for key in bigrams for c in (key // (HIGH + 1), key % (HIGH + 1)) if c > 0x7F})
    if not high or not letters:
        return {}, -np.inf
    fixed = sorted({c for key in bigrams for c in (key // (HIGH + 1), key % (HIGH + 1)) if c <= 0x7F} | {0})
    row = {c: i for i, c in enumerate(fixed + letters)}
    col = {c: i for i, c in enumerate(fixed + high)}
    f = len(fixed)
    joint = np.zeros((len(row), len(row)))
    for key, n in bigrams.items():
        joint[row[key // (HIGH + 1)], row[key % (HIGH + 1)]] += n
    joint += 1e-3 * joint.sum() / joint.size
    joint[0, 0] = 0
    c = np.zeros((len(col), len(col)))
    for (a, b), n in observed.items():
        if a in col and b in col:
            c[col[a], col[b]] += n
    # only pairs with a symbol outside ASCII are observed
    joint[:f, :f] = 0
    joint /= joint.sum()
    known = np.zeros((len(letters), len(high)))
    for j, s in enumerate(high):
        if public and (to := LOW[public[s]] if s in public else 0) in row and to > 0x7F:
            known[row[int(to)] - f, j] = KAPPA
    rng = np.random.default_rng(7)
    best, score = None, -np.inf
    for go in range(1 if public else 1 + STARTS):
        e = np.zeros((len(row), len(col)))
        e[np.arange(f), np.arange(f)] = 1
        first = known + 0.05 if public else np.ones_like(known) + (rng.random(known.shape) if go else 0.0)
        e[f:, f:] = first / first.sum(1, keepdims=True)
        for _ in range(PUBLIC_STEPS if public else STEPS):
            m = e.T @ joint @ e
            r = np.divide(c, m, out=np.zeros_like(c), where=m > 0)
            n = e * (joint @ e @ r.T + joint.T @ e @ r)
            post = n[f:, f:] + known
            e[f:, f:] = (post + 1e-6) / (post + 1e-6).sum(1, keepdims=True)
        m = e.T @ joint @ e
        ll = float((c[m > 0] * np.log(m[m > 0])).sum() / max(c.sum(), 1))
        if ll > score:
            best, score = post, ll
    to = {s: letters[int(best[:, j].argmax())] for j, s in enumerate(high) if best[:, j].sum() > 0}
    most: dict[int, float] = defaultdict(float)
    for s, letter in to.items():
        most[letter] = max(most[letter], seen[s])
    out = {}
    for s, letter in to.items():
        capital = seen[s] < most[letter] if not public or s not in public or LOW[public[s]] != letter else bool(UPPER[public[s]])
        big = chr(letter).upper()
        out[s] = ord(big) if capital and len(big) == 1 else letter
    return out, score


def tables(symbols: dict, counts: dict[int, float], free: bool) -> dict[tuple[str, str], dict[int, int]]:
    """The table of every cipher seen, from its bigrams of symbols; with ``free`` also those from an even start, of the likeliest script."""
    by: dict = defaultdict(dict)
    for (source, k, a, b), n in symbols.items():
        by[source, k][a, b] = n
    of = scripts(counts)
    out = {}
    for (source, k), observed in by.items():
        if k.startswith("?"):
            if not free or sum(observed.values()) < FREE_LEAST:
                continue
            tried = [fit(observed, b) for name, b in of.items() if name == "LATIN" or k == WHOLE]
            got = max(tried, key=lambda t: t[1], default=({}, 0.0))[0]
        elif sum(observed.values()) < PUBLIC_LEAST:
            continue
        else:
            x, y = k.split("<")
            page = {int(FORTH[x][b]): int(FORTH[y][b]) for b in range(128, 256)}
            into = Counter(unicodedata.name(chr(page[s]), "?").split(" ")[0] for (a, b) in observed for s in (a, b) if s in page and chr(page[s]).isalpha())
            got = fit(observed, of.get(into.most_common(1)[0][0], {}), page)[0] if into else {}
            got = {s: c for s, c in got.items() if s in page and chr(page[s]).isalpha() and page[s] != c}
        if got:
            out[source, k] = got
    return out
