"""Noise in text from scanned pages (problem 6): the rules for one page.

The lines of a page are labelled header, pageno, body or break by a linear conditional model over layout features, fitted
on the lines at the ends of pages (``fit``) and decoded by Viterbi.  Lines further than EDGE from either end can only be
body or break, so the model is evaluated at the ends; blank lines and ends of blocks are breaks.  Whether a header line
really runs through the document is settled afterwards, over all pages.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata

import numpy as np

from leafmill.llm.vocab import SEEN_AS, plain

#: Lines from either end of a page that may be running lines, and the pages of a document on which one must stand.
EDGE, PAGES = 2, 3

_ITEM = re.compile(r"^\s*(?:[-*•·√–▪○]\s|├|└|â|‚|\d{1,3}[.)]\s|[A-Za-z][.)]\s)")
_TABLE = re.compile(r"\|.*\||\t|;[^\s;]*;|^[^;\s]*;[^\s;]*$|\S {2,}\S+ {2,}\S|^[-=_ |+]+$")
_HEADING = re.compile(r"^\s*\d+\.\d+\s+\S.*[A-Z]{2}-\d+\s*$")
_ROMAN = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))
# Words for a page, and between a page and the number of pages.
_WORDS = "page pages pag pág página pagina p pg seite s strona str стр страница с folio fol feuille blatt hoja sheet side".split()
_OF = "of von de z из sur av af".split()
_PAGENO = re.compile(rf"^[\W_]*(?:(?:{'|'.join(_WORDS)})\b\.?)?[\W_]*(\d+|[ivxlcdm]+)[\W_]*?(?:(?:/|\b(?:{'|'.join(_OF)})\b)\W*\d+)?[\W_]*$", re.I)
_ORNAMENT = re.compile(r"[\W_]{4,}")
_SPLIT = re.compile(r"([^\W\d_]+)([-‐‑­¬=~⸗⁃]|‐)[ \t]*$")
_MARK = frozenset("-‐‑­¬=~⸗⁃")
_LEAD = re.compile(r"\s*([^\W\d_]+)")


def roman(n: int) -> str:
    """Lower-case Roman numeral; '' below 1."""
    out = ""
    for v, s in _ROMAN:
        while n >= v:
            out, n = out + s, n - v
    return out


def is_pageno(line: str, page_num: int | None) -> bool:
    """The line gives the page's own number (page_num + 1) and nothing else, with or without ornament, word or total."""
    if page_num is None or page_num < 0:
        return False
    # a run of ornament matches at any length, so a short one stands for it
    line = _ORNAMENT.sub("   ", unicodedata.normalize("NFKC", line) if not line.isascii() else line)
    m = _PAGENO.match(line) if len(line) < 200 else None  # a longer one has more in it than a number, words and three short runs
    if not m:
        return False
    got = m.group(1)
    return int(got) == page_num + 1 if got.isdigit() else got.lower() == roman(page_num + 1)


# What a recogniser puts (first) for what stood there (rest).
MISREAD = (
    "c:e e:c f:t t:f l:i,1,t i:l,j 1:l,i |:l,i !:i,l 0:o 5:s @:a 6:b b:h,6 h:b 9:g q:g,9 y:v v:y u:n n:u 8:b $:s 4:a 2:z €:e 7:t 3:e,з и:н л:п "
    "ii:u ri:n rn:m m:rn cl:d d:cl vv:w li:h nn:m in:m"
)
# Letters whose marks a recogniser loses.
UNMARKED = "a:ä,á,à,â o:ö,ó,ô u:ü,ú e:é,è,ê i:í,î"


def _rules(text: str) -> list[tuple[str, list[str]]]:
    return [(k, v.split(",")) for k, v in (x.split(":", 1) for x in text.split(" "))]


_FROM, _MARKS = _rules(MISREAD), _rules(UNMARKED)
_FOLD = str.maketrans("1|!jl0569q@yc€f7$uh", "iiiiiosbggaveettsnb")


def variants(word: str, rules: list[tuple[str, list[str]]] = _FROM) -> set[str]:
    """The words that one misreading turns into ``word``."""
    out = set()
    for got, was in rules:
        at = word.find(got)
        while at >= 0:
            for w in was:
                out.add(word[:at] + w + word[at + len(got) :])
            at = word.find(got, at + 1)
    return out


# Letters and groups that are mistaken for one another have one fold.
_CLASS = str.maketrans("c€3|!1ljft70$5@48h6q9yuиz", "eeeiiiiiiiiossaabbbggvnн2")
_GROUP = (("rn", "m"), ("ri", "n"), ("vv", "w"), ("ei", "d"), ("ii", "n"), ("nn", "m"), ("in", "m"), ("л", "п"), ("з", "e"))


def fold(word: str) -> str:
    """What a word and its misreadings share."""
    word = word.translate(_CLASS)
    for got, was in _GROUP:
        word = word.replace(got, was)
    return word


# A mapping of letters under which both sides of every rule are equal, lost accents included.  As m stands for nn as well as
# for rn and in, nothing can be left of the narrow letters and what is made of them.
_WIDE = str.maketrans({c: None for c in "il1|!jt7frnumhb68üúíî"} | dict(zip("c€3зdq9y0öóô5$@4äáàâéèê2инлп", "eeeeeggvoooossaaaaaaeeezиилл", strict=True)) | {"w": "vv"})


def wide(word: str) -> str:
    """What a word and all words within any number of misreadings share."""
    return word.translate(_WIDE)


class Reader:
    """Which words are known, and which are misread; answers are remembered.

    marks: a lost accent counts too (in text that comes from a recogniser).
    """

    #: A known word is a misreading if a variant is at least this many times as frequent.
    RATIO = 25

    def __init__(self, counts: dict[str, int], marks: bool = False, keep: int = 300_000):
        self.counts, self.keep, self.rules = counts, keep, _FROM + (_MARKS if marks else [])
        self.back = [(was, [got]) for got, all_ in self.rules for was in all_]
        self.memo: dict[str, object] = {}
        self.folded: dict[str, list[str]] = {}
        self.widely: dict[str, list[str]] = {}
        for w in sorted(counts, key=counts.get, reverse=True):
            if w.replace("-", "").replace("’", "").isalpha():
                self.widely.setdefault(wide(w), []).append(w)
                if len(w) >= 5:
                    self.folded.setdefault(fold(w), []).append(w)

    def _judge(self, token: str) -> object:
        """True for a known word, a string for the word that was misread, None for what is no word or unknown."""
        w = plain(token)
        n = self.counts.get(w, 0)
        letters = sum(c.isalpha() for c in w)
        if letters < 2 or len(w) < 3 or 2 * letters < len(w) or re.fullmatch(r"[a-z]{1,4}-?\d{2,}", w):
            return True if n else None
        if "-" in w and not n:
            parts = [self.judge(x) for x in w.split("-") if x]
            if parts and all(p is True for p in parts):
                return True
        found, best = None, max(n * self.RATIO, 2)
        if n and n * self.RATIO > self.top:
            return True
        one = variants(w, self.rules)
        for v in one:
            k = self.counts.get(v, 0)
            if k > best and v != w and v.replace("-", "").replace("’", "").isalpha():
                found, best = v, k
        if found is None and not n and len(w) >= 5:
            # several misreadings in one word: words of the same fold
            for v in self.folded.get(fold(w), ()):
                k = self.counts[v]
                if k > best:
                    found, best = v, k
            # the fold does not cover every pair of rules: words that two misreadings turn into this one
            for v in self.widely.get(wide(w), ()):
                if self.counts[v] <= best:
                    break
                if -2 <= len(v) - len(w) <= 2 and not one.isdisjoint(variants(v, self.back)):
                    found = v
                    break
        if found:
            return found
        return True if n else None

    @property
    def top(self) -> int:
        got = self.__dict__.get("_top")
        if got is None:
            got = self.__dict__["_top"] = max(self.counts.values(), default=0)
        return got

    def judge(self, token: str) -> object:
        """See ``_judge``."""
        got = self.memo.get(token, self)
        if got is self:
            if len(self.memo) >= self.keep:
                self.memo.clear()
            got = self.memo[token] = self._judge(token)
        return got

    def misread(self, line: str, skip_first: bool = False, skip_last: bool = False) -> tuple[int, int, int]:
        """(known, misread, unknown) words of a line; fragments of split words may be skipped."""
        known = bad = other = 0
        tokens = line.split()
        if skip_first:
            tokens = tokens[1:]
        if skip_last:
            tokens = tokens[:-1]
        memo = self.memo
        for t in tokens:
            got = memo.get(t, self)
            if got is self:
                got = self.judge(t)
            if got is True:
                known += 1
            elif got is None:
                if len(t) > 2 and not any(c.isdigit() for c in t):
                    other += 1
            else:
                bad += 1
        return known, bad, other

    def splits(self, line: str, following: str) -> bool:
        """The line ends in the first half of a word whose rest begins ``following``."""
        m = _SPLIT.search(line)
        if not m:
            return False
        b = _LEAD.match(following)
        if not b or not b.group(1)[0].islower():
            return False
        first = re.search(r"\S*$", line[: m.start(2)]).group()
        a, mark, rest = plain(first), m.group(2), plain(following.split()[0])
        rest_word = plain(b.group(1))
        count = self.counts.get
        whole = count(a + rest, 0) or count(a + rest_word, 0)
        hyphened = count(f"{a}-{rest}", 0) or count(f"{a}-{rest_word}", 0)
        if whole or hyphened:
            return whole > hyphened
        for x in (rest, rest_word):
            if isinstance(self.judge(a + x), str):
                return True
        if mark in "-‐‑⁃":
            return not (count(m.group(1).casefold(), 0) and count(rest_word, 0))
        return True


_FIRST = re.compile(r"\s*[\W_]*(\d+|[ivxlcdm]+)[\W_]*\s{2,}(?=\S)", re.I)
_LAST = re.compile(r"(?<=\S)\s{2,}[\W_]*(\d+|[ivxlcdm]+)[\W_]*$", re.I)


def running_key(line: str, page_num: int | None) -> str:
    """A running line without the page's number at its ends, blanks, case and the differences that misreading makes."""
    text = unicodedata.normalize("NFKC", line.translate(SEEN_AS)) if not line.isascii() else line
    if page_num is not None:
        own = str(page_num + 1), roman(page_num + 1)
        # a fixed pattern and a comparison, as a pattern for each page would be compiled each time
        first = _FIRST.match(text)
        if first and first.group(1).lower() in own:
            text = text[first.end() :]
        last = _LAST.search(text)
        if last and last.group(1).lower() in own:
            text = text[: last.start()]
    key = " ".join(text.split()).casefold()
    for got, was in (("rn", "m"), ("ri", "n"), ("vv", "w"), ("cl", "d"), ("ii", "u")):
        key = key.replace(got, was)
    return key.translate(_FOLD)


def shape(line: str) -> int:
    """0 plain, 1 list item, 2 table row or rule, 3 numbered heading."""
    if _ITEM.match(line):
        return 1
    if _HEADING.match(line):
        return 3
    return 2 if _TABLE.search(line) else 0


#: Layout features of a line: log odds of header against body of each, as they are before anything is fitted. The first holds of every line.
FEATURES = {
    "any": 0.5, "own block": 2.0, "list item": -6.0, "table row": -6.0, "numbered heading": -2.0, "ends a sentence": -1.5, "begins small after text": -0.5, "longer than 60": -1.5,
    "nothing before": 0.5, "nothing after": 0.5, "capitals": 1.0, "number beside": 1.0,
}
PRIOR = tuple(FEATURES.values())
_BESIDE = re.compile(r"^\d+ {2,}| {2,}\d+$")
#: Spread of the prior over the fitted weights, and the weight of one observed line against it.
SPREAD = 1.0


def features(line: str, before: str | None, after: str | None, apart: bool | None) -> int:
    """The FEATURES of a line as bits.

    before, after: the neighbouring lines ('' for a blank one, None beyond the page).  apart: whether the line has a block of its own, None where blocks are unknown.
    """
    text = line.strip()
    bare = _BESIDE.sub("", text) if text[:1].isdigit() or text[-1:].isdigit() else text
    kind = shape(bare)
    bits = 1 | (2 if apart else 0)
    if kind == 1:
        bits |= 0 if bare.startswith("©") else 4
    elif kind:
        bits |= 8 if kind == 2 else 16
    if text[-1:] in ".!?" and not text.endswith(("rev.", "p.")):
        bits |= 32
    if before and text[:1].islower():
        bits |= 64
    if len(text) > 60:
        bits |= 128
    if not before:
        bits |= 256
    if not after:
        bits |= 512
    if text.isupper():
        bits |= 1024
    return bits if bare is text or bare == text else bits | 2048


@functools.lru_cache(maxsize=8)
def scores(weights: tuple[float, ...]) -> list[float]:
    """``score`` of all bits."""
    return [score(b, weights) for b in range(1 << len(weights))]


def score(bits: int, weights: tuple[float, ...] = PRIOR) -> float:
    """Log odds of header against body of a line with these features."""
    return sum(w for i, w in enumerate(weights) if bits >> i & 1)


def fit(cells: list[tuple[int, int, int]], steps: int = 30) -> tuple[float, ...]:
    """Weights of the linear model from (bits, lines, lines that run through their document): logistic, a Gaussian about PRIOR.

    The counts are as many as there are different features together, whatever the number of lines.
    """
    if not cells:
        return PRIOR
    x = np.array([[b >> i & 1 for i in range(len(PRIOR))] for b, _, _ in cells], float)
    n, k = np.array([c[1] for c in cells], float), np.array([c[2] for c in cells], float)
    prior = np.array(PRIOR)
    w = prior.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (k - n * p) - (w - prior) / SPREAD**2
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w)) / SPREAD**2
        step = np.linalg.solve(hessian, gradient)
        w = w + step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def edges(lines: list[str], page_num: int | None) -> list[tuple[str, int]]:
    """(running key, features) of the first and last EDGE non-empty lines of a page that give no page number; blocks are unknown."""
    full = [i for i, x in enumerate(lines) if x and not x.isspace()]
    out = []
    for i in dict.fromkeys(full[:EDGE] + full[-EDGE:]):
        if not is_pageno(lines[i], page_num):
            out.append((running_key(lines[i], page_num), features(lines[i], lines[i - 1].strip() if i else None, lines[i + 1].strip() if i + 1 < len(lines) else None, None)))
    return out


#: Log odds of a running line beside another one, and beside the body.
STAY, LEAVE = 0.5, -0.5
#: How much worse it is to pass over a running line than to try one in vain, as the pages it stands on are counted afterwards.
COST = 50.0


def label(lines: list[str], page_num: int | None, apart: list[bool] | None = None, top: bool = True, bottom: bool = True, weights: tuple[float, ...] = PRIOR) -> dict[int, str]:
    """'header' and 'pageno' lines among the first and last EDGE non-empty lines of a page, by index; all others are body or break.

    top, bottom: whether the page begins with the first line and ends with the last; only true ends are labelled.
    Running lines form a stretch from either end; Viterbi over each end finds the best stretch, body within.
    """
    full = [i for i, x in enumerate(lines) if x and not x.isspace()]
    out: dict[int, str] = {}
    if not full:
        return out
    ends = (full[:EDGE] if top else [], full[-EDGE:][::-1] if bottom else [])
    of, bonus = scores(weights), math.log(COST)
    for end in ends:
        stay, leave, back = 0.0, float("-inf"), []
        for i in end:
            own = apart is None or apart[i]
            if own and is_pageno(lines[i], page_num):
                s, what = 8.0, "pageno"
            else:
                # a line inside a block is none, whatever it looks like
                s = bonus + of[features(lines[i], lines[i - 1].strip() if i else None, lines[i + 1].strip() if i + 1 < len(lines) else None, apart is not None)] if own else -9.0
                what = "header"
            # states: running (from the end so far, or standing alone beside a heading), body
            run = max(stay + STAY, leave + LEAVE) + s
            body = max(stay, leave)
            back.append((i, what, run > body))
            stay, leave = run, body
        for i, what, taken in back:
            if taken:
                out[i] = what
    return out


def paragraphs(lines: list[str], drop: set[int], reader: Reader | None = None) -> str:
    """Continuous paragraphs of a page: running lines dropped, split words joined, misread words mended, line breaks inside a paragraph removed."""
    kept = [x.rstrip() for i, x in enumerate(lines) if i not in drop]
    # the pieces of each paragraph are put together once, and its kind is that of its first line, so time grows with the lines
    out: list[list[str]] = []
    fresh, before = True, 0
    for i, x in enumerate(kept):
        if not x.strip():
            fresh = True
            continue
        kind = shape(x)
        if reader is not None and not all(reader.judge(t) in (True, None) for t in x.split()):
            x = re.sub(r"\S+", lambda m: _mend(m.group(), reader), x)
        if out and not fresh and not kind and not before:
            if reader is not None and kept[i - 1][-1:] in _MARK and reader.splits(kept[i - 1], x):
                out[-1][-1] = _SPLIT.sub(r"\1", out[-1][-1])
                out[-1].append(x.lstrip())
            else:
                out[-1].append(f" {x.strip()}")
        else:
            if out and (fresh or bool(kind) != bool(before)):
                out.append([""])
            out.append([x.strip() if not kind else x])
            before = shape(out[-1][0])
        fresh = False
    return "\n".join("".join(x) for x in out)


def _mend(token: str, reader: Reader) -> str:
    got = reader.judge(token)
    if not isinstance(got, str):
        return token
    inner = token.strip(".,;:()[]{}\"'“”„‘’«»…?*")
    new = got.capitalize() if inner[:1].isupper() else got
    return token.replace(inner, new, 1)
