"""Truncated and otherwise defective answers (problems 3 and 4): the rules for one answer.

Everything here is plain Python on one text; the queries in p3 and p4 feed it Arrow batches.
"""

from __future__ import annotations

import re
import sys
import unicodedata

from leafmill.llm.codepoints import TWINS

_UNSEEN = {i: None for i in range(sys.maxunicode + 1) if unicodedata.category(chr(i)) == "Cf"}
_SEEN_AS = _UNSEEN | {ord(p[0]): p[1] for p in TWINS.split(" ")}
_WORD = re.compile(r"\w+", re.U)
_TOKEN = re.compile(r"[^\s;|]+")
_END = re.compile(r"[.!?。！？][\"'”’»)\]*_]*(?:\s*\(\d{1,3}\))?$")
_ITEM = re.compile(r"^\s*(?:[-*•·√–▪○]|├──|└──|\d{1,3}[.)]|[A-Za-z][.)]|\(?\w{1,2}\))\s+\S")
_HEADING = re.compile(r"^\s*\d+(?:\.\d+)*\.?\s+\S")


def bare(text: str | None) -> str:
    """The text without invisible characters and outer blanks."""
    return (text or "").translate(_UNSEEN).strip()


def is_empty(text: str | None) -> bool:
    """Nothing is left without blanks, invisible characters, quotes and fences."""
    # every other fence opens, and may have a label
    parts = [re.sub(r"^\w*", "", x) if i % 2 else x for i, x in enumerate(bare(text).split("```"))]
    kept = re.sub(r"[`\"'“”„‘’«»\s]", "", "".join(parts))
    return not kept


def open_json(text: str) -> bool | None:
    """Whether a JSON text stops before its outer value closes; None if the text is no JSON at all.

    Both quote styles count as strings, so text that is only invalid JSON is not taken for cut.
    """
    at = re.search(r"[{\[]", text)
    if not at or (text[: at.start()].strip() and "```" not in text[: at.start()] and not text[: at.start()].rstrip().endswith(":")):
        return None
    after = text[at.start() + 1 :].lstrip()
    if text[at.start()] == "[" and re.match(r"\w+\]", after):
        return None
    first = re.match(r"[{\[\s]*([\"'])", text[at.start() :])
    style = first.group(1) if first else '"'
    depth, inside, skip = 0, False, False
    for i in range(at.start(), len(text)):
        c = text[i]
        if skip:
            skip = False
        elif inside:
            if c == "\\":
                skip = True
            elif c == style and (style == '"' or not (text[i - 1 : i].isalnum() and text[i + 1 : i + 2].isalnum())):
                inside = False
        elif c == style:
            inside = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if depth == 0:
                return False
    return True


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence of two token lists, a bit for each token of ``a``."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & places.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def containment(a: list[str], b: list[str], k: int = 3) -> float:
    """Share of the k-token shingles of ``a`` that occur in ``b``."""
    have = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)}
    own = [tuple(a[i : i + k]) for i in range(len(a) - k + 1)]
    return sum(s in have for s in own) / len(own) if own else 0.0


def words(text: str) -> list[str]:
    """Casefolded words, with letters of one shape and width forms taken as one."""
    return _WORD.findall(unicodedata.normalize("NFKC", text.translate(_SEEN_AS)).casefold())


def is_copy(answer: str, prompt: str | None, page: str | None = None) -> bool:
    """The answer gives the prompt back, with or without its page, and nothing of its own.

    Decoration (quotes, asterisks, a trailing "Answer:", dots instead of the last mark) does not count.
    """
    if not prompt:
        return False
    lead = prompt.replace("{page}", "").strip()
    text = re.sub(r"(?i)\banswer\s*:?\s*$", "", bare(answer).strip("\"'“”*`… \n"))
    own, asked = words(text), words(lead)
    if len(own) < 4 or len(asked) < 4:
        return False
    if len(own) <= 1.5 * len(asked) + 4:
        known = set(asked)
        if sum(w in known for w in own) >= 0.8 * len(own) and (containment(own, asked) >= 0.8 or lcs(own, asked) >= 0.85 * len(own)):
            return True
    head, rest = own[: len(asked)], own[len(asked) :]
    if page is not None and len(set(head) & set(asked)) >= 0.8 * len(set(asked)) and lcs(head, asked) >= 0.9 * len(asked):
        given = words(page)
        if not rest or rest == given:
            # a page without noise reads the same after correction: its line breaks tell a copy from an answer
            body = text[text.find("\n") :] if "\n" in text else ""
            return not rest or "\n" not in page.strip() or body.strip().count("\n") >= page.strip().count("\n")
    return False


# Refusal wordings to align with; up to GAP other words may stand between two of theirs.
REFUSALS = (
    "can't help with|can't help|cannot help|cannot process|can't process|cannot assist|can't assist|am unable to|unable to complete|not able to comply|not able to|"
    "won't be able to|cannot comply|can't comply|have to refuse|must refuse|not possible for me|do not have the ability|don't have the ability|must decline|cannot fulfil|can't provide|"
    "kann ich ihnen nicht helfen|kann diese anfrage nicht bearbeiten|kann dabei nicht helfen|keine auskunft geben|nicht in der lage|muss ablehnen|muss diese aufgabe ablehnen|"
    "ist mir nicht möglich|ne peux pas|ne suis pas en mesure|dois refuser|m'est impossible|il m'est impossible|no puedo|no me es posible|no soy capaz|debo rechazar|lamento no poder|"
    "não posso|não consigo ajudar|não me é possível|devo recusar|não sou capaz|nie mogę|nie jestem w stanie|muszę odmówić|не могу|не в состоянии|вынужден отказать|должен отказать"
).split("|")
# Words by which a speaker speaks of itself, pronouns and verb forms.
SPEAKER = frozenset("i i'm i'd i'll i've me my we our ich mir mich wir uns je j'ai moi m'est nous puedo me soy debo lamento posso consigo devo sou mogę jestem muszę mnie я могу мне вынужден должен состоянии".split())
GAP = 2
_REFUSALS = [(r.split(), frozenset(r.split())) for r in REFUSALS]
_SENTENCE = re.compile(r"[^.!?。！？;:\n]+")


def aligned(template: list[str], own: list[str]) -> bool:
    """The template's words stand in ``own`` in order, at most GAP other words between two of them."""
    for start in (i for i, w in enumerate(own) if w == template[0]):
        ends = {start}
        for t in template[1:]:
            ends = {j for e in ends for j in range(e + 1, min(e + 2 + GAP, len(own))) if own[j] == t}
            if not ends:
                break
        if ends:
            return True
    return False


def is_refusal(answer: str) -> bool:
    """The answer opens with a refusal: a sentence or clause that aligns with a refusal wording, said of the speaker.

    What stands before it must be shorter than it and what follows: an apology or thanks, and no answer.  However long the
    answer is, nothing of it is left out of account.
    """
    text = bare(answer).replace("’", "'").casefold()
    if text[:1] in "{[":
        return False
    clauses = [c for c in (re.findall(r"[\w']+", m.group()) for m in _SENTENCE.finditer(text)) if c]
    before, total = 0, sum(map(len, clauses))
    said = False
    for own in clauses:
        have = set(own)
        said = said or not SPEAKER.isdisjoint(have)
        if said and 2 * before < total:
            if any(words_ <= have and aligned(template, own) for template, words_ in _REFUSALS):
                return True
        before += len(own)
        if 2 * before >= total:
            return False
    return False


def unfinished(answer: str, listed: bool = False) -> bool:
    """The text stops inside a word, a sentence or a JSON value; ``listed``: a list of labels, which needs no full stop."""
    text = bare(answer)
    if not text:
        return False
    is_open = open_json(text)
    if is_open is not None:
        return is_open
    return not listed and not _END.search(text)


def unfinished_page(corrected: str, raw: str | None) -> bool:
    """A corrected page stops before the wording of its raw page does.

    Prose must end in a full stop.  Lists, tables and headings need none: there the tail is aligned with the raw
    page, and the page is cut if what follows there is more than running lines.
    """
    text = bare(corrected)
    if not text or _END.search(text):
        return False
    last = text.rsplit("\n", 1)[-1]
    row = bool(_ITEM.match(last) or _HEADING.match(last) or re.search(r"[;|\t]|\S {2,}\S", last))
    if not row and len(last.split()) > 6:
        return True
    page = (raw or "").rstrip()
    spans = [(m.group().casefold(), m.end()) for m in _TOKEN.finditer(page)]
    tail = [t.casefold() for t in _TOKEN.findall(text)[-7:]]
    if not spans or not tail:
        return not row
    best, at = -1.0, len(spans) - 1
    for p in range(len(spans)):
        hit = sum(1 for k in range(1, len(tail)) if p - k >= 0 and spans[p - k][0] == tail[-1 - k])
        if spans[p][0] == tail[-1]:
            hit += 1.5
        elif spans[p][0].startswith(tail[-1]):
            hit += 1.2
        if hit >= best:
            best, at = hit, p
    left = page[spans[at][1] :]
    same, _, below = left.partition("\n")
    if spans[at][0] != tail[-1] and spans[at][0].startswith(tail[-1]) and len(spans[at][0]) > len(tail[-1]):
        return True
    if same.strip(" -|;\t"):
        return True
    more = [x for x in below.split("\n") if x.strip()]
    return len(more) > 3 or any(_ITEM.match(x) or re.search(r"[;|\t]|\S {2,}\S.* {2,}\S", x) for x in more[:1]) and len(more) > 2


# How an English prompt names the language of the answer.
NAMED = {"english": "en", "german": "de", "french": "fr", "spanish": "es", "portuguese": "pt", "russian": "ru", "polish": "pl", "japanese": "ja"}
_NAMED = re.compile(r"(?i)\bin (english|german|french|spanish|portuguese|russian|polish|japanese)\b")


def asked_language(prompt: str | None, lang: str | None) -> str | None:
    """The language that the prompt names, else its own."""
    m = _NAMED.search(prompt or "")
    return NAMED[m.group(1).lower()] if m else (lang or "").lower()[:2] or None
