"""Column functions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column | str) -> Column:
    """The text without outer Unicode white space; null stays null."""
    return F.regexp_replace(c, r"(?U)^\s+|(?U)\s+\z", "")


# The patterns that the cleaned text is defined by, in the order they are applied.
LAYOUT = ((" +", " "), ("\n{3,}", "\n\n"), ("(?<=[a-z])-\n(?=[a-z])", ""), (r"[^\x09\x0A\x0D\x20-\x7E\x{00A0}-\x{FFFF}]", ""))
# Fixed value: the fences of a JSON answer.
FENCE = r"(?mdU)^```json\s*|```$"


def layout_clean(c: Column | str) -> Column:
    """Runs of blanks and of line breaks shortened, words split with a hyphen joined, unprintable characters dropped, stripped."""
    t = F.col(c) if isinstance(c, str) else c
    for pattern, to in LAYOUT:
        t = F.regexp_replace(t, pattern, to)
    return strip(t)


def fence_strip(c: Column | str) -> Column:
    """The text without the markdown fences of a JSON answer, stripped."""
    return strip(F.regexp_replace(c, FENCE, ""))


def words(c: Column | str) -> Column:
    """Words between Unicode white space; none for a blank text."""
    t = strip(c)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"(?U)\s+"))


def token_class(w: Column) -> Column:
    """What the spelling step does with a token: number, acronym (left alone), or capital, plain (looked up)."""
    return (
        F.when(w.rlike(r"^[0-9.,\-]+$"), "number")
        .when((F.upper(w) == w) & (F.lower(w) != w) & (F.length(w) > 1), "acronym")
        .when((F.upper(F.substring(w, 1, 1)) == F.substring(w, 1, 1)) & (F.lower(F.substring(w, 1, 1)) != F.substring(w, 1, 1)), "capital")
        .otherwise("plain")
    )


#: What the strip of ``strip`` is in the other engine's SQL (its \s knows ASCII only).
SQL_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SQL_SPACE_JAVA = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_strip(expr: str) -> str:
    """``strip`` as SQL of the oracle."""
    return f"regexp_replace({expr}, '^{SQL_SPACE_JAVA}+|{SQL_SPACE_JAVA}+$', '', 'g')"
