"""Frequent words of a corpus, with their counts."""

from __future__ import annotations

import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.answers import _SEEN_AS as SEEN_AS
from leafmill.llm.answers import _UNSEEN as UNSEEN
from leafmill.session import cut

#: A word is frequent if it is at least one in SHARE words, and occurs LEAST times.  So there are at most SHARE frequent words, whatever the corpus.
SHARE, LEAST = 200_000, 3
STRIP = ".,;:()[]{}\"'“”„‘’«»…?*"


def plain(word: str) -> str:
    """A word without case, outer punctuation and invisible characters; letters of one shape and width forms as one."""
    word = word.strip(STRIP)
    if word.isascii():
        return word.lower()
    word = unicodedata.normalize("NFKC", word.translate(UNSEEN)).strip(STRIP)
    if not any("A" <= c <= "Z" or "a" <= c <= "z" for c in word):
        word = word.casefold()
    return unicodedata.normalize("NFC", word.translate(SEEN_AS)).casefold()


def frequent(texts: DataFrame, column: str) -> dict[str, int]:
    """The frequent words of a text column with their counts; at most SHARE of them reach the driver.

    Words are counted per batch, then by an aggregate; words with fewer than two letters are left out.
    """

    def run(batches):
        for b in batches:
            n = Counter(" ".join(t for t in b.column(0).to_pylist() if t).split())
            kept: Counter = Counter()
            for w, k in n.items():
                p = plain(w)
                if len(p) > 1 and p[0].isalpha() and sum(c.isalpha() for c in p) > 1:
                    kept[p] += k
            yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())], names=["word", "n"])

    counts = texts.select(column).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = counts.where(F.col("n") >= LEAST)
    counts = cut(counts)
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.where(F.col("n") >= max(LEAST, total / SHARE)).collect()
    return {r.word: r.n for r in rows}
