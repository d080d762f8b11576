"""Language of a text: naive Bayes over hashed letter trigrams, fitted on a bounded sample of labelled documents."""

from __future__ import annotations

import re
import unicodedata
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANGS = ("en", "de", "fr", "es", "pt", "ru", "pl", "ja")
#: Cells of the trigram table, and labelled documents taken per language, whole, by a share of the range of a hash of doc_id.
CELLS, SAMPLE = 1 << 15, 300
_WORD = re.compile(r"[^\W\d_]+")
_JA = re.compile(r"[ぁ-ヿ一-鿿]")


_known: dict[str, list[int]] = {}


def _of_word(w: str) -> list[int]:
    got = _known.get(w)
    if got is None:
        if len(_known) > 200_000:
            _known.clear()
        x = f" {w.lower()} "
        got = _known[w] = [] if len(w) > 1 and w.isupper() else [zlib.crc32(x[i : i + 3].encode()) % CELLS for i in range(len(x) - 2)]
    return got


def cells(text: str) -> np.ndarray:
    """Cells of the letter trigrams of the words of ``text``; codes in capitals are not words."""
    got: list[int] = []
    for w in _WORD.findall(text if text.isascii() else unicodedata.normalize("NFKC", text)):
        got += _of_word(w)
    return np.array(got, np.int64)


def sample(documents: DataFrame, per: int = SAMPLE) -> DataFrame:
    """Up to ``per`` documents of each language, by hash of doc_id; lang is read without case and region."""
    lang = F.lower(F.substring_index("lang", "-", 1))
    rows = documents.where("text is not null").select(lang.alias("lang"), F.xxhash64("doc_id").alias("h"), "text").where(F.col("lang").isin(*LANGS))
    cut_at = rows.groupBy("lang").agg(F.count("*").alias("n"))
    # the hash is uniform, so the share per/n of its range holds about ``per`` rows of the language
    share = F.broadcast(cut_at.withColumn("share", F.least(F.lit(1.0), F.lit(float(per)) / F.col("n"))).drop("n"))
    return rows.join(share, "lang").where(F.pmod("h", F.lit(1_000_000)) < F.col("share") * 1_000_000).select("lang", "text")


def fit(documents: DataFrame, per: int = SAMPLE) -> np.ndarray:
    """Log probabilities, one row of CELLS for each of LANGS. About ``per`` documents a language reach the driver's sums."""
    counts = np.zeros((len(LANGS), CELLS))

    def run(batches):
        own = np.zeros((len(LANGS), CELLS))
        for b in batches:
            for lang, text in zip(b["lang"], b["text"]):
                own[LANGS.index(lang)] += np.bincount(cells(text), minlength=CELLS)
        k, c = np.nonzero(own)
        import pandas as pd

        yield pd.DataFrame({"k": k.astype("int32"), "c": c.astype("int32"), "n": own[k, c]})

    got = sample(documents, per).mapInPandas(run, "k int, c int, n double").groupBy("k", "c").agg(F.sum("n").alias("n")).toPandas()
    np.add.at(counts, (got["k"].to_numpy(int), got["c"].to_numpy(int)), got["n"].to_numpy(float))
    counts += 0.05
    return np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def score(table: np.ndarray, text: str) -> tuple[np.ndarray, int]:
    """Mean log probability by language, and the number of trigrams. A text without Japanese letters is not Japanese."""
    c = cells(text)
    if not len(c):
        return np.zeros(len(LANGS)), 0
    s = table[:, c].mean(axis=1)
    if text.isascii() or not _JA.search(text):
        s[LANGS.index("ja")] = -99.0
    return s, len(c)


def guess(table: np.ndarray, text: str, least: int = 12) -> str | None:
    """The likeliest language; None for fewer than ``least`` trigrams."""
    s, n = score(table, text)
    return LANGS[int(s.argmax())] if n >= least else None
