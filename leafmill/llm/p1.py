"""Problem 1: garbled text from wrong character encoding."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import swaps
from leafmill.llm.codepoints import to_points
from leafmill.session import cut, table


#: Distinct (source, word) counted in a worker before they are handed on.
MOST = 200_000


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src_table, source, rec_id, text. The source is the recogniser in ocr_results, native or ocr in text_blocks. Null texts are left out."""
    t = table(spark, sf_dir, "text_blocks").select(F.lit("text_blocks").alias("src_table"), F.concat(F.lit("t:"), F.coalesce("source", F.lit(""))).alias("source"), F.col("tb_id").alias("rec_id"), "text")
    o = table(spark, sf_dir, "ocr_results").select(F.lit("ocr_results").alias("src_table"), F.concat(F.lit("o:"), F.coalesce("engine", F.lit(""))).alias("source"), F.col("ocr_id").alias("rec_id"), "text")
    return t.unionAll(o).where("text is not null and rec_id is not null")


def _gather(rows: DataFrame) -> DataFrame:
    """(source, word, pair, n): words with a character outside ASCII by source, and, with null word, the letter bigrams of all text."""

    def run(batches):
        sums: Counter = Counter()
        words: Counter = Counter()
        for b in batches:
            points, starts = to_points(b.column(1))
            lows = np.zeros(len(points) + len(starts), np.int64)
            where = np.arange(len(points)) + 1 + np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            lows[where] = swaps.LOW[np.minimum(points, swaps.TOP)]
            a, c = lows[:-1], lows[1:]
            keep = (a != 0) | (c != 0)
            pair, n = np.unique(a[keep] * (swaps.HIGH + 1) + c[keep], return_counts=True)
            sums.update(dict(zip(pair.tolist(), n.tolist())))
            for src, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not t.isascii():
                    words.update((src, w) for w in swaps.WORD.findall(t))
            if len(words) > MOST:
                yield _counts(words, {})
                words.clear()
        yield _counts(words, sums)

    got = rows.select("source", "text").mapInArrow(run, "source string, word string, pair long, n long")
    return cut(got.groupBy("source", "word", "pair").agg(F.sum("n").alias("n")))


def _counts(words: dict, sums: dict) -> pa.RecordBatch:
    w, s = list(words), list(sums)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([k[0] for k in w] + [None] * len(s), pa.string()),
            pa.array([k[1] for k in w] + [None] * len(s), pa.string()),
            pa.array([None] * len(w) + s, pa.int64()),
            pa.array([*words.values(), *sums.values()], pa.int64()),
        ],
        names=["source", "word", "pair", "n"],
    )


def learn(spark: SparkSession, rows: DataFrame) -> swaps.Model:
    """The model after swaps.ROUNDS of expectation-maximization over all words.

    What reaches the driver is bounded by alphabets and sources, not by rows: bigrams of letters (below swaps.HIGH),
    shares (sources x ciphers) and bigrams of symbols (sources x ciphers x symbols of a code page squared).
    """
    gathered = _gather(rows)
    base = {r["pair"]: float(r["n"]) for r in gathered.where("word is null").select("pair", "n").collect()}
    model = swaps.Model(swaps.lettered(base))
    words = gathered.where("word is not null").select("source", "word", "n")
    learnt: dict = {}
    for step in range(swaps.ROUNDS + 1):
        counts, shares, symbols = _expect(spark, words, model, base, step == 0)
        learnt = swaps.tables(symbols, counts, step == swaps.ROUNDS)
        model = swaps.Model(counts, shares, {k: t for k, t in learnt.items() if not k[1].startswith("?")})
    free = {k: t for k, t in learnt.items() if k[1].startswith("?")}
    return _with_free(spark, words, model, free) if free else model


def _expect(spark: SparkSession, words: DataFrame, model: swaps.Model, base: dict, start: bool) -> tuple[dict, dict, dict]:
    """One expectation step over all words: bigrams without what is garbled, shares by source, bigrams of symbols."""
    shared = _share(spark, model)

    def run(batches):
        own = _own(shared)
        out: Counter = Counter()
        for b in batches:
            shares, cells, symbols = swaps.expect(own, list(zip(*(c.to_pylist() for c in b.columns))), start)
            for (s, k), n in shares.items():
                out[s, k, 0, 0] += n
            for (s, k, p, q), n in symbols.items():
                out[s, k, p + 1, q + 1] += n
            for c, n in cells.items():
                out[None, None, c, 0] += n
        ks = list(out)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[i] for k in ks], pa.string() if i < 2 else pa.int64()) for i in range(4)] + [pa.array([float(out[k]) for k in ks], pa.float64())],
            names=["source", "cipher", "a", "b", "n"],
        )

    got = words.mapInArrow(run, "source string, cipher string, a long, b long, n double").groupBy("source", "cipher", "a", "b").agg(F.sum("n").alias("n")).collect()
    counts: dict = defaultdict(float, base)
    shares: dict = defaultdict(dict)
    symbols: dict = {}
    for r in got:
        if r["source"] is None:
            counts[r["a"]] += r["n"]
        elif r["a"] == 0:
            shares[r["source"]][r["cipher"]] = r["n"]
        else:
            symbols[r["source"], r["cipher"], r["a"] - 1, r["b"] - 1] = r["n"]
    for s, by in shares.items():
        total = sum(by.values()) + 1
        shares[s] = {k: max(n, 0.0) / total for k, n in by.items()}
        shares[s][""] = max(shares[s].get("", 0.0), 0.5)
    return dict(counts), dict(shares), symbols


def _with_free(spark: SparkSession, words: DataFrame, model: swaps.Model, free: dict) -> swaps.Model:
    """``model`` with those free ciphers whose words are words of the corpus once they are decoded, and with these words as decoded in its bigrams."""
    tried = _share(spark, swaps.Model(model.counts, model.shares, model.tables | free))

    def decoded(own, batch):
        src, words_, n = (c.to_pylist() for c in batch.columns)
        for s, w, c, odd, (k, _, lo) in zip(src, words_, n, own.strange(words_), own.judge(src, words_)):
            cipher = swaps.kind(w) if odd and (k is None or k.startswith("?") or lo < swaps.ODDS) else ""
            yield s, cipher, w, c, lo, own.tables.get((s, cipher))

    def run(batches):
        own = _own(tried)
        for b in batches:
            out = []
            for s, cipher, w, c, lo, to in decoded(own, b):
                if to:
                    if (t := w.translate(to)) != w:
                        out.append((s, cipher, t.lower(), c))
                elif lo < swaps.ODDS:
                    out.append((None, None, w.lower(), c))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string() if i < 3 else pa.int64()) for i in range(4)], names=["source", "cipher", "word", "n"])

    got = cut(words.mapInArrow(run, "source string, cipher string, word string, n long").groupBy("source", "cipher", "word").agg(F.sum("n").alias("n")))
    known = got.where("source is null").select("word", F.lit(1).alias("known"))
    rows = got.where("source is not null").join(known, "word", "left").groupBy("source", "cipher").agg(F.count("*").alias("words"), F.count("known").alias("known"), F.sum("n").alias("n")).collect()
    kept = {(r["source"], r["cipher"]): r["n"] for r in rows if r["known"] >= swaps.KNOWN_WORDS and r["known"] >= swaps.KNOWN_SHARE * r["words"]}
    if not kept:
        return model
    total = {r["source"]: r["n"] for r in words.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    shares = {s: dict(by) for s, by in model.shares.items()}
    for (s, k), n in kept.items():
        shares.setdefault(s, {})[k] = n / total[s]
    sure = {k: free[k] for k in kept}
    ours = _share(spark, swaps.Model(model.counts, model.shares, model.tables | sure))

    def moved(batches):
        own = _own(ours)
        for b in batches:
            out = swaps.bigrams([x for _, _, w, c, _, to in decoded(own, b) if to for x in ((w, -float(c)), (w.translate(to), float(c)))])
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.float64())], names=["pair", "n"])

    counts = defaultdict(float, model.counts)
    for r in words.mapInArrow(moved, "pair long, n double").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        counts[r["pair"]] += r["n"]
    return swaps.Model(dict(counts), shares, model.tables | sure)


def _share(spark: SparkSession, model: swaps.Model):
    """The model for the workers: bounded as ``learn`` says."""
    keys = np.fromiter(model.counts, np.int64, len(model.counts))
    return spark.sparkContext.broadcast((keys, np.fromiter(model.counts.values(), np.float64, len(keys)), model.shares, model.tables))


def _own(shared) -> swaps.Model:
    keys, n, shares, tables = shared.value
    return swaps.Model(dict(zip(keys.tolist(), n.tolist())), shares, tables)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with at least one garbled stretch, repairable or not."""
    rows = texts(spark, sf_dir)
    shared = _share(spark, learn(spark, rows))

    def run(batches):
        model = _own(shared)
        for b in batches:
            found = [(s, swaps.WORD.findall(t)) if not t.isascii() else (s, []) for s, t in zip(b.column(1).to_pylist(), b.column(3).to_pylist())]
            known = model.verdicts({(s, w) for s, words in found for w in words})
            keep = [any(known[s, w][2] >= swaps.ODDS for w in words) for s, words in found]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2)], names=["src_table", "rec_id"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, "src_table string, rec_id long").distinct()


def p1_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The garbled records with their text as restored, and whether all of it could be."""
    rows = texts(spark, sf_dir)
    shared = _share(spark, learn(spark, rows))

    def run(batches):
        model = _own(shared)
        for b in batches:
            src, rec, out, full = [], [], [], []
            cols = [c.to_pylist() for c in b.columns]
            model.verdicts({(s, w) for s, t in zip(cols[1], cols[3]) if not t.isascii() for w in swaps.WORD.findall(t)})
            for s, origin, i, t in zip(*cols):
                if t.isascii():
                    continue
                new, found, whole = model.repair(origin, t)
                if found:
                    src.append(s)
                    rec.append(i)
                    out.append(new)
                    full.append(whole)
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.string()), pa.array(rec, pa.int64()), pa.array(out, pa.string()), pa.array(full, pa.bool_())], names=["src_table", "rec_id", "restored", "complete"])

    return rows.mapInArrow(run, "src_table string, rec_id long, restored string, complete boolean").distinct()


QUERIES = {"p1_found": p1_found, "p1_repaired": p1_repaired}
SQL: dict[str, str] = {}
