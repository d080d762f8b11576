"""Problem 6: noise in text from scanned pages."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import noise, vocab
from leafmill.session import cut, table

_OUT = "src_table string, doc_id long, page_num int, rec_id long, noise string, key string"
#: Lines of a page that are held at once; a longer page streams through, its last lines carried over from one stretch to the next.
HELD = 20_000
#: Rows of whole pages that the line model is fitted on, about; its labels are made here, so the sample bounds the work only.
SAMPLE = 20_000


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_num, span_ord, block_id, rec_id, text of text_blocks, null and blank texts left out."""
    return table(spark, sf_dir, "text_blocks").where(r"text rlike '\\S' and tb_id is not null").select("doc_id", "page_num", "span_ord", "block_id", F.col("tb_id").alias("rec_id"), "text")


def whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src_table, doc_id, page_num, rec_id, text of ocr_results.text and corrected_texts.raw_ocr."""
    o = table(spark, sf_dir, "ocr_results").select(F.lit("ocr_results").alias("src_table"), "doc_id", "page_num", F.col("ocr_id").alias("rec_id"), "text")
    c = table(spark, sf_dir, "corrected_texts").select(F.lit("corrected_texts").alias("src_table"), "doc_id", "page_num", F.col("ct_id").alias("rec_id"), F.col("raw_ocr").alias("text"))
    return o.unionAll(c).where("text is not null and rec_id is not null")


def _seam(lines: list[str]) -> int:
    """Where a stretch of a long page can end: both parts have the lines by which the ends of a page are labelled. 0 for nowhere."""
    full = [i for i, x in enumerate(lines) if x and not x.isspace()]
    return full[-noise.EDGE - 1] if len(full) > 2 * noise.EDGE + 2 else 0


def _page(src, doc, page, recs, lines, apart, broken, reader, out, start=0, stop=None, top=True, bottom=True, skip=False, weights=noise.PRIOR):
    """Appends the noise of one page, or of its lines from start to stop. recs: the record of each line; apart: own block, None where a record is a page; broken: the lines that end a paragraph before the next.

    skip: whether the line before start ends in the first half of a word; the same of the last line is returned.
    """
    for i, what in noise.label(lines, page, apart, top, bottom, weights).items():
        out.append((src, doc, page, recs[i], what, noise.running_key(lines[i], page) if what == "header" else None))
    tally: dict = {}
    last = len(lines) - 1
    for i in range(start, len(lines) if stop is None else stop):
        x = lines[i]
        split = i < last and not broken[i] and x[-1:] in "-‐‑­¬=~⸗⁃ \t" and reader.splits(x, lines[i + 1])
        if split:
            out.append((src, doc, page, recs[i], "hyphen", None))
        k, b, u = reader.misread(x, skip, split)
        got = tally.get(recs[i])
        tally[recs[i]] = (k, b, u) if got is None else (got[0] + k, got[1] + b, got[2] + u)
        skip = split
    for rec, (k, b, u) in tally.items():
        if b and k + b >= u and (k or b == 1):
            out.append((src, doc, page, rec, "misread", None))
    return skip


def _batch(rows):
    cols = list(zip(*rows)) if rows else [[]] * 6
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in _OUT.split(", ")])


def _rows(held, reader, out, start, stop, top, skip, weights=noise.PRIOR):
    """Appends the noise of the lines of a page, or of a stretch of it, from start to stop; see ``_page``."""
    if not held:
        return False
    doc, page = held[0][:2]
    of = [r[3] for r in held]
    n = len(of)
    apart = [(i == 0 or of[i - 1] != of[i]) and (i == n - 1 or of[i + 1] != of[i]) for i in range(n)]
    broken = [i == n - 1 or of[i + 1] != of[i] for i in range(n)]
    return _page("text_blocks", doc, page, [r[4] for r in held], [r[5] for r in held], apart, broken, reader, out, start, stop, top, stop is None, skip, weights)


def _stream(batches, reader, most_held=HELD, weights=noise.PRIOR):
    """The noise of text_blocks sorted by page and line, at most about most_held lines of a page held at once.

    A row with line breaks is a page of its own, however many of them a page has; the other rows of the page are its lines.
    """
    held: list = []
    now = before = None
    # of the page at hand: lines of held that are done, whether its first line is in held, split word before, length at which to look for a seam
    fresh = (0, True, False, most_held)
    done, top, skip, most = fresh
    for b in batches:
        out: list = []
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[:2] != now:
                _rows(held, reader, out, done, None, top, skip, weights)
                held, now = [], row[:2]
                done, top, skip, most = fresh
            elif len(held) >= most:
                if at := _seam([r[5] for r in held]):
                    skip = _rows(held, reader, out, done, at, top, skip, weights)
                    # the line before the seam stays to be looked back at
                    held, done, top, most = held[at - 1 :], 1, False, most_held
                else:
                    most += most_held
            if row[4] == before:
                continue
            before = row[4]
            if "\n" in row[5]:
                lines = row[5].replace("\r\n", "\n").split("\n")
                _page("text_blocks", row[0], row[1], [row[4]] * len(lines), lines, None, [False] * len(lines), reader, out, weights=weights)
            else:
                held.append(row)
        yield _batch(out)
    out = []
    _rows(held, reader, out, done, None, top, skip, weights)
    yield _batch(out)


def fitted(spark: SparkSession, sf_dir: str) -> tuple[float, ...]:
    """Weights of the line model, from the lines at the ends of the pages of about SAMPLE rows of ``whole``, whole documents by hash.

    A line counts as a header where its key stands on noise.PAGES pages of its document in its table.  Pages are read where
    they lie; only keys and features are shuffled, and counts by features (at most 2^12) reach the driver.
    """

    def run(batches):
        for b in batches:
            out = [(src, doc, page, k, bits) for src, doc, page, _, text in zip(*(c.to_pylist() for c in b.columns)) for k, bits in noise.edges(text.replace("\r\n", "\n").split("\n"), page)]
            cols = list(zip(*out)) if out else [[]] * 5
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["src_table", "doc_id", "page_num", "key", "bits"])

    rows = whole(spark, sf_dir).where("doc_id is not null and page_num is not null")
    total = rows.count()
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(1_000_000 * min(1.0, SAMPLE / max(total, 1))))
    got = chosen.mapInArrow(run, "src_table string, doc_id long, page_num int, key string, bits int").withColumn("key", F.xxhash64("key"))
    line = cut(got.groupBy("src_table", "doc_id", "key", "page_num", "bits").agg(F.count("*").alias("n")))
    pages = line.select("src_table", "doc_id", "key", "page_num").distinct().groupBy("src_table", "doc_id", "key").agg((F.count("*") >= noise.PAGES).alias("runs"))
    by_bits = line.groupBy("src_table", "doc_id", "key", "bits").agg(F.sum("n").alias("n")).join(pages, ["src_table", "doc_id", "key"])
    cells = by_bits.groupBy("bits").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("runs"), F.col("n")).otherwise(0)).alias("k"))
    return noise.fit(sorted((r.bits, r.n, r.k) for r in cells.collect()))


def marks(spark: SparkSession, sf_dir: str, counts, weights: tuple[float, ...] = noise.PRIOR) -> DataFrame:
    """All noise of all records, header lines still as candidates with their key."""

    def run_whole(batches):
        reader = noise.Reader(counts.value, marks=True)
        for b in batches:
            out: list = []
            for src, doc, page, rec, text in zip(*(c.to_pylist() for c in b.columns)):
                lines = text.replace("\r\n", "\n").split("\n")
                _page(src, doc, page, [rec] * len(lines), lines, None, [False] * len(lines), reader, out, weights=weights)
            yield _batch(out)

    def run_blocks(batches):
        yield from _stream(batches, noise.Reader(counts.value), weights=weights)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = blocks(spark, sf_dir).repartition(parts, "doc_id", "page_num").sortWithinPartitions("doc_id", "page_num", "span_ord", "rec_id")
    return rows.mapInArrow(run_blocks, _OUT).unionAll(whole(spark, sf_dir).mapInArrow(run_whole, _OUT))


def words(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    """The frequent words of all three columns, at most vocab.SHARE."""
    texts = blocks(spark, sf_dir).select("text").unionAll(whole(spark, sf_dir).select("text"))
    return vocab.frequent(texts, "text")


def noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src_table, doc_id, page_num, rec_id, noise, key of all noise; header lines that stand on noise.PAGES pages of their document.

    Rows without doc_id have no document, so no header.
    """
    counts = spark.sparkContext.broadcast(words(spark, sf_dir))
    found = cut(marks(spark, sf_dir, counts, fitted(spark, sf_dir)))
    heads = found.where("noise = 'header' and doc_id is not null and page_num is not null")
    often = heads.select("src_table", "doc_id", "key", "page_num").distinct().groupBy("src_table", "doc_id", "key").agg(F.count("*").alias("pages")).where(F.col("pages") >= noise.PAGES)
    return found.where("noise <> 'header'").unionByName(heads.join(often.drop("pages"), ["src_table", "doc_id", "key"]))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with noise, one row per kind."""
    return noisy(spark, sf_dir).select("src_table", "rec_id", "noise").distinct()


def _clean_page(text, page, keys, reader, weights=noise.PRIOR):
    """The paragraphs of a text that is a whole page; keys: those of its running lines."""
    lines = text.replace("\r\n", "\n").split("\n")
    drop = {i for i, what in noise.label(lines, page, weights=weights).items() if what == "pageno" or (keys and noise.running_key(lines[i], page) in keys)}
    return noise.paragraphs(lines, drop, reader)


def _clean_blocks(batches, reader, most_held=HELD, weights=noise.PRIOR):
    """The paragraphs of text_blocks sorted by page and line, each under its first record.

    Of a block of more than most_held lines every so many lines are a row of their own, never ended inside a split word.
    """
    held: list = []
    now = before = None
    for b in batches:
        out: list = []
        for doc, page, _, block, rec, text, keys, pageno in zip(*(c.to_pylist() for c in b.columns)):
            if rec == before:
                continue
            before = rec
            if "\n" in text:
                _paragraph(held, reader, out)
                held, now = [], None
                out.append((rec, _clean_page(text, page, keys, reader, weights)))
                continue
            if pageno or keys:
                continue
            if (doc, page, block) != now or len(held) >= most_held and not reader.splits(held[-1][1], text):
                _paragraph(held, reader, out)
                held, now = [], (doc, page, block)
            held.append((rec, text))
        yield _cleaned("text_blocks", out)
    out = []
    _paragraph(held, reader, out)
    yield _cleaned("text_blocks", out)


def _paragraph(held, reader, out):
    if held and (clean := noise.paragraphs([x for _, x in held], set(), reader)):
        out.append((held[0][0], clean))


def _cleaned(src, rows):
    kinds = (pa.string(), pa.int64(), pa.string())
    cols = [[src] * len(rows), [r[0] for r in rows], [r[1] for r in rows]]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["src_table", "rec_id", "clean"])


def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src_table, rec_id, clean: the pages of ocr_results and corrected_texts, and the paragraphs of text_blocks, as continuous paragraphs.

    Lines that run through the document and page numbers are dropped, split words joined, misread words mended.  A row of
    text_blocks that holds a whole page stays one; elsewhere the rows of a block are a paragraph, listed under its first row.
    """
    counts = spark.sparkContext.broadcast(words(spark, sf_dir))
    weights = fitted(spark, sf_dir)
    found = cut(marks(spark, sf_dir, counts, weights).where("noise in ('header', 'pageno')"))
    heads = found.where("noise = 'header' and doc_id is not null and page_num is not null")
    often = heads.select("src_table", "doc_id", "key", "page_num").distinct().groupBy("src_table", "doc_id", "key").agg(F.count("*").alias("pages")).where(F.col("pages") >= noise.PAGES)
    running = heads.join(often.drop("pages"), ["src_table", "doc_id", "key"]).select("src_table", "rec_id", "key", F.lit(False).alias("pageno"))
    numbers = found.where("noise = 'pageno'").select("src_table", "rec_id", F.lit(None).cast("string").alias("key"), F.lit(True).alias("pageno"))
    drop = running.unionAll(numbers).groupBy("src_table", "rec_id").agg(F.collect_set("key").alias("keys"), F.max("pageno").alias("pageno"))
    pages = whole(spark, sf_dir).dropDuplicates(["src_table", "rec_id"]).join(drop, ["src_table", "rec_id"], "left").select("src_table", "rec_id", "page_num", "text", "keys")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    of_blocks = drop.where("src_table = 'text_blocks'").drop("src_table")
    lines = blocks(spark, sf_dir).join(of_blocks, "rec_id", "left").select("doc_id", "page_num", "span_ord", "block_id", "rec_id", "text", "keys", "pageno")
    lines = lines.repartition(parts, "doc_id", "page_num").sortWithinPartitions("doc_id", "page_num", "span_ord", "rec_id")

    def run(batches):
        reader = noise.Reader(counts.value, marks=True)
        for b in batches:
            out = [_clean_page(text, page, ks, reader, weights) for _, _, page, text, ks in zip(*(c.to_pylist() for c in b.columns))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["src_table", "rec_id", "clean"])

    def run_blocks(batches):
        yield from _clean_blocks(batches, noise.Reader(counts.value), weights=weights)

    schema = "src_table string, rec_id long, clean string"
    return pages.mapInArrow(run, schema).unionAll(lines.mapInArrow(run_blocks, schema))


QUERIES = {"p6_found": p6_found, "p6_clean": p6_clean}
SQL: dict[str, str] = {}
