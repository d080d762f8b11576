"""Problem 10: repetition inside a single document.

The method named (how often a line occurs across the documents of a host) measures copies between documents; the
share of a text that repeats earlier wording of the same text does not follow from it.  That share is computed exactly
by run hashing instead: every window of RUN words (characters for Japanese) is hashed, a window whose hash occurred
at an earlier place of the same text marks all its words.  ``p10_lines`` is the method named, for the lines.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.session import cut, table

#: Words of a run (characters of a Japanese text), and the share from which a document counts as repetitive.
RUN, RUN_JA, LIMIT = 8, 16, 0.4
#: Documents of a host in which a line must occur to be boilerplate, and the share of characters a document may lose.
LINE_DOCS, DEPLETED = 3, 0.5

_JA = re.compile(r"[ぁ-ヿㇰ-ㇿ㐀-䶿一-鿿ｦ-ﾟ]")
_WORD = re.compile(r"[^\W\d_]+")
_DROP = re.compile(r"[\W\d_]+", re.U)


def units(text: str | None) -> tuple[list[str], int]:
    """The words of a text, which are its runs of letters without case, and the run length; characters where most letters are Japanese.

    Punctuation and digits are between words: cells that only a semicolon parts are words of their own.
    """
    if not text:
        return [], RUN
    if _JA.search(text):
        letters = _DROP.sub("", text).casefold()
        if 2 * len(_JA.findall(letters)) > len(letters):
            return list(letters), RUN_JA
    return _WORD.findall(text.casefold()), RUN


def repeated(text: str | None) -> tuple[int, int]:
    """(units, units inside runs that occurred earlier)."""
    own, run = units(text)
    n = len(own)
    if n <= run:
        return n, 0
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, zlib.crc32(w.encode()) | (len(seen) << 32)) for w in own), np.uint64, count=n)
    h = np.zeros(n - run + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(run):
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + len(h)] * np.uint64(0xBF58476D1CE4E5B9)
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    again = np.flatnonzero(first[inverse] < np.arange(len(h)))
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + run, -1)
    return n, int((np.cumsum(edge[:-1]) > 0).sum())


def shares(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, words, repeated, share) of every row; null, empty and wordless texts have share 0."""

    @F.pandas_udf("words long, repeated long")
    def of(t: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([repeated(x if isinstance(x, str) else None) for x in t], columns=["words", "repeated"])

    got = docs.select(key, of(text).alias("r")).select(key, "r.*")
    return got.withColumn("share", F.when(F.col("words") > 0, F.col("repeated") / F.col("words")).otherwise(0.0))


def p10_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of repeated wording of every document."""
    return shares(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which at least two fifths of the words repeat earlier runs."""
    return p10_share(spark, sf_dir).where(F.col("words") > 0).where(5 * F.col("repeated") >= 2 * F.col("words")).select("doc_id").distinct()


#: A line in more than one of HOT rows of (document, line) is hot; so there are at most HOT hot lines.
HOT = 2000
_EOL = r"\r\n|\r|\n"


def _form(line):
    """A line without case, blanks and digits."""
    return F.regexp_replace(F.lower(line), r"[\s\d\p{Z}]+", "")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n, often) of (doc_id, source, text): the hash of each line of a document, its characters there, and whether
    LINE_DOCS documents of the source have it.

    A line counts once per document; counts are pre-aggregated, so a line that a third of all documents have is one row per
    task before the shuffle.  Its flag comes back by a broadcast of the hot lines, at most HOT, and by a join for the others,
    of which none fills a task.
    """
    lines = cut(
        docs.select("doc_id", "source", F.explode(F.split("text", _EOL)).alias("line"))
        .select("doc_id", "source", F.xxhash64(_form("line")).alias("h"), F.length(F.trim("line")).alias("n"), (F.length(_form("line")) > 0).alias("seen"))
        .where("seen").groupBy("source", "doc_id", "h").agg(F.sum("n").alias("n"))
    )
    total = lines.count()
    often = cut(lines.groupBy("source", "h").agg(F.count("*").alias("docs")).where(F.col("docs") >= LINE_DOCS))
    hot = often.where(F.col("docs") > total / HOT).select("source", "h", F.lit(1).alias("hot"))
    cold = often.where(F.col("docs") <= total / HOT).select("source", "h", F.lit(1).alias("cold"))
    flagged = lines.join(F.broadcast(hot), ["source", "h"], "left")
    rest = flagged.where("hot is null").drop("hot").join(cold, ["source", "h"], "left").select("doc_id", "h", "n", F.col("cold").isNotNull().alias("often"))
    return rest.unionAll(flagged.where("hot is not null").select("doc_id", "h", "n", F.lit(True).alias("often")))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).alias("text"))


def _depleted(lines: DataFrame, *more) -> DataFrame:
    kept = lines.groupBy("doc_id").agg(F.sum("n").alias("chars"), F.sum(F.when(F.col("often"), 0).otherwise(F.col("n"))).alias("kept"), *more)
    return kept.withColumn("depleted", F.col("kept") < (1 - DEPLETED) * F.col("chars"))


def p10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: characters in its lines, those left without lines that occur in LINE_DOCS documents of its source, and whether it is depleted."""
    return _depleted(repeated_lines(_docs(spark, sf_dir)))


def p10_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that occur in LINE_DOCS documents of its source, and whether it is rejected as depleted.

    A document without visible lines keeps its text, null as '', and is not rejected.
    """
    docs = _docs(spark, sf_dir)
    gone = _depleted(repeated_lines(docs), F.collect_set(F.when(F.col("often"), F.col("h"))).alias("gone"))
    rows = docs.select("doc_id", "text").join(gone.select("doc_id", "gone", "depleted"), "doc_id", "left")
    left = F.filter(F.split("text", _EOL), lambda x: (F.length(_form(x)) == 0) | ~F.array_contains("gone", F.xxhash64(_form(x))))
    return rows.select("doc_id", F.when(F.size("gone") > 0, F.array_join(left, "\n")).otherwise(F.col("text")).alias("clean"), F.coalesce("depleted", F.lit(False)).alias("rejected"))


QUERIES = {"p10_found": p10_found, "p10_share": p10_share, "p10_lines": p10_lines, "p10_clean": p10_clean}

SQL = {
    "p10_lines": f"""
with l as (
  select doc_id, coalesce(source, '') as source, unnest(regexp_split_to_array(coalesce(text, ''), '\\r\\n|\\r|\\n')) as line from documents where doc_id is not null
), k as (
  select doc_id, source, regexp_replace(lower(line), '[\\s\\d\\p{{Z}}\\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}]+', '', 'g') as h, length(trim(line)) as n from l
), d as (select source, doc_id, h, sum(n)::bigint as n from k where h <> '' group by all),
often as (select source, h from d group by all having count(*) >= {LINE_DOCS}),
r as (
  select d.doc_id, sum(d.n)::bigint as chars, sum(case when o.h is null then d.n else 0 end)::bigint as kept
  from d left join often o on d.source = o.source and d.h = o.h group by 1
)
select doc_id, chars, kept, kept < {1 - DEPLETED} * chars as depleted from r
""",
    "p10_clean": f"""
with l as (
  select doc_id, coalesce(source, '') as source, unnest(ls) as line, generate_subscripts(ls, 1) as pos from (select doc_id, source, regexp_split_to_array(coalesce(text, ''), '\\r\\n|\\r|\\n') as ls from documents where doc_id is not null)
), k as (
  select *, regexp_replace(lower(line), '[\\s\\d\\p{{Z}}\\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}]+', '', 'g') as h, length(trim(line)) as n from l
), often as (select source, h from k where h <> '' group by all having count(distinct doc_id) >= {LINE_DOCS}),
f as (select k.*, o.h is not null as often from k left join often o on k.source = o.source and k.h = o.h),
d as (select doc_id, string_agg(line, chr(10) order by pos) filter (where not often) as clean, bool_or(often) as any_, sum(n) filter (where h <> '') as chars, coalesce(sum(n) filter (where h <> '' and not often), 0) as kept from f group by 1)
select d.doc_id, case when any_ then coalesce(clean, '') else coalesce(text, '') end as clean, coalesce(kept < {1 - DEPLETED} * chars, false) as rejected from d join documents using (doc_id)
""",
}
