"""Problem 3: text cut off by field limits or broken transfers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import answers
from leafmill.session import cut, table

#: A length is a limit if it is the largest of its source, LEAST answers reach it, and they are RATIO times as many as the mean length below it has.
LEAST, RATIO = 4, 3.0


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src_table, source (the model; 'diagrams'), rec_key, text, task, prompt_text. Null texts and keys are left out; repeated records stay and are made one once they are judged."""
    # the prompts are joined by hash or by broadcast as their measured size says
    task = table(spark, sf_dir, "prompts").select("prompt_hash", "task", "prompt_text").dropDuplicates(["prompt_hash"])
    api = table(spark, sf_dir, "api_cache").select("prompt_hash", F.lit("api_cache").alias("src_table"), F.coalesce("model", F.lit("")).alias("source"), F.col("content_hash").alias("rec_key"), F.col("response").alias("text"))
    api = api.join(task, "prompt_hash", "left").drop("prompt_hash")
    dia = table(spark, sf_dir, "diagram_analyses").select(
        F.lit("diagram_analyses").alias("src_table"), F.lit("diagrams").alias("source"), F.col("diagram_id").cast("string").alias("rec_key"), F.col("raw_response").alias("text"), F.lit("diagram").alias("task"), F.lit(None).cast("string").alias("prompt_text")
    )
    return api.unionByName(dia).where("text is not null and rec_key is not null")


def sizes(rows: DataFrame) -> DataFrame:
    """src_table, source, rec_key, chars, bytes, broken of each record once.

    A text that ends in a replacement character was cut inside a character (broken); its bytes are counted without it.
    """
    kept = F.regexp_replace("text", "�+$", "")
    return rows.select("src_table", "source", "rec_key", F.length("text").alias("chars"), F.octet_length(kept).alias("bytes"), F.col("text").endswith("�").alias("broken")).dropDuplicates(["src_table", "rec_key"])


def limits(lengths: DataFrame) -> DataFrame:
    """(src_table, source, chars_limit, bytes_limit): the spikes at the end of the histograms of ``sizes``, null where there is none.

    The histograms are aggregates with map-side combine: one row for each source and length, whatever the number of texts.
    """
    pairs = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("len")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("len"))))
    hist = lengths.select("src_table", "source", pairs.alias("l")).groupBy("src_table", "source", "l.unit", "l.len").agg(F.count("*").alias("n"))
    top = hist.groupBy("src_table", "source", "unit").agg(F.max("len").alias("top"))
    shape = (
        hist.join(top, ["src_table", "source", "unit"])
        .groupBy("src_table", "source", "unit", "top")
        .agg(F.sum(F.when(F.col("len") == F.col("top"), F.col("n"))).alias("at"), F.sum(F.when((F.col("len") < F.col("top")) & (F.col("len") >= 0.8 * F.col("top")), F.col("n"))).alias("below"))
    )
    spike = shape.where((F.col("at") >= LEAST) & (F.col("at") >= RATIO * F.coalesce("below", F.lit(0)) / F.greatest(F.lit(1.0), 0.2 * F.col("top"))))
    return spike.groupBy("src_table", "source").agg(F.max(F.when(F.col("unit") == "chars", F.col("top"))).alias("chars_limit"), F.max(F.when(F.col("unit") == "bytes", F.col("top"))).alias("bytes_limit"))


def spiked(rows: DataFrame) -> DataFrame:
    """``sizes`` with the limits of each source and at_limit: the record's length is one of them."""
    lengths = cut(sizes(rows))
    got = lengths.join(limits(lengths), ["src_table", "source"], "left")
    at = (F.col("bytes") == F.col("bytes_limit")) | (F.col("broken") & (F.col("bytes") >= F.col("bytes_limit") - 3))
    return got.withColumn("at_limit", F.coalesce(F.col("chars") == F.col("chars_limit"), F.lit(False)) | F.coalesce(at, F.lit(False)))


def _end_of(label):
    """The last word of a label without case; of a code its pattern."""
    word = F.regexp_extract(label, r"(\S+)\s*$", 1)
    return F.when(word.rlike("[0-9]"), F.regexp_replace(F.regexp_replace(word, "[A-Z]", "A"), "[0-9]", "0")).otherwise(F.lower(word))


def cut_lists(rows: DataFrame, spikes: DataFrame) -> DataFrame:
    """(src_table, rec_key) of the lists of labels that a limit cut.

    A list at a limit is cut if it ends after a blank or separator, or in a word that ends no label known to be whole:
    all labels but the last of a list at a limit are.
    """
    after = F.col("text").rlike(r"[;,-][\s\p{Cf}]*$|\s$")
    lists = rows.where("task = 'labels'").select("src_table", "rec_key", after.alias("after"), F.split(F.regexp_replace("text", r"[\s\p{Cf}]+$", ""), r"[;,|\r\n]").alias("labels"))
    lists = lists.join(spikes.where("at_limit").select("src_table", "rec_key", F.lit(True).alias("at_limit")), ["src_table", "rec_key"], "left")
    one = lists.select(F.coalesce("at_limit", F.lit(False)).alias("at_limit"), F.size("labels").alias("n"), F.posexplode("labels").alias("i", "label"))
    known = one.where(~(F.col("at_limit") & (F.col("i") == F.col("n") - 1))).select(_end_of(F.col("label")).alias("end")).where("end <> ''").distinct()
    last = lists.where("at_limit").select("src_table", "rec_key", "after", _end_of(F.element_at("labels", -1)).alias("end"))
    return last.where("after").select("src_table", "rec_key").unionAll(last.where("not after").join(known, "end", "left_anti").select("src_table", "rec_key")).distinct()


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src_table, source, rec_key, at_limit, limits and cut of every record.

    A record at a spike of its source's lengths is cut if it has no end of its own (terminal punctuation, a closed JSON
    value; for a list of labels see ``cut_lists``).  Elsewhere only a broken transfer can have cut it, which leaves a
    sentence or JSON value open.  Empty answers, refusals and prompts given back are not cut.
    """
    rows = texts(spark, sf_dir)
    diagram = table(spark, sf_dir, "prompts").where("task = 'diagram'").agg(F.max("prompt_text").alias("p")).first()["p"]

    @F.pandas_udf("int")
    def open_(text: pd.Series, task: pd.Series, prompt: pd.Series) -> pd.Series:
        """0 for a text with an end of its own, 1 for one without, 2 for a list of labels."""

        def one(t, k, q):
            if answers.is_empty(t) or answers.is_refusal(t) or answers.is_copy(t, diagram if k == "diagram" else q if isinstance(q, str) else None):
                return 0
            if t.endswith("�"):
                return 1
            return 2 if k == "labels" else int(answers.unfinished(t))

        return pd.Series([one(*x) for x in zip(text, task, prompt)], dtype="int32")

    # what has a plain end needs no closer look, and never leaves the JVM: a full stop without a bracket before it is no open value
    whole = F.col("text").rlike(r"^[^{\[]*[.!?][\"')]?$") & ~F.coalesce(F.col("task") == "labels", F.lit(False))
    verdict = rows.where(~whole).select("src_table", "source", "rec_key", open_("text", "task", "prompt_text").alias("open")).where("open > 0").dropDuplicates(["src_table", "rec_key"])
    spikes = spiked(rows)
    lists = cut_lists(rows, spikes).withColumn("list_cut", F.lit(True))
    got = spikes.join(verdict.drop("source"), ["src_table", "rec_key"], "left").join(lists, ["src_table", "rec_key"], "left")
    by_limit = F.col("at_limit") & ((F.col("open") == 1) | (F.col("open") == 2) & F.col("list_cut"))
    return got.withColumn("cut", F.coalesce(by_limit, F.lit(False)) | F.coalesce(F.col("open") == 1, F.lit(False))).drop("open", "list_cut", "chars", "bytes", "broken")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose response was cut."""
    return judged(spark, sf_dir).where("cut").select("src_table", "rec_key")


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per model, and for diagrams: records, cut ones, those at a limit, the rate, and the limits."""
    return (
        judged(spark, sf_dir).groupBy("src_table", "source")
        .agg(
            F.count("*").alias("records"), F.count(F.when(F.col("cut"), 1)).alias("cut"), F.count(F.when(F.col("cut") & F.col("at_limit"), 1)).alias("cut_at_limit"),
            F.round(F.avg(F.col("cut").cast("double")), 6).alias("rate"), F.max("chars_limit").alias("chars_limit"), F.max("bytes_limit").alias("bytes_limit"),
        )
    )


def p3_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limits of every source that has one."""
    return limits(sizes(texts(spark, sf_dir)))


QUERIES = {"p3_found": p3_found, "p3_rates": p3_rates, "p3_limits": p3_limits}
SQL = {
    "p3_limits": rf"""
with t as (
  select distinct 'api_cache' as src_table, coalesce(model, '') as source, content_hash as k, response as t from api_cache where response is not null and content_hash is not null
  union all select distinct 'diagram_analyses', 'diagrams', diagram_id::varchar, raw_response from diagram_analyses where raw_response is not null and diagram_id is not null
), l as (
  select src_table, source, 'chars' as unit, length(t) as len from t union all select src_table, source, 'bytes', octet_length(encode(regexp_replace(t, '\x{{FFFD}}+$', ''))) from t
), h as (select src_table, source, unit, len, count(*) as n from l group by all),
m as (select src_table, source, unit, max(len) as top from h group by all),
s as (
  select src_table, source, unit, top, sum(n) filter (where len = top) as reach, coalesce(sum(n) filter (where len < top and len >= 0.8 * top), 0) as below from h join m using (src_table, source, unit) group by all
), k as (select * from s where reach >= {LEAST} and reach >= {RATIO} * below / greatest(1.0, 0.2 * top))
select src_table, source, max(top) filter (where unit = 'chars') as chars_limit, max(top) filter (where unit = 'bytes') as bytes_limit from k group by 1, 2
""",
}
