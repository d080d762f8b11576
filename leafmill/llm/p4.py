"""Problem 4: broken prompt and response pairs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import answers, langid, p3
from leafmill.session import table

#: Mean log probability by which another language must beat the one asked for, and the fewest trigrams to tell.
MARGIN, TRIGRAMS = 0.25, 14
_FIELD = re.compile(r"""["'](?:title|description)["']\s*:\s*(?:"((?:[^"\\]|\\.)*)"?|'((?:[^'\\]|\\.)*)'?)""")
_VALUE = re.compile(r'"((?:[^"\\]|\\.)*)"(?!\s*:)')


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src_table, rec_key, answer, prompt_text, lang (asked for by the prompt's row), task, page; repeated records stay.

    A null answer counts as empty.  A record without key is left out; one whose prompt is unknown has null there.
    """
    prompts = table(spark, sf_dir, "prompts").dropDuplicates(["prompt_hash"]).select("prompt_hash", "prompt_text", "lang", "task")
    none = F.lit(None).cast("string")
    api = (
        table(spark, sf_dir, "api_cache").select(F.lit("api_cache").alias("src_table"), F.col("content_hash").alias("rec_key"), F.col("response").alias("answer"), "prompt_hash")
        .join(prompts, "prompt_hash", "left").drop("prompt_hash").withColumn("page", none)
    )
    dia = table(spark, sf_dir, "diagram_analyses").select(
        F.lit("diagram_analyses").alias("src_table"), F.col("diagram_id").cast("string").alias("rec_key"), F.col("raw_response").alias("answer"),
        none.alias("prompt_text"), none.alias("lang"), F.lit("diagram").alias("task"), none.alias("page"),
    )
    cor = table(spark, sf_dir, "corrected_texts").select(
        F.lit("corrected_texts").alias("src_table"), F.col("ct_id").cast("string").alias("rec_key"), F.col("corrected").alias("answer"),
        none.alias("prompt_text"), none.alias("lang"), F.lit("correct").alias("task"), F.col("raw_ocr").alias("page"),
    )
    return api.unionByName(dia).unionByName(cor).where("rec_key is not null")


def _off_language(lm, text: str, want: str | None) -> bool:
    if want not in langid.LANGS:
        return False
    s, n = langid.score(lm, text)
    return n >= TRIGRAMS and float(s.max() - s[langid.LANGS.index(want)]) > MARGIN


def defect(answer: str | None, prompts: list[str], lang: str | None, task: str | None, page: str | None, lm) -> str | None:
    """The one defect of an answer, or None: empty, copy, refusal, truncated or language, in this order. Lists of labels cut at a limit are found in ``judged``."""
    if task == "correct" and answers.is_empty(page) and answers.is_empty(answer):
        return None
    if answers.is_empty(answer):
        return "empty"
    if task == "correct" and (answer == page or answer.strip() == (page or "").strip()):
        return None
    if any(answers.is_copy(answer, p, page) for p in prompts):
        return "copy"
    own = answers.words(answer)
    kept = answers.containment(own, answers.words(page), 2) if task == "correct" and page else 0.0
    if kept < 0.3 and answers.is_refusal(answer):
        return "refusal"
    if task == "correct":
        if kept < 0.3:
            # hardly any of the page's wording: a translation, if the languages differ
            want = langid.guess(lm, page or "", TRIGRAMS)
            if want and _off_language(lm, answer, want):
                return "language"
        return "truncated" if answers.unfinished_page(answer, page) else None
    if answer.endswith("�") or answers.unfinished(answer, listed=task == "labels"):
        return "truncated"
    if task == "diagram":
        got = [a or b for a, b in _FIELD.findall(answer)]
        text = " ".join(got) if got else ("" if "{" in answer else answer)
        return "language" if _off_language(lm, text, "en") else None
    text = " ".join(_VALUE.findall(answer)) if task == "json" and '"' in answer else answer
    want = answers.asked_language(prompts[0] if prompts else None, lang)
    return "language" if _off_language(lm, text, want) else None


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src_table, rec_key, task and defect of each record once.

    The language model is fitted on about langid.SAMPLE documents a language; the answers themselves are judged whole.
    """
    fixed = table(spark, sf_dir, "prompts").where("task in ('diagram', 'correct')").select("task", "prompt_text").distinct().collect()
    by_task = {k: sorted(r.prompt_text for r in fixed if r.task == k and r.prompt_text) for k in ("diagram", "correct")}
    lm = spark.sparkContext.broadcast(langid.fit(table(spark, sf_dir, "documents")))

    @F.pandas_udf("string")
    def defect_(answer: pd.Series, prompt: pd.Series, lang: pd.Series, task: pd.Series, page: pd.Series) -> pd.Series:
        ok = lambda x: x if isinstance(x, str) else None
        return pd.Series([defect(ok(a), by_task.get(k) or ([p] if ok(p) else []), ok(n), ok(k), ok(g), lm.value) for a, p, n, k, g in zip(answer, prompt, lang, task, page)], dtype=object)

    verdict = pairs(spark, sf_dir).select("src_table", "rec_key", "task", defect_("answer", "prompt_text", "lang", "task", "page").alias("defect")).dropDuplicates(["src_table", "rec_key"])
    # a list of labels that a limit cut is truncated, unless it is empty, a copy or a refusal
    rows = p3.texts(spark, sf_dir)
    lists = p3.cut_lists(rows, p3.spiked(rows)).withColumn("list_cut", F.lit(True))
    truncated = F.col("list_cut") & (F.col("task") == "labels") & F.coalesce(~F.col("defect").isin("empty", "copy", "refusal"), F.lit(True))
    return verdict.join(lists, ["src_table", "rec_key"], "left").withColumn("defect", F.when(truncated, "truncated").otherwise(F.col("defect"))).drop("list_cut")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a defective answer, and the defect."""
    return judged(spark, sf_dir).where("defect is not null").select("src_table", "rec_key", "defect")


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and defects by table and task."""
    return judged(spark, sf_dir).groupBy("src_table", "task", "defect").agg(F.count("*").alias("records"))


QUERIES = {"p4_found": p4_found, "p4_rates": p4_rates}
SQL: dict[str, str] = {}
