"""Recognition results: confidence, boxes and ensembles."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.functions.engines import find
from leafmill.session import table

PAGE = ("doc_id", "page_num")
#: Engines by name that were registered: a function from image bytes to (text, confidence). Others are looked for in functions.engines.
ENGINES: dict[str, Callable[[bytes], tuple[str, float]]] = {}


def register_engine(name: str, run: Callable[[bytes], tuple[str, float]]) -> None:
    """Makes an engine known to ``recognise``."""
    ENGINES[name] = run


def recognise(pages: DataFrame, image: str, engines: list[str]) -> DataFrame:
    """``pages`` with engine_priority, engine, text, confidence: a row per page and engine that gives text.

    Unknown and missing engines give nothing; an engine that fails on a page gives nothing for that page.
    """
    chosen = [(i, n, ENGINES.get(n) or find(n)) for i, n in enumerate(engines)]
    kept = [f for f in pages.schema.fields if f.name != image]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", engine_priority int, engine string, text string, confidence double"

    def run(batches):
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                row = dict(zip(b.columns, r))
                data = row.pop(image)
                for i, n, f in chosen:
                    if f is None or data is None:
                        continue
                    try:
                        text, conf = f(bytes(data))
                    except Exception:
                        continue
                    if text and text.strip():
                        rows.append(row | {"engine_priority": i, "engine": n, "text": text, "confidence": float(conf)})
            yield pd.DataFrame(rows, columns=[f.name for f in kept] + ["engine_priority", "engine", "text", "confidence"])

    return pages.mapInPandas(run, schema)


def confident(boxes: Column | str, least: float = 0.6) -> Column:
    """Word boxes with at least ``least`` confidence and some text."""
    return F.filter(boxes, lambda x: (x["conf"] >= least) & (T.strip(x["text"]) != ""))


def percent_words(boxes: Column | str, least: float = 0.6) -> Column:
    """Word boxes of an engine that gives confidence in percent, -1 for what is no word: such and blank ones dropped, shares instead."""
    words = F.filter(boxes, lambda x: (x["conf"] >= 0) & (T.strip(x["text"]) != ""))
    shares = F.transform(words, lambda x: F.struct(x["text"].alias("text"), (x["conf"] / 100).alias("conf"), x["x"].alias("x"), x["y"].alias("y"), x["w"].alias("w"), x["h"].alias("h")))
    return F.filter(shares, lambda x: x["conf"] >= least)


def quad_to_box(xs: Column, ys: Column) -> Column:
    """x, y, w, h of a polygon given by its coordinates."""
    return F.struct(F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs)).alias("w"), (F.array_max(ys) - F.array_min(ys)).alias("h"))


def results(df: DataFrame) -> DataFrame:
    """The distinct results that have text."""
    return df.select(*PAGE, "engine_priority", "engine", "text", "confidence").where(T.strip("text") != "").distinct()


def first_boxes(df: DataFrame) -> DataFrame:
    """(page, word_boxes) of the first result of each page that has text."""
    return df.where(T.strip("text") != "").groupBy(*PAGE).agg(F.min_by("word_boxes", F.struct("engine_priority", "engine", "text")).alias("word_boxes"))


def best(df: DataFrame, by: Column) -> DataFrame:
    """The result with the largest ``by`` of each page, the first in engine order on ties."""
    first = F.min_by(F.struct("engine", "text", "confidence"), F.struct((-by).alias("k"), "engine_priority", "engine", "text"))
    return results(df).groupBy(*PAGE).agg(first.alias("b")).select(*PAGE, "b.*")


def voting(df: DataFrame) -> DataFrame:
    """Per page the most frequent word of each position, the first in engine order on ties; confidence is the mean.

    word_boxes, where the results have them, are those of the first result.  Words are counted before anything is gathered; what is gathered per page is one word per position.  A page with one result keeps its text.
    """
    r = results(df)
    pages = r.groupBy(*PAGE).agg(F.avg("confidence").alias("confidence"), F.count("*").alias("n"), F.min_by(F.struct("engine", "text"), F.struct("engine_priority", "engine", "text")).alias("only"))
    words = r.select(*PAGE, "engine_priority", F.posexplode(T.words("text")).alias("pos", "w"))
    counts = words.groupBy(*PAGE, "pos", "w").agg(F.count("*").alias("c"), F.min("engine_priority").alias("p"))
    win = counts.groupBy(*PAGE, "pos").agg(F.min_by("w", F.struct((-F.col("c")).alias("c"), "p", "w")).alias("w"))
    text = win.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"]), " ").alias("text"))
    single = F.col("n") == 1
    got = pages.join(text, list(PAGE)).select(*PAGE, F.when(single, F.col("only.engine")).otherwise("ensemble").alias("engine"), F.when(single, F.col("only.text")).otherwise(F.col("text")).alias("text"), "confidence")
    return got.join(first_boxes(df), list(PAGE)) if "word_boxes" in df.columns else got


# --- queries -------------------------------------------------------------------------------------------------------


def token_confidence_filter(spark, d):
    """Kept words of every result."""
    o = table(spark, d, "ocr_results").select("ocr_id", confident("word_boxes").alias("k"))
    return o.select("ocr_id", F.size("k").cast("long").alias("n"), F.array_join(F.transform("k", lambda x: x["text"]), " ").alias("words"))


def mean_confidence_default(spark, d):
    """Mean confidence of the kept words of every result, 0.5 where there are none."""
    o = table(spark, d, "ocr_results").select("ocr_id", F.explode_outer(confident("word_boxes")).alias("k"))
    return o.groupBy("ocr_id").agg(F.round(F.coalesce(F.avg("k.conf"), F.lit(0.5)), 6).alias("confidence"))


def ensemble_confidence(spark, d):
    """The most confident result of every page."""
    return best(table(spark, d, "ocr_results"), F.col("confidence")).select(*PAGE, "engine", "text")


def ensemble_longest(spark, d):
    """The longest result of every page."""
    return best(table(spark, d, "ocr_results"), F.length("text")).select(*PAGE, "engine", "text")


def ensemble_voting(spark, d):
    """The voted text of every page."""
    got = voting(table(spark, d, "ocr_results"))
    return got.withColumn("confidence", F.round("confidence", 6)).withColumn("boxes", F.coalesce(F.size("word_boxes"), F.lit(0)).cast("long")).drop("word_boxes")


def percent_filter(spark, d):
    """Kept words of every result as an engine with percentages has them; every seventh word is none."""
    o = table(spark, d, "ocr_results").select("ocr_id", "word_boxes")
    raw = F.transform("word_boxes", lambda x, i: F.struct(x["text"].alias("text"), F.when(i % 7 == 6, -1.0).otherwise(x["conf"] * 100).alias("conf"), x["x"].alias("x"), x["y"].alias("y"), x["w"].alias("w"), x["h"].alias("h")))
    k = percent_words(raw)
    return o.select("ocr_id", F.size(k).cast("long").alias("n"), F.array_join(F.transform(k, lambda x: x["text"]), " ").alias("words"))


def quad_to_box_q(spark, d):
    """Word boxes as boxes of their corners."""
    o = table(spark, d, "ocr_results").select("ocr_id", F.posexplode("word_boxes").alias("pos", "k"))
    k = F.col("k")
    xs = F.array(k["x"], k["x"] + k["w"], k["x"] + k["w"] / 2, k["x"])
    ys = F.array(k["y"] + k["h"], k["y"], k["y"] + k["h"] / 2, k["y"])
    b = quad_to_box(xs, ys)
    return o.select("ocr_id", F.col("pos").cast("long").alias("pos"), *[F.round(b[n], 4).alias(n) for n in ("x", "y", "w", "h")])


QUERIES = {f.__name__.removesuffix("_q"): f for f in (token_confidence_filter, percent_filter, mean_confidence_default, ensemble_confidence, ensemble_longest, ensemble_voting, quad_to_box_q)}
_S = T.sql_strip
_KEPT = f"list_filter(word_boxes, lambda x: coalesce(x.conf >= 0.6 and {_S('x.text')} <> '', false))"
_R = f"r as (select distinct doc_id, page_num, engine_priority, engine, text, confidence from ocr_results where {_S('text')} <> '')"
_BEST = "with " + _R + " select doc_id, page_num, engine, text from (select *, row_number() over (partition by doc_id, page_num order by @ desc, engine_priority, engine, text) as rn from r) where rn = 1"
SQL = {
    "token_confidence_filter": f"select ocr_id, len({_KEPT}) as n, array_to_string(list_transform({_KEPT}, lambda x: x.text), ' ') as words from ocr_results",
    "percent_filter": f"""with k as (select ocr_id, list_filter(word_boxes, lambda x, i: coalesce((i - 1) % 7 <> 6 and x.conf * 100 / 100 >= 0.6 and {_S('x.text')} <> '', false)) as k from ocr_results)
      select ocr_id, len(k) as n, array_to_string(list_transform(k, lambda x: x.text), ' ') as words from k""",
    "mean_confidence_default": f"with k as (select ocr_id, unnest({_KEPT}).conf as c from ocr_results) select o.ocr_id, round(coalesce(avg(c), 0.5), 6) as confidence from (select distinct ocr_id from ocr_results) o left join k on o.ocr_id = k.ocr_id group by 1",
    "ensemble_confidence": _BEST.replace("@", "confidence"),
    "ensemble_longest": _BEST.replace("@", "length(text)"),
    "ensemble_voting": f"""with {_R}, w as (select doc_id, page_num, engine_priority, unnest(ws) as w, generate_subscripts(ws, 1) as pos from (select *, regexp_split_to_array({_S("text")}, '{T.SQL_SPACE_JAVA}+') as ws from r)),
      c as (select doc_id, page_num, pos, w, count(*) as c, min(engine_priority) as p from w group by all),
      v as (select *, row_number() over (partition by doc_id, page_num, pos order by c desc, p, w) as rn from c),
      t as (select doc_id, page_num, string_agg(w, ' ' order by pos) as text from v where rn = 1 group by 1, 2),
      g as (select doc_id, page_num, avg(confidence) as confidence, count(*) as n, min_by(engine, engine_priority) as engine, min_by(text, engine_priority) as lone from r group by 1, 2),
      f as (select doc_id, page_num, word_boxes as boxes from (select *, row_number() over (partition by doc_id, page_num order by engine_priority, engine, text) as rn from ocr_results where {_S('text')} <> '') where rn = 1)
      select g.doc_id, g.page_num, case when n = 1 then engine else 'ensemble' end as engine, case when n = 1 then lone else text end as text, round(confidence, 6) as confidence, coalesce(len(f.boxes), 0) as boxes from g join t on g.doc_id = t.doc_id and g.page_num = t.page_num join f on g.doc_id = f.doc_id and g.page_num = f.page_num""",
    "quad_to_box": "with k as (select ocr_id, unnest(word_boxes) as k, generate_subscripts(word_boxes, 1) - 1 as pos from ocr_results) select ocr_id, pos, round(k.x, 4) as x, round(k.y, 4) as y, round(k.x + k.w - k.x, 4) as w, round(k.y + k.h - k.y, 4) as h from k",
}
