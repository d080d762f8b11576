"""The correction chain of recognised text, and the analysis of figures: built-in steps as columns, the rest behind hooks."""

from __future__ import annotations

import base64
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill import config
from leafmill.functions import hooks
from leafmill.functions import text as T
from leafmill.operators import spelling
from leafmill.operators.text import parse_answer
from leafmill.session import table

C = F.col
#: Characters of a text that a model is asked about; its answer replaces the whole text.
ASKED = 3000
#: Functions that take a text: 'unicode', 'grammar', 'model'. Where one is missing its library is tried, 'model' has none.
TEXT_HOOKS: dict[str, Callable[[str], str]] = {}
#: Function from (base64 of a picture, media type) to a model's answer about it.
VISION: list[Callable[[str, str], str]] = []


def through(df: DataFrame, column: str, change: Callable[[], Callable[[str], str] | None], attempts: int = 1, most: int | None = None) -> DataFrame:
    """``df`` with a text column passed through a hook, made once a worker; texts it fails on stay, null stays null.

    most: how many characters the hook is given.
    """
    names = df.columns

    def run(batches):
        f = change()
        for b in batches:
            if f is not None:
                call = lambda t: hooks.retried(lambda: f(t if most is None else t[:most]), attempts)
                b = b.assign(**{column: [hooks.or_same(call, t) if isinstance(t, str) else None for t in b[column]]})
            yield b[names]

    return df.mapInPandas(run, df.schema)


def corrected(results: DataFrame, dictionary: DataFrame | None, cfg: config.OCR | None = None, key: str = "ocr_id") -> DataFrame:
    """key, raw_ocr, corrected, changes_made, final_confidence of (key, text, confidence).

    Steps in order: encoding repair, layout (always tagged), spelling, grammar, model; each tagged where it changes the text.
    A blank or null text gives '', '', no tags and confidence 0.
    """
    cfg = cfg or config.OCR()
    rows = results.select(key, C("text").alias("raw_ocr"), "confidence").where(T.strip("text") != "").withColumn("t", C("raw_ocr"))
    rows = rows.withColumn("tags", F.array().cast("array<string>"))
    unicode_, grammar, model = (TEXT_HOOKS.get(k) for k in ("unicode", "grammar", "model"))

    def tagged(after: DataFrame, tag: str) -> DataFrame:
        changed = F.when(C("t") != C("b"), F.array_append("tags", F.lit(tag))).otherwise(C("tags"))
        return after.withColumn("tags", changed).drop("b")

    if cfg.enable_unicode_fix:
        rows = tagged(through(rows.withColumn("b", C("t")), "t", lambda: unicode_ or hooks.unicode_fix()), "unicode_fix")
    rows = rows.withColumn("t", T.layout_clean("t")).withColumn("tags", F.array_append("tags", F.lit("layout_clean")))
    if cfg.enable_spell_correction and dictionary is not None:
        fixed = spelling.correct(rows.select(key, "t"), dictionary, key, "t").withColumnRenamed("corrected", "_n")
        rows = tagged(rows.withColumnRenamed("t", "b").join(fixed, key).withColumnRenamed("_n", "t"), "spell_correct")
    if cfg.enable_grammar_fix:
        rows = tagged(through(rows.withColumn("b", C("t")), "t", lambda: grammar or hooks.grammar_fix()), "grammar_fix")
    if cfg.enable_ai_correction and model is not None:
        rows = tagged(through(rows.withColumn("b", C("t")), "t", lambda: model, 3, ASKED), "ai_correction")
    full = rows.select(key, "raw_ocr", C("t").alias("corrected"), C("tags").alias("changes_made"), C("confidence").alias("final_confidence"))
    blank = results.where(F.coalesce(T.strip("text"), F.lit("")) == "").select(key, F.lit("").alias("raw_ocr"), F.lit("").alias("corrected"), F.array().cast("array<string>").alias("changes_made"), F.lit(0.0).alias("final_confidence"))
    return full.unionByName(blank)


def media_type(data: bytes) -> str:
    """image/jpeg by its first bytes, else image/png."""
    return "image/jpeg" if data[:2] == b"\xff\xd8" else "image/png"


def analysed(figures: DataFrame, key: str, image: str, cfg: config.Diagram | None = None) -> DataFrame:
    """key, analysis (see text.parse_answer; null where none is asked for), svg, use_vector of every picture.

    Pictures with a side below min_diagram_size_px, or that cannot be decoded, get neither.  A model is asked up to three
    times; where it fails the analysis is null.
    """
    from leafmill.functions import imaging

    cfg = cfg or config.Diagram()
    ask = VISION[0] if VISION and cfg.enable_ai_analysis else None
    kind = figures.schema[key].dataType.simpleString()
    kept = imaging.registered()

    def run(batches):
        imaging.register(kept)
        for b in batches:
            out = []
            for k, data in zip(b[key], b[image]):
                raw = svg = None
                img = imaging.decode(bytes(data)) if data is not None else None
                if img is not None and min(img.shape[:2]) >= cfg.min_diagram_size_px:
                    if ask is not None:
                        try:
                            raw = hooks.retried(lambda d=bytes(data): ask(base64.b64encode(d).decode(), media_type(d)), 3, 2, 30)
                        except Exception:
                            raw = None
                    if cfg.enable_vectorization:
                        svg = imaging.vectorise(img, local=True)
                out.append((k, raw, svg))
            yield pd.DataFrame(out, columns=[key, "raw", "svg"])

    got = figures.select(key, image).mapInPandas(run, f"`{key}` {kind}, raw string, svg binary")
    return got.select(key, F.when(C("raw").isNotNull(), parse_answer("raw")).alias("analysis"), "svg", (C("svg").isNotNull() & F.lit(cfg.embed_as_vector)).alias("use_vector"))


# --- queries -------------------------------------------------------------------------------------------------------


def correction_chain(spark: SparkSession, d: str) -> DataFrame:
    """Every recognised text through the chain, by tags and hash."""
    o = table(spark, d, "ocr_results").select("ocr_id", "text", "confidence").dropDuplicates(["ocr_id"])
    got = corrected(o, spelling.dictionary(spark, d))
    return got.select("ocr_id", F.array_join("changes_made", ",").alias("changes"), F.md5("corrected").alias("corrected"), F.round("final_confidence", 6).alias("confidence"))


QUERIES = {"correction_chain": correction_chain}
SQL: dict[str, str] = {}
