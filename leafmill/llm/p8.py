"""Problem 8: encoding of the whole corpus with a public tokenizer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.bpe import encode_column, encoder, vocabulary
from leafmill.session import table


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and the ids of every document; null and empty texts have the empty list."""
    return encode_column(table(spark, sf_dir, "documents"), "doc_id", "text", vocabulary())


def p8_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose decoded ids differ from their text (none), and totals."""
    path = vocabulary()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def run(batches):
        import pandas as pd

        enc = encoder(path)
        for b in batches:
            rows = [(t or "", enc.encode(t)) for t in b["text"]]
            yield pd.DataFrame({"docs": [len(rows)], "tokens": [sum(len(i) for _, i in rows)], "bad": [sum(enc.decode(i) != t for t, i in rows)]})

    got = docs.mapInPandas(run, "docs long, tokens long, bad long")
    return got.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))


QUERIES = {"p8_ids": p8_ids, "p8_round_trip": p8_round_trip}
SQL: dict[str, str] = {}
