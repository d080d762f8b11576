"""Files written and read again inside tasks: what the writers put down is what the readers give."""

from __future__ import annotations

import hashlib
import io

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.session import table
from leafmill.sources import pdf, xlsx

C = F.col


def text_of(data: bytes) -> list[str]:
    """The texts of a file's spans, in the order of its pages."""
    return [s["text"] for r in pdf.pages_of(data, "") if r["error"] is None for s in r["spans"]]


def pdf_text_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text as the hidden layer of a file of its own, read again: spans and their hash."""

    def run(batches):
        for b in batches:
            out = []
            for key, text in zip(b["doc_id"], b["text"]):
                f = io.BytesIO()
                w = pdf.Writer(f)
                w.add_page(595, 842, texts=[{"x": 10, "y": 20, "size": 8, "text": text or ""}])
                w.close()
                lines = text_of(f.getvalue())
                out.append((key, len(lines), hashlib.md5("\n".join(lines).encode()).hexdigest()))
            yield pd.DataFrame(out, columns=["doc_id", "spans", "text"])

    return table(spark, d, "documents").select("doc_id", "text").mapInPandas(run, "doc_id long, spans long, text string")


def xlsx_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The customers of every nation as a workbook, read again: rows, sum of balances, hash of the names in order."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_name", "c_acctbal").repartition(parts, "c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey")

    def one(nation, held):
        got = list(xlsx.rows(xlsx.encode(["key", "name", "balance"], [list(r) for r in held], "Customers"), "Customers"))[1:]
        return nation, len(got), round(sum(float(v[2]) for _, v in got), 2), hashlib.md5("|".join(v[1] for _, v in got).encode()).hexdigest()

    def run(batches):
        now, held = None, []
        for b in batches:
            out = []
            for nation, *row in b.itertuples(index=False):
                if nation != now and held:
                    out.append(one(now, held))
                    held = []
                now = nation
                held.append(row)
            yield pd.DataFrame(out, columns=["nation", "rows", "balance", "names"])
        yield pd.DataFrame([one(now, held)] if held else [], columns=["nation", "rows", "balance", "names"])

    return rows.mapInPandas(run, "nation int, rows long, balance double, names string")


QUERIES = {"pdf_text_roundtrip": pdf_text_roundtrip, "xlsx_roundtrip": xlsx_roundtrip}
SQL = {
    "pdf_text_roundtrip": """with l as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as pos from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents))
      select doc_id, count(*) filter (where line <> '') as spans, md5(coalesce(string_agg(line, chr(10) order by pos) filter (where line <> ''), '')) as text from l group by 1""",
    "xlsx_roundtrip": "select c_nationkey as nation, count(*) as rows, round(sum(c_acctbal), 2) as balance, md5(string_agg(c_name, '|' order by c_custkey)) as names from customer group by 1",
}
