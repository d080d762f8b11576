"""Quality reports: counters of pages, totals of documents, nested JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.session import table

C = F.col
COUNTERS = ("images", "diagrams", "tables", "ocr_blocks")


def rollup(pages: DataFrame, doc: str) -> DataFrame:
    """Totals by document: pages_processed and each counter."""
    return pages.groupBy(doc).agg(F.count("*").alias("pages_processed"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS])


def report_json(pages: DataFrame, doc: str, seconds: str) -> DataFrame:
    """(doc, report): the report of each document as JSON, its pages in order, counted from 1.

    A document's pages are gathered, as the report is one text; the hot document of the stand-in has some hundred.
    """
    item = F.struct((C("page_num") + 1).alias("page"), *COUNTERS)
    got = pages.groupBy(doc).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in COUNTERS], F.bround(F.sum(seconds), 2).alias("s"), F.array_sort(F.collect_list(item)).alias("per_page"))
    body = F.struct(
        C("n").alias("pages_processed"), C("images").alias("total_images_enhanced"), C("diagrams").alias("total_diagrams_vectorized"), C("tables").alias("total_tables_embedded"),
        C("ocr_blocks").alias("total_ocr_blocks"), C("s").alias("processing_time_seconds"), "per_page",
    )
    return got.select(doc, F.to_json(body).alias("report"))


def page_quality(spark: SparkSession, d: str) -> DataFrame:
    """Counters of every page of the recognised documents."""
    o = table(spark, d, "ocr_results").select("doc_id", "page_num", "ocr_id", "engine_priority", "confidence").distinct()
    return o.groupBy("doc_id", "page_num").agg(
        F.count("*").alias("ocr_blocks"), F.sum((C("ocr_id") % 3).cast("long")).alias("images"), F.sum((C("ocr_id") % 2).cast("long")).alias("diagrams"),
        F.sum((C("engine_priority") % 2).cast("long")).alias("tables"), F.sum((C("ocr_id") % 400) * 0.25).alias("seconds"),
    )


_PQ = "pq as (select doc_id, page_num, count(*) as ocr_blocks, sum(ocr_id % 3)::bigint as images, sum(ocr_id % 2)::bigint as diagrams, sum(engine_priority % 2)::bigint as tables, sum((ocr_id % 400) * 0.25::double) as seconds from (select distinct doc_id, page_num, ocr_id, engine_priority, confidence from ocr_results) group by 1, 2)"


def report_rollup(spark, d):
    """Totals of every document."""
    return rollup(page_quality(spark, d), "doc_id")


def report_per_page_json(spark, d):
    """Report of every document as JSON."""
    return report_json(page_quality(spark, d), "doc_id", "seconds")


QUERIES = {f.__name__: f for f in (report_rollup, report_per_page_json)}
SQL = {
    "report_rollup": f"with {_PQ} select doc_id, count(*) as pages_processed, {', '.join(f'sum({c})::bigint as {c}' for c in COUNTERS)} from pq group by 1",
    "report_per_page_json": f"""with {_PQ}, g as (select doc_id, count(*) as n, sum(images)::bigint as i, sum(diagrams)::bigint as g, sum(tables)::bigint as t, sum(ocr_blocks)::bigint as o, round_even(sum(seconds), 2) as s,
      list({{'page': page_num + 1, 'images': images, 'diagrams': diagrams, 'tables': tables, 'ocr_blocks': ocr_blocks}} order by page_num) as p from pq group by 1)
      select doc_id, to_json({{'pages_processed': n, 'total_images_enhanced': i, 'total_diagrams_vectorized': g, 'total_tables_embedded': t, 'total_ocr_blocks': o, 'processing_time_seconds': s, 'per_page': p}})::varchar as report from g""",
}
