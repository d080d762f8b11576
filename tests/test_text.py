import pytest
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import geometry, pages, pixels, quality, text


def value(spark, column, *values, schema="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {schema}")
    return [r[0] for r in df.select(column(F.col("v"))).collect()]


@pytest.mark.parametrize("given, want", [
    ("a  b   c", "a b c"), ("a\n\n\n\nb\n\nc", "a\n\nb\n\nc"), ("a-\nb-\nc-\nd", "abcd"), ("A-\nb", "A-\nb"), ("é-\nb", "é-\nb"), (" x　", "x"), ("a\u0007b\u007fc", "abc"), ("x 😀 y", "x  y"), ("a​b", "a​b"), ("", ""), (None, None),
])
def test_layout_clean(spark, given, want):
    assert value(spark, T.layout_clean, given) == [want]


@pytest.mark.parametrize("given, want", [("```json\n{}\n```", "{}"), ("```json {}```", "{}"), ("{}", "{}"), ("```\nx\n```", "x"), ("  ```json\n{}", "```json\n{}"), (None, None)])
def test_fence_strip(spark, given, want):
    assert value(spark, T.fence_strip, given) == [want]


def test_words_and_classes(spark):
    assert value(spark, T.words, " a b\n c ", "", None, "　") == [["a", "b", "c"], [], None, []]
    got = value(spark, T.token_class, "12.5", "-", "ABC", "A", "Abc", "abc", "aBC", "1a", "É")
    assert got == ["number", "number", "acronym", "capital", "capital", "plain", "plain", "plain", "capital"]


@pytest.mark.parametrize("raw, want", [
    ('{"diagram_type": "graph", "confidence": 0.9, "labels": ["a"]}', ("graph", "", ["a"], 0.9, True)), ("```json\n{}\n```", ("unknown", "", [], 0.5, True)),
    ("no json", ("unknown", "no json", [], 0.3, False)), ("[1]", ("unknown", "[1]", [], 0.3, False)), ('{"title": null}', ("unknown", "", [], 0.5, True)), ("x" * 600, ("unknown", "x" * 500, [], 0.3, False)),
])
def test_answers_about_figures(spark, raw, want):
    (a,) = value(spark, text.parse_answer, raw)
    assert (a.diagram_type, a.description, a.labels, a.confidence, a.valid) == want


def test_text_layers(spark):
    df = spark.createDataFrame([(1, (1.0, 2.0, 3.0, 4.0), 10.0, "x"), (2, (1.0, 2.0, 3.0, 4.0), 0.1, "y"), (3, (0.0, 0.0, 0.0, 0.0), 5.0, " "), (4, None, None, None)], "k int, bbox struct<x0:double,y0:double,x1:double,y1:double>, font_size double, text string")
    assert [(r.k, r.x, r.y, r.size) for r in text.text_layer(df, 2.0).orderBy("k").collect()] == [(1, 2.0, 8.0, 18.0), (2, 2.0, 8.0, 1.0)]
    got = text.recognised_layer(df.select("k", "text")).orderBy("k").collect()
    assert [(r.k, r.x, r.y, r.size, r.text) for r in got] == [(1, 0.0, 8.0, 8.0, "x"), (2, 0.0, 8.0, 8.0, "y")]


@pytest.mark.parametrize("std, edge, want", [(79, 0.06, (True, False)), (80, 0.06, (False, True)), (61, 0.05, (False, True)), (61, 0.08, (True, False)), (10, 0.01, (False, False))])
def test_figure_rule(spark, std, edge, want):
    a, b = pixels.figure_rule(F.lit(std), F.lit(edge))
    assert tuple(spark.range(1).select(a, b).first()) == want


@pytest.mark.parametrize("w, h, flag, want", [(23, 23, True, True), (23, 24, True, False), (1, 1, False, False)])
def test_tiny_images(spark, w, h, flag, want):
    assert spark.range(1).select(pixels.is_tiny(F.lit(w), F.lit(h), flag)).first()[0] is want


@pytest.mark.parametrize("data, want", [(b"\x89PNG\r\n\x1a\nxxxx", "png"), (b"\xff\xd8\xff", "jpg"), (b"RIFF1234WEBPVP8 ", "webp"), (b"RIFF1234WAVE", "png"), (b"", "png")])
def test_magic_bytes(spark, data, want):
    assert value(spark, pixels.sniff, data, schema="binary") == [want]


@pytest.mark.parametrize("render, has, frac, full, want", [(True, False, 0.0, True, True), (False, False, 1.0, False, False), (False, True, 0.95, False, True), (False, True, 0.95, True, False), (False, True, 0.7, False, True), (False, True, 0.6, False, False)])
def test_block_skip_rule(spark, render, has, frac, full, want):
    assert spark.range(1).select(pages.skip_block(F.lit(render), F.lit(has), F.lit(frac), full)).first()[0] is want


def test_reports(spark):
    rows = [(1, 1, 2, 0, 1, 3, 0.5), (1, 0, 1, 1, 0, 0, 0.25), (2, 0, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "d int, page_num int, images long, diagrams long, tables long, ocr_blocks long, seconds double")
    got = {r.d: tuple(r)[1:] for r in quality.rollup(df, "d").collect()}
    assert got == {1: (2, 3, 1, 1, 3), 2: (1, 0, 0, 0, 0)}
    import json

    rep = json.loads(quality.report_json(df.where("d = 1"), "d", "seconds").first().report)
    assert rep["pages_processed"] == 2 and rep["processing_time_seconds"] == 0.75 and [p["page"] for p in rep["per_page"]] == [1, 2]


def test_tables_of_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, page_num int, text string")
    assert text.recognised_layer(empty).count() == 0 and quality.rollup(spark.createDataFrame([], "d int, images long, diagrams long, tables long, ocr_blocks long"), "d").count() == 0
    assert geometry.segment_groups(spark.createDataFrame([], "k int, n int, x1 double, y1 double, x2 double, y2 double"), "k", ["n"]).count() == 0
