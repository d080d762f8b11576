import pytest
from pyspark.sql import functions as F

from leafmill.operators import geometry, ocr, pages, tables

SPECS = ["1-5,8,10-15", "", None, "0", "-5", "5-3", "3,3,2", "a,2", " 2 - 4 ,9", "99", "1-2-3", "0-2", ",,", "+3", "12", "13"]


def test_page_range_one_value_and_column(spark):
    df = spark.createDataFrame([(i, s, 12) for i, s in enumerate(SPECS)], "i int, s string, n int")
    got = {r.i: r.p for r in df.select("i", pages.page_range("s", "n").alias("p")).collect()}
    assert got == {i: pages.wanted_pages(s, 12) for i, s in enumerate(SPECS)}
    assert got[0] == [0, 1, 2, 3, 4, 7, 9, 10, 11] and got[3] == [] and got[8] == [1, 2, 3, 8] and got[11] == [0, 1]


@pytest.mark.parametrize("density, images, tabs, want", [(0.16, 0.09, False, "text"), (0.15, 0.09, False, "mixed"), (0.04, 0.51, False, "image"), (0.05, 0.51, False, "diagram"), (0.1, 0.16, True, "mixed"), (0.0, 0.0, False, "mixed"), (0.16, 0.1, False, "mixed")])
def test_page_type(spark, density, images, tabs, want):
    assert spark.range(1).select(pages.page_type(F.lit(density), F.lit(images), F.lit(tabs)).alias("t")).first().t == want


def test_metadata_rules(spark):
    df = spark.range(1).select(F.create_map(F.lit("title"), F.lit("t"), F.lit("page_count"), F.lit("x"), F.lit("creator"), F.lit("c")).alias("m"), F.lit(None).cast("int").alias("n"), F.lit(None).cast("boolean").alias("b"))
    r = df.select(pages.with_counts(F.col("m"), F.col("n"), F.col("b"), F.col("b")).alias("a"), pages.metadata(F.col("m")).alias("b")).first()
    assert r.a == {"title": "t", "creator": "c", "page_count": "0", "is_pdf": "true", "needs_pass": "false"} and r.b == {"title": "t", "creator": "leafmill"}


def test_bookmarks_default(spark):
    df = spark.createDataFrame([(1, [(1, None, 2)]), (2, None)], "k int, t array<struct<level:int,title:string,page:int>>")
    assert {r.k: len(r.b) for r in df.select("k", pages.bookmarks("t").alias("b")).collect()} == {1: 1, 2: 0}


def test_near_pairs_over_cells(spark):
    import math
    import random

    rng = random.Random(2)
    rows = [(k, n, *(rng.choice((0.0, 10.0, -5.0)) + rng.random() * 30 for _ in range(4))) for k in range(3) for n in range(60)]
    df = spark.createDataFrame(rows, "k int, n int, x1 double, y1 double, x2 double, y2 double")
    got = sorted((r[0], r[1], r[2]) for r in geometry.near_pairs(df, "k", ["n"]).select("i.k", "i.n", "j.n").collect())

    def like(a, b):
        p, q = math.atan2(a[5] - a[3], a[4] - a[2]), math.atan2(b[5] - b[3], b[4] - b[2])
        near = math.hypot((a[2] + a[4] - b[2] - b[4]) / 2, (a[3] + a[5] - b[3] - b[5]) / 2) < 10
        return near and (abs((p - q + math.pi) % math.pi - math.pi / 2) < 0.05 or abs(p - q) < 0.05)

    want = sorted((a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and like(a, b))
    assert got == want and len(want) > 20


def test_merge_segments_is_around_the_seed():
    segs = [(0.0, 0.0, 10.0, 0.0), (4.0, 0.0, 14.0, 0.0), (12.0, 0.0, 22.0, 0.0), (5.0, -5.0, 5.0, 5.0), (100.0, 0.0, 110.0, 1.0)]
    # the third is near the second but not the seed; the fourth stands at right angles
    assert geometry.merge_segments(segs) == [(0, -5, 14, 5), (12, 0, 22, 0), (100, 0, 110, 1)]
    assert geometry.merge_segments([]) == []


def greedy(segs, tol=0.05, near=10.0):
    """The rule over all pairs."""
    import math

    a = [math.atan2(s[3] - s[1], s[2] - s[0]) for s in segs]
    m = [((s[0] + s[2]) / 2, (s[1] + s[3]) / 2) for s in segs]
    left, out = list(range(len(segs))), []
    while left:
        i = left[0]
        own = [j for j in left if j == i or (abs((a[i] - a[j] + math.pi) % math.pi - math.pi / 2) < tol or abs(a[i] - a[j]) < tol) and math.dist(m[i], m[j]) < near]
        left = [j for j in left if j not in own]
        xs, ys = [v for j in own for v in segs[j][0::2]], [v for j in own for v in segs[j][1::2]]
        out.append((int(min(xs)), int(min(ys)), int(max(xs)), int(max(ys))))
    return out


@pytest.mark.parametrize("seed", range(10))
def test_merge_segments_against_all_pairs(seed):
    import random

    rng = random.Random(seed)
    segs = []
    for _ in range(200):
        x, y, n = rng.uniform(-40, 60), rng.uniform(-40, 60), rng.uniform(1, 15)
        dx, dy = rng.choice(((1, 0), (0, 1), (1, 1), (-1, 0.02)))
        segs.append((x, y, x + n * dx, y + n * dy))
    assert geometry.merge_segments(segs) == greedy(segs)


def test_voting_keeps_boxes_of_the_first_result(spark):
    box = "array<struct<text:string,conf:double,x:double,y:double,w:double,h:double>>"
    rows = [(1, 0, 1, "b", "x y z", 0.5, [("b", 0.5, 0.0, 0.0, 1.0, 1.0)]), (1, 0, 0, "a", "x q", 0.7, [("a", 0.5, 0.0, 0.0, 1.0, 1.0)]), (1, 0, 2, "c", "x y", 0.9, None), (1, 1, 0, "a", " ", 0.1, None), (2, 0, 1, "b", "one\n two", 0.4, None)]
    df = spark.createDataFrame(rows, f"doc_id long, page_num int, engine_priority int, engine string, text string, confidence double, word_boxes {box}")
    got = {(r.doc_id, r.page_num): r for r in ocr.voting(df).collect()}
    assert set(got) == {(1, 0), (2, 0)}
    r = got[1, 0]
    assert (r.engine, r.text, round(r.confidence, 6), r.word_boxes[0].text) == ("ensemble", "x y z", 0.7, "a")
    assert (got[2, 0].engine, got[2, 0].text, got[2, 0].word_boxes) == ("b", "one\n two", None)
    assert ocr.voting(df.where("false")).count() == 0


def test_recognise_isolates_failures(spark):
    ocr.register_engine("good", lambda data: (data.decode(), 0.9))
    ocr.register_engine("bad", lambda data: 1 / 0)
    ocr.register_engine("blank", lambda data: ("  ", 0.9))
    try:
        df = spark.createDataFrame([(1, b"abc"), (2, None)], "p int, img binary")
        got = [tuple(r) for r in ocr.recognise(df, "img", ["bad", "unknown", "blank", "good"]).collect()]
    finally:
        for n in ("good", "bad", "blank"):
            ocr.ENGINES.pop(n)
    assert got == [(1, 3, "good", "abc", 0.9)]


def test_percent_words(spark):
    box = "array<struct<text:string,conf:double,x:double,y:double,w:double,h:double>>"
    rows = [(1, [("a", 95.0, 0.0, 0.0, 1.0, 1.0), ("b", -1.0, 0.0, 0.0, 1.0, 1.0), (" ", 99.0, 0.0, 0.0, 1.0, 1.0), ("c", 59.0, 0.0, 0.0, 1.0, 1.0), ("d", 60.0, 0.0, 0.0, 1.0, 1.0)]), (2, None), (3, [])]
    df = spark.createDataFrame(rows, f"k int, b {box}")
    got = {r.k: r.b and [(x.text, x.conf) for x in r.b] for r in df.select("k", ocr.percent_words("b").alias("b")).collect()}
    assert got == {1: [("a", 0.95), ("d", 0.6)], 2: None, 3: []}


def test_cells_and_methods(spark):
    df = spark.createDataFrame([(0, False, ""), (3, True, "x"), (None, None, None)], "n int, b boolean, s string")
    got = [tuple(r) for r in df.select(tables.cell_text(F.col("n"), "int"), tables.cell_text(F.col("b"), "boolean"), tables.cell_text(F.col("s"), "string")).collect()]
    assert got == [("", "", ""), ("3", "True", "x"), ("", "", "")]
    t = spark.createDataFrame([("plumber", 0.9), ("camelot", 87.0), ("camelot", None)], "method string, accuracy double")
    count = {m: tables.gated(t, m).count() for m in ("pdfplumber", "camelot", "paddleocr", "all", "other")}
    assert count == {"pdfplumber": 1, "camelot": 2, "paddleocr": 0, "all": 3, "other": 0}
    assert {r.accuracy for r in tables.gated(t, "camelot").collect()} == {0.87, None}


def test_keep_best_ties(spark):
    rows = [(1, 2, [["a"]], "x", 0.5), (1, 1, [["a"]], "y", 0.5), (1, 3, [["a"]], "z", None), (1, 4, [["b"]], "z", None)]
    df = spark.createDataFrame(rows, "page int, tbl_ord int, data array<array<string>>, method string, accuracy double")
    assert {(r.tbl_ord, r.method) for r in tables.keep_best(df, ["page"]).collect()} == {(1, "y"), (4, "z")}


def test_engines_that_are_missing_or_unknown():
    from leafmill.functions import engines

    assert all(engines.find(n) is None for n in ("tesseract", "paddleocr", "other"))
    assert engines.joined([("a", 0.9), (" ", 0.9), ("b", 0.5), ("c", 0.7)]) == ("a c", pytest.approx(0.8)) and engines.joined([]) == ("", 0.5)
