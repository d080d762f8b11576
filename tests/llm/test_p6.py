import random
import re

import pyarrow as pa
import pytest

from leafmill.llm import noise, p6

WORDS = "behälter übersicht página hatch schließen número température fenêtre español bearing lubricant valve mounting housing winding connector filter assembly machine minimum running button diagram kurz hebel gehäuse módulo llave".split()
COUNTS = {w: 10 + i for i, w in enumerate(WORDS)}


def two_steps(word, rules):
    """The words that one misreading by ``rules`` after one of noise._FROM turns into ``word``."""
    return {x for v in noise.variants(word, rules) for x in noise.variants(v)}


@pytest.mark.parametrize("got, was", [("ubersicbt", "übersicht"), ("bebalter", "behälter"), ("paqina", "página"), ("liatcb", "hatch")])
def test_two_misreadings(got, was):
    assert noise.Reader(COUNTS, marks=True).judge(got) == was


def test_both_sides_of_every_rule_are_widely_equal():
    for got, all_ in noise._FROM + noise._MARKS:
        for was in all_:
            assert noise.wide(got) == noise.wide(was), (got, was)


@pytest.mark.parametrize("marks", [False, True])
def test_all_of_the_two_step_search_is_found(marks):
    rng, reader = random.Random(7), noise.Reader(COUNTS, marks=marks)
    back = [(w, [g]) for g, all_ in noise._FROM for w in all_]
    first = back + ([(w, [g]) for g, all_ in noise._MARKS for w in all_] if marks else [])
    tried = 0
    for was in WORDS:
        once = sorted(noise.variants(was, back))
        for v in rng.sample(once, min(12, len(once))):
            twice = sorted(noise.variants(v, first))
            for got in rng.sample(twice, min(12, len(twice))):
                letters = sum(c.isalpha() for c in got)
                if got in COUNTS or len(got) < 5 or noise.plain(got) != got or 2 * letters < len(got) or re.fullmatch(r"[a-z]{1,4}-?\d{2,}", got) or was not in two_steps(got, reader.rules):
                    continue
                tried += 1
                assert isinstance(reader.judge(got), str), (got, was)
    assert tried > 500


BLOCKS = "tb_id long, doc_id long, page_num int, span_ord int, block_id int, text string"
OCR = "ocr_id long, doc_id long, page_num int, text string"
CORRECTED = "ct_id long, doc_id long, page_num int, raw_ocr string"


@pytest.fixture
def folder(spark, tmp_path):
    def write(blocks, ocr=(), corrected=()):
        for name, rows, schema in (("text_blocks", blocks, BLOCKS), ("ocr_results", ocr, OCR), ("corrected_texts", corrected, CORRECTED)):
            spark.createDataFrame(list(rows), schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


COUNTED = {"assembly": 50, "the": 90, "bearing": 40, "housing": 40, "machine": 40, "winding": 40, "and": 50, "of": 80}


def _hot_page(lines):
    """One long page: every fifth line is short and has a block of its own, every fifth ends in a split word."""
    rows = [(1, 5, 0, 0, 0, "OPERATING MANUAL")]
    for i in range(1, lines):
        text = "Spare Parts" if i % 5 == 0 else "the bearing is in the assem-" if i % 5 == 1 else "bly of the machine housing and winding"
        rows.append((1 + i, 5, 0, i, i if i % 5 == 0 else 1_000_000 + i // 5, text))
    return rows + [(1 + lines, 5, 0, lines, 2_000_000, "- 1 -")]


def test_a_page_longer_than_what_is_held(spark, folder):
    # lines 20,001 and 40,001 are those at which stretches of 20,000 begin
    lines = 40_003
    counts = spark.sparkContext.broadcast(COUNTED)
    got = [(r.rec_id, r.noise) for r in p6.marks(spark, folder(_hot_page(lines)), counts).collect()]
    assert {i for i, what in got if what in ("header", "pageno")} <= {1, 2, lines, lines + 1}
    assert (1, "header") in got and (lines + 1, "pageno") in got
    assert sorted(i for i, what in got if what == "hyphen") == [1 + i for i in range(1, lines) if i % 5 == 1 and i + 1 < lines]


@pytest.mark.parametrize("held", [*range(7, 25), 61])
def test_noise_does_not_depend_on_stretches(held):
    rows = _hot_page(60)
    for i in (3, 17, 18, 33, 59):
        rows[i] = (*rows[i][:5], "\u00a0")
    rows = [(r[1], r[2], r[3], r[4], r[0], r[5]) for r in rows]
    batch = pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], names=["doc_id", "page_num", "span_ord", "block_id", "rec_id", "text"])

    def run(most):
        return sorted((tuple(r.values()) for b in p6._stream([batch], noise.Reader(COUNTED), most) for r in b.to_pylist()), key=str)

    assert run(held) == run(1000)


def test_clean_paragraphs_of_text_blocks(spark, folder):
    blocks = []
    for page in range(3):
        at = 10 * page
        blocks += [
            (at, 7, page, 0, 0, "OPERATING MANUAL"),
            (at + 1, 7, page, 1, 1, "the bearing is in the assem-"),
            (at + 2, 7, page, 2, 1, "bly of the machine"),
            (at + 3, 7, page, 3, 2, "the housing of the winding"),
            (at + 3, 7, page, 3, 2, "the housing of the winding"),
            (at + 4, 7, page, 4, 2, "and of the rnachine." if page == 1 else "and of the machine."),
            (at + 5, 7, page, 5, 3, f"- {page + 1} -"),
        ]
    blocks += [(90, 8, 0, 0, 0, "the machine of\nthe assem-\nbly"), (91, 8, 1, 0, 0, None)]
    blocks += [(100 + i, 9, 0, i, i // 2, "the assembly and the machine") for i in range(6)]
    got = sorted((r.src_table, r.rec_id, r.clean) for r in p6.p6_clean(spark, folder(blocks, [(1, 1, 0, "the machine")])).collect())
    want = [("ocr_results", 1, "the machine"), ("text_blocks", 90, "the machine of the assembly")]
    for at in (0, 10, 20):
        want += [("text_blocks", at + 1, "the bearing is in the assembly of the machine"), ("text_blocks", at + 3, "the housing of the winding and of the machine.")]
    want += [("text_blocks", 100 + i, "the assembly and the machine the assembly and the machine") for i in (0, 2, 4)]
    assert got == sorted(want)


@pytest.mark.parametrize("held", [1, 2, 3])
def test_a_long_block_is_not_ended_inside_a_word(held):
    texts = ["the bearing of the assem-", "bly and the", "winding of the assem-", "bly"]
    cols = [[1] * 4, [0] * 4, [0, 1, 2, 3], [0] * 4, [1, 2, 3, 4], texts, [None] * 4, [None] * 4]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=list("abcdefgh"))
    got = [r["clean"] for b in p6._clean_blocks([batch], noise.Reader(COUNTED), held) for r in b.to_pylist()]
    assert " ".join(got) == "the bearing of the assembly and the winding of the assembly"


def test_the_line_model_is_fitted():
    # headers that end like sentences, which the prior speaks against
    like = noise.features("Sheet no.", None, "", None)
    body = noise.features("and goes on to the next line of the paragraph", "x", "y", None)
    assert noise.score(like) < noise.score(noise.features("Sheet", None, "", None))
    w = noise.fit([(like, 500, 490), (body, 3000, 10)])
    assert noise.score(like, w) > 1 and noise.score(body, w) < -1
    assert noise.fit([]) == noise.PRIOR
    # with two lines it stays near the prior
    assert max(abs(a - b) for a, b in zip(noise.fit([(like, 2, 1)]), noise.PRIOR)) < 1


@pytest.mark.parametrize("line, page, want", [("- 4 -", 3, True), ("Page 4 of 12", 3, True), ("~" * 60 + " 4 " + "*" * 90, 3, True), ("iv", 3, True), ("5", 3, False), ("Page", 3, False), ("4 pumps", 3, False), ("4", None, False), ("-" * 100_000, 3, False)])
def test_page_numbers(line, page, want):
    assert noise.is_pageno(line, page) is want


def test_many_whole_pages_under_one_page_number(spark, folder):
    text = "OPERATING MANUAL\n\nthe bearing of the assem-\nbly and the machine\n\n- 1 -"
    rows = [(i, 4, 0, i, i, text) for i in range(5)] + [(9, 4, 0, 9, 9, "the winding of the machine")]
    counts = spark.sparkContext.broadcast(COUNTED)
    got = [(r.rec_id, r.noise) for r in p6.marks(spark, folder(rows), counts).collect()]
    assert {i for i, what in got if what == "pageno"} == set(range(5)) == {i for i, what in got if what == "hyphen"}


def test_weights_of_a_corpus(spark, folder):
    ocr = [(d * 10 + p, d, p, f"PUMP MANUAL {chr(65 + d)}\n\nthe bearing of page {chr(97 + p)} and the\nmachine stands\n\n- {p + 1} -") for d in range(5) for p in range(6)]
    w = p6.fitted(spark, folder([], ocr))
    head = noise.features("PUMP MANUAL A", None, "", None)
    assert noise.score(head, w) > 1.5


def test_weights_of_no_pages(spark, folder):
    assert p6.fitted(spark, folder([])) == noise.PRIOR
