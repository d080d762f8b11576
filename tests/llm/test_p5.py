import unicodedata

import numpy as np
import pyarrow as pa
import pytest

from leafmill.llm import codepoints, p5


def one(text):
    return codepoints.unify_column(pa.array([text])).to_pylist()[0]


SAME = [
    ("Ｆｉｇ． ２", "Fig. 2"), ("étude", "étude"), ("ofﬁce", "office"), ("Тор", "Top"), ("a​b­c﻿", "abc"), ("x‑y", "x-y"), ("ậ", "ậ"), ("ậ", "ậ"),
    ("ｶﾞ", "ガ"), ("한글", "한글"), ("가나", "가나"), ("각", "각"), ("Å", "Å"),
]
DIFFERENT = [("Top", "top"), ("étude", "etude"), ("x²", "x2"), ("a-b", "a–b"), ("“a”", '"a"'), ("l", "1"), ("O", "0"), ("a b", "a  b"), ("가", "나")]


@pytest.mark.parametrize("a, b", SAME)
def test_one_form(a, b):
    assert one(a) == one(b)


@pytest.mark.parametrize("a, b", DIFFERENT)
def test_differences_stay(a, b):
    assert one(a) != one(b)


@pytest.mark.parametrize("text", [a for p in SAME + DIFFERENT for a in p] + ["", " \n\t", "​"])
def test_the_form_is_its_own_form(text):
    assert one(one(text)) == one(text)


def test_all_hangul_syllables_and_plain_scripts():
    every = "".join(map(chr, range(0xAC00, 0xD7A4)))
    assert one(unicodedata.normalize("NFD", every)) == every
    for text in ("Привет, мир", "日本語テキスト", "plain text 123", "naïve façade"):
        assert one(unicodedata.normalize("NFD", text)) == one(text)


def test_rows_do_not_run_into_one_another():
    col = pa.array(["ᄀ", "ᅡ", None, "e", "́", ""])
    assert codepoints.unify_column(col).to_pylist() == ["ᄀ", "ᅡ", None, "e", "́", ""]


def test_points_round_trip():
    col = pa.array(["a😀", None, "", "ß"])
    points, starts = codepoints.to_points(col)
    assert codepoints.to_column(points, starts, np.asarray(col.is_null())).to_pylist() == col.to_pylist()


@pytest.fixture
def folder(spark, tmp_path):
    blocks = [(1, 7, "café A"), (2, 7, "café A"), (2, 7, "café A"), (3, 7, "café A"), (4, 8, "café A"), (5, None, "café"), (6, None, "café"), (7, 7, " "), (8, 7, " "), (9, 7, None)]
    spark.createDataFrame(blocks, "tb_id long, doc_id long, text string").write.parquet(f"{tmp_path}/text_blocks.parquet")
    spark.createDataFrame([(1, 7, "Тор", "form"), (2, 7, "Top", "x")], "ct_id long, doc_id long, corrected string, form string").write.parquet(f"{tmp_path}/corrected_texts.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("stride", [1, 1000])
def test_pairs_and_classes(spark, folder, monkeypatch, stride):
    monkeypatch.setattr(p5, "STRIDE", stride)
    got = sorted(tuple(r) for r in p5.p5_found(spark, folder).collect())
    assert got == [("corrected_texts", 1, 2), ("text_blocks", 1, 2), ("text_blocks", 2, 3)]
    links = {(r.src_table, r.rec_id): r.links for r in p5.p5_classes(spark, folder).collect()}
    assert links == {("corrected_texts", 1): 1, ("corrected_texts", 2): 1, ("text_blocks", 1): 1, ("text_blocks", 2): 2, ("text_blocks", 3): 1}
