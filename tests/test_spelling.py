import random

import pytest

from leafmill.operators import correction, spelling

WORDS = {"pump": 50, "pumps": 20, "valve": 40, "value": 60, "gearbox": 30, "a": 99, "the": 99, "straße": 5, "lamp": 10, "camp": 10}


def brute(token):
    best = min(((spelling.osa(token, w), -n, w) for w, n in WORDS.items()), default=None)
    return (best[2], best[0]) if best and best[0] <= spelling.EDITS else None


@pytest.fixture(scope="module")
def dictionary(spark):
    return spark.createDataFrame(list(WORDS.items()), "word string, count long")


@pytest.mark.parametrize("a, b, d", [("", "", 0), ("ab", "ba", 1), ("ca", "abc", 3), ("valve", "value", 1), ("pump", "pmup", 1), ("abcd", "badc", 2), ("x", "xyzw", 3), ("", "ab", 2)])
def test_distance(a, b, d):
    assert spelling.osa(a, b) == d == spelling.osa(b, a)


def test_suggestions_against_all_pairs(spark, dictionary):
    rng = random.Random(4)
    tokens = {"", "zzzzzzzz", "x" * 5000, *WORDS}
    for w in WORDS:
        for _ in range(30):
            t = list(w)
            for _ in range(rng.randint(1, 3)):
                i = rng.randrange(len(t) + 1)
                what = rng.randrange(4)
                if what == 0:
                    t.insert(i, rng.choice("aelpuvß"))
                elif t and i < len(t):
                    if what == 1:
                        t.pop(i)
                    elif what == 2:
                        t[i] = rng.choice("aelpuvß")
                    elif i + 1 < len(t):
                        t[i], t[i + 1] = t[i + 1], t[i]
            tokens.add("".join(t))
    df = spark.createDataFrame([(t,) for t in tokens] + [(None,)], "token string")
    got = {r.token: (r.term, r.distance) for r in spelling.suggestions(df, dictionary).collect()}
    assert got == {t: b for t in tokens if t and (b := brute(t))}


def test_texts(spark, dictionary):
    rows = [(1, "The  pmup\n3.14 OCR Valvee xylophone Gear-box"), (2, None), (3, "  "), (4, "GearBox VALVE pumpS")]
    df = spark.createDataFrame(rows, "k int, t string")
    got = {r.k: r.corrected for r in spelling.correct(df, dictionary, "k", "t").collect()}
    assert got == {1: "The pump 3.14 OCR Valve xylophone Gearbox", 2: None, 3: "", 4: "Gearbox VALVE pumps"}


def test_empty_dictionary(spark, dictionary):
    df = spark.createDataFrame([(1, "some words")], "k int, t string")
    assert spelling.correct(df, dictionary.where("false"), "k", "t").first().corrected == "some words"


def test_chain_and_hooks(spark, dictionary):
    rows = [(1, "the  pmup", 0.8), (2, " ", 0.9), (3, None, 0.7), (4, "a value", 0.5)]
    df = spark.createDataFrame(rows, "ocr_id int, text string, confidence double")
    plain = {r.ocr_id: r for r in correction.corrected(df, dictionary).collect()}
    assert (plain[1].corrected, plain[1].changes_made, plain[1].final_confidence) == ("the pump", ["layout_clean", "spell_correct"], 0.8)
    assert (plain[2].raw_ocr, plain[2].corrected, plain[2].changes_made, plain[2].final_confidence) == ("", "", [], 0.0) and plain[3].corrected == ""
    assert plain[4].changes_made == ["layout_clean"]
    correction.TEXT_HOOKS.update({"grammar": lambda t: t + ".", "model": lambda t: 1 / 0 if "value" in t else t.upper()})
    correction.hooks.time.sleep, kept = (lambda s: None), correction.hooks.time.sleep
    try:
        got = {r.ocr_id: r for r in correction.corrected(df, dictionary).collect()}
    finally:
        correction.TEXT_HOOKS.clear()
        correction.hooks.time.sleep = kept
    assert (got[1].corrected, got[1].changes_made) == ("THE PUMP.", ["layout_clean", "spell_correct", "grammar_fix", "ai_correction"])
    assert (got[4].corrected, got[4].changes_made) == ("a value.", ["layout_clean", "grammar_fix"])


def test_retries():
    waits, calls = [], []

    def fails():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert correction.hooks.retried(fails, 3, 2, 3, waits.append) == "ok" and len(waits) == 2 and waits[0] <= 2 < 3 >= waits[1]
    with pytest.raises(ZeroDivisionError):
        correction.hooks.retried(lambda: 1 / 0, 2, sleep=waits.append)


def test_once_and_libraries():
    made = []
    assert [correction.hooks.once("t", lambda: made.append(1) or 5) for _ in range(3)] == [5, 5, 5] and made == [1]
    assert correction.hooks.once("u", lambda: 1 / 0) is None and correction.hooks.library("no_such_module_here") is None
    assert correction.hooks.or_same(lambda t: "", "x") == "x" and correction.hooks.or_same(None, "x") == "x"


def test_analysis_of_figures(spark):
    import numpy as np

    from leafmill import config
    from leafmill.functions.pixels import png_encode

    big = np.full((120, 120), 255, np.uint8)
    big[30:90, 40:50] = 0
    rows = [(1, png_encode(big)), (2, png_encode(big[:50])), (3, b"junk"), (4, None)]
    df = spark.createDataFrame(rows, "k int, image binary")
    correction.VISION.append(lambda b64, kind: '```json\n{"diagram_type": "graph", "confidence": 0.9}\n```' if kind == "image/png" else "")
    try:
        got = {r.k: r for r in correction.analysed(df, "k", "image").collect()}
    finally:
        correction.VISION.clear()
    assert got[1].analysis.diagram_type == "graph" and got[1].analysis.title == "" and got[1].use_vector and got[1].svg
    assert all(got[k].analysis is None and got[k].svg is None and not got[k].use_vector for k in (2, 3, 4))
    off = correction.analysed(df, "k", "image", config.Diagram(enable_vectorization=False)).where("k = 1").first()
    assert off.analysis is None and off.svg is None
