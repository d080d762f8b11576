import random

import pytest

from leafmill.llm import p10


def brute(words, run):
    seen, hit = set(), [False] * len(words)
    for i in range(len(words) - run + 1):
        w = tuple(words[i : i + run])
        if w in seen:
            hit[i : i + run] = [True] * run
        seen.add(w)
    return sum(hit)


@pytest.mark.parametrize("seed", range(30))
def test_share_against_brute_force(seed):
    rng = random.Random(seed)
    vocabulary = ["ab", "cd", "ef"][: rng.randint(1, 3)] + [f"w{chr(97 + i)}" for i in range(rng.randint(0, 20))]
    words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 120))]
    if rng.random() < 0.6 and words:
        a = rng.randrange(len(words))
        words += words[a : a + 30]
    text = " ".join(w.upper() + rng.choice(["", ".", "!", "7"]) for w in words)
    assert p10.repeated(text) == (len(words), brute(words, p10.RUN))


@pytest.mark.parametrize("text, want", [(None, (0, 0)), ("", (0, 0)), (" \n 12 ...", (0, 0)), ("a b c", (3, 0))])
def test_texts_without_runs(text, want):
    assert p10.repeated(text) == want


def test_japanese_runs_of_characters():
    once = "検査記録は東側の棚に保管されている機械部品の一覧である"
    n, hit = p10.repeated(once + "。" + once)
    assert n == 2 * len(once) and hit == len(once)


def test_a_very_long_text():
    n, hit = p10.repeated("one two three four five six seven eight " * 100_000)
    assert n == 800_000 and hit >= n - 8


def test_lines_and_clean_documents(spark, tmp_path):
    rows = [(i, f"Imprint {i}\r\nown words of document {chr(97 + i) * 3} and more\n  all rights reserved ", "a", "x") for i in range(4)]
    rows += [(10, "All Rights Reserved\nAll rights reserved\nx", "a", None), (11, "all rights reserved", "b", None), (12, None, "a", "x"), (13, "", None, "x"), (14, "Imprint 7\nall rights reserved", "a", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, line string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.clean, r.rejected) for r in p10.p10_clean(spark, str(tmp_path)).collect()}
    assert got[0] == ("own words of document aaa and more", False)
    assert got[10] == ("x", True) and got[11] == ("all rights reserved", False) and got[12] == ("", False) and got[13] == ("", False) and got[14] == ("", True)
    lines = {r.doc_id: (r.chars, r.kept, r.depleted) for r in p10.p10_lines(spark, str(tmp_path)).collect()}
    assert lines[10] == (39, 1, True) and 12 not in lines


def test_hot_lines_come_back_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(p10, "HOT", 3)
    docs = spark.createDataFrame([(i, "s", f"hot line\nown {chr(97 + i)}\n{'rare' if i < 3 else 'other ' + chr(97 + i)}") for i in range(20)], "doc_id long, source string, text string")
    got = p10.repeated_lines(docs).groupBy("often").count().collect()
    assert {r.often: r["count"] for r in got} == {True: 23, False: 37}


def test_cells_parted_by_punctuation_are_words():
    assert p10.units("Rev;Qty;n/a;48.20 KA-5825")[0] == ["rev", "qty", "n", "a", "ka"]
