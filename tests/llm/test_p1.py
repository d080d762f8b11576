import random
import re
from collections import Counter

import pytest

from leafmill.llm import p1, swaps

DOCUMENTS = "/root/testdata/sf0.01/documents.parquet"
BLOCKS = "tb_id long, text string, source string"
OCR = "ocr_id long, text string, engine string"


@pytest.fixture(scope="module")
def lines(spark):
    rows = spark.read.parquet(DOCUMENTS).where("text is not null and lang in ('en', 'de', 'fr', 'ru', 'pl', 'es')").orderBy("doc_id").collect()
    return {lang: [s.strip() for r in rows if r.lang == lang for s in re.split(r"[\r\n]+", r.text) if 30 < len(s) < 200] for lang in ("en", "de", "fr", "ru", "pl", "es")}


@pytest.fixture
def folder(spark, tmp_path):
    def write(blocks, ocr=()):
        spark.createDataFrame(list(blocks), BLOCKS).write.parquet(f"{tmp_path}/text_blocks.parquet")
        spark.createDataFrame(list(ocr), OCR).write.parquet(f"{tmp_path}/ocr_results.parquet")
        return str(tmp_path)

    return write


def words_of(lines, pattern):
    return Counter(w for s in lines for w in re.findall(pattern, s))


@pytest.mark.parametrize("page, reads", [("iso8859_5", "cp1252"), ("cp855", "latin_1")])
def test_fit_from_an_even_start_learns_a_page_that_is_not_listed(lines, page, reads):
    assert page not in swaps.WRITTEN
    n = words_of(lines["ru"], "[А-Яа-яЁё]+")
    every = swaps.scripts(swaps.bigrams(list(n.items()) + list(words_of(lines["en"], "[A-Za-z]+").items())))
    seen: Counter = Counter()
    for w, c in n.items():
        swaps._symbols(seen, "s", swaps.WHOLE, w.encode(page).decode(reads), c)
    seen = {(a, b): c for (_, _, a, b), c in seen.items()}
    got = {name: swaps.fit(seen, b) for name, b in every.items()}
    assert max(got, key=lambda k: got[k][1]) == "CYRILLIC"
    table = got["CYRILLIC"][0]
    right = sum(c for w, c in n.items() if w.encode(page).decode(reads).translate(table).lower() == w.lower())
    assert right > 0.8 * sum(n.values())


def test_a_page_that_is_not_listed_is_found_and_restored(spark, lines, folder):
    rng = random.Random(5)
    clean = [(s, "native") for lang in lines for s in lines[lang] for _ in range(3)]
    true = [s for s in lines["pl"] if not s.isascii()]
    garbled = [s.encode("cp852", "replace").decode("cp1252", "replace") for s in true]
    keep = [i for i, (s, g) in enumerate(zip(true, garbled)) if "�" not in g and "?" not in g.replace("?", "", s.count("?"))]
    rows = [(i, s, src) for i, (s, src) in enumerate(clean)]
    at = {10**6 + i: true[i] for i in keep}
    rows += [(10**6 + i, garbled[i], "native") for i in keep]
    rng.shuffle(rows)
    d = folder(rows)
    got = {r.rec_id: r for r in p1.p1_repaired(spark, d).collect()}
    found = set(got) & set(at)
    assert len(at) > 30 and len(found) > 0.9 * len(at)
    assert len(set(got) - set(at)) <= 0.02 * len(clean)
    words = [(a, b) for i in found for a, b in zip(at[i].split(), got[i].restored.split()) if not a.isascii()]
    assert sum(a == b for a, b in words) > 0.8 * len(words)


@pytest.mark.parametrize("written, reads", [("utf-8", "cp1252"), ("utf-8", "mac_roman"), ("cp1251", "cp1252"), ("koi8_r", "cp1251"), ("cp1252", "mac_roman")])
def test_public_pages(spark, lines, folder, written, reads):
    lang = "ru" if written in ("cp1251", "koi8_r") else "de"
    clean = [(i, s, "ocr") for i, s in enumerate(s for k in lines for s in lines[k] * 2)]
    true = [s for s in lines[lang] if sum(not c.isascii() for c in s) > 1][:40]
    bad = [(10**6 + i, s.encode(written, "ignore").decode(reads, "replace"), "ocr") for i, s in enumerate(true)]
    bad = [b for b in bad if "�" not in b[1]]
    got = {r.rec_id: r for r in p1.p1_repaired(spark, folder(clean + bad)).collect()}
    assert len(bad) > 5 and sum(b[0] in got for b in bad) >= 0.9 * len(bad)
    assert sum(i < 10**6 for i in got) <= 0.01 * len(clean)
    words = [(a, b) for i, _, _ in bad if i in got for a, b in zip(true[i - 10**6].split(), got[i].restored.split()) if not a.isascii()]
    assert sum(a == b for a, b in words) >= 0.85 * len(words)


def test_nulls_empties_repeats_and_extra_columns(spark, tmp_path):
    rows = [(1, None, "native", "x"), (2, "", None, "x"), (3, "caf\x82 \x82t\x82", "native", None), (3, "caf\x82 \x82t\x82", "native", None), (None, "Ã©", "native", "x")]
    spark.createDataFrame(rows, BLOCKS + ", word string").write.parquet(f"{tmp_path}/text_blocks.parquet")
    spark.createDataFrame([], OCR).write.parquet(f"{tmp_path}/ocr_results.parquet")
    got = p1.p1_found(spark, str(tmp_path)).collect()
    assert [(r.src_table, r.rec_id) for r in got] == [("text_blocks", 3)]


def test_empty_tables(spark, folder):
    d = folder([])
    assert p1.p1_found(spark, d).count() == 0 and p1.p1_repaired(spark, d).count() == 0


def test_whole_lines_joined_by_no_break_spaces_end_in_time():
    line = "Die\xa0Messreihe\xa0bestätigt\xa0das\xa0Typenschild\xa0im\xa0zweiten\xa0Durchlauf" * 50
    assert max(map(len, swaps.WORD.findall(line))) < 40
    model = swaps.Model({})
    assert len(model.judge(["s"], ["ä" + "x" * 5000])) == 1


def test_utf_8_twice_is_undone_twice():
    word = "légende".encode().decode("cp1252").encode().decode("cp1252")
    model = swaps.Model(dict(swaps.bigrams([("légende", 50.0), ("legende", 900.0)])))
    k, text, lo = model.judge(["s"], [word])[0]
    assert (k, text) == ("cp1252<utf_8+", "légende") and lo > swaps.ODDS


def test_verdicts_do_not_depend_on_the_batch():
    model = swaps.Model(dict(swaps.bigrams([("légende", 50.0), ("über", 900.0), ("Gerät", 30.0)])))
    words = ["lÃ©gende", "Ã¼ber", "über", "GerГ¤t", "abc​d", "ｆｕｌｌ", "", "¬"]
    words = [w for w in words if w]
    all_ = model.judge(["s"] * len(words), words)
    assert all_ == [model.judge(["s"], [w])[0] for w in words]
