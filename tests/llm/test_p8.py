import base64
import os

import pytest

from leafmill.llm import bpe, p8

PATH = bpe.vocabulary()
TEXTS = ["", " ", "Hello world", "The quick  brown\n\n fox's 12345 jumps", "Grüße — Привет, 世界 🙂", "a" * 3000, "    indented\tcode();\r\n", "​­ odd", "<|endoftext|>", "'s 're I'll", " leading and trailing "]


@pytest.fixture(scope="module")
def library():
    tiktoken = pytest.importorskip("tiktoken")
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary")
@pytest.mark.parametrize("text", TEXTS)
def test_ids_and_round_trip(library, text):
    enc = bpe.encoder(PATH)
    assert enc.encode(text) == library.encode_ordinary(text) and enc.decode(enc.encode(text)) == text


@pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary")
def test_table(spark, library, tmp_path):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(100, None, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, ids string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: list(r.ids) for r in p8.p8_ids(spark, str(tmp_path)).collect()}
    assert got == {i: library.encode_ordinary(t) if t else [] for i, t, _ in rows}
    assert p8.p8_round_trip(spark, str(tmp_path)).first().bad == 0
