import pytest

from leafmill.llm import p3, p4

DOCUMENTS = "/root/testdata/sf0.001/documents.parquet"
LIMIT = 40
WHOLE = ["spare valve; hinge; WF-8837; faded pump", "outer hinge; valve", "pump; valve; hinge; GE-5049"]
#: All of LIMIT characters: four cut inside a label, one after a separator, two that properly end at the limit.
CUT = ["heavy spring; upper folder; spare hinge; valv", "first longer label; faded pump; VH-86", "upper folder one; outer hinge; outer", "spare valve; hinge; WF-8837; hin"]
AFTER, PROPER = "spare valve; hinge; faded pump; valve;", ["outer valve; WF-8837; hinge", "outer hinge; spare pump; VH-8627"]


def _fit(text):
    """The list with a first label that brings it to LIMIT characters."""
    rest = text[-(LIMIT - 4) :]
    rest = rest[rest.index(";") :] if len(text) > LIMIT - 4 else "; " + text
    return "x" * (LIMIT - len(rest)) + rest


@pytest.fixture
def folder(spark, tmp_path):
    texts = {f"w{i}": t for i, t in enumerate(WHOLE)} | {f"c{i}": _fit(t) for i, t in enumerate(CUT)} | {"after": _fit(AFTER)} | {f"p{i}": _fit(t) for i, t in enumerate(PROPER)}
    assert all(len(t) == LIMIT for k, t in texts.items() if k[0] != "w")
    spark.read.parquet(DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    prompts = [("h", "List the labels printed around the flange, separated by semicolons.", "en", "labels"), ("d", "Describe the diagram as JSON.", "en", "diagram")]
    spark.createDataFrame(prompts, "prompt_hash string, prompt_text string, lang string, task string").write.parquet(f"{tmp_path}/prompts.parquet")
    spark.createDataFrame([(k, "m", "h", t) for k, t in texts.items()], "content_hash string, model string, prompt_hash string, response string").write.parquet(f"{tmp_path}/api_cache.parquet")
    spark.createDataFrame([], "diagram_id long, raw_response string").write.parquet(f"{tmp_path}/diagram_analyses.parquet")
    spark.createDataFrame([], "ct_id long, raw_ocr string, corrected string").write.parquet(f"{tmp_path}/corrected_texts.parquet")
    return str(tmp_path)


def test_lists_of_labels_cut_at_a_limit(spark, folder):
    want = {f"c{i}" for i in range(len(CUT))} | {"after"}
    assert {r.rec_key for r in p3.p3_found(spark, folder).collect()} == want
    assert {r.rec_key for r in p4.p4_found(spark, folder).collect() if r.defect == "truncated"} == want
