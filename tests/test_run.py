import json
import os

import numpy as np
import pytest

from leafmill import config
from leafmill.functions.pixels import png_encode
from leafmill.plans import run
from leafmill.sources import pdf

PX = np.random.default_rng(3).integers(0, 256, (12, 16, 3)).astype(np.uint8)


def make(path, pages=2, text="native text on this page that is long enough"):
    with open(path, "wb") as f:
        w = pdf.Writer(f)
        for i in range(pages):
            w.add_page(200, 300, None, [{"x0": 10, "y0": 20, "x1": 90, "y1": 80, "data": png_encode(PX)}], [{"x": 5, "y": 50, "size": 10, "text": f"{text} {i}"}] if text else [])
        w.close({"title": "T"}, [(1, "Start", 1)])


@pytest.fixture
def cfg(tmp_path):
    c = config.Config()
    c.pipeline.checkpoint_db = str(tmp_path / "state")
    c.pipeline.output_dpi = 144
    c.enhancement.enable_super_resolution = False
    return c


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    make(d / "b.pdf")
    make(d / "a.pdf", 3)
    (d / "bad.pdf").write_bytes(b"%PDF-1.4 broken")
    (d / "other.txt").write_text("x")
    return str(d)


def test_a_bad_file_gives_an_error_and_the_rest_proceed(spark, folder, cfg, tmp_path):
    out = str(tmp_path / "out")
    got = run.run_folder(spark, folder, out, cfg)
    assert [(os.path.basename(r["source"]), r["pages_processed"], r["error"] is None) for r in got] == [("a.pdf", 3, True), ("b.pdf", 2, True), ("bad.pdf", 0, False)]
    assert sorted(os.listdir(out)) == ["a_enhanced.pdf", "a_enhanced.quality_report.json", "b_enhanced.pdf", "b_enhanced.quality_report.json"]
    rows = list(pdf.pages_of(open(f"{out}/a_enhanced.pdf", "rb").read(), "p"))
    assert len(rows) == 3 and (rows[0]["width"], rows[0]["height"]) == (400, 600) and rows[0]["bookmarks"][0]["title"] == "Start" and rows[0]["metadata"]["title"] == "T"
    s = rows[1]["spans"][0]
    assert s["text"].startswith("native text") and s["font_size"] == pytest.approx(18) and len(rows[1]["pictures"]) == 1
    rep = json.load(open(f"{out}/a_enhanced.quality_report.json"))
    assert rep["pages_processed"] == 3 and rep["total_images_enhanced"] == 3 and [p["page"] for p in rep["per_page"]] == [1, 2, 3]
    store = run.state.Store(spark, cfg.pipeline.checkpoint_db)
    (r,) = store.runs().collect()
    assert (r.status, r.pages_done) == ("failed", 5)


def test_page_range_and_recognised_text(spark, tmp_path, cfg):
    d = tmp_path / "in"
    d.mkdir()
    make(d / "s.pdf", 3, "")
    cfg.pipeline.pages = "2-3"
    texts = spark.createDataFrame([(f"file:{d}/s.pdf", 1, "seen text"), (f"file:{d}/s.pdf", 2, "  ")], "path string, page_num int, text string")
    (r,) = run.run_folder(spark, str(d), str(tmp_path / "out"), cfg, texts=texts)
    assert (r["pages_processed"], r["total_ocr_blocks"]) == (2, 1)
    rows = list(pdf.pages_of(open(r["output"], "rb").read(), "p"))
    assert [[s["text"] for s in x["spans"]] for x in rows] == [["seen text"], []] and rows[0]["spans"][0]["font_size"] == 8


def test_one_file(spark, folder, cfg, tmp_path):
    r = run.run_file(spark, f"{folder}/b.pdf", str(tmp_path / "o"), cfg)
    assert r["pages_processed"] == 2
    with pytest.raises(FileNotFoundError):
        run.run_file(spark, f"{folder}/none.pdf", str(tmp_path / "o"), cfg)


def test_no_files(spark, folder, cfg, tmp_path):
    assert run.run_folder(spark, folder, str(tmp_path / "o"), cfg, "*.xyz") == []


def test_stop_after_extraction(spark, folder, cfg, tmp_path, monkeypatch):
    monkeypatch.setattr(run.state.Store, "start", lambda *a, **k: run.request_stop())
    monkeypatch.setattr(run.state.Store, "finish", lambda *a, **k: None)
    assert run.run_folder(spark, folder, str(tmp_path / "o"), cfg) == []


def test_command_line(spark, folder, tmp_path):
    c = str(tmp_path / "c.yaml")
    assert run.main(["config", "--save", c]) == 0
    a = run._arguments().parse_args(["enhance", "x.pdf", "-c", c, "--dpi", "72", "--pages", "1", "--no-sr", "--no-ai", "--no-vectorize", "--workers", "2"])
    s = run.settings(a)
    assert (s.pipeline.output_dpi, s.pipeline.pages, s.pipeline.workers) == (72, "1", 2)
    assert not (s.enhancement.enable_super_resolution or s.ocr.enable_ai_correction or s.diagram.enable_ai_analysis or s.diagram.enable_vectorization)
    assert run.main(["enhance", str(tmp_path / "none.pdf"), "-c", c], spark) == 1


def test_tables_as_grid():
    t = run._scaled({"x0": 0, "y0": 0, "x1": 10, "y1": 20, "data": [["a", None], ["b"]]}, 2)
    assert len(t["lines"]) == 6 and [x["text"] for x in t["texts"]] == ["a", "b"]


@pytest.mark.parametrize("p, render, full, want", [
    ({"xref": -1}, False, False, False), ({"xref": 1, "x0": 0, "y0": 0, "x1": 10, "y1": 10}, False, False, True),
    ({"xref": 1, "x0": 0, "y0": 0, "x1": 10, "y1": 7}, True, False, False), ({"xref": 1, "x0": 0, "y0": 0, "x1": 10, "y1": 5}, True, False, True), ({"xref": 1, "x0": 0, "y0": 0, "x1": 10, "y1": 9.5}, True, True, True),
])
def test_keep_picture(p, render, full, want):
    assert run.keep_picture(p, 10, 10, render, full) is want


def test_renders_are_backgrounds_and_repair_pictures(spark, tmp_path, cfg):
    d = tmp_path / "in"
    d.mkdir()
    make(d / "a.pdf", 1)
    page = np.full((300, 200, 3), 200, np.uint8)
    pdf.register_renderer(lambda data, n, dpi: page)
    try:
        (r,) = run.run_folder(spark, str(d), str(tmp_path / "out"), cfg)
    finally:
        pdf._RENDERER.clear()
    (row,) = pdf.pages_of(open(r["output"], "rb").read(), "p")
    assert len(row["pictures"]) == 2 and (row["pictures"][0]["width"], row["pictures"][0]["x1"]) == (200, 400)
