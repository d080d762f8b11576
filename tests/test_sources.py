import io
import sqlite3
import zipfile

import numpy as np
import pytest

from leafmill.functions.pixels import png_encode
from leafmill.sources import pdf, sqlite, xlsx

PX = np.arange(4 * 6 * 3, dtype=np.uint8).reshape(4, 6, 3)


def make(compress=True, pages=3):
    out = io.BytesIO()
    w = pdf.Writer(out, compress)
    for i in range(pages):
        w.add_page(595, 842, PX if i == 0 else None, [{"x0": 10, "y0": 20, "x1": 110, "y1": 70, "data": png_encode(PX)}], [{"x": 50, "y": 100, "size": 12, "text": f"Grüße {i} — Привет\nzweite 🙂"}])
    w.close({"title": "Tëst (1)", "author": "x", "producer": "gone", "creator": "other"}, [(1, "One", 1), (2, "Sub", 2), (1, "Zwei ü", 3), (1, "Nowhere", 9)])
    return out.getvalue()


@pytest.mark.parametrize("compress", [True, False])
def test_pdf_round_trip(compress):
    rows = list(pdf.pages_of(make(compress), "p"))
    assert [r["page_num"] for r in rows] == [0, 1, 2] and all(r["error"] is None and r["page_count"] == 3 for r in rows)
    assert [s["text"] for s in rows[1]["spans"]] == ["Grüße 1 — Привет", "zweite 🙂"]
    assert rows[1]["spans"][0]["y1"] == 100 and rows[1]["spans"][0]["font_size"] == 12
    assert rows[0]["metadata"] == {"title": "Tëst (1)", "author": "x", "creator": "leafmill"}
    assert [(b["level"], b["title"], b["page"]) for b in rows[0]["bookmarks"]] == [(1, "One", 1), (2, "Sub", 2), (1, "Zwei ü", 3), (1, "Nowhere", 0)]
    assert len(rows[0]["pictures"]) == 2 and (rows[0]["pictures"][1]["x0"], rows[0]["pictures"][1]["y1"]) == (10, 70)
    from leafmill.functions.pixels import png_decode

    assert (png_decode(rows[0]["pictures"][0]["data"]) == PX).all()


def test_pdf_with_a_wrong_table_is_read_by_its_objects():
    data = make(False)
    at = data.rindex(b"startxref")
    rows = list(pdf.pages_of(data[:at] + b"startxref\n17\n%%EOF", "p"))
    assert len(rows) == 3 and rows[2]["spans"][0]["text"].startswith("Grüße 2")


@pytest.mark.parametrize("data", [b"", b"junk", b"%PDF-1.4 nothing", make()[:400], make(False).replace(b"/Root", b"/Encrypt 1 0 R /Root")])
def test_pdf_that_cannot_be_read_gives_an_error_row(data):
    rows = list(pdf.pages_of(data, "p"))
    assert len(rows) == 1 and rows[0]["error"]


def test_pdf_text_operators():
    content = b"BT /F1 10 Tf 1 0 0 1 20 700 Tm (Hel\\154o \\(x\\)) Tj 0 -12 Td [(Wor) -20 (ld) -300 (!)] TJ T* <414243> Tj ET 1 0 0 rg q 2 0 0 2 0 0 cm BT /F1 5 Tf 10 10 Td (red) Tj ET Q"
    objects = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[3 0 R]/Count 1/MediaBox[0 0 200 800]>>", b"<</Type/Page/Parent 2 0 R/Resources<</Font<</F1 4 0 R>>>>/Contents 5 0 R/Rotate 90>>", b"<</Type/Font/Subtype/Type1/BaseFont/ABCDEF+Times-BoldItalic>>", b"<</Length %d>>\nstream\n%s\nendstream" % (len(content), content)]
    body = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objects, 1)) + b"trailer<</Root 1 0 R>>"
    (row,) = pdf.pages_of(body, "p")
    assert (row["width"], row["height"], row["rotation"]) == (200, 800, 90)
    assert [s["text"] for s in row["spans"]] == ["Hello (x)", "World !", "ABC", "red"]
    s = row["spans"][3]
    assert (s["r"], s["g"], s["font_size"], s["x0"], s["y1"]) == (1, 0, 10, 20, 780) and s["bold"] and s["italic"] and s["font_name"] == "Times-BoldItalic"


def test_pdf_scan_goes_on_after_a_bad_file(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(make())
    (tmp_path / "b.pdf").write_bytes(b"junk")
    (tmp_path / "c.txt").write_bytes(make())
    files = pdf.files(spark, str(tmp_path))
    assert files.count() == 2
    rows = pdf.scan(files, "2-3,9").collect()
    assert sorted((r.path[-5:], r.page_num, r.error is None) for r in rows if r.error is None) == [("a.pdf", 1, True), ("a.pdf", 2, True)]
    assert sum(r.error is not None for r in rows) == 1
    docs = {r.path[-5:]: r for r in pdf.documents(pdf.scan(files)).collect()}
    assert docs["a.pdf"].metadata["page_count"] == "3" and docs["a.pdf"].fonts == ["Helvetica"] and len(docs["a.pdf"].bookmarks) == 4
    assert docs["b.pdf"].metadata == {"page_count": "0", "is_pdf": "false", "needs_pass": "false"} and docs["b.pdf"].bookmarks == [] and docs["b.pdf"].fonts == []


def test_pdf_renderers_are_tried_in_order():
    kept = list(pdf._RENDERER)
    try:
        pdf._RENDERER[:] = []
        assert pdf.render(b"", 0, 72) is None
        pdf.register_renderer(lambda *_: 1 / 0)
        pdf.register_renderer(lambda *_: None)
        pdf.register_renderer(lambda d, p, dpi: PX)
        assert pdf.render(b"", 0, 72) is PX
    finally:
        pdf._RENDERER[:] = kept


BODY = [["a", 1, 2.5, True], [None, None, None, None], ["<&> ü\u0001", -3, None, False], ["", 0, 1e-7, None]]


def test_xlsx_round_trip(spark, tmp_path):
    p = str(tmp_path / "b.xlsx")
    open(p, "wb").write(xlsx.encode(["Name", "n", "x", "flag"], BODY, "Tasks"))
    got = xlsx.read(spark, p, "Tasks")
    assert got.columns == ["_row", "Name", "n", "x", "flag"]
    assert [tuple(r) for r in got.orderBy("_row").collect()] == [(2, "a", "1", "2.5", "TRUE"), (4, "<&> ü", "-3", None, "FALSE"), (5, "", "0", "1e-07", None)]
    cells = {(r.row, r.col): r.value for r in xlsx.read(spark, p, by_cell=True).collect()}
    assert cells[1, 1] == "Name" and cells[2, 4] == "TRUE" and (3, 1) not in cells


def test_xlsx_writer_keeps_order_and_update_keeps_the_rest(spark, tmp_path):
    a, b = str(tmp_path / "a.xlsx"), str(tmp_path / "b.xlsx")
    df = spark.range(5).selectExpr("concat('t', 4 - id) as task", "id as n").orderBy("task")
    xlsx.write(df, a)
    xlsx.update(a, b, {(2, 2): 99, (9, 3): "new", (3, 1): None})
    rows = dict(xlsx.rows(open(b, "rb").read(), "Task Summary"))
    assert rows[1] == ["task", "n"] and rows[2] == ["t0", "99"] and rows[3] == [None, "3"] and rows[4] == ["t2", "2"] and rows[9] == [None, None, "new"]
    assert dict(xlsx.rows(open(a, "rb").read()))[2] == ["t0", "4"]


def test_xlsx_errors(tmp_path):
    with pytest.raises(xlsx.WorkbookError):
        list(xlsx.cells(b"junk"))
    with pytest.raises(xlsx.WorkbookError):
        list(xlsx.cells(xlsx.encode(["a"], []), "other"))
    z = io.BytesIO()
    zipfile.ZipFile(z, "w").close()
    with pytest.raises(xlsx.WorkbookError):
        list(xlsx.cells(z.getvalue()))


@pytest.mark.parametrize("n, name", [(1, "A"), (26, "Z"), (27, "AA"), (702, "ZZ"), (703, "AAA")])
def test_columns(n, name):
    assert xlsx.column_name(n) == name and xlsx.column_number(name) == n


def test_sqlite(spark, tmp_path):
    p = str(tmp_path / "s.db")
    con = sqlite3.connect(p)
    con.execute("create table page_status (run_id text, page_num integer, score real, data_blob blob)")
    con.executemany("insert into page_status values (?, ?, ?, ?)", [(f"r{i}", i if i % 3 else None, i / 2, b"\x00" * i) for i in range(50)] + [("x", "no number", "no", "text")])
    con.execute("create table keyed (k text primary key, v integer) without rowid")
    con.execute("insert into keyed values ('a', 1)")
    con.execute("create table none (v integer)")
    con.commit()
    con.close()
    got = sqlite.read(spark, p, "page_status", 3)
    assert [f.dataType.simpleString() for f in got.schema.fields] == ["string", "bigint", "double", "binary"]
    rows = {r.run_id: r for r in got.collect()}
    assert len(rows) == 51 and rows["r4"].page_num == 4 and rows["r3"].page_num is None and len(rows["r7"].data_blob) == 7
    assert rows["x"].page_num is None and rows["x"].score is None and bytes(rows["x"].data_blob) == b"text"
    assert [tuple(r) for r in sqlite.read(spark, p, "keyed").collect()] == [("a", 1)]
    assert sqlite.read(spark, p, "none").count() == 0


def test_embedded_and_rendered_pictures(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(make())
    files = pdf.files(spark, str(tmp_path))
    scanned = pdf.scan(files)
    assert pdf.all_pictures(scanned, files).count() == 4
    page = np.full((842, 595, 3), 255, np.uint8)
    page[100:200, 50:150] = 0
    kept = list(pdf._RENDERER)
    try:
        pdf._RENDERER[:] = [lambda data, n, dpi: page if n == 1 else None]
        got = pdf.all_pictures(scanned, files, 72).where("xref = -1").collect()
    finally:
        pdf._RENDERER[:] = kept
    (r,) = got
    assert (r.page_num, r.x0, r.y0, r.x1, r.y1, r.width, r.height) == (1, 50, 100, 150, 200, 100, 100)


def test_pdf_code_maps_hold_wide_ranges_by_their_ends():
    codes, width = pdf._to_unicode(b"begincodespacerange <0000> <FFFF> endcodespacerange beginbfchar <0041> <0058> <0500> <0059> endbfchar beginbfrange <0000> <FFFF> <0000> <0100> <0101> <00660066> endbfrange")
    assert width == 2 and len(codes) < 256
    # what comes later in the map wins
    assert [codes[k] for k in (0x41, 0x500, 0xFF, 0x100, 0x101, 0xFFFF)] == ["A", "Ԁ", "ÿ", "ff", "fg", "￿"]
    with pytest.raises(ValueError):
        pdf._to_unicode(b"beginbfrange <0000> <FFFF> <DBFFDFFF> endbfrange")


def test_pdf_object_streams_are_decoded_once(monkeypatch):
    data, read, inner = make(pages=40), [], pdf.Document._stream_at
    monkeypatch.setattr(pdf.Document, "_stream_at", lambda doc, at: read.append(at) or inner(doc, at))
    doc = pdf.Document(data)
    assert len(doc.pages()) == 40 and len(doc.outline()) == 4 and doc.metadata()["author"] == "x"
    assert len(read) == len(set(read))


@pytest.mark.parametrize("compress", [True, False])
def test_pdf_texts_keep_every_character(compress):
    lines = ["(a) \\ b)(", "", "\r\t\\053", "ШЩ⠨屜⤀", "😀﻿￾", "(", "\\"]
    out = io.BytesIO()
    w = pdf.Writer(out, compress)
    w.add_page(595, 842, texts=[{"x": 10, "y": 20, "size": 8, "text": "\n".join(lines)}])
    w.close()
    (row,) = pdf.pages_of(out.getvalue(), "p")
    assert [s["text"] for s in row["spans"]] == [x for x in lines if x]
    assert [round(s["y1"], 3) for s in row["spans"]] == [round(20 + 9.6 * i, 3) for i, x in enumerate(lines) if x]
