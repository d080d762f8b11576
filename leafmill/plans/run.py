"""Whole runs over files: extract, recognise, correct, rebuild, report; one job for a folder, errors as rows."""

from __future__ import annotations

import argparse
import datetime as dt
import io
import json
import logging
import os
import signal
import threading
import time
import uuid
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill import config
from leafmill.functions import imaging
from leafmill.operators import quality, report, state
from leafmill.session import cut, local_session
from leafmill.sources import pdf, xlsx

log = logging.getLogger(__name__)
C = F.col
#: Recognised pages have fewer native characters than this in all.
SCANNED = 50
REPORT = "path string, output string, page_num int, images long, diagrams long, tables long, ocr_blocks long, seconds double, error string"
_stop = threading.Event()


def request_stop(*_: object) -> None:
    """Asks a run to end after what it is at; also as a signal handler."""
    _stop.set()


def handle_signals() -> None:
    """Interrupt and terminate ask for a stop instead of ending the process."""
    for s in (signal.SIGINT, signal.SIGTERM):
        signal.signal(s, request_stop)


def extract(spark: SparkSession, folder: str, pattern: str = "*.pdf", pages: str | None = None) -> DataFrame:
    """Pages of all files of a folder that match (pdf.PAGE_SCHEMA), with error rows for what cannot be read."""
    return pdf.scan(pdf.files(spark, folder, pattern), pages)


def keep_picture(p: dict, width: float, height: float, has_render: bool, full_pages: bool = False) -> bool:
    """``pages.skip_block`` for one picture."""
    if p.get("xref") == -1:
        return False
    if not has_render:
        return True
    frac = max(0.0, (p["x1"] - p["x0"]) * (p["y1"] - p["y0"])) / (width * height) if width * height else 0.0
    return frac <= 0.6 or full_pages


def build_page(writer: pdf.Writer, row: dict, data: bytes | None, cfg: config.Config, text: str | None, scanned: bool) -> dict:
    """Adds one page to a file being written; gives its counters. A picture that fails is tried once more from the render, then left out."""
    scale = cfg.pipeline.output_dpi / 72
    w, h = row["width"], row["height"]
    img = pdf.render(data, row["page_num"], cfg.extraction.render_dpi) if data is not None else None
    if img is not None and scanned:
        try:
            img = imaging.enhance_render(img, cfg.enhancement)
        except Exception:
            log.debug("render of page %s not enhanced", row["page_num"])
    images = diagrams = 0
    placed = []
    for p in row["pictures"] if row["pictures"] is not None else []:
        if not keep_picture(p, w, h, img is not None):
            continue
        box = {k: p[k] * scale for k in ("x0", "y0", "x1", "y1")}
        box = {"x0": max(0.0, box["x0"]), "y0": max(0.0, box["y0"]), "x1": min(w * scale, box["x1"]), "y1": min(h * scale, box["y1"])}
        if box["x0"] >= box["x1"] or box["y0"] >= box["y1"]:
            continue
        part = imaging.crop(img, p["x0"], p["y0"], p["x1"], p["y1"], w, h) if img is not None else None
        source = imaging.normalise(p["data"], part)
        try:
            better = imaging.enhance(source, p["width"], p["height"], cfg=cfg.enhancement)
            images += 1
            diagrams += better.is_diagram
            embed = better.data
        except Exception:
            embed = source
        if (embed := imaging.normalise(embed, source)) is not None:
            placed.append(box | {"data": embed})
    texts = []
    if cfg.pipeline.embed_searchable_text:
        spans = row["spans"] if row["spans"] is not None else []
        texts = [{"x": s["x0"] * scale, "y": s["y1"] * scale, "size": max(s["font_size"] * scale * 0.9, 1.0), "text": s["text"]} for s in spans if s["text"].strip()]
        if not texts and text and text.strip():
            texts = [{"x": 0.0, "y": 8.0, "size": 8.0, "text": text}]
    tables = row.get("tables") if row.get("tables") is not None else []
    writer.add_page(w * scale, h * scale, img, placed, texts, [_scaled(t, scale) for t in tables])
    return {"images": images, "diagrams": diagrams, "tables": len(tables), "ocr_blocks": int(bool(text and text.strip()))}


def _scaled(t: dict, s: float) -> dict:
    """A table (x0, y0, x1, y1, data) as grid lines and cell texts."""
    rows = [list(r) for r in t["data"]]
    n, m = max(1, len(rows)), max([1, *map(len, rows)])
    x0, y0, w, h = t["x0"] * s, t["y0"] * s, (t["x1"] - t["x0"]) * s / m, (t["y1"] - t["y0"]) * s / n
    lines = [(x0, y0 + i * h, x0 + m * w, y0 + i * h) for i in range(n + 1)] + [(x0 + j * w, y0, x0 + j * w, y0 + n * h) for j in range(m + 1)]
    cells = [{"x": x0 + j * w + 2, "y": y0 + i * h + h * 0.7, "size": max(h * 0.5, 1.0), "text": str(c)} for i, r in enumerate(rows) for j, c in enumerate(r) if c not in (None, "", 0, False)]
    return {"lines": lines, "texts": cells}


def rebuild(pages: DataFrame, binary: DataFrame, out_dir: str, cfg: config.Config, texts: DataFrame | None = None) -> DataFrame:
    """Writes a file a document below ``out_dir`` (a folder all workers share); rows of REPORT.

    pages: pdf.PAGE_SCHEMA; texts: (path, page_num, text) recognised.  A document's pages meet in one task, in order, and leave
    it one by one into the file, which appears under its name when it is whole; a retried task writes it again.
    """
    os.makedirs(out_dir, exist_ok=True)
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pages.join(texts, ["path", "page_num"], "left") if texts is not None else pages.withColumn("text", F.lit(None).cast("string"))
    native = pages.select("path", F.aggregate(F.coalesce("spans", F.array()), F.lit(0), lambda a, s: a + F.length(s["text"])).alias("n")).groupBy("path").agg((F.sum("n") < SCANNED).alias("scanned"))
    rows = rows.join(native, "path", "left")
    if pdf._RENDERER:
        rows = rows.join(binary.select("path", "content"), "path", "left")
    else:
        rows = rows.withColumn("content", F.lit(None).cast("binary"))
    rows = rows.repartition(parts, "path").sortWithinPartitions("path", F.col("page_num").asc_nulls_last())
    kept, renderers = imaging.registered(), list(pdf._RENDERER)

    def run(batches):
        imaging.register(kept)
        pdf._RENDERER[:] = renderers
        now, writer, target, stream, meta, marks, began = None, None, "", None, None, None, time.time()

        def end():
            if writer is not None:
                writer.close(meta, marks)
                stream.close()
                os.replace(f"{target}.part", target)

        for b in batches:
            out = []
            for r in b.to_dict("records"):
                if r["path"] != now:
                    end()
                    now, writer = r["path"], None
                began = time.time()
                target = os.path.join(out_dir, Path(r["path"]).stem + cfg.pipeline.output_suffix + ".pdf")
                got, error = {"images": 0, "diagrams": 0, "tables": 0, "ocr_blocks": 0}, r["error"]
                if not isinstance(error, str):
                    try:
                        if writer is None:
                            stream = open(f"{target}.part", "wb")
                            writer = pdf.Writer(stream, cfg.pipeline.compress_output)
                            meta, marks = dict(r["metadata"] or {}), [(m["level"], m["title"], m["page"]) for m in (r["bookmarks"] if r["bookmarks"] is not None else [])]
                        got = build_page(writer, r, r["content"], cfg, r["text"] if isinstance(r["text"], str) else None, bool(r["scanned"]))
                        error = None
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                num = None if r["page_num"] is None or r["page_num"] != r["page_num"] else int(r["page_num"])
                out.append({"path": r["path"], "output": target, "page_num": num, **got, "seconds": time.time() - began, "error": error})
            yield pd.DataFrame(out, columns=[x.split()[0] for x in REPORT.split(", ")]).astype({"page_num": "Int32"})
        end()

    return rows.mapInPandas(run, REPORT)


def run_folder(spark: SparkSession, folder: str, out_dir: str, cfg: config.Config | None = None, pattern: str = "*.pdf", texts: DataFrame | None = None) -> list[dict]:
    """All files of a folder rebuilt in one job; a report a file in order of path, a file that failed with its error and no output.

    With checkpoints on, extractions are kept below pipeline.checkpoint_db and runs entered there.  A requested stop ends it
    after extraction, with no report.
    """
    cfg = cfg or config.Config()
    _stop.clear()
    binary = pdf.files(spark, folder, pattern)
    if binary.isEmpty():
        log.warning("no files in %s match %s", folder, pattern)
        return []
    pages = cut(pdf.scan(binary, cfg.pipeline.pages))
    store = state.Store(spark, cfg.pipeline.checkpoint_db) if cfg.pipeline.enable_checkpoint else None
    run_id, now = uuid.uuid4().hex, dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    if store:
        store.save(folder, pages, now)
        store.start(run_id, folder, now)
    if _stop.is_set():
        log.warning("stopped after extraction")
        if store:
            store.finish(run_id, now, False, 0)
        return []
    rows = cut(rebuild(pages, binary, out_dir, cfg, texts))
    total = quality.rollup(rows.where("error is null"), "path")
    seconds = rows.groupBy("path").agg(F.round(F.sum("seconds"), 2).alias("seconds"), F.max("output").alias("output"), F.max("error").alias("error"))
    got = seconds.join(total, "path", "left").orderBy("path")
    reports = []
    for r in got.toLocalIterator():  # a row a file
        whole = r.pages_processed is not None
        item = {
            "source": r.path, "output": r.output if whole else None, "pages_processed": r.pages_processed or 0, "total_images_enhanced": r.images or 0, "total_diagrams_vectorized": r.diagrams or 0,
            "total_tables_embedded": r.tables or 0, "total_ocr_blocks": r.ocr_blocks or 0, "processing_time_seconds": r.seconds, "error": r.error,
        }
        reports.append(item)
        if whole and cfg.pipeline.save_report:
            per = [{"page": p.page_num + 1, "images": p.images, "diagrams": p.diagrams, "tables": p.tables, "ocr_blocks": p.ocr_blocks} for p in rows.where((C("path") == r.path) & C("error").isNull()).orderBy("page_num").toLocalIterator()]
            Path(r.output).with_suffix(".quality_report.json").write_text(json.dumps({k: v for k, v in item.items() if k != "error"} | {"per_page": per}, indent=2))
    if store:
        store.finish(run_id, dt.datetime.now(dt.timezone.utc).replace(tzinfo=None), all(r["error"] is None for r in reports), sum(r["pages_processed"] for r in reports))
    return reports


def run_file(spark: SparkSession, path: str, out_dir: str = "out", cfg: config.Config | None = None) -> dict | None:
    """One file rebuilt; its report, None after a requested stop. FileNotFoundError where there is none."""
    if not Path(path).exists():
        raise FileNotFoundError(path)
    got = run_folder(spark, str(Path(path).parent), out_dir, cfg, Path(path).name)
    return got[0] if got else None


def run_task_report(spark: SparkSession, sheet: str, mis: str, summary_out: str, mis_out: str, total: str = "E", delayed: str = "J", key: str = "C") -> int:
    """The task report on workbooks: summary written, cells of the second workbook updated in a copy; gives the rows updated.

    ReportError for missing columns, an empty sheet, no matching task; OSError and WorkbookError for files that cannot be read.
    Workbooks have a sheet's rows at most, so the updates reach the driver.
    """
    tasks = xlsx.read(spark, sheet)
    summary = report.flat(report.require_rows(report.require_columns(report.trim_names(tasks), report.SHEET[1:])), total=True)
    summary = cut(summary).orderBy("Task Name")
    look = report.lookup(summary, ["Task Name"])
    cells = xlsx.read(spark, mis, by_cell=True).where(C("col") == xlsx.column_number(key))
    hits = cells.withColumn("task", report.strip("value")).join(look, "task").select("row", "total", "delayed").collect()
    if not hits:
        raise report.ReportError("no matching task in the workbook")
    xlsx.write(summary, summary_out)
    t, d = xlsx.column_number(total), xlsx.column_number(delayed)
    xlsx.update(mis, mis_out, {(r.row, c): v for r in hits for c, v in ((t, r.total), (d, r.delayed))})
    return len(hits)


def _arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="leafmill")
    sub = p.add_subparsers(dest="command", required=True)
    one = sub.add_parser("enhance", help="rebuild one file")
    one.add_argument("input")
    many = sub.add_parser("batch", help="rebuild all files of a folder")
    many.add_argument("input")
    many.add_argument("--pattern", default="*.pdf")
    for s in (one, many):
        s.add_argument("-o", "--output", default="out", help="folder of the results")
        s.add_argument("-c", "--config", default="config.yaml")
        s.add_argument("--dpi", type=int)
        s.add_argument("--pages")
        s.add_argument("--workers", type=int)
        s.add_argument("--api-key")
        for flag in ("no-sr", "no-ocr", "no-ai", "no-vectorize"):
            s.add_argument(f"--{flag}", action="store_true")
    conf = sub.add_parser("config", help="write the default settings")
    conf.add_argument("--save", default="config.yaml")
    rep = sub.add_parser("report", help="task summary and workbook update")
    for name in ("sheet", "mis", "summary_out", "mis_out"):
        rep.add_argument(name)
    return p


def settings(a: argparse.Namespace) -> config.Config:
    """The file's settings with those of the command line over them."""
    cfg = config.load(a.config)
    if a.dpi:
        cfg.pipeline.output_dpi = a.dpi
    if a.pages:
        cfg.pipeline.pages = a.pages
    if a.workers:
        cfg.pipeline.workers = a.workers
    if a.api_key:
        cfg.api.anthropic_api_key = a.api_key
    if a.no_sr:
        cfg.enhancement.enable_super_resolution = False
    if a.no_ocr or a.no_ai:
        cfg.ocr.enable_ai_correction = False
    if a.no_ai:
        cfg.diagram.enable_ai_analysis = False
    if a.no_vectorize:
        cfg.diagram.enable_vectorization = False
    return cfg


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """The command line; 1 on any error, as its last line says."""
    a = _arguments().parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    try:
        if a.command == "config":
            config.Config().write(a.save)
            return 0
        if a.command == "report":
            run_task_report(spark or local_session(), a.sheet, a.mis, a.summary_out, a.mis_out)
            return 0
        handle_signals()
        cfg = settings(a)
        spark = spark or local_session(cfg.pipeline.workers)
        got = [run_file(spark, a.input, a.output, cfg)] if a.command == "enhance" else run_folder(spark, a.input, a.output, cfg, a.pattern)
        out = io.StringIO()
        for r in filter(None, got):
            print(f"{r['source']}: {r['error'] or r['output']} ({r['pages_processed']} pages, {r['processing_time_seconds']} s)", file=out)
        log.info("%s", out.getvalue())
        return int(a.command == "enhance" and bool(got[0] and got[0]["error"]))
    except Exception as e:
        log.error("%s: %s", type(e).__name__, e)
        return 1


if __name__ == "__main__":
    raise SystemExit(main())
