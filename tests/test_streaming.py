import datetime as dt

from leafmill.sources import pdf
from leafmill.streaming import follow


def read(spark, target):
    return sorted((r.path[-5:], r.error is None) for r in spark.read.parquet(target).collect())


def test_each_file_is_processed_once(spark, tmp_path):
    folder, target = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    name = f"q{tmp_path.name.replace('-', '_')}{id(folder)}"

    def go():
        q = follow.each_batch(follow.files(spark, str(folder), per_batch=1), name, lambda b: pdf.scan(b).select("path", "error"), target)
        q.awaitTermination()

    (folder / "a.pdf").write_bytes(b"junk")
    (folder / "b.pdf").write_bytes(b"junk")
    (folder / "c.txt").write_bytes(b"junk")
    go()
    assert read(spark, target) == [("a.pdf", False), ("b.pdf", False)]
    (folder / "d.pdf").write_bytes(b"junk")
    go()
    go()
    assert read(spark, target) == [("a.pdf", False), ("b.pdf", False), ("d.pdf", False)]


def test_status_counts(spark, tmp_path):
    t = dt.datetime(2030, 1, 1, 12)
    rows = [("r", "f", 1, " DONE", t), ("r", "f", 1, "done ", t), ("r", "f", 2, "done", t), ("r", "f", 2, "error", t + dt.timedelta(days=1)), ("r", "g", 1, "done", t + dt.timedelta(days=30))]
    kinds = "run_id string, pdf_path string, page_num int, status string, updated_at timestamp_ntz"
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema(kinds).parquet(f"{tmp_path}/log")
    q = follow.status_counts(stream).writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.day.date().isoformat(), r.status): r.n for r in spark.table("counts").collect()}
    assert got == {("2030-01-01", "done"): 2, ("2030-01-02", "error"): 1}
