import pytest

from leafmill.operators import report
from leafmill.plans import run
from leafmill.sources import xlsx

SHEET = [
    (2, None, None, "d", "On Time"), (3, "Alpha", None, None, None), (4, None, " t1 ", "d", " on time "), (5, None, "t1", "d", "Delayed"), (6, "Total Alpha", "t9", "d", "Delayed"),
    (7, " Total", "t2", "d", "DELAYED"), (8, "Beta", "  ", "d", "On Time"), (9, None, "t2", "d", None), (10, None, "t3", None, "late"),
]
NAMES = ["_row", " Process ", "Task Name", "Task Date", "Completed On Time "]
KINDS = "`_row` long, ` Process ` string, `Task Name` string, `Task Date` string, `Completed On Time ` string"


@pytest.fixture
def sheet(spark):
    return spark.createDataFrame(SHEET, KINDS)


def test_trimmed_names(sheet):
    assert report.trim_names(sheet).columns == [n.strip() for n in NAMES]


def test_missing_columns_are_named(spark, sheet):
    with pytest.raises(report.ReportError, match="Process, Task Date"):
        report.require_columns(report.trim_names(sheet).drop("Process", "Task Date"), report.SHEET)
    assert report.require_columns(report.trim_names(sheet), report.SHEET) is not None


def test_no_rows(sheet):
    with pytest.raises(report.ReportError):
        report.require_rows(sheet.where("false"))


def test_forward_fill_over_partitions(spark):
    n = 500
    df = spark.range(n).selectExpr("id as _row", "case when id % 37 = 5 then concat('g', id) end as v").repartition(13)
    got = [r.v for r in report.forward_fill(df, "_row", "v").orderBy("_row").collect()]
    want, last = [], None
    for i in range(n):
        last = f"g{i}" if i % 37 == 5 else last
        want.append(last)
    assert got == want


def test_by_process(sheet):
    got = [tuple(r) for r in report.by_process(sheet).collect()]
    assert got == [("Alpha", "t1", 1, 1), ("Beta", "t2", 0, 0), ("Beta", "t3", 0, 0), ("Total", "t2", 1, 0)]


def test_flat_keeps_untrimmed_twins(sheet):
    got = {r["Task Name"]: (r.DelayedCount, r.OnTimeCount, r.TotalTasks) for r in report.flat(sheet, total=True).collect()}
    assert got == {" t1 ": (0, 1, 1), "t1": (1, 0, 1), "t9": (1, 0, 1), "t2": (1, 0, 1), "t3": (0, 0, 0)}


def test_mis_update_keeps_unmatched(spark, sheet):
    look = report.lookup(report.flat(sheet, total=True), ["Task Name"])
    mis = spark.createDataFrame([(1, " t2 ", 5, 6), (2, None, 7, 8), (3, "zz", 9, 10), (4, "t2", 0, 0)], "row int, c string, e long, j long")
    got = {r.row: (r.e, r.j, r.updated) for r in report.mis_update(mis, look, "c", "e", "j").collect()}
    assert got == {1: (1, 1, True), 2: (7, 8, False), 3: (9, 10, False), 4: (1, 1, True)}


def books(tmp_path, tasks, keys):
    a, b = str(tmp_path / "tasks.xlsx"), str(tmp_path / "mis.xlsx")
    open(a, "wb").write(xlsx.encode([n.strip() for n in NAMES[1:]], tasks))
    open(b, "wb").write(xlsx.encode(["x", "y", "Task"], [[None, None, k, None, 0, None, None, None, None, 0] for k in keys], "MIS"))
    return a, b, str(tmp_path / "summary.xlsx"), str(tmp_path / "out.xlsx")


def test_report_on_files(spark, tmp_path):
    paths = books(tmp_path, [list(r[1:]) for r in SHEET], ["t2", " t1", "zz"])
    assert run.run_task_report(spark, *paths) == 2
    summary = dict(xlsx.rows(open(paths[2], "rb").read(), "Task Summary"))
    assert summary[1] == ["Task Name", "DelayedCount", "OnTimeCount", "TotalTasks"] and ["t2", "1", "0", "1"] in summary.values()
    out = dict(xlsx.rows(open(paths[3], "rb").read(), "MIS"))
    assert (out[2][4], out[2][9]) == ("1", "1") and out[3][4] == "1" and out[4][4] == "0"
    assert run.main(["report", *paths], spark) == 0


def test_report_without_a_match_fails(spark, tmp_path):
    paths = books(tmp_path, [list(r[1:]) for r in SHEET], ["other"])
    with pytest.raises(report.ReportError):
        run.run_task_report(spark, *paths)
    assert run.main(["report", *paths], spark) == 1


def test_report_errors_of_files(spark, tmp_path):
    assert run.main(["report", str(tmp_path / "none.xlsx"), "b", "c", "d"], spark) == 1
    paths = books(tmp_path, [], ["t1"])
    with pytest.raises(report.ReportError):
        run.run_task_report(spark, *paths)
