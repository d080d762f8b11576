"""The task report: fill, clean, group, pivot, update."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions.text import strip
from leafmill.session import cut, numbered, table

SHEET = ("Process", "Task Name", "Task Date", "Completed On Time")


class ReportError(ValueError):
    """Input that a report cannot be made of."""


def trim_names(df: DataFrame) -> DataFrame:
    """Column names without outer blanks."""
    return df.toDF(*[c.strip() for c in df.columns])


def require_columns(df: DataFrame, needed: tuple[str, ...] | list[str]) -> DataFrame:
    """``df`` if it has the columns, else ReportError naming the missing ones."""
    if missing := sorted(set(needed) - set(df.columns)):
        raise ReportError(f"missing columns: {', '.join(missing)}")
    return df


def require_rows(df: DataFrame) -> DataFrame:
    """``df`` if it has a row, else ReportError."""
    if df.isEmpty():
        raise ReportError("no rows")
    return df


def forward_fill(df: DataFrame, order: str, value: str) -> DataFrame:
    """``value`` with nulls replaced by the last value before them in ``order``; leading nulls stay.

    No task sees all rows: they are partitioned by range of ``order``, each partition fills its own, and takes over the
    last value of the partitions before it, which are a row each.  Rows of equal order are ordered by value, nulls first.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()))
    own = Window.partitionBy("_part").orderBy(F.col(order).asc_nulls_first(), F.col(value).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    filled = ranged.withColumn("_own", F.last(value, ignorenulls=True).over(own))
    last = ranged.groupBy("_part").agg(F.max(F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))["v"].alias("_last"))
    carry = last.select("_part", F.last("_last", ignorenulls=True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    out = filled.join(F.broadcast(carry), "_part", "left")  # a row per partition
    return out.withColumn(value, F.coalesce("_own", "_carry")).select(*df.columns)


def not_blank(c: str) -> Column:
    """Neither null nor blank."""
    return F.col(c).isNotNull() & (strip(c) != "")


def no_totals(c: str) -> Column:
    """Not a subtotal row: the text does not begin with Total, case and leading blanks counting."""
    return ~F.coalesce(F.col(c).startswith("Total"), F.lit(False))


def status(c: str) -> Column:
    """Stripped and in capitals; null is NAN, as text made of a missing cell is."""
    return F.coalesce(F.upper(strip(c)), F.lit("NAN"))


def count_pivot(rows: DataFrame, keys: list[str], st: str) -> DataFrame:
    """keys, DelayedCount, OnTimeCount; a group that has other states only stays with zeros."""
    counts = rows.groupBy(*keys).pivot(st, ["DELAYED", "ON TIME"]).count().na.fill(0, ["DELAYED", "ON TIME"])
    return counts.select(*keys, F.col("DELAYED").alias("DelayedCount"), F.col("ON TIME").alias("OnTimeCount"))


def by_process(sheet: DataFrame, row: str = "_row") -> DataFrame:
    """ProcessGroupName, Task Name, DelayedCount, OnTimeCount of a task sheet, in the order of the report's steps."""
    rows = forward_fill(require_columns(trim_names(sheet), SHEET), row, "Process")
    rows = rows.where(not_blank("Task Name")).where(no_totals("Process"))
    rows = rows.select(F.coalesce(strip("Process"), F.lit("nan")).alias("ProcessGroupName"), strip("Task Name").alias("Task Name"), status("Completed On Time").alias("st"))
    return count_pivot(rows, ["ProcessGroupName", "Task Name"], "st").orderBy("ProcessGroupName", "Task Name")


def flat(sheet: DataFrame, total: bool = False) -> DataFrame:
    """Task Name (not trimmed), DelayedCount, OnTimeCount, and TotalTasks where asked for."""
    rows = require_columns(trim_names(sheet), SHEET[1:]).where(not_blank("Task Name")).select("Task Name", status("Completed On Time").alias("st"))
    got = count_pivot(rows, ["Task Name"], "st")
    if total:
        got = got.withColumn("TotalTasks", F.col("DelayedCount") + F.col("OnTimeCount"))
    return got.orderBy("Task Name")


def lookup(summary: DataFrame, order: list[str]) -> DataFrame:
    """(task, total, delayed): one row per trimmed task, the last in ``order`` where several share it."""
    last = F.max(F.struct(*[F.col(c) for c in order], F.col("DelayedCount").alias("d"), F.col("OnTimeCount").alias("o"))).alias("x")
    return summary.groupBy(strip("Task Name").alias("task")).agg(last).select("task", (F.col("x.d") + F.col("x.o")).alias("total"), F.col("x.d").alias("delayed"))


def mis_update(sheet: DataFrame, look: DataFrame, key: str, total: str, delayed: str) -> DataFrame:
    """``sheet`` with the cells ``total`` and ``delayed`` of the rows whose trimmed key is in ``look`` replaced, and ``updated``.

    The look-up has a row per task; Spark broadcasts it where its measured size allows and joins by hash or sort beyond.
    """
    got = sheet.withColumn("_key", strip(key)).join(look.withColumnsRenamed({"total": "_t", "delayed": "_d"}), F.col("_key") == F.col("task"), "left")
    return got.select(
        *[F.coalesce("_t", c).alias(c) if c == total else F.coalesce("_d", c).alias(c) if c == delayed else F.col(c) for c in sheet.columns],
        F.col("task").isNotNull().alias("updated"),
    )


def run_report(sheet: DataFrame, mis: DataFrame, key: str = "c", total: str = "e", delayed: str = "j") -> tuple[DataFrame, DataFrame]:
    """(summary with totals, updated workbook); ReportError for an empty sheet, or where no row of the workbook is updated."""
    summary = flat(require_rows(sheet), total=True)
    updated = mis_update(mis, lookup(summary, ["Task Name"]), key, total, delayed)
    if updated.where("updated").isEmpty():
        raise ReportError("no matching task in the workbook")
    return summary, updated


# --- queries -------------------------------------------------------------------------------------------------------


def task_sheet(spark: SparkSession, d: str) -> DataFrame:
    """A task sheet of every line item: the segment as process, the priority as task, its shipping as status."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    st = F.expr("case when l_linenumber = 7 then null when l_linenumber = 6 then 'Late' when l_shipdate <= o_orderdate + interval 60 days then ' On Time ' else 'Delayed' end")
    task = F.expr("case when l_linenumber % 2 = 0 then concat('  ', o_orderpriority, ' ') when l_linenumber = 5 then ' ' else o_orderpriority end")
    return (
        li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey"))
        .select(F.col("c_mktsegment").alias("Process"), task.alias(" Task Name "), F.col("o_orderdate").cast("string").alias("Task Date"), st.alias("Completed On Time"))
    )


SHEET_SQL = """task_sheet as (
  select c_mktsegment as process,
    case when l_linenumber % 2 = 0 then concat('  ', o_orderpriority, ' ') when l_linenumber = 5 then ' ' else o_orderpriority end as task,
    case when l_linenumber = 7 then null when l_linenumber = 6 then 'Late' when l_shipdate <= o_orderdate + interval 60 days then ' On Time ' else 'Delayed' end as st
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey)"""


def gap_sheet(spark: SparkSession, d: str) -> DataFrame:
    """A sheet with gaps, of every event in order: processes at some rows only, subtotals, header rows without task."""
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("_row"),
        F.expr("case when event_id % 50 = 1 then concat('Total ', event_type) when event_id % 7 = 0 then concat(' ', event_type) end").alias("Process"),
        F.expr("case when event_id % 7 = 0 then null when event_id % 11 = 0 then '  ' else concat(' task ', cast(event_id % 5 as string), ' ') end").alias("Task Name"),
        F.col("ts").cast("string").alias("Task Date"),
        F.expr("case when event_id % 13 = 0 then null when value < 20 then ' delayed' when value < 60 then 'On Time ' else 'open' end").alias("Completed On Time"),
    )


GAP_SQL = """gap_sheet as (
  select event_id as rn,
    case when event_id % 50 = 1 then concat('Total ', event_type) when event_id % 7 = 0 then concat(' ', event_type) end as process,
    case when event_id % 7 = 0 then null when event_id % 11 = 0 then '  ' else concat(' task ', cast(event_id % 5 as varchar), ' ') end as task,
    case when event_id % 13 = 0 then null when value < 20 then ' delayed' when value < 60 then 'On Time ' else 'open' end as st
  from events), filled as (select rn, last_value(process ignore nulls) over (order by rn rows unbounded preceding) as process, task, st from gap_sheet)"""
BY_SQL = f"""{GAP_SQL}, clean as (select coalesce(trim(process), 'nan') as process, trim(task) as task, coalesce(upper(trim(st)), 'NAN') as st
  from filled where task is not null and trim(task) <> '' and not coalesce(starts_with(process, 'Total'), false)),
  by_process as (select process as "ProcessGroupName", task as "Task Name", count(*) filter (where st = 'DELAYED') as "DelayedCount", count(*) filter (where st = 'ON TIME') as "OnTimeCount" from clean group by 1, 2)"""
FLAT_SQL = f"""{SHEET_SQL}, flat as (select task as "Task Name", count(*) filter (where upper(trim(st)) = 'DELAYED') as "DelayedCount",
  count(*) filter (where upper(trim(st)) = 'ON TIME') as "OnTimeCount" from task_sheet where task is not null and trim(task) <> '' group by 1)"""


def mis_sheet(spark: SparkSession, d: str) -> DataFrame:
    """A workbook's cells, a row per part, with task names in some keys."""
    p = table(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("row"),
        F.expr("case p_partkey % 9 when 0 then '1-URGENT' when 1 then '  2-HIGH ' when 2 then '5-LOW' when 3 then 'task 3' when 4 then null else p_name end").alias("c"),
        F.col("p_size").cast("long").alias("e"), (F.col("p_size") * 2).cast("long").alias("g"), (F.col("p_size") + 7).cast("long").alias("j"),
    )


MIS_SQL = """mis as (select p_partkey as "row", case p_partkey % 9 when 0 then '1-URGENT' when 1 then '  2-HIGH ' when 2 then '5-LOW' when 3 then 'task 3' when 4 then null else p_name end as c,
  p_size::bigint as e, (p_size * 2)::bigint as g, (p_size + 7)::bigint as j from part)"""


def task_summary_by_process(spark, d):
    """Counts by process and task of the sheet with gaps."""
    return by_process(gap_sheet(spark, d))


def task_summary_flat(spark, d):
    """Counts by untrimmed task."""
    return flat(task_sheet(spark, d))


def task_summary_total(spark, d):
    """Counts by untrimmed task, with totals."""
    return flat(task_sheet(spark, d), total=True)


def process_ffill(spark, d):
    """The filled process of every row."""
    return forward_fill(gap_sheet(spark, d).select("_row", "Process"), "_row", "Process").select(F.col("_row").alias("row_num"), F.col("Process").alias("process"))


def drop_total_rows(spark, d):
    """Rows by process without subtotals."""
    return gap_sheet(spark, d).where(no_totals("Process")).groupBy(F.col("Process").alias("process")).agg(F.count("*").alias("n"))


def nonblank_filter(spark, d):
    """Rows whose task is neither null nor blank."""
    return gap_sheet(spark, d).where(not_blank("Task Name")).select(F.col("_row").alias("row_num"), F.col("Task Name").alias("task"))


def status_normalise(spark, d):
    """Rows by normalised process and status."""
    g = gap_sheet(spark, d)
    return g.groupBy(strip("Process").alias("process"), status("Completed On Time").alias("st")).agg(F.count("*").alias("n"))


def status_long_counts(spark, d):
    """Rows by process, task and status."""
    s = trim_names(task_sheet(spark, d)).where(not_blank("Task Name"))
    return s.groupBy(strip("Process").alias("process"), strip("Task Name").alias("task"), status("Completed On Time").alias("st")).agg(F.count("*").alias("n"))


def status_pivot(spark, d):
    """Rows by process and task, a column per status."""
    s = trim_names(task_sheet(spark, d)).where(not_blank("Task Name"))
    rows = s.select(strip("Process").alias("process"), strip("Task Name").alias("task"), status("Completed On Time").alias("st"))
    return count_pivot(rows, ["process", "task"], "st").select("process", "task", F.col("DelayedCount").alias("delayed"), F.col("OnTimeCount").alias("on_time"))


def summary_index(spark, d):
    """The flat summary with its index from 0 in order of task."""
    return numbered(flat(task_sheet(spark, d)), ["Task Name"], "idx").select("idx", F.col("Task Name").alias("task"))


def summary_lookup_last_wins(spark, d):
    """Totals by trimmed task; of untrimmed twins the last in order counts."""
    return lookup(flat(task_sheet(spark, d)), ["Task Name"])


def mis_update_q(spark, d):
    """The workbook updated from the summary by process, columns e and g."""
    look = lookup(by_process(gap_sheet(spark, d)), ["ProcessGroupName", "Task Name"])
    return mis_update(mis_sheet(spark, d).drop("j"), look, "c", "e", "g")


def mis_update_v2(spark, d):
    """The workbook updated from the flat summary, columns e and j."""
    return mis_update(mis_sheet(spark, d).drop("g"), lookup(flat(task_sheet(spark, d)), ["Task Name"]), "c", "e", "j")


def mis_updated_rows(spark, d):
    """How many rows of the workbook are updated, and how many not."""
    return mis_update_v2(spark, d).groupBy("updated").agg(F.count("*").alias("n"))


def summary_unpivot(spark, d):
    """The flat summary as one row per task and metric."""
    s = flat(task_sheet(spark, d), total=True)
    return s.unpivot(["Task Name"], ["DelayedCount", "OnTimeCount", "TotalTasks"], "metric", "val").select(F.col("Task Name").alias("task"), "metric", "val")


QUERIES = {f.__name__.removesuffix("_q"): f for f in (
    task_summary_by_process, task_summary_flat, task_summary_total, process_ffill, drop_total_rows, nonblank_filter, status_normalise,
    status_long_counts, status_pivot, summary_index, summary_lookup_last_wins, mis_update_q, mis_update_v2, mis_updated_rows, summary_unpivot,
)}
_UPDATE = 'select "row", c, coalesce(t, e) as e, coalesce(dl, {0}) as {0}, k is not null as updated from mis left join look on trim(c) = k'
_LAST = "look as (select k, dl + o as t, dl from (select trim(\"Task Name\") as k, \"DelayedCount\" as dl, \"OnTimeCount\" as o, row_number() over (partition by trim(\"Task Name\") order by {0}) as r from {1}) where r = 1)"
_LOOK_FLAT = _LAST.format('"Task Name" desc', "flat")
SQL = {
    "task_summary_by_process": f"with {BY_SQL} select * from by_process",
    "task_summary_flat": f"with {FLAT_SQL} select * from flat",
    "task_summary_total": f'with {FLAT_SQL} select *, "DelayedCount" + "OnTimeCount" as "TotalTasks" from flat',
    "process_ffill": f"with {GAP_SQL} select rn as row_num, process from filled",
    "drop_total_rows": f"with {GAP_SQL} select process, count(*) as n from gap_sheet where not coalesce(starts_with(process, 'Total'), false) group by 1",
    "nonblank_filter": f"with {GAP_SQL} select rn as row_num, task from gap_sheet where task is not null and trim(task) <> ''",
    "status_normalise": f"with {GAP_SQL} select trim(process) as process, coalesce(upper(trim(st)), 'NAN') as st, count(*) as n from gap_sheet group by 1, 2",
    "status_long_counts": f"with {SHEET_SQL} select trim(process) as process, trim(task) as task, coalesce(upper(trim(st)), 'NAN') as st, count(*) as n from task_sheet where trim(task) <> '' group by 1, 2, 3",
    "status_pivot": f"with {SHEET_SQL} select trim(process) as process, trim(task) as task, count(*) filter (where upper(trim(st)) = 'DELAYED') as delayed, count(*) filter (where upper(trim(st)) = 'ON TIME') as on_time from task_sheet where trim(task) <> '' group by 1, 2",
    "summary_index": f'with {FLAT_SQL} select row_number() over (order by "Task Name") - 1 as idx, "Task Name" as task from flat',
    "summary_lookup_last_wins": f"with {FLAT_SQL}, {_LOOK_FLAT} select k as task, t as total, dl as delayed from look",
    "mis_update": f'with {BY_SQL}, {MIS_SQL}, {_LAST.format(chr(34) + "ProcessGroupName" + chr(34) + " desc", "by_process")} {_UPDATE.format("g")}',
    "mis_update_v2": f"with {FLAT_SQL}, {MIS_SQL}, {_LOOK_FLAT} {_UPDATE.format('j')}",
    "mis_updated_rows": f"with {FLAT_SQL}, {MIS_SQL}, {_LOOK_FLAT} select k is not null as updated, count(*) as n from mis left join look on trim(c) = k group by 1",
    "summary_unpivot": f'with {FLAT_SQL}, t as (select *, "DelayedCount" + "OnTimeCount" as "TotalTasks" from flat) select "Task Name" as task, metric, val from t unpivot (val for metric in ("DelayedCount", "OnTimeCount", "TotalTasks"))',
}
