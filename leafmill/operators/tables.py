"""Table blocks: duplicates, union of sources, grid layout, empty cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.session import table


def cell_key(data: Column | str) -> Column:
    """What two tables with the same cells share."""
    return F.md5(F.to_json(data))


def keep_best(tables: DataFrame, page: list[str], data: str = "data") -> DataFrame:
    """Per page and cells the table with the best accuracy, the first (tbl_ord) on ties; null accuracy comes last."""
    w = Window.partitionBy(*page, "_key").orderBy(F.col("accuracy").desc_nulls_last(), "tbl_ord", "method")
    return tables.withColumn("_key", cell_key(data)).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_key", "_rn")


def union_sources(*sources: DataFrame) -> DataFrame:
    """All rows of all sources, columns by name."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def fill_cells(data: Column | str) -> Column:
    """Cells with null as ''."""
    return F.transform(data, lambda r: F.transform(r, lambda c: F.coalesce(c, F.lit(""))))


def cell_text(value: Column, kind: str) -> Column:
    """A typed cell as text: null, zero and false are ''."""
    empty = value.isNull() | (~value if kind == "boolean" else (value == "") if kind == "string" else (value == 0))
    text = F.when(value, "True") if kind == "boolean" else value.cast("string")
    return F.when(empty, "").otherwise(text)


#: Which sources give tables for each method setting.
METHODS = {"pdfplumber": ("plumber",), "camelot": ("camelot",), "paddleocr": (), "all": ("plumber", "camelot")}


def gated(tables: DataFrame, method: str) -> DataFrame:
    """The tables of the sources that the setting allows; accuracy of the second source comes in percent and leaves as a share.

    An unknown setting allows none.
    """
    kept = tables.where(F.col("method").isin(*METHODS.get(method, ()))) if METHODS.get(method) else tables.where(F.lit(False))
    return kept.withColumn("accuracy", F.when((F.col("method") == "camelot") & (F.col("accuracy") > 1), F.col("accuracy") / 100).otherwise(F.col("accuracy")))


def grid(tables: DataFrame, keys: list[str], scale: float, data: str = "data", bbox: str = "bbox") -> DataFrame:
    """keys, r, c, cell, x, y, w, h: the rectangle of every cell, columns and rows of equal size, the longest row deciding."""
    cols = F.greatest(F.lit(1), F.array_max(F.transform(data, F.size)))
    rows = F.greatest(F.lit(1), F.size(data))
    t = tables.where(F.size(data) > 0).where(F.size(F.get(data, 0)) > 0).select(
        *keys, data, (F.col(f"{bbox}.x0") * scale).alias("_x"), (F.col(f"{bbox}.y0") * scale).alias("_y"),
        ((F.col(f"{bbox}.x1") - F.col(f"{bbox}.x0")) * scale / cols).alias("w"), ((F.col(f"{bbox}.y1") - F.col(f"{bbox}.y0")) * scale / rows).alias("h"),
    )
    r = t.select(*keys, "_x", "_y", "w", "h", F.posexplode(data).alias("r", "_row"))
    c = r.select(*keys, "_x", "_y", "w", "h", "r", F.posexplode("_row").alias("c", "cell"))
    return c.select(*keys, "r", "c", "cell", (F.col("_x") + F.col("c") * F.col("w")).alias("x"), (F.col("_y") + F.col("r") * F.col("h")).alias("y"), "w", "h")


# --- queries -------------------------------------------------------------------------------------------------------


def table_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Made-up tables, two per order from two sources, with equal cells now and then."""
    o = table(spark, d, "orders")
    cells = F.expr("array(array(o_orderstatus, cast(o_custkey % 3 as string), null), array(o_orderpriority, ''))")
    box = F.expr("named_struct('x0', 10.0D, 'y0', 20.0D, 'x1', 110.0D + o_custkey % 50, 'y1', 220.0D)")
    base = o.select((F.col("o_orderkey") % 997).alias("page"), F.col("o_orderkey").alias("tbl_ord"), cells.alias("data"), box.alias("bbox"), F.col("o_custkey").alias("k"))
    one = base.select("page", "tbl_ord", "data", "bbox", F.lit("plumber").alias("method"), F.lit(0.9).alias("accuracy"))
    two = base.select("page", "tbl_ord", "data", "bbox", F.lit("camelot").alias("method"), F.expr("case when k % 4 = 0 then null else (k % 100) / 100.0D end").alias("accuracy"))
    return union_sources(one, two)


_T = """base as (select o_orderkey % 997 as page, o_orderkey as tbl_ord, o_custkey as k, [[o_orderstatus, (o_custkey % 3)::varchar, null], [o_orderpriority, '']] as data from orders),
  t as (select page, tbl_ord, k, data, 'plumber' as method, 0.9 as accuracy from base union all select page, tbl_ord, k, data, 'camelot', case when k % 4 = 0 then null else (k % 100) / 100.0 end from base)"""


def table_dedup_best(spark, d):
    """The best of equal tables of every page."""
    return keep_best(table_blocks(spark, d), ["page"]).select("page", "tbl_ord", "method", F.round("accuracy", 4).alias("accuracy"))


def union_sources_q(spark, d):
    """Tables by page and source."""
    return table_blocks(spark, d).groupBy("page", "method").agg(F.count("*").alias("n"))


def table_grid_layout(spark, d):
    """Every cell of every table, at 150 dpi."""
    g = grid(table_blocks(spark, d), ["page", "tbl_ord", "method"], 150 / 72)
    return g.select("page", "tbl_ord", "method", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), "cell", *[F.round(k, 4).alias(k) for k in "xywh"])


def cell_null_fill(spark, d):
    """Cells with null as '', by value."""
    c = table_blocks(spark, d).select(F.explode(F.flatten(fill_cells("data"))).alias("cell"))
    return c.groupBy("cell").agg(F.count("*").alias("n"))


def cell_falsy_fill(spark, d):
    """Numbers, flags and texts of every order as cells, counted by whether they are empty."""
    o = table(spark, d, "orders")
    c = o.select(cell_text(F.col("o_custkey") % 3, "long").alias("n"), cell_text(F.col("o_orderkey") % 2 == 0, "boolean").alias("b"), cell_text(F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderstatus")), "string").alias("s"))
    return c.groupBy("n", "b", "s").agg(F.count("*").alias("rows"))


def table_method_gate(spark, d):
    """Tables that each setting allows, with their mean accuracy as a share."""
    t = table_blocks(spark, d).withColumn("accuracy", F.when(F.col("method") == "camelot", F.col("accuracy") * 100).otherwise(F.col("accuracy")))
    out = [gated(t, m).groupBy("method").agg(F.count("*").alias("n"), F.round(F.avg("accuracy"), 6).alias("accuracy")).select(F.lit(m).alias("setting"), "method", "n", "accuracy") for m in METHODS]
    return union_sources(*out)


QUERIES = {f.__name__.removesuffix("_q"): f for f in (table_dedup_best, union_sources_q, table_grid_layout, cell_null_fill, cell_falsy_fill, table_method_gate)}
SQL = {
    "table_dedup_best": f"with {_T} select page, tbl_ord, method, round(accuracy, 4)::double as accuracy from (select *, row_number() over (partition by page, md5(data::varchar) order by accuracy desc nulls last, tbl_ord, method) as rn from t) where rn = 1",
    "union_sources": f"with {_T} select page, method, count(*) as n from t group by 1, 2",
    "table_grid_layout": f"""with {_T}, r as (select page, tbl_ord, method, k, unnest(data) as row_, generate_subscripts(data, 1) - 1 as r from t),
      c as (select page, tbl_ord, method, k, r, unnest(row_) as cell, generate_subscripts(row_, 1) - 1 as c from r),
      g as (select *, (100.0 + k % 50)::double * (150 / 72.0::double) / 3 as w, 200.0::double * (150 / 72.0::double) / 2 as h from c)
      select page, tbl_ord, method, r, c, cell, round(10.0::double * (150 / 72.0::double) + c * w, 4) as x, round(20.0::double * (150 / 72.0::double) + r * h, 4) as y, round(w, 4) as w, round(h, 4) as h from g""",
    "cell_null_fill": f"with {_T}, c as (select coalesce(unnest(flatten(data)), '') as cell from t) select cell, count(*) as n from c group by 1",
    "cell_falsy_fill": "select case when o_custkey % 3 = 0 then '' else (o_custkey % 3)::varchar end as n, case when o_orderkey % 2 = 0 then 'True' else '' end as b, case when o_orderkey % 5 > 0 then o_orderstatus else '' end as s, count(*) as rows from orders group by 1, 2, 3",
    "table_method_gate": f"""with {_T}, u as (select method, accuracy as a from t where method = 'plumber' union all select method, case when accuracy * 100 > 1 then accuracy else accuracy * 100 end from t where method = 'camelot')
      select setting, method, count(*) as n, round(avg(a), 6)::double as accuracy from u join (values ('pdfplumber', 'plumber'), ('camelot', 'camelot'), ('all', 'plumber'), ('all', 'camelot')) g(setting, m) on m = method group by 1, 2""",
}
