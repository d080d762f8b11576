"""Boxes, scales and segments."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.session import table

C = F.col


def box_area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Area of a box: the product of its sides, not below 0 (two negative sides give a positive area)."""
    return F.greatest(F.lit(0.0), (x1 - x0) * (y1 - y0))


def px_to_pt(v: Column, pixels: Column, points: Column) -> Column:
    """A pixel coordinate in points."""
    return v / pixels * points


def crop(lo: Column, hi: Column, points: Column, pixels: Column) -> tuple[Column, Column, Column]:
    """First and end pixel of a stretch in points, clamped to the page, and whether anything is left."""
    scale = F.when(points != 0, pixels / points).otherwise(1.0)
    a = F.greatest(F.lit(0), F.bround(lo * scale).cast("long"))
    b = F.least(pixels.cast("long"), F.bround(hi * scale).cast("long"))
    return a, b, a < b


def rotate_clip(x: Column, y: Column, scale: float, degrees: Column, w: Column, h: Column) -> tuple[Column, Column]:
    """A point scaled, rotated by a multiple of 90 degrees and clipped to the page."""
    d = F.pmod(degrees, F.lit(360))
    sx, sy = x * scale, y * scale
    rx = F.when(d == 90, -sy).when(d == 180, -sx).when(d == 270, sy).otherwise(sx)
    ry = F.when(d == 90, sx).when(d == 180, -sy).when(d == 270, -sx).otherwise(sy)
    return F.least(F.greatest(rx, F.lit(0.0)), w * scale), F.least(F.greatest(ry, F.lit(0.0)), h * scale)


def megapixel_cap(w: Column, h: Column, most: float = 8e6) -> tuple[Column, Column]:
    """Sides of a render with at most ``most`` pixels, rounded down, at least 1."""
    s = F.sqrt(F.lit(most) / (w * h))
    cap = lambda v: F.when(w * h > most, F.greatest(F.lit(1), F.floor(v * s))).otherwise(v.cast("long"))
    return cap(w), cap(h)


def downscale(w: Column, h: Column, most: float = 6e6, side: float = 3500.0) -> Column:
    """Factor that brings an image within its limits, at most 1."""
    one = F.lit(1.0)
    return F.least(F.when(w > side, side / w).otherwise(one), F.when(h > side, side / h).otherwise(one), F.when(w * h > most, F.sqrt(most / (w * h))).otherwise(one), one)


def effective_dpi(pixels: Column, points: Column) -> Column:
    """Pixels per inch over a side in points, one decimal; a side of 0 counts as an inch."""
    inches = F.when(points != 0, points / 72.0).otherwise(1.0)
    return F.bround(F.when(inches > 0, pixels / inches).otherwise(72.0), 1)


def angle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Direction of a segment."""
    return F.atan2(y2 - y1, x2 - x1)


def collinear(a: Column, b: Column, tol: float = 0.05) -> Column:
    """The merge test of two directions, as it stands: equal, or at right angles."""
    return (F.abs(F.pmod(a - b + math.pi, F.lit(math.pi)) - math.pi / 2) < tol) | (F.abs(a - b) < tol)


def merge_segments(segs: list[tuple[float, float, float, float]], tol: float = 0.05, near: float = 10.0) -> list[tuple[int, int, int, int]]:
    """Greedy groups of segments, each around the first one left, as boxes: like direction and midpoints nearer than ``near`` to the seed.

    Midpoints lie in cells of a grid as wide as ``near``, so a seed looks only into its own cell and the eight around it.
    """
    cells: dict[tuple[int, int], list[int]] = {}
    place = []
    for i, (x1, y1, x2, y2) in enumerate(segs):
        mx, my = (x1 + x2) / 2, (y1 + y2) / 2
        at = math.floor(mx / near), math.floor(my / near)
        place.append((mx, my, math.atan2(y2 - y1, x2 - x1), at))
        cells.setdefault(at, []).append(i)
    taken = [False] * len(segs)
    out = []
    for i, (mx, my, a, (gx, gy)) in enumerate(place):
        if taken[i]:
            continue
        group = []
        for cell in ((gx + dx, gy + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)):
            if cell not in cells:
                continue
            left = []
            for j in cells[cell]:
                nx, ny, b, _ = place[j]
                like = abs(a - b) < tol or abs((a - b + math.pi) % math.pi - math.pi / 2) < tol
                if j == i or like and math.hypot(mx - nx, my - ny) < near:
                    taken[j] = True
                    group.append(segs[j])
                else:
                    left.append(j)
            cells[cell] = left
        xs, ys = [v for s in group for v in s[0::2]], [v for s in group for v in s[1::2]]
        out.append((int(min(xs)), int(min(ys)), int(max(xs)), int(max(ys))))
    return out


def segment_groups(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key, grp, x0, y0, x1, y1: merged segments (x1, y1, x2, y2) of each drawing, in the order given."""
    kind = df.schema[key].dataType.simpleString()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(key, *order, "x1", "y1", "x2", "y2").repartition(parts, key).sortWithinPartitions(key, *order, "x1", "y1", "x2", "y2")

    def run(batches):
        # drawings follow one another in a partition; one that runs over the end of a batch is carried on
        now, held = None, []
        for b in batches:
            out = []
            for k, *seg in zip(b[key], b["x1"], b["y1"], b["x2"], b["y2"]):
                if k != now and held:
                    out += [(now, i, *g) for i, g in enumerate(merge_segments(held))]
                    held = []
                now = k
                held.append(tuple(seg))
            yield pd.DataFrame(out, columns=[key, "grp", "x0", "y0", "x1", "y1"])
        yield pd.DataFrame([(now, i, *g) for i, g in enumerate(merge_segments(held))], columns=[key, "grp", "x0", "y0", "x1", "y1"])

    return rows.where(F.col(key).isNotNull()).mapInPandas(run, f"`{key}` {kind}, grp int, x0 int, y0 int, x1 int, y1 int")


# --- queries -------------------------------------------------------------------------------------------------------


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """A box per line item."""
    return table(spark, d, "lineitem").select(
        C("l_orderkey").alias("k"), C("l_linenumber").alias("n"), C("l_partkey").alias("p"),
        (C("l_partkey") % 600 - 20).cast("double").alias("x0"), (C("l_suppkey") % 800 - 20).cast("double").alias("y0"),
        (C("l_partkey") % 600 + C("l_quantity") * 8 - 60).alias("x1"), (C("l_suppkey") % 800 + C("l_quantity") * 11 - 60).alias("y1"), C("l_quantity").alias("q"),
    )


_B = "b as (select l_orderkey as k, l_linenumber as n, l_partkey as p, (l_partkey % 600 - 20)::double as x0, (l_suppkey % 800 - 20)::double as y0, l_partkey % 600 + l_quantity * 8 - 60 as x1, l_suppkey % 800 + l_quantity * 11 - 60 as y1, l_quantity as q from lineitem)"


def bbox_area(spark, d):
    """Sides and areas of all boxes, by sheet."""
    b = boxes(spark, d).withColumn("a", box_area(C("x0"), C("y0"), C("x1"), C("y1")))
    return b.groupBy((C("p") % 100).alias("sheet")).agg(F.round(F.sum(C("x1") - C("x0")), 2).alias("w"), F.round(F.sum(C("y1") - C("y0")), 2).alias("h"), F.round(F.sum("a"), 2).alias("area"), F.count(F.when(C("a") == 0, 1)).alias("empty"))


def bbox_px_mapping(spark, d):
    """All boxes from pixels to points, by sheet."""
    b = boxes(spark, d)
    m = lambda c, px, pt: F.round(F.sum(px_to_pt(C(c), F.lit(px), F.lit(pt))), 3).alias(c)
    return b.groupBy((C("p") % 100).alias("sheet")).agg(m("x0", 1240.0, 595.0), m("y0", 1754.0, 842.0), m("x1", 1240.0, 595.0), m("y1", 1754.0, 842.0))


def crop_clamp(spark, d):
    """Crops of all boxes."""
    b = boxes(spark, d)
    ax, bx, okx = crop(C("x0"), C("x1"), F.lit(595.0), F.lit(1240))
    ay, by, oky = crop(C("y0"), C("y1"), F.lit(842.0), F.lit(1754))
    return b.select("k", "n", "p", ax.alias("px0"), ay.alias("py0"), bx.alias("px1"), by.alias("py1"), (okx & oky).alias("ok")).distinct()


def page_scale_clip(spark, d):
    """Corners scaled, rotated and clipped, by rotation."""
    b = boxes(spark, d).withColumn("rot", (C("n") % 4 * 90).cast("int"))
    x, y = rotate_clip(C("x1"), C("y1"), 150 / 72, C("rot"), F.lit(595.0), F.lit(842.0))
    return b.select("rot", (C("p") % 50).alias("sheet"), x.alias("x"), y.alias("y")).groupBy("rot", "sheet").agg(F.round(F.sum("x"), 2).alias("x"), F.round(F.sum("y"), 2).alias("y"))


def coverage_fraction(spark, d):
    """Share of the page of every box, in steps of a hundredth."""
    a = box_area(C("x0"), C("y0"), C("x1"), C("y1")) / (595.0 * 842.0)
    return boxes(spark, d).groupBy(F.floor(a * 100).alias("pct")).agg(F.count("*").alias("n"))


def megapixel_cap_q(spark, d):
    """Capped sides of all renders, by size."""
    w, h = megapixel_cap((C("p_size") * 150).cast("double"), (C("p_partkey") % 60 * 100 + 500).cast("double"))
    return table(spark, d, "part").groupBy(w.alias("w"), h.alias("h")).agg(F.count("*").alias("n"))


def downscale_factor(spark, d):
    """Scaled sides of all images, by size."""
    w, h = (C("p_size") * 150).cast("double"), (C("p_partkey") % 60 * 100 + 500).cast("double")
    s = downscale(w, h)
    p = table(spark, d, "part").select(F.greatest(F.lit(1.0), F.bround(w * s)).cast("long").alias("w"), F.greatest(F.lit(1.0), F.bround(h * s)).cast("long").alias("h"))
    return p.groupBy("w", "h").agg(F.count("*").alias("n"))


def effective_dpi_q(spark, d):
    """Resolution of every part's image over a side of its size, 0 now and then."""
    return table(spark, d, "part").select("p_partkey", effective_dpi((C("p_partkey") % 4000).cast("double"), (C("p_size") % 40 * 12).cast("double")).alias("dpi"))


def dpi_after_resize(spark, d):
    """Resolution of every part's image after resizing."""
    return table(spark, d, "part").select("p_partkey", F.round(300.0 * (C("p_size") * 10 / (C("p_partkey") % 977 + 1)), 4).alias("dpi"))


def color_unpack(spark, d):
    """Colours by part, summed by sheet."""
    c = C("l_partkey").cast("int") * 31 % 16777216
    ch = lambda n: F.round(F.sum(F.shiftright(c, n).bitwiseAND(255) / 255), 4)
    return table(spark, d, "lineitem").groupBy((C("l_suppkey") % 64).alias("sheet")).agg(ch(16).alias("r"), ch(8).alias("g"), ch(0).alias("b"))


def font_flags(spark, d):
    """Line items by bold and italic."""
    f = (C("l_suppkey") % 32).cast("int")
    return table(spark, d, "lineitem").groupBy((f.bitwiseAND(16) != 0).alias("bold"), (f.bitwiseAND(2) != 0).alias("italic")).agg(F.count("*").alias("n"))


def segment_metrics(spark, d):
    """Direction and length of all boxes' diagonals, by sheet."""
    b = boxes(spark, d)
    return b.groupBy((C("p") % 100).alias("sheet")).agg(F.round(F.sum(angle(C("x0"), C("y0"), C("x1"), C("y1"))), 4).alias("angle"), F.round(F.sum(F.hypot(C("x1") - C("x0"), C("y1") - C("y0"))), 3).alias("length"))


def _segments(spark, d):
    return boxes(spark, d).select(C("k"), C("n"), C("p"), (C("x0") % 40).alias("x1"), (C("y0") % 40).alias("y1"), (C("x0") % 40 + C("q") % 5).alias("x2"), (C("y0") % 40 + C("q") % 3).alias("y2")).distinct()


def near_pairs(segs: DataFrame, key: str, order: list[str], near: float = 10.0) -> DataFrame:
    """Pairs (i before j in ``order``) of segments of one drawing with like directions and midpoints nearer than ``near``.

    Midpoints meet by cells of a grid as wide as ``near``: each segment looks into its own cell and the eight around it, so a
    drawing with very many segments is spread over its cells.
    """
    s = segs.withColumn("a", angle(C("x1"), C("y1"), C("x2"), C("y2"))).withColumn("mx", (C("x1") + C("x2")) / 2).withColumn("my", (C("y1") + C("y2")) / 2)
    s = s.withColumn("gx", F.floor(C("mx") / near)).withColumn("gy", F.floor(C("my") / near))
    steps = F.array(*[F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x in (-1, 0, 1) for y in (-1, 0, 1)])
    i = s.withColumn("_s", F.explode(steps)).withColumn("gx", C("gx") + C("_s.dx")).withColumn("gy", C("gy") + C("_s.dy")).drop("_s").alias("i")
    j = s.alias("j")
    like = collinear(C("i.a"), C("j.a")) & (F.hypot(C("i.mx") - C("j.mx"), C("i.my") - C("j.my")) < near)
    before = F.struct(*[C(f"i.{o}") for o in order]) < F.struct(*[C(f"j.{o}") for o in order])
    return i.join(j, (C(f"i.{key}") == C(f"j.{key}")) & (C("i.gx") == C("j.gx")) & (C("i.gy") == C("j.gy")) & before & like)


def collinear_pairs(spark, d):
    """Pairs of segments of one order that the merge test joins, counted by order."""
    return near_pairs(_segments(spark, d), "k", ["n", "p"]).groupBy(C("i.k").alias("k")).agg(F.count("*").alias("pairs"))


def segment_group_box(spark, d):
    """Union box of all segments of an order."""
    s = _segments(spark, d)
    return s.groupBy("k").agg(F.least(F.min("x1"), F.min("x2")).alias("x0"), F.least(F.min("y1"), F.min("y2")).alias("y0"), F.greatest(F.max("x1"), F.max("x2")).alias("x1"), F.greatest(F.max("y1"), F.max("y2")).alias("y1"))


def segment_merge(spark, d):
    """Merged segments of every order."""
    return segment_groups(_segments(spark, d), "k", ["n", "p"])


QUERIES = {f.__name__.removesuffix("_q"): f for f in (
    bbox_area, bbox_px_mapping, crop_clamp, page_scale_clip, coverage_fraction, megapixel_cap_q, downscale_factor, effective_dpi_q, dpi_after_resize,
    color_unpack, font_flags, segment_metrics, collinear_pairs, segment_group_box, segment_merge,
)}
_AR = "greatest(0.0, (x1 - x0) * (y1 - y0))"
_SEG = f"{_B}, s as (select distinct k, n, p, x0 % 40 as x1, y0 % 40 as y1, x0 % 40 + q % 5 as x2, y0 % 40 + q % 3 as y2 from b)"
_WH = "(p_size * 150)::double as w, (p_partkey % 60 * 100 + 500)::double as h"
SQL = {
    "bbox_area": f"with {_B} select p % 100 as sheet, round(sum(x1 - x0), 2) as w, round(sum(y1 - y0), 2) as h, round(sum({_AR}), 2) as area, count(*) filter (where {_AR} = 0) as empty from b group by 1",
    "bbox_px_mapping": f"with {_B} select p % 100 as sheet, {', '.join(f'round(sum({c} / {px}::double * {pt}::double), 3) as {c}' for c, px, pt in (('x0', 1240, 595), ('y0', 1754, 842), ('x1', 1240, 595), ('y1', 1754, 842)))} from b group by 1",
    "crop_clamp": f"""with {_B}, c as (select k, n, p, greatest(0, round_even(x0 * (1240 / 595.0::double), 0)::bigint) as px0, greatest(0, round_even(y0 * (1754 / 842.0::double), 0)::bigint) as py0,
      least(1240, round_even(x1 * (1240 / 595.0::double), 0)::bigint) as px1, least(1754, round_even(y1 * (1754 / 842.0::double), 0)::bigint) as py1 from b) select distinct *, px0 < px1 and py0 < py1 as ok from c""",
    "page_scale_clip": f"""with {_B}, s as (select n % 4 * 90 as rot, p % 50 as sheet, x1 * (150 / 72.0::double) as sx, y1 * (150 / 72.0::double) as sy from b),
      r as (select rot, sheet, case rot when 90 then -sy when 180 then -sx when 270 then sy else sx end as x, case rot when 90 then sx when 180 then -sy when 270 then -sx else sy end as y from s)
      select rot, sheet, round(sum(least(greatest(x, 0), 595 * (150 / 72.0::double))), 2) as x, round(sum(least(greatest(y, 0), 842 * (150 / 72.0::double))), 2) as y from r group by 1, 2""",
    "coverage_fraction": f"with {_B} select floor({_AR} / (595.0::double * 842.0::double) * 100)::bigint as pct, count(*) as n from b group by 1",
    "megapixel_cap": f"with p as (select {_WH} from part), s as (select w, h, sqrt(8e6 / (w * h)) as s from p) select case when w * h > 8e6 then greatest(1, floor(w * s)) else w end::bigint as w, case when w * h > 8e6 then greatest(1, floor(h * s)) else h end::bigint as h, count(*) as n from s group by 1, 2",
    "downscale_factor": f"""with p as (select {_WH} from part), s as (select w, h, least(case when w > 3500 then 3500.0::double / w else 1 end, case when h > 3500 then 3500.0::double / h else 1 end, case when w * h > 6e6 then sqrt(6e6 / (w * h)) else 1 end, 1.0::double) as s from p)
      select greatest(1, round_even(w * s, 0))::bigint as w, greatest(1, round_even(h * s, 0))::bigint as h, count(*) as n from s group by 1, 2""",
    "effective_dpi": "select p_partkey, round_even((p_partkey % 4000)::double / case when p_size % 40 * 12 <> 0 then (p_size % 40 * 12)::double / 72.0::double else 1 end, 1) as dpi from part",
    "dpi_after_resize": "select p_partkey, round(300.0::double * ((p_size * 10)::double / (p_partkey % 977 + 1)), 4) as dpi from part",
    "color_unpack": f"select l_suppkey % 64 as sheet, {', '.join(f'round(sum(((l_partkey * 31 % 16777216) >> {n} & 255) / 255.0::double), 4) as {c}' for n, c in ((16, 'r'), (8, 'g'), (0, 'b')))} from lineitem group by 1",
    "font_flags": "select (l_suppkey % 32)::int & 16 <> 0 as bold, (l_suppkey % 32)::int & 2 <> 0 as italic, count(*) as n from lineitem group by 1, 2",
    "segment_metrics": f"with {_B} select p % 100 as sheet, round(sum(atan2(y1 - y0, x1 - x0)), 4) as angle, round(sum(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))), 3) as length from b group by 1",
    "collinear_pairs": f"""with {_SEG}, t as (select *, atan2(y2 - y1, x2 - x1) as a, (x1 + x2) / 2 as mx, (y1 + y2) / 2 as my from s),
      u as (select i.k, i.a - j.a as d from t i join t j on i.k = j.k and (i.n < j.n or (i.n = j.n and i.p < j.p)) and sqrt((i.mx - j.mx) ^ 2 + (i.my - j.my) ^ 2) < 10)
      select k, count(*) as pairs from u where abs(d) < 0.05 or abs((d + pi()) - floor((d + pi()) / pi()) * pi() - pi() / 2) < 0.05 group by 1""",
    "segment_group_box": f"with {_SEG} select k, least(min(x1), min(x2)) as x0, least(min(y1), min(y2)) as y0, greatest(max(x1), max(x2)) as x1, greatest(max(y1), max(y2)) as y1 from s group by 1",
}
