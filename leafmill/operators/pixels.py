"""Pictures: one row a picture, statistics by numpy kernels in Arrow batches, rules on them as columns."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import imaging as I
from leafmill.functions import pixels as K
from leafmill.session import table

C = F.col
SIDE = 8


def moments(p: np.ndarray) -> dict:
    """Population variance, mean, largest, smallest, deviation and number of distinct values of a picture's pixels."""
    v = p.astype(np.float64)
    return {"var": float(v.var()), "mean": float(v.mean()), "max": int(p.max()), "min": int(p.min()), "std": float(v.std()), "colors": len(np.unique(p.reshape(-1, p.shape[-1]) if p.ndim == 3 else p.ravel(), axis=0))}


MOMENTS = "var double, mean double, max int, min int, std double, colors long"


# Limits of the rules on pictures below.
PHOTO_VAR, PHOTO_COLORS = 500, 256
DIAGRAM_EDGES, DIAGRAM_STD, PHOTO_STD, PHOTO_EDGES = 0.05, 80, 60, 0.08
MANY_COLORS, TINY, NEARLY_EMPTY, NEARLY_BLACK, SWAPPED, FEW_MARKS = 2000, 24, 1.0, 6.0, 1.5, 0.0005


def is_photo(var: Column, colors: Column) -> Column:
    """At extraction: a large variance or many colours."""
    return (var > PHOTO_VAR) | (colors > PHOTO_COLORS)


def figure_rule(std: Column, edge_density: Column) -> tuple[Column, Column]:
    """(is_diagram, is_photo) before enhancement."""
    diagram = (edge_density > DIAGRAM_EDGES) & (std < DIAGRAM_STD)
    return diagram, (std > PHOTO_STD) & (edge_density < PHOTO_EDGES) & ~diagram


def encode_format(diagram: Column, photo: Column, colors: Column, webp: bool) -> Column:
    """Format in which a picture is kept: png for diagrams and what is no photo, else webp or jpg."""
    return F.when(diagram, "png").when(photo | (colors > 2000), "webp" if webp else "jpg").otherwise("png")


def sniff(data: Column | str, default: str = "png") -> Column:
    """Format of encoded bytes by their first bytes."""
    h = F.hex(F.substring(data, 1, 12))
    return F.when(h.startswith("89504E470D0A1A0A"), "png").when(h.startswith("FFD8"), "jpg").when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), "webp").otherwise(default)


def is_tiny(w: Column, h: Column, flag: bool = False) -> Column:
    """Whether an image is left out as too small: both sides below 24, where the flag is set."""
    return F.lit(flag) & (w < TINY) & (h < TINY)


def accepts_raster(mean: Column, top: Column) -> Column:
    """Whether a raster made from a vector picture is more than nearly empty."""
    return (top > NEARLY_EMPTY) & (mean > NEARLY_EMPTY)


def near_black(mean: Column) -> Column:
    """Whether a result is rejected as nearly black."""
    return mean < NEARLY_BLACK


def channels_swapped(first: Column, third: Column) -> Column:
    """Whether the first channel outweighs the third by half, so that they are taken for swapped."""
    return first > third * SWAPPED


def too_few_marks(mask_sum: Column, pixels: Column) -> Column:
    """Whether a mark mask (255 each) covers too little to be removed."""
    return mask_sum < FEW_MARKS * pixels


def on_pictures(df: DataFrame, keys: list[str], data: str, kernel: Callable[[np.ndarray], dict], schema: str, shape: tuple[int, int] = (SIDE, SIDE)) -> DataFrame:
    """keys and what ``kernel`` makes of each picture (an array of values, row by row). A null or short array gives nulls."""
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for b in batches:
            out = []
            for values in b[data]:
                ok = values is not None and len(values) == shape[0] * shape[1] and not any(v is None or v != v for v in values)
                out.append(kernel(np.asarray(values, np.int64).reshape(shape).astype(np.uint8)) if ok else dict.fromkeys(names))
            yield pd.concat([b[keys].reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    return df.select(*keys, data).mapInPandas(run, f"{kinds}, {schema}")


# --- queries -------------------------------------------------------------------------------------------------------


def pictures(spark: SparkSession, d: str) -> DataFrame:
    """Every embedding as a grey picture of 8 x 8."""
    v = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") + 1) * 127.5).cast("int"))))
    return table(spark, d, "embeddings").select("vec_id", "label", v.alias("v"))


def measured(spark: SparkSession, d: str, kernel: Callable[[np.ndarray], dict], schema: str) -> DataFrame:
    """vec_id and what a kernel makes of every picture."""
    return on_pictures(pictures(spark, d), ["vec_id"], "v", kernel, schema)


_PX = """px as (select vec_id, label, i // 8 as y, i % 8 as x, greatest(0, least(255, floor((e + 1) * 127.5)))::int as v
  from (select vec_id, label, unnest(embedding)::double as e, generate_subscripts(embedding, 1) - 1 as i from embeddings))"""
_MOM = "m as (select vec_id, var_pop(v) as var, avg(v) as mean, max(v) as max, min(v) as min, stddev_pop(v) as std, count(distinct v) as colors from px group by 1)"


def image_moments(spark, d):
    """Moments of every picture."""
    m = measured(spark, d, moments, MOMENTS)
    return m.select("vec_id", F.round("var", 6).alias("var"), F.round("mean", 6).alias("mean"), "max", "min", F.round("std", 6).alias("std"))


def unique_colors(spark, d):
    """Distinct values of every picture."""
    return measured(spark, d, moments, MOMENTS).select("vec_id", "colors")


def photo_heuristic(spark, d):
    """Whether every picture is a photo at extraction; variances are scaled up, as the stand-in has little contrast."""
    return measured(spark, d, moments, MOMENTS).select("vec_id", is_photo(F.round(C("var") * 2, 6), C("colors")).alias("photo"))


def diagram_rule(spark, d):
    """Diagram and photo of every picture by deviation (scaled up) and the share of edge pixels."""
    m = measured(spark, d, lambda p: moments(p) | {"e": float(K.edges(p, 20, 60).mean())}, MOMENTS + ", e double")
    diagram, photo = figure_rule(F.round(C("std") * 4, 6), F.round("e", 6))
    return m.select("vec_id", diagram.alias("is_diagram"), photo.alias("is_photo"))


def encode_format_q(spark, d):
    """Formats of every picture, with and without webp."""
    u = unique_colors(spark, d)
    args = (C("vec_id") % 5 == 0, C("vec_id") % 3 == 0, C("colors") * 50)
    return u.select("vec_id", encode_format(*args, True).alias("webp"), encode_format(*args, False).alias("plain"))


def magic_sniff(spark, d):
    """Format of every extraction's data behind a made-up header."""
    head = F.expr("unhex(element_at(array('89504E470D0A1A0A', 'FFD8FFE0', '52494646000000005745425056', '25504446', '52494646000000005741564520', ''), cast(length(pdf_path) % 6 + 1 as int)))")
    return table(spark, d, "extractions").select("pdf_path", sniff(F.concat(head, F.coalesce("data_blob", F.unhex(F.lit(""))))).alias("fmt")).distinct()


def near_black_guard(spark, d):
    """Pictures by whether a vector raster is accepted, and a result rejected as near black; values are lowered to meet the limits."""
    m = measured(spark, d, lambda p: moments(np.maximum(p.astype(int) - 120, 0)), MOMENTS)
    return m.groupBy(accepts_raster(C("mean"), C("max")).alias("accept"), near_black(C("mean")).alias("reject")).agg(F.count("*").alias("n"))


def channel_swap(spark, d):
    """Whether the first channel outweighs the third by half, with the columns of a picture as channels."""
    m = measured(spark, d, lambda p: {"r": float(p[:, 0::3].mean() - 90), "b": float(p[:, 2::3].mean() - 90)}, "r double, b double")
    return m.select("vec_id", channels_swapped(F.round("r", 6), F.round(C("b"), 6)).alias("swap"))


def mark_coverage(spark, d):
    """Marked pixels (at 255 each) of every picture, and whether there are too few to remove."""
    m = measured(spark, d, lambda p: {"mask": 255 * int((p > 165).sum()), "n": p.size}, "mask long, n long")
    return m.select("vec_id", "mask", too_few_marks(C("mask"), C("n")).alias("skip"))


def alpha_over_white(spark, d):
    """Every picture over white, its columns giving opacity."""
    a = np.arange(SIDE) / (SIDE - 1)
    return measured(spark, d, lambda p: {"total": float((p * a + 255 * (1 - a)).sum())}, "total double").select("vec_id", F.round("total", 4).alias("total"))


def otsu_threshold(spark, d):
    """Threshold of every picture."""
    return measured(spark, d, lambda p: {"threshold": I.otsu(p)}, "threshold int")


def _pairs(spark, d, kernel, schema):
    """What a kernel makes of every picture and the one before it."""
    a = pictures(spark, d).select("vec_id", "v")
    both = a.join(a.select((C("vec_id") + 1).alias("vec_id"), C("v").alias("u")), "vec_id").select("vec_id", F.concat("v", "u").alias("v"))
    return on_pictures(both, ["vec_id"], "v", lambda p: kernel(p[:SIDE].astype(float), p[SIDE:].astype(float)), schema, (2 * SIDE, SIDE))


def psnr(spark, d):
    """Signal to noise of every picture against the one before it; null where they are equal."""
    m = _pairs(spark, d, lambda a, b: {"mse": float(((a - b) ** 2).mean())}, "mse double")
    return m.select("vec_id", F.when(C("mse") > 0, F.round(10 * F.log10(255.0 * 255.0 / C("mse")), 6)).alias("psnr"))


def mean_abs_diff(spark, d):
    """Mean absolute difference of every picture and the one before it."""
    return _pairs(spark, d, lambda a, b: {"diff": float(np.abs(a - b).mean())}, "diff double").select("vec_id", F.round("diff", 6).alias("diff"))


def laplacian_variance(spark, d):
    """Variance of the Laplacian of every picture, edges mirrored."""

    def kernel(p: np.ndarray) -> dict:
        q = np.pad(p.astype(float), 1, mode="reflect")
        return {"lap_var": float((q[:-2, 1:-1] + q[2:, 1:-1] + q[1:-1, :-2] + q[1:-1, 2:] - 4 * q[1:-1, 1:-1]).var())}

    return measured(spark, d, kernel, "lap_var double").select("vec_id", F.round("lap_var", 6).alias("lap_var"))


def unsharp_mask(spark, d):
    """Sum of every picture sharpened."""
    return on_pictures(pictures(spark, d), ["vec_id"], "v", lambda p: {"total": int(K.unsharp(p).sum())}, "total long")


def bicubic_upscale(spark, d):
    """Sum of every picture at twice its size."""
    return on_pictures(pictures(spark, d), ["vec_id"], "v", lambda p: {"total": int(K.bicubic(p, 2).sum())}, "total long")


def postprocess(spark, d):
    """Sum of every picture, its rows taken as channels by shifting, after the last step."""
    return on_pictures(pictures(spark, d), ["vec_id"], "v", lambda p: {"total": int(K.postprocess(np.stack([p, np.roll(p, 1, 0), np.roll(p, 2, 0)], -1)).sum())}, "total long")


def ssim(spark, d):
    """Similarity of every picture and its blurred self, of their edges, and its edge density."""

    def kernel(p: np.ndarray) -> dict:
        b = K.to_uint8(np.rint(K.gaussian(p, 1.0)))
        e, f = (K.edges(x, 20, 60) for x in (p, b))
        return {"ssim": K.ssim(p, b), "edge_ssim": K.ssim(e * 255, f * 255), "edges": float(e.mean())}

    return on_pictures(pictures(spark, d), ["vec_id"], "v", kernel, "ssim double, edge_ssim double, edges double")


def png_roundtrip(spark, d):
    """Bytes of every picture as PNG, and whether it comes back as it was."""

    def kernel(p: np.ndarray) -> dict:
        data = K.png_encode(p)
        return {"size": len(data), "same": bool((K.png_decode(data) == p).all())}

    return on_pictures(pictures(spark, d), ["vec_id"], "v", kernel, "size long, same boolean")


def rendered_regions(spark, d):
    """Dark regions of every picture: how many, and the largest box."""

    def kernel(p: np.ndarray) -> dict:
        boxes = K.regions(p, 120)
        return {"n": len(boxes), "largest": max((w * h for *_, w, h in boxes), default=0)}

    return on_pictures(pictures(spark, d), ["vec_id"], "v", kernel, "n long, largest long")


def segment_extend(spark, d):
    """A short segment in every picture lengthened over its bright pixels."""

    def kernel(p: np.ndarray) -> dict:
        return dict(zip(("x0", "y0", "x1", "y1"), K.extend((3.0, 3.0, 4.0, 4.0), p > 120)))

    return on_pictures(pictures(spark, d), ["vec_id"], "v", kernel, "x0 int, y0 int, x1 int, y1 int")


def enhance_chain(spark, d):
    """Every picture through the enhancement chain: size of the result, whether it was traced, its mean."""

    def kernel(p: np.ndarray) -> dict:
        e = I.enhance(K.png_encode(p))
        return {"width": e.width, "height": e.height, "is_diagram": e.is_diagram, "mean": round(float(I.decode(e.data).mean()), 4)}

    # a costly kernel: pictures are spread over all tasks first
    wide = pictures(spark, d).select("vec_id", "v").repartition(max(2, spark.sparkContext.defaultParallelism), "vec_id")
    return on_pictures(wide, ["vec_id"], "v", kernel, "width int, height int, is_diagram boolean, mean double")


def vector_trace(spark, d):
    """Every picture traced and drawn again: rectangles, and whether the raster is the mask."""

    def kernel(p: np.ndarray) -> dict:
        ink = p <= I.otsu(p)
        svg = I.trace(ink, 1)
        return {"size": len(svg or b""), "same": bool(svg is None and not ink.any() or svg is not None and ((I.rasterise(svg)[..., 0] == 0) == ink).all())}

    return measured(spark, d, kernel, "size long, same boolean")


def mark_removal(spark, d):
    """Pixels that mark removal changes in every picture."""
    return measured(spark, d, lambda p: {"changed": int((I.remove_marks(np.repeat(p[..., None], 3, -1), diff=4) != p[..., None]).any(-1).sum())}, "changed long")


QUERIES = {f.__name__.removesuffix("_q"): f for f in (
    image_moments, unique_colors, photo_heuristic, diagram_rule, encode_format_q, magic_sniff, near_black_guard, channel_swap, mark_coverage, alpha_over_white, otsu_threshold,
    psnr, mean_abs_diff, laplacian_variance, unsharp_mask, bicubic_upscale, postprocess, ssim, png_roundtrip, rendered_regions, segment_extend,
    enhance_chain, vector_trace, mark_removal,
)}
_PAIR = "p as (select a.vec_id, a.v, b.v as u from px a join px b on a.vec_id = b.vec_id + 1 and a.x = b.x and a.y = b.y)"
SQL = {
    "image_moments": f"with {_PX}, {_MOM} select vec_id, round(var, 6) as var, round(mean, 6) as mean, max, min, round(std, 6) as std from m",
    "unique_colors": f"with {_PX}, {_MOM} select vec_id, colors from m",
    "photo_heuristic": f"with {_PX}, {_MOM} select vec_id, round(var * 2, 6) > 500 or colors > 256 as photo from m",
    "encode_format": f"with {_PX}, {_MOM} select vec_id, {', '.join(f'''case when vec_id % 5 = 0 then 'png' when vec_id % 3 = 0 or colors * 50 > 2000 then '{f}' else 'png' end as {n}''' for f, n in (('webp', 'webp'), ('jpg', 'plain')))} from m",
    "magic_sniff": "select distinct pdf_path, (['png', 'jpg', 'webp', 'png', 'png', case when starts_with(hex(data_blob), '89504E470D0A1A0A') then 'png' when starts_with(hex(data_blob), 'FFD8') then 'jpg' when starts_with(hex(data_blob), '52494646') and substr(hex(data_blob), 17, 8) = '57454250' then 'webp' else 'png' end])[length(pdf_path) % 6 + 1] as fmt from extractions",
    "near_black_guard": f"with {_PX}, m as (select vec_id, avg(greatest(v - 120, 0)) as mean, max(greatest(v - 120, 0)) as max from px group by 1) select max > 1 and mean > 1.0 as accept, mean < 6.0 as reject, count(*) as n from m group by 1, 2",
    "channel_swap": f"with {_PX}, m as (select vec_id, avg(v - 90) filter (where x % 3 = 0) as r, avg(v - 90) filter (where x % 3 = 2) as b from px group by 1) select vec_id, round(r, 6) > round(b * 1.5, 6) as swap from m",
    "mark_coverage": f"with {_PX}, m as (select vec_id, sum(case when v > 165 then 255 else 0 end)::bigint as mask, count(*) as n from px group by 1) select vec_id, mask, mask < 0.0005 * n as skip from m",
    "alpha_over_white": f"with {_PX} select vec_id, round(sum(v * (x / 7.0::double) + 255 * (1 - x / 7.0::double)), 4) as total from px group by 1",
    "otsu_threshold": f"""with {_PX}, h as (select vec_id, v, count(*) as n from px group by 1, 2),
      c as (select vec_id, v as t, sum(n) over w as n0, sum(n * v) over w as s0, sum(n) over (partition by vec_id) as n1, sum(n * v) over (partition by vec_id) as s1 from h window w as (partition by vec_id order by v)),
      s as (select vec_id, t, round(case when n1 > n0 then (s0 * n1 - s1 * n0)::double * (s0 * n1 - s1 * n0)::double / (n0 * (n1 - n0)) else 0 end, 6) as score from c)
      select vec_id, t as threshold from (select *, row_number() over (partition by vec_id order by score desc, t) as rn from s) where rn = 1""",
    "psnr": f"with {_PX}, {_PAIR}, m as (select vec_id, avg((v - u) * (v - u)) as mse from p group by 1) select vec_id, case when mse > 0 then round(10 * log10(255.0::double * 255.0::double / mse), 6) end as psnr from m",
    "mean_abs_diff": f"with {_PX}, {_PAIR} select vec_id, round(avg(abs(v - u)), 6) as diff from p group by 1",
    "laplacian_variance": f"""with {_PX}, n as (select vec_id, v, lag(v) over r as u, lead(v) over r as d, lag(v) over c as l, lead(v) over c as g from px window r as (partition by vec_id, x order by y), c as (partition by vec_id, y order by x))
      select vec_id, round(var_pop(coalesce(u, d) + coalesce(d, u) + coalesce(l, g) + coalesce(g, l) - 4 * v), 6) as lap_var from n group by 1""",
}
