"""Pages and documents: selection, classification, joins with their blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions.text import sql_strip, strip
from leafmill.operators.pixels import is_tiny
from leafmill.session import numbered, table

#: Page size in points where a stand-in needs one.
WIDTH, HEIGHT = 595.0, 842.0


def page_range(spec: Column | str, total: Column | str) -> Column:
    """Sorted distinct 0-based pages of a specification such as 1-5,8; all pages where it is null or empty.

    Parts that cannot be read, reversed ranges and pages beyond 0 <= p < total are left out.
    """
    spec, total = (F.col(c) if isinstance(c, str) else c for c in (spec, total))
    none = F.array().cast("array<int>")
    number = lambda t: F.when(F.trim(t).rlike(r"^[+-]?[0-9]+$"), F.trim(t).try_cast("int"))

    def part(p: Column) -> Column:
        p = F.trim(p)
        ends = F.split(p, "-", 2)
        lo, hi = F.greatest(F.lit(1), number(ends[0])), F.least(number(F.get(ends, 1)), total)
        readable = number(ends[0]).isNotNull() & number(F.get(ends, 1)).isNotNull()
        one = number(p)
        return F.when(F.instr(p, "-") > 0, F.when(readable & (lo <= hi), F.sequence(lo - 1, hi - 1)).otherwise(none)).otherwise(F.when(one.isNotNull(), F.array(one - 1)).otherwise(none))

    every = F.when(total > 0, F.sequence(F.lit(0), total - 1)).otherwise(none)
    chosen = F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(F.split(spec, ","), part)), lambda p: (p >= 0) & (p < total))))
    return F.when(spec.isNull() | (spec == ""), every).otherwise(chosen)


def wanted_pages(spec: str | None, total: int) -> list[int]:
    """``page_range`` for one value."""
    if not spec:
        return list(range(total))

    def number(t: str) -> int | None:
        t = t.strip()
        return int(t) if t.lstrip("+-").isdigit() and t[1:].isdigit() | (len(t) == 1) else None

    out: set[int] = set()
    for part in map(str.strip, spec.split(",")):
        low, dash, high = part.partition("-")
        if dash:
            a, b = number(low), number(high)
            if a is not None and b is not None:
                out.update(range(max(1, a) - 1, min(b, total)))
        elif (one := number(part)) is not None:
            out.add(one - 1)
    return sorted(p for p in out if 0 <= p < total)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.when(whole > 0, part / whole).otherwise(0.0)


# Densities and image shares by which a page is classified, and shares of the page by which a block is left to the render.
TEXT_FROM, TEXT_IMAGES, IMAGE_FROM, IMAGE_TEXT, DIAGRAM_FROM = 0.15, 0.1, 0.5, 0.05, 0.15
FULL, LARGE = 0.9, 0.6


def page_type(density: Column, images: Column, tables: Column) -> Column:
    """text, image, diagram or mixed, by the first rule that holds."""
    return F.when((density > TEXT_FROM) & (images < TEXT_IMAGES), "text").when((images > IMAGE_FROM) & (density < IMAGE_TEXT), "image").when((images > DIAGRAM_FROM) & ~tables, "diagram").otherwise("mixed")


def skip_block(from_render: Column, has_render: Column, frac: Column, full_pages: bool) -> Column:
    """Whether an image block is left to the page's background."""
    big = F.lit(not full_pages)
    return F.when(from_render, True).when(~has_render, False).when(frac > FULL, big).when((frac > LARGE) & big, True).otherwise(False)


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in ``order``; remaining ties by all other columns."""
    w = Window.partitionBy(*keys).orderBy(*order, *[c for c in df.columns if c not in keys + order])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def density(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_num, chars, density): characters of a page's text, by area."""
    got = blocks.groupBy("doc_id", "page_num").agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))
    return got.withColumn("density", ratio(F.col("chars"), F.lit(WIDTH * HEIGHT)))


def area(b: str) -> Column:
    """Area of a box, its product not below 0."""
    return F.greatest(F.lit(0.0), (F.col(f"{b}.x1") - F.col(f"{b}.x0")) * (F.col(f"{b}.y1") - F.col(f"{b}.y0")))


def figures(spark: SparkSession, d: str) -> DataFrame:
    """Figures with boxes made from their ids."""
    return table(spark, d, "diagram_analyses").select(
        "doc_id", "page_num", "diagram_id", "xref", F.expr("named_struct('x0', cast(diagram_id % 100 as double), 'y0', cast(diagram_id % 70 as double), 'x1', cast(diagram_id % 100 + diagram_id % 480 as double), 'y1', cast(diagram_id % 70 + diagram_id % 760 as double))").alias("bbox"),
    ).distinct()


_FIG = "fig as (select distinct doc_id, page_num, diagram_id, xref, (diagram_id % 100)::double as x0, (diagram_id % 70)::double as y0, (diagram_id % 100 + diagram_id % 480)::double as x1, (diagram_id % 70 + diagram_id % 760)::double as y1 from diagram_analyses)"
_A = f"{WIDTH * HEIGHT!r}::double"


def page_range_expand(spark, d):
    """Pages chosen of every document by a specification made from its id."""
    spec = "element_at(array('1-5,8,10-15', '', null, '0', '-5', '5-3', '3,3,2', 'a,2', ' 2 - 4 ,9', '99', '1-2-3', '0-2', ',,'), cast(doc_id % 13 + 1 as int))"
    t = table(spark, d, "documents").select("doc_id", F.expr(spec).alias("spec"), F.expr("cast(coalesce(page_count, 12) as int)").alias("total"))
    return t.select("doc_id", F.explode(page_range("spec", "total")).alias("page"))


def fast_text_mode(spark, d):
    """Whole pages of recognised text that are not blank, as one block."""
    return table(spark, d, "ocr_results").where(strip("text") != "").select("ocr_id", F.length("text").alias("n")).distinct()


def text_density(spark, d):
    """Characters by area of every page."""
    got = density(table(spark, d, "text_blocks").dropDuplicates(["tb_id"]))
    return got.select("doc_id", "page_num", "chars", F.round("density", 8).alias("density"))


def _image_area(spark, d):
    return figures(spark, d).groupBy("doc_id", "page_num").agg(F.least(F.sum(area("bbox")) / (WIDTH * HEIGHT), F.lit(1.0)).alias("images"))


def image_area_fraction(spark, d):
    """Share of every page that figures cover, at most 1."""
    return _image_area(spark, d).select("doc_id", "page_num", F.round("images", 6).alias("fraction"))


def page_classify(spark, d):
    """The type of every page with text or figures. Densities are scaled up, as the stand-in pages hold little text."""
    t = text_density(spark, d)
    j = t.join(_image_area(spark, d), ["doc_id", "page_num"], "full")
    kind = page_type(F.coalesce(F.round(F.col("density") * 100, 8), F.lit(0.0)), F.coalesce("images", F.lit(0.0)), F.col("page_num") % 3 == 0)
    return j.select("doc_id", "page_num", kind.alias("page_type"))


def scanned_flag(spark, d):
    """Native characters of every document, and whether it is scanned (fewer than 50)."""
    t = table(spark, d, "text_blocks").dropDuplicates(["tb_id"])
    n = F.coalesce(F.sum(F.when(F.col("source") == "native", F.length("text"))), F.lit(0))
    return t.groupBy("doc_id").agg(n.alias("chars")).withColumn("is_scanned", F.col("chars") < 50)


def block_skip_rule(spark, d):
    """Figures by whether they are left to the background, with and without full pages."""
    f = figures(spark, d).withColumn("frac", area("bbox") / (WIDTH * HEIGHT))
    args = (F.col("xref") == -1, F.col("diagram_id") % 5 != 0, F.col("frac"))
    return f.select("diagram_id", skip_block(*args, False).alias("skip"), skip_block(*args, True).alias("skip_full"))


def tiny_filter(spark, d):
    """Figures large enough to keep: as image (not both sides below 24), and as diagram (no side below 50)."""
    f = figures(spark, d).select("diagram_id", (F.col("bbox.x1") - F.col("bbox.x0")).alias("w"), (F.col("bbox.y1") - F.col("bbox.y0")).alias("h"))
    return f.select("diagram_id", (~is_tiny(F.col("w"), F.col("h"), True)).alias("image"), ((F.col("w") >= 50) & (F.col("h") >= 50)).alias("diagram"))


def font_catalogue_first(spark, d):
    """Fonts of every document as they occur first."""
    t = table(spark, d, "text_blocks").where("font_name is not null").select("doc_id", "font_name", "page_num", "span_ord", "font_size").distinct()
    return first_wins(t, ["doc_id", "font_name"], ["page_num", "span_ord"]).select("doc_id", "font_name", "page_num", "span_ord", "font_size")


def bbox_lookup_default(spark, d):
    """Box of every figure of the text blocks' pages by xref; the whole page where there is none."""
    f = figures(spark, d)
    info = first_wins(f.where("xref % 3 <> 0").select("doc_id", "page_num", "xref", "diagram_id", "bbox"), ["doc_id", "page_num", "xref"], ["diagram_id"])
    j = f.select("diagram_id", "doc_id", "page_num", "xref").join(info.select("doc_id", "page_num", "xref", "bbox"), ["doc_id", "page_num", "xref"], "left")
    return j.select("diagram_id", *[F.coalesce(f"bbox.{k}", F.lit(v)).alias(k) for k, v in (("x0", 0.0), ("y0", 0.0), ("x1", WIDTH), ("y1", HEIGHT))])


def page_block_join(spark, d):
    """Blocks and figures of every page that has both."""
    t = table(spark, d, "text_blocks").dropDuplicates(["tb_id"]).groupBy("doc_id", "page_num").agg(F.count("*").alias("blocks"))
    f = figures(spark, d).groupBy("doc_id", "page_num").agg(F.count("*").alias("figures"))
    return t.join(f, ["doc_id", "page_num"])


def with_counts(entries: Column, page_count: Column, is_pdf: Column, needs_pass: Column) -> Column:
    """A document's metadata with page_count (0 by default), is_pdf (true) and needs_pass (false), over entries of these names."""
    plain = F.map_filter(F.coalesce(entries, F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin("page_count", "is_pdf", "needs_pass"))
    more = F.create_map(
        F.lit("page_count"), F.coalesce(page_count, F.lit(0)).cast("string"), F.lit("is_pdf"), F.coalesce(is_pdf, F.lit(True)).cast("string"), F.lit("needs_pass"), F.coalesce(needs_pass, F.lit(False)).cast("string")
    )
    return F.map_concat(plain, more)


def metadata_defaults(spark, d):
    """Metadata of every document with its counts, a row per entry."""
    m = F.create_map(F.lit("title"), F.col("doc_kind"), F.lit("page_count"), F.lit("x"))
    null = F.lit(None).cast("boolean")
    return table(spark, d, "documents").select("doc_id", F.explode(with_counts(m, F.col("page_count"), null, F.when(F.col("doc_id") % 7 == 0, True))).alias("k", "v"))


def metadata(entries: Column) -> Column:
    """The entries of a document's metadata that a rebuilt one keeps; its creator is always ours."""
    keep = F.map_filter(entries, lambda k, v: k.isin("title", "author", "subject") & v.isNotNull())
    return F.map_concat(keep, F.create_map(F.lit("creator"), F.lit("leafmill")))


def metadata_whitelist(spark, d):
    """Kept metadata of every document, a row per entry."""
    m = F.create_map(F.lit("title"), F.col("doc_kind"), F.lit("author"), F.col("source"), F.lit("producer"), F.col("lang"), F.lit("creator"), F.lit("x"), F.lit("subject"), F.col("lang"))
    return table(spark, d, "documents").select("doc_id", F.explode(metadata(m)).alias("k", "v"))


def bookmarks(toc: Column | str) -> Column:
    """The table of contents (level, title, page) of a document, none where it is null; entries without title stay."""
    return F.coalesce(toc, F.from_json(F.lit("[]"), "array<struct<level:int,title:string,page:int>>"))


def bookmark_default(spark, d):
    """Bookmarks of every document: its entries in order, none where it has no table of contents.

    The stand-in has one for two documents of three, of three entries.
    """
    toc = F.expr("case when doc_id % 3 <> 0 then transform(sequence(1, 3), i -> named_struct('level', cast(1 + (i + doc_id) % 2 as int), 'title', concat(coalesce(doc_kind, ''), ' ', i), 'page', cast(i * 2 as int))) end")
    b = table(spark, d, "documents").select("doc_id", bookmarks(toc).alias("b"))
    return b.select("doc_id", F.size("b").cast("long").alias("n"), F.array_join(F.transform("b", lambda x: F.concat_ws(":", x["level"].cast("string"), x["title"], x["page"].cast("string"))), "|").alias("entries"))


def output_path(path: Column | str, suffix: str = "_enhanced") -> tuple[Column, Column]:
    """Paths of the rebuilt file and of its report, in the folder out."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    out = F.concat(F.lit("out/"), stem, F.lit(f"{suffix}.pdf"))
    return out, F.regexp_replace(out, r"\.pdf$", ".quality_report.json")


def output_path_q(spark, d):
    """Output paths of every extracted file."""
    out, report = output_path("pdf_path")
    return table(spark, d, "extractions").select("pdf_path", out.alias("output"), report.alias("report")).distinct()


def listing_order(spark, d):
    """The files of a batch in order, numbered."""
    files = table(spark, d, "extractions").select("pdf_path").distinct().where("pdf_path like '%.pdf'")
    return numbered(files, ["pdf_path"], "idx").select("idx", "pdf_path")


QUERIES = {f.__name__.removesuffix("_q"): f for f in (
    page_range_expand, fast_text_mode, text_density, image_area_fraction, page_classify, scanned_flag, block_skip_rule, tiny_filter, font_catalogue_first,
    bbox_lookup_default, page_block_join, metadata_whitelist, metadata_defaults, bookmark_default, output_path_q, listing_order,
)}
_TB = "tb as (select * from (select *, row_number() over (partition by tb_id) as dup from text_blocks) where dup = 1)"
_FA = "greatest(0.0, (x1 - x0) * (y1 - y0))"
_IMG = f"img as (select doc_id, page_num, least(sum({_FA}) / {_A}, 1.0) as images from fig group by 1, 2)"
_DENS = f"dens as (select doc_id, page_num, coalesce(sum(length(text)), 0)::bigint as chars, coalesce(sum(length(text)), 0) / {_A} as density from tb group by 1, 2)"
_SPEC = "(['1-5,8,10-15', '', null, '0', '-5', '5-3', '3,3,2', 'a,2', ' 2 - 4 ,9', '99', '1-2-3', '0-2', ',,'])[doc_id % 13 + 1]"
SQL = {
    "page_range_expand": f"""with s as (select doc_id, {_SPEC} as spec, coalesce(page_count, 12) as total from documents),
      p as (select doc_id, total, trim(unnest(string_split(spec, ','))) as p from s where spec <> ''),
      r as (select doc_id, total, p, case when contains(p, '-') then try_cast(trim(left(p, instr(p, '-') - 1)) as int) end as a, case when contains(p, '-') then try_cast(trim(substr(p, instr(p, '-') + 1)) as int) end as b, try_cast(p as int) as one from p),
      x as (select doc_id, total, unnest(case when contains(p, '-') then case when a is not null and b is not null and greatest(1, a) <= least(b, total) then range(greatest(1, a) - 1, least(b, total)) else [] end when one is not null then [one - 1] else [] end) as page from r
        union all select doc_id, total, unnest(range(0, total)) from s where spec is null or spec = '')
      select distinct doc_id, page::int as page from x where page >= 0 and page < total""",
    "fast_text_mode": f"select distinct ocr_id, length(text) as n from ocr_results where {sql_strip('text')} <> ''",
    "text_density": f"with {_TB}, {_DENS} select doc_id, page_num, chars, round(density, 8) as density from dens",
    "image_area_fraction": f"with {_FIG}, {_IMG} select doc_id, page_num, round(images, 6) as fraction from img",
    "page_classify": f"""with {_TB}, {_FIG}, {_IMG}, {_DENS}, j as (select coalesce(dens.doc_id, img.doc_id) as doc_id, coalesce(dens.page_num, img.page_num) as page_num, coalesce(round(round(density, 8) * 100, 8), 0) as td, coalesce(images, 0) as ia from dens full join img on dens.doc_id = img.doc_id and dens.page_num = img.page_num)
      select doc_id, page_num, case when td > 0.15 and ia < 0.1 then 'text' when ia > 0.5 and td < 0.05 then 'image' when ia > 0.15 and page_num % 3 <> 0 then 'diagram' else 'mixed' end as page_type from j""",
    "scanned_flag": f"with {_TB} select doc_id, coalesce(sum(length(text)) filter (where source = 'native'), 0)::bigint as chars, coalesce(sum(length(text)) filter (where source = 'native'), 0) < 50 as is_scanned from tb group by 1",
    "block_skip_rule": f"""with {_FIG}, f as (select diagram_id, xref, {_FA} / {_A} as frac from fig) select diagram_id,
      case when xref = -1 then true when diagram_id % 5 = 0 then false when frac > 0.9 then true when frac > 0.6 then true else false end as skip,
      case when xref = -1 then true when diagram_id % 5 = 0 then false else false end as skip_full from f""",
    "tiny_filter": f"with {_FIG} select diagram_id, not (x1 - x0 < 24 and y1 - y0 < 24) as image, x1 - x0 >= 50 and y1 - y0 >= 50 as diagram from fig",
    "font_catalogue_first": "select doc_id, font_name, page_num, span_ord, font_size from (select *, row_number() over (partition by doc_id, font_name order by page_num, span_ord, font_size) as rn from (select distinct doc_id, font_name, page_num, span_ord, font_size from text_blocks where font_name is not null)) where rn = 1",
    "bbox_lookup_default": f"""with {_FIG}, i as (select * from (select *, row_number() over (partition by doc_id, page_num, xref order by diagram_id) as rn from fig where xref % 3 <> 0) where rn = 1)
      select f.diagram_id, coalesce(i.x0, 0) as x0, coalesce(i.y0, 0) as y0, coalesce(i.x1, {WIDTH}) as x1, coalesce(i.y1, {HEIGHT}) as y1 from fig f left join i on f.doc_id = i.doc_id and f.page_num = i.page_num and f.xref = i.xref""",
    "page_block_join": f"with {_TB}, {_FIG}, a as (select doc_id, page_num, count(*) as blocks from tb group by 1, 2), b as (select doc_id, page_num, count(*) as figures from fig group by 1, 2) select a.doc_id, a.page_num, blocks, figures from a join b on a.doc_id = b.doc_id and a.page_num = b.page_num",
    "metadata_whitelist": "select doc_id, k, v from (select doc_id, unnest(['title', 'author', 'subject', 'creator']) as k, unnest([doc_kind, source, lang, 'leafmill']) as v from documents) where v is not null",
    "metadata_defaults": "select doc_id, k, v from (select doc_id, unnest(['title', 'page_count', 'is_pdf', 'needs_pass']) as k, unnest([doc_kind, coalesce(page_count, 0)::varchar, 'true', case when doc_id % 7 = 0 then 'true' else 'false' end]) as v from documents)",
    "bookmark_default": "select doc_id, case when doc_id % 3 <> 0 then 3 else 0 end::bigint as n, case when doc_id % 3 <> 0 then array_to_string(list_transform([1, 2, 3], lambda i: concat(1 + (i + doc_id) % 2, ':', coalesce(doc_kind, ''), ' ', i, ':', i * 2)), '|') else '' end as entries from documents",
    "output_path": r"select distinct pdf_path, concat('out/', regexp_replace(regexp_extract(pdf_path, '([^/]*)$', 1), '(.)\.[^.]*$', '\1'), '_enhanced.pdf') as output, concat('out/', regexp_replace(regexp_extract(pdf_path, '([^/]*)$', 1), '(.)\.[^.]*$', '\1'), '_enhanced.quality_report.json') as report from extractions",
    "listing_order": "select row_number() over (order by pdf_path) - 1 as idx, pdf_path from (select distinct pdf_path from extractions where pdf_path like '%.pdf')",
}
