"""Text correction steps, answers of a model as JSON, spans and text layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.session import table

#: The fields of an answer about a figure, with what stands for a missing one.
ANSWER = "diagram_type string, title string, description string, labels array<string>, relationships array<struct<`from`:string, `to`:string, label:string>>, colors_used array<string>, has_text boolean, is_chart boolean, is_flowchart boolean, is_table boolean, confidence double"


def parse_answer(raw: Column | str) -> Column:
    """A struct of ANSWER with defaults: missing fields are '', [], false and 0.5; text that is no JSON is type unknown, its first 500 characters the description, confidence 0.3.

    An explicit null counts as missing.
    """
    raw = F.col(raw) if isinstance(raw, str) else raw
    clean = T.fence_strip(raw)
    valid = F.try_parse_json(clean).isNotNull() & clean.startswith("{")
    j = F.from_json(clean, ANSWER)
    none = F.array().cast("array<string>")

    def field(name: str, default: Column, invalid: Column) -> Column:
        return F.when(valid, F.coalesce(j[name], default)).otherwise(invalid).alias(name)

    return F.struct(
        field("diagram_type", F.lit("unknown"), F.lit("unknown")),
        field("title", F.lit(""), F.lit("")),
        field("description", F.lit(""), F.substring(raw, 1, 500)),
        field("labels", none, none),
        field("relationships", F.from_json(F.lit("[]"), "array<struct<`from`:string, `to`:string, label:string>>"), F.from_json(F.lit("[]"), "array<struct<`from`:string, `to`:string, label:string>>")),
        field("colors_used", none, none),
        *[field(k, F.lit(False), F.lit(False)) for k in ("has_text", "is_chart", "is_flowchart", "is_table")],
        field("confidence", F.lit(0.5), F.lit(0.3)),
        valid.alias("valid"),
    )


def correction_tags(raw: Column, steps: list[tuple[str, Column, bool]]) -> Column:
    """The tags of the correction steps, in order: (tag, text after the step, tagged even without change). None for blank text."""
    tags, before = [], raw
    for tag, after, always in steps:
        tags.append(F.lit(tag) if always else F.when(after != before, F.lit(tag)))
        before = after
    return F.when(T.strip(raw) == "", F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*tags)))


def spans(blocks: DataFrame) -> DataFrame:
    """Text spans from (…, type, spans ARRAY<STRUCT<text, size, color, flags>>): type 0 only, stripped, empty ones dropped, decoded.

    color is packed RGB; bold is flag 2^4, italic 2^1; sizes have two decimals.
    """
    keep = [c for c in blocks.columns if c not in ("type", "spans")]
    s = blocks.where("type = 0").select(*keep, F.posexplode("spans").alias("span_ord", "s"))
    t = T.strip("s.text")
    return s.where(t != "").select(*keep, "span_ord", t.alias("text"), *decoded("s.color", "s.flags"), F.bround("s.size", 2).alias("font_size"))


def decoded(color: str, flags: str) -> list[Column]:
    """r, g, b from 0 to 1 of a packed colour, and bold, italic of font flags."""
    c = F.col(color).cast("int")
    part = lambda n: (F.shiftright(c, n).bitwiseAND(255) / 255).alias("rgb"[2 - n // 8])
    f = F.col(flags).cast("int")
    return [part(16), part(8), part(0), (f.bitwiseAND(16) != 0).alias("bold"), (f.bitwiseAND(2) != 0).alias("italic")]


def text_layer(blocks: DataFrame, scale: float) -> DataFrame:
    """Where and how large each non-blank block is set in the searchable layer: x, y, size (at least 1), text."""
    return blocks.where(T.strip("text") != "").select(
        *[c for c in blocks.columns if c not in ("bbox", "font_size", "text")],
        (F.col("bbox.x0") * scale).alias("x"), (F.col("bbox.y1") * scale).alias("y"),
        F.greatest(F.col("font_size") * scale * 0.9, F.lit(1.0)).alias("size"), "text",
    )


def recognised_layer(pages: DataFrame, text: str = "text", size: float = 8.0) -> DataFrame:
    """What pages without native text get in the searchable layer: their recognised text as one box of ``size`` points from the upper left corner; blank texts give nothing."""
    rest = [c for c in pages.columns if c != text]
    return pages.where(T.strip(text) != "").select(*rest, F.lit(0.0).alias("x"), F.lit(size).alias("y"), F.lit(size).alias("size"), F.col(text).alias("text"))


# --- queries -------------------------------------------------------------------------------------------------------


def _planted(spark: SparkSession, d: str) -> DataFrame:
    t = F.expr(r"concat(' ', replace(replace(replace(text, '. ', '.   '), 'ted ', 'te-\nd '), ',', ',\n\n\n\n'), unhex('C2A0'), chr(127))")
    return table(spark, d, "documents").select("doc_id", t.alias("text"))


_PLANTED = r"(select doc_id, ' ' || replace(replace(replace(text, '. ', '.   '), 'ted ', 'te-' || chr(10) || 'd '), ',', ',' || repeat(chr(10), 4)) || chr(160) || chr(127) as text from documents)"
_CLEAN = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, ' +', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '([a-z])-\n([a-z])', '\1\2', 'g'), '([a-z])-\n([a-z])', '\1\2', 'g'), '[^\x09\x0A\x0D\x20-\x7E\x{00A0}-\x{FFFF}]', '', 'g')"
)


def layout_clean(spark, d):
    """Every document, cleaned."""
    return _planted(spark, d).select("doc_id", T.layout_clean("text").alias("clean"))


def correction_changes(spark, d):
    """Tags of the correction steps of every document: unicode, layout (always), spelling stand-in (line breaks lost)."""
    raw = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    one = F.regexp_replace("text", "�", "")
    two = T.layout_clean(one)
    three = F.array_join(T.words(two), " ")
    tags = correction_tags(F.col("text"), [("unicode_fix", one, False), ("layout_clean", two, True), ("spell_correct", three, False)])
    return raw.select("doc_id", F.array_join(tags, ",").alias("tags"))


def spell_token_class(spark, d):
    """Tokens of all recognised text by what the spelling step does with them."""
    w = table(spark, d, "ocr_results").select(F.explode(F.split(F.trim("text"), r"[ \n\t\r]+")).alias("w")).where("w <> ''")
    return w.groupBy(T.token_class(F.col("w")).alias("class")).agg(F.count("*").alias("n"))


def fence_strip(spark, d):
    """Every answer about a figure without fences."""
    return table(spark, d, "diagram_analyses").select("diagram_id", T.fence_strip("raw_response").alias("clean"))


def json_defaults(spark, d):
    """Every answer about a figure, parsed."""
    a = table(spark, d, "diagram_analyses").select("diagram_id", parse_answer("raw_response").alias("a"))
    return a.select(
        "diagram_id", "a.diagram_type", "a.title", "a.description", F.array_join("a.labels", "|").alias("labels"), F.size("a.relationships").cast("long").alias("n_relationships"),
        F.array_join("a.colors_used", "|").alias("colors"), "a.has_text", "a.is_chart", "a.is_flowchart", "a.is_table", F.round("a.confidence", 6).alias("confidence"),
    )


def text_truncate(spark, d):
    """The first 3000, 500 and 200 characters of every document, by length and hash."""
    t = table(spark, d, "documents")
    return t.select("doc_id", *[F.md5(F.substring("text", 1, n)).alias(f"h{n}") for n in (3000, 500, 200)], F.length(F.substring("text", 1, 3000)).alias("n"))


def word_join(spark, d):
    """Word boxes joined by blanks and by line breaks."""
    o = table(spark, d, "ocr_results")
    w = F.transform("word_boxes", lambda x: x["text"])
    return o.select("ocr_id", F.array_join(w, " ").alias("blanks"), F.array_join(w, "\n").alias("breaks"))


def text_spans(spark, d):
    """Spans of made-up blocks, a block per line item."""
    li = table(spark, d, "lineitem")
    blocks = li.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.expr("l_linenumber % 4").alias("type"),
        F.expr("array(struct(concat('  ', l_returnflag, l_linestatus, ' ') as text, l_discount * 100 + 9 as size, cast(l_partkey % 16777216 as int) as color, cast(l_suppkey % 32 as int) as flags), struct('  ' as text, 9.0D as size, 0 as color, 0 as flags))").alias("spans"),
    )
    got = spans(blocks)
    return got.groupBy("text", "bold", "italic").agg(F.count("*").alias("n"), F.round(F.sum("r"), 4).alias("r"), F.round(F.sum("g"), 4).alias("g"), F.round(F.sum("b"), 4).alias("b"), F.round(F.sum("font_size"), 2).alias("size"))


def text_layer_projection(spark, d):
    """Place and size of every text block in the searchable layer at 150 dpi."""
    t = table(spark, d, "text_blocks").select("tb_id", "bbox", "font_size", "text")
    return text_layer(t, 150 / 72).select("tb_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.round("size", 4).alias("size"), F.length("text").alias("n"))


def recognised_layer_q(spark, d):
    """The box of every recognised page that has no native text."""
    native = table(spark, d, "text_blocks").where(T.strip("text") != "").where("source = 'native'").select("doc_id", "page_num").distinct()
    o = table(spark, d, "ocr_results").select("ocr_id", "doc_id", "page_num", "text").dropDuplicates(["ocr_id"])
    return recognised_layer(o.join(native, ["doc_id", "page_num"], "left_anti")).select("ocr_id", "x", "y", "size", F.md5("text").alias("text"))


QUERIES = {f.__name__.removesuffix("_q"): f for f in (layout_clean, correction_changes, spell_token_class, fence_strip, json_defaults, text_truncate, word_join, text_spans, text_layer_projection, recognised_layer_q)}
_STRIP = T.sql_strip
_FENCE = _STRIP(r"regexp_replace(raw_response, '(?m)^```json\s*|```$', '', 'g')")
_J = "case when ok then coalesce(json_extract_string(j, '$.{0}'), {1}) else {2} end as {3}"
SQL = {
    "layout_clean": f"select doc_id, {_STRIP(_CLEAN)} as clean from {_PLANTED}",
    "correction_changes": f"""with a as (select doc_id, text as t0, replace(text, chr(65533), '') as text from documents where text is not null),
      b as (select doc_id, t0, text as t1, {_STRIP(_CLEAN)} as t2 from a),
      c as (select *, regexp_replace(t2, '{T.SQL_SPACE_JAVA}+', ' ', 'g') as t3 from b)
      select doc_id, case when {_STRIP("t0")} = '' then '' else concat(case when t1 <> t0 then 'unicode_fix,' else '' end, 'layout_clean', case when t3 <> t2 then ',spell_correct' else '' end) end as tags from c""",
    "spell_token_class": r"""with w as (select unnest(regexp_split_to_array(trim(text), '[ \n\t\r]+')) as w from ocr_results)
      select case when regexp_matches(w, '^[0-9.,\-]+$') then 'number' when upper(w) = w and lower(w) <> w and length(w) > 1 then 'acronym'
        when upper(w[1]) = w[1] and lower(w[1]) <> w[1] then 'capital' else 'plain' end as class, count(*) as n from w where w <> '' group by 1""",
    "fence_strip": f"select diagram_id, {_FENCE} as clean from diagram_analyses",
    "json_defaults": rf"""with a as (select diagram_id, raw_response as raw, {_FENCE} as c from diagram_analyses), b as (select *, json_valid(c) and starts_with(c, '{{') and not regexp_matches(c, ',\s*[}}\]]') as ok, case when json_valid(c) then c::json end as j from a)
      select diagram_id, {_J.format("diagram_type", "'unknown'", "'unknown'", "diagram_type")}, {_J.format("title", "''", "''", "title")}, {_J.format("description", "''", "left(raw, 500)", "description")},
      case when ok then coalesce(array_to_string(from_json(json_extract(j, '$.labels'), '["VARCHAR"]'), '|'), '') else '' end as labels,
      case when ok then coalesce(json_array_length(json_extract(j, '$.relationships')), 0) else 0 end::bigint as n_relationships,
      case when ok then coalesce(array_to_string(from_json(json_extract(j, '$.colors_used'), '["VARCHAR"]'), '|'), '') else '' end as colors,
      {", ".join(f"case when ok then coalesce(json_extract_string(j, '$.{k}') = 'true', false) else false end as {k}" for k in ("has_text", "is_chart", "is_flowchart", "is_table"))},
      round(case when ok then coalesce(try_cast(json_extract_string(j, '$.confidence') as double), 0.5) else 0.3 end, 6) as confidence from b""",
    "text_truncate": "select doc_id, md5(left(text, 3000)) as h3000, md5(left(text, 500)) as h500, md5(left(text, 200)) as h200, length(left(text, 3000)) as n from documents",
    "word_join": "select ocr_id, array_to_string(list_transform(word_boxes, lambda x: x.text), ' ') as blanks, array_to_string(list_transform(word_boxes, lambda x: x.text), chr(10)) as breaks from ocr_results",
    "text_spans": """select concat(l_returnflag, l_linestatus) as text, (l_suppkey % 32)::int & 16 <> 0 as bold, (l_suppkey % 32)::int & 2 <> 0 as italic, count(*) as n,
      round(sum(((l_partkey % 16777216) >> 16 & 255) / 255.0::double), 4) as r, round(sum(((l_partkey % 16777216) >> 8 & 255) / 255.0::double), 4) as g, round(sum((l_partkey % 16777216 & 255) / 255.0::double), 4) as b,
      round(sum(round_even(l_discount * 100 + 9, 2)), 2) as size from lineitem where l_linenumber % 4 = 0 group by 1, 2, 3""",
    "text_layer_projection": f"select tb_id, round(bbox.x0 * (150 / 72.0::double), 4) as x, round(bbox.y1 * (150 / 72.0::double), 4) as y, round(greatest(font_size * (150 / 72.0::double) * 0.9::double, 1.0), 4) as size, length(text) as n from text_blocks where {_STRIP('text')} <> ''",
    "recognised_layer": f"with n as (select distinct doc_id, page_num from text_blocks where source = 'native' and {_STRIP('text')} <> '') select distinct ocr_id, 0.0::double as x, 8.0::double as y, 8.0::double as size, md5(text) as text from ocr_results o where {_STRIP('text')} <> '' and not exists (select 1 from n where n.doc_id = o.doc_id and n.page_num = o.page_num)",
}
