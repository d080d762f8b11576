"""Problem 5: visually identical text with different characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.codepoints import unify_text
from leafmill.session import cut, table


#: Records of one class that a part of the join has on one side.
STRIDE = 1000


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src_table, doc_id, id, text and its one form, of text_blocks.text and corrected_texts.corrected.

    Null texts have no form; repeated rows stay.
    """
    tb = table(spark, sf_dir, "text_blocks").select(F.lit("text_blocks").alias("src_table"), "doc_id", F.col("tb_id").alias("id"), "text")
    ct = table(spark, sf_dir, "corrected_texts").select(F.lit("corrected_texts").alias("src_table"), "doc_id", F.col("ct_id").alias("id"), F.col("corrected").alias("text"))
    return unify_text(tb.unionAll(ct).where("text is not null and id is not null"), "text", "form")


def same_look(rows: DataFrame) -> DataFrame:
    """Pairs (src_table, id_a, id_b), id_a < id_b, of one doc_id whose forms are equal and whose texts are not.

    Rows need src_table, doc_id, id, text, form.  Only hashes are shuffled; forms that occur in one spelling only,
    nearly all, leave before the join.  A null doc_id matches no other; blank forms have nothing to see and give no pair.
    """
    keyed = cut(
        rows.where(r"doc_id is not null and form rlike '[^\\s\\p{Z}\\p{C}]'")
        .select("src_table", "doc_id", "id", F.xxhash64("form").alias("f"), F.xxhash64("text").alias("t"))
    )
    many = keyed.groupBy("src_table", "doc_id", "f").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count("*").alias("g")).where("lo <> hi")
    # a class of g records is joined in g / STRIDE parts: its pairs are many times what the copies of one side cost
    left = keyed.join(many.select("src_table", "doc_id", "f", F.ceil(F.col("g") / STRIDE).cast("int").alias("parts")), ["src_table", "doc_id", "f"]).distinct()
    a = left.select("src_table", "doc_id", "f", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.col("id").alias("id_a"), F.col("t").alias("ta"))
    b = left.select("src_table", "doc_id", "f", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("id").alias("id_b"), F.col("t").alias("tb"))
    return a.join(b, ["src_table", "doc_id", "f", "part"]).where("id_a < id_b and ta <> tb").select("src_table", "id_a", "id_b")


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record that reads as another of its document with other code points: (src_table, rec_id, doc_id, class_id, links).

    class_id is the hash of the form, links the number of records in the class with another text.  A record counts once.
    """
    rows = forms(spark, sf_dir).where(r"doc_id is not null and form rlike '[^\\s\\p{Z}\\p{C}]'")
    keyed = cut(rows.select("src_table", "doc_id", F.col("id").alias("rec_id"), F.xxhash64("form").alias("class_id"), F.xxhash64("text").alias("t")).distinct())
    each = keyed.groupBy("src_table", "doc_id", "class_id", "t").agg(F.count("*").alias("n"))
    every = each.groupBy("src_table", "doc_id", "class_id").agg(F.sum("n").alias("g"), F.count("*").alias("spellings")).where("spellings > 1")
    links = each.join(every, ["src_table", "doc_id", "class_id"]).select("src_table", "doc_id", "class_id", "t", (F.col("g") - F.col("n")).alias("links"))
    return keyed.join(links, ["src_table", "doc_id", "class_id", "t"]).select("src_table", "rec_id", "doc_id", "class_id", "links")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records of one document that read the same and differ in code points."""
    return same_look(forms(spark, sf_dir)).distinct()


def p5_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records whose text is not in its one form yet, with that form."""
    got = forms(spark, sf_dir).where("form <> text")
    return got.select("src_table", F.col("id").alias("rec_id"), "form").distinct()


QUERIES = {"p5_found": p5_found, "p5_classes": p5_classes, "p5_forms": p5_forms}
SQL: dict[str, str] = {}
