"""Lines to paragraphs, paragraphs to numbered sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import split_sentences


def split_paragraphs(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) -> (doc_id, paragraph, line_no, line). A null, empty or indented (U+3000) line is a boundary; lines of equal
    flag in a row are one part, and parts of empty lines alone are dropped."""
    flag = F.coalesce(F.col("line").isNull() | (F.col("line") == "") | F.col("line").startswith("　"), F.lit(True))
    order = Window.partitionBy("doc_id").orderBy("line_no")
    parts = lines.withColumn("_flag", flag).withColumn("_new", (F.col("_flag") != F.lag("_flag", 1).over(order)).cast("int"))
    parts = parts.withColumn("_part", F.sum(F.coalesce("_new", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    full = F.max(F.coalesce(F.col("line") != "", F.lit(False))).over(Window.partitionBy("doc_id", "_part"))
    kept = parts.withColumn("_full", full).where("_full").withColumn("paragraph", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("_part")))
    return kept.where(F.coalesce(F.col("line") != "", F.lit(False))).select("doc_id", "paragraph", "line_no", "line")


def number_sentences(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, paragraph, text) -> sentences numbered through the document from 1, paragraphs from 1."""
    cut = paragraphs.select("doc_id", "paragraph", F.posexplode(split_sentences(F.col("text"))).alias("pos", "sentence"))
    by = Window.partitionBy("doc_id")
    return cut.select(
        "doc_id",
        F.dense_rank().over(by.orderBy("paragraph")).alias("paragraph_order_id"),
        F.row_number().over(by.orderBy("paragraph", "pos")).alias("sentence_order_id"),
        F.col("sentence").alias("text"),
    )
