"""Corpus sources: JSON lines, a limit on documents, a budget of bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def read_jsonl(spark: SparkSession, path: str, on_missing: str = "fail") -> DataFrame:
    """(doc_id, text) of a file with one JSON object a line. doc_id follows the file's order. A document
    without text is an error, or with on_missing="drop" is left out."""
    if on_missing not in ("fail", "drop"):
        raise ValueError(f"unknown on_missing {on_missing}")
    lines = spark.read.text(path).withColumn("doc_id", F.monotonically_increasing_id())
    docs = lines.filter(F.length(F.trim("value")) > 0).select("doc_id", F.from_json("value", "text string")["text"].alias("text"))
    if on_missing == "drop":
        return docs.filter(F.col("text").isNotNull())
    return docs.withColumn("text", F.coalesce("text", F.raise_error(F.lit("a document has no text")).cast("string")))


def first_documents(docs: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """The first n documents in the order of key; all of them where there are fewer."""
    return docs.orderBy(key).limit(n)


def byte_budget(docs: DataFrame, max_bytes: int, key: str = "doc_id", text: str = "text", buckets: int = 1024) -> DataFrame:
    """Documents in the order of key until their UTF-8 bytes reach max_bytes; the one that reaches it is
    included. Sums are taken over ranges of the key first, so only ranges meet in one partition."""
    sized = docs.withColumn("__bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint"))
    low, high = docs.agg(F.min(key), F.max(key)).first()
    if low is None:
        return docs
    width = max(1, -(-(high - low + 1) // buckets))
    ranged = sized.withColumn("__range", F.floor((F.col(key) - low) / width))
    ahead = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("__range").agg(F.sum("__bytes").alias("__sum")).withColumn("__before", F.coalesce(F.sum("__sum").over(ahead), F.lit(0))).filter(F.col("__before") < max_bytes).select("__range", "__before")
    inside = Window.partitionBy("__range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    kept = ranged.join(before, "__range").withColumn("__so_far", F.col("__before") + F.coalesce(F.sum("__bytes").over(inside), F.lit(0)))
    return kept.filter(F.col("__so_far") < max_bytes).select(*docs.columns)


def read_hex_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(id, token) of a file with one hexadecimal token a line."""
    lines = spark.read.option("wholetext", True).text(path).select(F.posexplode(F.split("value", "\r?\n")).alias("id", "h"))
    return lines.filter("h <> ''").select("id", F.unhex("h").alias("token"))
