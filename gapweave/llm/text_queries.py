"""Queries on the text corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapweave.llm.leaks import leaks
from gapweave.llm.tokens import decode, token_ids
from gapweave.llm.truncation import truncated
from gapweave.runtime import table


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return token_ids(table(spark, d, "documents"), "doc_id", "text")


def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    back = decode(token_ids(docs, "doc_id", "text"), "doc_id").withColumnRenamed("text", "decoded")
    return docs.join(back, "doc_id").select("doc_id", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "item_text")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items and leaking documents by suite."""
    items = table(spark, d, "eval_items").select("item_id", "suite")
    found = p8_found(spark, d).join(items, "item_id")
    return found.groupBy("suite").agg(F.count_distinct("item_id").alias("items"), F.count_distinct("doc_id").alias("documents"))


def stops(spark: SparkSession, d: str) -> DataFrame:
    return truncated(table(spark, d, "documents"), "doc_id", "text", "source", "lang")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return stops(spark, d).where("truncated").select("doc_id")


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    """How many texts of each source are cut, of those that hold anything."""
    rows = stops(spark, d).where("odds is not null").groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.count_if("truncated").alias("cut"))
    return rows.withColumn("rate", F.round(F.col("cut") / F.col("texts"), 6))


_WORDS = r"regexp_extract_all(regexp_replace(lower({t}), '\\[a-z]*', ' ', 'g'), '[a-z0-9]+')"
_GRAMS = """select distinct {id}, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) as g
  from (select {id}, {words} as w from {table} where {t} is not null) x"""
_FOUND = (
    "select distinct d.doc_id, i.item_id from ("
    + _GRAMS.format(id="doc_id", t="text", table="documents", words=_WORDS.format(t="text"))
    + ") d join ("
    + _GRAMS.format(id="item_id", t="item_text", table="eval_items", words=_WORDS.format(t="item_text"))
    + ") i on d.g = i.g"
)
ORACLES = {
    "p7_round_trip": "select doc_id, true as same from documents",
    "p8_found": _FOUND,
    "p8_report": f"select suite, count(distinct f.item_id) as items, count(distinct doc_id) as documents from ({_FOUND}) f join eval_items e on f.item_id = e.item_id group by suite",
}
QUERIES = {"p7_ids": p7_ids, "p7_round_trip": p7_round_trip, "p8_found": p8_found, "p8_report": p8_report, "p9_found": p9_found, "p9_rates": p9_rates}
