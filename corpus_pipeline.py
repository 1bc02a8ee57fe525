"""A training-data pipeline over `documents`: five stages, each written as Parquet and read again as the next one's input.

Every stage takes (spark, docs, sf_dir) and works on all rows of docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orthoplan.llm import bpe, language_id, line_templates, mixing, near_dedup, scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identifiable language (`und`) go; the others carry the predicted one.

    The machines learn from the labelled rows of the stage's own input. If it has none, nothing can be named: texts with
    a letter then stay as they are. Null and empty texts go; repeated rows fare alike.
    """
    model = language_id.learn(docs.select("doc_id", "text", "lang"))
    if not model.families:
        return docs.filter(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    named = language_id.identified(docs, model).filter("lang_pred <> 'und'")
    return named.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, but for their first document; a document that keeps no letter or digit goes with them.

    Documents that lose no line stay whatever they hold, null and empty ones too; repeated rows lose the same lines.
    """
    clean = line_templates.deduplicated(docs)
    left = (F.col("n_dropped") == 0) | F.col("text").rlike(r"[\p{L}\p{N}]")
    return clean.filter(left).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id (null ids come last).

    Rows are numbered first and compared as rows, so that different texts under one id, or without one, are judged by what
    they say and repeated rows are copies like any other. Texts without words are near nothing and stay.
    """
    rows = scratch.written(docs.select(F.monotonically_increasing_id().alias("row"), *COLUMNS), "near-rows")
    found = near_dedup.near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"), percent=75)
    of = found.select(F.col("doc_id").alias("row"), "component_id").join(rows.select("row", "doc_id"), "row")
    first = of.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")).alias("first"))
    return rows.join(first.select(F.col("first.row").alias("row")).hint("merge"), "row", "left_semi").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document is repeated as often as it is drawn. A null source is one of its own."""
    return mixing.drawn(docs, weights=[1, 2, 3], most=3.0).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE, encoded and decoded again: one row for each drawn copy. A null text counts as empty."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language", language), ("lines", lines), ("near", near), ("mix", mix), ("tokens", tokens)]

#: Language identification and token ids have no SQL form; tests compare the run with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES:
        docs = scratch.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
