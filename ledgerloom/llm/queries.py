"""Queries over the language-data problems, each through its operator and over whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import components, leakage, packing, sentences
from ledgerloom.session import table, tune

#: Where the public tokenizers lie.
TOKENIZERS = os.environ.get("LEDGERLOOM_TOKENIZERS", "/opt/tokenizers")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Every record of an accepted pair and its group."""
    tune(spark)
    pairs = table(spark, d, "links").where(components.accepted(F.col("decision"))).select("left_record_id", "right_record_id")
    return components.groups(pairs, "left_record_id", "right_record_id").select(F.col("node").alias("record_id"), F.col("group").alias("group_id"))


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    """Texts of all documents in containers of 2,048 tokens."""
    tune(spark)
    sized = packing.count_tokens(table(spark, d, "documents").select("doc_id", "source", "text"), "text", f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken")
    return packing.pack(sized.select("doc_id", "source", "n_tokens"), "doc_id", "source", "n_tokens").withColumnRenamed("key", "doc_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the evaluation items that they leak."""
    tune(spark)
    return leakage.leaks(leakage.shared_passages(table(spark, d, "documents"), table(spark, d, "eval_items")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """The last character of every sentence, headline and advert sentence of all documents."""
    tune(spark)
    documents = table(spark, d, "documents")
    return sentences.sentence_ends(documents, sentences.train(documents))


QUERIES = {f.__name__: f for f in (p5_found, p8_pack, p9_found, p10_found)}
SQL = {
    "p5_found": """WITH RECURSIVE e AS (SELECT DISTINCT a, b FROM (
        SELECT left_record_id AS a, right_record_id AS b FROM links WHERE lower(trim(decision, E' \\t\\n\\r')) = 'accepted' AND left_record_id <> right_record_id AND left_record_id <> '' AND right_record_id <> ''
        UNION ALL SELECT right_record_id, left_record_id FROM links WHERE lower(trim(decision, E' \\t\\n\\r')) = 'accepted' AND left_record_id <> right_record_id AND left_record_id <> '' AND right_record_id <> '')),
      r AS (SELECT a AS id, a AS other FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.other)
      SELECT id AS record_id, min(other) AS group_id FROM r GROUP BY 1""",
}
