"""Statistics of the documents' texts, and the documents that are not prose."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinomill.llm.texttype import PROSE, classify, statistics
from kinomill.tables import table


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return classify(table(spark, folder, "documents")).filter(F.col("type") != PROSE).select("doc_id")


def p8_types(spark: SparkSession, folder: str) -> DataFrame:
    return classify(table(spark, folder, "documents"))


def p8_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return statistics(table(spark, folder, "documents")).withColumnRenamed("key", "doc_id")


QUERIES = {"p8_found": p8_found, "p8_types": p8_types, "p8_statistics": p8_statistics}
ORACLES: dict[str, str] = {}
