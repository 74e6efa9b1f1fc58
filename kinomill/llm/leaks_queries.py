"""Evaluation items inside the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinomill.llm.leaks import WINDOW, find_leaks
from kinomill.tables import table


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    leaks = find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))
    return leaks.filter(F.col("words") >= WINDOW).select("doc_id", "item_id")


QUERIES = {"p7_found": p7_found}
#: Runs of ten words that both texts have, without markup, accents and punctuation.
ORACLES = {
    "p7_found": r"""
        WITH t AS (SELECT doc_id AS key, 0 AS kind, text FROM documents UNION ALL SELECT item_id, 1, text FROM eval_items),
        w AS (SELECT key, kind, string_split(trim(regexp_replace(regexp_replace(lower(strip_accents(regexp_replace(text, '</?[a-zA-Z][^<>]*>', ' ', 'g'))), '[\p{M}\p{Cf}]+', '', 'g'), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM t),
        g AS (SELECT DISTINCT key, kind, array_to_string(w[i:i+9], ' ') AS gram FROM (SELECT key, kind, w, unnest(range(1, len(w) - 8)) AS i FROM w WHERE len(w) >= 10))
        SELECT DISTINCT d.key AS doc_id, i.key AS item_id FROM g d JOIN g i ON d.gram = i.gram WHERE d.kind = 0 AND i.kind = 1""",
}
