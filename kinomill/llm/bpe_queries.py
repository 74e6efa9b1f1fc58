"""Token ids of all documents."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from kinomill.llm.bpe import encode_corpus
from kinomill.tables import table

#: Where the vocabulary files are, the same on every machine.
TOKENIZERS = "/opt/tokenizers"


def p6_ids(spark: SparkSession, folder: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    return encode_corpus(table(spark, folder, "documents"), os.path.join(tokenizers, "byte_bpe_50k.tiktoken"))


QUERIES = {"p6_ids": p6_ids}
ORACLES: dict[str, str] = {}
