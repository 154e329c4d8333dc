"""A training corpus from the documents table: language, toxicity, near copies, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again
as the next one's docs. All but the last keep the columns of documents, and extra ones.

Null and empty texts have no letter and go at the language stage, as do texts far from every learned
profile, such as those in a language that no row names. A null lang or source changes nothing. Rows
without a key stay, told apart by their texts; of rows alike in key and text one stays. Copies that tie
give way to the least key. Texts of any length are taken whole; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from verdigris.llm import language_id, packing, simhash, toxicity
from verdigris.llm.common import table, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without letters or like no profile go."""
    return language_id.keep_known(docs)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under one half for toxicity."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def no_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by five-word shingles."""
    return simhash.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", known_language), ("toxicity", not_toxic), ("near_duplicates", no_copies), ("packing", packed)]

#: SQL can express neither the learned stages nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents table, each written to the shared folder in between."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
