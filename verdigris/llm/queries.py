"""The queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import alignment, byte_bpe, hnsw, katz, language_id, leaderboard, media, packing, secret_scan, simhash, token_counts, toxicity, url_filters
from verdigris.llm.common import table


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's capture against the list entries that were active on its day."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filters.evaluate(url_filters.page_captures(pages), url_filters.page_entries(pages))
    return judged.withColumn("fetched", F.col("fetched").cast("string")).withColumn("valid_from", F.col("valid_from").cast("string"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of at most 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document by rank-order profiles."""
    return language_id.identify(table(spark, sf_dir, "documents"))


def op4_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copy class of every picture rendered from the embeddings, and of their edited copies."""
    return media.copies(media.rendered(table(spark, sf_dir, "embeddings")))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by a two-tier lookup."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document by subword-bag embeddings."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 100."""
    return hnsw.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document, links at two differing bits or fewer."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log probability of every document under a Katz backoff model."""
    return katz.score(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the local rank file and decoded again."""
    return byte_bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets, by a trigram index; built-in functions only."""
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's groups and links of two tokenizers, with the corpus-wide counts of the links."""
    return alignment.report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)


def op13_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes of every nation's board of ten items, by a stream of eight batches."""
    return leaderboard.feed(spark, *(table(spark, sf_dir, name) for name in ("sale_lines", "vendors", "items")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_packing": op2_packing,
    "op3_language_id": op3_language_id,
    "op4_media_copies": op4_media_copies,
    "op5_token_counts": op5_token_counts,
    "op6_toxicity": op6_toxicity,
    "op7_hnsw": op7_hnsw,
    "op8_simhash": op8_simhash,
    "op9_katz": op9_katz,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_secret_scan": op11_secret_scan,
    "op12_alignment": op12_alignment,
    "op13_leaderboard": op13_leaderboard,
}

#: DuckDB SQL for those that SQL can express.
SQL: dict[str, str] = {"op1_url_filters": url_filters.SQL, "op11_secret_scan": secret_scan.duck_sql(), "op13_leaderboard": leaderboard.SQL}
