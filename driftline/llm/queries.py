"""The subpackage's registered queries: thin wrappers that shape the operators' results.

`queries()` and `oracle_sql()` are what the driver's entry file adds.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embed, fingerprint, langid, mixing, pii, sharding, simhash, substring, toxicity
from .common import fold, table

#: Production weights: the crawl is large, curated and reference sources are worth more.
MIX = mixing.MixParams(domains={"crawl": 2, "curated": 5, "reference": 3}, langs={"en": 4, "de": 2, "fr": 2, "es": 2}, sources={"src3": 3, "src12": 2})
DOMAIN_SQL = "CASE WHEN source = 'src0' THEN 'crawl' WHEN length(source) = 4 THEN 'curated' WHEN source IS NOT NULL THEN 'reference' END"
RANKS = "byte_bpe_50k.tiktoken"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of ids that fold to 2 (mod 4) are never read."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(fold("doc_id", 4) != 2))
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; rows whose id folds to 1 (mod 3) are kept out of the training."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    model = langid.fit(docs.where(~held))
    return langid.predict(docs, model).select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 50-word windows that a smaller id holds too."""
    return substring.remove_repeats(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids and of the bytes decoded from them."""
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint, direct links and component of every document."""
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "n_near", "component_id")


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketch of every document and of its edited text, with their likenesses."""
    return fingerprint.neighbours(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: the fixed forms and what their contexts reveal."""
    return pii.find(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 shards of near-equal bytes."""
    return sharding.shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is in the mix of target weights."""
    return mixing.mix(table(spark, sf_dir, "documents"), F.expr(DOMAIN_SQL), MIX)


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return embed.near_duplicates(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_language_id": op2_language_id,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_byte_bpe": op4_byte_bpe,
        "op5_simhash": op5_simhash,
        "op6_fingerprint": op6_fingerprint,
        "op7_pii": op7_pii,
        "op8_sharding": op8_sharding,
        "op9_source_mix": op9_source_mix,
        "op10_embedding_dedup": op10_embedding_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_source_mix": mixing.sql(DOMAIN_SQL, MIX)}
