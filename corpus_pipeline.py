"""A training corpus from `documents`, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. `run` writes every stage's result as Parquet to the shared folder and
reads it back for the next one, so an executor lost later costs no earlier stage.
All stages but the last return the columns of `docs`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import bpe, langid, mixing, pii, simhash
from driftline.llm.common import materialise, small_batches, table
from driftline.llm.queries import DOMAIN_SQL, MIX, RANKS

#: A text is rejected only if no language is found or the best one is little more than a guess; short and mixed texts stay.
MIN_LANGUAGE_SCORE = 0.3
#: The mix of the registered query, but no document twice after deduplication.
ONE_EPOCH = mixing.MixParams(MIX.domains, MIX.langs, MIX.sources, MIX.budget_permille, 1, MIX.seed)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; null texts and texts without letters go."""
    small_batches(spark)
    model = langid.fit(docs)
    judged = docs.select(F.struct(*docs.columns).alias("_row"), langid.judged(docs, model).alias("_judged"))
    keep = (F.col("_judged.lang_pred") != langid.UNKNOWN) & (F.col("_judged.score") >= MIN_LANGUAGE_SCORE)
    return judged.where(keep).select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, the one with the smallest id."""
    small_batches(spark)
    return simhash.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by its kind in brackets and n_chars counted anew."""
    small_batches(spark)
    out = pii.redact(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the mix of target weights, each once."""
    return mixing.select(docs, F.expr(DOMAIN_SQL), ONE_EPOCH)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, their number, and whether they decode to its text."""
    small_batches(spark)
    coded = bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, keep=("lang", "source", "text"))
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("byte_bpe", byte_bpe),
]

#: Trained models and iterated graphs aren't SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
