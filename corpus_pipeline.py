"""Corpus pipeline: quality rules, language ID, near-dedup, source mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of documents; the last returns a row of token ids for each document of the mix.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import byte_bpe, language_id, near_dup, quality_rules, source_mix
from quillspan.llm.common import read, settle, ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and every rule of the cascade keep."""
    return quality_rules.quality_rules(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; lang becomes the prediction. Texts without letters or unlike any language go."""
    ship(spark)
    return language_id.accepted(docs.select(*COLUMNS)).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest doc_id."""
    ship(spark)
    return near_dup.without_near_duplicates(docs.select(*COLUMNS), width=5, least=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often, and as far, as the mix takes them."""
    return source_mix.mixed_documents(docs.select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens and the ids of every document of the mix, after a round trip."""
    ship(spark)
    ranks = byte_bpe.load_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coded = byte_bpe.round_trip(docs.select("doc_id", "source", "lang", "text"), ranks, public_tokenizers.PATTERN)
    same = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "utf-8")
    n = F.floor(F.octet_length("ids") / 4).cast("long")
    return coded.select("doc_id", "source", "lang", n.alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("quality rules", quality),
    ("language ID", language),
    ("MinHash near-dedup", dedup),
    ("mixing sources to target weights", mixture),
    ("byte-level BPE", tokens),
]

#: SQL cannot express the stages; tests/llm hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
