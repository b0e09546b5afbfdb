"""A training corpus from ``documents``: quality rules, near-dedup, suffix dedup, mixing and tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; ``run`` writes what a stage
returns as Parquet in the shared folder and hands the table it reads back to the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import byte_bpe, mixing, near_dedup, quality_rules, suffix_dedup
from quadrille.llm.common import load, stored


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned rules keep, with their columns.

    Null and empty texts have fewer than 10 words and go. Rows with equal texts are kept or go together; a null id is
    judged like any other. An empty table, or one of which nothing is kept, gives an empty one.
    """
    return quality_rules.judge(docs, load(spark, sf_dir, "labels")).where("kept").select(*docs.columns)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near duplicates, with its columns.

    It is that of the smallest id, null ids last; of rows equal in id and text any one stays, as they are the same text.
    Null and empty texts are one class. An empty table gives an empty one.
    """
    return near_dedup.first_of_classes(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the strings of 100 bytes that also start earlier; n_chars is that of the text left.

    Every row stays: a null text becomes the empty one, a text that is all repeats becomes empty. Rows of equal id do not
    cut each other, null ids come last. An empty table gives an empty one.
    """
    carry = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    left = suffix_dedup.dedup(docs, with_text=True, carry=carry).withColumn("n_chars", F.length("text").cast("long"))
    return left.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources repeats them: never, once or twice, with their columns.

    The null source is one of the sources. Documents without words take nothing of a target and come as their place in
    their source has it. Rows of equal id are taken together. An empty table gives an empty one.
    """
    return mixing.repeated(mixing.mix(docs)).select(*docs.columns)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix: a row for each row, those that repeat too.

    A null text has no tokens and the digests of nothing; an empty table gives an empty one.
    """
    return byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", keep_quality),
    ("near_dedup", keep_distinct),
    ("suffix_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("byte_bpe", to_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can express neither the learned rules nor the near-duplicate classes; tests compare with plain versions.
ORACLE_SQL = None
