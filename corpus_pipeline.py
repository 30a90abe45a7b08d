"""From raw documents to token ids: language ID, exact dedup, near dedup, source mixing, byte-pair encoding.

Each stage works on what the one before it kept, written as Parquet and read again. All but the last return the columns of
documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tubula.llm import bpe, exact_dedup, language_id, mixing, near_dedup
from tubula.llm.common import cut, documents, drop, settled


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the model learns from documents of the same table.

    Null texts and those without a letter go, whatever their lang; with no lang to learn from, all texts with a letter stay;
    repeated rows are told row by row; texts of any length are read whole; no rows give none."""
    return language_id.accepted(docs, language_id.learn(language_id.to_learn(docs)))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with the same text but for white space: what an index that begins empty takes in.

    Null texts count as empty, and one of all empty ones stays; repeated rows leave one; ties go to the smallest doc_id, null
    last; no rows give none."""
    index = exact_dedup.DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    out = index.fresh(docs, "documents")
    index.drop()
    return out


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates.

    Null texts and those without words are linked with nothing and stay, as do rows without a doc_id; of a component the row with
    the smallest doc_id stays, and of rows that share it one; no rows give none."""
    return near_dedup.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice.

    A null text has size 0; a null source is a source of its own; repeated rows are taken one by one; no rows give none."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and digests of the ids and of the text they decode to; a row per row.

    Null texts count as empty and have no tokens; repeated rows and null ids stay rows of their own; no rows give none."""

    def work() -> DataFrame:
        out = bpe.encode(docs)
        return out.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

    return settled(work, "encoded")


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("source_mix", mix), ("bpe", tokens)]
#: Neither the learned language model, the rounding by hashes nor the encoding can be written in SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    before = None
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
