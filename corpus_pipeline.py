"""Documents to training tokens in stages; each is written as Parquet and reread as the documents of the next."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.bpe import encoded
from recordloom.llm.common import written
from recordloom.llm.mixture import mixed
from recordloom.llm.near_dup import kept_one_of_each
from recordloom.llm.pii import redacted
from recordloom.llm.quality import kept_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality rules reject, and without the boilerplate lines of the others.

    Null and empty texts fail; a null source is a host of its own; repeated rows stay or go together; documents keeps its
    columns, whatever further ones there are; an empty table gives an empty one."""
    return kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its five-word shingles: that with the smallest doc_id.

    Null and empty texts are no copies of anything; of repeated rows of a doc_id one stays; rows without doc_id all stay;
    an empty table gives an empty one."""
    return kept_one_of_each(docs, shingle=5)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With personal data and secrets replaced by their kind.

    Every row stays, null and empty texts as they are, repeated rows alike; an empty table gives an empty one."""
    return redacted(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often, and as far, as the mix of sources takes it, in the order of the mix.

    Null and empty texts are not taken; a null source is one of its own; repeated rows are taken each for itself; an empty
    table gives an empty one."""
    return mixed(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every document.

    Null and empty texts have no tokens; repeated rows stand for themselves; an empty table gives an empty one."""
    done = encoded(docs, public_tokenizers.path("word_bpe_49k.json"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [("quality", quality), ("near_duplicates", near_duplicates), ("pii", pii), ("mixture", mixture), ("bpe", bpe)]

#: SQL has no counterpart of MinHash components, boosted trees and BPE; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between stages the documents are a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
