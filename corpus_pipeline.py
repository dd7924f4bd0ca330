"""A corpus made ready for training: the stages in order, each over all that its predecessor kept.

Toxic texts go, one document of each near-duplicate group stays, texts with benchmark passages go, the
sources are mixed to their target weights, and the rest is written as token ids. Every stage but the
last returns the columns of ``documents``, whatever these are. Rows that agree in doc_id and text count as
one document from the second stage on. Null and empty texts are neither toxic, nor near
anything, nor contaminated; the mix takes them as often as the whole part of their source's rate.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import decontamination, mixing, token_files, toxicity
from tickloom.llm.near_duplicates import near_duplicates
from tickloom.llm.shared import matching, stored, workspace
from tickloom.sources.store import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a toxicity score below the limit; learned from the labels of the documents given."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    column = "score" + "_" * max(map(len, docs.columns))
    return toxicity.score(docs, model, column).where(F.col(column) < toxicity.TOXIC).drop(column)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates (five-word shingles, 0.8)."""
    found = near_duplicates(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "high", "low")).alias("first")
    keepers = found.where("group is not null").groupBy("group").agg(first).select("first.*")
    wordless = found.where("group is null").select(F.col("doc_id").isNull().alias("nameless"), "doc_id", "high", "low")
    return matching(docs, keepers.unionByName(wordless), "one")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a run of ten words of a benchmark item."""
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    return matching(docs, found.where("contaminated"), "others")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the corpus; returns doc_id, start, n_tokens and ids_crc32 read back from them."""
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return token_files.read_documents(token_files.write_tokens(docs, vocabulary))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("token_ids", write_token_ids),
]

#: SQL can express neither learned weights nor the tokenizer; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each is written as Parquet and read as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with workspace(spark):
            docs = stored(stage(spark, docs, sf_dir), name, keep=True)
    return docs
