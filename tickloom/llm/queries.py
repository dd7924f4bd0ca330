"""The operators on the given tables. Each query returns its operator's full result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import (
    alignment,
    bit_sliced,
    chat,
    decontamination,
    language,
    licenses,
    mixing,
    prefix_trie,
    sql,
    substrings,
    token_counts,
    token_files,
    toxicity,
)
from tickloom.llm.near_duplicates import near_duplicates
from tickloom.llm.shared import query
from tickloom.sources.store import table


@query("op1_minhash_near_dedup", sql.NEAR_DUPLICATES)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(table(spark, folder, "documents"), words=4)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query("op2_decontamination", sql.CONTAMINATION)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


@query("op3_token_ids")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return token_files.read_documents(token_files.write_tokens(table(spark, folder, "documents"), vocabulary))


@query("op4_license_scan")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """The table has no paths; a document lies in the folder of its language below that of its source."""
    docs = table(spark, folder, "documents")
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return licenses.scan(docs.select("doc_id", path.alias("path"), "text"))


@query("op5_top_k_bit_sliced", sql.TOP_K)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return bit_sliced.top_k(vectors, vectors.where(F.pmod("vec_id", F.lit(50)) == 0), 5)


@query("op6_chat_prefix_tree")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat.read_conversations(*chat.build_tree(turns.unionByName(more), vocabulary), vocabulary)


@query("op7_language_id")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = language.predict(docs, language.train(docs))
    return found.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous"
    )


@query("op8_toxicity")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, folder, "labels"))
    return toxicity.score(docs, model, "score").select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= toxicity.TOXIC, 1).otherwise(0).alias("predicted"),
    )


@query("op9_source_mixing")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    taken = mixing.copies(table(spark, folder, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query("op10_substring_dedup", sql.REPEATS)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, folder, "documents"), 50, keep_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op11_prefix_trie", sql.PREFIX_TRIE)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.sequences(table(spark, folder, "conversations"))))


@query("op12_token_counts")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op13_token_alignment")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
