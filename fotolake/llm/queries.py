"""The queries opN_<name>, each over its whole table with production parameters, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fotolake.llm import divergence, language, perplexity, prefix_trie, quality, toxicity, warc
from fotolake.llm.common import fold, table
from fotolake.llm.decontaminate import contaminated
from fotolake.llm.embedding_near import embedding_components
from fotolake.llm.html_text import html_text
from fotolake.llm.packing import pack
from fotolake.llm.secrets import scan
from fotolake.llm.simhash import simhash_components

#: The tokenizer file of the packing query; a parameter everywhere else.
TOKENIZER = "byte_bpe_50k.json"


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(table(spark, sf_dir, "pages"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"), words=4, radius=4)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), kept=400_000, chars=8_000_000)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights, bias = toxicity.train(docs, table(spark, sf_dir, "labels"), parts=4, held=2)
    found = toxicity.score(docs, weights, bias)
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(table(spark, sf_dir, "pages"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.predict(docs, language.profiles(docs, parts=5, held=0))
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field, share = quality.train(docs, table(spark, sf_dir, "labels"), parts=3, held=1)
    found = quality.score(docs, field, share)
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op10_embedding_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(table(spark, sf_dir, "embeddings"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.quality_rules(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_decontaminate": op2_decontaminate,
    "op3_simhash": op3_simhash,
    "op4_packing": op4_packing,
    "op5_toxicity": op5_toxicity,
    "op6_warc": op6_warc,
    "op7_language": op7_language,
    "op8_secrets": op8_secrets,
    "op9_quality": op9_quality,
    "op10_embedding_near": op10_embedding_near,
    "op11_quality_rules": op11_quality_rules,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_divergence": op13_divergence,
}
ORACLE: dict[str, str] = {"op6_warc": warc.ORACLE, "op12_prefix_trie": prefix_trie.ORACLE, "op13_divergence": divergence.ORACLE}
