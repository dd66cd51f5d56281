"""The corpus pipeline: quality, near duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. `run` writes each stage's result as
Parquet in the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fotolake.llm import quality
from fotolake.llm.common import MADE, drop, table, written
from fotolake.llm.decontaminate import without_leaks
from fotolake.llm.packing import pack
from fotolake.llm.queries import TOKENIZER
from fotolake.llm.secrets import redact
from fotolake.llm.simhash import without_near_copies

#: Near duplicates: word 5-shingles of a Jaccard similarity of 0.8 or more. Candidates differ in at most 80 of 256 bits of their
#: fingerprints: a pair at 0.8 differs in 39 to 40 on average (48 if 4 of 5 shingles are shared), with a deviation of 6, unrelated
#: texts in 128 with one of 8. Candidates are compared exactly.
WORDS, WIDTH, RADIUS, SIMILARITY = 5, 4, 80, 0.8


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; the field is trained on labelled documents among `docs`."""
    field, share = quality.train(docs, table(spark, sf_dir, "labels"), parts=3, held=1)
    return quality.without_rejected(docs, field, share)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest id; rows are judged by id and text, so null and repeated ids do no harm."""
    return without_near_copies(docs, words=WORDS, radius=RADIUS, width=WIDTH, similarity=SIMILARITY)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark question, or one re-parameterised, go."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kinds; no document goes."""
    return redact(docs, length_col="n_chars")


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2048 tokens."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("secrets", redact_secrets),
    ("packing", pack_windows),
]
#: The stages are classifiers, fingerprints and packing, which SQL does not express; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's tables, and its predecessor's result, go when its own result is written."""
    docs = table(spark, sf_dir, "documents")
    last: list[str] = []
    for name, stage in STAGES[:-1]:
        before = len(MADE)
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        done = [*last, *MADE[before:-1]]
        last = MADE[-1:]
        drop(spark, done)
    return STAGES[-1][1](spark, docs, sf_dir)
