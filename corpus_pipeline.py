"""The corpus pipeline: documents in, token ids out, one text operator per stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnish.llm.decontaminate import drop_leaks
from tarnish.llm.exact_dedup import drop_copies
from tarnish.llm.near_copies import drop_near_copies
from tarnish.llm.queries import table, tokens
from tarnish.llm.toxicity import drop_toxic
from tarnish.session import staged


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go; they learn from the labels of those that came."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, the one with the smallest id."""
    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts whose five-word shingles are at least 0.8 similar stays, the one with the smallest id.

    Fingerprints find the links first, an exact join those they miss."""
    return drop_near_copies(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark, as it is or with other values, go."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every remaining text, with digests of the ids and of what they decode to."""
    digests = [F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")]
    return tokens(docs).select("doc_id", "n_tokens", "ids", *digests)


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_copies),
    ("near-dedup", near_copies),
    ("benchmark decontamination", leaks),
    ("byte-level bpe", token_ids),
]

#: Model scores, fingerprints and token ids are no SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
