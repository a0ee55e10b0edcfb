"""Exact deduplication: sorted digest runs merged in rounds up a tree of partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnish.llm.common import WHITE, packed_key, small_batches, staged, text_of

#: How many runs one round merges into one.
FAN_IN = 16
_KEY = ["digest", "witness", "n_bytes"]


def _digests(docs: DataFrame, text_col: str) -> list:
    text = F.regexp_replace(text_of(docs, text_col), WHITE, " ")
    return [
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.xxhash64(text).alias("witness"),
        F.octet_length(text).alias("n_bytes"),
    ]


def _merge_round(runs: DataFrame, fan_in: int) -> DataFrame:
    """One round: ``fan_in`` neighbouring runs meet, sorted by digest, and leave one row per digest.

    The window's sort is the multiway merge. A digest brings one row per run at most, so even a
    text that fills the corpus gives a task no more than ``fan_in`` rows of it.
    """
    equal = Window.partitionBy("run", *_KEY).orderBy("first")
    whole = equal.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        runs.withColumn("run", F.floor(F.col("run") / fan_in))
        .select("*", F.row_number().over(equal).alias("place"), F.sum("copies").over(whole).alias("together"))
        .filter("place = 1")
        .select("run", *_KEY, "first", F.col("together").alias("copies"))
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical after every run of white space became one space; the
    row with the smallest id stays. A partition is a run; each run is first reduced to one row per
    digest with its smallest id, then ``fan_in`` runs merge per round until one is left, and the
    winners go back down to the runs. A digest counts as verified: rows are only joined when a
    second, unrelated hash and the byte length agree as well.

    Null text is empty text and equal to it. Null ids come after all others. Rows that agree in id
    and text count one by one in ``group_size`` and exactly one of them is kept. An empty table
    gives an empty result. Other columns are not looked at.
    """
    small_batches(docs.sparkSession)
    leaf = staged(
        docs.select(docs[id_col].alias("id"), *_digests(docs, text_col), F.monotonically_increasing_id().alias("row"))
    ).withColumn("run", F.shiftright("row", 33))
    first = F.struct(F.col("id").isNull().alias("no_id"), "id", "row")
    runs = leaf.groupBy("run", *_KEY).agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("copies"))
    top, level = runs, (leaf.agg(F.max("run")).first()[0] or 0) + 1
    while level > 1:
        top, level = _merge_round(top, fan_in), -(-level // fan_in)
    located = runs.select("run", *_KEY).join(top.drop("run"), _KEY)
    return leaf.join(located, ["run", *_KEY]).select(
        F.col("id").alias("doc_id"),
        F.col("first.id").alias("keep_id"),
        F.col("copies").alias("group_size"),
        (F.col("row") == F.col("first.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, with all their columns.

    Rows that agree in id and text are one document; which of them stays is not determined. Null
    ids equal each other, null texts are empty, an empty table stays empty, and columns of any
    name pass through. Documents are looked up by a hash join and not sorted; only rows whose id and text
    occur more than once are ranked.
    """
    found = staged(exact_dedup(docs, id_col, text_col, fan_in).select(packed_key(F.col("doc_id"), F.col("text_sha256")).alias("key"), "kept"))
    keys = found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept")).filter("kept")
    keys = staged(keys.select("key", "n"))
    digest = F.sha2(F.regexp_replace(text_of(docs, text_col), WHITE, " "), 256)
    packed = docs.select(packed_key(docs[id_col], digest).alias("key"), F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    once = packed.join(keys.filter("n = 1").hint("shuffle_hash"), "key", "left_semi").select("doc.*")
    if keys.filter("n > 1").isEmpty():
        return once
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.lit(1)))
    again = packed.join(keys.filter("n > 1").hint("shuffle_hash"), "key", "left_semi").withColumn("place", place).filter("place = 1")
    return once.unionByName(again.select("doc.*"))
