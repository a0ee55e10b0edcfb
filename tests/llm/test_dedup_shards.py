"""Exact dedup and sharding against plain Python."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tarnish.llm.exact_dedup import drop_copies, exact_dedup
from tarnish.llm.sharding import assign_shards, first_map, rebalance, slot_rows


def normal(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def plain(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[normal(r["text"])].append(r["doc_id"])
    out = Counter()
    for text, ids in groups.items():
        digest = hashlib.sha256(text.encode()).hexdigest()
        keep = min((i for i in ids if i is not None), default=None)
        first = True
        for i in sorted(ids, key=lambda i: (i is None, i or 0)):
            out[i, keep, len(ids), first, digest] += 1
            first = False
    return out


@pytest.mark.parametrize("fan_in", [2, 16])
def test_groups(small, odd, fan_in):
    for df in (small.repartition(7), odd):
        got = exact_dedup(df, fan_in=fan_in)
        assert Counter(tuple(r) for r in got.collect()) == plain(df.collect())


def test_hot_text_and_empty(spark, empty):
    df = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same \t text")).otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text")
    )
    df = df.repartition(9)
    hot = exact_dedup(df, fan_in=2).filter("group_size > 1").agg(F.count("*"), F.max("keep_id"), F.sum(F.col("kept").cast("int"))).first()
    assert tuple(hot) == (1000, 0, 1)
    assert exact_dedup(empty).count() == 0


def test_drop_copies_keeps_rows_whole(odd, empty):
    kept = drop_copies(odd)
    assert kept.columns == odd.columns
    want = {t for (_, _, _, first, t), n in plain(odd.collect()).items() if first}
    texts = [hashlib.sha256(normal(r["text"]).encode()).hexdigest() for r in kept.collect()]
    assert sorted(texts) == sorted(want)
    assert drop_copies(empty).count() == 0


def check_shards(df, shards):
    rows = assign_shards(df, shards).collect()
    source = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in df.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == source
    places = defaultdict(list)
    for r in rows:
        places[r["shard"]].append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    return rows


def test_shards(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = check_shards(docs, 16)
    sums = Counter()
    for r in rows:
        sums[r["shard"]] += r["size"]
    mean = sum(sums.values()) / 16
    assert len(sums) == 16 and max(sums.values()) < 1.02 * mean and min(sums.values()) > 0.98 * mean
    check_shards(odd, 4)
    assert assign_shards(empty).count() == 0


def test_rebalancing_edits_the_map(spark):
    rows = slot_rows(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), slots=512)
    old = first_map(rows, 8)
    new = rebalance(rows, old, 9)
    a = {r["virtual_slot"]: r["shard"] for r in old.collect()}
    b = {r["virtual_slot"]: (r["shard"], r["version"]) for r in new.collect()}
    assert {v for _, v in b.values()} == {2} and set(a) == set(b)
    moved = [s for s in a if a[s] != b[s][0]]
    assert 0 < len(moved) < len(a) / 4
    sums = Counter()
    for r in new.collect():
        sums[r["shard"]] += r["n_bytes"]
    assert len(sums) == 9 and max(sums.values()) < 1.2 * sum(sums.values()) / 9
    fewer = rebalance(rows, new, 7)
    assert {r["shard"] for r in fewer.collect()} == set(range(7)) and fewer.first()["version"] == 3
