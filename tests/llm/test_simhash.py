"""Fingerprints and components against all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tarnish.llm.simhash import child_masks, components, drop_near_duplicates, fingerprint, links, near_duplicates, near_edges


def plain_print(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Smallest index reachable over pairs of at most four differing bits."""
    values = np.array(prints, dtype=np.uint64)
    label = np.arange(len(values))
    near = [np.flatnonzero(np.bitwise_count(values ^ v) <= 4) for v in values]
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            return label
        label = new


def test_fingerprints(odd, small):
    for r in odd.collect() + small.collect():
        assert fingerprint(r["text"] or "") % (1 << 64) == plain_print(r["text"])


def test_near_duplicates(small, odd, empty):
    for df in (small, odd.filter("doc_id is not null")):
        rows = sorted(df.collect(), key=lambda r: r["doc_id"])
        prints = [plain_print(r["text"]) for r in rows]
        label = plain_components(prints)
        want = sorted((r["doc_id"], f"{p:016x}", rows[i]["doc_id"]) for r, p, i in zip(rows, prints, label))
        assert sorted(tuple(r) for r in near_duplicates(df).collect()) == want
        kept = drop_near_duplicates(df)
        assert kept.columns == df.columns
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted({w[2] for w in want})
    assert near_duplicates(empty).count() == 0 and drop_near_duplicates(empty).count() == 0
    assert near_duplicates(odd).count() == odd.count()


def cluster_prints(rng, n):
    centres = [rng.getrandbits(64) for _ in range(6)]
    out = set()
    while len(out) < n:
        value = rng.choice(centres)
        for _ in range(rng.randrange(7)):
            value ^= 1 << rng.randrange(64)
        out.add(value)
    return sorted(out)


@pytest.mark.parametrize("size", [1, 63, 64, 65, 300])
def test_bit_sliced_links(size):
    values = np.array(cluster_prints(random.Random(size), size), dtype=np.uint64)
    assert links(values, np.zeros(size, dtype=np.int64)).tolist() == plain_components(values).tolist()
    halves = np.repeat([0, 1], [size // 2, size - size // 2])
    got = links(values, halves)
    want = np.concatenate([plain_components(values[halves == 0]), size // 2 + plain_components(values[halves == 1])])
    assert got.tolist() == want.tolist()


@pytest.mark.parametrize("compared", [12, 16384])
def test_splitting_hot_buckets_loses_no_link(spark, compared):
    values = cluster_prints(random.Random(3), 150)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    root = {r["u"]: r["root"] for r in components(near_edges(df, compared)).collect()}
    label = plain_components(values)
    groups = {}
    for v, i in zip(signed, label):
        groups.setdefault(i, set()).add(root.get(v, v))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_masks_cover_all_bits():
    for mask in (0, (1 << 13) - 1, (1 << 60) - 1):
        children = child_masks(mask)
        union = 0
        for c in children:
            assert c & mask == mask
            union |= c
        assert union == (1 << 64) - 1 and len(children) <= 5


def test_long_chain(spark):
    n = 60
    edges = spark.range(n).select((F.col("id") + 1).alias("u"), F.col("id").alias("v"))
    assert {(r["u"], r["root"]) for r in components(edges).collect()} == {(i, 0) for i in range(1, n + 1)}
