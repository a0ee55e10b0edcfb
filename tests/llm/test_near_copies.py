"""Near copies of the pipeline against the Jaccard similarity of all pairs."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tarnish.llm import near_copies
from tarnish.llm.near_copies import _candidates, _levels, _prefixes, _shared, drop_near_copies, shingles, similar
from tarnish.llm.simhash import fingerprint, near_pairs


def plain_kept(rows):
    """Ids that stay when every pair with a five-word Jaccard similarity of 0.8 links."""
    sets = {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        sets[r["doc_id"]] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = list(sets)
    pairs = 0
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and 10 * len(a & b) >= 8 * len(a | b):
                pairs += 1
                low, high = sorted((root(i), root(j)))
                label[high] = low
    return {i for i in ids if root(i) == i}, pairs


def changed(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def copies(spark):
    """Texts with one to twelve words changed: similarities on both sides of 0.8; a common line; a large group."""
    rng = random.Random(5)
    texts = []
    for _ in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(40, 300))]
        texts += [" ".join(words)] + [changed(rng, words, rng.randrange(1, 13)) for _ in range(3)]
    line = "this very common line stands in many of the texts here "
    texts += [line + " ".join(f"w{rng.randrange(3000)}" for _ in range(30)) for _ in range(80)]
    group = [f"g{i}" for i in range(200)]
    texts += [changed(rng, group, 3) for _ in range(70)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)


@pytest.mark.parametrize("hot", [2, 32])
def test_all_similar_pairs_link(copies, hot):
    want, pairs = plain_kept(copies.collect())
    assert pairs > 60
    assert {r["doc_id"] for r in drop_near_copies(copies, hot=hot).collect()} == want


def test_pipeline_stage(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = corpus_pipeline.exact_copies(spark, docs, "")
    want, pairs = plain_kept(docs.collect())
    assert pairs and {r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect()} == want
    rows = odd.filter("doc_id is not null")
    kept = drop_near_copies(rows)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == plain_kept(rows.collect())[0]
    assert drop_near_copies(empty).count() == 0
    assert drop_near_copies(odd.withColumn("node", F.lit(1))).count() == kept.count()


def test_candidates_grow_like_the_texts(spark):
    """A line that all texts hold makes no pair a candidate; near copies stay candidates."""
    line = " ".join(f"line{i}" for i in range(20))

    def found(n):
        rng = random.Random(n)
        rows = []
        for _ in range(n):
            words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(60, 90))]
            rows += [" ".join(words) + " " + line, changed(rng, words, 1) + " " + line]
        texts = spark.createDataFrame(list(enumerate(rows)), "node long, text string").repartition(4)
        shared = _shared(_prefixes(texts, 0.8)).withColumn("root", F.col("node"))
        return _candidates(shared, 0.8).count()

    few, many = found(50), found(200)
    assert 50 <= few <= 60 and 200 <= many <= 240


def test_levels_count_all_texts(spark):
    texts = spark.createDataFrame([(f"one very common line here w{i} x{i} y{i} z{i} q{i}",) for i in range(300)], "text string")
    levels = _levels(texts, 1 << 12)
    common = shingles("one very common line here")[0] % (1 << 12)
    assert levels[common] >= 8 and (levels > 0).sum() < 100


def test_short_texts_of_one_repeated_word(spark):
    """Five equal words and six are the same set of shingles."""
    rows = spark.createDataFrame([(1, "a a a a a"), (2, "a a a a a a"), (3, "a a a a")], "doc_id long, text string")
    assert {r["doc_id"] for r in drop_near_copies(rows).collect()} == {1, 3}


def test_fingerprints_link(spark, monkeypatch):
    """Near copies are found by operator 6's fingerprints before any shingle is joined; links less similar than 0.8 do not count."""
    rng = random.Random(3)
    rows = []
    for _ in range(30):
        words = [f"w{rng.randrange(3000)}" for _ in range(400)]
        rows += [" ".join(words), changed(rng, words, 1), " ".join(words).upper()]
    rows += ["x y z", "x  y Z", "", " "]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    prints = {i: fingerprint(text) % (1 << 64) for i, text in enumerate(rows)}
    sets = {i: shingles(text) for i, text in enumerate(rows)}
    label = {i: i for i in prints}
    for i, j in ((i, j) for i in prints for j in prints if i < j and (prints[i] ^ prints[j]).bit_count() <= 4):
        if similar(sets[i], sets[j]):
            low, high = sorted((label[i], label[j]))
            label = {k: low if r == high else r for k, r in label.items()}
    want = {i for i, r in label.items() if i == r}
    assert 40 < len(rows) - len(want)
    nothing = spark.createDataFrame([], "h long, node long, n int")
    monkeypatch.setattr(near_copies, "_prefixes", lambda texts, least: nothing)
    assert {r["doc_id"] for r in drop_near_copies(docs).collect()} == want


def test_pairs_of_fingerprints(spark):
    """The pairs connect what brute force connects, equal fingerprints too."""
    rng = random.Random(4)
    prints = [rng.getrandbits(64) for _ in range(40)]
    prints += [p ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for p in prints for _ in range(3)] + prints[:5]
    signed = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
    pairs = [(r["a"], r["b"]) for r in near_pairs(spark.createDataFrame(signed, "id long, fp long"), compared=4).collect()]

    def parts(pairs):
        label = list(range(len(prints)))
        for i, j in pairs:
            low, high = sorted((label[i], label[j]))
            label = [low if r == high else r for r in label]
        return label

    near = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    assert parts(pairs) == parts(near) and len(set(parts(near))) <= 40


def test_a_shared_line_is_not_enough(spark):
    """Texts that share a line with a few others, too few for the counters to see, drop out before pairs are made."""
    rng = random.Random(6)
    rows = []
    for i in range(90):
        line = " ".join(f"line{i // 3}x{j}" for j in range(7))
        rows.append(line + " " + " ".join(f"w{rng.randrange(10**7)}" for _ in range(100)))
    rows.append(changed(rng, rows[0].split(), 1))
    texts = spark.createDataFrame(list(enumerate(rows)), "node long, text string").repartition(4)
    shared = _shared(_prefixes(texts, 0.8))
    assert {r["node"] for r in shared.collect()} == {0, 90}
    pairs = _candidates(shared.withColumn("root", F.col("node")), 0.8).collect()
    assert [(r["a"], r["b"]) for r in pairs] == [(90, 0)]


def test_short_texts_of_all_sizes(spark):
    """No pair is lost where the rounded lengths of prefixes do not grow with the text."""
    rng = random.Random(7)
    rows = []
    for size in range(5, 65):
        words = [f"s{size}w{i}" for i in range(size)]
        rows += [" ".join(words[: size - cut]) for cut in range(1 + size // 4)] + [changed(rng, words, 1)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    texts = docs.select(F.col("doc_id").alias("node"), "text")
    found = _candidates(_shared(_prefixes(texts, 0.8)).withColumn("root", F.col("node")), 0.8).collect()
    sets = [shingles(text) for text in rows]
    want = {(a, b) for a in range(len(rows)) for b in range(a) if similar(sets[a], sets[b])}
    assert len(want) > 500 and want <= {(r["a"], r["b"]) for r in found}
    assert {r["doc_id"] for r in drop_near_copies(docs).collect()} == plain_kept(docs.collect())[0]
