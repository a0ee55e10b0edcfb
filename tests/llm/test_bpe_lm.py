"""BPE against tiktoken, language-model scores against plain counting."""

from __future__ import annotations

import base64
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tarnish.llm.bpe import _heap, _scan, decode, encode, load_ranks
from tarnish.llm.lm_score import BASE, Segments, build_filter, count_of, level_of, lm_score
from tarnish.llm.wordblocks import pack, pack_words, unpack, unpack_words

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(VOCABULARY, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_packing():
    values = np.array([0, 1, 255, 256, 1 << 31], dtype="<u4")
    assert unpack(pack(values)).tolist() == values.tolist() and len(unpack(pack(values[:0]))) == 0
    words = [b"", b"a", "ß".encode(), b"x" * 300]
    assert unpack_words(pack_words(words)) == words


def test_merging_orders_agree():
    ranks = load_ranks(VOCABULARY)
    rng = random.Random(5)
    for n in (1, 2, 3, 17, 64, 65, 400):
        for _ in range(40):
            word = bytes(rng.choice(b"aabbthe nr\xc3\xa9") for _ in range(n))
            assert _scan(word, ranks) == _heap(word, ranks)


def check_round_trip(df, reference, frame, **sizes):
    out = frame(decode(encode(df, VOCABULARY, public_tokenizers.PATTERN, **sizes), VOCABULARY))
    expected = Counter()
    for row in df.collect():
        ids = np.array(reference.encode_ordinary(row["text"] or ""), dtype="<u4")
        expected[row["doc_id"], len(ids), ids.tobytes(), (row["text"] or "").encode()] += 1
    assert Counter((None if math.isnan(d) else int(d), n, bytes(i), bytes(t)) for d, n, i, t in zip(out.doc_id.astype(float), out.n_tokens, out.ids, out.decoded)) == expected


def test_bpe_like_the_library(small, odd, empty, reference, frame):
    check_round_trip(small, reference, frame)
    check_round_trip(odd, reference, frame, block_bytes=6000, bucket_bytes=500)
    both = frame(encode(small, VOCABULARY, public_tokenizers.PATTERN, decoded=True))
    assert {d: bytes(t) for d, t in zip(both.doc_id, both.decoded)} == {r["doc_id"]: r["text"].encode() for r in small.collect()}
    assert decode(encode(empty, VOCABULARY, public_tokenizers.PATTERN), VOCABULARY).count() == 0


def test_bpe_of_random_unicode(spark, reference, frame):
    rng = random.Random(9)
    pool = "aeb  \n\t\r\x1c\x85\xa0 　'sLL1２½ñß中文한😀́?!_-̀﻿"
    rows = [(i, "".join(rng.choice(pool) for _ in range(rng.randrange(60)))) for i in range(400)]
    check_round_trip(spark.createDataFrame(rows, "doc_id long, text string"), reference, frame)


def plain_scores(rows):
    """The base model by definition."""

    def tokens(text):
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        return re.findall("[^\x20\x09-\x0d]+", lowered) + [None]

    def held(doc_id):
        return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2

    counts, pairs = Counter(), Counter()
    for doc_id, text in rows:
        if not held(doc_id):
            own = tokens(text)
            counts.update(own)
            pairs.update(zip([None, *own], own))
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for doc_id, text in rows:
        own = tokens(text)
        base = sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in own)
        score = 0.0
        for h, w in zip([None, *own], own):
            p = (counts[w] + 1) / (total + distinct + 1)
            c = pairs[h, w]
            c = min(float(count_of(level_of(np.array([c])))[0]), counts[h]) if c else 0
            score += math.log10((c + 16 * p) / (counts[h] + 16))
        out.append((doc_id, held(doc_id), len(own), sum(counts[t] > 0 for t in own), total, base, score))
    return out


@pytest.mark.parametrize("broadcast_bytes", [1 << 27, 0])
def test_lm_scores(small, odd, frame, broadcast_bytes):
    for df, sizes in ((small, {}), (odd, {"block_bytes": 6000, "bucket_bytes": 500})):
        got = frame(lm_score(df, broadcast_bytes=broadcast_bytes, **sizes)).astype({"doc_id": float}).sort_values(["doc_id", "n_tokens", "base_score"])
        want = plain_scores([(r["doc_id"], r["text"]) for r in df.collect()])
        want.sort(key=lambda r: (math.inf if r[0] is None else r[0], r[2], r[5]))
        for a, b in zip(got.itertuples(index=False), want, strict=True):
            assert (a.held_out, a.n_tokens, a.n_known, a.train_tokens) == b[1:5]
            assert abs(a.base_score - b[5]) < 1e-6 * max(1, abs(b[5]))
            # false hits of the filter only ever raise a pair's count
            assert -1e-6 * max(1, abs(b[6])) <= a.score - b[6] < 0.02 * abs(b[6]) + 0.5


def test_lm_ways_agree_and_survive_an_empty_table(small, empty, frame):
    a = frame(lm_score(small)).sort_values("doc_id", ignore_index=True)
    b = frame(lm_score(small, broadcast_bytes=0)).sort_values("doc_id", ignore_index=True)
    assert a.equals(b)
    assert lm_score(empty).count() == 0


def test_filter_has_no_misses():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 48, 5000).astype(np.uint64))
    counts = rng.integers(1, 2000, len(keys))
    data = build_filter(keys, counts).tobytes()
    held = Segments([(0, data)], 1, len(data))
    levels = held.levels(keys)
    assert (levels >= level_of(counts)).all() and (levels == level_of(counts)).mean() > 0.97
    others = np.setdiff1d(rng.integers(0, 1 << 48, 20000).astype(np.uint64), keys)
    assert (held.levels(others) > 0).mean() < 0.02
    assert np.all(np.abs(count_of(level_of(counts)) - counts) <= (BASE - 1) * counts)
