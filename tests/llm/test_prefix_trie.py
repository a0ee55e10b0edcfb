"""The prefix trie against dictionaries of prefixes."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnish.llm.prefix_trie import _NO_ENDS, Path, _frame, _merged, close, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    said = lambda r: hashlib.md5((str(len((r[2] or "").encode())) + ":" + (r[2] or "") + (r[3] or "")).encode()).hexdigest()
    own = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            own[r[0]].append(r)
    for c, turns in own.items():
        turns.sort(key=lambda r: (r[1] is not None, r[1] or 0, said(r)))
        own[c] = [(r[2] or "", r[3] or "") for r in turns]
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        lead = own[c - c % 20] if c - c % 20 in own else []
        convs[c] = tuple(lead[:h] + turns[h:])
    return trie(convs, lambda turn: len(re.findall(r"[^\x20\x09-\x0D]+", turn[1])))


def trie(convs, words):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = defaultdict(set)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    out = []
    for p, ids in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = ",".join(map(str, sorted(c for c in ids if convs[c] == p)))
        saved = sum((len(members[q]) - 1) * words(q[-1]) for q in below if q)
        up = min(members[p[:-1]]) if p else None
        leaves = sum(q not in kids for q in below)
        out.append((min(ids), len(p), up, len(ids), len(kids[p]) if p in kids else 0, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, v if v is not None else 0) for v in r))


def same(df):
    got = [tuple(r) for r in prefix_trie(df, fan_in=2).collect()]
    assert ordered(got) == ordered(brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]))
    return got


@given(st.lists(st.lists(st.integers(0, 2), max_size=6), min_size=1, max_size=40), st.integers(0, 2**30))
@settings(max_examples=150, deadline=None)
def test_forests(convs, seed):
    """Random ranges of random sequences, merged in random groups of neighbours."""
    rng = random.Random(seed)
    turn = lambda t: bytes([t]) * 16
    groups = defaultdict(list)
    for c, turns in enumerate(convs):
        groups[tuple(turns)].append(c)
    paths = []
    for turns in sorted(groups):
        ids = groups[turns]
        ends = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        paths.append(Path(b"".join(map(turn, turns)), [t + 1 for t in turns], {len(turns): [len(ids), min(ids), 0, 0, 0, ends]}))
    frames, done = [], []
    while paths:
        n = rng.randint(1, 8)
        frames.append(_frame(len(frames), *close(paths[:n], whole=False)))
        paths = paths[n:]
    while True:
        done += [f[f["seq"].isna()] for f in frames]
        kept = [f[f["seq"].notna()] for f in frames]
        whole = len(kept) <= 3
        frames, n = [], 0
        while kept:
            n = len(kept) if whole else rng.randint(1, 3)
            frames.append(_merged(whole)((len(frames),), pd.concat(kept[:n])))
            kept = kept[n:]
        if whole:
            break
    rows = pd.concat([*done, *frames])
    low = dict(zip(rows["key"], rows["conv_id"]))
    got = []
    for _, r in rows.iterrows():
        up = r["parent_conv_id"] if r["parent_key"] is None else low[r["parent_key"]]
        got.append((r["conv_id"], r["depth"], up, r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]))
    expected = trie({c: tuple(t) for c, t in enumerate(convs)}, lambda t: t + 1)
    assert ordered(got) == ordered(expected)
    assert _NO_ENDS == hashlib.sha256().hexdigest()


@pytest.fixture
def many_ranges(spark):
    """Ranges of few sequences, whatever the size of the table."""
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "7"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_table(spark, many_ranges):
    same(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))


def test_odd(spark, many_ranges):
    rows = [(c, t, ["user", None, "assistant"][t % 3], ["hello there", "", None, "a\tb\x0bc", "ü " * 3000][(c // 3 + t) % 5]) for c in range(60) for t in range(c % 7)]
    rows += [(3, None, "user", "null first"), (3, None, "user", "null first"), (4, 1, "user", "x"), (4, 1, "a", "y"), (None, 0, "user", "lost")]
    rows += [(-3, 0, "user", "hello there"), (-40, 0, "user", "hello there"), (10**15, 0, None, None), (21, 0, "user", "alone")]
    rows += [(1000 + c, 0, "user", "hot first turn") for c in range(150)] + [(1000 + c, 1, "assistant", "hot") for c in range(0, 150, 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    same(df.withColumns({"key": F.lit(1), "seg": F.lit("x"), "depth": F.lit(None).cast("int")}))
    assert same(df.filter("false")) == []
    assert len(same(df.filter("conv_id = 10"))) > 0
