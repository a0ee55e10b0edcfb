"""Language-model scores from a log-frequency Bloom filter of n-gram counts."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnish.llm.common import remainder, staged
from tarnish.llm.wordblocks import BLOCK_BYTES, BUCKET_BYTES, pack, per_block, per_word, unpack, word_blocks, word_hashes

#: The end of a text; no word holds a space.
END = b" "
#: Counts are kept as levels: level q stands for counts from BASE^(q-1) to BASE^q.
BASE = 1.5
#: Bits of filter per inserted level, and hash probes per level.
BITS, PROBES = 10, 5
#: A filter up to this size is broadcast; beyond it the probes travel to the filter's segments.
BROADCAST_BYTES = 96 << 20
#: Weight of the unigram distribution in a bigram probability, in observations of the history.
PRIOR = 16.0
_KEY_BITS = np.uint64((1 << 48) - 1)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bigram_keys(hashes: np.ndarray, end: np.uint64, numbers: np.ndarray) -> np.ndarray:
    """A 48-bit key for each token and the one before it; the end of a text precedes the first token."""
    own = hashes[numbers]
    before = np.concatenate([[end], own[:-1]]).astype(np.uint64)
    return mix(before * _GOLDEN + own) & _KEY_BITS


def _by_bucket(keys: np.ndarray, counts: np.ndarray, buckets: int):
    """Sorted keys with their counts, cut into equal key ranges; differences of sorted keys pack well."""
    at = _bucket(keys, buckets)
    cuts = np.flatnonzero(np.diff(at, prepend=-1)).tolist() + [len(keys)]
    for a, b in zip(cuts, cuts[1:]):
        yield int(at[a]), pack(np.diff(keys[a:b], prepend=np.uint64(0)), "<u8"), pack(counts[a:b])


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def count_bigrams(numbers: np.ndarray, hashes: np.ndarray, buckets: int):
    """Bigram counts of a block's training texts, per key range."""
    keys, counts = np.unique(bigram_keys(hashes, hashes[numbers[-1]], numbers), return_counts=True)
    yield from _by_bucket(keys, counts, buckets)


# ------------------------------------------------------------------ the filter


def level_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / math.log(BASE) + 1e-9).astype(np.int64)


def count_of(levels: np.ndarray) -> np.ndarray:
    """The middle of a level's counts; 1 and 0 are exact."""
    middle = (BASE ** (levels - 1.0) + BASE**levels) / 2
    return np.where(levels <= 1, levels, middle)


def _position(keys: np.ndarray, level: int, probe: int, bits) -> np.ndarray:
    salt = (level * PROBES + probe + 1) * int(_GOLDEN) % (1 << 64)
    return (mix(keys + np.uint64(salt)) >> np.uint64(32)) * bits >> np.uint64(32)


def build_filter(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A filter (bytes) that holds every key once for each level up to that of its count."""
    levels = level_of(counts)
    bits = max(64, (BITS * int(levels.sum()) + 7) // 8 * 8)
    held = np.zeros(bits, dtype=bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        own = keys[levels >= level]
        for probe in range(PROBES):
            held[_position(own, level, probe, np.uint64(bits))] = True
    return np.packbits(held, bitorder="little")


def probe_filter(keys: np.ndarray, flat: np.ndarray, first: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The highest level up to which every probe of a key hits. ``first``: where the key's segment
    begins in ``flat``; ``bits``: its size, 0 where it has no segment."""
    levels = np.zeros(len(keys), dtype=np.int64)
    alive, level = np.flatnonzero(bits > 0), 0
    while len(alive):
        level += 1
        for probe in range(PROBES):
            at = _position(keys[alive], level, probe, bits[alive])
            byte = flat[first[alive] + (at >> np.uint64(3)).astype(np.int64)]
            alive = alive[(byte >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0]
        levels[alive] = level
    return levels


class Segments:
    """Filter segments side by side, one per key range."""

    def __init__(self, segments: Iterable[tuple[int, bytes]], buckets: int, size: int):
        self.first = np.zeros(buckets, dtype=np.int64)
        self.bits = np.zeros(buckets, dtype=np.uint64)
        self.flat = np.empty(size, dtype=np.uint8)
        self.buckets = buckets
        at = 0
        for bucket, data in segments:
            self.first[bucket], self.bits[bucket] = at, len(data) * 8
            self.flat[at : at + len(data)] = np.frombuffer(data, dtype=np.uint8)
            at += len(data)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        at = _bucket(keys, self.buckets)
        return probe_filter(keys, self.flat, self.first[at], self.bits[at])


def _merge(blobs: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([np.cumsum(unpack(k, "<u8"), dtype=np.uint64) for k in blobs["words"]])
    sums = np.concatenate([unpack(c) for c in blobs["counts"]]).astype(np.int64)
    keys, at = np.unique(keys, return_inverse=True)
    counts = np.zeros(len(keys), dtype=np.int64)
    np.add.at(counts, at, sums)
    return keys, counts


def filter_segments(blocks: DataFrame) -> DataFrame:
    """``bucket, data``: the filter of each key range, over the n-grams of all training texts."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        held = build_filter(*_merge(pdf))
        return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "data": [held.tobytes()]})

    grams = blocks.filter("kind = 'also'").select("bucket", "words", "counts")
    return staged(grams.groupBy("bucket").applyInPandas(run, "bucket long, data binary"))


def _answers(blocks: DataFrame, words: DataFrame, segments: DataFrame, buckets: int) -> DataFrame:
    """``block, keys, levels``: each block's distinct bigrams after a trip to the filter's segments."""

    def ask(texts: pd.DataFrame, numbers: np.ndarray, values: list[bytes]) -> pd.DataFrame:
        hashes = np.frombuffer(b"".join(values), dtype="<u8").reshape(-1, 2)[:, 1].astype(np.uint64)
        keys = np.unique(bigram_keys(hashes, hashes[numbers[-1]], numbers))
        parts = [(at, packed) for at, packed, _ in _by_bucket(keys, np.ones(len(keys)), buckets)]
        return pd.DataFrame(parts, columns=["bucket", "keys"]).assign(block=texts["block"].iloc[0])

    def answer(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        data = np.frombuffer(held["data"].iloc[0] if len(held) else b"", dtype=np.uint8)
        levels = []
        for packed in asked["keys"]:
            keys = np.cumsum(unpack(packed, "<u8"), dtype=np.uint64)
            size = np.full(len(keys), len(data) * 8, dtype=np.uint64)
            levels.append(pack(probe_filter(keys, data, np.zeros(len(keys), dtype=np.int64), size)))
        return asked[["block", "keys"]].assign(levels=levels)

    asked = per_block(blocks, words, ask, "block long, bucket long, keys binary")
    return asked.groupBy("bucket").cogroup(segments.groupBy("bucket")).applyInPandas(answer, "block long, keys binary, levels binary")


# ------------------------------------------------------------------- scoring


def score_texts(texts: pd.DataFrame, numbers: np.ndarray, values: list[bytes], n_train: int, n_distinct: int, prior: float, levels_of) -> pd.DataFrame:
    """Scores of a block's texts; ``levels_of`` gives the filter's levels for bigram keys."""
    known = np.frombuffer(b"".join(values), dtype="<u8").reshape(-1, 2)
    counts, hashes = known[:, 0].astype(np.int64), known[:, 1].astype(np.uint64)
    own = counts[numbers]
    history = np.concatenate([own[-1:], own[:-1]])  # each text ends with END, so END also precedes the next
    smooth = (own + 1) / (n_train + n_distinct + 1)
    keys = bigram_keys(hashes, hashes[numbers[-1]], numbers)
    pairs = np.minimum(count_of(levels_of(keys)), history)
    log_p = np.log10((pairs + prior * smooth) / (history + prior))
    start = np.cumsum(texts["n"]) - texts["n"]
    return pd.DataFrame(
        {
            "doc_id": texts["id"],
            "held_out": ~texts["flag"].astype(bool),
            "n_tokens": texts["n"],
            "n_known": np.add.reduceat((own > 0).astype(np.int64), start),
            "train_tokens": n_train,
            "base_score": np.add.reduceat(np.log10(smooth), start),
            "score": np.add.reduceat(log_p, start),
        }
    )


def split_words(text: str) -> list[bytes]:
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII space only
    words.append(END)
    return words


def lm_score(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prior: float = PRIOR,
    broadcast_bytes: int = BROADCAST_BYTES,
    block_bytes: int = BLOCK_BYTES,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """Score every text: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Learns from the rows whose crc32 of the id modulo 7 is not 2. ``base_score`` is the add-one
    unigram model with exact counts, which meet the words in the shuffle of distinct words.
    ``score`` is a bigram model: (c(h, w) + prior * p(w)) / (c(h) + prior) with p(w) the add-one
    unigram; c(h, w) comes from a log-frequency Bloom filter that holds the bigrams of all
    training texts as quantised levels, read by probing level after level until one misses.

    The filter grows with the number of bigrams. Its size is known before it is used: up to
    ``broadcast_bytes`` it is broadcast; a larger one stays in segments by key range, and each
    block's distinct bigrams travel to them and back. Both ways give the same scores.

    Null and empty texts have one token, the end. A null id counts as empty text for the
    remainder. Repeated rows are scored, and counted in training, one by one. An empty table
    gives an empty result. Other columns are not looked at.
    """
    kind = docs.select(docs[id_col]).dtypes[0][1]
    train = remainder(docs[id_col], 7) != 2
    blocks, buckets = word_blocks(docs, split_words, id_col, text_col, train, count_bigrams, block_bytes, bucket_bytes)

    def count_and_hash(words: list[bytes], counts: np.ndarray) -> list[bytes]:
        both = np.stack([counts.astype("<u8"), word_hashes(words, len(words))], axis=1).astype("<u8").tobytes()
        return [both[i : i + 16] for i in range(0, len(both), 16)]

    words = staged(per_word(blocks, count_and_hash))
    trained = F.zip_with("flags", "sizes", lambda flag, size: F.when(flag, size).otherwise(0))
    trained = F.aggregate(trained, F.lit(0).cast("long"), lambda a, b: a + b)
    n_train = blocks.filter("kind = 'text'").agg(F.sum(trained)).first()[0] or 0
    n_distinct = words.agg(F.sum("known")).first()[0] or 0
    segments = filter_segments(blocks)
    size = segments.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    schema = "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    if size <= broadcast_bytes:
        # at most broadcast_bytes reach the driver, an eighth of them at a time
        held = Segments(map(tuple, segments.coalesce(8).toLocalIterator()), buckets, size)
        shared = docs.sparkSession.sparkContext.broadcast(held)
        del held

        def score(texts: pd.DataFrame, numbers: np.ndarray, values: list[bytes]) -> pd.DataFrame:
            return score_texts(texts, numbers, values, n_train, n_distinct, prior, shared.value.levels)

        out = per_block(blocks, words, score, schema)
    else:
        answers = _answers(blocks, words, segments, buckets)

        def score_answered(texts: pd.DataFrame, numbers: np.ndarray, values: list[bytes], rest: pd.DataFrame) -> pd.DataFrame:
            keys = np.concatenate([np.cumsum(unpack(k, "<u8"), dtype=np.uint64) for k in rest["keys"]])
            levels = np.concatenate([unpack(v) for v in rest["levels"]]).astype(np.int64)
            order = np.argsort(keys)
            keys, levels = keys[order], levels[order]
            return score_texts(texts, numbers, values, n_train, n_distinct, prior, lambda k: levels[np.searchsorted(keys, k)])

        out = per_block(blocks, words, score_answered, schema, answers)
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))
