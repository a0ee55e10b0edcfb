"""SimHash near-duplicates: fingerprints compared as vertical bit planes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnish.llm.common import packed_key, small_batches, staged, text_of

RADIUS, SHINGLE = 4, 4
#: Buckets up to this many distinct fingerprints are compared; larger ones are split by more bits.
COMPARED = 1 << 14
#: Candidate rows that one task takes.
ROWS_PER_TASK = 1 << 20
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
_CHUNK = 1 << 16

# --------------------------------------------------------------- fingerprints


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64 majority votes over the hashes of all word shingles, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    spans = zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist())
    hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in spans), dtype=np.uint64, count=n)
    votes = np.zeros(64, dtype=np.int64)
    for i in range(0, n, _CHUNK):
        bits = np.unpackbits(hashes[i : i + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<i8")[0])


def fingerprint_column(text):
    """The fingerprint as a signed 64-bit column."""

    @F.pandas_udf("long")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in texts:
            yield pd.Series([fingerprint(t) for t in column], dtype="int64")

    return run(text)


# -------------------------------------------------------------- bit-sliced search


def bit_planes(values: np.ndarray) -> np.ndarray:
    """Blocks of 64 fingerprints stored vertically: word ``[block, b]`` holds bit b of all 64."""
    blocks = -(-len(values) // 64)
    padded = np.zeros(blocks * 64, dtype="<u8")
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(blocks, 64, 8), axis=2, bitorder="little")
    return np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little").reshape(blocks, 512).view("<u8")


def near_lanes(queries: np.ndarray, planes: np.ndarray, at: np.ndarray, lanes: np.ndarray):
    """For each query and block ``at``: which of the block's 64 lanes lie within the radius.

    All distances of a block are counted at once: two planes at a time enter a carry-save adder
    whose digits are ones, twos and fours, one bit per lane; 5 to 7 show in the digits, 8 as the
    carry out of the fours, so the digits are made for a radius of 4. A block whose lanes all exceed the
    radius is abandoned. ``lanes`` marks the lanes to look at. Returns (pair index, lane mask).
    """
    pair = np.arange(len(queries))
    ones = np.zeros(len(pair), dtype=np.uint64)
    twos, fours, dead = ones.copy(), ones.copy(), ~lanes
    for b in range(0, 64, 2):
        differ = []
        for bit in (b, b + 1):
            flip = np.where((queries[pair] >> np.uint64(bit)) & np.uint64(1) > 0, _ONES, np.uint64(0))
            differ.append(planes[at[pair], bit] ^ flip)
        half = ones ^ differ[0]
        carry = (ones & differ[0]) | (half & differ[1])
        ones = half ^ differ[1]
        more = twos & carry
        twos ^= carry
        dead |= fours & more
        fours ^= more
        dead |= fours & (ones | twos)
        if b % 8 == 6:
            live = dead != _ONES
            pair, ones, twos, fours, dead = pair[live], ones[live], twos[live], fours[live], dead[live]
            if not len(pair):
                break
    return pair, ~dead


class Labels:
    """Smallest connected index of each of n items, joined pair by pair in bulk."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            left, right = self.of[a], self.of[b]
            open_ = left != right
            if not open_.any():
                return
            a, b = a[open_], b[open_]
            low, high = np.minimum(left, right)[open_], np.maximum(left, right)[open_]
            np.minimum.at(self.of, high, low)
            while True:
                up = self.of[self.of]
                if (up == self.of).all():
                    break
                self.of = up


def links(values: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """For fingerprints sorted by bucket: the index of the first one each is connected to inside it."""
    labels = Labels(len(values))
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-2))
    sizes = np.diff(cuts)
    # every bucket starts a new block of planes
    blocks = -(-sizes // 64)
    first_block = np.cumsum(blocks) - blocks
    own = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(len(values)) - cuts[own]
    padded = np.zeros(int(blocks.sum()) * 64, dtype="<u8")
    slot = first_block[own] * 64 + inside
    padded[slot] = values
    item = np.full(len(padded), -1)
    item[slot] = np.arange(len(values))
    planes = bit_planes(padded)
    # an item meets the blocks from its own on, and there only later lanes
    reach = first_block[own] + blocks[own] - slot // 64
    reach[sizes[own] < 2] = 0
    ends = np.cumsum(reach)
    for low in range(0, int(ends[-1]) if len(ends) else 0, _CHUNK):
        k = np.arange(low, min(low + _CHUNK, int(ends[-1])))
        i = np.searchsorted(ends, k, side="right")
        at = slot[i] // 64 + k - (ends[i] - reach[i])
        filled = np.minimum(sizes[own[i]] - (at - first_block[own[i]]) * 64, 64).astype(np.uint64)
        lanes = _ONES >> (np.uint64(64) - filled)
        same = at == slot[i] // 64
        after = ~(_ONES >> (np.uint64(63) - (slot[i] % 64).astype(np.uint64)))
        pair, near = near_lanes(values[i], planes, at, np.where(same, lanes & after, lanes))
        for lane in range(64):
            hit = (near >> np.uint64(lane)) & np.uint64(1) > 0
            if hit.any():
                labels.join(i[pair[hit]], item[at[pair[hit]] * 64 + lane])
    return labels.of


# ---------------------------------------------------------------- candidates


def child_masks(mask: int, radius: int = RADIUS) -> list[int]:
    """The mask with one more of radius + 1 nearly equal parts of the bits it leaves open.

    Two fingerprints that agree under the mask and differ in at most ``radius`` bits differ in
    none of the bits of some part, so they agree under one of the children.
    """
    free = [b for b in range(64) if not mask >> b & 1]
    parts = np.array_split(np.array(free, dtype=np.int64), radius + 1)
    return [mask | sum(1 << int(b) for b in part) for part in parts if len(part)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _compared(candidates: DataFrame, n_rows: int) -> DataFrame:
    """Edges ``u, v`` (v the smaller) that connect what is near inside each bucket."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["mask", "held", "fp"], ignore_index=True)
        mask, held = pdf["mask"].to_numpy(), pdf["held"].to_numpy()
        change = (np.diff(mask, prepend=mask[0]) != 0) | (np.diff(held, prepend=held[0]) != 0)
        root = links(pdf["fp"].to_numpy().view(np.uint64), np.cumsum(change))
        linked = root != np.arange(len(root))
        return pd.DataFrame({"u": pdf["fp"][linked], "v": pdf["fp"].to_numpy()[root[linked]]})

    tasks = max(candidates.sparkSession.sparkContext.defaultParallelism, -(-n_rows // ROWS_PER_TASK))
    task = F.pmod(F.xxhash64("mask", "held"), F.lit(tasks))
    return candidates.withColumn("task", task).groupBy("task").applyInPandas(run, "u long, v long")


def near_edges(prints: DataFrame, compared: int = COMPARED) -> DataFrame:
    """Edges between distinct fingerprints ``fp`` whose connected parts are those of all links.

    Fingerprints that share the bits of a mask form a bucket; the first masks are the five parts of
    the 64 bits. A bucket with more than ``compared`` members is split by more bits instead of
    compared, again and again, until it is small enough; a bucket with few bits open is.
    """
    spark = prints.sparkSession
    masks = F.array(*[F.lit(_signed(m)) for m in child_masks(0)])
    level = prints.select("fp", F.explode(masks).alias("mask"))
    edges = None
    while True:
        level = staged(level.withColumn("held", F.col("fp").bitwiseAND(F.col("mask"))))
        sizes = level.groupBy("mask", "held").agg(F.count(F.lit(1)).alias("n"))
        hot = staged(sizes.filter(F.col("n") > compared).select("mask", "held"))
        small = level.join(hot, ["mask", "held"], "left_anti")
        found = _compared(small, level.count())
        edges = found if edges is None else edges.unionByName(found)
        # there are at most as many masks as ways to pick parts, whatever the input
        open_masks = [r["mask"] for r in hot.select("mask").distinct().collect()]
        if not open_masks:
            return edges.distinct()
        children = spark.createDataFrame(
            [(m, _signed(c)) for m in open_masks for c in child_masks(m % (1 << 64))], "mask long, child long"
        )
        again = level.join(hot, ["mask", "held"], "left_semi").join(F.broadcast(children), "mask")
        level = again.select("fp", F.col("child").alias("mask")).distinct()


def near_pairs(rows: DataFrame, compared: int = COMPARED) -> DataFrame:
    """``a, b``: pairs of ids of ``id, fp`` that connect what links of fingerprints connect.

    Of equal fingerprints each is paired with the smallest id, and an edge between two fingerprints
    pairs their smallest ids. So there are at most six pairs a row and level of buckets.
    """
    rows = staged(rows)
    lowest = staged(rows.groupBy("fp").agg(F.min("id").alias("low")))
    equal = rows.join(lowest, "fp").filter("id != low").select(F.col("id").alias("a"), F.col("low").alias("b"))
    u, v = (lowest.select(F.col("fp").alias(c), F.col("low").alias(to)) for c, to in (("u", "a"), ("v", "b")))
    return equal.unionByName(near_edges(lowest.select("fp"), compared).join(u, "u").join(v, "v").select("a", "b"))


def components(edges: DataFrame) -> DataFrame:
    """``u, root``: the smallest member connected to each u that is not itself the smallest.

    Alternating stars: every node hooks its larger neighbours, then its smaller ones, to the
    smallest neighbour, until nothing changes. Rounds grow with the logarithm of the longest path.
    """
    edges = staged(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = staged(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select("u", F.col("v").alias("root"))
        before = state


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", compared: int = COMPARED) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint, component_id``.

    A fingerprint has a bit where over half of the XXH64 hashes of the text's 4-word shingles have
    it. Fingerprints link at 4 or fewer differing bits; ``component_id`` is the smallest id that
    links reach, the own id included. Equal fingerprints are compared once, so copies cost nothing.

    Null and empty texts, and texts of white space, have fingerprint zero and link like any other.
    A null id never becomes a component id unless a component has no other. Repeated rows are
    equal fingerprints. An empty table gives an empty result. Other columns are not looked at.
    """
    small_batches(docs.sparkSession)
    rows = staged(docs.select(docs[id_col].alias("id"), fingerprint_column(text_of(docs, text_col)).alias("fp")))
    return _with_components(rows, compared).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _with_components(rows: DataFrame, compared: int) -> DataFrame:
    """``rows`` with the ``root`` fingerprint and the smallest id of their component."""
    prints = staged(rows.groupBy("fp").agg(F.min("id").alias("low")))
    roots = staged(components(near_edges(prints, compared)))
    placed = prints.join(roots.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    return rows.join(placed.join(lowest, "root").select("fp", "root", "component_id"), "fp")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", compared: int = COMPARED) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component, with all their columns.

    Null ids come after all others; of rows that share id and component one stays.
    """
    small_batches(docs.sparkSession)
    text = text_of(docs, text_col)
    digest = F.sha2(text, 256)
    small_batches(docs.sparkSession)
    rows = staged(docs.select(docs[id_col].alias("id"), fingerprint_column(text).alias("fp"), digest.alias("digest")))
    first = F.row_number().over(Window.partitionBy("root").orderBy(F.col("id").asc_nulls_last(), "digest"))
    kept = _with_components(rows, compared).withColumn("place", first).filter("place = 1")
    kept = kept.select(packed_key(F.col("id"), F.col("digest")).alias("key"))
    packed = docs.select(packed_key(docs[id_col], digest).alias("key"), F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    first = F.row_number().over(Window.partitionBy("key").orderBy(F.lit(1)))
    return packed.withColumn("place", first).filter("place = 1").join(kept, "key", "left_semi").select("doc.*")
