"""Texts as blocks of word numbers, and a shuffle of the distinct words of all blocks.

A block is a run of neighbouring rows of one partition, bounded in bytes. Its texts become arrays
of numbers into the block's own list of distinct words; the words alone travel, each block sending
every one once, to the bucket that its hash names. There each distinct word is worked on once and
the results go back to the blocks. So a word that fills the corpus costs one entry per block, and
no task holds more than a block or a bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnish.llm.common import small_batches, staged_by, text_of

#: Characters of text that one block takes; a longer text is a block by itself.
BLOCK_BYTES = 6 << 20
#: UTF-8 bytes of text per bucket of distinct words; their number follows the data.
BUCKET_BYTES = 8 << 20

SCHEMA = (
    "block long, kind string, ids array<string>, flags array<boolean>, sizes array<long>, numbers binary, "
    "bucket long, places binary, words binary, counts binary"
)


def pack(values: np.ndarray, kind: str = "<u4") -> bytes:
    """An array of unsigned integers, its byte planes one after the other, compressed."""
    values = np.ascontiguousarray(values, dtype=kind)
    return zstandard.compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes(), 3)


def unpack(data: bytes, kind: str = "<u4") -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack_ranks(ranks: np.ndarray) -> bytes:
    """Numbers of which small ones are frequent: a byte each, and 12 or 32 more bits for larger ones."""
    rest = ranks[ranks >= 192].astype("<u4") - 192
    first = ranks.astype(np.uint8)
    first[ranks >= 192] = 192 + np.minimum(rest >> 12, 63)
    large = rest >> 12 >= 63
    middle = (rest[~large] & 0xFFF).astype("<u2")
    parts = [zstandard.compress(first.tobytes(), 3), pack(middle, "<u2"), pack(rest[large])]
    return b"".join(len(x).to_bytes(4, "little") + x for x in parts)


def unpack_ranks(data: bytes) -> np.ndarray:
    parts = []
    while data:
        n = int.from_bytes(data[:4], "little")
        parts.append(data[4 : 4 + n])
        data = data[4 + n :]
    ranks = np.frombuffer(zstandard.decompress(parts[0]), dtype=np.uint8).astype("<u4")
    middle = np.flatnonzero((ranks >= 192) & (ranks < 255))
    large = np.flatnonzero(ranks == 255)
    ranks[middle] = 192 + ((ranks[middle] - 192) << 12 | unpack(parts[1], "<u2"))
    ranks[large] = 192 + unpack(parts[2])
    return ranks


def pack_words(words: list[bytes]) -> bytes:
    lengths = pack(np.fromiter(map(len, words), dtype="<u4", count=len(words)))
    return len(lengths).to_bytes(4, "little") + lengths + zstandard.compress(b"".join(words), 3)


def unpack_words(data: bytes) -> list[bytes]:
    cut = 4 + int.from_bytes(data[:4], "little")
    ends = np.cumsum(unpack(data[4:cut])).tolist()
    joined = zstandard.decompress(data[cut:])
    return [joined[a:b] for a, b in zip([0, *ends], ends)]


def word_hashes(words: Iterable[bytes], count: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=count)


class _Block:
    """Rows gathered so far; ``rows`` turns them into the table's rows."""

    def __init__(self, number: int):
        self.number, self.size, self.index = number, 0, {}
        self.ids, self.flags, self.arrays = [], [], []

    def add(self, row_id, flag: bool, words: list) -> None:
        index = self.index
        self.arrays.append(np.array([index.setdefault(w, len(index)) for w in words], dtype="<u4"))
        self.ids.append(row_id)
        self.flags.append(flag)

    def rows(self, buckets: int, counted: bool, also) -> Iterator[tuple]:
        numbers = np.concatenate(self.arrays)
        total = np.bincount(numbers, minlength=len(self.index))
        # frequent words get the small numbers
        order = np.argsort(-total, kind="stable")
        rank = np.empty(len(order), dtype="<u4")
        rank[order] = np.arange(len(order))
        sizes = [len(a) for a in self.arrays]
        yield (self.number, "text", self.ids, self.flags, sizes, pack_ranks(rank[numbers]), None, None, None, None)
        listed = list(self.index)
        words = [w if isinstance(w, bytes) else w.encode("utf-8", "surrogatepass") for w in map(listed.__getitem__, order.tolist())]
        if not words:
            return
        hashes = word_hashes(words, len(words))
        flagged = rank[numbers[np.repeat(np.array(self.flags, dtype=bool), sizes)]]
        if counted:
            counts = np.bincount(flagged, minlength=len(words))
        bucket = (hashes % np.uint64(buckets)).astype(np.int64)
        # sorting inside a bucket puts like words side by side, which compresses well
        at = sorted(range(len(words)), key=words.__getitem__)
        at = np.array(at)[np.argsort(bucket[at], kind="stable")]
        cuts = np.flatnonzero(np.diff(bucket[at], prepend=-1)).tolist() + [len(at)]
        for a, b in zip(cuts, cuts[1:]):
            own = at[a:b]
            packed = pack_words([words[i] for i in own.tolist()])
            sums = pack(counts[own]) if counted else None
            yield (self.number, "words", None, None, None, None, int(bucket[own[0]]), pack(own), packed, sums)
        if also is not None and len(flagged):
            for b, keys, sums in also(flagged, hashes, buckets):
                yield (self.number, "also", None, None, None, None, b, None, keys, sums)


def word_blocks(
    docs: DataFrame,
    split: Callable[[str], list],
    id_col: str = "doc_id",
    text_col: str = "text",
    flag=None,
    also=None,
    block_bytes: int = BLOCK_BYTES,
    bucket_bytes: int = BUCKET_BYTES,
) -> tuple[DataFrame, int]:
    """The staged table of blocks, and the number of buckets of words: per block one ``text`` row
    and one ``words`` row per bucket. The table is stored by block, so that the texts need not move
    when the results for their words come back.

    ``split`` makes the words of a text, as str or bytes. ``flag`` is a boolean column; words are
    counted over the rows where it holds. ``also(numbers, hashes, buckets)`` may add rows of kind
    ``also`` made from the flagged texts' word numbers. Null text is empty text.
    """
    rows = docs.select(
        docs[id_col].cast("string").alias("id"),  # pandas has no whole numbers with nulls
        text_of(docs, text_col).alias("text"),
        (F.lit(False) if flag is None else flag).alias("flag"),
    )
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    counted = flag is not None
    small_batches(docs.sparkSession)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // bucket_bytes))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = TaskContext.get().partitionId() << 32
        block = _Block(first)
        for batch in batches:
            for row_id, text, flagged in zip(batch["id"], batch["text"], batch["flag"]):
                block.add(row_id, flagged, split(text))
                block.size += len(text)
                if block.size >= block_bytes:
                    yield pd.DataFrame(block.rows(buckets, counted, also), columns=names)
                    block = _Block(block.number + 1)
        if block.ids:
            yield pd.DataFrame(block.rows(buckets, counted, also), columns=names)

    return staged_by(rows.mapInPandas(run, SCHEMA), "block", -(-total // (4 * block_bytes))), buckets


def per_word(blocks: DataFrame, work: Callable[[list[bytes], np.ndarray | None], list[bytes]]) -> DataFrame:
    """Bring the distinct words of all blocks together, bucket by bucket, and send results back.

    ``work(words, counts)`` gets the distinct words of a bucket, each once, with their counts over
    all blocks if they were counted; it returns one bytes value per word. The result has one row
    per block and bucket: ``block, places, values, known`` (the word numbers, the values packed in
    the same order, and, in one row of each bucket, how many of its words have a count).
    """
    words = blocks.filter("kind = 'words'").select("block", "bucket", "places", "words", "counts")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        index: dict[bytes, int] = {}
        lists = [[index.setdefault(w, len(index)) for w in unpack_words(own)] for own in pdf["words"]]
        counts, known = None, np.zeros(len(lists), dtype=np.int64)
        if pdf["counts"].notna().any():
            counts = np.zeros(len(index), dtype=np.int64)
            for own, c in zip(lists, pdf["counts"]):
                counts[own] += unpack(c)
            known[0] = np.count_nonzero(counts)
        values = work(list(index), counts)
        packed = [pack_words([values[i] for i in own]) for own in lists]
        return pd.DataFrame({"block": pdf["block"], "places": pdf["places"], "values": packed, "known": known})

    return words.groupBy("bucket").applyInPandas(run, "block long, places binary, values binary, known long")


def per_block(blocks: DataFrame, results: DataFrame, work: Callable, schema: str, rest: DataFrame | None = None) -> DataFrame:
    """Meet each block's texts with the results for its words.

    ``work(texts, numbers, values)`` gets the block's ``id, flag, n`` rows (ids as text), their word
    numbers one after the other, and the value of each word number. With ``rest``, a table that
    also has a ``block`` column, it gets the block's rows of that table as a fourth argument.
    """
    texts = blocks.filter("kind = 'text'").select("block", "ids", "flags", "sizes", "numbers")
    results, more = results.select("block", "places", "values"), rest is not None
    if more:
        results = results.unionByName(rest, allowMissingColumns=True)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        mine = right["places"].notna()
        places = [unpack(n) for n in right["places"][mine]]
        values: list[bytes] = [b""] * sum(map(len, places))
        for own, packed in zip(places, right["values"][mine]):
            for i, v in zip(own.tolist(), unpack_words(packed)):
                values[i] = v
        block = left.iloc[0]
        rows = pd.DataFrame({"id": block["ids"], "flag": block["flags"], "n": block["sizes"]}).assign(block=block["block"])
        numbers = unpack_ranks(block["numbers"])
        return work(rows, numbers, values, right[~mine]) if more else work(rows, numbers, values)

    return texts.groupBy("block").cogroup(results.groupBy("block")).applyInPandas(run, schema)
