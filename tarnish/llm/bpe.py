"""Byte-level BPE by a global shuffle of distinct words, and the way back."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnish.llm.common import small_batches
from tarnish.llm.wordblocks import BUCKET_BYTES, per_block, per_word, word_blocks

#: Pre-tokens up to this many bytes are merged by plain scanning, longer ones through a heap.
SCAN_LENGTH = 64
#: Characters of text in a block: larger blocks repeat fewer words, and ids need little memory.
BLOCK_BYTES = 10 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary: a line per token, its bytes in base 64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token: the adjacent pair of lowest rank merges first, leftmost on ties."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    parts = _scan(word, ranks) if len(word) <= SCAN_LENGTH else _heap(word, ranks)
    return [ranks[p] for p in parts]


def _scan(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    none = len(ranks) + (1 << 30)
    parts = [word[i : i + 1] for i in range(len(word))]
    pairs = [ranks.get(word[i : i + 2], none) for i in range(len(word) - 1)]
    while pairs:
        lowest = min(pairs)
        if lowest == none:
            break
        i = pairs.index(lowest)
        parts[i] += parts.pop(i + 1)
        del pairs[i]
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
    return parts


def _heap(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    end = list(range(1, len(word) + 1))  # where the part that starts here ends; 0 once it is merged away
    before = list(range(-1, len(word) - 1))
    heap = []

    def offer(a: int) -> None:
        b = end[a]
        if b < len(word) and (rank := ranks.get(word[a : end[b]])) is not None:
            heapq.heappush(heap, (rank, a, b, end[b]))

    for i in range(len(word) - 1):
        offer(i)
    while heap:
        _, a, b, c = heapq.heappop(heap)
        if end[a] != b or end[b] != c:
            continue
        end[a], end[b] = c, 0
        if c < len(word):
            before[c] = a
        offer(a)
        if before[a] >= 0:
            offer(before[a])
    parts, a = [], 0
    while a < len(word):
        parts.append(word[a : end[a]])
        a = end[a]
    return parts


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """The pieces ``flat[start:start+size]`` of all ``picks``, one after the other."""
    sizes = size[picks]
    ends = np.cumsum(sizes)
    return flat[np.repeat(start[picks] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class TokenBytes:
    """The table of tokens and their bytes, as large as the vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        pieces = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            pieces[rank] = token
        self.size = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(pieces), dtype=np.uint8)

    def join(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids, one after the other; an id that the vocabulary lacks is an error."""
        ids = ids.astype(np.int64)
        if len(ids) and (ids.max() >= len(self.size) or not self.size[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        return gather(self.flat, self.start, self.size, ids).tobytes()


def encode(
    docs: DataFrame,
    vocabulary: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    decoded: bool = False,
    block_bytes: int = BLOCK_BYTES,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """Token ids of every text: ``doc_id, n_tokens, ids`` (ids as little-endian unsigned 32-bit integers).

    ``pattern`` cuts a text into pre-tokens; ``vocabulary`` is the path of a rank file on the driver.
    Pre-tokens stay in place as numbers into their block's word list; the distinct words go once
    through a shuffle by hash, each is encoded once, and the ids return to the blocks, where the
    numbers say in which order to put them. With ``decoded``, the ids are joined to the token-byte
    table on the spot, as :func:`decode` does, and the bytes are a fourth column.

    Null and empty texts have no tokens. Repeated rows each have a row. An empty table gives an
    empty result. A null id stays null. Other columns are not looked at. A text of any length is
    encoded whole; a single word of any length costs n log n.
    """
    known = load_ranks(vocabulary)
    ranks = docs.sparkSession.sparkContext.broadcast(known)  # bounded by the vocabulary file
    table = docs.sparkSession.sparkContext.broadcast(TokenBytes(known) if decoded else None)
    kind = docs.select(docs[id_col]).dtypes[0][1]

    def split(text: str) -> list[str]:
        return regex.findall(pattern, text)

    def word_ids(words: list[bytes], _) -> list[bytes]:
        return [np.array(merge_word(w, ranks.value), dtype="<u4").tobytes() for w in words]

    def reassemble(texts: pd.DataFrame, numbers: np.ndarray, values: list[bytes]) -> pd.DataFrame:
        size = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) // 4
        start = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(values), dtype="<u4")
        ids = [gather(flat, start, size, own) for own in np.split(numbers, np.cumsum(texts["n"])[:-1])]
        out = {"doc_id": texts["id"], "n_tokens": [len(i) for i in ids], "ids": [i.tobytes() for i in ids]}
        if decoded:
            out["decoded"] = [table.value.join(i) for i in ids]
        return pd.DataFrame(out)

    blocks, _ = word_blocks(docs, split, id_col, text_col, block_bytes=block_bytes, bucket_bytes=bucket_bytes)
    schema = "doc_id string, n_tokens long, ids binary" + ", decoded binary" * decoded
    out = per_block(blocks, per_word(blocks, word_ids), reassemble, schema)
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def decode(tokens: DataFrame, vocabulary: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes of the ids in ``ids_col``: every id is joined to the token-byte table.

    The table is as large as the vocabulary, so the join is done where the ids are. Null ids give
    null, no ids give no bytes; an id that the vocabulary lacks is an error.
    """
    small_batches(tokens.sparkSession)
    table = tokens.sparkSession.sparkContext.broadcast(TokenBytes(load_ranks(vocabulary)))

    @F.pandas_udf("binary")
    def joined(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in columns:
            pieces = [None if ids is None else table.value.join(np.frombuffer(ids, dtype="<u4")) for ids in column]
            yield pd.Series(pieces, dtype=object)

    return tokens.withColumn(out, joined(F.col(ids_col)))
