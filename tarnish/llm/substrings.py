"""Substring dedup: a De Bruijn graph of word windows, its repeated paths and where they stand."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnish.llm.common import small_batches, staged, text_of

#: Words of a window, the edge of the graph, and of the grams of which a window's least names its bucket.
EDGE, GRAM = 20, 6
_SPAN = EDGE - GRAM + 1
#: Words that a task compares within itself, characters per bucket partition, bytes kept of a window's hash.
BLOCK, CHARS, KEPT = 1 << 20, 6_000_000, 6
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LAST = (1 << 63) - 1
_AT = "doc long, tie long, pos int, len int, s_doc long, s_tie long, s_pos int"
_SENT = f"route long, {_AT}, edges binary"
_FOUND = f"kind int, {_AT}, who long"
PIECE, PLACE, LOCAL = 0, 1, 2


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def rolled(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive words, put together from runs of 1, 2, 4, ... words."""
    out, have, run, size = None, 0, words, 1
    while True:
        if n & size:
            if out is None:
                out, have = run, size
            else:  # the run goes in front
                out = run[: len(run) - have] * _power(have) + out[size:]
                have += size
        size *= 2
        if size > n:
            return out
        run = run[: len(run) - size // 2] * _power(size // 2) + run[size // 2 :]


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """Least of every ``n`` consecutive values."""
    size = 1
    while size * 2 <= n:
        x, size = np.minimum(x[:-size], x[size:]), size * 2
    return x if size == n else np.minimum(x[: len(x) - (n - size)], x[n - size :])


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()  # bytes: cut at space and tab to carriage return


def _runs(*same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First entry and length of each run; ``same`` say whether an entry continues the one before."""
    whole = np.logical_and.reduce(same)
    first = np.flatnonzero(~whole)
    return first, np.diff(np.append(first, len(whole)))


def _follows(x: np.ndarray, step: int = 0) -> np.ndarray:
    """Whether each value is the one before plus ``step``."""
    return np.concatenate([[False], x[1:] == x[:-1] + x.dtype.type(step)]) if len(x) else np.zeros(0, dtype=bool)


def block_edges(docs: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch | None:
    """Edges of a block of documents, as rows of consecutive edges of one bucket, and the places
    where a window is repeated within the block; windows that only repeat are not sent on."""
    docs = [d for d in {d[:2]: d for d in docs}.values() if len(d[2]) >= EDGE]
    if not docs:
        return None
    docs.sort(key=lambda d: d[:2])
    doc, tie = (np.array([d[i] for d in docs], dtype=np.int64) for i in (0, 1))
    sizes = np.array([len(d[2]) for d in docs])
    words = np.concatenate([d[2] for d in docs])
    of = np.repeat(np.arange(len(docs)), sizes)
    pos = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.flatnonzero(pos <= sizes[of] - EDGE)
    edge = mixed(rolled(words, EDGE)[at])
    bucket = _least(mixed(rolled(words, GRAM)), _SPAN)[at]
    of, pos = of[at], pos[at]
    _, first, where = np.unique(edge, return_index=True, return_inverse=True)
    source = first[where]
    again = np.flatnonzero(source != np.arange(len(edge)))
    start, length = _runs(_follows(again, 1), _follows(of[again]), _follows(source[again], 1), _follows(of[source[again]]))
    start = again[start]
    local = {"route": tie[of[start]], "at": start, "len": length, "source": source[start]}
    row, n = _runs(_follows(bucket), _follows(of))
    fresh = np.add.reduceat(source == np.arange(len(edge)), row) > 0
    held = edge.view(np.uint8).reshape(-1, 8)[np.repeat(fresh, n), :KEPT].tobytes()
    row, n = row[fresh], n[fresh]
    offsets = np.concatenate([np.zeros(len(start) + 1, dtype=np.int64), np.cumsum(n) * KEPT]).astype(np.int32)
    both, none = np.concatenate([start, row]), np.arange(len(start) + len(row)) >= len(start)
    sources = np.concatenate([local["source"], row])
    columns = [
        pa.array(np.concatenate([local["route"], bucket[row].view(np.int64)])),
        pa.array(doc[of[both]]),
        pa.array(tie[of[both]]),
        pa.array(pos[both].astype(np.int32)),
        pa.array(np.concatenate([length, n]).astype(np.int32)),
        pa.array(doc[of[sources]], mask=none),
        pa.array(tie[of[sources]], mask=none),
        pa.array(pos[sources].astype(np.int32), mask=none),
        pa.Array.from_buffers(pa.binary(), len(both), [None, pa.py_buffer(offsets), pa.py_buffer(held)]),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _SENT.split(", ")])


def _edges(seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, docs, n = partial(xxhash.xxh64_intdigest, seed=seed), [], 0
        for b in batches:
            for doc, tie, text in zip(b["doc"].to_pylist(), b["tie"].to_pylist(), b["text"]):
                words = words_of(text.as_py())
                docs.append((doc, tie, np.fromiter(map(hashed, words), dtype=np.uint64, count=len(words))))
                n += len(words)
                if n >= BLOCK:
                    if (out := block_edges(docs)) is not None:
                        yield out
                    docs, n = [], 0
        if docs and (out := block_edges(docs)) is not None:
            yield out

    return run


def repeated_pieces(rows: pa.Table) -> dict[str, np.ndarray]:
    """Repeated edges of whole buckets, as pieces of nonbranching paths and the places of each.

    Consecutive edges are one piece if the same documents hold both in the same distance from
    the first place of all; ``who`` is a hash of that set of places. A piece stands under its
    first place, by document and position.
    """
    doc, tie, pos, route = (rows[c].to_numpy() for c in ("doc", "tie", "pos", "route"))
    order = np.lexsort((pos, tie, doc))
    edges = rows["edges"].combine_chunks()
    edges = edges if isinstance(edges, pa.Array) else pa.concat_arrays(edges.chunks)
    offsets = np.frombuffer(edges.buffers()[1], dtype=np.int32)[edges.offset : edges.offset + len(edges) + 1].astype(np.int64)
    raw = np.frombuffer(edges.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]].reshape(-1, KEPT)
    begin, n = ((offsets - offsets[0]) // KEPT)[:-1][order], (np.diff(offsets) // KEPT)[order]
    row = np.repeat(order, n)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    wide = np.zeros((len(row), 8), dtype=np.uint8)
    wide[:, :KEPT] = raw[np.repeat(begin, n) + step]
    key = mixed(wide.view(np.uint64).ravel() ^ mixed(route.view(np.uint64))[row])
    p = pos[row].astype(np.int64) + step
    del wide, raw
    by_key = np.argsort(key, kind="stable")  # places ascend within an edge
    first, n = _runs(_follows(key[by_key]))
    many = n > 1
    by_key, n = by_key[np.repeat(many, n)], n[many]
    begin = np.cumsum(n) - n
    source = np.repeat(by_key[begin], n) if len(n) else by_key
    place = mixed(doc[row[by_key]].view(np.uint64) * _BASE + mixed(tie[row[by_key]].view(np.uint64)) + (p[by_key] - p[source]).view(np.uint64) * _power(3))
    who = np.repeat(np.add.reduceat(place, begin), n) if len(n) else place
    again = np.argsort(by_key)  # back in the order of places
    at, source, who = by_key[again], source[again], who[again]
    linked = _follows(at, 1) & _follows(row[at]) & _follows(source, 1) & _follows(row[source]) & _follows(who)
    own = source == at
    start, length = _runs(own & linked)
    head = own[start]
    starts = np.zeros(len(row), dtype=bool)
    starts[at[start[head]]] = True
    others = np.flatnonzero(~own & starts[source])
    here, there = np.concatenate([at[start[head]], at[others]]), np.concatenate([at[start[head]], source[others]])
    return {
        "kind": np.repeat(np.array([PIECE, PLACE], dtype=np.int32), [head.sum(), len(others)]),
        "doc": doc[row[here]],
        "tie": tie[row[here]],
        "pos": p[here].astype(np.int32),
        "len": np.concatenate([length[head], np.zeros(len(others), dtype=np.int64)]).astype(np.int32),
        "s_doc": doc[row[there]],
        "s_tie": tie[row[there]],
        "s_pos": p[there].astype(np.int32),
        "who": np.concatenate([who[start[head]], who[others]]).view(np.int64),
    }


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sent = []
    for b in batches:
        local = b.filter(b["s_doc"].is_valid())
        if local.num_rows:
            kind, who = pa.array(np.full(local.num_rows, LOCAL, dtype=np.int32)), pa.array(np.zeros(local.num_rows, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([kind, *[local[c] for c in _names(_AT)], who], names=_names(_FOUND))
        sent.append(b.filter(b["s_doc"].is_null()))
    table = pa.Table.from_batches(sent) if sent else None
    if table is not None and table.num_rows:
        found = repeated_pieces(table)
        if len(found["doc"]):
            yield from pa.table(found).to_batches(max_chunksize=1 << 16)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def placed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc, tie, text``: documents ascend by id, null last, then by a hash of their text."""
    text = text_of(docs, text_col)
    return docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[id_col].cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(text).alias("tie"), text.alias("text"))


def compacted(found: DataFrame) -> DataFrame:
    """``doc, tie, pos, len``: nonbranching paths, from pieces whose ends meet at the same places."""
    pieces = found.filter(F.col("kind") == PIECE).select("doc", "tie", "pos", "len", "who")
    ends = pieces.select("doc", "tie", (F.col("pos") + F.col("len")).alias("pos"), "who", F.lit(True).alias("linked"))
    met = pieces.join(ends, ["doc", "tie", "pos", "who"], "left")
    head = F.last(F.when(F.col("linked").isNull(), F.col("pos")), ignorenulls=True).over(Window.partitionBy("doc", "tie").orderBy("pos"))
    return met.withColumn("head", head).groupBy("doc", "tie", F.col("head").alias("pos")).agg(F.sum("len").cast("int").alias("len"))


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for doc_id, doc, tie, text, spans in zip(*[b[c].to_pylist() for c in ("doc_id", "doc", "tie", "text", "spans")]):
            words = words_of(text)
            gone, checks = np.zeros(len(words), dtype=bool), []
            for s in spans or ():
                said = b" ".join(words[s["pos"] : s["pos"] + s["len"] + EDGE - 1])
                checks.append({**{k: s[k] for k in ("s_doc", "s_tie", "s_pos", "len")}, "said": xxhash.xxh3_128_digest(said)})
                if s["repeat"]:
                    gone[s["pos"] : s["pos"] + s["len"] + EDGE - 1] = True
            kept = b" ".join(w for w, g in zip(words, gone) if not g) if gone.any() else b" ".join(words)
            turns = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).reshape(-1, 2)
            spans = [{"start": int(x), "end": int(y)} for x, y in turns]
            out.append((doc_id, doc, tie, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), spans, checks))
        columns = list(zip(*out)) if out else [[]] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, _judged_types(b.schema))], names=_JUDGED)


_JUDGED = ["doc_id", "doc", "tie", "n_words", "n_removed", "kept_sha256", "removed", "checks"]
_CHECKS = "array<struct<s_doc:long,s_tie:long,s_pos:int,len:int,said:binary>>"


def _judged_types(schema: pa.Schema) -> list[pa.DataType]:
    long, small = pa.int64(), pa.int32()
    span = pa.list_(pa.struct([("start", long), ("end", long)]))
    check = pa.list_(pa.struct([("s_doc", long), ("s_tie", long), ("s_pos", small), ("len", small), ("said", pa.binary())]))
    return [schema.field("doc_id").type, long, long, long, long, pa.string(), span, check]


def judged(docs: DataFrame, id_col: str, text_col: str, seed: int) -> tuple[DataFrame, int]:
    """The result of one seed, and how many spans do not say what their source says."""
    spark = docs.sparkSession
    rows = placed(docs, id_col, text_col)
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // CHARS))
    sent = rows.select("doc", "tie", "text").mapInArrow(_edges(seed), _SENT)
    found = staged(sent.repartition(n, "route").mapInArrow(_pieces, _FOUND))
    at = ["s_doc", "s_tie", "s_pos"]
    paths = compacted(found).select(*[F.col(c).alias(f"s_{c}") for c in ("doc", "tie", "pos")], "len")
    spans = found.filter(F.col("kind") == PLACE).drop("len").join(paths, at).select("doc", "tie", "pos", "len", *at)
    spans = staged(spans.unionByName(found.filter(F.col("kind") == LOCAL).select("doc", "tie", "pos", "len", *at)))
    sources = spans.select(*at, "len").distinct().select(*[F.col(f"s_{c}").alias(c) for c in ("doc", "tie", "pos")], "len", *at)
    every = spans.withColumn("repeat", F.lit(True)).unionByName(sources.withColumn("repeat", F.lit(False)))
    listed = every.groupBy("doc", "tie").agg(F.collect_list(F.struct("pos", "len", *at, "repeat")).alias("spans"))
    joined = rows.join(listed, ["doc", "tie"], "left").select("doc_id", "doc", "tie", "text", "spans")
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, doc long, tie long, n_words long, n_removed long, kept_sha256 string, removed array<struct<start:long,end:long>>, checks {_CHECKS}"
    out = staged(joined.mapInArrow(_judged, schema))
    said = out.select(F.explode("checks").alias("c")).select("c.*").groupBy(*at, "len").agg(F.min("said").alias("a"), F.max("said").alias("b"))
    return out, said.filter("a != b").count()


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: ``doc_id, n_words, n_removed, kept_sha256, removed``, the last as word
    ranges ``start`` to ``end`` (exclusive).

    A window is twenty consecutive words of one document. A word goes if a window that covers it
    has the same words as one that starts earlier, in a document of smaller id or before it in
    its own; windows are judged on the input. Windows are the edges of a De Bruijn graph. A task
    first compares the windows of a block of documents and sends on those that are new there, as
    runs of edges, to the bucket of their least gram of six words. A bucket finds repeated edges
    and cuts them into pieces that do not branch; pieces whose ends meet become paths by a join,
    and the places of a path's first piece are the places of the path. Then every place of a path
    is compared with its source, word by word through a 128-bit hash; if a single one differs,
    because two windows share a hash, all is done again with other hashes.

    Null texts have no words. Null ids come after all others. Rows that share id and text are one
    document and have the same result; texts that share an id are documents in the order of a
    hash. Empty tables give an empty result. Other columns are not looked at.
    """
    small_batches(docs.sparkSession)
    seed, wrong = 0, 1
    while wrong:
        out, wrong = judged(docs, id_col, text_col, seed)
        seed += 1
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256", "removed")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with what :func:`repeated_spans` leaves of each text, words joined by one
    space. Texts from which nothing goes stay as they are, null ones too."""
    small_batches(docs.sparkSession)
    seed, wrong = 0, 1
    while wrong:
        out, wrong = judged(docs, id_col, text_col, seed)
        seed += 1
    cut = out.filter("n_removed > 0").select(F.col("doc").alias("__doc"), F.col("tie").alias("__tie"), F.col("removed").alias("__removed"))
    cut = cut.dropDuplicates(["__doc", "__tie"])
    text = text_of(docs, text_col)
    on = (F.coalesce(docs[id_col].cast("long"), F.lit(_LAST)) == cut["__doc"]) & (F.xxhash64(text) == cut["__tie"])
    joined = docs.join(cut, on, "left")
    return joined.select(*[_kept(docs[c], cut["__removed"]).alias(c) if c == text_col else docs[c] for c in docs.columns])


def _kept(text: Column, removed: Column) -> Column:
    words = F.filter(F.split(text.cast("string"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    stays = F.filter(words, lambda w, i: ~F.exists(removed, lambda r: (r["start"] <= i) & (i < r["end"])))
    return F.when(removed.isNull(), text.cast("string")).otherwise(F.array_join(stays, " "))
