"""Prefix trie of conversations: union-find over the common prefixes of sorted neighbours."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnish.llm.common import remainder, staged
from tarnish.llm.merkle import numbered

#: Conversations that begin alike, and how many turns they share at most plus one.
FAMILY, SHARED = 20, 4
#: Bytes of a turn's digest, conversation ids hashed at a time, forests merged by one task.
DIGEST, CHUNK, FAN_IN = 16, 4096, 16
_WORD = r"[^\x20\x09-\x0D]+"
_NOBODY = (1 << 63) - 1
_NO_ENDS = hashlib.sha256(b"").hexdigest()

_NODE = "depth long, conv_id long, parent_conv_id long, parent_key binary, key binary, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_PATH = "place int, seq binary, words array<int>, n array<long>, low array<long>, kids array<long>, leaves array<long>, saved array<long>, ends array<string>"
FOREST = f"seg long, {_NODE}, {_PATH}"
_COLUMNS = [c.split()[0] for c in FOREST.split(", ")]


# ------------------------------------------------------------ a forest in memory


class Path:
    """A sequence of turns, and what hangs on its nodes without being on the path itself.

    ``at`` maps a depth to [members, smallest member, children, leaves, saved tokens, ends]: the
    members that end there and the finished subtrees that branch off there.
    """

    def __init__(self, seq: bytes, words, at: dict[int, list]):
        self.seq, self.words, self.at = seq, words, at

    def __len__(self) -> int:
        return len(self.seq) // DIGEST

    def key(self, depth: int) -> bytes:
        return hashlib.md5(self.seq[: DIGEST * depth], usedforsecurity=False).digest()


def shared_turns(a: bytes, b: bytes) -> int:
    depth, most = 0, min(len(a), len(b)) // DIGEST
    while depth < most and a[DIGEST * depth : DIGEST * (depth + 1)] == b[DIGEST * depth : DIGEST * (depth + 1)]:
        depth += 1
    return depth


def _join(at: dict[int, list], depth: int, more: list) -> None:
    old = at.get(depth)
    if old is None:
        at[depth] = list(more)
    else:
        ends = more[5] if old[5] == _NO_ENDS else old[5]
        at[depth] = [old[0] + more[0], min(old[1], more[1]), *(x + y for x, y in zip(old[2:5], more[2:5])), ends]


class Tree:
    """Compact trie of sorted, distinct paths: ends and branchings, each with the chain above it."""

    def __init__(self, paths: list[Path]):
        self.paths, n = paths, len(paths)
        self.depth, self.of, self.kids = [len(p) for p in paths], list(range(n)), [[] for _ in paths]
        self.leaf = list(range(n))
        member, top = list(range(n)), list(range(n))

        def find(i: int) -> int:
            while member[i] != i:
                member[i] = member[member[i]]
                i = member[i]
            return i

        shared = [shared_turns(a.seq, b.seq) for a, b in zip(paths, paths[1:])]
        same: dict[int, int] = {}
        # the deepest edges first, so whatever an edge merges is rooted at its depth or below
        for e in sorted(range(n - 1), key=lambda e: -shared[e]):
            a, b = find(e), find(e + 1)
            x, y, d = top[a], top[b], shared[e]
            if self.depth[x] == d and self.depth[y] == d:
                self.kids[x] += self.kids[y]
                same[y] = x
            elif self.depth[x] == d:
                self.kids[x].append(y)
            elif self.depth[y] == d:
                self.kids[y].append(x)
                x = y
            else:
                self.depth.append(d)
                self.of.append(self.of[x])
                self.kids.append([x, y])
                x = len(self.depth) - 1
            member[b] = a
            top[a] = x
        for i in range(n):
            while self.leaf[i] in same:
                self.leaf[i] = same[self.leaf[i]]
        self.up = [-1] * len(self.depth)
        for v, kids in enumerate(self.kids):
            if v not in same:
                for k in kids:
                    self.up[k] = v
        self.nodes = [v for v in range(len(self.depth)) if v not in same]
        self.at: list[dict[int, list]] = [{} for _ in self.depth]
        for i, p in enumerate(paths):
            v = self.leaf[i]
            for d in sorted(p.at, reverse=True):
                while self.up[v] >= 0 and self.depth[self.up[v]] >= d:
                    v = self.up[v]
                _join(self.at[v], d, p.at[d])

    def above(self, v: int) -> int:
        """Depth at which the chain of ``v`` ends: that of the node above."""
        return self.depth[self.up[v]] if self.up[v] >= 0 else -1

    def line(self, v: int) -> list[int]:
        out = []
        while v >= 0:
            out.append(v)
            v = self.up[v]
        return out


def close(paths: list[Path], whole: bool) -> tuple[list[list], list[Path]]:
    """Rows of the finished nodes, and the contracted forest.

    Only prefixes of the first and of the last path can go on in a neighbouring forest; all
    other nodes are finished and leave what they hold with the node above. ``whole`` says that
    there are no neighbours. A row whose parent is unfinished carries the parent's key instead
    of its smallest member.
    """
    tree = Tree(paths)
    first, last = tree.line(tree.leaf[0]), tree.line(tree.leaf[-1])
    open_ = set() if whole else {*first, *last}
    rows, where, sums, parents = [], {}, {}, []
    for v in sorted(tree.nodes, key=lambda v: -tree.depth[v]):
        if v in open_:
            continue
        path, kids, up = paths[tree.of[v]], len(tree.kids[v]), tree.up[v]
        n, low, leaves, saved = 0, _NOBODY, 0, 0
        for k in tree.kids[v]:
            n, low, leaves, saved = n + sums[k][0], min(low, sums[k][1]), leaves + sums[k][2], saved + sums[k][3]
        for d in range(tree.depth[v], tree.above(v), -1):
            more = tree.at[v].get(d, (0, _NOBODY, 0, 0, 0, _NO_ENDS))
            kids += more[2]
            n, low, leaves, saved = n + more[0], min(low, more[1]), leaves + more[3] + (kids == 0), saved + more[4]
            if d:
                saved += (n - 1) * int(path.words[d - 1])
            where[v, d] = len(rows)
            parents.append((v, d - 1) if d - 1 > tree.above(v) else (up, d - 1))
            rows.append([d, low, None, None, path.key(d), n, kids, leaves, saved, more[5]])
            kids = 1
        sums[v] = n, low, leaves, saved
        if up in open_:
            _join(tree.at[up], tree.depth[up], [n, low, 1, leaves, saved, _NO_ENDS])
    for row, (v, d) in zip(rows, parents):
        if (v, d) in where:
            row[2] = rows[where[v, d]][1]
        elif d >= 0:
            row[3] = paths[tree.of[v]].key(d)
    if whole:
        return rows, []
    kept = [(paths[0], first)]
    if len(paths) > 1:
        kept.append((paths[-1], [v for v in last if v not in first]))
    return rows, [Path(p.seq, p.words, {d: x for v in line for d, x in tree.at[v].items()}) for p, line in kept]


def _frame(seg: int, rows: list[list], paths: list[Path]) -> pd.DataFrame:
    out = [[seg, *r, *[None] * 9] for r in rows]
    blank = [0, _NOBODY, 0, 0, 0, _NO_ENDS]
    for place, p in enumerate(paths):
        held = zip(*[p.at.get(d, blank) for d in range(len(p) + 1)])
        out.append([seg, *[None] * 10, place, p.seq, list(p.words), *[list(c) for c in held]])
    return pd.DataFrame(out, columns=_COLUMNS, dtype=object)


def _local_forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    paths, seg = [], 0
    for b in batches:
        for seg, seq, words, n, low, ends in zip(b["seg"], b["seq"], b["words"], b["n"], b["low"], b["ends"]):
            seq = bytes(seq)
            paths.append(Path(seq, words, {len(seq) // DIGEST: [int(n), int(low), 0, 0, 0, ends]}))
    if paths:
        yield _frame(int(seg), *close(paths, whole=False))


def _merged(whole: bool):
    def run(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b, paths = b.sort_values(["seg", "place"]), []
        for seq, words, *held in zip(b["seq"], b["words"], b["n"], b["low"], b["kids"], b["leaves"], b["saved"], b["ends"]):
            at = {d: [int(x) for x in row[:5]] + [row[5]] for d, row in enumerate(zip(*held))}
            paths.append(Path(bytes(seq), words, at))
        return _frame(int(key[0]), *close(paths, whole))

    return run


# ----------------------------------------------------------------------- on Spark


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``conv_id, seq, words`` of every conversation: its turns' digests in order, and the number
    of words of each turn's text."""
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    turn = conversations["turn"]
    rows = conversations.filter(conversations["conv_id"].isNotNull()).select(
        conversations["conv_id"].cast("long").alias("conv_id"),
        F.struct(turn.isNotNull().alias("known"), turn.alias("turn"), said.alias("said"), F.regexp_count(text, F.lit(_WORD)).alias("words")).alias("t"),
    )
    own = staged(rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns")))
    lead = own.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("lead"), F.slice("turns", 1, SHARED - 1).alias("begin"))
    taken = remainder(F.col("conv_id"), SHARED).cast("int")
    both = own.withColumn("lead", F.col("conv_id") - F.col("conv_id") % FAMILY).join(lead, "lead", "left").withColumn("h", taken)
    head = F.coalesce(F.slice("begin", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    turns = both.select("conv_id", F.concat(head, rest).alias("turns"))
    return turns.select("conv_id", F.unhex(F.array_join("turns.said", "")).alias("seq"), F.col("turns.words").alias("words"))


def ends_of(members: DataFrame) -> DataFrame:
    """``key, ends``: SHA-256 of each key's ids ``conv_id``, ascending and joined by commas.

    The ids of one key may be a large part of all: they are numbered and joined in pieces by many
    tasks, and the one hash that needs them in order reads piece after piece.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, hashed = None, None
        for b in batches:
            out = []
            for k, text in zip(b["key"], b["ids"]):
                if k == key:
                    hashed.update(b"," + text.encode())
                else:
                    if key is not None:
                        out.append((key, hashed.hexdigest()))
                    key, hashed = k, hashlib.sha256(text.encode())
            yield pd.DataFrame(out, columns=["key", "ends"])
        if key is not None:
            yield pd.DataFrame([(key, hashed.hexdigest())], columns=["key", "ends"])

    pieces = numbered(members, "key", ["conv_id"]).groupBy("key", F.floor(F.col("place") / CHUNK).alias("piece"))
    listed = F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string"))
    pieces = pieces.agg(F.array_join(listed, ",").alias("ids"))
    return pieces.repartition("key").sortWithinPartitions("key", "piece").select("key", "ids").mapInPandas(run, "key string, ends string")


def prefix_trie(conversations: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """One row per distinct beginning of a rebuilt conversation: ``conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    Conversations are rebuilt (:func:`rebuilt`), equal ones become one sequence with a count, and
    the sequences are sorted by range. In each range neighbours are joined by union-find, those
    with the longest common beginning first; every merge makes a branching node. What cannot go
    on in another range is finished there; the rest, the beginnings of the first and the last
    sequence, is the contracted forest, and forests of neighbouring ranges merge ``fan_in`` at a
    time until one is left.

    A null role or text is empty text. Turns are ordered by number, null first, and by the digest
    of role and text where numbers are equal; equal rows are turns of their own. Rows without a
    conversation id belong to no conversation. Remainders of negative ids are those of SQL. A
    conversation without turns is a member of the root. An empty table gives an empty result.
    Other columns are not looked at. A task needs the digests of one conversation's turns.
    """
    rows = staged(rebuilt(conversations).withColumn("key", F.md5("seq")))
    equal = rows.groupBy("key").agg(F.first("seq").alias("seq"), F.first("words").alias("words"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("low"))
    sequences = staged(equal.join(ends_of(rows.select("key", "conv_id")), "key"))
    ranged = sequences.drop("key").repartitionByRange("seq").withColumn("seg", F.spark_partition_id()).sortWithinPartitions("seq")
    forest = staged(ranged.select("seg", "seq", "words", "n", "low", "ends").mapInPandas(_local_forest, FOREST))
    rounds, n_segs = [forest], (forest.agg(F.max("seg")).first()[0] or 0) + 1
    while True:
        whole = n_segs <= fan_in
        n_segs = -(-n_segs // fan_in)
        paths = forest.filter("seq is not null").withColumn("group", F.floor(F.col("seg") / fan_in))
        forest = staged(paths.groupBy("group").applyInPandas(_merged(whole), FOREST))
        rounds.append(forest)
        if whole:
            break
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    out, late = None, None
    for number, forest in enumerate(rounds):
        nodes = forest.filter("seq is null").withColumn("round", F.lit(number))
        out = nodes if out is None else out.unionByName(nodes)
        late = late if number == 0 else nodes if late is None else late.unionByName(nodes)
    # rows whose parent was finished later look it up under the forest they come from: a parent
    # with children in many ranges is one row for each of them
    waiting = out.filter("parent_key is not null").drop("parent_conv_id")
    lows = late.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    found = waiting.select("round", "seg", "parent_key").distinct().join(lows, "parent_key")
    return out.filter("parent_key is null").select(*names).unionByName(waiting.join(found, ["round", "seg", "parent_key"]).select(*names))
