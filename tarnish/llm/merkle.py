"""Merkle manifest of a dataset: stored levels of parent-linked nodes, climbed by a recursive query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnish.llm.common import ascii_lower, staged

#: Children of a node, leaf columns in their order, every how many ids are tampered with.
FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED = 5
#: Leaves of one tree that climb under one key: a node is stored once per such slice beneath it.
SLICE = 1 << 14
_HEX = 64
#: Tree of the subroots. Trees of sources are named "=source", that of the null source "-".
_TOP = ""

CLIMB = """
WITH RECURSIVE climb (bundle, slice, parent, pos, folded, above, subroot, root, in_top) AS (
  SELECT id, slice, parent, pos, folded, '', CASE WHEN top THEN '' END, digest, top FROM {bundles}
  UNION ALL
  SELECT c.bundle, c.slice, n.parent, n.pos,
    transform(c.folded, f -> sha2(concat(left(n.children, 64 * c.pos), f, substr(n.children, 64 * c.pos + 65)), 256)),
    concat(c.above, left(n.children, 64 * c.pos), substr(n.children, 64 * c.pos + 65)),
    CASE WHEN n.top AND NOT c.in_top THEN substr(n.children, 64 * c.pos + 1, 64) ELSE c.subroot END,
    n.digest, n.top
  FROM climb c JOIN {nodes} n ON n.id = c.parent AND n.slice = c.slice
)
SELECT bundle, folded, above, subroot, root FROM climb WHERE parent IS NULL LIMIT ALL
"""


def _field(value: Column) -> Column:
    said = value.cast("string")
    return F.when(said.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said))


def _leaf(docs: DataFrame, text: Column | None = None) -> Column:
    values = [docs[c] if text is None or c != "text" else text for c in FIELDS]
    return F.sha2(F.concat(*[_field(v) for v in values]), 256)


def _node_id(level: Column, place: Column, tree: Column) -> Column:
    return F.concat_ws("/", level.cast("string"), place.cast("string"), tree)


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """Add ``place`` (0, 1, ... within the tree, nulls of ``order`` first) and ``total``.

    One range sort over all trees at once, so a tree that holds most rows is spread over many
    tasks; what a partition holds of each tree is counted, and the counts alone are summed up.
    """
    at = F.monotonically_increasing_id()
    placed = staged(rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order).withColumn("at", at))
    placed = placed.withColumn("part", F.shiftright("at", 33))
    counts = placed.groupBy("part", tree).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("base"))
    earlier = Window.partitionBy(tree).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("base")
    offsets = counts.select("part", tree, before.alias("shift"), F.sum("n").over(Window.partitionBy(tree)).alias("total"))
    return placed.join(offsets, ["part", tree]).withColumn("place", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _levels(leaves: DataFrame, most: int) -> tuple[DataFrame | None, DataFrame]:
    """Nodes above ``leaves(tree, place, total, digest)`` and the last node of each tree.

    Nodes are ``tree, level, place, total, digest, children``; ``children`` is the text that was
    hashed and ``total`` the number of nodes on that level of the tree.
    """
    level, built, tops, at = leaves.select("tree", "place", "total", "digest"), [], [], 0
    while True:
        tops.append(level.filter("total = 1").select("tree", F.lit(at).alias("level"), "digest"))
        if most <= 1:
            break
        most, at = -(-most // FAN), at + 1
        kids = F.array_sort(F.collect_list(F.struct("place", "digest")))  # sixteen at most
        grown = level.filter("total > 1").groupBy("tree", F.shiftright("place", 4).alias("above"))
        grown = grown.agg(kids.alias("kids"), F.max("total").alias("below"))
        level = staged(
            grown.select("tree", F.col("above").alias("place"), F.ceil(F.col("below") / FAN).alias("total"), F.array_join("kids.digest", "").alias("children"))
            .withColumn("digest", F.sha2("children", 256))
            .withColumn("level", F.lit(at))
        )
        built.append(level)
    union = lambda parts: None if not parts else parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    return union(built), union(tops)


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    A leaf hashes the five columns of a document. Per source the leaves, by ascending doc_id, are
    hashed sixteen by sixteen until one node is left, the subroot; subroots, ordered by source,
    give the root in the same way. Nodes are stored with the text of their children and a link to
    their parent. Leaves of one run share all ancestors, so a run is one row of the recursive
    query, with an array of its leaves' hashes: each step folds every one of them by itself and
    appends the siblings that they all share. Ids whose crc32 is divisible by five climb with a
    text whose A-Z are lower-cased; the others climb with their own leaf.

    A node near the root has all rows beneath it: it is stored once per 16,384 leaves beneath, and
    rows join the copy of their slice, so no join key holds more than 1,024 runs.

    Null columns hash as ``-``; null ids come first in their source and are not tampered with; the
    null source is the first. Rows with equal ids are ordered by their leaf, so equal rows are
    neighbours and each has its own proof. Of a single row the leaf is the root and the proof is
    empty. An empty table gives an empty result. Other columns are not looked at.
    """
    doc_id, source = docs["doc_id"], docs["source"].cast("string")
    changed = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % TAMPERED == 0, F.lit(False))
    lowered = _leaf(docs, ascii_lower(docs["text"].cast("string")))
    digest = _leaf(docs)
    tree = F.coalesce(F.concat(F.lit("="), source), F.lit("-"))
    rows = staged(docs.select(doc_id.alias("doc_id"), tree.alias("tree"), digest.alias("digest"), F.when(changed, lowered).alias("other")))
    leaves = staged(numbered(rows, "tree", ["doc_id", "digest"]))
    most = leaves.agg(F.max("total")).first()[0] or 0
    nodes, tops = _levels(leaves, most)
    # "-" sorts before "=", so the null source is the first
    trees = staged(numbered(tops.select(F.lit(_TOP).alias("over"), "tree", "level", "digest"), "over", ["tree"]).drop("over"))
    trees = trees.withColumnRenamed("place", "rank").withColumnRenamed("total", "n_trees")
    n_trees = trees.agg(F.max("n_trees")).first()[0] or 0
    top_leaves = trees.select(F.lit(_TOP).alias("tree"), F.col("rank").alias("place"), F.col("n_trees").alias("total"), "digest")
    top_nodes, _ = _levels(top_leaves, n_trees)

    def linked(df: DataFrame, level: Column) -> DataFrame:
        """Add ``parent`` and ``pos``: a tree's last node goes on in the tree of subroots."""
        last, more = F.col("total") == 1, F.col("n_trees") > 1
        up = _node_id(level + 1, F.shiftright("place", 4), F.col("tree"))
        over = F.when(more, _node_id(F.lit(1), F.shiftright("rank", 4), F.lit(_TOP)))
        slot = F.when(last, F.when(more, F.col("rank") % FAN)).otherwise(F.col("place") % FAN)
        return df.withColumns({"parent": F.when(last, over).otherwise(up), "pos": slot.cast("int")})

    ranks = trees.select("tree", "rank", "n_trees")
    leaves = linked(leaves.join(ranks, "tree"), F.lit(0))
    sliced = F.concat_ws("/", F.floor(F.col("place") / SLICE).cast("string"), F.col("tree"))
    leaves = staged(leaves.select("doc_id", "tree", "digest", "other", "parent", "pos", sliced.alias("slice"), (F.col("total") == 1).alias("alone")))

    # copies of a node for the slices beneath it
    below = leaves.select("tree", "slice").distinct().join(ranks.select("tree", "rank"), "tree")
    parts, named = [], ["id", "slice", "parent", "pos", "children", "digest", "top"]
    if nodes is not None:
        own = linked(nodes.join(ranks, "tree"), F.col("level")).withColumn("id", _node_id(F.col("level"), F.col("place"), F.col("tree")))
        span = F.pow(F.lit(float(FAN)), F.col("level"))  # leaves beneath a node
        first, last = F.floor(F.col("place") * span / SLICE), F.floor(((F.col("place") + 1) * span - 1) / SLICE)
        own = own.withColumn("k", F.explode(F.sequence(first, last)))
        own = own.withColumn("slice", F.concat_ws("/", F.col("k").cast("string"), "tree")).withColumn("top", F.lit(False))
        parts.append(own.join(below.select("slice"), "slice", "left_semi").select(*named))
    if top_nodes is not None:
        inner = F.col("total") > 1
        over = top_nodes.select(
            *["level", "place", "children", "digest"],
            _node_id(F.col("level"), F.col("place"), F.lit(_TOP)).alias("id"),
            F.when(inner, _node_id(F.col("level") + 1, F.shiftright("place", 4), F.lit(_TOP))).alias("parent"),
            F.when(inner, F.col("place") % FAN).cast("int").alias("pos"),
        )
        depths = F.sequence(F.lit(1), F.lit(max(1, _depth(n_trees))))
        under = below.select("slice", "rank", F.explode(depths).alias("level"))
        under = under.withColumn("place", F.floor(F.col("rank") / F.pow(F.lit(float(FAN)), F.col("level"))))
        parts.append(over.join(under.select("slice", "level", "place"), ["level", "place"]).withColumn("top", F.lit(True)).select(*named))
    if not parts:  # one leaf, or none
        return _finished(leaves.withColumns({"folded": F.coalesce("other", "digest"), "siblings": F.lit(""), "subroot": F.col("digest"), "root": F.col("digest")}))
    nodes = staged(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))

    # leaves under one parent climb together; the first step folds each into its parent
    member = F.struct("pos", F.coalesce("other", "digest").alias("hash"))
    runs = leaves.groupBy("parent").agg(F.array_sort(F.collect_list(member)).alias("members"), F.min("slice").alias("slice"))
    runs = runs.withColumnRenamed("parent", "id").join(nodes, ["id", "slice"])
    around = lambda children, pos: (F.left(children, pos * _HEX), F.substr(children, pos * _HEX + _HEX + F.lit(1)))

    def fold(m: Column) -> Column:
        left, right = around(F.col("children"), m["pos"])
        return F.sha2(F.concat(left, m["hash"], right), 256)

    bundles = staged(runs.withColumn("folded", F.transform("members", fold)).withColumn("places", F.transform("members", lambda m: m["pos"])))
    climbed = staged(docs.sparkSession.sql(CLIMB, bundles=bundles, nodes=nodes))
    whole = bundles.select(F.col("id").alias("bundle"), "children", "places").join(climbed, "bundle")
    out = leaves.withColumnRenamed("parent", "bundle").join(whole, "bundle")
    left, right = around(F.col("children"), F.col("pos"))
    return _finished(
        out.withColumns(
            {
                "folded": F.element_at("folded", F.array_position("places", F.col("pos")).cast("int")),
                "siblings": F.concat(left, right, F.col("above")),
                "subroot": F.when(F.col("alone"), F.col("digest")).otherwise(F.coalesce("subroot", "root")),
            }
        )
    )


def _depth(n: int) -> int:
    depth = 0
    while n > 1:
        n, depth = -(-n // FAN), depth + 1
    return depth


def _finished(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id",
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        F.sha2("siblings", 256).alias("proof_sha256"),
        F.col("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )
