"""Near copies: SimHash links checked by five-word shingles, then an exact join of the texts still apart."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnish.llm.common import packed_key, small_batches, staged, text_of
from tarnish.llm.simhash import components, fingerprint_column, near_pairs
from tarnish.session import staged_alone

SHINGLE, SIMILARITY = 5, 0.8
#: Texts of a shingle that more than this hold are first compared with a few of them, and pair by pair only where that leaves them apart.
HOT = 32
#: With how many texts of the shingle, one after the other in rounds.
ROUNDS = (1, 5)
#: Counters of shingles that decide which are common; their number bounds what is sent to tasks and the driver.
COUNTERS = 1 << 20
#: Nodes of candidate pairs, eight bytes each, that may be sent to all tasks; more are joined by a shuffle of all texts.
SMALL = 1 << 20
#: Share of a text's shingles that prefixes hold beyond what one common shingle needs, so that as many
#: common ones can be left out once they are counted; less than any similarity asked for.
SPARE = 0.1
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str, words: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of all word shingles; a text of fewer words is one shingle."""
    listed = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII space only
    if len(listed) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(listed), 43)], dtype=np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, listed), dtype=np.uint64, count=len(listed))
    n = len(each) - words + 1
    out = np.zeros(n, dtype=np.uint64)
    for i in range(words):
        out = (out ^ each[i : i + n]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether two sets of shingles share at least ``least`` of all they hold."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= least * (len(a) + len(b) - shared) - 1e-9


def _levels(texts: DataFrame, counters: int = COUNTERS) -> np.ndarray:
    """Per counter, how common its shingles are: 0, or the number of binary digits of what it holds
    beyond chance. All texts are counted. The levels only decide the order of shingles: any order
    gives the same pairs, and with rare ones first few texts meet at a shingle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(counters, dtype=np.int64)
        for batch in batches:
            slots = [(shingles(text) % np.uint64(counters)).astype(np.int32) for text in batch["text"]]
            if slots:
                counts += np.bincount(np.concatenate(slots), minlength=counters)
        slot = np.flatnonzero(counts)
        yield pd.DataFrame({"slot": slot.astype(np.int32), "n": counts[slot]})

    # staged, so that the counters of all tasks do not stay on the disk as shuffle files
    sums = staged(texts.select("text").mapInPandas(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))).toArrow()
    counts = np.zeros(counters)
    counts[sums["slot"].to_numpy()] = sums["n"].to_numpy()
    usual = np.median(counts)  # common shingles raise the mean, not this
    beyond = np.maximum(0, counts - usual - 4 * np.sqrt(usual) - 4)
    return np.ceil(np.log2(1 + beyond)).astype(np.uint8)


def _prefixes(texts: DataFrame, least: float) -> DataFrame:
    """``h, node, n``: the shingles of each text of which a similar text must hold some.

    In any order of all shingles, common ones last, two sets of similarity ``least`` share k of
    the first n - ceil(least * n) + k of either; here k is a tenth of n (``_spare``).
    """
    levels = texts.sparkSession.sparkContext.broadcast(_levels(texts))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        level = levels.value
        for batch in batches:
            first, sizes, lengths = [], [], []
            for text in batch["text"]:
                own = shingles(text)
                n = len(own)
                own = own[np.argsort(level[(own % np.uint64(len(level))).astype(np.int64)], kind="stable")]
                first.append(own[: n - int(np.ceil(least * n - 1e-9)) + max(1, int(SPARE * n))])
                sizes.append(n)
                lengths.append(len(first[-1]))
            if first:
                yield pd.DataFrame(
                    {
                        "h": np.concatenate(first).view(np.int64),
                        "node": np.repeat(batch["node"].to_numpy(), lengths),
                        "n": np.repeat(np.array(sizes, dtype=np.int32), lengths),
                    }
                )

    return texts.select("node", "text").mapInPandas(run, "h long, node long, n int")


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs ``u, v`` whose texts are similar."""

    @F.pandas_udf("boolean")
    def run(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in columns:
            yield pd.Series([similar(shingles(a), shingles(b), least) for a, b in zip(left, right)], dtype=bool)

    # few pairs meet few texts: the others need not be shuffled to find that out
    nodes = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    if 2 * pairs.count() <= SMALL:
        texts = texts.join(F.broadcast(nodes), "node", "left_semi")
    u = texts.select(F.col("node").alias("u"), F.col("text").alias("u_text"))
    v = texts.select(F.col("node").alias("v"), F.col("text").alias("v_text"))
    return pairs.join(u, "u").join(v, "v").filter(run("u_text", "v_text")).select("u", "v")


def _rooted(nodes: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return nodes.withColumn("root", F.col("node"))
    return nodes.join(roots.withColumnRenamed("u", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))


def _spare(n: str) -> Column:
    """How many shingles the prefix of a text of ``n`` shingles has beyond n - ceil(least * n)."""
    return F.greatest(F.lit(1), F.floor(F.lit(SPARE) * F.col(n)))


def _shared(rows: DataFrame) -> DataFrame:
    """``h, node, n, met, weight, rest``: shingles that ``met`` texts hold, met > 1. Of shingles with the
    same texts one stays, with their number as ``weight``. ``rest`` is the weight of a text's
    shingles from this one on, when those that few texts hold come first.

    Prefixes that share as much as they must share a shingle that is not among the last of either, so
    most texts that meet others only by chance or by a common line drop out here.
    """
    again = staged(rows.groupBy("h").agg(F.count(F.lit(1)).alias("met")).filter("met > 1").select("h"))
    rows = staged(rows.join(again, "h", "left_semi"))
    who = F.xxhash64("node")
    met = rows.groupBy("h").agg(F.count(F.lit(1)).alias("met"), F.bit_xor(who).alias("who"), F.min(who).alias("low"), F.max(who).alias("high"))
    met = met.groupBy("met", "who", "low", "high").agg(F.min("h").alias("h"), F.count(F.lit(1)).alias("weight"))
    common_first = Window.partitionBy("node").orderBy(F.col("met").desc(), F.col("h").desc())
    shared = rows.join(staged(met.select("h", "met", "weight")), "h").withColumn("rest", F.sum("weight").over(common_first))
    return shared.filter(F.col("rest") >= _spare("n") - 1)  # 1: what rounding may take off


def _candidates(shared: DataFrame, least: float) -> DataFrame:
    """``a, b``: pairs of texts with different roots that may be similar by what their prefixes share.

    Similar sets share ceil(least / (1 + least) * (n + m)) shingles. A prefix leaves out the last
    ceil(least * n) - ``_spare(n)`` in the common order, so the prefixes share all but the larger of
    these two numbers. Of what they share the rarest is followed by all the rest in both texts, so pairs meet
    only at shingles with that much ``rest``: of texts of equal length nine in a hundred and the spare
    ones. One common line is not enough, and texts a little less similar meet at few shingles.
    """
    sides = [shared.select("h", *[F.col(x).alias(f"{c}_{x}") for x in ("rest", "n", "root")], F.col("node").alias(c)) for c in "ab"]
    cut = F.greatest(*[F.ceil(least * F.col(n) - 1e-9) - _spare(n) for n in ("a_n", "b_n")])
    both = F.ceil(least / (1 + least) * (F.col("a_n") + F.col("b_n")) - 1e-6) - cut
    apart = (F.col("a") > F.col("b")) & (F.col("a_root") != F.col("b_root")) & _fits("a_n", "b_n", least)
    return sides[0].join(sides[1], "h").filter(apart & (F.least("a_rest", "b_rest") >= both)).select("a", "b").distinct()


def _fits(a: str, b: str, least: float) -> Column:
    """Whether sets of these sizes can be similar."""
    return F.least(a, b) >= least * F.greatest(a, b) - 1e-9


def similar_components(texts: DataFrame, least: float = SIMILARITY, hot: int = HOT) -> DataFrame:
    """``u, root`` over the distinct texts ``node, digest, text``: the smallest node that pairs of similar texts reach.

    First the texts that operator 6 links by their fingerprints are compared by all their shingles; a
    link of texts less similar does not count. Fingerprints within its radius are rarer than similar
    texts, so an exact join finds the rest: texts that share a prefix shingle are candidates. Of a
    shingle with many texts, those still apart are first compared with one of them, then with a few
    more, so that a large group of near copies grows together without all its pairs; then every
    candidate pair that is still apart is compared.
    """
    spark = texts.sparkSession
    done = roots = None

    def compare(pairs: DataFrame) -> int:
        nonlocal done, roots
        pairs = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        pairs = staged(pairs if done is None else pairs.join(done, ["u", "v"], "left_anti"))
        found = staged(_verified(pairs, texts, least))
        done = pairs if done is None else done.unionByName(pairs)
        if grown := found.count():
            # what was linked before is as well connected by its roots
            known = found if roots is None else found.unionByName(roots.select("u", F.col("root").alias("v")))
            roots = staged_alone(spark, lambda: components(known))
        return grown

    compare(near_pairs(texts.select(F.col("node").alias("id"), fingerprint_column("text").alias("fp"))))
    shared = staged_alone(spark, lambda: _shared(staged(_prefixes(texts, least))))
    for k, stars in enumerate(ROUNDS if shared.filter(F.col("met") > hot).limit(1).count() else ()):
        large = _rooted(shared.filter(F.col("met") > hot), roots)
        # a few texts of each shingle are found by partial aggregation, so no task holds all its texts
        found = [F.min_by(F.struct("node", "n", "root"), F.xxhash64("node", F.lit(k), F.lit(i))) for i in range(stars)]
        some = large.groupBy("h").agg(F.array_distinct(F.array(*found)).alias("some")).select("h", F.explode("some").alias("one"))
        stars = large.join(some, "h").filter((F.col("root") != F.col("one.root")) & _fits("n", "one.n", least))
        if not compare(stars.select(F.col("node").alias("a"), F.col("one.node").alias("b"))):
            break
    left = staged(_rooted(shared, roots))
    # shingles whose texts are all connected are settled
    open_ = left.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("h")
    left = left.join(open_, "h", "left_semi")
    compare(_candidates(left, least))
    return spark.createDataFrame([], "u long, root long") if roots is None else roots


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, hot: int = HOT) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component of similar texts, with all their columns.

    Two texts are similar if the sets of their five-word shingles have a Jaccard similarity of at
    least ``least``; every such pair links. Words are lower-cased (A-Z) and cut at ASCII white
    space; a text of fewer than five words is one shingle, so texts without words are equal.

    Null texts are empty. Null ids come after all others; of rows that share id and component one stays.
    """
    small_batches(docs.sparkSession)
    digest = F.sha2(text_of(docs, text_col), 256)
    rows = docs.select(docs[id_col].alias("id"), digest.alias("digest"), text_of(docs, text_col).alias("text"))

    def place() -> DataFrame:
        texts = rows.groupBy("digest").agg(F.first("text").alias("text")).withColumn("node", F.monotonically_increasing_id())
        texts = staged(texts.select("node", "digest", "text"))
        return _rooted(texts.select("node", "digest"), similar_components(texts, least, hot)).select("digest", "root")

    placed = staged_alone(docs.sparkSession, place)
    first = F.row_number().over(Window.partitionBy("root").orderBy(F.col("id").asc_nulls_last(), "digest"))
    lowest = rows.groupBy("digest").agg(F.min("id").alias("id")).join(placed, "digest")
    kept = lowest.withColumn("place", first).filter("place = 1").select(packed_key(F.col("id"), F.col("digest")).alias("key"))
    packed = docs.select(packed_key(docs[id_col], digest).alias("key"), F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    first = F.row_number().over(Window.partitionBy("key").orderBy(F.lit(1)))
    return packed.join(kept, "key", "left_semi").withColumn("place", first).filter("place = 1").select("doc.*")
