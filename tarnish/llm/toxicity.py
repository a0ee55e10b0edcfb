"""Toxicity by two class-conditional Kneser-Ney models with shared back-off counts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnish.llm.common import remainder, small_batches, staged, text_of

#: At most so many labelled rows of each class are learned from, those of smallest hash.
MAX_TOXIC, MAX_ORDINARY = 6000, 12000
#: What absolute discounting takes from every count, in documents of the smaller class.
DISCOUNT = 2.0
#: Least share of the back-off count for either class.
FLOOR = 0.05
#: Events that a task counts at a time.
COUNTED = 1 << 19
#: A word backs off to its first letters, longest first.
PREFIXES = (8, 7, 6, 5, 4, 3)
#: Share of a text's tokens that its most telling passage takes.
TELLING = 0.01
THRESHOLD = 0.7
_WORD = re.compile(r"\w+")
_CACHE = 1 << 18
_MARKS = [(n, b"%d " % n) for n in reversed(PREFIXES)]
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _hash(event: str) -> int:
    return xxhash.xxh64_intdigest(event.encode("utf-8", "surrogatepass"))


def events_of(word: str) -> list[int]:
    """Keys of a word's events, the coarsest first: prefixes, then the word."""
    if not word.isascii():
        return [_hash(f"{n} {word[:n]}") for n in reversed(PREFIXES) if len(word) > n] + [_hash(word)]
    letters, size = word.encode(), len(word)  # letters are bytes: encoded once for all prefixes
    keys = [xxhash.xxh64_intdigest(mark + letters[:n]) for n, mark in _MARKS if size > n]
    keys.append(xxhash.xxh64_intdigest(letters))
    return keys


def pair_keys(hashes: np.ndarray) -> np.ndarray:
    """Keys of each word after the first together with the one before it."""
    mixed = hashes[:-1] * _GOLDEN + hashes[1:]
    return (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


# ------------------------------------------------------------------- learning


def sample_labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_toxic: int, max_ordinary: int) -> DataFrame:
    """``text, toxic, fold`` of the training rows: labelled, and crc32 of the id modulo 3 is not 1."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("l_id")).agg(F.max("toxic").alias("toxic"))
    known = known.filter(remainder(F.col("l_id"), 3) != 1)
    mixed = F.xxhash64("l_id")
    parts = [
        known.filter("toxic = 1").orderBy(mixed, "l_id").limit(max_toxic),
        known.filter("toxic = 0").orderBy(mixed, "l_id").limit(max_ordinary),
    ]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # at most the two limits
    rows = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("text"))
    fold = F.pmod(F.xxhash64("id", "text"), F.lit(2)).cast("int")
    return staged(rows.join(chosen, F.col("id") == F.col("l_id")).select("text", "toxic", fold.alias("fold")))


def count_documents(sample: DataFrame) -> DataFrame:
    """``key, before, c0..c3``: in how many documents each event occurs, by 2 * toxic + fold.

    Kneser-Ney counts contexts, not occurrences; here the context is the document, so a text that
    repeats itself counts once. ``before`` is the key of a pair's first word, 0 for other events.
    """

    def counted(keys: list, before: list, at: list) -> pd.DataFrame:
        key, first_words, column = np.concatenate(keys), np.concatenate(before), np.concatenate(at)
        unique, first, place = np.unique(key, return_index=True, return_inverse=True)
        counts = np.zeros((len(unique), 4), dtype=np.int64)
        np.add.at(counts, (place, column), 1)
        out = pd.DataFrame(counts, columns=["c0", "c1", "c2", "c3"])
        return out.assign(key=unique.view(np.int64), before=first_words[first].view(np.int64))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, before, at, n = [], [], [], 0
        for batch in batches:
            for text, toxic, fold in zip(batch["text"], batch["toxic"], batch["fold"]):
                words = words_of(text)
                if not words:
                    continue
                singles = {k for w in set(words) for k in events_of(w)}
                hashes = np.fromiter(map(_hash, words), dtype=np.uint64, count=len(words))
                pairs, first = np.unique(pair_keys(hashes), return_index=True)
                keys += [np.fromiter(singles, dtype=np.uint64, count=len(singles)), pairs]
                before += [np.zeros(len(singles), dtype=np.uint64), hashes[first]]
                at.append(np.full(len(singles) + len(pairs), 2 * int(toxic) + fold))
                n += len(at[-1])
                if n >= COUNTED:
                    yield counted(keys, before, at)
                    keys, before, at, n = [], [], [], 0
        if n:
            yield counted(keys, before, at)

    partial = sample.mapInPandas(run, "c0 long, c1 long, c2 long, c3 long, key long, before long")
    return partial.groupBy("key").agg(F.max("before").alias("before"), *[F.sum(c).alias(c) for c in ("c0", "c1", "c2", "c3")])


class Model:
    """Log-likelihood ratios from the discounted counts of both classes.

    Per event, each class has its count less the discount; what was taken off both is the shared
    back-off count, dealt out by the ratio of the coarser event. So an expression that is rare in
    both classes says what its coarser form says, and nothing where that is rare as well. Only
    events that keep something after discounting are stored.
    """

    def __init__(self, keys, before, toxic, ordinary, n_toxic: int, n_ordinary: int, discount: float):
        counts = np.column_stack([toxic, ordinary * (n_toxic / max(1, n_ordinary))]).astype(float)
        single = before == 0
        self.singles, rows = self._kept(keys[single], counts[single], discount)
        self.single_parts = self._split(rows, discount)
        # a pair's counts are compared given its first word
        at, known = self._find(self.singles, before[~single])
        first = np.ones((len(at), 2))
        first[known] = rows[at[known]]
        pairs = counts[~single]
        pairs[:, 1] *= (first[:, 0] + discount) / (first[:, 1] + discount)
        self.pairs, rows = self._kept(keys[~single], pairs, discount)
        self.pair_parts = self._split(rows, discount)

    @staticmethod
    def _kept(keys: np.ndarray, counts: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
        held = (counts > discount).any(axis=1)
        order = np.argsort(keys[held])
        return keys[held][order], counts[held][order]

    @staticmethod
    def _find(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each key would stand among the known ones, and whether it does."""
        if not len(known):
            return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return at, known[at] == keys

    @staticmethod
    def _split(counts: np.ndarray, discount: float) -> np.ndarray:
        """Columns: toxic and ordinary after discounting, and the shared back-off count."""
        left = np.maximum(counts - discount, 0)
        return np.column_stack([left, (counts - left).sum(axis=1)])

    @staticmethod
    def _ratio(toxic, ordinary, shared, coarser):
        # a twentieth of it goes to either side whatever the coarser event says, so no ratio runs away
        part = shared * (FLOOR + (1 - 2 * FLOOR) / (1 + np.exp(-coarser)))
        return np.log((toxic + part) / (ordinary + shared - part))

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The key and the log ratio of each word, from its coarsest event to the word itself."""
        events = np.zeros((len(words), len(PREFIXES) + 1), dtype=np.uint64)
        for row, word in enumerate(words):
            own = events_of(word)
            events[row, -len(own) :] = own
        ratios = np.zeros(len(words))
        for keys in events.T:
            at, known = self._find(self.singles, keys)
            known &= keys > 0
            ratios[known] = self._ratio(*self.single_parts[at[known]].T, ratios[known])
        return events[:, -1], ratios

    def features(self, texts, cache: WordCache) -> np.ndarray:
        """Length-normalised log-likelihood ratio of each text, and of its most telling tokens."""
        out = np.zeros((len(texts), 2))
        for row, text in enumerate(texts):
            words = words_of(text)
            if not words:
                continue
            at = cache.places(words, self)
            hashes, ratios = cache.hashes[at], cache.ratios[at]
            at, known = self._find(self.pairs, pair_keys(hashes))
            hit = np.flatnonzero(known)
            ratios[hit + 1] = self._ratio(*self.pair_parts[at[hit]].T, ratios[hit + 1])
            n = max(1, int(len(words) * TELLING))
            out[row] = ratios.mean(), np.partition(ratios, len(ratios) - n)[-n:].mean()
        return out


class WordCache(dict):
    """Places of the words met in two arrays, their keys and log ratios; past ``_CACHE`` words it starts anew."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.hashes, self.ratios = np.zeros(0, dtype=np.uint64), np.zeros(0)

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        return place

    def places(self, words: list[str], model: Model) -> np.ndarray:
        """The place of each word; those of new words are filled from the model."""
        if len(self) > _CACHE:
            self.clear()
        known = len(self)
        at = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        if len(self) > known:
            new = list(islice(reversed(self), len(self) - known))[::-1]
            if len(self) > len(self.hashes):
                room = 2 * len(self) - len(self.hashes)
                self.hashes = np.concatenate([self.hashes, np.zeros(room, dtype=np.uint64)])
                self.ratios = np.concatenate([self.ratios, np.zeros(room)])
            self.hashes[known : len(self)], self.ratios[known : len(self)] = model.words(new)
        return at


def fit_logistic(features: np.ndarray, target: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    x = np.column_stack([np.ones(len(features)), features])
    weights = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, x.T @ (target - p) - ridge * weights)
        weights += step
        if np.abs(step).max() < 1e-9:
            break
    return weights


class Scorer:
    def __init__(self, model: Model | None, weights: np.ndarray):
        self.model, self.weights, self.cache = model, weights, WordCache()

    def scores(self, texts) -> np.ndarray:
        features = self.model.features(texts, self.cache) if self.model else np.zeros((len(texts), 2))
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + features @ self.weights[1:], -30, 30)))


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_toxic: int = MAX_TOXIC,
    max_ordinary: int = MAX_ORDINARY,
    discount: float = DISCOUNT,
) -> Scorer:
    """Learn both models and the scale of the score from a bounded sample of labelled rows.

    Everything that reaches the driver comes from that sample: the events that keep something
    after discounting, and two features per sampled row. The features that set the scale are those
    of models that did not see the row. Without rows of both classes every score is one half.
    """
    sample = sample_labelled(docs, labels, id_col, text_col, max_toxic, max_ordinary)
    sizes = np.zeros(4, dtype=np.int64)
    for r in sample.groupBy("toxic", "fold").count().collect():
        sizes[2 * int(r["toxic"]) + r["fold"]] = r["count"]
    if not sizes.all():
        return Scorer(None, np.zeros(3))
    least = discount * min(1.0, max(1.0, (sizes[0] + sizes[1]) / (sizes[2] + sizes[3])))
    counts = count_documents(sample).filter(f"c0 + c1 > {least} or c2 + c3 > {least}").toArrow()
    keys, before = (counts[c].to_numpy().view(np.uint64) for c in ("key", "before"))
    c = [counts[f"c{i}"].to_numpy() for i in range(4)]
    del counts
    folds = [Model(keys, before, c[3 - f], c[1 - f], sizes[3 - f], sizes[1 - f], discount) for f in (0, 1)]
    shared = docs.sparkSession.sparkContext.broadcast(folds)

    @F.pandas_udf("array<double>")
    def unseen(text: pd.Series, fold: pd.Series) -> pd.Series:
        out = np.zeros((len(text), 2))
        for f, model in enumerate(shared.value):
            own = (fold == f).to_numpy()
            out[own] = model.features(text[own].tolist(), WordCache())
        return pd.Series(list(out))

    found = unseen("text", "fold")
    rows = sample.select("toxic", found.alias("f")).select("toxic", F.col("f")[0].alias("a"), F.col("f")[1].alias("b")).toArrow()
    shared.destroy()
    features = np.column_stack([rows["a"].to_numpy(), rows["b"].to_numpy()])
    weights = fit_logistic(features, rows["toxic"].to_numpy().astype(float))
    return Scorer(Model(keys, before, c[2] + c[3], c[0] + c[1], sizes[2] + sizes[3], sizes[0] + sizes[1], discount), weights)


# -------------------------------------------------------------------- scoring


def _scored(scorer: Scorer, columns: Iterator[pd.Series], forget: bool) -> Iterator[pd.Series]:
    for column in columns:
        yield pd.Series(scorer.scores(column.tolist()))
    if forget:
        scorer.cache.clear()


def toxicity_column(shared: Broadcast, text: Column, forget: bool = False) -> Column:
    """The score of a text, 0 to 1, by a broadcast :class:`Scorer`. With ``forget`` a task leaves no
    cached words in its Python worker, which stays when the task is over."""

    @F.pandas_udf("double")
    def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from _scored(shared.value, columns, forget)

    return run(text)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    The score compares the length-normalised log-likelihoods of a toxic and an ordinary model, over
    the whole text and over its most telling tokens, so that neither a short text nor one insult in
    a long one is lost. It looks at the text alone. ``held_out`` marks the rows whose label is
    never learned (crc32 of the id modulo 3 is 1); ``predicted`` is 1 from a score of 0.7.

    Null text is empty text; texts without words get the score of no evidence. A null id counts as
    empty text for the remainder, and has no label. Of several labels of an id the highest counts;
    null labels do not. Repeated rows each have a row. Empty tables give an empty result or, for
    the labels, one half for all. Other columns are not looked at.
    """
    small_batches(docs.sparkSession)
    scorer = fit_toxicity(docs, labels, id_col, text_col, **limits)
    score = toxicity_column(docs.sparkSession.sparkContext.broadcast(scorer), text_of(docs, text_col))
    rows = docs.select(docs[id_col].alias("doc_id"), (remainder(docs[id_col], 3) == 1).alias("held_out"), score.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns.

    They are written once, and tasks forget the words they met, so that model and words leave the
    workers before later stages run. Null and
    empty texts score like no evidence, rows with null or repeated ids are judged one by one, an
    empty table stays empty, and columns of any name pass through.
    """
    small_batches(docs.sparkSession)
    scorer = fit_toxicity(docs, labels, id_col, text_col, **limits)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    kept = staged(docs.filter(toxicity_column(shared, text_of(docs, text_col), forget=True) < THRESHOLD))
    shared.destroy()
    return kept
