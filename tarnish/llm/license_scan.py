"""License scans: ordered signature rules over normalised words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnish.llm.common import ascii_lower, text_of
from tarnish.llm.license_rules import RULES, STEMS, WEIGHTS

#: The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Fixed value: characters that no word holds.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normal_words(text: Column) -> Column:
    """The words of a text, each with one space before it, and one after the last or alone."""
    words = F.trim(F.regexp_replace(ascii_lower(text), NO_WORD, " "))
    return F.when(words == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _spans(words: Column, rule: Column) -> Column:
    """Every match of a rule as ``start, -end, priority, label``, in word numbers; one pass over the pieces."""
    pieces = F.split(words, rule["pattern"], -1)
    found = F.regexp_extract_all(words, rule["pattern"], F.lit(0))
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,back:int,priority:int,label:string>>").alias("spans"))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + _spaces(pair["piece"])
        end = start + _spaces(pair["match"])
        span = F.struct(start.alias("start"), (-end).alias("back"), rule["priority"].alias("priority"), rule["label"].alias("label"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    pairs = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda a, b: F.struct(a.alias("piece"), b.alias("match")))
    return F.aggregate(pairs, nothing, step, lambda state: state["spans"])


def _survivors(spans: Column) -> Column:
    """``priority, label`` of the spans that no span of a stronger priority, and no larger one of
    the same priority, contains.

    Sorted by start and falling end, a containing span comes first, so it is enough to remember
    the furthest end seen of each priority, and the ends before the first span of equal extent.
    """
    n = len(WEIGHTS)
    nothing = F.struct(
        F.lit(-1).alias("start"),
        F.lit(0).alias("back"),
        F.array(*[F.lit(0)] * n).alias("larger"),
        F.array(*[F.lit(0)] * n).alias("reach"),
        F.array().cast("array<struct<priority:int,label:string>>").alias("kept"),
    )

    def step(state: Column, span: Column) -> Column:
        stronger = F.slice(state["reach"], 1, span["priority"] - 1)
        equal = (state["start"] == span["start"]) & (state["back"] == span["back"])
        larger = F.when(equal, state["larger"]).otherwise(state["reach"])
        hidden = F.exists(stronger, lambda end: end >= -span["back"]) | (F.element_at(larger, span["priority"]) >= -span["back"])
        reach = F.transform(
            state["reach"], lambda end, i: F.when(i + 1 == span["priority"], F.greatest(end, -span["back"])).otherwise(end)
        )
        own = F.array(F.struct(span["priority"].alias("priority"), span["label"].alias("label")))
        kept = F.when(hidden, state["kept"]).otherwise(F.array_union(state["kept"], own))
        return F.struct(
            span["start"].alias("start"), span["back"].alias("back"), larger.alias("larger"), reach.alias("reach"), kept.alias("kept")
        )

    return F.aggregate(F.sort_array(spans), nothing, step, lambda state: state["kept"])


def _rules() -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(label).alias("label"),
                F.lit(priority).alias("priority"),
                F.lit(keyword).alias("keyword"),
                F.lit(f" (?:{pattern})(?= )").alias("pattern"),
            )
            for label, priority, keyword, pattern in RULES
        ]
    )


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    The text becomes lower-case words. A rule is a pattern over words with a keyword that each of
    its matches holds; texts without any keyword stem skip the rules, and a rule runs only where
    its keyword occurs. Each match is an interval of words; an interval inside one of a stronger
    priority, or inside a larger one of its own, is suppressed. ``labels`` are those of the surviving rules and of the base phrases;
    ``score`` is the weight of the strongest of them, 0 without any.

    Null and empty texts have no words: zeros, nulls and empty label strings. Repeated rows each
    have a row, null ids stay null, an empty table gives an empty result, and other columns are
    not looked at. The scan works row by row: no shuffle, and a text of any length is read whole.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), normal_words(text_of(docs, text_col)).alias("words"))
    words = F.col("words")
    n_words = F.greatest(_spaces(words) - 1, F.lit(0))
    base = {phrase: F.regexp_extract_all(words, F.lit(f" {phrase}(?= )"), F.lit(0)) for phrase in BASE}
    places = {phrase: F.when(F.contains(words, F.lit(f" {phrase} ")), F.size(found)).otherwise(0) for phrase, found in base.items()}
    firsts = [F.when(F.contains(words, F.lit(f" {p} ")), _spaces(F.substring_index(words, f" {p} ", 1))) for p in BASE]
    lasts = [
        F.when(F.contains(words, F.lit(f" {p} ")), n_words - _spaces(F.substring_index(words, f" {p} ", -1)) - len(p.split()))
        for p in BASE
    ]
    gate = F.lit(False)
    for stem in STEMS:
        gate = gate | F.contains(words, F.lit(stem))
    near = F.filter(_rules(), lambda rule: F.contains(words, rule["keyword"]))
    spans = F.flatten(F.transform(near, lambda rule: _spans(words, rule)))
    nothing = F.array().cast("array<struct<priority:int,label:string>>")
    base_labels = F.array_compact(F.array(*[F.when(places[p] > 0, F.lit(label)) for p, label in BASE.items()]))
    scanned = rows.select(
        "doc_id",
        n_words.cast("long").alias("n_words"),
        sum(places.values(), F.lit(0)).cast("long").alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"),
        F.greatest(*lasts).cast("long").alias("last_word"),
        F.sort_array(base_labels).alias("base"),
        F.when(gate, _survivors(spans)).otherwise(nothing).alias("found"),
    )
    weights = F.create_map(*[x for p, w in WEIGHTS.items() for x in (F.lit(p), F.lit(w))])
    strongest = F.array_min(F.transform("found", lambda f: f["priority"]))
    labels = F.array_union(F.transform("found", lambda f: f["label"]), F.col("base"))
    return scanned.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.sort_array(labels), ",").alias("labels"),
        F.greatest(
            F.coalesce(weights[strongest], F.lit(0.0)), F.when(F.size("base") > 0, F.lit(WEIGHTS[1])).otherwise(0.0)
        ).alias("score"),
    )
