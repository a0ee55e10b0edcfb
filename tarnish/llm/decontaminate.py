"""Benchmark decontamination by template windows and slot consistency."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnish.llm.common import staged, text_of

#: Words of a window; an item of fewer than 2 * WINDOW - 1 words is one window.
WINDOW = 5
#: A window of so many slots is dense: documents are cut at every word for those.
DENSE = 3
#: Share of an item's words that consistent windows must cover.
COVERAGE = 0.5
#: The marks put before numbers, names and units.
NUMBER, NAME, UNIT = "\x01", "\x02", "\x03"
#: Units of measure; they count as slots wherever they stand as a word.
UNITS = (
    "mm cm m km in inch inches ft foot feet yard yards mile miles mg g kg lb lbs pound pounds oz ounce ounces ton tons ml l liter liters "
    "litre litres gallon gallons s sec second seconds minute minutes hour hours day days week weeks month months year years usd eur gbp "
    "dollar dollars cent cents euro euros percent degree degrees mph kmh watt watts volt volts hz"
).split()


def marked_words(text: Column) -> Column:
    """Lower-case words, each followed by a space; numbers, names and units start with their mark.

    A name is a capitalised word inside a sentence: after a letter, digit or comma, and not in
    capitals throughout. Numbers keep
    their inner points and commas as the letter p, so each is one word.
    """
    units = "|".join(UNITS)
    steps = [
        (r"[\x01-\x03]", " "),
        (r"(?<=[\p{Ll}0-9,;][ \n])(?=\p{Lu}\p{Ll})", NAME),
        (r"(?<=[0-9])[.,:](?=[0-9])", "p"),
        (r"(?<![\p{L}\p{N}\x02])(?=[0-9])", NUMBER),
        (rf"(?<![\p{{L}}\p{{N}}\x01\x02])(?=(?:{units})(?![\p{{L}}\p{{N}}]))", UNIT),
    ]
    marked = reduce(lambda t, step: F.regexp_replace(t, *step), steps, text)
    words = F.trim(F.regexp_replace(F.lower(marked), r"[^\p{L}\p{N}\x01-\x03]+", " "))
    return F.when(words == "", words).otherwise(F.concat(words, F.lit(" ")))


def template(words: Column) -> Column:
    """Marked words with every slot's value taken out."""
    return F.regexp_replace(words, r"([\x01-\x03])\S*", "$1")


def _window_key(canonical: Column, marked: Column) -> Column:
    """A window without a plain word says nothing as a template; it keeps its values."""
    return F.when(F.rlike(canonical, F.lit(r"(?:^| )[^\x01-\x03 ]")), canonical).otherwise(marked)


def _dense(words: int, slots: int, plain: int) -> str:
    """Pattern of so many words with at least these numbers of slots and of plain words."""
    if words == 0:
        return ""
    if slots <= 0 and plain <= 0:
        return rf"(?:\S++ ){{{words}}}"
    options = []
    if words > slots:
        options.append(r"[^\x01-\x03\s]\S*+ " + _dense(words - 1, slots, plain - 1))
    if words > plain:
        options.append(r"[\x01-\x03] " + _dense(words - 1, slots - 1, plain))
    return f"(?:{'|'.join(options)})"


def _item_words(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    words = benchmark.select(benchmark[item_col].alias("item_id"), marked_words(text_of(benchmark, text_col)).alias("words"))
    listed = words.select(
        "item_id",
        F.filter(F.split("words", " "), lambda w: w != "").alias("item_marked"),
        F.filter(F.split(template(F.col("words")), " "), lambda w: w != "").alias("item_template"),
    )
    n = F.size("item_template")
    # repeated items are one
    listed = listed.filter(n > 0).distinct().withColumn("whole", n < 2 * WINDOW - 1)
    return listed.withColumn("width", F.when(F.col("whole"), n).otherwise(WINDOW))


def _item_windows(items: DataFrame) -> DataFrame:
    starts = F.sequence(F.lit(0), F.size("item_template") - F.col("width"))
    rows = items.select("*", F.explode(starts).alias("start"))
    parts = [F.concat(F.array_join(F.slice(c, F.col("start") + 1, F.col("width")), " "), F.lit(" ")) for c in ("item_template", "item_marked")]
    return rows.select("item_id", "width", "start", F.xxhash64(_window_key(*parts)).alias("hash"))


def _doc_windows(docs: DataFrame, widths: list[tuple[int, bool]]) -> DataFrame:
    """Windows of the documents, of each width: at every word for items that are one window; else
    those that start at multiples of the width, and dense ones with a plain word at every word.

    An item's windows start at every word. A stretch of 2 * width - 1 shared words holds one whole
    document window, so the coarser grid loses nothing of what is copied with its values. Dense
    windows on the grid may have no plain word and then keep their values, so they are not enough
    where values have changed.
    """
    found = docs.withColumn("template", template(F.col("words")))
    keys = []

    def placed(width: int, step: int):
        return lambda h, i: F.struct(h.alias("hash"), F.lit(width).alias("width"), (i * step).alias("at"))

    def every(pattern: str, column: str) -> Column:
        """An element for each word: what the pattern finds from there on, else empty."""
        return F.regexp_extract_all(F.col(column), F.lit(rf"(?:(?=({pattern}))|)\S++ "), F.lit(1))

    for width, whole in widths:
        cut = rf"(?:\S++ ){{{width}}}"
        if whole:
            windows = F.zip_with(every(cut, "template"), every(cut, "words"), lambda t, m: F.when(t != "", F.xxhash64(_window_key(t, m))))
            keys.append(F.filter(F.transform(windows, placed(width, 1)), lambda w: w["hash"].isNotNull()))
            continue
        both = [F.regexp_extract_all(c, F.lit(cut), F.lit(0)) for c in (F.col("template"), F.col("words"))]
        keys.append(F.transform(F.zip_with(*both, lambda t, m: F.xxhash64(_window_key(t, m))), placed(width, width)))
        dense = F.transform(every(_dense(width, DENSE, 1), "template"), lambda t: F.when(t != "", F.xxhash64(t)))
        keys.append(F.filter(F.transform(dense, placed(width, 1)), lambda w: w["hash"].isNotNull()))
    rows = found.select("id", "text_hash", F.explode(F.concat(*keys)).alias("w"))
    return rows.select("id", "text_hash", "w.hash", "w.width", "w.at")


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    coverage: float = COVERAGE,
) -> DataFrame:
    """Leaked items: ``doc_id, item_id, coverage, n_slots, reparameterised, text_hash``, a row per document and item.

    Numbers, names and units of both sides become typed slots. Hashes of template windows find
    candidates and the places where the two texts line up; there the words are compared. Windows
    that are equal with their values count. Others need a plain word, and slots that are consistent
    at their alignment: equal values of the item are equal in the document (different ones may be
    equal too). If an item's value is partly kept and partly changed, the windows with the change do
    not count; if it is changed in two ways and kept nowhere, no changed window of the alignment
    does; nor do changed windows that, at their alignment, cover fewer than nine words with fewer than
    three plain ones. An item has leaked if the windows that count cover at least ``coverage`` of its words and
    nine words, or all words of an item of fewer; ``reparameterised`` says that some value was
    changed on the way.

    Null texts are empty, and empty texts and items never match. Repeated items with equal text
    are one; repeated rows of a document are found each. A null document or item id is reported as
    null. Empty tables give an empty result. Other columns are not looked at.
    """
    text = text_of(docs, text_col)
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(text, F.octet_length(text)).alias("text_hash"), text.alias("text"))
    items = staged(_item_words(benchmark, item_col, item_text_col))
    widths = sorted((r["width"], r["whole"]) for r in items.select("width", "whole").distinct().collect())  # 2 * WINDOW values at most
    schema = f"doc_id {docs.select(docs[id_col]).dtypes[0][1]}, item_id {items.dtypes[0][1]}, coverage double, n_slots int, reparameterised boolean, text_hash long"
    if not widths:
        return docs.sparkSession.createDataFrame([], schema)
    windows = _doc_windows(rows.select("id", "text_hash", marked_words(F.col("text")).alias("words")), widths)
    known = staged(_item_windows(items))
    hits = windows.join(known, ["hash", "width"]).select("id", "text_hash", "item_id", (F.col("at") - F.col("start")).alias("shift"))
    found = staged(hits.distinct().groupBy("id", "text_hash", "item_id").agg(F.sort_array(F.collect_set("shift")).alias("shifts")))
    same = F.col("id").eqNullSafe(F.col("d_id")) & (F.col("text_hash") == F.col("d_hash"))
    texts = rows.select(F.col("id").alias("d_id"), F.col("text_hash").alias("d_hash"), "text")
    pairs = found.join(texts, same).withColumn("words", marked_words(F.col("text")))
    pairs = pairs.select(
        "id",
        "text_hash",
        "item_id",
        "shifts",
        F.split("words", " ").alias("doc_marked"),
        F.split(template(F.col("words")), " ").alias("doc_template"),
    )
    renamed = items.withColumnRenamed("item_id", "i_id")
    pairs = pairs.join(renamed, F.col("item_id").eqNullSafe(F.col("i_id")))
    n = F.size("item_template")

    def within(column: str, start: Column) -> Column:
        return F.slice(column, F.greatest(start, F.lit(0)) + 1, F.col("width"))

    def values_of(starts: Column, shift: Column) -> tuple[Column, Column]:
        """The words that windows cover, and the values that the item and the document have in their slots."""
        covered = F.array_distinct(F.flatten(F.transform(starts, lambda s: F.sequence(s, s + F.col("width") - 1))))
        slots = F.filter(covered, lambda i: F.rlike(F.element_at("item_template", i + 1), F.lit(r"[\x01-\x03]")))
        pair = lambda i: F.struct(F.element_at("item_marked", i + 1).alias("a"), F.element_at("doc_marked", i + shift + 1).alias("b"))
        return covered, F.array_distinct(F.transform(slots, pair))

    def matching(shift: Column) -> Column:
        """Window starts at this shift whose templates match, and the values in their slots."""
        equal = lambda s: (s + shift >= 0) & (within("doc_template", s + shift) == within("item_template", s))
        starts = F.filter(F.sequence(F.lit(0), n - F.col("width")), equal)
        return F.struct(shift.alias("shift"), starts.alias("starts"), values_of(starts, shift)[1].alias("values"))

    def conflicts(place: Column) -> Column:
        """Changes of a value that has another counterpart as well; ``kept``: one of these is the value itself."""
        others = lambda v: F.filter(place["values"], lambda w: (w["a"] == v["a"]) & (w["b"] != v["b"]))
        changed = F.filter(place["values"], lambda v: (v["a"] != v["b"]) & (F.size(others(v)) > 0))
        bad = F.transform(changed, lambda v: F.struct(v["a"].alias("a"), v["b"].alias("b"), F.exists(others(v), lambda w: w["b"] == v["a"]).alias("kept")))
        return F.struct(*[place[c].alias(c) for c in ("shift", "starts", "values")], bad.alias("bad"))

    def counted(place: Column) -> Column:
        """The windows that count, as the words they cover and the values in their slots."""
        shift, bad = place["shift"], place["bad"]
        slot = lambda s, i: (F.element_at("item_marked", s + i + 1), F.element_at("doc_marked", s + shift + i + 1))
        touched = lambda s, v: F.exists(
            F.sequence(F.lit(0), F.col("width") - 1), lambda i: (slot(s, i)[0] == v["a"]) & (slot(s, i)[1] == v["b"])
        )
        plain = lambda s: F.exists(within("item_template", s), lambda w: ~F.rlike(w, F.lit(r"[\x01-\x03]")))
        same = lambda s: within("item_marked", s) == within("doc_marked", s + shift)
        follows = lambda s: plain(s) & F.forall(bad, lambda v: v["kept"]) & ~F.exists(bad, lambda v: touched(s, v))
        starts = F.filter(place["starts"], lambda s: same(s) | follows(s))
        return F.struct(shift.alias("shift"), starts.alias("starts"), F.filter(place["starts"], same).alias("same"))

    def said(place: Column) -> Column:
        """Changed windows with few plain words, all in all, meet by chance; then only equal ones count."""
        covered = values_of(place["starts"], place["shift"])[0]
        plain = F.filter(covered, lambda i: ~F.rlike(F.element_at("item_template", i + 1), F.lit(r"[\x01-\x03]")))
        enough = (F.size(plain) > WINDOW - DENSE) | (F.size(covered) >= F.least(n, F.lit(2 * WINDOW - 1)))
        covered, values = values_of(F.when(enough, place["starts"]).otherwise(place["same"]), place["shift"])
        return F.struct(covered.alias("covered"), values.alias("values"))

    # an alignment is judged by itself
    places = F.col("shifts")
    for step in (matching, conflicts, counted, said):
        places = F.transform(places, step)
    # staged, as Spark would repeat the steps for the filter
    placed = staged(pairs.select("id", "text_hash", "item_id", n.alias("n"), places.alias("places")))
    words = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: p["covered"]))))
    judged = placed.filter(words >= F.least(F.col("n"), F.lit(2 * WINDOW - 1))).select(
        F.col("id").alias("doc_id"),
        "item_id",
        (words / F.col("n")).alias("coverage"),
        F.coalesce(F.array_max(F.transform("places", lambda p: F.size(p["values"]))), F.lit(0)).alias("n_slots"),
        F.exists("places", lambda p: F.exists(p["values"], lambda v: v["a"] != v["b"])).alias("reparameterised"),
        "text_hash",
    )
    return judged.filter(F.col("coverage") >= coverage)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` into which no item of the benchmark has leaked, with all their columns."""
    leaks = find_leaks(docs, benchmark, id_col, text_col, coverage=coverage).select("doc_id", "text_hash").distinct()
    leaks = staged(leaks.select(F.col("doc_id").alias("d_id"), F.col("text_hash").alias("d_hash")))
    text = text_of(docs, text_col)
    packed = docs.select(
        docs[id_col].alias("id"), F.xxhash64(text, F.octet_length(text)).alias("text_hash"), F.struct(*[docs[c] for c in docs.columns]).alias("doc")
    )
    same = F.col("id").eqNullSafe(F.col("d_id")) & (F.col("text_hash") == F.col("d_hash"))
    return packed.join(leaks, same, "left_anti").select("doc.*")
