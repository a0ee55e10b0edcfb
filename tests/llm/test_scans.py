"""License scan, toxicity, decontamination, HTML and the pipeline."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tarnish.llm import toxicity
from tarnish.llm.common import small_batches
from tarnish.llm.decontaminate import drop_leaks, find_leaks
from tarnish.llm.exact_dedup import drop_copies
from tarnish.llm.html_text import extract_html, visible_text
from tarnish.llm.license_rules import RULES, STEMS, WEIGHTS
from tarnish.llm.license_scan import BASE, license_scan
from tarnish.llm.toxicity import Model, drop_toxic, fit_logistic, score_toxicity

# -------------------------------------------------------------------- licenses

_COMPILED = [(label, priority, keyword, re.compile(f" (?:{pattern})(?= )")) for label, priority, keyword, pattern in RULES]


def plain_scan(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)
    joined = " " + "".join(w + " " for w in words)
    places, base = [], set()
    for phrase, label in BASE.items():
        want = phrase.split()
        for i in range(len(words) - len(want) + 1):
            if words[i : i + len(want)] == want:
                places.append(i)
                base.add(label)
    spans = []
    for label, priority, keyword, pattern in _COMPILED:
        for m in pattern.finditer(joined):
            spans.append((joined[: m.start()].count(" "), joined[: m.end()].count(" "), priority, label))

    def hides(o, s):
        return o[0] <= s[0] and o[1] >= s[1] and (o[2] < s[2] or (o[2] == s[2] and o[1] - o[0] > s[1] - s[0]))

    kept = [s for s in spans if not any(hides(o, s) for o in spans)]
    labels = base | {s[3] for s in kept}
    score = max([WEIGHTS[s[2]] for s in kept] + [WEIGHTS[1]] * bool(base), default=0.0)
    first, last = (min(places), max(places)) if places else (None, None)
    return (len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score)


TEXTS = [
    "Licensed under the Apache License, Version 2.0 (the \"License\"); see http://www.apache.org/licenses/LICENSE-2.0.",
    "This is released under the MIT license. Under the MIT License! under the mit-license",
    "GNU Lesser General Public License version 2.1, or the GNU General Public License as published by the Free Software Foundation, "
    "either version 3 of the License, or (at your option) any later version.",
    "SPDX-License-Identifier: GPL-2.0-or-later // CC BY-NC-SA 4.0 and CC-BY-NC, cc by nc",
    "Apache License version 20 is none; all rights reserved. Copyright (c) 2019 X",
    "LICENſE K under the mit licenſe",
    "cc by nc " * 300,
]


def test_rules_are_gated_by_their_keywords():
    assert len(RULES) > 200 and {p for _, p, _, _ in RULES} == set(WEIGHTS)
    for _, _, keyword, pattern in RULES:
        assert any(stem in keyword for stem in STEMS)
        # a literal run of the pattern outside all optional parts holds the keyword
        plain = re.sub(r"\(\?:[^()]*(?:\([^()]*\)[^()]*)*\)\??", "\x00", pattern)
        assert keyword in plain or all(keyword in v for v in _variants(pattern)), (keyword, pattern)


def _variants(pattern):
    """Some expansions of the alternatives of a pattern."""
    found = re.search(r"\(\?:([^()]*)\)(\??)", pattern)
    if not found:
        yield re.sub(r"\[([^\]])[^\]]*\](?:\{\d+(?:,\d+)?\})?", r"\1", re.sub(r" \?|[a-z]\?", lambda m: m[0][0], pattern))
        return
    for option in [*found[1].split("|"), *([""] if found[2] else [])]:
        yield from _variants(pattern[: found.start()] + option + pattern[found.end() :])


def test_license_scan(spark, small, odd, empty):
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for df in (extra, odd, small):
        want = Counter((r["doc_id"], *plain_scan(r["text"])) for r in df.collect())
        assert Counter(tuple(r) for r in license_scan(df).collect()) == want
    assert license_scan(empty).count() == 0
    labels = {r["doc_id"]: r["labels"].split(",") for r in license_scan(extra).collect()}
    assert labels[1000] == ["apache-2"] and labels[1001] == ["mit"]
    assert labels[1002] == ["gpl-3-or-later", "lgpl-2-1"]


# -------------------------------------------------------------------- toxicity


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = score_toxicity(docs.withColumn("toxic", F.lit(1)), labels).join(labels, "doc_id").filter("held_out").collect()
    found = Counter((r["toxic"], r["predicted"]) for r in rows)
    assert found[1, 1] > 0.85 * (found[1, 0] + found[1, 1]) and found[0, 1] < 0.01 * (found[0, 0] + found[0, 1])
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_toxicity_edges(spark, small, odd, empty):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = score_toxicity(odd, labels.unionByName(labels).withColumn("quality", F.lit(None)))
    assert rows.count() == odd.count() and rows.filter("score is null or isnan(score)").count() == 0
    assert score_toxicity(empty, labels).count() == 0
    assert {r["score"] for r in score_toxicity(small, labels.filter("false")).collect()} == {0.5}
    assert drop_toxic(odd, labels).columns == odd.columns


def test_rare_events_back_off():
    import numpy as np

    from tarnish.llm.toxicity import events_of

    keys = np.array([*events_of("abcdefgh"), *events_of("abczzz")[-1:]], dtype=np.uint64)
    counts = np.array([50.0] * (len(keys) - 1) + [1.0])
    zero = np.zeros(len(keys))
    model = Model(keys, np.zeros(len(keys), dtype=np.uint64), counts, zero, 100, 100, 2.0)
    seen, rare, other = model.words(["abcdefgh", "abczzz", "unseen"])[1]
    assert seen > rare > 1 and other == 0
    weights = fit_logistic(np.array([[0.0], [1.0], [2.0], [3.0]]), np.array([0, 0, 1, 1.0]))
    assert weights[1] > 0


# -------------------------------------------------------------- decontamination

ITEMS = [
    (1, "A farmer named Alice has 12 apples and 7 pears, gives 12 apples to Bob, and walks 3 km home. How many pears are left with Alice?"),
    (2, "the quick brown fox jumps over the lazy dog while seven wizards quietly box near the old stone bridge"),
    (2, "the quick brown fox jumps over the lazy dog while seven wizards quietly box near the old stone bridge"),
    (3, "short item of five"),
    (4, None),
    (None, ""),
    (5, "41 52 63 74 85 96 17 28 39 40 51 62"),
]
CHANGED = ITEMS[0][1].replace("12", "30").replace("7", "9").replace("Alice", "Carol").replace("Bob", "Dave").replace("km", "miles")
DOCS = {
    1: "noise before it " * 40 + ITEMS[0][1] + " noise after it" * 30,
    2: "some words here. " + CHANGED + " and more",
    3: CHANGED.replace("gives 30", "gives 31") + " tail",
    4: "x y z THE QUICK BROWN FOX JUMPS OVER THE LAZY DOG WHILE SEVEN WIZARDS QUIETLY BOX NEAR THE OLD STONE BRIDGE",
    5: "the quick brown fox jumped over nothing and the lazy dog slept",
    6: "here stands a short item of five words",
    7: "11 22 33 44 55 66 77 88 99 10 21 32 43 54",
    8: "1 41 52 63 74 85 96 17 28 39 40 51 62",
    9: None,
    10: "",
}


def test_leaks(spark, empty, odd):
    docs = spark.createDataFrame(list(DOCS.items()) + [(1, DOCS[1]), (None, DOCS[4])], "doc_id long, text string")
    docs = docs.withColumn("template", F.lit(1)).withColumn("id", F.lit(2)).withColumn("text_hash", F.lit(3))
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = Counter((r["doc_id"], r["item_id"], r["reparameterised"]) for r in find_leaks(docs, benchmark).collect())
    assert found == {(1, 1, False): 2, (2, 1, True): 1, (4, 2, False): 1, (None, 2, False): 1, (6, 3, False): 1, (8, 5, False): 1}
    kept = drop_leaks(docs, benchmark)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 5, 7, 9, 10]
    assert find_leaks(empty, benchmark).count() == 0 and find_leaks(odd, benchmark.filter("false")).count() == 0
    assert drop_leaks(odd, benchmark.filter("item_id = 4")).count() == odd.count()


def leaked(spark, docs, items):
    docs = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r["reparameterised"] for r in find_leaks(docs, items).collect()}


def test_dense_questions_are_found_at_every_offset(spark):
    items = [
        "A train travels 120 km in 3 hours. How many km in 5 hours?",
        "Convert 3 hours 20 minutes 15 seconds to seconds.",
        "A car drives 60 miles in 2 hours and 30 miles in 1 hour. How many miles per hour is that?",
    ]
    changed = [
        "A train travels 450 km in 7 hours. How many km in 9 hours?",
        "Convert 8 hours 41 minutes 37 seconds to seconds.",
        "A car drives 75 miles in 4 hours and 20 miles in 6 hours. How many miles per hour is that?".replace("6 hours", "6 hour"),
    ]
    docs = ["so. " * (k + 1) + text + " and then more text follows" for text in changed for k in range(5)]
    assert leaked(spark, docs, items) == {(5 * i + k, i): True for i in range(3) for k in range(5)}
    # numbers alone say nothing
    table = "11 22 33 44 55 66 77 88 99 10 21 32 apples"
    assert leaked(spark, ["1 2 3 4 5 6 7 8 9 10 11 12 apples"], [table]) == {}


def test_values_may_meet_and_one_slip_costs_its_windows(spark):
    item = "Tom puts 7 apples and 5 pears into the basket, then eats 7 apples and gives 5 pears away before lunch. How many are left?"
    met = item.replace("7", "6").replace("5", "6")
    slip = item.replace("eats 7", "eats 8")
    assert leaked(spark, [met, slip], [item]) == {(0, 0): True, (1, 0): False}


def test_short_items_need_all_their_words(spark):
    items = ["What is 12 + 35?", "Explain", "one two three four five six seven eight nine ten"]
    docs = [f"{'x ' * k}{text}" for k in range(4) for text in ("what is this", "tell me what is 4 + 5 now", "six seven eight nine ten one two", "so explain it")]
    want = {(4 * k + 1, 0): True for k in range(4)} | {(4 * k + 3, 1): False for k in range(4)}
    assert leaked(spark, docs, items) == want


def test_every_planted_passage_is_found(spark):
    folder = "/root/testdata/sf0.01"
    docs, benchmark = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    normal = {r["item_id"]: re.findall(r"\w+", r["text"].lower()) for r in benchmark.collect()}
    windows = defaultdict(set)
    for item, words in normal.items():
        for i in range(len(words) - 7):
            windows[tuple(words[i : i + 8])].add(item)
    want = set()
    for r in docs.collect():
        words = re.findall(r"\w+", r["text"].lower())
        hits = Counter(item for i in range(len(words) - 7) for item in windows.get(tuple(words[i : i + 8]), ()))
        want |= {(r["doc_id"], item) for item, n in hits.items() if n >= 0.6 * (len(normal[item]) - 7)}
    got = {(r["doc_id"], r["item_id"]) for r in find_leaks(docs, benchmark).collect()}
    assert want and got == want


# ------------------------------------------------------------------------ HTML


@pytest.mark.parametrize(
    "source,text",
    [
        ("<p>one<br>two <b>bold</b>,x<p>para", "one\ntwo bold,x\n\npara"),
        ("<ul><li>a<li>b<ol start=3><li>n1</li><li>n2</ol><li>c</ul>", "- a\n- b\n  3. n1\n  4. n2\n- c"),
        ("<table><tr><th>Name<th>Qty<tr><td>apple<td>3<tr><td>pear tree<td>12</table>", "Name       Qty\napple      3\npear tree  12"),
        ("<table><tr><td colspan=2>wide<td>z<tr><td>a<td>b<td>c</table>", "wide     z\na     b  c"),
        ("<style>.ad, #x{display:none}</style><div class='b ad'>no</div><i id=x>no</i><div hidden>no</div>yes", "yes"),
        ("<p style='Display: none'>no<p>yes<script>var t='</p>'</script>!", "yes!"),
        ("a<!-- b --> &amp;&nbsp;c &lt;d&gt; <", "a & c <d> <"),
        ("<pre> x\n   y</pre>z", " x\n   y\n\nz"),
        ("<a title='x>y'>link</a><img alt=no>", "link"),
        ("</div></p>stray<td>cell", "straycell"),
        ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
        ("<blockquote>q<p>r</blockquote>s", "  q\n\n  r\n\ns"),
        ("", ""),
        ("<a href=\"", ""),
    ],
)
def test_layout(source, text):
    assert visible_text(source) == text


@pytest.mark.parametrize(
    "source,text",
    [
        ("<html><head><title>T</title><body><p>text", "text"),
        ("<html><head><title>T</title><meta name=a><p>text<p>more", "text\n\nmore"),
        ("<head><link rel=x><div>text</div>", "text"),
        ("<head><title>T</title> bare text", "bare text"),
        ("<head><template><div>no</div></template></head><body>yes", "yes"),
        ("<head><style>p{}</style><script>no</script></head><body>yes", "yes"),
        ("<table><tbody><td>a<td>b<tr><td>c<td>d</table>", "a  b\nc  d"),
        ("<table><td>a<td>b<tbody><tr><td>c<td>d</table>", "a  b\nc  d"),
        ("<table><colgroup><col><col><tr><td>a<td>b</table>", "a  b"),
        ("<table><caption>cap<td>a</table>", "cap\n\na"),
        ("<table><tbody>loose<div>block</div><tr><td>a</tbody></table>", "loose\nblock\n\na"),
    ],
)
def test_implied_tags(source, text):
    assert visible_text(source) == text


@pytest.mark.parametrize(
    "sheet,shown",
    [
        ("@media print{.x{display:none}}", True),
        ("@media (max-width:600px){.x{display:none}.y{color:red}}", True),
        ("@media screen and (max-width:600px){ .x { display: none } }", True),
        ("@media screen{.x{display:none}}", False),
        ("@media print, all { .x{display:none} }", False),
        ("@supports (display:grid){@media all{.x{display:none}}} .y{display:none}", True),
        ("@keyframes a{from{visibility:hidden}to{visibility:visible}} .x{color:red}", True),
        ("@charset 'a'; @font-face{font-family:'}'} .x{display:none}", False),
        (".x{display:none}.x{display:block}", True),
        (".x{display:block}.x{color:red;display:none}", False),
        (".x{display:none!important}.x{display:block}", False),
        ("#i{display:block}.x{display:none}", True),
        (".x{display:none}", False),
        (".x{display:none;.x{display:block}}", False),
        (".a{.x{display:none}}", True),
        (".x{display:none", False),
    ],
)
def test_style_sheets(sheet, shown):
    assert visible_text(f"<style>{sheet}</style><div class=x id=i>text</div>") == "text" * shown


def test_style_attributes():
    assert visible_text("<style media=print>.x{display:none}</style><p class=x>a") == "a"
    assert visible_text("<style>.x{display:none}</style><style>.x{display:block}</style><p class=x>a") == "a"
    assert visible_text("<style>.x{display:none}</style><p class=x style='display:block'>a<p style='display:none;display:block'>b") == "a\n\nb"
    assert visible_text("<style>DIV{display:none}</style><div>a</div>b") == "b"


def test_extract_html(spark):
    rows = [(1, "<p>a", "x"), (1, "<p>a", "x"), (None, None, None), (2, "<b>" + "word " * 50000, "t")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in extract_html(df).collect()), key=str)
    assert got == sorted([(1, "a", 1), (1, "a", 1), (None, "", 0), (2, ("word " * 50000).strip(), 249999)], key=str)
    assert extract_html(df.filter("false")).count() == 0
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in pages.select("html").collect():
        shown = visible_text(r["html"])
        paragraphs = re.findall(r"<p>([^<]+)</p>", r["html"])
        flat = " ".join(shown.split())
        assert all(" ".join(p.replace("&amp;", "&").split()) in flat for p in paragraphs) and "track(" not in shown


# -------------------------------------------------------------------- pipeline


def test_pipeline(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        after = {r["doc_id"]: r["text"] for r in out.collect()}
        assert after.items() <= before.items()
        docs, before = spark.createDataFrame(out.collect(), out.schema), after
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r["doc_id"] for r in last.collect()} == set(before)
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()} == set(before)


def test_texts_come_in_small_batches(spark):
    """Exact dedup and the others read few long texts at a time; a smaller setting of the session stays."""
    names = ["spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch"]
    before = [spark.conf.get(name) for name in names]
    docs = spark.createDataFrame([(1, "a b"), (2, "a  b")], "doc_id long, text string")
    try:
        spark.conf.set(names[0], "4096")
        assert [r["doc_id"] for r in drop_copies(docs).collect()] == [1]
        assert spark.conf.get(names[0]) == "512"
        for name in names:
            spark.conf.set(name, "7")
        small_batches(spark)
        assert [spark.conf.get(name) for name in names] == ["7", "7"]
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)


def test_pipeline_tasks_forget_words():
    """What a task of the pipeline has cached of words is gone when it ends; op 2's tasks hand it on."""
    key = np.array([toxicity.events_of("bad")[-1]], dtype=np.uint64)
    one = np.array([5])
    scorer = toxicity.Scorer(toxicity.Model(key, np.zeros(1, dtype=np.uint64), one, 0 * one, 5, 5, 2.0), np.array([0.0, 1.0, 0.0]))
    texts = [pd.Series(["a bad word", "good"])]
    kept = list(toxicity._scored(scorer, iter(texts), False))
    assert set(scorer.cache) == {"a", "bad", "word", "good"}
    forgotten = list(toxicity._scored(scorer, iter(texts), True))
    assert not scorer.cache and kept[0].tolist() == forgotten[0].tolist() and kept[0][0] > kept[0][1]


def test_known_words_are_not_looked_up_again(monkeypatch):
    """Scores are those of words looked up one by one, also when the cache starts anew; known words cost no lookup."""
    words = ["good", "bad", "naïve", "prefixes", "prefix", "pre"]
    hashes = np.array([toxicity._hash(w) for w in words], dtype=np.uint64)
    counts = np.array([3.0, 30, 9, 8, 20, 5])
    pair = toxicity.pair_keys(hashes[:2])
    keys, before = np.concatenate([hashes, pair]), np.array([0] * 6 + [hashes[0]], dtype=np.uint64)
    model = toxicity.Model(keys, before, np.append(counts, 9), np.append(counts[::-1], 3), 40, 40, 2.0)
    calls = []
    look_up = toxicity.Model.words
    monkeypatch.setattr(toxicity.Model, "words", lambda self, new: calls.append(list(new)) or look_up(self, new))
    texts = ["good bad naïve", "bad good bad", "", "prefixes pre bad unseen", "pre prefix good"]
    scorer = toxicity.Scorer(model, np.array([0.1, 1.0, 0.5]))
    scores = scorer.scores(texts).tolist()
    assert calls == [["good", "bad", "naïve"], ["prefixes", "pre", "unseen"], ["prefix"]]
    assert scores == [toxicity.Scorer(model, scorer.weights).scores([t])[0] for t in texts]
    monkeypatch.setattr(toxicity, "_CACHE", 1)
    assert scorer.scores(texts).tolist() == scores
    assert toxicity.events_of("prefixes") == [toxicity._hash(f"{n} {'prefixes'[:n]}") for n in (3, 4, 5, 6, 7)] + [toxicity._hash("prefixes")]
