"""Substring dedup against a dictionary of windows."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnish.llm import substrings
from tarnish.llm.substrings import EDGE, LOCAL, block_edges, drop_repeats, judged, repeated_pieces, repeated_spans, rolled, words_of


def brute(rows):
    """Of ``id, text``: the words of each row and which of them go."""
    docs = sorted({(r[0] is None, r[0] or 0, r[1] or "") for r in rows}, key=lambda d: d[:2])
    seen, gone = {}, {}
    for d in docs:
        words = words_of(d[2])
        marks = [False] * len(words)
        for i in range(len(words) - EDGE + 1):
            window = tuple(words[i : i + EDGE])
            if seen.setdefault(window, (d, i)) != (d, i):
                marks[i : i + EDGE] = [True] * EDGE
        gone[d] = words, marks
    return {(r[0], r[1]): gone[(r[0] is None, r[0] or 0, r[1] or "")] for r in rows}


def expected(rows):
    out, known = [], brute(rows)
    for r in rows:
        words, marks = known[r[0], r[1]]
        kept = b" ".join(w for w, m in zip(words, marks) if not m)
        out.append((r[0], len(words), sum(marks), hashlib.sha256(kept).hexdigest()))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, str(v)) for v in r))


def same(df):
    got = [tuple(r)[:4] for r in repeated_spans(df).collect()]
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    assert ordered(got) == ordered(expected(rows))
    return got


@pytest.mark.parametrize("n", [1, 2, 3, 6, 15, 20])
def test_rolled(n):
    words = np.random.default_rng(n).integers(0, 2**63, 50).astype(np.uint64)
    again = rolled(np.concatenate([words[7:30], words]), n)
    assert (rolled(words, n)[7 : 31 - n] == again[: 24 - n]).all() and len(again) == 74 - n
    assert len(set(rolled(words, n).tolist())) == 51 - n


@pytest.mark.parametrize("seed", range(25))
def test_graph(seed):
    """Blocks of documents with few words, so that paths branch and texts have periods."""
    rng = random.Random(seed)
    parts = [[rng.randint(0, 3 if seed % 3 else 1000) for _ in range(rng.randint(5, 60))] for _ in range(6)]
    docs = []
    for i in range(30):
        words = [w for _ in range(rng.randint(0, 5)) for w in rng.choice(parts)] if i % 4 else rng.choice(parts) * rng.randint(1, 4)
        docs.append((rng.choice([i, i, 3]), i, np.array(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    shuffled, blocks = docs[:], []
    rng.shuffle(shuffled)
    while shuffled:
        n = rng.randint(1, 9)
        blocks, shuffled = [*blocks, block_edges(shuffled[:n])], shuffled[n:]
    sent = pa.Table.from_batches([b for b in blocks if b is not None])
    spans, pieces, places = [], {}, []
    for r in sent.filter(sent["s_doc"].is_valid()).to_pylist():
        spans.append((r["doc"], r["tie"], r["pos"], r["len"]))
    rest = sent.filter(sent["s_doc"].is_null())
    for bucket in range(3):
        mine = rest.filter(pa.array(rest["route"].to_numpy().view(np.uint64) % 3 == bucket))
        if mine.num_rows:
            found = repeated_pieces(mine)
            for kind, *here, n, s_doc, s_tie, s_pos, who in zip(*[c.tolist() for c in found.values()]):
                assert kind != LOCAL
                if kind == substrings.PIECE:
                    pieces[tuple(here)] = n, who
                else:
                    places.append((*here, (s_doc, s_tie, s_pos)))
    linked = {(d, t, p + n) for (d, t, p), (n, who) in pieces.items() if pieces.get((d, t, p + n), (0, None))[1] == who}
    for *here, source in places:
        if source not in linked:
            d, t, p = source
            total = pieces[source][0]
            while (d, t, p + total) in linked:
                total += pieces[d, t, p + total][0]
            spans.append((*here, total))
    got = {(d, t): set() for d, t, _ in docs}
    for d, t, p, n in spans:
        got[d, t] |= set(range(p, p + n + EDGE - 1))
    seen = {}
    for d, t, words in sorted(docs, key=lambda x: x[:2]):
        marks = set()
        for i in range(len(words) - EDGE + 1):
            if seen.setdefault(words[i : i + EDGE].tobytes(), (d, t, i)) != (d, t, i):
                marks |= set(range(i, i + EDGE))
        assert got[d, t] == marks
    assert pieces or seed % 3 == 0


def test_table(small):
    got = same(small)
    assert any(0 < r[2] < r[1] for r in got) and any(r[2] == 0 for r in got)


def test_odd(spark, odd):
    line = " ".join(f"w{i}" for i in range(25))
    rows = [(200 + i, f"{i} {line} {i} \t {line}\n" * (1 + i % 3)) for i in range(40)]
    rows += [(300, "x " * 3000), (301, "a b " * 500), (306, "a b " * 700), (302, " ".join(map(str, range(60000)))), (303, " ".join(map(str, range(30000, 61000))))]
    rows += [(304, line), (304, line), (None, line), (305, " ".join(line.split()[:19])), (-5, line.replace(" ", "\x0b ")), (2**63 - 1, line)]
    df = odd.unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)
    df = df.withColumns({"doc": F.lit("x"), "tie": F.lit(1), "spans": F.lit(None).cast("int"), "pos": F.col("text")})
    same(df)
    assert same(df.filter("false")) == []


def test_kept_texts(small):
    known = brute([tuple(r) for r in small.select("doc_id", "text").collect()])
    out = drop_repeats(small)
    assert out.columns == small.columns
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    for (doc_id, text), (words, marks) in known.items():
        kept = " ".join(w.decode() for w, m in zip(words, marks) if not m) if any(marks) else text
        assert texts[doc_id] == kept


def test_wrong_sources_are_seen(small):
    """Without any verified collision nothing is done again."""
    out, wrong = judged(small, "doc_id", "text", 5)
    assert wrong == 0 and out.filter("size(checks) > 0").count() > 0
