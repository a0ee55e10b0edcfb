"""The Merkle manifest against a plain tree of hashes."""

from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import functions as F

from tarnish.llm import merkle
from tarnish.llm.merkle import merkle_manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def lowered(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def leaf(row, text):
    said = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in said])


def levels(hashes):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    by_leaf = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]))
    trees = {s: (rs := sorted(groups[s], key=by_leaf), levels([leaf(r, r["text"]) for r in rs])) for s in names}
    top, out = levels([trees[s][1][-1][0] for s in names]), []
    for rank, s in enumerate(names):
        rs, own = trees[s]
        for place, r in enumerate(rs):
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            hashed, siblings = leaf(r, lowered(r["text"]) if tampered else r["text"]), []
            for tree, at in ((own, place), (top, rank)):
                for level in tree[:-1]:
                    run, pos = level[at // 16 * 16 :][:16], at % 16
                    siblings += run[:pos] + run[pos + 1 :]
                    hashed, at = digest(*run[:pos], hashed, *run[pos + 1 :]), at // 16
            out.append((r["doc_id"], own[0][place], own[-1][0], top[-1][0], digest(*siblings), hashed, hashed == top[-1][0]))
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((v is not None, str(v)) for v in r))


def same(docs):
    rows = [r.asDict() for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = merkle_manifest(docs).collect()
    assert ordered(got) == ordered(brute(rows))
    return got


def test_tables(small):
    got = same(small)
    assert 0 < sum(not r["verified"] for r in got) < len(got)
    # more sources than one run of subroots holds, among them lone leaves, and slices of few leaves
    many = F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("doc_id") % 61).cast("string")))
    same(small.withColumn("source", many))


def test_slices(small, monkeypatch):
    monkeypatch.setattr(merkle, "SLICE", 32)
    same(small.withColumn("source", F.when(F.col("doc_id") % 4 == 0, F.lit("b")).otherwise("a")))


def test_odd(odd):
    rows = odd.withColumnsRenamed({"digest": "lang", "run": "source", "words": "n_chars"})
    extra = rows.withColumns({"tree": F.lit(1), "place": F.lit("x"), "children": F.lit(None).cast("string"), "id": F.lit(2)})
    same(extra)
    same(rows.withColumn("source", F.lit(None).cast("string")))


def test_few_rows(odd):
    rows = odd.withColumnsRenamed({"digest": "lang", "run": "source", "words": "n_chars"})
    assert same(rows.filter("false")) == []
    alone = same(rows.filter("doc_id = 11"))[0]
    assert alone["proof_sha256"] == digest() and alone["leaf"] == alone["root"] == alone["subroot"]
    two = rows.filter("doc_id in (10, 11)")
    same(two)
    same(two.withColumn("source", F.col("doc_id").cast("string")))
