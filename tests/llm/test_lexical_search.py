"""Lexical search against a score of every document, and the bound of every stratum."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from casegrid.llm import lexical_search as X

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    found = [(i, Counter(split(t))) for i, t in docs if split(t)]
    n_docs, length = len(found), sum(c.total() for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        scored = []
        for i, c in found:
            m = 25 + (75 * c.total() * n_docs) // length
            s = 0
            for t in split(text):
                if c[t]:
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def corpus(rng, n):
    vocabulary = [f"w{i}" for i in range(40)] + ["Äpfel", "naïve", "x1", "日本", "THE"]
    text = lambda: rng.choice([" ", "-", "  ", "_"]).join(rng.choices(vocabulary, [50 / (i + 1) for i in range(45)], k=rng.choice([1, 2, 5, 5, 5, 40, 300])))
    docs = [(rng.choice([None, i, i, i, 3]), text()) for i in range(n)] + [(900, None), (901, ""), (902, "!?"), (903, "w1 " * 60_000)]
    items = [(f"q{i}", text()) for i in range(12)] + [("q1", "w3 w3 w4"), ("none", None), ("empty", ""), ("absent", "zzz"), ("q0", "W1 w1")]
    return docs + rng.choices(docs, k=15), items + items[:2]


@pytest.mark.parametrize("seed", [0, 1])
def test_ranking_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    docs, items = corpus(rng, 250)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": F.lit("x"), "m": F.lit(1), "item": F.lit(2), "score": F.lit(0.5)})
    q = spark.createDataFrame(items, "item_id string, text string").withColumns({"doc_id": F.lit(5), "n": F.lit("y"), "rank": F.lit(1)})
    want = brute(docs, items, 10)
    for blocks in (X.BLOCK_TERMS, 300):          # one block of items, and several
        got = sorted(map(tuple, X.ranked(d.repartition(4), q, block_terms=blocks).collect()), key=str)
        assert got == want
    assert any(r[2] is None for r in want)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([("q", "a")], "item_id string, text string")
    assert X.ranked(docs.where("false"), items).count() == 0
    assert X.ranked(docs, items.where("false")).count() == 0
    assert X.ranked(docs, items.withColumn("text", F.lit(None).cast("string"))).count() == 0


def _strata(spark, docs, vocabulary, piece):
    rows = X.forward(spark.createDataFrame(docs, "doc_id long, text string"), vocabulary)
    n, length, df = X.statistics(rows, len(vocabulary))
    index = X.build_index(rows, n, length, piece=piece)
    return rows, index, n, length, df


def test_index_holds_every_posting_once(spark):
    docs, _ = corpus(random.Random(3), 120)
    docs = [(i, t) for i, (_, t) in enumerate(docs)]
    some = [t for i, t in enumerate(sorted({w for _, t in docs for w in split(t)})) if i % 3]
    vocabulary = {t.encode(): i for i, t in enumerate(some)}
    rows, index, n, length, df = _strata(spark, docs, vocabulary, piece=100)
    got = []
    for r in index.collect():
        assert len(r.at) <= 100 or len(r.doc_ids) == 1
        assert list(zip(r.term, r.tf, strict=True)) == sorted(set(zip(r.term, r.tf, strict=True)))
        for j, (t, f) in enumerate(zip(r.term, r.tf, strict=True)):
            got += [(r.m, r.doc_ids[a], t, f) for a in r.at[(r.upto[j - 1] if j else 0):r.upto[j]]]
    want = []
    for i, text in docs:
        c = Counter(split(text))
        if c:
            m = 25 + (75 * c.total() * n) // length
            want += [(m, i, vocabulary[t.encode()], f) for t, f in c.items() if t.encode() in vocabulary]
    assert sorted(got) == sorted(want)
    assert df.tolist() == [sum(t in split(text) for _, text in docs) for t in some]


def test_bounds_hold_and_skip(spark):
    """No document scores above its stratum's bound, and strata are skipped."""
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choices([f"w{j}" for j in range(30)], k=rng.randint(1, 200)))) for i in range(400)]
    vocabulary = {f"w{j}".encode(): j for j in range(30)}
    _, index, n, _, df = _strata(spark, docs, vocabulary, piece=200)
    weight = np.floor(1000 * np.log((2.0 * n + 2) / (2.0 * df + 1))).astype(np.int64)
    q = X.Queries([np.array([1, 2, 2, 7]), np.array([3]), np.array([29, 5])], weight)
    strata = [X.Stratum(r.m, *(np.array(c) for c in (r.doc_ids, r.term, r.tf, r.upto, r.at))) for r in index.collect()]
    best = X.Best(3, 10)
    for s in strata:
        for i, bound in enumerate(s.bounds(q)):
            one = X.Best(3, 1000)
            s.visit(q, np.array([i]), one)
            assert one.score.max(initial=0) <= bound
    visited = 0
    for s in sorted(strata, key=lambda s: -s.bounds(q).max()):
        items = np.flatnonzero(s.bounds(q) >= best.least)
        visited += len(items)
        if len(items):
            s.visit(q, items, best)
    assert 0 < visited < 3 * len(strata)
