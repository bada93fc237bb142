"""Filter audit against a plain count over every document, order and step."""

import random
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casegrid.llm import filter_audit as A


def fails(rows, i):
    doc_id, text, _ = rows[i]
    text = text or ""
    words, word = [], ""
    for c in text + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    out = set()
    if len(words) < 50:
        out.add("A")
    if 100 * len(set(words)) < 65 * len(words):
        out.add("B")
    if 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text):
        out.add("C")
    if any(c in "#$%&*|" for c in text):
        out.add("D")
    if doc_id is not None and any(o is not None and o < doc_id and (t or "") == text for o, t, _ in rows):
        out.add("E")
    return out


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    failed = [fails(rows, i) for i in range(len(rows))]
    parts = sorted({s or "" for _, _, s in rows})
    out = []
    for part in parts:
        mine = [(r[0], f) for r, f in zip(rows, failed, strict=True) if (r[2] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        lines = []
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                shapley[x] += len(gone)
                lines.append((part, "".join(order), step, len(left), len(gone), sum(x in f for _, f in mine) - len(gone),
                              sum(f == {x} for _, f in mine), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone), x))
        out += [(*line[:-1], shapley[line[-1]]) for line in lines]
    return out


def random_rows(rng, n):
    texts = [None, "", "short one", "a b " * 60, " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(50)) + " $",
             "SHOUT " * 3, " ".join(f"W{i}" for i in range(70)), "é" * 30, "x y " * 51, " ".join(f"v{i}" for i in range(49)) + "\x1fz", "many words " * 4000]
    return [(rng.choice([None, *range(12)]), rng.choice(texts), rng.choice([None, "", "s1", "s2"])) for _ in range(n)]


@pytest.mark.parametrize("seed", [0, 1])
def test_audit_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = random_rows(rng, 90)
    labels = [(rng.choice([None, *range(14)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"n": F.lit(7), "good": F.lit("x"), "failed": F.lit(1)})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit(3))
    found = A.audit(docs.repartition(5), marks)
    assert found.columns == [c.split()[0] for c in A.RESULT.split(", ")]
    assert sorted(map(tuple, found.collect())) == sorted(brute(rows, labels))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "x", "s")], "doc_id long, text string, source string")
    got = A.audit(one, labels).agg(F.count("*"), F.sum("removed"), F.sum("kept"), F.max("shapley")).first()
    assert tuple(got) == (600, 120, 120 * 2, 120)       # A removes it where it stands; steps before it keep it


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**32 - 1), st.integers(0, 1000)), max_size=200))
def test_positional_popcount(pairs):
    words = np.array([w for w, _ in pairs], np.uint32)
    times = np.array([n for _, n in pairs], np.int64)
    assert A.positional_popcount(words).tolist() == [sum(w >> b & 1 for w, _ in pairs) for b in range(32)]
    assert A.weighted_popcount(words, times).tolist() == [sum((w >> b & 1) * n for w, n in pairs) for b in range(32)]


def test_truth_table():
    for failed, word in enumerate(A.truth_table().tolist()):
        assert [word >> s & 1 for s in range(32)] == [int(s & failed == 0) for s in range(32)]
