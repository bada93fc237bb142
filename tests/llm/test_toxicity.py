"""Toxicity: held-out accuracy, learned interactions, edge cases."""

import random
import re
import zlib

import numpy as np
import pytest

from casegrid.llm import toxicity as T

FILLER = [f"fill{i}" for i in range(300)]


def make_rows(n=900, seed=4):
    """Rows that are toxic when an insult and a group mention stand together, or a slur alone."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(FILLER, k=rng.randint(10, 40))
        insult, group, slur = rng.random() < 0.4, rng.random() < 0.4, rng.random() < 0.1
        words += ["awful"] * insult + ["folk"] * group + ["slurword"] * slur
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int((insult and group) or slur)))
    return rows, labels


@pytest.fixture()
def labelled(spark, make_docs):
    rows, labels = make_rows()
    return make_docs(rows, extra=True).drop("score"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_held_out_accuracy_and_fold(labelled):
    docs, labels, truth = labelled
    out = T.toxicity(docs, labels).select("doc_id", "held_out", "score", "predicted").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)


def test_pairs_are_learned(labelled):
    docs, labels, _ = labelled
    both, one, other = T.train(docs, labels).score(["fill1 awful folk fill2", "fill1 awful fill2", "fill1 folk fill2"])
    assert both > 0.8 and one < 0.4 and other < 0.4


def test_held_out_labels_are_not_used(spark, labelled):
    docs, labels, truth = labelled
    flipped = spark.createDataFrame([(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in truth.items()], "doc_id long, toxic int")
    a, b = T.train(docs, labels), T.train(docs, flipped)
    assert (a.kept == b.kept).all() and np.allclose(a.weight, b.weight)


def test_gradient_matches_finite_differences():
    rows, label = [[0, 1], [1, 2], [0, 2], []], np.array([1.0, 0, 1, 0])
    b, w, v = T.fit(rows, label, 3)
    p = T.sigmoid(T.margin(rows, b, w, v))
    assert p[0] > 0.5 and p[1] < 0.5


def test_without_labels(spark, make_docs):
    docs = make_docs([(1, "a b"), (2, None), (3, ""), (None, "x"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = T.toxicity(docs, none).collect()
    assert [r.predicted for r in out] == [0] * 5 and {r.score for r in out} == {0.25}
    assert T.toxicity(make_docs([]), none).count() == 0
    alike = spark.createDataFrame([(2, 1), (2, 1), (4, None)], "doc_id long, toxic int")
    assert all(0 <= r.score <= 1 for r in T.toxicity(docs, alike).collect())


def _brute_margin(terms, bias, weight, factor):
    out = bias + sum(weight[i] for i in terms)
    for a in range(len(terms)):
        for b in range(a):
            out += sum(factor[terms[a]][f] * factor[terms[b]][f] for f in range(len(factor[0])))
    return out


def test_margin_equals_a_double_loop():
    rng = np.random.default_rng(1)
    weight, factor = rng.normal(size=30), rng.normal(size=(30, 8))
    rows = [sorted(rng.choice(30, k, replace=False).tolist()) for k in (0, 1, 2, 7, 30, 0)]
    assert np.allclose(T.margin(rows, 0.3, weight, factor), [_brute_margin(r, 0.3, weight, factor) for r in rows])


def test_gradient_equals_differences_of_the_loss():
    rng = np.random.default_rng(2)
    rows = [rng.choice(6, k, replace=False).tolist() for k in (3, 1, 0, 4, 6)]
    row, term = T._pairs(rows)
    label = np.array([1.0, 0, 1, 0, 1])
    theta = [rng.normal(size=1), rng.normal(size=6), rng.normal(size=(6, 3))]
    for i, g in enumerate(T.gradient(theta, row, term, label)):
        for at in np.ndindex(g.shape):
            moved = []
            for h in (1e-5, -1e-5):
                other = [t.copy() for t in theta]
                other[i][at] += h
                moved.append(T.loss(other, row, term, label))
            assert abs((moved[0] - moved[1]) / 2e-5 - g[at]) < 1e-7


def _plain_terms(text):
    """Levels of every stem of a text, by plain counting."""
    counts = {}
    for word in re.findall(r"\w+", (text or "").lower()):
        for stem in [("=", word), *((k, word[:k]) for k in T.STEMS if len(word) > k)]:
            counts[stem] = counts.get(stem, 0) + 1
    return sum(sum(n >= k for k in T.LEVELS) for n in counts.values())


def test_terms_of_texts():
    texts = [None, "", "One one ONE two", "naïve Äpfel_3 日本語のテキスト", "x" * 50, "a-b a_b", "word " * 90_000, "é" * 3, "\n\t"]
    row, term = T.Terms().of(texts)
    assert np.bincount(row, minlength=len(texts)).tolist() == [_plain_terms(t) for t in texts]
    alone = [T.Terms().of([t])[1].tolist() for t in texts]
    assert [term[row == i].tolist() for i in range(len(texts))] == alone          # neighbours don't matter
    assert T.Terms().of(["ONE two one, one"])[1].tolist() == alone[2]
    kept = np.unique(term)[::3]
    row_k, place = T.Terms(kept).of(texts)
    want = [(r, t) for r, t in zip(row, term, strict=True) if t in set(kept.tolist())]
    assert list(zip(row_k, kept[place], strict=True)) == want


def test_sample_keeps_different_texts(spark, make_docs):
    """Texts that share a long first line all stay; equal ones of one label count once."""
    rows = [(i, "the same first line of every text\n" + f"w{i} " * 5) for i in range(200)] + [(1000 + i, "copy") for i in range(50)]
    labels = spark.createDataFrame([(i, int(i % 2)) for i, _ in rows], "doc_id long, toxic int")
    learned = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5]
    got = T.sample(make_docs(rows), labels, 20_000).collect()
    assert len(got) == sum(i < 1000 for i in learned) + 2
    assert len(T.sample(make_docs(rows), labels, 30).collect()) <= 30


def test_clashing_columns_give_way(labelled):
    from pyspark.sql import functions as F
    docs, labels, _ = labelled
    clash = docs.withColumns({"score": F.lit("x"), "predicted": F.lit("y"), "held_out": F.lit(3)})
    a = T.toxicity(docs, labels).select("doc_id", "score", "predicted").collect()
    b = T.toxicity(clash, labels)
    assert len(b.columns) == len(set(b.columns))
    assert sorted(a) == sorted(b.select("doc_id", "score", "predicted").collect())
