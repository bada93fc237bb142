"""Decontamination against a brute-force version."""

import hashlib
import random
import re

import pytest

from casegrid.llm import decontaminate as D


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_force(doc, items, window):
    w = words(doc)
    hit, found = set(), set()
    for item_id, text in items:
        v = words(text)
        for s in range(max(1, len(v) - window + 1)) if v else ():
            piece = v[s:s + window]
            for p in range(len(w) - len(piece) + 1):
                if w[p:p + len(piece)] == piece:
                    hit.update(range(p, p + len(piece)))
                    if item_id is not None:
                        found.add(str(item_id))
    ids = sorted(found)
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)


@pytest.fixture()
def tables(spark, make_docs):
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(60)] + ["Éa", "ÉA", "éa", "Σας", "ΣΑΣ", "naïve"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(8, 30)))) for i in range(25)]
    items += [(100, "v1"), (101, "v2 ,, V3"), (102, ""), (103, None), (104, "..."), (None, " ".join(rng.choices(vocabulary, k=12))), (5, items[7][1])]
    docs = []
    for i in range(60):
        text = rng.choices(vocabulary, k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            v = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(v) + 1)
            at = rng.randrange(len(text) + 1)
            text[at:at] = v[a:a + rng.choice([9, 10, 11, 30])]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(w.upper() if w.isascii() and rng.random() < 0.1 else w for w in text)))
    docs += [(200, None), (201, ""), (202, items[3][1]), (202, items[3][1]), (202, "other text"), (None, items[4][1]), (203, "ΑΣ." + " ".join(["x"] * 3000) + " " + items[2][1])]
    return docs, items


def test_matches_brute_force(spark, make_docs, tables):
    docs, items = tables
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r)[:6] for r in D.contamination(make_docs(docs, extra=True), bench).collect()), key=repr)
    assert got == sorted(((i, *brute_force(t, items, 10)) for i, t in docs), key=repr)


def test_shuffled_tokens_give_the_same(spark, make_docs, tables, monkeypatch):
    """Beyond the broadcast bound the scan joins by shuffle."""
    monkeypatch.setattr(D, "BROADCAST_SHINGLES", 0)
    docs, items = tables
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r)[:6] for r in D.contamination(make_docs(docs), bench).collect()), key=repr)
    assert got == sorted(((i, *brute_force(t, items, 10)) for i, t in docs), key=repr)


def test_empty_tables(spark, make_docs, tables):
    docs, items = tables
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contamination(make_docs(docs), none).where("contaminated").count() == 0
    assert D.contamination(make_docs([]), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert D.clean(make_docs(docs), none).count() == len(docs)


def test_clean_keeps_only_clean_rows(spark, make_docs, tables):
    docs, items = tables
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = sorted(((r.doc_id, r.text) for r in D.clean(make_docs(docs), bench).collect()), key=repr)
    assert kept == sorted(((i, t) for i, t in docs if not brute_force(t, items, 10)[4]), key=repr)
