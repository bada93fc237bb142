"""Fingerprints: edits, estimates against true similarity, edge cases."""

import hashlib
import random

import numpy as np

from casegrid.llm import fingerprints as P


def similarity(a, b, k=5):
    sets = []
    for t in (a, b):
        w = t.lower().split()
        sets.append({tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def texts(n, seed=2):
    rng = random.Random(seed)
    return [" ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randint(1, 300))) for _ in range(n)]


def test_estimates_are_unbiased_and_near():
    a = texts(300)
    b = [P.edited(x, y) for x, y in zip(a, a[1:] + a[:1], strict=True)]
    bits, full = P.fingerprints([t.encode() for t in a + b])
    got = P.likeness(bits[:300], bits[300:], full[:300], full[300:])
    error = got - np.array([similarity(x, y) for x, y in zip(a, b, strict=True)])
    assert abs(error.mean()) < 0.01 and np.sqrt((error**2).mean()) < 0.05


def test_empty_bins_are_filled_alike():
    """Texts of few shingles fill every bin; equal sets give equal fingerprints."""
    one, same, other = P.fingerprints([b"a b c d e f", b"A  b\nc d e f", b"a b c d e x"])[0]
    assert (one == same).all() and 0.2 < (one == other).mean() < 0.6


def expected(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        t, nxt = t or "", nxt or ""
        k = len(t) // 3
        out[i] = (len(t), hashlib.sha256((t[:len(t) - k] + nxt[:k]).encode()).hexdigest())
    return out


def test_edits_follow_descending_ids(spark, make_docs):
    rows = list(enumerate(texts(60))) + [(100, None), (101, ""), (102, "é" * 50), (103, "x " * 700_000)]
    random.Random(1).shuffle(rows)
    out = P.fingerprint_edits(make_docs(rows, extra=True)).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in out} == expected(rows) and len(out) == len(rows)
    empty = [r for r in out if r.doc_id in (100, 101)]
    assert [r.fingerprint for r in empty] == ["", ""] and [r.near_edited for r in empty] == [1.0, 1.0]


def test_steps_cut_anywhere(make_docs):
    """Texts of more than a step each are passed on one by one."""
    rows = [(i, t + " x" * 600_000) for i, t in enumerate(texts(4))]
    found = P.fingerprint_edits(make_docs(rows)).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in found} == expected(rows)


def test_one_document_repeats_nulls_and_empty(make_docs):
    (one,) = P.fingerprint_edits(make_docs([(5, "abcdef")])).collect()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one.near_next == 1.0
    out = P.fingerprint_edits(make_docs([(5, "a b"), (5, "a b"), (None, "c d"), (4, None)])).collect()
    assert len(out) == 4 and len({r.fingerprint for r in out if r.doc_id == 5}) == 1
    assert P.fingerprint_edits(make_docs([])).count() == 0
