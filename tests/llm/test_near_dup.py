"""Near duplicates against a brute-force version, and the sketch's own laws."""

import random
import re

import numpy as np
import pytest

from casegrid.llm import near_dup as N


def shingles(text, k):
    w = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_force(rows, k):
    """{doc_id: (set size, smallest linked id)} for rows of distinct ids."""
    sets = {i: shingles(t, k) for i, t in rows}
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and comp[a] > comp[b]:
                    n = len(sets[a] & sets[b])
                    if 100 * n >= 80 * len(sets[a] | sets[b]):
                        comp[a], changed = comp[b], True
    return {i: (len(sets[i]), comp[i]) for i in sets}


def corpus(seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(25):                                     # unrelated texts
        rows.append(" ".join(rng.choices(vocabulary, k=rng.randint(1, 80))))
    base = rng.choices(vocabulary, k=60)
    for _ in range(60):                                     # near copies of all degrees, some linked by others only
        t = list(base)
        for _ in range(rng.randint(0, 9)):
            t[rng.randrange(len(t))] = rng.choice(vocabulary)
        rows.append(" ".join(t))
    rows += [rows[30]] * 6 + [rows[30].upper(), "  " + rows[31].replace(" ", "\t ")]
    rows += ["", None, "one", "one", "One", "two words", " \n "]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("width", [2, 5])
def test_matches_brute_force(make_docs, width):
    rows = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(make_docs(rows, extra=True), width).collect()}
    assert got == brute_force(rows, width)


def test_blocks_lose_nothing(make_docs, monkeypatch):
    """Buckets cut into many small blocks give the same components."""
    monkeypatch.setattr(N, "BLOCK_ROWS", 4)
    monkeypatch.setattr(N, "PAIRS", 16)
    rows = corpus(9)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(make_docs(rows), 2).collect()}
    assert got == brute_force(rows, 2)


def test_repeated_rows_nulls_and_empty_table(make_docs):
    text = "a b c d e f g h"
    out = N.near_duplicates(make_docs([(3, text), (3, text), (None, text), (7, None), (7, "")]), 2).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.component_id, r.kept) for r in out) == [
        (-1, 3, False), (3, 3, True), (3, 3, True), (7, 7, True), (7, 7, True)]
    assert N.near_duplicates(make_docs([]), 2).count() == 0


def test_registers_merge_by_maximum():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (500, 40))
    both = np.concatenate((a, b))
    ra, rb, rab = (N.registers(x, np.array([len(x)]))[0] for x in (a, b, both))
    assert (np.maximum(ra, rb) == rab).all()


def test_likelihood_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(2)
    kept = []
    for trial in range(40):
        common = rng.integers(0, 2**63, 400).astype(np.uint64)
        a, b = (np.concatenate((common, rng.integers(0, 2**63, 50).astype(np.uint64))) for _ in range(2))    # similarity 0.8
        x, y = N.registers(np.concatenate((a, b)), np.array([len(a), len(b)])).astype(int)
        kept.append(bool(N.may_reach(len(a), len(b), (x > y).sum(), (x < y).sum(), 0.8)))
    assert all(kept)
    assert not N.may_reach(450, 450, 100, 100, 0.8)


def test_bands_find_every_pair_at_the_threshold():
    """Estimated chance that a pair of similarity 0.8 shares no band, from the register law."""
    p = 1 - 2 * float(N._p(np.array(0.1)))
    assert (1 - p**N.ROWS) ** N.BANDS < 1e-6


def test_components_of_a_chain(spark):
    links = [(bytes([i]), bytes([i + 1])) for i in range(40)] + [(b"\x80", b"\x81")]
    roots = {bytes(r["class"]): bytes(r["root"]) for r in N.components(spark.createDataFrame(links, "a binary, b binary")).collect()}
    assert set(roots.values()) == {b"\x00", b"\x80"} and len(roots) == 43
