"""Packing: optimal boundaries against brute force, budgets, edge cases."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np

from casegrid.llm import packing as P


def test_boundaries_are_optimal():
    rng = random.Random(3)
    for _ in range(40):
        lengths = sorted(rng.sample(range(1, 60), rng.randint(1, 8)))
        rows = [rng.randint(1, 20) for _ in lengths]
        k = rng.randint(1, 4)

        def padding(ends, lengths=lengths, rows=rows):
            return sum(n * (min(e for e in ends if e >= x) - x) for x, n in zip(lengths, rows, strict=True))

        best = min(padding((*c, lengths[-1])) for r in range(k) for c in itertools.combinations(lengths[:-1], r))
        ends = P.boundaries(np.array(lengths), np.array(rows), k)
        assert padding(ends) == best and len(ends) <= k


def test_batches(make_docs, monkeypatch):
    monkeypatch.setattr(P, "CHUNK_ROWS", 20)
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 3, 3, 3, 50, 51, 400]))) for i in range(200)] + [(900, None), (901, "long " * 5000), (7, "w w w"), (7, "w w w")]
    out = P.pack(make_docs(rows, extra=True), budget=600, buckets=4).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in rows)
    batches = defaultdict(list)
    for r in out:
        assert r.n_tokens <= r.pad_to
        batches[r.bucket, r.chunk, r.batch].append(r)
    for b in batches.values():
        assert len({r.pad_to for r in b}) == 1 and sorted(r.slot for r in b) == list(range(len(b)))
        assert b[0].pad_to * len(b) <= 600 or len(b) == 1
    assert {r.doc_id: r.n_tokens for r in out}[900] == 1 and {r.doc_id: r.n_tokens for r in out}[901] == 5001


def test_boundaries_of_long_lengths_are_optimal():
    """Against the plain program over every begin of every bucket, lengths far over a thousand included."""
    rng = np.random.default_rng(5)
    for n, k in ((200, 6), (150, 1), (40, 40), (300, 16)):
        lengths = np.sort(rng.choice(50_000, n, replace=False) + 1)
        rows = rng.integers(1, 10**rng.integers(1, 7), n)

        def padding(i, j, lengths=lengths, rows=rows):
            return int((rows[i:j] * (lengths[j - 1] - lengths[i:j])).sum())

        best = [0] + [padding(0, j) for j in range(1, n + 1)]
        for _ in range(k - 1):
            best = [0] + [min(best[i] + padding(i, j) for i in range(j)) for j in range(1, n + 1)]
        ends = P.boundaries(lengths, rows, k)
        at = [0, *(int(np.searchsorted(lengths, e)) + 1 for e in ends)]
        assert len(ends) <= k and ends[-1] == lengths[-1]
        assert sum(padding(i, j) for i, j in zip(at, at[1:], strict=False)) == best[n]


def test_empty(make_docs):
    assert P.pack(make_docs([])).count() == 0
    assert P.pack(make_docs([(1, None)])).count() == 1


def test_lengths_are_the_tokenizers(make_docs):
    from tokenizers import Tokenizer

    from casegrid.llm.common import public_tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizer("byte_bpe_50k.json"))
    rng = random.Random(6)
    texts = ["漢字仮名" * 60, "".join(rng.choices("ABCDEFabcdef0123456789+/", k=900)), "for(i=0;i<n;++i){a[i]=b[i]^c;}" * 20, " two  spaces\n\nand lines ", "", None,
             *("".join(rng.choices("xyz0189{}();", k=rng.randint(1, 400))) for _ in range(60)), *("plain words in a row " * k for k in range(1, 12))]
    want = [1 + len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts]
    out = P.pack(make_docs(list(enumerate(texts))), budget=2000, buckets=4).collect()
    assert {r.doc_id: r.n_ids for r in out} == dict(enumerate(want))
    batches = defaultdict(list)
    for r in out:
        assert r.n_ids <= r.pad_to
        batches[r.bucket, r.chunk, r.batch].append(r)
    assert all(b[0].pad_to * len(b) <= 2000 or len(b) == 1 for b in batches.values())
    assert len({r.pad_to for r in out}) == 4
