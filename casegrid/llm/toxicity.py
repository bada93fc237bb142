"""Toxicity scores from a factorization machine over hashed terms.

Terms of a text: its words in lower case and their beginnings of 3 to 7 letters, each
with the levels of ``LEVELS`` that its count in the text reaches, hashed to
``2**HASH_BITS`` numbers. The model adds a bias, a weight per term and, for each pair
of terms in a text, the inner product of their factor vectors, so two terms that are
mild alone can be toxic together.

Fitting: at most ``max_rows`` labelled rows (those with the least hash of their id) are
the training sample; equal texts of one label count once, all others stay. Spark counts in
how many texts of either label each term stands; the ``max_terms`` terms that part the
labels best, by a two-proportion z score, are kept (terms below ``MIN_TEXTS`` texts or
``MIN_Z`` never are); the machine is fitted to the sample's kept terms by gradient descent on
the driver, whose input is bounded by ``max_rows`` times ``max_terms``. Scoring hashes the
words of about a megabyte of text at a time, in arrays.

Edge cases: a null label is no label. Null texts count as empty; an empty text has no
terms and gets the bias. With no labelled rows, or labels all alike, every text gets
the smoothed share of label 1, (n1 + 0.5) / (n + 2). Repeated rows are scored alike. A text of
any length is one step of a worker. Extra columns stay, but one named ``held_out``, ``score``
or ``predicted`` gives way to the result's.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from casegrid.llm.common import chunks, mix, powers, written

HASH_BITS = 20
LEVELS = (1, 2, 3, 4, 6)
STEMS = range(3, 8)
#: Bounds of the fit: labelled rows that are learned from, terms that the model has.
MAX_ROWS, MAX_TERMS = 20_000, 2048
MIN_TEXTS, MIN_Z = 4, 4.0
FACTORS, STEPS, RATE, L2 = 8, 400, 0.05, 2e-4

_WHOLE_WORD = np.uint64(1 << 40)


@cache
def _word_characters() -> np.ndarray:
    """Whether each code point is a letter, a digit or an underscore."""
    return np.fromiter((chr(i).isalnum() or i == 95 for i in range(0x110000)), bool, 0x110000)


def _slots(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) of every word of the texts and of its beginnings: a slot is a hash of ``HASH_BITS`` bits."""
    lower = [t.lower() for t in texts]
    code = np.frombuffer("\n".join([*lower, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in lower])
    word = _word_characters()[code]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if word[0]:
        edge = np.concatenate(([0], edge))
    begin, end = edge[0::2], edge[1::2]              # the closing newline ends the last word
    up, down = powers(len(code) + 1)
    total = np.zeros(len(code) + 1, np.uint64)
    np.cumsum((code.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    text = np.searchsorted(ends, begin, "right")
    found = [(text, mix((total[end] - total[begin]) * down[begin] + _WHOLE_WORD))]
    for k in STEMS:
        longer = np.flatnonzero(end - begin > k)
        b = begin[longer]
        found.append((text[longer], mix((total[b + k] - total[b]) * down[b] + np.uint64(k))))
    return np.concatenate([t for t, _ in found]), (np.concatenate([h for _, h in found]) >> np.uint64(64 - HASH_BITS)).astype(np.int64)


class Terms:
    """Terms of texts: a slot and one of the levels that its count in the text reaches, as one number.
    With ``kept`` (sorted terms) only those, by their place in it."""

    def __init__(self, kept: np.ndarray | None = None):
        self.kept = kept
        if kept is not None:
            self.useful = np.zeros(1 << HASH_BITS, bool)
            self.useful[kept // len(LEVELS)] = True

    def of(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(text number, term) of all terms, in order of both, each once."""
        texts = [t or "" for t in texts]
        rows, terms = [], []
        for i, j in chunks(texts):
            row, slot = _slots(texts[i:j])
            if self.kept is not None:
                few = self.useful[slot]
                row, slot = row[few], slot[few]
            key, n = np.unique(row << HASH_BITS | slot, return_counts=True)
            for level, least in enumerate(LEVELS):
                reached = key[n >= least]
                term = (reached & (1 << HASH_BITS) - 1) * len(LEVELS) + level
                row = (reached >> HASH_BITS) + i
                if self.kept is not None:
                    place = np.minimum(np.searchsorted(self.kept, term), len(self.kept) - 1)
                    there = self.kept[place] == term if len(self.kept) else np.zeros(len(term), bool)
                    row, term = row[there], place[there]
                rows.append(row)
                terms.append(term)
        row, term = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (rows, terms))
        order = np.lexsort((term, row))
        return row[order], term[order]


@dataclass
class Model:
    kept: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def score(self, texts: Sequence[str | None]) -> np.ndarray:
        row, term = Terms(self.kept).of(texts)
        return sigmoid(margins(len(texts), row, term, self.bias, self.weight, self.factor))

    def column(self, text: str = "text") -> Column:
        @F.pandas_udf(DoubleType())
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                yield pd.Series(self.score(s.tolist()))

        return score(F.col(text))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def margins(n: int, row: np.ndarray, term: np.ndarray, bias: float, weight: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Bias + weights + half of (square of the factor sum - sum of factor squares), per row of (row, term) pairs."""
    v = factor[term]
    total = np.stack([np.bincount(row, v[:, f], n) for f in range(factor.shape[1])], 1)
    return bias + np.bincount(row, weight[term], n) + 0.5 * ((total**2).sum(1) - np.bincount(row, (v**2).sum(1), n))


def margin(rows: list[list[int]], bias: float, weight: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """``margins`` of lists of terms."""
    return margins(len(rows), *_pairs(rows), bias, weight, factor)


def _pairs(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(r) for r in rows], np.int64)
    return np.repeat(np.arange(len(rows)), size), np.fromiter((t for r in rows for t in r), np.int64, int(size.sum()))


def loss(theta: list[np.ndarray], row: np.ndarray, term: np.ndarray, label: np.ndarray) -> float:
    """Mean logistic loss plus half of ``L2`` times the squared weights and factors."""
    z = margins(len(label), row, term, theta[0][0], theta[1], theta[2])
    return float(np.mean(np.logaddexp(0, z) - label * z) + 0.5 * L2 * ((theta[1]**2).sum() + (theta[2]**2).sum()))


def gradient(theta: list[np.ndarray], row: np.ndarray, term: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
    """Of ``loss``, by bias, weights and factors."""
    b, w, v = theta
    n, n_terms, n_factors = len(label), *v.shape
    vt = v[term]
    total = np.stack([np.bincount(row, vt[:, f], n) for f in range(n_factors)], 1)
    z = b[0] + np.bincount(row, w[term], n) + 0.5 * ((total**2).sum(1) - np.bincount(row, (vt**2).sum(1), n))
    e = (sigmoid(z) - label) / n
    er = e[row]
    gv = np.stack([np.bincount(term, er * (total[row, f] - vt[:, f]), n_terms) for f in range(n_factors)], 1)
    return [np.array([e.sum()]), np.bincount(term, er, n_terms) + L2 * w, gv + L2 * v]


def fit(rows: list[list[int]], label: np.ndarray, n_terms: int, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray]:
    """Adam on the mean logistic loss of the factorization machine, L2 on all but the bias."""
    rng = np.random.default_rng(seed)
    n = len(rows)
    row, term = _pairs(rows)
    theta = [np.array([np.log((label.sum() + 0.5) / (n - label.sum() + 0.5))]), np.zeros(n_terms), rng.normal(0, 0.05, (n_terms, FACTORS))]
    m, s = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for step in range(1, STEPS + 1):
        for i, g in enumerate(gradient(theta, row, term, label)):
            m[i] = 0.9 * m[i] + 0.1 * g
            s[i] = 0.999 * s[i] + 0.001 * g * g
            theta[i] = theta[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.999**step)) + 1e-8)
    return float(theta[0][0]), theta[1], theta[2]


def sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(text, label) of the training sample; a text that several rows have with one label counts once."""
    ids = (labels.where("toxic is not null and doc_id is not null")
           .where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
           .groupBy("doc_id").agg(F.max("toxic").alias("label"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return rows.select(F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("long").alias("label")).dropDuplicates(["text", "label"])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_terms: int = MAX_TERMS) -> Model:
    """A model from the rows of ``labels`` (doc_id, toxic) outside the held-out fold
    (crc32 of the id's text, modulo 5, is 0)."""
    rows = written(sample(docs, labels, max_rows), "toxic-sample")
    n_terms = len(LEVELS) << HASH_BITS

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(2 * n_terms, np.int32)
        for pdf in batches:
            row, term = Terms().of(pdf["text"].tolist())
            np.add.at(n, pdf["label"].to_numpy(np.int64)[row] * n_terms + term, 1)
        t = np.flatnonzero(n[:n_terms] + n[n_terms:])
        yield pd.DataFrame({"term": t, "n0": n[t].astype(np.int64), "n1": n[n_terms + t].astype(np.int64)})

    size = {int(r["label"]): r["count"] for r in rows.groupBy("label").count().collect()}
    n0, n1 = size.get(0, 0), size.get(1, 0)
    if not n0 or not n1:
        p = (n1 + 0.5) / (n0 + n1 + 2)
        return Model(np.zeros(0, np.int64), float(np.log(p / (1 - p))), np.zeros(0), np.zeros((0, FACTORS)))
    p0, p1, p = F.col("n0") / n0, F.col("n1") / n1, (F.col("n0") + F.col("n1")) / (n0 + n1)
    z = F.abs(p1 - p0) / F.sqrt(p * (1 - p) * (1 / n0 + 1 / n1))
    best = (rows.mapInPandas(count, "term long, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
            .where((F.col("n0") + F.col("n1") >= MIN_TEXTS) & (F.col("n0") + F.col("n1") < n0 + n1))
            .withColumn("z", z).where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "term").limit(max_terms))
    kept = np.array(sorted(r["term"] for r in best.select("term").collect()), np.int64)

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            row, term = Terms(kept).of(pdf["text"].tolist())
            cuts = np.searchsorted(row, np.arange(1, len(pdf)))
            yield pd.DataFrame({"label": pdf["label"], "terms": np.split(term, cuts)})

    found = rows.mapInPandas(keep, "label long, terms array<int>").toPandas()      # at most max_rows rows
    # A fixed order of rows: sums of floats then don't depend on how tasks end.
    found = found.assign(key=[tuple(t) for t in found["terms"]]).sort_values(["label", "key"], kind="stable")
    bias, weight, factor = fit([list(map(int, t)) for t in found["terms"]], found["label"].to_numpy(float), len(kept))
    return Model(kept, bias, weight, factor)


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_terms: int = MAX_TERMS) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` (0 to 1) and ``predicted`` (score >= 0.5)."""
    model = train(docs, labels, max_rows, max_terms)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    scored = docs.withColumns({"held_out": F.coalesce(held, F.lit(False)), "score": model.column()})
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
