"""Ranked lexical search over a length-stratified index.

A document's normaliser m follows from its length, so documents with equal m form a stratum,
and in a stratum the impact of a term depends on its frequency tf alone. The index holds, per
stratum, the postings of every query term grouped by tf; an impact is computed once per tf.
The highest tf of each term bounds what any document of the stratum can score; strata are
visited from the highest bound down, and an item skips every stratum whose bound is below
its k-th best score so far. The result is exact: nothing that could rank is skipped.

Score of a document: the sum of ``w * ((10**9 * tf) div (1000 * tf + 8 * m))`` over the
item's terms, repeats included; ``w = floor(1000 * ln((2N + 2) / (2df + 1)))``;
``m = 25 + (75 * n * N) div L``. N: documents with a term, L: their terms, n: the document's,
df: documents with the term, tf: its occurrences. Terms are runs of ASCII letters, digits and
code points above 127; only A-Z are lower-cased.

Scale: texts are read once per block of the query set (``BLOCK_TERMS`` term occurrences, the
bound of what is broadcast; a query set of usual size is one block) and leave term numbers and
counts. Those are range-partitioned by (m, hash of the id), so a hot stratum is split and
small ones share a task; a stratum's piece has at most ``PIECE`` postings or one document.
Each task keeps its k best per item, and only those rows are shuffled again.

Edge cases: null and empty texts have no term; such documents rank nowhere and count nowhere,
such items have no rows. Equal scores go by ascending doc_id, null ids last. Rows that repeat
an id are documents of their own; items that repeat an id and text are one, with other texts
each its own. Empty tables give no rows. Extra columns are ignored. Texts of any length are
one step of a worker.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casegrid.llm.common import utf8, written

K = 10
#: Term occurrences of the items that are searched for at once.
BLOCK_TERMS = 1 << 20
#: Postings of one row of the index.
PIECE = 1 << 18
#: Products of items and documents, or of items and postings, that are scored in one step.
STEP = 1 << 22
#: Stands for a null doc_id, after all others.
NO_ID = (1 << 63) - 1

# A-Z to a-z; every other ASCII character that is no letter or digit parts terms.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, in order."""
    return text.translate(_TERMS).split()


def forward(docs: DataFrame, vocabulary: dict[bytes, int], name: str = "search-terms") -> DataFrame:
    """(doc_id, n, terms, tfs) of the documents with a term: the numbers and counts of those in ``vocabulary``."""

    @F.pandas_udf("n long, terms array<int>, tfs array<int>")
    def count(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in utf8(texts):
            found = terms(text)
            known = [(vocabulary[t], n) for t, n in Counter(found).items() if t in vocabulary]
            pairs = np.array(known, np.int32).reshape(-1, 2)
            rows.append((len(found), pairs[:, 0], pairs[:, 1]))
        return pd.DataFrame(rows, columns=["n", "terms", "tfs"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), count("text").alias("found"))
    return written(rows.select("doc_id", "found.*").where("n > 0"), name)


def statistics(rows: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """N, L and the number of documents of every vocabulary term."""
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()

    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(n_terms, np.int64)
        for batch in batches:
            n += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=n_terms)
        t = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(n[t])], names=["term", "df"])

    found = rows.select("terms").mapInArrow(holders, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()   # a row per vocabulary term
    df = np.zeros(n_terms, np.int64)
    df[found["term"]] = found["df"]
    return total["n"], total["length"], df


INDEX = "m long, doc_ids array<long>, term array<int>, tf array<int>, upto array<int>, at array<int>"


def build_index(rows: DataFrame, n_docs: int, length: int, piece: int = PIECE, name: str = "search-index") -> DataFrame:
    """The index of ``forward`` rows: a row per piece of a stratum (``INDEX``). Posting list j holds
    the documents ``doc_ids[at[upto[j-1]:upto[j]]]`` in which ``term[j]`` stands ``tf[j]`` times;
    lists are in order of (term, tf)."""
    # In decimals: 75 * n * N may be beyond 64 bits.
    m = F.expr(f"cast(25 + (cast(75 * n as decimal(38,0)) * cast({n_docs} as decimal(38,0))) div cast({max(length, 1)} as decimal(38,0)) as long)")
    strata = rows.withColumn("m", m).where(F.size("terms") > 0).withColumn("__h", F.xxhash64("doc_id"))
    strata = strata.repartitionByRange("m", "__h").sortWithinPartitions("m")

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("m", pa.int64()), ("doc_ids", pa.list_(pa.int64())), *((c, pa.list_(pa.int32())) for c in ("term", "tf", "upto", "at"))])
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, m = batch.column("doc_id").to_numpy(), batch.column("m").to_numpy()
            term, tf = (batch.column(c).flatten().to_numpy() for c in ("terms", "tfs"))
            ends = np.cumsum(batch.column("terms").value_lengths().to_numpy())
            out = []
            for i, j in _pieces(m, ends, piece):
                a, b = ends[i - 1] if i else 0, ends[j - 1]
                at = np.repeat(np.arange(j - i), np.diff(np.concatenate(([a], ends[i:j]))))
                order = np.lexsort((at, tf[a:b], term[a:b]))
                t, f = term[a:b][order], tf[a:b][order]
                last = np.append((t[1:] != t[:-1]) | (f[1:] != f[:-1]), True)
                out.append((int(m[i]), doc[i:j], t[last], f[last], np.flatnonzero(last) + 1, at[order]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return written(strata.select("doc_id", "m", "terms", "tfs").mapInArrow(invert, INDEX), name)


def _pieces(m: np.ndarray, ends: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with one m and at most ``limit`` postings, of one row at least."""
    start = 0
    cuts = np.append(np.flatnonzero(m[1:] != m[:-1]) + 1, len(m))
    for stop in cuts.tolist():
        while start < stop:
            base = ends[start - 1] if start else 0
            end = min(stop, max(start + 1, int(np.searchsorted(ends, base + limit, "right"))))
            yield start, end
            start = end


class Best:
    """The k best (score, doc_id) of every item so far, and what a further one must score."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.item, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.ones(n_items, np.int64)

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        if not len(item):
            return
        item, score, doc = np.append(self.item, item), np.append(self.score, score), np.append(self.doc, doc)
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        first = np.flatnonzero(np.append(True, item[1:] != item[:-1]))
        rank = np.arange(len(item)) - np.repeat(first, np.diff(np.append(first, len(item))))
        stay = rank < self.k
        self.item, self.score, self.doc = item[stay], score[stay], doc[stay]
        full = rank == self.k - 1
        self.least[item[full]] = score[full]


class Queries:
    """Items as flat arrays: the occurrences ``term[starts[i]:starts[i + 1]]`` of item i, each of weight ``w``."""

    def __init__(self, lists: list[np.ndarray], weight: np.ndarray):
        self.size = np.array([len(t) for t in lists], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.size)))
        self.term = np.concatenate(lists).astype(np.int64) if lists else np.zeros(0, np.int64)
        self.w = weight[self.term]


class Stratum:
    """One row of the index."""

    def __init__(self, m: int, doc_ids: np.ndarray, term: np.ndarray, tf: np.ndarray, upto: np.ndarray, at: np.ndarray):
        self.docs, self.at = doc_ids, at
        levels, which = np.unique(tf.astype(np.int64), return_inverse=True)
        self.impact = (1_000_000_000 * levels // (1000 * levels + 8 * m))[which]      # once per tf
        last = np.append(term[1:] != term[:-1], True) if len(term) else np.zeros(0, bool)
        self.terms, self.peak = term[last], self.impact[last]          # impacts rise with tf, so a term's last is its peak
        self.stop = upto[last].astype(np.int64)
        self.start = np.concatenate(([0], self.stop[:-1]))
        self.value = np.repeat(self.impact, np.diff(np.concatenate(([0], upto))))

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each wanted term among the stratum's, whether it is there)."""
        place = np.minimum(np.searchsorted(self.terms, wanted), len(self.terms) - 1)
        return place, self.terms[place] == wanted

    def bounds(self, q: Queries) -> np.ndarray:
        """The most that a document here can score for each item."""
        place, there = self.find(q.term)
        total = np.concatenate(([0], np.cumsum(np.where(there, q.w * self.peak[place], 0))))
        return total[q.starts[1:]] - total[q.starts[:-1]]

    def visit(self, q: Queries, items: np.ndarray, best: Best) -> None:
        """Score the documents for ``items``."""
        at_once = max(1, STEP // len(self.docs))
        for i in range(0, len(items), at_once):
            part = items[i:i + at_once]
            owner = np.repeat(np.arange(len(part)), q.size[part])
            row = np.arange(len(owner)) - np.repeat(np.cumsum(q.size[part]) - q.size[part], q.size[part]) + q.starts[part][owner]
            place, there = self.find(q.term[row])
            owner, row, place = owner[there], row[there], place[there]
            score = np.zeros(len(part) * len(self.docs), np.int64)
            n = self.stop[place] - self.start[place]
            ends = np.cumsum(n)
            a = 0
            while a < len(n):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + STEP, "right")))
                k = n[a:b]
                posting = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k - self.start[place[a:b]], k)
                cell = np.repeat(owner[a:b] * len(self.docs), k) + self.at[posting]
                np.add.at(score, cell, np.repeat(q.w[row[a:b]], k) * self.value[posting])
                a = b
            table = score.reshape(len(part), len(self.docs))
            who, doc = np.nonzero(table >= best.least[part][:, None])
            best.add(part[who], table[who, doc], self.docs[doc])


def search(index: DataFrame, queries: Queries, k: int = K) -> DataFrame:
    """(item, doc_id, score): at least the k best documents of every item, by its number."""

    def best_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(queries.size), k)
        for batch in batches:
            lists = [[x.values.to_numpy() for x in batch.column(c)] for c in ("doc_ids", "term", "tf", "upto", "at")]
            strata = [Stratum(m, *row) for m, *row in zip(batch.column("m").to_pylist(), *lists, strict=True)]
            bound = [s.bounds(queries) for s in strata]
            for i in np.argsort([-b.max(initial=0) for b in bound], kind="stable"):
                items = np.flatnonzero(bound[i] >= best.least)
                if len(items):
                    strata[i].visit(queries, items, best)
        yield pa.RecordBatch.from_arrays([pa.array(best.item), pa.array(best.doc), pa.array(best.score)], names=["item", "doc_id", "score"])

    return index.mapInArrow(best_of, "item long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item, score above 0."""
    spark = docs.sparkSession

    @F.pandas_udf("long")
    def n_terms(text: pd.Series) -> pd.Series:
        return pd.Series([len(terms(t)) for t in utf8(text)], dtype="int64")

    asked = written(items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
                    .withColumn("n", n_terms("text")).where("n > 0"), "search-items")
    total = asked.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // block_terms))
    schema = f"item_id {items.schema['item_id'].dataType.simpleString()}, item long, doc_id long, score long"
    found = spark.createDataFrame([], schema)
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()      # about block_terms terms
        texts = [terms(r["text"].encode("utf-8", "surrogatepass")) for r in block]
        vocabulary = {t: i for i, t in enumerate(sorted({t for ts in texts for t in ts}))}
        if not vocabulary:
            continue
        rows = forward(docs, vocabulary)
        n_docs, length, df = statistics(rows, len(vocabulary))
        weight = np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * df + 1))).astype(np.int64)
        queries = Queries([np.array([vocabulary[t] for t in ts]) for ts in texts], weight)
        names = spark.createDataFrame([(r["item_id"], i) for i, r in enumerate(block)], f"item_id {items.schema['item_id'].dataType.simpleString()}, item long")
        hits = search(build_index(rows, n_docs, length), queries, k)
        found = found.unionByName(hits.join(names, "item").withColumn("item", F.lit(b).cast("long") + F.col("item") * blocks))
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("item_id", "rank", F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "score"))
