"""How a set of quality filters interact: what each removes, in every order.

Each document becomes a truth-table word: bit S of its 32 bits is set if the document
survives the subset S of the five filters (bit i of S: filter i is applied). Positional
popcounts of the words, added in carry-save form, then give the survivors of every subset
per part and label, and every order of the filters follows from those 32 counts: a filter
that comes after the set P removes ``survivors(P) - survivors(P + filter)``.

Filters (``FILTERS``; a document fails): A under 50 words; B ``100 * distinct < 65 * words``;
C ``100 * [A-Z] > 5 * code points``; D any of ``#$%&*|``; E the text is identical to that of
a smaller doc_id anywhere in the table (texts are compared by their SHA-256).

Scale: one pass over the texts leaves a narrow row per document; rows that repeat are
counted before they move. A text's smallest id is a map-side minimum, and a row is looked
up among those by (doc_id, text), not by text, so a large group of copies stays spread.
What reaches the last step is 32 counts per part.

Edge cases: a null text counts as empty (null and empty texts are identical); an empty text
fails A alone, and E. A null source is the part ``''``. A null doc_id has no label, is
smaller than none and has no smaller one, so it never fails E. Rows that repeat a doc_id
count each, and one with the text's smallest id passes E. A doc_id with several labels has
a label if any row gives it. No documents, no rows. Other columns are ignored. A text of
any length is one step of a worker.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrid.llm.common import utf8, written

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_UPPER = 50, 65, 5
MARKS = b"#$%&*|"

_UPPER = bytes(range(65, 91))
_DUPLICATE = 1 << FILTERS.index("E")
_FULL = (1 << len(FILTERS)) - 1


def failures(text: bytes, n_chars: int) -> int:
    """The filters that a text fails by itself (all but E), a bit each."""
    words = text.split()                       # bytes part at \t \n \v \f \r and space
    n, distinct = len(words), len(set(words))
    upper = len(text) - len(text.translate(None, _UPPER))
    marked = len(text) != len(text.translate(None, MARKS))
    return ((n < MIN_WORDS) | (100 * distinct < MIN_DISTINCT * n) << 1
            | (100 * upper > MAX_UPPER * n_chars) << 2 | marked << 3)


def facts(docs: DataFrame) -> DataFrame:
    """(doc_id, part, failed, text_key, n): a row per different one, ``n`` times there."""

    @F.pandas_udf("failed int, text_key binary")
    def judge(texts: pd.Series) -> pd.DataFrame:
        texts = texts.fillna("")
        raw = utf8(texts)
        return pd.DataFrame({"failed": [failures(b, len(t)) for b, t in zip(raw, texts, strict=True)],
                             "text_key": [hashlib.sha256(b).digest() for b in raw]})

    judged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                         judge("text").alias("judged")).select("doc_id", "part", "judged.*")
    return judged.groupBy("doc_id", "part", "failed", "text_key").agg(F.count(F.lit(1)).alias("n"))


def words(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, good, toxic, failed, word, n): the truth-table word of every document."""
    rows = written(facts(docs), "audit-facts")
    # One row per text, so a row finds at most one; copies meet it by their own ids.
    first = (rows.where("doc_id is not null").groupBy("text_key").agg(F.min("doc_id").alias("doc_id"))
             .withColumn("is_first", F.lit(True)))
    rows = rows.join(first, ["doc_id", "text_key"], "left")
    copy = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    rows = rows.select("doc_id", "part", "n", F.when(copy, F.col("failed").bitwiseOR(F.lit(_DUPLICATE))).otherwise(F.col("failed")).alias("failed"))
    marks = (labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")))
    # Rows without an id have no label; kept out of the join, they don't meet in one task.
    known = rows.where("doc_id is not null").join(marks, "doc_id", "left").drop("doc_id")
    nameless = rows.where("doc_id is null").drop("doc_id").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    both = known.unionByName(nameless)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    table = F.lit([int(w) for w in truth_table()])
    return both.select("part", flag("good"), flag("toxic"), "failed", F.get(table, F.col("failed")).cast("long").alias("word"), "n")


def truth_table() -> np.ndarray:
    """The word of each set of failed filters: bit S is set if no filter of S is failed."""
    subset = np.arange(_FULL + 1)
    survives = (subset[:, None] & subset[None, :]) == 0
    return (survives.astype(np.uint64) << subset.astype(np.uint64)).sum(1).astype(np.uint32)


def positional_popcount(column: np.ndarray) -> np.ndarray:
    """How many of the uint32 words have each bit set. Three words of one weight are added, bit
    by bit, to a sum of that weight and a carry of twice it, until at most two are left."""
    counts, weight = np.zeros(32, np.int64), 1
    while len(column):
        carries = [column[:0]]
        while len(column) >= 3:
            k = len(column) // 3
            a, b, c, rest = column[:k], column[k:2 * k], column[2 * k:3 * k], column[3 * k:]
            half = a ^ b
            carries.append((a & b) | (half & c))
            column = np.concatenate((half ^ c, rest))
        for w in column.tolist():
            counts += weight * ((w >> np.arange(32)) & 1)
        column, weight = np.concatenate(carries), 2 * weight
    return counts


def weighted_popcount(column: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The same with word i there ``times[i]`` times, one binary digit of the times after the other."""
    counts = np.zeros(32, np.int64)
    for bit in range(int(times.max(initial=0)).bit_length()):
        counts += positional_popcount(column[(times >> bit) & 1 == 1]) << bit
    return counts


def survivors(found: DataFrame) -> DataFrame:
    """(part, subset, n, good, toxic): documents of each part that survive each subset."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, rows in pdf.groupby("part", sort=False):
                word, n = rows["word"].to_numpy(np.int64).astype(np.uint32), rows["n"].to_numpy(np.int64)
                good, toxic = rows["good"].to_numpy(bool), rows["toxic"].to_numpy(bool)
                yield pd.DataFrame({"part": part, "subset": np.arange(32, dtype=np.int32), "n": weighted_popcount(word, n),
                                    "good": weighted_popcount(word[good], n[good]), "toxic": weighted_popcount(word[toxic], n[toxic])})

    per_task = found.select("part", "good", "toxic", "word", "n").mapInPandas(count, "part string, subset int, n long, good long, toxic long")
    return per_task.groupBy("part", "subset").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def steps() -> pd.DataFrame:
    """Every step of every order: filter_order, step, the filter's number and the subsets before and after it."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order, 1):
            rows.append(("".join(FILTERS[i] for i in order), step, f, before, before | 1 << f))
            before |= 1 << f
    return pd.DataFrame(rows, columns=["filter_order", "step", "filter", "before", "after"])


RESULT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
          "good_lost long, toxic_lost long, shapley long")


def orders(counts: DataFrame) -> DataFrame:
    """The audit's rows from ``survivors``: 120 orders of five steps per part."""

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = steps()
        f, before, after = (at[c].to_numpy() for c in ("filter", "before", "after"))
        for pdf in batches:
            for part, rows in zip(pdf["part"], pdf["counts"], strict=True):
                n, good, toxic = np.array([[r["n"], r["good"], r["toxic"]] for r in rows], np.int64).T
                removed = n[before] - n[after]
                alone = np.array([n[_FULL ^ 1 << i] for i in range(len(FILTERS))]) - n[_FULL]
                total = np.zeros(len(FILTERS), np.int64)
                np.add.at(total, f, removed)
                yield pd.DataFrame({
                    "part": part, "filter_order": at["filter_order"], "step": at["step"], "kept": n[after], "removed": removed,
                    "redundant": n[0] - n[1 << f] - removed, "unique_fails": alone[f], "good_lost": good[before] - good[after],
                    "toxic_lost": toxic[before] - toxic[after], "shapley": total[f]})

    # 32 entries per part, in the order of the subsets.
    per_part = counts.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("subset", "n", "good", "toxic"))).alias("counts"))
    return per_part.mapInPandas(expand, RESULT)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step (see ``RESULT``)."""
    return orders(survivors(words(docs, labels)))
