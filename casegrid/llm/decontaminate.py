"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

A benchmark item gives windows of ``window`` consecutive words (an item of fewer
words is one window). A window is a sequence of ``SHINGLE``-word shingles. Since a
window has to be contained whole, its necessary prefix is one shingle: the rarest,
by the number of its occurrences in all documents. Steps:

1. one scan of the documents keeps the positions of shingles that any window has;
2. their counts order each window's shingles by rarity; a window that lacks an
   occurrence of its rarest shingle cannot occur;
3. occurrences of prefix shingles give candidate starts, within the document's bounds;
4. each candidate is compared with the document's words.

Words are the runs of characters outside ``SEPARATORS`` with A-Z in lower case. The
scan lowers other letters too (a faster function), which can only add candidates;
step 4 compares the words as defined.

Edge cases: null or wordless texts have no words and no hits; wordless items have no
windows. Repeated rows keep their own result row; documents are told apart by id and
text, so a repeated id is safe. A null item_id marks words but is not listed. Extra
columns are ignored. An empty table of items leaves every document clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegrid.llm.common import written

SHINGLE = 3
#: Characters that part words, before and after A-Z became lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEPARATORS_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Distinct shingles (8 bytes each) up to which the scan gets them by broadcast;
#: beyond, Spark joins by shuffle.
BROADCAST_SHINGLES = 1 << 20


def words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lower, SEPARATORS), "")


def _folded(text: Column) -> Column:
    """All letters in lower case, the same for a letter wherever it stands: lower() gives a
    capital sigma its final form by its neighbours, so both forms become one."""
    plain = lambda t: F.when(F.contains(t, F.lit("ς")), F.translate(t, "ς", "σ")).otherwise(t)
    return F.transform(F.array(F.lower(F.coalesce(text, F.lit("")))), plain)[0]


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS_ANY_CASE), ""))


def _shingles(w: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words, by position."""
    last = F.size(w) - size
    at = lambda i: F.xxhash64(*[w[i + j] for j in range(size)])
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), at))


def windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id, phrase, m): every window of every item, words joined by a space."""
    w = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.size("w") - window, F.lit(0))
    return (w.select("item_id", "w", F.explode(F.sequence(F.lit(0), last)).alias("s"))
            .select("item_id", F.slice("w", F.col("s") + 1, F.lit(window)).alias("w"))
            .select("item_id", F.array_join("w", " ").alias("phrase"), F.size("w").alias("m")).distinct())


def contamination(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_hash) per row of ``docs``."""
    wins = written(windows(items, window), "windows")
    phrases = wins.select("phrase", "m").distinct()
    split = phrases.withColumn("w", F.split("phrase", " "))
    # Folding each phrase by the scan's function gives the scan's words.
    folded = F.split(_folded(F.col("phrase")), " ")
    tokens = None
    for size in range(1, SHINGLE + 1):
        own = split.where(F.col("m") == size if size < SHINGLE else F.col("m") >= size).withColumn("f", folded)
        part = own.select("phrase", "m", F.lit(size).alias("size"), F.posexplode(_shingles(F.col("f"), size)).alias("off", "h"))
        tokens = part if tokens is None else tokens.union(part)
    tokens = written(tokens, "tokens")
    sizes = [r["size"] for r in tokens.select("size").distinct().collect()]      # at most SHINGLE numbers
    keys = tokens.select("h").distinct()
    if keys.count() <= BROADCAST_SHINGLES:
        keys = F.broadcast(keys)

    text_hash = F.xxhash64("text").alias("text_hash")
    scan = docs.select(F.col("doc_id"), text_hash, F.array_remove(F.split(_folded(F.col("text")), SEPARATORS), "").alias("w"))
    found = None
    for size in sizes:
        part = (scan.select("doc_id", "text_hash", F.size("w").alias("n"), F.posexplode(_shingles(F.col("w"), size)).alias("pos", "h"))
                .join(keys, "h").select("doc_id", "text_hash", "n", "pos", "h"))
        found = part if found is None else found.union(part)
    if found is None:
        found = docs.select("doc_id", text_hash, F.lit(0).alias("n"), F.lit(0).alias("pos"), F.lit(0).cast("long").alias("h")).limit(0)
    found = written(found, "occurrences")

    counts = found.groupBy("h").agg(F.count("*").alias("c"))
    prefix = (tokens.join(counts, "h", "left").groupBy("phrase", "m")
              .agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "off", "h")).alias("p"))
              .where("p.c > 0").select("phrase", "m", F.col("p.off").alias("off"), F.col("p.h").alias("h")))
    prefix = written(prefix, "prefix")
    candidates = (found.join(prefix, "h").withColumn("start", F.col("pos") - F.col("off"))
                  .where("start >= 0 and start + m <= n")
                  .groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "m", "phrase")).alias("cands")))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])
    texts = docs.select("doc_id", text_hash, "text")
    # Rows of one id and text become one before the comparison, which so stays above the join;
    # a text's words are made once, as the argument of a function, not once per candidate.
    occurs = lambda w: F.filter("cands", lambda c: F.array_join(F.slice(w, c["start"] + 1, c["m"]), " ") == c["phrase"])
    confirmed = (texts.join(candidates, same(texts, candidates)).select(texts["doc_id"], texts["text_hash"], "text", "cands")
                 .dropDuplicates(["doc_id", "text_hash"])
                 .select("doc_id", "text_hash", F.transform(F.array(words(F.col("text"))), occurs)[0].alias("hits")))
    confirmed = written(confirmed, "confirmed").where(F.size("hits") > 0)
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda c: F.sequence(c["start"], c["start"] + c["m"] - 1))))
    marked = confirmed.select("doc_id", "text_hash", F.size(covered).alias("n_hit"))
    listed = (confirmed.select("doc_id", "text_hash", F.explode(F.array_distinct(F.transform("hits", lambda c: c["phrase"]))).alias("phrase"))
              .join(wins.select("phrase", F.col("item_id").cast("string").alias("item")), "phrase")
              .groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("item")).alias("ids")))
    marked = marked.join(listed, same(marked, listed), "left").select(marked["doc_id"], marked["text_hash"], "n_hit", "ids")
    base = docs.select("doc_id", text_hash, n_words(F.col("text")).cast("long").alias("n_words"))
    out = base.join(marked, same(base, marked), "left")
    n_hit, ids = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("ids", F.array().cast("array<string>"))
    return out.select(base["doc_id"], "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
                      F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), base["text_hash"])


def clean(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs."""
    dirty = contamination(docs, items, window).where("contaminated").select(F.col("doc_id").alias("d_id"), F.col("text_hash").alias("d_hash")).distinct()
    return docs.join(dirty, F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.xxhash64("text") == F.col("d_hash")), "left_anti")
