"""Mixing against a plain sort, sum and cut per source."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from casegrid.llm import mixing as M


def n_words(text):
    return len((text or "").encode().split())


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, at_most = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in at_most)
        share = sum(weight[s] for s in names if s not in at_most)
        target = {s: float(most * sizes[s]) if s in at_most else weight[s] * float(left) / float(share) for s in names}
        above = {s for s in names if target[s] > most * sizes[s]}
        if not above:
            return target
        at_most |= above


def brute(docs, seed="mix"):
    sizes, by = defaultdict(int), defaultdict(list)
    for i, text, source in docs:
        sizes[source] += n_words(text)
        by[source].append((hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), i, n_words(text)))
    target = brute_targets(sizes)
    out = []
    for source, rows in by.items():
        budget, at = int(target[source] + 0.5), 0
        full, rest = divmod(budget, sizes[source]) if sizes[source] else (0, 0)
        for _, i, size in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2])):
            out.append((i, source, size, sizes[source], target[source], full * size + min(max(rest - at, 0), size)))
            at += size
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "source", "size", "source_size", "target", "taken").collect()), key=str)


def corpus(seed, n=300):
    rng = random.Random(seed)
    text = lambda: rng.choice([None, "", " \t\n", "one", "two words here", "a\x0bb\x0cc\rd", "w " * rng.randint(1, 80)])
    sources = ["big"] * 30 + ["a", "b", "Z", "é", "", None, "z9", "empty"]
    docs = [(rng.choice([None, i, i, i, 7]), text(), rng.choice(sources)) for i in range(n)]
    docs = [(i, None if s == "empty" else t, s) for i, t, s in docs]
    return docs + rng.choices(docs, k=10) + [(9999, "long " * 50_000, "b")]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_mix_equals_brute_force(spark, seed):
    docs = corpus(seed)
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns(
        {"size": F.lit("x"), "key": F.lit(1), "before": F.lit(2), "target": F.lit(3), "source_no": F.lit(4), "weight": F.lit(5)})
    got = rows_of(M.mix(d.repartition(3)))
    assert got == brute(docs)
    assert rows_of(M.mix(d.repartition(11))) == got          # reruns agree
    taken, size, target = defaultdict(int), defaultdict(int), {}
    for _, s, n, whole, t, k in got:
        assert k <= 3 * n
        taken[s] += k
        size[s], target[s] = whole, t
    for s in taken:
        assert taken[s] == int(target[s] + 0.5)
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6 * max(1, sum(size.values()))


def test_excess_is_shared_again(spark):
    docs = [(i, "w " * 10, "a") for i in range(2)] + [(10 + i, "w " * 10, "b") for i in range(30)] + [(100 + i, "w " * 10, "c") for i in range(200)]
    got = {r[1]: r[4] for r in rows_of(M.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")))}
    assert got["a"] == 60.0 and got["b"] == 900.0 and got["c"] == 2320 - 960        # two rounds: a, then b stop at three times


def test_running_sums_over_many_tasks(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, 1, 2, 5]), rng.randint(0, 500), rng.randint(0, 9), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g long, k long, v long, i long").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.i: r.before for r in M.running(df, F.col("g"), [F.col("k"), F.col("i")], "v", "t").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    at = defaultdict(int)
    for g, _, v, i in sorted(rows, key=lambda r: (r[0], r[1], r[3])):
        assert got[i] == at[g]
        at[g] += v


def test_mixture_holds_the_taken_words(spark):
    docs = [(i, f"d{i}  " + f"x{i} " * (i % 40), "abc"[i % 3] if i % 11 else None) for i in range(200)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    texts, taken = dict((i, t) for i, t, _ in docs), {r.doc_id: r.taken for r in M.mix(d).collect()}
    words, cut = defaultdict(int), 0
    for r in M.mixture(d).collect():
        assert texts[r.doc_id].startswith(r.text)
        cut += texts[r.doc_id] != r.text
        words[r.doc_id] += n_words(r.text)
    assert {i: n for i, n in taken.items() if n} == dict(words)
    assert 0 < cut <= 4                                      # one document of a source at most


def test_empty_and_wordless_tables(spark):
    d = spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string")
    assert M.mix(d.where("false")).count() == 0
    assert rows_of(M.mix(d.withColumn("text", F.lit(None).cast("string")))) == [(1, "s", 0, 0, 0.0, 0)]
