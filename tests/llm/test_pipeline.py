"""The pipeline on planted documents, held against a brute-force version; registered queries and SQL."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from casegrid.llm import registry as R
from casegrid.llm import secrets as S
from casegrid.llm.common import scratch_path
from test_decontaminate import brute_force as contaminated
from test_near_dup import brute_force as near

SF = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark labels".split()


def test_stages_are_in_order():
    assert [n for n, _ in C.STAGES] == ["toxicity", "near_dedup", "decontaminate", "secrets", "packing"]


def test_whole_run(spark):
    """Planted rows: toxic ones, copies, a benchmark passage, a secret; clean rows stay."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(900)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    rows, labels = [], []
    for i in range(300):
        toxic = i % 4 == 0
        rows.append((i, prose(40) + (" awful nasty scum" if toxic else "")))
        labels.append((i, 1, int(toxic)))
    item = prose(14)
    base = prose(80)
    rows += [(400, base), (401, base), (402, base + " tail"), (410, prose(20) + " " + item), (420, prose(30) + ' token = "abcd1234efgh"'), (421, None), (422, "")]
    folder = scratch_path(spark, "pipeline-test")
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    kept = {i: t for i, t in rows if "scum" not in (t or "")}
    planted = near([(i, t) for i, t in kept.items() if i >= 400], 5)       # the rest are random and unlike
    kept = {i: t for i, t in kept.items() if i < 400 or planted[i][1] == i}
    kept = {i: t for i, t in kept.items() if not contaminated(t, [(1, item)], 10)[4]}
    want = {i: len((S.redact(t) or "").split()) + 1 for i, t in kept.items()}
    assert {r.doc_id: r.n_tokens for r in C.run(spark, folder).collect()} == want

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    secret = {r.doc_id: r for r in C.redact_secrets(spark, docs, folder).collect()}[420]
    assert secret.text.endswith("[secret]\"") and secret.n_chars == len(secret.text)
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, docs.withColumns({"class": F.lit(1), "score": F.lit(2)}), folder).columns == C.COLUMNS
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_one_of_each_group_stays_without_ids(spark):
    """Near copies whose ids are all null, or all the same, leave one row; unlike rows of that id stay."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    near_copies = [" ".join([*base, f"t{i}"]) for i in range(3)]
    unlike = " ".join(f"v{i}" for i in range(60))
    for doc_id in (None, 9):
        rows = [(doc_id, t) for t in [*near_copies, *near_copies, unlike, None, ""]]
        frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(1).cast("long")})
        kept = [r.text for r in C.drop_near_duplicates(spark, frame, "").collect()]
        assert len(set(kept) & set(near_copies)) == 1 and len(kept) == 4 and {unlike, None, ""} < set(kept)


@pytest.mark.parametrize("name", sorted(R.llm_oracle_sql()))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = R.llm_queries()[name](spark, SF)
    res = con.execute(R.llm_oracle_sql()[name])
    columns = [d[0] for d in res.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == sorted(tuple(r) for r in res.fetchall())


@pytest.mark.parametrize("name", sorted(set(R.llm_queries()) - set(R.llm_oracle_sql())))
def test_queries_cover_their_tables(spark, name):
    table = "pages" if name.startswith("op2_") else "documents"
    assert R.llm_queries()[name](spark, SF).count() == spark.read.parquet(os.path.join(SF, f"{table}.parquet")).count()
