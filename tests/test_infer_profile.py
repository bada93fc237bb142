"""Type inference, profiles, unbounded totals, ranges of an order, calendar spine."""

import contextlib
import datetime as dt
import io
import random
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from casegrid.operators import metrics as M
from casegrid.operators.ordered import number_rows, over_ranges
from casegrid.operators.profile import exact_tops, profile, profile_approx
from casegrid.sources.infer import infer_types, parsed, type_map


def _explain(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("simple")
    return out.getvalue()


# Inference ------------------------------------------------------------------

@pytest.mark.parametrize("values,want", [
    (["1", "-2", "+3"], "bigint"), (["1", "2.5"], "double"), (["1e5", ".5", "7"], "double"), (["9223372036854775807"], "bigint"),
    (["9223372036854775808", "1"], "double"), (["true", "NO", "Yes"], "boolean"), (["yes", "1"], "string"), (["2024-02-29", "1999-12-31"], "date"),
    (["2023-02-29"], "string"), (["2024-01-01", "2024-01-01 10:20:30.5", "2024-01-01T10:20"], "timestamp"), (["2024-01-01 25:00:00"], "string"),
    (["01/02/2024"], "string"), ([None, "", "5"], "bigint"), ([None, ""], "string"), ([" 5"], "string"), (["1,000"], "string"), (["NaN"], "string")])
def test_narrowest_type(spark, values, want):
    raw = spark.createDataFrame([(v,) for v in values], "`a b` string").repartition(2)
    row = infer_types(raw).first()
    filled = [v for v in values if v]
    assert (row.column_name, row.column_type, row.n_values, row.n_missing, row.n_bad) == ("a b", want, len(filled), len(values) - len(filled), 0)
    if want != "string":
        assert raw.select(F.count(parsed(F.nullif(F.col("`a b`"), F.lit("")), want))).first()[0] == len(filled)


def test_tolerance_and_edges(spark):
    raw = spark.createDataFrame([(str(i), "x") for i in range(99)] + [("bad", "y")], "n string, N2 string")
    assert type_map(infer_types(raw)) == {"n": "string", "N2": "string"}
    assert [tuple(r) for r in infer_types(raw, tolerance=0.01).select("column_type", "n_bad").collect()] == [("bigint", 1), ("string", 0)]
    assert infer_types(raw.where("false")).select("column_type", "n_values").distinct().collect() == [("string", 0)]
    assert infer_types(spark.range(3)).count() == 0


def test_load_with_inferred_types(spark, tmp_path):
    from casegrid.sources import complaints_csv as C
    (tmp_path / "a.csv").write_text("Date received,ZIP code,Complaint ID,Amount,Filed\n2023-01-05,01234,17,2.5,2023-01-04\nbad,xx,yy,zz,no date\n2023-01-06,,18,3,\n")
    good, bad = C.read_complaints(spark, str(tmp_path / "a.csv"), str(tmp_path / "landed"), infer=True)
    # Rejected rows have no say; an empty value is null in a typed column.
    assert dict(good.dtypes) == {"date_received": "date", "zip_code": "bigint", "complaint_id": "bigint", "amount": "double", "filed": "date"}
    assert {r.complaint_id: r.filed for r in good.collect()} == {17: dt.date(2023, 1, 4), 18: None} and bad.count() == 1


# Profiles -------------------------------------------------------------------

def _table(spark, n=3000):
    rng = random.Random(2)
    rows = [(rng.choice([None, "a", "a", "a", "b", f"v{rng.randint(0, 900)}"]), rng.choice([None, rng.randint(-50, 50)]), dt.date(2020, 1, 1) + dt.timedelta(rng.randint(0, 2000)),
             rng.random() < 0.3) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "`odd name` string, n long, day date, flag boolean").repartition(5)


def test_profile_equals_plain_counts(spark):
    rows, df = _table(spark)
    got = profile(df, k=4).collect()
    for i, c in enumerate(df.columns):
        values = [r[i] for r in rows]
        there = [v for v in values if v is not None]
        text = lambda v: None if v is None else str(v).lower() if isinstance(v, bool) else str(v)
        top = sorted(Counter(map(text, values)).items(), key=lambda x: (-x[1], x[0] is None, x[0]))[:4]
        mine = [r for r in got if r.column_name == c]
        assert {(r.n_rows, r.n_null, r.n_distinct, r.min_value, r.max_value) for r in mine} == \
            {(len(values), len(values) - len(there), len(set(there)), text(min(there)), text(max(there)))}
        assert sorted((r["rank"], r["value"], r["n"]) for r in mine) == [(j, v, n) for j, (v, n) in enumerate(top, 1)]
    assert profile(df.where("false")).count() == 0
    assert _explain(profile(df)).count("Scan ExistingRDD") <= 2          # the second is the same exchange, reused


def test_profile_of_counted_rows(spark):
    df = spark.createDataFrame([("a", 5), ("b", 2), (None, 4)], "k string, n long")
    got = {(r.rank, r.value, r.n) for r in profile(df, ["k"], weight="n").select("rank", "value", "n").collect()}
    assert got == {(1, "a", 5), (2, None, 4), (3, "b", 2)}


def test_approximate_profile_is_within_its_bounds(spark):
    rng = random.Random(9)
    heavy = [f"h{i}" for i in range(12)]
    rows = [(rng.choice(heavy) if rng.random() < 0.5 else f"v{rng.randint(0, 30_000)}", rng.randint(0, 10_000)) for _ in range(60_000)]
    df = spark.createDataFrame(rows, "word string, number long").repartition(6)
    approx = profile_approx(df, k=20, tracked=512)
    found = {r.column_name: r for r in approx.collect()}
    true = Counter(w for w, _ in rows)
    assert abs(found["word"].n_distinct / len(true) - 1) < 0.06 and abs(found["number"].n_distinct / len({n for _, n in rows}) - 1) < 0.06
    assert (found["number"].min_value, found["number"].max_value) == (str(min(n for _, n in rows)), str(max(n for _, n in rows)))
    for t in found["word"].tops:
        assert abs(t["count"] - true[t["item"]]) <= found["word"].error
    exact = exact_tops(df, approx, k=10).where("column_name = 'word'").collect()
    assert sorted((r["rank"], r["value"], r["n"]) for r in exact) == [(i, w, n) for i, (w, n) in enumerate(sorted(true.items(), key=lambda x: (-x[1], x[0]))[:10], 1)]
    assert all(r.proven for r in exact)


# Totals, lags and frames without a bound ---------------------------------------

def test_unbounded_totals_equal_the_window_and_use_none(spark):
    df = spark.range(5000).select((F.col("id") * 7 % 1000).alias("k"), (F.col("id") % 13).alias("v"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 50).cast("int")).alias("day"))
    for make in (lambda b: M.share_of_total(df, "v", bounded=b), lambda b: M.at_latest_period(df, "day", F.col("v") < 5, bounded=b),
                 lambda b: M.zscore(df, "v", mean_out="m", band_out="band", cuts=(1.0,), labels=("high",), default="low", bounded=b)):
        assert sorted(make(True).collect(), key=str) == sorted(make(False).collect(), key=str)
        assert "Window" in _explain(make(True)) and "Window" not in _explain(make(False))


@pytest.mark.parametrize("partition", [(), ("g",)])
def test_frames_over_ranges_equal_plain_windows(spark, partition):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 8 + ["b", None]), i, rng.choice([None, rng.randint(0, 99)])) for i in range(4000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, t long, v long").repartition(7)
    columns = lambda w: {"lag1": F.lag("v", 1).over(w), "lag12": F.lag("v", 12).over(w),
                         "total": F.sum("v").over(w.rowsBetween(-29, 0)), "mean": F.avg("v").over(w.rowsBetween(-29, 0)), "least": F.min("v").over(w.rowsBetween(-29, 0))}
    plain = df.withColumns(columns(Window.partitionBy(*partition).orderBy("t")))
    for size in (30, 170):
        ranged = over_ranges(df, [F.col("t")], columns, 29, partition, range_rows=size)
        assert ranged.columns == plain.columns
        assert sorted(ranged.collect(), key=lambda r: r.t) == sorted(plain.collect(), key=lambda r: r.t)


def test_ranges_are_even_and_numbers_follow_the_order(spark):
    df = spark.range(0, 10_000, 1, 8).select((F.lit(9_999) - F.col("id")).alias("t"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = number_rows(df, [F.col("t")]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert all(r.t == r.row_no for r in got) and len(got) == 10_000
    plan = _explain(over_ranges(df, [F.col("t")], lambda w: {"x": F.lag("t", 2).over(w)}, 2, range_rows=500))
    window = plan[plan.index("Window"):]
    assert "hashpartitioning(__range" in window[:window.index("FileScan")]


def test_metrics_over_ranges(spark):
    df = spark.range(500).select(F.col("id").alias("t"), (F.col("id") * 37 % 101).alias("v"), (F.col("id") % 2).alias("g"))
    for make in (lambda b: M.growth_vs_lag(df, "t", "v", lag=12, bounded=b), lambda b: M.rolling(df, "t", "v", 90, partition=["g"], bounded=b),
                 lambda b: M.trend_class(df, "t", "v", partition=["g"], bounded=b)):
        assert sorted(make(True).collect()) == sorted(make(False).collect())


def test_latest_per_group_keeps_whole_rows(spark):
    rng = random.Random(6)
    days = [None, dt.date(2020, 1, 1), dt.date(2021, 5, 5), dt.date(1969, 1, 1)]
    rows = sorted({(rng.choice([None, "a", "b", "c", "d"]), rng.choice(days), rng.choice([None, 1, 2, 3]), rng.choice([None, "x"])) for _ in range(60)}, key=str)
    df = spark.createDataFrame(rows, "g string, day date, tie int, note string")
    w = Window.partitionBy("g").orderBy(F.desc_nulls_last("day"), F.asc_nulls_last("tie"), F.asc_nulls_last("note"))
    want = df.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
    for order in ("day", F.col("day").cast("timestamp"), F.unix_date("day").cast("double"), F.col("day").cast("string")):
        by = df if isinstance(order, str) else df.withColumn("day", order)
        ref = want if isinstance(order, str) else want.withColumn("day", order)
        got = M.latest_per_group(by, ["g"], "day", ["tie", "note"])
        assert got.columns == df.columns and sorted(got.collect(), key=str) == sorted(ref.collect(), key=str)
    plan = _explain(M.latest_per_group(df, ["g"], "day", ["tie"]))
    assert "Window" not in plan and "partial_min_by" in plan


# Calendar -------------------------------------------------------------------

def test_calendar_spine(spark):
    rows = [("a", dt.date(2020, 1, 1), 5, "x"), ("a", dt.date(2020, 4, 1), 7, "y"), (None, dt.date(2020, 3, 1), 1, None), ("c", None, 9, "z")]
    df = spark.createDataFrame(rows, "k string, month date, n long, note string")
    got = sorted(map(tuple, M.with_calendar(df, "month", ["k"], {"n": 0}).collect()), key=str)
    month = lambda m: dt.date(2020, m, 1)
    assert got == sorted([("a", month(1), 5, "x"), ("a", month(2), 0, None), ("a", month(3), 0, None), ("a", month(4), 7, "y"), (None, month(3), 1, None), (None, month(4), 0, None)], key=str)
    own = M.with_calendar(df, "month", ["k"], {"n": 0}, whole=False)
    assert own.count() == 5
    grown = {(r.k, r.month): r.prev for r in M.growth_vs_lag(M.with_calendar(df, "month", ["k"], {"n": 0}), "month", "n", partition=["k"]).collect()}
    assert grown["a", month(4)] == 0                     # the row lag would have given 5
    assert M.with_calendar(df.where("false"), "month", ["k"], {"n": 0}).count() == 0


def test_each_value_is_matched_in_a_row_of_its_own(spark):
    # Generated code that grows with the columns is no longer compiled: one pattern set serves all of them.
    raw = spark.createDataFrame([("1", "a"), ("123e-5", "2020-02-30"), ("2020-01-01\n", None), ("", "yes")], "a string, b string")
    found = infer_types(raw)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate posexplode" in plan and plan.count("[0-9]{1,19}") <= 2
    assert [tuple(r) for r in found.collect()] == [("a", "string", 3, 1, 0), ("b", "string", 3, 1, 0)]
    assert [tuple(r) for r in infer_types(raw.limit(0)).collect()] == [("a", "string", 0, 0, 0), ("b", "string", 0, 0, 0)]
    assert [r["column_type"] for r in infer_types(raw.where("a like '%e%'")).collect()] == ["double", "string"]
    assert [r["column_type"] for r in infer_types(raw.where("a like '2020%'")).collect()] == ["date", "string"]
