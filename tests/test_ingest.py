"""CSV ingest fixtures (FIXTURES.md section 4), series loading, catalog and sinks."""

import datetime as dt
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casegrid import schema as S
from casegrid.plans import catalog, sinks
from casegrid.sources import complaints_csv as C
from casegrid.sources.series import load_series, series_range

HEADER = ('"Date received","Product","Sub-product","Consumer complaint narrative",'
          '"Company response to consumer","Timely response?","State","Complaint ID"\n')
ROWS = [
    # quoted newline and doubled quotes in a text column
    '2023-01-05,Credit card,,"multi\nline ""q"", x",Closed with monetary relief,Yes,TX,1\n',
    '2023-01-06,Mortgage,,,Closed with explanation,No,CA,2\n',
    '2023-01-07,Mortgage,,,,,,3\n',                                   # empty timely and state
    '2023-01-08,Mortgage,,,Closed,Yes,TX,4,extra\n',                  # extra trailing field
    'not-a-date,Mortgage,,,Closed,Yes,TX,5\n',                        # bad date
    '2023-01-09,Mortgage,,,Closed,Maybe,TX,6\n',                      # bad flag
]


@pytest.fixture()
def extract(tmpdir_path):
    os.makedirs(tmpdir_path, exist_ok=True)
    p = os.path.join(tmpdir_path, "complaints.csv")
    with open(p, "w") as f:
        f.write(HEADER + "".join(ROWS))
    return p


def test_ingest_fixture_rows(spark, extract, tmpdir_path):
    good, bad = C.read_complaints(spark, extract, tmpdir_path + "/landed")
    g = {r.complaint_id: r for r in good.collect()}
    assert sorted(g) == ["1", "2", "3"]
    assert g["1"].consumer_complaint_narrative == 'multi\nline "q", x'
    assert g["1"].timely_response is True and g["2"].timely_response is False
    assert g["3"].timely_response is None and g["3"].state is None
    assert g["1"].date_received == dt.date(2023, 1, 5)
    reasons = {r.complaint_id: r.reject_reason for r in bad.collect()}
    assert reasons == {"4": "malformed_record", "5": "bad_date", "6": "bad_timely"}
    assert set(S.SOURCE_COLUMNS.values()) <= set(good.columns)
    assert dict(good.dtypes)["date_received"] == "date"


def test_written_table_counts(spark, extract, tmpdir_path):
    good, _ = C.read_complaints(spark, extract, tmpdir_path + "/landed")
    catalog.write_case_table(good.select(*S.CASE_SCHEMA.fieldNames()), tmpdir_path + "/cases")
    assert catalog.row_count(spark, tmpdir_path + "/cases") == 3
    back = catalog.read_case_table(spark, tmpdir_path + "/cases")
    assert catalog.CASE_PARTITION in back.columns


def test_source_layout_roundtrip(spark, tmpdir_path):
    rows = [(dt.date(2023, 1, 1), "P", "TX", S.RELIEF_RESPONSE, True),
            (dt.date(2023, 1, 2), None, None, None, None)]
    df = spark.createDataFrame(rows, S.CASE_SCHEMA)
    sinks.csv_writer(C.to_source_layout(df)).csv(tmpdir_path + "/csv")
    good, bad = C.read_complaints(spark, tmpdir_path + "/csv", tmpdir_path + "/landed")
    assert bad.count() == 0
    assert sorted(map(tuple, good.select(*S.CASE_SCHEMA.fieldNames()).collect()), key=str) == \
        sorted(map(tuple, df.collect()), key=str)


def test_series_loader(spark, tmpdir_path):
    p = tmpdir_path + "/series.csv"
    os.makedirs(tmpdir_path, exist_ok=True)
    with open(p, "w") as f:
        f.write("date,value\n2020-01-01,2.5\n2020-04-01,\n2020-07-01,3.1\n")
    s = load_series(spark, p)
    assert [tuple(r) for r in s.orderBy("date").collect()] == [
        (dt.date(2020, 1, 1), 2.5), (dt.date(2020, 7, 1), 3.1)]
    r = series_range(s).first()
    assert (r.observations, r.first_date, r.last_date) == (2, dt.date(2020, 1, 1), dt.date(2020, 7, 1))
    with open(p, "a") as f:
        f.write("2020-08-01,3.3\n")
    with pytest.raises(ValueError):
        load_series(spark, p)


def test_catalog_create_replace_describe(spark, tmpdir_path):
    df = spark.createDataFrame([("TX", 1)], "state string, population long")
    name = "pop_" + os.path.basename(tmpdir_path).replace("-", "_")
    assert catalog.create_if_absent(df, name, tmpdir_path + "/t1")
    assert not catalog.create_if_absent(df, name, tmpdir_path + "/t1")
    df2 = spark.createDataFrame([("CA", 2), ("NY", 3)], "state string, population long")
    assert catalog.replace_table(df2, name, tmpdir_path + "/t2").count() == 2
    d = {r.col_name: r.data_type for r in catalog.describe(df2).collect()}
    assert d == {"state": "string", "population": "bigint"}


def test_overwrite_in_place(spark, tmpdir_path):
    path = tmpdir_path + "/report"
    df = spark.createDataFrame([("SMALL", "A", 1, 1.0), ("MEDIUM", "A", 3, 2.0)],
                               S.PRODUCT_STATE_SCHEMA)
    sinks.write_report_csv(df, path)
    back = sinks.read_report_csv(spark, path, S.PRODUCT_STATE_SCHEMA)
    merged = back.replace({"SMALL": "X", "MEDIUM": "X"}, subset=["product"]) \
        .groupBy("product", "state").agg(F.sum("complaints").alias("complaints"),
                                         F.avg("relief_rate").alias("relief_rate"))
    sinks.overwrite_in_place(merged, path)
    out = sinks.read_report_csv(spark, path, S.PRODUCT_STATE_SCHEMA).collect()
    assert [tuple(r) for r in out] == [("X", "A", 4, 1.5)]
    assert len([f for f in os.listdir(path) if f.endswith(".csv")]) == 1


def test_extract_without_flag_or_date_columns(spark, tmpdir_path):
    os.makedirs(tmpdir_path, exist_ok=True)
    p = os.path.join(tmpdir_path, "narrow.csv")
    with open(p, "w") as f:
        f.write("State,Product\nTX,Card\nCA,Loan,extra\n")
    good, bad = C.read_complaints(spark, p, tmpdir_path + "/landed")
    assert [tuple(r) for r in good.collect()] == [("TX", "Card")]
    assert [r.reject_reason for r in bad.collect()] == ["malformed_record"]


_text = st.text(alphabet=list('ab ,"\n;\\é'), min_size=1, max_size=12)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.dates(dt.date(1990, 1, 1), dt.date(2030, 12, 31)),
                          st.one_of(st.none(), _text), st.one_of(st.none(), _text),
                          st.one_of(st.none(), _text), st.one_of(st.none(), st.booleans())),
                min_size=1, max_size=20))
def test_extract_roundtrip_with_hostile_text(spark, rows):
    from casegrid.session import scratch_path
    base = scratch_path(spark, "hyp-csv")
    df = spark.createDataFrame(rows, S.CASE_SCHEMA)
    sinks.csv_writer(C.to_source_layout(df)).csv(base + "/csv")
    good, bad = C.read_complaints(spark, base + "/csv", base + "/landed")
    assert bad.count() == 0
    got = sorted(map(tuple, good.select(*S.CASE_SCHEMA.fieldNames()).collect()), key=repr)
    assert got == sorted(map(tuple, df.collect()), key=repr)


def test_literal_dimension_queried_by_name(spark):
    from casegrid.sources.dims import population_table, register
    register(population_table(spark), "population_dim")
    r = spark.sql("SELECT COUNT(*) AS n, SUM(population) AS total FROM population_dim").first()
    assert r.n == 49 and r.total == sum(S.POPULATION_VALUES)


def test_headers_with_the_same_snake_case_name(spark, tmpdir_path):
    os.makedirs(tmpdir_path, exist_ok=True)
    p = os.path.join(tmpdir_path, "dup.csv")
    with open(p, "w") as f:
        f.write("State,ZIP code,Zip-Code\nTX,1,2\n")
    good, _ = C.read_complaints(spark, p, tmpdir_path + "/landed")
    assert good.columns == ["state", "zip_code", "zip_code_2"]
    assert [tuple(r) for r in good.collect()] == [("TX", "1", "2")]


def test_file_with_reordered_header_fails_loudly(spark, tmpdir_path):
    os.makedirs(tmpdir_path + "/x")
    with open(tmpdir_path + "/x/a.csv", "w") as f:
        f.write("State,Product\nTX,Card\n")
    with open(tmpdir_path + "/x/b.csv", "w") as f:
        f.write("Product,State\nLoan,CA\n")            # same columns, other order
    with pytest.raises(Exception):
        C.read_complaints(spark, tmpdir_path + "/x", tmpdir_path + "/landed",
                          multiline=True)


# One file with quoted newlines is split over tasks ----------------------------

def test_split_read_equals_multiline_read(spark, tmp_path):
    import random
    rng = random.Random(1)
    for f in range(2):
        with open(tmp_path / f"f{f}.csv", "w", newline="") as out:
            out.write("Date received,Note,Product\n")
            for i in range(800):
                note = rng.choice(["plain", 'with "q" in', "line one\nline two", "a,b", "\n\n", "",
                                   "long " + "x" * rng.randint(0, 200), "end\r\nwin", "many\n" * rng.randint(1, 60)])
                if rng.random() < 0.04:
                    out.write(rng.choice([f"{i},only two\n", f"{i},a,b,c too many\n"]))
                else:
                    quoted = note.replace('"', '""')
                    out.write(f'2020-01-{i % 28 + 1:02d},"{quoted}",p{i}\n')
    path = str(tmp_path)
    columns = C.header_columns(spark, path)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16000")
    try:
        lines = spark.read.option("lineSep", "\n").text(path)
        assert lines.select(F.spark_partition_id()).distinct().count() > 4
        got = sorted(map(tuple, C.read_raw(spark, path, columns).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    whole = (C._csv_reader(spark, True).schema(C.raw_schema(columns)).option("enforceSchema", False)
             .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", C.CORRUPT).csv(path))
    assert got == sorted(map(tuple, whole.collect()), key=repr) and len(got) == 1600


@pytest.mark.parametrize("stray", ['2020-01-01,5" pipe,TX', '2020-01-01,say "hi" there,TX', '2020-01-01,"a"b,TX', '2020-01-01, "x",TX', '2020-01-01,"never closed,TX'])
def test_stray_quotes_read_as_by_spark(spark, tmp_path, stray):
    for name, odd in (("plain.csv", ""), ("odd file.csv", stray + "\n")):
        with open(tmp_path / name, "w", newline="") as out:
            out.write("Date received,Note,State\n" + "".join(f'2020-01-{i % 28 + 1:02d},"line ""{i}""\nmore",TX\n2020-02-01,,""\n' for i in range(150))
                      + odd + "".join(f"2020-03-01,after {i},CA\n" for i in range(300)) + '2020-04-01,"two\nlines",WA\n')
    path = str(tmp_path)
    columns = C.header_columns(spark, path)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        assert [f.rsplit("/", 1)[1][:3] for f in C.odd_files(spark, path)] == ["odd"]
        got = sorted(map(tuple, C.read_raw(spark, path, columns).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    whole = (C._csv_reader(spark, True).schema(C.raw_schema(columns)).option("enforceSchema", False)
             .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", C.CORRUPT).csv(path))
    assert got == sorted(map(tuple, whole.collect()), key=repr)
    if "5" in stray:
        assert sum(r[2] == "CA" for r in got) == 600


# Strict read-back and series load ----------------------------------------------

def test_export_read_back_is_strict(spark, tmp_path):
    from casegrid.plans.sinks import read_report_csv
    schema = S.PRODUCT_STATE_SCHEMA
    for name, text in (("order", "state,product,complaints,relief_rate\nTX,A,1,2.0\n"),
                       ("count", "product,state,complaints,relief_rate\nA,TX,many,2.0\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "f.csv").write_text(text)
        with pytest.raises(Exception):  # noqa: B017 - Spark wraps the reason
            read_report_csv(spark, str(tmp_path / name), schema).collect()


@pytest.mark.parametrize("line", ["2020-13-01,1.5", "2020-01-01,3;1", "soon,2"])
def test_series_value_that_does_not_parse_fails(spark, tmp_path, line):
    from casegrid.sources.series import load_series
    (tmp_path / "s.csv").write_text(f"date,value\n2019-01-01,1.0\n{line}\n")
    with pytest.raises(Exception, match="does not parse"):
        load_series(spark, str(tmp_path / "s.csv")).collect()


def test_series_missing_values_are_dropped(spark, tmp_path):
    from casegrid.sources.series import load_series
    (tmp_path / "s.csv").write_text("date,value\n2019-01-01,1.0\n2019-04-01,\n,2.0\n")
    assert [r.delinquency_rate for r in load_series(spark, str(tmp_path / "s.csv")).collect()] == [1.0]


# The split reader against Spark's own, whatever the quotes ------------------------

def _both_readers(spark, path, split_bytes, fragment_bytes=C.FRAGMENT_BYTES):
    columns = C.header_columns(spark, path)
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes"), C.FRAGMENT_BYTES
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    default = C.read_records.__defaults__
    C.read_records.__defaults__ = (fragment_bytes,)
    try:
        got = sorted(map(tuple, C.read_raw(spark, path, columns).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep[0])
        C.read_records.__defaults__ = default
    return got, sorted(map(tuple, C._whole_files(spark, path, columns, multiline=True).collect()), key=repr)


_piece = st.sampled_from(["a", "bc", " ", "é", '"', '""', '"""', ",", "\n", ',"', '",', '"\n', '\n"', "x" * 30, '"q, r\ns"', ',"t",'])


@settings(max_examples=10, deadline=None)
@given(st.lists(_piece, min_size=1, max_size=40), st.sampled_from([40, 97, 400]), st.sampled_from([0, 60, 1 << 20]))
def test_any_quotes_read_as_by_spark(spark, pieces, split_bytes, fragment_bytes):
    from casegrid.session import scratch_path
    path = scratch_path(spark, "hyp-quotes")
    os.makedirs(path)
    with open(path + "/f.csv", "w", newline="") as f:
        f.write("A,B,C\n" + "".join(pieces) + "\nlast,1,2\n")
    got, want = _both_readers(spark, path, split_bytes, fragment_bytes)
    # What Spark's reader makes of doubled quotes in a field with a stray one depends on the
    # records before it, so quotes are left out; where records and fields end is the same.
    bare = lambda rows: sorted((tuple(v and v.replace('"', "") for v in r) for r in rows), key=repr)
    assert bare(got) == bare(want)


def test_record_over_many_splits(spark, tmp_path):
    long = "\n".join(f'row {i} ""quoted"", x' for i in range(3000))
    (tmp_path / "f.csv").write_text(f'A,B\n1,"{long}"\n2,b\n3,"{long}"\n4,"unclosed\n5,c\n')
    for limit in (1 << 20, 500):
        got, want = _both_readers(spark, str(tmp_path), 4000, limit)
        assert got == want and len(got) == 4


def test_reader_scans_text_twice_and_shuffles_no_lines(spark, tmp_path):
    import contextlib
    import io
    (tmp_path / "f.csv").write_text('A,B\n' + '1,"two\nlines"\n' * 500)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            C.read_raw(spark, str(tmp_path)).explain("simple")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    plan = out.getvalue()
    assert plan.count("FileScan text") == 1          # the other scan made the table of splits
    # Between the scan and the union: nothing but a broadcast join and the narrow pass.
    union, scan = plan.index("Union"), plan.index("FileScan text")
    depth = next(x for x in plan.splitlines() if "FileScan text" in x).index("FileScan")
    above = [x for x in plan[union:scan].splitlines()[1:] if 0 < len(x) - len(x.lstrip(" :+-")) < depth]
    assert "MapInArrow" in "".join(above) and "BroadcastHashJoin" in "".join(above)
    assert not any("Exchange hash" in x or "Window" in x or "Sort" in x for x in above[:next(i for i, x in enumerate(above) if "BroadcastHashJoin" in x) + 1])


# Each file is read by the cheapest way that reads it whole and right --------------

def test_files_without_quotes_and_small_ones_need_no_split_reader(spark, tmp_path, monkeypatch):
    rows = "".join(f"{i},x\n\n" for i in range(400))
    texts = {"plain.csv": "A,B\n" + rows, "a [1] {b}*.csv": "A,B\n" + rows, "crlf.csv": "A,B\r\n1,x\r\n", "white.csv": "A,B\n \n1,x\n",
             "quoted.csv": 'A,B\n1,"two\nlines"\n', "empty.csv": "", "large.csv": "A,B\n" + '1,"two\nlines"\n' * 1500}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, newline="")
    path, read = str(tmp_path), []
    monkeypatch.setattr(C, "read_records", lambda spark, path, old=C.read_records: read.extend(path) or old(spark, path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        by_line, whole, large = ([f.rsplit("/", 1)[1] for f in way] for way in C._ways(spark, path))
        got = sorted(map(tuple, C.read_raw(spark, path, ["A", "B"]).collect()), key=repr)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert by_line == [r"a \[1\] \{b\}\*.csv", "plain.csv"] and whole == ["crlf.csv", "quoted.csv", "white.csv"]
    assert large == ["large.csv"] and [f.rsplit("/", 1)[1] for f in read] == ["large.csv"]
    want = C._whole_files(spark, path, ["A", "B"], multiline=True).collect()
    assert got == sorted(map(tuple, want), key=repr) and len(got) == 400 * 2 + 1500 + 4
