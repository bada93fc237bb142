"""Tolerant CSV ingest of the complaints extract.

Three steps, each a plain Spark job:

1. **Land**: read the CSV with every column as a string plus a corrupt
   record column (``PERMISSIVE``), and write it as Parquet. A file without quotes is read
   line by line, over all its splits; of the others, small ones in a task each and large ones
   with quoted newlines by as many tasks as they have splits (``read_records``), whatever
   their quotes.
   Each row is tagged in the same pass with a rejection reason (malformed
   record, unparsable date, unparsable Yes/No flag).
2. **Type**: rename the queried columns to snake_case and parse the date and
   the flag with ``try_*`` casts.
3. **Split** on the stored reason: good rows -> typed case table, rejected
   rows -> quarantine (a pushed-down ``IS NOT NULL`` that skips clean row
   groups, so the quarantine pass reads next to nothing).

The published load silently drops rows its sniffer cannot parse; here they are
kept in a quarantine table instead, and counts are taken from the written
tables (a lazily read CSV only validates the columns a query touches).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casegrid import schema as S
from casegrid.session import scratch_path
from casegrid.sources.infer import infer_types, parsed, type_map

CORRUPT = "_corrupt_record"
REASON = "reject_reason"


def _csv_reader(spark: SparkSession, multiline: bool):
    return (spark.read.option("header", True).option("multiLine", multiline)
            .option("escape", '"').option("quote", '"'))


def header_columns(spark: SparkSession, path: str | list[str], multiline: bool = True) -> list[str]:
    """Column names from the header (no type inference, no data scan)."""
    return _csv_reader(spark, multiline).option("inferSchema", False).csv(path).columns


def snake(name: str) -> str:
    """Snake-case name for a source column (the five queried ones use fixed names)."""
    if name in S.SOURCE_COLUMNS:
        return S.SOURCE_COLUMNS[name]
    return re.sub(r"[^0-9a-z]+", "_", name.strip().lower()).strip("_") or "col"


def raw_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType(), True) for c in columns]
                        + [T.StructField(CORRUPT, T.StringType(), True)])


# Splitting one file over tasks ------------------------------------------------
#
# A line either begins a record (OUT) or lies inside a quoted field (IN), and the state after a
# line follows from the state before it. So a split of a file maps a state to a state, whatever
# comes before it; composing those maps over the splits gives every split its own start state.
# Quotes are read as Spark's CSV reader does: they open a field only at its first character, are
# doubled inside, and after the closing one whatever follows goes on to the next delimiter.

OUT, IN = 0, 1
#: Bytes of a record's part that the first pass keeps of a split; longer parts take a third scan.
FRAGMENT_BYTES = 1 << 20

_INSIDE = rb'[^"]*+(?:""[^"]*+)*+'
_FIELD = rb'(?:"' + _INSIDE + rb'"[^,\n]*+|[^",\n][^,\n]*+)?+'
_RECORD = re.compile(_FIELD + rb"(?:," + _FIELD + rb")*+\n")
_REST = re.compile(_INSIDE + rb'"[^,\n]*+(?:,' + _FIELD + rb")*+\n")      # of a record, from inside quotes
# The same with all quotes as RFC 4180 has them, or with the last one not closed.
_RFC = rb'(?:"' + _INSIDE + rb'"|(?!")[^",\n]*+)'
_END = rb'(?:\r?\n|,?(?<![^,\n])"' + _INSIDE + rb"\Z)"
_RFC_RECORD = re.compile(rb"(?:" + _RFC + rb"(?:," + _RFC + rb")*+)?+" + _END)
_RFC_REST = re.compile(_INSIDE + rb'(?:\Z|"(?:,' + _RFC + rb")*+" + _END + rb")")


def _starts(text: bytes, state: int, known: list[int] | None = None, after: int = OUT) -> tuple[list[int], int]:
    """(where in ``text``, whole lines, a record begins; the state at its end). From where it meets a
    start of ``known`` it goes on as that, to the state ``after``."""
    pos, starts = 0, []
    if state == IN:
        rest = _REST.match(text)
        if not rest:
            return [], IN
        pos = rest.end()
    while pos < len(text):
        if known is not None:
            i = bisect_left(known, pos)
            if i < len(known) and known[i] == pos:
                return starts + known[i:], after
        starts.append(pos)
        record = _RECORD.match(text, pos)
        if not record:
            return starts, IN
        pos = record.end()
    return starts, OUT


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Stretches of lines of one split, in order, and whether each begins a new split."""
    last = None
    for batch in batches:
        file, block = batch.column("file").to_numpy(), batch.column("block").to_numpy()
        cuts = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(file)], strict=True):
            if i < j:
                new = (file[i], block[i]) != last
                last = (file[i], block[i])
                yield batch.slice(i, j - i), new


def _text(run: pa.RecordBatch) -> bytes:
    return b"\n".join([*run.column("value").to_pylist(), b""])


def _blank(record: bytes) -> bool:
    return record in (b"\n", b"\r\n")


class _Part:
    """Text of a record that may go on beyond the split, given up as ``None`` above a size."""

    def __init__(self, limit: int, text: bytes = b""):
        self.limit, self.size, self.texts = limit, 0, []
        self.add(text)

    def add(self, text: bytes) -> None:
        self.size += len(text)
        self.texts = [*self.texts, text] if self.size <= self.limit else None

    def whole(self) -> bytes | None:
        return None if self.texts is None else b"".join(self.texts)


class _Summary:
    """What the first pass finds out about one split, for either start state."""

    FIELDS = (("file", pa.int64()), ("block", pa.int64()), ("file_size", pa.int64()), ("bytes", pa.int64()), ("to_out", pa.int32()), ("to_in", pa.int32()),
              ("opens_in", pa.bool_()), ("stray_out", pa.bool_()), ("stray_in", pa.bool_()), ("head", pa.binary()),
              ("tail_out", pa.binary()), ("tail_in", pa.binary()), ("header_out", pa.bool_()), ("name", pa.string()))

    def __init__(self, file: int, block: int, file_size: int, name: str | None, limit: int, strays: bool):
        self.file, self.block, self.file_size, self.name, self.limit, self.strays = file, block, file_size, name, limit, strays
        self.bytes, self.state, self.stray, self.blank = 0, [OUT, IN], [False, False], True
        self.head, self.opened = _Part(limit), [False, False]
        self.tail, self.tail_is_first = [None, None], False

    def add(self, text: bytes) -> None:
        self.bytes += len(text)
        known, end = None, OUT
        for h in (OUT, IN):
            begin = self.state[h]
            known, end = starts, self.state[h] = _starts(text, begin, known, end)
            if self.strays and not self.stray[h]:
                self.stray[h] = self._has_stray(text, begin, starts)
            if h == IN and not self.opened[h]:
                self.head.add(text[:starts[0]] if starts else text)
            if end == OUT:
                self.tail[h] = None
            elif starts:
                self.tail[h] = _Part(self.limit, text[starts[-1]:])
                if h == OUT:
                    # A record is the file's first if only empty lines come before it.
                    self.tail_is_first = self.blank and not text[:starts[-1]].strip(b"\r\n")
            elif self.tail[h] is not None:
                self.tail[h].add(text)
            self.opened[h] |= len(starts) > 0
        self.blank = self.blank and not text.strip(b"\r\n")

    @staticmethod
    def _has_stray(text: bytes, begin: int, starts: list[int]) -> bool:
        ends = [*starts[1:], len(text)]
        if begin == IN and not _RFC_REST.fullmatch(text, 0, starts[0] if starts else len(text)):
            return True
        return not all(_RFC_RECORD.fullmatch(text, i, j) for i, j in zip(starts, ends, strict=False))

    def row(self) -> dict:
        whole = lambda part: b"" if part is None else part.whole()
        row = (self.file, self.block, self.file_size, self.bytes, *self.state, self.opened[IN], *self.stray, self.head.whole(),
               whole(self.tail[OUT]), whole(self.tail[IN]), self.block == 0 and self.tail_is_first, self.name)
        return dict(zip([name for name, _ in self.FIELDS], row, strict=True))


def _text_lines(spark: SparkSession, path: str | list[str], names: bool = False) -> DataFrame:
    """The lines at ``path`` in their order, under the split that they begin in (with ``names``, the first one's
    have the file's path)."""
    name = F.when(F.col("_metadata.file_block_start") == 0, F.col("_metadata.file_path")) if names else F.lit(None).cast("string")
    return (spark.read.option("lineSep", "\n").text(path)
            .select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.col("_metadata.file_size").alias("file_size"), name.alias("name"), F.col("value").cast("binary").alias("value")))


def _summaries(spark: SparkSession, path: str | list[str], limit: int, strays: bool = False) -> DataFrame:
    """A row per split (``_Summary``), found in one pass over the lines."""
    schema = pa.schema(_Summary.FIELDS)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = None
        for run, new in _runs(batches):
            if new:
                if split:
                    yield pa.RecordBatch.from_pylist([split.row()], schema)
                split = _Summary(*(run.column(c)[0].as_py() for c in ("file", "block", "file_size", "name")), limit, strays)
            split.add(_text(run))
        if split:
            yield pa.RecordBatch.from_pylist([split.row()], schema)

    types = {pa.int64(): "long", pa.int32(): "int", pa.bool_(): "boolean", pa.binary(): "binary", pa.string(): "string"}
    return _text_lines(spark, path, strays).mapInArrow(summarise, ", ".join(f"{f.name} {types[f.type]}" for f in schema))


def _split_states(summaries: DataFrame) -> DataFrame:
    """(file, block, state, after, opened, record) per split: the states before and after it, whether a
    record begins in it, and the split that the record open at its start begins in.

    A split's map either has one value, keeps the state or swaps it, so the state is the last single
    value before, swapped as often as splits since then do. The windows are over rows of splits.
    """
    swap = ((F.col("to_out") == IN) & (F.col("to_in") == OUT)).cast("long")
    fixed = F.when(F.col("to_out") == F.col("to_in"), F.col("to_out"))
    order = Window.partitionBy("file").orderBy("block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = summaries.select("file", "block", "file_size", "bytes", "to_out", "to_in", "opens_in", "stray_out", "stray_in", "name", fixed.alias("fixed"), swap.alias("swap"))
    rows = rows.withColumn("swaps", F.sum("swap").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    since = F.coalesce(F.last(F.when(F.col("fixed").isNotNull(), F.col("swaps")), ignorenulls=True).over(earlier), F.lit(0))
    state = (F.coalesce(F.last("fixed", ignorenulls=True).over(earlier), F.lit(OUT)) + F.coalesce(F.last("swaps").over(earlier), F.lit(0)) - since) % 2
    rows = rows.withColumn("state", state.cast("int"))
    opened = (F.col("state") == OUT) | F.col("opens_in")
    rows = rows.withColumns({"opened": opened, "after": F.when(F.col("state") == OUT, F.col("to_out")).otherwise(F.col("to_in")),
                             "stray": F.when(F.col("state") == OUT, F.col("stray_out")).otherwise(F.col("stray_in"))})
    return rows.withColumn("record", F.last(F.when(F.col("opened"), F.col("block")), ignorenulls=True).over(earlier))


def odd_files(spark: SparkSession, path: str) -> list[str]:
    """The files at ``path`` that have a quote elsewhere than around a field or doubled in a
    quoted one, or an unclosed one (a report for the user: the load reads them like any other)."""
    splits = _split_states(_summaries(spark, path, 0, strays=True))
    files = splits.groupBy("file").agg(F.max("stray").alias("stray"), F.max_by("after", "block").alias("after"), F.max("name").alias("name"))
    return sorted(r["name"] for r in files.where(F.col("stray") | (F.col("after") == IN)).select("name").collect())     # a row per file


def _lines_with_state(spark: SparkSession, path: str | list[str], states: DataFrame) -> DataFrame:
    """Lines with the state and the open record of their split. Only splits that begin inside quotes
    have a row to join: 24 bytes for each ``spark.sql.files.maxPartitionBytes`` of text, 20 MB for 100 TB."""
    inside = F.broadcast(states.where(F.col("state") == IN).select("file", "block", "state", "record"))
    return _text_lines(spark, path).join(inside, ["file", "block"], "left")


def _records(spark: SparkSession, path: str | list[str], states: DataFrame) -> DataFrame:
    """(is_header, text) of the records that lie whole in a split, each with its line end. A narrow
    pass: no line is shuffled."""
    schema = pa.schema([("is_header", pa.bool_()), ("text", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, part, first = OUT, None, False
        for run, new in _runs(batches):
            text = _text(run)
            if new:
                state, part, first = run.column("state")[0].as_py() or OUT, None, run.column("block")[0].as_py() == 0
            # ``part``: texts of the open record, if it began in this split.
            starts, after = _starts(text, state)
            if state == IN and part is not None:
                part.append(text[:starts[0]] if starts else text)
                if starts or after == OUT:
                    yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([b"".join(part)], pa.binary())], schema=schema)
                    part, first = None, False
            state = after
            offsets = np.array([*starts, len(text)] if after == OUT else starts, np.int32)
            if after == IN and starts:
                part = [text[starts[-1]:]]
            n = len(offsets) - 1
            if n > 0:
                header = np.zeros(n, bool)
                for i in range(n if first else 0):
                    if not _blank(text[offsets[i]:offsets[i + 1]]):
                        header[i], first = True, False
                        break
                yield pa.RecordBatch.from_arrays([pa.array(header), pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(text)])], schema=schema)

    return _lines_with_state(spark, path, states).select("file", "block", "value", "state").mapInArrow(cut, "is_header boolean, text binary")


def _fragments(spark: SparkSession, path: str | list[str], states: DataFrame) -> DataFrame:
    """(file, record, block, is_header, text) of the parts of the records that run over splits, of any size."""
    schema = pa.schema([("file", pa.int64()), ("record", pa.int64()), ("block", pa.int64()), ("is_header", pa.bool_()), ("text", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = tail = None
        file = block = record = None
        state, blank, is_header = OUT, True, False

        def parts() -> Iterator[pa.RecordBatch]:
            rows = [(record, False, head)] if head is not None else []
            rows += [(block, is_header, tail)] if tail is not None else []
            if rows:
                yield pa.RecordBatch.from_pylist([{"file": file, "record": r, "block": block, "is_header": h, "text": b"".join(t)} for r, h, t in rows], schema)

        for run, new in _runs(batches):
            text = _text(run)
            if new:
                yield from parts()
                file, block, record, state = (run.column(c)[0].as_py() for c in ("file", "block", "record", "state"))
                state = state or OUT
                head, tail, begun, blank = ([] if state == IN else None), None, state == OUT, block == 0
            starts, after = _starts(text, state)
            if state == IN:
                (tail if begun else head).append(text[:starts[0]] if starts else text)
            begun = begun or len(starts) > 0
            if after == IN and starts:
                tail, is_header = [text[starts[-1]:]], blank and not text[:starts[-1]].strip(b"\r\n")
            elif after == OUT:
                tail = None
            blank = blank and not text.strip(b"\r\n")
            state = after
        yield from parts()

    lines = _lines_with_state(spark, path, states).select("file", "block", "value", "state", "record")
    return lines.mapInArrow(cut, "file long, record long, block long, is_header boolean, text binary")


def read_records(spark: SparkSession, path: str | list[str], fragment_bytes: int = FRAGMENT_BYTES) -> DataFrame:
    """(is_header, record): the text of every CSV record, quoted newlines included, split as
    Spark's multi-line CSV reader does, but by as many tasks as the files have splits.

    The text is scanned twice: once for a row per split, once for the records. Records that
    run over splits are put together from the parts that the first pass kept; only those
    parts are shuffled. If one of them is over ``fragment_bytes``, a third scan fetches them.
    """
    found = scratch_path(spark, "csv-splits")
    _summaries(spark, path, fragment_bytes).write.parquet(found)
    summaries = spark.read.parquet(found)
    states = _split_states(summaries)
    texts = (summaries.select("file", "block", "head", "tail_out", "tail_in", "header_out")
             .join(states.select("file", "block", "state", "after", "opened", "record"), ["file", "block"]))
    tail = F.when(F.col("state") == OUT, F.col("tail_out")).otherwise(F.col("tail_in"))
    heads = texts.where(F.col("state") == IN).select("file", "record", "block", F.lit(False).alias("is_header"), F.col("head").alias("text"))
    tails = texts.where((F.col("after") == IN) & F.col("opened")).select("file", F.col("block").alias("record"), "block",
                                                                        ((F.col("state") == OUT) & F.col("header_out")).alias("is_header"), tail.alias("text"))
    parts = heads.union(tails)
    if parts.where("text is null").limit(1).count():
        parts = _fragments(spark, path, states)
    # Text that no quote closes ends with the file, its last newline included if it has one.
    ends = states.groupBy("file").agg(F.max_by("after", "block").alias("after"), F.max_by(F.when(F.col("opened"), F.col("block")).otherwise(F.col("record")), "block").alias("record"),
                                      (F.sum("bytes") == F.max("file_size")).alias("newline"))
    unclosed = ends.where((F.col("after") == IN) & F.col("newline")).select("file", "record", F.lit(True).alias("to_end"))
    joined = (parts.groupBy("file", "record").agg(F.max("is_header").alias("is_header"), F.array_sort(F.collect_list(F.struct("block", F.col("text").cast("string").alias("text")))).alias("parts"))
              .join(unclosed, ["file", "record"], "left"))
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    without_end = lambda c: F.regexp_replace(c, r"\r?\n\z", "")
    whole = _records(spark, path, states).select("is_header", without_end(F.col("text").cast("string")).alias("record"))
    joined = joined.select("is_header", F.when(F.col("to_end"), text).otherwise(without_end(text)).alias("record"))
    return whole.union(joined).where("record <> ''")


def _read_split(spark: SparkSession, path: str | list[str], columns: list[str]) -> DataFrame:
    """``read_raw`` through ``read_records``."""
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    schema = ", ".join(f"`{c}` string" for c in [*columns, CORRUPT])
    header = F.from_csv("record", ", ".join(f"`{c}` string" for c in columns), {**options, "mode": "FAILFAST"})
    # Spark's own readers tell names apart by case only if the session does.
    name = F.lower if spark.conf.get("spark.sql.caseSensitive") == "false" else lambda c: c
    same = lambda h: F.array(*[name(h[c]) for c in columns]) == F.array(*[name(F.lit(c)) for c in columns])
    checked = F.when(F.col("is_header"), F.when(same(header), F.lit(False)).otherwise(F.raise_error(
        F.concat(F.lit("unexpected CSV header: "), F.col("record"))).cast("boolean"))).otherwise(F.lit(True))
    records = read_records(spark, path)
    return records.where(checked).select(F.from_csv("record", schema, options).alias("r")).select("r.*")


def _whole_files(spark: SparkSession, path: str | list[str], columns: list[str], multiline: bool) -> DataFrame:
    return (_csv_reader(spark, multiline).schema(raw_schema(columns))
            .option("enforceSchema", False)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
            .csv(path))


def literal_path(path: str) -> str:
    """``path`` as a path to read: what stands for other names in it is escaped."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


#: The largest file that one task reads whole, unless a split is larger.
WHOLE_BYTES = 1 << 30


def _ways(spark: SparkSession, path: str | list[str]) -> tuple[list[str], list[str], list[str]]:
    """The files at ``path`` that hold text, as those to be read by lines, whole, and by ``read_records``.

    In a file without a quote or a carriage return every line is a record, and Spark's reader splits it
    by itself (lines of white space alone, which it drops, count as quotes do). Of the others
    ``read_records`` takes those that would hold a task much longer than the rest: it needs several times
    the CPU seconds of Spark's reader, so up to twice a core's share of all bytes is read whole.
    """
    value = F.col("value")
    by_line = (value == "") | (value.rlike(r"[^\x00-\x20]") & ~value.contains('"') & ~value.contains("\r"))
    # A row per file comes to the driver.
    files = (spark.read.option("lineSep", "\n").text(path)
             .groupBy(F.col("_metadata.file_path").alias("name"), F.col("_metadata.file_size").alias("bytes"))
             .agg(F.count_if(~by_line).alias("odd")).collect())
    share = sum(f["bytes"] for f in files) // spark.sparkContext.defaultParallelism
    split = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    limit = max(split, min(WHOLE_BYTES, 2 * share))
    ways: tuple[list[str], list[str], list[str]] = ([], [], [])
    for f in sorted(files, key=lambda f: f["name"]):
        ways[0 if not f["odd"] else 1 if f["bytes"] <= limit else 2].append(literal_path(unquote(f["name"])))    # the name is a URI
    return ways


def read_raw(spark: SparkSession, path: str | list[str], columns: list[str] | None = None,
             multiline: bool = True) -> DataFrame:
    """All-string read; malformed records (wrong field count) keep their text in
    ``_corrupt_record``. Every file's header is checked against ``columns``
    (``enforceSchema=false``): a file whose columns are reordered or renamed
    fails the load instead of being read into the wrong columns."""
    columns = columns or header_columns(spark, path, multiline)
    if not multiline:
        return _whole_files(spark, path, columns, multiline)
    by_line, whole, large = _ways(spark, path)
    found = [_whole_files(spark, by_line, columns, multiline=False)] if by_line else []
    found += [_whole_files(spark, whole, columns, multiline=True)] if whole else []
    found += [_read_split(spark, large, columns)] if large else []
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], raw_schema(columns))


def _source_of(columns: list[str], name: str) -> str | None:
    return next((c for c in columns if snake(c) == name), None)


def _parse_date(src, date_format: str):
    return F.try_to_date(src, date_format)


def with_reject_reason(raw: DataFrame, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """Add ``reject_reason`` from the raw string columns (NULL = good row):
    malformed record, unparsable date, unparsable Yes/No flag."""
    if REASON in raw.columns:
        return raw
    reason = F.when(F.col(CORRUPT).isNotNull(), F.lit("malformed_record"))
    date_src = _source_of(raw.columns, "date_received")
    if date_src:
        d = F.col(f"`{date_src}`")
        reason = reason.when(d.isNotNull() & _parse_date(d, date_format).isNull(),
                             F.lit("bad_date"))
    flag_src = _source_of(raw.columns, "timely_response")
    if flag_src:
        t = F.col(f"`{flag_src}`")
        reason = reason.when(t.isNotNull() & t.try_cast("boolean").isNull(), F.lit("bad_timely"))
    return raw.withColumn(REASON, reason)


def land(raw: DataFrame, staging_path: str, date_format: str = "yyyy-MM-dd") -> None:
    """Write the raw string table once (step 1), with each row's rejection
    reason. All columns are selected, so every record is fully parsed and
    validated; later passes filter on the stored reason, which Parquet
    statistics can skip on (almost every row group has no rejected row)."""
    with_reject_reason(raw, date_format).write.mode("overwrite").parquet(staging_path)


def typed(raw: DataFrame, date_format: str = "yyyy-MM-dd", types: dict[str, str] | None = None) -> DataFrame:
    """Rename and type the landed rows; keep ``reject_reason`` (NULL = good row). ``types``: the types of
    further columns by header name (``infer.type_map``); all others stay text."""
    raw = with_reject_reason(raw, date_format)
    out, used = [], set()
    for c in raw.columns:
        if c in (CORRUPT, REASON):
            continue
        name = snake(c)
        base, k = name, 2
        while name in used:            # two headers with the same snake-case name
            name, k = f"{base}_{k}", k + 1
        used.add(name)
        src = F.col(f"`{c}`")
        if name == "date_received":
            out.append(_parse_date(src, date_format).alias(name))
        elif name == "timely_response":
            out.append(src.try_cast("boolean").alias(name))
        elif types and types.get(c, "string") != "string":
            out.append(parsed(F.nullif(src, F.lit("")), types[c]).alias(name))
        else:
            out.append(src.alias(name))
    return raw.select(*out, F.col(CORRUPT), F.col(REASON))


def split(typed_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    good = typed_rows.filter(F.col(REASON).isNull()).drop(REASON, CORRUPT)
    bad = typed_rows.filter(F.col(REASON).isNotNull())
    return good, bad


def read_complaints(spark: SparkSession, csv_path: str, staging_path: str,
                    date_format: str = "yyyy-MM-dd", multiline: bool = True, infer: bool = False,
                    ) -> tuple[DataFrame, DataFrame]:
    """Land the CSV once, then return (good typed rows, rejected rows), both lazy
    over the landed Parquet. ``infer``: the columns that no report reads get the narrowest type
    that all values of the good rows have (one more pass over the landed columns)."""
    land(read_raw(spark, csv_path, multiline=multiline), staging_path, date_format)
    landed = spark.read.parquet(staging_path)
    return split(typed(landed, date_format, type_map(landed_types(landed)) if infer else None))


def landed_types(landed: DataFrame) -> DataFrame:
    """``infer.infer_types`` of the good rows' columns but those with a type or meaning of their own."""
    fixed = {CORRUPT, REASON}
    columns = [c for c in landed.columns if c not in fixed and snake(c) not in S.SOURCE_COLUMNS.values()]
    return infer_types(landed.where(F.col(REASON).isNull()), columns)


def to_source_layout(cases: DataFrame) -> DataFrame:
    """Case rows back in the extract's layout: source header names, Yes/No flag,
    ISO dates (the shape the CSV reader expects; used for exports and tests)."""
    inv = {v: k for k, v in S.SOURCE_COLUMNS.items()}
    cols = []
    for c in cases.columns:
        if c == "timely_response":
            cols.append(F.when(F.col(c), F.lit("Yes")).when(~F.col(c), F.lit("No"))
                        .alias(inv[c]))
        elif c == "date_received":
            cols.append(F.date_format(c, "yyyy-MM-dd").alias(inv[c]))
        else:
            cols.append(F.col(c).alias(inv.get(c, c)))
    return cases.select(*cols)
