"""Column types of an extract, found in one pass over its text columns.

Types form chains: every value of a narrower type is also one of the wider, up to text.
``boolean`` stands alone, ``bigint`` < ``double``, ``date`` < ``timestamp``. A column gets the
first type of ``TYPES`` to which all its non-empty values parse (or all but a share of
``tolerance``, the rest being rejected by the load); a column without values stays text.

The pass is one aggregate of counts per column and kind of value, so partial results merge in any order and nothing but
a row per column leaves it. What parses is fixed by a pattern and a cast, not by a sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What each type's text looks like. A cast must succeed as well (29 February, range).
PATTERNS = {
    "boolean": r"^(?i:true|false|yes|no)$",
    "bigint": r"^[+-]?[0-9]{1,19}$",
    "double": r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]{1,3})?$",
    "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
    "timestamp": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?)?$",
}
TYPES = tuple(PATTERNS)
_CAST = {"timestamp": "timestamp_ntz"}


def parsed(value: Column, kind: str) -> Column:
    """The text as a value of ``kind``, null where it is none."""
    return F.when(F.regexp_like(value, F.lit(PATTERNS[kind])), value.try_cast(_CAST.get(kind, kind)))


def _filled(c: str) -> Column:
    """A column's text; empty text is no value."""
    return F.nullif(F.col(f"`{c}`"), F.lit(""))


#: Types of which every value is one of the wider type too.
_WITHIN = {"double": ("bigint",), "timestamp": ("date",)}
_PLACE = {kind: i for i, kind in enumerate(TYPES)}


def _narrowest(value: Column) -> Column:
    """The place in ``TYPES`` of the narrowest type that the text is a value of, -1 for none, null without text.

    What its first characters and its length rule out is not matched. (A pattern's end also stands
    before a last line end of up to two characters.)"""
    first = F.substring(value, 1, 1)
    dated = F.substring(value, 5, 1) == "-"
    may_be = {"boolean": first.isin(*"tTfFyYnN") & (F.length(value) <= 7),
              "bigint": first.isin(*"+-0123456789") & ~dated, "double": first.isin(*"+-.0123456789"),
              "date": dated & (F.length(value) <= 12), "timestamp": dated}
    kind = F.when(value.isNull(), F.lit(None).cast("int"))
    for name in ("bigint", "date", "timestamp", "double", "boolean"):
        kind = kind.when(may_be[name] & parsed(value, name).isNotNull(), F.lit(_PLACE[name]))
    return kind.otherwise(F.lit(-1))


def infer_types(raw: DataFrame, columns: list[str] | None = None, tolerance: float = 0.0) -> DataFrame:
    """(column_name, column_type, n_values, n_missing, n_bad) per text column of ``raw``; ``n_bad`` counts
    values that are not of the type (0 unless ``tolerance`` lets some be)."""
    columns = columns or [f.name for f in raw.schema.fields if f.dataType.simpleString() == "string"]
    spark = raw.sparkSession
    schema = "column_name string, column_type string, n_values long, n_missing long, n_bad long"
    if not columns:
        return spark.createDataFrame([], schema)
    # Names by position: two headers may differ in case only. A row per value keeps the generated code as
    # small for many columns as for one, so that it is compiled; counts per column and kind are left.
    value = raw.select(F.posexplode(F.array(*[_filled(c) for c in columns])).alias("pos", "value"))
    kinds = value.groupBy("pos", _narrowest(F.col("value")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    total = lambda is_in: F.sum(F.when(is_in, F.col("n")).otherwise(0))
    counts = kinds.groupBy("pos").agg(F.sum("n").alias("rows"), total(F.col("kind").isNotNull()).alias("n_values"), *[
        total(F.col("kind").isin(*(_PLACE[k] for k in (name, *_WITHIN.get(name, ()))))).alias(name) for name in TYPES])
    # A row per column; one of a table without rows has counts of 0.
    names = spark.range(1).select(F.posexplode(F.array(*[F.lit(c) for c in columns])).alias("pos", "column_name"))
    found = names.join(F.broadcast(counts), "pos", "left").na.fill(0, ["rows", "n_values", *TYPES])
    n = F.col("n_values")
    kind, bad = F.when(n == 0, F.lit("string")), F.when(n == 0, F.lit(0).cast("long"))
    for name in TYPES:
        of_type = n - F.col(name) <= n * F.lit(tolerance)
        kind, bad = kind.when(of_type, F.lit(name)), bad.when(of_type, n - F.col(name))
    return found.orderBy("pos").select("column_name", kind.otherwise(F.lit("string")).alias("column_type"), "n_values",
                                       (F.col("rows") - n).alias("n_missing"), bad.otherwise(F.lit(0).cast("long")).alias("n_bad"))


def type_map(inferred: DataFrame) -> dict[str, str]:
    """column -> type, as ``complaints_csv.typed`` takes it (a row per column comes to the driver)."""
    return {r["column_name"]: r["column_type"] for r in inferred.select("column_name", "column_type").collect()}
