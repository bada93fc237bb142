"""Map the driver's TPC-H-like test tables onto the case data model.

``case_fact`` rows = lineitem x orders x customer x nation x part:

==================  ==================================================
date_received       CAST(l_shipdate AS DATE)
product             p_type
state               NULLIF(n_name, 'NATION_24')  (gives NULL states)
company_response    l_returnflag: R -> relief, A -> explanation, N -> NULL
timely_response     l_linestatus = 'F'
==================  ==================================================

Join order is chosen for scale: customers are resolved to a state first (the
only join on the 25-value nation key moves customer-sized rows), then orders by
customer, then lineitem joins once on the order key and once on the part key.
No join is hinted: Spark broadcasts by measured size, else shuffles.
Lineitem, the largest input, is shuffled at most twice and only with the
five columns the mapping needs; filters on date and state reach the scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casegrid.config import ReportConfig
from casegrid.functions import count_when, pct
from casegrid.plans.daily import with_unit_measures

# Fixed values of the test mapping.
NULL_STATE_NAME = "NATION_24"
RESPONSE_BY_FLAG = {"R": "Closed with monetary relief", "A": "Closed with explanation"}
TIMELY_STATUS = "F"
# Shipments of this day of the month get an unparsable date in the test extract.
BAD_DATE_DAY = 13
EXCLUDED_PRODUCTS = ("SMALL", "PROMO")

# Whitelist rule: NATION_0 .. NATION_19 (NATION_20..23 act as territories).
TEST_REGIONS: tuple[str, ...] = tuple(f"NATION_{i}" for i in range(20))

# Case columns in which some values stand out (dates are all about as frequent).
HEAVY_COLUMNS = ("product", "state", "company_response", "timely_response")
# Keys of state, product and response (as the calendar queries have them): sparse in months.
SPARSE_REGIONS: tuple[str, ...] = tuple(f"{s}/{p}/{r}" for s in TEST_REGIONS[:6] for p in ("LARGE", "SMALL", "PROMO") for r in RESPONSE_BY_FLAG.values())

TESTDATA_CONFIG = ReportConfig(
    regions=TEST_REGIONS,
    history_since="1995-01-01",
    monthly_since="1996-01-01",
    recent_since="1997-01-01",
    baseline_since="1998-01-01",
    current_since="1999-01-01",
    min_base=20,
    sample_states=("NATION_1", "NATION_4", "NATION_7", "NATION_10", "NATION_13"),
    product_merge=(("SMALL", "Compact"), ("MEDIUM", "Compact")),
)


def _fields(*pairs: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in pairs])


# Declared read schemas (only the columns the mapping uses): no footer
# inference job per read, and the scan reads just these columns.
_LONG, _INT, _STR, _TS = T.LongType(), T.IntegerType(), T.StringType(), T.TimestampNTZType()
TABLE_SCHEMAS = {
    "lineitem": _fields(("l_orderkey", _LONG), ("l_partkey", _LONG), ("l_returnflag", _STR),
                        ("l_linestatus", _STR), ("l_shipdate", _TS)),
    "orders": _fields(("o_orderkey", _LONG), ("o_custkey", _LONG), ("o_orderstatus", _STR),
                      ("o_orderdate", _TS)),
    "customer": _fields(("c_custkey", _LONG), ("c_nationkey", _INT)),
    "nation": _fields(("n_nationkey", _INT), ("n_name", _STR)),
    "part": _fields(("p_partkey", _LONG), ("p_type", _STR)),
}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "nation").select("n_nationkey", "n_name")


def case_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case rows (``schema.CASE_SCHEMA``) derived from the test tables."""
    li = _t(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_shipdate", "l_returnflag", "l_linestatus")
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cust = _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    part = _t(spark, sf_dir, "part").select("p_partkey", "p_type")
    nation = _nation(spark, sf_dir)

    cust_state = (cust.join(nation, cust.c_nationkey == nation.n_nationkey)
                      .select("c_custkey", "n_name"))
    order_state = (orders.join(cust_state, orders.o_custkey == cust_state.c_custkey)
                         .select("o_orderkey", "n_name"))
    rows = (li.join(order_state, li.l_orderkey == order_state.o_orderkey)
              .join(part, li.l_partkey == part.p_partkey))
    flag = F.col("l_returnflag")
    response = None
    for k, v in RESPONSE_BY_FLAG.items():
        response = (F.when(flag == k, F.lit(v)) if response is None
                    else response.when(flag == k, F.lit(v)))
    return rows.select(
        F.col("l_shipdate").cast("date").alias("date_received"),
        F.col("p_type").alias("product"),
        F.nullif(F.col("n_name"), F.lit(NULL_STATE_NAME)).alias("state"),
        response.alias("company_response"),
        (F.col("l_linestatus") == F.lit(TIMELY_STATUS)).alias("timely_response"),
    )


def case_counts(spark: SparkSession, sf_dir: str, cfg: ReportConfig = TESTDATA_CONFIG) -> DataFrame:
    """Case rows with the additive unit measures ``n``, ``n_relief``, ``n_timely``."""
    return with_unit_measures(case_fact(spark, sf_dir), cfg.relief_response)


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-state population: ``1000 * customers`` per nation.

    One row per nation; joined after the report's own aggregation, where AQE
    sees both (small) sides' measured sizes.
    """
    cust = _t(spark, sf_dir, "customer").select("c_nationkey")
    nation = _nation(spark, sf_dir)
    return (cust.join(nation, cust.c_nationkey == nation.n_nationkey)
                .groupBy(F.col("n_name").alias("state"))
                .agg((F.count(F.lit(1)) * F.lit(1000)).alias("population")))


def delinquency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly series (``date``, ``delinquency_rate``) from order status.

    Rate = share of finished orders per order-date quarter; one row per quarter.
    """
    od = F.col("o_orderdate").cast("date")
    o = _t(spark, sf_dir, "orders").select(od.alias("d"), "o_orderstatus")
    return (o.groupBy(F.trunc("d", "quarter").alias("date"))
             .agg(pct(count_when(F.col("o_orderstatus") == F.lit("F")), F.count(F.lit(1)), 2)
                  .alias("delinquency_rate")))

