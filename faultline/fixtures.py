"""Stand-in inputs over the star-schema test tables.

Each stand-in is a list of ``(name, expression)`` pairs that Spark and ANSI SQL
read alike, so a query and its SQL check start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from faultline.session import compile_in_pieces

# md5 over the whole line, doubles as fixed decimals and the date as text: the
# order and line numbers alone repeat.
LINE_KEY = (
    "md5(concat_ws('|', CAST(l_orderkey AS VARCHAR(20)), CAST(l_partkey AS VARCHAR(20)), "
    "CAST(l_suppkey AS VARCHAR(20)), CAST(l_linenumber AS VARCHAR(20)), "
    "CAST(CAST(l_quantity AS DECIMAL(12,2)) AS VARCHAR(20)), "
    "CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR(20)), "
    "CAST(CAST(l_discount AS DECIMAL(12,2)) AS VARCHAR(20)), "
    "CAST(CAST(l_tax AS DECIMAL(12,2)) AS VARCHAR(20)), "
    "l_returnflag, l_linestatus, CAST(CAST(l_shipdate AS DATE) AS VARCHAR(20))))"
)

_CLASS = (
    "CASE WHEN (l_quantity >= 45 AND l_discount >= 0.08 AND l_partkey % 5 <> 0) "
    "OR l_partkey % 199 = 0 THEN 'pos' ELSE 'neg' END"
)


def _text(expr: str) -> str:
    return f"CAST({expr} AS VARCHAR(20))"


def _missing(test: str, expr: str, token: str = "na") -> str:
    return f"CASE WHEN {test} THEN '{token}' ELSE {expr} END"


_DISCOUNT = f"concat(' ', {_text('CAST(l_discount AS DECIMAL(4,2))')}, ' ')"

# Raw text sensors with every cleaning case.
SENSOR_RAW = [
    ("class", _CLASS),
    ("aa_000", _text("CAST(l_quantity AS INT)")),
    ("ab_000", _missing("l_linenumber <> 7", _text("l_suppkey"))),
    ("ag_000", _missing("l_partkey % 10 = 0", _text("CAST(l_extendedprice AS DECIMAL(12,2))"))),
    ("ci_000", "CASE WHEN l_suppkey % 3 = 0 THEN ' na ' WHEN l_suppkey % 7 = 0 THEN 'NaN' "
               f"ELSE {_DISCOUNT} END"),
    ("ck_000", _missing("l_partkey % 50 = 0", _text("CAST(l_tax AS DECIMAL(4,2))"), "bad")),
    ("bj_000", _text("l_linenumber")),
    ("cd_000", "'1209600'"),
    ("ch_000", _missing("l_partkey % 100 = 0", "'7'")),
    ("cr_000", "'na'"),
]

# The same, widened to all model features and all excluded ones.
SENSOR_WIDE = SENSOR_RAW + [
    ("ah_000", _text("l_partkey % 1000")),
    ("bb_000", _missing("l_suppkey % 11 = 0", _text("CAST(l_extendedprice * 2 AS DECIMAL(14,2))"))),
    ("bg_000", _text("l_suppkey * 3")),
    ("bu_000", _text("l_orderkey % 5000")),
    ("bv_000", _missing("l_orderkey % 13 = 0", _text("l_orderkey % 700"))),
    ("cq_000", _text("l_partkey + l_suppkey")),
    ("bt_000", _missing("l_linenumber = 3", _text("CAST(l_quantity * 4 AS DECIMAL(12,2))"))),
    ("an_000", _text("l_partkey % 97")),
    ("ao_000", _text("l_partkey % 89")),
    ("bh_000", _missing("l_partkey % 17 = 0", _text("l_suppkey % 50"))),
    ("dn_000", _text("l_orderkey % 31")),
    ("cc_000", _text("CAST(l_extendedprice AS DECIMAL(12,1))")),
    ("bx_000", _text("l_suppkey % 23")),
    ("aq_000", _missing("l_quantity < 3", _text("CAST(l_quantity AS DECIMAL(6,1))"))),
    ("ap_000", _text("l_orderkey % 211")),
    ("by_000", _text("l_linenumber * 10")),
    ("bm_000", _missing("l_linenumber <> 1", _text("l_partkey"))),
    ("bn_000", _missing("l_linenumber <> 2", _text("l_partkey"))),
    ("bo_000", _missing("l_linenumber <> 3", _text("l_partkey"))),
    ("bp_000", _missing("l_linenumber <> 4", _text("l_partkey"))),
    ("bq_000", _missing("l_linenumber <> 5", _text("l_partkey"))),
    ("br_000", _missing("l_linenumber <> 6", _text("l_partkey"))),
]

# Scored rows with a true label.
PREDICTIONS = [
    ("prediction_id", "event_id + 1"),
    ("prediction", "CASE WHEN value/150.0 >= 0.5 THEN 1 ELSE 0 END"),
    ("prediction_label", "CASE WHEN value/150.0 >= 0.5 THEN 'FAILURE' ELSE 'NO_FAILURE' END"),
    ("failure_probability", "CASE WHEN value/150.0 > 1 THEN 1.0 ELSE value/150.0 END"),
    ("risk_level", "CASE WHEN value/150.0 >= 0.70 THEN 'HIGH' "
                   "WHEN value/150.0 >= 0.30 THEN 'MEDIUM' ELSE 'LOW' END"),
    ("created_at", "ts"),
    ("label", "CASE WHEN event_type = 'error' THEN 1 ELSE 0 END"),
]


# Two sides of a drift comparison, by date of shipping.
SIDES = [
    ("earlier", "l_shipdate < CAST('1995-06-17' AS DATE)"),
    ("quantity", "CAST(l_quantity AS DOUBLE)"), ("price", "CAST(l_extendedprice AS DOUBLE)"), ("tax", "CAST(l_tax AS DOUBLE)"),
    ("moved", "CASE WHEN l_shipdate < CAST('1995-06-17' AS DATE) THEN l_extendedprice ELSE l_extendedprice * 1.5 END"),
    ("thinned", "CASE WHEN l_shipdate >= CAST('1995-06-17' AS DATE) AND l_partkey % 3 = 0 THEN NULL ELSE l_discount END"),
    ("constant", "CAST(7 AS DOUBLE)"), ("empty", "CAST(NULL AS DOUBLE)"),
]
DRIFT_FEATURES = tuple(name for name, _ in SIDES[1:])
SIDES.append(("shipped", "CAST(l_shipdate AS DATE)"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return compile_in_pieces(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _project(df: DataFrame, pairs) -> DataFrame:
    return df.selectExpr(*(f"{expr} AS {name}" for name, expr in pairs))


def as_sql(pairs, source: str) -> str:
    """The same projection as a SELECT for the SQL checks."""
    return "SELECT " + ", ".join(f"{expr} AS {name}" for name, expr in pairs) + f" FROM {source}"


def sensor_raw(spark: SparkSession, sf_dir: str, key: bool = False, wide: bool = False) -> DataFrame:
    pairs = SENSOR_WIDE if wide else SENSOR_RAW
    pairs = ([("row_key", LINE_KEY)] if key else []) + pairs
    return _project(table(spark, sf_dir, "lineitem"), pairs)


def sensor_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(table(spark, sf_dir, "lineitem"), SIDES)


def sensor_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide sensors as a stream over the table's files."""
    schema = table(spark, sf_dir, "lineitem").schema
    # A streaming source takes a folder or a pattern, not one file.
    lines = spark.readStream.schema(schema).parquet(f"{sf_dir}/lineitem*.parquet")
    return _project(lines, [("row_key", LINE_KEY)] + SENSOR_WIDE)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(table(spark, sf_dir, "events"), PREDICTIONS)
