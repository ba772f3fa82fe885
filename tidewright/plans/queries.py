"""The registered queries over the tables of a scale-factor folder, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coerce import num
from ..functions.formula import derive as formula
from ..functions import coerce
from ..functions.formula import check_formula
from ..operators import charts, checks, clean, derive, kpi, metrics, profile, roles
from ..sources import io
from ..sources.scratch import new_path
from . import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[run.__name__] = run
        if sql:
            SQL[run.__name__] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# --- coercion -----------------------------------------------------------------------------------

_RAW_NUMBER = "CASE o_orderkey % 6 WHEN 0 THEN '  ' || o_custkey || ' ' WHEN 1 THEN '1,000' WHEN 2 THEN '$' || o_custkey WHEN 3 THEN o_custkey || 'e1' WHEN 4 THEN '-' || o_custkey || '.5' ELSE o_custkey || 'd' END"
_RAW_DATE = "CASE o_orderkey % 4 WHEN 0 THEN {iso} WHEN 1 THEN {us} WHEN 2 THEN {short} ELSE 'soon' END"


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (0, 3, 4) THEN try_cast(trim({_RAW_NUMBER}) AS DOUBLE) END AS number FROM orders")
def coerce_number(spark, sf_dir):
    raw = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_RAW_NUMBER).alias("raw"))
    return raw.select("o_orderkey", num(raw, "raw").alias("number"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def coerce_datetime(spark, sf_dir):
    raw = _RAW_DATE.format(iso="date_format(o_orderdate, 'yyyy-MM-dd')", us="date_format(o_orderdate, 'MM/dd/yyyy')", short="date_format(o_orderdate, 'MMM d yyyy')")
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(raw).alias("raw"))
    return df.select("o_orderkey", F.date_format(coerce.dt(df, "raw"), "yyyy-MM-dd").alias("day"))


# --- formulas -----------------------------------------------------------------------------------


def _derived(df: DataFrame, formulas: dict[str, str], *keys: str, as_of: str | None = None) -> DataFrame:
    for name, text in formulas.items():
        df = formula(df, name, text, as_of)
    return df.select(*keys, *formulas)


_LINE = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge,
  CASE WHEN l_discount <> 0 THEN l_tax / l_discount END AS ratio, -l_quantity + 0.0 AS negative, round(l_quantity ** 2, 4) AS squared FROM lineitem""")
def formula_arith(spark, sf_dir):
    out = _derived(table(spark, sf_dir, "lineitem"), {"charge": "l_extendedprice * (1 - l_discount) * (1 + l_tax)", "ratio": "l_tax / l_discount", "negative": "-l_quantity + 0", "squared": "l_quantity ** 2"}, *_LINE)
    return _rounded(out, 4, "squared")


@query("""SELECT o_orderkey, floor((o_custkey - 500) / 7) AS whole, (o_custkey - 500) - floor((o_custkey - 500) / 7) * 7.0 AS rest,
  (o_custkey - 500) - floor((o_custkey - 500) / -7) * -7.0 AS rest_down, CAST(NULL AS DOUBLE) AS by_zero FROM orders""")
def formula_mod_floor(spark, sf_dir):
    return _derived(table(spark, sf_dir, "orders"), {"whole": "(o_custkey - 500) // 7", "rest": "(o_custkey - 500) % 7", "rest_down": "(o_custkey - 500) % -7", "by_zero": "o_custkey % 0"}, "o_orderkey")


@query("""SELECT o_orderkey, o_totalprice > 1000 AND o_totalprice <= 200000 AS middle, o_orderstatus = 'F' OR o_orderpriority = '1-URGENT' AS hot,
  NOT (o_orderstatus <> 'O') AS open, coalesce(nullif(o_custkey, 7) < 100, false) AS low, coalesce(nullif(o_custkey, 7) <> 8, true) AS other FROM orders""")
def formula_compare_logic(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumn("maybe", F.nullif("o_custkey", F.lit(7)))
    return _derived(df, {"middle": "1000 < o_totalprice <= 200000", "hot": "o_orderstatus == 'F' or o_orderpriority == '1-URGENT'", "open": "not o_orderstatus != 'O'", "low": "maybe < 100", "other": "maybe != 8"}, "o_orderkey")


@query("""SELECT o_orderkey, year(o_orderdate)::DOUBLE AS y, strftime(o_orderdate, '%Y-%m') AS m, day(o_orderdate)::DOUBLE AS d, year(o_orderdate) || '-Q' || quarter(o_orderdate) AS q,
  week(o_orderdate)::DOUBLE AS w, dayname(o_orderdate) AS n, isodow(o_orderdate) >= 6 AS weekend FROM orders""")
def formula_dateparts(spark, sf_dir):
    return _derived(table(spark, sf_dir, "orders"), {"y": "year(o_orderdate)", "m": "month(o_orderdate)", "d": "day(o_orderdate)", "q": "quarter(o_orderdate)", "w": "week(o_orderdate)", "n": "dayofweek(o_orderdate)", "weekend": "is_weekend(o_orderdate)"}, "o_orderkey")


@query("SELECT event_id, hour(ts)::DOUBLE AS h, minute(ts)::DOUBLE AS m FROM events")
def formula_timeparts(spark, sf_dir):
    return _derived(table(spark, sf_dir, "events"), {"h": "hour(ts)", "m": "minute(ts)"}, "event_id")


@query("""SELECT event_id, floor(us / 86400e6) AS days, round(us / 3600e6, 4) AS hours, round(us / 60e6, 4) AS minutes, round(us / (30.4375 * 86400e6), 4) AS months, round(us / (365.25 * 86400e6), 4) AS years
FROM (SELECT event_id, epoch_us(TIMESTAMP '2025-01-01 06:00:00') - epoch_us(ts) AS us FROM events)""")
def formula_date_diff(spark, sf_dir):
    units = ("days", "hours", "minutes", "months", "years")
    return _rounded(_derived(table(spark, sf_dir, "events"), {u: f"date_diff('2025-01-01 06:00:00', ts, '{u}')" for u in units}, "event_id"), 4, *units[1:])


@query("""SELECT p_partkey, lower(p_type) AS low, upper(p_name) AS up, length(p_name)::DOUBLE AS n, contains(lower(p_type), 'steel') AS steel, starts_with(p_brand, 'Brand#1') AS first_brand, ends_with(p_brand, '3') AS third FROM part""")
def formula_text(spark, sf_dir):
    return _derived(table(spark, sf_dir, "part"), {"low": "lower(p_type)", "up": "upper(p_name)", "n": "length(p_name)", "steel": "contains(p_type, 'STEEL')", "first_brand": "startswith(p_brand, 'Brand#1')", "third": "endswith(p_brand, '3')"}, "p_partkey")


@query("SELECT p_partkey, coalesce(b, '') || ' / ' || p_type AS both_, coalesce(b, '') || p_name AS plain FROM (SELECT *, nullif(p_brand, 'Brand#11') AS b FROM part)")
def formula_concat(spark, sf_dir):
    df = table(spark, sf_dir, "part").withColumn("b", F.nullif("p_brand", F.lit("Brand#11")))
    return _derived(df, {"both_": "concat(b, p_type, ' / ')", "plain": "concat(b, p_name)"}, "p_partkey")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS size_, coalesce(nullif(o_custkey, 7)::DOUBLE, 0.0) AS cust, nullif(o_custkey, 7) IS NULL AS none FROM orders")
def formula_if_coalesce(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumn("maybe", F.nullif("o_custkey", F.lit(7)))
    return _derived(df, {"size_": "if(o_totalprice > 100000, 'big', 'small')", "cust": "coalesce(maybe, 0)", "none": "isnull(maybe)"}, "o_orderkey")


@query("""SELECT c_custkey, abs(c_acctbal) AS a, round_even(c_acctbal, 0) AS r, round(CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) END, 4) AS l, round(CASE WHEN c_acctbal >= 0 THEN sqrt(c_acctbal) END, 4) AS s FROM customer""")
def formula_math(spark, sf_dir):
    return _rounded(_derived(table(spark, sf_dir, "customer"), {"a": "abs(c_acctbal)", "r": "round(c_acctbal)", "l": "log(c_acctbal)", "s": "sqrt(c_acctbal)"}, "c_custkey"), 4, "l", "s")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, least(l_discount, l_tax) + 0.0 AS lo, greatest(l_quantity, 25.0) AS hi FROM lineitem")
def formula_minmax(spark, sf_dir):
    return _derived(table(spark, sf_dir, "lineitem"), {"lo": "min(l_discount, l_tax) + 0", "hi": "max(l_quantity, 25)"}, *_LINE)


@query("SELECT p_partkey, CASE WHEN p_size >= 0 AND p_size <= 10 THEN 'S' WHEN p_size > 10 AND p_size <= 30 THEN 'M' WHEN p_size > 30 AND p_size <= 45 THEN 'L' END AS size_ FROM part")
def formula_bucket(spark, sf_dir):
    return _derived(table(spark, sf_dir, "part"), {"size_": "bucket(p_size, [0, 10, 30, 45], ['S', 'M', 'L'])"}, "p_partkey")


@query("SELECT count(*)::BIGINT AS n, sum(length('2024-06-30'))::BIGINT AS chars, min('2024-06-30') AS day FROM orders")
def formula_today(spark, sf_dir):
    df = _derived(table(spark, sf_dir, "orders"), {"day": "today()"}, "o_orderkey", as_of="2024-06-30")
    return df.agg(F.count("*").alias("n"), F.sum(F.length("day")).alias("chars"), F.min("day").alias("day"))


# --- KPIs ---------------------------------------------------------------------------------------

_CARDS = [
    {"name": "revenue", "formula_type": "sum", "column": "l_extendedprice", "format": "currency"},
    {"name": "mean price", "formula_type": "average", "column": "l_extendedprice"},
    {"name": "least", "formula_type": "min", "column": "l_quantity"},
    {"name": "most", "formula_type": "max", "column": "l_quantity"},
    {"name": "spread", "formula_type": "std", "column": "l_quantity"},
    {"name": "rows", "formula_type": "count_rows"},
    {"name": "flags", "formula_type": "count_non_null", "column": "l_returnflag"},
    {"name": "parts", "formula_type": "count_distinct", "column": "l_partkey"},
]


@query("""SELECT unnest(['revenue', 'mean price', 'least', 'most', 'spread', 'rows', 'flags', 'parts']) AS title, round(unnest([s, a, lo, hi, sd, n, f, p]), 2) AS value,
  unnest(['currency', 'number', 'number', 'number', 'number', 'number', 'number', 'number']) AS format
FROM (SELECT sum(l_extendedprice) AS s, avg(l_extendedprice) AS a, min(l_quantity) AS lo, max(l_quantity) AS hi, stddev_samp(l_quantity) AS sd, count(*)::DOUBLE AS n, count(l_returnflag)::DOUBLE AS f, count(DISTINCT l_partkey)::DOUBLE AS p FROM lineitem)""")
def kpi_cards(spark, sf_dir):
    return _rounded(kpi.cards(table(spark, sf_dir, "lineitem"), _CARDS), 2, "value")


@query("SELECT 'urgent' AS title, round(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END), 2) AS value, 'number' AS format FROM orders UNION ALL SELECT 'all', round(sum(o_totalprice), 2), 'number' FROM orders")
def filtered_kpi(spark, sf_dir):
    specs = [{"name": "urgent", "formula_type": "sum", "column": "o_totalprice", "filter_condition": "o_orderpriority == '1-URGENT'"}, {"name": "all", "formula_type": "sum", "column": "o_totalprice"}]
    return _rounded(kpi.cards(table(spark, sf_dir, "orders"), specs), 2, "value")


@query("SELECT strftime(o_orderdate, '%Y-%m') AS key, strftime(o_orderdate, '%Y-%m') AS label, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1")
def group_sum(spark, sf_dir):
    df = formula(table(spark, sf_dir, "orders"), "order_month", "month(o_orderdate)")
    return _rounded(kpi.grouped_chart(df, {"formula_type": "group_sum", "group_by": "order_month", "value_column": "o_totalprice", "visual": "line_chart"}), 2, "value")


def _group_query(kind: str, sql: str):
    def run(spark, sf_dir):
        spec = {"formula_type": f"group_{kind}", "group_by": "l_suppkey", "value_column": "l_extendedprice", "visual": "table"}
        return _rounded(kpi.grouped_chart(table(spark, sf_dir, "lineitem"), spec).select("key", "value"), 4, "value")

    run.__name__ = f"group_{kind}"
    query(f"SELECT l_suppkey AS key, round({sql}, 4) AS value FROM lineitem GROUP BY l_suppkey")(run)


for _kind, _sql in {"average": "avg(l_extendedprice)", "median": "median(l_extendedprice)", "min": "min(l_extendedprice)", "max": "max(l_extendedprice)", "std": "stddev_samp(l_extendedprice)", "count": "count(*)::DOUBLE"}.items():
    _group_query(_kind, _sql)


@query("""SELECT coalesce(k, 'Missing') AS label, round(coalesce(sum(v), 0), 2) AS value FROM (SELECT nullif(o_orderpriority, '5-LOW') AS k, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS v FROM orders) GROUP BY 1""")
def group_missing(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(F.nullif("o_orderpriority", F.lit("5-LOW")).alias("k"), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("v"))
    return _rounded(kpi.grouped_chart(df, {"formula_type": "group_sum", "group_by": "k", "value_column": "v"}).select("label", "value"), 2, "value")


@query("SELECT p_brand AS key, round(sum(p_retailprice), 2) AS value FROM part GROUP BY 1 ORDER BY value DESC, key LIMIT 10")
def group_topn(spark, sf_dir):
    spec = {"formula_type": "group_sum", "group_by": "p_brand", "value_column": "p_retailprice", "visual": "bar_chart", "top_n": 10}
    return _rounded(kpi.grouped_chart(table(spark, sf_dir, "part"), spec).select("key", "value"), 2, "value")


@query("""SELECT l_returnflag AS key, round(sum(l_quantity), 2) AS quantity, round(avg(l_discount), 4) AS discount, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1""")
def group_fused(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    out = kpi.grouped(df, "l_returnflag", {"quantity": kpi.aggregate("sum", num(df, "l_quantity")), "discount": kpi.aggregate("average", num(df, "l_discount")), "n": kpi.aggregate("count")})
    return _rounded(_rounded(out, 2, "quantity"), 4, "discount")


@query("""WITH r AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
e AS (SELECT i::INTEGER AS bin, CASE WHEN i = 0 THEN lo - 0.001 * (hi - lo) ELSE lo + (hi - lo) * i / 10 END AS lo, CASE WHEN i = 9 THEN hi ELSE lo + (hi - lo) * (i + 1) / 10 END AS hi FROM r, range(10) t(i))
SELECT bin, round(e.lo, 6) AS lo, round(e.hi, 6) AS hi, count(value)::BIGINT AS count FROM e LEFT JOIN events ON value > e.lo AND value <= e.hi GROUP BY ALL""")
def histogram(spark, sf_dir):
    return _rounded(kpi.histogram(table(spark, sf_dir, "events"), "value").select("bin", "lo", "hi", "count"), 6, "lo", "hi")


@query("""SELECT l_quantity AS x, l_extendedprice AS y, l_returnflag AS color FROM (SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice LIMIT 500)""")
def scatter(spark, sf_dir):
    return kpi.scatter(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], color="l_returnflag")


def _heat_query(kind: str, sql: str):
    def run(spark, sf_dir):
        return _rounded(kpi.heatmap(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", "o_totalprice", kind), 4, "value")

    run.__name__ = f"heatmap_{kind}"
    query(f"SELECT o_orderpriority AS x, o_orderstatus AS y, round({sql}, 4) AS value FROM orders GROUP BY 1, 2")(run)


for _kind, _sql in {"count": "count(*)::DOUBLE", "sum": "sum(o_totalprice)", "average": "avg(o_totalprice)"}.items():
    _heat_query(_kind, _sql)


@query("""WITH c AS (SELECT p_brand AS x, p_type AS y, count(*)::DOUBLE AS value FROM part GROUP BY 1, 2),
tx AS (SELECT x FROM c GROUP BY x ORDER BY sum(value) DESC, x LIMIT 5), ty AS (SELECT y FROM c GROUP BY y ORDER BY sum(value) DESC, y LIMIT 5)
SELECT * FROM c WHERE x IN (FROM tx) AND y IN (FROM ty)""")
def heatmap_topn(spark, sf_dir):
    return kpi.heatmap(table(spark, sf_dir, "part"), "p_brand", "p_type", n=5)


# --- profile, roles -----------------------------------------------------------------------------


def _profile_sql(name: str, columns: list[tuple[str, str]]) -> str:
    parts = []
    for c, kind in columns:
        number, date = kind == "number", kind == "datetime"
        parts.append(
            f"SELECT '{c}' AS name, '{kind}' AS detected_type, count(*) AS row_count, count(*) - count({c}) AS missing_count, round_even((count(*) - count({c})) * 100.0 / greatest(count(*), 1), 2)::DOUBLE AS missing_percent, "
            f"count(DISTINCT {c}) AS unique_count, round_even(count(DISTINCT {c})::DOUBLE / greatest(count(*), 1), 4) AS unique_ratio, "
            + ", ".join(f"{f'round({f}({c})::DOUBLE, 4)' if number else 'CAST(NULL AS DOUBLE)'} AS {f if f != 'avg' else 'mean'}" for f in ("min", "max", "avg")) + ", "
            + ", ".join(f"{f'''strftime({f}({c}), '%Y-%m-%d')''' if date else 'CAST(NULL AS VARCHAR)'} AS {f}_date" for f in ("min", "max")) + f" FROM {name}"
        )
    return " UNION ALL ".join(parts)


def _profiled(df: DataFrame) -> DataFrame:
    out = profile.profile(df).drop("position", "exact_ratio")
    return _rounded(out, 4, "min", "max", "mean").withColumns({c: F.substring(c, 1, 10) for c in ("min_date", "max_date")})


@query(_profile_sql("customer", [("c_custkey", "number"), ("c_name", "text"), ("c_nationkey", "number"), ("c_acctbal", "number"), ("c_mktsegment", "text")]))
def profile_columns(spark, sf_dir):
    return _profiled(table(spark, sf_dir, "customer"))


@query(_profile_sql("orders", [("o_orderkey", "number"), ("o_custkey", "number"), ("o_orderstatus", "text"), ("o_totalprice", "number"), ("o_orderdate", "datetime"), ("o_orderpriority", "text")]))
def profile_orders(spark, sf_dir):
    return _profiled(table(spark, sf_dir, "orders"))


@query("SELECT unnest(['as_number', 'as_date', 'as_text', 'mixed']) AS name, unnest(['number', 'datetime', 'text', 'text']) AS detected_type")
def profile_types(spark, sf_dir):
    """Types of text columns: numbers, dates, texts, and a column of which 80 % are numbers."""
    df = table(spark, sf_dir, "orders").select(F.col("o_totalprice").cast("string").alias("as_number"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("as_date"), F.col("o_orderpriority").alias("as_text"), F.when(F.col("o_orderkey") % 5 == 0, "x").otherwise(F.col("o_custkey").cast("string")).alias("mixed"))
    return profile.profile(df).select("name", "detected_type")


@query("SELECT count(*)::BIGINT AS row_count, 3::BIGINT AS column_count, (count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_suppkey, l_returnflag, l_quantity FROM lineitem)))::BIGINT AS duplicate_rows FROM lineitem")
def profile_duplicates(spark, sf_dir):
    return profile.duplicate_rows(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_quantity"))


def _rename_all(df: DataFrame, names: list[str]) -> DataFrame:
    return df.toDF(*names)


_SALES = ["order_id", "customer", "order_status", "total_price", "order_date", "country"]


def _sales(spark, sf_dir) -> DataFrame:
    return _rename_all(table(spark, sf_dir, "orders"), _SALES)


@query("SELECT unnest(['order_id', 'customer', 'order_status', 'total_price', 'order_date', 'country']) AS name, unnest(['id', 'customer', 'status', 'money', 'date', 'location']) AS role_guess, unnest([0.9, 0.9, 0.9, 0.9, 0.9, 0.9])::DOUBLE AS role_confidence")
def roles_guess(spark, sf_dir):
    return roles.guess_roles(profile.profile(_sales(spark, sf_dir))).select("name", "role_guess", "role_confidence")


@query("SELECT unnest(['order_id', 'customer', 'order_status', 'total_price', 'order_date', 'country']) AS name, unnest(['identifier', 'customer', 'status', 'money', 'date', 'quantity']) AS by_part, unnest(['identifier', 'customer', 'status', 'money', 'date', 'location']) AS by_word")
def roles_corrected(spark, sf_dir):
    guessed = roles.guess_roles(profile.profile(_sales(spark, sf_dir)))
    by_word = roles.correct_roles(guessed, "word").select("name", F.col("corrected_role").alias("by_word"))
    return roles.correct_roles(guessed).select("name", F.col("corrected_role").alias("by_part")).join(by_word, "name")


@query("SELECT unnest(['order_id', 'customer', 'order_status', 'total_price', 'order_date', 'country']) AS name, unnest(['numeric_measure', 'numeric_measure', 'business_category', 'financial_amount', 'date_or_timestamp', 'quantity']) AS semantic_role, unnest(['measure', 'measure', 'dimension', 'measure', 'time', 'measure']) AS business_role")
def roles_semantic(spark, sf_dir):
    return roles.semantic_roles(roles.guess_roles(profile.profile(_sales(spark, sf_dir)))).select("name", "semantic_role", "business_role")


@query("SELECT 2 AS sales_or_transactions, 0 AS hr, 0 AS inventory, 0 AS finance, 0 AS operations, 'sales_or_transactions' AS possible_business_domain FROM (SELECT count(*) FROM orders)")
def domain_scores(spark, sf_dir):
    return roles.domain_scores(roles.guess_roles(profile.profile(_sales(spark, sf_dir))))


@query("""SELECT true AS time_analysis, true AS money_analysis, false AS product_analysis, false AS payment_method_analysis, true AS location_analysis, true AS status_analysis, false AS quantity_price_revenue_possible, true AS category_comparison FROM (SELECT count(*) FROM orders)""")
def capabilities(spark, sf_dir):
    return roles.capabilities(roles.guess_roles(profile.profile(_sales(spark, sf_dir))))


@query("""SELECT 'c_acctbal' AS name, 'number' AS detected_type, round_even((count(*) - count(c_acctbal)) * 100.0 / count(*), 2)::DOUBLE AS missing_percent, count(DISTINCT c_acctbal) AS unique_count FROM customer
UNION ALL SELECT 'c_mktsegment', 'text', round_even((count(*) - count(c_mktsegment)) * 100.0 / count(*), 2)::DOUBLE, count(DISTINCT c_mktsegment) FROM customer""")
def safe_metadata(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_acctbal", "c_mktsegment")
    return roles.safe_metadata(roles.guess_roles(profile.profile(df))).select("name", "detected_type", "missing_percent", "unique_count")


# --- cleaning, derived columns ------------------------------------------------------------------


@query("SELECT DISTINCT o_custkey, o_orderstatus FROM orders WHERE o_custkey % 3 <> 0")
def clean_dedup(spark, sf_dir):
    keep = F.col("o_custkey") % 3 != 0
    df = table(spark, sf_dir, "orders").select(F.when(keep, F.col("o_custkey")).alias("o_custkey"), F.when(keep, F.col("o_orderstatus")).alias("o_orderstatus"))
    return clean.drop_repeated_rows(clean.drop_empty_rows(df))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 IN (0, 1) THEN c_mktsegment WHEN c_custkey % 4 = 2 THEN CAST(NULL AS VARCHAR) ELSE 'NULL' END AS segment FROM customer")
def clean_trim(spark, sf_dir):
    dirty = F.expr("CASE c_custkey % 4 WHEN 0 THEN concat('  ', c_mktsegment, '\t') WHEN 1 THEN c_mktsegment WHEN 2 THEN ' nan ' ELSE 'NULL' END")
    return clean.trim_text(table(spark, sf_dir, "customer").select("c_custkey", dirty.alias("segment")))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 20 <> 0 THEN o_totalprice END AS price, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE o_custkey::VARCHAR END AS mixed FROM orders")
def clean_convert(spark, sf_dir):
    """Texts of which 95 % are numbers become numbers, dates become dates, 80 % are not enough."""
    raw = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 20 == 0, "?").otherwise(F.col("o_totalprice").cast("string")).alias("price"), F.date_format("o_orderdate", "MM/dd/yyyy").alias("day"), F.when(F.col("o_orderkey") % 5 == 0, "x").otherwise(F.col("o_custkey").cast("string")).alias("mixed"))
    return clean.convert(raw, clean.conversions(raw)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate, '%Y-%m') AS m, year(o_orderdate) || '-Q' || quarter(o_orderdate) AS q, year(o_orderdate)::INTEGER AS y, dayname(o_orderdate) AS n FROM orders")
def derive_dates(spark, sf_dir):
    plan = {"rename_columns": [{"old_name": "o_orderdate", "new_name": "ordered"}], "derived_columns": [{"name": n, "formula_type": f"extract_{k}", "input_columns": ["o_orderdate"]} for n, k in (("d", "date"), ("m", "month"), ("q", "quarter"), ("y", "year"), ("n", "weekday"))]}
    return derive.apply_schema(table(spark, sf_dir, "orders"), plan)[0].select("o_orderkey", "d", "m", "q", "y", "n")


@query("SELECT event_id, hour(ts)::INTEGER AS h FROM events")
def derive_hour(spark, sf_dir):
    return derive.apply_schema(table(spark, sf_dir, "events"), {"derived_columns": [{"name": "h", "formula_type": "extract_hour", "input_columns": ["ts"]}]})[0].select("event_id", "h")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_quantity * l_extendedprice, 4) AS value FROM lineitem")
def derive_multiply(spark, sf_dir):
    out = derive.apply_schema(table(spark, sf_dir, "lineitem"), {"derived_columns": [{"name": "value", "formula_type": "multiply", "input_columns": ["l_quantity", "l_extendedprice"]}]})[0]
    return _rounded(out.select(*_LINE, "value"), 4, "value")


# --- checks -------------------------------------------------------------------------------------


@query("""SELECT unnest(['code', 'day', 'o_orderstatus']) AS name, round(unnest([a, 0.0, 0.0]), 4) AS number_share, unnest([a >= 0.8, false, false]) AS is_numeric, unnest([false, true, false]) AS is_datetime, unnest([n, d, s]) AS distinct_, unnest([n > 50, d > 50, s > 50]) AS high_cardinality
FROM (SELECT avg(CASE WHEN o_orderkey % 10 = 0 THEN 0.0 ELSE 1.0 END) AS a, count(DISTINCT CASE WHEN o_orderkey % 10 = 0 THEN '?' ELSE o_custkey || '.5' END) AS n, count(DISTINCT strftime(o_orderdate, '%Y-%m-%d')) AS d, count(DISTINCT o_orderstatus) AS s FROM orders)""")
def check_columns(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 10 == 0, "?").otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit(".5"))).alias("code"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderstatus")
    out = checks.facts_table(df, ["code", "day", "o_orderstatus"])
    return _rounded(out.select("name", "number_share", "is_numeric", "is_datetime", F.col("distinct").alias("distinct_"), "high_cardinality"), 4, "number_share")


_PLAN = {
    "kpis": [
        {"name": "sales", "formula_type": "sum", "column": "o_totalprice", "visual": "bar_chart"},
        {"name": "sales", "formula_type": "count_rows"},
        {"name": "bad", "formula_type": "sum", "column": "o_orderstatus"},
        {"name": "lost", "formula_type": "average", "column": "nothing"},
        {"name": "by priority", "formula_type": "group_count", "group_by": "o_orderpriority", "visual": "pie_chart"},
        {"name": "by customer", "formula_type": "group_sum", "group_by": "o_custkey", "value_column": "o_totalprice", "visual": "donut_chart"},
        {"name": "x = 1", "formula_type": "count_rows"},
        {"name": "odd", "formula_type": "guess"},
    ],
    "dashboard_layout": {"top": ["sales", "bad"], "filters": ["o_orderstatus", "nothing"]},
}


@query("""SELECT unnest(['sales', 'sales', 'bad', 'lost', 'by priority', 'by customer', 'x = 1', 'odd', 'o_orderstatus', 'nothing']) AS item, unnest(['kpi', 'kpi', 'kpi', 'kpi', 'kpi', 'kpi', 'kpi', 'kpi', 'filter', 'filter']) AS kind,
  unnest(['accepted', 'rejected', 'rejected', 'rejected', 'accepted', 'accepted', 'rejected', 'rejected', 'accepted', 'rejected']) AS status FROM (SELECT count(*) FROM orders)""")
def kpi_validation(spark, sf_dir):
    return checks.check_kpis(table(spark, sf_dir, "orders"), _PLAN)[1].select("item", "kind", "status")


# --- declared metrics ---------------------------------------------------------------------------


@query("SELECT o_orderpriority AS key, round(sum(o_totalprice), 2) AS value, round(sum(o_totalprice) * 100 / sum(sum(o_totalprice)) OVER (), 4) AS pct_of_total FROM orders GROUP BY 1")
def pct_of_total(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    groups = kpi.grouped(df, "o_orderpriority", {"value": kpi.aggregate("sum", num(df, "o_totalprice"))})
    return _rounded(_rounded(metrics.pct_of_total(groups), 2, "value"), 4, "pct_of_total")


_MONTHS = "(SELECT strftime(o_orderdate, '%Y-%m') AS period, sum(o_totalprice) AS value FROM orders GROUP BY 1)"


def _months(spark, sf_dir) -> DataFrame:
    return metrics.by_period(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice")


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("period", F.date_format("period", "yyyy-MM"))


@query(f"SELECT period, round(value, 2) AS value, round(sum(value) OVER (ORDER BY period), 2) AS running_total FROM {_MONTHS}")
def running_total(spark, sf_dir):
    return _rounded(_named(metrics.running_total(_months(spark, sf_dir))), 2, "value", "running_total")


@query(f"SELECT period, round(value, 2) AS value, round(lag(value) OVER w, 2) AS previous, round((value - lag(value) OVER w) / lag(value) OVER w, 4) AS growth_rate FROM {_MONTHS} WINDOW w AS (ORDER BY period)")
def growth_rate(spark, sf_dir):
    return _rounded(_rounded(_named(metrics.growth_rate(_months(spark, sf_dir))), 2, "value", "previous"), 4, "growth_rate")


@query(f"""SELECT period, round(value, 2) AS value, round(p, 2) AS previous, round((value - p) / p * 100, 4) AS delta_pct, CASE WHEN value > p THEN 'up' WHEN value < p THEN 'down' ELSE 'flat' END AS direction
FROM (SELECT *, lag(value) OVER (ORDER BY period) AS p FROM {_MONTHS}) ORDER BY period DESC LIMIT 1""")
def vs_previous_period(spark, sf_dir):
    return _rounded(_rounded(_named(metrics.vs_previous_period(_months(spark, sf_dir))), 2, "value", "previous"), 4, "delta_pct")


def _rank_query(direction: str, order: str):
    def run(spark, sf_dir):
        return _rounded(metrics.ranking(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", 10, direction=direction), 2, "value")

    run.__name__ = f"rank_{direction}"
    query(f"SELECT row_number() OVER (ORDER BY v {order}, key)::INTEGER AS rank, key, round(v, 2) AS value FROM (SELECT o_custkey AS key, sum(o_totalprice) AS v FROM orders GROUP BY 1 ORDER BY v {order}, key LIMIT 10)")(run)


_rank_query("top", "DESC")
_rank_query("bottom", "ASC")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice BETWEEN 1000 AND 200000 AND o_orderdate::DATE BETWEEN DATE '1994-01-01' AND DATE '2030-12-31'")
def filters(spark, sf_dir):
    chosen = [{"type": "single_select", "column": "o_orderstatus", "value": "O"}, {"type": "multi_select", "column": "o_orderpriority", "values": ["1-URGENT", "2-HIGH"]}, {"type": "range", "column": "o_totalprice", "min": 1000, "max": 200000}, {"type": "date_range", "column": "o_orderdate", "from": "1994-01-01", "to": "2030-12-31"}]
    return metrics.apply_filters(table(spark, sf_dir, "orders"), chosen).select("o_orderkey")


@query("SELECT event_id FROM events, (SELECT max(ts)::DATE AS d FROM events) WHERE ts::DATE BETWEEN d - 6 AND d")
def filter_last_days(spark, sf_dir):
    return metrics.apply_filters(table(spark, sf_dir, "events"), [{"type": "relative", "column": "ts", "period": "last_7_days"}]).select("event_id")


@query("SELECT o_orderkey FROM orders, (SELECT max(o_orderdate)::DATE AS d FROM orders) WHERE date_trunc('quarter', o_orderdate) = date_trunc('quarter', d) AND o_orderdate::DATE <= d")
def filter_current_quarter(spark, sf_dir):
    return metrics.apply_filters(table(spark, sf_dir, "orders"), [{"type": "relative", "column": "o_orderdate", "period": "current_quarter"}]).select("o_orderkey")


@query('SELECT l_returnflag AS x, l_linestatus AS "group", round(sum(l_quantity), 2) AS value FROM lineitem GROUP BY 1, 2')
def series(spark, sf_dir):
    return _rounded(metrics.series(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity"), 2, "value")


@query("""SELECT o_orderpriority AS x, round(coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 0), 2) AS F, round(coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 0), 2) AS O, round(coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 0), 2) AS P FROM orders GROUP BY 1""")
def pivot(spark, sf_dir):
    return _rounded(metrics.pivot(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", "o_totalprice", ["F", "O", "P"]), 2, "F", "O", "P")


@query("SELECT event_type AS key, round(min(value), 4) AS min, round(quantile_cont(value, 0.25), 4) AS q1, round(median(value), 4) AS median, round(quantile_cont(value, 0.75), 4) AS q3, round(max(value), 4) AS max FROM events GROUP BY 1")
def box(spark, sf_dir):
    return _rounded(metrics.box_stats(table(spark, sf_dir, "events"), "event_type", "value"), 4, "min", "q1", "median", "q3", "max")


_SHARES = " UNION ALL ".join(f"SELECT '{c}' AS name, count(*)::BIGINT AS unique_count, round(max(n) * 100.0 / sum(n), 4)::DOUBLE AS top_share_pct FROM (SELECT {c}, count(*) AS n FROM part GROUP BY 1)" for c in ("p_brand", "p_type", "p_size"))


def _shares(spark, sf_dir) -> DataFrame:
    return metrics.top_share(table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size"])


@query(_SHARES)
def top_share(spark, sf_dir):
    return _rounded(_shares(spark, sf_dir), 4, "top_share_pct")


@query(f"SELECT name, 'pie_chart' AS requested, CASE WHEN unique_count > 50 THEN 'top_n_bar_chart' WHEN unique_count > 15 THEN 'table' WHEN unique_count > 6 OR (unique_count > 5 AND top_share_pct < 25) THEN 'bar_chart' ELSE 'pie_chart' END AS suggested FROM ({_SHARES})")
def chart_suitability(spark, sf_dir):
    return metrics.chart_suitability(_shares(spark, sf_dir))


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, round(min({c}), 4) AS min, round(max({c}), 4) AS max, round(avg({c}), 4) AS mean, CASE WHEN s < -0.5 THEN 'left' WHEN s > 0.5 THEN 'right' ELSE 'normal' END AS skew FROM lineitem, (SELECT sum(({c} - m) ** 3) / count(*) / (sum(({c} - m) ** 2) / count(*)) ** 1.5 AS s FROM lineitem, (SELECT avg({c}) AS m FROM lineitem)) GROUP BY s" for c in ("l_quantity", "l_extendedprice", "l_tax")))
def skew(spark, sf_dir):
    return _rounded(metrics.measure_ranges(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"]).drop("skewness"), 4, "min", "max", "mean")


@query("SELECT strftime(min(o_orderdate), '%Y-%m-%d') AS first, strftime(max(o_orderdate), '%Y-%m-%d') AS last FROM orders")
def date_range(spark, sf_dir):
    return metrics.date_range(table(spark, sf_dir, "orders"), "o_orderdate").select(*[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("first", "last")])


@query("SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1 AS is_first FROM orders")
def first_purchase(spark, sf_dir):
    return metrics.first_occurrence(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_orderkey", "o_custkey", "is_first")


@query("SELECT o_orderkey, o_custkey, coalesce(o_orderdate IS NOT NULL AND row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate NULLS LAST, o_orderkey) = 1, false) AS is_first FROM (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END AS o_orderdate FROM orders)")
def first_purchase_gaps(spark, sf_dir):
    """Orders without a date are never first."""
    orders = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate")))
    return metrics.first_occurrence(orders, "o_custkey", "o_orderdate", "o_orderkey").select("o_orderkey", "o_custkey", "is_first")


@query("SELECT o_custkey AS entity, strftime(max(o_orderdate), '%Y-%m-%d') AS last, floor((epoch_us(TIMESTAMP '2025-01-01') - epoch_us(max(o_orderdate))) / 86400e6) AS days_since FROM orders GROUP BY 1")
def recency(spark, sf_dir):
    return metrics.recency(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "2025-01-01").withColumn("last", F.date_format("last", "yyyy-MM-dd"))


_MASK = "regexp_replace(regexp_replace({c}::VARCHAR, '\\p{{L}}', 'A', 'g'), '\\p{{Nd}}', '#', 'g')"


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, max_by(pattern, (n, pattern)) AS pattern, max(n)::BIGINT AS n, round(max(n) / sum(n), 4)::DOUBLE AS share FROM (SELECT {_MASK.format(c=c)} AS pattern, count(*) AS n FROM part GROUP BY 1)" for c in ("p_brand", "p_type", "p_partkey")))
def pattern_profile(spark, sf_dir):
    return _rounded(metrics.pattern_profile(table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_partkey"]), 4, "share")


@query("SELECT 'amount' AS name, 'suspicious_dtype' AS warning FROM (SELECT count(*) FROM orders) UNION ALL SELECT 'code', 'low_cardinality_id' UNION ALL SELECT 'late', 'high_missing'")
def quality_warnings(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(F.concat(F.lit("about "), "o_totalprice").alias("amount"), F.col("o_orderstatus").alias("code"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).alias("late"))
    return metrics.quality_warnings(roles.guess_roles(profile.profile(df)), metrics.pattern_profile(df, df.columns))


# --- charts and report --------------------------------------------------------------------------


def _points(spark, sf_dir) -> DataFrame:
    df = formula(table(spark, sf_dir, "orders"), "order_month", "month(o_orderdate)")
    months = kpi.grouped_chart(df, {"formula_type": "group_sum", "group_by": "order_month", "value_column": "o_totalprice", "visual": "line_chart"})
    status = kpi.grouped_chart(df, {"formula_type": "group_count", "group_by": "o_orderstatus", "visual": "pie_chart"})
    ranked = [F.desc_nulls_last("value"), F.asc("key")]
    return charts.chart_points({"sales by month": ("line_chart", charts.placed(months, F.asc("key"))), "orders by status": ("pie_chart", charts.placed(status, *ranked))})


_POINTS = """(SELECT 'sales by month' AS chart, 1::INTEGER AS chart_no, 'line' AS type, row_number() OVER (ORDER BY label)::INTEGER AS pos, label, value FROM (SELECT strftime(o_orderdate, '%Y-%m') AS label, sum(o_totalprice) AS value FROM orders GROUP BY 1)
UNION ALL SELECT 'orders by status', 2, 'pie', row_number() OVER (ORDER BY value DESC, label)::INTEGER, label, value FROM (SELECT o_orderstatus AS label, count(*)::DOUBLE AS value FROM orders GROUP BY 1))"""


@query(f"SELECT chart, chart_no, type, pos, label, round(value, 2) AS value FROM {_POINTS}")
def chart_points(spark, sf_dir):
    return _rounded(_points(spark, sf_dir), 2, "value")


@query(f"SELECT chart, max_by(label, (value, -pos)) AS label, round(max(value), 2) AS value FROM {_POINTS} GROUP BY chart")
def insights(spark, sf_dir):
    return _rounded(charts.insights(_points(spark, sf_dir)), 2, "value")


@query(f"SELECT chart, records, pos, label, round(value, 2) AS value FROM (SELECT *, count(*) OVER (PARTITION BY chart) AS records FROM {_POINTS}) WHERE pos <= 5")
def report_top5(spark, sf_dir):
    return charts.report_items(_points(spark, sf_dir))


@query("""SELECT o_orderkey, CASE WHEN v IS NULL THEN '—' WHEN abs(v) >= 1e9 THEN printf('%.2fB', v / 1e9) WHEN abs(v) >= 1e6 THEN printf('%.2fM', v / 1e6) ELSE rtrim(rtrim(format('{:,.2f}', v), '0'), '.') END AS shown
FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN o_custkey * 1e6 WHEN 2 THEN o_custkey * 1e9 ELSE o_custkey + 0.5 END AS v FROM orders)""")
def compact_numbers(spark, sf_dir):
    v = F.expr("CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN o_custkey * 1e6D WHEN 2 THEN o_custkey * 1e9D ELSE o_custkey + 0.5D END")
    return table(spark, sf_dir, "orders").select("o_orderkey", charts.compact(v).alias("shown"))


# --- sources, jobs and logs ---------------------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    return new_path(spark, "io")


@query(" UNION ALL ".join(f"SELECT '{kind}' AS kind, count(*) AS n, sum(c_custkey)::BIGINT AS keys, round(sum(c_acctbal), 2) AS balance, count(DISTINCT c_name) AS names FROM customer" for kind in ("csv", "json", "orc", "parquet")))
def read_write(spark, sf_dir):
    """A table through every format; the CSV header has white space, which reading takes off."""
    folder, customers = _folder(spark), table(spark, sf_dir, "customer")
    totals = []
    for kind in ("csv", "json", "orc", "parquet"):
        spaced = customers.select(*[F.col(c).alias(f" {c} " if kind == "csv" else c) for c in ("c_custkey", "c_name", "c_acctbal")])
        io.write_table(spaced, f"{folder}/customer.{kind}", kind)
        back = io.read_table(spark, f"{folder}/customer.{kind}")
        totals.append(back.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.sum(F.col("c_custkey").cast("long")).alias("keys"), F.round(F.sum(F.col("c_acctbal").cast("double")), 2).alias("balance"), F.count_distinct("c_name").alias("names")))
    return totals[0].union(totals[1]).union(totals[2]).union(totals[3])


@query("SELECT o_orderstatus AS key, count(*)::DOUBLE AS value FROM orders GROUP BY 1")
def write_results(spark, sf_dir):
    """An aggregate as JSON lines, read back."""
    path = f"{_folder(spark)}/status.json"
    io.write_json(kpi.grouped_chart(table(spark, sf_dir, "orders"), {"formula_type": "group_count", "group_by": "o_orderstatus"}).select("key", "value"), path)
    return io.read_table(spark, path)


@query("SELECT 'customer.csv' AS \"table\", 'succeeded' AS status, count(*) AS rows_in, (SELECT count(*) FROM (SELECT DISTINCT * FROM customer)) AS rows_out FROM customer UNION ALL SELECT 'supplier.csv', 'succeeded', count(*), (SELECT count(*) FROM (SELECT DISTINCT * FROM supplier)) FROM supplier")
def batch_folder(spark, sf_dir):
    """A job for each CSV table of a folder."""
    folder = _folder(spark)
    for name in ("customer", "supplier"):
        io.write_table(table(spark, sf_dir, name), f"{folder}/in/{name}.csv", "csv")
    return jobs.batch(spark, f"{folder}/in", f"{folder}/out").select("table", "status", "rows_in", "rows_out")


_DIRTY = "(SELECT CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey % 10 END AS code, CASE WHEN o_orderkey % 7 <> 0 THEN ' ' || (o_orderkey % 11)::VARCHAR END AS amount FROM orders)"


@query(f"""SELECT 'original_rows' AS action, count(*) AS rows, NULL AS columns FROM {_DIRTY}
UNION ALL SELECT 'empty_rows_removed', count(*), NULL FROM {_DIRTY} WHERE code IS NULL AND amount IS NULL HAVING count(*) > 0
UNION ALL SELECT 'repeated_rows_removed', count(*) - count(DISTINCT (code, amount)), NULL FROM {_DIRTY} WHERE code IS NOT NULL HAVING count(*) > count(DISTINCT (code, amount))
UNION ALL SELECT 'text_trimmed', NULL, 'amount'
UNION ALL SELECT 'converted_to_number', NULL, 'amount' FROM {_DIRTY} WHERE code IS NOT NULL HAVING avg((try_cast(trim(amount) AS DOUBLE) IS NOT NULL)::INT) >= 0.9
UNION ALL SELECT 'final_rows', count(DISTINCT (code, amount)), NULL FROM {_DIRTY} WHERE code IS NOT NULL""")
def cleaning_log(spark, sf_dir):
    kept = F.col("o_orderkey") % 7 != 0
    df = table(spark, sf_dir, "orders").select(F.when(kept, F.col("o_custkey") % 10).alias("code"), F.when(kept, F.concat(F.lit(" "), F.col("o_orderkey") % 11)).alias("amount"))
    return clean.clean(df).log.withColumn("columns", F.array_join("columns", ","))


_RENAMES = [("o_totalprice", "price"), ("o_missing", "gone"), ("o_orderstatus", "o_custkey")]


@query("SELECT old AS item, CASE WHEN old NOT IN (SELECT column_name FROM (DESCRIBE orders)) OR new IN (SELECT column_name FROM (DESCRIBE orders)) THEN 'rejected' ELSE 'applied' END AS status, (SELECT count(*) FROM orders) AS n FROM (VALUES " + ", ".join(map(str, _RENAMES)) + ") t(old, new)")
def derive_log(spark, sf_dir):
    """What a plan's renames came to, with the rows of the table that they leave."""
    out, log = derive.apply_schema(table(spark, sf_dir, "orders"), {"rename_columns": [{"old_name": a, "new_name": b} for a, b in _RENAMES]})
    return log.toDF("action", "item", "status", "reason").select("item", "status", F.lit(out.count()).alias("n"))


_FORMULAS = [("abs(o_totalprice)", "abs", "o_totalprice"), ("sqrt(o_custkey)", "sqrt", "o_custkey"), ("abs(o_missing)", "abs", "o_missing"), ("open(o_totalprice)", "open", "o_totalprice")]


@query("SELECT formula, f IN ('abs', 'sqrt', 'log', 'round') AND c IN (SELECT column_name FROM (DESCRIBE orders)) AS valid, CASE WHEN f IN ('abs', 'sqrt', 'log', 'round') AND c IN (SELECT column_name FROM (DESCRIBE orders)) THEN CASE c WHEN 'o_totalprice' THEN (SELECT count(o_totalprice) FROM orders) ELSE (SELECT count(o_custkey) FROM orders) END END AS n FROM (VALUES " + ", ".join(map(str, _FORMULAS)) + ") t(formula, f, c)")
def formula_checks(spark, sf_dir):
    """Which formulas are valid for the table, and the values that the valid ones give."""
    orders = table(spark, sf_dir, "orders")
    out = None
    for text, _, _ in _FORMULAS:
        valid = check_formula(orders, text) is None
        made = formula(orders, "v", text) if valid else orders.withColumn("v", F.lit(None))
        row = made.agg(F.lit(text).alias("formula"), F.lit(valid).alias("valid"), (F.count("v") if valid else F.lit(None).cast("bigint")).alias("n"))
        out = row if out is None else out.union(row)
    return out


@query(" UNION ALL ".join(f"SELECT 'orders by {c}' AS name, CASE WHEN count(DISTINCT {c}) > 6 THEN 'horizontal_bar_chart' ELSE 'pie_chart' END AS visual FROM orders" for c in ("o_orderstatus", "o_orderpriority", "o_custkey")))
def visual_repair(spark, sf_dir):
    """Pies of too many parts become bars."""
    plan = {"kpis": [{"name": f"orders by {c}", "formula_type": "group_count", "group_by": c, "visual": "pie_chart"} for c in ("o_orderstatus", "o_orderpriority", "o_custkey")]}
    accepted, _ = checks.check_kpis(table(spark, sf_dir, "orders"), plan)
    return spark.createDataFrame([(k["name"], k["visual"]) for k in accepted["kpis"]], "name string, visual string")


@query(" UNION ALL ".join(f"SELECT 'm_{c}' AS item, CASE WHEN avg((try_cast({c} AS DOUBLE) IS NOT NULL)::INT) >= 0.75 THEN 'accepted' ELSE 'rejected' END AS status FROM orders" for c in ("o_totalprice", "o_custkey", "o_orderstatus")))
def schema_checks(spark, sf_dir):
    """Products need numeric columns."""
    plan = {"derived_columns": [{"new_column": f"m_{c}", "formula_type": "multiply", "input_columns": [c, "o_totalprice"]} for c in ("o_totalprice", "o_custkey", "o_orderstatus")]}
    return checks.check_schema(table(spark, sf_dir, "orders"), plan)[1].select("item", "status")


_JOB = {"kpis": [{"name": "sales", "formula_type": "sum", "column": "o_totalprice"}, {"name": "by status", "formula_type": "group_sum", "group_by": "o_orderstatus", "value_column": "o_totalprice", "visual": "bar_chart"}]}


@query("SELECT count(*) AS rows_before, (SELECT count(*) FROM (SELECT DISTINCT * FROM orders)) AS rows_after, round(sum(o_totalprice), 0) AS sales, (SELECT max_by(o_orderstatus, v) FROM (SELECT o_orderstatus, sum(o_totalprice) AS v FROM orders GROUP BY 1)) AS best FROM orders")
def report_summary(spark, sf_dir):
    """A whole job over orders: its summary's counts, its card and its first finding."""
    summary = jobs.run(table(spark, sf_dir, "orders"), {}, _JOB).summary
    return summary.select("rows_before", "rows_after", F.round(F.col("kpis")[0]["value"], 0).alias("sales"), F.col("findings")[0]["label"].alias("best"))


@query("SELECT 'by status' AS name, 'bar_chart' AS type, 'o_orderstatus' AS x, 'group_sum' AS aggregation, count(DISTINCT o_orderstatus) AS points FROM orders")
def chart_metadata(spark, sf_dir):
    """What a chart says of itself, with its number of points."""
    made = kpi.compute(table(spark, sf_dir, "orders"), _JOB["kpis"])
    about = made.metadata["by status"]
    return made.charts["by status"].agg(F.lit("by status").alias("name"), *[F.lit(about[k]).alias(k) for k in ("type", "x", "aggregation")], F.count("*").alias("points"))


# --- whole jobs: every chart, log and description ------------------------------------------------

_ALL_CHARTS = {"kpis": [
    {"name": "prices", "formula_type": "histogram", "column": "o_totalprice", "bins": 8},
    {"name": "days", "formula_type": "heatmap", "x_column": "o_orderstatus", "y_column": "o_orderpriority", "value_column": "o_totalprice", "aggregation": "sum"},
    {"name": "first orders", "formula_type": "scatter", "x_column": "o_custkey", "y_column": "o_totalprice", "order_by": ["o_orderkey", "o_custkey", "o_totalprice"], "color_column": "o_orderstatus", "size_column": "o_shippriority"},
    {"name": "by day", "formula_type": "group_sum", "group_by": "o_orderdate", "value_column": "o_totalprice", "visual": "line_chart"},
    {"name": "best customers", "formula_type": "group_sum", "group_by": "o_custkey", "value_column": "o_totalprice", "visual": "bar_chart", "top_n": 5},
    {"name": "lost", "formula_type": "group_sum", "group_by": "o_missing", "value_column": "o_totalprice"},
    {"name": "worded", "formula_type": "sum", "column": "o_orderstatus"},
    {"name": "orders", "formula_type": "count_rows"},
]}
_ORDERS = "(SELECT DISTINCT * FROM orders)"


def _saved_job(spark: SparkSession, sf_dir: str, result: str) -> DataFrame:
    """A result of a whole job over orders, as it was written and is read again."""
    folder = _folder(spark)
    orders = table(spark, sf_dir, "orders").withColumn("o_shippriority", F.col("o_custkey") % 3)
    schema = {"rename_columns": [{"old_name": "o_nothing", "new_name": "x"}], "derived_columns": [{"name": "month_", "formula": "month(o_orderdate)"}, {"name": "half", "formula": "open(o_totalprice)"}, {"name": "double", "formula_type": "multiply", "input_columns": ["o_totalprice", "o_orderstatus"]}, {"name": "year_", "formula_type": "extract_year", "input_columns": ["o_orderdate"]}]}
    jobs.save(jobs.run(orders, schema, _ALL_CHARTS), folder)
    return spark.read.json(f"{folder}/{result}")


@query(f"""WITH o AS {_ORDERS}, r AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM o),
e AS (SELECT i + 1 AS pos, CASE WHEN i = 0 THEN lo - 0.001 * (hi - lo) ELSE lo + (hi - lo) * i / 8 END AS x, CASE WHEN i = 7 THEN hi ELSE lo + (hi - lo) * (i + 1) / 8 END AS y FROM r, range(8) t(i)),
f AS (SELECT * FROM o ORDER BY o_orderkey, o_custkey, o_totalprice LIMIT 500)
SELECT 'prices' AS chart, 1 AS chart_no, 'histogram' AS type, pos, NULL AS label, NULL AS series, round(x, 4) AS x, round(y, 4) AS y, count(o_totalprice)::DOUBLE AS value, NULL AS size FROM e LEFT JOIN o ON o_totalprice > x AND o_totalprice <= y GROUP BY ALL
UNION ALL SELECT 'days', 2, 'heatmap', row_number() OVER (ORDER BY o_orderstatus, o_orderpriority), o_orderstatus, o_orderpriority, NULL, NULL, round(sum(o_totalprice), 2), NULL FROM o GROUP BY o_orderstatus, o_orderpriority
UNION ALL SELECT 'first orders', 3, 'scatter', row_number() OVER (ORDER BY o_orderkey, o_custkey, o_totalprice), NULL, o_orderstatus, o_custkey, round(o_totalprice, 4), round(o_totalprice, 2), (o_custkey % 3)::DOUBLE FROM f
UNION ALL SELECT 'by day', 4, 'line', row_number() OVER (ORDER BY o_orderdate), strftime(o_orderdate, '%Y-%m-%d'), NULL, NULL, NULL, round(sum(o_totalprice), 2), NULL FROM o GROUP BY o_orderdate
UNION ALL (SELECT 'best customers', 5, 'bar', row_number() OVER (ORDER BY sum(o_totalprice) DESC, o_custkey), o_custkey::VARCHAR, NULL, NULL, NULL, round(sum(o_totalprice), 2), NULL FROM o GROUP BY o_custkey ORDER BY sum(o_totalprice) DESC, o_custkey LIMIT 5)""")
def job_charts(spark, sf_dir):
    """The points of a job's histogram, heatmap, point cloud, line and bars, read back from its results."""
    points = _saved_job(spark, sf_dir, "chart_points")
    label = F.when(F.col("type") == "line", F.substring("label", 1, 10)).when(F.col("type").isin("heatmap", "bar"), F.col("label"))
    return _rounded(points.select("chart", "chart_no", "type", "pos", label.alias("label"), "series", "x", "y", "value", "size"), 4, "x", "y").withColumn("value", F.round("value", 2))


@query("""WITH n AS (SELECT avg((try_cast(o_orderstatus AS DOUBLE) IS NOT NULL)::INT) >= 0.8 AS numbers FROM orders)
SELECT unnest(['prices', 'days', 'first orders', 'by day', 'best customers', 'lost', 'worded', 'orders']) AS item, unnest(['accepted', 'accepted', 'accepted', 'accepted', 'accepted', CASE WHEN (SELECT count(*) FROM (DESCRIBE orders) WHERE column_name = 'o_missing') = 0 THEN 'rejected' ELSE 'accepted' END, CASE WHEN numbers THEN 'accepted' ELSE 'rejected' END, 'accepted']) AS status FROM n""")
def job_kpi_log(spark, sf_dir):
    """What became of a plan's KPIs: one names a missing column, one sums texts."""
    return _saved_job(spark, sf_dir, "kpi_log").select("item", "status")


@query("""WITH n AS (SELECT avg((try_cast(o_orderstatus AS DOUBLE) IS NOT NULL)::INT) >= 0.8 AS numbers, avg((try_cast(o_orderdate AS TIMESTAMP) IS NOT NULL)::INT) >= 0.7 AS dates FROM orders)
SELECT unnest(['o_nothing', 'month_', 'half', 'double', 'year_']) AS item, unnest(['rename', 'derive', 'derive', 'derive', 'derive']) AS kind,
  unnest(['rejected', 'accepted', 'rejected', CASE WHEN numbers THEN 'accepted' ELSE 'rejected' END, CASE WHEN dates THEN 'accepted' ELSE 'rejected' END]) AS status FROM n""")
def job_schema_log(spark, sf_dir):
    """What became of a plan's renames and derived columns."""
    return _saved_job(spark, sf_dir, "schema_log").select("item", "kind", "status")


@query(f"""SELECT unnest(['o_custkey', 'o_orderstatus', 'month_', 'year_']) AS name, unnest(['number', 'text', 'datetime', 'number']) AS detected_type, unnest([c, s, m, y]) AS unique_count
FROM (SELECT count(DISTINCT o_custkey) AS c, count(DISTINCT o_orderstatus) AS s, count(DISTINCT strftime(o_orderdate, '%Y-%m')) AS m, count(DISTINCT year(o_orderdate)) AS y FROM {_ORDERS})""")
def job_metadata(spark, sf_dir):
    """What a job says of its enriched table, derived columns included."""
    return _saved_job(spark, sf_dir, "metadata").where(F.col("name").isin("o_custkey", "o_orderstatus", "month_", "year_")).select("name", "detected_type", "unique_count")


@query("""SELECT CASE WHEN grouping(l_returnflag) = 0 THEN 'flag' WHEN grouping(l_linestatus) = 0 THEN 'status' WHEN grouping(l_suppkey) = 0 THEN 'supplier' WHEN grouping(l_linenumber) = 0 THEN 'line' ELSE 'tax' END AS chart,
  coalesce(l_returnflag, l_linestatus, l_suppkey::VARCHAR, l_linenumber::VARCHAR, l_tax::VARCHAR) AS label,
  round(CASE WHEN grouping(l_returnflag) = 0 THEN sum(l_quantity) WHEN grouping(l_linestatus) = 0 THEN avg(l_discount) WHEN grouping(l_suppkey) = 0 THEN max(l_extendedprice) WHEN grouping(l_linenumber) = 0 THEN count(*) FILTER (WHERE l_quantity > 25) ELSE stddev_samp(l_quantity) END, 4) AS value
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (l_suppkey), (l_linenumber), (l_tax))""")
def group_sets(spark, sf_dir):
    """Charts of five keys from one scan."""
    specs = {
        "flag": {"formula_type": "group_sum", "group_by": "l_returnflag", "value_column": "l_quantity"}, "status": {"formula_type": "group_average", "group_by": "l_linestatus", "value_column": "l_discount"},
        "supplier": {"formula_type": "group_max", "group_by": "l_suppkey", "value_column": "l_extendedprice"}, "line": {"formula_type": "group_count", "group_by": "l_linenumber", "filter_condition": "l_quantity > 25"},
        "tax": {"formula_type": "group_std", "group_by": "l_tax", "value_column": "l_quantity"},
    }
    made = kpi.grouped_sets(table(spark, sf_dir, "lineitem"), {s["group_by"]: [s] for s in specs.values()})
    parts = [made[s["group_by"]][0].select(F.lit(name).alias("chart"), F.col("key").cast("string").alias("label"), F.round("value", 4).alias("value")) for name, s in specs.items()]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).union(parts[4])


@query("SELECT row_number() OVER (ORDER BY n DESC, key) AS pos, key, n FROM (SELECT l_orderkey AS key, count(*) AS n FROM lineitem GROUP BY 1)")
def group_positions(spark, sf_dir):
    """All groups numbered by their size, without a window over them."""
    groups = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.count("*").alias("n"))
    return charts.positions(groups, F.desc("n"), F.asc("key"))


@query("""SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey, copy) = 1 AS is_first FROM (SELECT DISTINCT o_orderkey, o_custkey, o_orderdate FROM orders), range(3) t(copy)""")
def first_purchase_copies(spark, sf_dir):
    """Of three copies of each order, one is first if the order is."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate").distinct()
    return metrics.first_occurrence(orders.union(orders).union(orders), "o_custkey", "o_orderdate", "o_orderkey").select("o_orderkey", "o_custkey", "is_first")


@query("""SELECT 'customer.csv' AS "table", 'succeeded' AS status, count(*) AS rows_in FROM customer UNION ALL SELECT 'empty.csv', 'failed', NULL UNION ALL SELECT 'supplier.csv', 'succeeded', count(*) FROM supplier""")
def batch_failures(spark, sf_dir):
    """A table without a header fails and the others go on."""
    folder = _folder(spark)
    for name in ("customer", "supplier"):
        io.write_table(table(spark, sf_dir, name), f"{folder}/in/{name}.csv", "csv")
    table(spark, sf_dir, "customer").select("c_name").limit(0).write.text(f"{folder}/in/empty.csv")
    return jobs.batch(spark, f"{folder}/in", f"{folder}/out").select("table", "status", "rows_in")


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_name || ' é' AS name FROM customer UNION ALL SELECT c_custkey::VARCHAR, c_name || ' ü' FROM customer")
def read_encodings(spark, sf_dir):
    """The same reader finds out UTF-8 and Latin-1."""
    folder, out = _folder(spark), None
    for encoding, letter in (("UTF-8", "é"), ("ISO-8859-1", "ü")):
        named = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit(f" {letter}")).alias("name"))
        named.write.options(header=True, encoding=encoding).csv(f"{folder}/{encoding}.csv")
        read = io.read_table(spark, f"{folder}/{encoding}.csv", "auto")
        out = read if out is None else out.union(read)
    return out


@query("SELECT l_returnflag AS key, round(median(l_extendedprice), 4) AS value FROM lineitem GROUP BY 1")
def median_selection(spark, sf_dir):
    """Medians of groups of many different values, none of which is gathered."""
    spec = {"formula_type": "group_median", "group_by": "l_returnflag", "value_column": "l_extendedprice", "bounded": True}
    return _rounded(kpi.grouped_chart(table(spark, sf_dir, "lineitem"), spec).select("key", "value"), 4, "value")


@query("SELECT o_orderpriority AS key, round(min(o_totalprice), 4) AS min, round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.75), 4) AS q3, round(max(o_totalprice), 4) AS max FROM orders GROUP BY 1")
def box_selection(spark, sf_dir):
    """Quartiles by rounds over the table, in bounded memory."""
    return _rounded(metrics.box_stats(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", bounded=True), 4, "min", "q1", "median", "q3", "max")


@query("""SELECT name, row_count, missing_count, round(mean, 4) AS mean, true AS near FROM (
  SELECT 'o_totalprice' AS name, count(*) AS row_count, count(*) - count(o_totalprice) AS missing_count, avg(o_totalprice) AS mean FROM orders
  UNION ALL SELECT 'o_orderstatus', count(*), count(*) - count(o_orderstatus), NULL FROM orders UNION ALL SELECT 'o_custkey', count(*), count(*) - count(o_custkey), avg(o_custkey) FROM orders)""")
def profile_merged(spark, sf_dir):
    """The profile of a table from the stored sketches of its parts, whose estimates of different values are held against exact counts."""
    orders = table(spark, sf_dir, "orders").select("o_totalprice", "o_orderstatus", "o_custkey")
    parts = [orders.where(f"o_custkey % 3 = {i}") for i in range(2)] + [orders.where("coalesce(o_custkey % 3, 2) = 2")]
    folder = _folder(spark)
    for i, part in enumerate(parts):
        io.write_table(profile.sketches(part), f"{folder}/{i}")
    made = profile.described(profile.merged(spark.read.parquet(*[f"{folder}/{i}" for i in range(3)])))
    exact = profile.distinct_counts(orders)
    near = made.join(exact, "position").withColumn("near", F.abs(F.col("unique_count") - F.col("unique")) <= 0.06 * F.col("unique") + 1)
    return near.select("name", "row_count", "missing_count", F.round("mean", 4).alias("mean"), "near")


@query("""WITH t AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS i, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'none' ELSE o_custkey::VARCHAR END AS code FROM (SELECT DISTINCT o_orderkey, o_custkey, o_orderpriority FROM orders)),
c AS (SELECT code FROM t WHERE code IS NOT NULL ORDER BY i LIMIT 100), p AS (SELECT o_orderpriority FROM t WHERE o_orderpriority IS NOT NULL ORDER BY i LIMIT 100)
SELECT 'code' AS name, count(*) AS n, count(try_cast(code AS DOUBLE)) AS numbers FROM c UNION ALL SELECT 'o_orderpriority', count(*), count(try_cast(o_orderpriority AS DOUBLE)) FROM p""")
def first_values(spark, sf_dir):
    """Numbers among the first hundred values of each column in the table's order."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority").distinct()
    code = F.expr("CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'none' ELSE cast(o_custkey AS string) END")
    return profile.first_values(orders.withColumn("code", code), ["o_orderkey"], 100, ["code", "o_orderpriority"]).select("name", "n", "numbers")
