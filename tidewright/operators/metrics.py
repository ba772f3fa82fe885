"""Declared metrics over aggregated rows: shares, running totals, growth, rankings, filters, box plots, recency, patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import col, dt, num
from ..functions.formula import date_diff
from ..sources.scratch import stored
from .kpi import aggregate, grouped
from .profile import row_digest
from .quantiles import exact_quantiles

# Thresholds of warnings and of chart suitability.
HIGH_MISSING = 60.0
PIE_CATEGORIES, TABLE_CATEGORIES, LARGE_CATEGORIES, PIE_SHARE = 6, 15, 50, 25.0


def pct_of_total(groups: DataFrame, value: str = "value") -> DataFrame:
    """groups with pct_of_total. The total is one number, read first, so that the groups stay in their partitions."""
    whole = groups.agg(F.sum(value).cast("double")).first()[0]
    return groups.withColumn("pct_of_total", F.try_divide(F.col(value) * 100, F.lit(whole).cast("double")))


def by_period(df: DataFrame, date: str, value: str, unit: str = "month", kind: str = "sum") -> DataFrame:
    """(period, value): one row a period; periods are few, whatever the table's size."""
    return df.groupBy(F.date_trunc(unit, dt(df, date)).alias("period")).agg(aggregate(kind, num(df, value)).alias("value")).where("period is not null")


def running_total(periods: DataFrame, by: list[str] | None = None) -> DataFrame:
    return periods.withColumn("running_total", F.sum("value").over(Window.partitionBy(*(by or [])).orderBy("period").rowsBetween(Window.unboundedPreceding, 0)))


def growth_rate(periods: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(value - previous) / previous, against the period before it in the table; null for the first and after a zero."""
    before = F.lag("value").over(Window.partitionBy(*(by or [])).orderBy("period"))
    return periods.withColumn("previous", before).withColumn("growth_rate", F.try_divide(F.col("value") - F.col("previous"), F.col("previous")))


def vs_previous_period(periods: DataFrame) -> DataFrame:
    """One row: the last period against the one before, with delta_pct and direction."""
    last = growth_rate(periods).orderBy(F.desc("period")).limit(1)
    way = F.when(F.col("value") > F.col("previous"), "up").when(F.col("value") < F.col("previous"), "down").when(F.col("value") == F.col("previous"), "flat")
    return last.select("period", "value", "previous", (F.col("growth_rate") * 100).alias("delta_pct"), way.alias("direction"))


def ranking(df: DataFrame, group_by: str, value: str, n: int, kind: str = "sum", direction: str = "top") -> DataFrame:
    """(rank, key, value) of the n first or last groups; equal values by key."""
    groups = grouped(df, group_by, {"value": aggregate(kind, num(df, value))})
    order = [F.desc_nulls_last("value") if direction == "top" else F.asc_nulls_last("value"), F.asc_nulls_last("key")]
    # the window sees n rows
    return groups.orderBy(*order).limit(n).select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "key", "value")


def apply_filters(df: DataFrame, filters: list[dict], as_of: str | None = None) -> DataFrame:
    """df under dashboard filters: single_select, multi_select, range, date_range (both ends count), relative (last_N_days, current_quarter)."""
    for f in filters:
        name, kind = f["column"], f["type"]
        if kind == "single_select":
            df = df.where(col(name) == F.lit(f["value"]))
        elif kind == "multi_select":
            df = df.where(col(name).isin(f["values"]))
        elif kind == "range":
            df = df.where(num(df, name).between(f["min"], f["max"]))
        elif kind == "date_range":
            df = df.where(F.to_date(dt(df, name)).between(F.lit(f["from"]).cast("date"), F.lit(f["to"]).cast("date")))
        elif kind == "relative":
            df = df.where(relative(dt(df, name), f["period"], _as_of(df, name, as_of)))
        else:
            raise ValueError(f"unknown filter {kind}")
    return df


def _as_of(df: DataFrame, name: str, as_of: str | None) -> Column:
    day = as_of or df.agg(F.max(F.to_date(dt(df, name))).cast("string")).first()[0]
    return F.lit(day).cast("date")


def relative(when: Column, period: str, as_of: Column) -> Column:
    """last_N_days (as_of and the N - 1 days before it) or current_quarter."""
    day = F.to_date(when)
    if period == "current_quarter":
        return (F.date_trunc("quarter", day) == F.date_trunc("quarter", as_of)) & (day <= as_of)
    n = int(period.removeprefix("last_").removesuffix("_days"))
    return day.between(F.date_sub(as_of, n - 1), as_of)


def series(df: DataFrame, x: str, group: str, value: str, kind: str = "sum") -> DataFrame:
    """(x, group, value): one line of points a group."""
    return grouped(df, [x, group], {"value": aggregate(kind, num(df, value))}, ["x", "group"])


def pivot(df: DataFrame, x: str, group: str, value: str, groups: list, kind: str = "sum") -> DataFrame:
    """One row an x, one column for each of the named groups; conditional aggregates in one pass."""
    return grouped(df, x, {str(g): aggregate(kind, num(df, value), col(group) == F.lit(g)) for g in groups}, ["x"])


def box_stats(df: DataFrame, group_by: str, value: str, approx: bool = False, bounded: bool = False) -> DataFrame:
    """key, min, q1, median, q3, max. Exact quartiles count each different value of a group in memory; bounded finds the same by
    rounds over the table, in bounded memory; approx takes one pass in bounded memory."""
    at, names = [0.25, 0.5, 0.75], ("q1", "median", "q3")
    if bounded:
        rows = exact_quantiles(df, group_by, value, at)
    else:
        v = num(df, value)
        q = F.percentile_approx(v, at, 10_000) if approx else F.percentile(v, at)
        rows = df.groupBy(col(group_by).alias("key")).agg(F.min(v).alias("min"), q.alias("q"), F.max(v).alias("max"))
    return rows.select("key", "min", *[F.col("q")[i].alias(n) for i, n in enumerate(names)], "max")


def top_share(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, unique_count, top_share_pct) per column: the share of rows in its largest category; all columns share one shuffle."""
    cells = F.inline(F.array(*[F.struct(F.lit(c).alias("name"), col(c).cast("string").alias("category")) for c in columns]))
    counts = df.select(cells).groupBy("name", "category").agg(F.count("*").alias("n"))
    return counts.groupBy("name").agg(F.count("category").alias("unique_count"), (F.max(F.when(F.col("category").isNotNull(), F.col("n"))) * 100.0 / F.sum("n")).alias("top_share_pct"))


def measure_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, min, max, mean, skewness, skew) per column; skew is left below -0.5, right above 0.5, else normal."""
    aggs = [f(num(df, c)).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("skewness", F.skewness))]
    row = df.agg(*aggs)
    items = [F.struct(F.lit(c).alias("name"), *[F.col(f"{n}{i}").alias(n) for n in ("min", "max", "mean", "skewness")]) for i, c in enumerate(columns)]
    skew = F.when(F.col("skewness") < -0.5, "left").when(F.col("skewness") > 0.5, "right").when(F.col("skewness").isNotNull(), "normal")
    return row.select(F.inline(F.array(*items))).withColumn("skew", skew)


def date_range(df: DataFrame, date: str) -> DataFrame:
    return df.agg(F.min(dt(df, date)).alias("first"), F.max(dt(df, date)).alias("last"))


def first_occurrence(df: DataFrame, entity: str, date: str, tie: str) -> DataFrame:
    """df with is_first: exactly one row of each entity, its first by date, then by tie, then by a digest of the whole row.

    The firsts are found by partial aggregation, so that a large entity fills no window, and both sides of the join are
    tables, so that its rows can be split. Rows that are equal throughout are told apart by their place in the table that
    the first rows are written to: one of them is first. Rows without a date, or without an entity, are never first; a
    missing tie comes before all others.
    """
    spare = [f"first{i}_" for i in range(4)]
    if {c.lower() for c in df.columns} & {*spare, "is_first"}:
        raise ValueError("is_first and the columns first0_ to first3_ are made here")
    who, when, which, place = spare
    order = F.when(col(entity).isNotNull() & dt(df, date).isNotNull(), F.struct(dt(df, date).alias("d"), col(tie).alias("t"), row_digest(df).alias("r")))
    tagged = df.withColumn(when, order)
    first = stored(tagged.where(F.col(when).isNotNull()).groupBy(col(entity).alias(who)).agg(F.min(when).alias(which)), "first-rows")
    joined = tagged.join(first, col(entity) == F.col(who), "left")
    is_one = F.coalesce(F.col(when) == F.col(which), F.lit(False))
    names = [col(c) for c in df.columns]
    # mostly one row an entity; copies of it besides
    found = stored(joined.where(is_one).select(*names, F.monotonically_increasing_id().alias(place)), "found")
    lead = stored(found.groupBy(col(entity).alias(who)).agg(F.min(place).alias(which)), "leading")
    marked = found.join(lead, col(entity) == F.col(who)).select(*names, (F.col(place) == F.col(which)).alias("is_first"))
    return joined.where(~is_one).select(*names, F.lit(False).alias("is_first")).union(marked)


def recency(df: DataFrame, entity: str, date: str, as_of: str) -> DataFrame:
    """(entity, last, days_since): per entity, whole days from its last row to as_of."""
    last = df.groupBy(col(entity).alias("entity")).agg(F.max(dt(df, date)).alias("last"))
    return last.withColumn("days_since", date_diff(F.lit(as_of).cast("timestamp"), F.col("last"), "days"))


def mask(c: Column) -> Column:
    """Letters as A, digits as #; nothing else of the value is changed."""
    return F.regexp_replace(F.regexp_replace(c.cast("string"), r"\p{L}", "A"), r"\p{Nd}", "#")


def pattern_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, pattern, n, share) of the most frequent mask of every column; no value of the table is shown."""
    cells = F.inline(F.array(*[F.struct(F.lit(c).alias("name"), mask(col(c)).alias("pattern")) for c in columns]))
    counts = df.select(cells).where("pattern is not null").groupBy("name", "pattern").agg(F.count("*").alias("n"))
    best = counts.groupBy("name").agg(F.max(F.struct("n", "pattern")).alias("best"), F.sum("n").alias("all"))
    return best.select("name", F.col("best.pattern").alias("pattern"), F.col("best.n").alias("n"), (F.col("best.n") / F.col("all")).alias("share"))


def quality_warnings(roles: DataFrame, masks: DataFrame, low_ratio: float = 0.5, pattern_share: float = 0.5) -> DataFrame:
    """(name, warning) over profile rows: high_missing, low_cardinality_id, inconsistent_pattern, suspicious_dtype."""
    rows = roles.join(masks.select("name", "share"), "name", "left")
    tests = {
        "high_missing": F.col("missing_percent") > HIGH_MISSING,
        "low_cardinality_id": F.col("role_guess").isin("id", "identifier") & (F.col("exact_ratio") < low_ratio),
        "inconsistent_pattern": F.col("role_guess").isin("id", "identifier") & (F.col("share") < pattern_share),
        "suspicious_dtype": F.col("role_guess").isin("money", "quantity") & (F.col("detected_type") != "number") | ((F.col("role_guess") == "date") & (F.col("detected_type") == "text")),
    }
    found = F.filter(F.array(*[F.when(t, n) for n, t in tests.items()]), lambda w: w.isNotNull())
    return rows.select("name", F.explode(found).alias("warning"))


def chart_suitability(shares: DataFrame, requested: str = "pie_chart") -> DataFrame:
    """(name, requested, suggested) over rows of top_share: many categories and weak leaders make other charts."""
    n = F.col("unique_count")
    weak = (n > PIE_CATEGORIES - 1) & (F.col("top_share_pct") < PIE_SHARE)
    suggested = F.when(n > LARGE_CATEGORIES, "top_n_bar_chart").when(n > TABLE_CATEGORIES, "table")
    if requested in ("pie_chart", "donut_chart"):
        suggested = suggested.when((n > PIE_CATEGORIES) | weak, "bar_chart")
    return shares.select("name", F.lit(requested).alias("requested"), suggested.otherwise(requested).alias("suggested"))
