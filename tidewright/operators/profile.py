"""Column profiles: one row a column, from one pass for counts and ranges and one for distinct values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import col, dt, is_date, is_number, nan_to_null, num

# Shares of non-null values that must parse for a type.
NUMBER_SHARE = 0.85
DATE_SHARE = 0.75


def _parse_rate(parsed: Column, name: str) -> Column:
    return F.avg(F.when(col(name).isNotNull(), parsed.isNotNull().cast("double")))


def type_of(t: T.DataType, number_rate: Column, date_rate: Column) -> Column:
    """number, datetime, text or unknown (nothing but nulls); numbers are tried first."""
    if is_number(t):
        return F.lit("number")
    if is_date(t):
        return F.lit("datetime")
    return F.when(number_rate.isNull(), "unknown").when(number_rate >= NUMBER_SHARE, "number").when(date_rate >= DATE_SHARE, "datetime").otherwise("text")


def profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """name, detected_type, row_count, missing_count, missing_percent, unique_count, unique_ratio, min, max, mean, min_date, max_date.

    Type rates cover the whole column. approx: distinct counts within 1 %, from the same single pass.
    """
    df = nan_to_null(df)
    names = df.columns
    exprs = [F.count("*").alias("rows")]
    for i, c in enumerate(names):
        t, n, d = df.schema[c].dataType, num(df, c), dt(df, c)
        exprs += [F.count(col(c)).alias(f"n{i}"), F.min(n).alias(f"lo{i}"), F.max(n).alias(f"hi{i}"), F.avg(n).alias(f"mean{i}"), F.min(d).alias(f"from{i}"), F.max(d).alias(f"to{i}")]
        if isinstance(t, T.StringType):
            exprs += [_parse_rate(n, c).alias(f"nr{i}"), _parse_rate(d, c).alias(f"dr{i}")]
        if approx:
            exprs.append(F.approx_count_distinct(col(c), 0.01).alias(f"u{i}"))
    rows = []
    for i, c in enumerate(names):
        t = df.schema[c].dataType
        rates = (F.col(f"nr{i}"), F.col(f"dr{i}")) if isinstance(t, T.StringType) else (F.lit(None).cast("double"),) * 2
        kind = type_of(t, *rates) if isinstance(t, T.StringType) or is_number(t) or is_date(t) else F.lit("text")
        values = {"name": F.lit(c), "position": F.lit(i), "detected_type": kind, "row_count": F.col("rows"), "present": F.col(f"n{i}"), "unique": F.col(f"u{i}") if approx else F.lit(None).cast("long")}
        values |= {"min": F.col(f"lo{i}"), "max": F.col(f"hi{i}"), "mean": F.col(f"mean{i}"), "min_date": F.col(f"from{i}"), "max_date": F.col(f"to{i}")}
        rows.append(F.struct(*[v.alias(k) for k, v in values.items()]))
    out = df.agg(*exprs).select(F.inline(F.array(*rows)))
    if not approx:
        out = out.drop("unique").join(F.broadcast(distinct_counts(df)), "position", "left").withColumn("unique", F.coalesce("unique", F.lit(0)))
    number, date = F.col("detected_type") == "number", F.col("detected_type") == "datetime"
    missing, unique = F.col("row_count") - F.col("present"), F.col("unique").cast("long")
    return out.select(
        "name", "position", "detected_type", "row_count", missing.alias("missing_count"), F.bround(missing / F.greatest("row_count", F.lit(1)) * 100, 2).alias("missing_percent"),
        unique.alias("unique_count"), F.bround(unique / F.greatest("row_count", F.lit(1)), 4).alias("unique_ratio"), (unique / F.greatest("row_count", F.lit(1))).alias("exact_ratio"),
        *[F.when(number, F.col(c)).alias(c) for c in ("min", "max", "mean")], *[F.when(date, F.col(c).cast("string")).alias(c) for c in ("min_date", "max_date")],
    )


def distinct_counts(df: DataFrame) -> DataFrame:
    """(position, unique) of every column: values go through one shuffle as 16-byte digests, partly combined before it."""
    cells = F.array(*[F.when(col(c).isNotNull(), F.struct(F.lit(i).alias("position"), F.unhex(F.md5(value_bytes(df, c))).alias("digest"))) for i, c in enumerate(df.columns)])
    return df.select(F.explode(F.filter(cells, lambda x: x.isNotNull())).alias("c")).select("c.*").distinct().groupBy("position").agg(F.count("*").alias("unique"))


def value_bytes(df: DataFrame, name: str) -> Column:
    """A column's values as bytes, equal if and only if the values are."""
    t = df.schema[name].dataType
    if isinstance(t, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(F.struct(col(name))).cast("binary")
    c = col(name) + 0.0 if isinstance(t, (T.DoubleType, T.FloatType)) else col(name)
    return c if isinstance(t, T.BinaryType) else c.cast("string").cast("binary")


def row_digest(df: DataFrame) -> Column:
    """128 bits of a whole row, missing equal to missing."""
    cells = [F.when(col(c).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.hex(value_bytes(df, c)), F.lit("."))) for c in df.columns]
    return F.unhex(F.md5(F.concat(*cells).cast("binary")))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """(row_count, column_count, duplicate_rows): rows that repeat an earlier one, missing equal to missing; rows are told apart by 128-bit digests."""
    df = nan_to_null(df)
    counts = df.groupBy(row_digest(df).alias("d")).agg(F.count("*").alias("n"))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.lit(len(df.columns)).cast("long").alias("column_count"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


#: Binary logarithm of the registers of a distinct sketch: estimates within about 1.6 %.
_DISTINCT_BITS = 12
_QUANTILE_SIZE = 200


def sketches(df: DataFrame) -> DataFrame:
    """What can be merged of a table's profile: one row a column with counts, sums, ranges, and sketches of its different values and of its numbers.

    From one pass; each row takes a few kilobytes whatever the table's size.
    """
    df = nan_to_null(df)
    exprs, rows = [F.count("*").alias("rows")], []
    for i, c in enumerate(df.columns):
        n, d = num(df, c), dt(df, c)
        present = F.when(col(c).isNotNull(), F.concat(F.lit("v").cast("binary"), value_bytes(df, c)))
        made = {
            "present": F.count(col(c)), "numbers": F.count(n), "dates": F.count(d), "total": F.sum(n), "min": F.min(n), "max": F.max(n), "first": F.min(d), "last": F.max(d),
            "values_": F.hll_sketch_agg(present, _DISTINCT_BITS), "numbers_": F.kll_sketch_agg_double(n, F.lit(_QUANTILE_SIZE)),
        }
        exprs += [e.alias(f"{k}{i}") for k, e in made.items()]
        rows.append(F.struct(F.lit(c).alias("name"), F.lit(i).alias("position"), F.col("rows").alias("rows"), *[F.col(f"{k}{i}").alias(k) for k in made]))
    return df.agg(*exprs).select(F.inline(F.array(*rows)))


def merged(parts: DataFrame) -> DataFrame:
    """Rows of sketches of several tables (a union of them, or what was stored), one for each column name: as if of all rows together. A column that
    a table does not have is missing there only from the values, not from the rows: tables count the rows that have the column."""
    sums = [F.sum(c).alias(c) for c in ("rows", "present", "numbers", "dates", "total")]
    ends = [f(c).alias(c) for f, c in ((F.min, "min"), (F.max, "max"), (F.min, "first"), (F.max, "last"))]
    return parts.groupBy("name").agg(F.min("position").alias("position"), *sums, *ends, F.hll_union_agg("values_").alias("values_"), F.kll_merge_agg_double("numbers_").alias("numbers_"))


def described(parts: DataFrame, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """The profile that sketches stand for: name, detected_type, counts, unique_count (estimated), range and mean of numbers, quantiles (estimated), range of dates."""
    number_rate, date_rate = F.col("numbers") / F.col("present"), F.col("dates") / F.col("present")
    kind = type_of(T.StringType(), F.when(F.col("present") > 0, number_rate), F.when(F.col("present") > 0, date_rate))
    rows = parts.withColumn("detected_type", kind)
    number, date, missing = F.col("detected_type") == "number", F.col("detected_type") == "datetime", F.col("rows") - F.col("present")
    # a sketch of no numbers has no quantiles
    places = F.when(number & (F.col("numbers") > 0), F.array(*[F.kll_sketch_get_quantile_double("numbers_", F.lit(q)) for q in quantiles]))
    return rows.select(
        "name", "position", "detected_type", F.col("rows").alias("row_count"), missing.alias("missing_count"), F.bround(missing / F.greatest("rows", F.lit(1)) * 100, 2).alias("missing_percent"), F.hll_sketch_estimate("values_").alias("unique_count"),
        F.when(number, F.col("min")).alias("min"), F.when(number, F.col("max")).alias("max"), F.when(number, F.col("total") / F.col("numbers")).alias("mean"), places.alias("quantiles"), F.when(date, F.col("first")).alias("min_date"), F.when(date, F.col("last")).alias("max_date"),
    )


def first_values(df: DataFrame, order_by: list[str], k: int, columns: list[str] | None = None) -> DataFrame:
    """(name, n, numbers, dates): of the first k non-null values of every column, in the table's order, how many are numbers and dates.

    One pass: each task keeps the k first of each column it has seen, and the k first of those remain. Rows of equal order
    are told apart by their whole content.
    """
    names = columns or df.columns
    order = F.struct(*[F.struct(col(c).isNull().alias("none"), col(c).alias("v")) for c in order_by], row_digest(df).alias("row"))
    cells = F.array(*[F.when(col(c).isNotNull(), F.struct(F.lit(c).alias("name"), F.struct(order.alias("order"), num(df, c).isNotNull().alias("number"), dt(df, c).isNotNull().alias("date")).alias("cell"))) for c in names])
    seen = df.select(F.inline(F.filter(cells, lambda c: c.isNotNull())))
    # the first k of each task, then of all: a bounded number of rows for each column and task
    part = Window.partitionBy("name", "task").orderBy(F.col("cell.order"))
    some = seen.withColumn("task", F.pmod(F.xxhash64("cell.order.row"), F.lit(_PARTS))).withColumn("at", F.row_number().over(part)).where(F.col("at") <= k)
    first = some.withColumn("at", F.row_number().over(Window.partitionBy("name").orderBy(F.col("cell.order")))).where(F.col("at") <= k)
    counts = first.groupBy("name").agg(F.count("*").alias("n"), F.sum(F.col("cell.number").cast("long")).alias("numbers"), F.sum(F.col("cell.date").cast("long")).alias("dates"))
    return df.sparkSession.createDataFrame([(c,) for c in names], "name string").join(F.broadcast(counts), "name", "left").na.fill(0)


#: Parts in which the first values of a column are looked for before those of all parts are compared.
_PARTS = 256
