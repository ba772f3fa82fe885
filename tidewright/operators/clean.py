"""Cleaning: empty and repeated rows, trimmed text, conversion of text columns that are numbers or dates."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import col, dt, nan_to_null, num, number_of, timestamp_of, without_space
from ..sources.scratch import stored

# Texts that stand for nothing, and shares of all rows that must parse.
NULL_TEXTS = ["nan", "None", ""]
NUMBER_SHARE = 0.90
DATE_SHARE = 0.85


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return nan_to_null(df).na.drop("all")


def drop_repeated_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def trimmed(c: Column) -> Column:
    text = without_space(c)
    return F.when(~text.isin(NULL_TEXTS), text)


def trim_text(df: DataFrame) -> DataFrame:
    texts = set(text_columns(df))
    return df.select([trimmed(col(c)).alias(c) if c in texts else col(c) for c in df.columns])


def conversions(df: DataFrame) -> dict[str, str]:
    """{column: number or datetime} for the text columns to convert, from one pass."""
    texts = text_columns(df)
    if not texts:
        return {}
    rates = df.agg(*[F.avg(parsed(df, c).isNotNull().cast("double")).alias(f"{kind}{i}") for i, c in enumerate(texts) for kind, parsed in (("n", num), ("d", dt))]).first()
    out = {}
    for i, c in enumerate(texts):
        if (rates[f"n{i}"] or 0) >= NUMBER_SHARE:
            out[c] = "number"
        elif (rates[f"d{i}"] or 0) >= DATE_SHARE:
            out[c] = "datetime"
    return out


def convert(df: DataFrame, plan: dict[str, str]) -> DataFrame:
    made = {"number": num, "datetime": dt}
    return df.select([made[plan[c]](df, c).alias(c) if c in plan else col(c) for c in df.columns])


@dataclass
class Cleaned:
    table: DataFrame
    log: DataFrame
    rows_before: int
    rows_after: int


def clean(df: DataFrame) -> Cleaned:
    """Empty rows, then repeated rows, then trimming, then conversion. The log has a row an action; steps that removed nothing are left out.

    The source is read once and whole rows are shuffled once: equal rows meet with their number, from which all counts
    follow. Each text is trimmed and parsed once, for the decision and for the conversion. The result is a table.
    """
    spark, names = df.sparkSession, df.columns
    texts = text_columns(df)
    at = {c: f"c{i}" for i, c in enumerate(names)}
    rows = nan_to_null(df).toDF(*at.values())
    counted = rows.groupBy(*at.values()).agg(F.count("*").alias("copies"))
    filled = reduce(Column.__or__, [F.col(c).isNotNull() for c in at.values()])
    tidy = counted.select(*[trimmed(F.col(at[c])).alias(at[c]) if c in texts else F.col(at[c]) for c in names], "copies", filled.alias("filled"))
    parsed = stored(tidy.withColumns({f"n{at[c]}": number_of(F.col(at[c])) for c in texts} | {f"d{at[c]}": timestamp_of(F.col(at[c])) for c in texts}), "tidy")
    kept = parsed.where("filled")
    rates = [F.avg(F.col(f"{kind}{at[c]}").isNotNull().cast("double")).alias(f"{kind}{at[c]}") for c in texts for kind in "nd"]
    total = parsed.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("all"), F.coalesce(F.sum(F.when(~F.col("filled"), F.col("copies"))), F.lit(0)).alias("empty")).first()
    row = kept.agg(F.count("*").alias("left"), *rates).first()
    plan = {}
    for c in texts:
        if (row[f"n{at[c]}"] or 0) >= NUMBER_SHARE:
            plan[c] = "number"
        elif (row[f"d{at[c]}"] or 0) >= DATE_SHARE:
            plan[c] = "datetime"
    log = [("original_rows", total["all"], None)]
    log += [(what, n, None) for what, n in (("empty_rows_removed", total["empty"]), ("repeated_rows_removed", total["all"] - total["empty"] - row["left"])) if n]
    log.append(("text_trimmed", None, texts))
    log += [(f"converted_to_{kind}", None, found) for kind in ("number", "datetime") if (found := [c for c, k in plan.items() if k == kind])]
    log.append(("final_rows", row["left"], None))
    table = kept.select(*[F.col({"number": "n", "datetime": "d"}.get(plan.get(c), "") + at[c]).alias(c) for c in names])
    return Cleaned(table, spark.createDataFrame(log, "action string, rows bigint, columns array<string>"), total["all"], row["left"])
