"""Renames and derived columns from a plain-dict schema plan; mistakes become log rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import dt, num
from ..functions.formula import FormulaError, compile_formula

_LOG = "step string, name string, status string, reason string"


def _period(how: str):
    return lambda df, c: F.date_format(dt(df, c), how)


#: formula_type -> (number of inputs, how the column is made); missing stays missing
FIXED: dict[str, tuple[int, object]] = {
    "multiply": (2, lambda df, a, b: num(df, a) * num(df, b)),
    "extract_date": (1, _period("yyyy-MM-dd")),
    "extract_month": (1, _period("yyyy-MM")),
    "extract_quarter": (1, lambda df, c: F.concat(F.year(dt(df, c)).cast("string"), F.lit("-Q"), F.quarter(dt(df, c)).cast("string"))),
    "extract_year": (1, lambda df, c: F.year(dt(df, c))),
    "extract_hour": (1, lambda df, c: F.hour(dt(df, c))),
    "extract_weekday": (1, _period("EEEE")),
}


def fixed(df: DataFrame, formula_type: str, *inputs: str) -> Column:
    n, make = FIXED[formula_type]
    if len(inputs) < n:
        raise ValueError(f"{formula_type} takes {n} columns")
    return make(df, *inputs[:n])


def rename(df: DataFrame, items: list[dict]) -> tuple[DataFrame, dict[str, str], list[tuple]]:
    """Renames in order; one whose old name is missing or whose new name is taken is rejected."""
    names, log = {c: c for c in df.columns}, []
    for item in items:
        old, new = item.get("old_name"), item.get("new_name")
        now = set(names.values())
        reason = "the old name does not exist" if old not in now else "the new name is empty or taken" if not new or new in now else None
        if reason is None:
            names[next(k for k, v in names.items() if v == old)] = new
        log.append(("rename", str(old), "rejected" if reason else "applied", reason))
    return df.withColumnsRenamed({k: v for k, v in names.items() if k != v}), names, log


def apply_schema(df: DataFrame, plan: dict, as_of: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(table, log) after a plan's rename_columns and derived_columns; inputs may be called by old or new names."""
    out, names, log = rename(df, plan.get("rename_columns", []))
    for item in plan.get("derived_columns", []):
        name, formula, kind = item.get("new_column") or item.get("name"), item.get("formula"), item.get("formula_type")
        inputs = [names.get(c, c) for c in item.get("input_columns") or item.get("source_columns") or []]
        reason = None
        if not name:
            reason = "the column has no name"
        elif name in out.columns:
            reason = "the column exists"
        elif formula:
            try:
                out = out.withColumn(name, compile_formula(out, formula, as_of).column)
                out.schema  # noqa: B018  analysis finds what the compiler cannot
            except FormulaError as e:
                reason = str(e)
        elif kind not in FIXED:
            reason = f"unsupported formula_type {kind}"
        elif not set(inputs) <= set(out.columns) or len(inputs) < FIXED[kind][0]:
            reason = "an input column is missing"
        else:
            out = out.withColumn(name, fixed(out, kind, *inputs))
        log.append(("derive", str(name), "rejected" if reason else "applied", reason))
    return out, df.sparkSession.createDataFrame(log, _LOG)
