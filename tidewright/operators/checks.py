"""Checks of KPI and schema plans against the table: one pass for every column that a plan names."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import col, dt, is_date, num
from ..functions.formula import check_formula
from . import derive as derived
from .kpi import CARD_TYPES, GROUP_TYPES
from .profile import distinct_counts, value_bytes

# Thresholds and vocabularies of the plan checks.
NUMBER_SHARE, DATE_SHARE = 0.80, 0.70
HIGH_CARDINALITY, PIE_CARDINALITY = 50, 6
MAX_NAME = 80
CODE_TOKENS = [";", "--", "/*", "*/", "=", "<script", "import ", "eval("]
CATEGORY_VISUALS = {"bar_chart", "horizontal_bar_chart", "stacked_bar_chart", "pie_chart", "donut_chart", "table", "ranking_table", "pivot_table", "treemap"}
VISUALS = CATEGORY_VISUALS | {"kpi_card", "line_chart", "area_chart", "histogram", "scatter_plot", "bubble_chart", "heatmap", "funnel_chart", "gauge", "map_ready"}
PIE_NOTE = "more than 6 categories: shown as horizontal bars"


def safe_name(name: object) -> bool:
    """A text of at most 80 characters with a letter or digit and nothing that looks like code."""
    return isinstance(name, str) and 0 < len(name.strip()) <= MAX_NAME and not any(t in name for t in CODE_TOKENS) and re.search("[A-Za-z0-9]", name) is not None


@dataclass(frozen=True)
class Facts:
    """Shares of all rows that are numbers, of non-null values that are dates, and different values (exact up to a thousand)."""

    number_share: float
    date_share: float
    distinct: int


#: Binary logarithm of the digests that a sketch of different values keeps: counts up to that many are exact, larger ones within a few hundredths.
_SKETCH = 10


def _few_distinct(df: DataFrame, name: str) -> Column:
    """Different values: exact up to 2 ** _SKETCH, which is far above every threshold; memory stays bounded however many there are."""
    return F.theta_sketch_estimate(F.theta_sketch_agg(F.when(col(name).isNotNull(), F.concat(F.lit("v").cast("binary"), value_bytes(df, name))), _SKETCH))


def _shares(df: DataFrame, name: str) -> tuple[Column, Column]:
    dates = F.lit(1.0) if is_date(df.schema[name].dataType) else F.coalesce(F.avg(F.when(col(name).isNotNull(), dt(df, name).isNotNull().cast("double"))), F.lit(0.0))
    return F.coalesce(F.avg(num(df, name).isNotNull().cast("double")), F.lit(0.0)), dates


def column_facts(df: DataFrame, columns: list[str]) -> dict[str, Facts]:
    """Facts of the columns from one pass."""
    names = [c for c in dict.fromkeys(columns) if c in df.columns]
    if not names:
        return {}
    aggs = []
    for i, c in enumerate(names):
        numbers, dates = _shares(df, c)
        aggs += [numbers.alias(f"n{i}"), dates.alias(f"d{i}"), _few_distinct(df, c).alias(f"u{i}")]
    row = df.agg(*aggs).first()
    return {c: Facts(row[f"n{i}"], row[f"d{i}"], row[f"u{i}"]) for i, c in enumerate(names)}


def facts_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, number_share, is_numeric, date_share, is_datetime, distinct, high_cardinality): one pass for the shares, one shuffle of digests for exact counts of different values."""
    aggs = []
    for i, c in enumerate(columns):
        numbers, dates = _shares(df, c)
        aggs += [numbers.alias(f"n{i}"), dates.alias(f"d{i}")]
    items = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("name"), F.col(f"n{i}").alias("number_share"), F.col(f"d{i}").alias("date_share")) for i, c in enumerate(columns)]
    rows = df.agg(*aggs).select(F.inline(F.array(*items))).join(F.broadcast(distinct_counts(df.select(*map(col, columns)))), "position", "left")
    rows = rows.select("name", "number_share", "date_share", F.coalesce("unique", F.lit(0)).alias("distinct"))
    return rows.withColumns({"is_numeric": F.col("number_share") >= NUMBER_SHARE, "is_datetime": F.col("date_share") >= DATE_SHARE, "high_cardinality": F.col("distinct") > HIGH_CARDINALITY})


def _axes(kpi: dict) -> tuple:
    return kpi.get("x_column") or kpi.get("x"), kpi.get("y_column") or kpi.get("y")


def _needs(kpi: dict) -> tuple[list, list]:
    """The columns that must exist, and those of them that must be numeric."""
    kind = kpi.get("formula_type")
    if kind in ("count_rows",):
        return [], []
    if kind in ("count_non_null", "count_distinct"):
        return [kpi.get("column")], []
    if kind in CARD_TYPES or kind == "histogram":
        return [kpi.get("column")], [kpi.get("column")]
    if kind == "group_count":
        return [kpi.get("group_by")], []
    if kind in GROUP_TYPES:
        return [kpi.get("group_by"), kpi.get("value_column")], [kpi.get("value_column")]
    x, y = _axes(kpi)
    if kind == "scatter":
        return [x, y], [x, y]
    value = [kpi["value_column"]] if kpi.get("value_column") else []
    return [x, y, *value], value


_KINDS = {*CARD_TYPES, *GROUP_TYPES, "histogram", "scatter", "heatmap"}


def _repaired(kpi: dict, facts: dict[str, Facts]) -> dict:
    """The spec with a visual that suits its type."""
    kind, visual = kpi["formula_type"], kpi.get("visual") or kpi.get("chart_type") or "kpi_card"
    forced = {"histogram": "histogram", "scatter": "scatter_plot", "heatmap": "heatmap"}
    if kind in CARD_TYPES:
        return {**kpi, "visual": "kpi_card"}
    if kind in forced:
        return {**kpi, "visual": forced[kind]}
    allowed = CATEGORY_VISUALS | {"heatmap"} | (set() if kind == "group_count" else {"line_chart", "area_chart"})
    visual = visual if visual in allowed else "bar_chart"
    if visual in ("pie_chart", "donut_chart") and facts[kpi["group_by"]].distinct > PIE_CARDINALITY:
        return {**kpi, "visual": "horizontal_bar_chart", "validation_note": PIE_NOTE}
    return {**kpi, "visual": visual}


def check_kpis(df: DataFrame, plan: dict) -> tuple[dict, DataFrame]:
    """(accepted plan, log of item, kind, status, reason). Accepted specs have repaired visuals; the layout keeps accepted names, filters existing columns."""
    wanted = [c for k in plan.get("kpis", []) for c in _needs(k)[0] if isinstance(c, str)]
    facts, accepted, log = column_facts(df, wanted), {}, []
    for kpi in plan.get("kpis", []):
        name, kind = kpi.get("name"), kpi.get("formula_type")
        exist, numeric = _needs(kpi)
        tests = [
            (safe_name(name), "the name is empty, too long or unsafe"),
            (name not in accepted, "the name is taken"),
            (kind in _KINDS, f"unsupported formula_type {kind}"),
            ((kpi.get("visual") or kpi.get("chart_type") or "kpi_card") in VISUALS, "unsupported visual"),
            (all(c in facts for c in exist), "a column does not exist"),
            (all(c in facts and facts[c].number_share >= NUMBER_SHARE for c in numeric), f"{kind} needs numeric columns"),
        ]
        reason = next((why for ok, why in tests if not ok), None)
        if reason is None:
            accepted[name] = _repaired(kpi, facts)
        log.append((str(name), "kpi", "rejected" if reason else "accepted", reason))
    layout = plan.get("dashboard_layout") or {}
    filters = {f for f in layout.get("filters", []) if f in df.columns}
    log += [(str(f), "filter", "accepted" if f in filters else "rejected", None if f in filters else "the column does not exist") for f in layout.get("filters", [])]
    kept = {part: [n for n in layout.get(part, []) if n in accepted] for part in ("top", "middle", "bottom")}
    checked = {"kpis": list(accepted.values()), "dashboard_layout": kept | {"filters": sorted(filters)}, "future_opportunities": plan.get("future_opportunities", [])}
    return checked, df.sparkSession.createDataFrame(log, "item string, kind string, status string, reason string")


def check_schema(df: DataFrame, plan: dict) -> tuple[dict, DataFrame]:
    """(accepted plan, log): renames whose old name exists and whose new one is safe and free; columns whose inputs fit or whose formula is valid."""
    log, renames, names = [], [], {c: c for c in df.columns}
    for item in plan.get("rename_columns", []):
        old, new = item.get("old_name"), item.get("new_name")
        reason = "the old name does not exist" if old not in names.values() else "the new name is unsafe" if not safe_name(new) else "the new name is taken" if new in names.values() else None
        if reason is None:
            names[next(k for k, v in names.items() if v == old)] = new
            renames.append(item)
        log.append((str(old), "rename", "rejected" if reason else "accepted", reason))
    table = df.withColumnsRenamed({k: v for k, v in names.items() if k != v})
    items = plan.get("derived_columns", [])
    inputs = [[names.get(c, c) for c in i.get("input_columns") or i.get("source_columns") or []] for i in items]
    facts, made = column_facts(table, [c for own in inputs for c in own]), []
    for item, own in zip(items, inputs):
        name, kind, formula = item.get("new_column") or item.get("name"), item.get("formula_type"), item.get("formula")
        if not safe_name(name):
            reason = "the name is empty, too long or unsafe"
        elif name in table.columns:
            reason = "the column exists"
        elif formula:
            reason = check_formula(table, formula)
        elif kind not in derived.FIXED:
            reason = f"unsupported formula_type {kind}"
        elif len(own) < derived.FIXED[kind][0] or not all(c in facts for c in own):
            reason = "an input column is missing"
        elif kind == "multiply":
            reason = None if all(facts[c].number_share >= NUMBER_SHARE for c in own) else "multiply needs numeric columns"
        else:
            reason = None if facts[own[0]].date_share >= DATE_SHARE else f"{kind} needs a date column"
        if reason is None:
            made.append(item)
            if formula:
                table = derived.apply_schema(table, {"derived_columns": [item]})[0]
            else:
                table = table.withColumn(name, derived.fixed(table, kind, *own))
        log.append((str(name), "derive", "rejected" if reason else "accepted", reason))
    return {"rename_columns": renames, "derived_columns": made}, df.sparkSession.createDataFrame(log, "item string, kind string, status string, reason string")
