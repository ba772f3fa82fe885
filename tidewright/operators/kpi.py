"""KPI cards and chart-ready aggregates from plain-dict specs, in as few passes as keys allow."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import col, label, num
from ..functions.formula import compile_formula
from ..sources.scratch import stored
from .profile import value_bytes
from .quantiles import exact_quantiles

# Limits and names of visuals.
DEFAULT_TOP = 20
DEFAULT_BINS = 10
SCATTER_ROWS = 500
SERIES_VISUALS = {"line_chart", "area_chart"}
RANKED_VISUALS = {"bar_chart", "horizontal_bar_chart", "pie_chart", "donut_chart", "treemap", "ranking_table"}

CARD_TYPES = ("sum", "average", "min", "max", "std", "count_rows", "count_non_null", "count_distinct")
GROUP_TYPES = ("group_sum", "group_average", "group_median", "group_min", "group_max", "group_std", "group_count")


def aggregate(kind: str, value: Column | None = None, where: Column | None = None, approx: bool = False) -> Column:
    """The aggregate of a kind; sums of nothing are 0, other statistics of nothing are null."""

    def kept(c: Column) -> Column:
        return c if where is None else F.when(where, c)

    if kind == "count":
        return F.count(kept(F.lit(1))).cast("double")
    if kind == "non_null":
        return F.count(kept(value)).cast("double")
    if kind == "distinct":
        return (F.approx_count_distinct(kept(value), 0.01) if approx else F.count_distinct(kept(value))).cast("double")
    v = kept(value)
    makers = {
        "sum": lambda: F.coalesce(F.sum(v), F.lit(0.0)),
        "average": lambda: F.avg(v),
        "min": lambda: F.min(v),
        "max": lambda: F.max(v),
        "median": lambda: F.percentile_approx(v, 0.5, 10_000) if approx else F.median(v),
        "std": lambda: F.stddev_samp(v),
    }
    return makers[kind]()


def _condition(df: DataFrame, spec: dict) -> Column | None:
    text = spec.get("filter_condition")
    return F.coalesce(compile_formula(df, text).column, F.lit(False)) if text else None


def card(df: DataFrame, spec: dict) -> Column:
    """The aggregate column of one card spec."""
    kind, where = spec["formula_type"], _condition(df, spec)
    if kind == "count_rows":
        return aggregate("count", where=where)
    name = spec["column"]
    if kind in ("count_non_null", "count_distinct"):
        return aggregate(kind.removeprefix("count_"), col(name), where, spec.get("approx", False))
    return aggregate(kind, num(df, name), where)


_CARD = "title string, value double, format string"


def cards(df: DataFrame, specs: list[dict]) -> DataFrame:
    """(title, value, format): all cards from one pass over df, exact distinct counts from another, whose values go through one shuffle as digests."""
    distinct = [s for s in specs if s["formula_type"] == "count_distinct" and not s.get("approx")]
    plain = [s for s in specs if s not in distinct]
    out = df.sparkSession.createDataFrame([], _CARD)
    if plain:
        row = df.agg(*[card(df, s).alias(f"c{i}") for i, s in enumerate(plain)])
        out = row.select(F.inline(F.array(*[F.struct(F.lit(s["name"]).alias("title"), F.col(f"c{i}").alias("value"), F.lit(s.get("format", "number")).alias("format")) for i, s in enumerate(plain)])))
    if distinct:
        out = out.union(_distinct_cards(df, distinct)) if plain else _distinct_cards(df, distinct)
    return out


def _distinct_cards(df: DataFrame, specs: list[dict]) -> DataFrame:
    cells = []
    for i, s in enumerate(specs):
        where, there = _condition(df, s), col(s["column"]).isNotNull()
        cells.append(F.when(there if where is None else there & where, F.struct(F.lit(i).alias("card"), F.unhex(F.md5(value_bytes(df, s["column"]))).alias("digest"))))
    values = df.select(F.explode(F.filter(F.array(*cells), lambda c: c.isNotNull())).alias("c")).select("c.*").distinct()
    counts = values.groupBy("card").agg(F.count("*").cast("double").alias("n"))
    named = df.sparkSession.createDataFrame([(i, s["name"], s.get("format", "number")) for i, s in enumerate(specs)], "card int, title string, format string")
    return named.join(F.broadcast(counts), "card", "left").select("title", F.coalesce("n", F.lit(0.0)).alias("value"), "format")


def top_n(spec: dict) -> int:
    """The row limit of a ranked chart; 0 and nothing stand for the default."""
    n = int(spec.get("top_n") or spec.get("limit") or DEFAULT_TOP)
    if n < 0:
        raise ValueError("top_n is negative")
    return n


def ordered(df: DataFrame, visual: str, value: str, key: str = "key", n: int = DEFAULT_TOP) -> DataFrame:
    """Rows of a chart: series by key, ranked visuals the n largest values, others by value; equal values by key."""
    if visual in SERIES_VISUALS:
        return df.orderBy(F.asc_nulls_last(key))
    ranked = df.orderBy(F.desc_nulls_last(value), F.asc_nulls_last(key))
    return ranked.limit(n) if visual in RANKED_VISUALS else ranked


def grouped(df: DataFrame, group_by: str | list[str], measures: dict[str, Column], keys: list[str] | None = None) -> DataFrame:
    """One row a group with its typed key(s) and all measures, from one shuffle."""
    by = [group_by] if isinstance(group_by, str) else group_by
    names = keys or (["key"] if len(by) == 1 else [f"key_{i}" for i in range(1, len(by) + 1)])
    return df.groupBy(*[_key(df, b).alias(k) for b, k in zip(by, names)]).agg(*[m.alias(n) for n, m in measures.items()])


def _key(df: DataFrame, name: str) -> Column:
    """The key of a group; -0.0 and 0.0 are one."""
    return col(name) + 0.0 if df.schema[name].dataType.typeName() in ("double", "float") else col(name)


def measure(df: DataFrame, spec: dict) -> Column:
    kind, where = spec["formula_type"].removeprefix("group_"), _condition(df, spec)
    return aggregate("count", where=where) if kind == "count" else aggregate(kind, num(df, spec["value_column"]), where, spec.get("approx", False))


def grouped_sets(df: DataFrame, by_key: dict[str, list[dict]]) -> dict[str, list[DataFrame]]:
    """For each key its charts' rows (key, value), one for each grouped spec, all from one scan and one shuffle of df.

    A row becomes one (key, its values) for each key; values of all keys share slots, so that a slot is aggregated once
    for each kind asked of it. Partial aggregates go through the shuffle. The groups are one table.
    """
    keys, slots, kinds = list(by_key), max(map(len, by_key.values())), set()
    types = [df.schema[k].dataType for k in keys]
    sets = []
    for i, key in enumerate(keys):
        specs = by_key[key]
        fields = [F.lit(i).alias("set")] + [(_key(df, key) if j == i else F.lit(None)).cast(t).alias(f"k{j}") for j, t in enumerate(types)]
        sets.append(F.struct(*fields, *[(_input(df, specs[j]) if j < len(specs) else F.lit(None)).cast("double").alias(f"v{j}") for j in range(slots)]))
        kinds |= {(j, *_kind(s)) for j, s in enumerate(specs)}
    rows = df.select(F.inline(F.array(*sets)))
    groups = stored(rows.groupBy("set", *[f"k{j}" for j in range(len(keys))]).agg(*[aggregate("non_null" if kind == "count" else kind, F.col(f"v{j}"), approx=approx).alias(_slot(j, kind, approx)) for j, kind, approx in sorted(kinds)]), "groups")
    return {key: [groups.where(F.col("set") == i).select(F.col(f"k{i}").alias("key"), F.col(_slot(j, *_kind(s))).alias("value")) for j, s in enumerate(by_key[key])] for i, key in enumerate(keys)}


def _kind(spec: dict) -> tuple[str, bool]:
    return spec["formula_type"].removeprefix("group_"), bool(spec.get("approx", False))


def _slot(j: int, kind: str, approx: bool) -> str:
    return f"v{j}_{kind}{'_approx' * approx}"


def _input(df: DataFrame, spec: dict) -> Column:
    """The number that a row gives to the measure of a grouped spec: null if none."""
    value, where = F.lit(1.0) if _kind(spec)[0] == "count" else num(df, spec["value_column"]), _condition(df, spec)
    return value if where is None else F.when(where, value)


def grouped_chart(df: DataFrame, spec: dict) -> DataFrame:
    """(key, label, value) of one grouped spec, in its visual's order."""
    return _chart(_bounded_median(df, spec) if _is_bounded(spec) else grouped(df, spec["group_by"], {"value": measure(df, spec)}), spec)


def _is_bounded(spec: dict) -> bool:
    return spec["formula_type"] == "group_median" and bool(spec.get("bounded"))


def _bounded_median(df: DataFrame, spec: dict) -> DataFrame:
    """(key, value): exact medians of groups of any size, by rounds over the table instead of a group's values in memory."""
    rows = df.select(_key(df, spec["group_by"]).alias("key"), _input(df, spec).alias("v"))
    return exact_quantiles(rows, "key", "v", [0.5]).select("key", F.col("q")[0].alias("value"))


def _chart(groups: DataFrame, spec: dict, name: str = "value") -> DataFrame:
    rows = groups.select("key", label(F.col("key")).alias("label"), F.col(name).alias("value"))
    visual = spec.get("visual") or spec.get("chart_type") or "bar_chart"
    if spec.get("sort") == "label" and visual in SERIES_VISUALS:
        return rows.orderBy("label")
    return ordered(rows, visual, "value", n=top_n(spec))


def bin_edges(low: float, high: float, bins: int) -> list[float]:
    """Edges of equal-width bins that are closed on the right; the lowest edge lies 0.1 % of the range below the least value."""
    if low == high:
        reach = 0.001 * abs(low) if low else 0.001
        low, high = low - reach, high + reach
        return [low + (high - low) * i / bins for i in range(bins)] + [high]
    edges = [low + (high - low) * i / bins for i in range(bins)] + [high]
    return [low - 0.001 * (high - low), *edges[1:]]


def histogram(df: DataFrame, column: str, bins: int = DEFAULT_BINS) -> DataFrame:
    """(bin, lo, hi, label, count): every bin, empty ones too; no row if the column has no number."""
    spark = df.sparkSession
    values = df.select(num(df, column).alias("v")).where("v is not null")
    low, high = values.agg(F.min("v"), F.max("v")).first()
    schema = "bin int, lo double, hi double, label string"
    if low is None:
        return spark.createDataFrame([], f"{schema}, count bigint")
    if float("inf") in (abs(low), abs(high)):
        raise ValueError("a histogram needs finite values")
    edges = bin_edges(low, high, bins)
    # the bin is the number of inner edges below the value, compared exactly
    at = sum((F.when(F.col("v") > e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
    counts = values.groupBy(at.alias("bin")).agg(F.count("*").alias("count"))
    every = spark.createDataFrame([(i, lo, hi, f"({lo:.6g}, {hi:.6g}]") for i, (lo, hi) in enumerate(zip(edges, edges[1:]))], schema)
    return every.join(counts, "bin", "left").select("bin", "lo", "hi", "label", F.coalesce("count", F.lit(0)).cast("long").alias("count")).orderBy("bin")


def scatter(df: DataFrame, x: str, y: str, order_by: list[str], color: str | None = None, size: str | None = None, rows: int = SCATTER_ROWS, pos: bool = False) -> DataFrame:
    """The first `rows` rows by order_by, then only those with both x and y. pos: with their place among the first."""
    order = [F.asc_nulls_last(col(c)) for c in order_by]
    first = df.orderBy(*order).limit(rows)
    extra = [label(col(color)).alias("color")] if color else []
    extra += [num(df, size).alias("size")] if size else []
    extra += [F.row_number().over(Window.orderBy(*order)).alias("pos")] if pos else []  # over `rows` rows at most
    return first.select(num(df, x).alias("x"), num(df, y).alias("y"), *extra).where("x is not null and y is not null")


def heatmap(df: DataFrame, x: str, y: str, value: str | None = None, aggregation: str = "count", n: int = DEFAULT_TOP) -> DataFrame:
    """(x, y, value): cells of the n x-labels and n y-labels of largest summed value. Average and sum need a value; otherwise rows are counted.

    Sums of counts and sums are known from the axes alone, so that only rows of the labels that stay form cells. Averages
    are summed over their cells, so there all cells are made first.
    """
    kind = aggregation if value and aggregation in ("sum", "average") else "count"
    rows = df.select(label(col(x)).alias("x"), label(col(y)).alias("y"), (num(df, value) if value else F.lit(1.0)).alias("v"))

    def cells(of: DataFrame) -> DataFrame:
        return of.groupBy("x", "y").agg(aggregate(kind, F.col("v")).alias("value"))

    def largest(totals: DataFrame, axis: str) -> DataFrame:
        # each side of the semi joins has at most n rows
        return F.broadcast(totals.orderBy(F.desc_nulls_last("total"), axis).limit(n).select(axis))

    if kind == "average":
        made = cells(rows)
        tops = {axis: largest(made.groupBy(axis).agg(F.sum("value").alias("total")), axis) for axis in ("x", "y")}
        return made.join(tops["x"], "x", "left_semi").join(tops["y"], "y", "left_semi").select("x", "y", "value")
    tops = {axis: largest(rows.groupBy(axis).agg(aggregate(kind, F.col("v")).alias("total")), axis) for axis in ("x", "y")}
    return cells(rows.join(tops["x"], "x", "left_semi").join(tops["y"], "y", "left_semi")).select("x", "y", "value")


@dataclass
class KpiResult:
    cards: DataFrame
    charts: dict[str, DataFrame] = field(default_factory=dict)
    metadata: dict[str, dict] = field(default_factory=dict)
    errors: list[dict] = field(default_factory=list)


def _columns_of(spec: dict) -> list[str]:
    keys = ("column", "group_by", "value_column", "x_column", "y_column", "color_column", "size_column")
    return [spec[k] for k in keys if spec.get(k)]


def compute(df: DataFrame, specs: list[dict]) -> KpiResult:
    """Every spec; cards share one pass, and grouped charts of any keys one scan and one shuffle. A bad spec becomes an error, the others go on."""
    out, plain, alone, by_key = KpiResult(cards(df, [])), [], [], defaultdict(list)
    for spec in specs:
        name, kind = spec.get("name"), spec.get("formula_type")
        spec = {**spec, "x_column": spec.get("x_column") or spec.get("x"), "y_column": spec.get("y_column") or spec.get("y")}
        try:
            if not set(_columns_of(spec)) <= set(df.columns):
                raise ValueError("a column does not exist")
            if kind in CARD_TYPES:
                card(df, spec)
                plain.append(spec)
            elif kind in GROUP_TYPES:
                top_n(spec)
                measure(df, spec)
                (alone if _is_bounded(spec) else by_key[spec["group_by"]]).append(spec)
            elif kind == "histogram":
                out.charts[name] = histogram(df, spec["column"], int(spec.get("bins") or DEFAULT_BINS))
            elif kind == "scatter":
                out.charts[name] = scatter(df, spec["x_column"], spec["y_column"], spec.get("order_by") or df.columns, spec.get("color_column"), spec.get("size_column"), pos=True)
            elif kind == "heatmap":
                out.charts[name] = heatmap(df, spec["x_column"], spec["y_column"], spec.get("value_column"), spec.get("aggregation") or "count", top_n(spec))
            else:
                raise ValueError(f"unsupported formula_type {kind}")
            out.metadata[name] = {"type": spec.get("visual") or kind, "x": spec.get("group_by") or spec.get("x_column") or spec.get("column"), "y": spec.get("value_column") or spec.get("y_column"), "aggregation": kind}
            if kind in (*GROUP_TYPES, "heatmap"):
                out.metadata[name]["top_n"] = top_n(spec)
            if kind == "histogram":
                out.metadata[name]["bins"] = int(spec.get("bins") or DEFAULT_BINS)
            if kind == "heatmap":
                out.metadata[name] |= {"y": spec["y_column"], "value": spec.get("value_column"), "aggregation": spec.get("aggregation") or "count"}
        except Exception as e:
            out.errors.append({"name": name, "formula_type": kind, "error": str(e).splitlines()[0]})
    out.cards = cards(df, plain)
    for spec in alone:
        out.charts[spec["name"]] = grouped_chart(df, spec)
    if sum(map(len, by_key.values())) == 1:
        ((spec,),) = by_key.values()
        out.charts[spec["name"]] = grouped_chart(df, spec)
    elif by_key:
        sets = grouped_sets(df, by_key)
        out.charts |= {spec["name"]: _chart(rows, spec) for key, specs in by_key.items() for spec, rows in zip(specs, sets[key])}
    return out
