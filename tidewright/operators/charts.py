"""Chart points, insights and report summaries: small work on aggregated rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored

# Chart types of visuals.
CHART_TYPES = {
    "kpi_card": "card", "line_chart": "line", "area_chart": "area", "bar_chart": "bar", "horizontal_bar_chart": "horizontal_bar", "stacked_bar_chart": "bar", "pie_chart": "pie", "donut_chart": "donut",
    "table": "table", "ranking_table": "table", "pivot_table": "table", "histogram": "histogram", "scatter_plot": "scatter", "bubble_chart": "bubble", "heatmap": "heatmap", "treemap": "treemap", "funnel_chart": "funnel", "gauge": "gauge", "map_ready": "map_ready",
}
INSIGHT_CHARTS = 4
REPORT_ITEMS = 5


def chart_points(charts: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """(chart, chart_no, type, pos, label, value) of {name: (visual, rows of label and value with their order in pos)}.

    Rows carry their own place in `pos`, since a union keeps no order.
    """
    parts = [rows.select(F.lit(name).alias("chart"), F.lit(i).alias("chart_no"), F.lit(CHART_TYPES.get(visual, visual)).alias("type"), F.col("pos").cast("int").alias("pos"), F.col("label").cast("string").alias("label"), F.col("value").cast("double").alias("value")) for i, (name, (visual, rows)) in enumerate(charts.items(), 1)]
    return reduce(DataFrame.unionByName, parts)


#: The columns of long chart points and their types.
POINT = {"chart": "string", "chart_no": "int", "type": "string", "pos": "bigint", "label": "string", "series": "string", "x": "double", "y": "double", "value": "double", "size": "double"}


def long_points(charts: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """The points of charts of every kind, one row each, from (name, visual, rows): rows have their place in pos and what the kind needs of the others.

    Groups: label, value. Bins: label, x and y (their ends), value (their count). Cells: label and series (their two
    labels), value. Points of a cloud: x, y, size, series (their colour), and as label and value the texts of x, and y.
    """
    parts = []
    for i, (name, visual, rows) in enumerate(charts, 1):
        named = {"chart": F.lit(name), "chart_no": F.lit(i), "type": F.lit(CHART_TYPES.get(visual, visual))}
        parts.append(rows.select(*[(named[c] if c in named else F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in POINT.items()]))
    return reduce(DataFrame.unionByName, parts)


#: Bits of monotonically_increasing_id that count the rows of a partition.
_ROW_BITS = 33


def positions(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with their place in `pos`, from 1 on, in that order, however many they are: they are dealt by ranges, counted by partition, and each
    partition goes on where those before it end. Only the counts, one for each partition, meet in one task. The result is a table."""
    dealt = stored(rows.orderBy(*order).withColumn("pos", F.monotonically_increasing_id()), "positions")
    part, inside = F.shiftrightunsigned("pos", _ROW_BITS), F.col("pos").bitwiseAND((1 << _ROW_BITS) - 1)
    counts = dealt.groupBy(part.alias("part_")).agg(F.count("*").alias("n_"))
    before = counts.select("part_", (F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_")).alias("before_"))
    return dealt.join(F.broadcast(before), part == F.col("part_")).withColumn("pos", F.col("before_") + inside + 1).drop("part_", "before_")


def placed(groups: DataFrame, *order: Column) -> DataFrame:
    """A bounded number of aggregated rows with their place in `pos`; see positions for any number."""
    return groups.withColumn("pos", F.row_number().over(Window.orderBy(*order)))


def insights(points: DataFrame, charts: int = INSIGHT_CHARTS) -> DataFrame:
    """(chart, label, value): the highest item of each of the first charts that have numbers; equal values: the first in chart order. Cells of heatmaps are no items."""
    best = points.where("value is not null and type <> 'heatmap'").groupBy("chart", "chart_no").agg(F.max_by(F.struct("label", "value"), F.struct("value", -F.col("pos"))).alias("best"))
    return best.orderBy("chart_no").limit(charts).select("chart", "best.label", "best.value")


def compact(c: Column) -> Column:
    """1234567 as 1.23M, 1234.5 as 1,234.5, missing as a dash."""
    def plain(v: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(F.format_number(v, 2), "0+$", ""), r"\.$", "")

    def scaled(by: float, sign: str) -> Column:
        return F.concat(F.replace(F.format_number(c / by, 2), F.lit(",")), F.lit(sign))

    return F.when(c.isNull(), "—").when(F.abs(c) >= 1e9, scaled(1e9, "B")).when(F.abs(c) >= 1e6, scaled(1e6, "M")).otherwise(plain(c))


def report_items(points: DataFrame, items: int = REPORT_ITEMS) -> DataFrame:
    """(chart, records, pos, label, value): the first items of every chart in its order, values to two places, with the chart's number of records."""
    counts = points.groupBy("chart").agg(F.count("*").alias("records"))
    first = points.where(F.col("pos") <= items)
    return first.join(F.broadcast(counts), "chart").select("chart", "records", "pos", "label", F.bround("value", 2).alias("value"))


def report_summary(rows_before: int, rows_after: int, domain: str, cards: DataFrame, points: DataFrame, cleaning: DataFrame, changes: DataFrame) -> DataFrame:
    """One row: counts, domain, KPI values to two places, cleaning and transformation logs, and the findings."""
    def listed(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.collect_list(F.struct(*df.columns)).alias(name))

    spark = cards.sparkSession
    row = spark.createDataFrame([(rows_before, rows_after, domain)], "rows_before bigint, rows_after bigint, domain string")
    rounded = cards.select("title", F.bround("value", 2).alias("value"))
    for part in (listed(rounded, "kpis"), listed(cleaning, "cleaning"), listed(changes, "changes"), listed(report_items(points), "charts"), listed(insights(points), "findings")):
        row = row.withColumn("one", F.lit(1)).join(part.withColumn("one", F.lit(1)), "one").drop("one")
    return row
