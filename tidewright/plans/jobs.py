"""Whole jobs: a table and plain-dict plans in, written tables and results out."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import charts, checks, clean, derive, kpi, profile, roles
from ..sources.io import read_table, write_json, write_table

#: Tables of a batch that are worked on at a time.
AT_ONCE = 4


@dataclass
class JobResult:
    profile: DataFrame
    cleaned: clean.Cleaned
    schema_log: DataFrame
    enriched: DataFrame
    changes: DataFrame
    metadata: DataFrame
    kpi_log: DataFrame
    kpis: kpi.KpiResult
    points: DataFrame
    summary: DataFrame


def chart_rows(spec: dict, rows: DataFrame) -> DataFrame:
    """One chart's rows as long points, in the chart's own order: series and other charts without a limit by ranges, the rest in one task."""
    kind, visual = spec["formula_type"], spec.get("visual") or spec.get("chart_type") or "bar_chart"
    if kind == "histogram":
        return rows.select((F.col("bin") + 1).alias("pos"), "label", F.col("lo").alias("x"), F.col("hi").alias("y"), F.col("count").alias("value"))
    if kind == "heatmap":
        return charts.placed(rows.select(F.col("x").alias("label"), F.col("y").alias("series"), "value"), F.asc("label"), F.asc("series"))
    if kind == "scatter":
        extra = [F.col(c).alias(n) for c, n in (("color", "series"), ("size", "size")) if c in rows.columns]
        return rows.select("pos", "x", "y", *extra, F.col("x").cast("string").alias("label"), F.col("y").alias("value"))
    if visual in kpi.SERIES_VISUALS:
        return charts.positions(rows, F.asc("label") if spec.get("sort") == "label" else F.asc_nulls_last("key"))
    order = [F.desc_nulls_last("value"), F.asc_nulls_last("key")]
    return charts.placed(rows, *order) if visual in kpi.RANKED_VISUALS else charts.positions(rows, *order)


def points(result: kpi.KpiResult, specs: list[dict]) -> DataFrame:
    """The points of every chart, in the order of the plan."""
    made = [(s["name"], result.metadata[s["name"]]["type"], chart_rows(s, result.charts[s["name"]])) for s in specs if s["name"] in result.charts]
    if made:
        return charts.long_points(made)
    return result.cards.sparkSession.createDataFrame([], ", ".join(f"{c} {t}" for c, t in charts.POINT.items()))


def run(df: DataFrame, schema_plan: dict, kpi_plan: dict) -> JobResult:
    """Profile, clean, check and apply the schema plan, profile again, check and compute the KPI plan, assemble the charts."""
    columns = roles.guess_roles(profile.profile(df))
    cleaned = clean.clean(df)
    accepted, schema_log = checks.check_schema(cleaned.table, schema_plan)
    enriched, changes = derive.apply_schema(cleaned.table, accepted)
    plan, kpi_log = checks.check_kpis(enriched, kpi_plan)
    result = kpi.compute(enriched, plan["kpis"])
    made = points(result, plan["kpis"])
    described = roles.safe_metadata(roles.guess_roles(profile.profile(enriched)))
    domain = roles.domain_scores(columns).first()["possible_business_domain"]
    # deriving columns keeps the rows
    summary = charts.report_summary(cleaned.rows_before, cleaned.rows_after, domain, result.cards, made, cleaned.log, changes)
    return JobResult(columns, cleaned, schema_log, enriched, changes, described, kpi_log, result, made, summary)


def save(result: JobResult, folder: str) -> None:
    """Tables as Parquet; results and logs as JSON lines, chart points in as many parts as they take."""
    spark = result.enriched.sparkSession
    write_table(result.cleaned.table, f"{folder}/cleaned")
    write_table(result.enriched, f"{folder}/enriched")
    write_table(profile.sketches(result.enriched), f"{folder}/sketches")
    about = [(name, *[m.get(k) for k in ("type", "x", "y", "value", "aggregation", "top_n", "bins")]) for name, m in result.kpis.metadata.items()]
    errors = [(e["name"], e["formula_type"], e["error"]) for e in result.kpis.errors]
    small = {
        "profile": result.profile, "cleaning_log": result.cleaned.log, "schema_log": result.schema_log, "transformation_log": result.changes, "metadata": result.metadata, "kpi_log": result.kpi_log, "cards": result.kpis.cards,
        "chart_metadata": spark.createDataFrame(about, "name string, type string, x string, y string, value string, aggregation string, top_n int, bins int"),
        "errors": spark.createDataFrame(errors, "name string, formula_type string, error string"), "summary": result.summary,
    }
    for name, rows in small.items():
        write_json(rows, f"{folder}/{name}")
    write_json(result.points, f"{folder}/chart_points", one_part=False)


_MANIFEST = "table string, status string, error string, rows_in bigint, rows_out bigint"


def tables_in(spark: SparkSession, folder: str, suffix: str = ".csv") -> list[str]:
    """The paths of a folder's tables of that suffix, in order; any store that Spark reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    listed = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    return sorted(f.getPath().toString() for f in listed if f.getPath().getName().lower().endswith(suffix))


def batch_profile(spark: SparkSession, out: str, names: list[str]) -> DataFrame:
    """The profile of all the tables of a batch together, from the sketches that their jobs left: no table is read again."""
    parts = spark.read.parquet(*[f"{out}/{name.rsplit('.', 1)[0]}/sketches" for name in names])
    return profile.described(profile.merged(parts))


def batch(spark: SparkSession, paths: list[str] | str, out: str, schema_plan: dict | None = None, kpi_plan: dict | None = None, at_once: int = AT_ONCE) -> DataFrame:
    """One job a table, several at a time, each in a scheduler pool of its own; the manifest is in the tables' order. A failure is a row of it and
    the others go on. A folder stands for its CSV tables, which are read as UTF-8 or, where they are none, as Latin-1."""

    def one(path: str) -> tuple:
        name = path.rstrip("/").rsplit("/", 1)[-1]
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        try:
            result = run(read_table(spark, path, "auto"), schema_plan or {}, kpi_plan or {})
            save(result, f"{out}/{name.rsplit('.', 1)[0]}")
            return name, "succeeded", None, result.cleaned.rows_before, result.cleaned.rows_after
        except Exception as e:
            return name, "failed", str(e).splitlines()[0], None, None

    found = tables_in(spark, paths) if isinstance(paths, str) else sorted(paths)
    with ThreadPoolExecutor(max(1, at_once)) as pool:
        rows = list(pool.map(inheritable_thread_target(spark)(one), found))
    return spark.createDataFrame(rows, _MANIFEST)
