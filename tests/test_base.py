"""Rules that SQL does not cover well: messy rows, edge values, rejection logs, formula safety."""

import math

import pytest
from pyspark.sql import functions as F

from tidewright.functions import coerce
from tidewright.functions.coerce import nan_to_null, num
from tidewright.functions.coerce import dt as to_time
from tidewright.functions.formula import FormulaError, check_formula, compile_formula, derive
from tidewright.operators import charts, checks, clean, kpi, metrics, profile, quantiles, roles
from tidewright.operators.derive import apply_schema
from tidewright.plans import jobs
from tidewright.sources.io import read_table, write_table


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_odd_numbers(spark):
    raw = ["1e3", " 2 ", "1,000", "$5", "5d", "0x1F", "True", "1_000", "-.5", "inf", None, ""]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string")
    got = [r[0] for r in df.orderBy("i").select(num(df, "raw")).collect()]
    assert got == [1000.0, 2.0, None, None, None, None, None, None, -0.5, math.inf, None, None]


def test_mixed_dates(spark):
    raw = ["2024-01-05", "01/02/2024", "13/02/2024", "Jan 5 2024", "20240105", "2024", "2024-01-05T06:07:08", "10:30", "abc", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string")
    got = [r[0] for r in df.orderBy("i").select(F.date_format(to_time(df, "raw"), "yyyy-MM-dd HH")).collect()]
    assert got == ["2024-01-05 00", "2024-01-02 00", "2024-02-13 00", "2024-01-05 00", "2024-01-05 00", "2024-01-01 00", "2024-01-05 06", None, None, None]


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (math.nan,), (None,)], "v double")
    assert nan_to_null(df).where("v is null").count() == 2
    row = profile.profile(df).first()
    assert (row.missing_count, row.unique_count, row.detected_type) == (2, 1, "number")


def test_profile_types_and_duplicates(spark):
    rows = [(str(i) if i < 17 else "x", "2024-01-0%d" % (i % 9 + 1) if i < 15 else "soon", None, i % 2 == 0) for i in range(20)]
    df = spark.createDataFrame(rows, "n string, d string, u string, b boolean")
    assert dict(values(profile.profile(df), "name", "detected_type")) == {"n": "number", "d": "datetime", "u": "unknown", "b": "number"}
    assert dict(values(profile.profile(df, approx=True), "name", "unique_count")) == {"n": 18, "d": 10, "u": 0, "b": 2}
    twice = spark.createDataFrame([(1, None), (1, None), (1, "n"), (1, "v")], "a int, b string")
    assert tuple(profile.duplicate_rows(twice).first()) == (4, 2, 1)
    assert tuple(profile.duplicate_rows(twice.limit(0)).first()) == (0, 2, 0)


def test_cleaning(spark):
    rows = [(None, None), (" ", " "), ("Rome", "1"), ("Rome ", "1"), ("Rome", "1"), ("nan", "2"), ("NULL", "3"), ("None", "4"), ("none", "5")]
    out = clean.clean(spark.createDataFrame(rows, "a string, b string"))
    # one row is empty, one repeated; the blank row stays; rows equal only after the trim stay
    assert sorted(values(out.table, "a", "b"), key=repr) == sorted([(None, None), ("Rome", "1"), ("Rome", "1"), (None, "2"), ("NULL", "3"), (None, "4"), ("none", "5")], key=repr)
    log = {r.action: r.rows for r in out.log.collect()}
    assert log == {"original_rows": 9, "empty_rows_removed": 1, "repeated_rows_removed": 1, "text_trimmed": None, "final_rows": 7}


@pytest.mark.parametrize("good,bad,kind,plan", [(90, 10, "1", {"v": "number"}), (89, 11, "1", {}), (85, 15, "2024-01-05", {"v": "datetime"}), (84, 16, "2024-01-05", {})])
def test_conversion_shares(spark, good, bad, kind, plan):
    df = spark.createDataFrame([(kind,)] * good + [(None,)] * bad, "v string")
    assert clean.conversions(df) == plan


def test_formula_values(spark):
    df = spark.createDataFrame([(-7.0, 3.0, None, "It's a Tea", "x"), (7.0, -3.0, "k", None, None), (5.0, 0.0, "Missing", "b", "y")], "a double, b double, k string, t string, `two words` string")

    def of(text):
        return [r[0] for r in derive(df, "out", text).orderBy("a").select("out").collect()]

    assert of("a % b") == [2.0, None, -2.0]
    assert of("a // b") == [-3.0, None, -3.0]
    assert of("if(a > 0, 'up', 'down')") == ["down", "up", "up"]
    assert of("concat(k, `two words`, '-')") == ["-x", "Missing-y", "k-"]
    assert of("contains(t, 'TEA')") == [True, False, False]
    assert of("1 < a <= 5") == [False, True, False]
    assert of("k != 'k'") == [True, True, False]
    assert of("round(a / 2) ") == [-4.0, 2.0, 4.0]
    assert of("log(a)")[0] is None and of("sqrt(b)")[2] is None
    assert of("bucket(a, [-7, 5, 6], ['L', 'H'])") == ["L", "L", None]
    assert of("coalesce(k, t)") == ["It's a Tea", "Missing", "k"]


def test_date_diff_floors(spark):
    df = spark.createDataFrame([("2024-01-01 06:00", "2024-01-02 00:00")], "a string, b string")
    assert derive(df, "d", "date_diff(a, b, 'days')").first().d == -1.0
    assert derive(df, "d", "date_diff(a, b, 'hours')").first().d == -18.0


UNSAFE = ["a.b", "a[0]", "lambda: 1", "__x", "open(a)", "round(a, n=1)", "[x for x in a]", "a; b", "a := 1", "nothing + 1", "year(a, a)", "'x' + 1", "a and 1", "bucket(a, [2, 1], ['x'])", "", "if(", "`a", "1 if a else 2", "{1: 2}", "a @ a", "f'{a}'", " + ".join(["a"] * 200)]


@pytest.mark.parametrize("text", UNSAFE)
def test_unsafe_formulas_are_refused(spark, text):
    df = spark.createDataFrame([(1.0,)], "a double")
    with pytest.raises(FormulaError):
        compile_formula(df, text)
    assert check_formula(df, text)


def test_missing_groups_and_ties(spark):
    df = spark.createDataFrame([(None, None), ("Missing", 1.0), ("b", 3.0), ("a", 3.0), ("c", None)], "k string, v double")
    spec = {"formula_type": "group_sum", "group_by": "k", "value_column": "v", "visual": "bar_chart"}
    assert values(kpi.grouped_chart(df, spec), "label", "value")[:2] == [("a", 3.0), ("b", 3.0)]
    got = dict(values(kpi.grouped_chart(df, spec).where("key is not null"), "label", "value"))
    assert got["c"] == 0.0
    mean = dict(values(kpi.grouped_chart(df, {**spec, "formula_type": "group_average"}), "label", "value"))
    assert mean["c"] is None


@pytest.mark.parametrize("data,bins,lo,counts", [([1.0, 2.0, 3.0, 10.0], 3, 0.991, [3, 0, 1]), ([5.0, 5.0], 2, 4.995, [2, 0]), ([0.0], 2, -0.001, [1, 0]), ([], 2, None, [])])
def test_histogram_edges(spark, data, bins, lo, counts):
    rows = kpi.histogram(spark.createDataFrame([(v,) for v in data], "v double"), "v", bins).collect()
    assert [r["count"] for r in rows] == counts
    assert not rows or rows[0].lo == pytest.approx(lo)


def test_scatter_takes_rows_before_dropping_missing(spark):
    df = spark.createDataFrame([(i, None if i == 3 else float(i), 1.0) for i in range(501)], "i int, x double, y double")
    assert kpi.scatter(df, "x", "y", ["i"]).count() == 499


def test_bad_kpis_do_not_stop_the_others(spark):
    df = spark.createDataFrame([("a", 1.0)], "k string, v double")
    specs = [{"name": "s", "formula_type": "sum", "column": "v"}, {"name": "x", "formula_type": "sum", "column": "gone"}, {"name": "n", "formula_type": "group_count", "group_by": "k", "top_n": "many"}, {"name": "g", "formula_type": "group_count", "group_by": "k"}, {"name": "m", "formula_type": "group_max", "group_by": "k", "value_column": "v"}, {"name": "?", "formula_type": "guess"}]
    out = kpi.compute(df, specs)
    assert [e["name"] for e in out.errors] == ["x", "n", "?"]
    assert values(out.cards, "title", "value") == [("s", 1.0)] and set(out.charts) == {"g", "m"}


def test_schema_plan_log(spark):
    df = spark.createDataFrame([("2024-03-01", 2.0)], "day string, v double")
    plan = {"rename_columns": [{"old_name": "day", "new_name": "date"}, {"old_name": "v", "new_name": "date"}, {"old_name": "no", "new_name": "x"}], "derived_columns": [{"name": "q", "formula_type": "extract_quarter", "input_columns": ["day"]}, {"name": "v", "formula_type": "extract_year", "input_columns": ["day"]}, {"name": "z", "formula_type": "guess"}, {"name": "w", "formula": "v * q2"}, {"name": "u", "formula": "v * 2"}]}
    out, log = apply_schema(df, plan)
    assert tuple(out.first()) == ("2024-03-01", 2.0, "2024-Q1", 4.0)
    assert [r.status for r in log.collect()] == ["applied", "rejected", "rejected", "applied", "rejected", "rejected", "rejected", "applied"]


def test_plan_checks(spark):
    df = spark.createDataFrame([(str(i % 7), float(i), "t%d" % i) for i in range(100)], "k string, v double, t string")
    plan = {"kpis": [{"name": "p", "formula_type": "group_sum", "group_by": "k", "value_column": "v", "visual": "pie_chart"}, {"name": "l", "formula_type": "group_count", "group_by": "k", "chart_type": "line_chart"}, {"name": "h", "formula_type": "histogram", "column": "t"}, {"name": "s", "formula_type": "scatter", "x": "v", "y": "v"}, {"name": "eval(", "formula_type": "count_rows"}]}
    checked, log = checks.check_kpis(df, plan)
    assert [(k["name"], k["visual"]) for k in checked["kpis"]] == [("p", "horizontal_bar_chart"), ("l", "bar_chart"), ("s", "scatter_plot")]
    assert checked["kpis"][0]["validation_note"] and log.where("status = 'rejected'").count() == 2
    schema, log = checks.check_schema(df, {"rename_columns": [{"old_name": "k", "new_name": "kind"}], "derived_columns": [{"name": "a", "formula_type": "multiply", "input_columns": ["v", "t"]}, {"name": "b", "formula": "concat(kind, t)"}, {"name": "c", "formula_type": "extract_date", "input_columns": ["t"]}]})
    assert [i["name"] for i in schema["derived_columns"]] == ["b"] and log.count() == 4


def test_role_words_and_parts(spark):
    df = spark.createDataFrame([("x", 1.0, "a")], "country string, coffee_name double, other string")
    guessed = roles.guess_roles(profile.profile(df))
    assert dict(values(guessed, "name", "role_guess")) == {"country": "location", "coffee_name": "product", "other": "text"}
    assert dict(values(roles.correct_roles(guessed), "name", "corrected_role"))["country"] == "quantity"
    assert dict(values(roles.correct_roles(guessed, "word"), "name", "corrected_role"))["country"] == "location"
    assert set(roles.safe_metadata(guessed).columns) == {"name", "detected_type", "role_guess", "role_confidence", "missing_percent", "unique_count"}
    assert roles.broad_domain(guessed).first().possible_business_domain == "sales_transactions"
    assert roles.broad_capabilities(guessed).first().product_analysis


def test_shares_sum_to_a_hundred(spark):
    groups = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 5.0)], "key string, value double")
    assert metrics.pct_of_total(groups).agg(F.sum("pct_of_total")).first()[0] == pytest.approx(100)


def test_patterns_hide_values(spark):
    df = spark.createDataFrame([("AB-12",), ("cd-34",), ("é9",)], "code string")
    assert tuple(metrics.pattern_profile(df, ["code"]).first())[:3] == ("code", "AA-##", 2)


def test_compact_numbers(spark):
    rows = [(None,), (1234.5,), (2.5e6,), (3e9,), (100.0,), (-1500000.0,)]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, v double")
    assert [r[0] for r in df.orderBy("i").select(charts.compact(F.col("v"))).collect()] == ["—", "1,234.5", "2.50M", "3.00B", "100", "-1.50M"]


def test_job_and_batch(spark, tmp_path):
    good = tmp_path / "sales.csv"
    good.write_text(" day ,product,price\n2024-01-05,tea,2.5\n2024-02-06,tea,3\n2024-02-06,tea,3\n2024-02-07,,4\n")
    (tmp_path / "odd.xyz").write_text("?")
    assert read_table(spark, str(good)).columns == ["day", "product", "price"]
    schema = {"derived_columns": [{"name": "month_", "formula": "month(day)"}]}
    kpis = {"kpis": [{"name": "total", "formula_type": "sum", "column": "price"}, {"name": "by month", "formula_type": "group_sum", "group_by": "month_", "value_column": "price", "visual": "line_chart"}]}
    manifest = jobs.batch(spark, [str(good), str(tmp_path / "odd.xyz")], str(tmp_path / "out"), schema, kpis)
    assert values(manifest, "table", "status", "rows_in", "rows_out") == [("odd.xyz", "failed", None, None), ("sales.csv", "succeeded", 4, 3)]
    summary = spark.read.json(str(tmp_path / "out/sales/summary")).first()
    assert (summary.rows_before, summary.rows_after, summary.kpis[0].value) == (4, 3, 9.5)
    assert [c.label for c in summary.charts] == ["2024-01", "2024-02"] and summary.findings[0].label == "2024-02"
    write_table(spark.range(2), str(tmp_path / "t.parquet"))
    assert read_table(spark, str(tmp_path / "t.parquet")).count() == 2


def test_first_occurrence_with_gaps_and_ties(spark):
    rows = [(1, "a", None, 1), (2, "a", "2024-01-02", 2), (3, "a", "2024-01-02", 1), (4, "b", None, 1), (5, None, "2024-01-01", 1), (6, "c", "2024-01-01", None), (7, "c", "2024-01-01", 3), (8, "d", "2024-05-01", 7), (9, "d", "2024-05-01", 7)]
    df = spark.createDataFrame(rows, "i int, who string, day string, tie int")
    out = metrics.first_occurrence(df, "who", "day", "tie")
    first = {r.i for r in out.where("is_first").collect()}
    # of rows equal in entity, date and tie, one
    assert out.count() == len(rows) and first - {8, 9} == {3, 6} and len(first) == 3


def test_one_of_equal_rows_is_first(spark):
    rows = [("a", "2024-01-02", 1)] * 500 + [("a", "2024-01-03", 0)] * 5 + [("b", "2024-01-01", 1)] * 2 + [("c", "soon", 1)] * 2
    out = metrics.first_occurrence(spark.createDataFrame(rows, "who string, day string, tie int").repartition(7), "who", "day", "tie")
    assert out.columns == ["who", "day", "tie", "is_first"]
    assert sorted(values(out.where("is_first"), "who", "day", "tie")) == [("a", "2024-01-02", 1), ("b", "2024-01-01", 1)]
    assert sorted(values(out.drop("is_first"), "who", "day", "tie")) == sorted(rows)
    with pytest.raises(ValueError):
        metrics.first_occurrence(out, "who", "day", "tie")


def test_csv_fields_over_lines_and_folders(spark, tmp_path):
    (tmp_path / "b.csv").write_text('day,note\n2024-01-01,"one\ntwo"\n')
    (tmp_path / "a.csv").write_text("day,note\n2024-01-01,x\n")
    (tmp_path / "c.txt").write_text("day\n")
    assert [r.note for r in read_table(spark, str(tmp_path / "b.csv"), multi_line=True).collect()] == ["one\ntwo"]
    assert [p.rsplit("/", 1)[1] for p in jobs.tables_in(spark, str(tmp_path))] == ["a.csv", "b.csv"]
    assert [r.table for r in jobs.batch(spark, str(tmp_path), str(tmp_path / "out")).collect()] == ["a.csv", "b.csv"]


def test_chart_metadata_names_limits_and_values(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("b", "y", 2.0)], "k string, c string, v double")
    specs = [
        {"name": "g", "formula_type": "group_sum", "group_by": "k", "value_column": "v", "top_n": 3, "visual": "bar_chart"}, {"name": "h", "formula_type": "histogram", "column": "v", "bins": 4},
        {"name": "m", "formula_type": "heatmap", "x_column": "k", "y_column": "c", "value_column": "v", "aggregation": "sum"},
    ]
    about = kpi.compute(df, specs).metadata
    assert about["g"]["top_n"] == 3 and about["h"]["bins"] == 4
    assert (about["m"]["x"], about["m"]["y"], about["m"]["value"], about["m"]["aggregation"]) == ("k", "c", "v", "sum")


def test_positions_go_on_over_partitions(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"), F.lit("x").alias("k"))
    out = charts.positions(df, F.desc("v"))
    assert out.columns == ["v", "k", "pos"]
    assert [(r.v, r.pos) for r in out.orderBy("pos").collect()] == [(4999 - i, i + 1) for i in range(5000)]
    assert charts.positions(df.limit(0), F.desc("v")).count() == 0


def test_positions_use_no_window_over_rows(spark):
    out = charts.positions(spark.range(1000).repartition(8), F.desc("id"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window") <= 2 and "sum(n_" in plan and "row_number" not in plan


def _grouped_by_hand(df, specs):
    return {s["name"]: kpi.grouped_chart(df, s).drop("label") for s in specs}


def test_grouped_sets_equal_single_groups(spark):
    rows = [(i % 3 if i % 7 else None, "xyz"[i % 3], float(i % 5) if i % 11 else None, -0.0 if i % 2 else 0.0, str(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "a int, b string, v double, z double, t string")
    specs = [{"name": f"{kind} by {key}", "formula_type": f"group_{kind}", "group_by": key, "value_column": value, "top_n": 100} for key, value in (("a", "v"), ("b", "t"), ("z", "v")) for kind in ("sum", "average", "median", "min", "max", "std", "count")]
    specs += [{"name": "some", "formula_type": "group_count", "group_by": "a", "filter_condition": "v > 2"}, {"name": "big", "formula_type": "group_sum", "group_by": "b", "value_column": "v", "filter_condition": "v > 2"}]
    out = kpi.compute(df, specs)
    assert not out.errors
    for name, want in _grouped_by_hand(df, specs).items():
        got = sorted(((repr(r.key), r.value) for r in out.charts[name].select("key", "value").collect()))
        assert got == [(k, pytest.approx(v)) for k, v in sorted((repr(r.key), r.value) for r in want.collect())], name


def test_grouped_sets_scan_once(spark, tmp_path):
    df = spark.createDataFrame([(i % 2, i % 3, i % 5, float(i)) for i in range(60)], "a int, b int, c int, v double")
    write_table(df, str(tmp_path / "t.parquet"))
    seen = []
    source = spark.read.parquet(str(tmp_path / "t.parquet"))
    original = kpi.stored

    def spy(rows, what):
        seen.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return original(rows, what)

    kpi.stored = spy
    try:
        made = kpi.compute(source, [{"name": k, "formula_type": "group_sum", "group_by": k, "value_column": "v"} for k in "abc"])
    finally:
        kpi.stored = original
    assert len(seen) == 1 and seen[0].count("Relation") == 1 and set(made.charts) == set("abc")


def test_cards_and_facts_without_expand(spark):
    df = spark.createDataFrame([(i % 40, i % 3000, None if i % 2 else "x") for i in range(6000)], "few int, many int, t string")
    specs = [{"name": c, "formula_type": "count_distinct", "column": c} for c in df.columns] + [{"name": "odd", "formula_type": "count_distinct", "column": "few", "filter_condition": "many > 2990"}, {"name": "n", "formula_type": "count_rows"}, {"name": "none", "formula_type": "count_distinct", "column": "few", "filter_condition": "many > 5000"}]
    cards = kpi.cards(df, specs)
    assert sorted(values(cards, "title", "value")) == [("few", 40.0), ("many", 3000.0), ("n", 6000.0), ("none", 0.0), ("odd", 9.0), ("t", 1.0)]
    facts = checks.column_facts(df, df.columns)
    assert (facts["few"].distinct, facts["t"].distinct) == (40, 1) and abs(facts["many"].distinct - 3000) < 300
    for plan in (cards, checks.facts_table(df, df.columns)):
        assert "Expand" not in plan._jdf.queryExecution().executedPlan().toString()
    edge = checks.column_facts(spark.createDataFrame([("",), (None,), ("a",)], "t string"), ["t"])
    assert edge["t"].distinct == 2


def test_heatmap_cut_keeps_what_all_cells_keep(spark):
    df = spark.createDataFrame([(i % 9 if i % 13 else None, i % 7, float(i % 4) if i % 5 else None) for i in range(500)], "a int, b int, v double")
    for value, kind in ((None, "count"), ("v", "sum"), ("v", "average")):
        cells = {}
        for a, b, v in [tuple(r) for r in df.collect()]:
            cells.setdefault(("Missing" if a is None else str(a), str(b)), []).append(v)
        made = {k: len(v) if kind == "count" else sum(x or 0 for x in v) if kind == "sum" else sum(x for x in v if x is not None) / len([x for x in v if x is not None]) for k, v in cells.items()}

        def top(axis):
            totals = {}
            for k, v in made.items():
                totals[k[axis]] = totals.get(k[axis], 0) + v
            return sorted(totals, key=lambda k: (-round(totals[k], 9), k))[:4]

        want = {k: v for k, v in made.items() if k[0] in top(0) and k[1] in top(1)}
        got = {(r.x, r.y): r.value for r in kpi.heatmap(df, "a", "b", value, kind, 4).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_signatures_of_date_shapes():
    assert coerce.signatures(r"\d{4}-\d{1,2}") == ["9999-9", "9999-99"]
    assert coerce.signatures(r"[A-Z][a-z]{3,8} \d{1,2},? \d{4}") == ["M 9 9999", "M 9, 9999", "M 99 9999", "M 99, 9999"]
    assert coerce.signatures(r"\d{2}(?:Z|[+-]\d{2}:\d{2})") == ["99Z", "99+99:99", "99-99:99"]


def test_batch_goes_on_beside_a_failure_and_keeps_caches(spark, tmp_path):
    for name, text in (("a", "k,v\nx,1\ny,2\n"), ("b", ""), ("c", "k,v\nx,3\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    (tmp_path / "d.csv").write_bytes("k,v\nété,1\n".encode("latin-1"))
    mine = spark.range(10).persist()
    mine.count()
    manifest = jobs.batch(spark, str(tmp_path), str(tmp_path / "out"), {}, {"kpis": [{"name": "n", "formula_type": "group_count", "group_by": "k"}]})
    assert [(r.table, r.status) for r in manifest.collect()] == [("a.csv", "succeeded"), ("b.csv", "failed"), ("c.csv", "succeeded"), ("d.csv", "succeeded")]
    assert mine.is_cached and mine.storageLevel.useMemory
    mine.unpersist()
    assert [r.label for r in spark.read.json(str(tmp_path / "out/d/chart_points")).collect()] == ["été"]


def test_job_writes_every_chart_and_log(spark, tmp_path):
    df = spark.createDataFrame([(f"2024-0{1 + i % 4}-01", "abc"[i % 3], float(i), float(i % 7)) for i in range(60)], "day string, kind string, v double, w double")
    plan = {"kpis": [
        {"name": "bins", "formula_type": "histogram", "column": "v", "bins": 5}, {"name": "cloud", "formula_type": "scatter", "x_column": "v", "y_column": "w", "color_column": "kind", "size_column": "v"},
        {"name": "cells", "formula_type": "heatmap", "x_column": "kind", "y_column": "day"}, {"name": "line", "formula_type": "group_sum", "group_by": "day", "value_column": "v", "visual": "line_chart"},
        {"name": "bars", "formula_type": "group_count", "group_by": "kind", "visual": "bar_chart"}, {"name": "all", "formula_type": "sum", "column": "v"}, {"name": "bad", "formula_type": "sum", "column": "gone"},
    ]}
    jobs.save(jobs.run(df, {"derived_columns": [{"name": "m", "formula": "month(day)"}, {"name": "m2", "formula": "nothing(day)"}]}, plan), str(tmp_path))
    read = lambda name: spark.read.json(f"{tmp_path}/{name}")
    points = read("chart_points")
    assert sorted(values(points.groupBy("chart", "chart_no", "type").count(), "chart", "chart_no", "type", "count")) == [("bars", 5, "bar", 3), ("bins", 1, "histogram", 5), ("cells", 3, "heatmap", 12), ("cloud", 2, "scatter", 60), ("line", 4, "line", 4)]
    for name in ("bins", "cells", "cloud", "line", "bars"):
        assert [r.pos for r in points.where(F.col("chart") == name).orderBy("pos").collect()] == list(range(1, points.where(F.col("chart") == name).count() + 1))
    cloud = points.where("chart = 'cloud'").orderBy("pos").collect()
    assert {(r.x, r.y, r.series, r.size) for r in cloud} == {(float(i), float(i % 7), "abc"[i % 3], float(i)) for i in range(60)}
    assert {(r.item, r.status) for r in read("kpi_log").collect()} == {(k["name"], "rejected" if k["name"] == "bad" else "accepted") for k in plan["kpis"]}
    assert {(r.item, r.status) for r in read("schema_log").collect()} == {("m", "accepted"), ("m2", "rejected")}
    assert {r["name"] for r in read("metadata").collect()} == {"day", "kind", "v", "w", "m"} and {r["name"] for r in read("chart_metadata").collect()} >= {"bins", "cloud", "cells", "line", "bars"}
    assert read("cards").first().value == sum(range(60))


def test_exact_quantiles_equal_percentiles(spark):
    import random

    rng = random.Random(4)
    rows = [(None if i % 17 == 0 else i % 4, rng.choice([rng.gauss(0, 1), rng.expovariate(1) * 10 ** rng.randint(-300, 300), -rng.expovariate(1) * 10 ** rng.randint(-30, 30), 0.0, -0.0, float(rng.randrange(5)), None])) for i in range(4000)]
    rows += [(7, None), (8, 2.5), (9, 1.0), (9, 2.0), (10, float("inf")), (10, float("-inf")), (10, 1.0), (10, 5.0), (10, float("inf"))]
    df = spark.createDataFrame(rows, "k int, v double")
    at = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    want = {r.key: r for r in df.groupBy(F.col("k").alias("key")).agg(F.count("v").alias("n"), F.percentile("v", at).alias("q")).collect()}
    for buckets in (64, 256):
        got = {r.key: r for r in quantiles.exact_quantiles(df, "k", "v", at, buckets).collect()}
        assert got.keys() == want.keys()
        for k in want:
            assert got[k].n == want[k].n and (got[k].q == want[k].q or got[k].q == pytest.approx(want[k].q, rel=1e-12, nan_ok=True)), k


def test_bounded_median_as_a_chart(spark):
    df = spark.createDataFrame([("ab"[i % 2], float(i * 37 % 101)) for i in range(400)], "k string, v double")
    specs = [{"name": n, "formula_type": "group_median", "group_by": "k", "value_column": "v", "bounded": n == "b", "filter_condition": "v > 10"} for n in "ab"]
    out = kpi.compute(df, specs)
    assert sorted(map(tuple, out.charts["a"].collect())) == sorted(map(tuple, out.charts["b"].collect())) and not out.errors


def test_merged_sketches_stand_for_the_union(spark):
    rows = [(i % 900 if i % 5 else None, f"t{i % 31}" if i % 3 else "", f"2024-01-{1 + i % 28:02d}", float("nan") if i % 4 else i / 7) for i in range(5000)]
    df = spark.createDataFrame(rows, "a int, b string, d string, f double")
    parts = [df.where(F.col("a") < 300), df.where(F.col("a") >= 300), df.where("a is null"), df.limit(0)]
    made = profile.sketches(parts[0])
    for part in parts[1:]:
        made = made.union(profile.sketches(part))
    got = {r.name: r for r in profile.described(profile.merged(made)).collect()}
    want = {r.name: r for r in profile.profile(df).collect()}
    for name, w in want.items():
        g = got[name]
        for c in ("detected_type", "row_count", "missing_count", "missing_percent", "min", "max"):
            assert g[c] == w[c], (name, c)
        assert (g.mean is None) == (w["mean"] is None) and (g.mean is None or g.mean == pytest.approx(w["mean"]))
        assert abs(g.unique_count - w.unique_count) <= 0.05 * w.unique_count + 1
    middle = sorted(r[0] for r in rows if r[0] is not None)[2000]
    assert got["a"].quantiles[1] == pytest.approx(middle, abs=30) and str(got["d"].min_date)[:10] == "2024-01-01"


def test_first_values_of_every_column(spark):
    rows = [(i, str(i) if i >= 50 else f"x{i}", None if i < 30 else "2024-01-01" if i < 45 else "soon", None) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, t string, d string, n string").repartition(9)
    got = {r.name: (r.n, r.numbers, r.dates) for r in profile.first_values(df, ["i"], 60, ["t", "d", "n", "i"]).collect()}
    assert got == {"t": (60, 10, 0), "d": (60, 0, 15), "n": (0, 0, 0), "i": (60, 60, 0)}


def test_profile_of_a_batch(spark, tmp_path):
    for name, text in (("a", "k,v\nx,1\ny,2\n"), ("b", "k,v\nx,7\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    jobs.batch(spark, str(tmp_path), str(tmp_path / "out"))
    got = {r.name: (r.row_count, r.unique_count, r.min, r.max) for r in jobs.batch_profile(spark, str(tmp_path / "out"), ["a.csv", "b.csv"]).collect()}
    assert got == {"k": (3, 2, None, None), "v": (3, 3, 1.0, 7.0)}


def test_backticks_in_names_and_texts(spark):
    df = spark.createDataFrame([(1, 2, 3, "a`b")], "`unit price` int, column_0_ int, column_1_ int, t string")
    made = lambda text: derive(df, "out", text).first()["out"]
    assert made("`unit price` + column_0_ * `column_1_`") == 7.0
    assert made("t == 'a`b'") is True and made("contains(t, \"`\") and `unit price` == 1") is True
    assert made("if(`unit price` > 0, 'it\\'s `ok`', '')") == "it's `ok`"
    for bad in ("`unit price + 1", "t == `", "`gone` + 1"):
        assert check_formula(df, bad)
