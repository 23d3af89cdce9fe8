import pytest
from tables import rows_of
from pyspark.sql import functions as F

from spanwise.report import overview, prepare, selection
from spanwise.results import exchange, longform, reshape
from spanwise.results.longform import OVERALL, RESULT_SCHEMA, SummarisedResult


def line(ident, variable, name, kind, value, level=None, strata=(OVERALL, OVERALL), additional=(OVERALL, OVERALL), cdm="db"):
    return (ident, cdm, "table", "records", *strata, variable, level, name, kind, value, *additional)


@pytest.fixture(scope="module")
def result(spark):
    rows = [
        line(1, "number subjects", "count", "integer", "1200"),
        line(1, "duration", "median", "numeric", "1234.5"),
        line(1, "duration", "q25", "numeric", "10.25"),
        line(1, "duration", "q75", "numeric", "2000"),
        line(1, "sex", "count", "integer", "1000", "Female"),
        line(1, "sex", "percentage", "percentage", "83.3333", "Female"),
        line(1, "sex", "count", "integer", "3", "Male", ("sex", "Male")),
        line(1, "sex", "percentage", "percentage", "0.25", "Male", ("sex", "Male")),
        line(2, "number subjects", "count", "integer", "4", None, ("sex &&& age_group", "Male &&& 0 to 19")),
        line(2, "duration", "mean", "numeric", "77", None, ("sex &&& age_group", "Male &&& 0 to 19")),
        line(2, "duration", "count", "integer", "0", None, ("age_group", "0 to 19")),
        line(2, "duration", "count", "integer", "5", "x", ("age_group", "0 to 19")),
    ]
    entries = [{"mode": "first"}, {"mode": "second"}]
    settings = longform.settings_table(spark, "summarise_table", entries)
    return SummarisedResult(spark.createDataFrame(rows, RESULT_SCHEMA), settings)


def test_small_counts_take_their_neighbours_along(result):
    shown = longform.suppress(result, 5)
    values = rows_of(shown.rows.filter("result_id = 1 and variable_name = 'sex'"), "variable_level", "estimate_name", "estimate_value")
    assert values == [
        ("Female", "count", "1000"),
        ("Female", "percentage", "83.3333"),
        ("Male", "count", None),
        ("Male", "percentage", None),
    ]
    second = rows_of(shown.rows.filter("result_id = 2"), "strata_name", "variable_name", "estimate_name", "estimate_value")
    assert second == [
        ("age_group", "duration", "count", "0"),
        ("age_group", "duration", "count", "5"),
        ("sex &&& age_group", "duration", "mean", None),
        ("sex &&& age_group", "number subjects", "count", None),
    ]
    assert {r["min_cell_count"] for r in shown.settings.collect()} == {"5"}


def test_split_and_unite_are_inverse(result):
    pairs = {p: reshape.pair_columns(result.rows, p) for p in longform.PAIRS}
    assert pairs == {"group": ["table"], "strata": ["age_group", "sex"], "additional": []}
    wide = reshape.split_all(result.rows, pairs)
    assert set(rows_of(wide, "sex", "age_group")) == {
        (OVERALL, OVERALL),
        ("Male", OVERALL),
        ("Male", "0 to 19"),
        (OVERALL, "0 to 19"),
    }
    back = longform.unite_pair(wide, "group", ["table"])
    back = longform.unite_pair(back, "strata", ["sex", "age_group"])
    back = longform.unite_pair(back, "additional", [])
    assert rows_of(back, *longform.RESULT_COLUMNS) == rows_of(result.rows)


def test_binding_renumbers(result):
    bound = longform.bind(result, result)
    assert rows_of(bound.settings, "result_id", "mode") == [(1, "first"), (2, "second"), (3, "first"), (4, "second")]
    counts = {r["result_id"]: r["count"] for r in bound.rows.groupBy("result_id").count().collect()}
    assert counts == {1: 8, 2: 4, 3: 8, 4: 4}
    assert longform.bind().rows.isEmpty() and longform.bind().settings.isEmpty()


def test_export_and_import(spark, result, tmp_path):
    for name in ("one", "two"):
        exchange.export_result(result, folder=str(tmp_path), cdm_name=name, min_cell_count=0)
    found = exchange.import_results(spark, str(tmp_path))
    assert rows_of(found.settings, "result_id", "mode", "min_cell_count") == [
        (1, "first", "0"),
        (2, "second", "0"),
        (3, "first", "0"),
        (4, "second", "0"),
    ]
    both = longform.bind(result, result)
    assert rows_of(found.rows) == rows_of(both.rows)


def test_bundle_is_built_once(spark, result, tmp_path):
    calls = []

    def rebuild():
        calls.append(1)
        return {"rows": result.rows}

    for _ in range(2):
        found = exchange.load_bundle(spark, str(tmp_path / "bundle"), ["rows"], rebuild)
    assert rows_of(found["rows"]) == rows_of(result.rows)
    assert len(calls) == 1


def test_pivot_types(result):
    wide = reshape.pivot_estimates(result.rows.filter("result_id = 1"))
    assert dict(wide.dtypes)["count"] == "bigint"
    row = wide.filter("variable_name = 'duration'").first()
    assert (row["median"], row["q25"], row["count"]) == (1234.5, 10.25, None)
    assert wide.filter("variable_level = 'Female'").first()["count"] == 1000


def test_templates(result):
    rows = reshape.format_values(result.rows.filter("result_id = 1"), {"integer": 0, "numeric": 1, "percentage": 1})
    rows = reshape.format_names(rows, prepare.PANEL_TEMPLATES)
    assert rows_of(rows, "variable_name", "variable_level", "estimate_name", "estimate_value") == [
        ("duration", None, "median [Q25 - Q75]", "1,234.5 [10.2 - 2,000.0]"),
        ("number subjects", None, "N", "1,200"),
        ("sex", "Female", "N (%)", "1,000 (83.3%)"),
        ("sex", "Male", "N (%)", "3 (0.2%)"),
    ]


def test_missing_estimates_stay_rows(result):
    rows = longform.suppress(result, 5).rows.filter("variable_level = 'Male'")
    found = reshape.format_names(rows, prepare.PANEL_TEMPLATES)
    assert rows_of(found, "estimate_name", "estimate_value") == [("count", None), ("percentage", None)]


def test_header_and_merged_columns(result):
    rows = reshape.add_settings(result.rows, result.settings, ["mode"]).select("cdm_name", "mode", "variable_name", "strata_level", "estimate_name", "estimate_value")
    wide = reshape.format_header(rows.filter("variable_name = 'number subjects'"), ["cdm_name", "mode"])
    assert wide.columns[-2:] == ["db / first", "db / second"]
    merged = reshape.merge_columns(rows, ["variable_name", "strata_level"])
    assert merged.columns == ["cdm_name", "mode", "variable_name; strata_level", "estimate_name", "estimate_value"]
    assert merged.first()[2] == "number subjects; overall"


def test_filter_result(result):
    found = selection.filter_result(
        result,
        settings={"mode": ["second"], "absent": ["x"]},
        grouping={"age_group": ["0 to 19"], "absent": ["x"]},
        variable_name=["duration"],
    )
    assert rows_of(found.rows, "estimate_name", "estimate_value") == [("count", "0"), ("count", "5"), ("mean", "77")]
    assert found.settings.count() == 1
    none = selection.filter_result(result, settings={"mode": ["third"]})
    assert none.rows.isEmpty() and none.settings.isEmpty()


def test_options(result):
    options = selection.filter_options(result, {"all": [1, 2], "one": [1]})
    assert options["all_settings_mode"] == ["first", "second"]
    assert options["one_settings_mode"] == ["first"]
    assert options["all_grouping_age_group"] == ["0 to 19", "overall"]
    assert options["one_estimate_name"] == ["count", "median", "percentage", "q25", "q75"]
    assert "age_group" in options["all_tidy_columns"]


def test_relabelling(result):
    labels = {"first": "The first", "second": "The second"}
    named = selection.relabel_result(result, {"db": "Database"}, labels)
    assert {r["cdm_name"] for r in named.rows.collect()} == {"Database"}
    assert {r["mode"] for r in named.settings.collect()} == set(labels.values())
    assert selection.relabel_result(result, {"other": "x"}, labels).rows.isEmpty()
    kept = selection.relabel_result(result, None, {"first": "The first"})
    assert kept.settings.count() == 1 and kept.rows.count() == 8


def test_rows_without_a_mode_stay(spark, result):
    settings = result.settings.withColumn("mode", F.when(F.col("result_id") == 2, F.col("mode")))
    named = selection.relabel_result(SummarisedResult(result.rows, settings), None, {"second": "S"})
    assert rows_of(named.settings, "result_id", "mode") == [(1, None), (2, "S")]


def test_row_selections(spark):
    rows = spark.createDataFrame([("a", 2000), (None, 2001), ("b", 2002)], "x string, year int")
    assert rows_of(selection.drop_rows(rows, x=["a"]), "year") == [(2001,), (2002,)]
    assert rows_of(selection.select_rows(rows, x=["a", "b"], year=None), "year") == [(2000,), (2002,)]
    assert rows_of(selection.year_range(rows, 2001, None), "year") == [(2001,), (2002,)]


def test_overview(spark, result):
    text = [r["message"] for r in overview.overview_text(result, 4).orderBy("line").collect()]
    assert text == [
        "Results contain 12 rows with 2 different result_id.",
        "Results contain 4 panels with 1 different result_type.",
        "Results contain data from 1 different cdm objects: db.",
    ]


def test_versions_and_suppression(spark):
    sets = spark.createDataFrame(
        [(1, "a", "1", "0"), (2, "a", "2", "1"), (3, "b", "1", "5"), (4, "b", "1", "5")],
        "result_id int, package_name string, package_version string, min_cell_count string",
    )
    found = [tuple(r) for r in overview.package_versions(sets).select("package_name", "result_ids", "group").collect()]
    assert found == [
        ("a", 1, "Inconsistent package versions"),
        ("a", 1, "Inconsistent package versions"),
        ("b", 2, "Consistent package versions"),
    ]
    tally = [tuple(r) for r in overview.suppression_tally(sets).select("min_cell_count", "n").collect()]
    assert tally == [("0", 2), ("5", 2)]


def test_empty_result(spark):
    empty = longform.empty_result(spark)
    assert empty.rows.isEmpty()
    assert longform.suppress(empty).rows.isEmpty()
    assert prepare.simple_table(empty).isEmpty()


def test_paper_patch(spark):
    rows = spark.createDataFrame(
        [("db", "Bespoke", "Number person-days", "overall", "overall", 2015, 730), ("db", "Persistence 180", "Number person-days", "overall", "overall", 2015, 365)],
        "cdm_name string, mode string, variable_name string, age_group string, sex string, year int, count long",
    )
    table = prepare.paper_person_years(rows, patch=("db", "Bespoke", "Other"))
    assert rows_of(table, "mode", "count", "person-years") == [("Bespoke", 730, 2.0), ("Other", 0, 0.0)]


def test_suppressed_counts_cannot_be_worked_out(spark):
    """With a small denominator no estimate of the stratum is left, nor person-days of few periods."""
    rows = [
        ("a", "Denominator", "denominator_count", "integer", "3"),
        ("a", "Denominator", "person_years", "numeric", "7.5"),
        ("a", "Outcome", "outcome_count", "integer", "0"),
        ("a", "Outcome", "incidence_100000_pys_95CI_upper", "numeric", "49185.1"),
        ("b", "Number records in observation", "count", "integer", "2"),
        ("b", "Number person-days", "count", "integer", "420"),
        ("c", "Denominator", "denominator_count", "integer", "30"),
        ("c", "Outcome", "outcome_count", "integer", "0"),
    ]
    long = [
        (1, "db", "g", g, "overall", "overall", v, None, e, k, x, "overall", "overall") for g, v, e, k, x in rows
    ]
    table = spark.createDataFrame(long, longform.RESULT_SCHEMA)
    settings = longform.settings_table(spark, "incidence", [{"mode": "m"}])
    left = longform.suppress(longform.SummarisedResult(table, settings), 5).rows
    shown = {(r["group_level"], r["variable_name"], r["estimate_name"]) for r in left.filter("estimate_value IS NOT NULL").collect()}
    assert shown == {("c", "Denominator", "denominator_count"), ("c", "Outcome", "outcome_count")}
