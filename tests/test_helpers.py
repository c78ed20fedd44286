import datetime as dt

from limnos.operators.profile import imputation_summary, shape
from limnos.operators.schema import bind_roles, normalise_date, project_positions, rename_columns
from limnos.sources.ingest import coerce_numeric, inline_rows, preview, write_table


def test_shape_rename_bind_positions(spark):
    df = spark.createDataFrame([(1, 2.0, "a"), (2, 3.0, "b")], "id int, chl_a_mg_L double, r string")
    assert tuple(shape(df).collect()[0]) == (2, 3)
    assert rename_columns(df, {"chl_a_mg_L": "chla", "missing": "x"}).columns == ["id", "chla", "r"]
    assert bind_roles(df, {"chl": "chl_a_mg_L"}, keep_others=True).columns == ["id", "r", "chl"]
    assert project_positions(df, [1, 3]).columns == ["id", "r"]


def test_coerce_dates_preview_write_inline(spark, tmp_path):
    df = spark.createDataFrame([("1.5", dt.datetime(2024, 5, 6, 7, 8)), ("x", dt.datetime(2024, 5, 7))],
                               "v string, ts timestamp")
    out = coerce_numeric(df, ["v"]).collect()
    assert out[0]["v"] == 1.5 and out[1]["v"] is None
    d = normalise_date(df, "ts", out="day", key_out="key").collect()
    assert d[0]["day"] == dt.date(2024, 5, 6) and d[0]["key"] == "20240506"
    assert [r["v"] for r in preview(df, "ts", 1).collect()] == ["1.5"]
    write_table(df, str(tmp_path / "csv"), fmt="csv")
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.count() == 2
    one = inline_rows(spark, [(0.01, 15.0)], "chl double, temp double")
    assert one.count() == 1


def test_imputation_summary(spark):
    before = spark.createDataFrame([(1.0,), (None,), (None,), (4.0,)], "a double")
    after = spark.createDataFrame([(1.0,), (2.0,), (None,), (4.0,)], "a double")
    r = imputation_summary(before, after, ["a"]).collect()[0]
    assert (r["missing_before"], r["missing_after"], r["pct_before"], r["pct_after"]) == (2, 1, 50.0, 25.0)


def test_project_numeric_keeps_numbers_only(spark):
    from limnos.operators.schema import project_numeric
    df = spark.createDataFrame([(1, 2.0, "a", True)], "i int, d double, s string, b boolean")
    assert project_numeric(df).columns == ["i", "d"]
