import os
import warnings

import duckdb
import pytest

from limnos.operators.schema import (datetime_columns, drop_empty_columns, require_columns, validate_nonnegative)
from limnos.sources.ingest import parse_date_all_or_nothing, read_measurements, sentinels_to_null

SF = "/root/testdata/sf0.001"


def test_read_csv_na_blank_sentinel_and_latin1(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_bytes("site,temp,do,remark\nA,1.5,NA,ok\nB,,-999,caf\xe9\nC,2.5,8.0,ok\n".encode("latin-1"))
    df = read_measurements(spark, str(p), numeric_sentinels=[-999])
    rows = {r["site"]: r for r in df.collect()}
    assert rows["A"]["do"] is None and rows["B"]["temp"] is None and rows["B"]["do"] is None
    assert rows["B"]["remark"] == "café"


def test_each_file_is_decoded_by_its_bytes(spark, tmp_path):
    from limnos.sources.ingest import invalid_utf8_files
    folder = tmp_path / "mixed folder"
    folder.mkdir()
    (folder / "a 1.csv").write_bytes("site,name,v\nA,caf\xe9,1\n".encode("utf-8"))
    (folder / "b.csv").write_bytes("site,name,v\nB,caf\xe9,2\n".encode("latin-1"))
    (folder / "c.csv").write_bytes(b"site,name,v\nC,plain,3\n")
    assert sorted(invalid_utf8_files(spark, str(folder)).values()) == [False, False, True]
    for schema in (None, "site string, name string, v int"):
        rows = read_measurements(spark, str(folder), schema=schema).orderBy("site").collect()
        assert [tuple(r) for r in rows] == [("A", "café", 1), ("B", "café", 2), ("C", "plain", 3)]


def test_text_sentinels_and_dates(spark):
    df = spark.createDataFrame([("NA", "2024-01-02"), (" NA ", "2024-01-03"), ("Inf", ""), ("1.5", "2024-01-05")],
                               "v string, d string")
    out = sentinels_to_null(df, text={"v": ["NA", "Inf"]}).collect()
    assert [r["v"] for r in out] == [None, None, None, "1.5"]
    parsed = parse_date_all_or_nothing(df, "d")
    assert str(parsed.schema["d"].dataType) == "DateType()"
    bad = spark.createDataFrame([("2024-01-02",), ("nope",)], "d string")
    with warnings.catch_warnings(record=True):
        warnings.simplefilter("always")
        assert str(parse_date_all_or_nothing(bad, "d").schema["d"].dataType) == "StringType()"
    assert datetime_columns(df.select("d").where("d <> ''")) == ["d"]


def test_schema_checks(spark):
    df = spark.createDataFrame([(1.0, None, -1.0), (2.0, None, 3.0)], "a double, b double, c double")
    with pytest.raises(ValueError):
        require_columns(df, ["a", "zz"])
    assert require_columns(df, ["a", "zz"], mode="any") == ["a"]
    assert drop_empty_columns(df).columns == ["a", "c"]
    ok, bad = validate_nonnegative(df, ["c"])
    assert ok.count() == 1 and bad.count() == 1


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    out = E.entry(spark)
    assert out.count() == 2 and set(out.columns) >= {"column", "count", "mean", "p50"}
    assert set(E.oracle_sql()) <= set(E.queries())


def _oracle_names():
    import __spark_entry__ as E
    return sorted(E.oracle_sql())


@pytest.mark.parametrize("name", _oracle_names())
def test_oracle_agreement_sf0001(spark, name):
    import __spark_entry__ as E
    con = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
    s = E.queries()[name](spark, SF).toPandas()
    o = con.execute(E.oracle_sql()[name]).df()
    cols = sorted(s.columns)
    assert cols == sorted(o.columns)

    def norm(df):
        rows = [tuple(None if v is None or v != v else (round(v, 6) if isinstance(v, float) else v) for v in r)
                for r in df[cols].itertuples(index=False, name=None)]
        return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))
    assert norm(s) == norm(o)


def test_strict_nonnegative_raises(spark):
    df = spark.createDataFrame([(1.0,), (-2.0,)], "c double")
    with pytest.raises(Exception):
        validate_nonnegative(df, ["c"], strict=True).collect()
    assert validate_nonnegative(df.where("c > 0"), ["c"], strict=True).count() == 1


def test_renamed_csv_with_explicit_schema(spark, tmp_path):
    p = tmp_path / "raw.csv"
    p.write_text("Sample _ID,CTDOXY_mg/L,pH_TS_20C\n1,-999,8.01\n2,6.5,NA\n")
    schema = "sample_id int, do double, ph double"
    df = read_measurements(spark, str(p), schema=schema, numeric_sentinels=[-999])
    rows = {r["sample_id"]: r for r in df.collect()}
    assert rows[1]["do"] is None and rows[1]["ph"] == 8.01 and rows[2]["ph"] is None
