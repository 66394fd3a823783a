"""CSV source and report sink round trips."""

import os

import pytest

from paysift.sources.csv import read_header_csv, write_report


def test_report_sink_modes(spark, scratch):
    df = spark.createDataFrame([("Overall", 1.5, 3), ("A", 2.5, 1)], "DRG string, AvgError double, TestRows long")
    path = os.path.join(scratch, "report")
    write_report(df, path)
    with pytest.raises(Exception):
        write_report(df, path)  # default refuses an existing path
    write_report(df, path, mode="overwrite")
    back = read_header_csv(spark, path)
    assert back.columns == ["DRG", "AvgError", "TestRows"]
    assert sorted(tuple(r) for r in back.collect()) == [("A", "2.5", "1"), ("Overall", "1.5", "3")]
    assert len([f for f in os.listdir(path) if f.startswith("part-")]) == 1


def test_header_csv_all_strings_with_given_schema(spark, scratch):
    path = os.path.join(scratch, "in.csv")
    with open(path, "w") as fh:
        fh.write("DRG Definition,Average Total Payments\n194 - X,$12.50\n")
    df = read_header_csv(spark, path)
    assert df.columns == ["DRG Definition", "Average Total Payments"]
    assert df.collect()[0][1] == "$12.50"
    typed = read_header_csv(spark, path, ["DRG Definition", "Average Total Payments"])
    assert [f.dataType.simpleString() for f in typed.schema] == ["string", "string"]


def test_read_table_formats(spark, scratch):
    from paysift.sources.csv import read_table

    df = spark.createDataFrame([(1, "a")], "id int, v string")
    df.write.parquet(os.path.join(scratch, "p"))
    assert read_table(spark, os.path.join(scratch, "p"), columns=["v"]).columns == ["v"]


def test_predict_prices_writes_both_reports(spark, scratch):
    from paysift.plans.models import predict_prices
    from .conftest import SF_SMOKE

    paths = predict_prices(spark, SF_SMOKE, os.path.join(scratch, "out"), kind="tree")
    pooled = read_header_csv(spark, paths["pooled"])
    grouped = read_header_csv(spark, paths["grouped"])
    assert pooled.columns[0] == "DRG" and pooled.where("DRG = 'Overall'").count() == 1
    assert grouped.where("DRG = 'Overall'").count() == 0 and grouped.count() > 0
    with pytest.raises(Exception):
        predict_prices(spark, SF_SMOKE, os.path.join(scratch, "out"), kind="tree")
    predict_prices(spark, SF_SMOKE, os.path.join(scratch, "out"), kind="tree", mode="overwrite")


def test_reports_come_all_or_none(spark, scratch, monkeypatch):
    """A run that is lost between its reports, or between their renames, is repeated."""
    from paysift.sources import csv

    out, calls = os.path.join(scratch, "out"), []

    def report(name, fails=False):
        def compute():
            calls.append(name)
            if fails:
                raise RuntimeError("driver lost")
            return spark.createDataFrame([(name, 1)], "DRG string, n long")
        return compute

    with pytest.raises(RuntimeError):
        csv.write_reports(spark, {"a": report("a"), "b": report("b", True)}, out, "r1")
    assert not os.path.exists(os.path.join(out, "a"))
    # staged whole, renamed by half: as left by a driver that was lost there
    paths = csv.write_reports(spark, {"a": report("a"), "b": report("b")}, out, "r1")
    os.makedirs(os.path.join(out, "_staging-r1"))
    os.rename(paths["b"], os.path.join(out, "_staging-r1", "b"))
    open(os.path.join(out, "_staging-r1", "_READY"), "w").close()
    calls.clear()
    again = csv.write_reports(spark, {"a": report("a"), "b": report("b")}, out, "r1")
    assert again == paths and calls == [] and sorted(os.listdir(out)) == ["a", "b"]
    assert [r.DRG for r in read_header_csv(spark, paths["b"]).collect()] == ["b"]
    with pytest.raises(FileExistsError):
        csv.write_reports(spark, {"a": report("a")}, out, "r2")
    csv.write_reports(spark, {"a": report("new")}, out, "r2", mode="overwrite")
    assert [r.DRG for r in read_header_csv(spark, paths["a"]).collect()] == ["new"]


def test_wide_csv_parses_only_the_named_columns(spark, scratch):
    from paysift.sources.csv import read_wide_csv

    path = os.path.join(scratch, "wide.csv")
    with open(path, "w") as fh:
        fh.write("RegionName," + ",".join(f"m{k}" for k in range(300)) + "\n00042," + ",".join(str(k) for k in range(299)) + ",\n")
    df = read_wide_csv(spark, path, ["m7", "RegionName", "m299"])
    assert [tuple(r) for r in df.collect()] == [("7", "00042", None)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<RegionName:string,m7:string,m299:string>" in plan
    with pytest.raises(ValueError, match="m300"):
        read_wide_csv(spark, path, ["m300"])
