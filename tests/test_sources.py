import pytest
from pyspark.sql import functions as F

from columnary import full_report, read_csv, read_parquet
from columnary.operators import archive
from columnary.sources import (
    list_sections, purge_runs, purged_runs, read_section, reports, validate_csv_filename, write_experiment, write_sections,
)
from columnary.sources.csv import clean_headers


def write(path, content):
    path.write_bytes(content)
    return str(path)


def test_utf8_with_bom_quotes_and_missing_tokens(spark, tmp_path):
    path = write(tmp_path / "a.csv", '﻿ name ,x,x,ok\nÀb,1,2.5,True\n"q ""z""\nline",NA,3,False\nn/a,7,,\n'.encode())
    ds = read_csv(spark, path)
    assert ds.encoding == "utf-8-sig" and ds.names == ["name", "x", "x.1", "ok"]
    assert [f.lane for f in ds.fields] == ["text", "long", "double", "bool"]
    assert [tuple(r) for r in ds.source.collect()] == [("Àb", 1, 2.5, True), ('q "z"\nline', None, 3.0, False), (None, 7, None, None)]


def test_encoding_ladder(spark, tmp_path):
    windows = read_csv(spark, write(tmp_path / "w.csv", "naïve,y\ncafé €,1\n".encode("cp1252")))
    assert windows.encoding == "cp1252" and windows.source.first()[0] == "café €" and windows.names[0] == "naïve"
    latin = read_csv(spark, write(tmp_path / "l.csv", b"n,y\ncaf\x81\xe9,1\n"))
    assert latin.encoding == "latin-1" and latin.source.first()[0] == "caf\x81é"


def test_rows_longer_than_the_header_are_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="1 rows have more fields"):
        read_csv(spark, write(tmp_path / "long.csv", b"a,b\n1,2\n3,4,5\n6\n"))
    short = read_csv(spark, write(tmp_path / "short.csv", b"a,b\n1,2\n6\n"))
    assert [tuple(r) for r in short.source.collect()] == [(1, 2), (6, None)]


def test_file_names_and_headers():
    assert validate_csv_filename(" Data.CSV ") == "Data.CSV"
    for bad in (None, "", "a.txt"):
        with pytest.raises(ValueError):
            validate_csv_filename(bad)
    assert clean_headers([" a", "a ", "", "a.1", "a"]) == ["a", "a.1", "Unnamed: 2", "a.1.1", "a.2"]


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_report_round_trip(spark, tmp_path, fmt):
    ds = read_parquet(spark, "/root/testdata/sf0.001/part.parquet", "part", ["p_partkey"])
    report = full_report(ds, probe=False) if fmt == "parquet" else {"column_profile": full_report(ds, probe=False)["column_profile"]}
    path = str(tmp_path / "report")
    for run in (1, 2, 2):  # writing run 2 again replaces it
        write_sections(report, path, run, fmt)
    assert set(list_sections(spark, path)) == set(report)
    assert read_section(spark, path, "column_profile", 2, fmt).count() == len(ds.names)
    assert read_section(spark, path, "column_profile", fmt=fmt).count() == 2 * len(ds.names)


def test_experiment_sink(spark, tmp_path):
    path = str(tmp_path / "experiments")
    write_experiment(spark.createDataFrame([("m", 1.0)], "model string, value double"), path, 4, "exp_1")
    write_experiment(spark.createDataFrame([("m", 2.0)], "model string, value double"), path, 4, "exp_2")
    assert {r.experiment_id for r in spark.read.parquet(path).collect()} == {"exp_1", "exp_2"}


def test_deleting_an_experiment_falls_back_to_the_one_before(spark):
    rows = [(1, "e1", "supervised", "2024-01-01", "old"), (1, "e2", "supervised", "2024-01-02", "new"), (1, "e3", "unsupervised", "2024-01-03", "scan")]
    experiments = spark.createDataFrame(rows, "analysis_id long, experiment_id string, experiment_type string, created_at string, summary string")
    experiments = archive.append_experiment(experiments, 2, "supervised", "e4", "2024-02-01", "other")
    latest = {(r.analysis_id, r.experiment_type): r.experiment_id for r in archive.latest_results(experiments).collect()}
    assert latest == {(1, "supervised"): "e2", (1, "unsupervised"): "e3", (2, "supervised"): "e4"}
    gone = spark.createDataFrame([(1, "e2")], "analysis_id long, experiment_id string")
    latest = {(r.analysis_id, r.experiment_type): r.experiment_id for r in archive.latest_results(experiments, gone).collect()}
    assert latest[1, "supervised"] == "e1"


def test_purged_runs_are_gone_and_can_come_back(spark, tmp_path):
    path = str(tmp_path / "store")
    for run, df in ((1, spark.range(3)), (2, spark.range(4).withColumn("more", F.lit("m"))), (3, spark.range(5))):
        write_sections({"facts": df}, path, run)
    both = {(r.analysis_id, r.id, r.more) for r in read_section(spark, path, "facts").collect()}
    assert (1, 0, None) in both and (2, 3, "m") in both and len(both) == 12
    # a purge that stopped behind its marks hides the run all the same
    spark.range(1).write.json(f"{path}/{reports._MARKS}/analysis_id=2")
    assert {r.analysis_id for r in read_section(spark, path, "facts").collect()} == {1, 3}
    assert read_section(spark, path, "facts", 2).count() == 0
    purge_runs(spark, path, [2, 3])
    purge_runs(spark, path, [3])
    assert purged_runs(spark, path) == [2, 3] and read_section(spark, path, "facts").count() == 3
    write_sections({"facts": spark.range(7)}, path, 3)
    assert purged_runs(spark, path) == [2] and read_section(spark, path, "facts", 3).count() == 7
