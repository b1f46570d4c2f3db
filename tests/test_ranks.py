import numpy as np
import pytest
from pyspark.sql import functions as F

from columnary import Dataset
from columnary.operators import ordinals, ranks


def table(spark, columns):
    rows = [tuple(None if v is None else float(v) for v in r) for r in zip(*columns.values())]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(5)


@pytest.mark.parametrize("inside", [1_000_000, 20])
def test_quantiles_equal_numpy(spark, inside):
    rng = np.random.default_rng(3)
    n = 4000
    columns = {
        "smooth": rng.normal(size=n),
        "third": np.where(rng.random(n) < 0.34, 7.0, rng.normal(size=n) * 1e6),  # one value holds a third
        "tail": np.exp(rng.normal(size=n) * 20),
        "few": rng.integers(0, 3, n).astype(float),
        "constant": np.full(n, 2.5),
    }
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    df = table(spark, columns)
    found = ranks.exact_quantiles(df, {c: F.col(c) for c in columns}, probs, inside)
    for c, values in columns.items():
        assert np.allclose(found[c], np.quantile(values, probs), rtol=1e-12, atol=0), c


def test_quantiles_of_empty_and_tiny_columns(spark):
    df = spark.createDataFrame([(None, 4.0), (None, None)], "a double, b double")
    found = ranks.exact_quantiles(df, {"a": F.col("a"), "b": F.col("b")}, [0.25, 0.5])
    assert found == {"a": [None, None], "b": [4.0, 4.0]}


def test_row_ids_follow_the_order_under_any_partitioning(spark):
    rows = [(int(k), f"r{k}") for k in np.random.default_rng(1).permutation(1000)]
    for parts in (1, 7):
        ds = Dataset(spark.createDataFrame(rows, "k long, v string").repartition(parts), order_by=["k"])
        assert {(r.k, r.row_id) for r in ordinals.with_row_id(ds).collect()} == {(k, k) for k in range(1000)}


def test_split_point_with_tied_first_keys(spark):
    rows = [(i // 400, i % 400, "abc"[i % 3]) for i in range(1200)]
    ds = Dataset(spark.createDataFrame(rows, "a long, b long, c string").repartition(6), order_by=["a", "b", "c"])
    for rank in (0, 1, 399, 400, 600, 1199):
        late = ds.rows.where(ordinals.from_rank(ds, rank)).collect()
        assert sorted((r.a, r.b, r.c) for r in late) == sorted(rows)[rank:]


def test_split_point_without_keys_uses_arrival(spark):
    ds = Dataset(spark.range(100).coalesce(1))
    assert ds.rows.where(ordinals.from_rank(ds, 50)).count() == 50


def test_missing_order_keys_come_first(spark):
    ds = Dataset(spark.createDataFrame([(1,), (None,), (0,)], "k long"), order_by=["k"])
    assert sorted(r.k for r in ds.rows.where(ordinals.from_rank(ds, 1)).collect()) == [0, 1]


def test_rows_of_files_are_numbered_in_file_order(spark, tmp_path):
    """The same numbers in every read, over several files and a filter, with no key."""
    path = str(tmp_path / "parts")
    spark.range(1000).selectExpr("id", "id % 7 AS v").repartitionByRange(6, "id").write.parquet(path)
    seen = []
    for _ in range(2):
        ds = Dataset(spark.read.parquet(path), hold=False)
        late = {r.id for r in ds.rows.where(ordinals.from_rank(ds, 500)).collect()}
        assert late == set(range(500, 1000))
        seen.append(sorted((r.id, r.row_id) for r in ordinals.with_row_id(ds).collect()))
    assert seen[0] == seen[1] == [(i, i) for i in range(1000)]
    some = Dataset(spark.read.parquet(path).where("v = 3"), hold=False)
    assert some.rows.where(ordinals.from_rank(some, 100)).count() == some.row_count - 100


def test_hot_order_key_is_spread(spark):
    """Half of all rows have one key: their ids are gapless and no range holds most of them."""
    rows = spark.range(20_000).selectExpr("CASE WHEN id % 2 = 0 THEN 5 ELSE id END AS k", "id AS v")
    ds = Dataset(rows.repartition(4), order_by=["k"], hold=False)
    got = ordinals.with_row_id(ds)
    assert [r.row_id for r in got.orderBy("row_id").select("row_id").collect()] == list(range(20_000))
    assert got.where("k < 5").agg(F.max("row_id").alias("m")).first().m < got.where("k > 5").agg(F.min("row_id").alias("m")).first().m


def test_rank_is_found_by_repeated_narrowing(spark, monkeypatch):
    monkeypatch.setattr(ordinals, "NARROW", 50)
    rows = spark.range(3000).selectExpr("concat('key ', lpad(id % 1500, 5, '0')) AS k")
    for rank in (0, 777, 1499, 2999):
        assert ordinals.key_at(rows, [F.col("k")], rank) == (f"key {rank // 2:05d}",)
