import math

import numpy as np
import pytest

from columnary import Dataset
from columnary.operators import charts, drift, insights, quality, stats


@pytest.fixture(scope="module")
def flawed(spark):
    rows = []
    for i in range(200):
        spike = 1000.0 if i % 20 == 0 else float(i % 10)
        rows.append((i, "k", "a" if i < 191 else "b", str(i) if i % 2 else f"w{i}", f"code {i:04d}", float(i), 2.0 * i, spike, None if i % 4 == 0 else 1.5 * (i % 9)))
    rows += rows[:3]
    df = spark.createDataFrame(rows, "id long, const string, near string, mixed string, key_text string, x double, y double, spike double, gap double")
    return Dataset(df, "flawed", ["id"])


def test_every_flag_is_raised(flawed):
    flags = {(r.column, r.flag) for r in quality.quality_flags(flawed).collect()}
    assert {("const", "constant"), ("near", "near_constant"), ("mixed", "invalid_numeric"), ("key_text", "high_cardinality"), ("spike", "outlier")} <= flags


def test_penalties_add_up(flawed):
    s = quality.quality_score(flawed).first()
    assert all(s[p] > 0 for p in quality.PENALTIES)
    assert math.isclose(s.quality_score, round(100 - sum(s[p] for p in quality.PENALTIES), 2), abs_tol=0.011)
    assert quality.quality_score(flawed, "count").first().constant == 8.0
    assert quality.duplicate_row_count(flawed) == 3


def test_missing_values_equal_each_other_in_duplicates(spark):
    ds = Dataset(spark.createDataFrame([(None, 1)] * 5 + [(None, 2), ("a", None)], "a string, b int"))
    assert quality.duplicate_row_count(ds) == 4


def test_summary_matches_pandas(spark, flawed):
    pdf = flawed.source.toPandas()
    for r in stats.numeric_summary(flawed).collect():
        s = pdf[r.column].dropna().astype(float)
        want = [len(s), s.mean(), s.median(), s.std(ddof=0), s.min(), s.max(), s.quantile(0.25), s.quantile(0.75), s.skew()]
        got = [r["count"], r.mean, r.median, r.std, r.min, r.max, r.q1, r.q3, r.skew]
        assert np.allclose(got, want, atol=2e-6), r.column


def test_correlations_use_complete_pairs_and_skip_constants(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(rng.normal()) + 1e6, None if i % 3 else float(i), 4.0 if i % 2 else None, float(i % 4)) for i in range(300)]
    ds = Dataset(spark.createDataFrame(rows, "k long, a double, b double, c double, d double"), order_by=["k"])
    pdf = ds.source.toPandas().corr()
    for r in stats.pair_correlations(ds).collect():
        want = pdf.loc[r.column_a, r.column_b]
        assert (r.correlation is None) == bool(np.isnan(want))
        assert r.correlation is None or math.isclose(r.correlation, want, abs_tol=1e-9)


def test_histogram_matches_numpy(spark):
    values = [float(v) for v in list(range(1, 101)) + [100] * 7]
    ds = Dataset(spark.createDataFrame([(v, 0.5 * (i % 3)) for i, v in enumerate(values)], "v double, w double"))
    for name, data in (("v", values), ("w", [0.5 * (i % 3) for i in range(len(values))])):
        counts, edges = np.histogram(data, bins=10)
        got = charts.histograms(ds).where(f"column = '{name}'").orderBy("bin").collect()
        assert [r["count"] for r in got] == list(counts) and np.allclose([r.start for r in got], edges[:-1])


def test_constant_column_histogram(spark):
    got = charts.histograms(Dataset(spark.createDataFrame([(3.0,)] * 20, "c double"))).collect()
    assert len(got) == 4 and sum(r["count"] for r in got) == 20 and min(r.start for r in got) == 2.5


@pytest.mark.parametrize("n", [20, 21])
def test_drift_splits_at_the_midpoint(spark, n):
    rows = [(i, 1.0 if i < n // 2 else 5.0 + i % 2, float(i % 3), "a" if i < n // 2 else "b") for i in range(n)]
    ds = Dataset(spark.createDataFrame(rows, "seq long, m double, z double, g string").repartition(4), order_by=["seq"])
    m = drift.numeric_drift(ds).where("column = 'm'").first()
    later = [r[1] for r in rows[n // 2:]]
    assert m.baseline_value == 1.0 and math.isclose(m.recent_value, round(sum(later) / len(later), 6))
    g = drift.categorical_drift(ds).first()
    assert (g.baseline_top, g.recent_top, g.baseline_share, g.recent_share) == ("a", "b", 1.0, 1.0)


def test_labels_count_missing_and_restore_long_texts(spark):
    long = "word " * 60
    ds = Dataset(spark.createDataFrame([(long,)] * 4 + [(None,)] * 3 + [("x",)] * 2, "t string"))
    top = stats.categorical_summary(ds).first()
    assert [(v.value, v["count"]) for v in top.top_values] == [(long, 4), ("<missing>", 3), ("x", 2)] and top.unique_count == 3


def test_insights_read_well(flawed):
    lines = [r.text for r in insights.insights(flawed).where("kind = 'finding'").orderBy("position").collect()]
    assert lines[0].startswith("flawed contains 203 rows across 9 columns")
    assert any("3 duplicate rows" in t for t in lines) and any("Strong correlation detected between" in t for t in lines)
    assert {r.capability: r.available for r in insights.capability_gates(flawed).collect()} == {"unsupervised": True, "supervised": True}


def test_rows_of_many_columns_travel_as_digests(spark):
    """Wide rows are compared by one digest, as their values are: nulls, minus zero, NaN and texts that run on."""
    from columnary.operators import quality

    names = [f"c{i}" for i in range(8)]
    rows = [
        (1, 0.0, "a", "bc", None, True, "x" * 300, "k"), (1, -0.0, "a", "bc", None, True, "x" * 300, "k"),
        (1, 0.0, "ab", "c", None, True, "x" * 300, "k"), (1, 0.0, "a", None, "bc", True, "x" * 300, "k"),
        (1, None, "a", "bc", None, True, "x" * 300, "k"), (1, float("nan"), "a", "bc", None, True, "x" * 300, "k"),
        (1, 0.0, "a", "bc", "", True, "x" * 300, "k"), (1, 0.0, "a", "bc", None, True, "x" * 299, "k"),
    ]
    ds = Dataset(spark.createDataFrame(rows, "c0 long, c1 double, c2 string, c3 string, c4 string, c5 boolean, c6 string, c7 string"), "wide", ["c0"])
    assert quality.row_counts(ds) == (8, 6)
    assert quality.row_counts(Dataset(ds.source.select(*names[:7]), "narrow", ["c0"])) == (8, 6)
    assert quality.row_keys(ds)[0]._jc.toString().startswith("unhex(sha2(") and len(quality.row_keys(ds)) == 1


def test_numbers_are_not_searched_for_addresses(spark):
    """Numbers and times hold no address and no link: those patterns are not tried on them, with the same facts."""
    from columnary.operators import tally

    ds = Dataset(spark.sql("SELECT id, id * 1.5D AS x, timestamp_ntz'2024-01-01 00:00:00' AS t, concat('a', id, '@mail.org') AS m FROM range(30)"), "facts", ["id"])
    number = [f for f in ds.fields if f.lane == "long"]
    plan = tally._measured("long", tally.tally(ds, number), number)._jdf.queryExecution().optimizedPlan().toString()
    assert "(?i)" not in plan
    facts = {r["name"]: r for r in tally.column_facts(ds).collect()}
    assert [facts[n].email_n for n in ("id", "x", "t", "m")] == [0, 0, 0, 30] and [facts[n].filled_n for n in ("id", "x", "t", "m")] == [30] * 4


def test_wide_tables_take_several_compiled_passes(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    from columnary.operators import stats
    from columnary.session import COMPILED_METHOD, compiled_methods

    limit = "spark.sql.codegen.hugeMethodLimit"
    rng = np.random.default_rng(4)
    values = rng.normal(size=(400, 21)) * np.arange(1, 22)
    values[:, 5] = 7.0
    rows = [(i, *[None if (i + j) % 9 == 0 else float(v) for j, v in enumerate(r)]) for i, r in enumerate(values)]
    names = [f"v{j}" for j in range(21)]
    ds = Dataset(spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} double" for n in names)), order_by=["id"])
    passes, multiplied, agg = [], [], DataFrame.agg

    def counted(self, *exprs):
        passes.append(len(exprs))
        return agg(self, *exprs)

    with monkeypatch.context() as m:
        m.setattr(DataFrame, "agg", counted)
        found = stats.moments(ds, names)
    assert max(passes) <= 6 * stats.MOMENT_COLUMNS < 6 * len(names)
    for j, n in enumerate(names):
        here = np.array([r[j + 1] for r in rows if r[j + 1] is not None])
        assert found[n]["count"] == len(here) and (found[n]["min"], found[n]["max"]) == (here.min(), here.max())
        assert np.allclose((found[n]["mean"], found[n]["std"]), (here.mean(), here.std()))

    def seen(frame):
        multiplied.append(spark.conf.get(limit))
        return pinned(frame)

    before, pinned = spark.conf.get(limit), stats.pin
    with monkeypatch.context() as m:
        m.setattr(stats, "pin", seen)
        found = stats.pair_correlations(ds, names).collect()
    assert len(found) == 21 * 20 // 2 and multiplied == [str(COMPILED_METHOD)]
    assert spark.conf.get(limit) == before
    try:
        with compiled_methods(spark):
            raise ValueError
    except ValueError:
        assert spark.conf.get(limit) == before
