import datetime as dt

import pytest

from columnary import Dataset
from columnary.operators import profile, quality, stats


def kinds(ds):
    return {r["name"]: r for r in profile.column_profile(ds).collect()}


def test_types_semantics_and_roles(spark):
    rows = []
    for i in range(60):
        rows.append((f"C{i}", "yes" if i % 2 else "no", float(i % 2), f"2024-01-{i % 28 + 1:02d}", f"{i % 12 + 1}/15/2024", 2000 + i % 20, i * 1.25,
                     f"a long note about row number {i} that keeps going", ["Paris", "Rome"][i % 2], None, ["low", "medium", "high"][i % 3],
                     f"u{i}@mail.example.org", 48.0 + i / 100, 0.01 * i, i % 7, dt.datetime(2024, 1, 1 + i % 28)))
    schema = ("customer_id string, is_active string, flag double, signup_date string, slash string, year long, amount double, notes string, city string, "
              "empty string, level string, contact string, lat double, rate double, visits long, seen timestamp_ntz")
    p = kinds(Dataset(spark.createDataFrame(rows, schema), order_by=["customer_id"]))
    expected = {
        "customer_id": ("categorical", "identifier", "identifier"), "is_active": ("boolean", "binary_flag", "boolean"),
        "flag": ("boolean", "binary_flag", "boolean"), "signup_date": ("datetime", "phone", "identifier"), "slash": ("datetime", "datetime", "datetime"),
        "year": ("datetime", "event_timestamp", "datetime"), "amount": ("numeric", "currency", "identifier"), "notes": ("text", "free_text", "identifier"),
        "city": ("categorical", "location_label", "target-candidate"), "empty": ("unknown", "unknown", "unknown"), "level": ("categorical", "ordinal_category", "target-candidate"),
        "contact": ("categorical", "email", "identifier"), "lat": ("numeric", "latitude", "identifier"), "rate": ("numeric", "percentage", "identifier"),
        "visits": ("numeric", "count", "target-candidate"), "seen": ("datetime", "phone", "identifier"),
    }
    assert {n: (r.inferred_type, r.semantic_type, r.likely_role) for n, r in p.items()} == expected


@pytest.mark.parametrize("share,kind", [(94, "categorical"), (95, "boolean"), (96, "boolean")])
def test_boolean_share_boundary(spark, share, kind):
    rows = [("yes" if i < share else f"other {i}",) for i in range(100)]
    assert kinds(Dataset(spark.createDataFrame(rows, "b string")))["b"].inferred_type == kind


@pytest.mark.parametrize("share,kind", [(89, "categorical"), (90, "numeric")])
def test_numeric_share_boundary(spark, share, kind):
    rows = [(str(i * 3) if i < share else "bad",) for i in range(100)]
    assert kinds(Dataset(spark.createDataFrame(rows, "n string")))["n"].inferred_type == kind


@pytest.mark.parametrize("share,kind", [(89, "categorical"), (90, "datetime")])
def test_date_share_boundary(spark, share, kind):
    rows = [(i, f"2024/02/{i % 28 + 1:02d}" if i < share else "soon") for i in range(100)]
    assert kinds(Dataset(spark.createDataFrame(rows, "k long, d string"), order_by=["k"]))["d"].inferred_type == kind


@pytest.mark.parametrize("length,kind", [(32, "categorical"), (33, "text")])
def test_text_length_boundary(spark, length, kind):
    rows = [(f"{i:03d}" + "x" * (length - 3),) for i in range(100)]
    assert kinds(Dataset(spark.createDataFrame(rows, "t string")))["t"].inferred_type == kind


def test_two_equal_numbers_in_three_spellings_are_boolean(spark):
    rows = [(["0.0", "1.0", "1.00"][i % 3],) for i in range(30)]
    assert kinds(Dataset(spark.createDataFrame(rows, "n string")))["n"].inferred_type == "boolean"


def test_strict_rules_leave_numbers_and_dates_alone(spark):
    rows = [(f"{100000 + i}.25", f"1998-10-{i % 28 + 1:02d}", f"https://a.example/{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "amount_text string, day_text string, ref string")
    loose = kinds(Dataset(df))
    strict = kinds(Dataset(df, semantic_rules="strict"))
    assert loose["amount_text"].semantic_type == "phone" and strict["amount_text"].semantic_type == "currency"
    assert strict["day_text"].semantic_type == "event_timestamp"
    assert loose["ref"].semantic_type != "url" and strict["ref"].semantic_type == "url"


def test_samples_step_over_missing_values(spark):
    rows = [(i, None if i < 500 else i) for i in range(520)]
    ds = Dataset(spark.createDataFrame(rows, "k long, sparse long"), order_by=["k"])
    assert kinds(ds)["sparse"].sample_values == ["500", "501", "502", "503", "504"]


def test_empty_one_row_and_odd_values(spark):
    schema = "id long, x double, s string, f boolean, a array<int>"
    empty = Dataset(spark.createDataFrame([], schema))
    assert {r.inferred_type for r in profile.column_profile(empty).collect()} == {"unknown"}
    assert quality.quality_score(empty).first().quality_score == 84.0  # every column constant, capped at 16 points
    one = Dataset(spark.createDataFrame([(1, 2.5, "a", True, [1])], schema))
    assert stats.numeric_summary(one).where("column = 'x'").first().skew is None
    assert one.unsupported_columns().first()["name"] == "a"


def test_nan_is_missing_and_infinity_is_not_boolean(spark):
    rows = [(float("nan"),), (float("inf"),), (1.0,), (0.0,)]
    ds = Dataset(spark.createDataFrame(rows, "x double"))
    p = kinds(ds)["x"]
    assert (p.missing_count, p.unique_count, p.inferred_type) == (1, 3, "numeric")


def test_names_with_dots_spaces_and_backticks(spark):
    df = spark.createDataFrame([(3.5, "a", 2)], "x double, y string, z int").toDF("a.b", "c d", "e`f")
    ds = Dataset(df)
    assert set(kinds(ds)) == {"a.b", "c d", "e`f"}
    assert stats.numeric_summary(ds).count() == 2
    assert quality.duplicate_row_count(ds) == 0


def test_type_counts_keep_zeros(spark):
    ds = Dataset(spark.createDataFrame([(1, "a")], "n long, s string"))
    counts = {r.inferred_type: r.column_count for r in profile.type_counts(ds).collect()}
    assert set(counts) == {"numeric", "categorical", "boolean", "datetime", "text", "unknown"} and sum(counts.values()) == 2


def test_large_integers_stay_distinct(spark):
    rows = [(2**53 + i,) for i in range(4)]
    assert kinds(Dataset(spark.createDataFrame(rows, "n long")))["n"].unique_count == 4
