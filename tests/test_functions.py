import datetime as dt

from pyspark.sql import functions as F

from columnary.functions import day_ordinal, double_text, name_tokens, normalized_text, parse_number, parse_timestamp, rounded, text_key, text_key_length


def column_of(spark, values, kind, expr):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_double_text_prints_like_python(spark):
    values = [0.0, 1.0, 23.5, 112946.26, 1e7, 123456789.25, 9.9e15, 1e16, 1.5e-5, 0.0001, 0.00025, 1e22, -2.5e-7, float("inf"), float("-inf")]
    assert column_of(spark, values, "double", double_text) == [repr(v) for v in values]


def test_numbers_need_a_whole_match(spark):
    texts = ["12", " 1.5 ", "-3e2", ".5", "5.", "12d", "1,000", "abc", "", "inf", "1e", "0x1A"]
    assert column_of(spark, texts, "string", parse_number) == [12.0, 1.5, -300.0, 0.5, 5.0, None, None, None, None, float("inf"), None, None]


def test_timestamp_ladder(spark):
    texts = ["2024-01-02", "2024/1/2", "01/02/2024", "1-2-2024", "20240102", "2024", "1/2/24", "2 Jan 2024", "Jan 2, 2024", "2024-01-02T03:04:05", "12:30", "hello", "2024-13-45"]
    day = dt.datetime(2024, 1, 2)
    want = [day] * 5 + [dt.datetime(2024, 1, 1)] + [day] * 3 + [dt.datetime(2024, 1, 2, 3, 4, 5), None, None, None]
    assert column_of(spark, texts, "string", parse_timestamp) == want


def test_header_words(spark):
    found = column_of(spark, ["customerId", "order_total-price", "  ", "HTTPCode2x", "a.b"], "string", name_tokens)
    assert found == [["customer", "id"], ["order", "total", "price"], [], ["httpcode2x"], ["a", "b"]]


def test_rounding_follows_the_binary_value(spark):
    values = [9 / 60000, 0.12345, 2.675, -0.5, 1e300, 0.5]
    assert column_of(spark, values, "double", lambda v: rounded(v, 4))[:2] == [0.0001, 0.1235]
    assert column_of(spark, [1e300, -1.25], "double", lambda v: rounded(v, 2)) == [1e300, -1.25]


def test_day_ordinal(spark):
    values = [dt.date(2000, 4, 4), dt.date(1, 1, 1), dt.date(1969, 12, 31)]
    assert column_of(spark, values, "date", day_ordinal) == [float(v.toordinal()) for v in values]


def test_normalized_text(spark):
    assert column_of(spark, ["  Very   LOW "], "string", normalized_text) == ["very low"]


def test_text_keys_are_bounded_and_distinct(spark):
    texts = ["short", "x" * 128, "x" * 129, "x" * 128 + "y", "x" * 5000]
    keys = column_of(spark, texts, "string", text_key)
    assert keys[:2] == texts[:2] and len(set(keys)) == 5 and max(len(k) for k in keys) < 150
    assert column_of(spark, texts, "string", lambda v: text_key_length(text_key(v))) == [len(t) for t in texts]
