import csv
import io
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from columnary import read_csv
from columnary.operators import samples
from columnary.sources.records import csv_records, follower


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield lambda size: spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    for k, v in before.items():
        spark.conf.set(k, v)


def made(seed, rows, end="\n", most=40):
    rng = random.Random(seed)
    words = ["plain", "say \"so\"", "two\nlines", "a,b", "", "\n", "\"", "ends\n", 'in"side', "x" * most, "é\n\n\"\"ü", ",\",", "end\n\"", "7", "dos\r\nbreak"]
    out = [["k", "note\nof it", "w"]] + [[str(i), " ".join(rng.choices(words, k=rng.randint(1, 4))), rng.choice(words) or "w"] for i in range(rows)]
    text = io.StringIO()
    csv.writer(text, lineterminator=end).writerows(out)
    return out, text.getvalue()


@given(st.lists(st.text(alphabet='a",\n', max_size=6), min_size=1, max_size=5), st.text(alphabet='a",', max_size=5))
def test_states_of_lines_compose(cells, tail):
    text = io.StringIO()
    csv.writer(text, lineterminator="").writerow(cells)
    follow, inside = follower(), False
    for line in text.getvalue().encode().split(b"\n"):
        inside = follow(line, inside)
    assert not inside  # a whole record ends outside quotes
    assert follow(b'"' + tail.encode().replace(b'"', b'""'), False)  # an open quote stays open


def test_states_of_single_lines():
    follow = follower()
    outside = [(b'a,b', False), (b'5" pipe,"x"', False), (b'"x', True), (b'a,"x', True), (b'"a""', True), (b'"a"""', False), (b'"a"b,"c', True), (b'a,"', True), (b'"",""', False)]
    assert [(line, follow(line, False)) for line, _ in outside] == outside
    inside = [(b'a', True), (b'a""', True), (b'a"', False), (b'",b', False), (b'","b', True), (b'"""', False), (b'', True)]
    assert [(line, follow(line, True)) for line, _ in inside] == inside


@pytest.mark.parametrize("size, end", [(37, "\n"), (200, "\r\n"), (1 << 20, "\n")])
def test_records_do_not_depend_on_splits(spark, tmp_path, small_splits, size, end):
    rows, text = made(size, 40, end)
    path = tmp_path / "m.csv"
    path.write_bytes(b"\xef\xbb\xbf" + text.encode())
    small_splits(size)
    ds = read_csv(spark, str(path), order_by=["k"])
    if size < 1000:
        assert ds.source.rdd.getNumPartitions() > 5
    assert ds.names == ["k", "note\nof it", "w"]
    missing = {"", "NA", "n/a"}
    got = {r[0]: tuple(r) for r in ds.source.collect()}
    assert got == {int(k): (int(k), None if n in missing else n, w) for k, n, w in rows[1:]}


def test_a_field_over_many_splits_and_files_in_order(spark, tmp_path, small_splits):
    folder = tmp_path / "many.csv"
    folder.mkdir()
    long = "line of a long note\n" * 15
    (folder / "a.csv").write_text(f'k,t\n\n1,"{long}"\n2,5" pipe\n')
    (folder / "b.csv").write_text(f'k,t\n3,x\n4,"y\n{long}"\n5,"never closed\n6,z\n')
    (folder / "c.csv").write_text("k,t\n7,last")
    (folder / "d.csv").write_text("")
    small_splits(64)
    records = csv_records(spark, str(folder), "UTF-8").orderBy("__arrival").collect()
    assert [r.record.split(",")[0] for r in records] == ["k", "1", "2", "k", "3", "4", "5", "k", "7"]
    assert [r.is_first for r in records] == [True, False, False, True, False, False, False, True, False]
    assert records[1].record == f'1,"{long}"' and records[6].record.startswith('5,"never closed\n6,z')
    ds = read_csv(spark, str(folder))
    assert [r.k for r in samples.preview_rows(ds).orderBy("row_id").collect()] == [1, 2, 3, 4, 5, 7]
    assert ds.source.where("k = 2").first().t == '5" pipe'


def test_other_encodings_and_bare_returns(spark, tmp_path, small_splits):
    small_splits(16)
    windows = tmp_path / "w.csv"
    windows.write_bytes('naïve,y\n"café €\nzwei",1\n"b",2\n'.encode("cp1252"))
    ds = read_csv(spark, str(windows), order_by=["y"])
    assert ds.encoding == "cp1252" and [tuple(r) for r in ds.source.orderBy("y").collect()] == [("café €\nzwei", 1), ("b", 2)]
    mac = tmp_path / "mac.csv"
    mac.write_bytes(b'a,b\r"x\ry",1\rz,2\r')
    assert [tuple(r) for r in read_csv(spark, str(mac)).source.collect()] == [("x\ny", 1), ("z", 2)]  # Spark's reader makes them line feeds
    with pytest.raises(ValueError, match="1 rows have more fields"):
        long = tmp_path / "long.csv"
        long.write_bytes(b'a,b\n1,"2\n"\n3,4,5\n6\n')
        read_csv(spark, str(long))
