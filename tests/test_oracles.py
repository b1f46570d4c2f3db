"""Every registered query with an oracle, against DuckDB on the small tables."""

import math

import duckdb
import pytest

from catalog.oracles import ORACLES
from catalog.queries import REGISTRY

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def plain(value):
    return None if isinstance(value, float) and math.isnan(value) else value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_answer(spark, duck, name):
    result = REGISTRY[name](spark, SF_DIR)
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(result.columns) == sorted(names)
    order = sorted(names)
    ours = sorted((tuple(plain(r[c]) for c in order) for r in result.collect()), key=repr)
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in found.fetchall()), key=repr)
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs):
        for c, x, y in zip(order, a, b):
            same = math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-6) if isinstance(x, float) and isinstance(y, (int, float)) else x == y
            assert same, (name, c, a, b)


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(REGISTRY)
