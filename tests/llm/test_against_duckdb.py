"""The queries that SQL can state give DuckDB's rows on supplied tables."""

import glob
import os

import duckdb
import pytest

from quire.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the supplied tables are not here")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    got = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in got.description]
    df = QUERIES[name](spark, SF)
    assert sorted(columns) == sorted(df.columns)
    key = lambda r: repr(r)
    mine = sorted([tuple(r[df.columns.index(c)] for c in sorted(columns)) for r in df.collect()], key=key)
    theirs = sorted([tuple(r[columns.index(c)] for c in sorted(columns)) for r in got.fetchall()], key=key)
    assert mine == theirs


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def views():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def test_quality_statistics_are_those_of_sql(spark):
    from quire.llm import oracles

    got = views().execute(oracles.QUALITY)
    columns = [c[0] for c in got.description]
    df = QUERIES["op8_quality_rules"](spark, SF)
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(got.fetchall())
    assert df.where("base_failed and kept").count() == 0


def test_shards_hold_every_row_once(spark):
    from collections import Counter

    from quire.llm import oracles

    rows = QUERIES["op3_sharding"](spark, SF).collect()
    want = Counter()
    for doc, size, n in views().execute(oracles.SHARDS).fetchall():
        want[doc, size] += n
    assert Counter((r["doc_id"], r["size"]) for r in rows) == want
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) == set(range(40)) and max(counts.values()) - min(counts.values()) <= 1
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
