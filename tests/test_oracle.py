"""Every query with SQL gives what DuckDB gives on the same tables."""

import math
import os

import duckdb
import pytest

from emberlog.plans.queries import QUERIES, SQL

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events pages".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, db, name):
    df = QUERIES[name](spark, DATA)
    want = db.sql(SQL[name])
    columns = sorted(want.columns)
    assert sorted(df.columns) == columns
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    rows = sorted((tuple(plain(dict(zip(want.columns, r))[c]) for c in columns) for r in want.fetchall()), key=repr)
    assert got == rows


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_sources_of_any_user(spark, tmp_path):
    """Users that fill more than two bytes, or share the 24 bits of an address, and none."""
    users = [0, 255, 65535, 65536, 65536, 89999, 2**24 - 1, 2**24, 2**24 + 255, -1, -256, -257, 2**63 - 1, -(2**63), None, None]
    rows = ", ".join(f"({k}, {'NULL' if u is None else f'{u}::HUGEINT'})" for k, u in enumerate(users))
    con = duckdb.connect()
    con.sql(f"CREATE TABLE events AS SELECT k::BIGINT AS event_id, TIMESTAMP '2024-01-01' AS ts, u::BIGINT AS user_id, 'view' AS event_type, 1.0::DOUBLE AS value, '{{}}' AS props FROM (VALUES {rows}) t(k, u)")
    con.sql(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = sorted((tuple(r) for r in QUERIES["facet_by_source"](spark, str(tmp_path)).select("src", "count").collect()), key=repr)
    assert got == sorted(con.sql(SQL["facet_by_source"]).fetchall(), key=repr)
    assert len(got) == 14 and ("10.0.256.0", 2) in got and ("10.0.65536.255", 1) in got and (None, 2) in got


def test_facet_by_address(spark):
    """The operator counts addresses as they are, and those without one."""
    from pyspark.sql import functions as F

    from emberlog.functions.net import ipv4_text
    from emberlog.operators.aggregates import facet_by
    from emberlog.sources.services import events_as_entries

    events = spark.createDataFrame([(k, u) for k, u in enumerate([1, 65536, 65536, 2**24 + 1, None])], "event_id long, user_id long")
    events = events.select("*", F.lit("2024-01-01").cast("timestamp").alias("ts"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    got = facet_by(events_as_entries(events), "src").select(ipv4_text(F.col("src")).alias("src"), "count").collect()
    assert {r["src"]: r["count"] for r in got} == {"10.0.0.1": 2, "10.1.0.0": 2, None: 1}
