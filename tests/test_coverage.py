import os

import duckdb
import pytest

import __spark_entry__
from spanloom.operators.asof import asof_join, range_join
from spanloom.plans import coverage

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


#: Columns that are null on purpose.
NULL = {"scalar_map": {"missing"}, "scalar_json": {"none"}}


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    return "~" if v is None else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in coverage.TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(coverage.QUERIES))
def test_agrees_with_its_twin(spark, duck, name):
    df = coverage.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = duck.execute(coverage.SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(norm(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert got == want and got, "a twin that compares nothing shows nothing"
    assert {c for i, c in enumerate(columns) if all(r[i] == "~" for r in got)} <= NULL.get(name, set())


def test_contract(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_intervals_of_any_length_and_nulls(spark):
    rows = spark.createDataFrame([(1, 0, 35), (2, 10, 10), (3, 20, 5), (4, None, 9), (5, 3, None)], "i long, a long, b long").selectExpr("i", "timestamp_seconds(a) low", "timestamp_seconds(b) high")
    points = spark.createDataFrame([(x,) for x in (0, 5, 10, 15, 25, 35, 36, None)], "x long").selectExpr("x", "timestamp_seconds(x) at")
    found = sorted((r.i, r.x) for r in range_join(rows, points, "low", "high", "at", 10).collect())
    assert found == [(1, x) for x in (0, 5, 10, 15, 25, 35)] + [(2, 10)]


def test_asof_ties_nulls_and_stretches(spark):
    left = spark.createDataFrame([("k", 5, 1), ("k", 50, 2), ("k", 1, 3), ("k", None, 4), (None, 9, 5), ("z", 9, 6), ("k", 500, 7)], "k string, t long, n long").selectExpr("k", "timestamp_seconds(t) at", "n")
    right = spark.createDataFrame([("k", 2, "a"), ("k", 5, "b"), ("k", 5, "c"), ("k", None, "d"), (None, 3, "e"), ("k", 49, "f")], "k string, t long, v string").selectExpr("k", "timestamp_seconds(t) at", "v")
    for stretch in (1, 7, 1000):
        found = {r.n: r.v for r in asof_join(left, right, ["k"], "at", stretch).collect()}
        assert found == {1: "c", 2: "f", 3: None, 4: None, 5: None, 6: None, 7: "f"}


def test_range_join_is_no_cross_product(spark):
    plan = coverage.QUERIES["join_range"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize(("name", "of"), [("projection", "orders"), ("scalar_math", "lineitem"), ("casts", "orders"), ("join_full", "customer")])
def test_whole_tables(spark, name, of):
    larger = "/root/testdata/sf0.01"
    rows = coverage.QUERIES[name](spark, larger)
    assert (rows.where("a is not null") if name == "join_full" else rows).count() == coverage.table(spark, larger, of).count()


def test_the_stream_drops_late_rows_and_only_those(spark, duck):
    taken = coverage.QUERIES["stream_late_rows"](spark, SF).agg({"n": "sum"}).first()[0]
    closed, on_time = duck.execute(
        f"""select count(*), count(*) filter (where not ({coverage.LATE})) from events
        where time_bucket(interval 1 hour, ts) + interval 1 hour <= (select max(ts) from events) - interval {coverage.ALLOWED}"""
    ).fetchone()
    assert on_time <= taken < closed


@pytest.mark.parametrize("files", [1, 5])
@pytest.mark.parametrize("turned", [False, True])
def test_equal_balances_take_the_first_customer(spark, tmp_path, files, turned):
    nan = float("nan")
    odd = [("a", None, 9.0), ("a", "x", None), ("b", "p", nan), ("b", "q", 3.0), ("c", "r", -0.0), ("c", "s", 0.0), ("d", "t", None), (None, "u", 2.0)]
    rows = [(i, f"n{i}", float(i % 7), "abc"[i % 3]) for i in range(210)] + [(210 + i, name, x, of) for i, (of, name, x) in enumerate(odd)]
    given = spark.createDataFrame(rows, "c_custkey long, c_name string, c_acctbal double, c_mktsegment string").repartitionByRange(files, "c_custkey")
    given.sortWithinPartitions("c_custkey", ascending=not turned).write.parquet(f"{tmp_path}/customer.parquet")
    got = {r.c_mktsegment: (norm(r.med), r.top, r.low) for r in coverage.QUERIES["median_mode"](spark, str(tmp_path)).collect()}
    con = duckdb.connect(config={"threads": 1})  # with more the twin's choice among equals varies
    con.execute(f"create table customer as select * from read_parquet('{tmp_path}/customer.parquet/*.parquet') order by c_custkey")
    want = {of: (norm(med), top, low) for of, med, top, low in con.execute(coverage.SQL["median_mode"]).fetchall()}
    assert got == want and len(got) == 5
