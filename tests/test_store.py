import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from spanloom.functions import tags
from spanloom.sources.catalog import Catalog, NotAQuery
from spanloom.sources.records import SPANS
from spanloom.operators.compaction import Compactor
from spanloom.sources.store import File, Store, directory, merged_name, new_id, own_id, split_live, stable_id, superseded
from tests.spans import at, frame, names, span


def test_names():
    assert superseded("a.parquet") == [] and superseded("c_a_b.parquet") == ["a", "b"] and own_id("c_a_b.parquet") == "c"
    merged = merged_name(["f1.parquet", "f2_x_y.parquet"])
    assert merged.endswith("_f1_f2.parquet")
    assert new_id(1) < new_id(2) and len(new_id()) == 32 and stable_id(5, "q", 1) == stable_id(5, "q", 1) != stable_id(5, "q", 2)
    assert len(merged_name([new_id() + ".parquet"] * 6)) == 238 <= 255


def test_live_and_stale():
    live, stale = split_live([File(f"/x/{n}.parquet", 1) for n in ("f1", "f2", "g1_f1_f2", "f3")])
    assert [f.name for f in live] == ["g1_f1_f2.parquet", "f3.parquet"] and [f.name for f in stale] == ["f1.parquet", "f2.parquet"]


def test_written_files(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = frame(spark, span("b2", "bbb"), span("a1", "aaa"), span("b1", "bbb"), span("m1", "mmm", at(18)))
    made = store.write(SPANS, rows)
    assert len(made) == 2 and store.partitions(SPANS) == ["2026-08-18T00:00:00Z", "2026-08-17T00:00:00Z"]
    first = next(f for f in made if "08-17" in f)
    one = pq.ParquetFile(first.removeprefix("file:"))
    assert one.metadata.row_group(0).column(0).compression == "ZSTD"
    assert [x.rstrip(b"\0") for x in one.read(["span_id"])["span_id"].to_pylist()] == [b"a1", b"b1", b"b2"]
    assert not store.files.list(f"{store.table_path(SPANS)}/_tmp")


def test_row_groups_and_retry(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    many = spark.range(25_000).select(*[F.lit(v).alias(k) for k, v in span().items() if k not in ("span_id", "tags", "parent_span_id", "ended_at", "status_message")], F.lpad(F.col("id").cast("string"), 8, "0").cast("binary").alias("span_id"), F.create_map().cast("map<string,string>").alias("tags"), F.lit(None).cast("binary").alias("parent_span_id"), F.lit(None).cast("timestamp").alias("ended_at"), F.lit(None).cast("string").alias("status_message"))
    name = lambda value, i: stable_id(0, value, i) + ".parquet"
    for _ in range(2):  # the same names replace what a first attempt wrote
        made = store.write(SPANS, many, name)
    assert len(store.live_files(SPANS)) == 1 and store.read(SPANS).count() == 25_000
    groups = pq.ParquetFile(made[0].removeprefix("file:")).metadata
    assert max(groups.row_group(i).num_rows for i in range(groups.num_row_groups)) <= 10_000
    assert 1 < len(store.write(SPANS, many, files_per_partition=3)) <= 3


def test_tags_by_sql(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    catalog.store.write(SPANS, frame(spark, span("s1", tags={"env": "prod", "blank": "", "production": None})))
    row = catalog.sql("select tags['env'] e, tags['blank'] b, tags['production'] p, tags['none'] n, map_contains_key(tags, 'production') hp, map_contains_key(tags, 'none') hn from spans").first()
    assert tuple(row) == ("prod", "", None, None, True, False)
    t = catalog.table().select(tags.value("tags", "env"), tags.bare("tags", "production"), tags.bare("tags", "none"), tags.equals("tags", "env", "dev"), tags.hex_id("span_id")).first()
    assert tuple(t) == ("prod", True, False, False, "7331000000000000")


def test_newest_wins_and_partitions_prune(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    catalog.store.write(SPANS, frame(spark, span("s1", received=at(17, 9))))
    catalog.store.write(SPANS, frame(spark, span("s1", received=at(17, 10), ended_at=at(17, 10)), span("m", received=at(18))))
    assert sorted(names(catalog.sql("select span_id from spans"))) == ["m", "s1", "s1"]
    assert catalog.sql("select ended_at from spans_merged where trace_id is not null and partition = '2026-08-17T00:00:00Z'").first()[0] is not None
    assert names(catalog.sql("select span_id from spans where partition = '2026-08-18T00:00:00Z'")) == ["m"]
    for view in ("spans", "spans_merged"):
        found = catalog.sql(f"select span_id from {view} where received_at >= timestamp'2026-08-18T00:00:00Z'")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "partition#" in plan.split("PartitionFilters")[1].split("]")[0] and names(found) == ["m"]


def test_pruning_keeps_to_its_relation(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    catalog.store.write(SPANS, frame(spark, *[span(f"d{d}", received=at(d)) for d in range(10, 20)]))
    joined = catalog.sql("select a.span_id from spans a join spans b on a.trace_id = b.trace_id where a.received_at < timestamp'2026-08-11T00:00:00Z' and b.received_at >= timestamp'2026-08-19T00:00:00Z'")
    assert names(joined) == ["d10"]
    ranked = catalog.sql("select span_id from (select *, row_number() over (order by received_at) r from spans) where received_at > timestamp'2026-08-18T12:00:00Z' and r = 10")
    assert names(ranked) == ["d19"]
    limited = catalog.sql("select count(*) c from (select * from spans order by received_at limit 3) where received_at >= '2026-08-12'")
    assert limited.first()[0] == 1
    for op in ("<", "<=", ">", ">=", "="):
        for bound in ("2026-08-14T00:00:00Z", "2026-08-14T09:00:00Z", "2026-08-14T09:00:01Z"):
            for text in (f"received_at {op} timestamp'{bound}'", f"timestamp'{bound}' {op} received_at"):
                pruned = catalog.sql(f"select span_id from spans where {text} or false").count()
                assert catalog.sql(f"select span_id from spans where {text}").count() == pruned == catalog.spark.sql(f"select span_id from spans where {text}").count()
    assert catalog.sql("select count(*) from spans where received_at >= now() - interval 1 hour").first()[0] == 0


def test_only_days_that_can_matter_are_listed(spark, tmp_path, monkeypatch):
    catalog = Catalog(spark, str(tmp_path))
    catalog.store.write(SPANS, frame(spark, *[span(f"d{d}", received=at(d)) for d in range(10, 20)]))
    listed, of = [], catalog.store.all_files
    monkeypatch.setattr(catalog.store, "all_files", lambda spec, value: listed.append(value[8:10]) or of(spec, value))
    for text, days, found in (
        ("select span_id from spans where received_at >= timestamp'2026-08-18T00:00:00Z'", {"18", "19"}, 2),
        ("select span_id from spans_merged where timestamp'2026-08-11T12:00:00Z' > received_at", {"10", "11"}, 2),
        ("select span_id from spans where partition in ('2026-08-12T00:00:00Z', '2026-08-14T00:00:00Z')", {"12", "14"}, 2),
        ("select a.span_id from spans a join spans_merged b on a.trace_id = b.trace_id where a.partition = '2026-08-12T00:00:00Z' and b.partition > '2026-08-18T00:00:00Z'", {"12", "19"}, 1),
        ("select span_id from spans where partition = '2026-08-12T00:00:00Z' and trace_id = (select max(trace_id) from spans)", set(map(str, range(10, 20))), 1),
        ("select span_id from (select * from spans order by received_at limit 3) where partition >= '2026-08-12T00:00:00Z'", set(map(str, range(10, 20))), 1),
        ("select 1 as span_id", set(), 1),
    ):
        listed.clear()
        assert catalog.sql(text).count() == found and set(listed) == days and len(listed) == len(days), text


def test_nothing_else_is_reachable(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    catalog.store.write(SPANS, frame(spark, span("s1", tags={"a": "b"})))
    path = catalog.store.live_files(SPANS)[0].path
    spark.range(3).write.mode("overwrite").saveAsTable("secret")
    for text in (
        "select java_method('java.lang.System', 'getProperty', 'user.dir')", "select 1 where reflect('java.lang.System', 'getProperty', 'user.dir') is not null",
        "select try_reflect('a', 'b')", "select (select java_method('java.lang.System', 'getProperty', 'user.dir'))", "with x as (select java_method('a', 'b')) select * from x",
        f"select * from parquet.`{path}`", "select * from text.`/etc/hosts`", "select count(*) from spans where exists (select 1 from text.`/etc/hosts`)", "select * from secret", "select * from default.secret",
        "select transform(span_id) using 'cat' as (x) from spans", "select transform(tags, x -> java_method('a', 'b')) from spans", "select input_file_name() from spans", "explain select * from secret",
        "select * from spans lateral view nothing(tags) t as k", "from spans |> select java_method('a', 'b')",
    ):
        with pytest.raises((NotAQuery, Exception)) as e:
            catalog.select(text).collect()
        assert isinstance(e.value, NotAQuery) or "PARSE" in str(e.value), (text, e.value)
    for text in (
        "select k, v from spans lateral view explode(tags) t as k, v", "with x as (select * from spans) select count(*) c from x join spans_merged using (span_id)", "select count(*) from range(5)",
        "select name, row_number() over (partition by service order by started_at) r from spans order by r limit 5", "values (1), (2)", "select * from (select 1 a) union all select 2 except select 3",
        "with recursive t(i) as (select 1 union all select i + 1 from t where i < 4) select max(i) from t", "select service, count(*) filter (where status = 'error') from spans group by rollup (service)",
    ):
        assert catalog.select(text).count() >= 0
    spark.sql("drop table secret")


def test_a_dead_compactors_lock_is_taken_over(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for i in range(2):
        store.write(SPANS, frame(spark, span(f"a{i}"), span(f"b{i}", received=at(18))))
    lock = f"{store.table_path(SPANS)}/_locks/{directory('2026-08-17T00:00:00Z')}"
    assert store.files.create_once(lock, b"someone")
    assert Compactor(store, SPANS).partition("2026-08-17T00:00:00Z", True) == 0 and store.files.read(lock) == b"someone"
    assert Compactor(store, SPANS, stale_seconds=-1).partition("2026-08-17T00:00:00Z", True) == 1 and not store.files.exists(lock)


def test_a_rename_replaces(spark, tmp_path):
    files = Store(spark, str(tmp_path)).files
    for text in (b"one", b"two"):
        files.write(f"{tmp_path}/a", text)
        files.rename(f"{tmp_path}/a", f"{tmp_path}/x/b")
    assert files.read(f"{tmp_path}/x/b") == b"two" and not files.exists(f"{tmp_path}/a")


def test_scope_and_outside_text(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    assert catalog.sql("select * from spans_merged").count() == 0  # no file yet
    catalog.store.write(SPANS, frame(spark, span("s1"), span("s2", organization_id="other")))
    assert names(catalog.sql("select span_id from spans", organization_id="other")) == ["s2"]
    assert catalog.select("with x as (select 1 a) select a from x").first()[0] == 1
    assert "Scan parquet" in catalog.select("explain select * from spans").first()[0]
    for text in ("drop view spans", "set a=b", "insert into spans select * from spans", "create table x as select 1", "with a as (select 1) insert into spans select * from a"):
        with pytest.raises(NotAQuery):
            catalog.select(text)
    with pytest.raises(Exception, match="PARSE|parse"):
        catalog.select("select 1; drop view spans")
