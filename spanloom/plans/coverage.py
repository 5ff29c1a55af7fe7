"""Queries over the driver's tables, each with its DuckDB twin.

``events`` stands for spans: the user is the trace, values under ten are roots. The first group runs the engine's own
operators over it; the rest covers the SQL surface that the endpoint passes on.

Twins agree to the bit: sums of prices are exact decimals, averages are rounded, every limit has a total order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions import tags
from spanloom.operators import traces as tr
from spanloom.operators.asof import asof_join, range_join
from spanloom.operators.compaction import Compactor
from spanloom.operators.merge import newest
from spanloom.plans.pruning import between_received
from spanloom.sources.catalog import Catalog
from spanloom.sources.records import RecordSpec, partition_column

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_as_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` in the shape of spans, with the partition derived from its time."""
    at = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")))
    return table(spark, sf_dir, "events").select(
        F.lit("1").alias("organization_id"),
        F.lit("1").alias("project_id"),
        at.alias("received_at"),
        "event_id",
        F.col("user_id").alias("trace_id"),
        F.when(F.col("value") >= 10, F.col("event_id")).alias("parent_span_id"),
        F.concat(F.lit("svc-"), F.col("event_type")).alias("service"),
        F.col("event_type").alias("name"),
        at.alias("started_at"),
        F.timestamp_micros(F.unix_micros(at) + F.floor(F.col("value") * 1000).cast("long")).alias("ended_at"),
        "value",
        F.from_json("props", "map<string,string>").alias("tags"),
        partition_column(at).alias("partition"),
    )


#: The same mapping for DuckDB.
SPANS_SQL = """spans AS (
  SELECT ts AS received_at, event_id, user_id AS trace_id, CASE WHEN value >= 10 THEN event_id END AS parent_span_id,
         'svc-' || event_type AS service, event_type AS name, ts AS started_at,
         ts + to_microseconds(CAST(floor(value * 1000) AS BIGINT)) AS ended_at, value, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k,
         strftime(date_trunc('day', ts), '%Y-%m-%dT00:00:00Z') AS partition
  FROM events)"""
TRACES_SQL = """traces AS (
  SELECT trace_id, min(service) FILTER (WHERE parent_span_id IS NULL) AS root_service, min(name) FILTER (WHERE parent_span_id IS NULL) AS root_name,
         min(started_at) AS started_at, min(partition) AS first_partition, max(partition) AS last_partition, count(*) AS spans,
         epoch_us(max(ended_at)) / 1e6 - epoch_us(min(started_at)) / 1e6 AS seconds
  FROM spans WHERE received_at >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY trace_id)"""
SINCE = datetime(2024, 1, 10, tzinfo=UTC)


def _micros(name: str):
    return F.unix_micros(name).alias(name)


def query(name: str, twin: str):
    def put(f):
        QUERIES[name], SQL[name] = f, twin
        return f

    return put


def both(name: str, spark_sql: str, duck_sql: str | None = None) -> None:
    """A query in SQL; ``{table}`` stands for a table, which each side puts in its own way."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in spark_sql}
        return spark.sql(spark_sql, **used)

    QUERIES[name] = run
    text = duck_sql or spark_sql
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    SQL[name] = text


# The engine's own operators


@query("partition_layout", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%dT00:00:00Z') AS partition, count(*) AS n FROM events GROUP BY 1")
def partition_layout(spark, sf_dir):
    return events_as_spans(spark, sf_dir).groupBy("partition").agg(F.count("*").alias("n"))


@query(
    "merge_latest",
    f"""WITH {SPANS_SQL} SELECT event_id, trace_id, name, value, partition FROM (
      SELECT *, row_number() OVER (PARTITION BY trace_id, name, partition ORDER BY received_at DESC, event_id DESC) r FROM spans) WHERE r = 1""",
)
def merge_latest(spark, sf_dir):
    rows = events_as_spans(spark, sf_dir)
    spec = RecordSpec("events", [f for f in rows.schema.fields if f.name not in ("organization_id", "project_id", "received_at", "partition")], ("trace_id", "name"), "received_at")
    return newest(rows, spec).select("event_id", "trace_id", "name", "value", "partition")


@query(
    "latency_percentile",
    f"""WITH {SPANS_SQL} SELECT name, count(*) AS n, round(avg(value) * 1000, 4) AS avg_ms, round(quantile_cont(value, 0.95) * 1000, 4) AS p95_ms FROM spans GROUP BY name""",
)
def latency_percentile(spark, sf_dir):
    p95 = F.percentile("value", F.lit(0.95))
    return events_as_spans(spark, sf_dir).groupBy("name").agg(F.count("*").alias("n"), F.round(F.avg("value") * 1000, 4).alias("avg_ms"), F.round(p95 * 1000, 4).alias("p95_ms"))


@query("tag_lookup", f"WITH {SPANS_SQL} SELECT event_id, k, k IS NOT NULL AS has_k, FALSE AS has_x, coalesce(k = '69', FALSE) AS is_69 FROM spans")
def tag_lookup(spark, sf_dir):
    rows = events_as_spans(spark, sf_dir)
    return rows.select("event_id", tags.value("tags", "k").alias("k"), tags.present("tags", "k").alias("has_k"), tags.present("tags", "x").alias("has_x"), tags.equals("tags", "k", "69").alias("is_69"))


def _rolled(spark, sf_dir) -> DataFrame:
    return tr.traces(events_as_spans(spark, sf_dir), since=SINCE)


_TRACE_COLUMNS = "trace_id, root_service, root_name, epoch_us(started_at) AS started_at, first_partition, last_partition, spans, round(seconds, 4) AS seconds"


@query("trace_rollup", f"WITH {SPANS_SQL}, {TRACES_SQL} SELECT {_TRACE_COLUMNS} FROM traces")
def trace_rollup(spark, sf_dir):
    return _rolled(spark, sf_dir).withColumns({"started_at": _micros("started_at"), "seconds": F.round("seconds", 4)})


_OPERATIONS = "root_service, root_name, count(*) AS traces, round(avg(seconds) * 1000, 2) AS avg_ms, round(quantile_cont(seconds, 0.95) * 1000, 2) AS p95_ms, epoch_us(max(started_at)) AS last_seen"


def _operations(rolled: DataFrame, text: str = "") -> DataFrame:
    return tr.operations(rolled, text).withColumns({"avg_ms": F.round("avg_ms", 2), "p95_ms": F.round("p95_ms", 2), "last_seen": _micros("last_seen")})


@query("operation_rollup", f"WITH {SPANS_SQL}, {TRACES_SQL} SELECT {_OPERATIONS} FROM traces GROUP BY root_service, root_name")
def operation_rollup(spark, sf_dir):
    return _operations(_rolled(spark, sf_dir))


@query("search_operations", f"WITH {SPANS_SQL}, {TRACES_SQL} SELECT {_OPERATIONS} FROM traces WHERE root_service = 'svc-click' AND root_name ILIKE '%LIC%' GROUP BY root_service, root_name")
def search_operations(spark, sf_dir):
    return _operations(_rolled(spark, sf_dir), "LIC service:svc-click")


@query("slowest_traces", f"WITH {SPANS_SQL}, {TRACES_SQL} SELECT trace_id, epoch_us(started_at) AS started_at, spans, round(seconds, 4) AS seconds, first_partition, last_partition FROM traces WHERE root_service = 'svc-click' AND root_name = 'click' ORDER BY traces.seconds DESC NULLS LAST, traces.started_at DESC, trace_id LIMIT 50")
def slowest_traces(spark, sf_dir):
    found = tr.traces_of(_rolled(spark, sf_dir), "svc-click", "click")
    return found.withColumns({"started_at": _micros("started_at"), "seconds": F.round("seconds", 4)})


@query("ordered_operations", f"WITH {SPANS_SQL}, {TRACES_SQL}, o AS (SELECT {_OPERATIONS} FROM traces GROUP BY root_service, root_name) SELECT *, row_number() OVER (ORDER BY traces DESC NULLS LAST, last_seen DESC NULLS LAST, root_service NULLS FIRST, root_name NULLS FIRST) AS place FROM o")
def ordered_operations(spark, sf_dir):
    return _operations(_rolled(spark, sf_dir)).withColumn("place", F.row_number().over(Window.orderBy(*tr.table_order("traces"))).cast("long"))


def _spans_with_ids(spark, sf_dir) -> DataFrame:
    wide = lambda c, n: F.unhex(F.lpad(F.hex(c), n, "0"))
    rows = events_as_spans(spark, sf_dir).withColumns({"status": F.lit("ok"), "status_message": F.lit(None).cast("string"), "span_id": wide("event_id", 16)})
    return rows.withColumns({"trace_id": wide("trace_id", 32), "parent_span_id": wide("parent_span_id", 16)})


_ONE_TRACE = "trace_id = 7 AND partition BETWEEN '2024-01-03T00:00:00Z' AND '2024-01-20T00:00:00Z'"


def _one_trace(spark, sf_dir) -> DataFrame:
    return tr.spans_of(_spans_with_ids(spark, sf_dir), f"{7:032x}", "2024-01-03T00:00:00Z", "2024-01-20T00:00:00Z")


@query("spans_of_trace", f"WITH {SPANS_SQL} SELECT lpad(lower(hex(event_id)), 16, '0') AS span_id, service, name, epoch_us(started_at) AS started_at, epoch_us(ended_at) AS ended_at FROM spans WHERE {_ONE_TRACE}")
def spans_of_trace(spark, sf_dir):
    return _one_trace(spark, sf_dir).select(F.lower(F.hex("span_id")).alias("span_id"), "service", "name", _micros("started_at"), _micros("ended_at"))


@query(
    "trace_waterfall",
    f"""WITH {SPANS_SQL}, s AS (SELECT *, epoch_us(started_at) AS a, epoch_us(ended_at) AS z FROM spans WHERE {_ONE_TRACE}),
    e AS (SELECT min(a) AS low, greatest(max(a), max(z)) AS high FROM s)
    SELECT lpad(lower(hex(event_id)), 16, '0') AS span_id, name, CAST(0 AS BIGINT) AS depth, round((a - low) / (high - low), 8) AS at, round((z - a) / (high - low), 8) AS width FROM s, e""",
)
def trace_waterfall(spark, sf_dir):
    rows = tr.waterfall(_one_trace(spark, sf_dir).collect())  # one trace
    out = [(r["span_id"], r["name"], r["depth"], round(r["offset"], 8), round(r["width"], 8)) for r in rows]
    return spark.createDataFrame(out, "span_id string, name string, depth long, at double, width double")


@query("time_pruned_count", "SELECT count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05 12:00:00' AND ts <= TIMESTAMP '2024-01-09 06:00:00'")
def time_pruned_count(spark, sf_dir):
    low, high = datetime(2024, 1, 5, 12, tzinfo=UTC), datetime(2024, 1, 9, 6, tzinfo=UTC)
    return between_received(events_as_spans(spark, sf_dir), low, high).agg(F.count("*").alias("n"))


@query("partition_equality", f"WITH {SPANS_SQL} SELECT event_id, value FROM spans WHERE partition = '2024-01-07T00:00:00Z'")
def partition_equality(spark, sf_dir):
    return events_as_spans(spark, sf_dir).where("partition = '2024-01-07T00:00:00Z'").select("event_id", "value")



# Stored tables: written, pruned, merged and compacted in the shared folder

EVENTS = RecordSpec(
    "events",
    (T.StructField("event_id", T.LongType(), False), T.StructField("user_id", T.LongType(), True), T.StructField("event_type", T.StringType(), True), T.StructField("value", T.DoubleType(), True)),
    ("event_id",),
    "received_at",
)


def shared_path(spark: SparkSession, tag: str) -> str:
    """A path of its own in the folder that driver and executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{found.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def stored_events(spark: SparkSession, sf_dir: str) -> Catalog:
    """All events in a first flush, a third of them again an hour later, with another value, in a second one."""
    catalog = Catalog(spark, shared_path(spark, "store"), [EVENTS])
    at = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")))
    rows = table(catalog.spark, sf_dir, "events").select(F.lit("1").alias("organization_id"), F.lit("1").alias("project_id"), at.alias("received_at"), "event_id", "user_id", "event_type", "value")
    catalog.store.write(EVENTS, rows)
    catalog.store.write(EVENTS, rows.where("event_id % 3 = 0").withColumns({"value": F.col("value") + 1, "received_at": F.expr("received_at + interval 1 hour")}))
    return catalog


STORED_SQL = """stored AS (
  SELECT *, strftime(date_trunc('day', moment), '%Y-%m-%dT00:00:00Z') AS partition FROM (
    SELECT event_id, event_type, value, ts AS moment FROM events UNION ALL SELECT event_id, event_type, value + 1, ts + INTERVAL 1 HOUR FROM events WHERE event_id % 3 = 0)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY event_id, partition ORDER BY moment DESC) AS r FROM stored)"""


@query("stored_rows", f"WITH {STORED_SQL} SELECT event_type, partition, count(*) AS n, round(sum(value), 4) AS total FROM stored WHERE moment >= TIMESTAMP '2024-01-20 12:00:00' GROUP BY 1, 2")
def stored_rows(spark, sf_dir):
    return stored_events(spark, sf_dir).sql("select event_type, partition, count(*) as n, round(sum(value), 4) as total from events where received_at >= timestamp'2024-01-20T12:00:00Z' group by 1, 2")


@query("stored_newest", f"WITH {STORED_SQL} SELECT event_id, value, partition, epoch_us(moment) AS received FROM ranked WHERE r = 1 AND moment < TIMESTAMP '2024-01-09 06:00:00'")
def stored_newest(spark, sf_dir):
    return stored_events(spark, sf_dir).sql("select event_id, value, partition, unix_micros(received_at) as received from events_merged where received_at < timestamp'2024-01-09T06:00:00Z'")


@query("stored_compacted", f"WITH {STORED_SQL} SELECT event_id, value, partition FROM ranked WHERE r = 1 OR partition = (SELECT max(partition) FROM stored)")
def stored_compacted(spark, sf_dir):
    """Closed days hold one file of the newest rows each; the newest day waits for more files."""
    catalog = stored_events(spark, sf_dir)
    Compactor(catalog.store, EVENTS).run(at_once=8)
    return catalog.sql("select event_id, value, partition from events")


@query("stored_explain", "SELECT TRUE AS pruned, TRUE AS pushed")
def stored_explain(spark, sf_dir):
    plan = stored_events(spark, sf_dir).select("explain select event_id from events where received_at >= timestamp'2024-01-20T12:00:00Z' and value > 5")
    return plan.select(F.col("plan").rlike(r"PartitionFilters: \[[^\]]*partition#\d+ >= 2024-01-20T00:00:00Z").alias("pruned"), F.col("plan").rlike(r"PushedFilters: \[[^\]]*GreaterThan\(value,5.0\)").alias("pushed"))


@query("scan_csv", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal > 100")
def scan_csv(spark, sf_dir):
    path, rows = shared_path(spark, "csv"), table(spark, sf_dir, "customer")
    rows.write.option("header", True).csv(path)
    return spark.read.schema(rows.schema).option("header", True).csv(path).where("c_acctbal > 100").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


@query("scan_json", "SELECT event_id, event_type, value, props FROM events WHERE user_id % 2 = 1")
def scan_json(spark, sf_dir):
    path, rows = shared_path(spark, "json"), table(spark, sf_dir, "events")
    rows.write.json(path)
    return spark.read.schema(rows.schema).json(path).where("user_id % 2 = 1").select("event_id", "event_type", "value", "props")


@query(
    "join_asof",
    """SELECT o_orderkey, e.event_id FROM orders o ASOF LEFT JOIN (SELECT max(event_id) AS event_id, user_id, ts - INTERVAL 28 YEAR AS at FROM events GROUP BY user_id, ts) e
       ON o.o_custkey = e.user_id AND o.o_orderdate >= e.at""",
)
def join_asof(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("at"))
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("k"), F.expr("ts - interval 28 years").alias("at"))
    return asof_join(orders, events, by=["k"], on="at").select("o_orderkey", "event_id")


@query(
    "join_range",
    """SELECT e.event_id, o.o_orderkey FROM events e JOIN orders o ON o.o_orderdate >= e.ts - INTERVAL 28 YEAR AND o.o_orderdate <= e.ts - INTERVAL 28 YEAR + INTERVAL 6 HOUR""",
)
def join_range(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.expr("ts - interval 28 years").alias("low"), F.expr("ts - interval 28 years + interval 6 hours").alias("high"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("at"))
    return range_join(events, orders, "low", "high", "at", 2 * 3600).select("event_id", "o_orderkey")


# A stream with late rows

LATE = "event_id % 5 = 0"
ALLOWED = "2 days"


@query(
    "stream_late_rows",
    f"""WITH e AS (SELECT ts, value, {LATE} AS late, time_bucket(INTERVAL 1 HOUR, ts) AS start FROM events),
    w AS (SELECT date_trunc('milliseconds', max(ts) FILTER (WHERE NOT late)) - INTERVAL {ALLOWED} AS first,
                 date_trunc('milliseconds', max(ts)) - INTERVAL {ALLOWED} AS last FROM e)
    SELECT epoch_us(start) AS start, count(*) AS n, max(value) AS top FROM e, w
    WHERE (NOT late OR start + INTERVAL 1 HOUR > w.first) AND start + INTERVAL 1 HOUR <= w.last GROUP BY 1""",
)
def stream_late_rows(spark, sf_dir):
    """Hourly windows of a stream: a fifth of the events arrives after the rest, and what the watermark has passed is dropped.

    The stream runs twice from one checkpoint, each time over all that is there, and appends a window once it is closed.
    """
    source, log, sink = (shared_path(spark, f"stream-{x}") for x in ("in", "log", "out"))
    events = table(spark, sf_dir, "events").select(F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp"))).alias("at"), "value", "event_id")
    out = T.StructType([T.StructField("start", T.LongType()), T.StructField("n", T.LongType()), T.StructField("top", T.DoubleType())])
    for part in (f"not ({LATE})", LATE):
        rows = events.where(part).drop("event_id")
        rows.write.mode("append").parquet(source)
        arriving = spark.readStream.schema(rows.schema).parquet(source).withWatermark("at", ALLOWED)
        closed = arriving.groupBy(F.window("at", "1 hour")).agg(F.count("*").alias("n"), F.max("value").alias("top"))
        flat = closed.select(F.unix_micros("window.start").alias("start"), "n", "top")
        flat.writeStream.format("parquet").option("path", sink).option("checkpointLocation", log).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out).parquet(sink)


# SQL passed on

D = "CAST(sum(CAST({} AS DECIMAL(18, 4))) AS DOUBLE)"
PRICE = D.format("l_extendedprice")

both("scan_filter", "SELECT l_orderkey, l_linenumber, l_quantity FROM {lineitem} WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24 AND l_returnflag IN ('A', 'R') AND l_linestatus LIKE 'F%'")
both("projection", "SELECT o_orderkey, o_totalprice * 2 AS twice, -o_custkey AS minus, o_orderkey % 7 AS m, o_orderstatus || '-' || o_orderpriority AS both_ FROM {orders}")
both("filter_logic", "SELECT c_custkey FROM {customer} WHERE (c_acctbal < 0 OR c_acctbal > 9000) AND NOT c_mktsegment = 'BUILDING' AND c_name IS NOT NULL AND c_nationkey <> 3 AND c_name ILIKE '%CUSTOMER%'")
both("distinct_profile", "SELECT count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS kinds, min(value) AS low, max(value) AS high FROM {events}")
both("pricing_summary", f"SELECT l_returnflag, l_linestatus, {D.format('l_quantity')} AS qty, {PRICE} AS price, count(*) AS n, round(avg(l_discount), 6) AS disc FROM {{lineitem}} WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus")
both("aggregate_filter", "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS big, max(l_extendedprice) FILTER (WHERE l_linestatus = 'O') AS top FROM {lineitem} GROUP BY l_returnflag")
both("statistics", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS r, round(covar_samp(l_discount, l_tax), 8) AS cs, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM {lineitem} GROUP BY l_returnflag")
both("bool_bit_aggregates", "SELECT o_orderstatus, bool_and(o_totalprice > 0) AS all_paid, bool_or(o_totalprice > 400000) AS any_big, bit_and(o_orderkey) AS ba, bit_or(o_custkey) AS bo, bit_xor(o_orderkey) AS bx FROM {orders} GROUP BY o_orderstatus")
# Nulls are passed over; of equal balances the smallest key counts (~ turns the order round), the first row of tables in key order.
# The twin takes the first row it meets: that one on one thread or from one row group, else any.
both("median_mode", "SELECT c_mktsegment, round(median(c_acctbal), 6) AS med, max_by(c_name, struct(c_acctbal, ~c_custkey)) FILTER (WHERE c_acctbal IS NOT NULL AND c_name IS NOT NULL) AS top, min_by(c_custkey, struct(c_acctbal, c_custkey)) FILTER (WHERE c_acctbal IS NOT NULL AND c_custkey IS NOT NULL) AS low FROM {customer} GROUP BY c_mktsegment", "SELECT c_mktsegment, round(median(c_acctbal), 6) AS med, arg_max(c_name, c_acctbal) AS top, arg_min(c_custkey, c_acctbal) AS low FROM {customer} GROUP BY c_mktsegment")
both("mode", "SELECT c_nationkey, mode(c_mktsegment, true) AS usual FROM {customer} GROUP BY c_nationkey", "SELECT c_nationkey, usual FROM (SELECT c_nationkey, c_mktsegment AS usual, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS r FROM customer GROUP BY 1, 2) WHERE r = 1")
both("string_aggregate", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey")
both("array_aggregate", "SELECT n_regionkey, array_join(array_sort(array_agg(n_name)), '|') AS names, size(collect_set(n_regionkey)) AS one FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(list_sort(array_agg(n_name)), '|') AS names, CAST(len(list_distinct(array_agg(n_regionkey))) AS INTEGER) AS one FROM {nation} GROUP BY n_regionkey")
both("grouping_sets", f"SELECT l_returnflag, l_linestatus, grouping(l_returnflag) AS gf, grouping(l_linestatus) AS gs, {PRICE} AS price FROM {{lineitem}} GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())", f"SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS TINYINT) AS gf, CAST(grouping(l_linestatus) AS TINYINT) AS gs, {PRICE} AS price FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
both("cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)")
both("rollup", "SELECT c_nationkey, c_mktsegment, count(*) AS n, max(c_acctbal) AS top FROM {customer} GROUP BY ROLLUP (c_nationkey, c_mktsegment)")
both("having", "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 12")
both("distinct_rows", "SELECT DISTINCT p_brand, p_type FROM {part}")
both("join_inner", "SELECT o.o_orderkey, c.c_name, n.n_name FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey WHERE o.o_totalprice > 300000")
both("join_left", "SELECT c.c_custkey, count(o.o_orderkey) AS n FROM {customer} c LEFT JOIN {orders} o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P' GROUP BY c.c_custkey")
both("join_right", "SELECT s.s_suppkey, n.n_nationkey FROM {supplier} s RIGHT JOIN {nation} n ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000")
both("join_full", "SELECT a.c_custkey AS a, b.user_id AS b FROM (SELECT c_custkey FROM {customer}) a FULL OUTER JOIN (SELECT DISTINCT user_id FROM {events}) b ON a.c_custkey = b.user_id")
both("join_cross", "SELECT r.r_name, n.n_name FROM {region} r CROSS JOIN {nation} n")
both("join_semi", "SELECT c.c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 450000)")
both("join_anti", "SELECT c.c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)")
both("join_inequality", "SELECT s.s_suppkey, r.r_regionkey FROM {supplier} s JOIN {region} r ON s.s_acctbal > r.r_regionkey * 2000")
both("join_hint_broadcast", "SELECT /*+ BROADCAST(c) */ o.o_orderkey, c.c_mktsegment FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey")
both("join_hint_merge", "SELECT /*+ MERGE(c) */ o.o_orderkey, c.c_mktsegment FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey")
both("join_hint_hash", "SELECT /*+ SHUFFLE_HASH(c) */ o.o_orderkey, c.c_mktsegment FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey")
both("join_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
both("join_null_safe", "SELECT a.k, b.n FROM (SELECT CASE WHEN r_regionkey < 3 THEN r_regionkey END AS k FROM {region}) a JOIN (SELECT CASE WHEN n_regionkey < 2 THEN n_regionkey END AS k, count(*) AS n FROM {nation} GROUP BY 1) b ON a.k <=> b.k", "SELECT a.k, b.n FROM (SELECT CASE WHEN r_regionkey < 3 THEN r_regionkey END AS k FROM region) a JOIN (SELECT CASE WHEN n_regionkey < 2 THEN n_regionkey END AS k, count(*) AS n FROM nation GROUP BY 1) b ON a.k IS NOT DISTINCT FROM b.k")
both("window_rank", "SELECT c_custkey, row_number() OVER w AS rn, rank() OVER w2 AS rk, dense_rank() OVER w2 AS dr, ntile(4) OVER w AS q FROM {customer} WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey), w2 AS (PARTITION BY c_mktsegment ORDER BY c_nationkey)", "SELECT c_custkey, CAST(row_number() OVER w AS INTEGER) AS rn, CAST(rank() OVER w2 AS INTEGER) AS rk, CAST(dense_rank() OVER w2 AS INTEGER) AS dr, CAST(ntile(4) OVER w AS INTEGER) AS q FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey), w2 AS (PARTITION BY c_mktsegment ORDER BY c_nationkey)")
both("window_share", "SELECT c_custkey, round(percent_rank() OVER w, 8) AS pr, round(cume_dist() OVER w, 8) AS cd FROM {customer} WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_nationkey)")
both("window_frame", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n3, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 FOLLOWING) AS top FROM {orders}")
both("window_range", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM {part}")
both("lag_lead", "SELECT event_id, lag(value) OVER w AS before, lead(value, 2, -1) OVER w AS after2, first_value(event_id) OVER w AS first_id, nth_value(event_id, 2) OVER w AS second_id FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)", "SELECT event_id, lag(value) OVER w AS before, lead(value, 2, -1) OVER w AS after2, first_value(event_id) OVER w AS first_id, nth_value(event_id, 2) OVER w AS second_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
both("qualify", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM {orders}) WHERE r = 1", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
both("topk", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
both("sort_offset", "SELECT c_custkey, c_acctbal FROM {customer} ORDER BY c_acctbal ASC NULLS LAST, c_custkey LIMIT 20 OFFSET 30")
both("union_all", "SELECT n_name AS name FROM {nation} UNION ALL SELECT r_name FROM {region} UNION ALL SELECT r_name FROM {region}")
both("union_distinct", "SELECT s_nationkey AS k FROM {supplier} UNION SELECT c_nationkey FROM {customer}")
both("intersect", "SELECT c_custkey AS k FROM {customer} INTERSECT SELECT user_id FROM {events}")
both("intersect_all", "SELECT s_nationkey AS k FROM {supplier} INTERSECT ALL SELECT c_nationkey FROM {customer}")
both("except", "SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey FROM {orders} WHERE o_totalprice > 400000")
both("distinct_on", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM {events}) WHERE r = 1", "SELECT DISTINCT ON (user_id) user_id, event_id, value FROM events ORDER BY user_id, ts DESC, event_id DESC")
both("last_value", "SELECT event_id, last_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS newest FROM {events}")
both("except_all", "SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT n_nationkey FROM {nation}")
both("cte", "WITH spent AS (SELECT o_custkey AS k, count(*) AS n FROM {orders} GROUP BY o_custkey), often AS (SELECT k FROM spent WHERE n > 10) SELECT c.c_custkey, s.n FROM {customer} c JOIN spent s ON c.c_custkey = s.k WHERE s.k IN (SELECT k FROM often)")
both("cte_recursive", "WITH RECURSIVE t(i, v) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT i + 1, v * 2 FROM t WHERE i < 30) SELECT i, v FROM t")
both("scalar_subquery", "SELECT o_orderkey FROM {orders} WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.9 FROM {orders})")
both("correlated_subquery", "SELECT p_partkey FROM {part} p WHERE p_size = (SELECT max(p2.p_size) FROM {part} p2 WHERE p2.p_brand = p.p_brand)")
both("values_unnest", "SELECT a, x FROM VALUES (1, array(10, 20)), (2, array(30)) AS t(a, xs) LATERAL VIEW explode(xs) e AS x", "SELECT a, unnest(xs) AS x FROM (VALUES (1, [10, 20]), (2, [30])) AS t(a, xs)")
both("scalar_string", "SELECT p_partkey, upper(p_name) AS u, lower(p_type) AS l, substring(p_name, 2, 4) AS s, trim(concat('  ', p_brand, ' ')) AS t, lpad(p_brand, 12, '*') AS lp, reverse(p_brand) AS rv, replace(p_name, 'e', 'E') AS rp, split_part(p_brand, '#', 2) AS sp, length(p_name) AS n, regexp_replace(p_name, '[aeiou]', '-', 'g') AS rx, translate(p_name, 'abc', 'xyz') AS tr FROM {part}".replace("'-', 'g')", "'-')"), "SELECT p_partkey, upper(p_name) AS u, lower(p_type) AS l, substring(p_name, 2, 4) AS s, trim(concat('  ', p_brand, ' ')) AS t, lpad(p_brand, 12, '*') AS lp, reverse(p_brand) AS rv, replace(p_name, 'e', 'E') AS rp, split_part(p_brand, '#', 2) AS sp, CAST(length(p_name) AS INTEGER) AS n, regexp_replace(p_name, '[aeiou]', '-', 'g') AS rx, translate(p_name, 'abc', 'xyz') AS tr FROM part")
both("scalar_date", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, quarter(o_orderdate) AS q, dayofyear(o_orderdate) AS dy, extract(day FROM o_orderdate) AS d, datediff(o_orderdate, DATE '1995-01-01') AS days, date_format(date_trunc('MONTH', o_orderdate), 'yyyy-MM-dd') AS mon, date_format(o_orderdate + INTERVAL 1 MONTH, 'yyyy-MM-dd') AS nextm FROM {orders}", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(quarter(o_orderdate) AS INTEGER) AS q, CAST(dayofyear(o_orderdate) AS INTEGER) AS dy, CAST(extract(day FROM o_orderdate) AS INTEGER) AS d, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS mon, strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m-%d') AS nextm FROM orders")
both("scalar_math", "SELECT l_orderkey, l_linenumber, abs(l_quantity - 25) AS a, ceil(l_extendedprice) AS c, floor(l_extendedprice) AS f, round(l_extendedprice, 1) AS r, round(power(l_quantity, 2), 4) AS p, round(ln(l_extendedprice), 8) AS n, round(sqrt(l_quantity), 8) AS s, round(sin(l_quantity), 8) AS sn, CAST(l_quantity AS INT) % 7 AS m, sign(l_quantity - 25) AS sg, greatest(l_discount, l_tax) AS g FROM {lineitem}", "SELECT l_orderkey, l_linenumber, abs(l_quantity - 25) AS a, CAST(ceil(l_extendedprice) AS BIGINT) AS c, CAST(floor(l_extendedprice) AS BIGINT) AS f, round(l_extendedprice, 1) AS r, round(power(l_quantity, 2), 4) AS p, round(ln(l_extendedprice), 8) AS n, round(sqrt(l_quantity), 8) AS s, round(sin(l_quantity), 8) AS sn, CAST(l_quantity AS INT) % 7 AS m, CAST(sign(l_quantity - 25) AS DOUBLE) AS sg, greatest(l_discount, l_tax) AS g FROM lineitem")
both("scalar_array", "SELECT user_id, size(a) AS n, array_contains(a, 'click') AS has, element_at(a, 1) AS first_, array_join(slice(a, 1, 2), '+') AS two, array_join(array_sort(array_distinct(a)), ',') AS kinds, array_position(a, 'click') AS pos, aggregate(transform(a, x -> length(x)), 0, (s, x) -> s + x) AS chars, size(filter(a, x -> x = 'error')) AS errors, exists(a, x -> x = 'view') AS any_view FROM (SELECT user_id, array_sort(collect_list(event_type)) AS a FROM {events} GROUP BY user_id)", "SELECT user_id, CAST(len(a) AS INTEGER) AS n, list_contains(a, 'click') AS has, a[1] AS first_, array_to_string(a[1:2], '+') AS two, array_to_string(list_sort(list_distinct(a)), ',') AS kinds, CAST(coalesce(list_position(a, 'click'), 0) AS BIGINT) AS pos, CAST(list_sum(list_transform(a, lambda x: length(x))) AS INTEGER) AS chars, CAST(len(list_filter(a, lambda x: x = 'error')) AS INTEGER) AS errors, len(list_filter(a, lambda x: x = 'view')) > 0 AS any_view FROM (SELECT user_id, list_sort(list(event_type)) AS a FROM events GROUP BY user_id)")
both("scalar_map", "SELECT r_regionkey, m['name'] AS v, m['none'] AS missing, map_contains_key(m, 'name') AS has, array_join(array_sort(map_keys(m)), ',') AS ks, size(m) AS n FROM (SELECT r_regionkey, map('name', r_name, 'key', CAST(r_regionkey AS STRING)) AS m FROM {region})", "SELECT r_regionkey, m['name'] AS v, m['none'] AS missing, map_contains(m, 'name') AS has, array_to_string(list_sort(map_keys(m)), ',') AS ks, CAST(cardinality(m) AS INTEGER) AS n FROM (SELECT r_regionkey, MAP {'name': r_name, 'key': CAST(r_regionkey AS VARCHAR)} AS m FROM region)")
both("scalar_json", "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k, from_json(props, 'k INT').k + 1 AS k1, variant_get(parse_json(props), '$.k', 'int') AS k2, get_json_object(props, '$.none') AS none FROM {events}", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(json_extract_string(props, '$.k') AS INTEGER) + 1 AS k1, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k2, json_extract_string(props, '$.none') AS none FROM events")
both("scalar_binary", "SELECT n_nationkey, lower(hex(CAST(n_name AS BINARY))) AS h, CAST(unhex(hex(CAST(n_name AS BINARY))) AS STRING) AS back, octet_length(n_name) AS n, md5(n_name) AS m, sha2(n_name, 256) AS s FROM {nation}", "SELECT n_nationkey, lower(hex(encode(n_name))) AS h, decode(unhex(hex(encode(n_name)))) AS back, CAST(octet_length(encode(n_name)) AS INTEGER) AS n, md5(n_name) AS m, sha256(n_name) AS s FROM nation")
both("conditional", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'owes' WHEN c_acctbal < 5000 THEN 'some' ELSE 'much' END AS band, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS seg, if(c_nationkey > 12, 1, 0) AS hi FROM {customer}")
both("casts", "SELECT o_orderkey, CAST(o_totalprice AS INT) AS i, CAST(o_orderkey AS STRING) AS s, CAST('12.50' AS DECIMAL(6, 2)) AS d, CAST(o_orderdate AS DATE) >= DATE '1998-01-01' AS late, CAST(o_totalprice AS DECIMAL(12, 1)) AS p FROM {orders}", "SELECT o_orderkey, CAST(trunc(o_totalprice) AS INTEGER) AS i, CAST(o_orderkey AS VARCHAR) AS s, CAST('12.50' AS DECIMAL(6, 2)) AS d, CAST(o_orderdate AS DATE) >= DATE '1998-01-01' AS late, CAST(o_totalprice AS DECIMAL(12, 1)) AS p FROM orders")
both("approximate_distinct", "SELECT event_type, abs(approx_count_distinct(user_id, 0.02) - count(DISTINCT user_id)) <= 0.1 * count(DISTINCT user_id) AS close FROM {events} GROUP BY event_type", "SELECT event_type, TRUE AS close FROM {events} GROUP BY event_type")
both("approximate_percentile", "SELECT event_type, abs(percentile_approx(value, 0.95, 10000) - percentile(value, 0.95)) <= 0.05 * percentile(value, 0.95) AS close FROM {events} GROUP BY event_type", "SELECT event_type, TRUE AS close FROM {events} GROUP BY event_type")
both("event_tumbling", "SELECT unix_micros(CAST(window.start AS TIMESTAMP)) AS start, event_type, count(*) AS n, max(value) AS top FROM {events} GROUP BY window(ts, '1 hour'), event_type", "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start, event_type, count(*) AS n, max(value) AS top FROM events GROUP BY 1, 2")
both("event_sliding", "SELECT unix_micros(CAST(window.start AS TIMESTAMP)) AS start, count(*) AS n FROM {events} GROUP BY window(ts, '2 hours', '1 hour')", "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts) - b.back * INTERVAL 1 HOUR) AS start, count(*) AS n FROM events, (VALUES (0), (1)) AS b(back) GROUP BY 1")
both("event_session", "SELECT user_id, unix_micros(CAST(session_window.start AS TIMESTAMP)) AS start, count(*) AS n FROM {events} GROUP BY user_id, session_window(ts, '30 minutes')", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, k")
both("top_revenue", f"SELECT n.n_name, {D.format('l.l_extendedprice * (1 - l.l_discount)')} AS revenue FROM {{customer}} c JOIN {{orders}} o ON c.c_custkey = o.o_custkey JOIN {{lineitem}} l ON l.l_orderkey = o.o_orderkey JOIN {{supplier}} s ON l.l_suppkey = s.s_suppkey AND c.c_nationkey = s.s_nationkey JOIN {{nation}} n ON s.s_nationkey = n.n_nationkey GROUP BY n.n_name")
both("pivot", "SELECT * FROM (SELECT o_orderstatus AS st, o_orderpriority AS pr FROM {orders}) PIVOT (count(1) FOR st IN ('F' AS f, 'O' AS o, 'P' AS p))", "SELECT o_orderpriority AS pr, nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS f, nullif(count(*) FILTER (WHERE o_orderstatus = 'O'), 0) AS o, nullif(count(*) FILTER (WHERE o_orderstatus = 'P'), 0) AS p FROM orders GROUP BY 1")

