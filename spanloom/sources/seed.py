"""Synthetic traces over a range of days, made by expressions alone: the same seed makes the same store anywhere.

A trace has one of eight shapes: a root and the calls beneath it, each inside its parent. About one in fourteen has a
failing call, and about one root in twenty is marked ok. The arrival is spread over the days, so every day partition
holds what it says.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.sources.records import SPANS
from spanloom.sources.store import Store

DAYS, TRACES_A_DAY, SEED = 30, 2_500, 1
#: (service, name, milliseconds, calls as (service, name, parent, share of the parent from, to, tag))
SHAPES = [
    ("gateway", "GET /catalogue", 170, [("catalogue", "ListItems", 0, 0.05, 0.6, "item"), ("catalogue-db", "SELECT items", 1, 0.1, 0.9, "db")]),
    ("gateway", "GET /item", 90, [("catalogue", "GetItem", 0, 0.05, 0.7, "item"), ("reviews", "ListReviews", 0, 0.2, 0.9, None)]),
    ("gateway", "POST /basket", 220, [("basket", "AddItem", 0, 0.05, 0.6, "item"), ("basket-cache", "SET basket", 1, 0.2, 0.8, None)]),
    ("gateway", "POST /order", 900, [("orders", "PlaceOrder", 0, 0.03, 0.95, None), ("payment", "Charge", 1, 0.1, 0.5, None), ("orders-db", "INSERT order", 1, 0.5, 0.6, "db"), ("mail", "SendReceipt", 1, 0.6, 0.9, None)]),
    ("gateway", "GET /basket", 60, [("basket", "GetBasket", 0, 0.1, 0.9, None), ("basket-cache", "GET basket", 1, 0.2, 0.8, None)]),
    ("shipping", "GET /quote", 130, [("carrier", "Quote", 0, 0.1, 0.9, None)]),
    ("search", "GET /search", 310, [("search-index", "Lookup", 0, 0.05, 0.8, None), ("catalogue", "GetItems", 0, 0.8, 0.98, "item"), ("catalogue-db", "SELECT items", 2, 0.1, 0.9, "db")]),
    ("accounts", "POST /login", 140, [("accounts-db", "SELECT account", 0, 0.1, 0.4, "db"), ("tokens", "Issue", 0, 0.5, 0.9, None)]),
]
MESSAGES = ["timed out upstream", "connection was reset", "too many requests"]


def spans(spark: SparkSession, days: int = DAYS, traces: int = TRACES_A_DAY, seed: int = SEED, until: datetime | None = None) -> DataFrame:
    """Span rows; ``traces`` is the number a day."""
    end = F.lit(int((until or datetime.now(UTC)).timestamp() * 1e6))

    def drawn(what: str, below: int | Column, of: str = "id") -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(what), of), F.lit(below) if isinstance(below, int) else below)

    def calls(shape) -> Column:
        service, name, millis, steps = shape
        span = lambda i, p, s, n, a, b, t: F.struct(F.lit(i).alias("i"), F.lit(p).cast("int").alias("p"), F.lit(s).alias("s"), F.lit(n).alias("n"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b"), F.lit(t).cast("string").alias("t"))
        placed, out = [(0.0, 1.0)], [span(0, None, service, name, 0.0, 1.0, None)]
        for i, (s, n, parent, a, b, tag) in enumerate(steps, 1):
            low, high = placed[parent]
            placed.append((low + a * (high - low), low + b * (high - low)))
            out.append(span(i, parent, s, n, *placed[-1], tag))
        return F.struct(F.lit(float(millis)).alias("millis"), F.lit(len(steps)).alias("calls"), F.array(*out).alias("spans"))

    rows = spark.range(days * traces).select(
        "id",
        (end - drawn("arrival", days * 86_400_000_000)).alias("arrival"),
        F.element_at(F.array(*[calls(s) for s in SHAPES]), (drawn("shape", len(SHAPES)) + 1).cast("int")).alias("shape"),
        (drawn("pace", 150) / 100 + 0.55).alias("pace"),
        F.when(drawn("fails", 14) == 0, drawn("call", 1 << 20)).alias("fails"),
        (drawn("asserted", 20) == 0).alias("asserted"),
        drawn("item", 10).alias("item"),
    )
    rows = rows.select("*", (F.col("shape.millis") * F.col("pace") * 1000).alias("micros"), F.explode("shape.spans").alias("span"))
    key = lambda what, *c: F.unhex(F.lpad(F.hex(F.xxhash64(F.lit(seed), F.lit(what), *c)), 16, "0"))
    failed = F.coalesce(F.col("span.i") == 1 + F.pmod("fails", F.col("shape.calls")), F.lit(False))
    at = lambda share: F.timestamp_micros((F.col("arrival") - F.col("micros") + F.col("micros") * F.col(share)).cast("long"))
    tags = (
        F.when(F.col("span.t") == "db", F.create_map(F.lit("db.system"), F.lit("postgresql")))
        .when(F.col("span.t") == "item", F.create_map(F.lit("item.number"), F.concat(F.lit("item-"), F.col("item").cast("string")), F.lit("sampled"), F.lit(None).cast("string")))
        .otherwise(F.create_map().cast("map<string,string>"))
    )
    return rows.select(
        F.lit("1").alias("organization_id"),
        F.lit("1").alias("project_id"),
        F.timestamp_micros("arrival").alias("received_at"),
        key("span", F.col("id"), F.col("span.i")).alias("span_id"),
        F.concat(key("trace-a", F.col("id")), key("trace-b", F.col("id"))).alias("trace_id"),
        F.when(F.col("span.p").isNotNull(), key("span", F.col("id"), F.col("span.p"))).alias("parent_span_id"),
        F.col("span.s").alias("service"),
        F.col("span.n").alias("name"),
        at("span.a").alias("started_at"),
        at("span.b").alias("ended_at"),
        F.when(failed, "error").when(F.col("asserted") & (F.col("span.i") == 0), "ok").otherwise("unset").alias("status"),
        F.when(failed, F.element_at(F.array(*[F.lit(m) for m in MESSAGES]), (F.pmod("fails", F.lit(len(MESSAGES))) + 1).cast("int"))).alias("status_message"),
        tags.alias("tags"),
    )


def seed_store(store: Store, days: int = DAYS, traces: int = TRACES_A_DAY, seed: int = SEED, until: datetime | None = None, files_per_day: int = 3) -> int:
    """Writes them, a few files a day so that there is something to compact; the number of files."""
    return len(store.write(SPANS, spans(store.spark, days, traces, seed, until), files_per_partition=files_per_day))
