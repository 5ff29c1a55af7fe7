"""Joins by nearness in time, without a cross product.

``asof_join`` finds for each left row the last right row of its keys that isn't later: both sides go into one stream
ordered by time, in which the last right row is carried forward. Keys are dealt over stretches of time as well, so a
hot key is many windows; what the stretches before hand on is one row a key and stretch. Of right rows of one time
the one with the greatest content wins; a row whose time or key is null meets none.

``range_join`` finds the right rows within each left row's interval, however long: instants fall into buckets, an
interval has a row for each bucket that it touches, and the exact bounds are checked after the join. The width of the
buckets only decides how many those rows are. Intervals and instants with nulls meet nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a stretch of time.
STRETCH_SECONDS = 86_400


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, stretch_seconds: int = STRETCH_SECONDS) -> DataFrame:
    """All left rows with the columns of their right row, null if there is none."""
    own = [c for c in right.columns if c not in {*by, on}]
    keys = [F.col(c).alias(f"__k{i}") for i, c in enumerate(by)]
    names = [f"__k{i}" for i in range(len(by))]
    packed = F.struct(*[F.col(c) for c in own]) if own else F.struct(F.lit(1).alias("__one"))
    kind = right.select(packed.alias("r")).schema["r"].dataType
    at, stretch = _micros(on).alias("__at"), F.floor(_micros(on) / (stretch_seconds * 1_000_000)).alias("__stretch")
    lefts = left.select(*keys, at, stretch, F.struct(*left.columns).alias("__left"), F.lit(None).cast(kind).alias("__right"), F.lit(1).alias("__side"))
    known = F.col(on).isNotNull()
    for c in by:
        known = known & F.col(c).isNotNull()
    rights = right.where(known).select(*keys, at, stretch, F.lit(None).cast(lefts.schema["__left"].dataType).alias("__left"), packed.alias("__right"), F.lit(0).alias("__side"))
    # The last right row of each stretch, and of all stretches before each.
    last = rights.groupBy(*names, "__stretch").agg(F.max(F.struct("__at", F.col("__right").alias("r"))).alias("__last"))
    touched = last.unionByName(lefts.select(*names, "__stretch").distinct().withColumn("__last", F.lit(None).cast(last.schema["__last"].dataType)))
    touched = touched.groupBy(*names, "__stretch").agg(F.max("__last").alias("__last"))
    before = F.last("__last", ignorenulls=True).over(Window.partitionBy(*names).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1))
    handed = touched.select(*[F.col(n).alias(f"{n}b") for n in names], F.col("__stretch").alias("__s"), before["r"].alias("__before"))
    w = Window.partitionBy(*names, "__stretch").orderBy("__at", "__side", "__right").rowsBetween(Window.unboundedPreceding, 0)
    carried = lefts.unionByName(rights).withColumn("__found", F.last("__right", ignorenulls=True).over(w)).where("__side = 1")
    same = F.col("__stretch") == F.col("__s")
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"{n}b"))
    met = carried.join(handed, same, "left").select("__left", "__at", F.coalesce("__found", "__before").alias("__found"))
    found = F.when(F.col("__at").isNotNull(), F.col("__found"))
    return met.select("__left", found.alias("__found")).select("__left.*", *[F.col(f"__found.{c}").alias(c) for c in own])


def range_join(intervals: DataFrame, points: DataFrame, low: str, high: str, at: str, bucket_seconds: int) -> DataFrame:
    """Pairs with low <= at <= high, for intervals of any length."""
    bucket = lambda c: F.floor(_micros(c) / (bucket_seconds * 1_000_000))
    touched = F.explode(F.sequence(bucket(low), bucket(high)))
    spread = intervals.where(F.col(low) <= F.col(high)).withColumn("__bucket", touched)
    return spread.join(points.withColumn("__bucket", bucket(at)), "__bucket").where((F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high))).drop("__bucket")
