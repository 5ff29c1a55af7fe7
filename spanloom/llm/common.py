"""What the training-data operators share: words, shared storage, and written intermediates."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a maximal run of anything but these six blanks.
WORD_SEPARATORS = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset (tests), a folder under the SQL warehouse is taken, which Spark shares too.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.conf.set("spark.checkpoint.dir", found)
    # With its scheme, so that Spark and the tasks' own file calls mean the same store.
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found)
    full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/+", "file:///", full).rstrip("/")


def new_dir(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """The rows, written as Parquet to the shared folder and read back, and where they lie.

    Later jobs read the files, so neither a lost executor nor a second use repeats the work before them.
    """
    spark = df.sparkSession
    path = new_dir(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    return written(df, tag)[0]


def delete(spark: SparkSession, path: str) -> None:
    """Removes an intermediate that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Intermediates that go once the result that they serve is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame, tag: str) -> DataFrame:
        out, path = written(df, tag)
        self.paths.append(path)
        return out

    def delete(self) -> None:
        for path in self.paths:
            delete(self.spark, path)
        self.paths.clear()


def running(rows: DataFrame, order: str, value: Column, name: str, tag: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over all rows before in the order of a column, nulls last.

    Rows are dealt by ranges; sums run within each, and only one row a range meets the others'.
    """
    dealt = rows.withColumn("__value", value).repartitionByRange(F.col(order).asc_nulls_last())
    dealt = materialize(dealt.withColumn("__range", F.spark_partition_id()), tag)
    inside = Window.partitionBy("__range").orderBy(F.col(order).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("__range").agg(F.sum("__value").alias("__sum")).withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0)))
    total = F.coalesce(F.sum("__value").over(inside), F.lit(0)) + F.col("__before")
    return dealt.join(F.broadcast(ranges.drop("__sum")), "__range").withColumn(name, total).drop("__range", "__value", "__before")


def numbered(rows: DataFrame, by: list[str], cells: list[str], name: str = "nth") -> DataFrame:
    """Adds ``name``: 0, 1, ... among the rows that agree in ``by``, in the order of ``cells``.

    Rows are numbered within their cell, and cells (a bounded number for each key) by how many rows come before, so
    that no key's rows meet in one task. What cells don't tell apart is numbered in any order.
    """
    sizes = rows.groupBy(*by, *cells).agg(F.count("*").alias("__rows"))
    before = F.coalesce(F.sum("__rows").over(Window.partitionBy(*by).orderBy(*cells).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # As names, so that nulls among the keys meet.
    keys = [*by, *cells]
    offsets = sizes.select(*[F.col(c).alias(f"__{c}") for c in keys], before.alias("__before"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0))) - 1
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return rows.withColumn("__inside", inside).join(offsets, same).withColumn(name, F.col("__before") + F.col("__inside")).drop("__before", "__inside", *[f"__{c}" for c in keys])


def words(text: Column) -> Column:
    """The words of a text as an array; null counts as empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_SEPARATORS), lambda w: w != "")


def n_words(text: Column) -> Column:
    """The number of words, without a lambda: separators at both ends give one empty piece each."""
    pieces = F.split(F.coalesce(text, F.lit("")), WORD_SEPARATORS)
    edge = lambda p: F.when(p == "", 1).otherwise(0)
    n = F.size(pieces)
    return (n - edge(pieces[0]) - F.when(n > 1, edge(F.element_at(pieces, -1))).otherwise(0)).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, also where the body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
