"""Files of a table: names that tell which files they replace, the live ones among them, and writing new ones.

A file is ``<id>.parquet``, or ``<id>_<id>_<id>.parquet`` if it was merged from others, which it names. A file that
another one names is replaced: readers leave it out from the moment the merged file has its name, whether or not it
was deleted. So the rename of a finished file is the commit, and nothing else has to happen at the same time.

All access goes through Hadoop's file systems; on a store whose rename copies, the copy under the final name is the
commit.
"""

from __future__ import annotations

import hashlib
import os
import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.sources.records import PARTITION, RecordSpec, partition_column, partition_start

SUFFIX = ".parquet"
#: Rows of a row group, and the compression.
GROUP_ROWS = 10_000
COMPRESSION = "zstd"
#: Partitions that are listed, or whose new files are put in place, side by side.
LISTED_AT_ONCE = 16


def new_id(millis: int | None = None, random: bytes | None = None) -> str:
    """A UUID of version 7 without hyphens: ids made later sort later."""
    millis = time.time_ns() // 1_000_000 if millis is None else millis
    random = os.urandom(10) if random is None else random
    value = (millis & (1 << 48) - 1) << 80 | int.from_bytes(random[:10], "big")
    value = value & ~(0xF << 76) | 7 << 76
    return f"{value & ~(3 << 62) | 2 << 62:032x}"


def stable_id(millis: int, *parts: object) -> str:
    """An id that is the same whenever it is made of the same parts."""
    return new_id(millis, hashlib.sha256("\x00".join(map(str, parts)).encode()).digest())


def own_id(name: str) -> str:
    return name.removesuffix(SUFFIX).split("_", 1)[0]


def superseded(name: str) -> list[str]:
    """The ids that a file's name says it replaces."""
    return name.removesuffix(SUFFIX).split("_")[1:]


def merged_name(sources: Iterable[str], millis: int | None = None) -> str:
    """A fresh name that names each source by its own id only, so names don't grow from merge to merge."""
    return "_".join([new_id(millis), *map(own_id, sources)]) + SUFFIX


@dataclass(frozen=True)
class File:
    path: str
    size: int

    @property
    def name(self) -> str:
        return self.path.rsplit("/", 1)[-1]


def split_live(files: Iterable[File]) -> tuple[list[File], list[File]]:
    """(live, stale) files of a listing; a file is stale if another one names its id."""
    files = list(files)
    replaced = {i for f in files for i in superseded(f.name)}
    return [f for f in files if own_id(f.name) not in replaced], [f for f in files if own_id(f.name) in replaced]


class Files:
    """Hadoop file system calls."""

    def __init__(self, spark: SparkSession):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def list(self, path: str) -> list[File]:
        """What stands in a folder; a folder in it has size -1."""
        fs, p = self._at(path)
        found = fs.listStatus(p) if fs.exists(p) else []
        return [File(s.getPath().toString(), -1 if s.isDirectory() else s.getLen()) for s in found]

    def make(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def delete(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.delete(p, True)

    def write(self, path: str, data: bytes) -> None:
        fs, p = self._at(path)
        out = fs.create(p, True)
        try:
            out.write(bytearray(data))
            out.hsync()
        finally:
            out.close()

    def read(self, path: str) -> bytes:
        fs, p = self._at(path)
        source = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(source))
        finally:
            source.close()

    def rename(self, source: str, to: str) -> None:
        """Moves a file; one of that name, which an earlier attempt left, is replaced in the same step where the store
        can do that, so that readers never miss it."""
        _, p = self._at(source)
        q = self.jvm.org.apache.hadoop.fs.Path(to)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.getFileSystem(self.conf).getUri(), self.conf)
        kinds = self.jvm.org.apache.hadoop.fs.Options.Rename
        flags = self.jvm.java.lang.reflect.Array.newInstance(kinds.OVERWRITE.getClass(), 1)
        self.jvm.java.lang.reflect.Array.set(flags, 0, kinds.OVERWRITE)
        context.mkdir(q.getParent(), None, True)
        context.rename(p, q, flags)

    def age(self, path: str) -> float | None:
        """Seconds since a file was written; None if there is none."""
        fs, p = self._at(path)
        return max(0.0, time.time() - fs.getFileStatus(p).getModificationTime() / 1000) if fs.exists(p) else None

    def create_once(self, path: str, data: bytes = b"") -> bool:
        """Makes a file; False if there is one."""
        fs, p = self._at(path)
        fs.mkdirs(p.getParent())
        try:
            out = fs.create(p, False)
            out.write(bytearray(data))
            out.close()
        except Exception as e:
            if "AlreadyExists" in str(e):
                return False
            raise
        return True


def directory(value: str) -> str:
    """A partition's directory, spelled as Spark's writer does."""
    return f"{PARTITION}={value.replace(':', '%3A')}"


class Store:
    """The tables under one root path."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)

    def table_path(self, spec: RecordSpec) -> str:
        return f"{self.root}/{spec.table}"

    def partitions(self, spec: RecordSpec) -> list[str]:
        """The values of the table's partitions, newest first; directories that are none are passed over."""
        found = []
        for f in self.files.list(self.table_path(spec)):
            if f.size < 0 and f.name.startswith(PARTITION + "="):
                value = f.name.removeprefix(PARTITION + "=").replace("%3A", ":")
                if partition_start(value):
                    found.append(value)
        return sorted(set(found), reverse=True)

    def all_files(self, spec: RecordSpec, value: str) -> list[File]:
        found = self.files.list(f"{self.table_path(spec)}/{directory(value)}")
        return sorted((f for f in found if f.size >= 0 and f.name.endswith(SUFFIX)), key=lambda f: f.name)

    def live_files(self, spec: RecordSpec, values: Iterable[str] | None = None) -> list[File]:
        """The live files of some partitions, or of all; several are listed at a time."""
        with ThreadPoolExecutor(LISTED_AT_ONCE) as pool:
            listed = pool.map(lambda v: split_live(self.all_files(spec, v))[0], self.partitions(spec) if values is None else list(values))
            return [f for files in listed for f in files]

    def read(self, spec: RecordSpec, files: Iterable[File] | None = None) -> DataFrame:
        """The rows of the live files, with ``partition``; columns are as declared, whatever the files say.

        The files are named one by one: a folder would be listed again by Spark, and a merge that commits in between
        would show its rows twice.
        """
        paths = [f.path for f in (self.live_files(spec) if files is None else files)]
        if not paths:
            return self.spark.createDataFrame([], spec.read_schema)
        return self.spark.read.schema(spec.read_schema).option("basePath", self.table_path(spec)).parquet(*paths)

    def write(self, spec: RecordSpec, rows: DataFrame, name: Callable[[str, int], str] | None = None, files_per_partition: int | None = None) -> list[str]:
        """Writes the rows into their partitions and returns the new files.

        Rows are shuffled by partition, and a day that is large is split among tasks by its size; with
        ``files_per_partition`` by shares of the keys among so many. Each file is sorted by the file order.
        ``name`` gives a file's name by partition and ordinal: the same names on a retry replace what was written.
        """
        keyed = spec.checked(rows).withColumn(PARTITION, partition_column())
        if files_per_partition is None and name is None:
            dealt = keyed.hint("rebalance", F.col(PARTITION)).sortWithinPartitions(PARTITION, *spec.file_order())
        elif (files_per_partition or 1) > 1:
            share = F.pmod(F.xxhash64(*spec.primary_key), F.lit(files_per_partition))
            dealt = keyed.withColumn("__share", share).repartition(max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 8 * files_per_partition), PARTITION, "__share").sortWithinPartitions(PARTITION, "__share", *spec.file_order()).drop("__share")
        else:
            dealt = keyed.repartition(PARTITION).sortWithinPartitions(PARTITION, *spec.file_order())
        return self._commit(spec, dealt, name)

    def _placed(self, spec: RecordSpec, day: File, name: Callable[[str, int], str] | None) -> list[str]:
        """Moves a written day's files to their own names."""
        value = day.name.removeprefix(PARTITION + "=").replace("%3A", ":")
        made = []
        for i, part in enumerate(sorted(f.path for f in self.files.list(day.path) if f.name.endswith(SUFFIX))):
            made.append(f"{self.table_path(spec)}/{directory(value)}/{name(value, i) if name else new_id() + SUFFIX}")
            self.files.rename(part, made[-1])
        return made

    def _commit(self, spec: RecordSpec, dealt: DataFrame, name: Callable[[str, int], str] | None) -> list[str]:
        stage = f"{self.table_path(spec)}/_tmp/{new_id()}"
        writer = dealt.write.option("compression", COMPRESSION).option("parquet.block.row.count.limit", str(GROUP_ROWS))
        try:
            writer.partitionBy(PARTITION).parquet(stage)
            days = [d for d in self.files.list(stage) if d.size < 0]
            with ThreadPoolExecutor(LISTED_AT_ONCE) as pool:
                made = [path for paths in pool.map(lambda d: self._placed(spec, d, name), days) for path in paths]
        finally:
            self.files.delete(stage)
        return made

    def write_merged(self, spec: RecordSpec, rows: DataFrame, value: str, name: str) -> str:
        """One sorted file with a name given, for rows of one partition that are read from files of it."""
        columns = [*[f.name for f in spec.schema.fields], PARTITION]
        one = rows.select(*columns).coalesce(1).sortWithinPartitions(*spec.file_order())
        return self._commit(spec, one, lambda *_: name)[0]
