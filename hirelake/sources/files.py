"""File sources and sinks. Readers take explicit schemas, so no file is scanned to infer one."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S

#: What the names of the files begin with that point at a snapshot's versions; a number follows.
POINTER = "current-"


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _fs(spark, path).exists(_path(spark, path))


def _sighted(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """The postings of JSON Lines files, with `_at`: file, part of it and place in that part, in reading order.

    Blank lines are passed over. A line that is no posting (broken JSON, or no id) stops the job
    with its file and its text.
    """
    lines = spark.read.text(path, pathGlobFilter=pattern, recursiveFileLookup=True)
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("n"))
    lines = lines.select("value", at.alias("_at")).where(F.trim("value") != "")
    parsed = lines.withColumn("_r", F.from_json("value", f"{S.POSTING}, _broken string", {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"}))
    good = F.col("_r._broken").isNull() & F.col("_r.id").isNotNull()
    told = F.concat(F.lit("not a posting: "), F.col("_at.file"), F.lit(": "), F.substring("value", 1, 200))
    names = [c.split(" ")[0] for c in S.POSTING.split(", ")]
    checked = parsed.withColumn("_id", F.when(good, F.col("_r.id")).otherwise(F.raise_error(told)))
    return checked.select(F.col("_id").alias("id"), *[F.col(f"_r.{c}").alias(c) for c in names if c != "id"], "_at")


def _first_sight(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """The first row of each id in the order of the named columns, whole, without them."""
    rest = [c for c in rows.columns if c != "id" and c not in order]
    first = rows.groupBy("id").agg(F.min(F.struct(*order, *rest)).alias("_first"))
    return first.select("id", *[F.col(f"_first.{c}").alias(c) for c in rest])


def read_postings(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """A directory of `{source}.jsonl` as one typed table, an id once in each file: its first line.
    The source is the file's stem; a malformed line stops the job and names its file."""
    rows = _sighted(spark, path, pattern).withColumn("source", F.regexp_extract(F.col("_at.file"), r"([^/]*)\.\w+$", 1))
    rest = [c for c in rows.columns if c not in ("id", "source", "_at")]
    first = rows.groupBy("source", "id").agg(F.min(F.struct("_at", *rest)).alias("_first"))
    return first.select("id", *[F.col(f"_first.{c}").alias(c) for c in rest], "source")


def union_fragments(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Many shard fragments as one snapshot, an id counted once: its first line in the first
    fragment, in the order the paths are given, that holds it."""
    parts = [_sighted(spark, path, "*.json*").withColumn("_place", F.lit(i)) for i, path in enumerate(paths)]
    return _first_sight(reduce(DataFrame.unionByName, parts), ["_place", "_at"])


def assemble_feed(postings: DataFrame, order: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The combined feed, one row an id, and its rows per source. Of rows repeating an id the first
    in the order of the named columns is kept; rows equal in these, or all without them, by value."""
    feed = _first_sight(postings, list(order))
    return feed, feed.groupBy("ats").agg(F.count("*").alias("rows"))


def read_ledger(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A CSV ledger as a typed table; an absent file is an empty one."""
    schema = S.LEDGERS[kind]
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).csv(path, header=True, mode="PERMISSIVE")


def read_ticks(spark: SparkSession, path: str, archive: str | None = None) -> DataFrame:
    """The tick history, one `ts` partition a tick, with the older index-wide archive, whose rows
    name a source instead of a board."""
    # The stamp is a string: as a partition value it would otherwise be read as a date.
    rows = spark.read.schema(f"{S.TICK}, ts string").parquet(path).select("ts", "board", "metric", "family", "band", "delta")
    if archive is None or not exists(spark, archive):
        return rows
    old = spark.read.schema(S.TICK_ARCHIVE).parquet(archive)
    return rows.unionByName(old.select("ts", F.concat("ats", F.lit(":")).alias("board"), "metric", "family", "band", "delta"))


def append_tick(rows: DataFrame, path: str) -> None:
    """Add one tick's rows as its own partition, replacing that partition if the write is retried."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ts").parquet(path)


class SnapshotConflict(Exception):
    """Another writer published a version since the one that this writer started from."""


def _pointers(spark: SparkSession, path: str) -> list[int]:
    """The numbers of a snapshot's pointer files, in order."""
    if not exists(spark, path):
        return []
    names = [s.getPath().getName() for s in _fs(spark, path).listStatus(_path(spark, path))]
    return sorted(int(n.removeprefix(POINTER)) for n in names if n.startswith(POINTER) and n.removeprefix(POINTER).isdigit())


def _publish(spark: SparkSession, path: str, version: str, number: int) -> bool:
    """Make `version` the pointer of that number, unless one has it already.

    The pointer is written beside under a name that readers pass over, closed, and renamed without overwriting.
    """
    beside = _path(spark, f"{path}/.{version}")
    out = _fs(spark, path).create(beside, False)
    out.write(bytearray(version, "ascii"))
    out.close()
    jvm = spark._jvm
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_fs(spark, path).getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(beside, _path(spark, f"{path}/{POINTER}{number:012d}"), options)
    except Py4JJavaError as failed:
        _fs(spark, path).delete(beside, False)
        if failed.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
            raise
        return False
    return True


def write_snapshot(df: DataFrame, path: str, partition_by: Sequence[str] = (), expected: str | None = None) -> str:
    """Replace a table whole or not at all; the name of the new version.

    Each version is a folder of its own under `path`. Small numbered files point at versions, the highest number is the
    current one, and none is ever rewritten: a writer that dies at any moment leaves the table as it was. With
    `expected`, the version that the rows were made from, the switch happens only if that is still the current one, and
    raises `SnapshotConflict` if not, so of two writers that start from one version neither is lost unnoticed. Without it
    the later writer wins. Needs a file system whose rename is atomic. Earlier versions stay until `drop_versions`.
    """
    spark = df.sparkSession
    number = max(_pointers(spark, path), default=0)
    if expected is not None and current_version(spark, path) != expected:
        raise SnapshotConflict(f"{path} is no longer at {expected}")
    version = f"v-{uuid.uuid4().hex}"
    writer = df.write.mode("error")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/{version}")
    while not _publish(spark, path, version, number + 1):
        if expected is not None:
            raise SnapshotConflict(f"{path} is no longer at {expected}")
        number += 1
    return version


def current_version(spark: SparkSession, path: str) -> str | None:
    """The folder name of a snapshot's current version; none where nothing was written whole."""
    numbers = _pointers(spark, path)
    if not numbers:
        return None
    return spark.read.text(f"{path}/{POINTER}{numbers[-1]:012d}").first()["value"]


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a snapshot."""
    version = current_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"no snapshot at {path}")
    return spark.read.parquet(f"{path}/{version}")


def drop_versions(spark: SparkSession, path: str) -> None:
    """Remove all versions of a snapshot but the current one, and the pointers to them. No writer may be at work."""
    fs, numbers, version = _fs(spark, path), _pointers(spark, path), current_version(spark, path)
    for number in numbers[:-1]:
        fs.delete(_path(spark, f"{path}/{POINTER}{number:012d}"), False)
    for status in fs.listStatus(_path(spark, path)):
        if status.isDirectory() and status.getPath().getName() != version:
            fs.delete(status.getPath(), True)


def overwrite_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replace only the partitions the rows fall in."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)
