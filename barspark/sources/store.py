"""Partitioned tables that are replaced as a whole.

Data files are never changed. A commit writes the partitions it replaces under a version
of its own, then a list of all partitions with the version each now has, then one small
snapshot file that names the list. Snapshots are numbered; creating the next number
fails if it exists. So a reader sees the table before a commit or after it, and of two
writers that began on the same snapshot the second fails without a trace. Versions and
lists that none of the newest ``KEPT`` snapshots names are removed after a commit: a
reader may be that many commits behind.

The folder must be on a file system that creates a file only if it is not there (a local
one or HDFS; object stores need a conditional put).
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEPT = 3
VERSION = "version"


class Conflict(RuntimeError):
    """Another writer has committed since this one read the table."""


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _numbers(spark: SparkSession, root: str) -> list[int]:
    system, where = _folder(spark, f"{root}/snapshots")
    if not system.exists(where):
        return []
    return sorted(int(f.getPath().getName()) for f in system.listStatus(where) if f.getPath().getName().isdigit())


def newest(spark: SparkSession, root: str) -> int:
    """Number of the newest snapshot, 0 if there is none."""
    return max(_numbers(spark, root), default=0)


def _list_of(spark: SparkSession, root: str, number: int) -> str:
    return spark.read.text(f"{root}/snapshots/{number:020d}").first()[0]


def _listed(spark: SparkSession, root: str, number: int, partitions: tuple[str, ...]) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*partitions, VERSION)])
    return spark.read.schema(schema).parquet(f"{root}/lists/{_list_of(spark, root, number)}")


def read(spark: SparkSession, root: str, schema: T.StructType, partitions: tuple[str, ...], number: int | None = None, **only: str | None) -> DataFrame:
    """The table as of a snapshot (default: the newest); ``only`` names partition values to read."""
    number = newest(spark, root) if number is None else number
    if not number:
        raise FileNotFoundError(f"no snapshot under {root}")
    listed = _listed(spark, root, number, partitions)
    data = spark.read.schema(T.StructType([*schema.fields, T.StructField(VERSION, T.StringType())])).parquet(f"{root}/data")
    for name, value in only.items():
        if value is not None:
            listed, data = listed.filter(F.col(name) == value), data.filter(F.col(name) == value)
    live = [r[0] for r in listed.select(VERSION).distinct().collect()]  # at most one per commit that still counts
    return data.filter(F.col(VERSION).isin(live)).join(listed, [*partitions, VERSION], "left_semi").select(*schema.names)


def commit(rows: DataFrame, root: str, partitions: tuple[str, ...], sort: str, base: int) -> int:
    """Replace exactly the partitions present in ``rows``, on top of snapshot ``base``; the new snapshot's number."""
    spark, version = rows.sparkSession, uuid4().hex
    path = f"{root}/data/{VERSION}={version}"
    dealt = rows.repartition(*partitions).sortWithinPartitions(*partitions, sort)
    dealt.write.partitionBy(*partitions).parquet(path)
    system, where = _folder(spark, path)
    made = None
    if any(f.isDirectory() for f in system.listStatus(where)):
        text = T.StructType([T.StructField(c, T.StringType()) for c in partitions])
        made = spark.read.schema(T.StructType([*[f for f in rows.schema.fields if f.name not in partitions], *text.fields])).parquet(path)
        made = made.select(*partitions).distinct().withColumn(VERSION, F.lit(version))
    old = _listed(spark, root, base, partitions) if base else None
    if made is None and old is None:
        made = spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in (*partitions, VERSION)]))
    if made is None:
        return base
    every = made if old is None else made.unionByName(old.join(made, list(partitions), "left_anti"))
    every.write.parquet(f"{root}/lists/{version}")
    snapshots, target = _folder(spark, f"{root}/snapshots/{base + 1:020d}")
    try:
        out = snapshots.create(target, False)  # the one step that makes the commit visible
    except Exception as taken:  # noqa: BLE001
        for left in (path, f"{root}/lists/{version}"):
            system, where = _folder(spark, left)
            system.delete(where, True)
        raise Conflict(f"snapshot {base + 1} of {root} exists") from taken
    out.write(bytearray(version.encode()))
    out.close()
    _expire(spark, root, partitions)
    return base + 1


def _expire(spark: SparkSession, root: str, partitions: tuple[str, ...]) -> None:
    numbers = _numbers(spark, root)
    kept, old = numbers[-KEPT:], numbers[:-KEPT]
    if not old:
        return
    live = set()
    for number in kept:
        live |= {r[0] for r in _listed(spark, root, number, partitions).select(VERSION).distinct().collect()}
    lists = {_list_of(spark, root, n) for n in kept}
    for number in old:
        gone = _list_of(spark, root, number)
        dead = {r[0] for r in _listed(spark, root, number, partitions).select(VERSION).distinct().collect()} - live
        for path in [f"{root}/snapshots/{number:020d}", *[f"{root}/data/{VERSION}={v}" for v in dead], *([] if gone in lists else [f"{root}/lists/{gone}"])]:
            system, where = _folder(spark, path)
            system.delete(where, True)
