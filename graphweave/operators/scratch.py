"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a session in one process (local tests) uses a temporary folder of its own; a cluster
    fails rather than write where other executors cannot read.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = tempfile.mkdtemp(prefix="spark-graphweave-")
    return _own_folders[app]


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet into the shared folder and read it again.

    The files outlive lost executors. ``discard`` deletes them once what is made of them is written itself;
    the tables that a result is read from stay, and whoever owns the shared folder clears those.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/graphweave-{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._gw_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete the files of ``written`` tables that nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._gw_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(table: DataFrame) -> None:
    """Let go of the shuffle files of what is written: Spark deletes them once the driver has collected the plans that held them, which in a long loop it may not do by itself."""
    table.sparkSession._jvm.System.gc()


def state_of(df: DataFrame) -> tuple:
    """Count and order-free hashes of the rows: equal for equal tables, and differing (but for a chance in 2^64) for others."""
    a, b = F.xxhash64(F.struct("*")), F.xxhash64(F.lit(1), F.struct("*"))
    return tuple(df.agg(F.count("*"), F.bit_xor(a), F.sum(b.cast("decimal(38,0)"))).first())


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_sum(df: DataFrame, order: list[str], value: str | list[str], out: str | list[str]) -> DataFrame:
    """Add ``out``, the sum of ``value`` over all rows up to and with this one in the order given; with lists, several sums at once.

    Rows are range-sorted and written once with their range's number; the ranges' totals (one row
    per range, as many as shuffle partitions) give each range its base, so no task sees more than a
    range. ``order`` should be total; rows equal in it are told apart arbitrarily but consistently,
    which only matters if they differ elsewhere. Nulls in ``value`` count 0.
    """
    sums = list(zip([value], [out])) if isinstance(value, str) else list(zip(value, out))
    n = shuffle_partitions(df.sparkSession)
    ranged = df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id())
    ranged = written(ranged, "ranges")
    counted = lambda v: F.sum(F.coalesce(F.col(v), F.lit(0)))
    totals = ranged.groupBy("_range").agg(*[counted(v).alias(f"_total_{o}") for v, o in sums])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_range", *[F.coalesce(F.sum(f"_total_{o}").over(before), F.lit(0)).alias(f"_base_{o}") for _, o in sums])
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.join(F.broadcast(bases), "_range")
    for v, o in sums:
        summed = summed.withColumn(o, F.col(f"_base_{o}") + counted(v).over(within))
    return summed.drop("_range", *[f"_base_{o}" for _, o in sums])


def numbered(df: DataFrame, order: list[str], out: str = "place") -> DataFrame:
    """Add ``out``, each row's number from 1 in a total order; no task sees more than a range of the rows."""
    return running_sum(df.withColumn("_one", F.lit(1).cast("long")), order, "_one", out).drop("_one")
