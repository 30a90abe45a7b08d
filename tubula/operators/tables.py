"""Durable intermediate tables, and joins to tables of a row per study."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that is sent to every task; larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Rows of a row group in files of bricks: a task that reads such files holds the arrays of a whole group.
BRICK_ROWS = 16
#: The tables written for the finished() that is at work.
_written: ContextVar[list | None] = ContextVar("written", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; where that is unset, a temporary one on a local master
    and an error on any other."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or getattr(spark, "_own_tables_dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = spark._own_tables_dir = tempfile.mkdtemp(prefix="spark-")
    return folder.rstrip("/")


def settled(df: DataFrame, bricks: bool = False) -> DataFrame:
    """df written to the shared folder and read back: its lineage ends there. The files go when the driver ends, or by released().

    Files of voxels are a few bits a row, so that a join would take them for small by their bytes: with more than BROADCAST_ROWS rows
    (told by the files' footers) the table is one that joins do not send to every task. Files of `bricks` have few rows a row group."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    (brick_writer(df) if bricks else df.write).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    return noted(wide(table) if table.count() > BROADCAST_ROWS else table, path)


def brick_writer(df: DataFrame) -> DataFrameWriter:
    """A writer of Parquet files with BRICK_ROWS rows a row group: arrays of few values pack so well that a group would have thousands."""
    return df.write.format("parquet").option("parquet.block.row.count.limit", BRICK_ROWS)


def wide(df: DataFrame) -> DataFrame:
    """df for joins that sort and merge: its rows are many more than what it is made from tells, and no task may hold them all."""
    return df.hint("merge")


def noted(table: DataFrame, path: str, name: str | None = None) -> DataFrame:
    """A table that was written to path, under a name or not: it goes when the driver ends, or by released()."""
    spark = table.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    table._settled_path, table._settled_name = path, name
    if (written := _written.get()) is not None:
        written.append(table)
    return table


def released(*tables: DataFrame) -> None:
    """Deletes tables that settled() wrote and that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        if t._settled_name:
            spark.sql(f"DROP TABLE IF EXISTS {t._settled_name}")
        where = spark._jvm.org.apache.hadoop.fs.Path(t._settled_path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def finished(work: Callable[[], DataFrame], write: Callable[[DataFrame], DataFrame] = settled) -> DataFrame:
    """What work() returns, written; the tables that were written on the way are deleted, after a failure too."""
    outer, own, out = _written.get(), [], None
    token = _written.set(own)
    try:
        out = write(work())
    finally:
        _written.reset(token)
        released(*(t for t in own if t is not out))
    if outer is not None:
        outer.append(out)
    return out


def with_study(rows: DataFrame, table: DataFrame, *on: str) -> DataFrame:
    """rows inner-joined to a table of a row per study (or per `on`), which is sent to every task if it is small enough, so that a
    study's rows stay where they are."""
    table = settled(table)
    few = table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(table) if few else table, list(on or ("study",)))


#: A key with more than one HOT_SHARE-th of all rows is joined by broadcast; there are fewer than HOT_SHARE such keys.
HOT_SHARE = 512


def with_least(rows: DataFrame, key: str, value: str) -> DataFrame:
    """rows with m, the least `value` of their key. Rows of a key that has very many stay where they are."""
    least = settled(rows.groupBy(key).agg(F.min(value).alias("m"), F.count("*").alias("n_")))
    total = least.agg(F.coalesce(F.sum("n_"), F.lit(0))).first()[0]
    hot = F.col("n_") * HOT_SHARE > total
    few = F.broadcast(least.where(hot).select(key, "m"))
    return rows.join(few, key).unionByName(rows.join(few.select(key), key, "left_anti").join(least.where(~hot).select(key, "m"), key))
