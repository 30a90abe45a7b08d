"""Shared pieces of the training-data operators: durable intermediate tables and skew-proof lookups."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Deletes every byte of [\x20\x09-\x0D]; words are what stands between these.
SPACES = ("\t", "\n", "\x0b", "\x0c", "\r", " ")
WORD = r"[^\x20\x09-\x0D]+"
#: A key that holds more than 1/HOT_SHARE of the rows is joined by broadcast; there are fewer than HOT_SHARE such keys.
HOT_SHARE = 512
#: The tables that cut() wrote for the settled() that is at work.
_written: ContextVar[list | None] = ContextVar("written", default=None)
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from spark.checkpoint.dir; where that is unset, a temporary one on a local
    master and an error on any other, whose executors would not see it."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or getattr(spark, "_own_shared_dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = spark._own_shared_dir = tempfile.mkdtemp(prefix="spark-")
    return folder.rstrip("/")


def quoted(column: str) -> str:
    """The name as SQL takes it, whatever its characters."""
    return f"`{column.replace('`', '``')}`"


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores before those that any of the columns has, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def cut(df: DataFrame, name: str, bucket: str | None = None, level: int = 3, buckets: int | None = None, onto: DataFrame | None = None) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there, so that a lost executor costs no
    recomputation, and every reader sees the same rows. The files go when the driver's JVM exits, or by drop().

    While it writes, the session cleans up shuffle files behind finished queries, others too; the setting is put back after.

    With a column as `bucket` the table is bucketed by it, by default into the session's number of shuffle partitions, so that grouping or joining by that column needs no shuffle.
    Each task writes a file for each bucket it has rows of: for tables of few rows a task, or dealt out by the column.
    With `onto`, a table bucketed in the same way, the rows are added to that one, and it is read anew."""
    spark = df.sparkSession
    path, table = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", None
    if onto is not None:
        path = onto._cut_path
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # the shuffle files behind a table that is written are of no more use
    try:
        to = df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level))
        if bucket:
            table = f"{name}_{uuid.uuid4().hex}" if onto is None else onto._cut_table
            to.mode("error" if onto is None else "append").option("path", path).bucketBy(buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), bucket).format("parquet").saveAsTable(table)
        else:
            to.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.table(table) if bucket else spark.read.schema(df.schema).parquet(path)
    out._cut_path, out._cut_table = path, table
    if (tables := _written.get()) is not None:
        tables.append(out)
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that cut() wrote and that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        if t._cut_table:
            spark.sql(f"DROP TABLE IF EXISTS {t._cut_table}")
        where = spark._jvm.org.apache.hadoop.fs.Path(t._cut_path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def settled(work: Callable[[], DataFrame], name: str, level: int = 3) -> DataFrame:
    """What work() returns, written by cut(); the tables that were written on the way are deleted, after a failure too."""
    outer, own, out = _written.get(), [], None
    token = _written.set(own)
    try:
        out = cut(work(), name, level=level)
    finally:
        _written.reset(token)
        drop(*(t for t in own if t is not out))
    if outer is not None:
        outer.append(out)
    return out


def lookup_join(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """rows inner-joined to table, which has one row per key and in `weight` the number of rows with that key.

    As the weights sum to `total` at most, fewer than HOT_SHARE keys can weigh over total / HOT_SHARE: those are broadcast,
    so that no task gets all rows of a hot key. The others are joined by a shuffle, whatever their number. Keys aren't null.
    """
    is_hot = F.col(weight) * HOT_SHARE > total
    hot, cold = table.where(is_hot), table.where(~is_hot)
    few = F.broadcast(hot.select(*keys))
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(few, keys, "left_anti").join(cold, keys))


def hot_keys(rows: DataFrame, key: str, total: int) -> DataFrame | None:
    """(key_, parts_) of the keys, fewer than HOT_SHARE, that have more than one HOT_SHARE-th of the `total` rows each, with the
    number of parts in which none has more; None if there is none. Inputs of few rows have none to speak of."""
    if total < 1 << 14:
        return None
    parts = F.ceil(F.col("n") * HOT_SHARE / total).cast("int").alias("parts_")
    hot = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") * HOT_SHARE > total).select(F.col(key).alias("key_"), parts).collect()
    return rows.sparkSession.createDataFrame(hot, f"key_ {rows.schema[key].dataType.simpleString()}, parts_ int") if hot else None


def spread_join(rows: DataFrame, table: DataFrame, key: str, by: str, hot: DataFrame | None) -> DataFrame:
    """rows inner-joined to table, which has few rows per key, however wide. The rows of a hot key are dealt over its parts by the
    column `by`, and the table's row goes to each part; nothing but the hot keys with their numbers of parts is broadcast, so that
    small inputs go the way of large ones."""
    if hot is None:
        return rows.join(table.hint("merge"), key)
    hot = F.broadcast(hot)
    part = F.coalesce(F.pmod(F.xxhash64(by), "parts_"), F.lit(0)).cast("int")
    dealt = rows.join(hot, F.col(key) == F.col("key_"), "left").withColumn("part_", part).drop("key_", "parts_")
    each = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts_") - 1, F.lit(0))))
    copies = table.join(hot, F.col(key) == F.col("key_"), "left").withColumn("part_", each).drop("key_", "parts_")
    return dealt.join(copies.hint("merge"), [key, "part_"]).drop("part_")


def squeezed(text):
    """The text without white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
