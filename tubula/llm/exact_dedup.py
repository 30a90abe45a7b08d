"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest, at a location of the caller's. A batch is reduced to its distinct digests,
those are sort-merge anti-joined to the index, and what is new is appended; the index side of the join is never shuffled.

A batch has a name, given by the caller. A batch that is run again, as after a failure, finds what it has added before under its
name, adds what is missing and gives the same rows.

With `revise` a digest's best row may come in a later batch: where that beats the one in the index, a further index row is
appended for it, and the best of a digest's rows counts. Without, the first batch that brings a digest keeps it.

Defined results: a null text counts as empty; texts of white space only are equal to it. Of equal texts the row with the
most code points stays, then the smallest doc_id, null last. Repeated rows (same doc_id, same number of code points, equal
text) are one group as well: one of them stays. Other columns, whatever their names, are not read. An empty batch leaves
the index as it is.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, drop, hot_keys, quoted, shared_dir, spread_join, squeezed, unused

INDEX = "digest string, keep_id bigint, keep_points int, batch string"
#: The best row of equal texts is the least of these.
RANK = "struct(-keep_points AS less, keep_id IS NULL AS none, keep_id AS id)"


def with_digest(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.sha2(squeezed(F.col("text")), 256).alias("digest"), F.char_length(F.coalesce("text", F.lit(""))).alias("points"))


class DigestIndex:
    """A table of all digests seen so far, with the row that stays for each.

    Its files lie under `path` (default: the shared folder, under the table's name), so that a session whose catalog doesn't know
    the table finds it again. `buckets` is fixed when the table is made (default: the session's shuffle partitions) and part of
    its location; size it for the index to come."""

    def __init__(self, spark: SparkSession, table: str, path: str | None = None, buckets: int | None = None):
        self.spark, self.table = spark, table
        self.path = (path or f"{shared_dir(spark)}/{table}").rstrip("/")
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        old = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
        old = [int(n.removeprefix("buckets=")) for n in old if n.startswith("buckets=")]
        if old and buckets not in (None, old[0]):
            raise ValueError(f"the index at {self.path} has {old[0]} buckets")
        self.buckets = old[0] if old else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({INDEX}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/buckets={self.buckets}'")

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def append(self, groups: DataFrame, batch: str, revise: bool = False) -> None:
        """groups: one row per digest. Those that the index lacks are added, in one file per bucket."""
        cols = ["digest", "keep_id", "keep_points"]
        groups = groups.select(*cols)
        fresh = groups.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        if revise:
            known = self.rows().select("digest", F.expr(RANK).alias("known"))
            better = groups.join(known.hint("merge"), "digest").groupBy(*cols).agg(F.min("known").alias("known")).where(f"{RANK} < known")
            fresh = fresh.unionByName(better.select(*cols))
        fresh = fresh.withColumn("batch", F.lit(batch)).repartition(self.buckets, "digest").sortWithinPartitions("digest")
        writer = fresh.write.bucketBy(self.buckets, "digest").sortBy("digest").mode("append").format("parquet").option("compression", "zstd")
        writer.option("path", f"{self.path}/buckets={self.buckets}").saveAsTable(self.table)
        self.spark.catalog.refreshTable(self.table)

    def add(self, docs: DataFrame, batch: str, revise: bool = False) -> Batch:
        """Adds the batch to the index."""
        keyed = cut(with_digest(docs).groupBy("digest", "doc_id", "points").agg(F.count("*").alias("copies")), "digests")
        best = F.min(F.struct((-F.col("points")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id")).alias("best")
        groups = keyed.groupBy("digest").agg(best)
        groups = cut(groups.select("digest", F.col("best.doc_id").alias("keep_id"), (-F.col("best.less")).cast("int").alias("keep_points")), "groups")
        self.append(groups, batch, revise)
        drop(groups)
        return Batch(batch, keyed)

    def results(self, *batches: Batch) -> DataFrame:
        """A row for each row of these batches: doc_id, digest, points, copies, keep_id, group_size (rows of these batches with that
        digest), kept (this row stays: it is the index's row, and the first of its copies)."""
        keyed = None
        for b in batches:
            rows = b.keyed.withColumn("own", F.lit(b.name))
            keyed = rows if keyed is None else keyed.unionByName(rows)
        index = self.rows().groupBy("digest").agg(F.min(F.struct(F.expr(RANK).alias("rank"), "batch")).alias("b"))
        index = index.select("digest", F.col("b.rank.id").alias("keep_id"), (-F.col("b.rank.less")).alias("keep_points"), F.col("b.batch").alias("batch"))
        groups = keyed.groupBy("digest").agg(F.sum("copies").alias("group_size")).join(index, "digest")
        out = spread_join(keyed, groups, "digest", "doc_id", hot_keys(keyed, "digest", keyed.count()))
        out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points")) & (F.col("copy") == 1) & (F.col("batch") == F.col("own"))
        return out.select("doc_id", "digest", "points", "keep_id", "group_size", "copies", kept.alias("kept"))

    def dedup(self, docs: DataFrame, batch: str) -> DataFrame:
        """Adds the batch; results() of it alone."""
        return self.results(self.add(docs, batch))

    def fresh(self, docs: DataFrame, batch: str) -> DataFrame:
        """Adds the batch; its rows, all columns, that stay. The index is not read any more after this."""
        d, p, *names = unused(docs.columns, "d_", "p_", "doc_id_", "digest_", "points_", "copies_")
        added = self.add(docs, batch)
        won = self.results(added).where("kept").select(*(F.col(c).alias(n) for c, n in zip(("doc_id", "digest", "points", "copies"), names, strict=True)))
        won = cut(won, "won")
        drop(added.keyed)
        keyed = docs.withColumns({d: F.sha2(squeezed(docs["text"]), 256), p: F.char_length(F.coalesce(docs["text"], F.lit("")))})
        same = keyed["doc_id"].eqNullSafe(won[names[0]]) & (keyed[d] == won[names[1]]) & (keyed[p] == won[names[2]])
        rows = keyed.join(won, same)
        # Repeated rows all match; of these, which are few or none, one stays.
        again = rows.where(F.col(names[3]) > 1).dropDuplicates(["doc_id", d, p])
        return rows.where(F.col(names[3]) == 1).unionByName(again).select(*(F.col(quoted(c)) for c in docs.columns))


class Batch:
    """What was added under a name: (digest, doc_id, points, copies)."""

    def __init__(self, name: str, keyed: DataFrame):
        self.name, self.keyed = name, keyed


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table arrives in two batches, so that the second is deduplicated against an index that holds the first."""
    docs = documents(spark, sf_dir)
    index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    late = F.coalesce(F.col("doc_id") % 2 != 0, F.lit(True))
    parts = [index.add(docs.where(~late), "first"), index.add(docs.where(late), "second", revise=True)]
    out = index.results(*parts).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))
    out = cut(out, "exact")
    index.drop()
    drop(*(b.keyed for b in parts))
    return out


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
r AS (SELECT doc_id, norm, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, row_number() OVER w AS place
      FROM d WINDOW w AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id ASC NULLS LAST))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""
QUERIES, ORACLES = {"op4_exact_dedup": op4_exact_dedup}, {"op4_exact_dedup": SQL}
