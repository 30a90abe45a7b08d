"""Volumes, centrelines and graphs derived from the driver's tables, in Spark and as SQL for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A volume per label; each vector is an 8 x 8 slice."""
    z = F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("study"), z.alias("z"), "embedding")
    rows = rows.select("study", "z", F.posexplode("embedding").alias("pos", "v"))
    return rows.select("study", "z", F.floor(F.col("pos") / 8).cast("int").alias("y"), (F.col("pos") % 8).alias("x"), F.col("v").cast("double").alias("v"))


def grey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vox with values of 0 to 255."""
    return vox(spark, sf_dir).withColumn("v", F.floor(F.least(F.lit(255.0), F.abs("v") * 400)).cast("int"))


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vox(spark, sf_dir).where("v > 0.18").select("study", "z", "y", "x")


def centreline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A branch per user, a point per event."""
    idx = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("branch_id"), idx.alias("idx"), (1 + F.col("value") / 20).alias("br"), (0.4 + e % 60 / 100).alias("si"), (e % 7 - 2).cast("double").alias("k"),
        (e % 31).cast("int").alias("x"), (e % 29).cast("int").alias("y"), (e % 23).cast("int").alias("z"), (1 + e % 5).cast("double").alias("radius"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ternary tree over order keys."""
    o = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").where("o_orderkey > 0").select(o.alias("u"), F.floor(o / 3).alias("v"), (F.col("o_totalprice") / 50000).alias("length_mm"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One volume of 32 x 32 pixels a slice, every pixel present; each slice has half the quantities of 2,048 orders."""
    lines = table(spark, sf_dir, "lineitem")
    sums = lines.groupBy(F.floor(F.col("l_orderkey") / 2048).alias("z"), (F.col("l_suppkey") % 32).alias("y"), (F.col("l_partkey") % 32).alias("x")).agg(F.sum("l_quantity").alias("q"))
    slices = lines.agg(F.floor(F.max("l_orderkey") / 2048).alias("last")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("z"))
    every = slices.select("z", F.explode(F.sequence(F.lit(0), F.lit(1023))).alias("id")).select("z", F.floor(F.col("id") / 32).alias("y"), (F.col("id") % 32).cast("long").alias("x"))
    v = F.least(F.lit(255), (F.coalesce("q", F.lit(0.0)) / 2).cast("int"))
    return every.join(sums, ["z", "y", "x"], "left").select(F.lit(1).alias("study"), *(F.col(a).cast("int").alias(a) for a in "zyx"), v.alias("v"))


def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As images, with the quantities of every third line of an order as red, green and blue."""
    lines = table(spark, sf_dir, "lineitem")
    part = lambda k: F.sum(F.when(F.col("l_linenumber") % 3 == k, F.col("l_quantity"))).alias("rgb"[k])
    sums = lines.groupBy(F.floor(F.col("l_orderkey") / 2048).cast("int").alias("z"), (F.col("l_suppkey") % 32).cast("int").alias("y"), (F.col("l_partkey") % 32).cast("int").alias("x")).agg(part(0), part(1), part(2))
    every = images(spark, sf_dir).select("study", "z", "y", "x")
    return every.join(sums, ["z", "y", "x"], "left").select("study", "z", "y", "x", *(F.least(F.lit(255), F.coalesce(c, F.lit(0.0)).cast("int")).alias(c) for c in "rgb"))


def axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path through all slices of each volume of vox, with fixed frames; it swings to and fro across the slices, 19 points each way."""
    i = F.col("i")
    slices = table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("study")).agg(F.count("*").alias("n"))
    last = F.greatest(F.lit(0), F.ceil((F.col("n") - 1 - 2.0213) / 1.49)).cast("int")
    rows = slices.select("study", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    across = F.abs((i + 19) % 38 - 19)
    vec = lambda *v: F.array(*(F.lit(c) for c in v))
    return rows.select("study", F.col("study").alias("branch_id"), "i", (1.0331 + across * 0.31).alias("x"), (3.4717 + across * 0.11).alias("y"), (2.0213 + i * 1.49).alias("z"), vec(0.8, 0.6, 0.0).alias("normal"), vec(0.0, 0.0, 1.0).alias("binormal"))


def phantom(spark: SparkSession, ball: bool = True, middle: int = 17, size: int = 20) -> DataFrame:
    """A tube of radius 3 along z through 32 x 25 x 32 voxels, with a ball of squared radius `size` at its side, or around it."""
    rows = spark.range(32 * 25 * 32).select(F.lit(1).alias("study"), *(c.cast("int").alias(a) for a, c in (("z", F.floor(F.col("id") / 800)), ("y", F.floor(F.col("id") / 32 % 25)), ("x", F.col("id") % 32))))
    inside = "(x - 12) * (x - 12) + (y - 12) * (y - 12) <= 9" + (f" OR (x - {middle}) * (x - {middle}) + (y - 12) * (y - 12) + (z - 16) * (z - 16) <= {size}" if ball else "")
    return rows.withColumn("v", F.expr(f"CASE WHEN {inside} THEN 255 ELSE 0 END"))


def tubes(spark: SparkSession, sf_dir: str, middle: int = 12, size: int = 30) -> DataFrame:
    """A volume per label, 25 x 32 voxels a slice and a slice per vector: a tube of radius 3 along all slices with a ball of squared
    radius `size` around it, or at its side; the vectors give the noise, and their numbers the ball's slice: (..., v, inside, ball)."""
    label = W.partitionBy("label")
    z = F.row_number().over(label.orderBy("vec_id")) - 1
    vectors = table(spark, sf_dir, "embeddings").where("label IS NOT NULL")
    ball = 10 + F.sum("vec_id").over(label) % F.greatest(F.lit(1), F.count("*").over(label) - 20)
    # Slices are dealt out before their voxels are made: a join to a row per label could make all of a study's from that one row.
    rows = vectors.select("label", z.alias("z"), ball.cast("int").alias("ball"), "embedding").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "label", "z")
    rows = rows.select(F.col("label").alias("study"), "z", "ball", "embedding", F.explode(F.sequence(F.lit(0), F.lit(799))).alias("p"))
    rows = rows.select("study", "z", F.floor(F.col("p") / 32).cast("int").alias("y"), (F.col("p") % 32).alias("x"), "ball", "embedding")
    noise = F.floor(F.abs(F.expr("element_at(embedding, (y * 8 + x) % 64 + 1)")).cast("double") * 1000) % 11
    inside = F.expr(f"(x - 12) * (x - 12) + (y - 12) * (y - 12) <= 9 OR (x - {middle}) * (x - {middle}) + (y - 12) * (y - 12) + CAST(z - ball AS BIGINT) * (z - ball) <= {size}")
    return rows.select("study", "z", "y", "x", (20 + F.when(inside, 178.5).otherwise(0.0) + noise).alias("v"), inside.alias("inside"), "ball")


VOX = """vox AS (SELECT study, z, (i - 1) // 8 AS y, (i - 1) % 8 AS x, CAST(e[i] AS DOUBLE) AS v FROM (
  SELECT label AS study, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS z, embedding AS e FROM embeddings), range(1, 65) t(i))"""
GREY = VOX + """, grey AS (SELECT study, z, y, x, CAST(floor(least(255e0, abs(v) * 400)) AS INT) AS v FROM vox)"""
MASK = VOX + """, mask AS (SELECT study, z, y, x FROM vox WHERE v > 0.18)"""
CENTRELINE = """centreline AS (SELECT user_id AS branch_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx, 1 + value / 20 AS br,
  0.4e0 + (event_id % 60) / 100e0 AS si, CAST(event_id % 7 - 2 AS DOUBLE) AS k, event_id % 31 AS x, event_id % 29 AS y, event_id % 23 AS z, CAST(1 + event_id % 5 AS DOUBLE) AS radius FROM events)"""
EDGES = """edges AS (SELECT o_orderkey AS u, o_orderkey // 3 AS v, o_totalprice / 50000 AS length_mm FROM orders WHERE o_orderkey > 0)"""
IMAGES = """images AS (SELECT 1 AS study, CAST(iz AS INT) AS z, CAST(id // 32 AS INT) AS y, CAST(id % 32 AS INT) AS x, least(255, CAST(trunc(coalesce(q, 0) / 2e0) AS INT)) AS v
  FROM (SELECT unnest(range(max(l_orderkey) // 2048 + 1)) AS iz FROM lineitem) CROSS JOIN range(1024) r(id)
  LEFT JOIN (SELECT l_orderkey // 2048 AS pz, l_suppkey % 32 AS py, l_partkey % 32 AS px, sum(l_quantity) AS q FROM lineitem GROUP BY ALL) ON pz = iz AND py = id // 32 AND px = id % 32)"""
COLOURS = IMAGES + """, colours AS (SELECT study, z, y, x, least(255, CAST(trunc(coalesce(qr, 0)) AS INT)) AS r, least(255, CAST(trunc(coalesce(qg, 0)) AS INT)) AS g, least(255, CAST(trunc(coalesce(qb, 0)) AS INT)) AS b FROM images
  LEFT JOIN (SELECT l_orderkey // 2048 AS cz, l_suppkey % 32 AS cy, l_partkey % 32 AS cx, sum(l_quantity) FILTER (l_linenumber % 3 = 0) AS qr, sum(l_quantity) FILTER (l_linenumber % 3 = 1) AS qg, sum(l_quantity) FILTER (l_linenumber % 3 = 2) AS qb FROM lineitem GROUP BY ALL) ON cz = z AND cy = y AND cx = x)"""
AXIS = """axis AS (SELECT study, study AS branch_id, CAST(i AS INT) AS i, 1.0331e0 + abs((i + 19) % 38 - 19) * 0.31e0 AS x, 3.4717e0 + abs((i + 19) % 38 - 19) * 0.11e0 AS y, 2.0213e0 + i * 1.49e0 AS z FROM (
  SELECT study, unnest(range(CAST(greatest(0, ceil((n - 1 - 2.0213e0) / 1.49e0)) AS BIGINT) + 1)) AS i FROM (SELECT label AS study, count(*) AS n FROM embeddings GROUP BY label)))"""
