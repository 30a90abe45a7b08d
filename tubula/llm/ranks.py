"""Exact ranks within groups by histograms of key digits, without a sort of everything and without a large window.

Keys are binary, of one length. From the digits that all keys share on, the histogram of the keys' first digits is refined digit by
digit until no prefix has more than WIDE rows. Running sums within each parent prefix, of 256 digits at most, then give each prefix
the number of rows before it, and a window of WIDE rows each row's own. However many rows a group has, no task gets them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

#: Rows of one prefix that a window sorts.
WIDE = 256


def ordered_long(column):
    """A long as 9 bytes that sort as the numbers do, null first."""
    bits = F.lpad(F.hex(column.bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    return F.coalesce(F.concat(F.lit(b"\x01"), F.unhex(bits)), F.lit(b"\x00" * 9))


def ranked(rows: DataFrame) -> DataFrame:
    """rows(group, key, n, ...), one per group and key, which stand for n equal ones -> with `before`, the sum of n over the group's
    rows with smaller keys, and `total`, over all of the group's. Read several times: a written table. Neither column is null."""
    low, high = rows.agg(F.min("key"), F.max("key")).first()
    if low is None:
        return rows.withColumns({"before": F.lit(0).cast("long"), "total": F.lit(0).cast("long")})
    same = next((i for i, (a, b) in enumerate(zip(low, high, strict=True)) if a != b), len(low))
    head = lambda p, of="key": F.substring(of, 1, p)
    at, fine = same, None
    while True:
        fine = cut(rows.groupBy("group", head(at).alias("prefix")).agg(F.sum("n").alias("n"), F.count("*").alias("rows")), "histogram")
        if fine.agg(F.max("rows")).first()[0] <= WIDE or at == len(low):
            break
        at += 1
    levels = {at: fine}
    for p in range(at - 1, same - 1, -1):
        levels[p] = cut(levels[p + 1].groupBy("group", head(p, "prefix").alias("prefix")).agg(F.sum("n").alias("n")), "histogram")
    before = lambda *by: F.coalesce(F.sum("n").over(W.partitionBy("group", *by).orderBy("digit").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = levels[same].select("group", "prefix", F.lit(0).cast("long").alias("before"), F.col("n").alias("total"))
    for p in range(same + 1, at + 1):
        own = levels[p].select("group", F.col("prefix").alias("digit"), head(p - 1, "prefix").alias("prefix"), "n")
        own = own.withColumn("inside", before("prefix"))
        offsets = own.join(offsets, ["group", "prefix"]).select("group", F.col("digit").alias("prefix"), (F.col("before") + F.col("inside")).alias("before"), "total")
    offsets = cut(offsets, "offsets")
    own = rows.withColumns({"digit": F.col("key"), "prefix": head(at)}).withColumn("inside", before("prefix"))
    return own.join(offsets, ["group", "prefix"]).withColumn("before", F.col("before") + F.col("inside")).drop("digit", "prefix", "inside")
