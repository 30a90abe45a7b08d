"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

A source's target divided by its size is the expected number of copies of each of its documents. The whole part is taken
as it is; the fractions are rounded by the pivotal method: two documents meet, one takes as much of the other's mass as
leaves one of them at 0 or 1, at random so that each keeps its expectation, and the other goes on. Mass is counted in
words (the fraction times the size), and its sum never changes, so a source ends within one document of its target; as
long documents go first and what is left of them meets short ones, that one is mostly short. Groups of about FAN
documents are folded at once, and what each leaves over meets the others' rest on the next level of a reduction tree,
whose depth is the logarithm of the number of documents.

Defined results: a null text has size 0; a null source is a source of its own, ranked last; sources of size 0 get target 0;
repeated rows are rounded one by one, numbered among themselves, so that rows of one id and size, or without an id, do not all
meet in one group; empty input gives no rows. Coin tosses are hashes of the doc_ids and numbers that meet, so reruns agree.
Other columns, whatever their names, are not read. The table of sources has a row per source, whose targets one task works out:
some million sources are fine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut, documents, drop, lookup_join, quoted, unused

WEIGHTS, SHARE, CAP, FAN, SEED = (3, 1, 2), 1.5, 2.0, 64, 20
#: Sizes within a factor of 2 ** (1 / BINS) are in one bin.
BINS = 4
EPS = 1e-9
ITEM = "struct<size:bigint,h:bigint,doc_id:bigint,whole:int,p:double,source_size:bigint,target:double>"
FIELDS = [f.split(":")[0] for f in ITEM[7:-1].split(",")]


def targets(sizes: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """sizes(source_key, source, source_size) with target: `share` of all sizes by weight, none above cap times its size.

    Giving what is above a cap to the others by weight, again and again, ends with target = least(cap * size, level *
    weight) for one level. In order of cap * size / weight, sources are at their cap until that is above the level that
    the rest could have. The table has one row per source, so its windows are small.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (rank % len(weights) + 1).cast("int"))
    by = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(cap))
    order = W.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    before, after, every = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing), W.partitionBy()
    left = F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    by = by.withColumn("level", left / F.sum("weight").over(after))
    by = by.withColumn("level", F.max(F.when(F.col("most") > F.col("level") * F.col("weight"), F.col("level"))).over(every))
    target = F.coalesce(F.least("most", F.col("level") * F.col("weight")), "most")
    return by.select("source_key", "source_size", target.alias("target"))


def _fold() -> str:
    """SQL that lets the items of an array meet one after the other: struct(done: items with `extra` 0 or 1, carry: an item or null).

    carry and x hold p * size words each. Up, x gives words to carry until carry is at 1 or x at 0; down, the other way
    round. Tossing up with the chance down / (up + down) leaves both expectations as they were, and the words always.
    """
    done = ITEM[:-1] + ",extra:int>"

    def item(of: str, p: str = "", extra: str = "") -> str:
        body = ", ".join(f"'{f}', {p if f == 'p' and p else f'{of}.{f}'}" for f in FIELDS)
        return f"named_struct({body}{f', {chr(39)}extra{chr(39)}, {extra}' if extra else ''})"

    u = f"(xxhash64({SEED}, acc.carry.h, x.h, acc.carry.size) & 9007199254740991) / 9007199254740992D"
    up, down = "least((1 - acc.carry.p) * acc.carry.size, x.p * x.size)", "least(acc.carry.p * acc.carry.size, (1 - x.p) * x.size)"
    # y: the words that carry gets, and which of the two has come to an end.
    moved = f"named_struct('up', {up}, 'down', {down})"
    moved = f"element_at(transform(array({moved}), m -> IF({u} * (m.up + m.down) < m.down, named_struct('got', m.up, 'first', (1 - acc.carry.p) * acc.carry.size <= x.p * x.size, 'up', true), named_struct('got', -m.down, 'first', acc.carry.p * acc.carry.size <= (1 - x.p) * x.size, 'up', false))), 1)"
    ended = f"IF(y.first, {item('acc.carry', '', 'int(y.up)')}, {item('x', '', 'int(NOT y.up)')})"
    goes_on = f"IF(y.first, {item('x', 'x.p - y.got / x.size')}, {item('acc.carry', 'acc.carry.p + y.got / acc.carry.size')})"
    meet = f"element_at(transform(array({moved}), y -> named_struct('done', concat(acc.done, array({ended})), 'carry', {goes_on})), 1)"
    step = f"CASE WHEN acc.carry IS NULL THEN named_struct('done', acc.done, 'carry', x) ELSE {meet} END"
    settle = f"CASE WHEN acc.carry.p < {EPS} OR acc.carry.p > 1 - {EPS} THEN named_struct('done', concat(acc.done, array({item('acc.carry', '', 'int(acc.carry.p > 0.5)')})), 'carry', CAST(NULL AS {ITEM})) ELSE acc END"
    return f"aggregate(items, named_struct('done', CAST(array() AS array<{done}>), 'carry', CAST(NULL AS {ITEM})), (acc, x) -> {step}, acc -> {settle})"


def mix(docs: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """A row per document: doc_id, source, size, source_size, target, copies."""
    key = F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("+"), "source"))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("source_key"), size.alias("size"))
    rows = rows.groupBy("doc_id", "source_key", "size").agg(F.count("*").alias("same"))  # equal rows are counted before they are dealt
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("same")))).drop("same")
    rows = cut(rows.withColumn("bin", F.floor(F.log2(F.col("size") + 1) * BINS).cast("int")), "sizes")
    cells = cut(rows.groupBy("source_key", "bin").agg(F.count("*").alias("n"), F.sum("size").alias("cell_size")), "cells")
    source = F.when(F.col("source_key") != "-", F.expr("substring(source_key, 2)")).alias("source")
    sizes = cells.groupBy("source_key").agg(F.sum("cell_size").alias("source_size")).select("source_key", source, "source_size")
    n_groups = F.ceil(F.col("n") / FAN)
    first = F.sum(n_groups).over(W.partitionBy("source_key").orderBy(F.desc("bin"))) - n_groups
    cells = cut(cells.join(targets(sizes, share, weights, cap), "source_key").withColumns({"n_groups": n_groups, "first": first}).drop("cell_size"), "cells")
    total, widest = cells.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max(F.col("first") + F.col("n_groups")), F.lit(0))).first()
    h = F.xxhash64(F.lit(SEED), "doc_id", "size", "copy")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = lookup_join(rows, cells, ["source_key", "bin"], "n", total).withColumns({"h": h, "whole": F.floor(rate).cast("int"), "p": rate - F.floor(rate)})
    rows = rows.withColumn("g", F.col("first") + F.pmod("h", "n_groups"))
    toss = f"int((xxhash64({SEED}, {{0}}h) & 9007199254740991) / 9007199254740992D < {{0}}p)"
    open_ = (F.col("p") > 0) & (F.col("size") > 0)
    out = [rows.where(~open_).select("source_key", *FIELDS, F.expr(toss.format("")).alias("extra"))]
    level = rows.where(open_).select("source_key", "g", F.struct(*FIELDS).alias("item"))
    while True:
        folded = level.groupBy("source_key", "g").agg(F.sort_array(F.collect_list("item"), asc=False).alias("items"))
        folded = cut(folded.select("source_key", "g", F.expr(_fold()).alias("f")).select("source_key", "g", "f.done", "f.carry"), "pivots")
        out.append(folded.select("source_key", F.explode("done").alias("d")).select("source_key", "d.*"))
        level = folded.where("carry IS NOT NULL").select("source_key", F.floor(F.col("g") / FAN).alias("g"), F.col("carry").alias("item"))
        if widest <= 1:
            break
        widest = -(-widest // FAN)
    out.append(level.select("source_key", "item.*", F.expr(toss.format("item.")).alias("extra")))
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    return every.select("doc_id", source, "size", "source_size", "target", (F.col("whole") + F.col("extra")).alias("copies"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, all columns, each as many times as mix() says."""
    names = unused(docs.columns, "size_", "id_", "source_", "n_size_", "n_", "copies_", "part_", "turn_", "copy_")
    size, i, source, n_size, n, copies, part, turn, copy = names
    words = F.coalesce(F.regexp_count(docs["text"], F.lit(WORD)), F.lit(0)).cast("long")
    taken = mix(docs, **how).groupBy("doc_id", "source", "size").agg(F.count("*").alias(n), F.sum("copies").alias(copies))
    taken = cut(taken.where(F.col(copies) > 0).withColumnsRenamed({"doc_id": i, "source": source, "size": n_size}), "taken")
    sized = docs.withColumn(size, words)
    rows = sized.join(taken.hint("merge"), sized["doc_id"].eqNullSafe(taken[i]) & sized["source"].eqNullSafe(taken[source]) & (sized[size] == taken[n_size]))
    if not taken.where(F.col(n) > 1).isEmpty():
        # Rows that share doc_id, source and size share their copies: each has a turn, by the task it is in and its place there.
        again = cut(rows.where(F.col(n) > 1).withColumn(part, F.spark_partition_id()), "again")
        inside = F.row_number().over(W.partitionBy(i, source, n_size, part).orderBy(F.sha2(F.coalesce("text", F.lit("")), 256)))
        before = F.sum(turn).over(W.partitionBy(i, source, n_size).orderBy(part).rowsBetween(W.unboundedPreceding, -1))
        parts = again.groupBy(i, source, n_size, part).agg(F.count("*").alias(turn)).select(F.struct(i, source, n_size, part).alias(copy), F.coalesce(before, F.lit(0)).alias(turn))
        again = again.withColumn(size, inside).join(parts, F.struct(i, source, n_size, part) == F.col(copy)).withColumn(turn, F.col(turn) + F.col(size))
        again = again.withColumn(copies, F.floor((F.col(copies) - F.col(turn)) / F.col(n)) + 1)
        rows = rows.where(F.col(n) == 1).select(*(F.col(quoted(c)) for c in docs.columns), copies).unionByName(again.select(*(F.col(quoted(c)) for c in docs.columns), copies))
    rows = rows.withColumn(copy, F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies)))).where(F.col(copy) > 0)
    return rows.select(*(F.col(quoted(c)) for c in docs.columns))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(documents(spark, sf_dir))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


QUERIES, ORACLES = {"op7_source_mix": op7_source_mix}, {}
