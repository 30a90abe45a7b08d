"""Merkle manifest of a dataset: a hash tree per source over its documents, and one over the sources, with a proof per document.

Leaves are ranked within their source by histograms of the digits of doc_id (see ranks). A rank written in digits of base FANOUT, as
many as the tree has levels, is a leaf's key in a trie: what stands under a prefix is a node's subtree. The longest prefixes are
reduced first, STEP digits at a time: nodes that agree in all but their last STEP digits are one group, at most FANOUT ** STEP of
them, whose levels are worked out in one row. Only groups are shuffled, each round FANOUT ** STEP times fewer. On the way back
each group hands its nodes the siblings above them, so that a proof is a group's own part and a shared one.

Defined results: leaves with a null doc_id come first in their source and are never tampered with; rows that share a doc_id go by
their leaf digests, and rows with equal leaves are interchangeable; a null source is a source of its own, before all others and
apart from the empty one; a single document is leaf, subroot and root at once, with an empty proof; an empty table gives no rows.
Columns other than the five hashed, whatever their names, are not read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, settled
from .ranks import ordered_long, ranked

FANOUT, STEP = 3, 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*fields: Column) -> Column:
    """Lowercase hex SHA-256 of the fields one after the other, each with its length, `-` for null."""
    marked = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*marked), 256)


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """tree (null first in the order of bytes), doc_id, leaf, forged: the digest with the text `tampered`, where that isn't null."""
    fields = [F.col(c) for c in FIELDS]
    forged = F.when(tampered.isNotNull(), digest(*fields[:-1], tampered)) if tampered is not None else F.lit(None).cast("string")
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    return docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), digest(*fields).alias("leaf"), forged.alias("forged"))


def _digits(rank: Column, total: Column) -> Column:
    """The rank in base FANOUT, with as many digits as the tree over `total` leaves has levels."""
    base = lambda x: F.conv(x.cast("string"), 10, FANOUT)
    return F.when(total == 1, "").otherwise(F.lpad(base(rank), F.length(base(total - 1)), "0"))


def _groups(nodes: DataFrame) -> DataFrame:
    """nodes(tree, digits, h, load) -> tree, prefix, steps, digits, loads, levels (the hashes of each level in the group), top."""
    prefix = F.expr(f"substring(digits, 1, greatest(length(digits) - {STEP}, 0))")
    steps = F.length("digits") - F.length("prefix")
    rows = nodes.withColumn("prefix", prefix).groupBy("tree", "prefix", steps.alias("steps"))
    rows = rows.agg(F.sort_array(F.collect_list(F.struct("digits", "h", "load"))).alias("nodes"))
    rows = rows.select("tree", "prefix", "steps", F.col("nodes.digits").alias("digits"), F.col("nodes.load").alias("loads"), F.array("nodes.h").alias("leaves"))
    runs = f"transform(sequence(0, (size(a[k]) - 1) div {FANOUT}), i -> sha2(array_join(slice(a[k], i * {FANOUT} + 1, {FANOUT}), ''), 256))"
    rows = rows.withColumn("levels", F.expr(f"aggregate(sequence(0, {STEP - 1}), leaves, (a, k) -> concat(a, array(IF(k < steps, {runs}, a[k]))))"))
    return rows.drop("leaves").withColumn("top", F.expr(f"levels[{STEP}][0]"))


def _reduced(nodes: DataFrame) -> list[DataFrame]:
    """The groups of all trees, round by round; those with an empty prefix are the trees' tops."""
    rounds = []
    while True:
        rounds.append(cut(_groups(nodes), "groups"))
        nodes = rounds[-1].where("prefix <> ''").select("tree", F.col("prefix").alias("digits"), F.col("top").alias("h"), F.lit(None).cast("long").alias("load"))
        if nodes.isEmpty():
            return rounds


def _proved(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """tree, load, h of every node of the first round with its siblings, (before, after) level by level, and what `above` (tree,
    siblings, ...) has of its tree: first the groups' own siblings, then those above."""
    at = f"(i div CAST(power({FANOUT}, k) AS INT))"
    run = lambda first, n: f"array_join(slice(levels[k], {first}, {n}), '')"
    own = f"struct({run(f'{at} - {at} % {FANOUT} + 1', f'{at} % {FANOUT}')} AS before, {run(f'{at} + 2', f'{FANOUT - 1} - {at} % {FANOUT}')} AS after)"
    each = f"inline(transform(sequence(0, size(digits) - 1), i -> struct(digits[i] AS digits, loads[i] AS load, levels[0][i] AS h, slice(transform(sequence(0, {STEP - 1}), k -> {own}), 1, steps) AS own)))"
    rest = [c for c in above.columns if c not in ("tree", "siblings")]
    top = above.withColumn("prefix", F.lit(""))
    for groups in reversed(rounds):
        rows = groups.join(top, ["tree", "prefix"]).select("tree", "siblings", *rest, F.expr(each))
        rows = rows.withColumn("siblings", F.concat("own", "siblings")).drop("own")
        top = above.withColumn("prefix", F.lit("")).unionByName(rows.select("tree", F.col("digits").alias("prefix"), "siblings", *rest).where("prefix <> ''"))
    return rows


def _in_order(trees: DataFrame) -> DataFrame:
    """trees(tree, h) with rank and total, by tree: sorted in ranges, counted range by range."""
    spark = trees.sparkSession
    mark = F.monotonically_increasing_id()
    placed = cut(trees.repartitionByRange("tree").sortWithinPartitions("tree").withColumn("at", mark), "trees")
    part, inside = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("part")).count().collect()  # a row per task
    starts, total = [], 0
    for p, n in sorted(sizes):
        starts.append((p, total))
        total += n
    starts = spark.createDataFrame(starts, "part long, start long")
    return placed.withColumn("part", part).join(F.broadcast(starts), "part").select("tree", "h", (F.col("start") + inside).alias("rank"), F.lit(total).cast("long").alias("total"))


def manifest(rows: DataFrame) -> DataFrame:
    """rows(tree, doc_id, leaf, forged) -> doc_id, leaf, forged, subroot, root, siblings: array of (before, after), the hashes left
    and right of the leaf's node in its run, one after the other, from the leaves to the root."""
    same = rows.groupBy("tree", "doc_id", "leaf", "forged").agg(F.count("*").alias("n"))
    key = F.concat(ordered_long(F.col("doc_id")), F.unhex("leaf"))
    kept = cut(same.withColumn("key", key).withColumnRenamed("tree", "group"), "leaves")
    if kept.isEmpty():
        return kept.select("doc_id", "leaf", "forged", F.col("leaf").alias("subroot"), F.col("leaf").alias("root"), F.array(F.struct(F.col("leaf").alias("before"), F.col("leaf").alias("after"))).alias("siblings"))
    placed = ranked(kept).withColumn("rank", F.explode(F.expr("sequence(before, before + n - 1)")))
    rounds = _reduced(placed.select(F.col("group").alias("tree"), _digits(F.col("rank"), F.col("total")).alias("digits"), F.col("leaf").alias("h"), F.struct("doc_id", "forged").alias("load")))
    tops = rounds[0].where("prefix = ''").select("tree", F.col("top").alias("h"))
    for r in rounds[1:]:
        tops = tops.unionByName(r.where("prefix = ''").select("tree", F.col("top").alias("h")))
    sources = _in_order(tops).select(F.lit("").alias("tree"), _digits(F.col("rank"), F.col("total")).alias("digits"), "h", F.col("tree").alias("load"))
    upper = _reduced(sources)
    root = upper[-1].select("tree", F.expr("CAST(array() AS array<struct<before: string, after: string>>)").alias("siblings"), F.col("top").alias("root"))
    above = cut(_proved(upper, root).select(F.col("load").alias("tree"), "siblings", F.col("h").alias("subroot"), "root"), "sources")
    return _proved(rounds, above).select("load.doc_id", F.col("h").alias("leaf"), "load.forged", "subroot", "root", "siblings")


def folded(leaf: Column, siblings: Column) -> Column:
    """The root that a leaf and its siblings make."""
    return F.aggregate(siblings, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def proof(siblings: Column) -> Column:
    """All siblings of a leaf, one after the other."""
    return F.array_join(F.flatten(F.transform(siblings, lambda s: F.array(s["before"], s["after"]))), "")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    chosen = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    tampered = F.when(chosen & F.col("text").contains("\n"), F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    rows = settled(lambda: manifest(leaves(docs, tampered)), "manifest")
    again = folded(F.coalesce("forged", "leaf"), F.col("siblings"))
    out = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("siblings")), 256).alias("proof_sha256"), again.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {"op11_merkle_manifest": op11_merkle_manifest}
_FIELD = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in FIELDS[:-1]) + " || {})"
ORACLES = {"op11_merkle_manifest": f"""
WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || range(8), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
d AS (SELECT *, CAST(doc_id AS VARCHAR) AS id FROM documents),
e AS (SELECT *, xor(4294967295, list_reduce([4294967295::BIGINT] || [ascii(id[k])::BIGINT FOR k IN range(1, length(id) + 1)], lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 2 = 0 AS forge FROM d, tab),
leaf AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS i, count(*) OVER (PARTITION BY source) AS n,
  {_LEAF.format(_FIELD.format("text"))} AS h, {_LEAF.format(_FIELD.format("CASE WHEN forge THEN replace(text, chr(10), '') ELSE text END"))} AS g FROM e),
a(level, source, i, n, h) AS (SELECT 0, source, i, n, h FROM leaf UNION ALL
  SELECT level + 1, source, i // 3, any_value(n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM a WHERE n > 1 GROUP BY level, source, i // 3),
sub AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM a WHERE n = 1),
b(level, i, n, h) AS (SELECT 0, i, n, h FROM sub UNION ALL SELECT level + 1, i // 3, any_value(n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM b WHERE n > 1 GROUP BY level, i // 3),
both_ AS (SELECT 0 AS part, level, source, i, n, h FROM a UNION ALL SELECT 1, level, NULL, i, n, h FROM b),
sib AS (SELECT x.part, x.level, x.source, x.i, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i < x.i), '') AS l, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i > x.i), '') AS r
  FROM both_ x LEFT JOIN both_ y ON x.part = y.part AND x.level = y.level AND x.source IS NOT DISTINCT FROM y.source AND x.i // 3 = y.i // 3 AND x.i <> y.i WHERE x.n > 1 GROUP BY ALL),
f(doc_id, leaf, source, level, i, h, proof) AS (SELECT doc_id, h, source, 0, i, g, '' FROM leaf UNION ALL
  SELECT f.doc_id, f.leaf, f.source, f.level + 1, f.i // 3, sha256(l || f.h || r), proof || l || r FROM f JOIN sib s ON s.part = 0 AND s.level = f.level AND s.source IS NOT DISTINCT FROM f.source AND s.i = f.i),
low AS (SELECT f.* FROM f JOIN a ON a.level = f.level AND a.source IS NOT DISTINCT FROM f.source AND a.i = f.i AND a.n = 1),
k(doc_id, leaf, subroot, level, i, h, proof) AS (SELECT low.doc_id, low.leaf, sub.h, 0, sub.i, low.h, low.proof FROM low JOIN sub ON low.source IS NOT DISTINCT FROM sub.source UNION ALL
  SELECT k.doc_id, k.leaf, k.subroot, k.level + 1, k.i // 3, sha256(l || k.h || r), proof || l || r FROM k JOIN sib s ON s.part = 1 AND s.level = k.level AND s.i = k.i)
SELECT k.doc_id, k.leaf, k.subroot, b.h AS root, sha256(k.proof) AS proof_sha256, k.h AS folded_root, k.h = b.h AS verified FROM k JOIN b ON b.level = k.level AND b.n = 1
"""}
