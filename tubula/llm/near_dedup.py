"""Near-duplicate documents by SetSketch registers.

A document's set holds its distinct 5-word shingles. Register i of a set's sketch is floor(1 - log_b(min of h_i)), h_i
being exponential hashes of rate A: exponentially spaced, truncated minima, which merge by maximum. With b = 1.001 two
registers are equal with about the probability J, the sets' Jaccard similarity. Rows of registers form bands, and documents
that agree in a band are candidates; candidates whose registers (greater, smaller, equal) make J >= 0.75 too unlikely, given
both set sizes, are left out; the rest are confirmed on their full sets.

With BANDS bands of ROWS registers a pair at J = 0.75 is no candidate with a probability of (1 - 0.75**4)**40 = 2.5e-7, and
the likelihood bound REFUTED leaves out such a pair with one of about 1e-6; more similar pairs are safer still.

Not all pairs of a bucket are looked at. Documents with equal sets are one class from the start. Every member of a bucket
is first paired with the bucket's leader, of which each bucket has one by either of two random orders; the confirmed pairs
make components. Only then are members of different components in one bucket paired, in buckets of up to SMALL members.
Members of larger buckets, as of many documents that share much but not enough, get an exact way instead: two sets with
J >= 0.75 have one of each other's rarest quarter of shingles in common, so that sets meet at those shingles only, once more a
leader first and then members of different components. A set meets only those whose size leaves room for what both still lack
of the shingle's place on; sizes are found as ranges of dyadic cells, so that no others are looked at, and cells of more than
CELL sets are split. Sets that could still be similar for all their sizes and places say do meet pair by pair.

Registers and candidates rest on 64-bit hashes. Equal sets are told by 128-bit digests of their words. Links are confirmed on the
words themselves, both whole texts being at hand.

Defined results: no words or null text: an empty set, linked with nothing; fewer than 5 words: one shingle of all. Rows
that share a doc_id are one document with the links of each. A null doc_id is linked with nothing and stays. Empty input
gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnum as T
from .common import cut, documents, hot_keys, lookup_join, quoted, settled, spread_join, unused
from .components import components
from .ranks import ordered_long, ranked

SHINGLE, PERCENT, ROWS, BANDS = 5, 75, 4, 40
M = ROWS * BANDS
BASE, RATE, TOP = 1.001, 20.0, 65534
#: log-likelihood by which the best J of all may beat the best J >= 0.75 before a candidate is left out.
REFUTED = 12.0
#: Members of a bucket of at most this size are paired directly.
SMALL = 8
#: Sets in a cell of sizes that one task meets at once.
CELL = 512
#: Bits of the filter through which texts pass before those with candidates are shuffled; 2 ** BITS / 64 rows at most.
BITS = 24
SKETCHED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary()), ("sketch", pa.binary())])
EACH = pa.schema([("rep", pa.int64()), ("size", pa.int32()), ("key", pa.int64())])


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text, two 64-bit hashes of its distinct shingles, as two columns, sorted by the first, which tells them apart."""
    short = T.odd(SHINGLE, 5)
    for _, data, offsets in T.runs(texts):
        starts, ends, _, bounds = T.words(data, offsets, lower=True)
        hashes = T.digests(data, starts, ends, lower=True).T
        every = np.stack([T.windows(h, SHINGLE, 6 + 10 * k) for k, h in enumerate(hashes)], axis=1)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= SHINGLE:
                own = every[a : b - SHINGLE + 1]
                yield own[np.unique(own[:, 0], return_index=True)[1]]
            elif b > a:
                yield T.mixed(np.stack([np.add.reduce(h[a:b] * short[: b - a], keepdims=True) + T.U(b - a) for h in hashes], axis=1))
            else:
                yield np.zeros((0, 2), T.U)


_FLIP, _TIMES = T.odd(M, 7), T.odd(M, 8)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The M registers of a set that isn't empty."""
    least = np.full(M, np.iinfo(T.U).max, T.U)
    for at in range(0, len(shingles), 512):
        part = (shingles[at : at + 512, None] ^ _FLIP) * _TIMES
        np.minimum(least, part.min(axis=0), out=least)
    e = -np.log1p(-np.minimum((least.astype(np.float64) + 0.5) / 2.0**64, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(e) / np.log(BASE)), 0, TOP + 1).astype("<u2")


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in T.parts(batches):
        n, ids, sketches = [], [], []
        for s in shingle_sets(b.column(1)):
            n.append(len(s))
            ids.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            sketches.append(sketch(s[:, 0]).tobytes() if len(s) else b"")
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(sketches, pa.binary())], schema=SKETCHED)


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of each text: the text's id, the size of its set, the shingle's hash."""
    for b in T.parts(batches, 128):
        sets = [s[:, 0] for s in shingle_sets(b.column(1))]
        n = np.array([len(s) for s in sets], np.int32)
        cols = [np.repeat(b.column(0).to_numpy(), n), np.repeat(n, n), np.concatenate(sets).view(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=EACH)


def similar(ta: pa.Array, tb: pa.Array) -> np.ndarray:
    """Of pairs of whole texts: whether their sets of shingles, compared word by word, have J >= PERCENT %."""
    n = len(ta)
    out = np.zeros(n, bool)
    (_, data, offsets), = T.runs(pa.concat_arrays([ta, tb]), 1 << 62)
    starts, ends, _, bounds = T.words(data, offsets, lower=True)
    code = T.spelled(data, starts, ends, lower=True).indices.to_numpy().astype(np.int64)
    count = np.diff(bounds)
    row = np.repeat(np.arange(2 * n), count)
    shingle = T.sequences(code, SHINGLE)
    inside = row[: len(shingle)] == row[len(row) - len(shingle) :]
    kinds = int(shingle.max(initial=0)) + 1
    sets = np.unique(row[: len(shingle)][inside] * kinds + shingle[inside])
    size = np.bincount(sets // kinds, minlength=2 * n)
    a, b = (np.split(sets, [np.searchsorted(sets, n * kinds)]))
    both = np.bincount(np.intersect1d(a, b - n * kinds, assume_unique=True) // kinds, minlength=n)
    long_ = (count[:n] >= SHINGLE) & (count[n:] >= SHINGLE)
    out[long_] = (100 * both >= PERCENT * (size[:n] + size[n:] - both))[long_]
    for i in np.flatnonzero((count[:n] < SHINGLE) & (count[:n] == count[n:]) & (count[:n] > 0)).tolist():
        out[i] = np.array_equal(code[bounds[i] : bounds[i + 1]], code[bounds[n + i] : bounds[n + i + 1]])
    return out


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in T.parts(batches, 64):
        ta, tb = (pc.fill_null(b.column(c), "") for c in ("ta", "tb"))
        size, at = np.cumsum(pc.binary_length(ta).to_numpy().astype(np.int64) + pc.binary_length(tb).to_numpy()), 0
        good = []
        while at < len(b):  # pairs of about RUN bytes together
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + T.RUN, "right")))
            good.append(similar(ta.slice(at, to - at), tb.slice(at, to - at)))
            at = to
        b = b.filter(pa.array(np.concatenate(good)))
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"])


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def may_link(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Of pairs of sketches (rows of a and b) and set sizes: whether J >= PERCENT % is not refuted by the joint likelihood."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    u, v = na / (na + nb), nb / (na + nb)

    def likelihood(j):
        # u and v are the shares of both sets' sizes; register a is greater where its minimum is only in a
        up, down = np.maximum(_p(u - v * j), 1e-12), np.maximum(_p(v - u * j), 1e-12)
        return more * np.log(up) + less * np.log(down) + (M - more - less) * np.log(np.maximum(1 - up - down, 1e-12))

    least = PERCENT / 100
    most = np.minimum(u / v, v / u)
    grid = np.linspace(0, 1, 65)
    best = np.max([likelihood(most * g) for g in grid], axis=0)
    good = np.max([likelihood(np.maximum(least, 0) + (most - least) * g) for g in grid], axis=0)
    return (most >= least - 1e-12) & (best - good <= REFUTED)


def _unrefuted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in T.parts(batches):
        x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(len(b), M) for c in ("sa", "sb"))
        na, nb = (b.column(c).to_numpy().astype(np.float64) for c in ("na", "nb"))
        b = b.filter(pa.array(may_link(x, y, na, nb)))
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"])


def _confirmed(pairs: DataFrame, known: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links, by known(doc_id, sketch, n_shingles) and texts(doc_id, text). A document in very many pairs, as a leader is, gets no task of its own: see spread_join."""

    def side(x: str, of: DataFrame, **cols) -> DataFrame:
        return of.select(F.col(of.columns[0]).alias(x), *(F.col(c).alias(n) for n, c in cols.items()))

    hot = {x: hot_keys(pairs, x, pairs.count()) for x in "ab"}
    both = spread_join(pairs, side("a", known, sa="sketch", na="n_shingles"), "a", "b", hot["a"])
    both = spread_join(both, side("b", known, sb="sketch", nb="n_shingles"), "b", "a", hot["b"])
    likely = cut(both.mapInArrow(_unrefuted, "a long, b long"), "likely")
    full = spread_join(likely, side("a", texts, ta="text"), "a", "b", hot["a"])
    full = spread_join(full, side("b", texts, tb="text"), "b", "a", hot["b"])
    return full.select("a", "b", "ta", "tb").mapInArrow(_similar, "a long, b long").distinct()


def _pairs(rows: DataFrame, x: str, y: str) -> DataFrame:
    return rows.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).where("a <> b").distinct()


def _likely_in(rows: DataFrame, ids: DataFrame, key: str = "doc_id", others: bool = False) -> DataFrame:
    """The rows whose id in `key` is among ids(doc_id), and some others: by a bit map of hashed ids, of bounded size. With `others`,
    the rest of the rows instead."""
    word, bit, bits = unused(rows.columns, "word", "bit", "bits")

    def marked(df: DataFrame, column: str) -> DataFrame:
        h = f"pmod(xxhash64(CAST({quoted(column)} AS BIGINT)), {1 << BITS}L)"
        return df.withColumns({word: F.expr(f"floor({h} / 64)"), bit: F.expr(f"shiftleft(1L, CAST({h} % 64 AS INT))")})

    table = marked(ids.select("doc_id"), "doc_id").groupBy(word).agg(F.bit_or(bit).alias(bits))
    there = F.coalesce(F.col(bits).bitwiseAND(F.col(bit)), F.lit(0)) != 0
    return marked(rows, key).join(F.broadcast(table), word, "left").where(~there if others else there).drop(word, bit, bits)


def _without(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id, never null, isn't among ids(doc_id), all columns. Only those that the bit map can't tell from them are
    joined, so that the others are not shuffled."""
    (gone,) = unused(rows.columns, "gone_")
    doubtful = _likely_in(rows, ids).join(ids.select(F.col("doc_id").alias(gone)), F.col("doc_id").cast("long") == F.col(gone), "left_anti")
    return _likely_in(rows, ids, others=True).unionByName(doubtful)


def _split(members: DataFrame) -> DataFrame:
    """members(key, rep, comp) of the buckets that hold several components, with the bucket's size n."""
    size = members.groupBy("key").agg(F.count("*").alias("n"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("key", "n")
    size = cut(size, "open")
    total = size.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return lookup_join(members, size, ["key"], "n", total)


def _placed(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows(rep, ...) with comp, the component so far."""
    known = labels.select(F.col("node").alias("rep"), "component")
    return rows.join(known, "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")


def _rare(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, rep, place, size): of each of these documents' sets, the shingles that a set with J >= PERCENT % could meet it at first
    when all go by (number of these sets that hold it, hash): place is the shingle's rank from 1, size the set's. Shingles of one
    set alone are left out."""
    each = texts.join(ids.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi").select("doc_id", "text")
    each = cut(each.mapInArrow(_exploded, "rep long, size int, key long"), "shingles")
    times = cut(each.groupBy("key").agg(F.count("*").alias("times")).where("times > 1"), "times")
    shared = lookup_join(each, times, ["key"], "times", each.count())
    # Shingles of one set alone come first in its order: there are as many as the set has more than shared ones.
    ranked = shared.groupBy("rep", "size").agg(F.sort_array(F.collect_list(F.struct("times", "key"))).alias("some"))
    most = F.expr(f"CAST(size - ceil({PERCENT} * size / 100.0D) + 1 AS int)")
    alone = F.col("size") - F.size("some")
    ranked = ranked.where(most > alone).select("rep", "size", alone.alias("alone"), F.posexplode(F.slice("some", F.lit(1), most - alone)).alias("at", "one"))
    return ranked.select("one.key", "rep", (F.col("alone") + F.col("at") + 1).alias("place"), "size")


def _meetings(rare: DataFrame) -> DataFrame:
    """rare(key, rep, comp, place, size) -> pairs (rep, rep2) of different components that meet at a key and whose overlap can be
    enough: the sets have at most size - place + 1 shingles in common from there on, and none before.

    Of a pair, let the second be the smaller one. Its size is then in a range that the first alone gives; the range is a few
    dyadic cells (level, size >> level), and the smaller set is in one cell of each level, so that an equi-join finds the pairs."""
    most = F.expr(f"floor({100 + PERCENT} * (size - place + 1) / {PERCENT}D)").cast("int") - F.col("size")  # a partner's size
    rows = rare.withColumn("most", most)
    level = "sequence(0, CAST(floor(log2(size)) AS INT))"
    small = rows.where("size <= most").select("key", F.col("rep").alias("rep2"), F.col("comp").alias("comp2"), F.col("most").alias("most2"), F.col("size").alias("size2"), F.expr(f"explode(transform({level}, j -> struct(j, shiftright(size, j) AS cell)))").alias("c"))
    small = cut(small.select("key", "c.j", "c.cell", "rep2", "comp2", "most2", "size2"), "small")
    blocks = small.groupBy("key", "j", "cell").agg(F.ceil(F.count("*") / CELL).cast("int").alias("blocks"))
    blocks = cut(blocks, "cells")
    # The cells of low <= size2 < high: at each level the odd one at either end.
    rows = rows.withColumns({"low": F.expr(f"CAST(ceil({PERCENT} * size / 100.0D) AS INT)"), "high": F.least("size", "most") + 1}).where("low < high")
    pair = "array(IF(e.l < e.r AND e.l % 2 = 1, struct(e.j AS j, e.l AS cell), NULL), IF(e.r % 2 = 1 AND e.l + e.l % 2 < e.r, struct(e.j AS j, e.r - 1 AS cell), NULL))"
    cells = F.expr(f"explode(filter(flatten(transform(transform({level}, j -> named_struct('j', j, 'l', CAST(ceil(low / shiftleft(1L, j)) AS INT), 'r', CAST(floor(high / shiftleft(1L, j)) AS INT))), e -> {pair})), x -> x IS NOT NULL))")
    large = rows.select("key", "rep", "comp", "most", "size", cells.alias("c")).select("key", "c.j", "c.cell", "rep", "comp", "most", "size")
    large = large.join(blocks, ["key", "j", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    small = small.join(blocks, ["key", "j", "cell"]).withColumn("block", F.pmod(F.xxhash64("rep2"), "blocks").cast("int")).drop("blocks")
    return large.join(small, ["key", "j", "cell", "block"]).where("comp <> comp2 AND size2 <= most AND size <= most2").select("rep", "rep2")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """A row per row of docs: doc_id, n_shingles, component_id, kept. What was written on the way is deleted."""
    return settled(lambda: _near_duplicates(docs), "near")


def _near_duplicates(docs: DataFrame) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = cut(docs.mapInArrow(_sketched, "doc_id long, n_shingles long, set_id binary, sketch binary"), "sketches")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    reps = table.where(linked).groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    reps = cut(reps, "reps")
    n_rows, n_reps = reps.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sketch"), i * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    bands = reps.select("rep", F.explode(band).alias("key"))
    order = F.struct(F.xxhash64("rep", F.col("key").bitwiseAND(1)), "rep")
    buckets = cut(bands.groupBy("key").agg(F.count("*").alias("n"), F.min(order)["rep"].alias("leader")).where("n > 1"), "buckets")
    members = cut(lookup_join(bands, buckets, ["key"], "n", n_reps * BANDS), "members")
    pairs = cut(_pairs(members, "rep", "leader"), "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    ids = cut(ids, "ids")
    known = cut(_likely_in(reps.select(F.col("rep").alias("doc_id"), "sketch", "n_shingles"), ids), "known")
    texts = cut(_likely_in(docs, ids).join(ids, "doc_id", "left_semi").select("doc_id", "text"), "texts")
    links = cut(_confirmed(pairs, known, texts), "links")
    labels = cut(components(links), "labels")
    # What is left to look at: members of one bucket whose components differ.
    open_ = cut(_split(_placed(members.select("key", "rep"), labels)), "open")
    small = open_.where(F.col("n") <= SMALL)
    other = small.select("key", F.col("rep").alias("rep2"), F.col("comp").alias("comp2"))
    more = _pairs(small.join(other, "key").where("rep < rep2 AND comp <> comp2"), "rep", "rep2")
    rare = cut(_rare(open_.where(F.col("n") > SMALL).select("rep").distinct(), texts), "rare")
    leads = rare.groupBy("key").agg(F.count("*").alias("times"), F.min(F.struct("place", "rep"))["rep"].alias("leader")).where("times > 1")
    leads = cut(leads, "leads")
    met = lookup_join(rare.select("key", "rep"), leads, ["key"], "times", rare.count())
    links = cut(links.unionByName(_confirmed(cut(more.unionByName(_pairs(met, "rep", "leader")).distinct(), "more"), known, texts)), "links")
    labels = cut(components(links), "labels")
    meeting = cut(_split(_placed(rare, labels)), "meeting")
    links = links.unionByName(_confirmed(cut(_pairs(_meetings(meeting), "rep", "rep2"), "last"), known, texts))
    labels = components(links)
    named = reps.join(labels, reps["rep"] == labels["node"], "left").select("set_id", "n", F.coalesce("component", "rep").alias("component_id"))
    named = cut(named, "named")
    rows = lookup_join(table.where(linked).select("doc_id", "n_shingles", "set_id"), named, ["set_id"], "n", n_rows)
    alone = table.where(~linked).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that stay: one document of each component, the one of the smallest doc_id. Rows without a
    doc_id stay. Different texts under one doc_id are documents of their own, in the order of their digests; of rows that share
    both one stays, whichever is met first."""
    key, number, digest, times = unused(docs.columns, "key_", "number_", "digest_", "times_")
    text = F.sha2(F.coalesce("text", F.lit("")), 256)
    known, other = docs.where("doc_id IS NOT NULL"), docs.where("doc_id IS NULL")
    names = known.groupBy(F.col("doc_id").cast("long").alias(key), text.alias(digest)).agg(F.count("*").alias(times))
    names = cut(names, "names")
    if names.groupBy(key).agg(F.sum(times).alias(times)).where(F.col(times) > 1).isEmpty():
        return _without(known, near_duplicates(known).where("NOT kept").select("doc_id")).unionByName(other)
    # Documents are numbered by doc_id and digest, so that each text has an id of its own.
    placed = names.select(F.lit(0).alias("group"), F.concat(ordered_long(F.col(key)), F.unhex(digest)).alias("key"), F.lit(1).cast("long").alias("n"), F.col(key).alias("id"), F.col(digest).alias("digest"))
    numbers = cut(ranked(placed).select(F.col("id").alias(key), F.col("digest").alias(digest), F.col("before").alias(number)), "numbers").join(names, [key, digest])
    rows = known.withColumn(f"{digest}own", text)
    rows = rows.join(numbers, (F.col("doc_id").cast("long") == F.col(key)) & (F.col(f"{digest}own") == F.col(digest)))
    won = near_duplicates(rows.select(F.col(number).alias("doc_id"), "text")).where("kept").select(F.col("doc_id").alias("won")).distinct()
    rows = rows.join(won, F.col(number) == F.col("won"), "left_semi")
    rows = rows.where(F.col(times) == 1).unionByName(rows.where(F.col(times) > 1).dropDuplicates([number]))
    return rows.select(*(F.col(quoted(c)) for c in docs.columns)).unionByName(other)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i+4], ' ') FOR i IN generate_series(1, len(w) - 4)]) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
"""
QUERIES: dict = {"op5_near_dedup": op5_near_dedup}
ORACLES: dict = {"op5_near_dedup": "WITH RECURSIVE " + SQL.strip().removeprefix("WITH ") + """
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(doc_id, seen) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.seen)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""}
