"""Removal of word windows that occur earlier in the corpus, by super-k-mer partitioning.

Each window of WINDOW words has a minimiser: the least hash of the MER-word sequences in it. Consecutive windows mostly share
it, and such a run travels as one packed string, its words joined by a space, to the bucket of the minimiser; equal windows
have equal minimisers, so a bucket holds all places of its windows, and sorting them there finds the first of each exactly.
Inside a bucket windows are compared word by word.
A minimiser that occurs once cannot belong to a repeated window, so only runs of repeated minimisers are packed and sent.
Minimisers of more than CROWD runs, as of a passage in very many documents, would make buckets without bound: their windows
are told apart by 128-bit digests of their own bytes instead, aggregated on the map side first.

Defined results: null or empty texts have no words; texts under WINDOW words have no window and stay whole; rows that share a
doc_id count as one document, a window at the same start in another of them being no earlier one; a null doc_id comes after
all others. Each text has a key of its own, 128 bits of its hash, by which what is found goes back to it: rows that share both
id and text share what is removed. Empty input gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnum as T
from .common import cut, documents, drop, lookup_join

#: What names a text: doc_id (LAST for null), and two hashes of the text.
NAME = ["id", "row", "row2"]

WINDOW, MER, CROWD = 20, 8, 4096
LAST = 2**63 - 1
#: Rows of packed runs that a bucket task works on at once, beside a bucket that is larger.
BATCH = 4096
#: A run is start << RUN_BITS | number of windows.
RUN_BITS = 31


def _minimisers(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows that share a minimiser, none over a row's bounds: row, first word in the run of rows, windows,
    minimiser, how often that occurs in the run."""
    mers = T.windows(hashes, MER, 9)
    width = WINDOW - MER + 1
    if len(mers) < width:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(T.U), none
    least, reach = mers, 1
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    least = np.minimum(least[: len(mers) - width + 1], least[width - reach : len(mers) - reach + 1])
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.arange(len(least))
    inside = row[at] == row[at + WINDOW - 1]
    at, least, row = at[inside], least[inside], row[at[inside]]
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    start, n, key = at[first], np.diff(np.append(first, len(at))), least[first]
    if not len(first):
        return row[first], start, n, key, n
    spans = n + width - 1
    ends = np.cumsum(spans)
    places = np.arange(ends[-1]) - np.repeat(ends - spans - start, spans)
    return row[first], start, n, key, np.add.reduceat(mers[places] == np.repeat(key, spans), ends - spans, dtype=np.int64)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in T.parts(batches):
        names = [b.column(c).to_numpy() for c in NAME]
        for at, data, offsets in T.runs(b.column("text")):
            _, _, hashes, bounds = T.words(data, offsets)
            row, start, n, key, times = _minimisers(hashes, bounds)
            cols = (key.view(np.int64), *(c[at + row] for c in names), (start - bounds[row]) << RUN_BITS | n, times.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", *NAME, "span", "times"])


PACKED = pa.schema([("key", pa.int64()), *((c, pa.int64()) for c in NAME), ("start", pa.int64()), ("packed", pa.string()), ("hi", pa.int64()), ("lo", pa.int64())])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (names, text, runs) the runs: packed strings, or for crowded minimisers (`crowd`) each window's digest."""
    for part in T.parts(batches, 256):
        key, names, start, packed, hashed = [], [], [], [], []
        for *name, text, runs in zip(*(c.to_pylist() for c in part.columns), strict=True):
            ws = (text or "").encode().split()
            for r in runs:
                a, n = r["span"] >> RUN_BITS, r["span"] & (1 << RUN_BITS) - 1
                words = ws[a : a + n + WINDOW - 1]
                if not r["crowd"]:
                    key.append(r["key"]), names.append(name), start.append(a), packed.append(b" ".join(words)), hashed.append(None)
                    continue
                key += [None] * n
                names += [name] * n
                start += range(a, a + n)
                packed += [None] * n
                hashed += [hashlib.blake2b(b" ".join(words[i : i + WINDOW]), digest_size=16).digest() for i in range(n)]
        two = np.frombuffer(b"".join(h or bytes(16) for h in hashed), "<i8").reshape(-1, 2)
        none = np.array([h is None for h in hashed], bool)
        cols = [pa.array(key, pa.int64()), *(pa.array(c, pa.int64()) for c in (zip(*names, strict=True) if names else [[]] * len(NAME))), pa.array(start, pa.int64()), pa.array(packed, pa.binary()).cast(pa.string()), *(pa.array(two[:, k], mask=none) for k in (0, 1))]
        yield pa.RecordBatch.from_arrays(cols, schema=PACKED)


def _repeats(ids: np.ndarray, starts: np.ndarray, packed: pa.Array) -> tuple[np.ndarray, ...]:
    """Of whole buckets: runs of windows that start earlier as well, as number of the packed run, start, number of windows."""
    (_, data, offsets), = T.runs(packed, 1 << 62)
    first_byte, last_byte, _, bounds = T.words(data, offsets)
    code = T.spelled(data, first_byte, last_byte).indices.to_numpy().astype(np.int64)
    inside = np.flatnonzero(np.arange(len(code)) + WINDOW <= np.repeat(bounds[1:], np.diff(bounds)))
    n = np.diff(bounds) - WINDOW + 1
    run = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n) + starts[run]
    name = T.windows(T.mixed(code.view(T.U) + T.U(1)), WINDOW, 10)[inside]
    while True:
        order = np.lexsort((place, ids[run], name))
        new = np.ones(len(order), bool)
        new[1:] = name[order][1:] != name[order][:-1]
        first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]  # of each window, in this order: its first
        if all((code[inside[order] + k] == code[inside[first] + k]).all() for k in range(WINDOW)):
            break
        name = T.sequences(code, WINDOW)[inside]  # different words of one hash: by the words' numbers instead
    later = np.zeros(len(order), bool)
    later[order] = (ids[run][order] != ids[run][first]) | (place[order] != place[first])
    on = np.flatnonzero(later)
    head = np.ones(len(on), bool)
    head[1:] = (on[1:] != on[:-1] + 1) | (run[on[1:]] != run[on[:-1]])
    at = np.flatnonzero(head)
    return run[on[at]], place[on[at]], np.diff(np.append(at, len(on)))


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed runs in the order of their keys -> repeated windows. Whole buckets are taken together, many at a time."""
    held: list[pa.RecordBatch] = []

    def done(rows: pa.Table) -> pa.RecordBatch:
        of, s, n = _repeats(rows.column("id").to_numpy(), rows.column("start").to_numpy(), rows.column("packed").combine_chunks())
        return pa.RecordBatch.from_arrays([*(pa.array(rows.column(c).to_numpy()[of]) for c in NAME), pa.array(s << RUN_BITS | n)], names=[*NAME, "span"])

    for b in T.parts(batches, BATCH):
        keys = b.column("key").to_numpy()
        split = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
        if split or held and held[-1].column("key")[-1].as_py() != keys[0]:
            yield done(pa.Table.from_batches([*held, b.slice(0, split)]))
            held = []
        held.append(b.slice(split))
    if held:
        yield done(pa.Table.from_batches(held))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in T.parts(batches):
        n_words, n_removed, kept = [], [], []
        for text, spans in zip(b.column(1), b.column(2).to_pylist(), strict=True):
            ws = (text.as_py() or "").encode().split()
            n_words.append(len(ws))
            if spans:
                gone = np.zeros(len(ws) + 1, np.int64)
                for s in spans:
                    start = s >> RUN_BITS
                    gone[start] += 1
                    gone[start + (s & (1 << RUN_BITS) - 1) + WINDOW - 1] -= 1
                stay = np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()
                ws = [ws[i] for i in stay]
            n_removed.append(n_words[-1] - len(ws))
            kept.append(b" ".join(ws))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])


def repeated_windows(docs: DataFrame) -> DataFrame:
    """docs(NAME, text) -> (NAME, span): windows from word span >> RUN_BITS on that also start earlier, as many as the low bits say.
    Texts that share an id differ in their hashes; a text that is there more than once gives its windows once or more."""
    names = ", ".join(f"{c} long" for c in NAME)
    runs = cut(docs.mapInArrow(_runs, f"key long, {names}, span long, times int"), "runs")
    total = runs.count()
    often = cut(runs.groupBy("key").agg(F.count("*").alias("size"), F.sum("times").alias("times")).where("times > 1").drop("times"), "minimisers")
    shared = lookup_join(runs.drop("times"), often, ["key"], "size", total).withColumn("crowd", F.col("size") > CROWD).drop("size")
    shared = cut(shared, "shared")
    drop(runs, often)
    by_doc = shared.groupBy(*NAME).agg(F.collect_set(F.struct("key", "span", "crowd")).alias("runs"))
    packed = docs.join(by_doc, NAME).select(*NAME, "text", "runs").mapInArrow(_packed, f"key long, {names}, start long, packed string, hi long, lo long")
    packed = cut(packed, "packed")
    drop(shared)
    p = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = packed.where("key IS NOT NULL").select("key", *NAME, "start", "packed").repartition(p, "key").sortWithinPartitions("key")
    out = sent.mapInArrow(_buckets, f"{names}, span long")
    crowded = packed.where("key IS NULL").select("hi", "lo", *NAME, "start")
    first = crowded.groupBy("hi", "lo").agg(F.min(F.struct("id", "start")).alias("first"), F.count("*").alias("times")).where("times > 1")
    first = cut(first, "first")
    n = first.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    later = lookup_join(crowded, first, ["hi", "lo"], "times", n).where(F.struct("id", "start") > F.col("first"))
    return out.unionByName(later.select(*NAME, F.expr(f"shiftleft(start, {RUN_BITS}) | 1").alias("span")))


def without_repeats(docs: DataFrame) -> DataFrame:
    """A row per row of docs: doc_id, n_words, n_removed, kept_text (the kept words, joined by a space)."""
    named = {"id": F.coalesce(F.col("doc_id"), F.lit(LAST)), "row": F.xxhash64("text"), "row2": F.xxhash64(F.lit(2), "text")}
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumns(named)
    gone = cut(repeated_windows(docs.select(*NAME, "text")), "repeats")
    gone = gone.groupBy(*NAME).agg(F.collect_set("span").alias("spans"))
    return docs.join(gone, NAME, "left").select("doc_id", "text", "spans").mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept_text string")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM d),
v AS (SELECT doc_id, i, row_number() OVER (PARTITION BY md5(array_to_string(w[i:i+19], ' ')) ORDER BY doc_id, i) AS place FROM s),
g AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS i FROM v WHERE place > 1),
k AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_filter(w, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)), ' ')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
QUERIES, ORACLES = {"op10_substring_dedup": op10_substring_dedup}, {"op10_substring_dedup": SQL}
