"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed in one pass. Training takes a bounded sample, SAMPLE expected labelled rows; their
statistics are put into at most BINS bins by quantiles and packed into blocks of BLOCK rows. For each level of a tree every
block gives its histogram of gradients by node, statistic and bin, in a Spark task; their sum, whose size doesn't depend on the
data, decides the splits. Trees are kept as flat arrays (statistic, threshold, left child, value by node), which numpy walks
for all rows of a batch at once.

Defined results: null or empty texts have statistics of 0 and a score like any other; without labelled rows of both kinds
every score is the share of label 1 (0.5 with no label at all); repeated rows and null ids are scored row by row (a row with a
null id is neither held out nor learned from); an empty table gives no rows. Columns other than doc_id and text, and the
labels to learn from, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnum as T
from .common import cut, documents, drop

SAMPLE, BLOCK, BINS, TREES, DEPTH, RATE, SMOOTH, SEED = 20_000, 4096, 48, 16, 3, 0.3, 1.0, 8
_CLASS = np.full(256, 6, np.uint8)  # other ASCII symbols
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[list(b".,;:!?'\"()-")] = 5
LINES = T.table_of(bytes(i for i in range(128) if i != 10))
STATS = ("log_bytes", "log_words", "upper", "digits", "beyond_ascii", "spaces", "punctuation", "symbols", "word_bytes", "distinct_words", "top_word", "repeats_last", "repeats_second", "distinct_trigrams", "marked_words", "short_words", "words_a_line", "distinct_lines", "exclaimed")


def _distinct(row: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """By row: the number of distinct hashes, and how often the most frequent one occurs."""
    if not len(row):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((hashes, row))
    r, h = row[order], hashes[order]
    first = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (h[1:] != h[:-1])))
    times = np.diff(np.append(first, len(r)))
    top = np.zeros(n)
    np.maximum.at(top, r[first], times)
    return np.bincount(r[first], minlength=n).astype(float), top


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of STATS for each text of a run."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    row = np.repeat(np.arange(n), np.diff(offsets))
    kinds = np.bincount(row * 7 + _CLASS[data], minlength=7 * n).reshape(n, 7)
    share = kinds / np.maximum(size, 1)[:, None]
    starts, ends, hashes, bounds = T.words(data, offsets)
    words = np.diff(bounds).astype(float)
    most = np.maximum(words, 1)
    word_row = np.repeat(np.arange(n), np.diff(bounds))
    distinct, top = _distinct(word_row, hashes, n)

    def repeats(by: int) -> np.ndarray:
        if len(hashes) <= by:
            return np.zeros(n)
        return np.bincount(word_row[by:], (hashes[by:] == hashes[:-by]) & (word_row[by:] == word_row[:-by]), n) / most

    tri = T.windows(hashes, 3, 4)
    inside = word_row[: len(tri)] == word_row[2:] if len(tri) else np.zeros(0, bool)
    tri_row = word_row[: len(tri)][inside]
    last = data[ends - 1] if len(ends) else data[:0]
    of_words = lambda x: np.bincount(word_row, x, n) / most
    _, _, lines, line_bounds = T.words(data, offsets, table=LINES)
    n_lines = np.diff(line_bounds).astype(float)
    out = [np.log1p(size), np.log1p(words), share[:, 1], share[:, 2], share[:, 3], share[:, 4], share[:, 5], share[:, 6],
           of_words(ends - starts), distinct / most, top / most, repeats(1), repeats(2),
           _distinct(tri_row, tri[inside], n)[0] / np.maximum(np.bincount(tri_row, minlength=n), 1),
           of_words(_CLASS[last] == 6), of_words(ends - starts <= 2), words / np.maximum(n_lines, 1),
           _distinct(np.repeat(np.arange(n), np.diff(line_bounds)), lines, n)[0] / np.maximum(n_lines, 1), of_words(last == 33)]
    return np.stack(out, axis=1)


def stats_table(docs: DataFrame) -> DataFrame:
    """doc_id and STATS of every row of docs."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.parts(batches):
            for at, data, offsets in T.runs(b.column(1)):
                x = statistics(data, offsets)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(x)), *(pa.array(c) for c in x.T)], names=["doc_id", *STATS])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(of, "doc_id long, " + ", ".join(f"{s} double" for s in STATS))


@dataclass
class Trees:
    """All trees in flat arrays; a node of a tree that has no split leads to itself."""

    start: float  # log-odds before the first tree
    stat: np.ndarray  # of each node: the statistic it looks at
    edge: np.ndarray  # rows whose statistic is at most this go left
    left: np.ndarray  # the left child; the right one is the next
    value: np.ndarray  # what a row that ends here adds
    roots: list[int]
    deep: int = DEPTH

    @staticmethod
    def of(start: float, deep: int = DEPTH) -> Trees:
        return Trees(start, np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0), [], deep)

    def grow(self, n: int) -> int:
        """n more leaves; returns the first."""
        at = len(self.stat)
        self.stat = np.append(self.stat, np.zeros(n, np.int64))
        self.edge = np.append(self.edge, np.full(n, np.inf))
        self.left = np.append(self.left, np.arange(at, at + n))
        self.value = np.append(self.value, np.zeros(n))
        return at

    def leaves(self, x: np.ndarray, root: int) -> np.ndarray:
        at, rows = np.full(len(x), root), np.arange(len(x))
        for _ in range(self.deep):
            at = self.left[at] + (x[rows, self.stat[at]] > self.edge[at])
        return at

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for root in self.roots:
            out += self.value[self.leaves(x, root)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def _blocks(edges: list[np.ndarray]):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in (big.slice(i, BLOCK) for i in range(0, len(big), BLOCK)):
                x = np.stack([np.searchsorted(e, b.column(s).to_numpy()) for s, e in zip(STATS, edges, strict=True)], axis=1).astype(np.uint8)
                y = b.column("label").to_numpy().astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]), pa.array([y.tobytes()])], names=["x", "y"])

    return of


def _histograms(trees: Trees, root: int, nodes: list[int]):
    """Of each block: sums of gradient, hessian and rows, by node, statistic and bin."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                y = np.frombuffer(y.as_py(), np.uint8)
                x = np.frombuffer(x.as_py(), np.uint8).reshape(len(y), len(STATS))
                p = trees.score(x)
                leaf = trees.leaves(x, root)
                node = np.searchsorted(nodes, leaf)
                keep = np.isin(leaf, nodes)
                out = np.zeros((len(nodes), len(STATS), BINS, 2))
                for s in range(len(STATS)):
                    cell = (node * BINS + x[:, s])[keep]
                    for k, v in enumerate((y - p, p * (1 - p))):
                        out[:, s, :, k] = np.bincount(cell, v[keep], len(nodes) * BINS).reshape(len(nodes), BINS)
                yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()])], names=["h"])

    return of


def learn(labelled: DataFrame, sample: int = SAMPLE) -> Trees:
    """labelled: STATS, doc_id and label (0 or 1) -> trees over the statistics."""
    n = labelled.count()
    draw = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    rows = cut(labelled.where(draw < min(1.0, sample / max(n, 1))).select(*STATS, "label"), "labelled")
    at = [i / BINS for i in range(1, BINS)]
    got = rows.agg(F.avg("label").alias("mean"), *(F.percentile_approx(s, at, 10_000).alias(s) for s in STATS)).first()
    mean = 0.5 if got["mean"] is None else got["mean"]
    trees = Trees.of(float(np.log((mean + 1e-6) / (1 - mean + 1e-6))))
    if mean in (0.0, 1.0) or got["mean"] is None:
        return trees
    edges = [np.unique(got[s]) for s in STATS]
    blocks = cut(rows.coalesce(8).mapInArrow(_blocks(edges), "x binary, y binary"), "blocks")
    for _ in range(TREES):
        root = trees.grow(1)
        nodes = [root]
        for level in range(DEPTH):
            parts = blocks.mapInArrow(_histograms(trees, root, nodes), "h binary").collect()  # one for each block of the sample
            h = np.sum([np.frombuffer(p["h"]) for p in parts], axis=0).reshape(len(nodes), len(STATS), BINS, 2)
            g, w = h[..., 0].cumsum(axis=2), h[..., 1].cumsum(axis=2)
            g_all, w_all = g[:, :1, -1:], w[:, :1, -1:]
            gain = g**2 / (w + SMOOTH) + (g_all - g) ** 2 / (w_all - w + SMOOTH) - g_all**2 / (w_all + SMOOTH)
            gain[(w < 1) | (w_all - w < 1)] = -1
            new = []
            for i, node in enumerate(nodes):
                s, b = np.unravel_index(int(gain[i].argmax()), gain[i].shape)
                if gain[i, s, b] <= 1e-6:
                    if level == 0:
                        trees.value[node] = RATE * g_all[i, 0, 0] / (w_all[i, 0, 0] + SMOOTH)
                    continue
                child = trees.grow(2)
                trees.stat[node], trees.edge[node], trees.left[node] = s, b, child
                for c, (gs, ws) in enumerate(((g[i, s, b], w[i, s, b]), (g_all[i, 0, 0] - g[i, s, b], w_all[i, 0, 0] - w[i, s, b]))):
                    trees.value[child + c] = RATE * gs / (ws + SMOOTH)
                new += [child, child + 1]
            nodes = new
            if not nodes:
                break
        trees.roots.append(root)
    drop(rows, blocks)
    split = trees.left != np.arange(len(trees.left))  # from bins to the statistics themselves
    trees.edge = np.array([edges[s][int(e)] if on and int(e) < len(edges[s]) else np.inf for s, e, on in zip(trees.stat, np.where(split, trees.edge, 0), split, strict=True)])
    return trees


def score(stats: DataFrame, trees: Trees) -> DataFrame:
    """doc_id and score of each row of stats."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.parts(batches, 1 << 14):
            x = np.stack([b.column(s).to_numpy() for s in STATS], axis=1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(trees.score(x))], names=["doc_id", "score"])

    return stats.mapInArrow(of, "doc_id long, score double")


def held_out():
    """Whether crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = cut(stats_table(documents(spark, sf_dir)), "statistics")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality IS NOT NULL AND doc_id IS NOT NULL")
    labels = labels.where(~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    out = score(stats, learn(stats.join(labels, "doc_id")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES, ORACLES = {"op8_quality": op8_quality}, {}
