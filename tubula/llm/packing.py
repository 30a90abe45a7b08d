"""Packing documents into sequences of SIZE tokens by cutting-stock column generation.

A document's ids and an end id make its tokens. Whole blocks of SIZE tokens are sequences of their own; what is left of each document,
its tail, is shorter. The histogram of tail lengths, SIZE - 1 rows at most, goes to the driver, where a linear program finds how often
each pattern (lengths that add up to exactly SIZE) should be used, so that most tails are in one. Patterns are not listed: a knapsack
dynamic program over the program's dual prices gives the best new ones (columns) until none is left that is worth its while. The
numbers are rounded down, and up again where tails are left. Tails are ranked within their length by doc_id (see ranks) and a
pattern takes a range of ranks of each of its lengths, so that every task tells a tail's sequence and place by its length and rank.
Tails that no pattern takes are laid end to end and cut at every SIZE tokens; what is left at the very end is cut into powers of
two. So no sequence needs padding, where lengths of powers of two go without.

Defined results: null and empty texts have the end id only; rows that share a doc_id, null ones too, are packed row by row, in the
order in which they were read; texts of any length are read whole; an empty table gives no rows. Columns other than doc_id and
text, whatever their names, are not read."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnum as T
from .bpe import vocabulary
from .common import cut, documents, settled
from .ranks import ordered_long, ranked
from .tokens import Encoder

SIZE, END = 1024, 0
#: The linear program ends when no solution can take more than this much more.
GAP = 0.01
#: Columns that one knapsack table may give.
COLUMNS = 40
#: Knapsack tables at most; what has been found by then is a solution too.
ROUNDS = 100
#: Added to each price, so that of patterns as cheap the one of fewer tails is taken.
FEWER = 1e-7
EPS = 1e-9

Pattern = tuple[tuple[int, int], ...]
"""(length, times) of a sequence, by length."""


def cheapest(prices: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each total up to size: the least sum of prices of lengths (ascending, repeated as you like) with just that total, and the
    length that comes last in it (-1: there is none)."""
    least, last = np.full(size + 1, np.inf), np.full(size + 1, -1)
    least[0] = 0
    upto = np.searchsorted(lengths, np.arange(size + 1), "right")
    for s in range(1, size + 1):
        k = upto[s]
        if k:
            sums = prices[:k] + least[s - lengths[:k]]
            j = int(sums.argmin())
            least[s], last[s] = sums[j], lengths[j] if sums[j] < np.inf else -1
    return least, last


def _pattern(last: np.ndarray, total: int, first: int = 0) -> Pattern:
    parts = Counter([first] if first else [])
    while total:
        parts[int(last[total])] += 1
        total -= int(last[total])
    return tuple(sorted(parts.items()))


def filled(counts: dict[int, int], size: int = SIZE) -> Iterator[Pattern]:
    """Patterns to begin with: the longest tail there is, filled up by one, two or three others, as large as can be, for as long as
    there are such; each pattern leaves some length without tails, or without company."""
    left = np.zeros(size + 1, np.int64)
    left[list(counts)] = list(counts.values())
    left[size] = 0
    for k in sorted(counts, reverse=True):
        while left[k]:
            left[k] -= 1
            found = next((f for n in (1, 2, 3) if (f := _fill(left, size - k, n))), None)
            left[k] += 1
            if not found:
                break
            parts = Counter([k, *found])
            left[list(parts)] -= min(int(left[j]) // n for j, n in parts.items()) * np.array(list(parts.values()))
            yield tuple(sorted(parts.items()))


def _fill(left: np.ndarray, total: int, n: int) -> list[int] | None:
    """n lengths that are left and add up to the total, the first as large as can be."""
    if n == 1:
        return [total] if left[total] else None
    some = np.flatnonzero(left[:total])[::-1]
    if n == 2:
        rest = total - some
        fits = np.flatnonzero(left[rest] > (rest == some))
        return [int(some[fits[0]]), int(rest[fits[0]])] if len(fits) else None
    for a in some.tolist():
        left[a] -= 1
        more = _fill(left, total - a, n - 1)
        left[a] += 1
        if more:
            return [a, *more]
    return None


def relaxed(counts: dict[int, int], size: int = SIZE, gap: float = GAP) -> list[tuple[Pattern, float]]:
    """How often each pattern should be used, whole numbers or not, to take up the most tails' tokens: a primal simplex that begins
    with no pattern at all, over columns as the knapsack prices them."""
    lengths = np.array(sorted(k for k, n in counts.items() if n), np.int64)
    m = len(lengths)
    if not m:
        return []
    have = np.array([counts[k] for k in lengths.tolist()]) + np.random.default_rng(20).uniform(1e-4, 1e-3, m)  # no ties, no steps of 0
    row = {k: i for i, k in enumerate(lengths.tolist())}
    inverse, x, gain, basis = np.eye(m), have.copy(), np.zeros(m), [None] * m

    def enter(p: Pattern) -> bool:
        """Puts the pattern into the basis if it is worth more than what it takes."""
        nonlocal inverse, x
        at, times = [row[k] for k, _ in p], np.array([n for _, n in p], float)
        if 1 - gain @ (inverse[:, at] @ times) < EPS:
            return False
        column = inverse[:, at] @ times
        rise = np.flatnonzero(column > EPS)
        ratio = x[rise] / column[rise]
        out = int(rise[ratio.argmin()])
        step = x[out] / column[out]
        x = np.maximum(x - step * column, 0)
        x[out] = step
        pivot = inverse[out] / column[out]
        inverse -= np.outer(column, pivot)
        inverse[out] = pivot
        gain[out], basis[out] = 1, p
        return True

    for p in filled(counts, size):
        enter(p)
    for _ in range(ROUNDS):
        prices = np.maximum(gain @ inverse, 0)
        least, last = cheapest(prices + FEWER, lengths, size)
        # Prices over the cheapest pattern's are a bound for every solution, and so is that each token is in one sequence at most.
        bound = min(lengths @ have / size, prices @ have / max(least[size] - size * FEWER, EPS))
        if gain @ x >= (1 - gap) * bound:
            break
        ways = prices + least[size - lengths]
        best = lengths[np.argsort(ways, kind="stable")[:COLUMNS]].tolist()
        new = {_pattern(last, size - k, k) for k in best if ways[row[k]] < 1}
        if not any([enter(p) for p in sorted(new) if all(n <= counts[k] for k, n in p)]):
            break
    return [(p, float(v)) for p, v in zip(basis, x.tolist(), strict=True) if p is not None and v > EPS]


def rounded(counts: dict[int, int], plan: list[tuple[Pattern, float]]) -> list[tuple[Pattern, int]]:
    """Whole numbers for the patterns, none of which takes more tails than there are: down, then up while tails are left."""
    left, uses = Counter(counts), {}
    for p, v in plan:
        uses[p] = min([int(v + 1e-6), *(left[k] // n for k, n in p)])
        left.subtract({k: n * uses[p] for k, n in p})
    for p, _ in sorted(plan, key=lambda e: (uses[e[0]] - e[1], e[0])):
        more = min(left[k] // n for k, n in p)
        uses[p] += more
        left.subtract({k: n * more for k, n in p})
    return [(p, n) for p, n in uses.items() if n]


class Layout:
    """Where a tail goes, by its length and rank. The patterns' sequences come first, then those of cut tails, then whole blocks."""

    def __init__(self, counts: dict[int, int], patterns: list[tuple[Pattern, int]], size: int = SIZE) -> None:
        self.size, self.blocks = size, {k: [] for k in counts}
        used, sequence = Counter(), 0
        for p, times in patterns:
            at = 0
            for k, n in p:
                self.blocks[k].append((used[k], sequence, times, at))
                used[k] += n * times
                at += n * k
            sequence += times
        self.used, self.first, self.start, total = used, sequence, {}, 0
        for k in sorted(counts):
            self.start[k] = total
            total += (counts[k] - used[k]) * k
        self.edges, at = [], total - total % size  # the powers of two at the end
        for e in reversed(range(size.bit_length())):
            if total % size >> e & 1:
                self.edges.append((at, at + (1 << e)))
                at += 1 << e
        self.whole = sequence + total // size + len(self.edges)
        self.from_ = {k: np.array([b[0] for b in v]) for k, v in self.blocks.items()}

    def pieces(self, length: int, rank: int) -> list[tuple[int, int, int]]:
        """(length, sequence, offset) of a tail's pieces."""
        if rank < self.used[length]:
            low, sequence, times, at = self.blocks[length][int(np.searchsorted(self.from_[length], rank, "right")) - 1]
            turn, inside = divmod(rank - low, times)
            return [(length, sequence + inside, at + turn * length)]
        at, out = self.start[length] + (rank - self.used[length]) * length, []
        end = at + length
        while at < end:
            number = at // self.size
            low, high = number * self.size, (number + 1) * self.size
            for i, (a, b) in enumerate(self.edges):
                if a <= at < b:
                    low, high, number = a, b, self.edges[0][0] // self.size + i
            out.append((min(end, high) - at, self.first + number, at - low))
            at = min(end, high)
        return out


TOKENS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("tokens", pa.int64()), ("ids", pa.binary())])


def _tokens(content: str, kind: str):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, row = Encoder(content), TaskContext.get().partitionId() << 33
        for b in T.parts(batches):
            out, sizes = [], []
            for ids, offsets in encoder.runs(b.column(1)):
                ids = ids.astype(kind)
                out += [ids[x:y].tobytes() for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                sizes.append(np.diff(offsets) + 1)
            end = np.array([END], kind).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(b))), b.column(0), pa.array(np.concatenate(sizes)), pa.array([x + end for x in out], pa.binary())], schema=TOKENS)
            row += len(b)

    return of


PIECES = pa.schema([*((c, pa.int64()) for c in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")), ("ids", pa.binary())])


def _pieces(layout: Layout, kind: str):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = layout.size
        for b in T.parts(batches):
            rows = []
            for doc, n, ids, rank, block in zip(*(b.column(c).to_pylist() for c in ("doc_id", "tokens", "ids", "rank", "block")), strict=True):
                ids = np.frombuffer(ids, kind).astype("<u4")
                whole = n // size
                parts = [(size, layout.whole + block + i, 0) for i in range(whole)]
                parts += layout.pieces(n % size, rank) if n % size else []
                at = 0
                for length, sequence, offset in parts:
                    rows.append((doc, at, length, n, sequence, offset, ids[at : at + length].tobytes()))
                    at += length
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PIECES, strict=True)], schema=PIECES)

    return of


def packed(docs: DataFrame, content: str | None = None, size: int = SIZE) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit integers) of each piece."""
    content = content or vocabulary()
    kind = "<u2" if max(json.loads(content)["model"]["vocab"].values()) < 1 << 16 else "<u4"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tokens = cut(rows.mapInArrow(_tokens(content, kind), "row long, doc_id long, tokens long, ids binary"), "tokens")
    tail = F.col("tokens") % size
    counts = {k: n for k, n in tokens.groupBy(tail.alias("k")).count().collect() if k}  # size - 1 rows at most
    layout = Layout(counts, rounded(counts, relaxed(counts, size)), size)
    # A row's tail counts once in the group of its length, its whole blocks as often as there are in group 0.
    keyed = tokens.withColumn("key", F.concat(ordered_long(F.col("doc_id")), ordered_long(F.col("row"))))
    tails = keyed.where(tail > 0).select("row", "key", tail.alias("group"), F.lit(1).cast("long").alias("n"))
    whole = keyed.where(F.col("tokens") >= size).select("row", "key", F.lit(0).cast("long").alias("group"), F.expr(f"tokens div {size}").alias("n"))
    placed = ranked(cut(tails.unionByName(whole), "units")).groupBy("row")
    placed = placed.agg(F.max(F.when(F.col("group") > 0, F.col("before"))).alias("rank"), F.max(F.when(F.col("group") == 0, F.col("before"))).alias("block"))
    cols = ", ".join(f"{f.name} {'binary' if f.name == 'ids' else 'long'}" for f in PIECES)
    return tokens.join(placed, "row").select("doc_id", "tokens", "ids", "rank", "block").mapInArrow(_pieces(layout, kind), cols)


def assembled(pieces: DataFrame) -> DataFrame:
    """sequence_id, length, ids: the sequences that pieces make, without padding."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    whole = F.aggregate(parts, F.lit(b""), lambda all_, p: F.concat(all_, p["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), whole.alias("ids"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = settled(lambda: packed(documents(spark, sf_dir)), "pieces")
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES, ORACLES = {"op12_packing": op12_packing}, {}
