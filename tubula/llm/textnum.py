"""Words of whole Arrow string batches as numpy arrays, inside tasks.

words() gives quick hashes, which words made for it may share: they serve statistics and partitioning only. Where a result hangs
on words being the same, they are spelled(), that is numbered by their bytes, or told apart by digests()."""

from __future__ import annotations

import ctypes
import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
#: Texts are worked on in runs of about this many bytes, so that the arrays made for them stay small.
RUN = 1 << 21
#: Rows of a batch that are worked on at once.
ROWS = 1000
_rng = np.random.default_rng(20)
_KEY = _rng.integers(1, 2**63, 256, dtype=U) * U(2) + U(1)
_BYTE = _KEY.copy()
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE[_SPACE] = 0
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_BASE = U(0x9E3779B97F4A7C15)


def odd(n: int, seed: int) -> np.ndarray:
    """n random odd multipliers, the same in every process."""
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=U) * U(2) + U(1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(0x7FB5D329728EA185)
    h = (h ^ (h >> U(27))) * U(0x81DADEF4BC2DD44D)
    return h ^ (h >> U(33))


def tidy() -> None:
    """Gives memory that is no longer used back to the system: workers of Python stay when a task ends, with what they hold."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def parts(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that what is made of them stays small; empty ones are left out."""
    for b in batches:
        yield from (b.slice(i, rows) for i in range(0, len(b), rows))
    tidy()


def runs(texts: pa.Array, run: int = RUN) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of the rows in them), for runs of rows; null counts as empty."""
    texts = pc.fill_null(texts, "")
    if not len(texts):
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + run, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def table_of(chars: bytes, lower: bool = False, high: bool = True) -> np.ndarray:
    """A table for words() whose words are made of these ASCII characters and, if `high`, of all others beyond ASCII."""
    out = np.where(np.isin(np.arange(256), list(chars)) | (np.arange(256) >= 128) & high, _KEY, U(0))
    if lower:
        out[65:91] = out[97:123]
    return out


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of a run: start byte, end byte, hash; and each row's first word's number (one more at the end).

    Words are made of the bytes that `table` doesn't give 0; unless one is given, words are [^\\x20\\x09-\\x0D]+."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none.astype(U), np.zeros(len(offsets), np.int64)
    if table is None:
        table = _LOWER if lower else _BYTE
    ink = table[data] != 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = ink.copy()
    first[1:] &= ~ink[:-1] | edge[1:-1]
    last = ink.copy()
    last[:-1] &= ~ink[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    bounds = np.searchsorted(starts, offsets)
    if not len(starts):
        return starts, ends, starts.astype(U), bounds
    spans = np.diff(np.append(starts, len(data)))
    inside = np.arange(starts[0], len(data)) - np.repeat(starts, spans)
    powers = np.cumprod(np.full(int((ends - starts).max()) + 1, _BASE, U))
    values = table[data[starts[0] :]]
    np.minimum(inside, len(powers) - 1, out=inside)
    values = values * powers[inside]
    return starts, ends, mixed(np.add.reduceat(values, starts - starts[0]) + (ends - starts).astype(U)), bounds


def spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> pa.DictionaryArray:
    """The words of a run by their bytes: indices number them, the dictionary has each once."""
    n = ends - starts
    first = np.cumsum(n) - n
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    letters = data[np.cumsum(inside[:-1], dtype=np.int8) > 0]
    if lower:
        letters = np.where((letters >= 65) & (letters < 91), letters + 32, letters).astype(np.uint8)
    edges = np.append(first, len(letters))
    kind, width = (pa.binary(), np.int32) if len(letters) < 1 << 31 else (pa.large_binary(), np.int64)
    return pa.Array.from_buffers(kind, len(n), [None, pa.py_buffer(edges.astype(width)), pa.py_buffer(np.ascontiguousarray(letters))]).dictionary_encode()


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 128-bit digest of each word of a run, as two columns."""
    each = spelled(data, starts, ends, lower)
    made = b"".join(hashlib.blake2b(w, digest_size=16).digest() for w in each.dictionary.to_pylist())
    return np.frombuffer(made, U).reshape(-1, 2)[each.indices.to_numpy()]


def sequences(code: np.ndarray, n: int) -> np.ndarray:
    """A number for each n consecutive codes, the same for the same codes only; exact, by pairs of pairs."""
    code = np.unique(code, return_inverse=True)[1].astype(np.int64) if len(code) else code.astype(np.int64)
    made, reach, powers = code, 1, {1: code}

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1].astype(np.int64)

    while reach * 2 <= n:
        made = joined(made[: max(0, len(made) - reach)], made[reach:])
        reach *= 2
        powers[reach] = made
    out, at = made, reach
    for p in sorted(powers, reverse=True):
        if n - at >= p:
            size = max(0, len(code) - at - p + 1)
            out = joined(out[:size], powers[p][at : at + size])
            at += p
    return out


def windows(hashes: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hash of each n consecutive words (over row bounds too; the caller leaves those out)."""
    if len(hashes) < n:
        return np.zeros(0, U)
    out = np.zeros(len(hashes) - n + 1, U)
    for i, c in enumerate(odd(n, seed)):
        out += hashes[i : len(out) + i] * c
    return mixed(out)
