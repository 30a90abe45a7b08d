"""Spans of texts that byte-level tokenizers encode independently of each other.

They never join what stands before a white-space run to the run itself, nor letters or digits to another kind of character after
them, so a text can be cut there. Spans are found in numpy and told apart by their bytes. Where the kind of a character isn't told
by one ASCII byte, no cut is made, so that white space beyond ASCII stays with what follows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes by kind: 1 white space, 2 letters, 3 digits, 4 other ASCII, 5 all else, also control characters that may be white space.
_KIND = np.full(256, 5, np.uint8)
_KIND[:128] = [1 if c in b"\t\n\v\f\r " else 2 if chr(c).isalpha() else 3 if chr(c).isdigit() else 5 if 0x1C <= c <= 0x1F else 4 for c in range(128)]
#: UTF-8 forms of white space and its like beyond ASCII, as (all bytes but the last, first and last value of that).
_WIDE = ((b"", 0x1C, 0x1F), (b"\xc2", 0x85, 0x85), (b"\xc2", 0xA0, 0xA0), (b"\xe1\x9a", 0x80, 0x80), (b"\xe1\xa0", 0x8E, 0x8E), (b"\xe2\x80", 0x80, 0x8F), (b"\xe2\x80", 0xA8, 0xAF), (b"\xe2\x81", 0x9F, 0xA0), (b"\xe3\x80", 0x80, 0x80), (b"\xef\xbb", 0xBF, 0xBF))


def cuts(data: np.ndarray, offsets: np.ndarray, whole: tuple[bytes, ...] = ()) -> np.ndarray:
    """First bytes of the spans of a run of texts; no span begins inside one of the strings `whole`."""
    kind = _KIND[data]
    before, now = kind[:-1], kind[1:]
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = (now == 1) & (before != 1) | (before >= 2) & (before != now) & (before < 4) & (now >= 2) & (now < 5)
    odd = np.flatnonzero((before == 5) & (now == 1)) + 1  # white space after what may be white space itself
    for lead, low, high in _WIDE:
        hit = (data[odd - 1] >= low) & (data[odd - 1] <= high) & (odd > len(lead))
        for k, byte in enumerate(reversed(lead)):
            hit &= data[np.maximum(odd - 2 - k, 0)] == byte
        edge[odd[hit]] = False
    text = data.tobytes() if whole else b""
    for w in whole:
        at = text.find(w)
        while at >= 0:
            edge[at + 1 : at + len(w)] = False
            at = text.find(w, at + 1)
    edge[offsets] = True
    return np.flatnonzero(edge[:-1])


def spelled(data: np.ndarray, starts: np.ndarray) -> pa.DictionaryArray:
    """The spans of a run by their bytes: indices number them, the dictionary has each once."""
    edges, small = np.append(starts, len(data)), len(data) < 1 << 31
    kind, width = (pa.binary(), np.int32) if small else (pa.large_binary(), np.int64)
    return pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(edges.astype(width)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
