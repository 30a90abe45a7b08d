"""Token ids of whole texts inside tasks: each distinct span of a task (see spans) is encoded once and its ids are put in its places.

Where a vocabulary numbers its pieces in the order of its merges, spans of plain letters, digits or signs, which are never split
before the merges, are merged by ranks alone; all others go to the tokenizer's own library."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from . import textnum as T
from .bpe import _tokenizer, byte_of_character
from .spans import cuts, spelled

SIGNS = b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
#: Distinct spans that a task remembers.
KNOWN = 1_000_000
#: Bytes of texts that are encoded at once.
RUN = 1 << 21


def merges_by_rank(content: str):
    """A function from a span's bytes to its ids, if the ids are in the order of the merges; else None."""
    import tiktoken

    model = json.loads(content)["model"]
    vocab, names = model["vocab"], byte_of_character()
    merged = [vocab[m.replace(" ", "", 1) if isinstance(m, str) else "".join(m)] for m in model["merges"]]
    ranks = {bytes(names[c] for c in piece): i for piece, i in vocab.items() if all(c in names for c in piece)}
    singles = [i for piece, i in ranks.items() if len(piece) == 1]
    if model.get("dropout") or model.get("ignore_merges") or len(singles) != 256 or merged != sorted(merged) or merged and merged[0] < max(singles):
        return None
    added = {x["content"] for x in json.loads(content)["added_tokens"]}
    ranks = {p: i for p, i in ranks.items() if p.decode("utf-8", "replace") not in added}
    return tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece if len(ranks) == 256 + len(merged) else None


def plain(span: bytes) -> bool:
    """Whether a span is Latin letters, or ASCII digits or signs (no apostrophe), after one space or none."""
    body = span[1:] if span[:1] == b" " else span
    if body.isascii():
        return body.isalpha() or body.isdigit() or bool(body) and not body.strip(SIGNS)
    return max(body) < 0xC9 and body.decode("utf-8", "replace").isalpha()  # to U+023F


class Encoder:
    """Ids of texts by a tokenizer file's content, as its library gives them without special tokens added."""

    def __init__(self, content: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, added = _tokenizer(content)
        self.whole = tuple(a.encode() for a in added)
        self.merge = merges_by_rank(content)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.first, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _numbers(self, spans: list[bytes]) -> np.ndarray:
        new = [s for s in spans if s not in self.known]
        if len(self.known) + len(new) > KNOWN and self.known:
            self._forget()
            new = spans
        if new:
            quick = [self.merge is not None and plain(s) and s not in self.whole for s in new]
            rest = [s.decode("utf-8", "replace") for s, q in zip(new, quick, strict=True) if not q]
            other = (e.ids for at in range(0, len(rest), 4096) for e in self.tokenizer.encode_batch(rest[at : at + 4096], add_special_tokens=False))
            got = [self.merge(s) if q else next(other) for s, q in zip(new, quick, strict=True)]
            sizes = np.fromiter(map(len, got), np.int64, len(got))
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.ids = np.append(self.ids, np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum())))
            self.first = np.append(self.first, self.first[-1] + np.cumsum(sizes))
        return np.fromiter(map(self.known.__getitem__, spans), np.int64, len(spans))

    def runs(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, offsets of the texts in them), for runs of texts; null counts as empty."""
        for _, data, offsets in T.runs(texts, RUN):
            starts = cuts(data, offsets, self.whole)
            each = spelled(data, starts)
            number = self._numbers(each.dictionary.to_pylist())[each.indices.to_numpy()]
            first, size = self.first[number], self.first[number + 1] - self.first[number]
            ends = np.cumsum(size)
            total = int(ends[-1]) if len(ends) else 0
            ids = self.ids[np.arange(total) + np.repeat(first - (ends - size), size)]
            yield ids, np.append(0, ends)[np.searchsorted(starts, offsets)]
