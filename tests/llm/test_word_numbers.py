"""Numbers of words in a chunk: words that are there once take no room of their own."""

import numpy as np
import pytest

from tubula.llm import bpe


@pytest.mark.parametrize("words", ["", "a", "a b c", "a a a", "b a b c d a e", "x y x y z w z v"])
def test_numbers_come_back(words):
    codes = {}
    numbers = np.array([codes.setdefault(w, len(codes)) for w in words.split()], np.int64)
    order = np.argsort(-np.bincount(numbers, minlength=len(codes)), kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    names = bpe._numbers(bpe._numbers_packed(bpe._named(rank[numbers])))
    assert bpe._ranked(names).tolist() == rank[numbers].tolist()
    assert np.count_nonzero(names == 0) == np.count_nonzero(np.bincount(numbers) == 1)
