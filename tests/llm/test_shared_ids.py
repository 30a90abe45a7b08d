"""Texts that share a doc_id, or have none, each keep their own repeats."""

import pytest

from tubula.llm import substring_dedup
from tubula.llm.substring_dedup import LAST, WINDOW


def plain(rows):
    """(doc_id, n_words, n_removed, kept_text) by brute force."""
    texts = [(LAST if i is None else i, i, (t or "").split()) for i, t in rows]
    first = {}
    for key, _, ws in texts:
        for a in range(len(ws) - WINDOW + 1):
            w = tuple(ws[a : a + WINDOW])
            first[w] = min(first.get(w, (key, a)), (key, a))
    out = []
    for key, i, ws in texts:
        gone = {p for a in range(len(ws) - WINDOW + 1) if first[tuple(ws[a : a + WINDOW])] != (key, a) for p in range(a, a + WINDOW)}
        out.append((i, len(ws), len(gone), " ".join(w for p, w in enumerate(ws) if p not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("crowd", [substring_dedup.CROWD, 0])
def test_texts_that_share_an_id(spark, monkeypatch, crowd):
    monkeypatch.setattr(substring_dedup, "CROWD", crowd)
    words = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    shared, late = words("s", 40), words("a", 60)
    rows = [(1, shared), (None, f"{words('b', 70)} {shared} end"), (None, words("c", 25)), (None, late), (None, f"x {late}"),
            (2, f"{words('d', 90)} {shared}"), (2, words("e", 30)), (2, words("e", 30)), (3, f"{words('f', 5)} {shared}"), (3, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in substring_dedup.without_repeats(df).collect()), key=str)
    assert got == plain(rows)
