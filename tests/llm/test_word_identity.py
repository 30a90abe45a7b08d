"""Words are told apart by their letters, whatever hash they have; rows of one id, or none, keep their own results."""

import numpy as np
import pyarrow as pa
import pytest

from tubula.llm import license_scan, near_dedup, substring_dedup
from tubula.llm import textnum as T


def twins(a="a", b="b", doublings=10):
    """Two words of 1,024 letters whose quick hash is the same: each doubling adds the one's twin."""
    for _ in range(doublings):
        a, b = a + b, b + a
    return a, b


def quick(word):
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(T.words(raw, np.array([0, len(raw)]))[2][0])


def test_twins_share_the_quick_hash():
    a, b = twins()
    assert a != b and quick(a) == quick(b)


def test_windows_with_twins_are_not_repeats(spark):
    a, b = twins()
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join([*words[:14], x, *words[15:]]) for x in (a, b, a)]
    rows = {r.doc_id: r.n_removed for r in substring_dedup.without_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert rows == {0: 0, 1: 0, 2: 30}


@pytest.mark.parametrize("crowd", [substring_dedup.CROWD, 0])
def test_short_twins_in_either_way(spark, monkeypatch, crowd):
    monkeypatch.setattr(substring_dedup, "CROWD", crowd)
    test_windows_with_twins_are_not_repeats(spark)


def test_twins_are_not_near_duplicates(spark):
    a, b = twins()
    rows = [(1, a), (2, b), (3, a.upper()), (4, f"{a} x y"), (5, f"{b} x y")]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_pairs_are_compared_by_their_words():
    a, b = twins()
    words = [f"w{i}" for i in range(60)]
    text, other = " ".join([a, *words]), " ".join([b, *words])
    ta, tb = pa.array([text, text, "one two", "one two", ""]), pa.array([other, " ".join(words[:20]), "ONE  two", "one x", ""])
    assert near_dedup.similar(ta, tb).tolist() == [True, False, True, False, False]


def test_template_words_are_exact():
    a, b = twins()
    auto = license_scan.compiled((("x", f"one {a} end"),))

    def found(text):
        raw = np.frombuffer(text.encode(), np.uint8)
        starts, ends, _, bounds = T.words(raw, np.array([0, len(raw)]), table=license_scan.TABLE)
        return len(license_scan.places(auto, T.spelled(raw, starts, ends, lower=True), bounds)[0])

    assert found(f"one {a} end") == 1 and found(f"one {b} end") == 0


def test_many_templates(spark):
    many = tuple((f"l{i}", f"word{i} of") for i in range(150))
    docs = spark.createDataFrame([(1, "x word7 of word149 of y word149"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: [(p.start, p.n, p.template) for p in r.places] for r in license_scan.scan(docs, many).collect()}
    assert got == {1: [(1, 2, 7), (3, 2, 149)], 2: []}
    assert license_scan.from_table(spark.createDataFrame(many, "label string, template string")) == tuple(sorted(many))


def test_sequences_are_exact():
    code = np.random.default_rng(3).integers(0, 3, 400)
    for n in (1, 2, 3, 5, 7, 20):
        made, seen = T.sequences(code, n), {}
        assert len(made) == 400 - n + 1 and all(seen.setdefault(tuple(code[i : i + n]), m) == m for i, m in enumerate(made)) and len(set(seen.values())) == len(seen)
        assert len(T.sequences(code[: n - 1], n)) == 0
