"""The learned operators against plain loops over given weights, and their edges."""

import itertools
import math

import numpy as np
import pyarrow as pa
import pytest

from tubula.llm import language_id, quality
from tubula.llm import textnum as T

EDGES = [(1, None), (2, ""), (3, " \t\n "), (4, "🙂 123"), (5, "a"), (5, "a"), (None, "no id é"), (6, "ab Cd " * 4000)]


def features(word):
    """Positions of a word's features but for the lexicon, written out."""
    raw = [b + 32 if 65 <= b < 91 else b for b in word.encode()]
    mix = lambda x, seed, size: ((x * 2654435761 + seed) % 2**32) >> (33 - size.bit_length())
    v = [0, 0, *raw, 0]
    two = lambda i: v[i - 1] * 256 + v[i]
    three = lambda i: (v[i - 2] * 65536 + two(i)) % 2**32
    out = []
    for i in range(2, len(v)):
        out += [mix(two(i), 0, language_id.GRAMS // 2), mix(three(i), 77, language_id.GRAMS // 2) + language_id.GRAMS // 2]
    first, last = 2, len(raw) + 1
    begin = three(first + 2) if len(raw) > 2 else two(min(first + 1, last + 1))
    each = [v[first] * 256 + v[min(first + 1, last + 1)], begin + (1 << 25), v[max(last - 1, first - 1)] * 256 + v[last] + (1 << 26), three(last) + (1 << 27)]
    return out + [mix(x % 2**32, 13 * k, language_id.AFFIXES) + language_id.GRAMS for k, x in enumerate(each)]


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(4)
    words = ["the", "une", "ño"]
    lexicon = np.sort(np.concatenate([T.words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]), table=language_id.TABLE)[2] for w in words]))
    none = language_id.GRAMS + language_id.AFFIXES + 3
    members = np.array([[none - 3 + k if k == i else none for k in range(3)] for i in range(3)])
    m = language_id.Model.empty(["de", "en", "fr"], lexicon, members)
    m.weights[:-1] = rng.normal(size=(len(m.weights) - 1, 3)) / 3
    m.moves[:] = rng.normal(size=(3, 3))
    return m


def plain_prediction(model, text):
    """Language and score by all sequences of languages."""
    words = language_id.regex.findall(r"[A-Za-z\x80-\U0010FFFF]+", text or "")
    if not language_id.LETTER.search(text or ""):
        return "und", 0.0
    scores = []
    for w in words:
        h = T.words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]), table=language_id.TABLE)[2][0]
        own = [p for known, row in zip(model.lexicon, model.members, strict=True) if known == h for p in row]
        scores.append(sum(model.weights[p].astype(float) for p in features(w) + own))
    mean = np.zeros(3)
    total = 0.0
    for path in itertools.product(range(3), repeat=len(words)):
        weight = math.exp(sum(s[k] for s, k in zip(scores, path, strict=True)) + sum(float(model.moves[a, b]) for a, b in zip(path, path[1:], strict=False)))
        total += weight
        for k in path:
            mean[k] += weight / len(words)
    return model.languages[int(mean.argmax())], float(mean.max() / total)


def test_predictions_against_all_sequences(spark, model):
    texts = ["the cat", "Une ño the a", "Ärger 12 the-THE x", "a", "", None, "ño", "zz yyy xxxx www vv u"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        lang, score = plain_prediction(model, t)
        assert got[i][0] == lang and abs(got[i][1] - score) < 1e-4


def test_segments_give_what_whole_texts_give():
    rng = np.random.default_rng(5)
    bounds = np.cumsum([0, 3, 50, 0, 7, 21, 1])
    scores, moves = rng.normal(size=(bounds[-1], 4)), rng.normal(size=(4, 4))
    whole = language_id.forward_backward(scores, bounds, moves)
    for n in (1, 5, 7, 20):
        assert np.allclose(language_id.forward_backward(scores, bounds, moves, segment=n), whole)


def test_language_edges(spark, model):
    df = spark.createDataFrame(EDGES, "doc_id long, text string")
    rows = language_id.predict(df, model).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in EDGES) and all(0 <= r.score <= 1 for r in rows)
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == {1, 2, 3, 4}
    assert next(r for r in rows if r.doc_id == 6).n_words == 8000
    lots = spark.range(300).selectExpr("id AS doc_id", "'some text' AS text", "concat('l', id) AS lang")
    with pytest.raises(ValueError, match="languages; say"):
        language_id.learn(language_id.to_learn(lots))
    some = language_id.learn(language_id.to_learn(lots), most=20)
    assert len(some.languages) == 20 and some.left_out[0] > 200 and some.left_out[1] > 0


def plain_statistics(text):
    """What STATS names, written out."""
    raw, words = (text or "").encode(), (text or "").encode().split()
    size, n = max(len(raw), 1), max(len(words), 1)
    share = lambda ok: sum(map(ok, raw)) / size
    spaces, marks = b"\t\n\x0b\x0c\r ", b".,;:!?'\"()-"
    symbol = lambda b: b < 128 and not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b in spaces or b in marks)
    tri = list(zip(words, words[1:], words[2:], strict=False))
    lines = [x for x in raw.split(b"\n") if x]
    return [math.log1p(len(raw)), math.log1p(len(words)), share(lambda b: 65 <= b < 91), share(lambda b: 48 <= b < 58), share(lambda b: b >= 128), share(lambda b: b in spaces), share(lambda b: b in marks), share(symbol),
            sum(map(len, words)) / n, len(set(words)) / n, max((words.count(w) for w in set(words)), default=0) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, sum(a == b for a, b in zip(words, words[2:], strict=False)) / n,
            len(set(tri)) / max(len(tri), 1), sum(symbol(w[-1]) for w in words) / n, sum(len(w) <= 2 for w in words) / n, len(words) / max(len(lines), 1), len(set(lines)) / max(len(lines), 1), sum(w[-1:] == b"!" for w in words) / n]


def test_statistics_against_plain_loops():
    texts = ["One two, two two! A1 #x y\n\nsame line\nsame line\n(é) ö", "", "a", "  ", "b b b b b b", None, "x\x0by\x0cz\r"]
    for (at, data, offsets) in T.runs(pa.array(texts)):
        got = quality.statistics(data, offsets)
        assert at == 0 and np.allclose(got, [plain_statistics(t) for t in texts])


def test_trees_against_a_plain_walk(spark, sf):
    stats = quality.stats_table(spark.read.parquet(f"{sf}/documents.parquet"))
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality IS NOT NULL").selectExpr("doc_id", "CAST(quality AS INT) AS label")
    trees = quality.learn(stats.join(labels, "doc_id"))
    assert len(trees.roots) == quality.TREES

    def walk(node, row):
        if trees.left[node] == node:
            return trees.value[node]
        return walk(trees.left[node] + (row[trees.stat[node]] > trees.edge[node]), row)

    rows = stats.toPandas()
    got = {r.doc_id: r.score for r in quality.score(stats, trees).collect()}
    for i, *row in rows.itertuples(index=False):
        want = 1 / (1 + math.exp(-(trees.start + sum(walk(r, row) for r in trees.roots))))
        assert abs(got[i] - want) < 1e-9


def test_first_split_against_a_plain_search(spark):
    """With one statistic that tells the labels apart, the first tree splits there, and its leaves have the sums' values."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, len(quality.STATS)))
    y = (x[:, 3] > 0.2).astype(int)
    rows = [(i, *map(float, r), int(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"{s} double" for s in quality.STATS) + ", label int")
    trees = quality.learn(df)
    root = trees.roots[0]
    edge = trees.edge[root]
    assert trees.stat[root] == 3 and abs(edge - 0.2) < 0.15
    mean = (y.mean() + 1e-6) / (1 + 0e-6)
    p = 1 / (1 + math.exp(-trees.start))
    assert abs(p - mean) < 1e-4
    for child, side in ((0, x[:, 3] <= edge), (1, x[:, 3] > edge)):
        g, h = (y - p)[side].sum(), p * (1 - p) * side.sum()
        assert abs(trees.value[trees.left[root] + child] - quality.RATE * g / (h + quality.SMOOTH)) < 1e-9


def test_quality_edges(spark):
    df = spark.createDataFrame(EDGES, "doc_id long, text string")
    stats = quality.stats_table(df)
    labelled = stats.where("doc_id IS NOT NULL").selectExpr("*", "CAST(doc_id % 2 AS INT) AS label")
    for trees in (quality.learn(labelled), quality.learn(labelled.where("label = 1")), quality.learn(labelled.where("false"))):
        rows = quality.score(stats, trees).collect()
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in EDGES) and all(0 <= r.score <= 1 for r in rows)
