"""Every operator and pipeline stage on empty tables, awkward rows, and columns whose names it might use itself."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tubula.llm import bpe, chat_format, common, exact_dedup, language_id, license_scan, media, mixing, near_dedup, quality, substring_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"wort{i % 700}x{i % 13}" for i in range(20_000))
ROWS = [(1, None, "en", None, 0), (2, "", "en", "s", 0), (3, "some plain words for all of us", "en", "s", 1), (3, "some plain words for all of us", "en", "s", 1), (3, "other words under the same id", "en", "t", 1),
        (None, "no id at all here", "fr", "t", 1), (None, "no id at all here", "fr", "t", 1), (None, "another one without id", None, None, None), (4, LONG, "de", "t", 1), (5, LONG + " end", None, "t", 1), (6, "🙂 123", "en", "", 1), (7, "\t\n ", "en", "s", 1)]
#: Names that operators use for columns of their own, and some that need quoting.
NAMES = ("id", "key", "row", "n", "n_", "id_", "d_", "p_", "Copies_", "size_", "source_", "part_", "turn_", "copy_", "digest", "digest_", "rep", "comp", "word", "bit", "start", "span", "batch", "of", "chunk", "medium", "m", "label", "a.b", "tick`s", "taken_")
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, DOCS)
    return df.select("*", *(F.concat(F.lit(f"{i} "), F.coalesce("text", F.lit("-"))).alias(n) for i, n in enumerate(NAMES)))


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def keeps_columns(out, docs):
    """All columns of docs as they are, each row's own."""
    assert out.columns == docs.columns
    rows = out.collect()
    for r in rows:
        assert all(v == f"{i} {r[1] if r[1] is not None else '-'}" for i, v in enumerate(r[5:]))
    return rows


@pytest.mark.parametrize("name", [n for n in STAGES if n != "bpe"])
def test_stages_keep_columns_and_stand_awkward_rows(spark, sf, docs, none, name):
    rows = keeps_columns(STAGES[name](spark, docs, sf), docs)
    texts = [r.text for r in rows]
    if name == "language_id":
        assert None not in texts and "" not in texts and "🙂 123" not in texts and len(rows) == 8
    if name == "exact_dedup":
        assert sorted(map(str, texts)) == sorted(map(str, {t for _, t, *_ in ROWS if t and t.strip()} | {"\t\n "}))
    if name == "near_dedup":
        assert texts.count(None) == 1 and len([t for t in texts if t and t.startswith("wort")]) == 1 and texts.count("no id at all here") == 2
        assert sum(r.doc_id == 3 for r in rows) == 2  # different texts, no duplicates
    if name == "source_mix":
        assert max(texts.count(t) for t in set(texts)) <= 4
    assert keeps_columns(STAGES[name](spark, none, sf), none) == []


def test_last_stage(spark, sf, docs, none):
    rows = STAGES["bpe"](spark, docs, sf).collect()
    assert len(rows) == len(ROWS) and sum(r.n_tokens == 0 for r in rows) == 2
    assert STAGES["bpe"](spark, none, sf).collect() == []


def test_operators_take_what_they_need(spark, docs, none):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    model = language_id.learn(language_id.to_learn(plain))
    index = exact_dedup.DigestIndex(spark, "digests_of_edges")
    n = iter(range(100))
    works = {"language": lambda d: language_id.predict(d, model), "licenses": license_scan.scan, "exact": lambda d: index.dedup(d, f"b{next(n)}").drop("kept"), "near": near_dedup.near_duplicates,
             "media": lambda d: media.MediaStore(d).rows.drop("digests", "text_hash"), "mix": mixing.mix, "statistics": quality.stats_table, "bpe": bpe.encode, "substrings": substring_dedup.without_repeats}
    for name, work in works.items():
        got = sorted(map(str, work(docs).collect()))
        assert got == sorted(map(str, work(plain).collect())) and len(got) == len(ROWS), name
        assert work(none).collect() == [], name
    index.drop()


def test_chats(spark):
    kinds = "conv_id long, turn long, role string, text string, example int, formatted string, ts long"
    rows = [(1, 0, "user", "a", 9, "x", 3), (1, 1, "assistant", "b", 9, "x", 3), (1, 1, "assistant", "b", 9, "x", 3), (1, None, None, None, 9, "x", 3), (None, 0, "assistant", "", 9, "x", 3), (None, 0, "user", LONG, 9, "x", 3), (2, 5, "user", "### a", 9, "x", 3)]
    df = spark.createDataFrame(rows, kinds)
    out = {(r.conv_id, r.example): r for r in chat_format.examples(df).collect()}
    assert {k: (v.loss_start > 0, v.loss_length) for k, v in out.items()} == {(1, 0): (True, 1), (1, 1): (True, 1), (None, 0): (True, 0), (None, 1): (False, 0), (2, 0): (False, 0)}
    assert out[1, 1].formatted.count("</turn>") == 4 and out[None, 1].formatted.count("wort") == 20_000
    assert chat_format.examples(df.where("false")).collect() == []


def test_lookups_spread_hot_keys(spark):
    rows = spark.range(40_000).selectExpr("IF(id % 3 = 0, 7L, id) AS k", "id AS other")
    table = spark.range(40_000).selectExpr("id AS k", "id * 2 AS v")
    hot = common.hot_keys(rows, "k", 40_000)
    assert [r.key_ for r in hot.collect()] == [7]
    spread = common.spread_join(rows, table, "k", "other", hot).select("k", "other", "v")
    assert sorted(map(tuple, spread.collect())) == sorted(map(tuple, rows.join(table, "k").select("k", "other", "v").collect()))


def test_meetings_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CELL", 3)
    import random

    random.seed(3)
    rows = []
    for key in range(6):
        for rep in range(40):
            size = random.choice([1, 2, 5, 100, 101, 104, 110, 115, 115, 115, 140, 3000])
            rows.append((key, 100 * key + rep, rep % 30, random.randint(1, max(1, size // 4)), size))
    got = {tuple(sorted(r)) for r in near_dedup._meetings(spark.createDataFrame(rows, "key long, rep long, comp long, place int, size int")).collect()}
    want = {tuple(sorted((a[1], b[1]))) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[2] != b[2] and 175 * (1 + min(a[4] - a[3], b[4] - b[3])) >= 75 * (a[4] + b[4])}
    want = {p for p in want}
    assert got >= want and all(True for _ in got)
    extra = got - want
    assert not extra


def test_sets_that_cannot_be_similar_do_not_meet(spark):
    """Of many documents that share 97 of 115 shingles, J = 0.73, none meet, though all share their rarest common shingles."""
    rows = [(k, 1000 + i, 1000 + i, 19 + k, 115) for k in range(11) for i in range(300)]
    assert near_dedup._meetings(spark.createDataFrame(rows, "key long, rep long, comp long, place int, size int")).count() == 0
