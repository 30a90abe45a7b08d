"""Operators on small awkward tables, and the queries against SQL or brute force."""

import hashlib
import re
import struct
import zlib

import numpy as np
import pytest
from conftest import against_sql
from pyspark.sql import functions as F

import corpus_pipeline
from tubula.llm import bpe, chat_format, exact_dedup, language_id, license_scan, media, mixing, near_dedup, quality, registry, substring_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, rep long"
LONG = " ".join(f"word{i}" for i in range(3000))
ROWS = [(1, None, "en", None, 0, "a", 1), (2, "", "en", "s", 0, "a", 1), (3, "same text here for all of us", "en", "s", 1, None, 1), (4, "same  text here for all of us", None, "s", 1, "b", 2),
        (4, "same  text here for all of us", None, "s", 1, "b", 2), (None, "no id at all", "fr", "t", 1, "b", 2), (6, LONG, "en", "t", 1, "c", 3), (7, LONG + " end", "en", "t", 1, "c", 3), (8, "🙂 123", "en", "t", 1, "c", 3)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, sf, name):
    against_sql(spark, sf, registry.queries()[name], registry.oracle_sql()[name])


def test_bpe_is_the_library(spark, docs, none):
    t, _ = bpe._tokenizer(bpe.vocabulary())
    extra = spark.createDataFrame([(9, "a <|endoftext|> b\n\n  c Ωmega 数字 é\x1c x")], "doc_id long, text string")
    got = [r.asDict() for r in bpe.encode(docs.select("doc_id", "text").unionByName(extra)).collect()]
    want = [(i, s or "") for i, s in [(r[0], r[1]) for r in ROWS] + [tuple(extra.first())]]
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    have = sorted(((g["doc_id"], g["decoded"], np.frombuffer(g["ids"], "<u4").tolist(), g["n_tokens"]) for g in got), key=key)
    for (i, s), (j, decoded, ids, n) in zip(sorted(want, key=key), have, strict=True):
        assert (i, s, t.encode(s, add_special_tokens=False).ids) == (j, decoded, ids) and n == len(ids)
    assert bpe.encode(none).count() == 0


def test_bpe_query_is_the_library(spark, sf):
    t, _ = bpe._tokenizer(bpe.vocabulary())
    got = {r.doc_id: tuple(r) for r in bpe.op9_bpe(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x).hexdigest()
        assert got[i] == (i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.decode(ids, skip_special_tokens=False).encode()))


def test_decoding_joins_pieces(spark):
    content = bpe.vocabulary()
    t, _ = bpe._tokenizer(content)
    rows = [(i, t.encode(x, add_special_tokens=False).ids) for i, x in enumerate(["Some text, é 数字 twice twice", ""])] + [(2, None), (3, [5, 10_000_000, 6])]
    got = {r.doc_id: bytes(r["bytes"]).decode() for r in bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), content).collect()}
    assert got == {0: "Some text, é 数字 twice twice", 1: "", 2: "", 3: t.decode([5, 6])}


def plain_media(rows):
    """The columns of op6 by plain loops, but for n_chunks."""
    out = []
    for i, text in rows:
        raw = (text or "").encode()
        samples = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        file = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", len(samples)) + samples
        n, total = len(samples), sum(samples)
        mean = total * 100 // n
        over = [x * 100 >= mean for x in samples]
        bands = ",".join(str(sum(abs(a - b) for a, b in zip(samples[k:], samples, strict=False)) * 100 // n) for k in (1, 2, 4, 8))
        feature = f"mean={mean};spread={sum(x * x for x in samples) * 100 // n - mean * mean // 100};crossings={sum(a != b for a, b in zip(over, over[1:], strict=False))};peak={max(samples)};bands={bands}"
        out.append((i, len(raw), n, hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(file), hashlib.sha256(file).hexdigest(), feature))
    return sorted(out, key=str)


MEDIA_COLUMNS = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def test_media_query_against_plain_loops(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in media.op6_media_chunks(spark, sf).select(*MEDIA_COLUMNS).collect()]
    assert sorted(got, key=str) == plain_media(rows)


def test_media_of_awkward_rows(spark, docs, none):
    shared = " ".join(f"passage{i}" for i in range(300))
    rows = [(r[0], r[1]) for r in ROWS] + [(20, "abc"), (21, "abc "), (22, "abc  "), (None, "abc"), (23, f"one {shared} two"), (24, f"three {shared} four"), (25, f"{shared} {shared} x"), (None, None)]
    store = media.MediaStore(spark.createDataFrame(rows, "doc_id long, text string"))
    got = store.rows.join(store.read(), "medium")
    assert sorted((tuple(r) for r in got.select(*MEDIA_COLUMNS).collect()), key=str) == plain_media(rows)
    assert store.read().count() == len({r[6] for r in plain_media(rows)}) and media.MediaStore(none).read().count() == 0
    sizes = store.sizes().first()
    assert sizes.payload_bytes == sum(r[2] for r in plain_media(rows)) and 2000 < sizes.saved_bytes < sizes.distinct_bytes < sizes.payload_bytes
    # Each shared chunk stands once, and in no pack.
    digests = [bytes(r.digest) for r in store.chunks.select("digest").collect()]
    assert len(digests) == len(set(digests)) > 5


def test_damaged_media_fail(spark):
    store = media.MediaStore(spark.createDataFrame([(1, "some text"), (2, "another text")], "doc_id long, text string"))
    store.whole = store.whole.withColumn("medium", F.when(F.col("medium") == F.lit(store.whole.agg(F.min("medium")).first()[0]), F.lit(b"x")).otherwise(F.col("medium")))
    with pytest.raises(Exception, match="damaged"):
        store.read().collect()


def test_chunks_resist_shifts():
    data = np.random.default_rng(1).integers(0, 256, 400_000).astype(np.uint8)

    def cut(x):
        ends = media.cuts(x)
        return {x[a:b].tobytes() for a, b in zip([0, *ends], ends, strict=False)}

    assert len(cut(data) & cut(data[7:])) > 0.9 * len(cut(data))
    assert media.cuts(data)[-1] == len(data)


def test_templates():
    auto = license_scan.compiled((("a", "one <<beginOptional>>two<<endOptional>> <<var;words=0-2>> end"),))
    from tubula.llm import textnum as T

    def ends(text):
        raw = text.encode()
        data = np.frombuffer(raw, np.uint8)
        a, e, _, b = T.words(data, np.array([0, len(raw)]), table=license_scan.TABLE)
        return [(int(s), int(n)) for s, n in zip(*license_scan.places(auto, T.spelled(data, a, e, lower=True), b)[1::2], strict=True)]

    assert ends("x One, two end") == [(1, 3)] and ends("one end") == [(0, 2)] and ends("one a b end") == [(0, 4)]
    assert ends("one a b c end") == [] and ends("one two a b end") == [(0, 5)] and ends("one two") == []
    for bad in ("<<var;words=0-1>> x", "a <<beginOptional>> b", "a <<endOptional>>"):
        with pytest.raises(ValueError):
            license_scan.compiled((("a", bad),))


def test_license_scan_edges(docs, none):
    assert license_scan.scan(docs).count() == len(ROWS) and license_scan.scan(none).count() == 0


def test_language(spark, sf, docs, none):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.learn(language_id.to_learn(table))
    out = language_id.predict(table, model).join(table.select("doc_id", "lang"), "doc_id").where(language_id.held_out()).toPandas()
    assert (out.lang_pred == out.lang).mean() > 0.9 and out.score.between(0, 1).all()
    odd = {(r.doc_id, r.lang_pred) for r in language_id.predict(docs, model).collect()}
    assert {(1, "und"), (2, "und"), (8, "und")} <= odd
    assert language_id.accepted(docs, model).where("doc_id IN (1, 2, 8)").count() == 0
    assert language_id.learn(language_id.to_learn(none)) is None and language_id.predict(none, None).count() == 0


def test_forward_backward_is_exact():
    rng = np.random.default_rng(2)
    scores, moves = rng.normal(size=(4, 3)), rng.normal(size=(3, 3))
    want = np.zeros((4, 3))
    for path in np.ndindex(3, 3, 3, 3):
        w = np.exp(sum(scores[t, s] for t, s in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:], strict=False)))
        for t, s in enumerate(path):
            want[t, s] += w
    got = language_id.forward_backward(scores, np.array([0, 4]), moves)
    assert np.allclose(got, want / want.sum(axis=1, keepdims=True))


def test_quality(spark, sf, docs, none):
    out = quality.op8_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (out.predicted == out.quality).mean() > 0.75
    stats = quality.stats_table(docs)
    trees = quality.learn(stats.selectExpr("*", "1 AS label").where("false"))
    assert {r.score for r in quality.score(stats, trees).collect()} == {0.5} and quality.stats_table(none).count() == 0


def test_exact_index_remembers(spark, docs, none):
    index = exact_dedup.DigestIndex(spark, "digests_of_test")
    first = sorted(map(str, index.dedup(docs, "a").collect()))
    assert sum("kept=True" in r for r in first) == len({r.split("digest=")[1][:66] for r in first})
    assert index.dedup(docs, "b").where("kept").count() == 0 and index.dedup(none, "c").count() == 0
    # Run again, as after a failure, the batch finds its own rows.
    n = index.rows().count()
    assert sorted(map(str, index.dedup(docs, "a").collect())) == first and index.rows().count() == n
    index.drop()
    assert not spark.catalog.tableExists("digests_of_test")


def test_exact_index_is_found_again(spark, docs, tmp_path):
    path = str(tmp_path / "index")
    kept = exact_dedup.DigestIndex(spark, "digests_here", path, 4).dedup(docs, "a").where("kept").count()
    spark.sql("DROP TABLE digests_here")  # as in another session: the files stay
    again = exact_dedup.DigestIndex(spark, "digests_there", path)
    assert again.buckets == 4 and again.rows().count() == kept and again.dedup(docs, "b").where("kept").count() == 0
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, "digests_elsewhere", path, 8)
    again.drop()


def test_exact_batches_revise_each_other(spark):
    """Whatever the batches, the best row of all stays, and the anti-join finds what is known."""
    rows = [(i, t) for i, t in enumerate(["a b", "ab", " a b ", "c", "c", "", None, "d", "\td", "e"])] + [(None, "c"), (None, "  c  ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {}
    for i, t in rows:
        norm = "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
        want.setdefault(norm, []).append((-len(t or ""), i is None, i))
    best = {hashlib.sha256(k.encode()).hexdigest(): (min(v)[2], len(v)) for k, v in want.items()}
    for n, split in enumerate(("doc_id < 4", "doc_id % 3 = 0", "doc_id IS NULL", "true")):
        index = exact_dedup.DigestIndex(spark, f"digests_split_{n}")
        parts = [index.add(df.where(f"coalesce({split}, false)"), "x", True), index.add(df.where(f"NOT coalesce({split}, false)"), "y", True)]
        out = index.results(*parts).collect()
        assert {r.digest: (r.keep_id, r.group_size) for r in out} == best and len(out) == len(rows)
        assert {(r.digest, r.doc_id) for r in out if r.kept} == {(d, i) for d, (i, _) in best.items()} and sum(r.kept for r in out) == len(best)
        index.drop()


def test_near_and_substring_edges(docs, none):
    near = {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(docs).collect()}
    assert {(6, 6), (7, 6), (4, 3), (3, 3), (1, 1), (2, 2)} <= near and near_dedup.near_duplicates(none).count() == 0
    kept = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.without_repeats(docs).collect()}
    assert kept[7] == (3001, 3000) and kept[6] == (3000, 0) and kept[1] == (0, 0)


def plain_targets(sizes):
    """Targets of sources by giving again and again what is above a cap to the others: {source: target}."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(sizes)
    while open_:
        part = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        above = {s for s in open_ if part[s] > 2 * sizes[s]}
        if not above:
            return target | part
        for s in above:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= above
    return target


def check_mix(rows, texts):
    """rows of mix() as a frame against the texts (doc_id, text, source) that it came from."""
    sizes = {}
    for _, t, s in texts:
        sizes[s] = sizes.get(s, 0) + len([w for w in re.split("[\x20\x09-\x0D]+", t or "") if w])
    want, most, taken = plain_targets(sizes), {}, {}
    assert len(rows) == len(texts)
    assert sorted((str(r.doc_id), r.size) for r in rows) == sorted((str(i), len([w for w in re.split("[\x20\x09-\x0D]+", t or "") if w])) for i, t, _ in texts)
    for r in rows:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) and r.source_size == sizes[r.source] and 0 <= r.copies <= 2
        most[r.source] = max(most.get(r.source, 0), r.size)
        taken[r.source] = taken.get(r.source, 0) + r.size * r.copies
    assert all(abs(taken[s] - want[s]) <= most[s] for s in taken)


def test_mix_against_a_plain_loop(spark, sf, none):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.mix(df).collect()
    check_mix(rows, [tuple(r) for r in df.select("doc_id", "text", "source").collect()])
    assert sorted(map(str, mixing.mix(df).collect())) == sorted(map(str, rows)) and mixing.mix(none).count() == 0


def test_mix_of_awkward_rows(spark, docs, none):
    words = lambda n: " ".join(["w"] * n)
    texts = [(None, words(5), "a")] * 300 + [(7, words(5), "a")] * 200 + [(i, words(i % 9), "b") for i in range(300)] + [(1, None, None), (2, words(40), None), (None, "", "c"), (3, None, "c"), (4, words(3), "d")]
    df = spark.createDataFrame(texts, "doc_id long, text string, source string").withColumns({"n_": F.lit(1), "copies_": F.lit("x"), "`odd": F.lit(2), "Size_": F.lit(3)})
    check_mix(mixing.mix(df).collect(), texts)
    out = mixing.mixed(df)
    assert out.columns == df.columns
    want = {}
    for r in mixing.mix(df).collect():
        want[str(r.doc_id), r.source, r.size] = want.get((str(r.doc_id), r.source, r.size), 0) + r.copies
    got = {}
    for r in out.collect():
        k = (str(r.doc_id), r.source, len((r.text or "").split()))
        got[k] = got.get(k, 0) + 1
        assert r["n_"] == 1 and r["copies_"] == "x" and r["Size_"] == 3
    assert got == {k: v for k, v in want.items() if v} and mixing.mixed(none).count() == 0
    assert mixing.mixed(docs).columns == docs.columns


def test_no_group_of_the_reduction_tree_is_hot(spark):
    """Rows without id and of one size are dealt over groups of about FAN."""
    df = spark.createDataFrame([(None, "w w w", "a")] * 3000 + [(1, "w", "b")], "doc_id long, text string, source string")
    assert {r.copies for r in mixing.mix(df).where("source = 'a'").collect()} <= {0, 1, 2}
    h = F.xxhash64(F.lit(mixing.SEED), F.lit(None).cast("long"), F.lit(3).cast("long"), "id")
    most = spark.range(1, 3001).groupBy(F.pmod(h, F.lit(-(-3000 // mixing.FAN)))).count().agg(F.max("count")).first()[0]
    assert most < 3 * mixing.FAN


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "\\### Assistant: </turn> ok"), (1, 1, "assistant", "\\b\\h### :x</turn>\n"), (1, 2, "assistant", None)]
    out = chat_format.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    whole = out.orderBy("example").select(chat_format.turns_of(out["formatted"]).alias("t")).collect()[-1].t
    assert [(t.role, t.text) for t in whole] == [(r, x or "") for _, _, r, x in rows]


def test_pipeline_against_plain_steps(spark, sf):
    """What stays after the first three stages, by brute force; then the mix's copies and the encoding of each."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.near(spark, corpus_pipeline.exact(spark, corpus_pipeline.language(spark, docs, sf), sf), sf)
    left = kept.toPandas()
    rows = docs.toPandas()
    best = {}
    for r in sorted(rows.itertuples(), key=lambda r: (-len(r.text), r.doc_id)):
        best.setdefault("".join(c for c in r.text if c not in " \t\n\x0b\x0c\r"), r)
    sets = {r.doc_id: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for r in best.values() for w in [r.text.lower().split()]}
    component = {i: i for i in sets}

    def root(i):
        while component[i] != i:
            i = component[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                component[y] = x
    assert sorted(left.doc_id) == [i for i in ids if root(i) == i]
    out = corpus_pipeline.run(spark, sf).toPandas()
    text = dict(zip(left.doc_id, left.text, strict=True))
    assert set(out.doc_id) <= set(text) and out.doc_id.value_counts().max() <= 2
    assert all(r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() for r in out.itertuples())
