"""What is on the disk and what is shuffled stays in step with the texts."""

import random
from pathlib import Path

import pytest

from bench import shuffled
from tubula.llm import bpe, near_dedup


def test_tables_go_before_the_encoded_rows_are_made(spark, sf, monkeypatch):
    written, cut = {}, bpe.cut

    def noted(df, name, *more, **named):
        written[name] = cut(df, name, *more, **named)
        return written[name]

    monkeypatch.setattr(bpe, "cut", noted)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = bpe.encode(docs)
    left = {n: t for n, t in written.items() if Path(t._cut_path.removeprefix("file:")).exists()}
    assert set(left) == {"numbers", "packs"} and "words" not in left["numbers"].columns
    assert rows.count() == docs.count()


@pytest.mark.parametrize("bits", [near_dedup.BITS, 6])
def test_texts_that_stay_are_not_shuffled(spark, monkeypatch, bits):
    monkeypatch.setattr(near_dedup, "BITS", bits)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for tables too large for it
    try:
        random.seed(bits)
        texts = [" ".join(f"{random.getrandbits(64):x}" for _ in range(3000)) for _ in range(300)]
        copies = {i: i + 10 for i in (5, 80, 200)}
        rows = [(i, texts[i] + " more" if i not in copies.values() else texts[i - 10] + " other", "w", i % 7) for i in range(300)]
        rows += [(None, texts[0], "w", 1), (None, None, None, None)]
        docs = spark.createDataFrame(rows, "doc_id int, text string, word string, `a.Bits` int").repartition(8).cache()
        size, before = sum(len(t) for t in texts), shuffled(spark) if docs.count() else 0
        out = near_dedup.deduplicated(docs)
        assert out.columns == docs.columns
        got = out.collect()
        moved = shuffled(spark) - before
        assert sorted(map(tuple, got), key=str) == sorted((r for r in rows if r[0] not in copies.values()), key=str)
        if bits > 6:
            assert moved < size / 5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
