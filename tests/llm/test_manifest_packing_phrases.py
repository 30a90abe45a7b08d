"""Hash trees, packing and phrases against plain loops, on awkward rows, ties, repeated rows, empty tables and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tubula.llm import bpe, collocations, merkle, packing, ranks, tokens
from tubula.llm.common import cut

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = ("id", "key", "group", "n", "tree", "digits", "h", "load", "row", "tokens", "ids", "rank", "block", "phrase", "size", "word", "prefix", "Leaf", "siblings", "a.b")


def clashing(df):
    return df.select("*", *(F.lit(1).alias(n) for n in NAMES))


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def plain_siblings(levels, i):
    out = []
    for nodes in levels[:-1]:
        first = i - i % 3
        out.append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + 3])))
        i //= 3
    return out


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row (doc_id, source, lang, n_chars, text)."""
    trees = defaultdict(list)
    for r in rows:
        trees[(r[1] is not None, (r[1] or "").encode())].append(((r[0] is not None, r[0] or 0, plain_leaf(r)), r))
    names = sorted(trees)
    levels = {k: plain_levels([key[2] for key, _ in sorted(trees[k], key=lambda e: e[0])]) for k in names}
    top, out = plain_levels([levels[k][-1][0] for k in names]), []
    for j, k in enumerate(names):
        for i, (key, r) in enumerate(sorted(trees[k], key=lambda e: e[0])):
            way = plain_siblings(levels[k], i) + plain_siblings(top, j)
            h = plain_leaf((*r[:4], r[4] and r[4].replace("\n", ""))) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else key[2]
            for a, b in way:
                h = sha(a, h, b)
            out.append((r[0], key[2], levels[k][-1][0], top[-1][0], sha(*(x for w in way for x in w)), h, h == top[-1][0]))
    return out


def manifest_rows(df):
    tampered = F.when((F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.col("text").contains("\n"), F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    m = merkle.manifest(merkle.leaves(df, tampered))
    again = merkle.folded(F.coalesce("forged", "leaf"), F.col("siblings"))
    m = m.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof(F.col("siblings")), 256), again.alias("f"))
    return [tuple(r) for r in m.withColumn("v", F.col("f") == F.col("root")).collect()]


@pytest.mark.parametrize("wide", [ranks.WIDE, 2])
def test_manifest(spark, monkeypatch, wide):
    monkeypatch.setattr(ranks, "WIDE", wide)
    rows = [(7 * i - 900, "big", "en", i, f"line {i}\nnext") for i in range(300)] + [(5, None, None, None, None), (None, None, "de", 1, "no id"), (None, None, "de", 2, "no id é"), (1, "", "x", 0, ""), (2, "é", "x", 1, "\n"), (4, "one", "x", 1, "a\n\nb"),
            *[(9, "same", "x", 1, "t\n")] * 3, (9, "same", "x", 1, "other\n"), (9, "same", None, 1, None), (-(2**63), "far", "x", 1, "q\n"), (2**63 - 1, "far", "x", 1, "r\n")]
    random.Random(3).shuffle(rows)
    df = clashing(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string"))
    got = manifest_rows(df)
    assert sorted(got, key=str) == sorted(plain_manifest(rows), key=str)
    assert {r[-1] for r in got} == {True, False}
    assert manifest_rows(df.where("false")) == []
    (lone,) = manifest_rows(df.where("doc_id = 4"))
    assert lone[1] == lone[2] == lone[3] and lone[4] == sha("") and lone[5:] == (plain_leaf((4, "one", "x", 1, "ab")), False)


@pytest.mark.parametrize("wide", [3, 256])
def test_ranks(spark, monkeypatch, wide):
    monkeypatch.setattr(ranks, "WIDE", wide)
    rng = random.Random(4)
    rows = [(g, rng.randrange(-(10**k), 10**k), rng.randrange(1, 4)) for g in "ab" for k in (1, 4, 17) for _ in range(30)] + [("hot", i, 1) for i in range(200)] + [("c", None, 2)]
    rows = list({(g, k): (g, k, n) for g, k, n in rows}.values())
    df = spark.createDataFrame(rows, "group string, k long, n long").withColumn("key", ranks.ordered_long(F.col("k")))
    got = {(r.group, r.k): (r.before, r.total) for r in ranks.ranked(cut(df, "rows")).collect()}
    for g, k, _ in rows:
        less = sum(n for h, j, n in rows if h == g and (j is None and k is not None or None not in (j, k) and j < k))
        assert got[g, k] == (less, sum(n for h, _, n in rows if h == g))


def test_ids_by_spans():
    """Ids of made-up strings of all kinds of white space, letters and control strings, by the tokenizer's library."""
    content = bpe.vocabulary()
    library, _ = bpe._tokenizer(content)
    rng, encoder = random.Random(1), tokens.Encoder(content)
    some = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", " ", " ", "　", "​", " ", "﻿", "᠎", " ", "a", "b", "Word", "é", "ß", "ª", "µ", "ȿ", "Ɏ", "×", "ö", "1", "12", "²", "½", "!", "...",
            "’", "“", "'", "'s", "'t", "'ll", "don't", "<|endoftext|>", "<|endof", "text|>", "x<|endoftext|>y", "漢", "字", "😀", "́", "İ", "ſ", "٣", "\x00", "\x7f", "(", ")"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 30))) for _ in range(6000)] + [None, "", " "]
    got = [ids[a:b].tolist() for ids, edges in encoder.runs(pa.array(texts)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    assert got == [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_patterns_fill_sequences():
    rng = np.random.default_rng(6)
    for counts in ({}, {5: 3}, {40: 1000}, {64 - 1: 7, 1: 9}, dict(zip(range(1, 64), rng.integers(0, 50, 63).tolist(), strict=True))):
        plan = packing.relaxed(counts, 64)
        used = Counter()
        for p, n in packing.rounded(counts, plan):
            assert sum(k * m for k, m in p) == 64 and n > 0
            used.update({k: m * n for k, m in p})
        assert all(used[k] <= counts[k] for k in used)
    assert sum(k * n for k, n in used.items()) > 0.85 * sum(k * n for k, n in counts.items())  # long ones alone need more sequences than there are


@pytest.mark.parametrize("size", [16, 1024])
def test_packing(spark, size):
    words = "some words that make texts of any length and more".split()
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(150)] + [(3, None), (3, ""), (None, "no id"), (None, "no id"), (None, "other"), (500, "long text " * 3000)] + [(1000 + i, "the very same text") for i in range(90)]
    df = clashing(spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS))
    pieces = cut(packing.packed(df, size=size), "pieces")
    library, _ = bpe._tokenizer(bpe.vocabulary())
    want = Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids) + (0,)) for i, t in rows)
    by_sequence, docs = defaultdict(list), defaultdict(list)
    for r in pieces.collect():
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length > 0 and r.start + r.length <= r.doc_tokens
        by_sequence[r.sequence_id].append(r)
        docs[r.doc_id].append((r.start, r.doc_tokens, tuple(ids.tolist())))
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == size or at & (at - 1) == 0  # no padding at all
    for i in {i for i, _ in rows}:
        ids = [k for k, n in want.items() if k[0] == i for _ in range(n)]
        assert sum(len(k[1]) for k in ids) == sum(len(p[2]) for p in docs[i])
        if len(ids) == 1:
            assert tuple(x for _, _, p in sorted(docs[i]) for x in p) == ids[0][1]
        assert {n for _, n, _ in docs[i]} == {len(k[1]) for k in ids}
    whole = packing.assembled(pieces).collect()
    assert len(whole) == len(by_sequence) and all(len(r.ids) == 4 * r.length for r in whole) and sum(r.length for r in whole) == sum(len(k[1]) * n for k, n in want.items())
    assert packing.packed(df.where("false"), size=size).collect() == []


def plain_phrases(rows, most, least, top):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, most + 1) for i in range(len(w) - k + 1))
    found = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    out = defaultdict(list)
    for (lang, p), a in found.items():
        inside = lambda q, p=p: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        if any(m == lang and len(q) > len(p) and inside(q) and 100 * b >= 80 * a for (m, q), b in found.items()):
            continue
        score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    return [(lang, i, p.decode(), *rest) for lang, v in out.items() for i, (_, _, p, *rest) in enumerate(sorted(v)[:top], 1)]


@pytest.mark.parametrize(("most", "least", "top"), [(4, 3, 5), (4, 2, 2000), (2, 3, 50), (3, 4, 50)])
def test_phrases(spark, most, least, top):
    rng = random.Random(8)
    words = ["New", "york", "city", "hall", "a", "of", "the", "é", "İx", "\x00z", "don't", "x-y"]
    sentence = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))
    text = lambda: "".join(sentence() + rng.choice([". ", ", ", "\n", "!", " \t ", "; the new york "]) for _ in range(rng.randint(0, 6)))
    rows = [(rng.choice(["en", "de", None, "und", ""]), text()) for _ in range(120)] + [("en", None), (None, None), ("fr", ""), ("fr", "..,,")] + [("en", "new york city hall is new york city hall")] * 7
    df = clashing(spark.createDataFrame([(i, t, lang, None, None) for i, (lang, t) in enumerate(rows)], DOCS))
    got = [tuple(r) for r in collocations.collocations(df, most, least, top).collect()]
    assert sorted(got) == sorted(plain_phrases(rows, most, least, top)) and got
    assert collocations.collocations(df.where("false"), most, least, top).collect() == []


def test_scores_beyond_64_bits(spark):
    big = 10**17
    e = F.lit(2_000_000).cast("decimal(7,0)") * F.lit(big + 1).cast("decimal(20,0)")
    both = F.lit(3 * big).cast("decimal(20,0)")
    assert spark.range(1).select(e.alias("t"), both.alias("b")).selectExpr("t div b AS s").first().s == 2_000_000 * (big + 1) // (3 * big)
