"""Collocations: phrases of 2 to MOST words that occur more often, beside how often their parts do, than other phrases.

Texts are lower-cased and split at punctuation into pieces, and these into words. Every run of 1 to MOST words within a piece is a
row (lang, size, phrase, n), counted for some megabytes of texts at once before Spark adds the rows up by language and phrase. As
no phrase is more frequent than its parts, a row is left out when a part of it is known to be below LEAST: words are counted
first, then pairs of frequent words, then longer phrases all whose pairs are frequent. What is frequent is looked up in a bit
map of bounded size, which may let others through but loses none; the counts come from the words themselves.

Each candidate is then joined to the counts of both parts of each of its cuts and scored in decimals, those that a phrase one
word longer mostly stands for go by an anti-join (a phrase that is two words longer has one between them, which is at least as
frequent), and the rest is ranked in its language.

Defined results: null texts have no words; a null lang is `und`, together with that name; a text that repeats counts each time; empty
tables give no rows. Columns other than lang and text, whatever their names, are not read. A single text needs some forty times
its bytes in a task."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textnum as T
from .common import cut, documents, settled

MOST, LEAST, TOP, SCALE = 4, 30, 2000, 2_000_000
#: A longer phrase stands for one inside it if it has at least so many percent of its occurrences.
STANDS = 80
#: Bytes of texts that are counted at once: what a task holds is some forty times as much.
RUN = 1 << 20
#: Parts in which the phrases of a language are ranked at first.
PARTS = 64
#: log2 of the bits of a bit map, at least and at most; between, there are 32 bits for each phrase.
BITS = (16, 26)
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_WORDS = T.table_of(bytes(c for c in range(128) if c not in _BREAKS + b" \t"), lower=True)
_BREAK = np.isin(np.arange(256), list(_BREAKS))
_TIMES = T.odd(2, 31)
ROWS = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())])
_DDL = "lang string, size int, phrase string, n long"


def _of_langs(langs: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs], T.U)


def _marks(hashes: np.ndarray, langs: np.ndarray, size: int) -> np.ndarray:
    """A hash of each word, or of each pair of consecutive words, and its language."""
    if size == 1:
        return T.mixed(hashes * _TIMES[0] + langs)
    return T.mixed(hashes[:-1] * _TIMES[0] + hashes[1:] * _TIMES[1] + langs[:-1])


def _known(marks: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = marks & T.U(len(bits) * 64 - 1)
    return (bits[(at >> T.U(6)).astype(np.int64)] >> (at & T.U(63)) & T.U(1)).astype(bool)


def _exploded(sizes: range, prior):
    """Rows of all phrases of these sizes; prior: a broadcast bit map of the frequent phrases one word shorter than the least size."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = prior.value if prior is not None else None
        for b in T.parts(batches):
            langs = pc.fill_null(b.column(0), "und").dictionary_encode()
            names, of_row = langs.dictionary, langs.indices.to_numpy()
            lang_hash = _of_langs(names.to_pylist())
            for first, data, offsets in T.runs(b.column(1), RUN):
                starts, ends, hashes, bounds = T.words(data, offsets, table=_WORDS)
                if not len(starts):
                    continue
                words = T.spelled(data, starts, ends, lower=True)
                code, kinds = words.indices.to_numpy().astype(np.int64), len(words.dictionary)
                row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                lang = of_row[first + row].astype(np.int64)
                piece = np.cumsum(_BREAK[data])[starts]
                good = np.append((piece[1:] == piece[:-1]) & (row[1:] == row[:-1]), False)  # the next word is in the same piece
                if bits is not None and sizes[0] == 2:
                    some = _known(_marks(hashes, lang_hash[lang], 1), bits)
                    good[:-1] &= some[1:] & some[:-1]
                elif bits is not None:
                    good[:-1] &= _known(_marks(hashes, lang_hash[lang], 2), bits)
                ok = np.ones(len(code), bool)
                for size in range(1, sizes[-1] + 1):
                    if size > 1:
                        ok[: len(ok) - size + 2] &= good[size - 2 :]
                        ok[len(ok) - size + 2 :] = False
                    if size not in sizes:
                        continue
                    at = np.flatnonzero(ok)
                    if not len(at):
                        break
                    key = lang[at] * kinds + code[at]
                    for j in range(1, size):
                        key = np.unique(key, return_inverse=True)[1] * kinds + code[at + j]
                    _, where, n = np.unique(key, return_index=True, return_counts=True)
                    at = at[where]
                    parts = [words.dictionary.take(pa.array(code[at + j])).cast(pa.string()) for j in range(size)]
                    phrase = pc.binary_join_element_wise(*parts, " ") if size > 1 else parts[0]
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(lang[at])).cast(pa.string()), pa.array(np.full(len(at), size, np.int32)), phrase, pa.array(n.astype(np.int64))], schema=ROWS)

    return of


def _marked(size: int, mask: int):
    """(word, bits) of the bit map that has these phrases."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.parts(batches, 8192):
            for first, data, offsets in T.runs(b.column(1)):
                _, _, hashes, bounds = T.words(data, offsets, table=_WORDS)
                langs = np.repeat(_of_langs(b.column(0).slice(first, len(offsets) - 1).to_pylist()), np.diff(bounds))
                at = _marks(hashes, langs, size)[bounds[:-1]] & T.U(mask)
                yield pa.RecordBatch.from_arrays([pa.array((at >> T.U(6)).astype(np.int64)), pa.array((T.U(1) << (at & T.U(63))).view(np.int64))], names=["word", "bits"])

    return of


def _bit_map(frequent: DataFrame, size: int):
    """A broadcast bit map of frequent(lang, phrase), all of one size: 2 ** BITS[1] / 8 bytes at most."""
    bits = min(max((32 * frequent.count()).bit_length(), BITS[0]), BITS[1])
    got = frequent.select("lang", "phrase").mapInArrow(_marked(size, (1 << bits) - 1), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return frequent.sparkSession.sparkContext.broadcast(out.view(T.U))


def counted(docs: DataFrame, most: int = MOST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, n) of all phrases of 1 to `most` words with n >= least, and (lang, n) of all words."""
    texts = docs.select(F.col("lang").cast("string").alias("lang"), "text")

    def summed(sizes: range, prior) -> DataFrame:
        return texts.mapInArrow(_exploded(sizes, prior), _DDL).groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))

    words = cut(summed(range(1, 2), None), "words")
    levels = [words.where(F.col("n") >= least)]
    for sizes in (range(2, 3), range(3, most + 1)):
        if len(sizes) and sizes[0] <= most:
            prior = _bit_map(levels[-1], sizes[0] - 1)
            levels.append(cut(summed(sizes, prior).where(F.col("n") >= least), "phrases"))
            prior.unpersist()
    frequent = levels[0]
    for x in levels[1:]:
        frequent = frequent.unionByName(x)
    return frequent, words.groupBy("lang").agg(F.sum("n").alias("n"))


def collocations(docs: DataFrame, most: int = MOST, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first `top` phrases."""
    frequent, sizes = counted(docs, most, least)
    frequent = cut(frequent, "frequent")
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    cuts = frequent.where("size >= 2").select("lang", "phrase", "size", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": F.expr("substring_index(phrase, ' ', k)"), "rest": F.expr("substring_index(phrase, ' ', k - size)")})
    for part, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(frequent.select("lang", F.col("phrase").alias(part), F.col("n").alias(name)), ["lang", part])
    exact = cuts.withColumn("both", wide("l") + wide("r")).withColumn("times", F.lit(SCALE).cast("decimal(7,0)") * wide("a"))
    scored = exact.select("lang", "phrase", F.struct(F.expr("times div both").alias("score"), "k", "l", "r", "a").alias("cut"))
    best = scored.groupBy("lang", "phrase").agg(F.min("cut").alias("cut")).select("lang", "phrase", "cut.*")
    inner = F.explode(F.expr("array(substring_index(phrase, ' ', size - 1), substring_index(phrase, ' ', 1 - size))"))
    longer = frequent.where("size >= 3").select(F.col("lang").alias("in"), inner.alias("part"), "n").groupBy("in", "part").agg(F.max("n").alias("longer"))
    kept = best.join(longer, (F.col("lang") == F.col("in")) & (F.col("phrase") == F.col("part")) & (wide("longer") * 100 >= wide("a") * STANDS), "left_anti")
    # The first ones of a language are among the first ones of its parts, so that no task sorts all phrases of one language.
    place = lambda *of: F.row_number().over(W.partitionBy("lang", *of).orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("rank", place("part")).where(F.col("rank") <= top)
    ranked = ranked.withColumn("rank", place()).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(lambda: collocations(documents(spark, sf_dir)), "collocations")


QUERIES = {"op13_collocations": op13_collocations}
ORACLES = {"op13_collocations": rf"""
WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM piece),
g AS (SELECT lang, s, unnest([array_to_string(w[i:i + s - 1], ' ') FOR i IN range(1, len(w) - s + 2)]) AS phrase FROM w, range(1, {MOST + 1}) t(s)),
f AS (SELECT lang, s, phrase, count(*) AS n FROM g GROUP BY ALL),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE s > 1 AND n >= {LEAST}),
cuts AS (SELECT lang, phrase, n AS a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y FROM c, range(1, {MOST}) t(k) WHERE k < s),
best AS (SELECT cuts.lang, cuts.phrase, cuts.a, min({{'score': CAST(({SCALE}::HUGEINT * cuts.a) // (l.n + r.n) AS BIGINT), 'k': k, 'l': l.n, 'r': r.n}}) AS m
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = x JOIN f r ON r.lang = cuts.lang AND r.phrase = y GROUP BY ALL),
gone AS (SELECT DISTINCT a.lang, a.phrase FROM c a JOIN (SELECT lang, n, s, unnest(flatten([[array_to_string(w[i:j], ' ') FOR j IN range(i + 1, s + 1)] FOR i IN range(1, s + 1)])) AS phrase FROM c) b ON a.lang = b.lang AND a.phrase = b.phrase AND b.s > a.s AND 100 * b.n >= {STANDS} * a.n),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY m.score DESC, a DESC, encode(phrase)) AS rank, phrase, a, m.l AS l, m.r AS r, m.score AS score FROM best ANTI JOIN gone USING (lang, phrase))
SELECT ranked.lang, rank, phrase, a, l, r, t.n, score FROM ranked JOIN (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE s = 1 GROUP BY lang) t ON t.lang = ranked.lang WHERE rank <= {TOP}
"""}
