r"""Language identification by a linear-chain conditional random field over the words of a text.

Each word is scored for each language by its features: byte bigrams and trigrams with word ends, prefixes and suffixes, and
membership in lexicons of frequent words; learned transitions link neighbouring words, so that code-switched text falls into
runs of one language. Forward-backward gives every word its probability of each language. A text's language is the one with
the greatest mean probability over its words, and that mean is the score.

Training takes whole texts of a bounded sample, PER_LANGUAGE expected documents of each language, cut into windows of SPAN
words; half of the windows are spliced from two texts, which shows the transitions what switching looks like. The sample lies
in SHARDS partitions; in each round a task per shard goes over its windows from the common weights, and the weights of all
shards, whose size doesn't depend on the data, are averaged.

Words are runs of ASCII letters and characters beyond ASCII, with A-Z lower-cased. Texts of more than SEGMENT words are cut into
segments whose transfer matrices carry the messages from one to the next, so that the number of steps for a text of n words is
about 2 * SEGMENT + n / SEGMENT, with the same result.

Defined results: a null text, or one without a letter, is `und` with score 0 and no spans; so is every text when there is
nothing to learn from; ties go to the first language by name; repeated rows and null ids are predicted row by row (a row with
a null id is neither held out nor learned from; equal ones are learned from once); texts of any length stay whole; an empty table
gives no rows. Columns other than doc_id, text and, to learn from, lang are not read. A model has all languages, LANGUAGES
values of lang, so that stray values don't make it larger.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnum as T
from .common import cut, documents, drop

PER_LANGUAGE, SPAN, SHARDS, ROUNDS, SEED = 250, 40, 8, 3, 21
GRAMS, AFFIXES, LEXICON = 1 << 14, 1 << 12, 2000
LANGUAGES, SEGMENT = 200, 4096
#: Below this score accepted() takes a text's language for unknown.
LEAST = 0.3
#: Words whose features are weighed at once, and bytes of texts whose features, and whose probabilities, are held at once.
SOME, PART, RUN = 1 << 15, 1 << 20, 1 << 21
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
TABLE = T.table_of(b"abcdefghijklmnopqrstuvwxyz", lower=True)
_BYTE = np.where(TABLE > 0, np.arange(256), 0).astype(np.uint32)
_BYTE[65:91] = _BYTE[97:123]


@dataclass
class Words:
    """The words of a run of texts and their features, as positions in the weights."""

    bounds: np.ndarray  # each text's first word, one more at the end
    hashes: np.ndarray
    first: np.ndarray  # each word's first gram
    grams: np.ndarray
    affixes: np.ndarray  # four columns


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    starts, ends, hashes, bounds = T.words(data, offsets, table=TABLE)
    n = ends - starts
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Words(bounds, hashes, none, none, np.zeros((0, 4), np.int64))
    # Letters with two zeros before and one after each word
    room = n + 3
    first = np.cumsum(room) - room
    at = np.arange(int(room.sum())) - np.repeat(first, room)
    inside = (at >= 2) & (at < np.repeat(n, room) + 2)
    v = np.zeros(len(at), np.uint32)
    v[inside] = _BYTE[data[np.flatnonzero(TABLE[data] != 0)]]
    two = np.zeros(len(v), np.uint32)
    two[1:] = v[:-1] * np.uint32(256) + v[1:]
    three = two.copy()
    three[2:] += v[:-2] * np.uint32(65536)
    mix = lambda x, seed, size: ((x * np.uint32(2654435761) + np.uint32(seed)) >> np.uint32(32 - size.bit_length() + 1)).astype(np.int64)
    live = at >= 2  # a gram ends at each letter and at the zero after the word
    grams = np.stack([mix(two, 0, GRAMS // 2), mix(three, 77, GRAMS // 2) + GRAMS // 2], axis=1)[live].reshape(-1)
    i, j = first + 2, first + 1 + n  # first and last letter
    second, before = np.minimum(i + 1, j + 1), np.maximum(j - 1, i - 1)
    ends3 = three[np.maximum(j, i)]
    starts3 = np.where(n > 2, three[np.minimum(i + 2, j)], two[second])
    each = [v[i] * np.uint32(256) + v[second], starts3 + np.uint32(1 << 25), v[before] * np.uint32(256) + v[j] + np.uint32(1 << 26), ends3 + np.uint32(1 << 27)]
    affixes = np.stack([mix(x, 13 * k, AFFIXES) for k, x in enumerate(each)], axis=1) + GRAMS
    return Words(bounds, hashes, 2 * (np.cumsum(n + 1) - n - 1), grams, affixes)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # feature, language
    moves: np.ndarray  # from, to
    lexicon: np.ndarray  # sorted hashes of frequent words
    members: np.ndarray  # of each: the languages it is frequent in, as features' positions, one column per language
    left_out: tuple[int, int] = (0, 0)  # languages, and documents of them, that it doesn't know

    @staticmethod
    def empty(languages: list[str], lexicon: np.ndarray, members: np.ndarray) -> Model:
        k = len(languages)
        return Model(languages, np.zeros((GRAMS + AFFIXES + k + 1, k), np.float32), np.zeros((k, k), np.float32), lexicon, members)

    def in_lexicon(self, hashes: np.ndarray) -> np.ndarray:
        """A column per language: the feature's position, or that of the feature which is always 0."""
        none = len(self.weights) - 1
        if not len(self.lexicon):
            return np.full((len(hashes), len(self.languages)), none)
        at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
        return np.where((self.lexicon[at] == hashes)[:, None], self.members[at], none)

    def scores(self, w: Words) -> np.ndarray:
        out = np.zeros((len(w.hashes), len(self.languages)), np.float32)
        ends = np.append(w.first, len(w.grams))
        for a in range(0, len(out), SOME):
            b = min(a + SOME, len(out))
            part = np.add.reduceat(self.weights[w.grams[ends[a] : ends[b]]], ends[a:b] - ends[a], axis=0)
            for column in w.affixes[a:b].T:
                part += self.weights[column]
            for column in self.in_lexicon(w.hashes[a:b]).T:
                part += self.weights[column]
            out[a:b] = part
        return out

    def probabilities(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of the words of texts: each text's first word (one more at the end), each word's probability of each language."""
        scores, counts = [np.zeros((0, len(self.languages)), np.float32)], [np.zeros(0, np.int64)]
        for _, data, offsets in T.runs(texts, PART):
            w = words_of(data, offsets)
            scores.append(self.scores(w))
            counts.append(np.diff(w.bounds))
        bounds = np.append(0, np.cumsum(np.concatenate(counts)))
        return bounds, forward_backward(np.concatenate(scores), bounds, self.moves)


def forward_backward(scores: np.ndarray, bounds: np.ndarray, moves: np.ndarray, pairs: bool = False, segment: int = SEGMENT):
    """Each word's probability of each language; with `pairs`, also the expected number of each move."""
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    a = np.exp(moves - moves.max()).astype(p.dtype)
    spans = np.diff(bounds)
    if pairs or not len(spans) or spans.max() <= segment:
        return _steps(p, a, bounds, None, None, pairs)
    # Segments: whole ones, then what each text has left
    n = np.maximum(1, -(-spans // segment))
    text = np.repeat(np.arange(len(spans)), n)
    place = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    cuts = np.append(bounds[:-1][text] + place * segment, bounds[-1])
    sizes = np.diff(cuts)
    into, after = (np.ones((len(text), p.shape[1]), p.dtype) for _ in range(2))
    of = np.flatnonzero((n > 1)[text])  # segments of long texts
    through = np.broadcast_to(np.eye(p.shape[1], dtype=p.dtype), (len(of), *a.shape)).copy()
    for t in range(segment):
        on = np.flatnonzero(sizes[of] > t)
        now = (through[on] @ a if t else through[on]) * p[cuts[of[on]] + t][:, None, :]
        through[on] = now / now.sum(axis=(1, 2), keepdims=True)
    for i, (s, matrix) in enumerate(zip(of, through, strict=True)):
        if i + 1 < len(of) and text[of[i + 1]] == text[s]:
            ahead = into[s] @ matrix @ a
            into[of[i + 1]] = ahead / ahead.sum()
    for i in range(len(of) - 1, 0, -1):
        if text[of[i - 1]] == text[of[i]]:
            back = a @ (through[i] @ after[of[i]])
            after[of[i - 1]] = back / back.sum()
    return _steps(p, a, cuts, into, after, False)


def _steps(p: np.ndarray, a: np.ndarray, bounds: np.ndarray, into: np.ndarray | None, after: np.ndarray | None, pairs: bool):
    """forward_backward of sequences word by word, all sequences at once; `into` weighs their first words by what stands before,
    `after` their last ones by what follows."""
    spans = np.diff(bounds)
    order = np.argsort(-spans, kind="stable")
    spans, head = spans[order], bounds[:-1][order]
    longest = int(spans[0]) if len(spans) else 0
    active = np.searchsorted(-spans, -np.arange(longest), "left")  # sequences with more words than the step's number
    out = np.empty_like(p)
    now = None
    for t in range(longest):
        k = active[t]
        at = head[:k] + t
        now = (p[at] if into is None else into[order[:k]] * p[at]) if t == 0 else (now[:k] @ a) * p[at]
        now /= now.sum(axis=1, keepdims=True)
        out[at] = now
    back = np.ones((len(spans), p.shape[1]), p.dtype) if after is None else after[order].copy()
    moved = np.zeros_like(a)
    for t in range(longest - 1, -1, -1):
        k = active[t]
        at = head[:k] + t
        go_on = active[t + 1] if t + 1 < longest else 0
        ahead = back[:go_on] * p[at[:go_on] + 1]
        if pairs:
            both = out[at[:go_on]][:, :, None] * a * ahead[:, None, :]
            moved += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        b = ahead @ a.T
        b /= b.sum(axis=1, keepdims=True)
        back[:go_on] = b
        now = out[at] * back[:k]
        out[at] = now / now.sum(axis=1, keepdims=True)
    return (out, moved) if pairs else out


def _lexicons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language's number, hash, count) of the words of a shard."""
    for b in T.parts(batches):
        langs = b.column("label").to_numpy()
        for at, data, offsets in T.runs(b.column("text")):
            w = words_of(data, offsets)
            label = np.repeat(langs[at : at + len(w.bounds) - 1], np.diff(w.bounds))
            for k in np.unique(label):
                h, n = np.unique(w.hashes[label == k], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), k, np.int32)), pa.array(h.view(np.int64)), pa.array(n)], names=["label", "hash", "n"])


def _pass(model: Model, round_: int):
    """Goes over a shard once, in mini-batches with adaptive steps; gives the shard's weights."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([SEED, round_])
        size = model.weights.shape
        k = len(model.languages)
        w_sum, m_sum = np.full(size, 1e-2, np.float32), np.full(model.moves.shape, 1e-2, np.float32)
        rate, n = 0.25 / (1 + round_), 0
        windows: list[tuple[np.ndarray, ...]] = []
        for b in T.parts(batches):
            langs = b.column("label").to_numpy()
            for at, data, offsets in T.runs(b.column("text")):
                w = words_of(data, offsets)
                label = np.repeat(langs[at : at + len(w.bounds) - 1], np.diff(w.bounds))
                lex = model.in_lexicon(w.hashes)
                grams = np.split(w.grams, w.first[1:]) if len(w.first) else []
                place = np.arange(len(label)) - np.repeat(w.bounds[:-1], np.diff(w.bounds))
                for idx in np.split(np.arange(len(label)), np.flatnonzero(place % SPAN == 0)[1:]):
                    if len(idx):
                        windows.append((label[idx], w.affixes[idx], lex[idx], [grams[i] for i in idx.tolist()]))
        if not windows:
            return
        order = rng.permutation(len(windows))
        for i, j in zip(order[::4], order[1::4], strict=False):  # the halves of two windows change places
            x, y = windows[i], windows[j]
            c, d = len(x[0]) // 2, len(y[0]) // 2
            windows[i] = (*(np.concatenate([x[f][:c], y[f][d:]]) for f in range(3)), x[3][:c] + y[3][d:])
            windows[j] = (*(np.concatenate([y[f][:d], x[f][c:]]) for f in range(3)), y[3][:d] + x[3][c:])
        for part in np.array_split(rng.permutation(len(windows)), max(1, len(windows) // 64)):
            some = [windows[i] for i in part.tolist() if len(windows[i][0])]
            if not some:
                continue
            gold, affixes, lex = (np.concatenate([x[f] for x in some]) for f in range(3))
            flat = [g for x in some for g in x[3]]
            count = np.array([len(g) for g in flat])
            grams = np.concatenate(flat)
            first = np.cumsum(count) - count
            bounds = np.cumsum([0, *(len(x[0]) for x in some)])
            scores = np.add.reduceat(model.weights[grams], first, axis=0) + model.weights[affixes].sum(axis=1) + model.weights[lex].sum(axis=1)
            prob, moved = forward_backward(scores.astype(np.float64), bounds, model.moves.astype(np.float64), pairs=True)
            wrong = -prob
            wrong[np.arange(len(gold)), gold] += 1
            inner = np.ones(len(gold), bool)
            inner[bounds[:-1]] = False
            seen = np.zeros((k, k))
            np.add.at(seen, (gold[:-1][inner[1:]], gold[1:][inner[1:]]), 1)
            step = np.zeros(size, np.float32)
            for c in range(k):
                step[:, c] = np.bincount(grams, np.repeat(wrong[:, c], count), size[0])
                for f in (affixes, lex):
                    step[:, c] += np.bincount(f.reshape(-1), np.repeat(wrong[:, c], f.shape[1]), size[0])
            step[-1] = 0
            w_sum += step * step
            model.weights += rate * step / np.sqrt(w_sum)
            move = (seen - moved).astype(np.float32)
            m_sum += move * move
            model.moves += rate * move / np.sqrt(m_sum)
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()]), pa.array([model.moves.tobytes()])], names=["weights", "moves"])

    return of


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, most: int | None = None) -> Model | None:
    """docs(doc_id, text, lang), none of them null -> a model of all languages there are; None if there is nothing to learn from.

    A model grows with its languages, so more than LANGUAGES are refused; `most` takes the most frequent ones of any number, and the
    model's left_out tells how many languages and documents that leaves out."""
    spark = docs.sparkSession
    every = cut(docs.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    n, rows = every.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if most is None and n > LANGUAGES:
        raise ValueError(f"{n} languages; say how many of the most frequent to learn")
    counts = {r["lang"]: r["n"] for r in every.orderBy(F.desc("n"), "lang").limit(min(n, most or n)).collect()}
    drop(every)
    left = rows - sum(counts.values())
    languages = sorted(counts)
    if not languages:
        return None
    rows = spark.createDataFrame([(lang, i, min(1.0, per_language / counts[lang])) for i, lang in enumerate(languages)], "lang string, label int, rate double")
    draw = F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "text"), F.lit(1 << 20)) / float(1 << 20)
    sample = docs.join(F.broadcast(rows), "lang").where(draw < F.col("rate")).select("doc_id", "text", "label").distinct()
    sample = cut(sample.repartition(SHARDS, F.xxhash64("doc_id")).sortWithinPartitions("doc_id", "label", "text").select("text", "label"), "sample")
    frequent = sample.mapInArrow(_lexicons, "label int, hash long, n long").groupBy("label", "hash").agg(F.sum("n").alias("n"))
    frequent = frequent.where("n > 1").groupBy("label").agg(F.expr(f"slice(sort_array(collect_list(struct(n, hash)), false), 1, {LEXICON})").alias("top"))
    at = {r["label"]: [x["hash"] for x in r["top"]] for r in frequent.collect()}  # LEXICON words per language at most
    lexicon = np.array(sorted({h for hs in at.values() for h in hs}), np.int64).view(T.U)
    lexicon.sort()
    none = GRAMS + AFFIXES + len(languages)
    members = np.full((len(lexicon), len(languages)), none)
    for k, hs in at.items():
        members[np.searchsorted(lexicon, np.array(hs, np.int64).view(T.U)), k] = GRAMS + AFFIXES + k
    model = Model.empty(languages, lexicon, members)
    model.left_out = (n - len(counts), left)
    for round_ in range(ROUNDS):
        shards = sample.mapInArrow(_pass(model, round_), "weights binary, moves binary").collect()  # SHARDS models
        if not shards:
            return None
        mean = lambda name, like: np.mean([np.frombuffer(s[name], np.float32) for s in shards], axis=0, dtype=np.float64).astype(np.float32).reshape(like.shape)  # noqa: B023, E731
        model.weights, model.moves = mean("weights", model.weights), mean("moves", model.moves)
    drop(sample)
    return model


PREDICTED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int64()), ("language", pa.int32())])))])
PREDICTED_SQL = "doc_id long, lang_pred string, score double, n_words long, spans array<struct<start:long,n:long,language:int>>"


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """A row per row of docs: doc_id, lang_pred, score, n_words, spans: runs of words of one language, as (start, n, number of
    the language in model.languages)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.parts(batches):
            for at, data, offsets in T.runs(b.column(1), RUN):
                n = len(offsets) - 1
                ids, texts = b.column(0).slice(at, n), b.column(1).slice(at, n)
                known = np.array([bool(LETTER.search(t.as_py() or "")) for t in texts]) if model else np.zeros(n, bool)
                if not known.any():
                    count = np.zeros(n, np.int64)
                    langs, score, ends, spans = [UNKNOWN] * n, np.zeros(n), np.zeros(n + 1, np.int32), (count[:0], count[:0], count[:0])
                else:
                    bounds, prob = model.probabilities(texts)
                    count = np.diff(bounds)
                    row = np.repeat(np.arange(n), count)
                    mean = np.stack([np.bincount(row, c, n) for c in prob.T], axis=1) / np.maximum(count, 1)[:, None]
                    best = mean.argmax(axis=1)
                    score = np.where(known, np.clip(mean[np.arange(n), best], 0, 1), 0.0)
                    langs = [model.languages[i] if k else UNKNOWN for i, k in zip(best.tolist(), known.tolist(), strict=True)]
                    label = prob.argmax(axis=1)
                    new = np.ones(len(label), bool)
                    new[1:] = (label[1:] != label[:-1]) | (row[1:] != row[:-1])
                    new &= known[row]
                    first = np.flatnonzero(new)
                    stop = np.minimum(np.append(first[1:], len(label)), bounds[row[first] + 1])
                    ends = np.searchsorted(row[first], np.arange(n + 1)).astype(np.int32)
                    spans = (first - bounds[row[first]], stop - first, label[first])
                each = pa.StructArray.from_arrays([pa.array(spans[0]), pa.array(spans[1]), pa.array(spans[2].astype(np.int32))], names=["start", "n", "language"])
                cols = [ids, pa.array(langs), pa.array(score), pa.array(count), pa.ListArray.from_arrays(pa.array(ends), each)]
                yield pa.RecordBatch.from_arrays(cols, schema=PREDICTED)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(of, PREDICTED_SQL)


def accepted(docs: DataFrame, model: Model | None, least: float = LEAST) -> DataFrame:
    """The rows of docs, all columns, whose language is known with a score of `least` at least. Texts without a letter go;
    code-switched texts, whose languages share the score, stay. Without a model all rows with a letter stay."""
    text = docs.columns.index("text")
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # any names may follow

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.parts(batches):
            texts = b.column(text)
            for at, data, offsets in T.runs(texts, RUN):
                n = len(offsets) - 1
                stay = np.array([bool(LETTER.search(t.as_py() or "")) for t in texts.slice(at, n)])
                if model:
                    bounds, prob = model.probabilities(texts.slice(at, n))
                    count = np.diff(bounds)
                    row = np.repeat(np.arange(n), count)
                    stay &= np.max([np.bincount(row, c, n) for c in prob.T], axis=0) >= least * count
                yield b.slice(at, n).filter(pa.array(stay))

    return plain.mapInArrow(of, plain.schema).toDF(*docs.columns)


def held_out():
    """Whether crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def to_learn(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = predict(docs, learn(to_learn(docs)))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_words", F.size("spans").alias("n_spans"))


QUERIES, ORACLES = {"op1_language_id": op1_language_id}, {}
