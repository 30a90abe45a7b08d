"""Byte-pair encoding and decoding through a table of distinct words.

Texts are split into words inside Spark tasks (see spans). About CHUNK bytes of texts form a chunk: a row with its documents, its
distinct words and, for every word of every document, the word's number in that list. The chunks' words are dealt out by word,
in ROUNDS shuffles of a share each, into a bucketed table, and there make the distinct-word table, in which each word is encoded once; its ids are joined to
the table of pieces. Ids go back to the chunks by word and number, packed by chunk, and with them each id's piece, once, again in
ROUNDS shuffles, into a bucketed table. A document takes up its ids by position, and its text is decoded from those ids by their
pieces. Only distinct words of chunks are shuffled, never all words or tokens; the chunks stay where they are, in a bucketed table,
whose buckets grow in number with the texts. What no later step reads is deleted at once: chunks keep no words once these are dealt
out, and while the result is made, nothing is on the disk beside it but the chunks' numbers and the packed ids.

Works for tokenizer files of the byte-level BPE kind without normalizer, whose added tokens are plain strings; such a string
in a text becomes its id. The file's truncation and padding are not used.

Defined results: null or empty texts have no tokens and decode to an empty text; repeated rows and null ids are encoded row by
row; texts of any length stay whole (a text longer than CHUNK is a chunk of its own); an empty table gives no rows. Columns
other than doc_id and text, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnum as T
from .common import cut, documents, drop, settled
from .spans import cuts, spelled

#: Bytes of text in a chunk: what a task holds at once while it puts ids to the chunk's documents.
CHUNK = 8_000_000
#: Shuffles in which the chunks' words are dealt out, and the packed ids, so that the disk holds one share of them beside the tables.
ROUNDS = 2
VOCABULARY = "byte_bpe_50k.json"


def vocabulary(name: str = VOCABULARY) -> str:
    """The content of one of the public tokenizer files."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def _tokenizer(content: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(content)
    t.no_truncation()
    t.no_padding()
    added = [a.content for a in t.get_added_tokens_decoder().values()]
    if t.normalizer is not None or any(a.lstrip or a.rstrip or a.single_word for a in t.get_added_tokens_decoder().values()):
        raise ValueError("only tokenizers without normalizer and with plain added tokens")
    return t, added


def _numbers_packed(x: np.ndarray) -> bytes:
    """Numbers by planes of bytes, which compress better apart."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _numbers(packed: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").reshape(-1)


def _named(rank: np.ndarray) -> np.ndarray:
    """Words' numbers with those of words that are there once, the last ones in the order of their places, as 0, and others from 1 on."""
    often = np.count_nonzero(np.bincount(rank) > 1)
    return np.where(rank < often, rank + 1, 0)


def _ranked(names: np.ndarray) -> np.ndarray:
    """The inverse of _named()."""
    once = names == 0
    rank = names.astype(np.int64) - 1
    rank[once] = names.max(initial=0) + np.arange(np.count_nonzero(once))
    return rank


def _chunks(content: str):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, part, n = tuple(a.encode() for a in _tokenizer(content)[1]), TaskContext.get().partitionId(), 0
        codes, ids, sizes, flat, chars = {}, [], [], [], 0

        def done() -> pa.RecordBatch:
            numbers = np.concatenate(flat)
            order = np.argsort(-np.bincount(numbers, minlength=len(codes)), kind="stable")  # frequent words get small numbers
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            words = list(codes)
            row = [[f"{part}-{n}"], [ids], [sizes], [_numbers_packed(_named(rank[numbers]))], [[words[i].decode("utf-8", "replace") for i in order.tolist()]]]
            kinds = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.string())]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=["chunk", "ids", "sizes", "codes", "words"])

        for b in T.parts(batches):
            for first, data, offsets in T.runs(b.column(1)):
                if ids and chars + len(data) > CHUNK:
                    yield done()
                    codes, ids, sizes, flat, chars, n = {}, [], [], [], 0, n + 1
                starts = cuts(data, offsets, whole)
                each = spelled(data, starts)
                number = np.empty(len(each.dictionary), np.uint32)
                for i, w in enumerate(each.dictionary.to_pylist()):
                    number[i] = codes.setdefault(w, len(codes))
                ids += b.column(0).slice(first, len(offsets) - 1).to_pylist()
                sizes += np.diff(np.searchsorted(starts, offsets)).tolist()
                flat.append(number[each.indices.to_numpy()])
                chars += len(data)
        if ids:
            yield done()

    return of


def _encoded(content: str):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        t, _ = _tokenizer(content)
        for big in batches:
            for b in (big.slice(i, 8192) for i in range(0, len(big), 8192)):
                ids = [e.ids for e in t.encode_batch(b.column(0).to_pylist(), add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    return of


def byte_of_character() -> dict[str, int]:
    """Byte-level pieces write printable bytes as themselves and the other 68, in order, as U+0100 and so on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}


def pieces(spark: SparkSession, content: str) -> DataFrame:
    """The table (id, piece) of a vocabulary, a piece being bytes; as many rows as the vocabulary has."""
    t, _ = _tokenizer(content)
    byte = byte_of_character()
    added = {i: a.content.encode() for i, a in t.get_added_tokens_decoder().items()}
    rows = [(i, bytearray(added[i] if i in added else bytes(byte[c] for c in p))) for p, i in t.get_vocab().items()]
    return spark.createDataFrame(rows, "id int, piece binary")


def with_pieces(rows: DataFrame, content: str, key: str = "doc_id") -> DataFrame:
    """rows(key, ids, ...), one per key -> (key, ids, pieces), pieces being what each id stands for, by a join of ids to pieces; ids
    that the vocabulary lacks stand for nothing. Rows bucketed by the key are not shuffled."""
    each = rows.select(key, "ids", F.posexplode_outer("ids").alias("at", "id"))
    named = each.join(F.broadcast(pieces(rows.sparkSession, content)), "id", "left")  # as large as the vocabulary
    in_order = F.expr("transform(array_sort(collect_list(IF(at IS NULL, NULL, struct(at, piece)))), x -> coalesce(x.piece, X''))")
    return named.groupBy(key).agg(F.first("ids").alias("ids"), in_order.alias("pieces"))


def decode(rows: DataFrame, content: str, key: str = "doc_id") -> DataFrame:
    """rows(key, ids, ...), one per key -> (key, ids, bytes), what the ids stand for; nothing for null or empty arrays."""
    text = F.expr("aggregate(pieces, X'', (all, x) -> concat(all, x))")
    return with_pieces(rows, content, key).select(key, "ids", text.alias("bytes"))


#: Words that a task gathers before it packs them by chunk.
GATHER = 400_000
PACK = pa.schema([("of", pa.string()), *((c, pa.binary()) for c in ("codes", "counts", "ids", "vocabulary", "sizes", "text"))])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their ids and pieces, packed by chunk for the shuffle: ids of words, and each id's piece once."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress

    def done(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        of = t.column("of").combine_chunks().dictionary_encode()
        number = of.indices.to_numpy()
        order = np.argsort(number, kind="stable")
        codes = t.column("code").to_numpy()[order]
        lists = t.column("ids").combine_chunks().take(pa.array(order))
        count, ids = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
        parts = t.column("pieces").combine_chunks().take(pa.array(order)).flatten()
        edge = np.append(0, np.cumsum(np.bincount(number, minlength=len(of.dictionary))))
        id_edge = np.append(0, np.cumsum(count))[edge]
        out: list[list] = [[] for _ in PACK.names[1:]]
        for a, b, x, y in zip(edge[:-1], edge[1:], id_edge[:-1], id_edge[1:], strict=True):
            known, first = np.unique(ids[x:y], return_index=True)
            text = parts.take(pa.array(first + x)).to_pylist()
            sizes = np.array([len(p) for p in text], np.int64)
            row = (*map(_numbers_packed, (codes[a:b], count[a:b], ids[x:y], known, sizes)), pack(b"".join(text)))
            for column, value in zip(out, row, strict=True):
                column.append(value)
        return pa.RecordBatch.from_arrays([of.dictionary, *(pa.array(c, pa.binary()) for c in out)], schema=PACK)

    held, n = [], 0
    for b in batches:
        if len(b):
            held.append(b)
            n += len(b)
        if n >= GATHER:
            yield done(held)
            held, n = [], 0
    if held:
        yield done(held)


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places from each start on, as many as its size, one span after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _assembled(key: tuple, chunk: pa.Table, packs: pa.Table) -> pa.Table:
    """A chunk's documents with their ids, by the words' numbers, and the text that these ids stand for, by their pieces."""
    import zstandard

    T.tidy()
    joined = lambda name: np.concatenate([np.zeros(0, "<u4"), *map(_numbers, packs.column(name).to_pylist())])
    order = np.argsort(joined("codes"))
    count, flat = joined("counts").astype(np.int64), joined("ids")
    start, count = (np.cumsum(count) - count)[order], count[order]
    # The pieces of all ids of the chunk, in the order of the ids
    known, size = joined("vocabulary"), joined("sizes").astype(np.int64)
    letters = np.frombuffer(b"".join(map(zstandard.ZstdDecompressor().decompress, packs.column("text").to_pylist())), np.uint8)
    known, first = np.unique(known, return_index=True)
    size, piece = size[first], (np.cumsum(size) - size)[first]
    names = ["doc_id", "n_tokens", "ids", "decoded"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.string()]
    out: list[list] = [[], [], [], []]
    for row in chunk.select(["ids", "sizes", "codes"]).to_pylist():
        codes = _ranked(_numbers(row["codes"]))
        at = 0
        for doc, words in zip(row["ids"], row["sizes"], strict=True):
            own = codes[at : at + words]
            at += words
            ids = flat[_spans(start[own], count[own])]
            which = np.searchsorted(known, ids)
            out[0].append(doc)
            out[1].append(len(ids))
            out[2].append(ids.tobytes())
            out[3].append(letters[_spans(piece[which], size[which])].tobytes().decode("utf-8", "replace"))
    return pa.table([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=names)


def encode(docs: DataFrame, content: str | None = None) -> DataFrame:
    """A row per row of docs: doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), decoded (what they decode to).

    The tables behind it are read when the rows are; common.settled() deletes them once what is made of the rows is written."""
    content = content or vocabulary()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chars = texts.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()[0]
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // (4 * CHUNK)))
    chunks = cut(texts.mapInArrow(_chunks(content), "chunk string, ids array<long>, sizes array<long>, codes binary, words array<string>"), "chunks", "chunk", buckets=n)
    placed = chunks.select(F.col("chunk").alias("of"), F.posexplode("words").alias("code", "word"))
    words, placed = placed, None
    for k in range(ROUNDS):
        share = words.where(F.pmod(F.xxhash64("word"), F.lit(ROUNDS)) == k)
        placed = cut(share.repartition(n, "word").sortWithinPartitions("word"), "placed", "word", buckets=n, onto=placed)
    known = cut(chunks.select("chunk", "ids", "sizes", "codes"), "numbers", "chunk", buckets=n)
    drop(chunks)
    ids = cut(placed.select("word").distinct().mapInArrow(_encoded(content), "word string, ids array<int>"), "words", "word", buckets=n)
    table = cut(with_pieces(ids, content, "word"), "pieces", "word", buckets=n)
    drop(ids)
    schema, packs = ", ".join(f"{f.name} {'string' if f.name == 'of' else 'binary'}" for f in PACK), None
    for k in range(ROUNDS):
        share = placed.where(F.pmod(F.xxhash64("of"), F.lit(ROUNDS)) == k)
        named = share.join(table.withColumnRenamed("word", "w"), F.col("word") == F.col("w")).select("of", "code", "ids", "pieces")
        packs = cut(named.mapInArrow(_packed, schema).repartition(n, "of"), "packs", "of", buckets=n, onto=packs)
    drop(placed, table)
    return known.groupBy("chunk").cogroup(packs.groupBy("of")).applyInArrow(_assembled, "doc_id long, n_tokens long, ids binary, decoded string")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    def work() -> DataFrame:
        out = encode(documents(spark, sf_dir))
        return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

    return settled(work, "tokens")


QUERIES, ORACLES = {"op9_bpe": op9_bpe}, {}
