"""Content-defined chunking of media payloads into a deduplicated store, and their verified reconstruction.

A payload is stored as a medium: an 8-bit mono sound file, its samples being the payload. A gear hash rolls over the samples;
where its low bits are zero a chunk ends, so that equal passages make equal chunks wherever they stand. Each medium has an
ordered list of chunk digests. Spark counts the digests and joins those of several media back to their lists: such chunks stand
once in a table of their own, bucketed by digest, and are written by one of their media only. All other chunks, which no join
could share, stay together in their medium's pack; so packs without a shared chunk never move. Reading goes the other way: lists
are joined to the shared chunks by digest, chunks are put in order, and a medium whose digest differs from its name fails the job.

Defined results: null or empty texts have a payload of PAD spaces; rows with equal texts share one medium and have equal
values; repeated rows and null ids stay rows of their own; texts of any length stay whole; an empty table gives no rows.
Columns other than doc_id and text, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnum as T
from .common import cut, documents, drop, lookup_join

PAD, TAIL, RATE = 192, 16, 8000
#: A chunk has LEAST bytes at least and MOST at most; beyond LEAST each byte ends it with a chance of one in 1 << BITS.
LEAST, MOST, BITS = 128, 8192, 7
_GEAR = np.random.default_rng(6).integers(0, 2**32, 256, dtype=np.uint32)
#: Expected texts, and characters of each, that the dictionary for compressing packs is made from; its bytes, and the level.
SAMPLE, CHARS, DICTIONARY, LEVEL = 1000, 4096, 1 << 16, 9
#: Bits of the map of media with shared chunks; see MediaStore.
MAP_BITS = 24
HEAD = struct.Struct("<4sI4s4sIHHIIHH4sI")


def head(n: int) -> bytes:
    """What stands before n samples."""
    return HEAD.pack(b"RIFF", HEAD.size - 8 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n)


def padded(text: bytes) -> bytes:
    return text.ljust(max(1, -(-len(text) // PAD)) * PAD)


def medium(text: bytes) -> bytes:
    """The sound file with the padded text as its samples."""
    samples = padded(text)
    return head(len(samples)) + samples


def payload(file: bytes) -> bytes:
    fields = HEAD.unpack_from(file)
    if (fields[0], fields[2], fields[10], fields[11]) != (b"RIFF", b"WAVE", 8, b"data"):
        raise ValueError("not an 8-bit sound file of the kind that medium() writes")
    return file[HEAD.size : HEAD.size + fields[12]]


def cuts(data: np.ndarray) -> list[int]:
    """Where the chunks of the data end. The hash at a byte depends on the 32 bytes up to it alone."""
    h = _GEAR[data]
    reach = 1
    while reach < 32:  # the hash of 2 * reach bytes from two hashes of reach bytes
        h[reach:] += h[:-reach].copy() << np.uint32(reach)
        reach *= 2
    ends = np.flatnonzero((h >> np.uint32(32 - BITS)) == 0) + 1
    out, at, n = [], 0, len(data)
    while n - at > LEAST:
        i = int(np.searchsorted(ends, at + LEAST))
        at = min(int(ends[i]) if i < len(ends) else n, at + MOST, n)
        out.append(at)
    return out if at == n else [*out, n]


PACK = pa.schema([("medium", pa.binary()), ("chunks", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int32())), ("body", pa.binary())])
READ = pa.schema([("medium", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("n_chunks", pa.int32()), ("feature", pa.string())])
_SQL = {pa.binary(): "binary", pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.list_(pa.binary()): "array<binary>", pa.list_(pa.int32()): "array<int>"}


def _sql(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_SQL[f.type]}" for f in schema)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)


def chunked(samples: bytes) -> tuple[list[bytes], list[bytes]]:
    """The chunks of a payload, and their digests."""
    ends = cuts(np.frombuffer(samples, np.uint8))
    parts = [samples[x:y] for x, y in zip([0, *ends], ends, strict=False)]
    return parts, [hashlib.blake2b(p, digest_size=16).digest() for p in parts]


LISTED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("text_hash", pa.int64()), ("medium", pa.binary()), ("m", pa.int64()), ("digests", pa.list_(pa.binary()))])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's medium by name, m being the name's first bytes; with its distinct digests where it is the first in the batch."""
    for b in T.parts(batches):
        seen: set[bytes] = set()
        out = []
        for i, h, text in zip(b.column("doc_id").to_pylist(), b.column("text_hash").to_pylist(), b.column("text"), strict=True):
            text = (text.as_py() or "").encode()
            samples = padded(text)
            name = hashlib.sha256(head(len(samples)) + samples).digest()
            out.append((i, len(text), h, name, int.from_bytes(name[:8], "little", signed=True), None if name in seen else list(dict.fromkeys(chunked(samples)[1]))))
            seen.add(name)
        yield _rows(out, LISTED)


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    texts = [(t or "").encode() for b in batches for t in b.column(0).to_pylist()]
    try:
        made = zstandard.train_dictionary(DICTIONARY, texts).as_bytes()
    except zstandard.ZstdError:  # too few texts
        made = b""
    yield pa.RecordBatch.from_arrays([pa.array([made])], names=["dictionary"])


class Packing:
    """Compresses packs, with a dictionary from a bounded sample of texts' beginnings; values come out as they went in."""

    def __init__(self, docs: DataFrame, n: int, sample: int = SAMPLE):
        some = docs.sample(False, min(1.0, sample / max(n, 1)), 6).select(F.substring("text", 1, CHARS).alias("text"))
        made = some.repartition(1).mapInArrow(_trained, "dictionary binary").first()
        self.dictionary = bytes(made[0]) if made else b""

    def _dictionary(self):
        import zstandard

        return {"dict_data": zstandard.ZstdCompressionDict(self.dictionary)} if self.dictionary else {}

    def pack(self) -> Callable[[bytes], bytes]:
        import zstandard

        return zstandard.ZstdCompressor(level=LEVEL, **self._dictionary()).compress

    def unpack(self) -> Callable[[bytes], bytes]:
        import zstandard

        return zstandard.ZstdDecompressor(**self._dictionary()).decompress

    def whole(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """texts -> PACK, each medium once in a batch; a body has the medium's distinct chunks in the order of their first place."""
        pack = self.pack()
        for b in T.parts(batches):
            out: dict[bytes, tuple] = {}
            for text in b.column(0):
                samples = padded((text.as_py() or "").encode())
                name = hashlib.sha256(head(len(samples)) + samples).digest()
                if name not in out:
                    parts, digests = chunked(samples)
                    body = b"".join(dict(zip(digests, parts, strict=True)).values())
                    out[name] = (name, digests, [len(p) for p in parts], pack(body))
            yield _rows(list(out.values()), PACK)

    def split(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """PACK with `shared`, the medium's chunks that others have too -> PACK without those, and a row (digest, chunk) for each of
        them that is the medium's to write (`own`)."""
        pack, un = self.pack(), self.unpack()
        for b in T.parts(batches, 256):
            out = []
            for name, digests, sizes, body, shared in zip(*(c.to_pylist() for c in b.columns), strict=True):
                shared = {x["digest"]: x["own"] for x in shared or ()}
                body, at, left = un(body), 0, []
                for d, n in dict(zip(digests, sizes, strict=True)).items():
                    if d not in shared:
                        left.append(body[at : at + n])
                    elif shared[d]:
                        out.append((None, None, None, None, d, body[at : at + n]))
                    at += n
                out.append((name, digests, sizes, pack(b"".join(left)), None, None))
            yield _rows(out, SPLIT)

    def read(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """PACK, with the shared chunks where there are any, -> media put together and verified, with the values read from them."""
        un = self.unpack()
        for b in T.parts(batches, 256):
            out = []
            for name, digests, sizes, body, *shared in zip(*(c.to_pylist() for c in b.columns), strict=True):
                known = {x["digest"]: x["chunk"] for x in (shared[0] if shared else None) or ()}
                body, at = un(body), 0
                for d, n in zip(digests, sizes, strict=True):
                    if d not in known:
                        known[d] = body[at : at + n]
                        at += n
                samples = b"".join(known[d] for d in digests)
                file = head(len(samples)) + samples
                if hashlib.sha256(file).digest() != name:
                    raise ValueError(f"medium {name.hex()} is damaged")
                samples = payload(file)
                out.append((name, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-TAIL:]), len(file), name.hex(), len(digests), features(samples)))
            yield _rows(out, READ)


SPLIT = pa.schema([*PACK, ("digest", pa.binary()), ("chunk", pa.binary())])


def features(samples: bytes) -> str:
    """Mean and spread of the samples in hundredths, zero crossings of the centred signal, loudest sample, and four band levels."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    mean = int(x.sum() * 100 // len(x))
    spread = int((x * x).sum() * 100 // len(x)) - mean * mean // 100
    over = x * 100 >= mean
    bands = [int(np.abs(x[k:] - x[:-k]).sum() * 100 // len(x)) for k in (1, 2, 4, 8)]
    return f"mean={mean};spread={spread};crossings={int((over[1:] != over[:-1]).sum())};peak={int(x.max())};bands={','.join(map(str, bands))}"


class MediaStore:
    """Media of documents: rows(doc_id, n_bytes, medium), whole packs, split packs and shared chunks(digest, n, chunk).

    Texts of media with a shared chunk, or that occur more than once, are told by a bit map of their hashes, of bounded size; a text
    that has a bit by chance goes their way as well. Only these are shuffled."""

    def __init__(self, docs: DataFrame):
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
        self.rows = cut(docs.mapInArrow(_listed, _sql(LISTED)), "media")
        self.n = self.rows.count()
        self.packing = Packing(docs, self.n)
        refs = self.rows.where("digests IS NOT NULL").select("m", F.explode("digests").alias("digest"))
        # m stands for the medium here: should two media have the same, a chunk that only they have is taken for one medium's.
        kinds = refs.groupBy("digest").agg(F.min("m").alias("owner"), F.max("m").alias("last"), F.count("*").alias("n"))
        kinds = cut(kinds.where("owner <> last").drop("last"), "kinds")
        total = kinds.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        shared = lookup_join(refs, kinds, ["digest"], "n", total).select("m", F.struct("digest", (F.col("m") == F.col("owner")).alias("own")).alias("c"))
        plan = shared.groupBy("m").agg(F.collect_set("c").alias("shared"))
        # Texts of one medium differ in spaces at their end alone, so there are PAD of them at most.
        times = self.rows.groupBy("m", "medium").agg(F.count("*").alias("times"), F.collect_set("text_hash").alias("hashes"))
        moved = cut(times.join(plan, "m", "left").where("shared IS NOT NULL OR times > 1").select("medium", "shared", "hashes"), "moved")
        bit = f"pmod({{0}}, {1 << MAP_BITS}L)"
        marks = moved.select(F.explode("hashes").alias("h")).selectExpr(f"{bit.format('h')} DIV 64 AS word", f"shiftleft(1L, CAST({bit.format('h')} % 64 AS INT)) AS bit")
        marks = F.broadcast(marks.groupBy("word").agg(F.bit_or("bit").alias("bits")))  # 1 << MAP_BITS bits at most
        marked = docs.withColumn("word", F.expr(f"{bit.format('text_hash')} DIV 64")).join(marks, "word", "left")
        marked = marked.withColumn("moves", F.expr(f"coalesce(bits & shiftleft(1L, CAST({bit.format('text_hash')} % 64 AS INT)), 0L) <> 0"))
        self.whole = cut(marked.where("NOT moves").select("text").mapInArrow(self.packing.whole, _sql(PACK)), "packs", level=LEVEL)
        packs = marked.where("moves").select("text").mapInArrow(self.packing.whole, _sql(PACK))
        packs = packs.groupBy("medium").agg(F.first(F.struct("chunks", "sizes", "body")).alias("p")).select("medium", "p.*")
        packs = packs.join(moved.select("medium", "shared"), "medium", "left")
        parts = cut(packs.mapInArrow(self.packing.split, _sql(SPLIT)), "parts", level=LEVEL)
        self.split = parts.where("digest IS NULL").drop("digest", "chunk")
        chunks = parts.where("digest IS NOT NULL").select("digest", "chunk").join(kinds.select("digest", "n"), "digest")
        self.chunks = cut(chunks.dropDuplicates(["digest"]), "chunks", "digest", level=LEVEL)
        self.moved = moved
        drop(kinds)

    def read(self) -> DataFrame:
        """Each distinct medium, read back from the store: the columns of READ."""
        total = self.chunks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        refs = self.moved.select("medium", F.explode("shared.digest").alias("digest"))
        found = lookup_join(refs, self.chunks, ["digest"], "n", total).groupBy("medium").agg(F.collect_list(F.struct("digest", "chunk")).alias("shared"))
        split = self.split.join(found, "medium", "left")
        return self.whole.mapInArrow(self.packing.read, _sql(READ)).unionByName(split.mapInArrow(self.packing.read, _sql(READ)))

    def sizes(self) -> DataFrame:
        """One row: bytes of all payloads, of the distinct ones, and what sharing chunks between those saves (before compression)."""
        total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
        lists = self.whole.select("sizes").unionByName(self.split.select("sizes"))
        distinct = lists.agg(total(F.expr("aggregate(sizes, 0L, (a, x) -> a + x)"), "distinct_bytes"))
        refs = self.moved.select(F.explode("shared.digest").alias("digest")).groupBy("digest").agg(F.count("*").alias("refs"))
        saved = self.chunks.join(refs, "digest").agg(total(F.octet_length("chunk") * (F.col("refs") - 1), "saved_bytes"))
        every = self.rows.agg(total(F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / PAD)) * PAD, "payload_bytes"))
        return every.join(F.broadcast(distinct), F.lit(True)).join(F.broadcast(saved), F.lit(True))  # one row each


def op6_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = MediaStore(documents(spark, sf_dir))
    times = store.rows.groupBy("medium").agg(F.count("*").alias("times"))
    back = cut(store.read().join(times, "medium"), "values")
    out = lookup_join(store.rows.select("doc_id", "n_bytes", "medium"), back, ["medium"], "times", store.n)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_chunks")


QUERIES, ORACLES = {"op6_media_chunks": op6_media_chunks}, {}
