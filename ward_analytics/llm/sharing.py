"""Which keys do documents share? Documents in chunks, keys as packed arrays, answers sent back to the chunks.

A chunk is the documents whose ids and texts hash alike, a few MB of text; it is dealt out by one shuffle, which every later step
reads again. Each step sends the keys of a chunk, each once, as one sorted array per bucket of keys; what a bucket finds goes back as one
array per chunk in the same order. So a key that a third of all documents hold is one entry per chunk,
and no step holds more than a chunk or a bucket. Answers are notes: rows of (chunk, kind, bucket, body).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ward_analytics.llm import arrays

CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 6 << 20
NOTES = "chunk long, kind int, bucket int, body binary"
_NOTES = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("body", pa.binary())])
COPY, SHARED, FIRST, OTHER, WIDE = range(5)

Keys = Callable[[pa.Table, "Notes"], tuple[np.ndarray, np.ndarray]]


def chunk_of(name: Column, n_chunks: int) -> Column:
    """The chunk of a row by its doc_id and the name of its text, so that rows of one repeated id lie apart."""
    return F.pmod(F.xxhash64(F.col("doc_id"), name), F.lit(n_chunks))


class Notes:
    """The notes of one chunk."""

    def __init__(self, table: pa.Table):
        self.of: dict[int, dict[int, bytes]] = {}
        for kind, bucket, body in zip(*(table.column(c).to_pylist() for c in ("kind", "bucket", "body")), strict=True):
            self.of.setdefault(kind, {})[bucket] = body

    def bodies(self, kind: int) -> dict[int, bytes]:
        return self.of.get(kind, {})


class Chunks:
    """Documents by chunk.

    documents: doc_id and text, and the columns ``rest`` carried along. Rows without doc_id take part in
    nothing; rows with the same doc_id are documents of their own, none of them before the other.
    """

    def __init__(self, documents: DataFrame, doc_id: str = "doc_id", text: str = "text", rest: list[str] | None = None):
        size = documents.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
        self.size = int(size)
        self.n_chunks = max(1, math.ceil(self.size / CHUNK_BYTES))
        self.bits = max(3, math.ceil(math.log2(max(1, self.size / BUCKET_BYTES))))
        self.spark = documents.sparkSession
        own = documents.select(
            F.col(doc_id).cast("long").alias("doc_id"),
            F.col(text).alias("text"),
            F.struct(*[F.col(c) for c in rest or [doc_id]]).alias("rest"),
        )
        self.documents = own.select(chunk_of(F.xxhash64("text"), self.n_chunks).alias("chunk"), "*")
        self.rest_type = self.documents.schema["rest"].dataType.simpleString()

    def no_notes(self) -> DataFrame:
        return self.spark.createDataFrame([], NOTES)

    def copies(self) -> tuple[DataFrame, DataFrame]:
        """Exact copies of a text with a smaller doc_id: as notes, and as rows (doc_id, first). Texts without a word aren't looked at."""
        with_words = F.col("doc_id").isNotNull() & F.col("text").rlike("[^\\x20\\x09-\\x0D]")
        named = self.documents.where(with_words).select(
            "chunk", "doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), F.xxhash64("text").alias("name")
        )
        first = named.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
        copies = named.join(first.drop("last"), "digest").where("doc_id > first")
        body = F.concat(*[F.unhex(F.lpad(F.hex(c), 16, "0")) for c in ("doc_id", "name")])
        notes = (
            copies.groupBy("chunk").agg(F.array_join(F.collect_list(F.hex(body)), "").alias("all"))
            .select("chunk", F.lit(COPY).alias("kind"), F.lit(0).alias("bucket"), F.unhex("all").alias("body"))
        )
        return notes, copies.select("doc_id", "first")

    def apply(self, notes: DataFrame, work: Callable[[pa.Table, Notes], pa.Table], schema: str) -> DataFrame:
        """Each chunk with its notes, without the rows that have no doc_id."""

        def run(documents: pa.Table, found: pa.Table) -> pa.Table:
            return work(documents, Notes(found))

        dealt = self.documents.where("doc_id is not null").groupBy("chunk")
        return dealt.cogroup(notes.toDF("chunk", "kind", "bucket", "body").groupBy("chunk")).applyInArrow(run, schema)

    def apply_to_all(self, notes: DataFrame, work: Callable[[pa.Table, Notes], pa.Table], schema: str) -> DataFrame:
        """Each chunk with its notes, and the rows without doc_id where they are, without notes."""

        def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from work(pa.Table.from_batches([batch]), Notes(_NOTES.empty_table())).combine_chunks().to_batches()

        return self.apply(notes, work, schema).unionByName(self.documents.where("doc_id is null").mapInArrow(alone, schema))

    def shared(self, notes: DataFrame, keys_of: Keys, wide: int = 1 << 62) -> DataFrame:
        """Notes that tell each chunk which of its keys documents with different ids hold, and which of those more than ``wide`` chunks hold."""

        def meet(table: pa.Table) -> pa.Table:
            return _meet_shared(table, wide)

        return self._sent(notes, keys_of, False).groupBy("bucket").applyInArrow(meet, NOTES)

    def first_owner(self, notes: DataFrame, keys_of: Keys) -> DataFrame:
        """Notes that tell each chunk, for each of its keys, the smallest doc_id that holds it."""
        return self._sent(notes, keys_of, True).groupBy("bucket").applyInArrow(_meet_first, NOTES)

    def _sent(self, notes: DataFrame, keys_of: Keys, full: bool) -> DataFrame:
        bits = self.bits

        def send(documents: pa.Table, found: Notes) -> pa.Table:
            keys, lowest, several = distinct(*keys_of(documents, found))
            chunk, rows = _chunk(documents), []
            for bucket, a, b in buckets(keys, bits):
                body = keys[a:b].tobytes() if full else _short(keys[a:b])
                rows.append((bucket, chunk, body, lowest[a:b].tobytes() if full else np.packbits(several[a:b]).tobytes()))
            return pa.table(list(map(list, zip(*rows, strict=True))) or [[]] * 4, schema=_SENT)

        return self.apply(notes, send, "bucket int, chunk long, body binary, more binary")


_SENT = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("body", pa.binary()), ("more", pa.binary())])


def _chunk(documents: pa.Table) -> int:
    return documents.column("chunk")[0].as_py() if documents.num_rows else -1


def distinct(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys in order, the smallest owner of each, and whether there are several owners."""
    order = np.argsort(keys, kind="stable")
    keys, owners = keys[order], owners[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    if not len(first):
        return keys, owners, np.empty(0, bool)
    lowest = np.minimum.reduceat(owners, first)
    return keys[first], lowest, np.maximum.reduceat(owners, first) > lowest


def buckets(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """Sorted keys by their highest bits: bucket, first and last place."""
    edges = np.searchsorted(keys, np.arange(1, 2**bits, dtype=np.uint64) << np.uint64(64 - bits))
    edges = [0, *edges.tolist(), len(keys)]
    return ((i, edges[i], edges[i + 1]) for i in range(2**bits) if edges[i + 1] > edges[i])


def _short(keys: np.ndarray) -> bytes:
    """48 bits of each key that, with the bucket, tell keys apart well enough to find what may be shared."""
    return np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _joined(column: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Bodies one after another as rows of ``width`` bytes, and the number of rows of each."""
    bodies = column.to_pylist()
    return np.frombuffer(b"".join(bodies), np.uint8).reshape(-1, width), np.array([len(b) // width for b in bodies])


def _short_keys(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    short, sizes = _joined(table.column("body"), 6)
    keys = np.zeros((len(short), 8), np.uint8)
    keys[:, :6] = short
    return keys.view(np.uint64).ravel(), sizes


def _meet_shared(table: pa.Table, wide: int) -> pa.Table:
    keys, sizes = _short_keys(table)
    several = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=n) for m, n in zip(table.column("more").to_pylist(), sizes.tolist(), strict=True)]).astype(bool)
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1])))
    times = np.diff(np.concatenate((first, [len(keys)])))
    common = (times > 1) | np.logical_or.reduceat(several[order], first)
    out = np.empty(len(keys), bool)
    out[order] = np.repeat(common, times)
    found = _notes(table, SHARED, sizes, out, lambda x: np.packbits(x).tobytes(), np.any)
    if int(times.max()) > wide:
        out[order] = np.repeat(times > wide, times)
        found = pa.concat_tables([found, _notes(table, WIDE, sizes, out, lambda x: np.packbits(x).tobytes(), np.any)])
    return found


def _meet_first(table: pa.Table) -> pa.Table:
    keys, sizes = _joined(table.column("body"), 8)
    owners, _ = _joined(table.column("more"), 8)
    keys, owners = keys.copy().view(np.uint64).ravel(), owners.copy().view(np.int64).ravel()
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1])))
    out = np.empty_like(owners)
    out[order] = np.repeat(np.minimum.reduceat(owners[order], first), np.diff(np.concatenate((first, [len(keys)]))))
    return _notes(table, FIRST, sizes, out, lambda x: x.tobytes(), len)


def _notes(table: pa.Table, kind: int, sizes: np.ndarray, values: np.ndarray, pack: Callable, wanted: Callable) -> pa.Table:
    ends = np.cumsum(sizes).tolist()
    rows = [
        (chunk, kind, bucket, pack(values[end - n : end]))
        for chunk, bucket, n, end in zip(table.column("chunk").to_pylist(), table.column("bucket").to_pylist(), sizes.tolist(), ends, strict=True)
        if wanted(values[end - n : end])
    ]
    return pa.table(list(map(list, zip(*rows, strict=True))) or [[]] * 4, schema=_NOTES)


def shared_keys(keys: np.ndarray, owners: np.ndarray, notes: Notes, bits: int) -> np.ndarray:
    """Those of a chunk's keys that ``shared`` found to be shared, in order. keys and owners: as sent."""
    keys, _, _ = distinct(keys, owners)
    bodies = notes.bodies(SHARED)
    found = [keys[a:b][np.unpackbits(np.frombuffer(bodies[i], np.uint8), count=b - a).astype(bool)] for i, a, b in buckets(keys, bits) if i in bodies]
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def first_owners(keys: np.ndarray, owners: np.ndarray, notes: Notes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's different keys in order, and the smallest doc_id that holds each anywhere."""
    keys, lowest, _ = distinct(keys, owners)
    bodies = notes.bodies(FIRST)
    for i, a, b in buckets(keys, bits):
        lowest[a:b] = np.frombuffer(bodies[i], np.int64)
    return keys, lowest


def member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether each value is among the sorted ``of``."""
    if not len(of):
        return np.zeros(len(values), bool)
    return of[np.minimum(np.searchsorted(of, values), len(of) - 1)] == values


def is_copy(documents: pa.Table, notes: Notes) -> np.ndarray:
    """Rows that ``Chunks.copies`` found to be copies of a text with a smaller doc_id."""
    out = np.zeros(documents.num_rows, bool)
    body = notes.bodies(COPY).get(0)
    if body:
        known = set(map(tuple, np.frombuffer(body, ">u8").reshape(-1, 2).tolist()))
        ids = {x for x, _ in known}
        for i, doc in enumerate(documents.column("doc_id").to_pylist()):
            if doc is not None and doc % 2**64 in ids:
                text = documents.column("text")[i].as_py()
                out[i] = text is not None and (doc % 2**64, xxhash.xxh64_intdigest(text.encode(), seed=42)) in known
    return out
