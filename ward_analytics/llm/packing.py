"""Best-fit packing of token pieces by a grouping genetic algorithm on islands.

A gene is a whole bin. Crossover takes the well-filled bins of one parent into a copy of the other, removes the bins
that hold a piece twice, and puts what has lost its bin back by best fit, longest first. Pieces are dealt at random into
shards, each a packing problem of its own; several islands breed packings of each shard, and after each epoch
the best packing of an island moves to the next one. Bins that stay badly filled in the best packing of each
shard are opened once more and packed together, in fewer and fewer shards.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ward_analytics.llm import arrays
from ward_analytics.llm.tables import cut

CAPACITY = 2048
END = 0
SHARD = 8_000
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
#: Children of a population in an epoch. With 4 hardly any packing got better than best fit; beyond 30 few still do.
GENERATIONS = 30
#: A bin is well filled from this share of its capacity.
WELL = 0.998
SLICE_BYTES = 8 << 20

SPECIAL = "<|endoftext|>"
#: What the tokenizer takes for white space beyond ASCII, and its special token: such texts are encoded whole.
_UNUSUAL = "[\x1c-\x1f\x85   -     　]|<\\|endoftext\\|>"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=2)
def _word_encoder(path: str):
    """The same vocabulary in a form that encodes words faster, and the length in bytes of each token.

    Its ids are the order of its merges, so an id is a rank, too.
    """
    import public_tokenizers
    import tiktoken

    of, ranks = _byte_characters(), {}
    for token, i in _tokenizer(path).get_vocab().items():
        if token != SPECIAL:
            ranks[bytes(of[c] for c in token)] = i
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        size[i] = len(token)
    return tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), size


def encode(column: pa.Array, path: str) -> Iterator[np.ndarray]:
    """Token ids of each text, without an end token; a null text has none.

    The tokenizer never joins what stands before white space with it. So a text is cut into words, each with
    the white space before it; the different ones of a slice are encoded once, in one go, and told apart by their bytes.
    """
    tokenizer, (words, size) = _tokenizer(path), _word_encoder(path)
    unusual = pc.fill_null(pc.match_substring_regex(column, _UNUSUAL), False).to_numpy(zero_copy_only=False)
    data, offsets = arrays.text_bytes(column)
    for a, b in arrays.slices(offsets, SLICE_BYTES):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        _, ends, first = arrays.spans(part, at)
        cuts = np.sort(np.concatenate((at, ends)), kind="stable")
        cuts = cuts[np.concatenate(([True], cuts[1:] != cuts[:-1]))]
        begin, end = cuts[:-1], cuts[1:]
        number, _ = pd.factorize(arrays.names(part, begin, end))
        different = np.empty(int(number.max(initial=-1)) + 1, np.int64)
        different[number[::-1]] = np.arange(len(number))[::-1]
        ids, first_id, n_ids = _encode_units(part, begin[different], end[different], words, size)
        text_first = np.searchsorted(begin, at)
        for i in range(a, b):
            if unusual[i]:
                yield np.array(tokenizer.encode(column[i].as_py(), add_special_tokens=False).ids, np.uint32)
                continue
            unit = number[text_first[i - a] : text_first[i - a + 1]]
            n = n_ids[unit]
            total = int(n.sum())
            place = np.arange(total) + np.repeat(first_id[unit] - (np.cumsum(n) - n), n)
            yield ids[place]


def _encode_units(part: np.ndarray, begin: np.ndarray, end: np.ndarray, words, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of units one after another, the first of each unit and their number.

    Units that begin with white space are encoded as one long text, since they don't join; the tokens' lengths
    tell where each ends. The others, at the beginnings of texts, are encoded one by one.
    """
    spaced = ~arrays._WORD_BYTE[part[begin]] if len(begin) else np.empty(0, bool)
    trailing = spaced & ~arrays._WORD_BYTE[part[np.maximum(end - 1, 0)]] if len(begin) else spaced
    joined = np.flatnonzero(spaced & ~trailing)
    alone = np.flatnonzero(~spaced | trailing)
    first, count = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
    ids, done = [], 0
    for some in np.array_split(joined, max(1, len(joined) // 4096)):
        if not len(some):
            continue
        length = end[some] - begin[some]
        edge = np.cumsum(length)
        total = int(edge[-1])
        text = part[np.arange(total) + np.repeat(begin[some] - (edge - length), length)].tobytes().decode()
        got = np.array(words.encode_ordinary(text), np.uint32)
        upto = np.searchsorted(np.cumsum(size[got]), edge, side="left") + 1
        count[some] = np.diff(np.concatenate(([0], upto)))
        first[some] = done + upto - count[some]
        ids.append(got)
        done += len(got)
    if len(alone):
        for unit, x, y in zip(alone.tolist(), begin[alone].tolist(), end[alone].tolist(), strict=True):
            got = np.array(words.encode_ordinary(part[x:y].tobytes().decode()), np.uint32)
            first[unit], count[unit] = done, len(got)
            ids.append(got)
            done += len(got)
    return np.concatenate(ids) if ids else np.empty(0, np.uint32), first, count


def pieces(documents: DataFrame, path: str, capacity: int = CAPACITY, keep: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Each document's ids and an end id, cut if longer than the capacity: keep, piece, start, length, ids_crc32 (and ids).

    All pieces but the first are as long as the capacity. A null or empty text is the end id alone.
    """
    kind = documents.schema[keep].dataType.simpleString()
    schema = f"{keep} {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, piece, start, length, crc, own = [], [], [], [], [], []
            for i, ids in enumerate(encode(batch.column(1), path)):
                ids = np.append(ids, np.uint32(END)).astype("<u4")
                edge = 0
                for k in range(-(-len(ids) // capacity)):
                    n = (len(ids) - edge) % capacity or capacity
                    of.append(i)
                    piece.append(k)
                    start.append(edge)
                    length.append(n)
                    crc.append(zlib.crc32(ids[edge : edge + n].tobytes()))
                    if with_ids:
                        own.append(ids[edge : edge + n].astype(np.int64))
                    edge += n
            columns = [batch.column(0).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = [keep, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(own, pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return documents.select(F.col(keep).alias(keep), F.col("text").alias("text")).mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, items: np.ndarray, bins: list[list[int]], room: list[int], capacity: int) -> None:
    """Puts items, longest first, into the fullest bin that has room for them, else into a new one. Changes bins and room."""
    free = sorted((r, i) for i, r in enumerate(room) if r)
    for item in items[np.argsort(-lengths[items], kind="stable")].tolist():
        n = int(lengths[item])
        at = bisect_left(free, (n, -1))
        if at < len(free):
            left, i = free.pop(at)
            bins[i].append(item)
            left -= n
        else:
            left, i = capacity - n, len(bins)
            bins.append([item])
            room.append(left)
        room[i] = left
        if left:
            insort(free, (left, i))


def _fitness(lengths: np.ndarray, assigned: np.ndarray, capacity: int) -> tuple[int, float]:
    """Number of bins, then how unevenly they are filled: fewer, and fuller ones, are better."""
    load = np.bincount(assigned, lengths)
    return -int((load > 0).sum()), float(np.square(load / capacity).sum())


def _renumbered(assigned: np.ndarray) -> np.ndarray:
    return np.unique(assigned, return_inverse=True)[1]


def crossover(lengths: np.ndarray, giver: np.ndarray, taker: np.ndarray, random: np.random.Generator, capacity: int) -> np.ndarray:
    """A child: some well-filled bins of the giver, the bins of the taker that hold none of their pieces, the rest by best fit.

    The taker's worst bins are opened, too, so that what they hold can find better places.
    """
    load = np.bincount(giver, lengths)
    full = np.flatnonzero(load >= WELL * capacity)
    chosen = np.zeros(len(load), bool)
    chosen[full[random.random(len(full)) < 0.5]] = True
    injected = chosen[giver]
    load = np.bincount(taker, lengths)
    gone = np.zeros(len(load), bool)
    gone[taker[injected]] = True
    gone |= (load < WELL * capacity) & (random.random(len(load)) < 0.9)
    kept = ~injected & ~gone[taker]
    child = np.full(len(giver), -1)
    child[kept] = taker[kept]
    child[injected] = giver[injected] + len(load)
    settled = child >= 0
    used, child[settled] = np.unique(child[settled], return_inverse=True)
    load = np.bincount(child[settled], lengths[settled], minlength=len(used)).astype(np.int64)
    loose = np.flatnonzero(~settled)
    loose = loose[random.permutation(len(loose))]
    bins: list[list[int]] = [[] for _ in used]
    best_fit(lengths, loose, bins, (capacity - load).tolist(), capacity)
    for i, members in enumerate(bins):
        child[members] = i
    return child


def _first_packing(lengths: np.ndarray, random: np.random.Generator | None, capacity: int) -> np.ndarray:
    """Best fit, longest first; with ``random`` a share of the bins is filled at random first, which makes packings differ."""
    bins: list[list[int]] = []
    room: list[int] = []
    items = np.arange(len(lengths))
    if random is not None:
        mixed = random.permutation(len(lengths))
        some, items = mixed[: len(mixed) // 10], mixed[len(mixed) // 10 :]
        for item in some.tolist():
            bins.append([item])
            room.append(capacity - int(lengths[item]))
    best_fit(lengths, items, bins, room, capacity)
    assigned = np.empty(len(lengths), np.int64)
    for i, members in enumerate(bins):
        assigned[members] = i
    return assigned


def evolve(lengths: np.ndarray, population: list[np.ndarray], seed: int, generations: int = GENERATIONS, size: int = POPULATION, capacity: int = CAPACITY) -> list[np.ndarray]:
    """The population after some generations, best first. An empty one is founded; no packing gets worse than the best before."""
    random = np.random.default_rng(seed)
    if not population:
        population = [_first_packing(lengths, None if i == 0 else random, capacity) for i in range(size)]
    least = -(-int(lengths.sum()) // capacity)
    scored = sorted(((_fitness(lengths, p, capacity), i, p) for i, p in enumerate(population)), key=lambda x: x[0], reverse=True)
    for generation in range(generations):
        if -scored[0][0][0] <= least:
            break
        a, b = random.choice(len(scored), 2, replace=len(scored) < 2)
        child = crossover(lengths, scored[min(a, b)][2], scored[max(a, b)][2], random, capacity)
        scored.append((_fitness(lengths, child, capacity), size + generation, child))
        scored = sorted(scored, key=lambda x: x[0], reverse=True)[:size]
    return [p for _, _, p in scored]


_STATE = "shard long, island int, rank int, items binary, lengths binary, assigned binary"
_SCHEMA = pa.schema([("shard", pa.int64()), ("island", pa.int32()), ("rank", pa.int32()), ("items", pa.binary()), ("lengths", pa.binary()), ("assigned", pa.binary())])


def _bred(shards: DataFrame, islands: int, epochs: int, capacity: int) -> DataFrame:
    """The best packing of each shard: shard, items, lengths, assigned. shards: shard, items, lengths."""

    def breeding(epoch: int):
        def breed(table: pa.Table) -> pa.Table:
            rows = sorted(table.to_pylist(), key=lambda r: r["rank"])
            own = rows[0]
            lengths = np.frombuffer(own["lengths"], np.int32).astype(np.int64)
            population = [np.frombuffer(r["assigned"], np.int32).astype(np.int64) for r in rows if r["assigned"]]
            seed = zlib.crc32(f"{own['shard']} {own['island']} {epoch}".encode())
            bred = evolve(lengths, population, seed, capacity=capacity)
            out = [(own["shard"], own["island"], i, own["items"], own["lengths"], _renumbered(p).astype(np.int32).tobytes()) for i, p in enumerate(bred)]
            return pa.table(list(map(list, zip(*out, strict=True))), schema=_SCHEMA)

        return breed

    state = shards.select("*", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island")).select(
        "shard", "island", F.lit(0).alias("rank"), "items", "lengths", F.lit(None).cast("binary").alias("assigned")
    )
    for epoch in range(epochs):
        state = state.groupBy("shard", "island").applyInArrow(breeding(epoch), _STATE)
        if epoch + 1 < epochs:  # the best one visits the next island and stays at home as well
            visit = F.when(F.col("rank") == 0, F.array(F.col("island"), F.pmod(F.col("island") + 1, F.lit(islands)))).otherwise(F.array("island"))
            state = state.withColumn("island", F.explode(visit))

    def best(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        lengths = np.frombuffer(rows[0]["lengths"], np.int32).astype(np.int64)
        found = max(rows, key=lambda r: (_fitness(lengths, np.frombuffer(r["assigned"], np.int32), capacity), -r["island"]))
        return pa.table([[found["shard"]], [found["items"]], [found["lengths"]], [found["assigned"]]], names=["shard", "items", "lengths", "assigned"])

    return state.where("rank = 0").groupBy("shard").applyInArrow(best, "shard long, items binary, lengths binary, assigned binary")


def pack(items: DataFrame, capacity: int = CAPACITY, islands: int = ISLANDS, epochs: int = EPOCHS, shard: int = SHARD) -> DataFrame:
    """A bin for each row of (item, length): item, sequence_id, offset. Items are integers of their own; lengths are 1 to ``capacity``."""
    full = items.where(F.col("length") == capacity).select("item", F.lit(0).alias("level"), F.lit(0).cast("long").alias("shard"), F.col("item").cast("long").alias("bin"), F.lit(0).cast("long").alias("offset"))
    rest, done = items.where(F.col("length") < capacity), []
    n = rest.count()
    for level in (1, 2):
        n_shards = max(1, -(-n // shard)) if level == 1 else max(1, -(-n // (4 * shard)))

        def gather(table: pa.Table) -> pa.Table:
            item, length = table.column("item").to_numpy(), table.column("length").to_numpy()
            order = np.argsort(item, kind="stable")
            return pa.table([[table.column("shard")[0].as_py()], [item[order].astype(np.int64).tobytes()], [length[order].astype(np.int32).tobytes()]], names=["shard", "items", "lengths"])

        dealt = rest.select(F.pmod(F.xxhash64("item", F.lit(level)), F.lit(n_shards)).alias("shard"), "item", F.col("length").cast("long").alias("length"))
        shards = dealt.groupBy("shard").applyInArrow(gather, "shard long, items binary, lengths binary")

        def settle(batches: Iterator[pa.RecordBatch], last: bool = level == 2) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    item, length, bins = np.frombuffer(row["items"], np.int64), np.frombuffer(row["lengths"], np.int32).astype(np.int64), np.frombuffer(row["assigned"], np.int32).astype(np.int64)
                    load = np.bincount(bins, length)
                    order = np.lexsort((item, bins))
                    before = np.cumsum(length[order]) - length[order]
                    first = np.searchsorted(bins[order], np.arange(len(load)))
                    offset = before - before[first][bins[order]]
                    settled = np.full(len(item), True) if last else (load >= WELL * capacity)[bins[order]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(item[order]), pa.array(length[order]), pa.array(np.full(len(item), row["shard"])), pa.array(bins[order]), pa.array(offset), pa.array(settled)],
                        ["item", "length", "shard", "bin", "offset", "settled"],
                    )

        packed = cut(_bred(shards, islands, epochs, capacity).mapInArrow(settle, "item long, length long, shard long, bin long, offset long, settled boolean"))
        done.append(packed.where("settled").select("item", F.lit(level).alias("level"), "shard", "bin", "offset"))
        if level == 1:
            rest = packed.where("not settled").select("item", "length")
            n = rest.count()
    every = full.unionByName(done[0]).unionByName(done[1])
    # full pieces take even numbers, the bins of both levels odd ones: (bin, shard, level) by place
    number = F.when(F.col("level") == 0, F.col("bin") * 2).otherwise(((F.col("shard") * 2 + F.col("level") - 1) * (8 * shard) + F.col("bin")) * 2 + 1)
    return every.select("item", number.alias("sequence_id"), "offset")


def pack_documents(documents: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and the ids if asked for.

    Sequences are gapless from offset 0. Rows are documents of their own, even if doc_id is null or
    repeats; other columns don't matter. An empty table gives an empty table.
    """
    cuts = cut(pieces(documents, path, capacity, with_ids=with_ids).withColumn("item", F.monotonically_increasing_id()))
    packed = pack(cuts.select("item", "length"), capacity)
    return cuts.join(packed, "item").drop("item")
