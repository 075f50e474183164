"""Near-duplicate documents: a join of word n-gram sets by Jaccard similarity, with count-vector R-trees.

A document's n-grams are hashed into groups; how many fall into each makes a point. Two documents share at most the sum, over
all groups, of the smaller count, and an R-tree node at most that of its coordinates' maxima. Points whose bound reaches the overlap that the
similarity asks for are verified on the sets themselves.

Trees are local to blocks: linked documents share one of the first n-grams of each, in an order that is the
same for all (n-grams of very many documents last, else by hash), as many as similarity leaves room for. Blocks of one document are never formed.
First, documents of which enough such n-grams are shared meet with their sets in the blocks of two of them, and one link to each is
enough, so that a large group of near copies becomes a class in linear work. Then blocks that hold more
than one class give all their pairs that pass the bound and cross classes; those are verified pair by pair.

Texts are never shuffled. What is kept of all documents is the first n-grams and the point of each; whole sets are taken again from the texts
for those that a step asks for, found by a bit map of fixed size that may let others pass but misses none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ward_analytics.llm import arrays, idmap, sharing
from ward_analytics.llm.graph import components
from ward_analytics.llm.sharing import OTHER, Chunks, Notes
from ward_analytics.llm.tables import cut

N = 5
#: Two sets link if 100 * intersection >= PERCENT * union.
PERCENT = 80
#: N-grams come last in the order if more than one in so many chunks holds them, and more than WIDE chunks do. No more
#: than WIDE_SHARE times the first n-grams of one chunk can be such, so the tasks can all know them.
WIDE_SHARE = 32
WIDE = 8
#: Documents meet in so many blocks with their sets, if at least this share of their first n-grams is shared.
MEETINGS = 2
MOSTLY = 0.3
#: So many chunks meet at a time; what is left of each meeting goes on to the next.
MEET_CHUNKS = 16
#: Members of a class that go on.
GO_ON = 8
#: A point's size in bytes at most: it goes along with each n-gram that classes share.
MOST_GROUPS = 256
_FANOUT = 16
_TOP = 255


def first_ones(n: int | np.ndarray) -> int | np.ndarray:
    """How many n-grams of a set of n, from the front of a common order, contain one of any set it links with."""
    return n - (PERCENT * n + 99) // 100 + 1


def least_overlap(a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | int:
    """The overlap from which sets of these sizes link."""
    return (PERCENT * (a + b) + 99 + PERCENT) // (100 + PERCENT)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets, as sorted arrays, link."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= PERCENT * (len(a) + len(b) - common) and common > 0


def groups(n: int) -> int:
    """Into how many groups a set of n is hashed: as many as n-grams at least, so that the bound lies close above the overlap; of
    large sets fewer, which still differ in enough of them if they are unlike."""
    return min(MOST_GROUPS, 1 << max(4, math.ceil(math.log2(1.25 * max(n, 1)))))


def point(grams: np.ndarray, n_groups: int) -> np.ndarray:
    """Number of n-grams in each group; the largest number stands for itself and all above."""
    return np.minimum(np.bincount((grams & np.uint64(n_groups - 1)).astype(np.int64), minlength=n_groups), _TOP).astype(np.uint8)


def _bound(point: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The largest overlap that points allow; without limit where a number stands for all above."""
    low = np.minimum(others, point)
    out = low.sum(axis=1, dtype=np.int64)
    out[(low == _TOP).any(axis=1)] = 1 << 40
    return out


class Tree:
    """An R-tree over points of one number of groups, bulk-loaded in order of size."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        top, low, high = points, sizes, sizes
        while len(top) > _FANOUT:
            edge = np.arange(0, len(top), _FANOUT)
            top, low, high = np.maximum.reduceat(top, edge), np.minimum.reduceat(low, edge), np.maximum.reduceat(high, edge)
            self.levels.append((top, low, high))

    def search(self, point: np.ndarray, size: int) -> np.ndarray:
        """Numbers of the points that may link."""
        at = np.arange(len(self.levels[-1][0]) if self.levels else len(self.points))
        for top, low, high in [*self.levels[::-1], (self.points, self.sizes, self.sizes)]:
            at = at[at < len(top)]
            at = at[(100 * high[at] >= PERCENT * size) & (PERCENT * low[at] <= 100 * size)]
            at = at[_bound(point, top[at]) >= least_overlap(size, low[at])]
            if top is not self.points:
                at = (at[:, None] * _FANOUT + np.arange(_FANOUT)).ravel()
        return at


class Forest:
    """Trees by number of groups. Sets that may link differ at most by a factor of two in that."""

    def __init__(self, points: list[np.ndarray], sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        width = np.array([len(p) for p in points])
        self.members = {int(w): np.flatnonzero(width == w) for w in np.unique(width)}
        for w, own in self.members.items():
            self.members[w] = own[np.argsort(sizes[own], kind="stable")]
        self.trees = {w: Tree(np.stack([points[i] for i in own]), sizes[own]) for w, own in self.members.items()}

    def search(self, i: int) -> np.ndarray:
        """Members of no greater size that may link with i: itself, equals and smaller ones."""
        own, found = self.points[i], []
        for w in (len(own), len(own) // 2):
            if w in self.trees:
                folded = own if w == len(own) else _fold(own)
                hit = self.members[w][self.trees[w].search(folded, int(self.sizes[i]))]
                found.append(hit[self.sizes[hit] <= self.sizes[i]])
        return np.concatenate(found)


def _fold(point: np.ndarray) -> np.ndarray:
    half = len(point) // 2
    return np.minimum(point[:half].astype(np.int64) + point[half:], _TOP).astype(np.uint8)


def join_classes(ids: np.ndarray, sets: list[np.ndarray]) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links (by id) that connect what the first found link of each member connects, and some members of each class."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    forest = Forest([point(s, groups(len(s))) for s in sets], sizes)
    parent = np.arange(n)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    edges, rank = [], np.empty(n, np.int64)
    order = np.lexsort((ids, sizes))
    rank[order] = np.arange(n)
    for i in order.tolist():
        for j in forest.search(i).tolist():
            if rank[j] < rank[i] and find(j) != find(i) and linked(sets[i], sets[j]):
                edges.append((int(ids[i]), int(ids[j])))
                parent[find(i)] = find(j)
                break
    stay: dict[int, list[int]] = {}
    for i in order.tolist():
        members = stay.setdefault(find(i), [])
        if len(members) < GO_ON:
            members.append(i)
    return edges, np.array(sorted(i for members in stay.values() for i in members), np.int64)


def gram_sets(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    """The n-gram set of each text, in order."""
    return [s for some in _sliced_sets(column) for s in some]


def _sliced_sets(column: pa.Array | pa.ChunkedArray) -> Iterator[list[np.ndarray]]:
    data, offsets = arrays.text_bytes(column)
    for a, b in arrays.slices(offsets):
        out: list[np.ndarray] = []
        part, at = arrays.lower(data[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a]
        starts, ends, first = arrays.spans(part, at)
        names = arrays.names(part, starts, ends)
        runs = arrays.windows(names, N)
        for i, j in zip(first.tolist(), first[1:].tolist(), strict=False):
            if j - i >= N:
                out.append(np.unique(runs[i : j - N + 1]))
            else:
                out.append(arrays.windows(names[i:j], j - i, 1 + j - i) if j > i else np.empty(0, np.uint64))
        yield out


def _ids(documents: pa.Table) -> np.ndarray:
    return documents.column("doc_id").to_pandas().fillna(0).to_numpy().astype(np.int64)


def _short(grams: np.ndarray, bits: int) -> np.ndarray:
    """What buckets know of n-grams: the bucket and 48 more bits."""
    return grams >> np.uint64(64 - bits) << np.uint64(48) | grams & np.uint64(2**48 - 1)


def _prefix(grams: np.ndarray, late: np.ndarray | None = None) -> np.ndarray:
    """The first n-grams of a sorted set in the common order; late: those that come last."""
    n = int(first_ones(len(grams))) if len(grams) else 0
    if late is not None and late.any():
        grams = np.concatenate((grams[~late], grams[late]))
    return grams[:n]


def _marked(sets: list[np.ndarray], rows: np.ndarray, owners: np.ndarray, notes: Notes, bits: int) -> np.ndarray:
    """Those of a chunk's n-grams, as sent, that are shared, in order."""
    return np.sort(sharing.shared_keys(*_flat(sets, rows, owners), notes, bits))


def _flat(sets: list[np.ndarray], rows: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    used = [sets[i] for i in rows.tolist()]
    keys = np.concatenate([np.empty(0, np.uint64), *used])
    return keys, np.repeat(owners[rows], [len(u) for u in used]).astype(np.int64)


_FIRSTS = "doc_id long, name long, n_shingles long, prefix binary, counts binary"


def _firsts_of(texts: DataFrame, wide: np.ndarray, bits: int) -> DataFrame:
    """A row for each document: its size, its first n-grams in the common order, and its point."""
    sent = texts.sparkSession.sparkContext.broadcast(wide)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = gram_sets(batch.column(2))
            firsts = [_prefix(s, sharing.member(_short(s, bits), sent.value)).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(firsts, pa.binary()),
                pa.array([point(s, groups(len(s))).tobytes() if len(s) else b"" for s in sets], pa.binary()),
            ], ["doc_id", "name", "n_shingles", "prefix", "counts"])

    return texts.mapInArrow(run, _FIRSTS)


_PART = pa.schema([("bucket", pa.int32()), ("body", pa.binary())])


def _wide(texts: DataFrame, bits: int, least: int) -> np.ndarray:
    """N-grams, as buckets know them, that are among the first by hash in more than ``least`` slices of texts."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sets in _sliced_sets(batch.column(2)):
                keys = np.unique(np.concatenate([np.empty(0, np.uint64), *map(_prefix, sets)]))
                rows = [(bucket, sharing._short(keys[a:b])) for bucket, a, b in sharing.buckets(keys, bits)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=_PART)

    def meet(table: pa.Table) -> pa.Table:
        keys, times = np.unique(sharing._short_keys(table)[0], return_counts=True)
        bucket = table.column("bucket")[0].as_py()
        return pa.table([pa.array([bucket], pa.int32()), [(keys[times > least] | np.uint64(bucket) << np.uint64(48)).tobytes()]], schema=_PART)

    found = texts.mapInArrow(send, "bucket int, body binary").groupBy("bucket").applyInArrow(meet, "bucket int, body binary")
    bodies = [r["body"] for r in found.where(F.octet_length("body") > 0).select("body").collect()]
    return np.sort(np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(b, np.uint64) for b in bodies)]))


def _rows_in_play(table: pa.Table, notes: Notes) -> np.ndarray:
    """Rows that have an id and an n-gram and aren't a copy of a text with a smaller id."""
    body = notes.bodies(sharing.COPY).get(0)
    active = table.column("doc_id").combine_chunks().is_valid().to_numpy(zero_copy_only=False) & (table.column("n_shingles").to_numpy() > 0)
    if body:
        known = set(map(tuple, np.frombuffer(body, ">i8").reshape(-1, 2).tolist()))
        active &= np.array([x not in known for x in zip(table.column("doc_id").to_pylist(), table.column("name").to_pylist(), strict=True)], bool)
    return np.flatnonzero(active)


def _prefix_sets(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(p, np.uint64) for p in table.column("prefix").to_pylist()]


def _first_keys(table: pa.Table, notes: Notes) -> tuple[np.ndarray, np.ndarray]:
    return _flat(_prefix_sets(table), _rows_in_play(table, notes), _ids(table))


def _class_keys(table: pa.Table, notes: Notes) -> tuple[np.ndarray, np.ndarray]:
    return _flat(_prefix_sets(table), _rows_in_play(table, notes), _classes(table, notes))


class _Firsts:
    """The rows of ``_firsts_of`` by chunk, with the same steps as ``Chunks``."""

    def __init__(self, frame: DataFrame, chunks: Chunks):
        self.documents = frame.withColumn("chunk", sharing.chunk_of(F.col("name"), chunks.n_chunks))
        self.bits, self.spark = chunks.bits, chunks.spark

    apply, shared, _sent = Chunks.apply, Chunks.shared, Chunks._sent


def _classes(table: pa.Table, notes: Notes) -> np.ndarray:
    """The class of each row: as noted, else its own id."""
    own = _ids(table)
    body = notes.bodies(OTHER).get(0)
    if body:
        pairs = np.frombuffer(body, ">i8").astype(np.int64).reshape(-1, 2)
        pairs = pairs[np.argsort(pairs[:, 0])]
        at = np.minimum(np.searchsorted(pairs[:, 0], own), len(pairs) - 1)
        own = np.where(pairs[at, 0] == own, pairs[at, 1], own)
    return own


def _meetings(bits: int):
    """Documents enough of whose first n-grams are shared, and the blocks they meet in: those of the smallest second hashes. Near copies
    mostly agree on them; by the first hash they would not, since the order moves the common ones of small hash to its end."""

    def run(table: pa.Table, notes: Notes) -> pa.Table:
        sets, active = _prefix_sets(table), _rows_in_play(table, notes)
        common = _marked(sets, active, _ids(table), notes, bits)
        chosen, blocks = [], []
        for i in active.tolist():
            hit = sharing.member(sets[i], common)
            if hit.sum() >= max(1, MOSTLY * len(hit)):
                chosen.append(i)
                shared = sets[i][hit]
                blocks.append(shared[np.argsort(arrays.mix(shared))[:MEETINGS]].view(np.int64))
        return pa.table({
            "chunk": table.column("chunk").take(pa.array(chosen, pa.int64())), "doc_id": table.column("doc_id").take(pa.array(chosen, pa.int64())),
            "name": table.column("name").take(pa.array(chosen, pa.int64())), "blocks": pa.array(blocks, pa.list_(pa.int64())),
        })

    return run


_MET = pa.schema([("block", pa.int64()), ("chunk", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("grams", pa.binary())])
_MET_SQL = "block long, chunk long, a long, b long, grams binary"


def _meet(table: pa.Table) -> pa.Table:
    """Links of a block, and some documents of each class with their sets."""
    rows = table.to_pylist()
    out = [tuple(r.values()) for r in rows if r["grams"] is None]
    here = [r for r in rows if r["grams"] is not None]
    if len(here) > 1:
        ids = np.array([r["a"] for r in here], np.int64)
        edges, stay = join_classes(ids, [np.frombuffer(r["grams"], np.uint64) for r in here])
        out += [(here[0]["block"], here[0]["chunk"], a, b, None) for a, b in edges]
        here = [here[i] for i in stay]
    out += [tuple(r.values()) for r in here]
    return pa.table(list(map(list, zip(*out, strict=True))) or [[]] * 5, schema=_MET)


_ROWS = pa.schema([("bucket", pa.int32()), ("gram", pa.int64()), ("doc_id", pa.int64()), ("class", pa.int64()), ("n", pa.int64()), ("counts", pa.binary())])
_ROWS_SQL = "bucket int, gram long, doc_id long, class long, n long, counts binary"


def _crossing_rows(bits: int):
    """For each n-gram that several classes hold, the documents of this chunk in whose first ones it is."""

    def run(table: pa.Table, notes: Notes) -> pa.Table:
        sets, active = _prefix_sets(table), _rows_in_play(table, notes)
        classes, ids = _classes(table, notes), _ids(table)
        common = _marked(sets, active, classes, notes, bits)
        hits = [sets[i][sharing.member(sets[i], common)] for i in active.tolist()]
        row = np.repeat(active, [len(h) for h in hits])
        grams = np.concatenate([np.empty(0, np.uint64), *hits])
        return pa.table([
            pa.array((grams >> np.uint64(64 - bits)).astype(np.int32)), pa.array(grams.view(np.int64)), pa.array(ids[row]), pa.array(classes[row]),
            table.column("n_shingles").take(pa.array(row)), table.column("counts").take(pa.array(row)),
        ], schema=_ROWS)

    return run


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sizes are close enough to link."""
    return (100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b))


def _pairs(table: pa.Table) -> pa.Table:
    """Pairs that meet in one of a bucket's blocks, cross classes and pass the bound; small blocks are looked through, others have trees."""
    order = np.argsort(table.column("gram").to_numpy(), kind="stable")
    gram, ids, classes, sizes = (table.column(c).to_numpy()[order] for c in ("gram", "doc_id", "class", "n"))
    counts = table.column("counts").take(pa.array(order)).to_pylist()
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(gram)), bool), gram[1:] != gram[:-1])))
    times = np.diff(np.concatenate((first, [len(gram)])))
    small = np.repeat(times <= _FANOUT, times)
    found = set()
    for step in range(1, _FANOUT):
        i = np.flatnonzero((gram[step:] == gram[:-step]) & small[step:] & (classes[step:] != classes[:-step]) & _near(sizes[step:], sizes[:-step]))
        for x, y in zip(i.tolist(), (i + step).tolist(), strict=True):
            pair = (int(max(ids[x], ids[y])), int(min(ids[x], ids[y])))
            if pair not in found:
                a, b = np.frombuffer(counts[x], np.uint8), np.frombuffer(counts[y], np.uint8)
                a, b = (_fold(a), b) if len(a) > len(b) else (a, _fold(b)) if len(b) > len(a) else (a, b)
                if _bound(a, b[None, :])[0] >= least_overlap(int(sizes[x]), int(sizes[y])):
                    found.add(pair)
    for start, n in zip(first[times > _FANOUT].tolist(), times[times > _FANOUT].tolist(), strict=True):
        s = slice(start, start + n)
        own, kind, size = ids[s], classes[s], sizes[s]
        if (kind == kind[0]).all():
            continue
        forest = Forest([np.frombuffer(c, np.uint8) for c in counts[s]], size)
        for i in range(n):
            hit = forest.search(i)
            found.update((int(max(own[i], own[j])), int(min(own[i], own[j]))) for j in hit[kind[hit] != kind[i]])
    return pa.table([[a for a, _ in found], [b for _, b in found]], schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def _sets_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, name and set of the documents asked for, and of some others."""
    sent = texts.sparkSession.sparkContext.broadcast(idmap.bit_map(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(idmap.among(batch.column(3).to_numpy(), sent.value)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([s.tobytes() for s in gram_sets(batch.column(2))], pa.binary())], ["doc_id", "name", "grams"]
            )

    return texts.where("doc_id is not null").mapInArrow(run, "doc_id long, name long, grams binary")


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        same = [linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(same, pa.bool_()))


def _noted(rows: DataFrame, values: list[str]) -> DataFrame:
    """Longs as one note of each chunk; rows: chunk and the values."""
    body = F.concat(*[F.lpad(F.hex(v), 16, "0") for v in values])
    return (
        rows.groupBy("chunk")
        .agg(F.unhex(F.array_join(F.collect_list(body), "")).alias("body"))
        .select("chunk", F.lit(OTHER).alias("kind"), F.lit(0).alias("bucket"), "body")
    )


def classes(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id for each row: the smallest doc_id that links of 0.8 Jaccard similarity reach.

    Words are runs of bytes other than ASCII white space, A-Z read as a-z; a set holds the different runs of five
    words, or the whole sequence where there are fewer. A document without words has an empty set and links with nothing.
    Rows with the same doc_id are one node; a row without doc_id has no links and a null component_id. Other columns don't matter; an
    empty table gives an empty table. N-grams are compared by 64-bit names.
    """
    chunks = Chunks(documents, doc_id, text)
    bits = chunks.bits
    copies, copied = chunks.copies()
    texts = chunks.documents.select("doc_id", F.xxhash64("text").alias("name"), "text", idmap.bit("doc_id").alias("bit"))
    wide = _wide(texts, bits, max(WIDE, chunks.n_chunks // WIDE_SHARE))
    table = cut(_firsts_of(texts, wide, bits))
    copies, copied = cut(copies), cut(copied)
    firsts = _Firsts(table, chunks)
    notes = copies.unionByName(firsts.shared(copies, _first_keys))
    meeting = cut(firsts.apply(notes, _meetings(bits), "chunk long, doc_id long, name long, blocks array<long>"))
    met, far = (
        meeting.join(_sets_of(texts, meeting), ["doc_id", "name"])
        .select(F.explode("blocks").alias("block"), "chunk", F.col("doc_id").alias("a"), F.lit(None).cast("long").alias("b"), "grams")
    ), 1
    while far < chunks.n_chunks or far == 1:
        far *= MEET_CHUNKS
        met = met.select("block", F.floor(F.col("chunk") / MEET_CHUNKS).cast("long").alias("chunk"), "a", "b", "grams")
        met = met.groupBy("block", "chunk").applyInArrow(_meet, _MET_SQL)
    links = cut(met.where("grams is null").select("a", "b"))
    places = firsts.documents.where("doc_id is not null").select("doc_id", "chunk").distinct()  # an id may be in several chunks
    placed = components(links).select(F.col("node").alias("doc_id"), "component").join(places, "doc_id")
    known = copies.unionByName(_noted(placed, ["doc_id", "component"]))
    known = known.unionByName(firsts.shared(known, _class_keys))
    rows = firsts.apply(known, _crossing_rows(bits), _ROWS_SQL)
    pairs = cut(rows.groupBy("bucket").applyInArrow(_pairs, "a long, b long").distinct())
    sets = _sets_of(texts, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")))
    verified = (
        pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("grams").alias("x")), "a")
        .join(sets.select(F.col("doc_id").alias("b"), F.col("grams").alias("y")), "b")
        .select("a", "b", "x", "y").mapInArrow(_verify, "a long, b long")
    )
    found = components(links.unionByName(verified).unionByName(copied.select(F.col("doc_id").alias("a"), F.col("first").alias("b"))))
    return table.select("doc_id", "n_shingles").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )
