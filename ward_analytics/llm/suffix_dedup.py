"""Repeated byte strings by common-prefix interval trees over a sparse suffix array.

Of every 50-byte window one suffix enters the array: the one whose first 24 bytes have the smallest hash within the
window. Equal windows choose alike, so repeats meet in one bucket, with the bytes left and right of the 24. A bucket sorts its
suffixes, takes the longest common prefixes of neighbours and scans them with a stack into the tree of prefix
intervals. Within an interval the same scan over the left contexts finds where left extensions differ: each
maximal repeat group of 50 bytes or more comes out with all its occurrences. A byte is
removed if a group that covers it has an occurrence in a document with a smaller doc_id.

Equal contexts are one suffix with its smallest doc_id, in a chunk and in a bucket. Suffixes of a text that a great
many documents hold would still have that many different contexts at its ends; there, whole windows meet by their names instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from ward_analytics.llm import arrays, sharing
from ward_analytics.llm.sharing import FIRST, OTHER, Chunks, Notes

WIDTH = 50
SEED = 24
SIDE = WIDTH - SEED
#: Suffixes of which so many chunks hold different contexts meet by whole windows, which chunks reduce to one row each.
WIDE = 4096
#: Names are taken of so many windows at a time: arrays of this size stay in a core's cache.
BLOCK = 1 << 14
_BASE = np.uint64(arrays._BASE)
_RECORD = 2 * SIDE + 2
_WEIGHTS = arrays.powers(_RECORD, 0xC2B2AE3D27D4EB4F)
_NONE = 255

Interval = tuple[int, int, int]


def _power(n: int) -> np.uint64:
    return np.uint64(pow(arrays._BASE, n, 2**64))


def _grams(part: np.ndarray, width: int) -> np.ndarray:
    """A name for each run of ``width`` bytes, by doubling."""
    have, out, size = arrays._BYTE_VALUE[part], None, 1
    done = 0
    left = width
    while left:
        if left & 1:
            if out is None:
                out = have
            else:
                n = len(have) - done
                out = out[: max(n, 0)] * _power(size) + have[done : done + max(n, 0)]
            done += size
        left >>= 1
        if left:
            n = max(len(have) - size, 0)
            have = have[:n] * _power(size) + have[size : size + n]
            size *= 2
    n = max(len(part) - width + 1, 0)
    return arrays.mix(out[:n])


def _pieces(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The bytes of each block of windows, and where they start."""
    return ((x, part[x : x + BLOCK + WIDTH - 1]) for x in range(0, len(part) - WIDTH + 1, BLOCK))


def anchors(part: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes chosen by windows inside one document, in order: start, first window, number of windows, name.

    The windows that choose a suffix follow one another. Chosen are the smallest names; they are mixed once more, so that buckets get
    like numbers of them.
    """
    found = [(np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)]
    for x, piece in _pieces(part):
        a, b = np.searchsorted(offsets, x, side="right") - 1, np.searchsorted(offsets, x + len(piece))
        starts = np.flatnonzero(arrays.inside_one(np.clip(offsets[a : b + 1] - x, 0, len(piece)), WIDTH, len(piece)))
        names = _grams(piece, SEED)
        low = names & np.uint64(0xFFFFFFFF00000000) | np.arange(len(names), dtype=np.uint64)
        reach = 1
        while 2 * reach <= SIDE + 1:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        rest = SIDE + 1 - reach
        if rest:
            low = np.minimum(low[:-rest], low[rest:])
        chosen = (low[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        step = _steps(chosen)
        found.append((x + chosen[step], x + starts[step], np.diff(step, append=len(chosen)), arrays.mix(names[chosen[step]])))
    place, first, count, names = map(np.concatenate, zip(*found, strict=True))
    step = _steps(place)
    return place[step], first[step], np.add.reduceat(count, step) if len(step) else count, names[step]


def _window_grams(part: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Names of the windows at ``starts``, which ascend."""
    found = [np.empty(0, np.uint64)]
    for x, piece in _pieces(part):
        a, b = np.searchsorted(starts, (x, x + BLOCK))
        if a < b:
            found.append(_grams(piece, WIDTH)[starts[a:b] - x])
    return np.concatenate(found)


def _slices(documents: pa.Table, notes: Notes) -> Iterator[tuple]:
    """Rows, bytes, offsets, and the chosen suffixes with their rows of each slice of a chunk; copies and rows without id have none."""
    data, offsets = arrays.text_bytes(documents.column("text"))
    skip = sharing.is_copy(documents, notes) | documents.column("doc_id").combine_chunks().is_null().to_numpy(zero_copy_only=False)
    for a, b in arrays.slices(offsets):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        place, first, count, names = anchors(part, at)
        row = a + np.searchsorted(at, place, side="right") - 1
        keep = ~skip[row]
        yield a, b, part, at, place[keep], first[keep], count[keep], names[keep], row[keep]


def _ids(documents: pa.Table) -> np.ndarray:
    return documents.column("doc_id").to_pandas().fillna(0).to_numpy().astype(np.int64)


def _steps(values: np.ndarray) -> np.ndarray:
    """Where a sequence changes, its first place included."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(values)), bool), values[1:] != values[:-1])))


def _suffixes(documents: pa.Table, notes: Notes) -> tuple[list, np.ndarray, np.ndarray]:
    """Of each slice its chosen suffixes; and the names and owners of all of them."""
    ids, found, keys, owners = _ids(documents), [], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for a, b, part, at, place, first, count, names, row in _slices(documents, notes):
        found.append((a, b, part, at, place, first, count, row))
        keys.append(names)
        owners.append(ids[row])
    return found, np.concatenate(keys), np.concatenate(owners)


def _records(part: np.ndarray, at: np.ndarray, place: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Left context (backwards), right context, and the length of both, of suffixes; row: within the slice."""
    out = np.empty((len(place), _RECORD), np.uint8)
    left, right = np.minimum(place - at[row], SIDE), np.minimum(at[row + 1] - place - SEED, SIDE)
    step = np.arange(SIDE)
    around = np.lib.stride_tricks.sliding_window_view(np.pad(part, SIDE), SIDE)
    out[:, :SIDE] = around[place, ::-1] * (step < left[:, None])
    out[:, SIDE:-2] = around[place + SEED + SIDE] * (step < right[:, None])
    out[:, -2], out[:, -1] = left, right
    return out


class _Entries:
    """A chunk's shared suffixes: each different context once, in order of name."""

    def __init__(self, documents: pa.Table, notes: Notes, bits: int):
        self.slices, names, owners = _suffixes(documents, notes)
        order = np.argsort(names, kind="stable")
        first = _steps(names[order])
        times = np.diff(first, append=len(names))
        common, wide = np.empty(len(names), bool), np.empty(len(names), bool)
        for kind, told in ((sharing.SHARED, common), (sharing.WIDE, wide)):
            told[order] = np.repeat(_told(names[order[first]], notes.bodies(kind), bits), times)
        self.hit, self.wide, records, keys = [], [], [np.empty((0, _RECORD), np.uint8)], [np.empty(0, np.uint64)]
        done = 0
        for a, _, part, at, place, _, _, row in self.slices:
            s = slice(done, done := done + len(place))
            hit = np.flatnonzero(common[s] & ~wide[s])
            self.hit.append(hit)
            self.wide.append(wide[s])
            records.append(_records(part, at, place[hit], row[hit] - a))
            keys.append(names[s][hit])
        self.records, keys = np.concatenate(records), np.concatenate(keys)
        ids = _ids(documents)
        self.owners = np.concatenate([np.empty(0, np.int64), *(ids[s[7][h]] for s, h in zip(self.slices, self.hit, strict=True))])
        full = np.zeros(len(keys), np.uint64)
        for i in range(_RECORD):
            full += arrays._BYTE_VALUE[self.records[:, i]] * _WEIGHTS[i]
        order = np.lexsort((self.owners, full, keys))
        new = np.concatenate((np.ones(min(1, len(keys)), bool), (keys[order][1:] != keys[order][:-1]) | (full[order][1:] != full[order][:-1])))
        self.first = order[new]
        self.number = np.empty(len(keys), np.int64)
        self.number[order] = np.cumsum(new) - 1
        self.keys = keys[self.first]
        self.lowest = self.owners[self.first]


def _told(keys: np.ndarray, bodies: dict[int, bytes], bits: int) -> np.ndarray:
    """Which of a chunk's different keys, in order, the bits in the notes mark."""
    out = np.zeros(len(keys), bool)
    for i, a, b in sharing.buckets(keys, bits):
        if i in bodies:
            out[a:b] = np.unpackbits(np.frombuffer(bodies[i], np.uint8), count=b - a)
    return out


def _window_names(documents: pa.Table, entries: _Entries) -> tuple[list, np.ndarray, np.ndarray]:
    """Windows that chose a suffix which meets by whole windows: places by slice, and all names and owners."""
    ids, places, names, owners = _ids(documents), [], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for (_, _, part, _, _, first, count, row), wide in zip(entries.slices, entries.wide, strict=True):
        times = count[wide]
        own = np.repeat(first[wide] - np.cumsum(times) + times, times) + np.arange(times.sum())
        places.append(own)
        names.append(_window_grams(part, own))
        owners.append(ids[np.repeat(row[wide], times)])
    return places, np.concatenate(names), np.concatenate(owners)


_SENT = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("chunk", pa.int64()), ("body", pa.binary()), ("more", pa.binary())])


def _send(bits: int):
    """A chunk's shared suffixes with their contexts (OTHER), and its windows that meet by their names (FIRST)."""

    def send(documents: pa.Table, notes: Notes) -> pa.Table:
        e, rows = _Entries(documents, notes, bits), []
        chunk = documents.column("chunk")[0].as_py() if documents.num_rows else -1
        for bucket, a, b in sharing.buckets(e.keys, bits):
            body = np.concatenate((e.keys[a:b].view(np.uint8), e.lowest[a:b].view(np.uint8), e.records[e.first[a:b]].ravel())).tobytes()
            rows.append((bucket, OTHER, chunk, zstandard.compress(body, 1), b""))
        keys, lowest, _ = sharing.distinct(*_window_names(documents, e)[1:])
        for bucket, a, b in sharing.buckets(keys, bits):
            rows.append((bucket, FIRST, chunk, keys[a:b].tobytes(), lowest[a:b].tobytes()))
        return pa.table(list(map(list, zip(*rows, strict=True))) or [[]] * 5, schema=_SENT)

    return send


def _common(rows: np.ndarray, other: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows of bytes, at most ``length``."""
    differs = rows != other
    return np.minimum(np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1]), length)


def intervals(prefix: list[int], n: int) -> Iterator[Interval]:
    """The inner nodes of the tree of common prefixes of n sorted suffixes: (length, first, last).

    prefix: the common prefix of each suffix with the one before; that of the first counts for nothing.
    """
    stack = [(0, 0)]
    for i in range(1, n + 1):
        now = prefix[i] if i < n else -1
        first = i - 1
        while stack and stack[-1][0] > now:
            length, first = stack.pop()
            if i - 1 > first:
                yield length, first, i - 1
        if now >= 0 and (not stack or stack[-1][0] < now):
            stack.append((now, first))


def repeat_groups(left: np.ndarray, right: np.ndarray, left_size: np.ndarray, right_size: np.ndarray, least: int = SIDE) -> Iterator[tuple[int, int, np.ndarray]]:
    """Maximal repeats around one seed: (bytes to the left, bytes to the right, members) with at least ``least`` bytes in all.

    left, right: contexts as rows of bytes, the left one read backwards, with their true sizes. Suffixes
    are sorted by right context; in each of their prefix intervals, the left contexts are sorted and scanned in the same way, and
    an interval of those, where left extensions differ or end, is a group.
    """
    n = len(left)
    order = np.lexsort((right_size, *right.T[::-1]))
    right, left, left_size = right[order], left[order], left_size[order]
    sizes = right_size[order]
    prefix = [0, *_common(right[1:], right[:-1], np.minimum(sizes[1:], sizes[:-1])).tolist()]
    rank = np.empty(n, np.int64)
    rank[np.lexsort((left_size, *left.T[::-1]))] = np.arange(n)
    for length, a, b in intervals(prefix, n):
        member = a + np.argsort(rank[a : b + 1])
        rows, size = left[member], left_size[member]
        same = _common(rows[1:], rows[:-1], np.minimum(size[1:], size[:-1]))
        if int(same.max()) + length < least:
            continue
        for back, i, j in intervals([0, *same.tolist()], len(member)):
            if back + length >= least:
                yield back, length, order[member[i : j + 1]]


def _meet(table: pa.Table) -> pa.Table:
    """What a bucket tells the chunks of one kind of what they sent."""
    return sharing._meet_first(table) if table.column("kind")[0].as_py() == FIRST else _meet_suffixes(table)


def _meet_suffixes(table: pa.Table) -> pa.Table:
    """Of each suffix, how far to the left and to the right the groups reach that also hold a smaller doc_id."""
    bodies = [zstandard.decompress(b) for b in table.column("body").to_pylist()]
    counts = [len(b) // (16 + _RECORD) for b in bodies]
    keys = np.concatenate([np.frombuffer(b, np.uint64, n) for b, n in zip(bodies, counts, strict=True)])
    owners = np.concatenate([np.frombuffer(b, np.int64, n, 8 * n) for b, n in zip(bodies, counts, strict=True)])
    records = np.concatenate([np.frombuffer(b, np.uint8, n * _RECORD, 16 * n).reshape(n, _RECORD) for b, n in zip(bodies, counts, strict=True)])
    del bodies
    packed = np.zeros((len(keys), 56), np.uint8)
    packed[:, :_RECORD] = records
    words = packed.view(">u8").astype(np.uint64)
    order = np.lexsort((owners, *words.T[::-1], keys))
    del packed
    key, word = keys[order], words[order]
    new_key = np.concatenate(([True], key[1:] != key[:-1]))
    new = new_key | np.concatenate(([True], (word[1:] != word[:-1]).any(axis=1)))
    first = np.flatnonzero(new)
    kind = np.cumsum(new) - 1
    record, lowest = records[order[first]], owners[order[first]]
    reach = np.full((len(first), 2), _NONE, np.uint8)
    group = np.flatnonzero(new_key[first])
    sizes = np.diff(np.concatenate((group, [len(first)])))
    left, right, left_size, right_size = record[:, :SIDE], record[:, SIDE:-2], record[:, -2].astype(np.int64), record[:, -1].astype(np.int64)
    two = group[sizes == 2]
    if len(two):
        back = _common(left[two], left[two + 1], np.minimum(left_size[two], left_size[two + 1]))
        on = _common(right[two], right[two + 1], np.minimum(right_size[two], right_size[two + 1]))
        meets = back + on >= SIDE
        for mine, other in ((two, two + 1), (two + 1, two)):
            hit = meets & (lowest[mine] > lowest[other])
            reach[mine[hit], 0], reach[mine[hit], 1] = back[hit], on[hit]
    for start, n in zip(group[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        s = slice(start, start + n)
        far = np.full((n, 2), -1)
        own = lowest[s]
        for back, on, member in repeat_groups(left[s], right[s], left_size[s], right_size[s]):
            later = member[own[member] > own[member].min()]
            far[later] = np.maximum(far[later], (back, on))
        reach[s] = np.where(far < 0, _NONE, far)
    later = owners[order] > lowest[kind]
    answer = reach[kind]
    answer[later] = record[kind[later]][:, -2:]
    out = np.empty((len(keys), 2), np.uint8)
    out[order] = answer
    return sharing._notes(table, OTHER, np.array(counts), out, lambda x: x.tobytes(), lambda x: (x != _NONE).any())


def remove_repeats(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", rest: list[str] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes), spans (start and end of each removed run), and ``rest``.

    Removed is each byte covered by a 50-byte string that also starts in a document with a smaller
    doc_id, judged on the input. A null text is empty. Rows with the same doc_id don't remove bytes from one another; rows
    without doc_id neither lose bytes nor take any. Other columns don't matter, an empty table gives an empty table. Cuts
    may split a character. Suffixes and their contexts are told apart by 64-bit names and by bytes.
    """
    chunks = Chunks(documents, doc_id, text, rest)
    bits = chunks.bits
    notes, _ = chunks.copies()
    notes = notes.unionByName(chunks.shared(notes, lambda d, n: _suffixes(d, n)[1:], wide=WIDE))
    sent = chunks.apply(notes, _send(bits), "bucket int, kind int, chunk long, body binary, more binary")
    notes = notes.unionByName(sent.groupBy("bucket", "kind").applyInArrow(_meet, sharing.NOTES))

    def finish(table: pa.Table, found: Notes) -> pa.Table:
        e = _Entries(table, found, bits)
        reach = np.full((len(e.keys), 2), _NONE, np.uint8)
        bodies = found.bodies(OTHER)
        for i, a, b in sharing.buckets(e.keys, bits):
            if i in bodies:
                reach[a:b] = np.frombuffer(bodies[i], np.uint8).reshape(-1, 2)
        answer = reach[e.number]
        again = e.owners > e.lowest[e.number] if len(e.keys) else np.empty(0, bool)
        answer[again] = e.records[again][:, -2:]
        places, own, owner = _window_names(table, e)
        names, lowest = sharing.first_owners(own, owner, found, bits)
        later = lowest[np.searchsorted(names, own)] < owner if len(own) else np.empty(0, bool)
        copy, done, wide_done = sharing.is_copy(table, found), 0, 0
        sizes, removed, n_spans, kept, spans = [], [], [], [], []
        for (a, b, part, at, place, _, _, _), hit, windows in zip(e.slices, e.hit, places, strict=True):
            cover = np.zeros(len(part) + 1, np.int32)
            far = answer[done : done + len(hit)].astype(np.int64)
            done += len(hit)
            there = far[:, 0] != _NONE
            np.add.at(cover, place[hit[there]] - far[there, 0], 1)
            np.add.at(cover, place[hit[there]] + SEED + far[there, 1], -1)
            windows = windows[later[wide_done : (wide_done := wide_done + len(windows))]]
            np.add.at(cover, windows, 1)
            np.add.at(cover, windows + WIDTH, -1)
            gone = np.cumsum(cover[:-1], dtype=np.int32) > 0
            gone |= np.repeat(copy[a:b] & (np.diff(at) >= WIDTH), np.diff(at))
            for x, y in zip(at.tolist(), at[1:].tolist(), strict=False):
                edge = np.flatnonzero(np.diff(np.concatenate(([False], gone[x:y], [False])).astype(np.int8)))
                sizes.append(y - x)
                n_spans.append(len(edge) // 2)
                removed.append(int((edge[1::2] - edge[::2]).sum()))
                spans.append(edge.astype(np.int64).reshape(-1, 2).ravel())
                kept.append(part[x:y][~gone[x:y]].tobytes() if len(edge) else part[x:y].tobytes())
        return pa.table({
            "doc_id": table.column("doc_id"), "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
            "n_spans": pa.array(n_spans, pa.int64()), "kept": pa.array(kept, pa.binary()),
            "spans": pa.array(spans, pa.list_(pa.int64())), "rest": table.column("rest"),
        })

    return chunks.apply_to_all(
        notes, finish, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<long>, rest {chunks.rest_type}"
    )
