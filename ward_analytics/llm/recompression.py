"""Substring dedup by recompression.

Rounds name runs of equal symbols and then pairs of neighbours: a random bit of its name makes each symbol a left or a right
one, and a left one followed by a right one becomes one symbol. A name is a hash of the names it is made of, so
all documents agree on names without exchanging them. Symbols inside equal word sequences are equal, apart from
those near the ends; how far a symbol looked to be sure of its borders is carried along with it. Each window of words is
represented by the highest symbol inside it that depends on nothing outside, named together with the words it looked at. Symbols that several
documents hold reveal the windows that may repeat; the windows' own names verify them, and the smallest document that
holds each decides what is removed. A window without a sure symbol (long runs) is its own symbol.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ward_analytics.llm import arrays, sharing
from ward_analytics.llm.sharing import Chunks, Notes

WIDTH = 13
ROUNDS = 3
_FAR = 1 << 40


def _same(of: np.ndarray) -> np.ndarray:
    """Whether each symbol and the next are of one document."""
    return of[1:] == of[:-1]


def _runs(symbols: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Each maximal run of equal symbols as one; to know where it ends both neighbours must be seen."""
    name, of, start, end, low, high = symbols
    first = np.flatnonzero(np.concatenate(([True], (name[1:] != name[:-1]) | ~_same(of))))
    last = np.concatenate((first[1:], [len(name)])) - 1
    times = (last - first + 1).astype(np.uint64)
    renamed = np.where(times > 1, arrays.mix(name[first] + times * np.uint64(0xA24BAED4963EE407)), name[first])
    n = len(first)
    near, far = np.full(n, -_FAR), np.full(n, _FAR)
    joined = _same(of[first])
    near[1:][joined] = low[first[1:] - 1][joined]
    far[:-1][joined] = high[first[1:]][joined]
    return renamed, of[first], start[first], end[last], np.minimum(low[first], near), np.maximum(high[last], far)


def _pairs(symbols: tuple[np.ndarray, ...], salt: int) -> tuple[np.ndarray, ...]:
    """Each left symbol followed by a right one as one. One that stays alone must have seen the neighbour on its open side."""
    name, of, start, end, low, high = symbols
    right = (arrays.mix(name + np.uint64(salt)) >> np.uint64(63)).astype(bool)
    joined = _same(of)
    opens = np.zeros(len(name), bool)
    opens[:-1] = ~right[:-1] & right[1:] & joined
    closes = np.zeros(len(name), bool)
    closes[1:] = opens[:-1]
    after, before = np.append(joined, False), np.concatenate(([False], joined))
    i = np.arange(len(name))
    other = np.where(right, i - 1, i + 1)
    there = np.where(right, before, after)
    other = np.where(there, other, i)
    low, high = (
        np.where(there, np.minimum(low, low[other]), np.where(right, -_FAR, low)),
        np.where(there, np.maximum(high, high[other]), np.where(right, high, _FAR)),
    )
    renamed = name.copy()
    at = np.flatnonzero(opens)
    renamed[at] = arrays.mix(name[at] * np.uint64(0x9FB21C651E98DF25) + arrays.mix(name[at + 1]))
    end = end.copy()
    end[at] = end[at + 1]
    low[at], high[at] = np.minimum(symbols[4][at], symbols[4][at + 1]), np.maximum(symbols[5][at], symbols[5][at + 1])
    kept = ~closes
    return renamed[kept], of[kept], start[kept], end[kept], low[kept], high[kept]


def window_symbols(names: np.ndarray, first: np.ndarray, width: int = WIDTH, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window inside one document: its first word, its own name, and the symbol that represents it."""
    n = len(names)
    starts = np.flatnonzero(arrays.inside_one(first, width, n))
    if not len(starts):
        return starts, np.empty(0, np.uint64), np.empty(0, np.uint64)
    own = arrays.windows(names, width)
    i = np.arange(n)
    none = np.uint64(2**64 - 1)
    best = np.full(n, none)
    factor = arrays.powers(n + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(names * factor[:n])))
    back = arrays.powers(n + 1, pow(arrays._BASE, -1, 2**64))
    symbols = _runs((names, arrays.owner(first), i, i + 1, i, i + 1))
    for level in range(1, rounds + 1):
        symbols = _runs(_pairs(symbols, level)) if level > 1 else _pairs(symbols, level)
        name, _, _, _, low, high = symbols
        sure = np.flatnonzero(high - low <= width)
        low, high = low[sure], high[sure]
        seen = arrays.mix((sums[high] - sums[low]) * back[low] ^ name[sure])
        rank = seen >> np.uint64(3) | np.uint64(7 - level) << np.uint64(61)
        for step in range(width):
            at = low - step
            there = np.flatnonzero((at >= high - width) & (at >= 0))
            if not len(there):
                break
            np.minimum.at(best, at[there], rank[there])
    best = best[starts]
    own = own[starts]
    return starts, own, np.where(best == none, own, arrays.mix(best))


def _worked(documents: pa.Table, notes: Notes) -> Iterator[tuple]:
    """Slices of a chunk: rows, bytes, words, their names and the documents' first words. Copies and rows without id have no names."""
    data, offsets = arrays.text_bytes(documents.column("text"))
    left_out = sharing.is_copy(documents, notes) | documents.column("doc_id").combine_chunks().is_null().to_numpy(zero_copy_only=False)
    for a, b in arrays.slices(offsets):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, first = arrays.spans(part, at)
        yield a, b, part, starts, ends, first, left_out[a:b]


def _windows(documents: pa.Table, notes: Notes) -> Iterator[tuple[tuple, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    ids = documents.column("doc_id").to_pandas().fillna(0).to_numpy().astype(np.int64)
    for piece in _worked(documents, notes):
        a, _, part, starts, ends, first, left_out = piece
        at, own, symbol = window_symbols(arrays.names(part, starts, ends), first)
        of = arrays.owner(first)[at]
        in_play = ~left_out[of]
        yield piece, at[in_play], own[in_play], symbol[in_play], ids[a + of[in_play]]


def _joined(parts: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, kind)


def _symbol_keys(documents: pa.Table, notes: Notes) -> tuple[np.ndarray, np.ndarray]:
    keys, owners = [], []
    for _, _, _, symbol, owner in _windows(documents, notes):
        new = np.concatenate((np.ones(min(1, len(symbol)), bool), (symbol[1:] != symbol[:-1]) | (owner[1:] != owner[:-1])))
        keys.append(symbol[new])
        owners.append(owner[new])
    return _joined(keys, np.uint64), _joined(owners, np.int64)


def _candidates(documents: pa.Table, notes: Notes, bits: int) -> tuple[list, np.ndarray, np.ndarray]:
    """The windows whose symbols are shared: by slice, and all their names and owners."""
    found = list(_windows(documents, notes))
    common = sharing.shared_keys(_joined([f[3] for f in found], np.uint64), _joined([f[4] for f in found], np.int64), notes, bits)
    out = []
    for piece, at, own, symbol, owner in found:
        hit = sharing.member(symbol, common)
        out.append((piece, at[hit], own[hit], owner[hit]))
    return out, _joined([o[2] for o in out], np.uint64), _joined([o[3] for o in out], np.int64)


def kept_words(part: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, kept: np.ndarray) -> list[bytes]:
    """Of each document its kept words, joined by one space."""
    size = np.where(kept, ends - starts + 1, 0)
    place = np.concatenate(([0], np.cumsum(size)))
    n = int(place[-1])
    source = np.arange(n) + np.repeat(starts - place[:-1], size)
    out = part[np.minimum(source, max(len(part) - 1, 0))] if n else np.empty(0, np.uint8)
    out[place[1:][kept] - 1] = 0x20
    out, edge = out.tobytes(), place[first].tolist()
    return [out[a : max(a, b - 1)] for a, b in zip(edge, edge[1:], strict=False)]


def remove_repeats(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", rest: list[str] | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (the kept words joined by one space), and the columns ``rest`` as a struct of that name.

    Removed are the words covered by 13 consecutive words that also start in a document with a smaller
    doc_id, judged on the input. Words are runs of bytes other than ASCII white space. A null or empty text has no
    words. Rows with the same doc_id don't remove words from one another; rows without doc_id neither lose words nor
    take any. Columns that aren't named don't matter. Windows are compared by 64-bit names.
    """
    chunks = Chunks(documents, doc_id, text, rest)
    bits = chunks.bits
    copies, _ = chunks.copies()
    notes = copies.unionByName(chunks.shared(copies, _symbol_keys))
    notes = notes.unionByName(chunks.first_owner(notes, lambda d, n: _candidates(d, n, bits)[1:]))

    def finish(table: pa.Table, found: Notes) -> pa.Table:
        slices, own, owner = _candidates(table, found, bits)
        keys, lowest = sharing.first_owners(own, owner, found, bits)
        n_words, n_removed, texts = [], [], []
        copy = sharing.is_copy(table, found)
        for (a, b, part, starts, ends, first, _), at, name, holder in slices:
            count = np.diff(first)
            cover = np.zeros(len(starts) + 1, np.int64)
            if len(at):
                at = at[lowest[np.searchsorted(keys, name)] < holder]
                np.add.at(cover, at, 1)
                np.add.at(cover, at + WIDTH, -1)
            gone = np.cumsum(cover[:-1]) > 0
            gone |= np.repeat(copy[a:b] & (count >= WIDTH), count)
            n_words.append(count)
            n_removed.append(np.add.reduceat(np.append(gone, False).astype(np.int64), first[:-1]) * (count > 0))
            texts += kept_words(part, starts, ends, first, ~gone)
        return pa.table({
            "doc_id": table.column("doc_id"), "n_words": _joined(n_words, np.int64).astype(np.int64), "n_removed": _joined(n_removed, np.int64).astype(np.int64),
            "kept_text": pa.array(texts, pa.binary()).cast(pa.string()), "rest": table.column("rest"),
        })

    return chunks.apply_to_all(notes, finish, f"doc_id long, n_words long, n_removed long, kept_text string, rest {chunks.rest_type}")
