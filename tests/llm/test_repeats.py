"""Substring dedup by words and by bytes against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

import brute
from ward_analytics.llm import ngram_join, recompression, sharing, suffix_dedup


def corpus(seed, n, alphabet, sizes, glue):
    rng, rows = random.Random(seed), []
    for d in range(n):
        k = rng.choice([1, 2, 3, len(alphabet)])
        units = [rng.choice(alphabet[:k]) for _ in range(rng.choice(sizes))]
        for _ in range(rng.choice([0, 1, 2])):
            source = rng.choice(rows[-30:])[1] if rows else None
            if source:
                have = source.split(glue) if glue else list(source)
                i, at = rng.randrange(len(have)), rng.randrange(len(units) + 1)
                units[at:at] = have[i : i + rng.randrange(2 * max(sizes))]
        rows.append((rng.choice([None, d, d, d, d, max(0, d - 1)]), None if rng.random() < 0.03 else glue.join(units)))
    return rows + rows[5:8] + [(n + 1, rows[20][1]), (n + 2, rows[20][1]), (n + 3, ""), (n + 4, "  \n ")]


def key(row):
    return tuple(-1 if x is None else x for x in row)


def test_words_equal_brute_force(frame):
    rows = corpus(1, 120, [f"w{i}" for i in range(30)], [0, 1, 12, 13, 14, 30], " ")
    got = recompression.remove_repeats(frame(rows)).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    units = [(d, brute.words(x)) for d, x in rows]
    want = [
        (d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
        for (d, w), gone in zip(units, brute.repeats(units, 13), strict=True)
    ]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert sum(w[2] for w in want) > 100


@pytest.mark.parametrize("wide", [0, 1 << 20])
def test_bytes_equal_brute_force(frame, monkeypatch, wide):
    monkeypatch.setattr(suffix_dedup, "WIDE", wide)
    monkeypatch.setattr(sharing, "CHUNK_BYTES", 4000)
    rows = corpus(2, 120, "abcdefghé", [0, 1, 49, 50, 51, 90], "")
    got = suffix_dedup.remove_repeats(frame(rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    units = [(d, (x or "").encode()) for d, x in rows]
    want = []
    for (d, w), gone in zip(units, brute.repeats(units, 50), strict=True):
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        want.append((d, len(w), sum(gone), spans, bytes(x for x, g in zip(w, gone, strict=True) if not g)))
    assert sorted((tuple(map(lambda x: bytes(x) if isinstance(x, bytearray) else x, r)) for r in got), key=key) == sorted(want, key=key)
    assert sum(w[2] for w in want) > 500


def test_rows_of_no_id_or_of_one_id_lie_apart(frame, monkeypatch):
    monkeypatch.setattr(sharing, "CHUNK_BYTES", 1000)
    rows = [(None if i < 200 else 7 if i < 400 else i, " ".join(f"w{i % 190}x{j}" for j in range(15))) for i in range(600)]
    chunks = sharing.Chunks(frame(rows))
    size = "chunk long, doc_id long, n long"

    def count(table, notes):
        n = table.num_rows
        return table.select(["chunk", "doc_id"]).append_column("n", [[n] * n])

    dealt = chunks.apply(chunks.no_notes(), count, size).collect()
    assert len(dealt) == 400 and max(r.n for r in dealt) < 40
    got = recompression.remove_repeats(frame(rows)).select("doc_id", "n_words", "n_removed").collect()
    units = [(d, brute.words(x)) for d, x in rows]
    want = [(d, len(w), sum(gone)) for (d, w), gone in zip(units, brute.repeats(units, 13), strict=True)]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key) and sum(w[2] for w in want) > 100


def test_empty_table(frame):
    none = frame([(1, "x")]).where("doc_id < 0")
    assert recompression.remove_repeats(none).collect() == []
    assert suffix_dedup.remove_repeats(none).collect() == []


def test_spans_are_told(frame):
    passage = "The quick brown fox jumps over the lazy dog and runs away from it. "
    rows = suffix_dedup.remove_repeats(frame([(1, "A" * 30 + passage), (2, "bcd" * 9 + passage + "xyz")])).collect()
    spans = {r.doc_id: list(r.spans) for r in rows}
    assert spans == {1: [], 2: [27, 27 + len(passage)]}


@pytest.mark.parametrize("seed", range(5))
def test_window_symbols_depend_on_the_window_alone(seed):
    rng = np.random.RandomState(seed)
    inner = rng.randint(0, 3, 40).astype(np.uint64)
    seen = []
    for _ in range(4):
        before, after = (rng.randint(0, 3, rng.randint(0, 9)).astype(np.uint64) for _ in range(2))
        words = np.concatenate((before, inner, after))
        starts, _, symbol = recompression.window_symbols(words, np.array([0, len(words)]))
        seen.append(symbol[len(before) : len(before) + 28].tolist())
        assert starts.tolist() == list(range(len(words) - 12))
    assert all(s == seen[0] for s in seen)


def contexts(rows):
    out = np.zeros((len(rows), suffix_dedup.SIDE), np.uint8)
    for i, r in enumerate(rows):
        out[i, : len(r)] = list(r)
    return out, np.array([len(r) for r in rows])


@pytest.mark.parametrize("seed", range(8))
def test_groups_are_the_maximal_repeats(seed):
    rng = random.Random(seed)
    pick = lambda: bytes(rng.choice(b"ab") for _ in range(rng.choice([26, 26, 26, 9, 0])))
    pairs = [(pick(), pick()) for _ in range(12)]
    (left, left_size), (right, right_size) = contexts([a for a, _ in pairs]), contexts([b for _, b in pairs])
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    want = {}
    for i, (a, b) in enumerate(pairs):
        for j, (c, d) in enumerate(pairs[:i]):
            back, on = common(a, c), common(b, d)
            if back + on >= 5:
                want.setdefault((i, j), (back, on))
    got = {}
    for back, on, member in suffix_dedup.repeat_groups(left, right, left_size, right_size, least=5):
        for i in member.tolist():
            for j in member.tolist():
                if j < i:
                    got[i, j] = max(got.get((i, j), (0, 0)), (back, on), key=sum)
    assert got == want


def test_intervals():
    assert sorted(suffix_dedup.intervals([0, 1, 3, 2, 0], 5)) == [(0, 0, 4), (1, 0, 3), (2, 1, 3), (3, 1, 2)]
    assert list(suffix_dedup.intervals([0, 4, 4], 3)) == [(4, 0, 2), (0, 0, 2)] or list(suffix_dedup.intervals([0, 4, 4], 3))[0] == (4, 0, 2)


def thue_morse(k):
    """Two words of 2**k letters whose polynomials are equal modulo 2**64 for every base, from k = 10 on."""
    a, b = "a", "b"
    for _ in range(k):
        a, b = a + b, b + a
    return a, b


def test_words_of_equal_polynomials_are_told_apart(frame):
    for k in (6, 7, 10, 11):
        a, b = thue_morse(k)
        rest = [f"w{i}" for i in range(12)]
        rows = [(1, " ".join([a, *rest])), (2, " ".join([b, *rest])), (3, " ".join([a, *rest]))]
        removed = {r.doc_id: r.n_removed for r in recompression.remove_repeats(frame(rows)).collect()}
        assert removed == {1: 0, 2: 0, 3: 13}
        short = [(1, f"{a} x"), (2, f"{b} x"), (3, f"{a} x")]
        assert {r.doc_id: r.component_id for r in ngram_join.classes(frame(short)).collect()} == {1: 1, 2: 2, 3: 1}


def plain_anchors(docs):
    """Each chosen suffix with its windows, by a look at every window alone."""
    found, done = {}, 0
    for doc in docs:
        names = suffix_dedup._grams(np.frombuffer(doc, np.uint8), suffix_dedup.SEED)
        for i in range(len(doc) - suffix_dedup.WIDTH + 1):
            best = min(range(i, i + suffix_dedup.SIDE + 1), key=lambda j: (int(names[j]) >> 32, j))
            found.setdefault((done + best, doc[best : best + suffix_dedup.SEED]), []).append(done + i)
        done += len(doc)
    return found


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 14])
def test_windows_choose_alike_whatever_the_block(monkeypatch, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    rng = random.Random(8)
    passage = bytes(rng.randrange(97, 100) for _ in range(200))
    docs = [b"", b"a" * 130, passage, b"", b"x" * 49, b"b" * 50, passage[60:160] + b"zz", b"c", passage[:49] + b"\n" + passage, b""]
    part, offsets = np.frombuffer(b"".join(docs), np.uint8), np.cumsum([0, *map(len, docs)])
    place, first, count, names = suffix_dedup.anchors(part, offsets)
    got = [(p, list(range(f, f + n))) for p, f, n in zip(place.tolist(), first.tolist(), count.tolist(), strict=True)]
    want = plain_anchors(docs)
    assert got == sorted((p, windows) for (p, _), windows in want.items())
    assert len(set(names.tolist())) == len({seed for _, seed in want})
    starts = np.sort(np.concatenate([np.arange(f, f + n) for f, n in zip(first, count, strict=True)]))
    assert np.array_equal(suffix_dedup._window_grams(part, starts), suffix_dedup._grams(part, suffix_dedup.WIDTH)[starts])
    assert not any(len(x) for x in suffix_dedup.anchors(part[:20], np.array([0, 20])))


def test_buckets_get_like_numbers_of_suffixes():
    """The chosen names are the smallest of many: by their highest bits nearly all would meet in the first bucket."""
    text = np.random.RandomState(3).randint(97, 123, 200_000).astype(np.uint8).tobytes().decode()
    documents = pa.table({"doc_id": pa.array([1], pa.int64()), "text": [text]})
    _, names, _ = suffix_dedup._suffixes(documents, sharing.Notes(sharing._NOTES.empty_table()))
    sizes = [b - a for _, a, b in sharing.buckets(np.unique(names), 3)]
    assert len(sizes) == 8 and max(sizes) < 1.3 * min(sizes)


def test_texts_are_read_three_times(frame, monkeypatch):
    """Once for what is shared, once for contexts and windows together, once for the rows."""
    calls, apply = [], sharing.Chunks.apply
    monkeypatch.setattr(sharing.Chunks, "apply", lambda *args: calls.append(1) or apply(*args))
    suffix_dedup.remove_repeats(frame([(1, "ab" * 40), (2, "ab" * 40 + "c")])).collect()
    assert len(calls) == 3
