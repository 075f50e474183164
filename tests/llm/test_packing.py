"""Packing: exact token round trips, gapless sequences, and what crossover must keep."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa

from ward_analytics.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", None, "a  b  c <|endoftext|> x", "  lead  \n\n x  ", "\t", "é　 b", "don't stop 12 345\n\n\nyes  ", "plain words here", "x" * 3000, "tab\tand\x0bmore\x0c\r\n",
    " ", "  a", "日本語 テキスト", "a b c", "<|endoftext|>", "ab\x1c cd",
]


def test_ids_equal_the_tokenizer():
    want = [e.ids for e in packing._tokenizer(PATH).encode_batch([x or "" for x in ODD], add_special_tokens=False)]
    assert [list(x) for x in packing.encode(pa.array(ODD, pa.string()), PATH)] == want


def test_pieces_and_sequences(frame):
    rows = [(i, x) for i, x in enumerate(ODD)] + [(50 + i, f"word{i} " * (20 * i)) for i in range(60)] + [(None, "no id"), (3, "again")]
    found = packing.pack_documents(frame(rows), PATH, capacity=128, with_ids=True).collect()
    for r in found:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert r.piece == 0 or r.length == 128
    ids = {x: e.ids + [0] for (d, x), e in zip(rows, packing._tokenizer(PATH).encode_batch([x or "" for _, x in rows], add_special_tokens=False), strict=True)}
    for d, x in rows:
        if d is not None and d != 3:
            own = sorted((r for r in found if r.doc_id == d), key=lambda r: r.piece)
            assert [i for r in own for i in r.ids] == ids[x]
            assert [r.start for r in own] == list(np.cumsum([0, *(r.length for r in own[:-1])]))
    assert sum(r.length for r in found) == sum(len(packing._tokenizer(PATH).encode(x or "", add_special_tokens=False).ids) + 1 for _, x in rows)
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for members in sequences.values():
        assert [o for o, _ in sorted(members)] == list(np.cumsum([0, *(n for _, n in sorted(members)[:-1])]))
        assert sum(n for _, n in members) <= 128
    assert len(sequences) <= -(-sum(r.length for r in found) // 128) + 2


def test_empty_table(frame):
    assert packing.pack_documents(frame([(1, "x")]).where("doc_id < 0"), PATH).collect() == []


def test_crossover_keeps_every_piece_once_and_no_bin_overflows():
    random = np.random.default_rng(3)
    lengths = random.integers(1, 700, 400)
    population = packing.evolve(lengths, [], 1, generations=0, size=4, capacity=1000)
    for i in range(20):
        child = packing.crossover(lengths, population[i % 4], population[(i + 1) % 4], random, 1000)
        assert len(child) == len(lengths) and (child >= 0).all()
        assert np.bincount(child, lengths).max() <= 1000


def test_breeding_never_gets_worse():
    lengths = np.random.default_rng(5).integers(200, 500, 300)
    start = packing.evolve(lengths, [], 7, generations=0, capacity=1000)
    bred = packing.evolve(lengths, start, 8, generations=30, capacity=1000)
    assert packing._fitness(lengths, bred[0], 1000) >= packing._fitness(lengths, start[0], 1000)


def test_breeding_saves_bins_that_best_fit_leaves():
    """Two islands of two epochs, as a shard has them, of lengths for which best fit takes a bin too many."""
    for seed in (0, 3, 5):
        lengths = np.random.default_rng(seed).integers(20, 60, 3000)
        least = -(-int(lengths.sum()) // 1000)
        founded = packing.evolve(lengths, [], 1, generations=0, capacity=1000)
        assert packing._fitness(lengths, founded[0], 1000)[0] < -least
        islands = [packing.evolve(lengths, [], 1 + i, capacity=1000) for i in range(packing.ISLANDS)]
        bred = [packing.evolve(lengths, [*own, other[0]], 9 + i, capacity=1000) for i, (own, other) in enumerate(zip(islands, islands[::-1], strict=True))]
        assert max(packing._fitness(lengths, p[0], 1000) for p in bred)[0] == -least
