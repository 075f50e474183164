"""Benchmark decontamination by spaced-seed hashing.

A mask marks the word positions that count; the others may differ. Words of every benchmark item and of every document
are hashed under each mask at each position; equal hashes propose a document, an item and how they line
up. The line-up is verified word by word: of all its stretches that are alike enough, the one with the most agreements must have enough of them.

Benchmark items are stated queries against all documents. They are sent to the tasks in blocks of a bounded number of words,
a block a pass; documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ward_analytics.llm import arrays

#: Fixed: six counting positions each. Every stretch of at least LEAST_MATCHES agreements and LEAST_SHARE of its words holds one of them: each
#: pattern of up to 27 words was tried (a longer one has a half that is alike enough, too). A seed only proposes: 11011011 survives
#: every third word replaced, which leaves a share of 2/3 and is no leak.
MASKS = ("11011011", "111111", "110101011", "11100111", "111000001011", "11010010011", "10011111")
#: An item with fewer words is too common to leak.
LEAST_WORDS = 8
#: A leak agrees in so many words (in all of them, where the item has fewer), and in so large a share of its stretch.
LEAST_MATCHES = 10
LEAST_SHARE = 0.75
PER, OUT_OF = LEAST_SHARE.as_integer_ratio()
#: Words of benchmark items that are sent to the tasks at a time.
BLOCK_WORDS = 2_000_000
_BITS = 22

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x41:0x5B] = _WORD[0x61:0x7B] = True
_WORD[0x80:] = True


def _seeds(names: np.ndarray, mask: str) -> np.ndarray:
    """A hash for each place where the mask fits."""
    n = len(names) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for factor, at in zip(arrays.powers(len(mask) + 1)[1:], (i for i, c in enumerate(mask) if c == "1"), strict=False):
        out += names[at : at + n] * factor
    return arrays.mix(out)


class Index:
    """Seeds of a block of benchmark items."""

    def __init__(self, item_ids: list, texts: list[str | None]):
        data, offsets = arrays.text_bytes(pc.utf8_lower(pa.array(texts, pa.large_string())))
        starts, ends, self.first = arrays.spans(data, offsets, _WORD)
        self.item_ids = item_ids
        self.names = arrays.names(data, starts, ends)
        of = arrays.owner(self.first)
        long_enough = np.diff(self.first)[of] >= LEAST_WORDS
        self.seeds = []
        for mask in MASKS:
            seed = _seeds(self.names, mask)
            place = np.flatnonzero(arrays.inside_one(self.first, len(mask), len(self.names)) & long_enough[: len(seed)])
            place = place[np.argsort(seed[place], kind="stable")]
            there = np.zeros(2**_BITS, bool)
            there[(seed[place] >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            self.seeds.append((seed[place], place, there))
        self.of = of

    def line_ups(self, names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents, items, and the place of the item's first word among the words, that share a seed; each once."""
        of, found = arrays.owner(first), []
        for mask, (seeds, place, there) in zip(MASKS, self.seeds, strict=True):
            seed = _seeds(names, mask)
            at = np.flatnonzero(there[(seed >> np.uint64(64 - _BITS)).astype(np.int64)])
            at = at[arrays.inside_one(first, len(mask), len(names))[at]]
            low, high = np.searchsorted(seeds, seed[at], "left"), np.searchsorted(seeds, seed[at], "right")
            times = high - low
            hit = place[np.arange(int(times.sum())) + np.repeat(low - (np.cumsum(times) - times), times)]
            at = np.repeat(at, times)
            item = self.of[hit]
            found.append(np.stack((of[at], item, at - (hit - self.first[item]))))
        return tuple(np.unique(np.concatenate(found, axis=1), axis=1))

    def verify(self, names: np.ndarray, begin: int, end: int, item: int, at: int) -> tuple[int, int, int, int] | None:
        """The best stretch of a line-up, if it is a leak: first word in the document and in the item, words, agreements."""
        words = self.names[self.first[item] : self.first[item + 1]]
        low, high = max(begin, at), min(end, at + len(words))
        equal = names[low:high] == words[low - at : high - at]
        # A stretch has a share of PER out of OUT_OF if each agreement, OUT_OF - PER, makes up for the disagreements, PER each.
        height = np.concatenate(([0], np.cumsum(np.where(equal, OUT_OF - PER, -PER))))
        agreed = np.concatenate(([0], np.cumsum(equal)))
        start = np.searchsorted(-np.minimum.accumulate(height), -height)  # the first place no higher: the longest stretch that ends here
        last = int(np.argmax(agreed - agreed[start]))
        start = int(start[last])
        matches = int(agreed[last] - agreed[start])
        if matches < min(LEAST_MATCHES, len(words)):
            return None
        start += int(np.argmax(equal[start:last]))
        n = last - start
        return low - begin + start, low - at + start, n, matches


def _blocks(benchmark: DataFrame, item_id: str) -> Iterator[Index]:
    words = benchmark.agg(F.sum(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+"))).alias("n")).first()["n"] or 0
    n_blocks = max(1, -(-int(words) // BLOCK_WORDS))
    numbered = benchmark.select(F.col(item_id).alias("item_id"), "text").where("text is not null")
    for block in range(n_blocks):
        rows = numbered.where(F.pmod(F.xxhash64("text"), F.lit(n_blocks)) == block).orderBy("item_id", "text").collect()
        yield Index([r["item_id"] for r in rows], [r["text"] for r in rows])


def _leaks(block: Index, texts: pa.Array) -> dict[tuple[int, int], tuple[int, int, int, int]]:
    """The best leak of each row and item."""
    data, offsets = arrays.text_bytes(pc.utf8_lower(texts.cast(pa.large_string())))
    best: dict[tuple[int, int], tuple] = {}
    for a, b in arrays.slices(offsets):
        part = data[offsets[a] : offsets[b]]
        starts, ends, first = arrays.spans(part, offsets[a : b + 1] - offsets[a], _WORD)
        names = arrays.names(part, starts, ends)
        for row, item, at in zip(*(x.tolist() for x in block.line_ups(names, first)), strict=True):
            leak = block.verify(names, int(first[row]), int(first[row + 1]), item, at)
            known = best.get((a + row, item))
            if leak and (known is None or (-leak[3], leak[0]) < (-known[3], known[0])):
                best[a + row, item] = leak
    return best


def find_leaks(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """A row for each document row and benchmark item it holds a stretch of: doc_id, item_id, doc_start, item_start, n_words, n_matches, similarity.

    Words are runs of ASCII letters and digits and non-ASCII bytes, in lower case; starts count words from 0. Of
    several stretches the one with the most agreements is told, the first of those. similarity is agreements by the item's
    words. Null or empty texts leak nothing and an item of fewer than 8 words isn't looked for; rows are documents of their own even if
    ids repeat or are null; other columns don't matter; an empty table on either side gives an empty table.
    """
    spark = documents.sparkSession
    kinds = documents.schema[doc_id].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, doc_start int, item_start int, n_words int, n_matches int, similarity double"
    texts = documents.select(F.col(doc_id).alias("doc_id"), F.col("text").alias("text"))
    item_kind = pa.schema([("i", _arrow(kinds[1]))]).field(0).type
    found = None
    for index in _blocks(benchmark, item_id):
        sent = spark.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block: Index = sent.value
            for batch in batches:
                best = _leaks(block, batch.column(1))
                rows = sorted(best)
                size = np.diff(block.first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([r for r, _ in rows], pa.int64())), pa.array([block.item_ids[i] for _, i in rows], item_kind)]
                    + [pa.array([best[k][j] for k in rows], pa.int32()) for j in range(4)]
                    + [pa.array([best[k][3] / int(size[k[1]]) for k in rows], pa.float64())],
                    ["doc_id", "item_id", "doc_start", "item_start", "n_words", "n_matches", "similarity"],
                )

        leaks = texts.mapInArrow(search, schema)
        found = leaks if found is None else found.unionByName(leaks)
    return found


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}.get(kind, pa.string())


def drop_leaking(documents: DataFrame, benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The rows that hold no leak, each judged by its own text whatever its id: one without an id goes if it leaks, and one that shares its id with a
    leaking row stays. An empty benchmark keeps all rows. What one block of items leaves is searched for the next."""
    spark = documents.sparkSession
    rows = documents.select(F.struct(*documents.columns).alias("row"))
    for index in _blocks(benchmark, item_id):
        sent = spark.sparkContext.broadcast(index)

        def clean(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                stays = np.ones(batch.num_rows, bool)
                stays[[row for row, _ in _leaks(sent.value, pc.struct_field(batch.column(0), text))]] = False
                yield batch.filter(pa.array(stays))

        rows = rows.mapInArrow(clean, rows.schema)
    return rows.select("row.*")
