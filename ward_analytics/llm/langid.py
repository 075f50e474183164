"""Language identification by segmentation-marginalised unigrams.

Each language is a probability for each piece of a fixed public vocabulary. A word's likelihood is the
sum over all its segmentations into pieces, found by a forward pass; a text's is the product over its words. The
probabilities are learned by expectation maximisation: a forward and a backward pass give the expected
number of each piece. One pass over the texts counts the words of each language; the rounds run over the different words, until
the likelihood settles. Passes take a block of words of like length at once, so their memory depends on no text.
"""

from __future__ import annotations

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

#: The likelihood has settled when a round raises it by less than this, in nats a byte; no more rounds than these are run.
SETTLED, ROUNDS = 2e-3, 12
#: Texts whose words are looked at together: the more, the fewer words are seen twice, and the more memory a worker takes (some 25 bytes a byte).
SLICE_BYTES = 2 << 20
#: Longer runs of letters are read as several words of at most this many bytes, cut between characters, each with all its segmentations.
WORD_BYTES = 48
#: Words, and languages, whose segmentations are summed at once.
WORDS, LANGUAGES = 16384, 4
#: Share of each language's probability that all pieces have in common.
SMOOTH = 1e-3
#: Nats a letter byte costs outside of all languages: as if each of 30 were equally likely.
BACKGROUND = float(np.log(30))
#: Chances are kept times e to this power for each byte, so that a word of many rare pieces stays above the smallest double.
LIFT = 5.0

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_LETTER[0x80:] = True


@lru_cache(maxsize=2)
def vocabulary(path: str) -> list[bytes]:
    """The pieces in order, as byte strings; one that opens a word begins with a blank. Single bytes are pieces, too, so every word has a
    segmentation."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {bytes([b]) for b in range(256)}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            piece = model.id_to_piece(i).replace("▁", " ").lower().encode()
            if piece.lstrip(b" ") and b" " not in piece[1:]:
                found.add(piece)
    return sorted(found)


class Trie:
    """The prefixes of all pieces as states. Steps are looked up by the exact pair of state and byte, in small open tables: what finds its slot
    taken in one goes to the next."""

    def __init__(self, pieces: list[bytes]):
        prefixes = sorted({p[:i] for p in pieces for i in range(1, len(p) + 1)})
        state = {p: i for i, p in enumerate(prefixes)}
        self.root = np.array([state[bytes([b])] for b in range(256)], np.int32)
        self.piece = np.full(len(prefixes), -1, np.int32)
        self.piece[[state[p] for p in pieces]] = np.arange(len(pieces))
        self.size = np.array([len(p) for p in pieces])
        steps = np.array([(state[p[:-1]] << 8 | p[-1], state[p]) for p in prefixes if len(p) > 1], np.int64).reshape(-1, 2)
        self.bits = max(8, int(4 * len(steps)).bit_length())
        self.tables: list[tuple[int, np.ndarray, np.ndarray]] = []
        while len(steps):
            factor = int(arrays.mix(np.array([len(self.tables) + 1], np.uint64))[0]) | 1
            slot = self._slot(steps[:, 0], factor)
            _, taken = np.unique(slot, return_index=True)
            known, to = np.full(2**self.bits, -1, np.int64), np.full(2**self.bits, -1, np.int32)
            known[slot[taken]], to[slot[taken]] = steps[taken, 0], steps[taken, 1]
            self.tables.append((factor, known, to))
            steps = np.delete(steps, taken, axis=0)

    def _slot(self, key: np.ndarray, factor: int) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(factor)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The next state of each, -1 where no piece goes on."""
        key = state.astype(np.int64) << 8 | byte
        out = np.full(len(key), -1, np.int32)
        for factor, known, to in self.tables:
            slot = self._slot(key, factor)
            out = np.where(known[slot] == key, to[slot], out)
        return out


@lru_cache(maxsize=2)
def trie(path: str) -> Trie:
    return Trie(vocabulary(path))


class Lattice:
    """All segmentations of a block of words."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, opens: np.ndarray, path: str):
        """opens: whether a blank goes before, as before the first part of each word."""
        pieces = trie(path)
        opens = opens.astype(np.int64)
        size = ends - starts + opens
        self.order = np.argsort(-size, kind="stable")
        self.size, begins = size[self.order], (starts - opens)[self.order]
        self.n, self.width = len(size), int(size.max(initial=0))
        text = np.full((self.n, self.width), 0x20, np.uint8)
        for i in range(self.width):
            there = np.arange(self._longer(i))
            if i == 0:
                there = np.flatnonzero(opens[self.order] == 0)
            text[there, i] = data[begins[there] + i]
        #: From each position: the end, the words, by number from the longest, and the pieces.
        self.edges: list[list[tuple[int, np.ndarray, np.ndarray]]] = []
        for begin in range(self.width):
            words = np.arange(self._longer(begin))
            state, end, found = pieces.root[text[words, begin]], begin + 1, []
            while len(words):
                piece = pieces.piece[state]
                hit = np.flatnonzero(piece >= 0)
                if len(hit):
                    found.append((end, words[hit], piece[hit]))
                more = int(np.searchsorted(words, self._longer(end)))
                words, state = words[:more], state[:more]
                if not len(words):
                    break
                state = pieces.step(state, text[words, end])
                alive = np.flatnonzero(state >= 0)
                words, state, end = words[alive], state[alive], end + 1
            self.edges.append(found)

    def _longer(self, size: int) -> int:
        """How many words have more bytes than this."""
        return int(np.searchsorted(-self.size, -size, side="left"))

    def log_likelihood(self, chance: np.ndarray) -> np.ndarray:
        """Of each word in each language; chance as ``lifted``."""
        out = np.empty((self.n, chance.shape[1]))
        for k in range(0, chance.shape[1], LANGUAGES):
            some = np.ascontiguousarray(chance[:, k : k + LANGUAGES])
            alpha = np.zeros((self.width + 1, self.n, some.shape[1]))
            alpha[0] = 1
            for begin, found in enumerate(self.edges):
                for end, words, pieces in found:
                    alpha[end, words] += alpha[begin, words] * some[pieces]
            total = alpha[self.size, np.arange(self.n)]
            out[self.order, k : k + LANGUAGES] = np.log(np.maximum(total, 1e-300)) - LIFT * self.size[:, None]
        return out

    def expected(self, chance: np.ndarray, language: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Places (piece times languages plus language) and expected numbers of pieces, and the log-likelihood, given the language of each word and how often
        it occurs there; chance as ``lifted``."""
        language, weight = language[self.order], weight[self.order]
        n_languages, chance = chance.shape[1], chance.ravel()
        at = [[(end, words, pieces.astype(np.int64) * n_languages + language[words]) for end, words, pieces in found] for found in self.edges]
        alpha = np.zeros((self.width + 1, self.n))
        alpha[0] = 1
        for begin, found in enumerate(at):
            for end, words, places in found:
                alpha[end, words] += alpha[begin, words] * chance[places]
        total = np.maximum(alpha[self.size, np.arange(self.n)], 1e-300)
        beta = np.zeros_like(alpha)
        beta[self.size, np.arange(self.n)] = weight / total
        all_places, times = [np.empty(0, np.int64)], [np.empty(0)]
        for begin in range(self.width - 1, -1, -1):
            for end, words, places in at[begin]:
                after = beta[end, words] * chance[places]
                beta[begin, words] += after
                all_places.append(places)
                times.append(alpha[begin, words] * after)
        return np.concatenate(all_places), np.concatenate(times), float((weight * (np.log(total) - LIFT * self.size)).sum())


def lifted(chance: np.ndarray, path: str) -> np.ndarray:
    return chance * np.exp(LIFT * trie(path).size)[:, None]


def _blocks(size: np.ndarray) -> Iterator[np.ndarray]:
    """Words by length, WORDS at a time."""
    order = np.argsort(size, kind="stable")
    for i in range(0, len(order), WORDS):
        yield order[i : i + WORDS]


def letter_words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each slice of texts: its rows, the lower-case bytes, starts, ends and text of its words of letters, and whether each opens a run of letters."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    for a, b in arrays.slices(np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), SLICE_BYTES):
        part, at = arrays.text_bytes(pc.utf8_lower(column.slice(a, b - a).cast(pa.large_string())))
        starts, ends, first = arrays.spans(part, at, _LETTER)
        of, opens = arrays.owner(first), np.ones(len(starts), bool)
        if len(starts) and int((ends - starts).max()) > WORD_BYTES:
            step = WORD_BYTES - 3
            cuts = -(-(ends - starts) // step)
            number = np.arange(int(cuts.sum())) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            last, runs_end = number == np.repeat(cuts, cuts) - 1, np.repeat(ends, cuts)
            starts = np.repeat(starts, cuts) + number * step
            for _ in range(3):  # back to the start of a character, which is at most three bytes away
                starts -= (number > 0) & (part[starts] & 0xC0 == 0x80)
            ends = np.where(last, runs_end, np.append(starts[1:], 0))
            of, opens = np.repeat(of, cuts), number == 0
        yield a, b, part, starts, ends, of, opens


def _distinct(part: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word its number among the different ones (of its kind), and where each of those occurs first."""
    number, _ = pd.factorize(arrays.names(part, starts, ends) + kind.astype(np.uint64))
    first = np.empty(int(number.max(initial=-1)) + 1, np.int64)
    first[number[::-1]] = np.arange(len(number))[::-1]
    return number, first


def count_words(labelled: DataFrame, languages: list[str]) -> DataFrame:
    """word, opens, language (its place in ``languages``) and times, over all rows of (text, lang)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = np.searchsorted(languages, batch.column("lang").to_pylist())
            for a, _, part, starts, ends, of, opens in letter_words(batch.column("text")):
                if not len(starts):
                    continue
                number, first = _distinct(part, starts, ends, 2 * lang[a + of] + opens)
                times = np.bincount(number)
                for i in range(0, len(first), 4 * WORDS):
                    some = first[i : i + 4 * WORDS]
                    text = [part[x:y].tobytes() for x, y in zip(starts[some], ends[some], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(text, pa.binary()).cast(pa.string()), pa.array(opens[some]), pa.array(lang[a + of[some]], pa.int32()), pa.array(times[i : i + 4 * WORDS], pa.int64())],
                        ["word", "opens", "language", "times"],
                    )

    found = labelled.mapInArrow(count, "word string, opens boolean, language int, times long")
    return found.groupBy("word", "opens", "language").agg(F.sum("times").alias("times"))


def learn(labelled: DataFrame, path: str, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages and the chance of each piece in each, from all rows of (text, lang) with both.

    What reaches the driver is a number for each language and piece of the fixed vocabulary, and the names of the languages.
    """
    labelled = labelled.select("text", "lang").where("text is not null and lang is not null")
    languages = sorted(r[0] for r in labelled.select("lang").distinct().collect())
    n_pieces = len(vocabulary(path))
    chance = np.full((n_pieces, max(len(languages), 1)), 1.0 / n_pieces)
    if not languages:
        return languages, chance
    words = cut(count_words(labelled, languages))
    spark, before = labelled.sparkSession, None
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(lifted(chance, path))

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found, gain, size = np.zeros(sent.value.size), 0.0, 0
            for batch in batches:
                data, offsets = arrays.text_bytes(batch.column("word"))
                opens = batch.column("opens").to_numpy(zero_copy_only=False)
                language, times = arrays.ints(batch.column("language")), arrays.ints(batch.column("times")).astype(float)
                size += int((np.diff(offsets) * times).sum())
                for some in _blocks(np.diff(offsets)):
                    lattice = Lattice(data, offsets[some], offsets[some + 1], opens[some], path)
                    places, expected, likelihood = lattice.expected(sent.value, language[some], times[some])
                    np.add.at(found, places, expected)
                    gain += likelihood
            there = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(there, [-1, -2]), pa.int64()), pa.array(np.append(found[there], [gain, size]))], ["place", "times"]
            )

        rows = words.mapInArrow(expect, "place long, times double").groupBy("place").agg(F.sum("times").alias("times")).toPandas()
        summed = dict(zip(rows["place"], rows["times"], strict=True))
        likelihood = summed.pop(-1, 0.0) / max(summed.pop(-2, 0.0), 1)
        times = np.zeros(chance.size)
        times[list(summed)] = list(summed.values())
        times = times.reshape(chance.shape)
        chance = times / np.maximum(times.sum(axis=0), 1e-9)
        chance = (1 - SMOOTH) * chance + SMOOTH * (chance.mean(axis=1, keepdims=True) / 2 + 0.5 / n_pieces)
        if before is not None and likelihood - before < SETTLED:
            break
        before = likelihood
    return languages, chance


def identify(documents: DataFrame, languages: list[str], chance: np.ndarray, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` and, for each row, lang_pred, score (0 to 1) and nats_a_letter.

    The score is the chance of the best language against the others and against no language at all, where
    every letter byte costs the same. A null text or one without a letter is ``und`` with score 0; so is
    every text if no language has been learned. A letter is what Unicode calls one; words are runs of ASCII letters
    and non-ASCII bytes in lower case. Ties go to the language that comes first by name. Rows are
    independent: repeated rows get equal results, extra columns don't matter, an empty table gives an empty table.
    ``text`` names the column to read; ``a.b`` is the field b of the kept column a, which isn't sent twice.
    """
    spark = documents.sparkSession
    sent = spark.sparkContext.broadcast(lifted(chance, path))
    schema = documents.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("nats_a_letter", "double")
    outer, _, field = text.partition(".")
    inside = keep.index(outer) if field else -1

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.struct_field(batch.column(inside), field) if field else batch.column(batch.num_columns - 1)
            n = batch.num_rows
            total, letters = np.zeros((n, sent.value.shape[1])), np.zeros(n)
            for a, b, part, starts, ends, of, opens in letter_words(texts):
                if not len(starts) or not languages:
                    continue
                number, first = _distinct(part, starts, ends, opens)
                word = np.empty((len(first), total.shape[1]))
                for some in _blocks((ends - starts)[first]):
                    at = first[some]
                    word[some] = Lattice(part, starts[at], ends[at], opens[at], path).log_likelihood(sent.value)
                for k in range(total.shape[1]):
                    total[a:b, k] += np.bincount(of, word[number, k], minlength=b - a)
                letters[a:b] += np.bincount(of, ends - starts, minlength=b - a)
            real = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            real = real & bool(languages) & (letters > 0)
            best = total.argmax(axis=1)
            top = total[np.arange(n), best]
            rest = np.exp(np.clip(total - top[:, None], -700, 0)).sum(axis=1) + np.exp(np.clip(-BACKGROUND * letters - top, -700, 700))
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(keep))]
                + [
                    pa.array([languages[i] if r else "und" for i, r in zip(best, real, strict=True)], pa.string()),
                    pa.array(np.where(real, 1 / rest, 0.0)),
                    pa.array(np.where(real, -top / np.maximum(letters, 1), 0.0)),
                ],
                schema.names,
            )

    sent_columns = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)] + ([] if field else [F.col(text).alias("text")])
    return documents.select(*sent_columns).mapInArrow(score, schema)
