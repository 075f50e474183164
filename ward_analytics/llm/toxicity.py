"""Toxicity by class-conditional Kneser-Ney models.

Two models of how words are spelled, byte by byte, one of toxic and one of ordinary texts: a byte's chance after the bytes
before it in its word. Each model discounts its counts and backs off to shorter histories, which count how many
different bytes precede; the shortest histories are counted over both classes together, so rare expressions are
smoothed by what both share. A word's gap is the difference of its log-likelihoods. Their mean over a text, and how far on
average gaps exceed some steps, which tells few strong expressions from many weak ones, are weighed by a logistic curve into
a score from 0 to 1. The models are fitted on a bounded sample of labelled rows of either class, the curve on
others; scoring reads every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ward_analytics.llm import arrays
from ward_analytics.llm.tables import fold

#: Labelled rows of either class that the models are fitted on, and rows for the curve: about so many at most.
MODEL_ROWS = 8_000
CURVE_ROWS = 8_000
#: Gaps beyond these count once more.
STEPS = (1.0, 2.0, 3.0, 4.0)
PENALTY = 0.3
#: Bytes of the longest grams, and of the longest that are counted over both classes.
ORDER = 6
SHARED = 1
DISCOUNT = 0.75
SLICE_BYTES = 6 << 20

_EDGE = 0x20
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x41:0x5B] = _WORD[0x61:0x7B] = True
_WORD[0x80:] = True


def _words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, bytes, starts and ends of words, and the text of each word, by slice."""
    data, offsets = arrays.text_bytes(pc.utf8_lower(column.cast(pa.large_string())))
    for a, b in arrays.slices(offsets, SLICE_BYTES):
        part = data[offsets[a] : offsets[b]]
        starts, ends, first = arrays.spans(part, offsets[a : b + 1] - offsets[a], _WORD)
        yield a, b, part, starts, ends, arrays.owner(first)


def _spelled(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words one after another, each between edges: bytes, place of each in its word, and the word of each."""
    size = ends - starts + 2
    last = np.cumsum(size)
    place = np.arange(int(last[-1]) if len(last) else 0) - np.repeat(last - size, size)
    word = np.repeat(np.arange(len(starts)), size)
    source = np.repeat(starts, size) + place - 1
    out = part[np.clip(source, 0, max(len(part) - 1, 0))] if len(word) else np.empty(0, np.uint8)
    out[place == 0] = _EDGE
    out[last - 1] = _EDGE
    return out, place, word


def _grams(spelled: np.ndarray, order: int) -> np.ndarray:
    """The gram of this many bytes that ends at each place, as a number with its length on top."""
    out = np.full(len(spelled), order << 56, np.int64)
    for back in range(order):
        out[back:] += spelled[: len(spelled) - back].astype(np.int64) << (8 * back)
    return out


def _length(grams: np.ndarray) -> np.ndarray:
    return grams >> 56


def _suffix(grams: np.ndarray) -> np.ndarray:
    """Grams without their first byte."""
    shorter = _length(grams) - 1
    return shorter << 56 | grams & ((1 << (8 * shorter)) - 1)


def _history(grams: np.ndarray) -> np.ndarray:
    """Grams without their last byte."""
    shorter = _length(grams) - 1
    return shorter << 56 | (grams & ((1 << 56) - 1)) >> 8


def count_words(column: pa.Array, toxic: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The longest gram at each place, each once in a slice, and how often it occurs in ordinary and in toxic texts."""
    for a, _, part, starts, ends, of in _words(column):
        if not len(starts):
            continue
        number, _ = pd.factorize(arrays.names(part, starts, ends))
        different = np.empty(int(number.max()) + 1, np.int64)
        different[number[::-1]] = np.arange(len(number))[::-1]
        toxics = np.bincount(number, toxic[a + of], minlength=len(different)).astype(np.int64)
        times = np.bincount(number, minlength=len(different)) - toxics
        spelled, place, word = _spelled(part, starts[different], ends[different])
        every = np.concatenate([_grams(spelled, k)[(place == k - 1) if k < ORDER else (place >= k - 1)] for k in range(2, ORDER + 1)])
        words = np.concatenate([word[(place == k - 1) if k < ORDER else (place >= k - 1)] for k in range(2, ORDER + 1)])
        gram, where = np.unique(every, return_inverse=True)
        yield gram, np.bincount(where, times[words]).astype(np.int64), np.bincount(where, toxics[words]).astype(np.int64)


@dataclass
class Model:
    """Known grams with their chances and known histories with what they leave to shorter ones; a column for each class."""

    grams: np.ndarray
    chance: np.ndarray
    histories: np.ndarray
    rest: np.ndarray
    weights: np.ndarray | None = None
    shift: np.ndarray | None = None
    scale: np.ndarray | None = None

    def word_gaps(self, part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each word its toxic less its ordinary log-likelihood."""
        spelled, place, word = _spelled(part, starts, ends)
        gap = np.zeros(len(spelled))
        todo = np.flatnonzero(place > 0)
        order = np.minimum(place[todo] + 1, ORDER)
        for k in range(ORDER, 0, -1):
            now = order >= k
            at = todo[now]
            if not len(at):
                continue
            gram = _grams(spelled, k)[at]
            found = _find(self.grams, gram)
            hit = found >= 0
            gap[at[hit]] += self.chance[found[hit]]
            missed = at[~hit]
            past = _find(self.histories, _history(gram[~hit])) if k > 1 else np.full(len(missed), -1)
            gap[missed[past >= 0]] += self.rest[past[past >= 0]]
            keep = np.ones(len(todo), bool)
            keep[np.flatnonzero(now)[hit]] = False
            todo, order = todo[keep], order[keep]
        return np.bincount(word, gap, minlength=len(starts))

    def differences(self, column: pa.Array) -> np.ndarray:
        """Of each text the mean gap, and the mean of what gaps exceed each step by; 0 for a text without words.

        Means are over one word more than there are, which draws those of very short texts to 0.
        """
        total = np.zeros((len(column), 1 + len(STEPS)))
        n = np.ones((len(column), 1))
        for a, b, part, starts, ends, of in _words(column):
            if not len(starts):
                continue
            number, _ = pd.factorize(arrays.names(part, starts, ends))
            different = np.empty(int(number.max()) + 1, np.int64)
            different[number[::-1]] = np.arange(len(number))[::-1]
            gaps = self.word_gaps(part, starts[different], ends[different])
            for j, values in enumerate((gaps, *(np.maximum(gaps - step, 0) for step in STEPS))):
                total[a:b, j] += np.bincount(of, values[number], minlength=b - a)
            n[a:b, 0] += np.bincount(of, minlength=b - a)
        return total / n

    def score(self, column: pa.Array) -> np.ndarray:
        z = (self.differences(column) - self.shift) / self.scale @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _find(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Place of each value among the known ones, -1 if it isn't there."""
    if not len(known):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, at, -1)


def build(grams: np.ndarray, counts: np.ndarray) -> Model:
    """The model of counts (a row for each gram of ``count_words``, a column for each class)."""
    level = {}
    order = np.argsort(grams)
    grams, counts = grams[order], counts[order].astype(np.float64)
    above = (np.empty(0, np.int64), np.empty((0, 2)))
    for k in range(ORDER, 0, -1):
        own = _length(grams) == k
        names = np.concatenate((grams[own], _suffix(above[0])))
        values = np.concatenate((counts[own], (above[1] > 0).astype(np.float64)))
        known, where = np.unique(names, return_inverse=True)
        total = np.stack([np.bincount(where, values[:, c], minlength=len(known)) for c in (0, 1)], axis=1)
        level[k] = above = (known, total)
    all_grams, all_chance, histories, rests = [], [], [], []
    below, lower = np.empty(0, np.int64), np.empty((0, 2))
    for k in range(1, ORDER + 1):
        known, total = level[k]
        if k <= SHARED:
            total = np.repeat(total.sum(axis=1, keepdims=True), 2, axis=1)
        past, where = np.unique(_history(known), return_inverse=True)
        whole = np.stack([np.bincount(where, total[:, c], minlength=len(past)) for c in (0, 1)], axis=1)
        kinds = np.stack([np.bincount(where, total[:, c] > 0, minlength=len(past)) for c in (0, 1)], axis=1)
        rest = np.where(whole > 0, DISCOUNT * kinds / np.maximum(whole, 1), 1.0)
        short = lower[_find(below, _suffix(known))] if k > 1 else np.full((len(known), 2), 1 / 256)
        chance = np.maximum(total - DISCOUNT, 0) / np.maximum(whole, 1)[where] + rest[where] * short
        all_grams.append(known)
        all_chance.append(chance)
        if k > 1:
            histories.append(past)
            rests.append(rest)
        below, lower = known, chance
    names, chance = np.concatenate(all_grams), np.concatenate(all_chance)
    past, rest = np.concatenate(histories), np.concatenate(rests)
    order = np.argsort(names), np.argsort(past)
    return Model(names[order[0]], np.log(chance[:, 1] / chance[:, 0])[order[0]], past[order[1]], np.log(rest[:, 1] / rest[:, 0])[order[1]])


def _share(labels: DataFrame, most: int) -> DataFrame:
    """All labels, or a share of about ``most`` by the hash of their ids."""
    n = labels.count()
    return labels if n <= most else labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(most / n * (1 << 30)))


def fit(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "toxic") -> Model:
    """The model and its curve, from documents with a label whose fold isn't 0: folds 2 to 4 count, fold 1 sets the curve.

    documents: doc_id and text; labels: doc_id and the label, of several the highest counts. Rows without text or label are left out. If a
    class has no rows the score is the share of toxic labels, or next to 0 without any. The labels of the sample are
    sent to the tasks, so texts aren't shuffled; there are MODEL_ROWS and CURVE_ROWS of them.
    """
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("fold", fold())
    texts = documents.select(F.col(doc_id).alias("doc_id"), "text").where("text is not null")

    def texts_of(labels: DataFrame) -> DataFrame:
        return texts.join(F.broadcast(labels), "doc_id").select("text", "toxic")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = (batch.column(1).to_numpy(zero_copy_only=False) > 0).astype(np.int64)
            for gram, ordinary, toxics in count_words(batch.column(0), toxic):
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(ordinary), pa.array(toxics)], ["gram", "n0", "n1"])

    toxic, ordinary = (_share(known.where(f"fold >= 2 and toxic {sign} 0"), MODEL_ROWS) for sign in (">", "<="))
    counted = texts_of(toxic.unionByName(ordinary))
    found = (
        counted.mapInArrow(count, "gram long, n0 long, n1 long")
        .groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()
    )
    model = build(found["gram"].to_numpy(np.int64), found[["n0", "n1"]].to_numpy(np.float64))
    _set_curve(model, texts_of(_share(known.where("fold = 1"), CURVE_ROWS)))
    return model


def _set_curve(model: Model, rows: DataFrame) -> None:
    sent = rows.sparkSession.sparkContext.broadcast(model)
    names = [f"x{i}" for i in range(1 + len(STEPS))]

    def gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*map(pa.array, sent.value.differences(batch.column(0)).T), batch.column(1)], [*names, "toxic"])

    found = rows.mapInArrow(gaps, ", ".join(f"{x} double" for x in names) + ", toxic int").toPandas().sort_values([*names, "toxic"])
    model.weights, model.shift, model.scale = curve(found[names].to_numpy(np.float64), (found["toxic"].to_numpy() > 0).astype(np.float64))


def curve(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (the last one constant), shift and scale of a penalised logistic regression of labels on differences."""
    weights = np.zeros(x.shape[1] + 1)
    if not len(y) or y.min() == y.max():
        weights[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) and y.any() else -30.0
        return weights, np.zeros(x.shape[1]), np.ones(x.shape[1])
    shift, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 0, scale, 1.0)
    x = np.concatenate(((x - shift) / scale, np.ones((len(x), 1))), axis=1)
    for _ in range(100):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + PENALTY * np.eye(len(weights)), x.T @ (y - p) - PENALTY * weights)
        weights += step
        if np.abs(step).max() < 1e-9:
            break
    return weights, shift, scale


def score(documents: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep``, score (0 to 1, higher: more likely toxic) and predicted (1 from 0.5 on).

    Words are runs of ASCII letters and digits and non-ASCII bytes, in lower case. A null or empty text has no difference and gets the score of that.
    Rows are independent of one another; other columns don't matter.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)
    schema = documents.select(*keep).schema.add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sent.value.score(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(keep))] + [pa.array(found), pa.array((found >= 0.5).astype(np.int32))], schema.names
            )

    return documents.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col("text").alias("text")).mapInArrow(run, schema)
