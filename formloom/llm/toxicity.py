r"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the 4- and 5-grams of the bytes of the lower-cased text, each under its exact key.
The value of a feature is its share of the text's n-grams times the log-count ratio r, rows scaled
to length one. Training, on a bounded sample of the labelled rows (``sample`` rows, those of least
hash):

1. executors sum the shares of each n-gram over the toxic and over the other documents,
2. n-grams in fewer than ``LEAST`` documents say nothing about others and are left out; every other
   one is a feature, with r = the log of the ratio of its smoothed sums in the two classes,
3. one task, as the sample is bounded, fits a logistic regression on the scaled shares (AdaGrad, in
   a fixed order of the rows) and returns the weights; the regularised fit weighs the features.

The model's size is that of the sample's vocabulary, not of the corpus; it is broadcast. Scoring is a
narrow map over whole texts of any length. Only texts and labels are read for the model; doc_id only
deals rows to the held-out part (crc32 of its decimal text modulo 5 is 0), which is never learnt from.

Defined results: null and empty texts have no n-gram and score the intercept; without labels of
both classes every text scores the rate of toxic labels (0 without any label); rows with a null
label or id are not learnt from; repeated rows count as they come, as do ids with several labels; of
rows with equal hashes those of the smaller id come first; empty tables give an empty one; further
columns are ignored by ``toxicity`` and carried by ``drop_toxic``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordspans as ws
from .columns import carrying
from .tables import written

SIZES = (4, 5)
SAMPLE = 8_000
LEAST = 5
FOLDS = 5
#: A key has the bytes of an n-gram, its size above them, and in so many bits below them the row of the slab.
ROW_BITS = 22
_TABLE_BITS = 20
#: Bytes of text in work at a time; what is made of them is some fifty times as large.
SLAB = 1 << 18
_BATCH, _EPOCHS, _STEPS = 64, 12, 600


def shares(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, row in the slab, n-gram, its share of the text's n-grams), by n-gram and row."""
    for at in range(0, len(text), 1 << ROW_BITS):
        for a, b, data, offsets in ws.slabs(text.slice(at, 1 << ROW_BITS), SLAB):
            data, size = ws.LOWER[data], np.diff(offsets)
            row = np.repeat(np.arange(b - a, dtype=np.uint64), size)
            packed, found = data.astype(np.uint64), []
            for n in range(2, max(SIZES) + 1):
                packed = packed[:-1] << np.uint64(8) | data[n - 1 :] if len(packed) > 1 else packed[:0]
                if n in SIZES:
                    inside = row[: len(packed)] == row[n - 1 :] if len(packed) else np.zeros(0, bool)
                    found.append(((packed | np.uint64((n - min(SIZES)) << 40)) << np.uint64(ROW_BITS) | row[: len(packed)])[inside])
            every = np.sort(np.concatenate(found))
            start = _starts(every)
            count = np.diff(np.append(start, len(every)))
            own = (every[start] & np.uint64((1 << ROW_BITS) - 1)).astype(np.int64)
            total = sum(np.maximum(size - n + 1, 0) for n in SIZES)
            yield at + a, at + b, own, (every[start] >> np.uint64(ROW_BITS)).astype(np.int64), count / total[own]


def _starts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


@dataclass
class Model:
    bias: float
    keys: np.ndarray  # n-grams, in order
    ratio: np.ndarray  # log-count ratio of each
    weight: np.ndarray  # fitted weight of each
    _table: tuple[np.ndarray, np.ndarray] | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_table": None}

    def places(self, key: np.ndarray) -> np.ndarray:
        """Place among the keys of each n-gram, -1 for those that aren't features; by a hash table with the keys compared."""
        if self._table is None:
            slot = self._slot(self.keys)
            order = np.argsort(slot, kind="stable")
            self._table = np.searchsorted(slot[order], np.arange((1 << _TABLE_BITS) + 1)).astype(np.int32), order.astype(np.int32)
        first, order = self._table
        slot, out = self._slot(key), np.full(len(key), -1, dtype=np.int32)
        at, end = first[slot], first[slot + 1]
        todo = np.flatnonzero(at < end)
        while len(todo):
            place = order[at[todo]]
            good = self.keys[place] == key[todo]
            out[todo[good]] = place[good]
            at[todo] += 1
            todo = todo[~good]
            todo = todo[at[todo] < end[todo]]
        return out

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    def rows(self, text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first row, end row, row in the slab, feature, scaled value), by feature's n-gram."""
        for a, b, row, key, share in shares(text):
            start = _starts(key)
            place = np.repeat(self.places(key[start]), np.diff(np.append(start, len(key))))
            good = place >= 0
            row, place = row[good], place[good]
            value = share[good] * self.ratio[place]
            length = np.sqrt(np.bincount(row, weights=value * value, minlength=b - a)) + 1e-12
            yield a, b, row, place, value / length[row]

    def scores(self, text: pa.Array) -> np.ndarray:
        out = np.full(len(text), self.bias)
        for a, b, row, place, value in self.rows(text):
            out[a:b] += np.bincount(row, weights=value * self.weight[place], minlength=b - a)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit(blocks: list[tuple[np.ndarray, ...]], k: int, rate: float = 0.3, l2: float = 1e-6) -> tuple[float, np.ndarray]:
    """Logistic regression by AdaGrad; blocks of rows: (labels, where each row's features begin and the end, features, values)."""
    w, g2 = np.zeros(k), np.full(k, 1e-8)
    mean = np.concatenate([y for y, *_ in blocks]).mean()
    bias, b2 = float(np.log((mean + 1e-6) / (1 - mean + 1e-6))), 1e-8
    order = np.random.default_rng(5)
    for _ in range(max(_EPOCHS, -(-_STEPS // len(blocks)))):
        for i in order.permutation(len(blocks)):
            y, first, place, value = blocks[i]
            row = np.repeat(np.arange(len(y)), np.diff(first))
            x = value.astype(np.float64)
            p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(row, weights=x * w[place], minlength=len(y)), -30, 30)))
            error = (p - y) / len(y)
            g = np.bincount(place, weights=x * error[row], minlength=k)
            g += l2 * w
            g2 += g * g
            w -= rate * g / np.sqrt(g2)
            b2 += error.sum() ** 2
            bias -= rate * error.sum() / np.sqrt(b2)
    return float(bias), w


def ratios(toxic: np.ndarray, other: np.ndarray, documents: np.ndarray) -> np.ndarray:
    """Log of the ratio of the n-grams' smoothed sums of shares in the two classes; one mean share is added to each."""
    add = (toxic.sum() + other.sum()) / max(1.0, documents.sum())
    p, q = toxic + add, other + add
    return np.log(p / p.sum()) - np.log(q / q.sum())


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from labelled rows outside the held-out part."""
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_toxic")).where("_id is not null and _toxic is not null").where(_fold("_id") != 0)
    chosen = known.orderBy(F.xxhash64("_id"), "_id", "_toxic").limit(sample)
    # At most `sample` pairs of numbers: a bounded broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    rows = written(rows.select("text", (F.col("_toxic") > 0).alias("toxic"), F.xxhash64("_id").alias("turn")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
            for a, b, row, key, share in shares(batch.column("text")):
                marked, start = toxic[a:b][row], _starts(key)
                sums = [np.add.reduceat(x, start) if len(start) else np.zeros(0) for x in (share * marked, share * ~marked)]
                yield pa.RecordBatch.from_arrays([pa.array(key[start]), *map(pa.array, sums), pa.array(np.diff(np.append(start, len(key))))], names=["key", "toxic", "other", "documents"])

    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, other = n.get(True, 0), n.get(False, 0)
    if not toxic or not other:
        rate = toxic / max(1, toxic + other)
        return Model(float(np.clip(np.log((rate + 1e-9) / (1 - rate + 1e-9)), -30, 30)), *(np.zeros(0, kind) for kind in (np.int64, np.float64, np.float64)))
    counts = ws.mapped(rows, count, "key long, toxic double, other double, documents long").groupBy("key").agg(*(F.sum(c).alias(c) for c in ("toxic", "other", "documents")))
    found = ws.collected(counts.where(F.col("documents") >= LEAST))
    order = np.argsort(found["key"])
    keys = found["key"][order].astype(np.int64)
    model = Model(0.0, keys, ratios(*(found[c][order] for c in ("toxic", "other", "documents"))), np.zeros(len(keys)))
    del found
    sent, k = spark.sparkContext.broadcast(model), len(keys)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = []
        for batch in batches:
            label = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.float64)
            for a, b, row, place, value in sent.value.rows(batch.column("text")):
                order = np.argsort(row, kind="stable")
                row, place, value = row[order], place[order], value[order]
                for x in range(0, b - a, _BATCH):
                    y = label[a + x : min(a + x + _BATCH, b)]
                    first = np.searchsorted(row, np.arange(x, x + len(y) + 1))
                    blocks.append((y, first - first[0], place[first[0] : first[-1]].copy(), value[first[0] : first[-1]].astype(np.float16)))
        if blocks:
            bias, w = fit(blocks, k)
            yield pa.RecordBatch.from_arrays([pa.array([bias]), pa.array([w.astype(np.float32).tobytes()], pa.binary())], names=["bias", "weight"])

    fitted = ws.mapped(rows.repartition(1).sortWithinPartitions("turn", "toxic", "text").select("text", "toxic"), learn, "bias double, weight binary").first()
    sent.unpersist()
    return Model(fitted["bias"], keys, model.ratio, np.frombuffer(bytes(fitted["weight"]), dtype=np.float32).astype(np.float64))


def _fold(column: str) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with a score in 0..1 for each row: a narrow map that carries all columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c != column))
    schema = docs.select("*", F.lit(0.0).alias(column)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.scores(batch.column("text")), pa.float64())], names=[*batch.schema.names, column])

    return ws.mapped(docs, run, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    out = score(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", F.coalesce(_fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@carrying
def drop_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``limit`` or more."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return score(docs, train(docs, labels), "_toxicity").where(F.col("_toxicity") < limit).select(*columns)
