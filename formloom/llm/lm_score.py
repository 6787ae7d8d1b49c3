r"""LM scoring by cross-entropy difference.

Two bigram models are counted over the corpus: the background on all documents, the target on those
that ``labels`` marks as of good quality. They are matched: one vocabulary (all words of the
corpus), one order, one smoothing, and the end of a text counts as a word that may follow, so each
context's probabilities sum to one; a context that a model hasn't seen leaves the word's own share. The score of a document is the mean over its tokens of

    loss(token | target) - loss(token | background)    (natural logarithm)

so a low score means text like the target. Words are runs of letters, digits and non-ASCII
characters of the lower-cased text.

No table of a fixed size stands for the corpus: every word and every bigram is counted under a
64-bit key of its own (two of a billion n-grams share one with a chance of 3 %). The number of
tokens gives the number of ``chunks`` of documents (by a hash of the row) and ``parts`` of the key
space, so both grow with the corpus and a task's memory doesn't:

1. each chunk sends every part its distinct keys, in order, with their counts,
2. each part sums them and answers every chunk with the corpus's counts of the keys it sent,
3. each chunk, whose keys are the same again, scores its documents with the answers.

Shuffled are texts (by chunk) and, packed as bytes, distinct keys of each chunk and their counts.
Target ids go to the executors while there are at most ``BROADCAST_IDS``, else documents meet the
labels by a shuffle.

Defined results: null and empty texts have no tokens and score 0, as does everything if no document
is marked; texts of any length are counted and scored whole; every word and bigram counts, so there
are no ties to break; repeated rows count and are scored one by one; of ids with several labels one
that is good marks them; labels that are null count as 0; null ids are background; an empty table of
documents gives an empty one; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordspans as ws

BROADCAST_IDS = 1_000_000
#: Tokens of a chunk and of a part, about: sizes of tasks, not of models.
CHUNK_TOKENS, PART_TOKENS = 1 << 20, 1 << 21
#: Weight of the bigram estimate, and what is added to each unigram count.
MIX, ADD = 0.7, 0.5
_FLUSH = 1 << 20
#: Stands for the start of a text, as a word before the first.
_START = np.uint64(0x5851F42D4C957F2D)


def hashes(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, first word of each text)."""
    for a, b, data, offsets in ws.slabs(column):
        data = ws.LOWER[data]
        s, e, first = ws.words(data, offsets, ws.ALNUM)
        yield a, b, ws.word_hashes(data, s, e), first


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts (rows of counts)."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[start], np.add.reduceat(c, start) if len(k) else c


def _marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text and target (whether the document is marked)."""
    ids = labels.where("quality = 1").select(F.col("doc_id").alias("_id")).distinct()
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", F.col("_id").isNotNull().alias("target"))


def count_words(marked: DataFrame) -> DataFrame:
    """word (hash), target, n: all words of the marked documents and of all; under _START the numbers of texts with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(k: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c[:, 0].copy()), pa.array(c[:, 1].copy())], names=["word", "target", "n"])

        keys, counts, size = [np.zeros(0, np.uint64)], [np.zeros((0, 2), np.int64)], 0
        for batch in batches:
            target = batch.column("target").to_numpy(zero_copy_only=False)
            for a, b, h, first in hashes(batch.column("text")):
                sizes = np.diff(first)
                mine = np.concatenate([np.repeat(target[a:b], sizes), target[a:b][sizes > 0]])
                k, c = _summed([h, np.full(len(mine) - len(h), _START)], [np.stack([mine, np.ones(len(mine), bool)], axis=1).astype(np.int64)])
                keys.append(k)
                counts.append(c)
                size += len(k)
                if size > 2 * _FLUSH:
                    k, c = _summed(keys, counts)
                    if len(k) > _FLUSH:
                        yield packed(k, c)
                        k, c = k[:0], c[:0]
                    keys, counts, size = [k], [c], len(k)
        yield packed(*_summed(keys, counts))

    return ws.mapped(marked.select("text", "target"), run, "word long, target long, n long").groupBy("word").agg(F.sum("target").alias("target"), F.sum("n").alias("n"))


class Chunk:
    """The tokens of a chunk's documents, and its distinct n-gram keys in order."""

    def __init__(self, texts: pa.ChunkedArray):
        found, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for part in texts.chunks:
            for _, _, h, first in hashes(part):
                found.append(h)
                sizes.append(np.diff(first))
        words, self.sizes = np.concatenate(found), np.concatenate(sizes)
        n = len(words)
        self.first = (np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]
        before = np.concatenate([[_START], words[:-1]]) if n else words
        before[self.first] = _START
        bigrams = ws.mix(before * np.uint64(0xD6E8FEB86659FD93) + words)
        every = np.concatenate([words, bigrams, [_START][: len(self.first)]]).astype(np.uint64)
        del found, words, before, bigrams
        self.keys, place = _distinct(every)
        # Places in the keys of each token's word, of its bigram and of the start of a text.
        self.word, self.bigram, self.start = place[:n], place[n : 2 * n], place[2 * n :]

    def counts(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the keys in the marked documents and in all; target: whether each document is marked."""
        mark, k, out = np.repeat(target, self.sizes), len(self.keys), []
        for own, texts in ((mark, int(target[self.sizes > 0].sum())), (slice(None), len(self.first))):
            n = np.bincount(self.word[own], minlength=k) + np.bincount(self.bigram[own], minlength=k)
            n[self.start] = texts
            out.append(n)
        return out[0], out[1]

    def bounds(self, parts: int) -> np.ndarray:
        """Where each part of the key space begins in the keys, and the end."""
        part = (self.keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
        return np.searchsorted(part, np.arange(parts + 1).astype(np.uint64))

    def loss(self, n: np.ndarray, tokens: int, texts: int, words: int) -> np.ndarray:
        """Mean loss of each document's tokens under the model with the counts n of the keys.

        In each context the words of the vocabulary and the end of the text have probabilities that sum to one.
        """
        if not len(self.word):
            return np.zeros(len(self.sizes))
        word = n[self.word]
        before = np.concatenate([word[:1], word[:-1]])
        before[self.first] = n[self.start]
        single = (word + ADD) / (tokens + texts + ADD * (words + 1))
        p = np.where(before > 0, MIX * n[self.bigram] / np.maximum(before, 1) + (1 - MIX) * single, single)
        return -np.bincount(np.repeat(np.arange(len(self.sizes)), self.sizes), weights=np.log(p), minlength=len(self.sizes)) / np.maximum(self.sizes, 1)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and the place among them of each value."""
    order = np.argsort(values)
    values = values[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    place = np.empty(len(values), dtype=np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return values[new], place


def _packed(arrays: list[np.ndarray], rising: bool = False) -> pa.Array:
    """Arrays of 8-byte numbers as bytes, the first byte of all numbers first: zeros then lie together and shrink in the shuffle."""

    def planes(a: np.ndarray) -> bytes:
        a = np.diff(a, prepend=np.zeros(1, a.dtype)) if rising else a
        return np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8).T).tobytes()

    return pa.array([planes(np.ascontiguousarray(a)) for a in arrays], pa.binary())


def _unpacked(column: pa.ChunkedArray, kind: type, rising: bool = False) -> list[np.ndarray]:
    flat = (np.ascontiguousarray(np.frombuffer(x.as_buffer(), dtype=np.uint8).reshape(8, -1).T).view(kind).ravel() for x in column)
    return [np.cumsum(a, dtype=kind) if rising else a for a in flat]


def cross_entropy_difference(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss (means over the tokens) and score of every document."""
    marked = _marked(docs, labels)
    start = F.col("word") == int(np.int64(_START.view(np.int64)))
    size = count_words(marked).agg(*(F.coalesce(F.sum(F.when(own, F.col(c))), F.lit(0)).alias(f"{c}_{name}") for name, own in (("words", ~start), ("texts", start)) for c in ("target", "n")), F.coalesce(F.sum((~start).cast("long")), F.lit(0)).alias("words")).first()
    words, target_tokens, all_tokens = size["words"], size["target_words"], size["n_words"]
    chunks, parts = all_tokens // CHUNK_TOKENS + 1, all_tokens // PART_TOKENS + 1
    kind = docs.schema["doc_id"].dataType.simpleString()
    placed = marked.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks))).repartition(chunks, "chunk")

    def send(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        c = Chunk(table.column("text"))
        target, n = c.counts(table.column("target").to_numpy().astype(bool))
        at = c.bounds(parts)
        some = np.flatnonzero(np.diff(at))
        split = [[x[at[p] : at[p + 1]] for p in some] for x in (c.keys, target, n)]
        return pa.table([pa.array(some, pa.int64()), pa.array(np.full(len(some), key[0].as_py()), pa.int64()), _packed(split[0], rising=True), *map(_packed, split[1:])], names=["part", "chunk", "keys", "target", "n"])

    def answer(table: pa.Table) -> pa.Table:
        keys = _unpacked(table.column("keys"), np.uint64, rising=True)
        at = np.cumsum([0, *(len(k) for k in keys)])
        distinct, place = _distinct(np.concatenate(keys))
        del keys
        out = []
        for name in ("target", "n"):
            total = np.zeros(len(distinct), dtype=np.int64)
            for a, b, n in zip(at[:-1], at[1:], _unpacked(table.column(name), np.int64), strict=True):
                total[place[a:b]] += n  # a chunk sends each key once
            out.append(_packed([total[place[a:b]] for a, b in zip(at[:-1], at[1:], strict=True)]))
        return pa.table([table.column("part"), table.column("chunk"), *out], names=["part", "chunk", "target", "n"])

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        c = Chunk(table.column("text"))
        answers = answers.sort_by("part")
        losses = []
        for name, tokens, texts in (("target", target_tokens, size["target_texts"]), ("n", all_tokens, size["n_texts"])):
            n = np.concatenate([np.zeros(0, np.int64), *_unpacked(answers.column(name), np.int64)])
            if len(n) != len(c.keys):
                raise ValueError(f"{len(n)} counts for {len(c.keys)} n-grams")
            losses.append(c.loss(n, tokens, texts, words))
        t, g = losses
        return pa.table([table.column("doc_id"), pa.array(c.sizes, pa.int64()), pa.array(t), pa.array(g), pa.array(t - g if target_tokens else np.zeros(len(t)))], names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    sent = placed.groupBy("chunk").applyInArrow(send, "part long, chunk long, keys binary, target binary, n binary")
    answers = sent.repartition(parts, "part").groupBy("part").applyInArrow(answer, "part long, chunk long, target binary, n binary")
    answers = answers.repartition(chunks, "chunk")
    return placed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, f"doc_id {kind}, n_tokens long, target_loss double, background_loss double, score double")
