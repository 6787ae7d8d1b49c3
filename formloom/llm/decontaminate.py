r"""Benchmark decontamination by an FM-index over each training shard.

A task gathers documents into shards of about ``SHARD_WORDS`` words. Words are looked up in the
vocabulary of the benchmark; words outside it can't take part in any occurrence, so they act as
separators, and runs shorter than the shortest window are left out of the index (nothing can be
found in them). Over the rest the task builds

* the suffix array, by prefix doubling with numpy sorts; every separator is a symbol of its own,
* the Burrows-Wheeler transform in a wavelet matrix with O(1) bit ranks,
* suffix positions sampled at every fourth word and at the start of each run.

All windows of the benchmark are searched backwards at once; their occurrences are located by
walking to the next sampled position; spans that touch are merged into removal spans.

Everything is one narrow map: no shuffle. The benchmark's texts go to the executors in blocks of at
most ``BLOCK_WORDS`` words (a proven bound), and a task makes a block's windows itself; a larger
benchmark is applied block after block, each to the whole text, with a table written in between, so
that the driver and a task hold one block at a time: spans are merged over the blocks and cut once,
so results don't depend on the blocks.

Defined results: a null or empty text has no words and no hits; texts of any length are taken whole;
an item without words has no window; items may share windows, and each is found; item ids are of any
type, null ones are left out; repeated rows are scored one by one; an empty benchmark finds nothing
and empty documents give an empty table; further columns of the inputs are ignored by ``contamination``
and carried by ``decontaminate``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordspans as ws
from .columns import carrying
from .tables import written

WINDOW = 10
SHARD_WORDS = 1_000_000
BLOCK_WORDS = 2_000_000
SAMPLE = 4


class Patterns:
    """Windows of benchmark items over a vocabulary of word hashes; ids start at 1, 0 separates."""

    def __init__(self, names: list[str], texts: list[str], window: int = WINDOW):
        hashes: list[np.ndarray] = []
        for a, b, data, offsets in ws.slabs(pa.array(texts, pa.string())):
            data = ws.LOWER[data]
            s, e, first = ws.words(data, offsets, ws.ALNUM)
            h = ws.word_hashes(data, s, e)
            hashes += [h[first[i] : first[i + 1]] for i in range(b - a)]
        self.names = names
        sizes = np.array([len(h) for h in hashes], dtype=np.int64)
        flat = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        self.vocabulary = np.unique(flat)
        ids = np.concatenate([np.searchsorted(self.vocabulary, flat) + 1, np.zeros(window, np.int64)]).astype(np.int32)
        # Every place where a window starts, its item and its size; words beyond a short item's end are 0.
        many = np.where(sizes > 0, np.maximum(1, sizes - window + 1), 0)
        item = np.repeat(np.arange(len(sizes)), many)
        inside = np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many)
        start = np.repeat(np.cumsum(sizes) - sizes, many) + inside
        rows = np.where(np.arange(window)[None, :] < sizes[item][:, None], ids[start[:, None] + np.arange(window)], 0).astype(np.int32)
        self.windows, of = np.unique(rows, axis=0, return_inverse=True) if len(rows) else (rows, np.zeros(0, np.int64))
        self.sizes = (self.windows > 0).sum(axis=1).astype(np.int64)
        pairs = np.unique(np.stack([of.ravel().astype(np.int64), item], axis=1), axis=0) if len(item) else np.zeros((0, 2), np.int64)
        self.item_of = pairs[:, 1]
        self.item_at = np.searchsorted(pairs[:, 0], np.arange(len(self.windows) + 1))
        self.shortest = int(self.sizes.min()) if len(self.sizes) else 0
        self._known = np.zeros(1 << 16, dtype=bool)
        self._known[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True

    def ids(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), dtype=np.int32)
        if len(self.vocabulary):
            maybe = np.flatnonzero(self._known[(h & np.uint64(0xFFFF)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.vocabulary, h[maybe]), len(self.vocabulary) - 1)
            good = self.vocabulary[at] == h[maybe]
            out[maybe[good]] = at[good] + 1
        return out


class Block:
    """Items of the benchmark as they are sent; a worker makes their patterns once."""

    def __init__(self):
        self.names: list[str] = []
        self.texts: list[str] = []
        self._patterns: Patterns | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_patterns": None}

    @property
    def patterns(self) -> Patterns:
        if self._patterns is None:
            self._patterns = Patterns(self.names, self.texts)
        return self._patterns


class WaveletMatrix:
    """Rank of a symbol in a prefix, vectorised over many questions."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.levels = []
        self.bits, self.n = bits, len(seq)
        for level in range(bits - 1, -1, -1):
            bit = (seq >> level) & 1
            packed = np.packbits(np.pad(bit.astype(np.uint8), (0, -len(bit) % 64 + 64)), bitorder="little").view(np.uint64)
            before = np.zeros(len(packed) + 1, dtype=np.int64)
            np.cumsum(np.bitwise_count(packed), out=before[1:], dtype=np.int64)
            self.levels.append((packed, before, self.n - int(bit.sum())))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    @staticmethod
    def _ones(level, i: np.ndarray) -> np.ndarray:
        packed, before, _ = level
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return before[i >> 6] + np.bitwise_count(packed[i >> 6] & below)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        low, high = np.zeros_like(i), i
        for k, level in enumerate(self.levels):
            one = (symbol >> (self.bits - 1 - k)) & 1 == 1
            a, b = self._ones(level, low), self._ones(level, high)
            low, high = np.where(one, level[2] + a, low - a), np.where(one, level[2] + b, high - b)
        return high - low

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol at i, its rank before i)."""
        low, at, symbol = np.zeros_like(i), i, np.zeros_like(i)
        for level in self.levels:
            packed = level[0]
            one = (packed[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            symbol = symbol * 2 + one
            a, b = self._ones(level, low), self._ones(level, at)
            low, at = np.where(one, level[2] + a, low - a), np.where(one, level[2] + b, at - b)
        return symbol, at - low


class FMIndex:
    """FM-index of a text of symbols 1..v in runs that end with a 0."""

    def __init__(self, text: np.ndarray, largest: int):
        n = len(text)
        gap = np.flatnonzero(text == 0)
        rank = text.astype(np.int64) + len(gap)
        rank[gap] = np.arange(len(gap))
        width = 1
        while True:
            # Pairs of ranks until all differ; a run ends at its own separator, so few rounds do.
            nxt = np.zeros(n, dtype=np.int64)
            nxt[: n - width] = rank[width:] + 1
            key = rank * (n + largest + 2) + nxt
            self.order = np.argsort(key, kind="stable")
            sorted_key = key[self.order]
            new = np.zeros(n, dtype=np.int64)
            new[self.order[1:]] = np.cumsum(sorted_key[1:] != sorted_key[:-1])
            rank = new
            if int(rank[self.order[-1]]) == n - 1:
                break
            width *= 2
        bwt = text[self.order - 1].astype(np.int64)
        self.before = np.concatenate([[0, len(gap)], len(gap) + np.cumsum(np.bincount(text, minlength=largest + 1)[1:])])
        self.wavelet = WaveletMatrix(bwt, max(1, int(largest).bit_length()))
        first = np.ones(n, dtype=bool)
        first[1:] = text[:-1] == 0
        kept = first[self.order] | (self.order % SAMPLE == 0)
        self.kept_before = np.concatenate([[0], np.cumsum(kept)])
        self.kept, self.sampled = kept, self.order[kept]
        del self.order

    def search(self, windows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of all windows, by backward search."""
        low, high = np.zeros(len(windows), dtype=np.int64), np.full(len(windows), self.wavelet.n, dtype=np.int64)
        for back in range(1, windows.shape[1] + 1):
            live = np.flatnonzero((sizes >= back) & (low < high))
            if len(live):
                c = windows[live, sizes[live] - back].astype(np.int64)
                low[live] = self.before[c] + self.wavelet.rank(c, low[live])
                high[live] = self.before[c] + self.wavelet.rank(c, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes at these rows."""
        out, steps = np.full(len(rows), -1, dtype=np.int64), 0
        todo = np.arange(len(rows))
        rows = rows.copy()
        while len(todo):
            done = self.kept[rows]
            out[todo[done]] = self.sampled[self.kept_before[rows[done]]] + steps
            todo, rows = todo[~done], rows[~done]
            c, r = self.wavelet.access_rank(rows)
            rows, steps = self.before[c] + r, steps + 1
        return out


def occurrences(ids: np.ndarray, first: np.ndarray, p: Patterns) -> tuple[np.ndarray, np.ndarray]:
    """(window, word position) of every occurrence in the shard; first: first word of each document, and the end."""
    none = np.zeros(0, dtype=np.int64)
    if not p.shortest or not len(ids):
        return none, none
    known = ids > 0
    begin, end = known.copy(), known.copy()
    begin[1:] &= ~known[:-1]
    end[:-1] &= ~known[1:]
    edge = first[:-1][first[:-1] < first[1:]]
    begin[edge] = known[edge]
    edge = first[1:][first[:-1] < first[1:]] - 1
    end[edge] = known[edge]
    a, b = np.flatnonzero(begin), np.flatnonzero(end) + 1
    long = b - a >= p.shortest
    a, size = a[long], (b - a)[long]
    if not len(a):
        return none, none
    at = np.cumsum(size + 1) - size - 1
    text = np.zeros(int((size + 1).sum()), dtype=np.int32)
    place = np.repeat(a - at, size + 1) + np.arange(len(text))  # position in the shard of each symbol
    inside = np.ones(len(text), dtype=bool)
    inside[at + size] = False
    text[inside] = ids[place[inside]]
    index = FMIndex(text, len(p.vocabulary))
    low, high = index.search(p.windows, p.sizes)
    count = high - low
    window = np.repeat(np.arange(len(count)), count)
    rows = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    return window, place[index.locate(rows)]


def shard_hits(ids: np.ndarray, first: np.ndarray, p: Patterns):
    """(hit per word, documents and items of the distinct pairs that occur), both by number."""
    window, at = occurrences(ids, first, p)
    step = np.bincount(at, minlength=len(ids) + 1) - np.bincount(at + p.sizes[window], minlength=len(ids) + 1)
    hit = np.cumsum(step[:-1]) > 0
    doc = np.searchsorted(first, at, "right") - 1
    pairs = np.unique(doc * max(1, len(p.sizes)) + window) if len(doc) else np.zeros(0, dtype=np.int64)
    doc, window = pairs // max(1, len(p.sizes)), pairs % max(1, len(p.sizes))
    many = p.item_at[window + 1] - p.item_at[window]
    flat = np.repeat(p.item_at[window], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    return hit, np.repeat(doc, many), p.item_of[flat]


def _scan(sent: Broadcast, cut: bool):
    """The map over Arrow batches; sent: a block of items. Columns: row fields as they come, text, items, spans.

    With ``cut`` the merged spans, of this block and those before, are taken out of the text: for the last block.
    """

    def finish(p: Patterns, held: list, ids: list[np.ndarray], sizes: list[int]) -> Iterator[pa.RecordBatch]:
        first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        hit, doc, item = shard_hits(np.concatenate([*ids, np.zeros(0, np.int32)]), first, p)
        found: dict[int, set[str]] = {}
        for d, i in zip(doc.tolist(), item.tolist(), strict=True):
            found.setdefault(d, set()).add(p.names[i])
        edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
        runs_a, runs_b = edges[::2], edges[1::2]
        base = 0
        for batch, starts, ends, firsts in held:
            n, texts = batch.num_rows, batch.column("text")
            spans, items, counts, cleaned = [], [], [], []
            for r in range(n):
                a, b = int(first[base + r]), int(first[base + r + 1])
                counts.append(b - a)
                old = batch.column("spans")[r].as_py()
                # A run may pass from one document into the next: clip it.
                i, j = np.searchsorted(runs_b, a, "right"), np.searchsorted(runs_a, b, "left")
                own = [(max(int(x), a) - a, min(int(y), b) - a) for x, y in zip(runs_a[i:j], runs_b[i:j], strict=True)]
                both: list[list[int]] = []
                for x, y in sorted([*own, *((s["start"], s["end"]) for s in old)]):
                    if both and x <= both[-1][1]:
                        both[-1][1] = max(both[-1][1], y)
                    else:
                        both.append([x, y])
                spans.append([{"start": x, "end": y} for x, y in both])
                items.append(sorted(found.get(base + r, set()) | set(batch.column("items")[r].as_py())))
                text = texts[r].as_py()
                if cut and both:
                    raw, w = text.encode(), int(firsts[r])
                    out, last = [], 0
                    for x, y in both:
                        out.append(raw[last : int(starts[w + x])])
                        last = int(ends[w + y - 1])
                    text = b"".join([*out, raw[last:]]).decode()
                cleaned.append(text)
            base += n
            new = {"text": pa.array(cleaned, pa.string()), "items": pa.array(items, pa.list_(pa.string())), "n_words": pa.array(counts, pa.int64()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in batch.schema.names], names=batch.schema.names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value.patterns
        held, ids, sizes, total = [], [], [], 0
        for batch in batches:
            for a, b, data, offsets in ws.slabs(batch.column("text")):
                data = ws.LOWER[data]
                s, e, first = ws.words(data, offsets, ws.ALNUM)
                ids.append(p.ids(ws.word_hashes(data, s, e)))
                sizes += np.diff(first).tolist()
                low = np.repeat(offsets[:-1], np.diff(first))
                held.append((batch.slice(a, b - a), s - low if cut else None, e - low if cut else None, first))
                total += len(s)
                if total >= SHARD_WORDS:
                    yield from finish(p, held, ids, sizes)
                    held, ids, sizes, total = [], [], [], 0
        if held:
            yield from finish(p, held, ids, sizes)

    return scan


def _blocks(benchmark: DataFrame) -> Iterator[Block]:
    """Items in blocks of at most BLOCK_WORDS words, or one item; one block is in memory at a time."""
    block, size = Block(), 0
    for item, text in benchmark.select(F.col("item_id").cast("string"), "text").where("item_id is not null and text is not null").toLocalIterator():
        n = len(text) // 2 + 1
        if block.names and size + n > BLOCK_WORDS:
            yield block
            block, size = Block(), 0
        block.names.append(item)
        block.texts.append(text)
        size += n
    yield block


def scan_documents(docs: DataFrame, benchmark: DataFrame, cut: bool = False) -> DataFrame:
    """``docs`` plus n_words, items (ids of the items found, as text) and spans (merged removal spans, in words).

    With ``cut`` the spans' text, from the first to the last byte of its words, is taken out of ``text``;
    spans tell the words of the text as it came. All blocks read the uncut text, the last one cuts.
    """
    fields = [f for f in docs.schema.fields if f.name not in ("items", "spans", "n_words")]
    out = docs.select(*(F.col(f"`{f.name}`") for f in fields))
    empty = "cast(array() as array<string>) as items", "cast(array() as array<struct<start:int,end:int>>) as spans", "0L as n_words"
    out = out.selectExpr("*", *empty)
    context, schema = docs.sparkSession.sparkContext, out.schema
    blocks = _blocks(benchmark)
    block = next(blocks)
    while block is not None:
        sent = context.broadcast(block)  # at most BLOCK_WORDS words
        block = next(blocks, None)
        out = ws.mapped(out, _scan(sent, cut and block is None), schema)
        if block is not None:
            # A task, and the driver, hold one block's tables at a time.
            out = written(out)
            sent.destroy()
    return out


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and the removal spans of each document."""
    found = scan_documents(docs.select("doc_id", "text"), benchmark)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]).cast("long"))
    digest = F.sha2(F.array_join(F.sort_array("items"), ","), 256)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (n_hit > 0).alias("contaminated"), "spans")


@carrying
def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with the removal spans cut out of the texts and n_chars, where there is one, made to fit."""
    out = scan_documents(docs, benchmark, cut=True)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("spans") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
