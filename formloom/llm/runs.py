r"""Periodic runs of words by the runs theorem, and texts with their periods collapsed.

Words are ``[^\x20\x09-\x0D]+``. A run is a stretch of consecutive words of smallest period q and of at least
``max(least, times * q)`` words that neither neighbour extends with that period. Every run has an occurrence of its
Lyndon root that is the longest Lyndon word at its first word under the order of words or under the reverse order. So:

1. the suffixes of all texts of a slab are sorted by prefix doubling, of which each round looks only at suffixes that are
   still equal; the round that tells two neighbours apart gives their LCP (a range minimum over the LCPs known so far);
2. the longest Lyndon word at each word ends at the next smaller value of the inverse suffix array, under the reverse
   order at the next greater one;
3. each such word is extended right by the LCP of its two places (sparse-table range minimum) and left by the same over
   the reversed texts, which are built for texts that still have a candidate.

The sparse table is walked level by level with all queries side by side, so memory stays proportional to the slab.

A plain narrow map without a shuffle: a slab holds whole texts, ``SLAB_WORDS`` words or one longer text. Words are told
apart by their bytes. Defined results: null, empty and blank texts have no words, no runs and an empty collapsed text;
repeated rows are handled one by one; of runs of equal exponent the first, then that of the smaller period is the
greatest; an empty table gives an empty one; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import wordspans as ws

LEAST_WORDS = 24
LEAST_TIMES = 3
SLAB_WORDS = 200_000
_UNKNOWN = np.int32((1 << 31) - 1)


def range_minima(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(values[lo : hi + 1]) of each query (lo <= hi), by the levels of a sparse table, one at a time."""
    out = np.empty(len(lo), values.dtype)
    if not len(lo):
        return out
    level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    by = np.argsort(level, kind="stable")
    cuts = np.searchsorted(level[by], np.arange(level.max() + 2))
    for k in range(level.max() + 1):
        q = by[cuts[k] : cuts[k + 1]]
        out[q] = np.minimum(values[lo[q]], values[hi[q] - (1 << k) + 1])
        values = np.minimum(values[: -(1 << k)], values[1 << k :])
    return out


class Suffixes:
    """Ranks of all suffixes of several texts (earlier texts first) and the LCPs of neighbours.

    codes: words as numbers from 1, a 0 after each text; text: the number of the text at each place.
    """

    def __init__(self, codes: np.ndarray, text: np.ndarray) -> None:
        n = len(codes)
        key = (text.astype(np.int64) << 32) | codes
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.ones(n + 1, dtype=bool)
        new[1:n] = key[1:] != key[:-1]
        self.lcp = np.where(new[:n], np.int32(0), _UNKNOWN)
        self.rank = np.empty(n, dtype=np.int64)
        self.rank[order] = np.maximum.accumulate(np.where(new[:n], np.arange(n), 0))
        h = 1
        while len(still := np.flatnonzero(~(new[:n] & new[1:]))):
            place = order[still]
            key = (self.rank[place] << 32) | self.rank[place + h]
            by = np.argsort(key)
            place, key = place[by], key[by]
            order[still] = place
            fresh = np.flatnonzero(key[1:] != key[:-1]) + 1
            fresh = fresh[~new[still[fresh]]]
            k = still[fresh]
            self.lcp[k] = h + range_minima(self.lcp, self.rank[order[k - 1] + h] + 1, self.rank[order[k] + h])
            new[k] = True
            self.rank[place] = np.maximum.accumulate(np.where(new[still], still, 0))
            h *= 2

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that the suffixes at i and j, two places of one text, have in common."""
        a, b = self.rank[i], self.rank[j]
        return range_minima(self.lcp, np.minimum(a, b) + 1, np.maximum(a, b)).astype(np.int64)


def next_smaller(values: np.ndarray) -> np.ndarray:
    """The next place of a smaller value, or the length: by jumps of all places at once, then one by one from the right."""
    n = len(values)
    bounded = np.append(values, -1)
    jump = np.append(np.arange(1, n + 1), n)
    still = np.flatnonzero(bounded[jump[:n]] > values)
    for _ in range(12):
        jump[still] = jump[jump[still]]
        still = still[bounded[jump[still]] > values[still]]
    if len(still):
        known, heights = jump.tolist(), bounded.tolist()
        for i in reversed(still.tolist()):
            j, height = known[i], heights[i]
            while heights[j] > height:
                j = known[j]
            known[i] = j
        jump = np.array(known)
    return jump[:n]


def find_runs(codes: np.ndarray, starts: np.ndarray, least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs, by text, start, period. starts: of each text in codes, then the length; a 0 ends each."""
    sizes = np.diff(starts)
    text = np.repeat(np.arange(len(sizes)), sizes)
    suffixes = Suffixes(codes, text)
    ends = starts[1:] - 1
    i = np.tile(np.arange(len(codes)), 2)
    p = np.concatenate([next_smaller(suffixes.rank), next_smaller(len(codes) - suffixes.rank)]) - i
    # The first root of a run starts within its first period, so the period holds for so many words beyond that root.
    beyond = (times - 2) * p + 1
    able = i + p + beyond <= ends[text[i]]
    i, p, beyond = i[able], p[able], beyond[able]
    able = (codes[i] == codes[i + p]) & (codes[i + beyond - 1] == codes[i + p + beyond - 1])
    i, p, beyond = i[able], p[able], beyond[able]
    right = suffixes.common(i, i + p)
    able = (right >= beyond) & (right + 2 * p - 1 >= np.maximum(least, times * p))
    i, p, right = i[able], p[able], right[able]
    by = np.lexsort((i, p, i + p + right))
    i, p, right = i[by], p[by], right[by]
    first = np.ones(len(i), dtype=bool)
    first[1:] = (p[1:] != p[:-1]) | ((i + p + right)[1:] != (i + p + right)[:-1])
    i, p, right = i[first], p[first], right[first]
    length = p + right
    if len(i):
        some, own = np.unique(text[i], return_inverse=True)
        back = np.concatenate([[0], np.cumsum(sizes[some])])
        turned = np.concatenate([np.append(codes[starts[t] : ends[t]][::-1], 0) for t in some])
        mirrored = Suffixes(turned, np.repeat(np.arange(len(some)), sizes[some]))
        inner = np.flatnonzero(i > starts[text[i]])
        last = back[own] + ends[text[i]] - i  # the mirrored place of word i - 1
        left = np.zeros(len(i), dtype=np.int64)
        left[inner] = mirrored.common(last[inner], last[inner] - p[inner])
        i, length = i - left, length + left
    fits = length >= np.maximum(least, times * p)
    i, p, length = i[fits], p[fits], length[fits]
    by = np.lexsort((p, i))
    i, p, length = i[by], p[by], length[by]
    return text[i], i - starts[text[i]], length, p


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The words that a document of n words is read as: every tenth repeats a part of itself; others, and those without an id, are as they are."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    return np.where(place < a, place, a + (place - a) % p)


def _slabs(ids: list, texts: list[str | None], reading: Callable[[int | None, int], np.ndarray | None] | None) -> Iterator[list[list[bytes]]]:
    """Words of the texts, in slabs."""
    slab, size = [], 0
    for doc_id, t in zip(ids, texts, strict=True):
        words = (t or "").encode().split()
        if reading is not None and (read := reading(doc_id, len(words))) is not None:
            words = [words[k] for k in read.tolist()]
        slab.append(words)
        size += len(words)
        if size >= SLAB_WORDS:
            yield slab
            slab, size = [], 0
    if slab:
        yield slab


def _columns(slab: list[list[bytes]], least: int, times: int) -> list[pa.Array]:
    known: dict[bytes, int] = {}
    codes = np.fromiter(itertools.chain.from_iterable(itertools.chain((known.setdefault(w, len(known) + 1) for w in words), (0,)) for words in slab), dtype=np.int64)
    starts = np.cumsum([0, *(len(words) + 1 for words in slab)])
    text, start, length, period = find_runs(codes, starts, least, times)
    cuts = np.searchsorted(text, np.arange(len(slab) + 1)).tolist()
    out = []
    for k, words in enumerate(slab):
        own = slice(cuts[k], cuts[k + 1])
        found = list(zip(start[own].tolist(), length[own].tolist(), period[own].tolist(), strict=True))
        kept = words
        if found:
            stays = np.ones(len(words), dtype=bool)
            for s, size, q in found:
                stays[s + q : s + size] = False
            kept = itertools.compress(words, stays.tolist())
        top = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
        lines = "".join(f"{s},{size},{q}\n" for s, size, q in found)
        collapsed = b" ".join(kept)
        out.append((len(found), *top, None if top[0] is None else 1000 * top[1] // top[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest(), found, collapsed))
    return list(zip(*out, strict=True))


def periodic_runs(docs: DataFrame, reading: Callable[[int | None, int], np.ndarray | None] | None = None, least: int = LEAST_WORDS, times: int = LEAST_TIMES, texts: bool = True) -> DataFrame:
    """doc_id, n_runs; start, length, period and exponent_milli of the run of the greatest exponent (else null); runs_sha256, collapsed_sha256.

    With ``texts``, runs (array of start, length, period) and collapsed (the words that no run repeats) as well. A word
    is repeated if a run contains it after that run's first period. reading(doc_id, n): word numbers to read a document's
    n words as, or None. least, times (1 at least 2): a run's least number of words and of periods.
    """
    if times < 2 or least < 1:
        raise ValueError("a run repeats its period twice at least")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    kinds = [pa.int64()] * 5 + [pa.string()] * 2
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    if texts:
        schema += ", runs array<struct<start:long,length:long,period:long>>, collapsed string"
        names += ["runs", "collapsed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_run = pa.struct([(k, pa.int64()) for k in ("start", "length", "period")])
        for batch in batches:
            row = 0
            for slab in _slabs(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), reading):
                *plain, runs, collapsed = _columns(slab, least, times)
                columns = [batch.column("doc_id").slice(row, len(slab)), *(pa.array(c, k) for c, k in zip(plain, kinds, strict=True))]
                if texts:
                    columns.append(pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in found] for found in runs], pa.list_(of_run)))
                    columns.append(pa.array([c.decode() for c in collapsed], pa.string()))
                row += len(slab)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return ws.mapped(docs.select("doc_id", "text"), run, schema)
