r"""Repeated passages by sparse suffix arrays.

A passage is repeated if ``LENGTH`` words or more of it also stand, in the same order, in another
document. Words are runs of letters, digits and non-ASCII characters of the lower-cased text.

1. *Sample.* Suffixes are kept at minimiser positions only: the least hash of ``PREFIX``-word grams
   in every run of LENGTH - PREFIX + 1 grams, the first of them if several are least. The choice
   depends on content alone, so two equal passages of LENGTH words keep a suffix at the same place
   in both (about 1 suffix in 13). Suffixes whose PREFIX-word gram no other document has are dropped.
2. *Sort and compare neighbours.* The suffixes left, with ``PREFIX`` words before and ``LENGTH`` words
   after their position, are sorted over the cluster by their words; so long equal passages are split
   over range partitions by what follows them, before them, and by document. Each suffix is compared
   with its neighbours from other documents on both sides: the common prefix is the longest with any
   document. A second order, by the words before the position within an equal gram, gives the longest
   common part to the left.
3. *Extend.* From each pair of neighbours the match is extended to the left and to the right; from
   LENGTH words on it is a span in the document.
   Neighbours in other partitions are met in a second pass over the first and last rows of each.
4. *Rest.* A suffix isn't settled if its longest parts to the left and to the right come from different
   neighbours and their spans leave a gap. Its windows of LENGTH words in the gap are compared with
   those of all suffixes of its gram, of which equal ones go on once a task, so no passage is lost.

Documents of equal word sequences form one class first (128-bit digest), which is extended once; a
class of several documents repeats as a whole. No pair of documents is ever formed, so a passage in n
documents costs n rows. Keys with many rows are joined where the rows are.

Defined results: null, empty and short texts (under LENGTH words) repeat nothing; repeated rows are
copies of each other; a repeat within one document alone doesn't count, however long the text;
documents without a repeated passage are not returned, so an empty table gives an empty one; rows
with a null doc_id are documents like others; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import wordspans as ws
from .tables import Scratch, identified, join_by, repeats, texts_of, written

LENGTH = 50
PREFIX = 25
#: Places that a window of LENGTH words can start before its minimiser.
REACH = LENGTH - PREFIX
_SEEN = 1 << 20
_SLICE = 10_000
_SPAN = "struct<start:int,end:int>"


def minimisers(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes of the PREFIX-word grams) of the sampled suffixes of one text."""
    g = ws.gram_hashes(h, PREFIX)
    width = REACH + 1
    if len(g) < width:
        return np.zeros(0, np.int64), g[:0]
    windows = np.lib.stride_tricks.sliding_window_view(g, width)
    at = ws.distinct(np.arange(len(windows)) + windows.argmin(axis=1))
    return at, g[at]


def _texts(column: pa.Array) -> Iterator[np.ndarray]:
    """Word hashes of each text."""
    for a, b, data, offsets in ws.slabs(column):
        data = ws.LOWER[data]
        s, e, first = ws.words(data, offsets, ws.ALNUM)
        h = ws.word_hashes(data, s, e)
        for i in range(b - a):
            yield h[first[i] : first[i + 1]]


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[bytes] = set()
    for batch in batches:
        sizes, digests, places, keys = [], [], [], []
        for h in _texts(batch.column("text")):
            sizes.append(len(h))
            at, key = np.zeros(0, np.int64), np.zeros(0, np.uint64)
            digest = None
            if len(h) >= LENGTH:
                digest = hashlib.blake2b(h.tobytes(), digest_size=16).digest()
                if digest not in seen:  # a copy in the same task adds nothing
                    at, key = minimisers(h)
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(digest)
            digests.append(digest)
            places.append(at)
            keys.append(key)
        if sizes:
            ends = np.cumsum([0, *map(len, places)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("h"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), ws.lists(np.concatenate(places), ends, pa.int32()), ws.lists(np.concatenate(keys).view(np.int64), ends, pa.int64())],
                names=["doc_id", "h", "n_words", "class", "places", "keys"],
            )


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words before (the nearest first) and after each anchor, as hashes; zeros beyond the text."""
    for batch in batches:
        anchors = batch.column("anchors")
        for k, h in enumerate(_texts(batch.column("text"))):
            padded = np.concatenate([np.zeros(REACH, np.uint64), h, np.zeros(LENGTH, np.uint64)])
            gram = ws.gram_hashes(h, PREFIX)
            every = np.array(anchors[k].as_py(), dtype=np.int64)
            for x in range(0, len(every), _SLICE):
                at = every[x : x + _SLICE]
                left = padded[at[:, None] + (REACH - 1 - np.arange(REACH))]
                right = padded[at[:, None] + (REACH + np.arange(LENGTH))]
                n = len(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column("class")[k].as_py()] * n, pa.binary()),
                        pa.array(at, pa.int32()),
                        pa.array(gram[at].view(np.int64)),
                        ws.binaries(left),
                        ws.binaries(right),
                        pa.array(np.minimum(at, REACH), pa.int32()),
                        pa.array(np.minimum(len(h) - at, LENGTH), pa.int32()),
                    ],
                    names=["class", "place", "gram", "left", "right", "n_left", "n_right"],
                )


def _bits(least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Numbers with the bits least..most set; 0 where most is smaller."""
    one = np.int64(1)
    return np.where(most >= least, (one << (np.maximum(most, 0) + 1)) - (one << np.maximum(least, 0)), 0)


def _common(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows, at most ``most``."""
    differ = a != b
    return np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1]), most)


class Suffixes:
    """Sorted suffixes: rows as arrays."""

    NAMES = ("class", "place", "gram", "left", "right", "n_left", "n_right")

    def __init__(self, columns: dict[str, np.ndarray]):
        self.c = columns
        self.n = len(columns["place"])

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Suffixes:
        wide = {"class": 2, "left": REACH, "right": LENGTH}
        return cls({k: ws.matrix(batch.column(k), wide[k]) if k in wide else batch.column(k).to_numpy(zero_copy_only=False) for k in cls.NAMES})

    def part(self, a: int, b: int) -> Suffixes:
        return Suffixes({k: v[a:b] for k, v in self.c.items()})

    def __add__(self, other: Suffixes) -> Suffixes:
        return Suffixes({k: np.concatenate([v, other.c[k]]) for k, v in self.c.items()})

    def runs(self) -> np.ndarray:
        """Where runs of one class begin."""
        x = self.c["class"]
        return np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]).any(axis=1)])[: self.n])

    def match(self, at: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words equal to the left, to the right) of rows and their partners; none where the gram isn't equal."""
        c = self.c
        right = _common(c["right"][at], c["right"][other], np.minimum(c["n_right"][at], c["n_right"][other]))
        left = _common(c["left"][at], c["left"][other], np.minimum(c["n_left"][at], c["n_left"][other]))
        same = right >= PREFIX
        return np.where(same, left, 0).astype(np.int64), np.where(same, right, 0).astype(np.int64)

    def settled(self, a: int, b: int, turn: int = 0, *ends: int) -> pa.RecordBatch:
        """What rows a..b have in common with the nearest rows of another class; unknown where there is none in sight.

        turn: of the first row. Rows that aren't known, and those at ``ends``, have theirs and their words.
        """
        start = self.runs()
        run = np.searchsorted(start, np.arange(a, b), "right") - 1
        before = start[run] - 1
        after = np.append(start, self.n)[run + 1]
        at = np.arange(a, b)
        mask, most_left, most_right = (np.zeros(b - a, np.int64) for _ in range(3))
        known = np.ones(b - a, bool)
        for other, there in ((before, before >= 0), (after, after < self.n)):
            left, right = self.match(at, np.clip(other, 0, self.n - 1))
            left, right = np.where(there, left, 0), np.where(there, right, 0)
            mask |= np.where(left + right >= LENGTH, _bits(LENGTH - right, left), 0)
            most_left, most_right = np.maximum(most_left, left), np.maximum(most_right, right)
            known &= there
        if b <= a:
            return pa.RecordBatch.from_pylist([], schema=_SETTLED)
        passed = ~known | np.isin(at, ends)
        there = np.flatnonzero(passed)
        which = pa.array(np.where(passed, np.cumsum(passed) - 1, 0), mask=~passed)
        further = [pa.array(turn + at[there]), *(ws.binaries(self.c[k][at[there]]) for k in ("left", "right")), *(pa.array(self.c[k][at[there]], pa.int32()) for k in ("n_left", "n_right"))]
        return pa.RecordBatch.from_arrays(
            [ws.binaries(self.c["class"][a:b]), pa.array(self.c["place"][a:b], pa.int32()), pa.array(self.c["gram"][a:b]), pa.array(mask), pa.array(most_left), pa.array(most_right), pa.array(known), *(c.cast(_SETTLED.field(n).type).take(which) for n, c in zip(_FURTHER, further, strict=True))],
            schema=_SETTLED,
        )


_FURTHER = ["turn", "left", "right", "n_left", "n_right"]
_SETTLED = pa.schema([("class", pa.binary()), ("place", pa.int32()), ("gram", pa.int64()), ("mask", pa.int64()), ("most_left", pa.int64()), ("most_right", pa.int64()), ("known", pa.bool_())] + list(zip(_FURTHER, (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32()), strict=True)))
#: Bits of a row's turn below its partition's number, and below its order's.
_ROWS, _PARTS = 36, 58


def _neighbours(batches: Iterator[pa.RecordBatch], order: int = 0) -> Iterator[pa.RecordBatch]:
    """Compares each row of a sorted partition with the nearest rows of other classes before and after it.

    Rows of the first and the last run, which may have nearer ones in other partitions, and the row after and before these
    runs are passed on with their turn in the whole order.
    """
    task = TaskContext.get()
    turn = (order << _PARTS) + ((task.partitionId() if task else 0) << _ROWS)  # of the first row that is held
    held, done, second = None, 0, -1  # rows from the last of the run before the last two on; so many of them are settled; where the second run begins
    for batch in batches:
        if not batch.num_rows:
            continue
        new = Suffixes.of(batch)
        rows = held + new if held is not None else new
        start = rows.runs()
        if second < 0 and len(start) > 1:
            second = turn + int(start[1])
        upto = int(start[-1]) - 1
        if upto > done:
            yield rows.settled(done, upto, turn, second - turn)
            done = upto
        keep = max(int(start[-2]) - 1, 0) if len(start) > 1 else 0
        held, done, turn = rows.part(keep, rows.n), done - keep, turn + keep
    if held is not None:
        yield held.settled(done, held.n, turn, second - turn, int(held.runs()[-1]) - 1)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_neighbours`` of the rows that the partitions passed on, in their order: what isn't in sight here isn't there."""
    for batch in _neighbours(batches):
        yield batch.set_column(batch.schema.get_field_index("known"), "known", pa.array(np.ones(batch.num_rows, bool)))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The 128-bit digests of the windows of LENGTH words that start so many places before an anchor as ``bits`` has bits set.

    Windows that are open have their start. The others are there to be met: of equal ones, two classes are enough.
    """
    for batch in batches:
        for x in range(0, batch.num_rows, _SLICE):
            rows = batch.slice(x, _SLICE)
            c, asked, opened = Suffixes.of(rows).c, rows.column("bits").to_numpy(), rows.column("open").to_numpy()
            words, own = np.concatenate([c["left"][:, ::-1], c["right"]], axis=1), rows.column("class").to_pylist()
            names, starts, digests = [], [], []
            met: dict[bytes, tuple[bytes, bytes]] = {}
            for back in range(REACH + 1):
                good = np.flatnonzero((c["n_left"] >= back) & (c["n_right"] >= LENGTH - back) & (asked >> back & 1 == 1))
                window = np.ascontiguousarray(words[good, REACH - back : REACH - back + LENGTH])
                for k, is_open, w in zip(good.tolist(), (opened[good] >> back & 1 == 1).tolist(), window, strict=True):
                    digest = hashlib.blake2b(w, digest_size=16).digest()
                    if is_open:
                        names.append(own[k])
                        starts.append(int(c["place"][k]) - back)
                        digests.append(digest)
                    else:
                        least, most = met.get(digest, (own[k], own[k]))
                        met[digest] = min(least, own[k]), max(most, own[k])
            for digest, both in met.items():
                for name in set(both):
                    names.append(name)
                    starts.append(None)
                    digests.append(digest)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(starts, pa.int32()), pa.array(digests, pa.binary())], names=["class", "start", "window"])


def _sharing(rows: DataFrame, key: str, scratch: Scratch, asked: str = "true") -> DataFrame:
    """Rows, of those asked for, whose keys stand in two classes or more."""
    meets = scratch.write(rows.groupBy(key).agg(F.min("class").alias("_x"), F.max("class").alias("_y"), F.count_if(F.expr(asked)).alias("n")).where("_x <> _y and n > 0").select(key, "n"))
    return join_by(rows.where(asked), meets, key, how="left_semi")


def merged(hits: DataFrame) -> DataFrame:
    """class, spans: the spans of each class (rows class, spans), sorted and joined where they touch.

    Spans are sorted as rows: a class may have as many of them as words, too many to compare in an array.
    """
    each = hits.select("class", F.explode("spans").alias("s")).select("class", "s.start", "s.end").repartition("class")
    each = each.groupBy("class", "start").agg(F.max("end").alias("end"))
    by = W.partitionBy("class").orderBy("start")
    before = F.max("end").over(by.rowsBetween(W.unboundedPreceding, -1))
    each = each.withColumn("new", F.when(before >= F.col("start"), 0).otherwise(1)).withColumn("part", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    whole = each.groupBy("class", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return whole.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("start", "end").cast(_SPAN))).alias("spans"))


def _spans(mask: Column, place: Column) -> Column:
    """Spans of the windows that start so many places before the anchor as the mask has bits set."""

    def span(first: Column, last: Column) -> Column:
        return F.struct((place - first).cast("int").alias("start"), (place - last + LENGTH).cast("int").alias("end")).cast(_SPAN)

    bits = F.transform(F.array(*(F.lit(i) for i in range(REACH + 1))), lambda i: F.when(F.getbit(mask, i) == 1, i))
    bits = F.array_compact(bits)
    whole = F.array_max(bits) - F.array_min(bits) + 1 == F.size(bits)
    return F.when(whole, F.array(span(F.array_max(bits), F.array_min(bits)))).otherwise(F.transform(bits, lambda i: span(i, i)))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_repeated (words in repeated passages), n_copies and spans (word offsets, end exclusive).

    Only documents with a repeated passage are returned.
    """
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    base = written(ws.mapped(identified(docs), _sample, f"doc_id {kind}, h long, n_words long, class binary, places array<int>, keys array<long>"))
    scratch = Scratch()
    classes = scratch.write(base.where("class is not null").groupBy("class").agg(F.min(F.struct("doc_id", "h")).alias("rep"), F.max("n_words").alias("n_words"), F.count("*").alias("n_copies")))
    suffixes = base.select("class", F.explode(F.arrays_zip("places", "keys")).alias("s")).select("class", F.col("s.places").alias("place"), F.col("s.keys").alias("key"))
    anchors = _sharing(suffixes, "key", scratch).groupBy("class").agg(F.collect_set("place").alias("anchors"))
    anchors = scratch.write(anchors.join(classes.select("class", "rep.*"), "class"))

    # The sparse suffix array, in two orders.
    texts = texts_of(docs, anchors, repeats(base))
    met = texts.alias("t").join(anchors.alias("a"), F.col("t.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("t.h") == F.col("a.h")))
    met = met.select("class", "text", F.sort_array("anchors").alias("anchors"))
    contexts = scratch.write(ws.mapped(met, _contexts, "class binary, place int, gram long, left binary, right binary, n_left int, n_right int"))
    settled = "class binary, place int, gram long, mask long, most_left long, most_right long, known boolean, turn long, left binary, right binary, n_left int, n_right int"

    def compared(order: int, *by: str) -> DataFrame:
        return ws.mapped(contexts.repartitionByRange(*map(F.expr, by)).sortWithinPartitions(*map(F.expr, by)), functools.partial(_neighbours, order=order), settled)

    both = scratch.write(compared(0, "right", "left", "class", "place").unionByName(compared(1, f"substring(right, 1, {8 * PREFIX})", "left", "right", "class", "place")))
    # A few rows from each partition.
    ends = both.where("turn is not null").select("turn", *Suffixes.NAMES).repartition(1).sortWithinPartitions("turn")
    both = both.where("known").unionByName(ws.mapped(ends.select(*Suffixes.NAMES), _across, settled))
    found = both.groupBy("class", "place").agg(F.first("gram").alias("gram"), F.bit_or("mask").alias("mask"), F.max("most_left").alias("l"), F.max("most_right").alias("r"))
    # Windows that could still be equal to another's: as far as the longest parts reach.
    reached = F.expr(f"if(l + r >= {LENGTH}, shiftleft(1L, cast(l as int) + 1) - shiftleft(1L, cast(greatest({LENGTH} - r, 0L) as int)), 0L)")
    found = scratch.write(found.withColumn("open", reached.bitwiseAND(F.bitwise_not("mask"))))
    hits = found.where("mask <> 0").select("class", _spans(F.col("mask"), F.col("place")).alias("spans"))

    # What isn't settled is compared window by window.
    rest = scratch.write(found.groupBy("gram").agg(F.bit_or("open").alias("bits"), F.count("*").alias("n")).where("bits <> 0"))
    if not rest.isEmpty():
        asked = join_by(contexts, rest, "gram").join(found.where("open <> 0").select("class", "place", "open"), ["class", "place"], "left").fillna(0, ["open"])
        windows = scratch.write(ws.mapped(asked, _windows, "class binary, start int, window binary"))
        one = F.struct(F.col("start"), (F.col("start") + LENGTH).alias("end")).cast(_SPAN)
        hits = hits.unionByName(_sharing(windows, "window", scratch, "start is not null").select("class", F.array(one).alias("spans")))
    spans = merged(hits)

    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")).cast(_SPAN))
    out = classes.join(spans, "class", "left").withColumn("spans", F.when(F.col("n_copies") > 1, whole).otherwise(F.col("spans"))).where("spans is not null")
    out = written(out.select("class", "n_copies", "spans", F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["start"]).alias("n_repeated")))
    scratch.clear()
    return join_by(base.select("doc_id", "n_words", "class"), out, "class", "n_copies").select("doc_id", "n_words", "n_repeated", "n_copies", "spans")
