r"""N-gram Jaccard join through parity sketches.

Every document is the set of its distinct 3-word shingles. Two documents link when
100 * |A and B| >= 90 * |A or B|.

1. *Classes.* Documents of equal sets form one class (128-bit digest of the sorted set). Only classes
   go on; copies never meet as pairs. Half of the digest is a class's label while candidates are
   sought; should two classes share a label, both are verified.
2. *Parity sketches.* A set is XOR-hashed into a bit sketch: each shingle flips one bit. The Hamming
   distance of two sketches is at most the symmetric difference of the sets, and linked sets with at
   most M shingles each differ in at most D = 2M/19 shingles. Sets are put in size bands so wide that
   linked sets lie in one band or two that touch; a band's sketch has D + 1 + spare blocks of 64 bits,
   and every set is sketched for its own band and the next one.
3. *Pigeonhole join.* Linked sets agree in 1 + spare blocks at least. Blocks with at most one bit are
   shared by chance, so a set with no more than ``spare`` of them doesn't emit those. The other blocks
   are hashed with band and position, and classes meet that share one. Blocks of a large group of
   near copies, known from a sample of the classes, are gathered where they are, not by a shuffle;
   what is done for each group later is summed before it is shuffled, and joined likewise.
4. *Verify.* In each block's group all are compared with the group's hub, the class that meets most
   others, exactly, on the whole texts (after size and a 1024-bit sketch rule out what they can). Then
   pairs are compared that the links so far leave in different components, if size and sketch allow a
   link: first in a sixteenth of the groups, then in all. So no link between components is lost, and a
   group of near copies costs a star and what the star leaves rather than all its pairs.
5. Components of the links; every document takes the smallest doc_id of its component.

Defined results: null, empty and blank texts have no shingle and link with nothing; a text of one or
two words is one shingle; texts of any length are taken whole; repeated rows are copies of each other;
null doc_ids keep their row and link like others, and a component of null ids only has a null
component_id; of hubs with equally many meetings the largest label is taken; an empty table gives an
empty one; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import wordspans as ws
from .columns import carrying
from .components import components
from .tables import Scratch, by_identity, discard, identified, is_one_of, join_by, repeats, texts_of, written

SHINGLE = 3
NEED, OF = 90, 100
SKETCH_WORDS = 16
#: Shares (one in ...) of the groups in which pairs across components are sought, in turn; the last is all.
PASSES = (16, 1)
#: One class in so many is sampled for blocks that more than one in HOT_BLOCK of them share, at most HOT_KEYS: where rows go, not which.
HOT_SAMPLE, HOT_BLOCK, HOT_KEYS = 16, 100, 2_000
_SEEN = 1 << 20
_EDGES = [1]
while _EDGES[-1] < 1 << 40:
    _EDGES.append(_EDGES[-1] * OF // NEED + 1)
EDGES = np.array(_EDGES, dtype=np.int64)


def differ(size: int) -> int:
    """Most shingles by which two linked sets of at most ``size`` shingles can differ."""
    return 2 * size * (OF - NEED) // (OF + NEED)


def layout(band: int) -> tuple[int, int]:
    """(blocks, spare blocks) of a band's sketches; no block where linked sets must be equal."""
    most = differ(int(EDGES[band + 1]) - 1)
    spare = min(2, most // 4)
    return (most + 1 + spare if most else 0), spare


def sketch(shingles: np.ndarray, blocks: int) -> np.ndarray:
    """Parity sketch of ``blocks`` words of 64 bits."""
    block = ((shingles >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    bit = (block << np.uint64(6) | shingles & np.uint64(63)).astype(np.int64)
    parity = (np.bincount(bit, minlength=64 * blocks) & 1).astype(np.uint8)
    return np.packbits(parity, bitorder="little").view(np.uint64)


def block_keys(shingles: np.ndarray) -> np.ndarray:
    """Hashes of the blocks by which this set can meet the sets it links with."""
    own = int(np.searchsorted(EDGES, len(shingles), "right")) - 1
    keys = []
    for band in (own, own + 1):
        blocks, spare = layout(band)
        if blocks:
            value = sketch(shingles, blocks)
            place = np.arange(blocks, dtype=np.uint64)
            poor = np.bitwise_count(value) <= 1
            if poor.sum() <= spare:
                value, place = value[~poor], place[~poor]
            keys.append(ws.mix(value ^ ws.mix(place + np.uint64(band << 32))))
    return np.concatenate([*keys, np.zeros(0, np.uint64)])


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for a, b, data, offsets in ws.slabs(column):
        data = ws.LOWER[data]
        s, e, first = ws.words(data, offsets, ws.NOT_SPACE)
        h = ws.word_hashes(data, s, e)
        grams = ws.gram_hashes(h, SHINGLE) if len(h) >= SHINGLE else h[:0]
        for i in range(b - a):
            x, y = int(first[i]), int(first[i + 1])
            if y - x >= SHINGLE:
                yield ws.distinct(grams[x : y - SHINGLE + 1])
            else:
                yield ws.mix(ws.gram_hashes(h[x:y], y - x) + np.uint64(y - x)) if y > x else h[:0]


def set_id(shingles: np.ndarray) -> bytes | None:
    """128-bit digest of a sorted set; none for the empty set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[bytes] = set()
    for batch in batches:
        sizes, digests, small, keys = [], [], [], []
        for x in shingle_sets(batch.column("text")):
            sizes.append(len(x))
            digest = set_id(x)
            digests.append(digest)
            fresh = digest is not None and digest not in seen  # a copy in the same task adds no keys
            keys.append(block_keys(x).view(np.int64) if fresh else np.zeros(0, np.int64))
            small.append(sketch(x, SKETCH_WORDS) if fresh else np.zeros(SKETCH_WORDS, np.uint64))
            if len(seen) >= _SEEN:
                seen.clear()
            seen.add(digest)
        if sizes:
            ends = np.cumsum([0, *map(len, keys)])
            label = [int.from_bytes(d[:8], "little", signed=True) if d else None for d in digests]
            columns = [pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(label, pa.int64()), ws.lists(np.concatenate(small).view(np.int64), np.arange(len(sizes) + 1) * SKETCH_WORDS, pa.int64()), ws.lists(np.concatenate(keys), ends, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), *columns], names=["doc_id", "h", "n", "set_id", "label", "sketch", "keys"])


def _linking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose texts ta and tb link."""
    last: tuple[bytes, np.ndarray] | None = None
    for batch in batches:
        kept = []
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            names = part.column("a").to_pylist()
            for i, y in enumerate(shingle_sets(part.column("tb"))):
                if last is None or last[0] != names[i]:  # rows of one hub come one after the other
                    last = names[i], next(shingle_sets(part.column("ta").slice(i, 1)))
                x = last[1]
                both = len(x) + len(y) - len(ws.distinct(np.concatenate([x, y])))
                if both * OF >= (len(x) + len(y) - both) * NEED:
                    kept.append(at + i)
        yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(kept, pa.int64())) for c in ("a", "b")], names=["a", "b"])


def _apart(a: str, b: str) -> Column:
    """Bits in which two sketches differ."""
    each = [F.bit_count(F.element_at(a, i + 1).bitwiseXOR(F.element_at(b, i + 1))) for i in range(SKETCH_WORDS)]
    return sum(each[1:], each[0])


def _may_link(na: str, nb: str, apart: Column) -> Column:
    size = F.greatest(na, nb) * NEED <= F.least(na, nb) * OF
    return size & (apart * (OF + NEED) <= (F.col(na) + F.col(nb)) * (OF - NEED))


def _verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, repeated: bool, scratch: Scratch) -> DataFrame:
    """The links (a, b of set_ids) among pairs of labels, compared on whole texts."""
    c = classes.select("label", "set_id", "n", "sketch", "rep")
    met = pairs.join(c.toDF("a", "ia", "na", "sa", "ra"), "a").join(c.toDF("b", "ib", "nb", "sb", "rb"), "b")
    met = written(met.where(_may_link("na", "nb", _apart("sa", "sb"))).select(F.col("ia").alias("a"), F.col("ib").alias("b"), "ra", "rb"))
    ids = met.select(F.explode(F.array("ra", "rb")).alias("r")).select("r.*").distinct()
    texts = written(texts_of(docs, ids, repeated))

    def beside(rows: DataFrame, rep: str, name: str) -> DataFrame:
        t = texts.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), F.col("text").alias(name))
        return rows.join(t, F.col(f"{rep}.doc_id").eqNullSafe(F.col("_id")) & (F.col(f"{rep}.h") == F.col("_h"))).drop("_id", "_h", rep)

    out = scratch.write(ws.mapped(beside(beside(met, "rb", "tb"), "ra", "ta").select("a", "b", "ta", "tb"), _linking, "a binary, b binary"))
    discard(met, texts)
    return out


def _across(shared: DataFrame, label: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs of labels (a < b) of the groups that lie in different components and may link by size and sketch."""
    named = classes.select("label", "set_id", "n", "sketch").join(label.toDF("set_id", "component"), "set_id", "left").select("label", "n", "sketch", F.coalesce("component", "set_id").alias("c"))
    rows = shared.join(named.select("label", "c"), "label")
    split = scratch.write(rows.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.count("*").alias("m")).where("x < y").select("key", "m"))
    words = [F.element_at("sketch", i + 1).alias(f"s{i}") for i in range(SKETCH_WORDS)]
    left = scratch.write(join_by(shared, split, "key", "m", "left_semi").join(named.select("label", "n", "c", *words), "label"))
    x, y = left.alias("x"), left.alias("y")
    apart = sum((F.bit_count(F.col(f"x.s{i}").bitwiseXOR(F.col(f"y.s{i}"))) for i in range(1, SKETCH_WORDS)), F.bit_count(F.col("x.s0").bitwiseXOR(F.col("y.s0"))))
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.label") < F.col("y.label")) & (F.col("x.c") != F.col("y.c")) & _may_link("x.n", "y.n", apart))
    return met.select(F.col("x.label").alias("a"), F.col("y.label").alias("b")).distinct()


def _shared(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """key, label: the blocks that two classes share."""
    rows = classes.select("label", F.explode("keys").alias("key"))
    some = rows.where(F.pmod("label", F.lit(HOT_SAMPLE)) == 0)
    n = classes.where(F.pmod("label", F.lit(HOT_SAMPLE)) == 0).count()
    often = some.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > max(8, n // HOT_BLOCK))
    # Further ones are shuffled like the rest.
    hot = [r["key"] for r in often.orderBy(F.desc("n"), "key").limit(HOT_KEYS).collect()]
    meet = W.partitionBy("key")
    cold = rows.where(~is_one_of("key", hot)).select("key", "label", F.min("label").over(meet).alias("first"), F.max("label").over(meet).alias("last")).where("first < last").select("key", "label")
    return scratch.write(cold.unionByName(rows.where(is_one_of("key", hot)).select("key", "label")) if hot else cold)


def _linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, n, set_id of every row; set_id, component, rep and copies of every class)."""
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = written(ws.mapped(identified(docs), _describe, f"doc_id {kind}, h long, n long, set_id binary, label long, sketch array<long>, keys array<long>"))
    # Rows without an id come last, so that they stand for a class of null ids only; a class's first copy in a task has its keys.
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h"))
    full = F.max(F.struct(F.size("keys").alias("size"), "sketch", "keys"))
    classes = found.where("n > 0").groupBy("set_id").agg(F.first("label").alias("label"), rep.alias("rep"), F.first("n").alias("n"), full.alias("full"), F.count("*").alias("copies"))
    classes = written(classes.select("set_id", "label", F.struct("rep.doc_id", "rep.h").alias("rep"), "n", "full.sketch", "full.keys", "copies"))
    repeated, scratch = repeats(found), Scratch()
    shared = _shared(classes, scratch)
    sizes = scratch.write(shared.groupBy("key").agg(F.count("*").alias("m")))
    # Each group's hub: the class that meets the most, over all its groups.
    meets = join_by(shared, sizes, "key", "m").groupBy("label").agg(F.sum("m").alias("met"))
    hubs = shared.join(meets, "label").groupBy("key").agg(F.max(F.struct("met", "label")).alias("hub"), F.count("*").alias("m")).select("key", F.col("hub.label").alias("hub"), "m")
    tried = join_by(shared, scratch.write(hubs), "key", "m").where("label <> hub").select(F.least("hub", "label").alias("a"), F.greatest("hub", "label").alias("b")).distinct()
    tried = scratch.write(tried)
    links = _verified(docs, tried, classes, repeated, scratch)
    label = components(links)
    for share in PASSES:
        rest = scratch.write(_across(shared.where(F.pmod("key", F.lit(share)) == 0), label, classes, scratch).join(tried, ["a", "b"], "left_anti"))
        if not rest.isEmpty():
            tried = tried.unionByName(rest)
            links = links.unionByName(_verified(docs, rest, classes, repeated, scratch))
            label = components(links)
    every = classes.select("set_id", "rep", "copies").join(label.toDF("set_id", "component"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    every = written(every)
    scratch.clear()
    discard(classes)
    return found.select("doc_id", "h", "n", "set_id"), every


def _least(classes: DataFrame) -> DataFrame:
    """component, first: the row that stands for it, that of the smallest doc_id, null ids last; members: its classes."""
    rep = F.min(F.struct(F.col("rep.doc_id").isNull().alias("none"), F.col("rep.doc_id").alias("doc_id"), F.col("rep.h").alias("h")))
    return classes.groupBy("component").agg(rep.alias("first"), F.count("*").alias("members"))


def link_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    rows, classes = _linked(docs)
    named = written(join_by(classes, written(_least(classes)), "component", "members").select("set_id", F.col("first.doc_id").alias("component_id"), "copies"))
    out = join_by(rows.where("set_id is not null"), named, "set_id", "copies").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(rows.where("set_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


@carrying
def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: one of the smallest doc_id, or without an id where none has one.

    Rows without words link with nothing and all stay. Rows of one doc_id and different texts are told apart.
    """
    rows, classes = _linked(docs)
    least = written(_least(classes))
    # Only rows of components with several rows can go.
    many = written(join_by(classes, least, "component", "members").where("copies > 1 or members > 1").select("set_id", F.col("first.doc_id").alias("_first"), F.col("first.h").alias("_hash"), "copies"))
    member = join_by(rows, many, "set_id", "copies")
    stays = F.col("doc_id").eqNullSafe(F.col("_first")) & (F.col("h") == F.col("_hash"))
    member = written(member.groupBy("doc_id", "h").agg(F.max(stays).alias("stays"), F.count("*").alias("n")))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = by_identity(identified(docs), member.where("not stays or n > 1"), "left_anti")
    again = member.where("stays and n > 1")
    if not again.isEmpty():
        kept = kept.unionByName(by_identity(identified(docs), again, "left_semi").dropDuplicates(["doc_id", "h"]))
    return kept.select(*columns)
