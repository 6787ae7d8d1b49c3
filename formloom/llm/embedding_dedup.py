r"""Near-duplicate vectors by cosine: spherical k-means cells, blocked products within them, one vector kept of each group.

1. Centroids are fitted by Lloyd's rounds over a sample of ``SAMPLE`` vectors (each round sums in the tasks), about the
   square root of the number of vectors of them, ``MAX_CELLS`` at most. Centroids nearer than ``APART`` are one: no
   crowd of near copies is dealt over several cells.
2. Every vector is at home in the cell of its nearest centroid, and visits each cell of a lower number whose centroid is
   nearly as near: by ``MARGIN`` times the distance of the two centroids at most. A pair is looked for in the lower of
   its home cells, so it counts once. A margin of sqrt(2 - 2 * least) finds every pair for certain, as a vector can't be
   farther from the plane between two cells than from its neighbour beyond it; the smaller default leans on noise that
   has no common direction. The README has the measured recall.
3. A cell's vectors meet in blocks of ``BLOCK`` rows, a pair of blocks a group, so no cell is one task. Vectors within
   half the angle of their centroid are all linked with each other by the triangle inequality and are counted, not
   multiplied: a cell of a third of all rows, near copies of one vector, costs as much as its other rows.
4. A pair of blocks passes on counts and a spanning forest of its links, never the pairs; connected components follow.

Cosines are in double precision over vectors scaled by their largest component. Defined results: a vector that is null,
empty or zero, or holds a null or non-finite component, links with nothing, nor do vectors of different lengths; repeated
rows are vectors of their own; component_id is the smallest vec_id of the component, null ids last; a row without id is
kept if it has no links with a row that has one; an empty table gives an empty one; further columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordspans as ws
from .components import components
from .tables import Scratch, join_by

LEAST = 0.95
#: Vectors that centroids are fitted on, at most, and a round's number.
SAMPLE = 65_536
ROUNDS = 6
MAX_CELLS = 2_048
APART = 0.8
MARGIN = 0.1
BLOCK = 1_024
#: Rows of a product at a time.
STRIP = 512
CORE, OWN, VISIT = 0, 1, 2


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat components, nulls as NaN; ends; lengths, 0 for null) of a column of lists."""
    if pa.types.is_fixed_size_list(column.type):
        column = column.cast(pa.list_(column.type.value_type))
    sizes = np.array(column.value_lengths().fill_null(0))
    flat = column.flatten()
    values = flat.to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0)
    return values, np.cumsum(sizes), sizes


def packed(vectors: DataFrame) -> DataFrame:
    """vec_id, size, raw: the components' bytes, null where the vector links with nothing; floats stay floats."""
    kind = np.dtype(np.float32 if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, ends, sizes = _numbers(batch.column("embedding"))
            values = values.astype(kind)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            some = np.concatenate([[0], np.cumsum(values != 0)])
            starts = ends - sizes
            fine = (bad[ends] == bad[starts]) & (some[ends] > some[starts])
            raw = values.tobytes()
            cut = [raw[a:b] if ok else None for a, b, ok in zip((starts * kind.itemsize).tolist(), (ends * kind.itemsize).tolist(), fine.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(sizes, pa.int32()), pa.array(cut, pa.binary())], names=["vec_id", "size", "raw"])

    return ws.mapped(vectors.select("vec_id", "embedding"), run, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, size int, raw binary")


def units(raw: pa.Array, kind: np.dtype) -> np.ndarray:
    """Unit vectors, in double precision, of a column of packed vectors of one length."""
    rows = raw.to_pylist()
    x = np.frombuffer(b"".join(rows), dtype=kind).reshape(len(rows), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _merged(centroids: np.ndarray, most: int) -> np.ndarray:
    """At most so many of the centroids, in order, without those near an earlier one."""
    kept = np.zeros((0, centroids.shape[1]))
    for c in centroids:
        if len(kept) < most and not (kept @ c > APART).any():
            kept = np.vstack([kept, c])
    return kept


def fit(points: DataFrame, kind: np.dtype, n: int) -> np.ndarray:
    """Centroids (rows, unit length) of packed vectors of one length; n: how many there are."""
    cells = min(MAX_CELLS, max(1, math.isqrt(n)))
    share = min(1.0, SAMPLE / n)
    scratch = Scratch()
    draw = F.pmod(F.xxhash64("row"), F.lit(1 << 30))
    sample = scratch.write(points.where(draw < int(share * (1 << 30)) + 1).select("row", "raw").repartition(8))
    first = sample.orderBy(F.xxhash64("row"), "row").limit(4 * cells).toArrow().column("raw").combine_chunks()
    centroids = _merged(units(first, kind), cells)

    for _ in range(ROUNDS):

        def summed(batches: Iterator[pa.RecordBatch], now: np.ndarray = centroids) -> Iterator[pa.RecordBatch]:
            sums = np.zeros_like(now)
            for batch in batches:
                if len(batch):
                    x = units(batch.column("raw"), kind)
                    np.add.at(sums, (x @ now.T).argmax(axis=1), x)
            yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])

        parts = ws.mapped(sample.select("raw"), summed, "sums binary").collect()
        sums = sum(np.frombuffer(r["sums"]).reshape(centroids.shape) for r in parts)
        size = np.sqrt((sums * sums).sum(axis=1))
        centroids = sums[size > 0] / size[size > 0, None]
    scratch.clear()
    return _merged(centroids, cells)


def _placed(points: DataFrame, kind: np.dtype, centroids: np.ndarray, offset: int, least: float, margin: float, raw: bool) -> DataFrame:
    """row, cell, role (and raw) of each vector: at home, or a visitor of cells of lower numbers."""
    apart = margin * np.sqrt(np.maximum(2 - 2 * centroids @ centroids.T, 0))
    core = math.cos(math.acos(least) / 2) + 1e-9
    names = ["row", "cell", "role"] + ["raw"] * raw

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, len(whole), STRIP):
                batch = whole.slice(k, STRIP)
                near = units(batch.column("raw"), kind) @ centroids.T
                home = near.argmax(axis=1)
                top = near[np.arange(len(near)), home]
                visits = (top[:, None] - near <= apart[home]) & (np.arange(len(centroids)) < home[:, None])
                who, where = np.nonzero(visits)
                at = np.concatenate([np.arange(len(near)), who])
                cell = np.concatenate([home, where]) + offset
                role = np.concatenate([np.where(top >= core, CORE, OWN), np.full(len(who), VISIT)])
                columns = [batch.column("row").take(pa.array(at)), pa.array(cell, pa.int64()), pa.array(role, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns + [batch.column("raw").take(pa.array(at))] * raw, names=names)

    return ws.mapped(points.select("row", "raw"), run, "row long, cell long, role int" + ", raw binary" * raw)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n places reaches by the links (a, b)."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        label = label[label]
        if np.array_equal(label, before):
            return label


def _compared(blocks: DataFrame, kind: np.dtype, least: float) -> DataFrame:
    """row, links, other: links of each row within a pair of blocks, and a row that they connect it with."""

    def run(table: pa.Table) -> pa.Table:
        rows, side, role = (table.column(c).to_numpy() for c in ("row", "side", "role"))
        x = units(table.column("raw").combine_chunks(), kind)
        left, right = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
        found = []
        for k in range(0, len(left), STRIP):
            strip = left[k : k + STRIP]
            i, j = np.nonzero(x[strip] @ x[right].T >= least)
            i, j = strip[i], right[j]
            # A pair of two rows that are both on both sides counts from the one of the smaller number.
            once = (role[i] != OWN) | (role[j] != OWN) | (rows[i] < rows[j])
            found.append((i[once], j[once]))
        a, b = (np.concatenate([f[s] for f in found]) if found else np.zeros(0, np.int64) for s in (0, 1))
        links = np.bincount(a, minlength=len(rows)) + np.bincount(b, minlength=len(rows))
        label = _forest(len(rows), a, b)
        some = np.flatnonzero(links)
        return pa.table({"row": rows[some], "links": links[some], "other": rows[label[some]]}, pa.schema([("row", pa.int64()), ("links", pa.int64()), ("other", pa.int64())]))

    return blocks.groupBy("cell", "i", "j").applyInArrow(run, "row long, links long, other long")


def _links(points: DataFrame, kind: np.dtype, centroids: np.ndarray, offset: int, least: float, margin: float) -> DataFrame:
    """row, links, other over all cells of vectors of one length, in parts."""
    spark = points.sparkSession
    own = F.col("role") != VISIT
    sizes = _placed(points, kind, centroids, offset, least, margin, raw=False).groupBy("cell").agg(
        F.sum(own.cast("long")).alias("left"),
        F.sum((F.col("role") != CORE).cast("long")).alias("right"),
        F.sum((F.col("role") == CORE).cast("long")).alias("core"),
        F.min(F.when(F.col("role") == CORE, F.col("row"))).alias("first"),
    )
    # A row for each cell, MAX_CELLS at most.
    sizes = spark.createDataFrame(sizes.collect(), "cell long, left long, right long, core long, first long")
    blocks = sizes.select("cell", F.ceil(F.col("left") / BLOCK).cast("int").alias("n_left"), F.ceil(F.col("right") / BLOCK).cast("int").alias("n_right"))
    placed = _placed(points, kind, centroids, offset, least, margin, raw=True).join(F.broadcast(blocks), "cell").where("n_left > 0 and n_right > 0")
    placed = placed.withColumns({"l": F.pmod(F.xxhash64("row"), "n_left").cast("int"), "r": F.pmod(F.xxhash64("row", F.lit(1)), "n_right").cast("int")})
    as_left = F.expr(f"transform(sequence(0, n_right - 1), j -> struct(l as i, j as j, if(role = {OWN} and j = r, 3, 1) as side))")
    as_right = F.expr(f"transform(filter(sequence(0, n_left - 1), i -> role = {VISIT} or i <> l), i -> struct(i as i, r as j, 2 as side))")
    at = F.when(F.col("role") == CORE, as_left).when(F.col("role") == OWN, F.concat(as_left, as_right)).otherwise(as_right)
    dealt = placed.select("cell", "row", "role", "raw", F.explode(at).alias("at")).select("cell", "row", "role", "raw", "at.i", "at.j", "at.side")
    core = _placed(points, kind, centroids, offset, least, margin, raw=False).where(F.col("role") == CORE).join(F.broadcast(sizes), "cell")
    core = core.where("core > 1").select("row", (F.col("core") - 1).alias("links"), F.col("first").alias("other"))
    return _compared(dealt, kind, least).unionByName(core)


def near_duplicates(vectors: DataFrame, least: float = LEAST, margin: float = MARGIN) -> DataFrame:
    """vec_id, n_links (other vectors at this cosine at least), component_id, kept (vec_id = component_id) of every vector."""
    kind = np.dtype(np.float32 if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64)
    scratch = Scratch()
    points = scratch.write(packed(vectors).withColumn("row", F.monotonically_increasing_id()))
    offset, links = 0, None
    # Vectors of one model have one length; each length has its cells.
    for size, n in sorted(tuple(r) for r in points.where("raw is not null").groupBy("size").count().collect()):
        own = points.where((F.col("size") == size) & F.col("raw").isNotNull())
        centroids = fit(own, kind, n)
        found = _links(own, kind, centroids, offset, least, margin)
        links = found if links is None else links.unionByName(found)
        offset += len(centroids)
    if links is None:
        return points.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links = scratch.write(links)
    counts = links.groupBy("row").agg(F.sum("links").alias("n_links"))
    label = components(links.select(F.col("row").alias("a"), F.col("other").alias("b"))).toDF("row", "component")
    linked = scratch.write(counts.join(label, "row").join(points.select("row", "vec_id"), "row"))
    least_id = scratch.write(linked.groupBy("component").agg(F.min("vec_id").alias("component_id"), F.count("*").alias("n")))
    named = join_by(linked, least_id, "component").select("row", "n_links", "component_id")
    out = points.select("row", "vec_id").join(named, "row", "left")
    found = F.col("n_links").isNotNull()
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(found, F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
