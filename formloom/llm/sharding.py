r"""Sharding by a hierarchical weighted hash tree, in DataFrame expressions only.

A tree has regions, racks and shards. A row descends from the root: at each level every child draws
-log(u) / weight, where u comes from the md5 of the row's key and the child's name, and the least draw
wins. So a child wins in proportion to its weight, and when a weight changes, rows only move between
the child whose weight changed and its siblings: movement stays within the subtrees that changed.

``tree(shards)`` lays the planned shards out in regions of ``RACKS`` racks of ``RACK`` shards; a shard
added later opens a region of its own, with the weight of one shard. Hence the law ``key``: doc_id
and the number of shards decide, and one more shard takes rows only into itself.

Slots are dealt without putting a shard into one task: rows alike in key, size and crc are counted
first and take slots that follow one another; these counts are added up within (shard, bucket), for
``BUCKETS`` hash buckets of key, size and crc, and a table of shards x buckets counts, of a fixed size,
gives each bucket's first slot. Rows alike get their slots ``STEP`` at a time, so no array is longer. So neither a key with a third of all rows nor a shard is one task.

Defined results: equal keys (repeated rows too) share a shard and get slots of their own; a null doc_id
is the key "null"; a null text has 16 bytes and the crc of no bytes; texts of any length count whole;
equal draws go to the child that comes first; an empty table gives an empty one; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import written

SHARDS = 40
RACKS, RACK = 2, 5
BUCKETS = 256
OVERHEAD = 16
#: Equal rows beyond so many are told apart by several tasks, so many at a time.
STEP = 10_000


@dataclass(frozen=True)
class Node:
    name: str
    weight: float
    children: tuple[Node, ...] = ()
    shard: int = -1


def tree(shards: int, planned: int = SHARDS) -> Node:
    """Shards 0..planned-1 by region and rack, each further one in a region of its own."""
    region_size = RACKS * RACK
    groups = [list(range(a, min(a + region_size, planned, shards))) for a in range(0, min(planned, shards), region_size)]
    groups += [[s] for s in range(planned, shards)]
    regions = []
    for own in groups:
        name = f"region{own[0]}"
        racks = []
        for a in range(0, len(own), RACK):
            leaves = tuple(Node(f"shard{s}", 1.0, (), s) for s in own[a : a + RACK])
            racks.append(Node(f"rack{own[a]}", sum(x.weight for x in leaves), leaves))
        regions.append(Node(name, sum(r.weight for r in racks), tuple(racks)))
    return Node("root", sum(r.weight for r in regions), tuple(regions))


def _draw(key: Column, name: Column, weight: Column) -> Column:
    """-log(u) / weight with u in (0, 1) from 52 bits of an md5."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("/"), name).cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(1 << 52))) / weight


def _constant(children: tuple[Node, ...]) -> Column:
    """The nodes below one, as an array: each with those below it."""
    if not children:
        return F.array()
    fields = [(F.lit(c.name).alias("name"), F.lit(c.weight).alias("weight"), F.lit(c.shard).alias("shard"), *((_constant(c.children).alias("children"),) if c.children else ())) for c in children]
    return F.array(*(F.struct(*f) for f in fields))


def descend(key: Column, node: Node) -> Column:
    """The shard that a key reaches from a node: at each level the child of the least draw, the first of equals.

    The tree is a constant that the levels walk down, so the generated code doesn't grow with the number of shards.
    """
    at = _constant(node.children)
    below = node.children
    while True:
        draws = F.transform(at, lambda c: _draw(key, c["name"], c["weight"]))
        best = F.when(F.size(at) == 1, F.lit(1)).otherwise(F.array_position(draws, F.array_min(draws)).cast("int"))
        taken = F.element_at(at, best)
        if all(c.shard >= 0 for c in below):
            return taken["shard"]
        at, below = taken["children"], tuple(c for b in below for c in b.children)


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long")
    alike = ["doc_id", "size", "text_crc32"]
    rows = docs.select("doc_id", size.alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")).groupBy(*alike).agg(F.count("*").alias("_n"))
    of_bucket = F.md5(F.concat_ws("/", name, "size", "text_crc32").cast("binary"))
    place = {"shard": descend(name, tree(shards)), "grown_shard": descend(name, tree(shards + 1)), "_bucket": F.pmod(F.conv(F.substring(of_bucket, 1, 8), 16, 10).cast("long"), F.lit(BUCKETS)).cast("int")}
    rows = written(rows.withColumns(place))
    counts = rows.groupBy("shard", "_bucket").agg(F.sum("_n").alias("_all"))
    before = W.partitionBy("shard").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    first = counts.select(F.col("shard").alias("_shard"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_first"))
    earlier = W.partitionBy("shard", "_bucket").orderBy(*alike).rowsBetween(W.unboundedPreceding, -1)
    # shards x BUCKETS rows: a bounded broadcast.
    out = rows.withColumn("_slot", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).join(F.broadcast(first), (F.col("shard") == F.col("_shard")) & (F.col("_bucket") == F.col("_b")))
    out = out.select(*alike, F.lit("key").alias("law"), "shard", (F.col("_first") + F.col("_slot")).alias("_from"), "_n", "grown_shard")
    # Equal rows are told apart by their slots again, STEP at a time; many of them over all tasks.
    few = out.where(F.col("_n") <= STEP)
    many = out.where(F.col("_n") > STEP).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(STEP).cast("long")))).repartition(docs.sparkSession.sparkContext.defaultParallelism * 4)
    many = many.select(*alike, "law", "shard", (F.col("_from") + F.col("_part")).alias("_from"), F.least(F.col("_n") - F.col("_part"), F.lit(STEP)).alias("_n"), "grown_shard")
    return few.unionByName(many).select(*alike, "law", "shard", F.explode(F.sequence("_from", F.col("_from") + F.col("_n") - 1)).alias("slot"), "grown_shard")


def _sql(node: Node) -> str:
    """The same descent in DuckDB's SQL over a column k."""
    if node.shard >= 0:
        return str(node.shard)
    if len(node.children) == 1:
        return _sql(node.children[0])

    def draw(c: Node) -> str:
        return f"-ln((('0x' || substr(md5(k || '/{c.name}'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / {c.weight}"

    best = "list_position([" + ", ".join(draws := [draw(c) for c in node.children]) + "], list_min([" + ", ".join(draws) + "]))"
    return f"CASE {best} " + " ".join(f"WHEN {i} THEN {_sql(c)}" for i, c in enumerate(node.children, 1)) + " END"


def oracle_sql(shards: int = SHARDS) -> str:
    """DuckDB SQL for ``shard``; DuckDB has no crc32, so its table is made by the rule and folded over the bytes."""
    return f"""
WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS k, coalesce(strlen(text), 0) + {OVERHEAD} AS size,
      list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM documents),
c AS (SELECT d.*, xor(list_reduce(list_prepend(4294967295, bytes), lambda a, b: xor(a >> 8, t.crc[(xor(a, b) & 255) + 1])), 4294967295)::BIGINT AS text_crc32 FROM d, t),
s AS (SELECT doc_id, size::BIGINT AS size, text_crc32, {_sql(tree(shards))}::INT AS shard, {_sql(tree(shards + 1))}::INT AS grown_shard,
      (('0x' || substr(md5(k || '/' || size || '/' || text_crc32), 1, 8))::BIGINT % {BUCKETS})::INT AS b FROM c)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY b, doc_id, size, text_crc32) - 1)::BIGINT AS slot, grown_shard FROM s
"""
