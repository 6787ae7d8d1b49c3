"""Tables in the shared folder that cut lineage, and joins in which no key's rows meet in one task."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than one in so many of the rows is hot: there are at most so many of these keys.
HOT_SHARE = 1000
#: More ids than this are not broadcast (16 bytes each).
BROADCAST_IDS = 250_000


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or the one set by hand; a temporary one only where there is but one machine."""
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not known:
        if not sc.master.startswith(("local[", "local")) or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        known = sc.getCheckpointDir()
    return known.rstrip("/")


#: What each open ``sweeping`` has seen written.
_SWEPT: list[list[DataFrame]] = []


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there, and an executor's loss costs tasks only."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    for seen in _SWEPT:
        seen.append(out)
    return out


@contextlib.contextmanager
def sweeping(keep: list[DataFrame] | None = None) -> Iterator[None]:
    """Deletes the tables that are written within the block when it ends, but for those in ``keep`` (which the block may fill).

    For callers that have saved what an operator returned: the frame itself still reads its operator's tables.
    """
    seen: list[DataFrame] = []
    _SWEPT.append(seen)
    try:
        yield
    finally:
        _SWEPT.remove(seen)
        kept = {t.written_to for t in keep or []}
        discard(*(t for t in seen if t.written_to not in kept))


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that no plan reads any more."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables of one operation, to be deleted when its result is written."""

    def __init__(self) -> None:
        self.made: list[DataFrame] = []

    def write(self, df: DataFrame) -> DataFrame:
        self.made.append(written(df))
        return self.made[-1]

    def clear(self, *keep: DataFrame) -> None:
        discard(*(t for t in self.made if all(t is not k for k in keep)))


def is_one_of(key: str, values: list) -> Column:
    """Whether a column is one of a few values; null is none."""
    return F.coalesce(F.col(key).isin([bytes(v) if isinstance(v, bytearray) else v for v in values]), F.lit(False)) if values else F.lit(False)


def join_by(rows: DataFrame, table: DataFrame, key: str, n: str = "n", how: str = "inner") -> DataFrame:
    """rows joined (inner, left or left_semi) with a table of one row for each key, whose column n says how many rows it meets.

    Rows of hot keys, of which there are at most HOT_SHARE, stay where they are; the others are shuffled.
    """
    most = table.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0] // HOT_SHARE
    hot, cold = table.where(F.col(n) > most), table.where(F.col(n) <= most)
    keys = [r[0] for r in hot.select(key).collect()]
    if not keys:
        return rows.join(cold, key, how)
    here = rows.where(is_one_of(key, keys))
    here = here.select(*(F.col(c) for c in rows.columns)) if how == "left_semi" else here.join(F.broadcast(hot), key)
    apart = rows.where(~is_one_of(key, keys)).join(cold, key, how)
    return here.select(*apart.columns).unionByName(apart)


def by_identity(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, h) is in (left_semi) or not in (left_anti) ``ids``; null ids are equal.

    Few ids go to the executors, so that no text is shuffled; more are shuffled.
    """
    ids = ids.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"))
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), how)


def identified(docs: DataFrame) -> DataFrame:
    """``docs`` with h, a hash of the text: (doc_id, h) is a row's identity, which equal rows share."""
    return docs.withColumn("h", F.xxhash64("text"))


def repeats(rows: DataFrame) -> bool:
    """Whether two rows share an identity."""
    return not rows.groupBy("doc_id", "h").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def texts_of(docs: DataFrame, ids: DataFrame, repeated: bool) -> DataFrame:
    """doc_id, h and text of the rows in ``ids``, each identity once; repeated: whether docs repeat any."""
    found = by_identity(identified(docs.select("doc_id", "text")), ids, "left_semi")
    return found.groupBy("doc_id", "h").agg(F.first("text").alias("text")) if repeated else found
