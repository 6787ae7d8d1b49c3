"""The ensemble of name readings: page text and three crops, as they are and prepared, read by one engine and ranked together."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import boxes, images, text
from ..functions.pixels import _image, blank
from . import rank
from .pages import page_names

#: Reads crops: doc_id, source, raw, h, w in, rows doc_id, source, text, confidence out (a crop may have none).
Reader = Callable[[DataFrame], DataFrame]

# How far each crop reaches beyond the name's box (left, top, right, bottom), which of them are also prepared, and padding in pixels.
REACHES = {"tight": (0.0, 0.0, 0.0, 0.0), "context": (0.04, 0.010, 0.04, 0.008), "wide": (0.06, 0.013, 0.08, 0.013)}
PREPARED = ("context", "wide")
PADDING = 4
# The source and confidence of names in the page's text, their least number of words, and what each source counts.
TEXT_SOURCE, TEXT_CONFIDENCE, TEXT_WORDS = "page_text_name_regex", 0.78, 2
WEIGHTS = {
    "page_text_name_regex": 8.0,
    "name_crop_wide_raw": 8.0,
    "name_crop_context_raw": 7.0,
    "name_crop_wide_prepared": 6.0,
    "name_crop_context_prepared": 5.5,
    "name_crop_tight_raw": 4.0,
}


def crop_boxes(box: Column) -> Column:
    """The boxes of the crops, in order: the name's own as it is, the others kept on the page."""
    return F.array(*(box if not any(reach) else boxes.expanded(box, *reach) for reach in REACHES.values()))


_CROPS = [("variant", pa.int32(), T.IntegerType()), ("prepared", pa.bool_(), T.BooleanType()), ("raw", pa.binary(), T.BinaryType()), ("h", pa.int32(), T.IntegerType()), ("w", pa.int32(), T.IntegerType())]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of batches doc_id, raw, h, w, at: a row for each crop that isn't blank, and each prepared one. Pages of one size with the same boxes are one stack."""
    for batch in batches:
        # Three crops, and two prepared ones of four times their pixels.
        for part, (raw, h, w, at) in images.parts(batch, ("raw", "h", "w", "_at"), images.SLICE_BYTES // 16, each=64):
            pages = [_image(*x) for x in zip(raw, h, w, strict=True)]
            kinds = [tuple((k, b["y1"], b["y2"], b["x1"], b["x2"]) for k, b in enumerate(found or []) if b is not None) for found in at]
            rows, found = [], []
            for (each,), places, stack in images.by_size(pages, kinds):
                for k, y1, y2, x1, x2 in each:
                    crops = stack[:, max(0, y1) : max(0, y2), max(0, x1) : max(0, x2)]
                    seen = np.flatnonzero(~blank(crops)).tolist()
                    if not seen:
                        continue
                    crops = crops[seen]
                    made = [(False, crops)] + ([(True, images.cleaned(crops, False))] if list(REACHES)[k] in PREPARED else [])
                    for prepared, stacked in made:
                        rows += [places[j] for j in seen]
                        found += [(k, prepared, x.tobytes(), *x.shape) for x in stacked]
            if found:
                columns = [pa.array(v, kind) for v, (_, kind, _) in zip(zip(*found, strict=True), _CROPS, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(rows, pa.int64())), *columns], names=["doc_id", *(c for c, _, _ in _CROPS)])


def name_crops(pages: DataFrame) -> DataFrame:
    """doc_id, variant (its place in REACHES), source, raw, h, w of all crops that aren't blank; pages: doc_id, raw, h, w, box (fractions).

    A page goes to Python once, and its crops are cut, looked at and prepared there.
    """
    at = F.transform(crop_boxes(F.col("box")), lambda b: boxes.pixels(b, F.col("w"), F.col("h"), PADDING))
    placed = pages.select("doc_id", "raw", "h", "w", at.alias("_at"))
    cut = placed.mapInArrow(_cut, T.StructType([placed.schema["doc_id"], *(T.StructField(c, kind) for c, _, kind in _CROPS)]))
    name = F.element_at(F.array(*(F.lit(v) for v in REACHES)), F.col("variant") + 1)
    source = F.concat(F.lit("name_crop_"), name, F.when(F.col("prepared"), "_prepared").otherwise("_raw"))
    return cut.select("doc_id", "variant", source.alias("source"), "raw", "h", "w")


def ensemble(pages: DataFrame, read: Reader, clean: Callable[[Column], Column] = text.name_value, k: int | None = None) -> DataFrame:
    """doc_id, rank, source, value, confidence, score: the names of each page, best first, k at most.

    pages: doc_id, text, raw, h, w, box (of the name, as page fractions). ``clean`` makes a reading a name, or ''. Of equal
    values of one crop the better one stays before all are ranked together, so copies count once for each crop.
    """
    told = pages.select("doc_id", F.posexplode(page_names(F.coalesce("text", F.lit("")))).alias("ord", "raw")).withColumn("value", clean(F.col("raw")))
    told = told.where(text.token_count(F.col("value")) >= TEXT_WORDS).select("doc_id", "ord", F.lit(TEXT_SOURCE).alias("source"), "value", F.lit(TEXT_CONFIDENCE).alias("confidence"))
    crops = name_crops(pages)
    readings = read(crops.select("doc_id", "source", "raw", "h", "w")).withColumn("value", clean(F.col("text"))).where("value <> ''")
    variant = F.coalesce(*(F.when(F.col("source").startswith(f"name_crop_{v}_"), i) for i, v in enumerate(REACHES)))
    each = readings.select("doc_id", variant.alias("variant"), F.when(F.col("source").endswith("_raw"), 0).otherwise(1).alias("ord"), "source", "value", F.col("confidence").cast("double").alias("confidence"))
    best = rank.ranked_names(each, WEIGHTS, by=("doc_id", "variant"))
    of_crops = best.select("doc_id", ((F.col("variant") + 1) * 1000 + F.col("rank")).cast("int").alias("ord"), "source", "value", "confidence")
    # All windows stand on one shuffle, by the document.
    return rank.ranked_names(told.unionByName(of_crops).repartition("doc_id"), WEIGHTS, k).select("doc_id", "rank", "source", "value", "confidence", "score")
