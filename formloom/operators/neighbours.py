"""Lines beside or below a label on recognised pages, and the label's place, in pixels."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes

# How far beside (in label heights up or down, pixels left of its right edge) and below a label a value may stand.
ROW, BACK, BELOW = 1.4, 20.0, 3.0
# Fixed value: what a line below a label must hold.
BELOW_TEXT = "[0-9A-Za-z]{4,}"
#: Height of the bands of a page that labels and lines are joined by.
BAND = 128.0
# Labels that place a page, by what their compact text holds or starts with; the first kind that fits a line (in this order).
ANCHOR_HOLDS = {"idoc_or_le": "idocorle", "idoc": "idochousingapplication"}
ANCHOR_STARTS = {"name": ("1name", "name"), "gender": ("2gender", "gender")}
# What is cut out around a label: pixels to its left, above, to its right and below.
AROUND = (40, 30, 420, 120)


def edges(points: Column) -> Column:
    """struct x1, y1, x2, y2 around an array of points x, y."""
    each = lambda k: F.transform(points, lambda p: p[k])
    return boxes.box(F.array_min(each("x")), F.array_min(each("y")), F.array_max(each("x")), F.array_max(each("y")))


def beside_or_below(labels: DataFrame, lines: DataFrame, on: Sequence[str] = ("doc_id",), band: float = BAND) -> DataFrame:
    """on.., label, line, beside, text: the lines in a label's row from its right edge on, or in the three heights below it.

    labels: on.., label, box; lines: on.., line, box, text (box: struct x1, y1, x2, y2 in pixels). A line below counts
    only with a word of four letters or digits; a label that is a line itself is below itself. Labels meet only lines of
    the bands that they reach, so a page of n lines isn't n squared; a line is in one band and meets a label once.
    """
    of = lambda y: F.floor(y / band)
    height = F.greatest(F.lit(1.0), F.col("box.y2") - F.col("box.y1"))
    a = labels.select(*on, "label", F.col("box").alias("a"), height.alias("height"), F.explode(F.sequence(of(F.col("box.y1") - height * ROW), of(F.col("box.y1") + height * BELOW))).alias("_band"))
    b = lines.select(*on, "line", F.col("box").alias("b"), "text", of(F.col("box.y1")).alias("_band"))
    met = a.join(b, [*on, "_band"])
    beside = (F.abs(F.col("b.y1") - F.col("a.y1")) <= F.col("height") * ROW) & (F.col("b.x1") >= F.col("a.x2") - BACK)
    below = (F.col("b.y1") >= F.col("a.y1")) & (F.col("b.y1") <= F.col("a.y1") + F.col("height") * BELOW) & (F.col("b.x1") >= F.col("a.x1")) & F.col("text").rlike(BELOW_TEXT)
    return met.withColumn("beside", beside).where(F.col("beside") | below).select(*on, "label", "line", "beside", "text")


def first_label(lines: DataFrame, label: str, on: Sequence[str] = ("doc_id",)) -> DataFrame:
    """on.., label (the line's number), box: the first line of each page whose text without spaces holds a label."""
    small = F.lower(F.regexp_replace("text", r"\s+", ""))
    return lines.where(F.contains(small, F.lit(label))).groupBy(*on).agg(F.min(F.struct("line", "box")).alias("b")).select(*on, F.col("b.line").alias("label"), "b.box")


def label_candidates(lines: DataFrame, label: str = "idocorle", on: Sequence[str] = ("doc_id",)) -> DataFrame:
    """on.., strings: the texts beside and below the first label of each page, in the order of the lines."""
    near = beside_or_below(first_label(lines, label, on), lines, on)
    return near.groupBy(*on).agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]).alias("strings"))


def label_crop(box: Column, width: Column, height: Column) -> Column:
    """Pixel box of what is cut out around a label, on the page."""
    left, above, right, under = AROUND
    at = lambda c: F.floor(c).cast("int")
    return boxes.box(F.greatest(F.lit(0), at(box["x1"] - left)), F.greatest(F.lit(0), at(box["y1"] - above)), F.least(width, at(box["x2"] + right)), F.least(height, at(box["y2"] + under)))


def _free_of(taken: Column) -> Callable[[Column], Column]:
    return lambda x: ~F.array_contains(taken, x["line"].cast("long"))


def anchors(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, class, key, x, y: the first line of each kind of anchor, as page fractions; a null key for pages without any.

    lines: doc_id, line, box (pixels), text; pages: doc_id, class, w, h. The rows are what ``pages.registration`` takes.
    A line is one anchor at most: the first kind that it holds and that no earlier line is, else what it starts with.
    """
    small = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]", "")
    fits = {key: F.contains(F.col("small"), F.lit(part)) for key, part in ANCHOR_HOLDS.items()}
    fits |= {key: F.col("small").rlike(f"^(?:{'|'.join(parts)})") for key, parts in ANCHOR_STARTS.items()}
    some = lines.select("doc_id", F.struct("line", "box").alias("at"), small.alias("small")).select("doc_id", "at", *(t.alias(k) for k, t in fits.items()))
    # Only lines that fit are gathered: a handful of each page.
    hits = some.groupBy("doc_id").agg(*(F.array_sort(F.collect_list(F.when(F.col(k), F.col("at")))).alias(k) for k in fits))
    taken = F.array().cast("array<long>")
    for k in fits:
        hits = hits.withColumn(f"_{k}", F.get(F.filter(k, _free_of(taken)), F.lit(0)))
        if k in ANCHOR_HOLDS:
            taken = F.concat(taken, F.filter(F.array(F.col(f"_{k}.line").cast("long")), lambda x: x.isNotNull()))
    found = hits.select("doc_id", F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(f"_{k}.box").alias("box")) for k in fits))).alias("f")).where("f.box is not null").select("doc_id", "f.*")
    out = pages.join(found, "doc_id", "left")
    return out.select("doc_id", "class", "key", (F.col("box.x1") / F.col("w")).alias("x"), (F.col("box.y1") / F.col("h")).alias("y"))
