"""A sink of image files: crops and reviewed images as PNG, each at its own path below a folder.

    spark.dataSource.register(ImageFiles)
    crops.select("target", "raw", "h", "w").write.format("images").mode("append").save("/data/crops")

Files appear when all tasks are done (``stores.FolderWriter``); a target that several rows name is an error of the task
that sees both, and otherwise keeps the file that is moved last.
"""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from ..functions.images import _image, png
from .stores import FolderWriter


class ImageWriter(FolderWriter):
    """A PNG file of each row (target, raw, h, w) that has pixels."""

    def fill(self, rows, files, folder: str) -> int:
        made: set[str] = set()
        for r in rows:
            page = _image(r["raw"], r["h"], r["w"])
            if not page.size:
                continue
            target = posixpath.normpath(r["target"])
            if target.startswith(("/", "..")):
                raise ValueError(f"{r['target']!r} isn't below the folder")
            if target in made:
                raise ValueError(f"{target!r} is named twice")
            made.add(target)
            place = posixpath.join(folder, target)
            files.create_dir(posixpath.dirname(place), recursive=True)
            with files.open_output_stream(place) as out:
                out.write(png(page))
        return len(made)


class ImageFiles(DataSource):
    """The format ``images``, for writing only."""

    @classmethod
    def name(cls) -> str:
        return "images"

    def schema(self) -> str:
        return "target string, raw binary, h int, w int"

    def writer(self, schema, overwrite: bool) -> ImageWriter:
        return ImageWriter(self.options["path"], overwrite)


def write_images(crops: DataFrame, path: str, mode: str = "append", dealt: bool = False) -> None:
    """crops (target, raw, h, w) as PNG files; rows of one target meet in one task, so a target named twice is an error.

    ``dealt``: they are in one task already, as what the images are made of was dealt by target; pixels needn't be shuffled.
    """
    crops.sparkSession.dataSource.register(ImageFiles)
    rows = crops.select("target", "raw", F.col("h").cast("int").alias("h"), F.col("w").cast("int").alias("w"))
    (rows if dealt else rows.repartition("target")).write.format("images").mode(mode).save(path)
