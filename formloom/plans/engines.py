"""Plug-in points for recognition engines: DataFrame in, candidate rows out."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

CANDIDATES = "doc_id long, ord int, source string, value string, confidence double"


class NameEngine(Protocol):
    """Reads name candidates; rows follow CANDIDATES."""

    def boxes(self, box: tuple[float, float, float, float]) -> dict[str, tuple[float, float, float, float]]:
        """The boxes that the engine looks at, by variant, for a field's box."""

    def crop_candidates(self, crops: DataFrame) -> DataFrame:
        """Candidates of crops (doc_id, variant, content)."""

    def candidates(self, pages: DataFrame) -> DataFrame:
        """Candidates of pages (doc_id, page, content, text)."""


#: The engine that reads with a model given by its path.
MODEL_ENGINE = "trocr"
_ENGINES: dict[str, Callable[[str], NameEngine]] = {}


def register(name: str, make: Callable[[str], NameEngine]) -> None:
    """Adds an engine; ``make`` gets what follows the colon in the engine's spec."""
    _ENGINES[name] = make


def engine(spec: str) -> NameEngine:
    """Engine of a spec such as ``kraken:model``; the path of a model that is there stands for the model engine."""
    name, _, rest = spec.partition(":")
    if name not in _ENGINES and MODEL_ENGINE in _ENGINES and Path(spec).exists():
        return _ENGINES[MODEL_ENGINE](spec)
    if name not in _ENGINES:
        raise ValueError(f"unknown name engine {spec!r}; known: {', '.join(sorted(_ENGINES)) or 'none'}")
    return _ENGINES[name](rest)


def candidates_or_none(spark: SparkSession, spec: str | None, pages: DataFrame) -> DataFrame:
    """Candidates of an engine, an empty table if none is set up."""
    return spark.createDataFrame([], CANDIDATES) if not spec else engine(spec).candidates(pages)
