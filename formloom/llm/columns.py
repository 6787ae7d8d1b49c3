"""Operators that return the rows they get: columns of any name are carried past them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns that operators read or make to fit the text.
OWN = ("doc_id", "text", "n_chars")


def carrying(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The operator, with all other columns of its first argument renamed on the way in and back on the way out."""

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        names = {c: c if c in OWN else f"_carried{i}" for i, c in enumerate(docs.columns)}
        out = operator(docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), *args, **kwargs)
        return out.select(*(F.col(n).alias(c) for c, n in names.items()))

    return run
