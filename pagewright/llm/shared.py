"""Helpers that the training-data operators share: scratch tables, Arrow batch size, internal names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.arrow import ARROW_BYTES, ARROW_ROWS, small_batches
from pagewright.scratch import delete, scratch_path, stored, written

__all__ = ["ARROW_BYTES", "ARROW_ROWS", "delete", "fresh", "let", "scratch_path", "small_batches", "stored", "text_of", "written"]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """For each name one that no column of the table has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times in ``body`` (a lambda variable holds it)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(name: str) -> Column:
    """The text column with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
