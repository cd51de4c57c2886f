"""Column expressions over array<double> vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v
    )


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """The vector at length one; a zero vector stays as it is."""
    return let(
        v.cast("array<double>"),
        lambda w: let(norm(w), lambda size: F.when(size > 0, F.transform(w, lambda x: x / size)).otherwise(w)),
    )
