"""Computing a costly column exactly once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add ``columns`` so that later filters and projections reuse their values.

    Filters are pushed below a projection by repeating its expressions, once per use.
    They are not pushed below a generator's output, so the columns come out of one.
    """
    named = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(named)))
