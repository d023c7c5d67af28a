"""Following pointers to their end in a logarithmic number of joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..session import cut
from .skew import salted_join


def resolve_pointers(
    nodes: DataFrame, sums: Sequence[str] = (), skewed: bool = False
) -> DataFrame:
    """Resolve every ``node`` to the terminal its ``ptr`` chain reaches.

    ``nodes`` has ``node`` (unique), ``ptr`` (null on a terminal) and the numeric
    ``sums`` columns. Returns ``node, root`` and, per sum, the total over the
    chain including both ends. Each round doubles the distance covered, so a
    chain of length n needs about log2(n) joins. A round writes only the nodes that
    were open before it; the resolved ones stay where they were written and are
    read as targets. Nodes on a cycle reach no terminal and are left out. Set
    ``skewed`` when many nodes may share one pointer.
    """
    first = cut(
        nodes.select(
            "node",
            "ptr",
            F.when(F.col("ptr").isNull(), F.col("node")).alias("root"),
            *sums,
        )
    )
    resolved = [first.where(F.col("ptr").isNull())]
    waiting = first.where(F.col("ptr").isNotNull())
    still_open = waiting.count()
    while still_open:
        targets = reduce(DataFrame.unionByName, [waiting, *resolved]).select(
            F.col("node").alias("ptr"),
            F.col("ptr").alias("__ptr"),
            F.col("root").alias("__root"),
            *[F.col(s).alias(f"__{s}") for s in sums],
        )
        if skewed:
            met = salted_join(waiting.drop("root"), targets, ["ptr"], ["node"], "inner")
        else:
            met = waiting.drop("root").join(targets, "ptr", "inner")
        moved = cut(
            met.select(
                "node",
                F.col("__ptr").alias("ptr"),
                F.col("__root").alias("root"),
                *[(F.col(s) + F.col(f"__{s}")).alias(s) for s in sums],
            )
        )
        resolved.append(moved.where(F.col("ptr").isNull()))
        waiting = moved.where(F.col("ptr").isNotNull())
        left = waiting.count()
        if left == still_open:  # only cycles remain
            break
        still_open = left
    return reduce(DataFrame.unionByName, resolved).select("node", "root", *sums)
