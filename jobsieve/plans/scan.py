"""Ordered scans over groups of any size.

A window sends all rows of one key to one task. That is right for keys of ordinary
size. Keys with very many rows are cut into blocks: rows are scanned inside ``keys +
blocks``, each block is reduced to one summary row, only the summaries are scanned per
key, and the running state is joined back to the rows. ``blocks`` are columns that rise
with the sort order, such as a day or ``id div 4096``, so no sampling is involved and a
recomputed task always makes the same blocks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut
from .skew import hot_keys


COUNT_FIRST = object()


def running(
    df: DataFrame,
    keys: Sequence[str],
    blocks: Sequence[str],
    order: Sequence[str],
    *,
    sums: Mapping[str, Column] | None = None,
    previous: Mapping[str, Column] | None = None,
    position: str | None = None,
    hot: DataFrame | None | object = COUNT_FIRST,
    hot_rows: int | None = None,
) -> DataFrame:
    """Add running columns to ``df``.

    ``sums``      name -> numeric column; running total including the row itself.
    ``previous``  name -> column; its last non-null value strictly before the row.
    ``position``  name of a 1-based row number within the key.

    ``order`` is ascending and must be total inside a key; block columns must be
    non-null and must rise with it. ``hot`` is what ``hot_keys`` found on the same or
    fewer key columns; left out, the keys are counted first.
    """
    sums, previous = dict(sums or {}), dict(previous or {})
    if position:
        sums[position] = F.lit(1).cast("long")
    keys, blocks, order = list(keys), list(blocks), list(order)
    if not keys:
        raise ValueError("a scan over everything is a sort: use global_position")
    if hot is COUNT_FIRST:
        hot = hot_keys(df, keys, hot_rows)
    if hot is None:
        return _plain(df, keys, order, sums, previous)
    same_key = None
    for k in hot.columns:
        test = df[k].eqNullSafe(hot[k])
        same_key = test if same_key is None else same_key & test
    few = F.broadcast(hot)
    return _plain(df.join(few, same_key, "left_anti"), keys, order, sums, previous).unionByName(
        _in_blocks(df.join(few, same_key, "left_semi"), keys, blocks, order, sums, previous)
    )


def _plain(
    df: DataFrame, keys: list[str], order: list[str], sums: Mapping[str, Column], previous: Mapping[str, Column]
) -> DataFrame:
    along = Window.partitionBy(*keys).orderBy(*order)
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    return df.select(
        "*",
        *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(n) for n, c in sums.items()],
        *[F.last(c, ignorenulls=True).over(before).alias(n) for n, c in previous.items()],
    )


def _in_blocks(
    df: DataFrame, keys: list[str], blocks: list[str], order: list[str],
    sums: Mapping[str, Column], previous: Mapping[str, Column],
) -> DataFrame:
    # Keys may be null (a sequence without a contact); compare them as values.
    safe = {k: f"__k{i}" for i, k in enumerate(keys)}
    base = df.select("*", *[F.struct(F.col(k)).alias(s) for k, s in safe.items()])
    group = [*safe.values(), *blocks]

    inside = Window.partitionBy(*group).orderBy(*order)
    rows = base.select(
        "*",
        *[
            F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias(f"__s_{n}")
            for n, c in sums.items()
        ],
        *[
            F.last(c, ignorenulls=True)
            .over(inside.rowsBetween(Window.unboundedPreceding, -1))
            .alias(f"__p_{n}")
            for n, c in previous.items()
        ],
    )

    ordering = F.struct(*[F.col(c) for c in order])
    reduced = base.groupBy(*group).agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.sum(c).alias(f"__bs_{n}") for n, c in sums.items()],
        *[
            F.max_by(c, F.when(c.isNotNull(), ordering)).alias(f"__bp_{n}")
            for n, c in previous.items()
        ],
    )
    before = Window.partitionBy(*safe.values()).orderBy(*blocks).rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = reduced.select(
        *group,
        *[F.sum(f"__bs_{n}").over(before).alias(f"__cs_{n}") for n in sums],
        *[F.last(f"__bp_{n}", ignorenulls=True).over(before).alias(f"__cp_{n}") for n in previous],
    )
    joined = rows.join(carried, group, "left")
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[
            (F.coalesce(F.col(f"__s_{n}"), F.lit(0)) + F.coalesce(F.col(f"__cs_{n}"), F.lit(0))).alias(n)
            for n in sums
        ],
        *[F.coalesce(F.col(f"__p_{n}"), F.col(f"__cp_{n}")).alias(n) for n in previous],
    )


def global_position(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """Add the 1-based position of every row in ``order``, over the whole table.

    The table is sorted once by range and written with each row's partition and place in
    it. What remains is one count per partition: their running total is the only thing
    that is computed in one place, and it has as many rows as the sort had partitions.
    """
    placed = cut(df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("__id", 33).alias("__part")
    counts = placed.groupBy(part).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    row = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.select(*df.columns, part, row.alias("__row"))
        .join(F.broadcast(offsets), "__part")  # one row per partition
        .select(*df.columns, (F.col("__before") + F.col("__row") + 1).alias(name))
    )
