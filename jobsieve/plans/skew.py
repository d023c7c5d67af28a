"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..session import cut

HOT_ROWS = 500_000
#: Tasks over which rows with a null key, which match nothing, are spread.
NULL_SALTS = 64


def hot_limit(df: DataFrame, hot_rows: int | None = None) -> int:
    return int(df.sparkSession.conf.get("spark.jobsieve.hotRows", str(HOT_ROWS))) if hot_rows is None else hot_rows


def hot_keys(
    df: DataFrame, on: Sequence[str], hot_rows: int | None = None, counted: bool = False
) -> DataFrame | None:
    """The keys with more than ``hot_rows`` rows, or none at all; with ``counted`` their rows as ``__n``.

    The limit is ``spark.jobsieve.hotRows`` unless given. Counts are combined per task before they are shuffled. There can be at most
    ``rows / hot_rows`` such keys, so the list is small enough to broadcast.
    """
    found = df.groupBy(*on).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot_limit(df, hot_rows))
    hot = cut(found if counted else found.select(*on))
    return None if hot.isEmpty() else hot


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    spread: Sequence[str],
    how: str = "left",
    counted: DataFrame | None = None,
    hot_rows: int | None = None,
    null_salts: int = NULL_SALTS,
) -> DataFrame:
    """Join a large ``left`` to a ``right`` that has one row per key.

    Without hot keys this is an ordinary join. Otherwise the rows of each hot key are
    split over as many tasks as its rows are times the hot limit: a left row picks a salt from its own identity
    (``spread``), and the one right row of that key is repeated once per salt. A salt
    depends only on the row's own values, so a recomputed task sends its rows to the
    same place. Null keys never match and are spread too. ``counted`` is a cheaper table
    with the same keys to count hot ones on.
    """
    on = list(on)
    limit = hot_limit(left, hot_rows)
    hot = hot_keys(left if counted is None else counted, on, limit, counted=True)
    if hot is None:
        return left.join(right, on, how)
    # at least two, so that a key just over the limit is split as well
    salts = F.greatest(F.lit(2), F.ceil(F.col("__n") / F.lit(max(1, limit))).cast("int")).alias("__hot")
    hot = hot.select(*on, salts)
    if fits_broadcast(hot):
        hot = F.broadcast(hot)
    any_null = F.lit(False)
    for name in on:
        any_null = any_null | F.col(name).isNull()
    own_salt = F.pmod(F.xxhash64(*[F.col(c) for c in spread]), F.coalesce("__hot", F.lit(null_salts))).cast("int")
    every_salt = F.sequence(F.lit(0), F.col("__hot") - 1)
    salted_left = left.join(hot, on, "left").withColumn(
        "__salt", F.when(F.col("__hot").isNotNull() | any_null, own_salt).otherwise(F.lit(0))
    )
    salted_right = right.join(hot, on, "left").withColumn(
        "__salt", F.explode(F.when(F.col("__hot").isNotNull(), every_salt).otherwise(F.array(F.lit(0))))
    )
    return (
        salted_left.drop("__hot")
        .join(salted_right.drop("__hot"), [*on, "__salt"], how)
        .drop("__salt")
    )


def fits_broadcast(df: DataFrame, max_rows: int = 100_000, max_bytes: int = 32 << 20) -> bool:
    """Whether ``df`` is small enough to copy to every executor.

    Reads at most ``max_rows + 1`` rows to decide.
    """
    width = F.lit(0).cast("long")
    for field in df.schema.fields:
        width = width + F.coalesce(
            F.octet_length(F.to_json(F.struct(F.col(field.name)))).cast("long"), F.lit(0)
        )
    rows, size = (
        df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    )
    return rows <= max_rows and size <= max_bytes


def lookup_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", **limits
) -> DataFrame:
    """Equi-join that copies ``right`` to the executors only after checking its size."""
    if fits_broadcast(right, **limits):
        return left.join(F.broadcast(right), list(on), how)
    return left.join(right, list(on), how)
