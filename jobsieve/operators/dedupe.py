"""Resolving the same posting seen through several feeds.

Listings are taken in merge order. A listing is a duplicate when its id, or
failing that its link with title and company, was seen before; it then belongs to
whatever that earlier sighting belongs to. So every listing points at one earlier
listing at most - the first with its id, else the first with its link key - and
its survivor is where the pointers end. That is exact for the greedy order and
needs no walk over a group: identical sightings collapse before the shuffle,
first positions are plain minima, and pointers are followed in doubling rounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.links import listing_key
from ..plans.rounds import resolve_pointers
from ..plans.skew import salted_join
from ..session import cut


def listing_keys(listings: DataFrame) -> DataFrame:
    """One row per listing and key."""
    keys = F.array_compact(
        F.array(
            F.concat(F.lit("id:"), F.col("external_id")),
            listing_key(F.col("url"), F.col("title"), F.col("company")),
        )
    )
    return listings.select("adapter_rank", "pos", F.explode(keys).alias("key"))


def _sightings(listings: DataFrame, order: Sequence[str]) -> DataFrame:
    """Listings collapsed by (id, link key): first position, its columns, first description."""
    ordering = F.struct(*order)
    described = F.coalesce(F.col("description"), F.lit("")) != ""
    kept = [c for c in listings.columns if c not in ("external_id", "description")]
    return (
        listings.withColumn("__b", listing_key(F.col("url"), F.col("title"), F.col("company")))
        .groupBy("external_id", "__b")
        .agg(
            F.min(ordering).alias("node"),
            F.min_by(F.struct(*kept), ordering).alias("row"),
            F.min(F.when(described, ordering)).alias("desc_at"),
            F.min_by("description", F.when(described, ordering)).alias("desc"),
            F.count(F.lit(1)).alias("n"),
        )
    )


def _pointers(seen: DataFrame) -> DataFrame:
    first_id = seen.groupBy("external_id").agg(F.min("node").alias("a"))
    first_link = seen.where(F.col("__b").isNotNull()).groupBy("__b").agg(F.min("node").alias("b"))
    keys = seen.select("external_id", "__b", "node")
    met = salted_join(keys, first_id, ["external_id"], ["external_id", "__b"], "left")
    met = salted_join(met, first_link, ["__b"], ["external_id", "__b"], "left", counted=keys)
    return met.select(
        "node",
        F.when(F.col("a") < F.col("node"), F.col("a"))
        .when(F.col("b") < F.col("node"), F.col("b"))
        .alias("ptr"),
    )


def dedupe_listings(
    listings: DataFrame, order: Sequence[str] = ("adapter_rank", "pos")
) -> DataFrame:
    """Surviving listings with ``sightings``.

    ``order`` must be unique per row. A duplicate gives its survivor nothing but a
    description, and only when the survivor came without one.
    """
    seen = cut(_sightings(listings, order))
    roots = resolve_pointers(_pointers(seen), skewed=True)
    owned = seen.join(roots, "node")
    merged = owned.groupBy("root").agg(
        F.min_by(F.struct("external_id", "row"), "node").alias("first"),
        F.min_by("desc", "desc_at").alias("description"),
        F.sum("n").alias("sightings"),
    )
    return merged.select("first.external_id", "first.row.*", "description", "sightings")


def listing_owners(listings: DataFrame, order: Sequence[str] = ("adapter_rank", "pos")) -> DataFrame:
    """Each distinct (id, link key) sighting with the position of the listing it belongs to."""
    seen = cut(_sightings(listings, order))
    roots = resolve_pointers(_pointers(seen), skewed=True)
    return seen.join(roots, "node").select(
        "external_id",
        *[F.col(f"node.{c}").alias(c) for c in order],
        *[F.col(f"root.{c}").alias(f"owner_{c}") for c in order],
    )


def first_seen(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key. A plain minimum, so duplicates combine before the shuffle.

    The key is what is shuffled: give a digest in place of long texts.
    """
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
        .select(*keys, "__row.*")
    )
