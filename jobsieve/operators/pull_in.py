"""Pulling listings into the pipeline: jobs, their applications and the ratings they came with.

All incoming rows of a posting are folded first, so the result is that of pulling them in one by one,
and doing it again changes nothing. Ids of new rows are derived from what they stand for, so a
repeated or retried run makes the same ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab
from ..functions.links import canonical_url
from . import merge


def derived_id(kind: str, *keys: Column) -> Column:
    """An id that follows from the row's key alone."""
    return F.md5(F.concat_ws(":", F.lit(kind), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys]))


def pull_in(
    jobs: DataFrame, applications: DataFrame, listings: DataFrame, ratings: DataFrame, order: Sequence[str], now: Column
) -> dict[str, DataFrame]:
    """The ``jobs`` and ``applications`` after taking in ``listings``.

    ``jobs`` as for ``merge_jobs`` with a text ``job_id``; ``applications`` have ``application_id,
    job_id, status, created_at, fit_tier, fit_reasons``; ``ratings`` one row per ``external_id`` with
    ``tier, reasons``. A job that was seen has one application: the oldest it had, or a new one.
    The last rated sighting sets the tier and the reasons of that application; an unrated one leaves
    them. Jobs and applications that were not seen stay as they are.
    """
    given = ratings.select("external_id", F.struct("tier", "reasons").alias("__rating"))
    rated = listings.join(given, "external_id", "left")
    sighted = rated.withColumn("__url", canonical_url(F.col("url"))).select("*", *merge.match_key(F.col("__url")))
    last = sighted.groupBy("__u", "__t").agg(F.max_by("__rating", F.when(F.col("__rating").isNotNull(), F.struct(*order))).alias("__rating"))
    merged = merge.merge_jobs(jobs, listings, order, now)
    keyed = merged.select("*", *merge.match_key(F.col("url")))
    new_id = derived_id("job", F.col("url"), *[F.when(F.col("url").isNull(), F.col(c)) for c in ("title", "company", "location")])
    named = keyed.withColumn("job_id", F.coalesce("job_id", new_id))
    seen = named.where(F.col("outcome") != "kept").alias("j").join(
        last.alias("r"), (F.col("j.__u") == F.col("r.__u")) & F.col("j.__t").eqNullSafe(F.col("r.__t")), "left"
    )
    found = merge.find_or_create_applications(applications, seen.select("job_id"))
    wanted = seen.select("job_id", "__rating").join(found, "job_id")
    touched = wanted.select("application_id", "job_id", F.col("status").alias("__status"), "__rating")
    joined = applications.withColumn("application_id", F.col("application_id").cast("string")).alias("a").join(
        touched.alias("t"), "application_id", "full_outer"
    )
    after = joined.select(
        "application_id", F.coalesce("a.job_id", "t.job_id").alias("job_id"), F.coalesce("a.status", "__status").alias("status"),
        F.coalesce("a.created_at", F.when(F.col("a.job_id").isNull(), now)).alias("created_at"),
        F.coalesce("__rating.tier", "a.fit_tier").alias("fit_tier"),
        F.when(F.col("__rating").isNotNull(), F.col("__rating.reasons")).otherwise(F.col("a.fit_reasons")).alias("fit_reasons"),
    )
    return {"jobs": named.drop("outcome", "__u", "__t"), "applications": after}


def rating_runs(chunks: DataFrame, run: str) -> DataFrame:
    """What became of the chunks of each rating run: ``run, chunks, failed, outcome, error``.

    ``chunks`` has ``run, chunk_no, reason``, the reason null where the chunk could be read. A chunk that
    fails costs its own listings only; when every one does, the run is an error with the first reason.
    """
    bad = F.col("reason").isNotNull()
    counted = chunks.groupBy(run).agg(
        F.count(F.lit(1)).alias("chunks"), F.count_if(bad).alias("failed"), F.min_by("reason", F.when(bad, F.col("chunk_no"))).alias("__first")
    )
    every = F.col("failed") == F.col("chunks")
    return counted.select(
        run, "chunks", "failed", F.when(every, "error").when(F.col("failed") > 0, "partial").otherwise("rated").alias("outcome"),
        F.when(every, F.col("__first")).alias("error"),
    )
