"""Merges into stored tables. Every merge is a batch: all incoming rows of one key are
folded first with mergeable aggregates, then joined to the stored row, so the result
equals applying them one by one in order and a hot key is combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab
from ..functions.fields import body_of, in_vocabulary, is_missing_body, looks_like_email, refreshed_body
from ..functions.links import canonical_url
from ..functions.text import optional, trim


def match_key(url: Column) -> list[Column]:
    """Link when there is one; otherwise title, company and location, null-safe."""
    no_link = url.isNull()
    return [
        F.coalesce(url, F.lit("")).alias("__u"),
        F.when(no_link, F.struct("title", "company", "location")).alias("__t"),
    ]


def fold_incoming(listings: DataFrame, order: Sequence[str]) -> DataFrame:
    """All sightings of one posting as one row.

    The first sighting names title, company and source; the last known location
    wins. Of the real bodies the longest wins, the earliest among equals; a
    placeholder counts only when there is nothing else.
    """
    url = canonical_url(F.col("url"))
    rows = listings.withColumn("__url", url).withColumn(
        "__body", body_of(F.col("description"), F.col("source"), F.col("url"))
    )
    at = F.struct(*order)
    real = ~is_missing_body(F.col("__body"))
    # Order columns are numeric, so "earliest among equals" is the largest negated order.
    earliest = [-F.col(c) for c in order]
    return (
        rows.select("*", *match_key(F.col("__url")))
        .groupBy("__u", "__t")
        .agg(
            F.first("__url", ignorenulls=True).alias("in_url"),
            F.min_by(F.struct("title", "company", "source", "location"), at).alias("in_first"),
            F.max_by("location", F.when(F.col("location").isNotNull(), at)).alias("in_location"),
            F.max_by("__body", F.when(real, F.struct(F.length("__body"), *earliest))).alias("in_real"),
            F.min_by("__body", F.when(~real, at)).alias("in_placeholder"),
            F.count(F.lit(1)).alias("sightings"),
        )
    )


def merge_jobs(stored: DataFrame, listings: DataFrame, order: Sequence[str], now: Column) -> DataFrame:
    """Pull listings into the job table.

    ``stored`` has ``job_id, url (canonical or null), title, company, location,
    jd_text, source, scraped_at``. Known postings keep title, company and source; the
    body follows the refresh rule and ``scraped_at`` moves only when it changed.
    """
    incoming = fold_incoming(listings, order)
    old = stored.select(
        *[F.col(c).alias(f"s_{c}") for c in stored.columns], *match_key(F.col("url"))
    )
    joined = old.alias("o").join(
        incoming.alias("i"),
        (F.col("o.__u") == F.col("i.__u")) & F.col("o.__t").eqNullSafe(F.col("i.__t")),
        "full_outer",
    )
    known, seen = F.col("s_job_id").isNotNull(), F.col("sightings").isNotNull()
    stored_body = F.coalesce("s_jd_text", F.lit(""))
    body = (
        F.when(~seen, F.col("s_jd_text"))
        .when(F.col("in_real").isNotNull(), F.when(known, refreshed_body(stored_body, F.col("in_real"))).otherwise(F.col("in_real")))
        .otherwise(F.when(known, refreshed_body(stored_body, F.col("in_placeholder"))).otherwise(F.col("in_placeholder")))
    )
    out = joined.withColumn("jd_text", body)
    changed = ~known | (seen & ~F.col("jd_text").eqNullSafe(F.col("s_jd_text")))
    return out.select(
        F.col("s_job_id").alias("job_id"),
        F.when(known, F.col("s_url")).otherwise(F.col("in_url")).alias("url"),
        F.when(known, F.col("s_title")).otherwise(F.col("in_first.title")).alias("title"),
        F.when(known, F.col("s_company")).otherwise(F.col("in_first.company")).alias("company"),
        F.coalesce("in_location", "s_location").alias("location"),
        "jd_text",
        F.when(known, F.col("s_source")).otherwise(F.lit("api")).alias("source"),
        F.when(changed, now).otherwise(F.col("s_scraped_at")).alias("scraped_at"),
        F.when(~known, "inserted").when(changed, "refreshed").when(seen, "seen").otherwise("kept").alias("outcome"),
    )


def upsert_pasted(stored: DataFrame, pages: DataFrame, order: Sequence[str]) -> DataFrame:
    """Pasted pages by raw link: everything but title and company is refreshed."""
    last = pages.groupBy("url").agg(
        F.max_by(F.struct("location", "jd_text", "source", "scraped_at"), F.struct(*order)).alias("n"),
        F.min_by(F.struct("title", "company"), F.struct(*order)).alias("f"),
    )
    joined = stored.alias("s").join(last.alias("p"), "url", "full_outer")
    seen = F.col("p.n").isNotNull()
    return joined.select(
        "url",
        F.coalesce("s.title", "f.title").alias("title"),
        F.coalesce("s.company", "f.company").alias("company"),
        *[
            F.when(seen, F.col(f"n.{c}")).otherwise(F.col(f"s.{c}")).alias(c)
            for c in ("location", "jd_text", "source", "scraped_at")
        ],
    )


def check_contacts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contact inputs fit to save, and the refused ones with the reason."""
    email = optional(F.col("email"))
    source = F.coalesce(optional(F.col("source")), F.lit("manual"))
    reason = (
        F.when(optional(F.col("name")).isNull(), "A contact needs a name.")
        .when(email.isNotNull() & ~looks_like_email(email), F.concat(F.lit('"'), email, F.lit('" does not look like an email address.')))
        .when(~in_vocabulary(source, vocab.CONTACT_SOURCES), F.concat(F.lit('Unknown contact source "'), source, F.lit('".')))
    )
    judged = rows.withColumn("reason", reason)
    clean = judged.where(F.col("reason").isNull()).drop("reason")
    text = {"name": trim(F.col("name")), "source": source, "email": email}
    for c in ("title", "company", "linkedin_url"):
        text[c] = optional(F.col(c))
    return clean.withColumns(text), judged.where(F.col("reason").isNotNull())


def merge_contacts(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row per (application, e-mail without case), every row without an e-mail kept.

    ``rows`` are all sightings, stored ones included, in ``order``. A later sighting
    fills gaps and never blanks; name, e-mail and source are the latest. The contact
    keeps its first sighting's position as ``first_*``.
    """
    at = F.struct(*order)

    def latest(c: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c)

    merged = (
        rows.where(F.col("email").isNotNull())
        .groupBy("application_id", F.lower("email").alias("__e"))
        .agg(
            F.max_by("name", at).alias("name"),
            latest("title"), latest("company"),
            F.max_by("email", at).alias("email"),
            latest("linkedin_url"),
            F.max_by("source", at).alias("source"),
            F.min(at).alias("__first"),
            F.count(F.lit(1)).alias("sightings"),
        )
        .drop("__e")
    )
    alone = rows.where(F.col("email").isNull()).select(
        "application_id", "name", "title", "company", "email", "linkedin_url", "source",
        at.alias("__first"), F.lit(1).cast("long").alias("sightings"),
    )
    return merged.unionByName(alone).select(
        "application_id", "name", "title", "company", "email", "linkedin_url", "source",
        *[F.col(f"__first.{c}").alias(f"first_{c}") for c in order], "sightings",
    )


def replace_by_key(stored: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows of every key that has new rows give way to them."""
    replaced = new.select(*keys).distinct()
    return stored.join(replaced, list(keys), "left_anti").unionByName(new)


def append_versions(stored: DataFrame, saves: DataFrame) -> DataFrame:
    """Saved versions are appended, never rewritten."""
    return stored.unionByName(saves)


def edit_working_version(versions: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rewrite the newest version of each resume; edits of older ones are refused.

    ``edits`` has ``resume_id, version_id, content, edited_at``.
    """
    newest = versions.groupBy("resume_id").agg(
        F.max_by("version_id", F.struct("created_at", "version_id")).alias("working_id")
    )
    last = edits.groupBy("resume_id", "version_id").agg(F.max_by("content", "edited_at").alias("content"))
    judged = last.join(newest, "resume_id", "left")
    good = judged.where(F.col("working_id") == F.col("version_id")).select("version_id", F.col("content").alias("__new"))
    refused = judged.where(~F.col("working_id").eqNullSafe(F.col("version_id"))).drop("working_id")
    updated = versions.join(good, "version_id", "left").withColumn(
        "content", F.coalesce("__new", "content")
    ).select(*versions.columns)
    return updated, refused


def find_or_create_applications(applications: DataFrame, jobs: DataFrame) -> DataFrame:
    """One application per wanted job: the oldest existing one, else a new ``sourced`` row.

    Ids are text; a new application's follows from its job, so that it is the same every time.
    """
    oldest = applications.groupBy("job_id").agg(
        F.min_by(F.struct("application_id", "status"), F.struct("created_at", "application_id")).alias("a")
    )
    return jobs.select("job_id").distinct().join(oldest, "job_id", "left").select(
        "job_id",
        F.coalesce(F.col("a.application_id").cast("string"), F.md5(F.concat(F.lit("application:"), F.col("job_id").cast("string")))).alias("application_id"),
        F.coalesce("a.status", F.lit(vocab.DEFAULT_STATUS)).alias("status"),
        F.col("a").isNull().alias("created"),
    )


def delete_resumes(resumes: DataFrame, wanted: DataFrame, pins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Resumes left after deletion, and the refused deletions with the number of pins.

    ``pins`` has one row per application and the ``resume_id`` it pins.
    """
    counts = pins.where(F.col("resume_id").isNotNull()).groupBy("resume_id").agg(F.count(F.lit(1)).alias("pins"))
    asked = wanted.select("resume_id").distinct().join(counts, "resume_id", "left")
    refused = asked.where(F.col("pins") > 0).withColumn(
        "reason",
        F.concat(
            F.lit("Can't delete this résumé: "), F.col("pins").cast("string"), F.lit(" application"),
            F.when(F.col("pins") == 1, "").otherwise("s"),
            F.lit(" pin one of its versions. Archive it instead."),
        ),
    )
    gone = asked.where(F.coalesce("pins", F.lit(0)) == 0)
    return resumes.join(gone, "resume_id", "left_anti"), refused

