"""Resume documents, scraped pages and hand-entered rows, each with a reject side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import schemas
from ..functions.fields import page_identity
from ..functions.text import first_json_object, optional, required


def _list(items: Column) -> Column:
    return F.transform(
        F.coalesce(items, F.array().cast("array<string>")), lambda x: required(x)
    )


def _entries(column: Column, needed: str, optional_keys: tuple[str, ...], list_key: str) -> Column:
    def clean(entry: Column) -> Column:
        fields = []
        for name in (*needed.split(), *optional_keys):
            rule = required if name in needed.split() else optional
            fields.append(rule(entry[name]).alias(name))
        return F.struct(*fields, _list(entry[list_key]).alias(list_key))

    return F.coalesce(F.transform(column, clean), F.array())


def clean_content(content: Column) -> Column:
    """Trimmed text, blank optionals as null, missing lists as empty."""
    basics = content["basics"]
    return F.struct(
        F.struct(
            required(basics["name"]).alias("name"),
            *[
                optional(basics[k]).alias(k)
                for k in ("label", "email", "phone", "url", "location", "summary")
            ],
        ).alias("basics"),
        _entries(content["experience"], "company title", ("location", "start", "end"), "bullets").alias("experience"),
        _entries(content["education"], "institution", ("degree", "location", "start", "end"), "bullets").alias("education"),
        _entries(content["skills"], "category", (), "items").alias("skills"),
        _entries(content["projects"], "name", ("description", "url"), "bullets").alias("projects"),
        _entries(content["custom"], "title", (), "bullets").alias("custom"),
    )


def load_resumes(rows: DataFrame, key: str, json: str) -> tuple[DataFrame, DataFrame]:
    """``(content table, rejects)``. A resume is a JSON object with a ``basics`` record."""
    parsed = rows.withColumn("__c", F.from_json(json, schemas.RESUME_CONTENT))
    ok = F.col("__c").isNotNull() & F.col("__c.basics").isNotNull()
    return (
        parsed.where(ok).select(key, clean_content(F.col("__c")).alias("content")),
        parsed.where(~F.coalesce(ok, F.lit(False))).select(
            key, F.col(json).alias("raw"), F.lit("not a resume document").alias("reason")
        ),
    )


def land_pages(pages: DataFrame) -> DataFrame:
    """Scraped ``(url, title, markdown, fetched_at)`` rows as job rows; the body is kept verbatim."""
    identity = page_identity(F.col("title"), F.col("markdown"), F.col("url"))
    return pages.withColumn("__id", identity).select(
        "url",
        F.col("__id.title").alias("title"),
        F.col("__id.company").alias("company"),
        F.lit(None).cast("string").alias("location"),
        F.col("markdown").alias("jd_text"),
        F.lit("paste").alias("source"),
        F.col("fetched_at").alias("scraped_at"),
    )


def with_extraction(jobs: DataFrame, reply: str) -> DataFrame:
    """Prefer a model reply's fields where they are filled in, else keep the page's."""
    got = F.from_json(
        first_json_object(F.col(reply)),
        "title string, company string, location string, companyBlurb string",
    )
    return (
        jobs.withColumn("__r", got)
        .withColumn("title", F.coalesce(optional(F.col("__r.title")), F.col("title")))
        .withColumn("company", F.coalesce(optional(F.col("__r.company")), F.col("company")))
        .withColumn("location", optional(F.col("__r.location")))
        .withColumn("company_blurb", optional(F.col("__r.companyBlurb")))
        .drop("__r", reply)
    )


def manual_jobs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hand-entered jobs and the rows refused for want of a title or company."""
    ok = optional(F.col("title")).isNotNull() & optional(F.col("company")).isNotNull()
    good = rows.where(ok).select(
        *[c for c in rows.columns if c not in ("title", "company", "location", "jd_text", "url", "source")],
        required(F.col("title")).alias("title"),
        required(F.col("company")).alias("company"),
        optional(F.col("location")).alias("location"),
        required(F.col("jd_text")).alias("jd_text"),
        optional(F.col("url")).alias("url"),
        F.lit("manual").alias("source"),
    )
    bad = rows.where(~ok).withColumn("reason", F.lit("A job needs at least a title and a company."))
    return good, bad
