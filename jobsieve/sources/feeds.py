"""Board feeds to listings, people feeds to contacts.

A feed is a table of raw responses ``(provider, org, body)``, one row per
response, so parsing is spread over the cluster. Each provider's elements are
exploded and mapped with plain expressions. A response that does not parse costs
only its own rows and is reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schemas, vocab
from ..functions.links import posting_page_url
from ..functions.text import optional, title_case_token

# Sources in the order their listings are merged.
PROVIDER_RANK = {"jsearch": 0, "adzuna": 1, "remotive": 2, "greenhouse": 3, "lever": 4, "ashby": 5}


class AllSourcesFailed(ValueError):
    """Every response of the run was unusable."""


def read_payloads(spark: SparkSession, path: str, provider: str) -> DataFrame:
    """One row per response file; the file's base name is the organisation."""
    return (
        spark.read.text(path, wholetext=True)
        .withColumn("org", F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1))
        .select(F.lit(provider).alias("provider"), "org", F.col("value").alias("body"))
    )


def _says_remote(*values: Column) -> Column:
    found = F.lit(False)
    for value in values:
        found = found | F.contains(F.lower(F.coalesce(value, F.lit(""))), F.lit("remote"))
    return found


def _time(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) != "", F.try_to_timestamp(text))


def _listing(
    external_id: Column, title: Column, company: Column, location: Column, url: Column,
    description: Column, posted_at: Column, remote: Column, source: str,
) -> list[Column]:
    return [
        external_id.alias("external_id"),
        F.coalesce(title, F.lit("Untitled role")).alias("title"),
        company.alias("company"),
        location.alias("location"),
        F.coalesce(url, F.lit("")).alias("url"),
        description.alias("description"),
        posted_at.alias("posted_at"),
        remote.alias("remote"),
        F.lit(source).alias("source"),
    ]


def _id(prefix: str, id_: Column) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.col("org"), F.lit("-"), id_)


def _greenhouse(job: Column) -> list[Column]:
    place = job["location"]["name"]
    return _listing(
        _id("greenhouse", job["id"]), job["title"],
        F.coalesce(job["company_name"], title_case_token(F.col("org"))), place,
        job["absolute_url"], job["content"], _time(job["updated_at"]), _says_remote(place),
        "greenhouse",
    )


def _lever(job: Column) -> list[Column]:
    place = job["categories"]["location"]
    created = F.when(job["createdAt"] != 0, F.timestamp_millis(job["createdAt"]))
    remote = F.coalesce(job["workplaceType"] == "remote", F.lit(False)) | _says_remote(place)
    return _listing(
        _id("lever", job["id"]), job["text"], title_case_token(F.col("org")), place,
        job["hostedUrl"], F.coalesce(job["descriptionPlain"], job["description"]), created, remote,
        "lever",
    )


def _ashby(job: Column) -> list[Column]:
    remote = F.coalesce(job["isRemote"], F.lit(False)) | _says_remote(job["location"])
    return _listing(
        _id("ashby", job["id"]), job["title"],
        F.coalesce(job["organizationName"], title_case_token(F.col("org"))), job["location"],
        job["jobUrl"], job["descriptionPlain"], _time(job["publishedAt"]), remote, "ashby",
    )


def _remotive(job: Column) -> list[Column]:
    return _listing(
        F.concat(F.lit("remotive-"), job["id"]), job["title"],
        F.coalesce(job["company_name"], F.lit("Unknown")), job["candidate_required_location"],
        job["url"], job["description"], _time(job["publication_date"]), F.lit(True), "remotive",
    )


def _jsearch(job: Column) -> list[Column]:
    # A row without id or link gets a hash of itself, so reruns agree.
    own = F.concat(F.lit("row-"), F.sha2(F.to_json(job), 256))
    blank = lambda c: F.nullif(c, F.lit(""))
    place = F.nullif(F.concat_ws(", ", blank(job["job_city"]), blank(job["job_state"])), F.lit(""))
    return _listing(
        F.coalesce(job["job_id"], job["job_apply_link"], own), job["job_title"],
        F.coalesce(job["employer_name"], F.lit("Unknown")), place, job["job_apply_link"],
        job["job_description"], _time(job["job_posted_at_datetime_utc"]), job["job_is_remote"],
        "jsearch",
    )


def _adzuna(job: Column) -> list[Column]:
    return _listing(
        F.coalesce(job["id"], job["redirect_url"]), job["title"],
        F.coalesce(job["company"]["display_name"], F.lit("Unknown")),
        job["location"]["display_name"], job["redirect_url"], job["description"],
        _time(job["created"]), F.lit(None).cast("boolean"), "adzuna",
    )


_PROVIDERS = {
    "jsearch": (schemas.JSEARCH, "data", _jsearch),
    "adzuna": (schemas.ADZUNA, "results", _adzuna),
    "remotive": (schemas.REMOTIVE, "jobs", _remotive),
    "greenhouse": (schemas.GREENHOUSE, "jobs", _greenhouse),
    "lever": (schemas.LEVER, None, _lever),
    "ashby": (schemas.ASHBY, "jobs", _ashby),
}


def _parsed(payloads: DataFrame, provider: str) -> DataFrame:
    schema, envelope, _ = _PROVIDERS[provider]
    jobs = F.from_json("body", schema)
    if envelope:
        jobs = jobs[envelope]
    return payloads.where(F.col("provider") == provider).withColumn("jobs", jobs)


def listings(payloads: DataFrame) -> DataFrame:
    """All providers' listings with ``adapter_rank`` and ``pos`` for merge order."""
    out = None
    for provider, (_, _, mapping) in _PROVIDERS.items():
        rows = (
            _parsed(payloads, provider)
            .select("org", F.posexplode("jobs").alias("pos", "job"))
            .select(
                *mapping(F.col("job")),
                F.lit(PROVIDER_RANK[provider]).alias("adapter_rank"),
                "org",
                F.col("pos").cast("long").alias("pos"),
            )
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def _broken() -> Column:
    return F.col("body").isNull() | F.try_parse_json(F.col("body")).isNull()


def failures(payloads: DataFrame) -> DataFrame:
    """Responses that are not valid JSON, one row each: ``provider, org, message``."""
    return payloads.where(_broken()).select(
        "provider", "org",
        F.concat(F.col("provider"), F.lit(' board "'), F.col("org"), F.lit('" returned invalid JSON')).alias("message"),
    )


def search(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Listings and failures. Raises only when there were responses and all of them failed.

    A bad response costs only itself: others of the same board are read.
    """
    failed = failures(payloads)
    good = payloads.where(~_broken())
    if good.isEmpty() and not payloads.isEmpty():
        raise AllSourcesFailed(failed.select("message").first()[0])
    return listings(good), failed


def contacts(people: DataFrame) -> DataFrame:
    """``(company, body)`` responses to contacts; the asked-for company is the fallback."""
    person = F.col("person")
    return people.select(
        "company", F.explode(F.from_json("body", schemas.PEOPLE)["people"]).alias("person")
    ).select(
        F.coalesce(person["name"], F.lit("Unknown")).alias("name"),
        person["title"].alias("title"),
        F.coalesce(person["organization"]["name"], F.col("company")).alias("company"),
        F.when(
            (F.coalesce(person["email"], F.lit("")) != "")
            & ~F.contains(person["email"], F.lit(vocab.LOCKED_EMAIL)),
            person["email"],
        ).alias("email"),
        person["linkedin_url"].alias("linkedin_url"),
        F.lit("apollo").alias("source"),
    )


def contacts_for(applications: DataFrame, people: DataFrame, failed: DataFrame) -> DataFrame:
    """People at each application's company; an application without any keeps one row.

    ``reason`` says why there was nothing to search: no company name, or the lookup of
    that company failed (``failed`` has ``company, message``, one row per company).
    """
    wanted = applications.withColumn("__company", optional(F.col("company")))
    hits = people.withColumnRenamed("company", "__company")
    trouble = failed.select(F.col("company").alias("__company"), F.col("message").alias("__message"))
    return (
        wanted.join(hits, "__company", "left")
        .join(trouble, "__company", "left")
        .withColumn(
            "reason",
            F.when(F.col("__company").isNull(), "This application has no company name to search on.").otherwise(
                F.col("__message")
            ),
        )
        .drop("__company", "__message")
    )


def board_targets(companies: DataFrame, key: str, csv: str) -> DataFrame:
    """Comma-separated board tokens to ``(key, pos, board, token)``.

    A bare token names all three boards, ``lever:acme`` names one. The first
    sighting of a board and token wins, case-insensitively. Deduplication is
    inside the row the text came from, so nothing is shuffled.
    """
    boards = F.array(*[F.lit(b) for b in vocab.COMPANY_BOARDS])
    entries = F.filter(
        F.transform(F.split(F.coalesce(F.col(csv), F.lit("")), ","), lambda e: optional(e)),
        lambda e: e.isNotNull(),
    )

    def expand(entry: Column, at: Column) -> Column:
        head = F.lower(F.trim(F.substring_index(entry, ":", 1)))
        pinned = head.isin(*vocab.COMPANY_BOARDS)
        token = optional(F.when(pinned, F.regexp_replace(entry, "^[^:]*:?", "")).otherwise(entry))
        chosen = F.when(pinned, F.array(head)).otherwise(boards)
        return F.transform(
            chosen,
            lambda b: F.struct(
                F.concat_ws(":", b, F.lower(token)).alias("k"), at.alias("at"),
                b.alias("board"), token.alias("token"),
            ),
        )

    targets = F.filter(F.flatten(F.transform(entries, expand)), lambda t: t["token"].isNotNull())
    by_key = companies.select(key, F.array_sort(targets).alias("sorted"))
    first = F.filter(
        F.col("sorted"),
        lambda t, i: (i == 0) | (F.get(F.col("sorted"), i - 1)["k"] != t["k"]),
    )
    return by_key.select(key, F.explode(first).alias("t")).select(
        key, F.col("t.at").alias("pos"), F.col("t.board").alias("board"), F.col("t.token").alias("token")
    )


def posting_lookup(references: DataFrame, feed: DataFrame) -> DataFrame:
    """Find referenced postings in fetched boards; ``gone`` when the board answered without it.

    ``references`` has ``board, org, job_id``; ``feed`` is ``listings`` output. Ids
    are compared without case. A board with no response at all is not evidence
    that a posting is gone.
    """
    wanted = references.withColumn(
        "k", F.lower(F.concat_ws("-", F.col("board"), F.col("org"), F.col("job_id")))
    )
    found = feed.withColumn("k", F.lower("external_id")).groupBy("k").agg(
        F.min_by(F.struct(*schemas.LISTING_COLUMNS), F.struct("adapter_rank", "org", "pos")).alias("listing")
    )
    answered = feed.select(F.col("source").alias("board"), "org").distinct().withColumn("answered", F.lit(True))
    return (
        wanted.join(found, "k", "left")
        .join(answered, ["board", "org"], "left")
        .select(
            "board", "org", "job_id", "listing.*",
            (F.col("listing").isNull() & F.coalesce("answered", F.lit(False))).alias("gone"),
            posting_page_url(F.col("board"), F.col("org"), F.col("job_id")).alias("page_url"),
        )
    )
