"""Record-level predicates and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .. import vocab
from .text import SPACE, optional, trim


def is_pending(status: Column) -> Column:
    return status.isin(*vocab.PENDING_STATUSES)


def in_vocabulary(value: Column, allowed: Sequence[str]) -> Column:
    return F.coalesce(value.isin(*allowed), F.lit(False))


def contact_source(raw: Column) -> Column:
    value = F.lower(trim(F.coalesce(raw, F.lit(""))))
    return (
        F.when(value.isin(*vocab.CONTACT_SOURCES), value)
        .when(F.contains(value, F.lit("linkedin")), "linkedin")
        .when(F.contains(value, F.lit("brightdata")), "brightdata")
        .when(F.contains(value, F.lit("apollo")), "apollo")
        .otherwise("manual")
    )


def looks_like_email(text: Column) -> Column:
    return text.rlike(vocab.EMAIL_SHAPE)


def query_key(keywords: Column, location: Column, remote_only: Column) -> Column:
    """Identity of a saved search; the page is not part of it."""
    return F.to_json(
        F.struct(
            F.lower(trim(F.coalesce(keywords, F.lit("")))).alias("keywords"),
            F.lower(trim(F.coalesce(location, F.lit("")))).alias("location"),
            F.coalesce(remote_only, F.lit(False)).alias("remoteOnly"),
        )
    )


def query_label(keywords: Column, location: Column, remote_only: Column) -> Column:
    joined = F.concat_ws(
        " · ", optional(keywords), optional(location), F.when(remote_only, "remote")
    )
    return F.when(joined == "", "any role").otherwise(joined)


def missing_body(source: Column, url: Column) -> Column:
    """The sentence that stands in for a body the source did not return."""
    link = optional(url)
    return F.concat(
        F.lit(f"{vocab.NO_DESCRIPTION} "),
        source,
        F.lit(" for this listing."),
        F.when(link.isNotNull(), F.concat(F.lit(" Open "), link, F.lit(" for the full posting."))).otherwise(""),
    )


def body_of(description: Column, source: Column, url: Column) -> Column:
    return F.coalesce(optional(description), missing_body(source, url))


def is_missing_body(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+", "").startswith(vocab.NO_DESCRIPTION)


def refreshed_body(stored: Column, incoming: Column) -> Column:
    """Which body to keep when a posting is seen again."""
    blank = trim(stored) == ""
    return (
        F.when(is_missing_body(incoming), F.when(blank, incoming).otherwise(stored))
        .when(blank | is_missing_body(stored), incoming)
        .when(F.length(incoming) > F.length(stored), incoming)
        .otherwise(stored)
    )


def is_unconfirmed(status: Column, sent_at: Column) -> Column:
    """A send was claimed but never confirmed."""
    return sent_at.isNotNull() & is_pending(status)


def step_state(status: Column, sent_at: Column) -> Column:
    return F.when(is_unconfirmed(status, sent_at), "unconfirmed").otherwise(status)


def day_label(cumulative_offset: Column) -> Column:
    return F.when(cumulative_offset == 0, "day 0").otherwise(
        F.concat(F.lit("day +"), cumulative_offset.cast("string"))
    )


def message_text(subject: Column, body: Column, name: Column, email: Column) -> Column:
    filled = lambda c: F.nullif(c, F.lit(""))
    recipient = F.concat_ws(
        " ", filled(name), F.concat(F.lit("<"), filled(email), F.lit(">"))
    )
    return F.concat(
        F.when(recipient != "", F.concat(F.lit("To: "), recipient, F.lit("\n"))).otherwise(""),
        F.lit("Subject: "), subject, F.lit("\n\n"), body,
    )


def tier_verdict(tier: Column) -> Column:
    return F.when(tier == "strong", "pass").when(tier.isin("possible", "reach"), "warn")


def tier_word(tier: Column) -> Column:
    out = None
    for key, word in vocab.TIER_WORDS.items():
        out = F.when(tier == key, word) if out is None else out.when(tier == key, word)
    return out


def tier_rank(tier: Column) -> Column:
    return (
        F.when(tier == "strong", 0).when(tier == "possible", 1).when(tier == "reach", 2).otherwise(3)
    )


def page_identity(title: Column, markdown: Column, url: Column) -> Column:
    """``struct<title, company>`` from a page heading, or its host."""
    first_heading = optional(F.regexp_extract(markdown, r"(?m)^#\s+(.+)$", 1))
    heading = F.coalesce(optional(title), first_heading, url)
    parts = F.split(heading, rf"{SPACE}+[—–|·\-]{SPACE}+")
    site = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/:?#]+)", 1)), r"^www\.", "")
    return F.struct(
        trim(F.coalesce(F.get(parts, 0), heading)).alias("title"),
        trim(F.coalesce(F.get(parts, 1), site)).alias("company"),
    )


def path_key(path: Column) -> Column:
    """One spelling for bracket and dot paths."""
    dotted = F.regexp_replace(path, r"\[(\d+)\]", ".$1")
    return F.array_join(F.filter(F.split(dotted, r"\."), lambda s: s != ""), ".")


def first_three(paths: Column) -> Column:
    """The first three entries, then how many more there are."""
    extra = F.size(paths) - 3
    return F.concat(
        F.array_join(F.slice(paths, 1, 3), ", "),
        F.when(extra > 0, F.concat(F.lit(", +"), extra.cast("string"), F.lit(" more"))).otherwise(""),
    )
