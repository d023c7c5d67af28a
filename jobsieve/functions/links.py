"""Posting links: canonical form, match key, and the board posting they name."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import vocab
from .text import optional, squash, trim

_ABSOLUTE = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#\s]+)([^?#\s]*)(?:\?([^#\s]*))?(?:#\S*)?$"


def _part(text: Column, group: int) -> Column:
    return F.regexp_extract(text, _ABSOLUTE, group)


def is_url(text: Column) -> Column:
    return trim(text).rlike(_ABSOLUTE)


def host(text: Column) -> Column:
    """Lower-case host with its port, without user, ``www.`` or a default port."""
    t = trim(text)
    site = F.regexp_replace(F.lower(_part(t, 2)), r"^.*@", "")
    usual = F.when(F.lower(_part(t, 1)) == "https", F.regexp_replace(site, ":443$", "")).when(
        F.lower(_part(t, 1)) == "http", F.regexp_replace(site, ":80$", "")
    )
    return F.regexp_replace(F.coalesce(usual, site), r"^www\.", "")


def path(text: Column) -> Column:
    return _part(trim(text), 3)


def query_param(text: Column, name: str) -> Column:
    pairs = F.split(_part(trim(text), 4), "&")
    first = F.get(F.filter(pairs, lambda p: p.startswith(f"{name}=")), 0)
    return F.nullif(F.substr(first, F.lit(len(name) + 2)), F.lit(""))


def _decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def _kept_query(text: Column) -> Column:
    """Parameters that say which posting it is, in key order, decoded."""
    pairs = F.filter(F.split(_part(text, 4), "&"), lambda p: p != "")
    keyed = F.transform(
        pairs,
        lambda p, i: F.struct(
            _decoded(F.substring_index(p, "=", 1)).alias("k"),
            i.alias("i"),
            _decoded(F.regexp_replace(p, "^[^=]*=?", "")).alias("v"),
        ),
    )
    kept = F.array_sort(F.filter(keyed, lambda s: ~s["k"].rlike(vocab.TRACKING_PARAM)))
    joined = F.array_join(F.transform(kept, lambda s: F.concat(s["k"], F.lit("="), s["v"])), "&")
    return F.when(joined == "", "").otherwise(F.concat(F.lit("?"), joined))


def _tail(text: Column) -> Column:
    return F.concat(host(text), F.regexp_replace(path(text), "/+$", ""), _kept_query(text))


def canonical_url(raw: Column) -> Column:
    """Scheme, host, path and identifying parameters; null for blank, raw when not a URL."""
    t = optional(raw)
    return F.when(
        t.rlike(_ABSOLUTE), F.concat(F.lower(_part(t, 1)), F.lit("://"), _tail(t))
    ).otherwise(t)


def url_match_key(raw: Column) -> Column:
    """The canonical form without its scheme, so http and https agree."""
    t = trim(raw)
    return F.when(t.rlike(_ABSOLUTE), _tail(t)).otherwise(F.lower(t))


def listing_key(url: Column, title: Column, company: Column) -> Column:
    """The second identity of a listing; null when it has no link."""
    return F.when(
        F.coalesce(url, F.lit("")) != "",
        F.concat_ws(
            "|",
            F.concat(F.lit("url:"), url_match_key(url)),
            squash(F.coalesce(title, F.lit(""))),
            squash(F.coalesce(company, F.lit(""))),
        ),
    )


def board_reference(raw: Column) -> Column:
    """``struct<board, org, job_id>`` for a link to one board posting, else null."""
    t = optional(raw)
    site = host(t)
    parts = F.filter(F.split(path(t), "/"), lambda p: p != "")
    first, second, third = F.get(parts, 0), F.get(parts, 1), F.get(parts, 2)
    embedded = first == "embed"
    gh_org = F.when(embedded, query_param(t, "for")).otherwise(first)
    gh_job = F.when(embedded, query_param(t, "token")).otherwise(
        F.coalesce(F.when(second == "jobs", third), query_param(t, "gh_jid"))
    )
    board = (
        F.when(site.isin(*vocab.GREENHOUSE_HOSTS), "greenhouse")
        .when(site.isin(*vocab.LEVER_HOSTS), "lever")
        .when(site.isin(*vocab.ASHBY_HOSTS), "ashby")
    )
    org = F.when(board == "greenhouse", gh_org).otherwise(first)
    job = F.when(board == "greenhouse", gh_job).otherwise(second)
    return F.when(
        t.rlike(_ABSOLUTE) & board.isNotNull() & org.isNotNull() & job.isNotNull(),
        F.struct(board.alias("board"), org.alias("org"), job.alias("job_id")),
    )


def posting_page_url(board: Column, org: Column, job_id: Column) -> Column:
    return (
        F.when(board == "greenhouse", F.concat(F.lit("https://job-boards.greenhouse.io/"), org, F.lit("/jobs/"), job_id))
        .when(board == "lever", F.concat(F.lit("https://jobs.lever.co/"), org, F.lit("/"), job_id))
        .when(board == "ashby", F.concat(F.lit("https://jobs.ashbyhq.com/"), org, F.lit("/"), job_id))
    )
