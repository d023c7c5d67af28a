"""Reading title, company and location off a pasted posting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab
from ..functions.text import SPACE, trim


def _clean(value: Column) -> Column:
    """Usable as a field: not blank, not long, not prose."""
    v = trim(F.regexp_replace(trim(value), "[.,;:]+$", ""))
    return F.when((v != "") & (F.length(v) <= vocab.MAX_FIELD_CHARS) & ~v.rlike(rf"[.!?]{SPACE}+\S"), v)


def _is_location(value: Column) -> Column:
    return ~value.rlike(vocab.NOT_A_LOCATION) & (value.rlike(vocab.REMOTE_SEGMENT) | value.rlike(vocab.CITY_STATE))


def _is_name(value: Column) -> Column:
    return (F.length(value) <= 50) & (F.size(F.split(value, f"{SPACE}+")) <= 5)


def _first(values: Column) -> Column:
    return F.get(F.filter(values, lambda v: v.isNotNull()), 0)


def posting_fields(postings: DataFrame, key: str, body: str, max_lines: int | None = None) -> DataFrame:
    """``key, title, company, location``; null where the text does not say.

    A labelled line beats "Title at Company", which beats position. All lines are read, or
    the first ``max_lines`` that are not blank (``vocab.POSTING_FIELD_LINES`` for headings only).
    """
    lines = F.filter(F.transform(F.split(F.col(body), r"\r?\n"), trim), lambda l: l != "")
    if max_lines is not None:
        lines = F.slice(lines, 1, max_lines)
    rows = postings.select(key, lines.alias("lines"))
    def labelled_value(pattern: str) -> Column:
        matching = F.filter("lines", lambda l: l.rlike(pattern))
        return _first(F.transform(matching, lambda l: _clean(F.regexp_extract(l, pattern, 1))))

    labelled = {name: labelled_value(pattern) for name, pattern in vocab.POSTING_LABELS}

    def unlabelled(line: Column) -> Column:
        keep = F.lit(True)
        for _, pattern in vocab.POSTING_LABELS:
            keep = keep & ~line.rlike(pattern)
        return keep

    rows = rows.select(
        key, *[c.alias(f"l_{n}") for n, c in labelled.items()], F.filter("lines", unlabelled).alias("rest")
    )
    segments = F.flatten(F.transform("rest", lambda l: F.split(l, vocab.POSTING_SEGMENT)))
    found_place = _first(
        F.transform(
            segments,
            lambda s: F.when(_clean(s).isNotNull() & _is_location(_clean(s)), _clean(s)),
        )
    )
    headings = F.filter(
        "rest",
        lambda l: ~F.forall(F.split(l, vocab.POSTING_SEGMENT), lambda s: _is_location(trim(s))),
    )
    head = lambda i: _clean(F.get(F.split(F.get(F.col("headings"), i), vocab.POSTING_SEGMENT), 0))
    rows = rows.withColumns({"place": found_place, "headings": headings})
    rows = rows.withColumns({"first": head(0), "second": head(1)})
    paired = F.coalesce(F.col("first").rlike(vocab.TITLE_AT_COMPANY), F.lit(False))
    part = lambda i: _clean(F.regexp_extract("first", vocab.TITLE_AT_COMPANY, i))
    by_position = F.when(F.col("second").isNotNull() & _is_name(F.col("second")), F.col("second"))
    return rows.select(
        key,
        F.coalesce("l_title", F.when(paired, part(1)).otherwise(F.col("first"))).alias("title"),
        F.coalesce("l_company", F.when(paired, part(2)).otherwise(by_position)).alias("company"),
        F.coalesce("l_location", "place").alias("location"),
    )
