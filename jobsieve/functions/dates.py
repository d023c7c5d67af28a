"""Dates as resumes write them, plus fixed-length day arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import vocab
from .text import trim


def _months() -> Column:
    return F.array(*[F.lit(m) for m in vocab.MONTHS])


def month_number(name: Column) -> Column:
    """1-12 for a month name or its abbreviation, 0 when it is neither."""
    return F.array_position(_months(), F.lower(F.left(name, F.lit(3)))).cast("int")


def date_shape(text: Column) -> Column:
    out = None
    for shape, pattern, _ in vocab.DATE_SHAPES:
        out = F.when(text.rlike(pattern), shape) if out is None else out.when(text.rlike(pattern), shape)
    return out.otherwise("other")


def is_ongoing(text: Column) -> Column:
    return F.lower(trim(text)).isin(*vocab.ONGOING)


def month_index(year: Column, month: Column) -> Column:
    return (year * 12 + month - 1).cast("int")


def end_month_index(text: Column) -> Column:
    """Months since year 0; a bare year reads as December; null when unreadable."""
    t = trim(text)
    iso, slashed = r"^(\d{4})(?:-(\d{1,2}))?$", r"^(\d{1,2})/(\d{4})$"
    named = r"^([A-Za-z]{3,9})\.?\s+(\d{4})$"

    def number(pattern: str, group: int) -> Column:
        return F.regexp_extract(t, pattern, group).try_cast("int")

    month = month_number(F.regexp_extract(t, named, 1))
    return (
        F.when(t.rlike(iso), month_index(number(iso, 1), F.coalesce(number(iso, 2), F.lit(12))))
        .when(t.rlike(slashed), month_index(number(slashed, 2), number(slashed, 1)))
        .when(t.rlike(named) & (month > 0), month_index(number(named, 2), month))
    )


def _year_month(year: Column, month: Column) -> Column:
    return F.concat(year, F.lit("-"), F.lpad(month, 2, "0"))


def normalise_date(text: Column) -> Column:
    """``Jun 2021``, ``06/2020``, ``2021/6``, ``2021-6`` to ``YYYY-MM``; open-ended to null."""
    t = trim(text)
    named = r"(?i)^([a-z]+)\.?\s+(\d{4})$"
    iso, slashed, turned = r"^(\d{4})-(\d{1,2})$", r"^(\d{1,2})/(\d{4})$", r"^(\d{4})/(\d{1,2})$"
    g = lambda p, i: F.regexp_extract(t, p, i)
    month = month_number(g(named, 1))
    return (
        F.when((t == "") | F.lower(t).isin(*vocab.OPEN_ENDED), F.lit(None).cast("string"))
        .when(
            t.rlike(named),
            F.when(month > 0, _year_month(g(named, 2), month.cast("string"))).otherwise(g(named, 2)),
        )
        .when(t.rlike(iso), _year_month(g(iso, 1), g(iso, 2)))
        .when(t.rlike(slashed), _year_month(g(slashed, 2), g(slashed, 1)))
        .when(t.rlike(turned), _year_month(g(turned, 1), g(turned, 2)))
        .when(t.rlike(r"^\d{4}$"), t)
    )


_RANGE = (
    rf"(?i)(?<![A-Za-z0-9_])({vocab.DATE_ENDPOINT}){vocab.DATE_JOINER}({vocab.DATE_ENDPOINT})(?![A-Za-z0-9_])"
)
_WHOLE = rf"(?i)^(?:{vocab.DATE_ENDPOINT})$"


def has_date_range(text: Column) -> Column:
    return F.coalesce(text.rlike(_RANGE) | trim(text).rlike(_WHOLE), F.lit(False))


def date_range(text: Column) -> Column:
    """``struct<start, end, span>`` of the first range, or of a line that is one date."""
    ranged, alone = text.rlike(_RANGE), trim(text).rlike(_WHOLE)
    none = F.lit(None).cast("string")
    return F.when(
        ranged | alone,
        F.struct(
            F.when(ranged, normalise_date(F.regexp_extract(text, _RANGE, 1)))
            .otherwise(normalise_date(text))
            .alias("start"),
            F.when(ranged, normalise_date(F.regexp_extract(text, _RANGE, 2)))
            .otherwise(none)
            .alias("end"),
            F.when(ranged, F.regexp_extract(text, _RANGE, 0)).otherwise(trim(text)).alias("span"),
        ),
    )


def human_month(text: Column) -> Column:
    """``2023-03`` to ``Mar 2023``; anything else unchanged."""
    t = trim(text)
    pattern = r"^(\d{4})-(\d{2})$"
    month = F.regexp_extract(t, pattern, 2).try_cast("int")
    return F.when(
        t.rlike(pattern) & month.between(1, 12),
        F.concat(F.initcap(F.get(_months(), month - 1)), F.lit(" "), F.regexp_extract(t, pattern, 1)),
    ).otherwise(text)


def range_label(start: Column, end: Column) -> Column:
    s, e = F.coalesce(start, F.lit("")), F.coalesce(end, F.lit(""))
    return F.when((s == "") & (e == ""), F.lit("")).otherwise(
        F.concat(human_month(s), F.lit(" -- "), F.when(e == "", "Present").otherwise(human_month(e)))
    )


def add_days(at: Column, days: Column) -> Column:
    """Days of exactly 24 hours."""
    return F.timestamp_micros(F.unix_micros(at) + days.cast("long") * F.lit(86_400_000_000))


def whole_days_since(at: Column, now: Column) -> Column:
    millis = F.unix_millis(now) - F.unix_millis(at)
    return F.greatest(F.lit(0).cast("long"), F.floor(millis / F.lit(86_400_000))).cast("int")


def age_label(at: Column, now: Column) -> Column:
    """``5m ago``, ``3h ago``, ``2d ago``; halves round up at each step."""
    def rounded(x: Column) -> Column:
        return F.floor(x + F.lit(0.5))

    minutes = rounded((F.unix_millis(now) - F.unix_millis(at)) / F.lit(60_000))
    hours = rounded(minutes / F.lit(60))
    return (
        F.when(minutes < 60, F.concat(F.greatest(F.lit(1).cast("long"), minutes).cast("string"), F.lit("m ago")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
        .otherwise(F.concat(rounded(hours / F.lit(24)).cast("string"), F.lit("d ago")))
    )
