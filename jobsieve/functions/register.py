"""The plain scalars as SQL functions, for use in ``spark.sql``.

They are SQL expressions, so the optimiser inlines them like any other column.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .. import schemas, vocab
from .text import SPACE

_SPACE = SPACE.replace("\\", "\\\\")
_TRIM = f"regexp_replace({{}}, '^{_SPACE}+|{_SPACE}+$', '')"
_FUNCTIONS = (
    (
        "fold_plural(token STRING) RETURNS STRING",
        """CASE WHEN length(token) > 3 AND token LIKE '%ies' THEN concat(left(token, length(token) - 3), 'y')
             WHEN length(token) > 4 AND token RLIKE '(?:ses|xes|zes|ches|shes)$' THEN left(token, length(token) - 2)
             WHEN length(token) > 2 AND token LIKE '%s' AND NOT token RLIKE '(?:ss|us|is)$' THEN left(token, length(token) - 1)
             ELSE token END""",
    ),
    ("squash(value STRING) RETURNS STRING", f"lower(trim(regexp_replace(value, '{_SPACE}+', ' ')))"),
    (
        "date_shape(value STRING) RETURNS STRING",
        r"""CASE WHEN value RLIKE '^\\d{4}(-\\d{1,2})?$' THEN 'iso'
              WHEN value RLIKE '^[A-Za-z]{3,9}\\.?\\s+\\d{4}$' THEN 'month-name'
              WHEN value RLIKE '^\\d{1,2}/\\d{4}$' THEN 'slashed' ELSE 'other' END""",
    ),
    (
        "tier_rank(tier STRING) RETURNS INT",
        "CASE tier WHEN 'strong' THEN 0 WHEN 'possible' THEN 1 WHEN 'reach' THEN 2 ELSE 3 END",
    ),
    (
        "day_label(days BIGINT) RETURNS STRING",
        "CASE WHEN days = 0 THEN 'day 0' ELSE concat('day +', CAST(days AS STRING)) END",
    ),
    (
        "whole_days_since(happened TIMESTAMP, moment TIMESTAMP) RETURNS INT",
        "CAST(greatest(0, floor((unix_millis(moment) - unix_millis(happened)) / 86400000)) AS INT)",
    ),
    (
        "add_whole_days(start TIMESTAMP, days BIGINT) RETURNS TIMESTAMP",
        "timestamp_micros(unix_micros(start) + days * 86400000000)",
    ),
    ("optional_text(value STRING) RETURNS STRING", f"nullif({_TRIM.format('value')}, '')"),
    ("required_text(value STRING) RETURNS STRING", f"coalesce({_TRIM.format('value')}, '')"),
    (
        "path_key(path STRING) RETURNS STRING",
        r"array_join(filter(split(regexp_replace(path, '\\[(\\d+)\\]', '.$1'), '\\.'), s -> s <> ''), '.')",
    ),
    (
        "is_pending(status STRING) RETURNS BOOLEAN",
        f"status IN ({', '.join(repr(v) for v in vocab.PENDING_STATUSES)})",
    ),
)


def _leaf_sql(section: str, entry: str, key: str, item: str, value: str, rank: int) -> str:
    at = "'basics'" if section == "basics" else f"concat('{section}[', {entry}, ']')"
    index = "''" if item == "NULL" else f"concat('[', {item}, ']')"
    return (
        f"named_struct('section', '{section}', 'entry', {entry}, 'key', '{key}', 'key_rank', {rank}, 'item', CAST({item} AS INT), "
        f"'path', concat({at}, '.{key}', {index}), 'value', {value})"
    )


def resume_leaves_sql() -> str:
    """The table function ``resume_leaves(content)``: the rows of ``operators.leaves.leaves``."""
    from ..operators.leaves import BASICS, SECTIONS

    parts = ["array(" + ", ".join(_leaf_sql("basics", "0", k, "NULL", f"content.basics.`{k}`", r) for r, k in enumerate(BASICS)) + ")"]
    for section, (fields, items) in SECTIONS.items():
        plain = ", ".join(_leaf_sql(section, "i", f, "NULL", f"e.`{f}`", r) for r, f in enumerate(fields))
        listed = _leaf_sql(section, "i", items, "j", "v", len(fields))
        parts.append(f"flatten(transform(content.{section}, (e, i) -> concat(array({plain}), transform(e.{items}, (v, j) -> {listed}))))")
    columns = "section STRING, entry INT, key STRING, key_rank INT, item INT, path STRING, value STRING"
    names = ", ".join(f"leaf.{c.split()[0]}" for c in columns.split(", "))
    return (
        f"resume_leaves(content {schemas.RESUME_CONTENT}) RETURNS TABLE (leaf_no INT, {columns}) RETURN "
        f"SELECT leaf_no, {names} FROM (SELECT posexplode(concat({', '.join(parts)})) AS (leaf_no, leaf)) WHERE {_TRIM.format('leaf.value')} <> ''"
    )


def register_all(spark: SparkSession) -> list[str]:
    """Create the functions for this session; returns their names."""
    for signature, body in _FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {resume_leaves_sql()}")
    return [signature.split("(")[0] for signature, _ in _FUNCTIONS] + ["resume_leaves"]
