"""Nested resume documents as addressed text leaves.

All leaves of one document come from one row, so flattening is a generator inside the
scan and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import filled

BASICS = ("name", "label", "email", "phone", "url", "location", "summary")
SECTIONS = {
    "experience": (("company", "title", "location", "start", "end"), "bullets"),
    "education": (("institution", "degree", "location", "start", "end"), "bullets"),
    "skills": (("category",), "items"),
    "projects": (("name", "description", "url"), "bullets"),
    "custom": (("title",), "bullets"),
}
SECTION_RANK = {"basics": 0, **{s: i + 1 for i, s in enumerate(SECTIONS)}}


def _leaf(section: str, entry: Column, key: str, item: Column, value: Column, rank: int, back: Column | None = None) -> Column:
    """``item`` is null for a plain field and the list index for a list element."""
    at = F.lit(section) if section == "basics" else F.concat(F.lit(section), F.lit("["), entry.cast("string"), F.lit("]"))
    path = F.concat(at, F.lit("."), F.lit(key))
    path = F.when(item.isNull(), path).otherwise(F.concat(path, F.lit("["), item.cast("string"), F.lit("]")))
    return F.struct(
        F.lit(section).alias("section"),
        entry.cast("int").alias("entry"),
        F.lit(key).alias("key"),
        F.lit(rank).alias("key_rank"),
        item.cast("int").alias("item"),
        path.alias("path"),
        value.alias("value"),
        *([] if back is None else [back.alias("back")]),
    )


def _section_leaves(content: Column, section: str, back: Column | None) -> Column:
    fields, items = SECTIONS[section]

    def entry_leaves(entry: Column, i: Column) -> Column:
        other = None if back is None else F.get(back[section], i)
        plain = F.array(
            *[_leaf(section, i, f, F.lit(None).cast("int"), entry[f], r, None if other is None else other[f]) for r, f in enumerate(fields)]
        )
        listed = F.transform(
            entry[items],
            lambda v, j: _leaf(section, i, items, j, v, len(fields), None if other is None else F.get(other[items], j)),
        )
        return F.concat(plain, listed)

    return F.flatten(F.transform(content[section], entry_leaves))


def leaf_array(content: Column, back: Column | None = None, sections: Sequence[str] = tuple(SECTIONS)) -> Column:
    """Every leaf of the basics and ``sections`` in document order, blanks included.

    With another document as ``back``, each leaf also has that document's value at its path.
    """
    basics = F.array(
        *[
            _leaf("basics", F.lit(0), k, F.lit(None).cast("int"), content["basics"][k], r, None if back is None else back["basics"][k])
            for r, k in enumerate(BASICS)
        ]
    )
    return F.concat(basics, *[_section_leaves(content, s, back) for s in sections])


def leaves(resumes: DataFrame, key: str, content: str = "content") -> DataFrame:
    """Non-blank leaves: ``key, leaf_no, section, entry, key, key_rank, item, path, value``."""
    return (
        resumes.select(key, F.posexplode(leaf_array(F.col(content))).alias("leaf_no", "l"))
        .select(key, "leaf_no", "l.*")
        .where(filled(F.col("value")))
    )


def _unsearchable(section: Column, key: Column) -> Column:
    return key.isin("start", "end", "phone") | ((section == "projects") & (key == "url"))


def searchable(leaf_rows: DataFrame) -> DataFrame:
    """Fields a phrase may be found in: no dates, no phone, no project link."""
    return leaf_rows.where(~_unsearchable(F.col("section"), F.col("key")))


def searchable_values(content: Column) -> Column:
    """The same fields as an array inside the document's row, without their addresses."""
    hidden = ("start", "end", "phone")

    def section_values(section: str) -> Column:
        fields, items = SECTIONS[section]
        kept = [f for f in fields if f not in hidden and (section, f) != ("projects", "url")]
        return F.flatten(F.transform(content[section], lambda e: F.concat(F.array(*[e[f] for f in kept]), e[items])))

    basics = F.array(*[content["basics"][k] for k in BASICS if k not in hidden])
    return F.concat(basics, *[section_values(s) for s in SECTIONS])


def _is_prose(s: Column, k: Column) -> Column:
    return (
        ((s == "basics") & k.isin("label", "summary"))
        | ((s == "experience") & (k == "title"))
        | ((s == "projects") & (k == "description"))
        | (k == "bullets")
    )


def prose(leaf_rows: DataFrame) -> DataFrame:
    """Label, summary, job titles, project descriptions and all bullets."""
    return leaf_rows.where(_is_prose(F.col("section"), F.col("key")))


def prose_leaves(resumes: DataFrame, key: str, content: str = "content") -> DataFrame:
    """``prose`` of the non-blank leaves as ``key, section, entry, key, key_rank, item, path, value``; no other field becomes a row."""
    c = F.col(content)
    whole = F.flatten(F.transform(c["skills"], lambda g: g["items"])).isNotNull()  # as for all leaves, a missing list leaves none
    kept = F.filter(leaf_array(c, sections=[s for s in SECTIONS if s != "skills"]), lambda l: _is_prose(l["section"], l["key"]))
    return resumes.select(key, F.explode(F.when(whole, kept)).alias("l")).select(key, "l.*").where(filled(F.col("value")))


def dated(leaf_rows: DataFrame) -> DataFrame:
    """Start and end fields that hold a date, not an ongoing word."""
    from ..functions.dates import is_ongoing

    return leaf_rows.where(
        F.col("section").isin("experience", "education")
        & F.col("key").isin("start", "end")
        & ~is_ongoing(F.col("value"))
    )


def empty_entries(c: Column) -> Column:
    """Entries that print as a heading with nothing under them, as ``path, detail``."""
    def issue(section: str, label: str, fallback: str, tail: str, empty) -> Column:
        marked = F.transform(
            c[section],
            lambda e, i: F.when(
                empty(e),
                F.struct(
                    F.concat(F.lit(section), F.lit("["), i.cast("string"), F.lit("]")).alias("path"),
                    F.concat(
                        F.lit(section), F.lit("["), i.cast("string"), F.lit("] ("),
                        F.coalesce(F.nullif(e[label], F.lit("")), F.lit(fallback)), F.lit(f") {tail}"),
                    ).alias("detail"),
                ),
            ),
        )
        return F.filter(marked, lambda m: m.isNotNull())

    return F.concat(
        issue("experience", "company", "untitled role",
              "lists no bullets, so it prints as a heading with nothing under it.",
              lambda e: F.size(e["bullets"]) == 0),
        issue("projects", "name", "untitled project", "has no description and no bullets.",
              lambda e: (F.size(e["bullets"]) == 0) & (F.coalesce(e["description"], F.lit("")) == "")),
        issue("skills", "category", "untitled group", "lists no items.",
              lambda e: F.size(e["items"]) == 0),
        issue("custom", "title", "untitled section", "lists no lines.",
              lambda e: F.size(e["bullets"]) == 0),
    )


def empty_sections(resumes: DataFrame, key: str, content: str = "content") -> DataFrame:
    """``empty_entries`` as rows."""
    return resumes.select(key, F.posexplode(empty_entries(F.col(content))).alias("n", "i")).select(key, "n", "i.path", "i.detail")


def _node(path: Column, kind: str, size: Column, value: Column) -> Column:
    return F.struct(
        path.alias("node_path"), F.lit(kind).alias("node_kind"),
        size.cast("int").alias("node_size"), value.cast("string").alias("node_value"),
    )


def _entry_nodes(section: str, items: str):
    def entry(e: Column, i: Column) -> Column:
        at = F.concat(F.lit(f"{section}."), i.cast("string"))
        none = F.lit(None)
        return F.array(
            _node(at, "record", none, none),
            _node(F.concat(at, F.lit(f".{items}")), "list", F.size(e[items]), none),
        )

    return entry


def node_array(content: Column) -> Column:
    """Every address in the document: texts, lists and records, in dotted spelling."""
    none = F.lit(None)
    leaf_nodes = F.transform(
        F.filter(leaf_array(content), lambda l: l["value"].isNotNull()),
        lambda l: _node(F.regexp_replace(l["path"], r"\[(\d+)\]", ".$1"), "text", none, l["value"]),
    )
    parts = [leaf_nodes, F.array(_node(F.lit("basics"), "record", none, none))]
    for section, (_, items) in SECTIONS.items():
        parts.append(F.array(_node(F.lit(section), "list", F.size(content[section]), none)))
        parts.append(F.flatten(F.transform(content[section], _entry_nodes(section, items))))
    return F.concat(*parts)


def nodes(resumes: DataFrame, key: str, content: str = "content") -> DataFrame:
    """``key, node_path, node_kind, node_size, node_value``; unique per key and path."""
    return resumes.select(key, F.inline(node_array(F.col(content))))
