"""Differences between two versions of a field, a list or a nested document.

Elements are paired by value and occurrence number, so no walk is needed. Every
group here is one list of one row pair, bounded by the row it came from.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import vocab
from ..functions.text import words
from ..plans.once import computed
from . import leaves as L


def field_change(was: Column, now: Column) -> Column:
    """``edit``, ``add``, ``remove`` or null when nothing changed."""
    a, b = F.coalesce(was, F.lit("")), F.coalesce(now, F.lit(""))
    return F.when(a == b, F.lit(None).cast("string")).when(a == "", "add").when(b == "", "remove").otherwise("edit")


def list_diff(pairs: DataFrame, keys: Sequence[str], was: str = "was", now: str = "now", path: str = "path") -> DataFrame:
    """Changes between two string lists: ``keys, seq, kind, path, was_text, now_text``.

    Equal lists give nothing, the same items in another order one reorder. Otherwise
    items left over on both sides pair up as edits in order, the rest are additions or
    removals, and a reorder is added when the kept items changed order. ``seq`` orders
    the changes. The pairs are shuffled once, by their keys; nothing is joined.
    """
    keys = list(keys)
    lists = pairs.select(*keys, F.col(path).alias("path"), F.col(was).alias("was"), F.col(now).alias("now"))
    return _list_changes(_dealt(lists, keys, _length("was") + _length("now")), keys)


#: List items for which one task is reckoned; as rows of a window they take a few hundred bytes each.
TASK_ITEMS = 250_000


def _length(items: Column | str) -> Column:
    return F.coalesce(F.array_size(items), F.lit(0)).cast("long")


def _dealt(rows: DataFrame, keys: Sequence[str], items: Column) -> DataFrame:
    """``rows`` shuffled by ``keys`` into tasks enough for their ``items``.

    A row of lists is small until its items are rows; partitions joined by the size of the
    shuffle would hold far too many of them, so the items are counted first.
    """
    total = rows.agg(F.coalesce(F.sum(items), F.lit(0))).first()[0]
    tasks = -(-total // TASK_ITEMS)
    return rows.repartition(max(tasks, rows.sparkSession.sparkContext.defaultParallelism), *keys)


def _list_changes(lists: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``list_diff`` of rows that are already together by (some of) their keys.

    Both lists become rows of one table. An item's number among its equals on its own side
    meets the same number on the other side in a window; items alone there are left over.
    """
    none = F.lit(None).cast("string")
    lists = lists.select(*keys, "path", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("was", "now")])
    differing = computed(lists.where(F.col("was") != F.col("now")), moved=F.array_sort("was") == F.array_sort("now"))

    def items(side: int, name: str) -> Column:
        one = lambda v, i: F.struct(F.lit(side).alias("side"), i.alias("i"), v.alias("value"))
        whole = F.array(F.array_join(name, " · "))
        return F.transform(F.when(F.col("moved"), whole).otherwise(F.col(name)), one)

    rows = differing.select(*keys, "path", "moved", F.inline(F.concat(items(0, "was"), items(1, "now"))))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys, "side", "value").orderBy("i")))
    met = Window.partitionBy(*keys, "value", "nth")
    rows = rows.select(
        *keys, "path", "moved", "side", "i", "value",
        (~F.col("moved") & (F.count(F.lit(1)).over(met) == 2)).alias("kept"),
        F.min(F.when(F.col("side") == 0, F.col("i"))).over(met).alias("was_i"),
    )
    along = Window.partitionBy(*keys, "kept", "side").orderBy("i")
    falls = F.col("kept") & (F.col("side") == 1) & (F.col("was_i") < F.lag("was_i").over(along))
    slots = rows.withColumn("falls", F.coalesce(falls, F.lit(False))).withColumn(
        "slot", F.when(F.col("kept"), 0).otherwise(F.row_number().over(along))
    )
    item = F.struct("i", "value")
    changes = slots.groupBy(*keys, "path", "moved", "slot").agg(
        F.max(F.when(F.col("side") == 0, item)).alias("w"), F.max(F.when(F.col("side") == 1, item)).alias("n"),
        F.max("falls").alias("falls"),
    ).where((F.col("slot") > 0) | F.col("falls"))
    whole = F.col("moved") | (F.col("slot") == 0)
    has_was, has_now = F.col("w").isNotNull(), F.col("n").isNotNull()
    at = F.coalesce("n.i", "w.i").cast("string")
    return changes.select(
        *keys,
        F.when(F.col("moved"), 0).when(whole, 2_000_000_000).when(has_now, F.col("n.i")).otherwise(F.col("w.i") + 1_000_000_000)
        .cast("long").alias("seq"),
        F.when(whole, "reorder").when(has_was & has_now, "edit").when(has_now, "add").otherwise("remove").alias("kind"),
        F.when(whole, F.col("path")).otherwise(F.concat(F.col("path"), F.lit("["), at, F.lit("]"))).alias("path"),
        F.when(F.col("slot") == 0, none).otherwise(F.col("w.value")).alias("was_text"),
        F.when(F.col("slot") == 0, none).otherwise(F.col("n.value")).alias("now_text"),
    )


_IDENTITY = {
    "experience": lambda e: F.concat_ws("\u0001", e["company"], e["title"]),
    "education": lambda e: e["institution"],
    "skills": lambda e: e["category"],
    "projects": lambda e: e["name"],
    "custom": lambda e: e["title"],
}
_SUMMARY = {
    "experience": lambda e: F.concat(e["title"], F.lit(" — "), e["company"]),
    "education": lambda e: F.concat(F.coalesce(e["degree"], F.lit("Study")), F.lit(" — "), e["institution"]),
    "skills": lambda e: F.concat(e["category"], F.lit(": "), F.array_join(e["items"], ", ")),
    "projects": lambda e: e["name"],
    "custom": lambda e: e["title"],
}
# Sections whose plain fields are compared; in the others the identity is the only field.
_COMPARED = {"experience", "education", "projects"}


_FIELDS = "array<struct<key:string,value:string>>"


def _plain_fields(e: Column, names: Sequence[str]) -> Column:
    values = [F.struct(F.lit(f).alias("key"), F.coalesce(e[f], F.lit("")).alias("value")) for f in names]
    return F.array(*values).cast(_FIELDS)


def _entry(side: int, section: str, i: Column, value: Column, summary: Column, fields: Column, key: str, items: Column) -> Column:
    return F.struct(
        F.lit(side).alias("side"), F.lit(section).alias("section"), i.alias("i"), value.alias("value"), summary.alias("summary"),
        fields.alias("fields"), F.lit(key).alias("list_key"), items.alias("list"),
    )


def _entry_array(content: Column, side: int) -> Column:
    """All entries of a document; the basics are one entry that both sides always have."""

    def listed(section: str, fields: tuple[str, ...], items: str) -> Column:
        compared = fields if section in _COMPARED else ()
        return F.transform(
            content[section],
            lambda e, i: _entry(
                side, section, i, _IDENTITY[section](e), _SUMMARY[section](e), _plain_fields(e, compared), items, e[items]
            ),
        )

    none = F.lit(None).cast("string")
    basics = _entry(
        side, "basics", F.lit(0), F.lit(""), none, _plain_fields(content["basics"], L.BASICS), "", F.lit(None).cast("array<string>")
    )
    sections = F.array(F.array(basics), *[listed(s, fields, items) for s, (fields, items) in L.SECTIONS.items()])
    return F.flatten(F.filter(sections, lambda x: x.isNotNull()))


def semantic_diff(pairs: DataFrame, key: str, was: str = "was", now: str = "now") -> DataFrame:
    """Changes between two nested documents: ``key, kind, path, was_text, now_text``.

    Entries pair by section, identity and number among equals. The pairs are shuffled once by
    their key; pairing, order and list items are windows and groups on top of that.
    """
    entries = F.concat(_entry_array(F.col(was), 0), _entry_array(F.col(now), 1))
    items = F.aggregate(entries, F.lit(0).cast("long"), lambda n, e: n + 1 + _length(e["list"]))
    rows = _dealt(pairs.select(key, was, now), [key], items).select(key, F.inline(entries)).withColumn(
        "nth", F.row_number().over(Window.partitionBy(key, "side", "section", "value").orderBy("i"))
    )
    entry = F.struct("i", "summary", "fields", "list_key", "list")
    both = rows.groupBy(key, "section", "value", "nth").agg(
        *[F.first(F.when(F.col("side") == n, entry), ignorenulls=True).alias(c) for n, c in enumerate(("w", "n"))]
    )
    has_was, has_now = F.col("w").isNotNull(), F.col("n").isNotNull()
    numbered = F.concat(F.col("section"), F.lit("["), F.coalesce("n.i", "w.i").cast("string"), F.lit("]"))
    both = both.select(
        key, "section", "w", "n", (has_was & has_now).alias("matched"),
        F.when(F.col("section") == "basics", F.col("section")).otherwise(numbered).alias("at"),
    )
    along = Window.partitionBy(key, "section", "matched").orderBy("n.i")
    falls = F.coalesce(F.col("matched") & (F.col("w.i") < F.lag("w.i").over(along)), F.lit(False)).cast("int")
    ordered = both.withColumn("falls", falls).withColumn("n_falls", F.sum("falls").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    none = F.lit(None).cast("string")

    def change(kind: Column, path: Column, old: Column, new: Column) -> Column:
        return F.struct(kind.alias("kind"), path.alias("path"), old.alias("was_text"), new.alias("now_text"))

    one_sided = F.array(
        change(F.when(has_now, "add").otherwise("remove"), F.col("at"), F.col("w.summary"), F.col("n.summary"))
    )
    blank = lambda c: F.nullif(c, F.lit(""))
    fields = F.zip_with(
        "w.fields", "n.fields",
        lambda a, b: change(
            field_change(a["value"], b["value"]), F.concat(F.col("at"), F.lit("."), a["key"]), blank(a["value"]), blank(b["value"])
        ),
    )
    moved = F.array(
        change(F.when((F.col("falls") == 1) & (F.col("n_falls") == 1), "reorder"), F.col("section"), none, none)
    )
    found = F.when(F.col("matched"), F.concat(F.filter(fields, lambda f: f["kind"].isNotNull()), F.filter(moved, lambda f: f["kind"].isNotNull())))
    changes = ordered.select(key, F.inline(found.otherwise(one_sided)))
    path = F.concat(F.col("at"), F.lit("."), F.col("n.list_key"))
    lists = both.where("matched").select(
        key, path.alias("__path"), path.alias("path"), F.col("w.list").alias("was"), F.col("n.list").alias("now")
    )
    return changes.unionByName(_list_changes(lists, [key, "__path"]).select(key, "kind", "path", "was_text", "now_text"))


def value_changes(was: DataFrame, now: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Values gone from and new to each key, as multisets: ``keys, value, removed, added``.

    Both sides are counted before they meet, so a value that repeats very often is one row.
    """
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias(name))

    both = counted(was, "__a").join(counted(now, "__b"), [*keys, value], "full_outer")
    a, b = F.coalesce("__a", F.lit(0)), F.coalesce("__b", F.lit(0))
    return both.where(a != b).select(
        *keys, value, F.greatest(a - b, F.lit(0)).alias("removed"), F.greatest(b - a, F.lit(0)).alias("added")
    )


def word_retention(pairs: DataFrame, keys: Sequence[str], written: str, edited: str) -> DataFrame:
    """Share of the original words still there, counted with multiplicity; 0 for empty text.

    ``rewritten`` marks pairs that keep less than ``vocab.REWRITTEN_BELOW`` of their words. Words are
    counted per pair before the sides meet.
    """
    def counts(column: str, name: str) -> DataFrame:
        return (
            pairs.select(*keys, F.explode(words(F.coalesce(F.col(column), F.lit("")))).alias("word"))
            .groupBy(*keys, "word")
            .agg(F.count(F.lit(1)).alias(name))
        )

    kept = (
        counts(written, "__a")
        .join(counts(edited, "__b"), [*keys, "word"], "left")
        .groupBy(*keys)
        .agg(
            F.sum("__a").alias("words"),
            F.sum(F.least(F.col("__a"), F.coalesce("__b", F.lit(0)))).alias("kept"),
        )
    )
    total, hit = F.coalesce("words", F.lit(0)), F.coalesce("kept", F.lit(0))
    return pairs.select(*keys).join(kept, list(keys), "left").select(
        *keys, total.alias("words"), hit.alias("kept"),
        F.when(total > 0, hit / total).otherwise(F.lit(0.0)).alias("retained"),
        ((total > 0) & (hit < total * F.lit(vocab.REWRITTEN_BELOW))).alias("rewritten"),
    )


def letter_words(paragraphs: DataFrame, key: str, text: str) -> DataFrame:
    """Words per document, summed over its paragraphs."""
    return paragraphs.groupBy(key).agg(F.sum(F.size(words(F.col(text)))).alias("words"))
