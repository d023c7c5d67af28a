"""Tracing every proposed change, reason and paragraph to a cited source.

A citation is a path into a document. Documents are flattened to addressed nodes, so
resolving a path is an equi-join on (document, path). Refusals and flags are columns:
no row is dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import schemas, vocab
from ..functions import text as T
from ..functions.fields import first_three, in_vocabulary, path_key
from ..plans.skew import salted_join
from ..sources.documents import clean_content
from . import leaves as L


def _looked_up(rows: DataFrame, nodes: DataFrame, key: str, path: Column, prefix: str, spread: list[str]) -> DataFrame:
    """Attach the node at ``path`` as ``<prefix>_kind/size/value``; null when there is none."""
    rows = rows.withColumn("__path", path)
    right = nodes.select(
        key, F.col("node_path").alias("__path"),
        F.col("node_kind").alias(f"{prefix}_kind"), F.col("node_size").alias(f"{prefix}_size"),
        F.col("node_value").alias(f"{prefix}_value"),
    )
    return salted_join(rows, right, [key, "__path"], spread).drop("__path")


def _parent(path: Column) -> Column:
    return F.regexp_replace(path_key(path), r"\.?[^.]*$", "")


def _three_lookups(rows: DataFrame, nodes: DataFrame, key: str, number: str) -> DataFrame:
    """Attach the nodes at a change's path, at its parent and at its citation.

    The three addresses become three rows, so the document's nodes are joined once; a
    change gets its own three rows back.
    """
    wanted = F.array(
        *[
            F.struct(F.lit(role).alias("__role"), address.alias("__path"))
            for role, address in (
                ("at", path_key(F.col("path"))),
                ("parent", _parent(F.col("path"))),
                ("cited", path_key(F.col("citation_path"))),
            )
        ]
    )
    asked = rows.select(key, number, F.inline(wanted)).where(F.col("__path") != "")
    right = nodes.select(
        key, F.col("node_path").alias("__path"), F.struct("node_kind", "node_size", "node_value").alias("__node")
    )
    met = salted_join(asked, right, [key, "__path"], [key, number, "__role"], "inner")
    found = met.groupBy(key, number).agg(
        *[F.max(F.when(F.col("__role") == role, F.col("__node"))).alias(f"__{role}") for role in ("at", "parent", "cited")]
    )
    return rows.join(found, [key, number], "left").select(
        *rows.columns,
        *[
            F.col(f"__{role}.node_{part}").alias(f"{role}_{part}")
            for role in ("at", "parent", "cited")
            for part in ("kind", "size", "value")
        ],
    )


def _flat(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"\[(\d+)\]", ".$1"), r"\s+", "")


def validate_changes(changes: DataFrame, resumes: DataFrame, key: str, number: str = "change_no") -> DataFrame:
    """Add ``status`` and ``refused_reason`` to proposed changes; same rows in as out.

    ``changes`` has ``key, number, kind, path, now, citation_path, citation_snippet`` and,
    optionally, ``readable`` (false when the proposal was not a record at all).
    """
    text = lambda c: T.trim(F.coalesce(F.col(c), F.lit("")))
    kind = F.when(text("kind").isin(*vocab.CHANGE_KINDS), text("kind")).otherwise("edit")
    rows = changes.withColumns(
        {
            "kind": kind, "path": text("path"), "now": F.coalesce("now", F.lit("")),
            "citation_path": text("citation_path"), "citation_snippet": text("citation_snippet"),
        }
    )
    rows = _three_lookups(rows, L.nodes(resumes, key), key, number)

    segments = F.split(path_key(F.col("path")), r"\.")
    last = F.get(segments, F.size(segments) - 1)
    top_level = F.size(segments) == 1
    index = F.when(last.rlike(r"^\d+$"), last.try_cast("long"))
    can_add = (
        (F.col("at_kind") == "list")
        | top_level
        | (F.col("parent_kind") == "record")
        | ((F.col("parent_kind") == "list") & (index <= F.col("parent_size")))
    )
    lands = (path_key(F.col("path")) != "") & (
        F.when(F.col("kind") == "reorder", F.col("at_kind") == "list")
        .when(F.col("kind") == "edit", F.col("at_kind") == "text")
        .when(F.col("kind") == "remove", F.col("at_kind").isNotNull())
        .otherwise(can_add)
    )
    lands = F.coalesce(lands, F.lit(False))
    where = F.col("path")
    nowhere = (
        F.when(F.col("kind") == "reorder", F.concat(F.lit("Cannot reorder "), where, F.lit(" — your résumé has no list there.")))
        .when(F.col("kind") == "add", F.concat(F.lit("Cannot add at "), where, F.lit(" — your résumé has nowhere to put it.")))
        .when(F.col("kind") == "remove", F.concat(F.lit("Cannot remove "), where, F.lit(" — your résumé has no such field.")))
        .otherwise(F.concat(F.lit("Cannot edit "), where, F.lit(" — your résumé has no text there.")))
    )
    field = T.plain(F.col("cited_value"), extra_quote=True)
    quote = T.plain(F.col("citation_snippet"), extra_quote=True)
    claim = T.plain(F.col("now"), extra_quote=True)
    whole_field = (quote == field) & (_flat(F.col("citation_path")) == _flat(F.col("path")))
    enough = (F.size(F.filter(F.split(quote, " "), lambda w: w != "")) >= vocab.MIN_SNIPPET_WORDS) & (
        (claim == "") | (F.length(quote) * 3 >= F.length(claim))
    )
    cite = F.col("citation_path")
    readable = F.col("readable") if "readable" in changes.columns else F.lit(True)
    reason = (
        F.when(~readable, "The model returned this change in a shape that could not be read.")
        .when(where == "", "The model did not say where this change goes.")
        .when((F.col("now") == "") & (F.col("kind") != "remove"), "The model proposed no text for this change.")
        .when(~lands, nowhere)
        .when((cite == "") | (F.col("citation_snippet") == ""), "No source in your résumé — the model cited nothing for this.")
        .when(F.col("cited_kind").isNull(), F.concat(F.lit("Cited "), cite, F.lit(", which is not a field in your résumé.")))
        .when((F.col("cited_kind") != "text") | (T.trim(F.col("cited_value")) == ""), F.concat(F.lit("Cited "), cite, F.lit(", which is not one field of your résumé.")))
        .when((quote == "") | ~F.contains(field, quote), F.concat(F.lit("The quoted text is not what "), cite, F.lit(" says.")))
        .when(~(whole_field | enough), F.concat(F.lit("The quote from "), cite, F.lit(" is too little of it to carry this change.")))
    )
    return rows.select(
        *[c for c in changes.columns if c != "readable"],
        F.when(F.col("at_kind") == "text", F.col("at_value")).alias("was"),
        F.when(reason.isNull(), "proposed").otherwise("refused").alias("status"),
        reason.alias("refused_reason"),
    )


# --- applying accepted changes ----------------------------------------------

#: The order in which kinds of change are applied, and the separator of a new order.
_APPLY_ORDER = {"edit": 0, "remove": 1, "add": 2, "reorder": 3}
_ORDER_SEPARATOR = " · "
#: Why a change does not land; those with an address start with it or name it.
_NO_FIELD = "This change names no field in your résumé."
_NO_LIST = "That is not a list in your résumé."
_NO_ORDER = "The model gave no order to put that list in."
_OTHER_ITEMS = "That order is not the same items the list holds."
_NOTHING_AT = "Nothing at {} to add to."
_PAST_END = "{} is past the end of that list."
_NOT_A_FIELD = "{} is not a field in your résumé."
_NOT_IN = "{} is not in your résumé."

_SKIPS = "array<struct<change_no:bigint,reason:string>>"


def _texts(record: Column, names: Sequence[str]) -> Column:
    """The texts a record has, by name."""
    pairs = F.array(*[F.struct(F.lit(n).alias("key"), record[n].alias("value")) for n in names])
    return F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull()))


def _uniform(content: Column) -> tuple[Column, Column]:
    """A document whose sections all look alike: basic texts, and entries of (texts, items) by section."""

    def entries(section: str) -> Column:
        names, items = L.SECTIONS[section]
        return F.transform(content[section], lambda e: F.struct(_texts(e, names).alias("texts"), e[items].alias("items")))

    sections = F.map_from_arrays(F.array(*map(F.lit, L.SECTIONS)), F.array(*map(entries, L.SECTIONS)))
    return _texts(content["basics"], L.BASICS), sections


def _document(basics: Column, sections: Column) -> Column:
    """The way back; texts under unknown names go."""

    def record(texts: Column, names: Sequence[str]) -> list[Column]:
        return [F.try_element_at(texts, F.lit(n)).alias(n) for n in names]

    def entries(section: str) -> Column:
        names, items = L.SECTIONS[section]
        return F.transform(
            F.try_element_at(sections, F.lit(section)), lambda e: F.struct(*record(e["texts"], names), e["items"].alias(items))
        ).alias(section)

    return F.struct(F.struct(*record(basics, L.BASICS)).alias("basics"), *map(entries, L.SECTIONS))


def _address(path: Column) -> list[Column]:
    """Where a path points: what kind of spot, and its section, entry, name and item number."""
    key = path_key(path)
    parts = F.split(key, r"\.")
    part = lambda i: F.get(parts, F.lit(i))
    number = lambda i: F.when(part(i).rlike("^[0-9]+$"), F.coalesce(part(i).try_cast("long"), F.lit(1 << 62)))
    basics, depth = part(0) == "basics", F.size(parts)
    section = part(0).isin(*L.SECTIONS)
    entry, item = number(1), number(3)
    items_name = F.lit(None).cast("string")
    for name, (_, items) in L.SECTIONS.items():
        items_name = F.when(part(0) == name, items).otherwise(items_name)
    listed = F.coalesce(part(2) == items_name, F.lit(False))
    in_entry = section & entry.isNotNull()
    spot = (
        F.when(key == "", "none")
        .when(depth == 1, F.when(basics, "basics").when(section, "section").otherwise("stray"))
        .when(basics & (depth == 2), "text")
        .when(section & (depth == 2), F.when(entry.isNotNull(), "entry").otherwise("stray"))
        .when(in_entry & (depth == 3), F.when(listed, "items").otherwise("text"))
        .when(in_entry & (depth == 4) & listed, F.when(item.isNotNull(), "item").otherwise("stray item"))
        .otherwise("nowhere")
    )
    name = F.when(basics, part(1)).otherwise(part(2))
    return [spot.alias("spot"), part(0).alias("section"), entry.alias("entry"), name.alias("name"), item.alias("item")]


def reordered(items: Column, order: Column) -> Column:
    """``items`` as ``order`` lists them, or null when that is not the same items.

    Both sides sorted by text and position line up one to one, so equal texts keep their order.
    """
    by_text = F.array_sort(F.transform(items, lambda x, i: F.struct(T.trim(x).alias("w"), i.alias("i"), x.alias("x"))))
    wanted = F.transform(F.split(order, _ORDER_SEPARATOR), lambda w, i: F.struct(T.trim(w).alias("w"), i.alias("i")))
    sought = F.array_sort(wanted)
    same = F.transform(by_text, lambda x: x["w"]) == F.transform(sought, lambda x: x["w"])
    placed = F.zip_with(sought, by_text, lambda a, b: F.struct(a["i"].alias("i"), b["x"].alias("x")))
    return F.when(same, F.transform(F.array_sort(placed), lambda x: x["x"]))


def _apply_one(state: Column, c: Column) -> Column:
    """The document after one change, or as it was with the reason why the change did not land."""
    basics, sections, kind, now, spot = state["basics"], state["sections"], c["kind"], c["now"], c["spot"]
    entries = F.try_element_at(sections, c["section"])
    at = F.when(c["entry"] < F.size(entries), F.get(entries, c["entry"].cast("int")))
    items = at["items"]
    in_basics = c["section"] == "basics"
    text = F.try_element_at(F.when(in_basics, basics).otherwise(at["texts"]), c["name"])
    told = lambda words: F.replace(F.lit(words), F.lit("{}"), c["path"])

    here = (
        F.when(spot.isin("items", "item", "stray item"), at.isNotNull())
        .when(spot == "text", in_basics | at.isNotNull())
        .otherwise(spot != "nowhere")
    )
    present = (
        F.when(spot == "text", text.isNotNull())
        .when(spot.isin("entry", "items"), at.isNotNull())
        .when(spot == "item", F.coalesce(c["item"] < F.size(items), F.lit(False)))
        .otherwise(spot.isin("basics", "section"))
    )
    reason = (
        F.when(spot == "none", _NO_FIELD)
        .when(
            kind == "reorder",
            F.when(~((spot == "section") | ((spot == "items") & at.isNotNull())), _NO_LIST)
            .when(T.trim(now) == "", _NO_ORDER)
            .when((spot == "section") | reordered(items, now).isNull(), _OTHER_ITEMS),
        )
        .when(
            kind == "add",
            F.when(~here, told(_NOTHING_AT))
            .when((spot == "item") & (c["item"] > F.size(items)), told(_PAST_END))
            .when((spot == "entry") & (c["entry"] > F.size(entries)), told(_PAST_END))
            .when(spot.isin("basics", "section", "entry"), told(_NOTHING_AT)),
        )
        .when(~here, told(_NOT_A_FIELD))
        .when(~present, told(_NOT_IN))
        .when((kind == "edit") & ~spot.isin("text", "item"), told(_NOT_A_FIELD))
    )

    def texts_after(texts: Column) -> Column:
        others = F.map_filter(texts, lambda k, _: k != c["name"])
        return F.when(kind == "remove", others).otherwise(F.map_concat(others, F.create_map(c["name"], now)))

    def items_after(old: Column) -> Column:
        n = c["item"].cast("int")
        inserted = F.concat(F.slice(old, F.lit(1), n), F.array(now), F.slice(old, n + 1, F.size(old)))
        return (
            F.when(spot == "stray item", old)
            .when(kind == "edit", F.transform(old, lambda x, i: F.when(i == n, now).otherwise(x)))
            .when(kind == "reorder", reordered(old, now))
            .when(kind == "add", F.when(spot == "items", F.concat(old, F.array(now))).otherwise(inserted))
            .when(spot == "items", F.slice(old, 1, 0))
            .otherwise(F.filter(old, lambda _, i: i != n))
        )

    def entry_after(e: Column) -> Column:
        return F.struct(
            F.when(spot == "text", texts_after(e["texts"])).otherwise(e["texts"]).alias("texts"),
            F.when(spot == "text", e["items"]).otherwise(items_after(e["items"])).alias("items"),
        )

    def entries_after(old: Column) -> Column:
        changed = F.transform(old, lambda e, i: F.when(i == c["entry"], entry_after(e)).otherwise(e))
        gone = F.filter(old, lambda _, i: i != c["entry"])
        return F.when(spot == "section", F.slice(old, 1, 0)).when(spot == "entry", gone).otherwise(changed)

    def after(why: Column) -> Column:
        lands = why.isNull() & (spot != "stray")
        inside = F.when(spot == "basics", F.map_filter(basics, lambda k, _: F.lit(False))).otherwise(texts_after(basics))
        elsewhere = F.transform_values(sections, lambda k, old: F.when(k == c["section"], entries_after(old)).otherwise(old))
        skip = F.array(F.struct(c["change_no"].alias("change_no"), why.alias("reason")))
        return F.struct(
            F.when(lands & in_basics, inside).otherwise(basics).alias("basics"),
            F.when(lands & ~in_basics, elsewhere).otherwise(sections).alias("sections"),
            F.when(why.isNull(), state["skipped"]).otherwise(F.concat(state["skipped"], skip)).alias("skipped"),
        )

    return F.get(F.transform(F.array(reason), after), F.lit(0))


def apply_changes(resumes: DataFrame, accepted: DataFrame, key: str) -> DataFrame:
    """``key, content, skipped`` with every accepted change applied to its document.

    Edits first, then removals from the highest index down, additions in review order,
    reorders last; refused changes never apply. Repeated edits of one field reduce to
    the last before anything is gathered, and what is gathered per document otherwise
    becomes part of that document, which takes its changes one by one inside its own row.

    A removed list is an empty one. A text never replaces or joins records: such a change is
    skipped. A text added under an unknown name lands and is dropped with its name.
    """
    usable = accepted.where(F.col("status") != "refused")
    is_edit = F.col("kind") == "edit"
    last_edits = (
        usable.where(is_edit)
        .groupBy(key, path_key(F.col("path")).alias("__p"))
        .agg(F.max_by(F.struct("change_no", "kind", "path", "now"), "change_no").alias("e"))
        .select(key, "e.*")
    )
    others = usable.where(~is_edit).select(key, "change_no", "kind", "path", "now")
    phase = F.lit(None).cast("int")
    for kind, rank in _APPLY_ORDER.items():
        phase = F.when(F.col("kind") == kind, rank).otherwise(phase)
    number = F.col("change_no").cast("long")
    final_index = F.coalesce(F.regexp_extract(path_key(F.col("path")), r"(?:^|\.)(\d+)$", 1).try_cast("long"), F.lit(-1))
    ranked = last_edits.unionByName(others).select(
        key,
        F.struct(
            phase.alias("phase"), F.when(F.col("kind") == "remove", -final_index).otherwise(number).alias("rank"),
            number.alias("change_no"), "kind", F.coalesce("path", F.lit("")).alias("path"), F.coalesce("now", F.lit("")).alias("now"),
            *_address(F.coalesce("path", F.lit(""))),
        ).alias("c"),
    )
    gathered = ranked.groupBy(key).agg(F.array_sort(F.collect_list("c")).alias("__changes"))
    basics, sections = _uniform(F.col("content"))
    start = F.struct(basics.alias("basics"), sections.alias("sections"), F.array().cast(_SKIPS).alias("skipped"))
    touched = F.col("__changes").isNotNull()
    done = resumes.join(gathered, key, "left").withColumn("__done", F.when(touched, F.aggregate("__changes", start, _apply_one)))
    changed = clean_content(_document(F.col("__done.basics"), F.col("__done.sections")))
    return done.select(
        key, F.when(touched, changed).otherwise(F.col("content")).alias("content"),
        F.coalesce(F.array_sort("__done.skipped"), F.array().cast(_SKIPS)).alias("skipped"),
    )


def skip_report(applied: DataFrame, accepted: DataFrame, key: str) -> DataFrame:
    """Accepted changes that did not land, in review order, with the reason.

    Edits of one field share one fate, so an edit folded into a later one is reported with it.
    """
    skipped = applied.select(key, F.explode("skipped").alias("s")).select(key, "s.change_no", "s.reason")
    usable = accepted.where(F.col("status") != "refused").withColumn("__p", path_key(F.col("path")))
    direct = skipped.join(usable, [key, "change_no"])
    edit_paths = direct.where(F.col("kind") == "edit").select(key, "__p", "reason").distinct()
    edits = usable.where(F.col("kind") == "edit").join(edit_paths, [key, "__p"])
    others = direct.where(F.col("kind") != "edit")
    columns = [key, "change_no", "kind", "path", "reason"]
    return others.select(*columns).unionByName(edits.select(*columns))


def tailored_versions(applied: DataFrame, bases: DataFrame, key: str, id_of_child: Column, label: str) -> DataFrame:
    """Child versions of the documents changes were applied to, ready to append."""
    return applied.join(bases.select(key, "resume_id"), key).select(
        id_of_child.alias("version_id"), "resume_id", F.col(key).alias("parent_id"),
        F.lit(label).alias("label"), F.to_json("content").alias("content"),
    )


def pin_tailored(applications: DataFrame, children: DataFrame) -> DataFrame:
    """Pin each application's tailored version; one still ``sourced`` becomes ``tailored``.

    ``children`` has ``application_id, version_id``, one row per application.
    """
    new = children.select("application_id", F.col("version_id").alias("__v"))
    pinned = F.col("__v").isNotNull()
    return applications.join(new, "application_id", "left").select(
        *[
            F.coalesce("__v", c).alias(c) if c == "version_id"
            else F.when(pinned & (F.col(c) == "sourced"), "tailored").otherwise(F.col(c)).alias(c) if c == "status"
            else F.col(c)
            for c in applications.columns
        ]
    )


# --- reasons, paragraphs, drafts --------------------------------------------


def _exploded(rows: DataFrame, citations: str) -> DataFrame:
    """One row per non-blank citation, trimmed, in order; rows without any keep one null row."""
    cleaned = F.filter(F.transform(citations, lambda c: T.optional(c)), lambda c: c.isNotNull())
    return rows.select("*", F.posexplode_outer(cleaned).alias("cite_no", "cite"))


def _paths(name: str, keep: Column) -> Column:
    """The citations that satisfy ``keep``, in order. Bounded by the row they came from."""
    ordered = F.array_sort(F.collect_list(F.when(keep, F.struct("cite_no", "cite"))))
    return F.transform(ordered, lambda c: c["cite"]).alias(name)


def check_reasons(reasons: DataFrame, resumes: DataFrame, key: str, row_id: list[str]) -> DataFrame:
    """Split each reason's citations and flag what nothing backs.

    ``reasons`` has ``row_id, key, text, citations, gap``. A reason is flagged when no
    citation resolves and it either cited something or was not a gap.
    """
    nodes = L.nodes(resumes, key)
    usable = reasons.where(T.optional(F.col("text")).isNotNull())
    found = _looked_up(_exploded(usable, "citations"), nodes, key, path_key(F.col("cite")), "at", [*row_id, "cite_no"])
    hit = F.col("at_kind").isNotNull()
    owner = [] if key in row_id else [F.first(key).alias(key)]
    grouped = found.groupBy(*row_id).agg(
        *owner, F.first(T.trim(F.col("text"))).alias("text"),
        F.first(F.coalesce("gap", F.lit(False))).alias("gap"),
        _paths("resolved", F.col("cite").isNotNull() & hit),
        _paths("unresolved", F.col("cite").isNotNull() & ~hit),
    )
    bare = (F.size("resolved") == 0) & ((F.size("unresolved") > 0) | ~F.col("gap"))
    flag = F.when(
        F.size("unresolved") == 0, F.lit("No source — nothing in your résumé backs this.")
    ).otherwise(
        F.concat(F.lit("No source — cited "), first_three(F.col("unresolved")), F.lit(", which your résumé does not have."))
    )
    return grouped.withColumn("flag", F.when(bare, flag))


def valid_ratings(entries: DataFrame, known: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First usable rating per asked-for listing; the rest is dropped, never coerced.

    ``entries`` has ``keys, tier, reasons`` (reasons an array of records with text).
    """
    tier = F.lower(T.trim(F.coalesce("tier", F.lit(""))))
    usable = F.filter("reasons", lambda r: T.optional(r["text"]).isNotNull())
    good = entries.withColumns({"tier": tier, "reasons": usable}).where(
        in_vocabulary(F.col("tier"), vocab.FIT_TIERS) & (F.size("reasons") > 0)
    )
    asked = good.join(known.select(*keys).distinct(), keys, "left_semi")
    return asked.groupBy(*keys).agg(
        F.min_by(F.struct("tier", "reasons"), F.struct(*order)).alias("r")
    ).select(*keys, "r.*")


def _read_replies(replies: DataFrame) -> DataFrame:
    parsed = replies.withColumn("__r", F.from_json(T.first_json_object(F.col("reply")), schemas.FIT_REPLY))
    return parsed.withColumn("reason", F.when(F.col("__r.ratings").isNull(), "no ratings could be read"))


def rating_entries(replies: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rating entries read out of raw model replies, and the replies that held none.

    ``replies`` has ``keys, reply_no, reply``. An unreadable reply costs only its own listings.
    """
    parsed = _read_replies(replies)
    entries = parsed.where(F.col("reason").isNull()).select(
        *keys, "reply_no", F.posexplode("__r.ratings").alias("entry_no", "e")
    ).select(
        *keys, "reply_no", "entry_no", T.trim(F.col("e.externalId")).alias("external_id"),
        F.col("e.tier").alias("tier"), F.col("e.reasons").alias("reasons"),
    )
    return entries, rating_chunks(replies, keys).where(F.col("reason").isNotNull())


def rating_chunks(replies: DataFrame, keys: list[str]) -> DataFrame:
    """Every reply with the ``reason`` it could not be read for, null where it could."""
    return _read_replies(replies).select(*keys, "reply_no", "reason")


def draws_on(field: Column, paragraph: Column) -> Column:
    """Whether the paragraph shares the field's distinctive terms: two, or all of a shorter field."""
    wanted = T.distinctive_terms(field)
    shared = F.size(F.array_intersect(wanted, T.distinctive_terms(paragraph)))
    return (F.size(wanted) > 0) & (shared >= F.least(F.lit(vocab.MIN_SHARED_TERMS), F.size(wanted)))


def check_paragraphs(paragraphs: DataFrame, resumes: DataFrame, key: str, jobs: DataFrame, row_id: list[str]) -> DataFrame:
    """Attach provenance to letter paragraphs.

    ``paragraphs`` has ``row_id, key, job_id, text, citations``; ``jobs`` has ``job_id,
    title, company, jd_text``. Returns the backed citations, their ``sources`` (path, ``resume`` or
    ``job``, and the start of the text there) and a flag when there are none.
    """
    usable = paragraphs.where(T.optional(F.col("text")).isNotNull())
    cited = _exploded(usable, "citations")
    spread = [*row_id, "cite_no"]
    found = _looked_up(cited, L.nodes(resumes, key), key, path_key(F.col("cite")), "at", spread)
    from_job = F.coalesce(F.col("cite").startswith("job."), F.lit(False))
    # Only citations of the posting travel to the job table.
    job_side = salted_join(
        found.where(from_job), jobs.select("job_id", F.struct("title", "company", F.col("jd_text").alias("jdText")).alias("__j")),
        ["job_id"], spread, counted=cited,
    )
    name = F.substr(F.col("cite"), F.lit(5))
    job_field = F.lit(None).cast("string")
    for f in vocab.JOB_CITATION_FIELDS:
        job_field = F.when(name == f, F.col(f"__j.{f}")).otherwise(job_field)
    resolved = job_side.withColumn("__field", job_field).drop("__j").unionByName(
        found.where(~from_job).withColumn("__field", F.when(F.col("at_kind") == "text", F.col("at_value")))
    )
    is_text = T.trim(F.coalesce("__field", F.lit(""))) != ""
    backed = is_text & draws_on(F.coalesce("__field", F.lit("")), F.col("text"))
    present = F.col("cite").isNotNull()
    source = F.struct(
        "cite_no", F.col("cite").alias("path"),
        F.when(F.col("cite").startswith("job."), "job").otherwise("resume").alias("source"), T.snippet(F.col("__field")).alias("snippet"),
    )
    grouped = resolved.withColumns({"__is_text": is_text, "__backed": backed}).groupBy(*row_id).agg(
        F.first(T.trim(F.col("text"))).alias("text"),
        F.array_sort(F.collect_list(F.when(present & F.col("__backed"), source))).alias("sources"),
        _paths("backed", present & F.col("__backed")),
        _paths("unresolved", present & ~F.col("__is_text")),
        _paths("unsupported", present & F.col("__is_text") & ~F.col("__backed")),
    )
    flag = (
        F.when(F.size("unresolved") > 0, F.concat(F.lit("No source — cited "), first_three(F.col("unresolved")), F.lit(", which your résumé does not have.")))
        .when(F.size("unsupported") > 0, F.concat(F.lit("No source — cited "), first_three(F.col("unsupported")), F.lit(", which says nothing this paragraph rests on.")))
        .otherwise(F.lit("No source — nothing in your résumé or the posting backs this paragraph."))
    )
    shown = F.transform("sources", lambda c: F.struct(c["path"].alias("path"), c["source"].alias("source"), c["snippet"].alias("snippet")))
    return grouped.withColumn("sources", shown).withColumn("flag", F.when(F.size("backed") == 0, flag))


def draft_citations(drafts: DataFrame, resumes: DataFrame, key: str, row_id: list[str]) -> DataFrame:
    """Citations of drafted messages that resolve, first sighting of each, with their text."""
    cited = _exploded(drafts, "citations").where(F.col("cite").isNotNull())
    first = cited.groupBy(*row_id, key, "cite").agg(F.min("cite_no").alias("cite_no"))
    found = _looked_up(first, L.nodes(resumes, key), key, path_key(F.col("cite")), "at", [*row_id, "cite"])
    return found.where(F.col("at_kind").isNotNull()).select(
        *row_id, key, "cite_no", F.col("cite").alias("path"), F.col("at_value").alias("snippet")
    )
