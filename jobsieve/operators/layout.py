"""From the lines of a document to sections and entries, over a line table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab
from ..functions import dates as D
from ..functions import text as T
from ..plans.once import computed
from ..plans.scan import running
from ..plans.skew import hot_keys

LINE_BLOCK = 4096


def heading_kind(text: Column, is_list_item: Column) -> Column:
    """The section a whole line names by vocabulary, else null."""
    # Long lines are most lines; they fail on their first few words.
    short = text.rlike(rf"^{T.SPACE}*(?:{T.NOT_SPACE}+{T.SPACE}+){{0,4}}{T.NOT_SPACE}*$")
    value = T.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[:.]+$", ""), f"{T.SPACE}+", " "))
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(vocab.SECTION_HEADINGS):
        out = F.when(value.rlike(pattern), kind).otherwise(out)
    return F.when(~is_list_item & short, F.when((value != "") & (T.word_count(value) <= 4), out))


def _style() -> Column:
    return F.concat_ws("@", "font_name", F.format_number("font_size", 1))


def _labelish(text: Column) -> Column:
    value = F.regexp_replace(T.trim(text), ":$", "")
    return (
        (value != "") & (F.length(value) <= 34) & (T.word_count(value) <= 3)
        & ~value.rlike("[,;:]") & value.rlike(r"^[\p{Lu}\d]")
    )


def _has_link(text: Column) -> Column:
    url = (
        r"(?i)(?:https?://|www\.)[^\s|·•]+|(?<![A-Za-z0-9_])(?:[\w-]+\.)+(?:" + vocab.LINK_TLDS
        + r")(?![A-Za-z0-9_])(?!-)"
    )
    return text.rlike(url) | text.rlike(r"[\w.+-]+@[\w-]+\.[\w.-]+")


def heading_styles(lines: DataFrame) -> DataFrame:
    """Per document: type styles its known headings use, without its commonest style, and their indents."""
    styled = computed(lines, style=_style(), kind=heading_kind(F.col("text"), F.col("is_list_item")))
    per_style = styled.groupBy("doc_id", "style").agg(
        F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first"), F.count("kind").alias("headings")
    )
    common = per_style.groupBy("doc_id").agg(
        F.max_by("style", F.struct("n", -F.col("first"))).alias("common"),
        F.collect_list(F.when(F.col("headings") > 0, F.col("style"))).alias("styles"),
    )
    indents = styled.where(F.col("kind").isNotNull()).groupBy("doc_id").agg(F.collect_set("x").alias("indents"))
    return common.join(indents, "doc_id", "left").select(
        "doc_id", F.array_except("styles", F.array("common")).alias("styles"),
        F.coalesce("indents", F.array().cast("array<double>")).alias("indents"),
    )


def sections(lines: DataFrame) -> DataFrame:
    """Add ``section_no`` (0 is the banner), ``kind``, ``title`` and ``is_heading`` to every line."""
    judged = lines.join(heading_styles(lines), "doc_id", "left")
    known = heading_kind(F.col("text"), F.col("is_list_item"))
    near = F.exists("indents", lambda i: F.abs(F.col("x") - i) <= vocab.INDENT_TOLERANCE * 2)
    custom = (
        ~F.col("is_list_item") & F.array_contains("styles", _style()) & _labelish(F.col("text")) & near
        & ~_has_link(F.col("text")) & ~D.has_date_range(F.col("text"))
    )
    marked = computed(judged, own_kind=F.coalesce(known, F.when(custom, "custom"))).drop("styles", "indents")
    blocked = marked.withColumn("__b", F.floor(F.col("line_no") / LINE_BLOCK))
    heading = F.col("own_kind").isNotNull()
    placed = running(
        blocked, ["doc_id"], ["__b"], ["line_no"],
        sums={"section_no": heading.cast("long")},
        previous={"__open": F.when(heading, F.struct(F.col("own_kind").alias("kind"), F.col("text").alias("title")))},
        hot=hot_keys(lines, ["doc_id"]),
    )
    return placed.select(
        *lines.columns, "section_no",
        F.coalesce("own_kind", F.col("__open.kind"), F.lit("banner")).alias("kind"),
        F.when(heading, F.col("text")).otherwise(F.col("__open.title")).alias("title"),
        heading.alias("is_heading"),
    )


def entry_chunks(lines: DataFrame, keys: Sequence[str], order: str = "line_no") -> DataFrame:
    """Add ``chunk``: the entry each line of a section belongs to.

    An entry starts at a plain line that follows a bullet, and at every further dated
    line of one run of plain lines.
    """
    keys = list(keys)
    plain = ~F.col("is_list_item")
    rows = lines.withColumn("__b", F.floor(F.col(order) / LINE_BLOCK)).withColumn(
        "__dated", (plain & D.has_date_range(F.col("text"))).cast("long")
    )
    hot = hot_keys(rows, keys)
    looked = running(rows, keys, ["__b"], [order], previous={"__was_item": F.col("is_list_item")}, hot=hot)
    looked = looked.withColumn("__run_start", plain & F.coalesce("__was_item", F.lit(True)))
    runs = running(looked, keys, ["__b"], [order], sums={"__run": F.col("__run_start").cast("long")}, hot=hot)
    ranked = running(runs, [*keys, "__run"], ["__b"], [order], sums={"__nth": F.col("__dated")}, hot=hot)
    begins = F.col("__run_start") | (plain & (F.col("__dated") == 1) & (F.col("__nth") >= 2))
    return running(
        ranked.withColumn("__begins", begins.cast("long")), keys, ["__b"], [order],
        sums={"chunk": F.col("__begins")}, hot=hot,
    ).select(*lines.columns, "chunk")


def rejoin_wrapped(lines: DataFrame) -> DataFrame:
    """Bullets with their wrapped lines joined back; other lines unchanged.

    A line continues the last bullet while it stays on its page, near its indent and at
    its size, and is neither dated nor a heading; the first line that does not ends it.
    """
    rows = lines.where(T.trim(F.col("text")) != "").withColumn("__b", F.floor(F.col("line_no") / LINE_BLOCK))
    item = F.col("is_list_item")
    hot = hot_keys(rows, ["doc_id"])
    anchored = running(
        rows, ["doc_id"], ["__b"], ["line_no"],
        sums={"__a": item.cast("long")},
        previous={"__at": F.when(item, F.struct("page", "x", "font_size"))}, hot=hot,
    )
    indent = F.col("x") - F.col("__at.x")
    continues = (
        F.col("__at").isNotNull()
        & (F.col("page") == F.col("__at.page"))
        & indent.between(-vocab.INDENT_TOLERANCE, vocab.MAX_CONTINUATION_INDENT)
        & (F.abs(F.col("font_size") - F.col("__at.font_size")) <= vocab.FONT_SIZE_TOLERANCE)
        & ~D.has_date_range(F.col("text"))
        & heading_kind(F.col("text"), item).isNull()
    )
    broken = F.when(item, 0).otherwise((~continues).cast("long"))
    scanned = running(
        anchored.withColumn("__stop", broken.cast("long")), ["doc_id", "__a"], ["__b"], ["line_no"],
        sums={"__stops": F.col("__stop")}, hot=hot,
    )
    inside = (F.col("__a") > 0) & (F.col("__stops") == 0)
    pieces = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    glued = F.array_join(F.transform(pieces, lambda p: p["text"]), "\n")
    closed = F.replace(
        F.regexp_replace(glued, r"(?<=\p{Ll})-\n(?=\p{Ll})", ""), F.lit("\n"), F.lit(" ")
    )
    bullets = scanned.where(inside).groupBy("doc_id", "__a").agg(
        closed.alias("text"),
        F.min_by(F.struct(*[c for c in lines.columns if c not in ("doc_id", "text")]), "line_no").alias("r"),
    ).select("doc_id", "text", "r.*")
    return scanned.where(~inside).select(*lines.columns).unionByName(bullets.select(*lines.columns))
