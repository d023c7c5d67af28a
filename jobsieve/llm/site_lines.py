"""Line deduplication by frequency within a site.

A line that a large part of a site's pages share is boilerplate of that site. For every host and
line the distinct pages with the line are counted and divided by the host's distinct pages; lines
above the ratio are dropped from all of that host's pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.once import computed
from ..plans.skew import fits_broadcast, lookup_join
from ..session import cut
from .common import free
from .near_duplicates import node_of

#: A line in more than this share of a host's pages is boilerplate.
RATIO = 0.02
#: A line in fewer pages is never boilerplate, so that small hosts keep theirs.
MIN_PAGES = 5


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _line_key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def line_shares(pages: DataFrame, host: str = "source", text: str = "text", classes: DataFrame | None = None) -> DataFrame:
    """Per host and line hash: distinct pages with the line and distinct pages of the host.

    Exact copies of a page within a host are one page. A line counts once per page. Lines without
    any character but spaces are not counted. A null host is a host of its own. With ``classes``, as
    of ``near_duplicates.text_classes``, all texts of a class are one page too, which has a line if
    any of them has it: a text's own lines are not boilerplate because it was copied with changes.
    """
    page = pages.select(
        F.col(host).alias("host"), (F.xxhash64(text) if classes is None else node_of(text)).alias("p1"), F.xxhash64(F.lit(7), F.col(text)).alias("p2"),
        F.filter(_lines(F.coalesce(F.col(text), F.lit(""))), lambda x: F.trim(x) != "").alias("lines"),
    )
    if classes is not None:
        of = classes.select(F.col("node").alias("p1"), F.col("root"))
        page = lookup_join(page, of, ["p1"], "left").select(
            "host", F.coalesce("root", "p1").alias("p1"), F.lit(0).alias("p2"), "lines"
        )
    keys = F.array_distinct(F.transform("lines", _line_key))
    rows = page.select("host", "p1", "p2", F.explode_outer(keys).alias("line")).distinct()
    # every page has at least one row here, and one with a null line only if it has no line
    lines = rows.where(F.col("line").isNotNull()).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_pages"))
    totals = page.select("host", "p1", "p2").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("n_host_pages"))
    return lines.join(totals.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).drop("h")


def drop_site_lines(
    pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES,
    classes: DataFrame | None = None,
) -> DataFrame:
    """``pages`` with boilerplate lines removed, and ``n_lines`` and ``n_dropped`` as ``__lines`` (replaced if there).

    The dropped lines of a host are one small list: lines above the ratio number at most the mean
    lines per page divided by the ratio. The lists of all hosts are copied to the executors if their
    checked size allows; otherwise they are joined, and Spark splits a hot host. A null text stays null, an empty one empty; a
    page may end up empty, and stays. ``classes`` is as in ``line_shares``.
    """
    q = free(pages)
    common = (
        line_shares(pages, host, text, classes)
        .where((F.col("n_pages") >= min_pages) & (F.col("n_pages") > F.lit(ratio) * F.col("n_host_pages")))
        .groupBy(F.col("host").alias(f"{q}site"))
        .agg(F.collect_set("line").alias(f"{q}common"))
    )
    common = cut(common)
    if fits_broadcast(common):
        common = F.broadcast(common)
    found = pages.join(common, F.col(host).eqNullSafe(F.col(f"{q}site")), "left")
    lines = F.col(f"{q}all")
    split = computed(found, **{f"{q}all": _lines(F.col(text))})
    kept = F.when(F.col(f"{q}common").isNull(), lines).otherwise(
        F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(f"{q}common"), _line_key(x)))
    )
    left = F.col(f"{q}kept")
    out = computed(split, **{f"{q}kept": kept})
    own = [F.array_join(left, "\n").alias(c) if c == text else F.col(f"`{c}`") for c in pages.columns if c != "__lines"]
    counts = F.struct(
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(lines) - F.size(left), F.lit(0)).cast("long").alias("n_dropped"),
    )
    return out.select(*own, F.when(F.col(text).isNull(), F.struct(F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))).otherwise(counts).alias("__lines"))
