"""From glyph runs to the lines of a page, in one sweep over each page.

Runs are shuffled once, by page, and arrive sorted by height and place. A task holds one printed page
at a time: its rows, its gutter, its bands and its lines follow from one pass over the sorted runs.
A page that two Arrow batches share is carried from one to the next.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .. import vocab
from ..functions.text import SPACE

PAGE = ["doc_id", "page"]
_RUN = ["x", "y", "right", "str", "size", "font"]
_LINE = [
    ("band", pa.int64(), "long"), ("side", pa.int32(), "int"), ("row_y", pa.float64(), "double"), ("text", pa.string(), "string"),
    ("y", pa.float64(), "double"), ("x", pa.float64(), "double"), ("right", pa.float64(), "double"), ("font_size", pa.float64(), "double"),
    ("font_name", pa.string(), "string"), ("is_list_item", pa.bool_(), "boolean"),
]
# The listed kinds of white space, as in the column functions, and no others.
_BULLET_ONLY, _BULLET = re.compile(vocab.BULLET_ONLY, re.ASCII), re.compile(vocab.BULLET_GLYPHS, re.ASCII)
_EDGES = re.compile(f"^{SPACE}+|{SPACE}+$", re.ASCII)


def by_page(glyphs: DataFrame, *columns: str) -> DataFrame:
    """The one shuffle: runs of a page together, from the top and from the left."""
    return glyphs.select(*columns).repartition(*PAGE).sortWithinPartitions(*PAGE, "y", "x")


def _pages(batch: pa.RecordBatch) -> tuple[pa.DictionaryArray, list[int], list[int]]:
    """Encoded documents of a batch, where pages begin in it, and the pages' numbers there."""
    docs = batch.column("doc_id").dictionary_encode()
    doc = docs.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    page = batch.column("page").to_numpy(zero_copy_only=False)
    new = np.flatnonzero((doc[1:] != doc[:-1]) | (page[1:] != page[:-1])) + 1
    return docs, [0, *new.tolist()] if len(doc) else [], page


def baseline_rows(glyphs: DataFrame) -> DataFrame:
    """Add ``row_y``: the baseline of the row a run belongs to.

    From the top, a row takes every run within the tolerance of its first one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first = None, 0.0
        for batch in batches:
            docs, begins, pages = _pages(batch)
            heights, out = batch.column("y").to_pylist(), []
            for a, b in zip(begins, [*begins[1:], len(heights)]):
                at = (docs[a].as_py(), pages[a])
                if at != key:
                    key, first = at, heights[a]
                for y in heights[a:b]:
                    if y - first > vocab.BASELINE_TOLERANCE:
                        first = y
                    out.append(first)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, "row_y"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in glyphs.schema) + ", row_y double"
    return by_page(glyphs, *glyphs.columns).mapInArrow(run, schema)


def _rows(heights: list[float]) -> list[tuple[int, int]]:
    """Where each row of a page begins and ends among its sorted runs."""
    begins, first = [0], heights[0]
    for i, y in enumerate(heights):
        if y - first > vocab.BASELINE_TOLERANCE:
            begins.append(i)
            first = y
    return list(zip(begins, [*begins[1:], len(heights)]))


def gutter_of(x: list[float], right: list[float], rows: int) -> float | None:
    """The middle of the widest stretch of the page's middle that few rows cross, or none."""
    xs, ends = np.asarray(x), np.asarray(right)
    left = xs.min()
    span = float(ends.max() - left)
    if rows < 6 or span < 4 * vocab.MIN_GUTTER_POINTS:
        return None
    cells = int(np.ceil(span)) + 1
    first = np.maximum(0, np.floor(xs - left)).astype(np.int64)
    last = np.minimum(cells - 1, np.ceil(ends - left)).astype(np.int64)
    there = last >= first
    edges = np.bincount(first[there], minlength=cells + 1) - np.bincount(last[there] + 1, minlength=cells + 1)
    lo, hi = int(np.floor(span * 0.2)), int(np.ceil(span * 0.8))
    free = np.cumsum(edges)[lo : hi + 1] <= rows * vocab.MAX_GUTTER_CROSSINGS
    turns = np.flatnonzero(np.diff(np.concatenate(([False], free, [False])).astype(np.int8)))
    starts, stops = turns[::2] + lo, np.minimum(turns[1::2] + lo, hi)
    widths = stops - starts
    if not len(widths) or widths.max() < vocab.MIN_GUTTER_POINTS:
        return None
    best = int(widths.argmax())  # the first of equally wide ones
    return float(left + (starts[best] + stops[best]) / 2)


def _line(band: int, side: int, row_y: float, runs: list[tuple]) -> tuple:
    """One printed line: text with spaces at gaps, bullet stripped, extent and main font."""
    runs.sort()
    hanging = bool(_BULLET_ONLY.search(_EDGES.sub("", runs[0][3])))
    ink = runs[1:] if hanging and len(runs) > 1 else runs
    text, cursor, weight = "", 0.0, {}
    for x, _, right, piece, _, font in ink:
        text += " " + piece if text and x - cursor > vocab.SPACE_GAP else piece
        cursor = right
        weight[font] = weight.get(font, 0) + len(_EDGES.sub("", piece))
    stripped = _BULLET.sub("", text)
    return (
        band, side, row_y, _EDGES.sub("", stripped), ink[0][1], min(r[0] for r in ink), max(r[2] for r in ink), max(r[4] for r in ink),
        max(weight, key=weight.get), hanging or stripped != text,
    )


def lines_of(runs: list[tuple]) -> list[tuple]:
    """The lines of a page, in reading order, from its runs sorted by height and place.

    A row with a run across the gutter spans the page and ends a band; inside a band the left column
    (side 0) comes before the right (1), and the spanning row (2) last.
    """
    rows = _rows([r[1] for r in runs])
    gutter = gutter_of([r[0] for r in runs], [r[2] for r in runs], len(rows))
    out, band = [], 0
    for a, b in rows:
        row, row_y = runs[a:b], runs[a][1]
        if gutter is None:
            out.append(_line(band, 0, row_y, row))
        elif any(r[0] < gutter < r[2] for r in row):
            out.append(_line(band, 2, row_y, row))
            band += 1
        else:
            for side, half in ((0, [r for r in row if r[2] <= gutter]), (1, [r for r in row if r[2] > gutter])):
                if half:
                    out.append(_line(band, side, row_y, half))
    out.sort(key=lambda line: line[:3])
    return out


def _swept(glyphs: DataFrame, of_page: Callable[[list[tuple]], list[tuple]], fields: list[tuple]) -> DataFrame:
    """The rows ``of_page`` makes of each page's runs, behind the page's key."""
    kinds = {f.name: f.dataType.simpleString() for f in glyphs.schema if f.name in PAGE}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, kind = None, [], None

        def ready(done: list[tuple]) -> pa.RecordBatch:
            names = [*PAGE, *[f[0] for f in fields]]
            types = [*kind, *[f[1] for f in fields]]
            columns = list(zip(*done)) if done else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for batch in batches:
            kind = [batch.schema.field(c).type for c in PAGE]
            docs, begins, pages = _pages(batch)
            runs = list(zip(*[batch.column(c).to_pylist() for c in _RUN]))
            done = []
            for a, b in zip(begins, [*begins[1:], len(runs)]):
                at = (docs[a].as_py(), int(pages[a]))
                if at != key and key is not None:
                    done += [(*key, *row) for row in of_page(held)]
                    held = []
                key = at
                held += runs[a:b]
            yield ready(done)
        if key is not None:
            yield ready([(*key, *row) for row in of_page(held)])

    schema = ", ".join([*[f"{c} {kinds[c]}" for c in PAGE], *[f"{n} {t}" for n, _, t in fields]])
    whole = glyphs.where(F.col("y").isNotNull() & F.col("x").isNotNull() & F.col("right").isNotNull())
    return by_page(whole, *PAGE, *_RUN).mapInArrow(run, schema)


def gutters(glyphs: DataFrame) -> DataFrame:
    """``gutter``, the x that splits a two-column page, one row per page; null for one column."""

    def of_page(runs: list[tuple]) -> list[tuple]:
        return [(gutter_of([r[0] for r in runs], [r[2] for r in runs], len(_rows([r[1] for r in runs]))),)]

    return _swept(glyphs, of_page, [("gutter", pa.float64(), "double")])


def page_lines(glyphs: DataFrame) -> DataFrame:
    """The lines of every page; they are read by ``(band, side, row_y)``.

    ``glyphs`` has ``doc_id, page, x, y, right, str, size, font``, ``page`` a number that is not null. A run
    without a place or a height is in no line; a null text or font counts as empty.
    """
    named = glyphs.withColumns({"str": F.coalesce("str", F.lit("")), "font": F.coalesce("font", F.lit("")), "size": F.coalesce("size", F.lit(0.0))})
    return _swept(named, lines_of, _LINE)
