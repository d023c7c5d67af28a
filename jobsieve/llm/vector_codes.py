"""Product codes of vectors: integer Lloyd rounds that compare only with entries that moved.

A vector's components become integers and its parts are each coded by the nearest entry of the
part's codebook. A part keeps its entry and the exact distance to it from round to round. Where
its entry did not move, no other unmoved entry can have come nearer, so only the moved entries are
compared with the kept distance; where it moved, all entries are. Entries are compared in their
order, so the lower index wins ties either way.

A round is one pass over a written table: the pass assigns, and every task adds the sums of the
parts that changed their entry, so that the new entries follow from the old sums and these changes.
Codebooks and their sums are the only things the driver holds: parts x entries x (width + 1) numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.skew import fits_broadcast, salted_join
from ..session import cut, discard
from .common import free
from .vectors import finite, lists, matrix

PARTS, ENTRIES, SCALE, ROUNDS = 4, 256, 1024, 4
#: Numbers of one block of distances.
_BLOCK = 1 << 20


def part_bounds(dim: int, parts: int) -> list[tuple[int, int]]:
    """Consecutive parts; equal if the length allows it, otherwise one component apart at most."""
    return [(p * dim // parts, (p + 1) * dim // parts) for p in range(parts)]


def largest(dim: int, parts: int) -> int:
    """The largest integer component for which distances are exact in 64 bits."""
    width = max(b - a for a, b in part_bounds(dim, parts))
    return isqrt((1 << 61) // max(1, width)) // 2


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry and the exact squared distance, for every row of ``x``."""
    n, m = len(x), len(book)
    at, far = np.zeros(n, np.int32), np.zeros(n, np.int64)
    if not n:
        return at, far
    top = int(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)))
    small = 4 * x.shape[1] * top * top < 1 << 53  # then sums of doubles are exact
    step = max(1, _BLOCK // (m if small else m * max(1, x.shape[1])))
    for i in range(0, n, step):
        part = x[i : i + step]
        if small:
            a, b = part.astype(np.float64), book.astype(np.float64)
            d = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
        else:
            d = ((part[:, None, :] - book[None]) ** 2).sum(2)
        best = d.argmin(1)
        at[i : i + step], far[i : i + step] = best, d[np.arange(len(best)), best]
    return at, far


def assigned(
    x: np.ndarray, code: np.ndarray | None, far: np.ndarray | None, book: np.ndarray, moved: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of every row, from the last round's ``code`` and its exact distance ``far``."""
    if code is None:
        return nearest(x, book)
    code, far = code.copy(), far.copy()
    again = moved[code]
    code[again], far[again] = nearest(x[again], book)
    entries, rest = np.flatnonzero(moved), np.flatnonzero(~again)
    if len(entries) and len(rest):
        at, near = nearest(x[rest], book[entries])
        at = entries[at].astype(np.int32)
        better = (near < far[rest]) | ((near == far[rest]) & (at < code[rest]))
        code[rest[better]], far[rest[better]] = at[better], near[better]
    return code, far


def _add(sums: np.ndarray, at: np.ndarray, rows: np.ndarray, sign: int) -> None:
    """Add the rows, and their number as a last component, to the sums of their entries."""
    if not len(at):
        return
    order = np.argsort(at, kind="stable")
    at, rows = at[order], np.concatenate((rows[order], np.ones((len(rows), 1), np.int64)), 1)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    sums[at[first]] += sign * np.add.reduceat(rows, first, 0)


def _pass(keys: Sequence[str], names: dict[str, str], dim: int, books, moved, scale: int | None):
    """The function of one round; with ``scale`` it reads the vectors themselves and has no state yet."""
    bounds = part_bounds(dim, len(books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(b), hi - lo + 1), np.int64) for b, (lo, hi) in zip(books, bounds)]
        schema = None
        for batch in batches:
            column = batch.column(names["vec"])
            if scale is None:
                x = matrix(column, np.int64)
                old, dist = matrix(batch.column(names["code"]), np.int32), matrix(batch.column(names["far"]), np.int64)
            else:
                x, old, dist = np.floor(matrix(column) * scale).astype(np.int64), None, None
            n = len(x)
            code, far = np.zeros((n, len(books)), np.int32), np.zeros((n, len(books)), np.int64)
            for p, (lo, hi) in enumerate(bounds):
                part = x[:, lo:hi] if n else np.zeros((0, hi - lo), np.int64)
                was = old[:, p] if old is not None and n else None
                code[:, p], far[:, p] = assigned(part, was, dist[:, p] if was is not None else None, books[p], moved[p])
                changed = np.arange(n) if was is None else np.flatnonzero(code[:, p] != was)
                _add(sums[p], code[changed, p], part[changed], 1)
                if was is not None:
                    _add(sums[p], was[changed], part[changed], -1)
            if n:
                out = [batch.column(k) for k in keys]
                out += [lists(x, pa.int64()), lists(code, pa.int32()), lists(far, pa.int64())]
                empty = [pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int64()))]
                ready = pa.RecordBatch.from_arrays(out + empty, names=[*keys, *names.values()])
                schema = ready.schema
                yield ready
        for p, s in enumerate(sums):
            at = np.flatnonzero(s.any(1))
            if len(at) and schema is not None:
                blank = [pa.nulls(len(at), f.type) for f in list(schema)[: len(keys) + 3]]
                own = [pa.array(np.full(len(at), p), pa.int32()), pa.array(at, pa.int32()), lists(s[at], pa.int64())]
                yield pa.RecordBatch.from_arrays(blank + own, names=schema.names)

    return run


def compress(
    df: DataFrame, id_col: str, vec_col: str, keep: Sequence[str] = (), *,
    parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE, rounds: int = ROUNDS,
) -> tuple[DataFrame, list[np.ndarray]]:
    """Code every usable vector; returns the rows and the final codebooks.

    The rows have ``id_col``, the ``keep`` columns, ``code`` (an entry index per part) and
    ``error`` (the squared distances to the entries, summed over the parts). Components are
    ``floor(scale * x)``. A codebook begins as the parts of the rows with the smallest ids (ties by
    vector), ``entries`` of them or as many as there are; ``rounds`` times all parts are assigned
    and every used entry becomes the floor of its parts' mean; then all are assigned once more.

    * Rows whose vector is null, empty, or holds a null, NaN or infinite component are dropped.
    * Equal rows count each; a null id never begins a codebook, but its row is coded.
    * The length of the vector with the smallest id holds: rows of another length, and rows with
      components too large for exact 64-bit distances (beyond 2**18 for parts of 16 at a scale of
      1024), keep their row with null ``code`` and ``error`` and move no entry.
    * An empty table gives no rows and empty codebooks. Other columns of the table, whatever
      their names, have no effect.
    """
    spark = df.sparkSession
    p = free(df)
    keys = list(dict.fromkeys([id_col, *keep]))
    own = [F.col(f"`{k}`").alias(f"{p}k{i}") for i, k in enumerate(keys)]
    rows = df.select(*own, F.col(f"`{vec_col}`").alias(f"{p}vec")).where(finite(F.col(f"{p}vec")))
    vec, inner = F.col(f"{p}vec"), [f"{p}k{i}" for i in range(len(keys))]
    back = [F.col(c).alias(k) for c, k in zip(inner, keys)]
    first = rows.where(F.col(inner[0]).isNotNull()).orderBy(inner[0], vec).limit(entries).select(vec).collect()
    uncoded = [F.lit(None).cast("array<int>").alias("code"), F.lit(None).cast("long").alias("error")]
    if not first:
        return rows.select(*back, *uncoded), [np.zeros((0, 0), np.int64) for _ in range(parts)]
    dim = len(first[0][0])
    limit = largest(dim, parts)
    seeds = [np.floor(np.array(r[0], np.float64) * scale) for r in first if len(r[0]) == dim]
    seeds = np.array([s for s in seeds if (np.abs(s) <= limit).all()]).reshape(-1, dim).astype(np.int64)
    bounds = part_bounds(dim, parts)
    books = [seeds[:, lo:hi].copy() for lo, hi in bounds]
    if not len(seeds):
        return rows.select(*back, *uncoded), books
    scaled = lambda x: x.cast("double") * scale
    usable = (F.size(vec) == dim) & F.forall(vec, lambda x: (scaled(x) >= -limit) & (scaled(x) < limit + 1))

    names = {c: f"{p}{c}" for c in ("vec", "code", "far", "part", "entry", "sums")}
    kinds = {**{c: rows.schema[c].dataType.simpleString() for c in inner}, names["vec"]: "array<bigint>",
             names["code"]: "array<int>", names["far"]: "array<bigint>", names["part"]: "int", names["entry"]: "int",
             names["sums"]: "array<bigint>"}
    schema = ", ".join(f"`{c}` {t}" for c, t in kinds.items())
    total = [np.zeros((len(seeds), hi - lo + 1), np.int64) for lo, hi in bounds]
    moved = [np.ones(len(seeds), bool) for _ in books]
    state, source, by = None, rows.where(usable), scale
    for left in range(rounds, -1, -1):
        # ``vec`` is an input name of the first pass as well as of the later ones
        old, state = state, cut(source.mapInArrow(_pass(inner, names, dim, books, moved, by), schema))
        discard(old)
        if not left:
            break
        width = max(hi - lo for lo, hi in bounds) + 1
        summed = [F.sum(F.get(names["sums"], F.lit(i))).alias(f"{p}s{i}") for i in range(width)]
        for part, entry, *s in (
            state.where(F.col(names["part"]).isNotNull()).groupBy(names["part"], names["entry"]).agg(*summed).collect()
        ):
            total[part][entry] += np.array(s[: total[part].shape[1]], np.int64)
        fresh = [np.where(t[:, -1:] > 0, t[:, :-1] // np.maximum(t[:, -1:], 1), b) for t, b in zip(total, books)]
        moved = [(a != b).any(1) for a, b in zip(fresh, books)]
        books = fresh
        if not any(m.any() for m in moved):  # further rounds would change nothing
            break
        source, by = state.where(F.col(names["part"]).isNull()).select(*inner, *[names[c] for c in ("vec", "code", "far")]), None
    error = F.aggregate(names["far"], F.lit(0).cast("long"), lambda a, x: a + x)
    coded = state.where(F.col(names["part"]).isNull()).select(*back, F.col(names["code"]).alias("code"), error.alias("error"))
    return coded.unionByName(rows.where(~usable).select(*back, *uncoded)), books


def text_codes(code: Column) -> Column:
    """Codes as lower-case hexadecimal, two digits an entry."""
    return F.array_join(F.transform(code, lambda c: F.lpad(F.lower(F.hex(c.cast("long"))), 2, "0")), "")


def fingerprint(books: Sequence[np.ndarray]) -> str:
    """SHA-256 of all entries' components as decimal text, by part, entry and position."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.reshape(-1)).encode()).hexdigest()


def with_group_error(coded: DataFrame, group: str) -> DataFrame:
    """Add ``label_error``, the error summed over the rows of equal ``group``; nulls are one group.

    Sums are combined per task before they are shuffled, and the totals are copied to the rows if
    their size allows it; beyond that the rows of large groups are salted.
    """
    keyed = coded.withColumn("__group", F.struct(F.col(f"`{group}`").alias("g")))
    sums = keyed.groupBy("__group").agg(F.sum("error").alias("label_error"))
    if fits_broadcast(sums):
        return keyed.join(F.broadcast(sums), "__group", "left").drop("__group")
    return salted_join(keyed, sums, ["__group"], ["error"], "left").drop("__group")
