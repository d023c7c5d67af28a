"""What several operators share: the table reader and word hashes of whole Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: White space of the contracts: space and 0x09 to 0x0D.
SPACE = r"[\x20\x09-\x0D]"
#: Bytes of text that one vectorised step works on.
STEP_BYTES = 1 << 20
_ODD = 0x9E3779B97F4A7C15
_WRAP = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(*tables: DataFrame) -> str:
    """A prefix that no column name of the tables begins with."""
    prefix = "__"
    while any(c.startswith(prefix) for t in tables for c in t.columns):
        prefix += "_"
    return prefix


def own_columns(df: DataFrame, *replaced: str) -> list[Column]:
    """The table's columns without those whose names the result takes for itself."""
    return [F.col(f"`{c}`") for c in df.columns if c.lower() not in replaced]


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _byte_values(fold: bool) -> np.ndarray:
    """A random value for each byte; with ``fold``, A-Z have those of a-z."""
    v = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
    if fold:
        v[65:91] = v[97:123]
    return v


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _ODD, np.uint64)
    up[0] = 1
    back = np.full(n, pow(_ODD, -1, 1 << 64), np.uint64)
    back[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)


@lru_cache(maxsize=4)
def _gaps(punctuation: bool) -> np.ndarray:
    """Which bytes end a word: white space, with ``punctuation`` also ASCII marks."""
    gap = np.zeros(256, bool)
    gap[[32, *range(9, 14)]] = True
    if punctuation:
        for lo, hi in ((33, 48), (58, 65), (91, 97), (123, 127)):
            gap[lo:hi] = True
    return gap


def hashed_words(data: np.ndarray, ends: np.ndarray, fold: bool = False, punctuation: bool = False):
    """(hash, start, end) of the words in ``data``, the UTF-8 bytes of texts that end at ``ends``.

    A word is a run of bytes that are no gap and never spans two texts. Equal words have equal
    64-bit hashes; the hash is a polynomial of the word's bytes, taken from one running sum.
    """
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none
    inside = ~_gaps(punctuation)[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = ends[(ends > 0) & (ends < n)]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, back = _powers(1 << max(20, int(n).bit_length()))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_byte_values(fold)[data] * up[:n], out=total[1:], dtype=np.uint64)
    value = (total[end] - total[start]) * back[start]
    return mix(value ^ (end - start).astype(np.uint64)), start, end


def text_steps(column: pa.Array, step: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of about ``step`` bytes: (first row, last row, bytes, ends).

    ``ends`` has one entry per row, relative to the run's bytes. Null texts count as empty. One
    text is never split, so a longer one is a run of its own.
    """
    column = column.cast(pa.large_string()).fill_null("")
    _, at, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(at, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + step, "right")) - 1)
        j = min(j, n)
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i + 1 : j + 1] - offsets[i]
        i = j


def per_text(start: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Index into the word list where each text's words begin, with the total at the end."""
    begins = np.concatenate(([0], ends[:-1])) if len(ends) else np.zeros(0, np.int64)
    return np.append(np.searchsorted(start, begins), len(start))
