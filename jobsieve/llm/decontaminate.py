"""Benchmark decontamination under edits.

An item and a window of as many words of a document are compared by edit distance. The CGK random
walk writes out a string while a random bit, drawn for the step and the symbol, decides whether the
reading position moves on. Strings of small edit distance, walked with the same bits, fall into step
again after each edit, so that their outputs have a small Hamming distance. Bit sampling then hashes
a few output positions; repetitions with new bits and positions bring the recall to its target, and
an exact edit distance decides.

Only windows that share words with the item in about the same place need be walked: with at most
``d`` edits in ``n`` words a run of ``(n - d) / (d + 1)`` words is untouched, and ``n - q + 1 - q * d``
of the item's ``q``-word runs stay within ``d`` words of their place. Both facts lose nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import hashed_words, mix, per_text, text_steps

#: Edits allowed per word of an item.
EDITS = 0.2
RECALL = 0.998
#: Output positions in one hash.
SAMPLED = 2
#: Items that one pass over the documents searches for.
BLOCK_ITEMS = 10_000
#: Items on which the repetitions are measured, and copies of them with random edits of the allowed number.
MEASURED_ITEMS, MEASURED_COPIES = 64, 1024
_PAD = np.uint64(0xFFFFFFFFFFFFFFF1)


def runs(word: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all runs of ``q`` words."""
    n = max(0, len(word) - q + 1)
    out = np.full(n, q, np.uint64)
    for k in range(q):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + word[k : k + n])
    return out


def walk(word: np.ndarray, start: np.ndarray, stop: np.ndarray, seed: int, at: np.ndarray) -> np.ndarray:
    """Hash of the CGK outputs at positions ``at`` (sorted, for each string) of the strings word[start:stop]."""
    place, key = start.copy(), np.full(len(start), seed + 1, np.uint64)
    steps = int(at.max(initial=-1)) + 1
    order = np.argsort(at, axis=0, kind="stable")
    turn = [np.searchsorted(at[order[:, c], c], np.arange(steps + 1)) for c in range(at.shape[1])]
    for j in range(steps):
        symbol = word[np.minimum(place, len(word) - 1)]
        over = place >= stop
        if over.any():
            symbol[over] = _PAD
        for c, t in enumerate(turn):
            if t[j] < t[j + 1]:
                rows = order[t[j] : t[j + 1], c]
                key[rows] = mix(key[rows] * np.uint64(0x9E3779B97F4A7C15) + symbol[rows])
        step = np.uint64(((seed * 1_000_003 + j) * 2 + 1) * 0xD1342543DE82EF95 % (1 << 64))
        place += ((symbol * step) >> np.uint64(63)).view(np.int64)
    return key


class Items:
    """A block of benchmark items: words, allowed edits, runs to look for, and the hashes of each."""

    def __init__(self, ids: list, texts: list[str], edits: float = EDITS, recall: float = RECALL):
        data = [(t or "").encode() for t in texts]
        ends = np.cumsum([len(x) for x in data], dtype=np.int64)
        self.word, start, _ = hashed_words(np.frombuffer(b"".join(data), np.uint8), ends, True, True)
        at = per_text(start, ends)
        full = np.flatnonzero(np.diff(at) > 0)
        self.ids = [ids[i] for i in full]
        self.at, self.n = at[:-1][full], np.diff(at)[full]
        self.d = np.floor(self.n * edits + 1e-9).astype(np.int64)
        self.q = np.minimum(4, np.maximum(1, (self.n - self.d) // (self.d + 1)))
        # how many runs are sure to be about in their place; asking for a few of them is enough
        self.need = np.clip(self.n - self.q + 1 - self.q * self.d, 1, 4)
        self.by_q = {}
        for q in np.unique(self.q):
            rows = np.flatnonzero(self.q == q)
            key = np.concatenate([runs(self.word[a : a + n], q) for a, n in zip(self.at[rows], self.n[rows], strict=True)])
            item = np.repeat(rows, self.n[rows] - q + 1)
            offset = np.concatenate([np.arange(n - q + 1) for n in self.n[rows]])
            order = np.argsort(key, kind="stable")
            seen = np.zeros(1 << 20, bool)
            seen[key & np.uint64(len(seen) - 1)] = True
            self.by_q[int(q)] = key[order], item[order], offset[order], seen
        self.repeats = self._repetitions(recall)
        self.keys = np.array([self._hash(self.word, self.at, self.at + self.n, np.arange(len(self.n)), r) for r in range(self.repeats)])

    def _hash(self, word: np.ndarray, start: np.ndarray, stop: np.ndarray, item: np.ndarray, seed: int) -> np.ndarray:
        share = np.random.default_rng((7, seed)).random(SAMPLED)
        at = np.sort(np.floor(share[None, :] * 2 * self.n[item][:, None]).astype(np.int64), axis=1)
        return walk(word, start, stop, seed, at)

    def _repetitions(self, recall: float) -> int:
        """How many repetitions reach the recall, from the collisions of items with edited copies."""
        if not len(self.n):
            return 1
        rng, copies, item = np.random.default_rng(11), [], []
        some = range(0, len(self.n), max(1, len(self.n) // MEASURED_ITEMS))
        for i in some:
            for _ in range(-(-MEASURED_COPIES // len(some))):
                w = list(self.word[self.at[i] : self.at[i] + self.n[i]])
                for _ in range(self.d[i]):
                    k, what = rng.integers(0, len(w)), rng.integers(0, 3)
                    w[k : k + (what != 1)] = [] if what == 0 and len(w) > 1 else [np.uint64(rng.integers(1, 1 << 62))]
                copies.append(np.array(w, np.uint64)[: self.n[i]])
                item.append(i)
        word, item = np.concatenate(copies), np.array(item)
        size = np.array([len(c) for c in copies])
        start = np.cumsum(size) - size
        missed, r = np.ones(len(item), bool), 0
        while r < 200 and missed.mean() > 1 - recall:
            own = self._hash(self.word, self.at[item], self.at[item] + self.n[item], item, r)
            missed &= own != self._hash(word, start, start + size, item, r)
            r += 1
        return max(r, 4)

    def find(self, data: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, edits, first word) for every item that a text holds, at its best place."""
        word, start, _ = hashed_words(data, ends, True, True)
        bounds = per_text(start, ends)
        begin, item = self._windows(word, bounds)
        if not len(begin):
            return []
        text = np.searchsorted(bounds, begin, "right") - 1
        stop = np.minimum(begin + self.n[item], bounds[text + 1])
        met = np.zeros(len(begin), bool)
        for r in range(self.repeats):
            left = np.flatnonzero(~met)
            met[left] = self._hash(word, begin[left], stop[left], item[left], r) == self.keys[r][item[left]]
        best = {}
        text, item, begin = text[met], item[met], begin[met]
        i = 0
        while i < len(begin):  # windows of an item that overlap are one stretch
            j = i + 1
            while j < len(begin) and item[j] == item[i] and text[j] == text[i] and begin[j] - begin[j - 1] <= self.n[item[i]]:
                j += 1
            k, t = int(item[i]), int(text[i])
            lo = max(int(bounds[t]), int(begin[i] - self.d[k]))
            hi = min(int(bounds[t + 1]), int(begin[j - 1] + self.n[k] + self.d[k]))
            edits = self._edits(k, word[lo:hi])
            if edits <= self.d[k] and edits < best.get((t, k), (1 << 30,))[0]:
                best[t, k] = edits, int(begin[i] - bounds[t])
            i = j
        return [(t, k, e, at) for (t, k), (e, at) in best.items()]

    def _windows(self, word: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where windows of which item begin, sorted by item and place."""
        begins, items = [], []
        for q, (key, item, offset, seen) in self.by_q.items():
            here = runs(word, q)
            hit = np.flatnonzero(seen[here & np.uint64(len(seen) - 1)])
            lo, hi = np.searchsorted(key, here[hit], "left"), np.searchsorted(key, here[hit], "right")
            count = hi - lo
            row = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
            place, which, shift = np.repeat(hit, count), item[row], offset[row]
            text = np.searchsorted(bounds, place, "right") - 1
            inside = place + q <= bounds[text + 1]
            place, which, shift, text = place[inside], which[inside], shift[inside], text[inside]
            line = place - shift
            order = np.lexsort((line, text, which))
            which, line, text = which[order], line[order], text[order]
            reach, need = 2 * self.d[which], self.need[which]
            near = need < 2
            for k in range(2, 5):  # k runs whose places differ by no more than edits allow
                m = len(which) - k + 1
                if m > 0:
                    a, z = slice(0, m), slice(k - 1, None)
                    close = (which[z] == which[a]) & (text[z] == text[a]) & (line[z] - line[a] <= reach[a]) & (need[a] == k)
                    for i in range(k):
                        near[i : i + m] |= close
            keep = np.flatnonzero(near)
            which, line, text = which[keep], line[keep], text[keep]
            width = 2 * self.d[which] + 1
            begin = np.repeat(line - self.d[which] - (np.cumsum(width) - width), width) + np.arange(width.sum())
            which, text = np.repeat(which, width), np.repeat(text, width)
            begin = np.clip(begin, bounds[text], bounds[text + 1] - 1)
            pair = np.unique(np.stack([which, begin]), axis=1) if len(which) else np.zeros((2, 0), np.int64)
            items.append(pair[0])
            begins.append(pair[1])
        if not begins:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(begins), np.concatenate(items)

    def _edits(self, item: int, part: np.ndarray) -> int:
        """Edits that turn the item into the nearest stretch of ``part``: exact."""
        steps = np.arange(len(part) + 1)
        row = np.zeros(len(part) + 1, np.int64)
        for i, w in enumerate(self.word[self.at[item] : self.at[item] + self.n[item]], 1):
            new = np.empty_like(row)
            new[0] = i
            new[1:] = np.minimum(row[:-1] + (part != w), row[1:] + 1)
            row = np.minimum.accumulate(new - steps) + steps
        return int(row.min())


def _blocks(benchmark: DataFrame, item_id: str, text: str, size: int) -> Iterator[Items]:
    """The items in blocks of about ``size``, each small enough for every task to hold."""
    rows = benchmark.select(F.col(item_id).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    n = max(1, -(-rows.count() // size))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("t"), F.lit(n)) == k)
        got = part.collect()
        yield Items([r.i for r in got], [r.t for r in got])


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """(doc_id, item_id, n_words, n_edits, first_word): every item that a document holds.

    Words are runs of characters other than ASCII white space and marks, A-Z taken as a-z. A document
    holds an item if some stretch of it is within ``EDITS`` times the item's words of it. Items of
    fewer than five words must occur unchanged; items without words, and null or empty texts, match
    nothing. Repeated rows are searched and reported each.
    """
    found = None
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    schema = f"doc_id {kind(docs, doc_id)}, item_id {kind(benchmark, item_id)}, n_words bigint, n_edits bigint, first_word bigint"
    for items in _blocks(benchmark, item_id, item_text, block_items):
        id_type = pa.int64() if kind(benchmark, item_id) in ("bigint",) else None

        def run(batches: Iterator[pa.RecordBatch], items=items, id_type=id_type) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i, _, data, ends in text_steps(b.column(1)):
                    hits = items.find(data, ends)
                    if hits:
                        yield pa.RecordBatch.from_arrays(
                            [
                                b.column(0).take(pa.array([i + h[0] for h in hits])),
                                pa.array([items.ids[h[1]] for h in hits], id_type),
                                pa.array([int(items.n[h[1]]) for h in hits], pa.int64()),
                                pa.array([h[2] for h in hits], pa.int64()),
                                pa.array([h[3] for h in hits], pa.int64()),
                            ],
                            names=["doc_id", "item_id", "n_words", "n_edits", "first_word"],
                        )

        part = docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return found


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """The documents that hold no item, with their own columns. Nothing is shuffled."""
    where = docs.columns.index(text)
    for items in _blocks(benchmark, item_id, item_text, block_items):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for b in batches:
                clean = np.ones(b.num_rows, bool)
                for i, _, data, ends in text_steps(b.column(where)):
                    clean[[i + h[0] for h in items.find(data, ends)]] = False
                yield b.filter(pc.fill_null(pa.array(clean), True))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
