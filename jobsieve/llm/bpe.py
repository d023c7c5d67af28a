"""Byte-pair encoding by forced boundaries, and decoding.

A byte pair that is inside no token of the vocabulary can never be joined by a merge, so a text may
be cut there. After the tokenizer's own pre-splitting, the pieces are cut at all such pairs, each
fragment is encoded by itself and the results are put together.

Vocabulary files are read on the driver from a given path and travel to the tasks as a broadcast
value of a size that the vocabulary fixes.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

#: How byte-level vocabularies of this kind split a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose encoding a task remembers; when full it starts again.
REMEMBERED = 400_000
#: Longer fragments are merged with a heap.
LONG = 96
_NONE = 1 << 30


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary.

    Printable characters stand for themselves, the rest follow from U+0100 in order.
    """
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 0
    for b in range(256):
        out.append(chr(b) if b in plain else chr(256 + extra))
        extra += b not in plain
    return out


class Vocabulary:
    """Tokens, merges and special tokens of one tokenizer file, and the pairs inside tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        ids = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for token, i in ids.items():
            if token not in self.special:
                self.tokens[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            self.tokens[i] = token.encode()
        self.byte_ids = [ids[c] for c in byte_symbols()]
        self.rank, self.joined = {}, []
        for merge in spec["model"]["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.rank[ids[a] << 32 | ids[b]] = len(self.joined)
            self.joined.append(ids[a + b])
        self.inside = np.zeros((256, 256), bool)
        for i, token in enumerate(self.tokens):
            if len(token) > 1:
                t = np.frombuffer(token, np.uint8)
                self.inside[t[:-1], t[1:]] = True


class Encoder:
    """Encodes many texts at once; the packed ids of pieces seen before are kept."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.known: dict[str, bytes] = {}
        self.split = regex.compile(SPLIT).findall
        names = sorted(vocabulary.special, key=len, reverse=True)
        self.apart = regex.compile("(" + "|".join(map(regex.escape, names)) + ")").split if names else None
        pairs = sorted(vocabulary.rank.items())
        self.pair = np.array([p for p, _ in pairs], np.int64)
        self.pair_rank = np.array([r for _, r in pairs], np.int64)
        self.joined = np.array(vocabulary.joined, np.int64)
        self.byte_ids = np.array(vocabulary.byte_ids, np.int64)

    def learn(self, pieces: list[str]) -> None:
        """Encode pieces and remember them: cut at all forced boundaries, merge, put together."""
        raw = [p.encode() for p in pieces]
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum([len(x) for x in raw])
        cut = np.ones(len(data) + 1, bool)
        cut[1:-1] = ~self.v.inside[data[:-1], data[1:]]
        cut[ends] = True
        begin = np.flatnonzero(cut)
        size = np.diff(begin)
        begin, out = begin[:-1], np.full(len(data), -1, np.int64)
        low = 0
        for high in (1, 3, 5, 7, 9, 11, 13, 16, 20, 26, 40, LONG):
            rows = np.flatnonzero((size > low) & (size <= high))
            for some in np.array_split(rows, max(1, len(rows) // 20_000)):
                self._merge(data, begin[some], size[some], high, out)
            low = high
        for i in np.flatnonzero(size > LONG):
            ids = self._merged_long(self.byte_ids[data[begin[i] : begin[i] + size[i]]].tolist())
            out[begin[i] : begin[i] + len(ids)] = ids
        made = out >= 0
        packed, at = out[made].astype("<u4").tobytes(), (4 * np.concatenate(([0], np.cumsum(made)[ends - 1]))).tolist()
        self.known.update({p: packed[i:j] for p, i, j in zip(pieces, at, at[1:])})

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = np.where((a >= 0) & (b >= 0), a << 32 | np.maximum(b, 0), -1)
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.pair_rank[at], _NONE)

    def _merge(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, width: int, out: np.ndarray) -> None:
        """Merge the fragments that begin at ``begin``, the lowest rank first, the leftmost of equals."""
        if not len(begin):
            return
        place = np.arange(width + 1)
        inside = place < size[:, None]
        ids = np.where(inside, self.byte_ids[data[np.minimum(begin[:, None] + place, len(data) - 1)]], -1)
        rank = self._rank(ids[:, :-1], ids[:, 1:])
        live = np.arange(len(begin))
        while len(live):
            first = rank.argmin(axis=1)
            best = rank[np.arange(len(live)), first]
            go = best < _NONE
            done = live[~go]
            if len(done):
                flat, here = ids[~go], begin[done]
                r, c = np.nonzero(flat >= 0)
                out[here[r] + c] = flat[r, c]
            live, ids, rank, first, best = live[go], ids[go], rank[go], first[go], best[go]
            if not len(live):
                return
            after = np.minimum(place + (place > first[:, None]), width)
            ids = np.take_along_axis(ids, after, 1)
            ids[:, -1] = -1
            row = np.arange(len(live))
            ids[row, first] = self.joined[best]
            rank = np.take_along_axis(rank, np.minimum(after[:, :-1], width - 1), 1)
            rank[:, -1] = _NONE
            rank[row, first] = self._rank(ids[row, first], ids[row, first + 1])
            before = first > 0
            rank[row[before], first[before] - 1] = self._rank(ids[row[before], first[before] - 1], ids[row[before], first[before]])

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same merges in the same order; neighbours are linked and merges wait in a heap."""
        rank, joined, n = self.v.rank.get, self.v.joined, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ask = lambda i: rank(ids[i] << 32 | ids[after[i]]) if after[i] < n else None
        heap = [(r, i) for i in range(n - 1) if (r := ask(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if ids[i] < 0 or ask(i) != r:
                continue
            gone = after[i]
            ids[i], ids[gone], after[i] = joined[r], -1, after[gone]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (r := ask(k)) is not None:
                    heapq.heappush(heap, (r, k))
        return [x for x in ids if x >= 0]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, packed as little-endian unsigned 32-bit integers."""
        parts = [self.apart(t) if self.apart else [t] for t in texts]
        pieces = [[self.split(x) for x in p[::2]] for p in parts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        new = {w for text in pieces for part in text for w in part if w not in known}
        if new:
            self.learn(list(new))
        of, out = known.__getitem__, []
        for part, text in zip(parts, pieces):
            packed = [b"".join(map(of, text[0]))]
            for special, rest in zip(part[1::2], text[1:]):
                packed.append(np.array([self.v.special[special]], "<u4").tobytes())
                packed.extend(map(of, rest))
            out.append(b"".join(packed))
        return out

    def decode(self, packed: bytes) -> str:
        """The text of packed ids; bytes that are no UTF-8 become replacement characters."""
        ids = np.frombuffer(packed, "<u4").tolist()
        return b"".join(map(self.v.tokens.__getitem__, ids)).decode("utf-8", "replace")


def encode_documents(
    docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True
) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and ``ids`` if asked for.

    A null or empty text has no tokens. Every text is encoded whole; a document stays in its row.
    """
    source = docs.select(F.col(doc_id).alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    given = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(given.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                packed = encoder.encode(part.column(1).to_pylist())
                sizes = [len(x) // 4 for x in packed]
                columns = [
                    part.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array([sha256(x).hexdigest() for x in packed], pa.string()),
                    pa.array([sha256(encoder.decode(x).encode()).hexdigest() for x in packed], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                    ids = np.frombuffer(b"".join(packed), "<i4")
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = source.schema["__id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    out = source.mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))
    return out.withColumnRenamed("doc_id", doc_id)
