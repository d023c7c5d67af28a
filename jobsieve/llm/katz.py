"""Katz backoff scoring.

Counts of all words and of all word pairs come from the training documents; nothing is left out or
pooled. Pair counts up to five are discounted by Good and Turing's estimate; what a context loses
goes to the words it has not been seen with, in proportion to the first order, with a backoff weight
that makes each context sum to one exactly. Words the training texts lack are one class with one
count.

Texts are encoded once, in blocks of bounded size. A block sends each of its distinct words and pairs once
to the bucket of its hash, whatever the number of texts that have it, so no key is hot; the bucket answers
with the counts over all blocks. What contexts lose, and their weights, go the same way: a second exchange by
bucket, from the block that a pair is dealt to and back to the blocks whose texts want the context.
Numbers travel packed. ``count_words``, ``fit`` and ``table_of`` give the same model as plain tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut, discard
from .common import hashed_words, per_text, text_steps

#: Most frequent words whose counts every task of ``fit`` holds; those of all others are joined.
HELD_COUNTS = 1 << 17
DISCOUNTED = 5
#: Tokens of a block of texts, and of all blocks together for each bucket of keys: what one task holds at a time.
BLOCK_TOKENS, BUCKET_TOKENS = 1 << 20, 1 << 22
#: What a context must lose at least, in counts, for unseen pairs to get their share from it.
LEAST_LOST = 1e-9
#: The end of a text, also the context of its first word.
_END_HASH = np.uint64(0x1F0E0D0C0B0A0908)


@dataclass
class Corpus:
    """Training counts: words, tokens, distinct tokens, and the count from which every task holds a word."""

    words: DataFrame
    n: int
    v: int
    least: int


def _tokens(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of the texts, each closed by an end, and where each text's tokens begin."""
    word, start, _ = hashed_words(data, ends, fold=True)
    at = per_text(start, ends)
    begin = at + np.arange(len(at))
    out = np.full(begin[-1], _END_HASH, np.uint64)
    keep = np.ones(begin[-1], bool)
    keep[begin[1:] - 1] = False
    out[keep] = word
    return out, begin


def _runs(column: pa.Array, trained: np.ndarray):
    """(first row, tokens, begins, whether each text trains) of runs of texts."""
    for i, j, data, ends in text_steps(column):
        token, begin = _tokens(data, ends)
        yield i, token, begin, trained[i:j]


def held_out(doc_id):
    """Documents whose crc32 of the id as text leaves 2 modulo 7 are held out; a null id trains."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def _threshold(sizes: list, most: int) -> int:
    """The smallest count whose words, with all more frequent ones, are at most ``most``."""
    total, least = 0, 1 << 62
    for row in sorted(sizes, key=lambda r: -r.c):
        total += row.n
        if total > most:
            break
        least = row.c
    return least


def _prepared(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("id"), held_out(doc_id).alias("held"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def count_words(source: DataFrame) -> Corpus:
    """Counts of all training tokens, combined per batch before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = []
            for _, token, begin, train in _runs(b.column(1), ~b.column(0).to_numpy(zero_copy_only=False)):
                token = token[np.repeat(train, np.diff(begin))]
                seen.append(np.unique(token, return_counts=True))
            word, where = np.unique(np.concatenate([w for w, _ in seen]), return_inverse=True)
            count = np.bincount(where, np.concatenate([c for _, c in seen]), len(word)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(count)], names=["w", "c"])

    words = cut(source.select("held", "text").mapInArrow(run, "w bigint, c bigint").groupBy("w").agg(F.sum("c").alias("c")))
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    return Corpus(words, int(n), int(v), _least(words))


def _least(counts: DataFrame) -> int:
    """The count from which the rows of ``counts`` are few enough to be held by every task."""
    sizes = counts.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    # counts held by many rows cannot be frequent ones; the frequent end of the list is short
    return _threshold(sizes.orderBy(F.desc("c")).limit(HELD_COUNTS).collect(), HELD_COUNTS)


def _before(token: np.ndarray) -> np.ndarray:
    """The token before each. Every text closes with an end, so before a text's first there is one too."""
    return np.roll(token, 1)


def _pair(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """One 64-bit key of a pair of word hashes."""
    return (context << np.uint64(1) | context >> np.uint64(63)) ^ word


def discounts(sizes: dict[int, int], most: int = DISCOUNTED) -> list[float]:
    """Factors for counts 1 to ``most`` from the numbers of pairs with each count.

    Where these numbers do not give a factor between 0 and 1, half a count is taken off instead.
    """
    n = lambda r: sizes.get(r, 0)
    tail = (most + 1) * n(most + 1) / n(1) if n(1) else 1.0
    out = []
    for r in range(1, most + 1):
        d = ((r + 1) * n(r + 1) / (r * n(r)) - tail) / (1 - tail) if n(r) and tail < 1 else 0.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


def _distinct(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of the columns in order, and how often each occurs."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    at = np.flatnonzero(new)
    return [c[at] for c in columns], np.diff(np.append(at, len(order)))


def _kept(c, factor: list[float]):
    """What the discount leaves of a count, as a column."""
    out = c.cast("double")
    for r, d in enumerate(factor, 1):
        out = F.when(c == r, F.lit(r * d)).otherwise(out)
    return out


def fit(source: DataFrame, corpus: Corpus) -> tuple[DataFrame, DataFrame, list[float], int]:
    """(pairs with counts, words with count, backoff weight and denominator, discounts, mass of the first order).

    A word's first order is its count plus one by the mass; the words unknown to the training texts
    share the one that is left. ``weight`` and ``whole`` are log10 and belong to the word as a context.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            contexts, words = [], []
            for _, token, begin, train in _runs(b.column(1), ~b.column(0).to_numpy(zero_copy_only=False)):
                here = np.repeat(train, np.diff(begin))
                contexts.append(_before(token)[here])
                words.append(token[here])
            (context, word), count = _distinct(np.concatenate(contexts), np.concatenate(words))
            yield pa.RecordBatch.from_arrays(
                [pa.array(context.view(np.int64)), pa.array(word.view(np.int64)), pa.array(count.astype(np.int64))],
                names=["context", "w", "c"],
            )

    raw = source.select("held", "text").mapInArrow(run, "context bigint, w bigint, c bigint")
    pairs = cut(raw.groupBy("context", "w").agg(F.sum("c").alias("c")))
    few = pairs.where(F.col("c") <= DISCOUNTED + 1).groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()
    factor = discounts({r.c: r.n for r in few})
    mass = corpus.n + corpus.v + 1

    # frequent words, which follow many contexts, are copied; all others have few pairs each
    count = corpus.words.select("w", F.col("c").alias("cw"))
    often = F.broadcast(count.where(F.col("cw") >= corpus.least))
    rare = pairs.join(often, "w", "left_anti").join(count.where(F.col("cw") < corpus.least), "w")
    rows = pairs.join(often, "w").select("context", "c", "cw").union(rare.select("context", "c", "cw"))
    sums = rows.groupBy(F.col("context").alias("w")).agg(
        F.sum("c").alias("c"), F.sum(F.col("c") - _kept(F.col("c"), factor)).alias("lost"), F.sum(F.col("cw") + 1).alias("low")
    )
    # a context without low counts gives up one count, so that unseen pairs keep a probability
    spare = F.when(F.col("lost") < LEAST_LOST, F.lit(1.0)).otherwise(F.lit(0.0))
    whole = F.col("c") + spare
    words = cut(
        sums.select(
            "w", "c", F.log10((F.col("lost") + spare) / whole / ((F.lit(mass) - F.col("low")) / F.lit(float(mass)))).alias("weight"),
            F.log10(whole).alias("whole"),
        )
    )
    return pairs, words, factor, mass


def table_of(pairs: DataFrame, words: DataFrame, factor: list[float], mass: int) -> np.ndarray:
    """log10 probability of each word, and last of all unknown ones, in each known context.

    Pulls the whole model to one place: for looking at small ones.
    """
    rows = words.collect()
    at = {r.w: i for i, r in enumerate(rows)}
    first = np.log10(np.array([r.c + 1 for r in rows] + [1]) / mass)
    table = np.array([r.weight for r in rows])[:, None] + first[None, :]
    for r in pairs.select("context", "w", F.log10(_kept(F.col("c"), factor)).alias("kept")).collect():
        table[at[r.context], at[r.w]] = r.kept - rows[at[r.context]].whole
    return table


def _packed(values: np.ndarray) -> bytes:
    """Numbers as bytes, first bytes first, compressed: small numbers take little room."""
    values = np.ascontiguousarray(values)
    return pa.compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int, kind=np.int64) -> np.ndarray:
    size = np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    raw = pa.decompress(data, decompressed_size=n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).ravel()


def _packed_keys(keys: np.ndarray) -> bytes:
    return _packed(np.diff(keys, prepend=np.uint64(0)))


def _unpacked_keys(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unpacked(data, n, np.uint64), dtype=np.uint64)


def _edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket, an equal share of the hashes' range, begins in sorted keys, and their end."""
    first = np.array([-(-(b << 32) // buckets) for b in range(buckets + 1)], np.uint64)
    return np.searchsorted(keys >> np.uint64(32), first)


def _list(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _blocks(source: DataFrame) -> DataFrame:
    """The texts in blocks of bounded size, a row each: ids, lengths, distinct words by hash, and tokens as ranks of words.

    Block numbers are settled by writing the table.
    """
    kind = source.schema["id"].dataType.simpleString()
    names = ["id", "held", "n", "n_words", "words", "counts", "tokens"]

    def block(parts: list) -> pa.RecordBatch:
        ids, held, n, token = zip(*parts)
        word, at, count = np.unique(np.concatenate(token), return_inverse=True, return_counts=True)
        rank = np.empty(len(word), np.int32)
        rank[np.argsort(-count, kind="stable")] = np.arange(len(word), dtype=np.int32)
        return pa.RecordBatch.from_arrays(
            [
                _list(pa.concat_arrays(ids)), _list(pa.array(np.concatenate(held))), _list(pa.array(np.concatenate(n))),
                pa.array([len(word)], pa.int64()), pa.array([_packed_keys(word)]), pa.array([_packed(count)]), pa.array([_packed(rank[at])]),
            ],
            names=names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, total = [], 0
        for b in batches:
            held = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for i, token, begin, own in _runs(b.column(2), held):
                parts.append((b.column(0).slice(i, len(own)), own, np.diff(begin).astype(np.int64), token))
                total += len(token)
                if total >= BLOCK_TOKENS:
                    yield block(parts)
                    parts, total = [], 0
        if parts:
            yield block(parts)

    schema = f"id array<{kind}>, held array<boolean>, n array<bigint>, n_words bigint, words binary, counts binary, tokens binary"
    rows = source.select("id", "held", "text").mapInArrow(run, schema)
    total = F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)
    return cut(rows.select(F.monotonically_increasing_id().alias("block"), *names, total.alias("total")))


class _Block:
    """A block's words in the order of their hashes, its tokens as places among them, and its distinct pairs by key."""

    def __init__(self, row: dict):
        self.word = _unpacked_keys(row["words"], row["n_words"])
        by_rank = np.argsort(-_unpacked(row["counts"], row["n_words"]), kind="stable")
        self.n, self.held = np.array(row["n"], np.int64), np.array(row["held"], bool)
        self.token = by_rank[_unpacked(row["tokens"], int(self.n.sum()), np.int32)]
        self.before = _before(self.token)
        self.text = np.repeat(np.arange(len(self.n)), self.n)
        self.train = ~self.held[self.text]
        self.pair, self.pair_at = np.unique(_pair(self.word[self.before], self.word[self.token]), return_inverse=True)

    def ends_of(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the context and of the word of each distinct pair."""
        context, word = np.empty((2, len(self.pair)), np.int64)
        context[self.pair_at], word[self.pair_at] = self.before, self.token
        return context, word


def _summed(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(place among the distinct keys of each key of the lists, one row of each distinct key)."""
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(len(order), bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    del key
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return place, order[new]


def _counted(blocks: DataFrame, buckets: int) -> DataFrame:
    """Training counts of every word and pair of each block, in the block's order of keys, by block and bucket.

    A pair's count is doubled, and odd for one of the blocks that have it. ``sizes``, once per bucket, are
    tokens, distinct words, and numbers of pairs with counts one to ``DISCOUNTED + 1``.
    """
    names = ["block", "bucket", "n_words", "words", "words_n", "n_pairs", "pairs", "pairs_n"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                x = _Block(row)
                word_n = np.bincount(x.token[x.train], minlength=len(x.word))
                pair_n = np.bincount(x.pair_at[x.train], minlength=len(x.pair))
                w, p = _edges(x.word, buckets), _edges(x.pair, buckets)
                out = [
                    (
                        row["block"], i, int(w[i + 1] - w[i]), _packed_keys(x.word[w[i] : w[i + 1]]), _packed(word_n[w[i] : w[i + 1]]),
                        int(p[i + 1] - p[i]), _packed_keys(x.pair[p[i] : p[i + 1]]), _packed(pair_n[p[i] : p[i + 1]]),
                    )
                    for i in range(buckets) if w[i + 1] > w[i] or p[i + 1] > p[i]
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), sent)], names=names)

    sent = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]

    def count(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        totals, back = [], []
        for name in ("words", "pairs"):
            many = rows[f"n_{name}"]
            place, one = _summed([_unpacked_keys(d, m) for d, m in zip(rows[name], many)])
            n = np.concatenate([_unpacked(d, m) for d, m in zip(rows[f"{name}_n"], many)])
            total = np.bincount(place, n, len(one)).astype(np.int64)
            answer = total[place]
            if name == "pairs":
                answer *= 2
                answer[one] += 1
            totals.append(total)
            back.append([_packed(x) for x in np.split(answer, np.cumsum(many)[:-1])])
        word, pair = totals
        sizes = [int(word.sum()), int((word > 0).sum()), *np.bincount(pair[pair <= DISCOUNTED + 1], minlength=DISCOUNTED + 2)[1:].tolist()]
        return pa.table(
            {
                "block": rows["block"], "bucket": pa.array(rows["bucket"], pa.int32()), "n_words": rows["n_words"], "n_pairs": rows["n_pairs"],
                "words": pa.array(back[0], pa.binary()), "pairs": pa.array(back[1], pa.binary()),
                "sizes": pa.array([sizes] + [None] * (len(rows["block"]) - 1), pa.list_(pa.int64())),
            }
        )

    rows = blocks.drop("id").mapInArrow(
        send, "block bigint, bucket int, n_words bigint, words binary, words_n binary, n_pairs bigint, pairs binary, pairs_n binary"
    )
    schema = "block bigint, bucket int, n_words bigint, n_pairs bigint, words binary, pairs binary, sizes array<bigint>"
    return cut(rows.groupBy("bucket").applyInArrow(count, schema))


def _first_sums(blocks: DataFrame, counted: DataFrame, buckets: int, factor: list[float], mass: int) -> DataFrame:
    """Per block a row with its texts' sums, and rows per bucket with what its contexts give and want.

    Each pair gives its context's sums once, from one of the blocks that have it: numbers of pairs with counts
    one to ``DISCOUNTED``, the count, and the first order's share. A text wants the denominator of a context
    whose pairs here leave open whether a count is lost (negative times), and the weight of one with an unseen pair.
    """
    kind = blocks.schema["id"].dataType.simpleString()
    unit = math.log10(mass)
    lost = np.array([0.0, *[r - r * d for r, d in enumerate(factor, 1)]])
    names = ["block", "bucket", "id", "held", "n", "known", "base", "own", "n_keys", "keys", "sums", "n_wants", "want_key", "want_text", "want_n"]
    kinds = [
        pa.int64(), pa.int32(), None, pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()),
        pa.list_(pa.float64()), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary(),
    ]

    def run(state: pa.Table, answers: pa.Table) -> pa.Table:
        row = state.drop_columns(["id"]).to_pylist()[0]
        x, got = _Block(row), answers.sort_by("bucket").to_pydict()
        all_of = lambda k: np.concatenate([_unpacked(d, m) for d, m in zip(got[k], got[f"n_{k}"])])
        c_word, c_pair = all_of("words"), all_of("pairs")
        one, c_pair = (c_pair & 1).astype(bool), c_pair >> 1
        context, word = x.ends_of()
        texts = len(x.n)
        total = lambda of: np.bincount(x.text, of, texts)
        log, seen = np.log10(c_word + 1.0), c_pair > 0
        kept = np.where(seen, c_pair, 1).astype(float)
        for r, d in enumerate(factor, 1):
            kept[c_pair == r] = r * d
        low = seen & (c_pair <= len(factor))
        low[low] = lost[c_pair[low]] >= LEAST_LOST
        settled = np.zeros(len(x.word), bool)
        settled[context[low]] = True
        known = seen[x.pair_at]
        alone = settled[x.before]
        value = np.where(known, np.log10(kept)[x.pair_at], log[x.token] - unit)
        value -= np.where(known & alone, np.log10(np.maximum(c_word, 1))[x.before], 0.0)

        wanted = np.where(known, ~alone, c_word[x.before] > 0)
        asked, times = np.unique((x.before[wanted] * texts + x.text[wanted]) * 2 + known[wanted], return_counts=True)
        times = np.where(asked & 1, -times, times)
        want_at, want_text = np.divmod(asked >> 1, texts)
        mine = one & seen
        of = lambda rows, weight=None: np.bincount(context[rows], weight, len(x.word)).astype(np.int64)
        sums = np.stack([*[of(mine & (c_pair == r)) for r in range(1, DISCOUNTED + 1)], of(mine, c_pair[mine]), of(mine, c_word[word[mine]] + 1)])
        sent = sums[DISCOUNTED] > 0
        sent[want_at] = True
        at = np.flatnonzero(sent)
        key, sums, want_at = x.word[at], sums[:, at], (np.cumsum(sent) - 1)[want_at]
        edge = _edges(key, buckets)
        cutoff = np.searchsorted(want_at, edge)
        block = row["block"]
        texts_row = (
            block, None, None, row["held"], row["n"], total(c_word[x.token] > 0).astype(np.int64).tolist(),
            (total(log[x.token]) - x.n * unit).tolist(), total(value).tolist(), *[None] * 7,
        )
        out = [texts_row]
        for i in range(buckets):
            (a, z), (f, t) = edge[i : i + 2], cutoff[i : i + 2]
            if z > a:
                want = (int(t - f), _packed(want_at[f:t] - a), _packed(want_text[f:t]), _packed(times[f:t]))
                out.append((block, i, *[None] * 6, int(z - a), _packed_keys(key[a:z]), _packed(sums[:, a:z].ravel()), *want))
        columns = [pa.array(c, t) if t else c for c, t in zip(zip(*out), kinds)]
        ids = state["id"].combine_chunks()
        columns[2] = pa.concat_arrays([ids, pa.nulls(len(out) - 1, ids.type)])
        return pa.table(columns, names=names)

    schema = (
        f"block bigint, bucket int, id {kind}, held array<boolean>, n array<bigint>, known array<bigint>, base array<double>, own array<double>, "
        "n_keys bigint, keys binary, sums binary, n_wants bigint, want_key binary, want_text binary, want_n binary"
    )
    return cut(blocks.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(run, schema))


def _wanted(sums: DataFrame, factor: list[float], mass: int) -> DataFrame:
    """What the texts of each block want, summed by text: one row per block and bucket of contexts."""
    lost_of = np.array([r - r * d for r, d in enumerate(factor, 1)])

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        place, one = _summed([_unpacked_keys(d, m) for d, m in zip(rows["keys"], rows["n_keys"])])
        sums = np.concatenate([_unpacked(d, m * (DISCOUNTED + 2)).reshape(-1, m) for d, m in zip(rows["sums"], rows["n_keys"])], axis=1)
        sums = np.stack([np.bincount(place, s, len(one)) for s in sums])
        lost, (c, low) = lost_of @ sums[:DISCOUNTED], sums[DISCOUNTED:]
        # a context without low counts gives up one count, so that unseen pairs keep a probability
        spare = (lost < LEAST_LOST).astype(float)
        weight, whole = np.log10((lost + spare) / (c + spare) / ((mass - low) / mass)), np.log10(c + spare)
        begin, out = 0, []
        for block, m, n, key, text, times in zip(*[rows[k] for k in ("block", "n_keys", "n_wants", "want_key", "want_text", "want_n")]):
            at, text, times = place[begin : begin + m][_unpacked(key, n)], _unpacked(text, n), _unpacked(times, n)
            begin += m
            if n:
                own, of = np.unique(text, return_inverse=True)
                value = np.bincount(of, times * np.where(times > 0, weight[at], whole[at]))
                out.append((block, len(own), _packed(own), _packed(value)))
        kinds = {"block": pa.int64(), "n_texts": pa.int64(), "text": pa.binary(), "value": pa.binary()}
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, kinds.values())], names=list(kinds))

    given = sums.where(F.col("bucket").isNotNull()).select("block", "bucket", "n_keys", "keys", "sums", "n_wants", "want_key", "want_text", "want_n")
    return given.groupBy("bucket").applyInArrow(run, "block bigint, n_texts bigint, text binary, value binary")


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null texts are empty and have only the end. ``base_score`` has the first order alone: a word's
    count plus one by ``n + v + 1``. In ``score`` a pair seen in training has its own probability; any
    other has its context's backoff weight times the first order, and after an unknown context just
    the first order. Words are told apart by 64-bit hashes of their folded bytes, pairs by 64 bits of
    both. Without training documents every word is unknown and counts are zero.
    """
    source = _prepared(docs, doc_id, text)
    blocks = _blocks(source)
    tokens = blocks.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    buckets = max(4 * docs.sparkSession.sparkContext.defaultParallelism, tokens // BUCKET_TOKENS)
    counted = _counted(blocks, buckets)
    n, v, *few = counted.agg(*[F.coalesce(F.sum(F.col("sizes")[i]), F.lit(0)) for i in range(DISCOUNTED + 3)]).first()
    factor, mass = discounts(dict(enumerate(few, 1))), n + v + 1
    sums = _first_sums(blocks, counted, buckets, factor, mass)
    discard(blocks)
    discard(counted)
    kind = source.schema["id"].dataType.simpleString()
    names = ["id", "held", "n", "known", "base", "score"]

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        flat = {k: texts[k].combine_chunks().flatten() for k in ("id", "held", "n", "known", "base", "own")}
        score = flat.pop("own").to_numpy().copy()
        for m, text, value in zip(*[answers[k].to_pylist() for k in ("n_texts", "text", "value")]):
            score[_unpacked(text, m)] += _unpacked(value, m, np.float64)
        return pa.table([*flat.values(), pa.array(score)], names=names)

    texts = sums.where(F.col("bucket").isNull()).select("block", "id", "held", "n", "known", "base", "own")
    found = texts.groupBy("block").cogroup(_wanted(sums, factor, mass).groupBy("block")).applyInArrow(
        run, f"id {kind}, held boolean, n bigint, known bigint, base double, score double"
    )
    return found.select(
        F.col("id").alias(doc_id), F.col("held").alias("held_out"), F.col("n").alias("n_tokens"), F.col("known").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score",
    )
