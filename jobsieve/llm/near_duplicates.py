"""N-gram Jaccard join by banded MinHash, with exact verification.

Texts are sets of five-word shingles. Every distinct text gets ``trees`` signature sequences. Two
texts are candidates if in some tree their sequences share a prefix of one fixed depth: the longest
with which a pair at the threshold is met in some tree with the target recall. It follows from a
formula before any data are read; no sorted tries are built, and candidates meet by equal key.

Texts that meet are grouped, the groups' whole texts brought together in blocks of bounded size,
and all pairs of a group compared exactly. A block sends out one row per text: its links and the
smallest text it is connected to. So no pair is ever a row, and a group of any size is split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut
from .common import free, hashed_words, mix, per_text, text_steps

SHINGLE = 5
#: Jaccard similarity of a link, as a fraction so that the test is exact.
SIMILAR = (4, 5)
TREES = 32
DEPTH = 12
RECALL = 0.99
#: Texts and bytes of one block; a task holds two.
BLOCK_TEXTS = 1024
BLOCK_BYTES = 8 << 20
_CELLS = 4 << 20


def prefix_depth(similar: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix that finds a pair at the threshold in some tree with the target recall."""
    for k in range(depth, 0, -1):
        if 1 - (1 - similar**k) ** trees >= recall:
            return k
    raise ValueError("more trees are needed for this recall")


def shingles(data: np.ndarray, ends: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' word n-grams, and where each text's begin.

    A text of fewer words than ``n`` has one shingle of all its words; a text without words has none.
    """
    word, start, _ = hashed_words(data, ends)
    at = per_text(start, ends)
    size = np.diff(at)
    count = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    begin = np.concatenate(([0], np.cumsum(count)))
    first = np.repeat(at[:-1] - begin[:-1], count) + np.arange(begin[-1])
    last = np.repeat(at[1:], count)
    out = np.full(len(first), len(first) and 0x51, np.uint64)
    for k in range(n):
        here = first + k
        inside = here < last
        out = np.where(inside, mix(out * np.uint64(0x9E3779B97F4A7C15) + word[np.where(inside, here, 0)]), out)
    return out, begin


def _multipliers(trees: int, depth: int) -> np.ndarray:
    return np.random.default_rng(8).integers(0, 1 << 31, (trees, depth), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def tree_keys(grams: np.ndarray, begin: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """One key per text and tree: a hash of the tree's number and its first ``depth`` minima."""
    full = np.flatnonzero(np.diff(begin) > 0)
    keys = np.zeros((len(begin) - 1, trees), np.uint64)
    if not len(full):
        return keys
    small = (grams >> np.uint64(32)).astype(np.uint32)
    at = begin[:-1][full]
    for t, row in enumerate(_multipliers(trees, DEPTH)[:, :depth]):
        key = np.full(len(full), t + 1, np.uint64)
        for a in row:
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(small * a, at))
        keys[full, t] = key
    return keys


def _sign(trees: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, ends in text_steps(b.column(2), 1 << 18):
                grams, begin = shingles(data, ends)
                keys = tree_keys(grams, begin, trees, depth).view(np.int64)
                some = np.diff(begin) > 0
                rows = pa.ListArray.from_arrays(
                    pa.array(np.concatenate(([0], np.cumsum(some * trees))).astype(np.int32)), pa.array(keys[some].ravel())
                )
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), rows], names=["__id", "__node", "__keys"]
                )

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of the given (node, root) links: root is the component's smallest node.

    Each round hooks every node onto its smallest neighbour and contracts the links, so that only
    links between different groups remain; the rounds follow the logarithm of a component's width.
    Null when there are no links.
    """
    edges = cut(edges.where("node <> root").select("node", "root").distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
        low = both.groupBy("node").agg(F.min("root").alias("m"))
        hook = cut(low.select("node", F.least("node", "m").alias("root")))
        # every node points to one that is no larger; two steps at a time shorten the chains
        up = hook.select(F.col("node").alias("root"), F.col("root").alias("top"))
        hook = cut(hook.join(up, "root").select("node", F.col("top").alias("root")))
        up = hook.select(F.col("node").alias("root"), F.col("root").alias("top"))
        labels = (
            hook
            if labels is None
            else cut(labels.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
        )
        a = hook.select("node", F.col("root").alias("a"))
        b = hook.select(F.col("node").alias("root"), F.col("root").alias("b"))
        moved = edges.join(a, "node").join(b, "root").where("a <> b")
        edges = cut(moved.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct())
    return labels


def _common(a: list[np.ndarray], b: list[np.ndarray] | None) -> np.ndarray:
    """How many shingles each text of ``a`` shares with each of ``b`` (of ``a`` itself without ``b``)."""
    texts = a if b is None else a + b
    values, column = np.unique(np.concatenate(texts), return_inverse=True)
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    shared = np.bincount(column, minlength=len(values)) > 1
    keep = shared[column]
    column, owner = (np.cumsum(shared) - 1)[column[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    n, m = len(a), len(a) if b is None else len(b)
    total, width = np.zeros((n, m), np.float32), max(64, _CELLS // len(texts))
    for lo in range(0, int(shared.sum()), width):
        i, j = np.searchsorted(column, (lo, lo + width))
        bits = np.zeros((len(texts), min(width, int(shared.sum()) - lo)), np.float32)
        bits[owner[i:j], column[i:j] - lo] = 1
        total += bits[:n] @ (bits[:n] if b is None else bits[n:]).T
    return total.astype(np.int64)


def _linked(a: list[np.ndarray], b: list[np.ndarray] | None, similar: tuple[int, int]) -> np.ndarray:
    both = _common(a, b)
    size_a = np.array([len(x) for x in a])
    size_b = size_a if b is None else np.array([len(x) for x in b])
    link = both * similar[1] >= similar[0] * (size_a[:, None] + size_b[None, :] - both)
    if b is None:
        np.fill_diagonal(link, False)
    return link


def _roots(link: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id that each row of a symmetric link matrix is connected to."""
    low = ids.copy()
    while True:
        new = np.minimum(low, np.where(link, low[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max))
        if (new == low).all():
            return low
        low = new


def _verify(similar: tuple[int, int]):
    def group(one_block: bool, ids: list[int], sides: list[int], texts: list[str]) -> pd.DataFrame:
        data = [t.encode() for t in texts]
        grams, begin = shingles(
            np.frombuffer(b"".join(data), np.uint8), np.cumsum([len(x) for x in data], dtype=np.int64)
        )
        sets = [np.unique(grams[i:j]) for i, j in zip(begin[:-1], begin[1:], strict=True)]
        side, node = np.array(sides), np.array(ids, np.int64)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        pick = lambda at: [sets[i] for i in at]
        if one_block:
            link = _linked(sets, None, similar)
        else:  # of two blocks one may be empty; the other's own links are counted where it stands alone
            link = np.zeros((len(sets), len(sets)), bool)
            if len(left) and len(right):
                across = _linked(pick(left), pick(right), similar)
                link[np.ix_(left, right)] = across
                link[np.ix_(right, left)] = across.T
        return pd.DataFrame({"node": node, "root": _roots(link, node), "n_links": link.sum(axis=1).astype(np.int64)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, ids, sides, texts, out, made = None, [], [], [], [], 0
        for b in batches:
            for c, i, j, node, side, text in zip(b["comp"], b["i"], b["j"], b["node"], b["side"], b["text"], strict=True):
                if (c, i, j) != key:
                    if len(ids) > 1:
                        out.append(group(key[1] == key[2], ids, sides, texts))
                        made += len(ids)
                    key, ids, sides, texts = (c, i, j), [], [], []
                ids.append(node)
                sides.append(side)
                texts.append(text)
                if made > 5000:
                    yield pd.concat(out)
                    out, made = [], 0
        if len(ids) > 1:
            out.append(group(key[1] == key[2], ids, sides, texts))
        if out:
            yield pd.concat(out)

    return run


def similar_texts(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similar: tuple[int, int] = SIMILAR, trees: int = TREES,
    recall: float = RECALL, block_texts: int = BLOCK_TEXTS, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, n_links, n_copies.

    Classes are the connected groups of equal texts and of links; ``class_id`` is the class's
    smallest doc_id. ``n_links`` counts the other distinct texts with at least the given Jaccard
    similarity, ``n_copies`` the rows with this very text. Texts are told apart by 64-bit hashes.
    Null counts as empty; texts without words have no shingles and so no links, but equal ones
    share a class. Rows with a null doc_id take part; a class of only such rows has a null id.
    """
    signed, named = _classed(docs, doc_id, text, similar, trees, recall, block_texts, block_bytes)
    smallest = named.groupBy("root").agg(F.min("id").alias("class_id"))
    final = named.join(smallest, "root").select(
        "__node", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies"
    )
    rows = signed.select("__id", "__node").join(final, "__node", "left")
    return rows.select(F.col("__id").alias(doc_id), "class_id", "n_links", "n_copies")


def node_of(text: str) -> Column:
    """The 64-bit hash that stands for a text."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def text_classes(docs: DataFrame, text: str = "text") -> DataFrame:
    """(node, root) of the distinct texts, by hash, that belong to another text's class; root is the class's smallest hash."""
    _, named = _classed(docs.select(F.lit(None).cast("long").alias("id"), F.col(text).alias("text")), "id", "text")
    return named.where("root <> __node").select(F.col("__node").alias("node"), "root")


def _classed(
    docs: DataFrame, doc_id: str, text: str, similar: tuple[int, int] = SIMILAR, trees: int = TREES, recall: float = RECALL,
    block_texts: int = BLOCK_TEXTS, block_bytes: int = BLOCK_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """(all rows with id and text hash; the distinct texts with smallest id, copies, links and class root)."""
    depth = prefix_depth(similar[0] / similar[1], trees, DEPTH, recall)
    t = F.coalesce(F.col(text), F.lit(""))
    source = docs.select(F.col(doc_id).alias("__id"), node_of(text).alias("__node"), t.alias("__text"))
    id_type = source.schema["__id"].dataType.simpleString()
    signed = cut(source.mapInArrow(_sign(trees, depth), f"__id {id_type}, __node bigint, __keys array<bigint>"))

    # equal keys: whoever shares a prefix with a smaller text is linked to the smallest of them
    leaves = signed.select("__node", F.explode("__keys").alias("key"))
    meet = leaves.groupBy("key").agg(F.min("__node").alias("low"), F.max("__node").alias("high")).where("low < high")
    edges = leaves.join(meet, "key").select(F.col("__node").alias("node"), F.col("low").alias("root"))
    groups = components(edges)

    nodes = signed.groupBy("__node").agg(F.min("__id").alias("id"), F.count(F.lit(1)).alias("n_copies"))
    if groups is None:
        return signed, cut(nodes.withColumns({"n_links": F.lit(0).cast("long"), "root": F.col("__node")}))

    # whole texts of the grouped nodes, each node once
    once = source.groupBy("__node").agg(F.first("__text").alias("text"))
    member = cut(once.join(groups.select(F.col("node").alias("__node"), F.col("root").alias("comp")), "__node"))
    sizes = member.groupBy("comp").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    blocks = F.ceil(F.greatest(F.col("n") / F.lit(block_texts), F.col("bytes") / F.lit(block_bytes))).cast("int")
    split = sizes.select("comp", blocks.alias("blocks")).where("blocks > 1")
    own = F.pmod(F.xxhash64(F.lit(1), "__node"), F.coalesce("blocks", F.lit(1))).cast("int")
    placed = member.join(split, "comp", "left").select(
        "comp", F.col("__node").alias("node"), "text", own.alias("own"),
        F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("other"),
    ).select(
        "comp", "node", "text", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    verified = cut(
        placed.repartition(parts, "comp", "i", "j")
        .sortWithinPartitions("comp", "i", "j", "node")
        .mapInPandas(_verify(similar), "node bigint, root bigint, n_links bigint")
    )
    links = verified.groupBy(F.col("node").alias("__node")).agg(F.sum("n_links").alias("n_links"))
    classes = components(verified.select("node", "root"))
    named = nodes.join(links, "__node", "left")
    if classes is None:
        named = named.withColumn("root", F.col("__node"))
    else:
        named = named.join(classes.select(F.col("node").alias("__node"), "root"), "__node", "left")
        named = named.withColumn("root", F.coalesce("root", "__node"))
    return signed, cut(named)


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class: of the smallest doc_id, and of rows that share it of the smallest text hash.

    A class of only null ids keeps one of them. Rows of one text and doc_id are the same to it.
    """
    _, named = _classed(docs, doc_id, text)
    q = free(docs)
    order = F.struct(F.col("id").isNull(), "id", "__node")
    first = named.groupBy("root").agg(F.min(order).alias("first")).select(
        F.col("first.id").alias(f"{q}id"), F.col("first.__node").alias(f"{q}first")
    )
    keyed = docs.withColumn(f"{q}node", node_of(text))
    same = (F.col(f"{q}node") == F.col(f"{q}first")) & F.col(doc_id).eqNullSafe(F.col(f"{q}id"))
    return keyed.join(first, same, "left_semi").dropDuplicates([f"{q}node"]).drop(f"{q}node")
