"""Vector codes, nearest neighbours and conversation repair against brute force and awkward tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobsieve.llm import repair, vantage, vector_codes

NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id bigint, embedding array<float>, label int, __vec string, code string, cell string, id string"


def vectors(spark, rows):
    """Rows (vec_id, vector, label) with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, v, g, "x", "x", "x", "x") for i, v, g in rows], VECTORS).repartition(3)


def points(n, dim, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, dim)) * spread).astype(np.float32).tolist()


UNUSABLE = [(7001, None, 1), (7002, [], 1), (7003, [1.0, None, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0], 1), (7004, [NAN] * 8, 1), (7005, [INF] * 8, 2)]


# ---- vector codes


def lloyd(rows, parts, entries, rounds, scale=1024):
    """Every round compares every part with every entry."""
    rows = sorted((r for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    v = np.floor(np.array([r[1] for r in rows], np.float64) * scale).astype(np.int64)
    seeds = [i for i, r in enumerate(rows) if r[0] is not None][:entries]
    width = v.shape[1] // parts
    cols = [v[:, p * width : (p + 1) * width] for p in range(parts)]
    books = [c[seeds].copy() for c in cols]

    def assign():
        far = [((c[:, None] - b[None]) ** 2).sum(2) for c, b in zip(cols, books)]
        return np.stack([f.argmin(1) for f in far], 1), np.stack([f.min(1) for f in far], 1)

    for _ in range(rounds):
        code, _ = assign()
        for p, c in enumerate(cols):
            for e in np.unique(code[:, p]):
                mine = c[code[:, p] == e]
                books[p][e] = mine.sum(0) // len(mine)
    code, far = assign()
    return {(r[0], tuple(r[1]), tuple(c.tolist()), int(f)) for r, c, f in zip(rows, code, far.sum(1))}, books


@pytest.mark.parametrize("scale", [1024, 1 << 20])
def test_codes_equal_full_rescans(spark, scale):
    own = points(300, 8, 1, 0.2)
    own[40:60] = [own[3]] * 20  # copies, and ties between entries that are equal
    rows = [(i, v, i % 3 or None) for i, v in enumerate(own)] + [(None, own[9], 1), (12, own[12], 1), (12, own[12], 1)]
    rows += [(500 + i, [round(x * 4) / 4 for x in v], 9) for i, v in enumerate(points(80, 8, 2))]
    want, books = lloyd([(i, v) for i, v, _ in rows], 4, 16, 4, scale)
    df = vectors(spark, rows + UNUSABLE)
    got, found = vector_codes.compress(df, "vec_id", "embedding", ["embedding", "label"], entries=16, scale=scale)
    got = got.collect()
    assert {(r.vec_id, tuple(r.embedding), tuple(r.code), r.error) for r in got} == want
    assert len(got) == len(rows)
    assert all((a == b).all() for a, b in zip(books, found))
    text = ",".join(str(int(x)) for b in books for e in b for x in e)
    assert vector_codes.fingerprint(found) == hashlib.sha256(text.encode()).hexdigest()


def test_kept_distance_needs_only_the_moved_entries():
    rng = np.random.default_rng(5)
    for _ in range(200):
        x, book = rng.integers(-3, 4, (30, 2)), rng.integers(-3, 4, (6, 2))
        code, far = vector_codes.nearest(x, book)
        moved = rng.random(6) < rng.random()
        later = np.where(moved[:, None], rng.integers(-3, 4, (6, 2)), book)
        again = vector_codes.assigned(x, code, far, later, moved)
        full = vector_codes.nearest(x, later)
        assert (again[0] == full[0]).all() and (again[1] == full[1]).all()
        slow = ((x[:, None] - later[None]) ** 2).sum(2)
        assert (full[0] == slow.argmin(1)).all() and (full[1] == slow.min(1)).all()


def test_large_components_stay_exact():
    x = np.array([[1 << 27, 5], [-(1 << 27), 4]], np.int64)
    at, far = vector_codes.nearest(x, np.array([[0, 0], [1 << 27, 4]], np.int64))
    assert at.tolist() == [1, 0] and far.tolist() == [1, (1 << 54) + 16]


def test_codes_of_awkward_tables(spark):
    none, books = vector_codes.compress(vectors(spark, []), "vec_id", "embedding", ["label"])
    assert none.collect() == [] and none.columns == ["vec_id", "label", "code", "error"]
    assert vector_codes.fingerprint(books) == hashlib.sha256(b"").hexdigest()
    assert vector_codes.compress(vectors(spark, UNUSABLE), "vec_id", "embedding")[0].collect() == []
    rows = [(2, [1.0] * 8, None), (1, [0.5] * 8, None), (3, [1.0] * 4, 4), (4, [1e30] * 8, 4), (5, [1.0] * 8, 4)]
    got, _ = vector_codes.compress(vectors(spark, rows), "vec_id", "embedding", ["label"])
    got = {r.vec_id: r for r in vector_codes.with_group_error(got, "label").collect()}
    assert {i: r.code for i, r in got.items()} == {1: [0] * 4, 2: [1] * 4, 5: [1] * 4, 3: None, 4: None}
    assert {i: (r.error, r.label_error) for i, r in got.items()} == {1: (0, 0), 2: (0, 0), 5: (0, 0), 3: (None, 0), 4: (None, 0)}


# ---- nearest neighbours


def brute(rows, every, k):
    rows = {(i, tuple(v)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = []
    for i, v in rows:
        if i is None or i % every:
            continue
        near = []
        for j, w in rows:
            if j == i or len(w) != len(v):
                continue
            total = 0.0
            for a, b in zip(v, w):
                total += (a - b) * (a - b)
            near.append((total**0.5, j is None, j or 0))
        out += [(i, r + 1, None if n else j, s) for r, (s, n, j) in enumerate(sorted(near)[:k])]
    return sorted(out, key=str)


def answers(df, **more):
    out = vantage.search(df, "vec_id", "embedding", **more)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize("shard_rows", [20, 100_000])
def test_factor_one_is_exact(spark, shard_rows):
    own = points(260, 8, 3)
    own[50:140] = [own[50]] * 90  # a third of all rows are copies
    own[200:230] = [[round(x) + 0.5 for x in v] for v in own[200:230]]  # many equal distances
    rows = [(i - 100, v, 0) for i, v in enumerate(own)] + [(None, own[4], 0), (None, [2.0] * 8, 0), (20, own[120], 0), (30, [0.0] * 8, 0)]
    rows += [(10, own[110], 0), (1000, [1.0, 2.0], 0), (1010, [1.0, 4.0], 0), (1001, [3.0], 0)] + UNUSABLE
    got = answers(vectors(spark, rows), every=10, k=7, shard_rows=shard_rows, block_queries=6, leaf_rows=5)
    assert got == brute([(i, v) for i, v, _ in rows], 10, 7)


def test_relaxed_pruning_visits_less_and_finds_most():
    own = np.array(points(4000, 8, 4))
    ids = np.arange(len(own))
    asked = np.arange(0, 4000, 40)
    tree = vantage.Tree(own, ids, 32)
    found, visited = {}, {}
    for factor in (1.0, 1.5, 2.0):
        tree.visited = 0
        q, row, _ = tree.search(own[asked], ids[asked], np.full(len(asked), np.inf), 10, factor)
        found[factor], visited[factor] = set(zip(q.tolist(), row.tolist())), tree.visited
    assert len(found[1.0]) == 10 * len(asked)
    assert visited[2.0] < visited[1.5] < visited[1.0] < len(asked) * len(own)
    assert len(found[1.5] & found[1.0]) >= 0.98 * len(found[1.0])
    assert len(found[2.0] & found[1.0]) >= 0.9 * len(found[1.0])


def test_neighbours_of_awkward_tables(spark):
    assert answers(vectors(spark, []), every=10) == []
    assert answers(vectors(spark, UNUSABLE), every=1) == []
    assert answers(vectors(spark, [(0, [1.0, 0.0], 1)]), every=10) == []
    assert answers(vectors(spark, [(0, [1.0, 0.0], 1), (3, [1.0, 3.0], 1)]), every=10) == [(0, 1, 3, 3.0)]


# ---- conversation repair

BLANK = re.compile(r"[\x20\x09-\x0D]*")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        out.append("b" if BLANK.fullmatch(text) else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """All edits up to the cost of deleting everything."""
    kind, found = faults(rows), []

    def go(i, cost, audit, roles, items, put):
        if cost > 3 * len(rows) or not re.fullmatch("(s?(ua)*u?)?", roles):
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            found.append((cost, audit, "\n".join(items)))
        for new in ("user", "assistant") if put < 3 else ():
            go(i, cost + 2, audit + "I", roles + new[0], [*items, f"{new}:"], put + 1)
        if i == len(rows):
            return
        role, text = rows[i]
        more = kind[i] == "t"
        go(i + 1, cost + 3, audit + "D", roles, items, 0)
        if kind[i] in ("", "t"):
            if role[:1]:
                go(i + 1, cost + more, audit + "K", roles + role[:1], [*items, f"{role}:{text}"], 0)
            for new in ("user", "assistant"):
                go(i + 1, cost + 2 + more, audit + "R", roles + new[0], [*items, f"{new}:{text}"], 0)

    go(0, 0, "", "", [], 0)
    cost, audit, text = min(found)
    return cost, audit, hashlib.sha256(text.encode()).hexdigest()


def hurt(conv, turn, role, text):
    kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    role, text = " " if role is None else role, " " if text is None else text
    if kind == 0:
        return []
    text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
    return [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        left = sorted((x for r in rows if r[0] == conv for x in hurt(*r)), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        turns = {t for t, _, _ in left if t is not None}
        body = [(role, text) for _, role, text in left]
        kind = faults(body)
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(body, body[1:])]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, kind.count("b"), kind.count("d"), kind.count("t"),
            sum(p not in ("su", "ua", "au") for p in pairs), *cheapest(body),
        )
    return out


def talks(spark, rows):
    schema = "conv_id bigint, turn int, role string, text string, conv string, lost boolean, `__copy` int"
    return spark.createDataFrame([(*r, "x", True, 5) for r in rows], schema).repartition(3)


def repaired(spark, rows, **more):
    left = repair.damaged(talks(spark, rows), "conv_id", "turn", "role", "text")
    got = repair.repair(left, "conv", "turn", "role", "text", F.col("lost"), **more).collect()
    assert len(got) == len({r.conv for r in got})
    return {r.conv: tuple(r)[1:] for r in got}


@pytest.mark.parametrize("kept", [2, 1 << 20])
def test_repairs_are_the_cheapest(spark, kept):
    rng = random.Random(7)
    rows = []
    for conv in [None, *range(250)]:
        for turn in range(rng.randrange(1, 5)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            text = rng.choice(["Yes.", "No", "Why?", "", None, " \t\n", "Done! ", "ü", "a\nb."])
            rows.append((conv, rng.choice([turn, turn, turn + 3, None]), role, text))
    rows += rows[:3]
    assert repaired(spark, rows, kept_steps=kept) == expected(rows)


def test_damage_of_every_kind(spark):
    rows = [(1, t, "assistant", f"Turn {t}. Well!") for t in range(200)]
    got = repair.damaged(talks(spark, rows), "conv_id", "turn", "role", "text")
    assert got.columns == ["conv", "turn", "role", "text", "lost"]
    there = sorted((r.turn, r.role, r.text) for r in got.collect() if not r.lost)
    assert there == sorted(x for r in rows for x in hurt(*r))


def test_conversations_without_rows_and_empty_tables(spark):
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    assert repaired(spark, [(5, gone, "user", "Hi.")]) == {5: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert repaired(spark, []) == {}


def test_one_long_conversation_is_streamed(spark):
    """Many batches, the steps and digests in files: the same as a program that holds everything."""
    rng = random.Random(3)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["Same.", f"No {t}.", f"Half {t}"])) for t in range(6000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        got = repaired(spark, rows, kept_steps=500)[1]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    left = sorted((x for r in rows for x in hurt(*r)), key=lambda x: x)
    kind = faults([(role, text) for _, role, text in left])
    keep = {"E": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    put = {"E": "u", "s": "u", "u": "a", "a": "u"}
    after = {"E": (0, ""), "s": (4, "II"), "u": (2, "I"), "a": (0, "")}
    back = []
    for (_, role, _), fault in zip(reversed(left), reversed(kind)):  # costs to the end, from the last row back
        now, why = {}, {}
        for state in "Esua":
            ways, at = [], state
            for n in range(3):
                ways.append((3 + 2 * n + after[at][0], "I" * n + "D", at))
                if fault in ("", "t"):
                    ways.append((2 + (fault == "t") + 2 * n + after[put[at]][0], "I" * n + "R", put[at]))
                    if role[0] in keep[at]:
                        ways.append(((fault == "t") + 2 * n + after[keep[at][role[0]]][0], "I" * n + "K", keep[at][role[0]]))
                at = put[at]
            now[state] = min(ways)
        back.append(now)
        after = {s: (w[0], "") for s, w in now.items()}
    state, audit = "E", []
    for now in reversed(back):
        audit.append(now[state][1])
        state = now[state][2]
    assert got[5] == after["E"][0]
    assert got[1:4] == (kind.count("b"), kind.count("d"), kind.count("t"))
    assert got[6].startswith("".join(audit)) and set(got[6][len("".join(audit)) :]) <= {"I"}
