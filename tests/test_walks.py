"""Set-based operators against plain sequential walks on random input."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from jobsieve.operators import dedupe, diff, layout, lineage, merge, outreach, search
from jobsieve.plans import scan, skew
from jobsieve.plans.rounds import resolve_pointers


@pytest.mark.parametrize("hot_rows", [0, 80, 1000])
def test_running_matches_a_walk(spark, hot_rows):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "x", None]), i, rng.randint(0, 5), rng.choice([None, i])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i int, v int, p int").withColumn("b", F.floor(F.col("i") / 16))
    got = {r["i"]: r for r in scan.running(df, ["k"], ["b"], ["i"], sums={"s": F.col("v")}, previous={"l": F.col("p")}, position="n", hot_rows=hot_rows).collect()}
    total, last, count = {}, {}, {}
    for k, i, v, p in rows:
        total[k], count[k] = total.get(k, 0) + v, count.get(k, 0) + 1
        assert (got[i]["s"], got[i]["l"], got[i]["n"]) == (total[k], last.get(k), count[k])
        if p is not None:
            last[k] = p


def test_salted_join_keeps_every_row(spark):
    left = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 3 != 0, 7).otherwise(F.when(F.col("id") % 2 == 0, F.col("id").cast("int"))).alias("k"))
    right = spark.createDataFrame([(7, "hot"), (6, "six")], "k int, name string")
    got = skew.salted_join(left, right, ["k"], ["id"], "left", hot_rows=50)
    plain = left.join(right, "k", "left")
    assert sorted(map(tuple, got.select("id", "k", "name").collect())) == sorted(map(tuple, plain.select("id", "k", "name").collect()))


def test_pointers_reach_their_roots_and_cycles_do_not(spark):
    rows = [(i, i - 1 if i else None, 1) for i in range(70)] + [(100, 101, 1), (101, 100, 1)] + [(200 + i, 69, 1) for i in range(20)]
    df = spark.createDataFrame(rows, "node int, ptr int, w int")
    got = {r["node"]: (r["root"], r["w"]) for r in resolve_pointers(df, ["w"], skewed=True).collect()}
    assert got[69] == (0, 70) and got[219] == (0, 71) and 100 not in got and len(got) == 90


def _greedy(rows):
    kept, seen = [], {}
    for n, (i, link, desc) in enumerate(rows):
        keys = [("i", i)] + ([("u", link)] if link else [])
        at = next((seen[k] for k in keys if k in seen), None)
        if at is None:
            kept.append([n, desc])
            at = len(kept) - 1
        elif not kept[at][1] and desc:
            kept[at][1] = desc
        for k in keys:
            seen.setdefault(k, at)
    return {n: d for n, d in kept}


def test_dedupe_is_the_greedy_walk(spark):
    rng = random.Random(5)
    for trial in range(4):
        rows = [(f"id{rng.randint(0, 25)}", rng.choice([None] + [f"https://x.io/{j}" for j in range(20)]), rng.choice([None, "", f"d{n}"])) for n in range(60)]
        df = spark.createDataFrame(
            [(n // 20, n, i, u, d, "t", "c", "s") for n, (i, u, d) in enumerate(rows)],
            "adapter_rank int, pos int, external_id string, url string, description string, title string, company string, source string",
        )
        got = {r["pos"]: r["description"] for r in dedupe.dedupe_listings(df).collect()}
        assert got == {n: d or None for n, d in _greedy(rows).items()}, trial


def _schedule_walk(rows):
    cursor, sent, out = min(r[2] for r in rows), None, []
    for r in rows:
        cursor = (sent or cursor) + timedelta(days=r[3])
        sent = r[4]
        out.append(cursor)
    return out


@pytest.mark.parametrize("hot_rows", [0, 10**6])
def test_schedule_is_the_walk(spark, hot_rows):
    spark.conf.set("spark.jobsieve.hotRows", str(hot_rows))
    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    rows, want = [], {}
    for seq in range(25):
        group = [
            (seq, None if seq % 3 else 1, start + timedelta(days=rng.randint(0, 9)), rng.randint(0, 6),
             rng.choice([None, start + timedelta(days=rng.randint(0, 40))]), step)
            for step in range(1, rng.randint(2, 12))
        ]
        for r, due in zip(group, _schedule_walk(group)):
            want[(seq, r[5])] = due
        rows += group
    df = spark.createDataFrame(
        rows, "application_id int, contact_id int, created_at timestamp, day_offset int, sent_at timestamp, sequence_step int"
    ).withColumn("status", F.lit("scheduled")).withColumn("b", F.floor(F.col("sequence_step") / 3))
    got = {(r["application_id"], r["sequence_step"]): r["due_at"] for r in outreach.schedule(df, ["sequence_step"], ["b"]).collect()}
    spark.conf.unset("spark.jobsieve.hotRows")
    assert got == want


def _list_walk(was, now):
    if was == now:
        return []
    if sorted(was) == sorted(now):
        return [("reorder", "p")]
    taken, match = set(), []
    for v in now:
        at = next((i for i, w in enumerate(was) if i not in taken and w == v), None)
        match.append(at)
        if at is not None:
            taken.add(at)
    free = [i for i in range(len(was)) if i not in taken]
    out, slot = [], 0
    for i, m in enumerate(match):
        if m is None:
            out.append(("edit" if slot < len(free) else "add", f"p[{i}]"))
            slot += 1
    out += [("remove", f"p[{i}]") for i in free[slot:]]
    kept = [m for m in match if m is not None]
    return out + ([("reorder", "p")] if any(b < a for a, b in zip(kept, kept[1:])) else [])


def test_list_diff_is_the_walk(spark):
    rng = random.Random(9)
    pairs = [([rng.choice("abcd") for _ in range(rng.randint(0, 6))], [rng.choice("abcd") for _ in range(rng.randint(0, 6))]) for _ in range(150)]
    df = spark.createDataFrame([(i, "p", a, b) for i, (a, b) in enumerate(pairs)], "k int, path string, was array<string>, now array<string>")
    got = {}
    for r in diff.list_diff(df, ["k"]).orderBy("k", "seq").collect():
        got.setdefault(r["k"], []).append((r["kind"], r["path"]))
    for i, (a, b) in enumerate(pairs):
        assert got.get(i, []) == _list_walk(a, b), (a, b)


def test_entry_chunks_are_the_walk(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for doc in range(30):
        chunk, item, date, empty = 0, False, False, True
        for n in range(rng.randint(1, 20)):
            li, dated = rng.random() < 0.4, rng.random() < 0.4
            text = "Mar 2019 – Present" if dated else "words"
            is_date = dated and not li
            if not li and (empty or item or (is_date and date)):
                chunk, item, date = chunk + 1, False, False
            item, date, empty = item or li, date or is_date, False
            rows.append((doc, n, text, li))
            want[(doc, n)] = chunk
    df = spark.createDataFrame(rows, "doc_id int, line_no int, text string, is_list_item boolean")
    got = {(r["doc_id"], r["line_no"]): r["chunk"] for r in layout.entry_chunks(df, ["doc_id"]).collect()}
    assert got == want


def _merge_walk(stored, incoming):
    jobs = {k: [t, loc, body] for k, t, loc, body in stored}
    for k, t, loc, desc in incoming:
        body = desc.strip() if desc and desc.strip() else f"No description was returned by s for this listing. Open {k} for the full posting."
        if k not in jobs:
            jobs[k] = [t, loc, body]
            continue
        job = jobs[k]
        job[1] = loc if loc is not None else job[1]
        old, blank = job[2], "No description was returned by"
        if body.startswith(blank):
            job[2] = old if old.strip() else body
        elif not old.strip() or old.startswith(blank) or len(body) > len(old):
            job[2] = body
    return {k: tuple(v) for k, v in jobs.items()}


def test_merge_equals_one_by_one(spark):
    rng = random.Random(2)
    url = lambda i: f"https://x.io/{i}"
    stored = [(url(i), f"S{i}", rng.choice([None, "Oslo"]), rng.choice(["", "stored body", "No description was returned by s."])) for i in range(8)]
    incoming = [(url(rng.randint(4, 14)), f"T{n}", rng.choice([None, f"L{n}"]), rng.choice([None, " ", "b" * rng.randint(1, 20)])) for n in range(60)]
    s = spark.createDataFrame([(i, *r, "manual") for i, r in enumerate(stored)], "job_id int, url string, title string, location string, jd_text string, source string").withColumns(
        {"company": F.lit("c"), "scraped_at": F.current_timestamp()}
    )
    l = spark.createDataFrame([(n, *r) for n, r in enumerate(incoming)], "pos int, url string, title string, location string, description string").withColumns(
        {"company": F.lit("c"), "source": F.lit("s")}
    )
    got = {r["url"]: (r["title"], r["location"], r["jd_text"]) for r in merge.merge_jobs(s, l, ["pos"], F.current_timestamp()).collect()}
    assert got == _merge_walk(stored, incoming)


def test_version_tree_is_preorder(spark):
    rng = random.Random(4)
    rows = []
    for r in range(4):
        for v in range(30):
            parent = None if v == 0 else (999 if v == 5 else rng.randint(0, v - 1))
            rows.append((r, r * 100 + v, None if parent is None else (parent if parent == 999 else r * 100 + parent), datetime(2024, 1, 1 + rng.randint(0, 3))))
    rows += [(9, 901, 902, datetime(2024, 1, 1)), (9, 902, 901, datetime(2024, 1, 1))]
    want = {}
    for r in range(4):
        mine = sorted([x for x in rows if x[0] == r], key=lambda x: (x[3], x[1]))
        known = {x[1] for x in mine}
        order = []

        def walk(v, depth):
            order.append((v, depth))
            for x in mine:
                if x[2] == v:
                    walk(x[1], depth + 1)

        for x in mine:
            if x[2] not in known:
                walk(x[1], 0)
        want.update({v: (i, d) for i, (v, d) in enumerate(order)})
    df = spark.createDataFrame(rows, "resume_id int, version_id int, parent_id int, created_at timestamp").withColumn("day", F.to_date("created_at"))
    got = {r["version_id"]: (r["position"], r["depth"]) for r in lineage.version_tree(df, ["day"]).collect()}
    assert got == want


def test_search_finds_every_substring(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 5)))
    texts = [" ".join(word() for _ in range(6)) for _ in range(40)]
    needles = [t[i : i + rng.randint(1, 7)] for t in texts[:20] for i in (rng.randint(0, 3),)] + ["", "zz", "a"]
    needles += [t[i : i + rng.randint(6, 24)] for t in texts for i in (rng.randint(0, 3),)]  # with whole words inside
    rows = [(f"l{i}", t, "c", None if i % 4 else t[:5], t[::-1], i % 2 == 0, "s") for i, t in enumerate(texts)]
    rows += [rows[0], (None, *rows[1][1:]), (None, *rows[1][1:]), ("l2", *rows[3][1:])]
    listings = spark.createDataFrame(rows, "external_id string, title string, company string, location string, description string, remote boolean, source string")
    asked = [(i, n, None, i % 3 == 0) for i, n in enumerate(needles)] + [(100, " ", texts[4][1:4], False), (101, None, texts[8][:2], True), (102, "a", texts[0][:3], None)]
    queries = spark.createDataFrame(asked, "query_id int, keywords string, location string, remote_only boolean")
    squash = lambda t: (t or "").strip().lower()
    want = sorted(
        (q, x or "", t) for q, n, place, far in asked for x, t, _, at, d, remote, _ in rows
        if squash(n) in f"{t} c {d}".lower() and squash(place) in (at or "").lower() and (not far or remote)
    )
    for limit in (100_000, 1):  # searches copied to the listings, candidates shuffled
        for hot in ("500000", "5"):
            spark.conf.set("spark.jobsieve.hotRows", hot)
            got = search.saved_search_hits(queries, listings, max_searches=limit).collect()
            assert sorted((r["query_id"], r["external_id"] or "", r["title"]) for r in got) == want
    spark.conf.unset("spark.jobsieve.hotRows")
    none = search.saved_search_hits(queries.limit(0), listings)
    assert none.count() == 0 and none.columns == ["query_id", *listings.columns]


def test_global_position_is_a_sort(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([None, rng.randint(0, 5)])) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, v int").repartition(7)
    got = {r["i"]: r["n"] for r in scan.global_position(df, [F.col("v").desc_nulls_last(), "i"], "n").collect()}
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == {r[0]: n + 1 for n, r in enumerate(want)}


def test_pointer_rounds_write_only_open_nodes(spark, monkeypatch):
    from jobsieve.plans import rounds

    written = []
    real = rounds.cut
    monkeypatch.setattr(rounds, "cut", lambda df: written.append(t := real(df)) or t)
    n = 300
    chain = [(i, i - 1 if i % n else None, 1) for i in range(n)] + [(1000, 1001, 1), (1001, 1000, 1), (2000, None, 5)]
    nodes = spark.createDataFrame(chain, "node long, ptr long, w long")
    for skewed in (False, True):
        written.clear()
        got = {r.node: (r.root, r.w) for r in rounds.resolve_pointers(nodes, ["w"], skewed).collect()}
        assert got == {**{i: (0, i + 1) for i in range(n)}, 2000: (2000, 5)}
        sizes = [t.count() for t in written]
        # what round r writes is what the rounds before it left open, the two nodes of the cycle included
        assert sizes == [len(chain), *[max(0, n - 2**r) + 2 for r in range(len(sizes) - 1)]]


def test_long_lists_are_dealt_over_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(diff, "TASK_ITEMS", 100, raising=False)
    rows = [(k, "p", [str(i) for i in range(50)], [str(i) for i in range(1, 51)]) for k in range(20)]
    df = spark.createDataFrame(rows, "k int, path string, was array<string>, now array<string>")
    changes = diff.list_diff(df, ["k"])
    assert "hashpartitioning(k#" in (plan := changes._jdf.queryExecution().executedPlan().toString()) and ", 20), REPARTITION" in plan
    assert changes.count() == 20
