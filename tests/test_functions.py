"""Column functions, one rule per case."""

from __future__ import annotations

import re

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from jobsieve.functions import dates as D
from jobsieve.functions import fields as R
from jobsieve.functions import links as U
from jobsieve.functions import text as T
from jobsieve.functions.word_diff import segments as token_segments


def apply(spark, fn, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("v")).alias("r")).collect()]


def test_plural_fold(spark):
    got = apply(spark, T.term_key, ["Policies", "boxes", "glass", "bus", "axis", "APIs", "on-call", "ties", "gas", "C++ & Go"])
    assert got == ["policy", "box", "glass", "bus", "axis", "apis", "on call", "ty", "ga", "c go"]


def test_normalising(spark):
    assert apply(spark, T.plain, ["It’s  “A–B” x"]) == ["it's \"a-b\" x"]
    assert apply(spark, T.title_case_token, ["acme-labs_io", "openAI"]) == ["Acme Labs Io", "OpenAI"]
    assert apply(spark, T.optional, ["  ", " a ", None]) == [None, "a", None]
    assert apply(spark, T.required, ["  ", None]) == ["", ""]
    assert apply(spark, T.dehyphenate, ["down-\ntime on-\nCall"]) == ["downtime on-\nCall"]
    assert apply(spark, T.bullet_key, ["Éa, B!  c"]) == ["éa b c"]
    assert apply(spark, T.word_count, ["", " a  b\nc "]) == [0, 3]
    assert apply(spark, T.snippet, ["a  b", "x" * 300]) == ["a b", "x" * 219 + "…"]


def test_distinctive_terms(spark):
    (got,) = apply(spark, T.distinctive_terms, ["The 1.2M attempts per day. Class attempts a $40M"])
    assert got == ["1.2m", "attempt", "day", "class", "40m"]


def test_json_in_reply(spark):
    got = apply(spark, T.first_json_object, ['Sure {"a": {"b": 1}} bye', "none", "} {"])
    assert got == ['{"a": {"b": 1}}', None, None]


def test_links(spark):
    urls = [
        "HTTPS://www.Acme.com:443/Jobs/1/?utm_source=x&b=2&a=1&Ref=q#top", "http://a.io", "  ", "not a url",
        "https://a.io/x?q=a%20b&q=1", None,
    ]
    assert apply(spark, U.canonical_url, urls) == [
        "https://acme.com/Jobs/1?a=1&b=2", "http://a.io", None, "not a url", "https://a.io/x?q=a b&q=1", None,
    ]
    assert apply(spark, U.url_match_key, ["http://www.a.io/x/", "https://a.io/x", "Odd One"]) == ["a.io/x", "a.io/x", "odd one"]


def test_board_reference(spark):
    urls = [
        "https://boards.greenhouse.io/acme/jobs/12?x=1", "https://job-boards.greenhouse.io/embed/job_app?for=acme&token=9",
        "https://boards.greenhouse.io/acme?gh_jid=7", "https://jobs.lever.co/acme/ab-1/apply", "https://jobs.ashbyhq.com/acme",
        "https://boards.greenhouse.io/acme/jobs", "https://example.com/acme/1", "nope",
    ]
    got = [tuple(r) if r else None for r in apply(spark, U.board_reference, urls)]
    assert got == [
        ("greenhouse", "acme", "12"), ("greenhouse", "acme", "9"), ("greenhouse", "acme", "7"), ("lever", "acme", "ab-1"),
        None, None, None, None,
    ]


def test_dates(spark):
    assert apply(spark, D.date_shape, ["2020", "2020-1", "June 2020", "06/2020", "Fall"]) == ["iso", "iso", "month-name", "slashed", "other"]
    assert apply(spark, D.end_month_index, ["2021", "2021-03", "3/2021", "Mar. 2021", "Fob 2021", "x"]) == [
        2021 * 12 + 11, 2021 * 12 + 2, 2021 * 12 + 2, 2021 * 12 + 2, None, None,
    ]
    assert apply(spark, D.normalise_date, ["Jun 2021", "06/2020", "2021/6", "2021-6", "now", "1999", "x"]) == [
        "2021-06", "2020-06", "2021-06", "2021-06", None, "1999", None,
    ]
    spans = apply(spark, D.date_range, ["Acme, Mar 2019 – Present", "2018", "in 2018 we", "5/2011 to 6/2012 x"])
    assert [tuple(s) if s else None for s in spans] == [
        ("2019-03", None, "Mar 2019 – Present"), ("2018", None, "2018"), None, ("2011-05", "2012-06", "5/2011 to 6/2012"),
    ]
    assert apply(spark, D.human_month, ["2023-03", "2023-13", "Fall"]) == ["Mar 2023", "2023-13", "Fall"]
    labels = apply(spark, lambda c: D.range_label(c, F.lit(None)), ["2023-03", None])
    assert labels == ["Mar 2023 -- Present", ""]


@pytest.mark.parametrize("minutes,label", [(0, "1m ago"), (59, "59m ago"), (90, "2h ago"), (60 * 36, "2d ago")])
def test_age_label(spark, minutes, label):
    now = F.lit(datetime(2024, 1, 10)).cast("timestamp")
    at = F.timestamp_micros(F.unix_micros(now) - F.lit(minutes * 60_000_000))
    assert spark.range(1).select(D.age_label(at, now)).first()[0] == label


def test_fields(spark):
    assert apply(spark, R.contact_source, ["Apollo", "linkedin-cookie", " BrightData x", "", None, "web"]) == [
        "apollo", "linkedin", "brightdata", "manual", "manual", "manual",
    ]
    assert apply(spark, R.looks_like_email, ["a@b.c", "a b@c.d", "a@b"]) == [True, False, False]
    kept = apply(spark, lambda c: R.refreshed_body(c, F.lit("new body")), ["", "No description was returned by x.", "old", "a longer old body"])
    assert kept == ["new body", "new body", "new body", "a longer old body"]
    assert apply(spark, lambda c: R.refreshed_body(c, F.lit("No description was returned by y.")), [" ", "old"]) == [
        "No description was returned by y.", "old",
    ]
    text = apply(spark, lambda c: R.message_text(F.lit("S"), F.lit("B"), c, F.lit("e@x.y")), ["Ann", None])
    assert text == ["To: Ann <e@x.y>\nSubject: S\n\nB", "To: <e@x.y>\nSubject: S\n\nB"]
    assert apply(spark, R.path_key, ["experience[0].bullets[3]", "a..b"]) == ["experience.0.bullets.3", "a.b"]


def _walk_back(parts, keep):
    return "".join(p["text"] for p in parts if p["type"] in ("same", keep))


def _tokens(text):
    return None if text is None else re.findall(r"\s+|\w+%?|\S", text)


def segments(was, now, **limits):
    return token_segments(_tokens(was), _tokens(now), **limits)


def test_word_diff_rules():
    assert segments("", "x") == [{"type": "add", "text": "x"}]
    assert segments("x", None) == [{"type": "del", "text": "x"}]
    assert segments("a b", "a b") == [{"type": "same", "text": "a b"}]
    assert segments("cut costs 20%", "cut costs 25%") == [
        {"type": "same", "text": "cut costs "}, {"type": "del", "text": "20%"}, {"type": "add", "text": "25%"},
    ]
    long = " ".join(str(i) for i in range(900))
    assert [s["type"] for s in segments(long, long + " x", max_tokens=800)] == ["del", "add"]
    assert segments(long, long + " x") == [{"type": "same", "text": long + " "}, {"type": "add", "text": "x"}]
    middle = segments(long, long.replace("450", "changed"))
    assert [s["type"] for s in middle] == ["same", "del", "add", "same"]
    parts = segments("Led a team of five", "Led one small team")
    assert _walk_back(parts, "del").split() == "Led a team of five".split()
    assert _walk_back(parts, "add").split() == "Led one small team".split()
    assert all(p["text"] == p["text"].strip() for p in parts if p["type"] != "same")


def test_sql_functions_agree_with_columns(spark):
    from jobsieve.functions.register import register_all

    assert "fold_plural" in register_all(spark)
    rows = spark.createDataFrame([("policies", "strong", 0), ("boxes", "x", 5), ("June 2020", "reach", 2), ("A \u00a0 b\nC", None, 1)], "s string, t string, n int")
    rows.createOrReplaceTempView("samples")
    at, now = "timestamp'2024-01-01 06:00:00'", "timestamp'2024-01-03 05:00:00'"
    got = spark.sql(
        f"SELECT fold_plural(s), squash(s), date_shape(s), tier_rank(t), day_label(n), whole_days_since({at}, {now}), add_whole_days({at}, n) FROM samples"
    ).collect()
    start, end = F.expr(at), F.expr(now)
    want = rows.select(
        T.fold_plural(F.col("s")), T.squash(F.col("s")), D.date_shape(F.col("s")), R.tier_rank(F.col("t")), R.day_label(F.col("n")),
        D.whole_days_since(start, end), D.add_days(start, F.col("n")),
    ).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


def _aligned(a, b):
    """The alignment by the whole table of lengths."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            out.append(("same", a[i]))
            i, j = i + 1, j + 1
        elif j == len(b) or (i < len(a) and best[i + 1][j] >= best[i][j + 1]):
            out.append(("del", a[i]))
            i += 1
        else:
            out.append(("add", b[j]))
            j += 1
    return out


def test_word_diff_aligns_as_the_whole_table_does():
    import random

    from jobsieve.functions.word_diff import alignment

    rng = random.Random(7)
    for size in [9] * 200 + [70] * 20 + [300]:
        letters = "abcd" if size < 100 else [str(k) for k in range(40)]
        a = [rng.choice(letters) for _ in range(rng.randint(0, size))]
        b = [rng.choice(letters) for _ in range(rng.randint(0, size))]
        assert list(alignment(a, b)) == _aligned(a, b)


def test_word_diff_of_long_texts_is_quick():
    import random
    import time

    from jobsieve.functions.word_diff import alignment

    rng = random.Random(8)
    a = [str(rng.randrange(2000)) for _ in range(20_000)]
    b = [str(rng.randrange(2000)) for _ in range(20_000)]
    began = time.process_time()
    kinds = [k for k, _ in alignment(a, b)]
    assert time.process_time() - began < 10
    assert kinds.count("same") + kinds.count("del") == len(a) and kinds.count("same") + kinds.count("add") == len(b)


def test_word_diff_segments():
    """Gaps stay outside of changes, and one gap is left where a deletion meets an addition."""
    assert segments("Cut latency by sharding", "Cutting latency by sharding") == [
        {"type": "del", "text": "Cut"}, {"type": "add", "text": "Cutting"}, {"type": "same", "text": " latency by sharding"},
    ]
    assert segments("Built APIs at scale", "Built internal REST APIs at scale") == [
        {"type": "same", "text": "Built "}, {"type": "add", "text": "internal REST"}, {"type": "same", "text": " APIs at scale"},
    ]
    assert segments("Shipped the ledger.", "Shipped the ledger!") == [
        {"type": "same", "text": "Shipped the ledger"}, {"type": "del", "text": "."}, {"type": "add", "text": "!"},
    ]
    for was, now in (("Improved database performance", "Cut p99 latency"), ("a b c", "a c"), ("a c", "a b c")):
        assert "  " not in "".join(s["text"] for s in segments(was, now))
    assert segments("a\u00a0b", "a c") == [
        {"type": "same", "text": "a\u00a0"}, {"type": "del", "text": "b"}, {"type": "same", "text": " "}, {"type": "add", "text": "c"},
    ]


def test_sql_functions_equal_the_columns(spark):
    import json

    from jobsieve.functions import fields
    from jobsieve.functions import text as T
    from jobsieve.functions.register import register_all
    from jobsieve.operators import leaves as L
    from jobsieve.sources import documents

    register_all(spark)
    values = ["  a\u00a0", "", "  ", None, "experience[0].bullets[12]", "a..b.", "scheduled", "sent"]
    df = spark.createDataFrame([(v,) for v in values], "v string").coalesce(1)
    got = df.selectExpr("optional_text(v)", "required_text(v)", "path_key(v)", "is_pending(v)").collect()
    v = F.col("v")
    want = df.select(T.optional(v), T.required(v), fields.path_key(v), fields.is_pending(v)).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]

    resume = {"basics": {"name": "N", "label": " "}, "experience": [{"company": "C", "bullets": ["x", " ", "y"]}, {"title": "T"}],
              "skills": [{"category": "K", "items": ["i"]}]}
    rows = spark.createDataFrame([(1, json.dumps(resume)), (2, json.dumps({"basics": {"name": "M"}}))], "doc_id int, raw string")
    good, _ = documents.load_resumes(rows, "doc_id", "raw")
    good.createOrReplaceTempView("some_resumes")
    listed = spark.sql("SELECT r.doc_id, l.* FROM some_resumes r, LATERAL resume_leaves(r.content) l").collect()
    assert sorted(map(str, listed)) == sorted(map(str, L.leaves(good, "doc_id").collect())) and len(listed) == 8


def test_white_space_and_words_as_the_plain_expressions_have_them(spark):
    odd = ["", " ", " 　", "a", " a  b\t c \n", "x \u0085", "\u0085", "é﻿ ü", "‘q’ — “r” s", "one two  three", None]
    white = re.compile("[" + T.WHITE + "]+")
    trimmed = lambda v: None if v is None else v.strip(T.WHITE)
    assert apply(spark, T.filled, odd) == [None if v is None else trimmed(v) != "" for v in odd]
    assert apply(spark, T.word_count, odd) == [None if v is None else len([w for w in white.split(v) if w]) for v in odd]
    assert apply(spark, T.squash, odd) == [None if v is None else white.sub(" ", v).strip(" ").lower() for v in odd]
    assert apply(spark, T.trim, odd[:5]) == [trimmed(v) for v in odd[:5]]


def test_fields_folded_together_are_the_fields_folded_alone(spark):
    from jobsieve.operators import checks

    rows = [["The Boxes", "a\nb,  classes ", None, "", "ties!"], [], ["-", "x"], ["\n", "é ies"]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, fs array<string>").orderBy("i")
    alone = F.transform("fs", lambda f: T.term_key(F.coalesce(f, F.lit(""))))
    got = df.select(checks.folded_text(F.col("fs")).alias("g"), F.array_join(alone, " \n ").alias("w")).collect()
    assert [r.g for r in got] == [f" {r.w} " for r in got]


def test_classes_java_tests_fast_are_the_plain_ones(spark):
    from jobsieve.operators import checks

    odd = ["a\x00b\nZ9", "\u00a0x\u2028\ufeff y", "é\U0001f600+#/", "].^-[", ""]
    for fast, plain in (
        (T.besides("ab\n"), r"[^ab\n]"), (T.besides(T.WHITE), T.NOT_SPACE), (T.besides("].^-["), r"[^\].^\-\[]"),
        (T.listed("[a-zA-Z0-9+#]"), "[a-zA-Z0-9+#]"),
    ):
        assert apply(spark, lambda c, p=fast: F.regexp_replace(c, p, "_"), odd) == apply(spark, lambda c, p=plain: F.regexp_replace(c, p, "_"), odd)
    counts = [[i % 5 for i in range(n)] for n in (0, 1, 16, 17, 32, 33, 300)]
    df = spark.createDataFrame([(c,) for c in counts], "c array<int>").select("c", checks._sums(F.col("c")).alias("s"))
    assert all(r.s == [sum(r.c[: i + 1]) for i in range(len(r.c))] for r in df.collect())


def test_stock_phrases_are_looked_for_only_where_they_may_be(spark):
    from jobsieve.operators import checks

    texts = ["LEVERAGED synergies", "state of the art, fast-paced environment", "In today’s fast paced", "nothing here", "leveragable", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    found = checks.boilerplate(df, ["i"], "t")
    assert sorted((r.i, r.phrase) for r in found.collect()) == [
        (0, "LEVERAGED"), (0, "synergies"), (1, "fast-paced environment"), (1, "state of the art"), (2, "In today’s fast paced"),
    ]
    assert "__lower" in found._jdf.queryExecution().optimizedPlan().toString()


def test_word_diff_holds_few_rows_at_a_time():
    import pyarrow as pa

    from jobsieve.functions import word_diff

    old = pa.array([["a"] * 30_000, None, ["b"] * 90_000, [], ["c"]])
    new = pa.array([["a"] * 30_000, ["z"], None, None, ["d"]])
    assert list(word_diff._pieces(old, new)) == [(0, 1), (1, 1), (2, 1), (3, 2)]
    assert list(word_diff._lists(old.slice(3, 2))) == [[], ["c"]]
    assert list(word_diff._pieces(old.slice(0, 0), new.slice(0, 0))) == []
