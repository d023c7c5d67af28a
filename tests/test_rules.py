"""Operators on small hand-made rows, one rule per case."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from jobsieve import schemas
from jobsieve.functions import text as T
from jobsieve.operators import checks as K
from jobsieve.operators import funnel, provenance, postings
from jobsieve.sources import documents, feeds

RESUME = {
    "basics": {"name": "Ann Lee", "label": "Engineer", "email": "a@b.c", "phone": "1", "url": "", "summary": "Builds payment systems"},
    "experience": [
        {"company": "Acme", "title": "Engineer", "start": "2015-01", "end": "June 2017",
         "bullets": ["I leveraged Kafka webhooks across teams", "Cut p99 by 40%.", "cut P99 by 40%", " ".join(["word"] * 33)]},
        {"company": "Beta", "title": "Lead", "start": "2012-01", "end": "2014-12", "bullets": []},
    ],
    "education": [], "skills": [{"category": "Tools", "items": [f"t{i}" for i in range(13)]}],
    "projects": [{"name": "P"}], "custom": [{"title": "Notes"}],
    "ignored": 1,
}


def resumes(spark, *docs):
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "doc_id int, raw string")
    return documents.load_resumes(rows, "doc_id", "raw")


def test_loading(spark):
    good, bad = resumes(spark, RESUME, {"nope": 1}, [1])
    row = good.collect()[0]["content"]
    assert row["basics"]["url"] is None and row["basics"]["location"] is None
    assert row["experience"][0]["location"] is None and row["projects"][0]["bullets"] == []
    assert sorted(r["doc_id"] for r in bad.collect()) == [1, 2]


def test_lint(spark):
    good, _ = resumes(spark, RESUME, {"basics": {"name": "x"}})
    issues = K.lint(good, "doc_id", F.lit("2020-06-01").cast("timestamp"))
    got = [(r["code"], r["path"]) for r in issues.orderBy("rule", "leaf_no").collect()]
    assert got == [
        ("bullet-too-long", "experience[0].bullets[3]"),
        ("first-person", "experience[0].bullets[0]"),
        ("duplicate-bullet", "experience[0].bullets[2]"),
        ("trailing-punctuation-mixed", "experience[0].bullets[1]"),
        ("date-format-mixed", "experience[0].end"),
        ("stale-end-date", "experience[0].end"),
        ("skills-undifferentiated", "skills[0]"),
        ("empty-section", "experience[1]"), ("empty-section", "projects[0]"), ("empty-section", "custom[0]"),
    ]
    outcome = {r["doc_id"]: (r["verdict"], r["summary"]) for r in K.lint_outcome(good, issues, "doc_id").collect()}
    assert outcome == {0: ("warn", "10 issues"), 1: ("pass", "clean")}


def test_phrasing(spark):
    good, _ = resumes(spark, RESUME)
    flags = K.phrase_flags(good, "doc_id").collect()
    assert [(f["path"], f["phrase"]) for f in flags] == [("experience[0].bullets[0]", "leveraged")]
    rows = spark.createDataFrame([("éleverage it. Quickly boldly openly done. Weekly boldly openly.",)], "t string")
    assert [r["phrase"] for r in K.boilerplate(rows, [], "t").collect()] == ["leverage"]
    assert [r["phrase"] for r in K.adverb_stacks(rows, [], "t").collect()] == ["Quickly boldly openly done."]


def test_posting_terms(spark):
    body = (
        "Senior Engineer at Acme. We use Go, gRPC and CI/CD.\n"
        "Experience with the distributed tracing of Kafka Streams, and on-call.\n"
        "Strong knowledge of machine learning; SLOs and kafka. Monday"
    )
    df = spark.createDataFrame([(1, body)], "id int, body string")
    got = [r["term"] for r in K.posting_terms(df, "id", "body").orderBy("line_no", "ord", "rank").collect()]
    assert got == [
        "Acme", "Go", "gRPC", "CI/CD", "distributed tracing of", "distributed tracing", "Kafka", "Streams", "on-call",
        "machine learning", "SLOs",
    ]


def test_coverage_stays_inside_a_field(spark):
    good, _ = resumes(spark, RESUME)
    from jobsieve.operators import leaves as L

    folded = good.select("doc_id", K.folded_text(L.searchable_values(F.col("content"))).alias("folded"))
    terms = spark.createDataFrame(
        [(5, i, 0, 0, K_, t) for i, (K_, t) in enumerate([("webhook", "Webhooks"), ("payment system", "payment system"), ("kafka pipeline", "Kafka pipelines"), ("ann lee engineer", "x"), ("ai", "AI")])],
        "posting_id int, line_no int, ord int, rank int, term_key string, term string",
    )
    pairs = spark.createDataFrame([(1, 0, 5), (2, 0, 6)], "pair_id int, doc_id int, posting_id int")
    got = {r["pair_id"]: (r["matched"], r["missing"]) for r in K.coverage(pairs, terms, "posting_id", folded, "doc_id").collect()}
    assert got == {1: (["Webhooks", "payment system"], ["Kafka pipelines", "x", "AI"]), 2: ([], [])}


def test_fidelity(spark):
    good, _ = resumes(spark, RESUME, RESUME, RESUME)
    broken = json.loads(json.dumps(RESUME))
    broken["basics"]["label"] = "Engin eer"
    short = json.loads(json.dumps(RESUME))
    short["experience"] = short["experience"][:1]
    parsed, _ = resumes(spark, broken, short)
    got = {r["doc_id"]: (r["verdict"], r["summary"]) for r in K.fidelity(good, parsed, "doc_id").collect()}
    assert got[0][0] == "warn" and got[0][1].startswith("1 of ")
    assert got[1][0] == "fail" and got[2] == ("warn", "Not measured")


def test_all_checks_always_five_rows(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id int")
    one = spark.createDataFrame([(1, "ai_tell", "pass", "clean", None)], "doc_id int, kind string, verdict string, summary string, error string")
    rows = K.all_checks(docs, [one], "doc_id").orderBy("doc_id", "kind_no").collect()
    assert len(rows) == 10 and rows[3]["summary"] == "clean" and rows[0]["error"] == "This check failed to run."


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().split("\n")


def test_fidelity_joins_digests_and_keeps_no_text(spark):
    good, _ = resumes(spark, RESUME, RESUME)
    plan = _plan(K.fidelity(good, good, "doc_id"))
    joined = plan[: next(i for i, line in enumerate(plan) if "Join LeftOuter" in line)]
    assert not any("explode" in line or "content" in line for line in joined)


def test_lint_and_phrase_flags_read_the_documents_once(spark):
    good, _ = resumes(spark, RESUME, RESUME)
    now = F.lit("2020-06-15 00:00:00").cast("timestamp")
    for found in (K.lint(good, "doc_id", now), K.phrase_flags(good, "doc_id")):
        assert not any("Union" in line for line in _plan(found))


def test_fidelity_of_missing_lists_and_repeated_documents(spark):
    entry = "company string, title string, location string, start string, end string, bullets array<string>"
    content = (
        "struct<basics:struct<name:string,label:string,email:string,phone:string,url:string,location:string,summary:string>,"
        f"experience:array<struct<{entry.replace(' string', ':string').replace(' array', ':array')}>>,"
        "education:array<struct<institution:string,degree:string,location:string,start:string,end:string,bullets:array<string>>>,"
        "skills:array<struct<category:string,items:array<string>>>,"
        "projects:array<struct<name:string,description:string,url:string,bullets:array<string>>>,"
        "custom:array<struct<title:string,bullets:array<string>>>>"
    )
    basics = ("A", "\u00a0", None, None, None, None, "  Two\u2019s  words ")

    def doc(bullets, summary=basics[6]):
        return ((*basics[:6], summary), [("C", None, None, None, None, bullets)], [], [], [], [])

    was = [(1, doc(["x", " "])), (1, doc(["x", " "])), (2, doc(None)), (3, doc(["x"])), (4, doc(["x"])), (None, doc(["x"])), (5, doc(["x"]))]
    now = [(1, doc(["X", "y"], "two's words")), (2, doc(["x"])), (3, doc(None)), (4, None), (None, doc(["x"])), (5, doc(["x"])), (5, None)]
    before, after = (spark.createDataFrame(rows, f"id int, content {content}") for rows in (was, now))
    got = {(r.id, r.dropped, r.checked, r.summary) for r in K.fidelity(before, after, "id").collect()}
    assert got == {
        (1, 0, 8, "0 of 8 fields dropped"),  # two rows of four texts
        (2, 0, 0, "0 of 0 fields dropped"), (3, 1, 4, "1 of 4 fields dropped"), (4, 0, 0, "Not measured"), (None, 0, 0, "Not measured"),
        (5, 0, 4, "0 of 4 fields dropped"), (5, 0, 0, "Not measured"),  # read back twice, once without content
    }


def test_lint_counts_the_items_of_skills(spark):
    one = json.loads(json.dumps(RESUME))
    one["skills"] = [{"category": "c", "items": ["a", "b", "c"]}, {"category": "d", "items": []}]
    one["projects"] = [{"name": "p", "description": "d", "url": None, "bullets": ["My plan"]}]
    good, _ = resumes(spark, one)
    from jobsieve.operators import leaves as L

    now = F.lit("2020-06-15 00:00:00").cast("timestamp")
    found = K.lint(good, "doc_id", now).where("code = 'first-person' and path like 'projects%'").collect()
    leaf = L.leaves(good, "doc_id").where("path = 'projects[0].bullets[0]'").first()
    assert [f["leaf_no"] for f in found] == [leaf["leaf_no"]]


def test_terms_keep_their_ordinals_in_long_lines(spark):
    body = "go c++x/Kafka 9Abc. Then node, experience with.Net and Spark " + "aa Kotlin experience with Go/Lang+ in: " * 40
    got = K.posting_terms(spark.createDataFrame([(1, body)], "id int, body string"), "id", "body").collect()
    token = re.compile(r"[A-Za-z][A-Za-z0-9+#]*(?:[./][A-Za-z0-9+#]+)*")
    ords = {t: i for i, t in reversed(list(enumerate(token.findall(body))))}
    techs = {r.term: r.ord for r in got if r["rank"] == 2}
    assert techs == {t: ords[t] for t in ("go", "c++x/Kafka", "Abc", "node", "with.Net", "Spark", "Kotlin", "Go/Lang+")}
    asked = [(r.term, r.ord) for r in got if r["rank"] == 0]
    assert asked == [("Go/Lang+ in", len(token.findall(body[: body.index(" Go/Lang+")])))]


def test_validation_and_application(spark):
    good, _ = resumes(spark, RESUME)
    bullet = RESUME["experience"][0]["bullets"][0]
    proposals = [
        ("edit", "experience[0].bullets[0]", "Built it", "experience.0.bullets.0", bullet),
        ("edit", "basics.label", "Lead", "experience[0].bullets[0]", "leveraged Kafka webhooks across"),
        ("edit", "basics.label", "Lead", "experience[0].bullets[0]", "Kafka"),
        ("edit", "basics.url", "x", "basics.name", "Ann Lee"),
        ("add", "basics.url", "x", "experience[0].bullets[0]", bullet),
        ("remove", "experience[0].bullets[9]", "", "basics.name", "Ann Lee"),
        ("reorder", "skills[0].items", "a", "missing", "q"),
    ]
    changes = spark.createDataFrame([(0, i, *p) for i, p in enumerate(proposals)], "doc_id int, change_no long, kind string, path string, now string, citation_path string, citation_snippet string")
    judged = provenance.validate_changes(changes, good, "doc_id")
    got = [r["status"] for r in judged.orderBy("change_no").collect()]
    assert got == ["proposed", "proposed", "refused", "refused", "proposed", "refused", "refused"]

    accepted = spark.createDataFrame(
        [(0, i, *p, "proposed") for i, p in enumerate([
            ("add", "experience[0].bullets[1]", "new"), ("remove", "experience[0].bullets[0]", ""), ("remove", "experience[0].bullets[3]", ""),
            ("edit", "experience[0].bullets[2]", "edited"), ("reorder", "skills[0].items", "a · b"), ("remove", "projects[4]", ""),
        ])] + [(0, 99, "edit", "basics.name", "never", "refused")],
        "doc_id int, change_no long, kind string, path string, now string, status string",
    )
    applied = provenance.apply_changes(good, accepted, "doc_id")
    row = applied.collect()[0]
    assert row["content"]["experience"][0]["bullets"] == ["Cut p99 by 40%.", "new", "edited"]
    assert row["content"]["basics"]["name"] == "Ann Lee"
    skipped = [(r["change_no"], r["reason"]) for r in provenance.skip_report(applied, accepted, "doc_id").orderBy("change_no").collect()]
    assert skipped == [(4, "That order is not the same items the list holds."), (5, "projects[4] is not in your résumé.")]


def test_reorder_is_a_permutation(spark):
    rows = [(["a", "b ", "a"], "b · a · a"), (["a", "b"], "a · a"), (["a", "b"], "a · b · c"), ([], "a")]
    df = spark.createDataFrame(rows, "items array<string>, o string").coalesce(1)
    got = [r[0] for r in df.select(provenance.reordered(F.col("items"), F.col("o"))).collect()]
    assert got == [["b ", "a", "a"], None, None, None]


def test_every_reason_a_change_does_not_land(spark):
    good, _ = resumes(spark, RESUME)
    bullets = RESUME["experience"][0]["bullets"]
    changes = [
        ("edit", "", "x"), ("edit", "basics.nothing", "x"), ("edit", "experience[9].title", "x"), ("edit", "basics", "x"),
        ("remove", "experience[0].title.x", ""), ("remove", "experience.first", ""), ("remove", "experience[0].bullets[99999999999999999999]", ""),
        ("add", "experience[0].bullets[77]", "x"), ("add", "nowhere.at.all", "x"), ("add", "experience", "x"), ("add", "brand_new", "x"),
        ("reorder", "basics.name", "x"), ("reorder", "experience[0].bullets", " "), ("reorder", "experience", "x"),
        ("add", "basics.url", "https://new.example"), ("remove", "custom", ""), ("edit", "experience[0].bullets[0]", "first"),
        ("reorder", "experience[0].bullets", " · ".join([*bullets[1:], "first"])), ("add", None, "x"),
    ]
    accepted = spark.createDataFrame([(0, i, *c, "proposed") for i, c in enumerate(changes)], "doc_id int, change_no long, kind string, path string, now string, status string")
    row = provenance.apply_changes(good, accepted, "doc_id").collect()[0]
    reasons = dict(row["skipped"])
    no_field, at, past, not_in, nothing = "This change names no field in your résumé.", "is not a field in your résumé.", "is past the end of that list.", "is not in your résumé.", "Nothing at {} to add to."
    assert reasons == {
        0: no_field, 1: f"basics.nothing {not_in}", 2: f"experience[9].title {at}", 3: f"basics {at}", 4: f"experience[0].title.x {at}",
        5: f"experience.first {not_in}", 6: f"experience[0].bullets[99999999999999999999] {not_in}", 7: f"experience[0].bullets[77] {past}",
        8: nothing.format("nowhere.at.all"), 9: nothing.format("experience"), 11: "That is not a list in your résumé.",
        12: "The model gave no order to put that list in.", 13: "That order is not the same items the list holds.", 18: no_field,
    }
    assert row["content"]["basics"]["url"] == "https://new.example" and row["content"]["custom"] == []
    assert row["content"]["experience"][0]["bullets"] == [*bullets[1:], "first"]



def test_funnel_rates_are_null_when_sets_do_not_nest(spark):
    rows = [(i, None, "x" if i < 2 else None, None, None) for i in range(4)]
    apps = spark.createDataFrame(rows, "application_id int, applied_at string, replied_at string, interview_at string, offered_at string")
    got = [(r["to_label"], r["n"], r["rate"]) for r in funnel.funnel_conversions(apps).orderBy("stage").collect()]
    assert got == [("Applied", 0, 0.0), ("Replied", 2, None), ("Interview", 0, 0.0), ("Offer", 0, None)]


def test_unknown_status_is_refused(spark):
    df = spark.createDataFrame([("applied",), ("hired",), (None,)], "status string")
    good, bad = funnel.valid_events(df)
    assert good.count() == 1 and bad.count() == 2


def test_feeds_isolate_failures(spark):
    bodies = [
        ("greenhouse", "acme-co", json.dumps({"jobs": [{"id": 1, "title": "T", "location": {"name": "Remote"}, "absolute_url": "u"}]})),
        ("lever", "beta", "{oops"),
        ("greenhouse", "acme-co", "{cut off"),
        ("adzuna", "us", json.dumps({"results": [{"redirect_url": "r", "company": {"display_name": "C"}}]})),
    ]
    df = spark.createDataFrame(bodies, "provider string, org string, body string")
    found, failed = feeds.search(df)
    got = {(r["external_id"], r["company"], r["remote"]) for r in found.collect()}
    assert got == {("greenhouse-acme-co-1", "Acme Co", True), ("r", "C", None)}
    assert sorted(r["provider"] for r in failed.collect()) == ["greenhouse", "lever"]
    try:
        feeds.search(df.where("provider = 'lever'"))
    except feeds.AllSourcesFailed as error:
        assert "lever" in str(error)
    else:
        raise AssertionError("a run where every source failed must raise")


def test_posting_fields(spark):
    df = spark.createDataFrame(
        [(1, "Staff Engineer at Acme · Remote\nbody."), (2, "Title: A\nCompany: B\nLocation: Oslo, NO"), (3, "We are a team. Join us now.\n")],
        "id int, body string",
    )
    got = {r["id"]: (r["title"], r["company"], r["location"]) for r in postings.posting_fields(df, "id", "body").collect()}
    assert got == {1: ("Staff Engineer", "Acme", "Remote"), 2: ("A", "B", "Oslo, NO"), 3: (None, None, None)}


def _fold(token):
    if len(token) > 3 and token.endswith("ies"):
        return token[:-3] + "y"
    if len(token) > 4 and token.endswith(("ses", "xes", "zes", "ches", "shes")):
        return token[:-2]
    if len(token) > 2 and token.endswith("s") and not token.endswith(("ss", "us", "is")):
        return token[:-1]
    return token


def test_term_keys_fold_each_token(spark):
    import itertools
    import random
    import re

    rng = random.Random(4)
    ends = ["ies", "ses", "xes", "zes", "ches", "shes", "es", "s", "ss", "us", "is", "", "e"]
    words = ["".join(p) + e for n in range(4) for p in itertools.product("ash1", repeat=n) for e in ends]
    texts = [" ".join(rng.sample(words, 6)) for _ in range(1500)] + words + ["Gases, BOXES/policies!", " --s ies ", "É ties", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in rows.select("t", T.term_key(F.col("t")).alias("k")).collect():
        assert r.k == " ".join(_fold(x) for x in re.split("[^a-z0-9]+", r.t.lower()) if x), r


def test_phrases_by_automaton_by_join_and_by_hand(spark):
    import random

    from jobsieve.operators.phrases import Automaton, phrase_hits

    rng = random.Random(5)
    some = lambda n: [rng.choice("abc") for _ in range(rng.randrange(1, n))]
    for _ in range(300):
        asked, line = [some(5) for _ in range(rng.randrange(1, 7))], some(30)
        inside = lambda p: any(line[i : i + len(p)] == p for i in range(len(line)))
        want = {tuple(p) for p in asked if inside(p)}
        assert {tuple(asked[n]) for n in Automaton(asked).found(line)} == want

    phrases = [(i, " ".join(some(6))) for i in range(40)] + [(99, ""), (98, "a b"), (97, "a b")]
    lines = [(d if d else None, n, rng.choice([" ", ", "]).join(some(40)).upper()) for d in range(6) for n in range(8)] + [(7, 0, None), (7, 1, "")]
    want = {}
    for i, p in phrases:
        for d, _, t in lines:
            if p and t and f" {p} " in f" {t.lower().replace(',', '')} ":
                want[i, d] = want.get((i, d), 0) + 1
    p = spark.createDataFrame(phrases, "phrase_id int, term_key string")
    x = spark.createDataFrame(lines, "doc_id int, line_no int, text string")
    for limits in ({}, {"max_rows": 3}):
        rows = [(r.phrase_id, r.doc_id, r.lines) for r in phrase_hits(p, x, **limits).collect()]
        got = {(i, d): n for i, d, n in rows}
        assert len(rows) == len(got)
        assert got == want
