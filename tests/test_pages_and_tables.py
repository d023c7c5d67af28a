"""Pages swept as streams of runs, and tables that change together."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from jobsieve.operators import pages, pull_in
from jobsieve.sources.manifest import ConflictError, Manifests, TableSet

GLYPH = "doc_id string, page int, x double, y double, right double, str string, size double, font string"


def _page(doc, page, shift=0.0):
    """A heading across, then two columns of nine rows each whose heights drift."""
    out = [(doc, page, 40.0, 0.0, 560.0, "Ann Lee", 18.0, "Bold")]
    for r in range(9):
        y = 10.0 + 5.0 * r + shift
        out += [
            (doc, page, 40.0, y, 50.0, "•", 10.0, "Sym"), (doc, page, 60.0, y + 2.4, 150.0, f"left{r}", 10.0, "Text"),
            (doc, page, 150.5, y + 0.5, 200.0, "on", 10.0, "Text"), (doc, page, 400.0, y + 1.0, 480.0, f"right{r}", 9.0, "Text"),
            (doc, page, 490.0, y + 1.0, 550.0, "end", 9.0, "Bold"),
        ]
    return out


@pytest.mark.parametrize("batch", ["7", "10000"])
def test_lines_of_pages_that_batches_share(spark, batch):
    rows = [g for d in ("a", None, "b") for p in range(3) for g in _page(d, p, 0.1 * p)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(rows, GLYPH).repartition(5)
        lines = pages.page_lines(df).collect()
        cuts = {(r.doc_id, r.page): r.gutter for r in pages.gutters(df).collect()}
        placed = pages.baseline_rows(df).groupBy("doc_id", "page", "row_y").count().collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(lines) == 9 * 19 and len(cuts) == 9 and len(placed) == 9 * 10
    assert all(200 < g < 400 for g in cuts.values())
    one = sorted((r for r in lines if r.doc_id == "b" and r.page == 0), key=lambda r: (r.band, r.side, r.row_y))
    assert [r.text for r in one] == ["Ann Lee", *[f"left{r}on" for r in range(9)], *[f"right{r} end" for r in range(9)]]
    assert [(r.band, r.side) for r in one] == [(0, 2)] + [(1, 0)] * 9 + [(1, 1)] * 9
    assert [r.is_list_item for r in one] == [False] + [True] * 9 + [False] * 9
    first = one[1]
    assert (first.x, first.y, first.right, first.font_size, first.font_name, first.row_y) == (60.0, 12.4, 200.0, 10.0, "Text", 10.0)


def test_pages_without_runs_and_with_gaps(spark):
    assert pages.page_lines(spark.createDataFrame([], GLYPH)).collect() == []
    odd = [("a", 0, 1.0, 1.0, 2.0, None, None, None), ("a", 0, None, 1.0, 2.0, "x", 1.0, "f"), ("a", 0, 5.0, 1.0, 9.0, " w", 1.0, "f")]
    got = pages.page_lines(spark.createDataFrame(odd, GLYPH)).collect()
    assert [(r.text, r.x, r.right, r.font_name) for r in got] == [("w", 1.0, 9.0, "f")]


# ---- pull-in

NOW = datetime(2024, 1, 1)
JOBS = "job_id string, url string, title string, company string, location string, jd_text string, source string, scraped_at timestamp"
APPS = "application_id string, job_id string, status string, created_at timestamp, fit_tier string, fit_reasons array<string>"
LISTINGS = "adapter_rank int, pos int, external_id string, url string, title string, company string, location string, description string, source string"


def test_pull_in_twice_changes_nothing(spark, tmp_path):
    jobs = spark.createDataFrame([("j1", "https://x.io/1", "Mine", "C", "Oslo", "old", "paste", NOW), ("j2", None, "T", "D", None, "body", "paste", NOW), ("j3", None, "Q", "D", None, "b", "api", NOW)], JOBS)
    apps = spark.createDataFrame([("a1", "j1", "offer", NOW, "reach", ["r"]), ("a0", "j1", "applied", datetime(2024, 2, 1), None, None), ("a3", "j3", "applied", NOW, "strong", ["s"])], APPS)
    listings = spark.createDataFrame(
        [
            (0, 0, "e0", "https://x.io/1?utm_source=z", "Theirs", "C", None, "a longer body", "b"),
            (0, 1, "e1", None, "T", "D", None, "body", "b"),
            (0, 2, "e2", "https://x.io/2", "New", "E", "Rome", None, "b"),
            (0, 3, "e3", "https://x.io/2", "New2", "E", None, "text", "b"),
        ],
        LISTINGS,
    )
    ratings = spark.createDataFrame([("e0", "strong", ["fits"]), ("e2", "possible", ["p"]), ("e9", "reach", ["x"])], "external_id string, tier string, reasons array<string>")
    tables = TableSet(spark, str(tmp_path))
    assert tables.read() == {}
    tables.replace({"jobs": jobs, "applications": apps})
    states = []
    for _ in range(2):
        held = tables.read()
        tables.replace(pull_in.pull_in(held["jobs"], held["applications"], listings, ratings, ["adapter_rank", "pos"], F.lit(NOW)))
        held = tables.read()
        states.append((sorted(map(str, held["jobs"].collect())), sorted(map(str, held["applications"].collect()))))
    assert states[0] == states[1]
    found = {r.title: r for r in tables.read()["jobs"].collect()}
    assert set(found) == {"Mine", "T", "Q", "New"} and all(r.job_id for r in found.values())
    assert (found["Mine"].jd_text, found["Mine"].location, found["Mine"].source) == ("a longer body", "Oslo", "paste")
    assert (found["New"].jd_text, found["New"].location, found["New"].source) == ("text", "Rome", "api")
    mine = {r.application_id: r for r in tables.read()["applications"].collect()}
    by_job = {r.job_id: r for r in mine.values() if r.application_id not in ("a0",)}
    assert len(mine) == 5 and None not in mine
    assert (mine["a1"].status, mine["a1"].fit_tier, mine["a1"].fit_reasons) == ("offer", "strong", ["fits"])
    assert (mine["a0"].fit_tier, mine["a3"].fit_tier) == (None, "strong")
    assert (by_job["j2"].status, by_job["j2"].fit_tier) == ("sourced", None)
    assert (by_job[found["New"].job_id].status, by_job[found["New"].job_id].fit_tier) == ("sourced", "possible")


def test_tables_change_together_or_not_at_all(spark, tmp_path):
    tables = TableSet(spark, str(tmp_path))
    one = lambda n: spark.range(n)
    tables.replace({"a": one(1), "b": one(2)})
    state = tables.manifests.newest()

    class Lost(Exception):
        pass

    commit, tables.manifests.commit = tables.manifests.commit, lambda *_: (_ for _ in ()).throw(Lost())
    with pytest.raises(Lost):
        tables.replace({"a": one(5), "b": one(6)})
    tables.manifests.commit = commit
    assert {n: t.count() for n, t in tables.read().items()} == {"a": 1, "b": 2}
    tables.replace({"a": one(7)})
    assert {n: t.count() for n, t in tables.read().items()} == {"a": 7, "b": 2}
    with pytest.raises(ConflictError):
        Manifests(spark, str(tmp_path)).commit(state, {"tables": {}})


def test_rating_runs(spark):
    rows = [(1, 0, None), (1, 1, "late"), (2, 3, "first"), (2, 4, "second"), (3, 0, None)]
    got = pull_in.rating_runs(spark.createDataFrame(rows, "run int, chunk_no int, reason string"), "run").collect()
    assert {r.run: (r.chunks, r.failed, r.outcome, r.error) for r in got} == {
        1: (2, 1, "partial", None), 2: (2, 2, "error", "first"), 3: (1, 0, "rated", None),
    }
