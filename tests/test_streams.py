"""Streams give the rows their batch forms give."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Row, functions as F

from jobsieve.operators import funnel
from jobsieve.sources import manifest
from jobsieve.streaming import alerts, folds, joblog


def _files(spark, folder, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{i}")
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    )


def t(text):
    return datetime.fromisoformat(text)


def test_status_stream_accepts_late_events(spark, tmp_path):
    schema = "application_id int, seq int, event_at timestamp, status string"
    batches = [[(1, 2, t("2024-01-05"), "applied")], [(1, 1, t("2024-01-01"), "applied"), (2, 3, t("2024-01-02"), "offer")]]
    stream = _files(spark, tmp_path, batches, schema)
    got = folds.latest(folds.run_available(folds.status_stream(stream), "update", str(tmp_path)), ["application_id"])
    want = funnel.fold_status(spark.createDataFrame(sum(batches, []), schema))
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_alert_follows_a_late_send(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "seq string, sequence_step int, day_offset int, created_at timestamp, sent_at timestamp, status string, changed_at timestamp"
    day = lambda d: t(f"2024-01-{d:02d}")
    batches = [
        [("a", 1, 0, day(1), None, "scheduled", day(1)), ("a", 2, 4, day(1), None, "scheduled", day(1))],
        [("a", 1, 0, day(1), day(5), "sent", day(5))],
        [("b", 1, 0, day(20), None, "scheduled", day(20))],
        [("a", 2, 4, day(1), None, "scheduled", day(20))],  # redelivered after its alert
        [("b", 1, 0, day(20), day(21), "sent", day(28))],
    ]
    try:
        stream = alerts.due_alerts(_files(spark, tmp_path, batches, schema), "1 hour")
        rows = folds.run_available(stream, "append", str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert [(r["seq"], r["sequence_step"], r["due_at"]) for r in rows] == [("a", 2, day(9))]


def test_a_visit_reads_and_writes_a_sequence_once():
    calls = []

    class Store:
        kept = None

        def get(self):
            calls.append("get")
            return self.kept

        def update(self, value):
            calls.append("update")
            self.kept = value

    class Handle:
        getValueState = staticmethod(lambda *_: Store())
        registerTimer = staticmethod(lambda at: calls.append(f"register {at}"))
        deleteTimer = staticmethod(lambda at: calls.append(f"delete {at}"))

    day = 86_400_000_000
    step = lambda n, sent=None: Row(sequence_step=n, day_offset=2, created_us=0, sent_us=sent, status="sent" if sent else "scheduled")
    alert = alerts.DueAlerts()
    alert.init(Handle)
    list(alert.handleInputRows(("a",), [step(n) for n in range(1, 50)], None))
    assert calls == ["get", f"register {2 * day // 1000}", "update"]
    calls.clear()
    list(alert.handleInputRows(("a",), [step(1, sent=day)], None))
    assert calls == ["get", f"delete {2 * day // 1000}", f"register {3 * day // 1000}", "update"]
    assert [tuple(r) for r in alert.handleExpiredTimer(("a",), None, None)] == [("a", 2, 3 * day)]
    calls.clear()
    list(alert.handleInputRows(("a",), [step(2)], None))  # delivered again
    assert calls == ["get", "update"]


def test_incremental_merge_is_idempotent(spark, tmp_path):
    step = joblog.incremental_merge(str(tmp_path / "jobs"), ["adapter_rank", "pos"])
    schema = "adapter_rank int, pos int, external_id string, url string, title string, company string, location string, description string, source string"
    one = spark.createDataFrame([(0, 0, "a", "https://x.io/1?ref=q", "T", "C", None, None, "s"), (0, 1, "b", None, "U", "C", "Oslo", "body", "s")], schema)
    two = spark.createDataFrame([(0, 2, "c", "https://x.io/1", "T2", "C", "Rome", "real body", "s")], schema)
    for batch_id, batch in enumerate([one, two, two]):
        step(batch, batch_id)
    rows = {r["title"]: (r["location"], r["jd_text"]) for r in joblog.JobLog(spark, str(tmp_path / "jobs")).jobs().collect()}
    assert rows == {"T": ("Rome", "real body"), "U": ("Oslo", "body")}


def test_windows_and_sessions(spark, tmp_path):
    schema = "application_id int, seq int, event_at timestamp, status string"
    rows = [(1, 1, t("2024-01-01T00:10"), "applied"), (1, 2, t("2024-01-01T00:40"), "offer"), (1, 3, t("2024-01-01T09:00"), "offer"), (2, 4, t("2024-01-03"), "applied")]
    stream = _files(spark, tmp_path, [rows, [(3, 5, t("2024-01-09"), "applied")]], schema)
    found = folds.run_available(folds.sessions(stream, "1 hour", "1 hour"), "append", str(tmp_path))
    got = sorted((r["application_id"], r["events"]) for r in found.collect())
    assert got == [(1, 1), (1, 2), (2, 1)]


def test_thread_replies(spark, tmp_path):
    sent = spark.createDataFrame([("t1", 1, 9, 1, t("2024-01-01"))], "thread_ref string, application_id int, contact_id int, sequence_step int, sent_at timestamp")
    mail = spark.createDataFrame(
        [("t1", "me@x.io", t("2024-01-02")), ("t1", "you@y.io", t("2024-01-03")), ("t2", "you@y.io", t("2024-01-03")), ("t1", "you@y.io", t("2023-12-30"))],
        "thread_ref string, sender string, received_at timestamp",
    )
    got = folds.thread_replies(mail, sent, "ME@x.io", "30 days").collect()
    assert [(r["application_id"], r["received_at"]) for r in got] == [(1, t("2024-01-03"))]


LISTING = "adapter_rank int, pos int, external_id string, url string, title string, company string, location string, description string, source string"


def _random_listings(rng, n, start):
    out = []
    for i in range(n):
        url = rng.choice([None, f"https://x.io/{rng.randrange(30)}?utm_source=a"])
        text = rng.choice([None, "", "x" * rng.randrange(1, 9), f"{'y' * rng.randrange(1, 9)}"])
        out.append((0, start + i, f"e{start + i}", url, rng.choice("TU"), rng.choice("CD"), rng.choice([None, "Oslo", "Rome"]), text, "s"))
    return out


def test_log_equals_one_merge_and_rewrites_in_proportion(spark, tmp_path):
    import random

    from jobsieve.operators import merge

    rng = random.Random(2)
    log = joblog.JobLog(spark, str(tmp_path / "log"))
    batches = [_random_listings(rng, 25, 100 * b) for b in range(7)]
    for b, rows in enumerate(batches):
        df = spark.createDataFrame(rows, LISTING).coalesce(1)
        log.append(df, b, ["adapter_rank", "pos"])
        log.append(df, b, ["adapter_rank", "pos"])  # delivered again
    assert log.status()["last"] == 6 and len(log.status()["segments"]) <= 3
    # every row was rewritten about log2(7) times, not once per batch
    assert 0 < log.status()["rewritten"] < 2.8 * log.status()["appended"]
    everything = spark.createDataFrame(sum(batches, []), LISTING)
    stored = spark.createDataFrame([], "job_id string, url string, title string, company string, location string, jd_text string, source string, scraped_at timestamp")
    want = merge.merge_jobs(stored, everything, ["adapter_rank", "pos"], F.current_timestamp())
    columns = ["url", "title", "company", "location", "jd_text", "source"]
    rows = log.jobs().collect()
    assert sorted(str([r[c] for c in columns]) for r in rows) == sorted(str([r[c] for c in columns]) for r in want.collect())
    assert len({r.job_id for r in rows}) == len(rows)


def test_log_ignores_an_unfinished_commit_and_refuses_two(spark, tmp_path):
    import pytest

    log = joblog.JobLog(spark, str(tmp_path / "log"))
    assert log.jobs().count() == 0
    one = spark.createDataFrame([(0, 0, "a", "https://x.io/1", "T", "C", None, None, "s")], LISTING)
    log.append(one, 0, ["adapter_rank", "pos"])
    (tmp_path / "log" / "manifests" / "000000000002.json").write_text('{"version": 2, "segm')
    assert log.status()["version"] == 1 and log.jobs().count() == 1
    log.append(one, 1, ["adapter_rank", "pos"])
    assert log.status()["version"] == 3 and log.status()["last"] == 1
    with pytest.raises(manifest.ConflictError):
        log.manifests.commit({"version": 1}, {})
