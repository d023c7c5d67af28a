"""The state folds run as streams over the event table, to the same rows as in batch."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import testviews as V
from ..session import prepare, shared_folder
from ..streaming import alerts, folds, joblog
from .registry import REGISTRY, iso, query, sql_iso, with_views


def _stream(spark, sf, name: str):
    """A table as a file stream, times read as UTC."""
    schema = prepare(spark).read.parquet(f"{sf}/{name}.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)
    for field in schema.fields:
        if field.dataType.typeName() == "timestamp_ntz":
            rows = rows.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return rows


def _folder(spark):
    return f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"


def _run(spark, stream, keys, mode="update"):
    """Run to the end of the input in a new folder of the shared checkpoint folder."""
    return folds.latest(folds.run_available(stream, mode, _folder(spark)), keys)


def _appended(spark, stream):
    """The rows an append-mode stream has given by the end of the input."""
    return folds.run_available(stream, "append", _folder(spark)).drop("batch")


@query("streamed_status", REGISTRY["application_history"][1])
def streamed_status(spark, sf):
    folded = _run(spark, folds.status_stream(V.status_of(_stream(spark, sf, "events"))), ["application_id"])
    return folded.select("application_id", "status", *[iso(c).alias(c) for c in folded.columns if c.endswith("_at")])


@query("streamed_halts", REGISTRY["halted_steps"][1])
def streamed_halts(spark, sf):
    """Replies arrive as a stream; the steps they halt are looked up."""
    steps = V.steps(spark, sf)
    items = _stream(spark, sf, "lineitem").where(
        (F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1) & (F.col("l_linestatus") == "F")
    )
    owners = V.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_custkey") % 6 != 0, F.col("o_custkey")).alias("contact_id")
    )
    replies = items.join(owners, "l_orderkey").select(
        F.col("l_orderkey").alias("application_id"), "contact_id", F.col("l_linenumber").alias("sequence_step")
    )
    first = _run(spark, folds.first_replies(replies), ["__seq"])
    return folds.halts_for(first, steps).select("application_id", "contact_id", "sequence_step", "l_partkey", "l_suppkey")


@query("streamed_claims", "SELECT user_id AS step_id, min_by(event_id, (ts, event_id)) AS claim_id FROM events GROUP BY user_id")
def streamed_claims(spark, sf):
    claims = _stream(spark, sf, "events").select(
        F.col("user_id").alias("step_id"), F.col("event_id").alias("claim_id"), F.col("ts").alias("claimed_at")
    )
    return _run(spark, folds.claim_winners(claims), ["step_id"])


@query("streamed_windows", REGISTRY["windowed_funnel"][1])
def streamed_windows(spark, sf):
    windows = folds.windowed_funnel(V.status_of(_stream(spark, sf, "events")), "7 days", "1 day")
    found = _run(spark, windows, ["window_start", "window_end", "status"])
    return found.select(iso("window_start").alias("window_start"), "status", "n")


@query(
    "streamed_sessions",
    with_views(
        "ev",
        f"""SELECT application_id, {sql_iso('min(event_at)')} AS started_at, count(*) AS events
            FROM (SELECT *, sum(st) OVER (PARTITION BY application_id ORDER BY event_at, seq) AS session
                  FROM (SELECT *, CASE WHEN event_at - lag(event_at) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS st
                        FROM ev WINDOW w AS (PARTITION BY application_id ORDER BY event_at, seq)))
            GROUP BY application_id, session
            HAVING max(event_at) + INTERVAL 6 HOURS <= (SELECT max(event_at) FROM ev) - INTERVAL 1 HOUR""",
    ),
)
def streamed_sessions(spark, sf):
    """Sessions that can no longer grow: their pause is over, an hour of lateness included."""
    found = _appended(spark, folds.sessions(V.status_of(_stream(spark, sf, "events")), "1 hour", "6 hours"))
    return found.select("application_id", iso("started_at").alias("started_at"), "events")


@query("streamed_claims_within", "SELECT DISTINCT event_id // 3 AS step_id FROM events")
def streamed_claims_within(spark, sf):
    """One claim per step among retries of at most an hour; which of them arrives first is open."""
    claims = _stream(spark, sf, "events").select(
        F.floor(F.col("event_id") / 3).alias("step_id"), F.col("event_id").alias("claim_id"), F.col("ts").alias("claimed_at")
    )
    return _appended(spark, folds.claims_within(claims, "1 hour")).select("step_id")


@query(
    "streamed_replies",
    f"""SELECT m.event_id AS message_id, s.event_id AS send_id, {sql_iso('m.ts')} AS received_at
        FROM events m JOIN events s ON m.event_id // 8 = s.event_id // 8
          AND m.ts >= s.ts AND m.ts <= s.ts + INTERVAL 10 MINUTES
        WHERE s.event_type = 'click' AND m.event_type <> 'click' AND m.event_id % 5 <> 0""",
)
def streamed_replies(spark, sf):
    """Clicks are sends, all other events messages of the same thread; every fifth is our own."""
    thread = F.floor(F.col("event_id") / 8).alias("thread_ref")
    click = F.col("event_type") == "click"
    own = F.when(F.col("event_id") % 5 == 0, "Me@mail.example").otherwise("you@mail.example")
    messages = _stream(spark, sf, "events").where(~click).select(
        thread, own.alias("sender"), F.col("event_id").alias("message_id"), F.col("ts").alias("received_at")
    )
    sends = _stream(spark, sf, "events").where(click).select(thread, F.col("event_id").alias("send_id"), F.col("ts").alias("sent_at"))
    found = _appended(spark, folds.thread_replies(messages, sends, "me@mail.example", "10 minutes"))
    return found.select("message_id", "send_id", iso("received_at").alias("received_at"))


@query(
    "streamed_due_alerts",
    f"""WITH st AS (SELECT event_id // 4 AS seq, event_id % 4 AS n, ts AS created_at, ts AS changed_at, event_id % 3 AS day_offset,
             CASE WHEN event_type IN ('view', 'click') THEN ts + INTERVAL 1 HOUR END AS sent_at FROM events),
         cum AS (SELECT *, sum(day_offset) OVER w AS s, min(created_at) OVER (PARTITION BY seq) AS anchor,
             max(CASE WHEN sent_at IS NOT NULL THEN n END) OVER (PARTITION BY seq ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ln
           FROM st WINDOW w AS (PARTITION BY seq ORDER BY n)),
         due AS (SELECT c.seq, c.n, c.sent_at, coalesce(l.sent_at, c.anchor) + to_days(CAST(c.s - coalesce(l.s, 0) AS INT)) AS due_at
           FROM cum c LEFT JOIN cum l ON l.seq = c.seq AND l.n = c.ln)
       SELECT CAST(seq AS VARCHAR) AS seq, CAST(n AS INT) AS sequence_step, {sql_iso('due_at')} AS due_at
       FROM due WHERE sent_at IS NULL AND n = (SELECT min(n) FROM due d WHERE d.seq = due.seq AND d.sent_at IS NULL)
         AND due_at < (SELECT max(changed_at) FROM st) - INTERVAL 1 HOUR""",
)
def streamed_due_alerts(spark, sf):
    """The next unsent step of each sequence, once event time has passed its due time."""
    event = F.col("event_id")
    sent = F.col("event_type").isin("view", "click")
    changes = _stream(spark, sf, "events").select(
        F.floor(event / 4).cast("string").alias("seq"), (event % 4).cast("int").alias("sequence_step"), (event % 3).cast("int").alias("day_offset"),
        F.col("ts").alias("created_at"), F.when(sent, F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("sent_at"),
        F.when(sent, "sent").otherwise("scheduled").alias("status"), F.col("ts").alias("changed_at"),
    )
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        found = _appended(spark, alerts.due_alerts(changes, "1 hour"))
    finally:
        spark.conf.set(store, before)
    return found.withColumn("due_at", iso("due_at"))


@query(
    "incremental_jobs",
    with_views(
        "listings",
        """, bl AS (SELECT *, pos % 3 AS batch FROM listings UNION ALL SELECT *, 3 FROM listings WHERE pos % 3 = 0),
        n AS (SELECT *, (batch, adapter_rank, pos) AS node, batch || ':' || external_id AS xid,
          CASE WHEN url IS NOT NULL THEN batch || ':jobs.example.com/p/' || (pos - pos % 5) || '?id=1|' || lower(title) || '|' || lower(company) END AS b FROM bl),
        m AS (SELECT *, min(node) OVER (PARTITION BY xid) AS fa, CASE WHEN b IS NOT NULL THEN min(node) OVER (PARTITION BY b) END AS fb FROM n),
        p AS (SELECT *, CASE WHEN fa < node THEN fa WHEN fb < node THEN fb END AS ptr FROM m),
        r AS (SELECT node, node AS root FROM p WHERE ptr IS NULL UNION ALL SELECT p.node, r.root FROM r JOIN p ON p.ptr = r.node),
        g AS (SELECT root, min_by(description, p.node) FILTER (WHERE coalesce(description, '') <> '') AS description FROM p JOIN r USING (node) GROUP BY root),
        kept AS (SELECT node, title, company, location, url, CASE WHEN url IS NOT NULL THEN 'https://jobs.example.com/p/' || (pos - pos % 5) || '?id=1' END AS cu,
            coalesce(nullif(trim(g.description), ''),
              'No description was returned by ' || source || ' for this listing.' || coalesce(' Open ' || url || ' for the full posting.', '')) AS body
          FROM g JOIN p ON g.root = p.node),
        fo AS (SELECT cu, min_by(title, node) AS title, min_by(company, node) AS company, max_by(location, node) AS location,
            max_by(body, (length(body), -node[1], -node[2], -node[3])) FILTER (WHERE NOT starts_with(body, 'No description was returned by')) AS real,
            min_by(body, node) FILTER (WHERE starts_with(body, 'No description was returned by')) AS ph
          FROM kept GROUP BY cu, CASE WHEN cu IS NULL THEN title END, CASE WHEN cu IS NULL THEN company END, CASE WHEN cu IS NULL THEN location END)
        SELECT cu AS url, title, company, location, md5(coalesce(real, ph)) AS jd_md5 FROM fo""",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def incremental_jobs(spark, sf):
    """Listings arrive in three batches, one of them twice, and the first once more as a new batch."""
    listings = V.listings(spark, sf)
    log = joblog.JobLog(spark, _folder(spark))
    for number, part in ((0, 0), (1, 1), (1, 1), (2, 2), (3, 0)):
        log.append(listings.where(F.col("pos") % 3 == part), number, ["adapter_rank", "pos"])
    return log.jobs().select("url", "title", "company", "location", F.md5("jd_text").alias("jd_md5"))
