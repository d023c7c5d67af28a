"""Funnel, board and activity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import testviews as V
from .. import vocab
from ..functions.dates import age_label
from ..operators import funnel as O
from ..operators import lineage, outreach
from .registry import iso, query, sql_iso, with_views

_STATUSES = (
    "(VALUES (0, 'sourced'), (1, 'tailored'), (2, 'applied'), (3, 'outreach'), (4, 'replied'), "
    "(5, 'interview'), (6, 'offer'), (7, 'rejected')) AS s(stage, status)"
)
_NOW = "2024-02-01 12:00:00"
_COUNTS = f"SELECT s.stage, s.status, coalesce(c.n, 0) AS n FROM {_STATUSES} LEFT JOIN (SELECT status, count(*) AS n FROM apps GROUP BY status) c USING (status)"
_REACH = """
  (SELECT 0 AS stage, 'In pipeline' AS label, count(*) AS n FROM apps
   UNION ALL SELECT 1, 'Applied', count(applied_at) FROM apps
   UNION ALL SELECT 2, 'Replied', count(replied_at) FROM apps
   UNION ALL SELECT 3, 'Interview', count(interview_at) FROM apps
   UNION ALL SELECT 4, 'Offer', count(offered_at) FROM apps)"""


def _now():
    return F.lit(_NOW).cast("timestamp")


@query("status_counts", with_views("ev apps", _COUNTS))
def status_counts(spark, sf):
    return O.status_counts(V.applications(spark, sf))


@query("occupied_statuses", with_views("ev apps", f"SELECT * FROM ({_COUNTS}) WHERE n > 0"))
def occupied_statuses(spark, sf):
    return O.occupied_statuses(V.applications(spark, sf))


@query("milestone_reach", with_views("ev apps", f"SELECT * FROM {_REACH}"))
def milestone_reach(spark, sf):
    return O.milestone_reach(V.applications(spark, sf))


@query(
    "funnel_conversions",
    with_views(
        "ev apps",
        f"""SELECT b.stage, a.label AS from_label, b.label AS to_label, b.n,
              CASE WHEN a.n > 0 AND b.n <= a.n THEN round(b.n / a.n, 9) END AS rate
            FROM {_REACH} a JOIN {_REACH} b ON b.stage = a.stage + 1""",
    ),
)
def funnel_conversions(spark, sf):
    return O.funnel_conversions(V.applications(spark, sf)).withColumn("rate", F.round("rate", 9))


@query(
    "funnel_cube",
    with_views(
        "ev apps",
        """SELECT source, fit_tier, version_id, grouping(source, fit_tier, version_id) AS level, count(*) AS in_pipeline,
             count(applied_at) AS applied, count(replied_at) AS replied, count(interview_at) AS interview,
             count(offered_at) AS offer
           FROM apps GROUP BY CUBE (source, fit_tier, version_id)""",
    ),
)
def funnel_cube(spark, sf):
    return O.funnel_cube(V.applications(spark, sf), "source", "fit_tier", "version_id")


@query(
    "refused_statuses",
    with_views(
        "ev",
        f"""SELECT seq, status, '"' || coalesce(status, '') || '" is not a pipeline status. Legal values: {", ".join(vocab.APPLICATION_STATUSES)}.' AS reason
            FROM (SELECT seq, CASE WHEN seq % 5 = 0 THEN upper(status) WHEN seq % 7 = 0 THEN NULL ELSE status END AS status FROM ev)
            WHERE status IS NULL OR status NOT IN ({", ".join(repr(v) for v in vocab.APPLICATION_STATUSES)})""",
    ),
)
def refused_statuses(spark, sf):
    """Some events come with a status in capitals, some without one."""
    seq = F.col("seq")
    status = F.when(seq % 5 == 0, F.upper("status")).when(seq % 7 != 0, F.col("status"))
    return O.valid_events(V.status_events(spark, sf).withColumn("status", status))[1].select("seq", "status", "reason")


@query(
    "refused_tiers",
    f"""SELECT doc_id, tier, '"' || coalesce(tier, '') || '" is not a fit tier. Legal values: {", ".join(vocab.FIT_TIERS)}.' AS reason
        FROM (SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'strong' WHEN quality = 1 THEN 'Possible' WHEN doc_id % 3 = 0 THEN 'reach' END AS tier FROM labels)
        WHERE tier IS NULL OR tier NOT IN ({", ".join(repr(v) for v in vocab.FIT_TIERS)})""",
)
def refused_tiers(spark, sf):
    good = F.col("quality") == 1
    tier = F.when(good & (F.col("toxic") == 0), "strong").when(good, "Possible").when(F.col("doc_id") % 3 == 0, "reach")
    return O.valid_tiers(V.table(spark, sf, "labels").select("doc_id", tier.alias("tier")))[1]


@query(
    "application_history",
    with_views(
        "ev apps",
        "SELECT application_id, status, "
        + ", ".join(
            f"{sql_iso(c)} AS {c}"
            for c in ("applied_at", "replied_at", "interview_at", "offered_at", "decided_at", "created_at", "updated_at")
        )
        + " FROM apps",
    ),
)
def application_history(spark, sf):
    folded = O.fold_status(V.status_events(spark, sf))
    return folded.select("application_id", "status", *[iso(c).alias(c) for c in folded.columns if c.endswith("_at")])


@query(
    "forward_only_status",
    with_views(
        "ev",
        """SELECT application_id,
             CASE WHEN adv IS NOT NULL AND (set_at IS NULL OR adv > set_at)
                   AND coalesce(st, 'sourced') IN ('sourced', 'tailored', 'applied')
                  THEN 'outreach' ELSE coalesce(st, 'sourced') END AS status
           FROM (SELECT application_id,
               max_by(status, (event_at, seq)) FILTER (WHERE status <> 'outreach') AS st,
               max((event_at, seq)) FILTER (WHERE status <> 'outreach') AS set_at,
               max((event_at, seq)) FILTER (WHERE status = 'outreach') AS adv
             FROM ev GROUP BY application_id)""",
    ),
)
def forward_only_status(spark, sf):
    return O.fold_forward_only(V.status_events(spark, sf))


@query(
    "offer_backfill",
    with_views(
        "ev apps",
        f"""SELECT application_id, {sql_iso("coalesce(decided_at, updated_at)")} AS offered_at
            FROM apps WHERE status = 'offer'""",
    ),
)
def offer_backfill(spark, sf):
    """Offers stored before the offer time existed."""
    old = V.applications(spark, sf).withColumn("offered_at", F.lit(None).cast("timestamp"))
    return O.backfill_offered(old).where(F.col("offered_at").isNotNull()).select(
        "application_id", iso("offered_at").alias("offered_at")
    )


@query(
    "recent_activity",
    with_views(
        "ev apps jobs",
        f"""SELECT application_id, company, title, status, {sql_iso('updated_at')} AS updated_at
            FROM apps JOIN jobs USING (job_id) ORDER BY apps.updated_at DESC, application_id DESC LIMIT 8""",
    ),
)
def recent_activity(spark, sf):
    return O.recent_activity(V.applications(spark, sf), V.jobs(spark, sf)).withColumn("updated_at", iso("updated_at"))


@query(
    "board_cards",
    with_views(
        "ev apps jobs versions",
        f"""SELECT application_id, status, company, title, location, fit_tier, label AS resume_label,
              greatest(0, CAST(floor((epoch_ms(TIMESTAMP '{_NOW}') - epoch_ms(updated_at)) / 86400000.0) AS INT)) AS days_in_stage
            FROM apps JOIN jobs USING (job_id) LEFT JOIN versions USING (version_id)""",
    ),
)
def board_cards(spark, sf):
    return O.board_cards(V.applications(spark, sf), V.jobs(spark, sf), V.versions(spark, sf), _now()).drop("updated_at")


@query(
    "application_detail",
    with_views(
        "ev apps jobs versions",
        """SELECT application_id, status, company, title, label AS resume_label, 'Resume ' || resume_id AS resume_name
           FROM apps LEFT JOIN jobs USING (job_id) LEFT JOIN versions USING (version_id)""",
    ),
)
def application_detail(spark, sf):
    versions = V.versions(spark, sf)
    resumes = versions.select("resume_id").distinct().withColumn(
        "name", F.concat(F.lit("Resume "), F.col("resume_id").cast("string"))
    )
    return O.application_detail(V.applications(spark, sf), V.jobs(spark, sf), versions, resumes).select(
        "application_id", "status", "company", "title", "resume_label", "resume_name"
    )


@query(
    "activity_ages",
    with_views(
        "ev apps",
        f"""SELECT application_id,
              CASE WHEN m < 60 THEN greatest(1, m) || 'm ago' WHEN h < 24 THEN h || 'h ago'
                   ELSE CAST(floor(h / 24.0 + 0.5) AS BIGINT) || 'd ago' END AS age
            FROM (SELECT application_id, m, CAST(floor(m / 60.0 + 0.5) AS BIGINT) AS h
                  FROM (SELECT application_id,
                          CAST(floor((epoch_ms(TIMESTAMP '{_NOW}') - epoch_ms(updated_at)) / 60000.0 + 0.5) AS BIGINT) AS m
                        FROM apps))""",
    ),
)
def activity_ages(spark, sf):
    return V.applications(spark, sf).select("application_id", age_label(F.col("updated_at"), _now()).alias("age"))


@query(
    "windowed_funnel",
    with_views(
        "ev",
        f"""SELECT {sql_iso("date_trunc('day', event_at)")} AS window_start, status, count(*) AS n
            FROM ev GROUP BY date_trunc('day', event_at), status""",
    ),
)
def windowed_funnel(spark, sf):
    return O.windowed_funnel(V.status_events(spark, sf), "1 day").select(
        iso("window_start").alias("window_start"), "status", "n"
    )


@query(
    "sliding_funnel",
    with_views(
        "ev",
        f"""SELECT {sql_iso("w")} AS window_start, status, count(*) AS n
            FROM (SELECT status, time_bucket(INTERVAL 12 HOURS, event_at) - to_hours(12 * o) AS w
                  FROM ev, (VALUES (0), (1)) AS t(o)) GROUP BY w, status""",
    ),
)
def sliding_funnel(spark, sf):
    return O.windowed_funnel(V.status_events(spark, sf), "24 hours", "12 hours").select(
        iso("window_start").alias("window_start"), "status", "n"
    )


@query(
    "activity_sessions",
    with_views(
        "ev",
        f"""SELECT application_id, session, {sql_iso('min(event_at)')} AS started_at,
              {sql_iso('max(event_at)')} AS ended_at, count(*) AS events
            FROM (SELECT *, sum(st) OVER (PARTITION BY application_id ORDER BY event_at, seq) AS session
                  FROM (SELECT *, CASE WHEN lag(event_at) OVER w IS NULL
                                 OR event_at - lag(event_at) OVER w >= INTERVAL 360 MINUTES THEN 1 ELSE 0 END AS st
                        FROM ev WINDOW w AS (PARTITION BY application_id ORDER BY event_at, seq)))
            GROUP BY application_id, session""",
    ),
)
def activity_sessions(spark, sf):
    return O.activity_sessions(V.status_events(spark, sf), 360).select(
        "application_id", "session", iso("started_at").alias("started_at"), iso("ended_at").alias("ended_at"), "events"
    )


@query(
    "send_claims",
    """SELECT user_id AS step_id, event_id AS claim_id,
         CASE WHEN event_id = f THEN 'sent' WHEN ok THEN 'already-sent' ELSE 'unconfirmed' END AS outcome
       FROM (SELECT *, first_value(event_id) OVER w AS f, first_value(event_type <> 'error') OVER w AS ok
             FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""",
)
def send_claims(spark, sf):
    claims = V.table(spark, sf, "events").select(
        F.col("user_id").alias("step_id"), F.col("event_id").alias("claim_id"),
        F.col("ts").alias("claimed_at"), (F.col("event_type") != "error").alias("confirmed"),
    )
    return outreach.send_claims(claims).select("step_id", "claim_id", "outcome")


# --- versions and pins ------------------------------------------------------


@query(
    "version_tree",
    """WITH RECURSIVE v AS (
         SELECT doc_id AS version_id,
           CASE WHEN doc_id % 100 = 0 THEN NULL ELSE (doc_id // 100) * 100 + (doc_id % 100) // 2 END AS parent_id,
           doc_id // 100 AS resume_id, (doc_id * 13) % 29 AS h FROM documents),
       t AS (
         SELECT version_id, resume_id, 0 AS depth, [(h, version_id)] AS p FROM v WHERE parent_id IS NULL
         UNION ALL
         SELECT v.version_id, v.resume_id, t.depth + 1, list_append(t.p, (v.h, v.version_id))
         FROM t JOIN v ON v.parent_id = t.version_id)
       SELECT resume_id, version_id, depth, row_number() OVER (PARTITION BY resume_id ORDER BY p) - 1 AS position FROM t""",
)
def version_tree(spark, sf):
    versions = V.versions(spark, sf).withColumn("day", F.to_date("created_at")).withColumn(
        "hour_block", F.date_trunc("hour", F.col("created_at"))
    )
    return lineage.version_tree(versions, ["day", "hour_block"])


@query(
    "latest_versions",
    with_views("versions", "SELECT resume_id, max_by(version_id, (created_at, version_id)) AS version_id, count(*) AS versions FROM versions GROUP BY resume_id"),
)
def latest_versions(spark, sf):
    return lineage.latest_version(V.versions(spark, sf))


@query(
    "child_versions",
    with_views("versions", "SELECT resume_id, count(*) AS versions, count(parent_id) AS tailored FROM versions GROUP BY resume_id"),
)
def child_versions(spark, sf):
    return lineage.child_versions(V.versions(spark, sf))


@query(
    "pinned_counts",
    with_views(
        "ev apps versions",
        """SELECT r.resume_id, coalesce(n, 0) AS applications FROM (SELECT DISTINCT resume_id FROM versions) r
           LEFT JOIN (SELECT resume_id, count(*) AS n FROM apps JOIN versions USING (version_id) GROUP BY resume_id) USING (resume_id)""",
    ),
)
def pinned_counts(spark, sf):
    versions = V.versions(spark, sf)
    return lineage.pinned_counts(versions.select("resume_id").distinct(), versions, V.applications(spark, sf))


def _shelf(spark, sf):
    """Resumes with every third one archived."""
    r = F.col("resume_id")
    return V.versions(spark, sf).groupBy("resume_id").agg(F.max("created_at").alias("updated_at")).withColumn(
        "archived_at", F.when(r % 3 == 0, F.col("updated_at"))
    )


@query(
    "shelf_counts",
    with_views("versions", "SELECT count(*) FILTER (WHERE resume_id % 3 <> 0) AS live, count(*) FILTER (WHERE resume_id % 3 = 0) AS archived FROM (SELECT DISTINCT resume_id FROM versions)"),
)
def shelf_counts(spark, sf):
    return lineage.shelf_counts(_shelf(spark, sf))


@query(
    "live_shelf",
    with_views("versions", f"SELECT resume_id, {sql_iso('max(created_at)')} AS updated_at FROM versions WHERE resume_id % 3 <> 0 GROUP BY resume_id"),
)
def live_shelf(spark, sf):
    return lineage.shelf(_shelf(spark, sf)).select("resume_id", iso("updated_at").alias("updated_at"))


@query(
    "archived_shelf",
    with_views("versions", f"SELECT resume_id, {sql_iso('max(created_at)')} AS archived_at FROM versions WHERE resume_id % 3 = 0 GROUP BY resume_id"),
)
def archived_shelf(spark, sf):
    return lineage.shelf(_shelf(spark, sf), archived=True).select("resume_id", iso("archived_at").alias("archived_at"))


@query(
    "source_documents",
    with_views(
        "ev apps versions",
        """, r AS (SELECT max_by(resume_id, (u, resume_id)) AS resume_id FROM (SELECT resume_id, max(created_at) AS u FROM versions WHERE resume_id % 3 <> 0 GROUP BY resume_id)),
           f AS (SELECT max_by(version_id, (created_at, version_id)) AS vid FROM versions JOIN r USING (resume_id))
           SELECT application_id, CASE WHEN version_id % 7 <> 0 THEN version_id
                    ELSE (SELECT CASE WHEN vid % 7 <> 0 THEN vid END FROM f) END AS version_id,
             coalesce(version_id % 7 <> 0, false) AS pinned
           FROM apps""",
    ),
)
def source_documents(spark, sf):
    """Every seventh version is unreadable."""
    versions = V.versions(spark, sf).withColumn("readable", F.col("version_id") % 7 != 0)
    return lineage.source_documents(V.applications(spark, sf), versions, _shelf(spark, sf))
