"""Sequence, queue and contact queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import testviews as V
from ..functions import dates as D
from ..functions import fields as R
from ..operators import funnel, merge
from ..operators import outreach as O
from ..session import cut
from .registry import iso, query, sql_iso, with_views

_NOW = "2000-06-01 00:00:00"

# Due times by the same closed form, over plain windows.
_SCHEDULED = """
  , s1 AS (SELECT *, sum(day_offset) OVER w AS cum,
             CASE WHEN sent_at IS NOT NULL THEN {'t': sent_at, 's': sum(day_offset) OVER w} END AS sent_mark,
             min(created_at) OVER (PARTITION BY application_id, contact_id) AS anchor,
             row_number() OVER w AS rn
           FROM steps WINDOW w AS (PARTITION BY application_id, contact_id
             ORDER BY sequence_step, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate
             ROWS UNBOUNDED PRECEDING)),
    s2 AS (SELECT *, last_value(sent_mark IGNORE NULLS) OVER (PARTITION BY application_id, contact_id ORDER BY rn
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM s1),
    sched AS (SELECT *, CAST(cum AS BIGINT) AS cumulative_offset,
             coalesce(l.t, anchor) + to_days(CAST(cum - coalesce(l.s, 0) AS INT)) AS due_at FROM s2)"""

_FIRST = f"""{_SCHEDULED},
    first AS (SELECT application_id, contact_id,
        min_by(sequence_step, rn) FILTER (WHERE status = 'scheduled') AS next_step,
        min_by(due_at, rn) FILTER (WHERE status = 'scheduled') AS due_at,
        bool_or(status = 'replied') AS replied,
        min_by(coalesce(sent_at, created_at), rn) FILTER (WHERE status = 'replied') AS replied_at
      FROM sched GROUP BY application_id, contact_id)"""

_QUEUE = f"""{_FIRST},
    q0 AS (SELECT *, CASE WHEN replied THEN 'replied' WHEN due_at <= TIMESTAMP '{_NOW}' THEN 'due'
                        WHEN next_step IS NOT NULL THEN 'active' END AS state FROM first),
    q AS (SELECT application_id, contact_id, state,
        CASE WHEN state = 'due' THEN 'Due today' ELSE 'Active' END AS group_label,
        CASE WHEN state <> 'replied' THEN next_step END AS next_step,
        CASE WHEN state <> 'replied' THEN {sql_iso('due_at')} END AS due_at,
        CASE state WHEN 'due' THEN 0 WHEN 'active' THEN 1 ELSE 2 END AS group_rank,
        CASE WHEN state = 'replied' THEN -epoch_us(replied_at) ELSE epoch_us(due_at) END AS sort_key
      FROM q0 WHERE state IS NOT NULL)"""


def _now():
    return F.lit(_NOW).cast("timestamp")


def _scheduled(spark, sf):
    # The steps are a join here; the scans read it several times, so it is made once.
    return O.schedule(cut(V.steps(spark, sf)), V.STEP_ORDER, V.STEP_BLOCKS)


def _queue(spark, sf):
    return O.queue(_scheduled(spark, sf), V.STEP_ORDER, _now())


@query(
    "sequence_schedule",
    with_views(
        "steps",
        f"""{_SCHEDULED} SELECT application_id, contact_id, sequence_step, l_partkey, l_suppkey,
              cumulative_offset, {sql_iso('due_at')} AS due_at FROM sched""",
    ),
)
def sequence_schedule(spark, sf):
    return _scheduled(spark, sf).select(
        "application_id", "contact_id", "sequence_step", "l_partkey", "l_suppkey", "cumulative_offset",
        iso("due_at").alias("due_at"),
    )


@query(
    "step_timeline",
    with_views(
        "steps",
        f"""{_SCHEDULED} SELECT application_id, sequence_step, l_partkey, l_suppkey,
              CASE WHEN sent_at IS NOT NULL AND (status = 'scheduled' OR l_partkey % 10 = 0) THEN 'unconfirmed'
                   WHEN l_partkey % 10 = 0 THEN 'scheduled' ELSE status END AS state,
              CASE WHEN cum = 0 THEN 'day 0' ELSE 'day +' || cumulative_offset END AS day FROM sched""",
    ),
)
def step_timeline(spark, sf):
    """One send in ten was claimed and never confirmed."""
    steps = _scheduled(spark, sf).withColumn("status", F.when(F.col("l_partkey") % 10 == 0, "scheduled").otherwise(F.col("status")))
    return O.step_view(steps).select(
        "application_id", "sequence_step", "l_partkey", "l_suppkey", "state", "day"
    )


@query(
    "due_steps",
    with_views(
        "steps",
        f"""{_FIRST} SELECT application_id, contact_id, next_step AS sequence_step, 'scheduled' AS status,
              {sql_iso('due_at')} AS due_at FROM first WHERE due_at <= TIMESTAMP '{_NOW}'""",
    ),
)
def due_steps(spark, sf):
    return O.due_steps(_scheduled(spark, sf), V.STEP_ORDER, _now()).withColumn("due_at", iso("due_at"))


@query(
    "halted_steps",
    with_views(
        "steps",
        """, r AS (SELECT application_id, contact_id, min(sequence_step) AS s FROM steps WHERE status = 'replied' GROUP BY ALL)
           SELECT a.application_id, a.contact_id, a.sequence_step, a.l_partkey, a.l_suppkey
           FROM steps a JOIN r ON a.application_id = r.application_id AND a.contact_id IS NOT DISTINCT FROM r.contact_id
           WHERE a.status = 'scheduled' AND a.sequence_step > r.s""",
    ),
)
def halted_steps(spark, sf):
    return O.halted_steps(V.steps(spark, sf)).select(
        "application_id", "contact_id", "sequence_step", "l_partkey", "l_suppkey"
    )


@query(
    "reply_fold",
    with_views(
        "steps",
        """, r AS (SELECT application_id, contact_id, min(sequence_step) AS s FROM steps WHERE status = 'replied' GROUP BY ALL),
           f AS (SELECT a.sequence_step, CASE WHEN a.status = 'scheduled' AND a.sequence_step > r.s THEN 'halted' ELSE a.status END AS status
                 FROM steps a LEFT JOIN r ON a.application_id = r.application_id AND a.contact_id IS NOT DISTINCT FROM r.contact_id)
           SELECT sequence_step, status, count(*) AS n FROM f GROUP BY ALL""",
    ),
)
def reply_fold(spark, sf):
    return O.fold_replies(V.steps(spark, sf)).groupBy("sequence_step", "status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "replied_applications",
    with_views(
        "ev steps",
        """, al AS (SELECT application_id, seq, event_at, status FROM ev UNION ALL
             SELECT application_id, -sequence_step, CAST(coalesce(sent_at, created_at) AS TIMESTAMP), 'replied' FROM steps WHERE status = 'replied')
           SELECT application_id, max_by(status, (event_at, seq)) AS status, min(CASE WHEN status = 'replied' THEN event_at END) AS replied_at
           FROM al GROUP BY application_id""",
    ),
)
def replied_applications(spark, sf):
    """Applications after their own events and the answers to their steps."""
    replies = O.reply_events(V.steps(spark, sf), F.coalesce("sent_at", "created_at"), -F.col("sequence_step"))
    events = V.status_events(spark, sf).select("application_id", "seq", "event_at", "status").unionByName(replies)
    return funnel.fold_status(events).select("application_id", "status", "replied_at")


@query("outreach_queue", with_views("steps", f"{_QUEUE} SELECT * FROM q"))
def outreach_queue(spark, sf):
    return O.queue_order(_queue(spark, sf)).withColumn("due_at", iso("due_at"))


@query("queue_group_sizes", with_views("steps", f"{_QUEUE} SELECT group_label, count(*) AS n FROM q GROUP BY group_label"))
def queue_group_sizes(spark, sf):
    return O.group_sizes(_queue(spark, sf))


@query(
    "queue_with_context",
    with_views(
        "steps contacts outreach_jobs",
        f"""{_QUEUE} SELECT application_id, q.contact_id, state, coalesce(company, '') AS company, coalesce(title, '') AS title,
              coalesce(name, 'No contact') AS contact_name
            FROM q LEFT JOIN outreach_jobs USING (application_id)
            LEFT JOIN contacts c ON c.application_id = q.application_id AND c.contact_id = q.contact_id""",
    ),
)
def queue_with_context(spark, sf):
    rows = O.with_context(_queue(spark, sf), V.outreach_jobs(spark, sf), V.contacts(spark, sf))
    return rows.select("application_id", "contact_id", "state", "company", "title", "contact_name")


@query(
    "follow_ups_due",
    with_views(
        "steps contacts outreach_jobs",
        f"""{_FIRST}, top AS (SELECT * FROM first WHERE due_at <= TIMESTAMP '{_NOW}' ORDER BY due_at, application_id, contact_id NULLS FIRST LIMIT 8)
            SELECT t.application_id, t.contact_id, next_step AS sequence_step, {sql_iso('due_at')} AS due_at,
              coalesce(company, '') AS company, coalesce(title, '') AS title, coalesce(name, 'No contact') AS contact_name
            FROM top t LEFT JOIN outreach_jobs j USING (application_id)
            LEFT JOIN contacts c ON c.application_id = t.application_id AND c.contact_id = t.contact_id""",
    ),
)
def follow_ups_due(spark, sf):
    due = O.due_steps(_scheduled(spark, sf), V.STEP_ORDER, _now())
    panel = O.follow_ups_due(due, V.outreach_jobs(spark, sf), V.contacts(spark, sf))
    return panel.select(
        "application_id", "contact_id", "sequence_step", iso("due_at").alias("due_at"), "company", "title", "contact_name"
    )


@query(
    "open_sequences",
    with_views(
        "steps contacts",
        f"""{_QUEUE},
            sel AS (SELECT event_id AS selector_id, CASE WHEN event_id % 4 IN (0, 1) THEN event_id * 3 END AS app,
                      CASE WHEN event_id % 4 IN (0, 2) THEN event_id % 1000 END AS con FROM events),
            dealt AS (SELECT application_id, min_by({{'c': contact_id}}, (sequence_step, created_at)) AS d FROM steps GROUP BY application_id),
            fc AS (SELECT application_id, min_by(contact_id, created_at) AS c FROM contacts GROUP BY application_id),
            ow AS (SELECT contact_id, min_by(application_id, (created_at, application_id)) AS o FROM contacts GROUP BY contact_id),
            wr AS (SELECT contact_id, min_by(application_id, (created_at, application_id)) AS w FROM steps WHERE contact_id IS NOT NULL GROUP BY contact_id),
            top AS (SELECT application_id AS a, contact_id AS c FROM q ORDER BY group_rank, sort_key, application_id LIMIT 1),
            res AS (SELECT selector_id,
                      CASE WHEN app IS NOT NULL THEN CASE WHEN app IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 3) THEN app END WHEN con IS NOT NULL THEN coalesce(o, w) ELSE top.a END AS open_application_id,
                      CASE WHEN con IS NOT NULL THEN con
                           WHEN app IS NOT NULL THEN CASE WHEN d IS NOT NULL THEN d.c ELSE fc.c END ELSE top.c END AS oc
                    FROM sel LEFT JOIN dealt ON dealt.application_id = app LEFT JOIN fc ON fc.application_id = app
                    LEFT JOIN ow ON ow.contact_id = con LEFT JOIN wr ON wr.contact_id = con CROSS JOIN top)
            SELECT selector_id, open_application_id, CASE WHEN open_application_id IS NOT NULL THEN oc END AS open_contact_id FROM res""",
    ),
)
def open_sequences(spark, sf):
    """One application in seven is unknown and opens nothing."""
    e = F.col("event_id")
    selectors = V.table(spark, sf, "events").select(
        e.alias("selector_id"),
        F.when((e % 4).isin(0, 1), e * 3).alias("application_id"),
        F.when((e % 4).isin(0, 2), e % 1000).alias("contact_id"),
    )
    known = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("application_id")).where(F.col("application_id") % 7 != 3)
    return O.open_sequence(selectors, known, V.steps(spark, sf), V.contacts(spark, sf), _queue(spark, sf))


_GREET = "CASE WHEN name <> '' THEN 'Hi ' || regexp_extract(name, '^(\\S+)', 1) || ' — ' ELSE '' END"


@query(
    "sequence_templates",
    with_views(
        "contacts outreach_jobs",
        f""", t AS (SELECT c.application_id, c.contact_id, {_GREET} AS g, title, company FROM contacts c JOIN outreach_jobs USING (application_id))
            SELECT application_id, contact_id, 1 AS sequence_step, 0 AS day_offset, title || ' — quick note' AS subject,
              g || 'I''m applying for the ' || title || ' role at ' || company || ' and wanted to reach you directly.' || chr(10) || chr(10)
                || '[Two sentences on the work of yours that lines up with this role.]' || chr(10) || chr(10)
                || 'Would you be open to a short call this week?' AS body, 'scheduled' AS status FROM t
            UNION ALL SELECT application_id, contact_id, 2, 4, 'Re: ' || title || ' — quick follow-up',
              g || 'following up on my note about the ' || title || ' role at ' || company || '. Happy to send anything that would be useful on my end. If this req belongs to someone else, a pointer in their direction is just as welcome.', 'scheduled' FROM t
            UNION ALL SELECT application_id, contact_id, 3, 5, title || ' — closing the loop',
              g || 'last note from me on the ' || title || ' role at ' || company || '. I''ll assume the timing isn''t right and leave it here. If it opens up again later, I''d still be glad to talk.', 'scheduled' FROM t""",
    ),
)
def sequence_templates(spark, sf):
    targets = V.contacts(spark, sf).withColumnRenamed("name", "contact_name").join(
        V.outreach_jobs(spark, sf), "application_id"
    )
    return O.template_steps(targets)


@query(
    "dealt_sequences",
    with_views(
        "steps contacts",
        """, k AS (SELECT DISTINCT application_id, contact_id FROM steps)
           SELECT c.application_id, c.contact_id, n AS sequence_step FROM contacts c, (VALUES (1), (2), (3)) AS v(n)
           WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.application_id = c.application_id AND k.contact_id IS NOT DISTINCT FROM c.contact_id)""",
    ),
)
def dealt_sequences(spark, sf):
    targets = V.contacts(spark, sf).select(
        "application_id", "contact_id", F.col("name").alias("contact_name"), F.lit("t").alias("title"), F.lit("c").alias("company")
    )
    dealt = O.deal_sequences(O.template_steps(targets), V.steps(spark, sf))
    return dealt.select("application_id", "contact_id", "sequence_step")


@query(
    "message_texts",
    with_views(
        "contacts",
        """SELECT application_id, CASE WHEN name <> '' OR email IS NOT NULL THEN 'To: ' || concat_ws(' ', name, '<' || email || '>') || chr(10) ELSE '' END
             || 'Subject: Hello' || chr(10) || chr(10) || 'Body ' || application_id AS message FROM contacts""",
    ),
)
def message_texts(spark, sf):
    body = F.concat(F.lit("Body "), F.col("application_id").cast("string"))
    return V.contacts(spark, sf).select(
        "application_id", R.message_text(F.lit("Hello"), body, F.col("name"), F.col("email")).alias("message")
    )


@query(
    "manual_sends",
    with_views(
        "steps",
        f""", m AS (SELECT user_id AS application_id, max(ts) AS t FROM events GROUP BY user_id)
            SELECT application_id, sequence_step, l_partkey, l_suppkey, CASE WHEN t IS NOT NULL THEN 'sent' ELSE status END AS status,
              {sql_iso('coalesce(t, sent_at)')} AS sent_at FROM steps LEFT JOIN m USING (application_id)""",
    ),
)
def manual_sends(spark, sf):
    """Hand marks per application from the event log."""
    marks = V.table(spark, sf, "events").select(F.col("user_id").alias("application_id"), F.col("ts").alias("marked_at"))
    steps = V.steps(spark, sf).withColumn("thread_ref", F.lit("t"))
    return O.mark_sent(steps, marks, "application_id").select(
        "application_id", "sequence_step", "l_partkey", "l_suppkey", "status", iso("sent_at").alias("sent_at")
    )


# --- contacts ---------------------------------------------------------------

_SIGHTINGS = """
  , s AS (SELECT o_custkey // 4 AS application_id, c_name AS name,
       CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS title,
       CASE WHEN o_orderkey % 4 = 0 THEN c_mktsegment END AS company,
       CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN upper('c' || c_custkey || '@mail.example') ELSE 'c' || c_custkey || '@mail.example' END AS email,
       NULL AS linkedin_url, CASE o_orderkey % 2 WHEN 0 THEN 'apollo' ELSE 'manual' END AS source, o_orderkey AS seq
     FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _sightings(spark, sf):
    o = F.col("o_orderkey")
    joined = V.table(spark, sf, "orders").join(V.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    address = F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@mail.example"))
    return joined.select(
        F.floor(F.col("o_custkey") / 4).alias("application_id"), F.col("c_name").alias("name"),
        F.when(o % 3 == 0, F.col("o_orderpriority")).alias("title"),
        F.when(o % 4 == 0, F.col("c_mktsegment")).alias("company"),
        F.when(F.col("c_custkey") % 5 == 0, F.lit(None).cast("string")).when(o % 2 == 0, F.upper(address)).otherwise(address).alias("email"),
        F.lit(None).cast("string").alias("linkedin_url"),
        F.when(o % 2 == 0, "apollo").otherwise("manual").alias("source"), o.alias("seq"),
    )


@query(
    "contact_merge",
    "WITH x AS (SELECT 1)" + _SIGHTINGS + """
      SELECT application_id, max_by(name, seq) AS name, max_by(title, seq) FILTER (WHERE title IS NOT NULL) AS title,
        max_by(company, seq) FILTER (WHERE company IS NOT NULL) AS company, max_by(email, seq) AS email,
        max_by(source, seq) AS source, min(seq) AS first_seq, count(*) AS sightings
      FROM s WHERE email IS NOT NULL GROUP BY application_id, lower(email)
      UNION ALL SELECT application_id, name, title, company, email, source, seq, 1 FROM s WHERE email IS NULL""",
)
def contact_merge(spark, sf):
    return merge.merge_contacts(_sightings(spark, sf), ["seq"]).drop("linkedin_url")


@query(
    "contact_rejects",
    "WITH x AS (SELECT 1)" + _SIGHTINGS + """
      SELECT seq, CASE WHEN seq % 9 = 0 THEN 'A contact needs a name.'
          WHEN seq % 7 = 0 AND email IS NOT NULL THEN '"' || replace(email, '@', ' at ') || '" does not look like an email address.'
          ELSE 'Unknown contact source "web".' END AS reason
      FROM s WHERE seq % 9 = 0 OR (seq % 7 = 0 AND email IS NOT NULL) OR seq % 5 = 0""",
)
def contact_rejects(spark, sf):
    seq = F.col("seq")
    rows = _sightings(spark, sf).withColumns(
        {
            "name": F.when(seq % 9 == 0, "  ").otherwise(F.col("name")),
            "email": F.when(seq % 7 == 0, F.replace("email", F.lit("@"), F.lit(" at "))).otherwise(F.col("email")),
            "source": F.when(seq % 5 == 0, "web").otherwise(F.col("source")),
        }
    )
    return merge.check_contacts(rows)[1].select("seq", "reason")


@query(
    "contact_sources",
    """SELECT p_type AS raw, CASE WHEN v IN ('apollo', 'linkedin', 'manual', 'brightdata') THEN v
          WHEN contains(v, 'linkedin') THEN 'linkedin' WHEN contains(v, 'brightdata') THEN 'brightdata'
          WHEN contains(v, 'apollo') THEN 'apollo' ELSE 'manual' END AS source, count(*) AS n
       FROM (SELECT p_type, trim(lower(CASE p_partkey % 6 WHEN 0 THEN ' LinkedIn-' || p_type WHEN 1 THEN 'fake-apollo' WHEN 2 THEN 'BrightData ' WHEN 3 THEN '' ELSE p_type END)) AS v FROM part)
       GROUP BY ALL""",
)
def contact_sources(spark, sf):
    k = F.col("p_partkey") % 6
    raw = (
        F.when(k == 0, F.concat(F.lit(" LinkedIn-"), F.col("p_type"))).when(k == 1, "fake-apollo")
        .when(k == 2, "BrightData ").when(k == 3, "").otherwise(F.col("p_type"))
    )
    return V.table(spark, sf, "part").select(F.col("p_type").alias("raw"), R.contact_source(raw).alias("source")).groupBy(
        "raw", "source"
    ).agg(F.count(F.lit(1)).alias("n"))


# --- dates ------------------------------------------------------------------

_SPELT = """
  , d AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m') WHEN 1 THEN strftime(o_orderdate, '%b %Y')
      WHEN 2 THEN strftime(o_orderdate, '%m/%Y') WHEN 3 THEN strftime(o_orderdate, '%Y') ELSE 'Summer ' || o_orderkey END AS t FROM orders)"""


def _spelt(spark, sf):
    o, at = F.col("o_orderkey"), F.col("o_orderdate")
    return V.table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(o % 5 == 0, F.date_format(at, "yyyy-MM")).when(o % 5 == 1, F.date_format(at, "MMM yyyy"))
        .when(o % 5 == 2, F.date_format(at, "MM/yyyy")).when(o % 5 == 3, F.date_format(at, "yyyy"))
        .otherwise(F.concat(F.lit("Summer "), o.cast("string"))).alias("t"),
    )


_SHAPE = r"""CASE WHEN regexp_full_match(t, '\d{4}(-\d{1,2})?') THEN 'iso' WHEN regexp_full_match(t, '[A-Za-z]{3,9}\.?\s+\d{4}') THEN 'month-name'
   WHEN regexp_full_match(t, '\d{1,2}/\d{4}') THEN 'slashed' ELSE 'other' END"""
_MONTH = "(list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower(substr(t, 1, 3))))"


@query("date_shapes", "WITH x AS (SELECT 1)" + _SPELT + f" SELECT {_SHAPE} AS shape, count(*) AS n FROM d GROUP BY 1")
def date_shapes(spark, sf):
    return _spelt(spark, sf).groupBy(D.date_shape(F.col("t")).alias("shape")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "month_index",
    "WITH x AS (SELECT 1)" + _SPELT + rf"""
      SELECT o_orderkey, CAST(CASE WHEN regexp_full_match(t, '\d{{4}}-\d{{1,2}}') THEN CAST(substr(t, 1, 4) AS INT) * 12 + CAST(substr(t, 6) AS INT) - 1
        WHEN regexp_full_match(t, '\d{{4}}') THEN CAST(t AS INT) * 12 + 11
        WHEN regexp_full_match(t, '\d{{1,2}}/\d{{4}}') THEN CAST(right(t, 4) AS INT) * 12 + CAST(split_part(t, '/', 1) AS INT) - 1
        WHEN regexp_full_match(t, '[A-Za-z]{{3,9}}\.?\s+\d{{4}}') AND {_MONTH} > 0 THEN CAST(right(t, 4) AS INT) * 12 + {_MONTH} - 1 END AS INT) AS month_index
      FROM d""",
)
def month_index(spark, sf):
    return _spelt(spark, sf).select("o_orderkey", D.end_month_index(F.col("t")).alias("month_index"))


@query(
    "normal_dates",
    "WITH x AS (SELECT 1)" + _SPELT + rf"""
      , n AS (SELECT o_orderkey, t, CASE WHEN regexp_full_match(t, '\d{{4}}-\d{{1,2}}') THEN t WHEN regexp_full_match(t, '\d{{4}}') THEN t
        WHEN regexp_full_match(t, '\d{{1,2}}/\d{{4}}') THEN right(t, 4) || '-' || lpad(split_part(t, '/', 1), 2, '0')
        WHEN regexp_full_match(t, '[A-Za-z]+\.?\s+\d{{4}}') THEN CASE WHEN {_MONTH} > 0 THEN right(t, 4) || '-' || lpad(CAST({_MONTH} AS VARCHAR), 2, '0') ELSE right(t, 4) END END AS d FROM d)
      SELECT o_orderkey, d AS normal, CASE WHEN regexp_full_match(d, '\d{{4}}-\d{{2}}') THEN
          (['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'])[CAST(right(d, 2) AS INT)] || ' ' || left(d, 4) ELSE d END AS label FROM n""",
)
def normal_dates(spark, sf):
    normal = D.normalise_date(F.col("t"))
    return _spelt(spark, sf).select("o_orderkey", normal.alias("normal"), D.human_month(normal).alias("label"))


_MONTH_LABEL = """CASE WHEN regexp_full_match(trim({0}), '\\d{{4}}-\\d{{2}}') AND CAST(right(trim({0}), 2) AS INT) BETWEEN 1 AND 12
  THEN ['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec'][CAST(right(trim({0}), 2) AS INT)] || ' ' || left(trim({0}), 4) ELSE {0} END"""


@query(
    "range_labels",
    f"""SELECT o_orderkey, CASE WHEN coalesce(s, '') = '' AND coalesce(e, '') = '' THEN ''
          ELSE coalesce({_MONTH_LABEL.format('s')}, '') || ' -- ' || CASE WHEN coalesce(e, '') = '' THEN 'Present' ELSE {_MONTH_LABEL.format('e')} END END AS label
        FROM (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN year(o_orderdate) || '-13' WHEN 2 THEN CAST(year(o_orderdate) AS VARCHAR)
                ELSE strftime(o_orderdate, '%Y-%m') END AS s,
              CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, ' %Y-%m ') WHEN 1 THEN '' END AS e FROM orders)""",
)
def range_labels(spark, sf):
    o, at = F.col("o_orderkey"), F.col("o_orderdate")
    year = F.year(at).cast("string")
    start = F.when(o % 5 == 1, F.concat(year, F.lit("-13"))).when(o % 5 == 2, year).when(o % 5 > 2, F.date_format(at, "yyyy-MM"))
    end = F.when(o % 3 == 0, F.concat(F.lit(" "), F.date_format(at, "yyyy-MM"), F.lit(" "))).when(o % 3 == 1, "")
    return V.table(spark, sf, "orders").select("o_orderkey", D.range_label(start, end).alias("label"))


@query(
    "date_ranges",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS start,
         CASE WHEN o_orderkey % 3 <> 0 THEN strftime(o_orderdate + INTERVAL 200 DAYS, '%Y-%m') END AS end_,
         strftime(o_orderdate, '%b %Y') || CASE o_orderkey % 2 WHEN 0 THEN ' – ' ELSE ' to ' END
           || CASE WHEN o_orderkey % 3 <> 0 THEN strftime(o_orderdate + INTERVAL 200 DAYS, '%m/%Y') ELSE 'present' END AS span
       FROM orders""",
)
def date_ranges(spark, sf):
    o, at = F.col("o_orderkey"), F.col("o_orderdate")
    later = D.add_days(at, F.lit(200))
    line = F.concat(
        F.lit("Engineer, Acme | "), F.date_format(at, "MMM yyyy"), F.when(o % 2 == 0, " – ").otherwise(" to "),
        F.when(o % 3 != 0, F.date_format(later, "MM/yyyy")).otherwise("present"), F.lit(" | Remote"),
    )
    r = D.date_range(line)
    return V.table(spark, sf, "orders").select("o_orderkey", r["start"].alias("start"), r["end"].alias("end_"), r["span"].alias("span"))


@query(
    "stale_ends",
    r"""WITH e AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS entry,
          CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 89 = 0 THEN 'now' WHEN o_orderkey % 83 = 0 THEN 'Fall 99'
               WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%m/%Y') END AS e,
          year(o_orderdate) * 12 + month(o_orderdate) - 1 AS m,
          o_orderkey % 97 = 0 OR o_orderkey % 89 = 0 OR o_orderkey % 83 = 0 AS silent FROM orders),
        f AS (SELECT doc_id, bool_or(silent) AS silent, max(m) AS m, max_by({'n': entry, 'e': e}, (m, -entry)) AS l FROM e GROUP BY doc_id)
        SELECT doc_id, 'experience[' || l.n || '].end' AS path, l.e AS end_text, (2005 * 12 + 2 - m) // 12 AS years
        FROM f WHERE NOT silent AND 2005 * 12 + 2 - m > 18""",
)
def stale_ends(spark, sf):
    from ..operators import checks, search

    o, at = F.col("o_orderkey"), F.col("o_orderdate")
    orders = V.table(spark, sf, "orders").withColumn("b", F.floor(o / 65536))
    placed = search.positions(orders, ["o_custkey"], ["b"], ["o_orderkey"], "n")
    end = (
        F.when(o % 97 == 0, F.lit(None).cast("string")).when(o % 89 == 0, "now").when(o % 83 == 0, "Fall 99")
        .when(o % 2 == 0, F.date_format(at, "yyyy-MM")).otherwise(F.date_format(at, "MM/yyyy"))
    )
    ends = placed.select(F.col("o_custkey").alias("doc_id"), (F.col("n") - 1).alias("entry"), end.alias("end"))
    found = checks.stale_end(ends, "doc_id", F.lit("2005-03-15 00:00:00").cast("timestamp"))
    return found.select(
        "doc_id", "path", F.regexp_extract("detail", "reads “([^”]*)”", 1).alias("end_text"),
        F.regexp_extract("detail", r"about (\d+) year", 1).cast("int").alias("years"),
    )
