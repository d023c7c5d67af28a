"""Message sequences: derived schedules, the due queue, replies and sends.

A step row has ``application_id, contact_id (nullable), sequence_step, created_at,
day_offset, sent_at, status`` plus a unique id. ``order`` names the columns that
put a sequence's steps in order and ``blocks`` the coarser columns that rise with
them (see ``plans.scan``). Due times are never stored; they follow from the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab
from ..functions.dates import add_days
from ..functions.fields import day_label, is_pending, step_state
from ..functions.text import trim
from ..plans.scan import running
from ..plans.skew import hot_keys, salted_join

KEY = ("application_id", "contact_id")


def _sequence_key(df: DataFrame) -> DataFrame:
    """One non-null key column: a missing contact is part of the key."""
    return df.withColumn("__seq", F.concat_ws("::", F.col("application_id").cast("string"), F.coalesce(F.col("contact_id").cast("string"), F.lit(""))))


def schedule(steps: DataFrame, order: Sequence[str], blocks: Sequence[str]) -> DataFrame:
    """Add ``cumulative_offset`` and ``due_at``.

    A step is due its offset after the step before it was sent, or was due. With S
    the running offset and L the last earlier step that was sent,
    ``due = L.sent_at + (S - L.S)`` days, or the sequence's first creation time
    plus S days when nothing was sent.
    """
    keyed = _sequence_key(steps)
    hot = hot_keys(keyed, ["__seq"])
    offsets = running(
        keyed, ["__seq"], blocks, order,
        sums={"cumulative_offset": F.col("day_offset").cast("long")}, hot=hot,
    )
    sent = F.when(
        F.col("sent_at").isNotNull(), F.struct("sent_at", F.col("cumulative_offset").alias("s"))
    )
    based = running(offsets, ["__seq"], blocks, order, previous={"__last": sent}, hot=hot)
    anchor = keyed.groupBy("__seq").agg(F.min("created_at").alias("__anchor"))
    anchored = salted_join(based, anchor, ["__seq"], order, "left", counted=keyed)
    since = F.col("cumulative_offset") - F.coalesce(F.col("__last.s"), F.lit(0))
    return anchored.withColumn(
        "due_at", add_days(F.coalesce("__last.sent_at", "__anchor"), since)
    ).drop("__last", "__anchor", "__seq")


def _next_pending(scheduled: DataFrame, order: Sequence[str]) -> DataFrame:
    """Per sequence, its lowest pending step as a struct, reply facts and key columns."""
    keyed = _sequence_key(scheduled)
    pending, replied = is_pending(F.col("status")), F.col("status") == "replied"
    rank = F.struct(*order)
    row = F.struct("sequence_step", "status", "due_at")
    return keyed.groupBy("__seq").agg(
        F.first("application_id").alias("application_id"),
        F.first("contact_id").alias("contact_id"),
        F.min_by(row, F.when(pending, rank)).alias("next"),
        F.min_by(
            F.coalesce("sent_at", "created_at"), F.when(replied, rank)
        ).alias("replied_at"),
        F.max(replied).alias("replied"),
    )


def due_steps(scheduled: DataFrame, order: Sequence[str], now: Column) -> DataFrame:
    """At most one step per sequence: the lowest pending one, once its time has come."""
    first = _next_pending(scheduled, order)
    return first.where(F.col("next").isNotNull() & (F.col("next.due_at") <= now)).select(
        "application_id", "contact_id",
        F.col("next.sequence_step").alias("sequence_step"),
        F.col("next.status").alias("status"),
        F.col("next.due_at").alias("due_at"),
    )


def halted_steps(steps: DataFrame) -> DataFrame:
    """Pending steps after a replied one in the same sequence."""
    keyed = _sequence_key(steps)
    replied = (
        keyed.where(F.col("status") == "replied")
        .groupBy("__seq")
        .agg(F.min("sequence_step").alias("__replied"))
    )
    pending = keyed.where(is_pending(F.col("status")))
    return (
        salted_join(pending, replied, ["__seq"], [c for c in steps.columns], "inner")
        .where(F.col("sequence_step") > F.col("__replied"))
        .drop("__seq", "__replied")
    )


def fold_replies(steps: DataFrame) -> DataFrame:
    """The same rows with later pending steps of replied sequences set to ``halted``."""
    keyed = _sequence_key(steps)
    replied = (
        keyed.where(F.col("status") == "replied")
        .groupBy("__seq")
        .agg(F.min("sequence_step").alias("__replied"))
    )
    halted = is_pending(F.col("status")) & (F.col("sequence_step") > F.col("__replied"))
    return (
        salted_join(keyed, replied, ["__seq"], [c for c in steps.columns], "left")
        .withColumn("status", F.when(halted, "halted").otherwise(F.col("status")))
        .select(*steps.columns)
    )


def reply_events(steps: DataFrame, at: Column, number: Column) -> DataFrame:
    """The status event each answered step brings to its application, for ``fold_status``.

    ``at`` and ``number`` are the reply's time and its order among events of one time.
    Folding the same reply again changes nothing.
    """
    return steps.where(F.col("status") == "replied").select(
        "application_id", number.cast("long").alias("seq"), at.cast("timestamp").alias("event_at"), F.lit("replied").alias("status")
    )


def queue(scheduled: DataFrame, order: Sequence[str], now: Column) -> DataFrame:
    """One row per sequence that still matters: replied, due or active.

    A reply outranks a due step; a sequence with neither a reply nor a pending step
    is absent. ``sort_key`` is ascending inside a group.
    """
    first = _next_pending(scheduled, order)
    due = F.col("next.due_at") <= now
    state = (
        F.when(F.col("replied"), "replied")
        .when(F.col("next").isNotNull() & due, "due")
        .when(F.col("next").isNotNull(), "active")
    )
    stepped = state.isin("due", "active")
    out = first.withColumn("state", state).where(F.col("state").isNotNull())
    when_micros = F.unix_micros(F.coalesce(F.when(F.col("state") == "replied", F.col("replied_at")), F.col("next.due_at")))
    return out.select(
        "application_id", "contact_id", "state",
        F.when(F.col("state") == "due", "Due today").otherwise("Active").alias("group_label"),
        F.when(stepped, F.col("next.sequence_step")).alias("next_step"),
        F.when(stepped, F.col("next.due_at")).alias("due_at"),
        F.when(F.col("state") == "due", 0).when(F.col("state") == "active", 1).otherwise(2).alias("group_rank"),
        F.when(F.col("state") == "replied", -when_micros).otherwise(when_micros).alias("sort_key"),
    )


def queue_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy("group_rank", "sort_key", "application_id", "contact_id")


def group_sizes(queue_rows: DataFrame) -> DataFrame:
    """Due and active sizes; a group with nothing in it has no row."""
    return queue_rows.groupBy("group_label").agg(F.count(F.lit(1)).alias("n"))


def with_context(rows: DataFrame, jobs: DataFrame, contacts: DataFrame) -> DataFrame:
    """Company, title and contact name; blanks and ``No contact`` when unknown.

    ``jobs`` has one row per ``application_id``; a contact counts only for its own application.
    """
    named = contacts.select("application_id", "contact_id", F.col("name").alias("__name"))
    return (
        rows.join(jobs.select("application_id", "company", "title"), "application_id", "left")
        .join(named, ["application_id", "contact_id"], "left")
        .withColumn("company", F.coalesce("company", F.lit("")))
        .withColumn("title", F.coalesce("title", F.lit("")))
        .withColumn("contact_name", F.coalesce("__name", F.lit("No contact")))
        .drop("__name")
    )


def follow_ups_due(
    due: DataFrame, jobs: DataFrame, contacts: DataFrame, limit: int = vocab.DUE_PANEL_LIMIT
) -> DataFrame:
    """The panel of the most overdue steps. The limit is taken before the lookups."""
    first = due.orderBy("due_at", "application_id", "contact_id").limit(limit)
    return with_context(first, jobs, contacts)


def step_view(scheduled: DataFrame) -> DataFrame:
    """What the timeline prints per step: state and day label."""
    return scheduled.withColumn("state", step_state(F.col("status"), F.col("sent_at"))).withColumn(
        "day", day_label(F.col("cumulative_offset"))
    )


def open_sequence(
    selectors: DataFrame, applications: DataFrame, steps: DataFrame, contacts: DataFrame, queue_rows: DataFrame
) -> DataFrame:
    """Which sequence each selector ``(selector_id, application_id?, contact_id?)`` opens.

    Both given: that pair. Application only: its first dealt sequence, else its
    first contact. Contact only: the contact's application, else the first
    application it was written to. Neither: the most urgent queue entry. A named
    application that is not in ``applications`` opens nothing.
    """
    dealt = steps.groupBy("application_id").agg(
        F.min_by(F.struct("contact_id"), F.struct("sequence_step", "created_at", "contact_id")).alias("dealt")
    )
    first_contact = contacts.groupBy("application_id").agg(
        F.min_by("contact_id", F.struct("created_at", "contact_id")).alias("first_contact")
    )
    by_application = (
        applications.select("application_id").distinct()
        .join(dealt, "application_id", "left")
        .join(first_contact, "application_id", "left")
        .withColumn("__known", F.lit(True))
    )
    owner = contacts.groupBy("contact_id").agg(F.min_by("application_id", F.struct("created_at", "application_id")).alias("owner"))
    written = (
        steps.where(F.col("contact_id").isNotNull())
        .groupBy("contact_id")
        .agg(F.min_by("application_id", F.struct("created_at", "application_id")).alias("written"))
    )
    by_contact = owner.join(written, "contact_id", "full")
    urgent = (
        queue_rows.agg(
            F.min_by(
                F.struct("application_id", "contact_id"),
                F.struct("group_rank", "sort_key", "application_id", "contact_id"),
            ).alias("urgent")
        )
    )
    has_app, has_contact = F.col("application_id").isNotNull(), F.col("contact_id").isNotNull()
    top = urgent.scalar()
    chosen_app = (
        F.when(has_app, F.when(F.col("__known"), F.col("application_id")))
        .when(has_contact, F.coalesce("owner", "written"))
        .otherwise(top["application_id"])
    )
    chosen_contact = (
        F.when(has_contact, F.col("contact_id"))
        .when(has_app, F.when(F.col("dealt").isNotNull(), F.col("dealt.contact_id")).otherwise(F.col("first_contact")))
        .otherwise(top["contact_id"])
    )
    # Half the selectors may have a null key; the salted join spreads them.
    asked = salted_join(selectors, by_application, ["application_id"], ["selector_id"])
    return salted_join(asked, by_contact, ["contact_id"], ["selector_id"], counted=selectors).select(
        "selector_id",
        chosen_app.alias("open_application_id"),
        F.when(chosen_app.isNotNull(), chosen_contact).alias("open_contact_id"),
    )


def send_claims(claims: DataFrame) -> DataFrame:
    """Who may send a step: ``(step_id, claim_id, claimed_at, confirmed)`` in, one claimant out.

    Later claims see ``already-sent`` when the winner confirmed, else ``unconfirmed``.
    """
    winner = claims.groupBy("step_id").agg(
        F.min(F.struct("claimed_at", "claim_id")).alias("__first"),
        F.min_by("confirmed", F.struct("claimed_at", "claim_id")).alias("__ok"),
    )
    joined = salted_join(claims, winner, ["step_id"], ["claim_id"], "inner")
    return joined.withColumn(
        "outcome",
        F.when(F.col("__first.claim_id") == F.col("claim_id"), "sent")
        .when(F.col("__ok"), "already-sent")
        .otherwise("unconfirmed"),
    ).drop("__first", "__ok")


# --- Fixed values: wording of the three template messages -------------------

_INTRO_SUBJECT = "{title} — quick note"
_INTRO_BODY = (
    "{greet}I'm applying for the {title} role at {company} and wanted to reach you directly.\n\n"
    "[Two sentences on the work of yours that lines up with this role.]\n\n"
    "Would you be open to a short call this week?"
)
_SECOND_SUBJECT = "Re: {title} — quick follow-up"
_SECOND_BODY = (
    "{greet}following up on my note about the {title} role at {company}. "
    "Happy to send anything that would be useful on my end. "
    "If this req belongs to someone else, a pointer in their direction is just as welcome."
)
_THIRD_SUBJECT = "{title} — closing the loop"
_THIRD_BODY = (
    "{greet}last note from me on the {title} role at {company}. "
    "I'll assume the timing isn't right and leave it here. "
    "If it opens up again later, I'd still be glad to talk."
)


def _fill(template: str, values: dict[str, Column]) -> Column:
    out = F.lit(template)
    for name, column in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), column)
    return out


def template_steps(targets: DataFrame, draft_subject: Column | None = None, draft_body: Column | None = None) -> DataFrame:
    """The three steps for ``(application_id, contact_id, contact_name, title, company)`` rows.

    A drafted first message replaces the template's own.
    """
    first_name = F.regexp_extract(trim(F.coalesce("contact_name", F.lit(""))), r"^(\S+)", 1)
    greet = F.when(first_name != "", F.concat(F.lit("Hi "), first_name, F.lit(" — "))).otherwise("")
    values = {"greet": greet, "title": F.col("title"), "company": F.col("company")}
    texts = [
        (draft_subject if draft_subject is not None else _fill(_INTRO_SUBJECT, values),
         draft_body if draft_body is not None else _fill(_INTRO_BODY, values)),
        (_fill(_SECOND_SUBJECT, values), _fill(_SECOND_BODY, values)),
        (_fill(_THIRD_SUBJECT, values), _fill(_THIRD_BODY, values)),
    ]
    steps = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("sequence_step"),
                F.lit(vocab.FOLLOW_UP_OFFSETS[i]).alias("day_offset"),
                subject.alias("subject"),
                body.alias("body"),
            )
            for i, (subject, body) in enumerate(texts)
        ]
    )
    return targets.select("application_id", "contact_id", F.inline(steps)).withColumn(
        "status", F.lit("scheduled")
    )


def deal_sequences(new_steps: DataFrame, existing: DataFrame) -> DataFrame:
    """Only steps of sequences that do not exist yet."""
    taken = existing.select(*KEY).distinct()
    return new_steps.alias("n").join(
        taken.alias("t"),
        (F.col("n.application_id") == F.col("t.application_id"))
        & F.col("n.contact_id").eqNullSafe(F.col("t.contact_id")),
        "left_anti",
    )


def mark_sent(steps: DataFrame, marks: DataFrame, id_column: str) -> DataFrame:
    """Apply hand-marked sends: status sent, the mark's time, no thread reference."""
    last = marks.groupBy(id_column).agg(F.max("marked_at").alias("__at"))
    joined = steps.join(last, id_column, "left")
    hit = F.col("__at").isNotNull()
    return joined.select(
        *[
            F.when(hit, F.lit("sent")).otherwise(F.col(c)).alias(c) if c == "status"
            else F.when(hit, F.col("__at")).otherwise(F.col(c)).alias(c) if c == "sent_at"
            else F.when(~hit, F.col(c)).alias(c) if c == "thread_ref"
            else F.col(c)
            for c in steps.columns
        ]
    )
