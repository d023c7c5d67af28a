"""Application state: folding status events, the board, and funnel statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import vocab
from ..functions.dates import whole_days_since
from ..functions.fields import in_vocabulary
from ..plans.scan import running
from ..plans.skew import hot_keys, salted_join


def _in_list(rows: DataFrame, column: str, values: Sequence[str], name: str) -> tuple[DataFrame, DataFrame]:
    ok = F.coalesce(in_vocabulary(F.col(column), values), F.lit(False))
    reason = F.concat(F.lit('"'), F.coalesce(column, F.lit("")), F.lit(f'" is not a {name}. Legal values: {", ".join(values)}.'))
    return rows.where(ok), rows.where(~ok).withColumn("reason", reason)


def valid_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events with a known status, and the rest, those without one included, with a reason."""
    return _in_list(events, "status", vocab.APPLICATION_STATUSES, "pipeline status")


def valid_tiers(ratings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ratings with a known ``tier``, and the rest with a reason."""
    return _in_list(ratings, "tier", vocab.FIT_TIERS, "fit tier")


def _stamps(status: Column, at: Column) -> list[Column]:
    return [
        F.min(F.when(status.isin(*statuses), at)).alias(name)
        for name, statuses in vocab.MILESTONES.items()
    ]


def fold_status(events: DataFrame) -> DataFrame:
    """One row per application: current status, first-reached milestones, first and last event.

    Only order-free aggregates, so partial results combine before the shuffle and
    one very busy application costs one row per task, not one task.
    """
    return events.groupBy("application_id").agg(
        F.max_by("status", F.struct("event_at", "seq")).alias("status"),
        *_stamps(F.col("status"), F.col("event_at")),
        F.min("event_at").alias("created_at"),
        F.max("event_at").alias("updated_at"),
    )


def stage_rank(status: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in vocab.APPLICATION_STATUSES]), status)


def fold_forward_only(events: DataFrame, advance_to: str = "outreach") -> DataFrame:
    """Like ``fold_status``, but an ``advance_to`` event only ever moves forward.

    The last plain event decides; a later advance applies when that status comes
    earlier in the pipeline.
    """
    order = F.struct("event_at", "seq")
    advance = F.col("status") == advance_to
    folded = events.groupBy("application_id").agg(
        F.max_by("status", F.when(~advance, order)).alias("__set"),
        F.max(F.when(~advance, order)).alias("__set_at"),
        F.max(F.when(advance, order)).alias("__adv_at"),
    )
    base = F.coalesce("__set", F.lit(vocab.DEFAULT_STATUS))
    moves = F.col("__adv_at").isNotNull() & (
        F.col("__set_at").isNull() | (F.col("__adv_at") > F.col("__set_at"))
    )
    return folded.select(
        "application_id",
        F.when(moves & (stage_rank(base) < stage_rank(F.lit(advance_to))), advance_to)
        .otherwise(base)
        .alias("status"),
    )


def backfill_offered(applications: DataFrame) -> DataFrame:
    """Give offers without an offer time the decision time, else the last update."""
    return applications.withColumn(
        "offered_at",
        F.when(
            (F.col("status") == "offer") & F.col("offered_at").isNull(),
            F.coalesce("decided_at", "updated_at"),
        ).otherwise(F.col("offered_at")),
    )


def _dimension(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    return spark.createDataFrame(rows, columns)


def status_counts(applications: DataFrame) -> DataFrame:
    """Every status with its count, zero when empty; unknown statuses are not counted."""
    statuses = _dimension(
        applications.sparkSession,
        [(i, s) for i, s in enumerate(vocab.APPLICATION_STATUSES)],
        "stage int, status string",
    )
    counts = applications.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return statuses.join(counts, "status", "left").select(
        "stage", "status", F.coalesce("n", F.lit(0).cast("long")).alias("n")
    )


def occupied_statuses(applications: DataFrame) -> DataFrame:
    return status_counts(applications).where(F.col("n") > 0)


def milestone_reach(applications: DataFrame) -> DataFrame:
    """How many applications ever reached each stage, in one pass."""
    counted = applications.agg(
        *[
            F.count(F.lit(1) if column is None else F.col(column)).alias(f"c{i}")
            for i, (_, column) in enumerate(vocab.FUNNEL_STAGES)
        ]
    )
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("stage"), F.lit(label).alias("label"), F.col(f"c{i}").alias("n"))
            for i, (label, _) in enumerate(vocab.FUNNEL_STAGES)
        ]
    )
    return counted.select(F.inline(rows))


def funnel_conversions(applications: DataFrame) -> DataFrame:
    """Adjacent-stage rates; null when the pair does not nest or the first is empty."""
    counted = applications.agg(
        *[
            F.count(F.lit(1) if column is None else F.col(column)).alias(f"c{i}")
            for i, (_, column) in enumerate(vocab.FUNNEL_STAGES)
        ]
    )
    steps = []
    for i in range(1, len(vocab.FUNNEL_STAGES)):
        was, now = F.col(f"c{i - 1}"), F.col(f"c{i}")
        steps.append(
            F.struct(
                F.lit(i).alias("stage"),
                F.lit(vocab.FUNNEL_STAGES[i - 1][0]).alias("from_label"),
                F.lit(vocab.FUNNEL_STAGES[i][0]).alias("to_label"),
                now.alias("n"),
                F.when((was > 0) & (now <= was), now / was).alias("rate"),
            )
        )
    return counted.select(F.inline(F.array(*steps)))


def funnel_cube(applications: DataFrame, *dimensions: str) -> DataFrame:
    """Milestone reach over every combination of ``dimensions``.

    Applications are counted once, by all dimensions together; the combinations are sums of these
    counts, so rows are multiplied only after they have been combined, and a dimension may have many
    values, such as the resume version.
    """
    milestones = [(label.lower(), column) for label, column in vocab.FUNNEL_STAGES if column]
    counted = applications.groupBy(*dimensions).agg(
        F.count(F.lit(1)).alias("in_pipeline"), *[F.count(column).alias(label) for label, column in milestones]
    )
    return counted.cube(*dimensions).agg(
        F.grouping_id().alias("level"), *[F.sum(c).alias(c) for c in ("in_pipeline", *[label for label, _ in milestones])]
    )


def recent_activity(
    applications: DataFrame, jobs: DataFrame, limit: int = vocab.RECENT_ACTIVITY_LIMIT
) -> DataFrame:
    """The latest updates with their job. The limit is taken before the join."""
    latest = applications.join(jobs.select("job_id"), "job_id", "left_semi").orderBy(
        F.desc("updated_at"), F.desc("application_id")
    ).limit(limit)
    return latest.join(jobs, "job_id").select(
        "application_id", "company", "title", "status", "updated_at"
    )


def board_cards(
    applications: DataFrame, jobs: DataFrame, versions: DataFrame, now: Column
) -> DataFrame:
    """One card per application with job, pinned version label and days in stage.

    A popular job may carry a large share of the applications, so both lookups are salted.
    """
    with_job = salted_join(
        applications, jobs.select("job_id", "company", "title", "location"), ["job_id"],
        ["application_id"], "inner",
    )
    with_version = salted_join(
        with_job, versions.select("version_id", F.col("label").alias("resume_label")),
        ["version_id"], ["application_id"], "left", counted=applications,
    )
    return with_version.select(
        "application_id", "status", "company", "title", "location", "fit_tier", "resume_label",
        whole_days_since(F.col("updated_at"), now).alias("days_in_stage"), "updated_at",
    )


def application_detail(
    applications: DataFrame, jobs: DataFrame, versions: DataFrame, resumes: DataFrame
) -> DataFrame:
    """Application with job, version and resume; all lookups keep the application."""
    pinned = versions.select("version_id", F.col("label").alias("resume_label"), "resume_id").join(
        resumes.select("resume_id", F.col("name").alias("resume_name")), "resume_id", "left"
    )
    with_job = salted_join(
        applications, jobs.select("job_id", "company", "title"), ["job_id"], ["application_id"]
    )
    return salted_join(with_job, pinned, ["version_id"], ["application_id"], counted=applications)


def activity_sessions(events: DataFrame, gap_minutes: int) -> DataFrame:
    """Runs of events of one application with no pause longer than the gap.

    Days are the blocks, so a very busy application is scanned by many tasks.
    """
    day = events.withColumn("__day", F.to_date("event_at"))
    hot = hot_keys(day, ["application_id"])
    seen = running(
        day, ["application_id"], ["__day"], ["event_at", "seq"],
        previous={"__before": F.col("event_at")}, hot=hot,
    )
    pause = F.unix_micros("event_at") - F.unix_micros("__before")
    starts = seen.withColumn(
        "__start",
        F.when(F.col("__before").isNull() | (pause >= gap_minutes * 60_000_000), 1).otherwise(0).cast("long"),
    )
    numbered = running(
        starts, ["application_id"], ["__day"], ["event_at", "seq"], sums={"session": F.col("__start")}, hot=hot
    )
    return numbered.groupBy("application_id", "session").agg(
        F.min("event_at").alias("started_at"),
        F.max("event_at").alias("ended_at"),
        F.count(F.lit(1)).alias("events"),
    )


def windowed_funnel(events: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    """Status events per time window; with a slide, windows overlap."""
    w = F.window("event_at", width, slide) if slide else F.window("event_at", width)
    return events.groupBy(w.alias("w"), "status").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "status", "n"
    )
