"""Status, reply and claim folds over streams.

State is kept by Spark's own streaming aggregates wherever the fold is a mergeable
aggregate, so it lives in the state store per key and late events still count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import funnel
from ..operators.outreach import _sequence_key
from ..functions.fields import is_pending


def status_stream(events: DataFrame) -> DataFrame:
    """The status fold as a streaming aggregate; use update or complete mode."""
    return funnel.fold_status(events)


def first_replies(replies: DataFrame) -> DataFrame:
    """Per sequence, the lowest step that was answered so far (``sequence_step``)."""
    return _sequence_key(replies).groupBy("__seq").agg(F.min("sequence_step").alias("replied_step"))


def halts_for(first: DataFrame, steps: DataFrame) -> DataFrame:
    """Pending steps that the given first replies halt."""
    keyed = _sequence_key(steps).where(is_pending(F.col("status")))
    return keyed.join(first, "__seq").where(F.col("sequence_step") > F.col("replied_step")).drop("__seq", "replied_step")


def claims_within(claims: DataFrame, delay: str) -> DataFrame:
    """One claim per step among those no further apart than the delay; bounded state."""
    return claims.withWatermark("claimed_at", delay).dropDuplicatesWithinWatermark(["step_id"])


def claim_winners(claims: DataFrame) -> DataFrame:
    """One claim per step with no bound on the delay; state is one row per step."""
    return claims.groupBy("step_id").agg(
        F.min(F.struct("claimed_at", "claim_id")).alias("first")
    ).select("step_id", F.col("first.claim_id").alias("claim_id"))


def windowed_funnel(events: DataFrame, late: str, width: str, slide: str | None = None) -> DataFrame:
    """Status events per window; events later than ``late`` are dropped."""
    return funnel.windowed_funnel(events.withWatermark("event_at", late), width, slide)


def sessions(events: DataFrame, late: str, gap: str) -> DataFrame:
    return (
        events.withWatermark("event_at", late)
        .groupBy(F.session_window("event_at", gap).alias("w"), "application_id")
        .agg(F.count(F.lit(1)).alias("events"))
        .select("application_id", F.col("w.start").alias("started_at"), "events")
    )


def thread_replies(messages: DataFrame, sent: DataFrame, own_address: str, window: str) -> DataFrame:
    """Messages in a sent step's thread that are not our own, within ``window`` of the send.

    ``messages`` has ``thread_ref, sender, received_at``; ``sent`` has ``thread_ref,
    application_id, contact_id, sequence_step, sent_at``. Both sides carry a watermark,
    so matched and expired rows leave the state.
    """
    theirs = messages.withWatermark("received_at", window).where(F.lower("sender") != own_address.lower())
    ours = sent.withWatermark("sent_at", window).withColumnRenamed("thread_ref", "sent_ref")
    return theirs.join(
        ours,
        F.expr(f"thread_ref = sent_ref AND received_at >= sent_at AND received_at <= sent_at + INTERVAL {window}"),
    ).drop("sent_ref")


def upsert_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink for update mode: every batch in its own folder.

    A batch that is run again replaces its own folder, so a restart changes nothing.
    ``latest`` reads back the newest row per key.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def run_available(stream: DataFrame, mode: str, path: str) -> DataFrame:
    """Process everything there is, then return what the sink holds."""
    query: StreamingQuery = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(upsert_sink(f"{path}/out"))
        .option("checkpointLocation", f"{path}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    spark = stream.sparkSession
    return spark.read.option("basePath", f"{path}/out").schema(
        stream.schema.add("batch", "long")
    ).parquet(f"{path}/out")

