"""The job table as a log of folded batches: append, merge on read, compact in proportion.

A batch of listings is resolved, folded to one row per posting and written as a new segment; nothing
stored is read for that. The table is the fold of all segments, which is the same whatever the
segments hold, so two of them can be merged into one at any time. Segments are merged newest first
while the older one is at most ``FANOUT`` times the newer: a row is rewritten a logarithmic number of
times over the life of the table, and a commit on average rewrites a few times the batch's bytes.

What counts is the newest manifest, which lists the segments and the last batch taken in: a commit
happens entirely or not at all, and a batch that is delivered again is left alone. Segments that neither the newest manifest nor the one before it names are deleted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import dedupe, merge
from ..sources.manifest import Manifests

#: An older segment is merged with the newer ones up to this many times their size.
FANOUT = 2
#: Bytes of one file of a merged segment.
FILE_BYTES = 128 << 20

_TEXT = "struct<text:string,at:timestamp>"
SEGMENT = (
    "u string, t struct<title:string,company:string,location:string>, url string, first struct<title:string,company:string>, "
    f"first_in long, location string, location_in long, real {_TEXT}, real_in long, placeholder {_TEXT}, placeholder_in long, sightings long"
)


class JobLog:
    def __init__(self, spark: SparkSession, path: str, file_bytes: int = FILE_BYTES, fanout: int = FANOUT) -> None:
        self.spark, self.file_bytes, self.fanout = spark, file_bytes, fanout
        self.manifests = Manifests(spark, path)

    def _rows(self, segments: Sequence[dict]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], SEGMENT)
        return self.spark.read.schema(SEGMENT).parquet(*[s["path"] for s in segments])

    def append(self, listings: DataFrame, batch_id: int, order: Sequence[str], now: Column | None = None) -> None:
        """Take in one batch; ``order`` is unique and numeric within it, batch ids rise."""
        state = self.status()
        if state["last"] is not None and batch_id <= state["last"]:
            return
        folded = fold_batch(dedupe.dedupe_listings(listings, order), batch_id, order, F.current_timestamp() if now is None else now)
        segments, tail, merged = list(state["segments"]), [self.manifests.write(folded)], []
        appended, rewritten = state["appended"] + tail[0]["bytes"], state["rewritten"]
        while segments and segments[-1]["bytes"] <= self.fanout * sum(s["bytes"] for s in tail):
            tail.insert(0, segments.pop())
        if len(tail) > 1:
            size = sum(s["bytes"] for s in tail)
            files = max(1, -(-size // self.file_bytes))
            merged = tail
            tail = [self.manifests.write(folded_again(self._rows(tail).repartition(files, "u", "t")))]
            rewritten += tail[0]["bytes"]
        self.manifests.commit(
            state,
            {"last": batch_id, "segments": [*segments, *tail], "appended": appended, "rewritten": rewritten, "merged": [s["path"] for s in merged]},
        )
        # readers of the manifest before this one may still be at its segments; those it had merged away are free
        for old in state.get("merged", []):
            self.manifests.delete(old)

    def jobs(self) -> DataFrame:
        """The table: ``job_id, url, title, company, location, jd_text, source, scraped_at``."""
        rows = folded_again(self._rows(self.status()["segments"]))
        body = F.coalesce("real", "placeholder")
        return rows.select(
            F.sha2(F.to_json(F.struct("u", "t")), 256).alias("job_id"), "url", "first.title", "first.company", "location",
            body["text"].alias("jd_text"), F.lit("api").alias("source"), body["at"].alias("scraped_at"),
        )

    def status(self) -> dict:
        """Version, last batch, segments and the bytes appended and rewritten so far."""
        return {"last": None, "segments": [], "appended": 0, "rewritten": 0} | self.manifests.newest()


def fold_batch(listings: DataFrame, batch_id: int, order: Sequence[str], now: Column) -> DataFrame:
    """One row per posting of a batch, as a segment holds it."""
    number = F.lit(batch_id).cast("long")
    timed = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("text"), now.alias("at")))
    there = lambda c: F.when(F.col(c).isNotNull(), number)
    return merge.fold_incoming(listings, order).select(
        F.col("__u").alias("u"), F.col("__t").alias("t"), F.col("in_url").alias("url"),
        F.struct("in_first.title", "in_first.company").alias("first"), number.alias("first_in"),
        F.col("in_location").alias("location"), there("in_location").alias("location_in"),
        timed("in_real").alias("real"), there("in_real").alias("real_in"),
        timed("in_placeholder").alias("placeholder"), there("in_placeholder").alias("placeholder_in"), "sightings",
    )


def folded_again(rows: DataFrame) -> DataFrame:
    """Segments' rows folded to one per posting: the same as if their batches had come as one.

    The first batch names the posting, the last known location wins, of the bodies the longest and
    of equally long ones the earliest; a placeholder counts only where there is no body.
    """
    longest = F.when(F.col("real").isNotNull(), F.struct(F.length("real.text"), -F.col("real_in")))
    return rows.groupBy("u", "t").agg(
        F.first("url", ignorenulls=True).alias("url"), F.min_by("first", "first_in").alias("first"), F.min("first_in").alias("first_in"),
        F.max_by("location", "location_in").alias("location"), F.max("location_in").alias("location_in"),
        F.max_by("real", longest).alias("real"), F.max_by("real_in", longest).alias("real_in"),
        F.min_by("placeholder", "placeholder_in").alias("placeholder"), F.min("placeholder_in").alias("placeholder_in"),
        F.sum("sightings").alias("sightings"),
    )


def incremental_merge(path: str, order: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` step that takes a batch of listings into the log at ``path``."""

    def step(batch: DataFrame, batch_id: int) -> None:
        JobLog(batch.sparkSession, path).append(batch, batch_id, order)

    return step
