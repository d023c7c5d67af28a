"""Document versions: the tree, the newest version, pins and the shelf."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import trim
from ..plans.rounds import resolve_pointers
from ..plans.scan import running
from ..plans.skew import salted_join


def version_tree(versions: DataFrame, blocks: Sequence[str]) -> DataFrame:
    """Depth and preorder position of every version within its resume.

    ``versions`` has ``resume_id, version_id, parent_id, created_at``; ``blocks`` are
    columns that rise with ``(created_at, version_id)``. A version whose parent is
    absent is a root; siblings go by creation, then id; a cycle has no root and is left
    out.

    A walk down and up the tree visits each version twice. Every step of the walk has
    one predecessor, known locally: entering a version follows entering its parent or
    leaving its previous sibling; leaving it follows entering it or leaving its last
    child. Following predecessors in doubling rounds gives the number of versions
    entered before (the position) and entered minus left (the depth). No step is shared,
    so neither a wide parent nor a deep chain makes one task grow.
    """
    known = versions.select("resume_id", F.col("version_id").alias("parent_id")).withColumn("__has", F.lit(True))
    linked = salted_join(versions, known, ["resume_id", "parent_id"], ["version_id"]).withColumn(
        "parent_id", F.when(F.col("__has"), F.col("parent_id"))
    ).drop("__has")
    siblings = running(
        linked, ["resume_id", "parent_id"], blocks, ["created_at", "version_id"],
        previous={"__prev": F.col("version_id")},
    )
    last_child = (
        linked.where(F.col("parent_id").isNotNull())
        .groupBy("resume_id", "parent_id")
        .agg(F.max_by("version_id", F.struct("created_at", "version_id")).alias("__last"))
        .withColumnRenamed("parent_id", "version_id")
    )

    def step(version: Column, leaving: bool) -> Column:
        return F.when(
            version.isNotNull(), F.struct(F.col("resume_id"), version.alias("v"), F.lit(leaving).alias("leaving"))
        )

    enter = siblings.select(
        step(F.col("version_id"), False).alias("node"),
        F.coalesce(step(F.col("__prev"), True), step(F.col("parent_id"), False)).alias("ptr"),
        F.lit(1).cast("long").alias("entered"),
        F.lit(1).cast("long").alias("open"),
    )
    leave = linked.join(last_child, ["resume_id", "version_id"], "left").select(
        step(F.col("version_id"), True).alias("node"),
        F.coalesce(step(F.col("__last"), True), step(F.col("version_id"), False)).alias("ptr"),
        F.lit(0).cast("long").alias("entered"),
        F.lit(-1).cast("long").alias("open"),
    )
    walked = resolve_pointers(enter.unionByName(leave), sums=["entered", "open"])
    return walked.where(~F.col("node.leaving")).select(
        F.col("node.resume_id").alias("resume_id"),
        F.col("node.v").alias("version_id"),
        (F.col("entered") - 1).alias("position"),
        (F.col("open") - 1).alias("depth"),
    )


def latest_version(versions: DataFrame) -> DataFrame:
    return versions.groupBy("resume_id").agg(
        F.max_by("version_id", F.struct("created_at", "version_id")).alias("version_id"),
        F.count(F.lit(1)).alias("versions"),
    )


def child_versions(versions: DataFrame) -> DataFrame:
    return versions.groupBy("resume_id").agg(
        F.count(F.lit(1)).alias("versions"), F.count_if(F.col("parent_id").isNotNull()).alias("tailored")
    )


def pinned_counts(resumes: DataFrame, versions: DataFrame, applications: DataFrame) -> DataFrame:
    """Applications per resume; applications are counted per version before the join."""
    per_version = applications.where(F.col("version_id").isNotNull()).groupBy("version_id").agg(
        F.count(F.lit(1)).alias("n")
    )
    per_resume = per_version.join(versions.select("version_id", "resume_id"), "version_id").groupBy(
        "resume_id"
    ).agg(F.sum("n").alias("applications"))
    return resumes.select("resume_id").join(per_resume, "resume_id", "left").select(
        "resume_id", F.coalesce("applications", F.lit(0).cast("long")).alias("applications")
    )


def shelf(resumes: DataFrame, archived: bool = False) -> DataFrame:
    """Live resumes by last update, or archived ones by when they were put away."""
    if archived:
        return resumes.where(F.col("archived_at").isNotNull()).orderBy(F.desc("archived_at"))
    return resumes.where(F.col("archived_at").isNull()).orderBy(F.desc("updated_at"))


def shelf_counts(resumes: DataFrame) -> DataFrame:
    return resumes.agg(
        F.count_if(F.col("archived_at").isNull()).alias("live"),
        F.count_if(F.col("archived_at").isNotNull()).alias("archived"),
    )


def source_documents(applications: DataFrame, versions: DataFrame, resumes: DataFrame) -> DataFrame:
    """The version each application's drafts may cite.

    The pinned one when readable; otherwise the newest version of the most recently
    updated live resume, the same for everyone, or none when that is unreadable.
    ``versions`` has ``readable``.
    """
    readable = versions.where(F.col("readable")).select(
        "version_id", F.col("version_id").alias("__pinned")
    )
    newest_resume = resumes.where(F.col("archived_at").isNull()).agg(
        F.max_by("resume_id", F.struct("updated_at", "resume_id")).alias("resume_id")
    )
    fallback = (
        versions.join(F.broadcast(newest_resume), "resume_id")  # one row by construction
        .agg(F.max_by(F.struct("version_id", "readable"), F.struct("created_at", "version_id")).alias("v"))
        .select(F.when(F.col("v.readable"), F.col("v.version_id")).alias("version_id"))
    )
    joined = salted_join(applications, readable, ["version_id"], ["application_id"])
    return joined.select(
        "application_id",
        F.coalesce("__pinned", fallback.scalar()).alias("version_id"),
        F.col("__pinned").isNotNull().alias("pinned"),
    )


def readable_source(resumes: DataFrame, text: str = "source_text") -> DataFrame:
    return resumes.where(F.coalesce(trim(F.col(text)), F.lit("")) != "")
