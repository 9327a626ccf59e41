"""Revisioned submissions: ordered outcome rules, idempotency, assignments, carry-over between revisions."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """A glob as a Java pattern of the whole path."""
    body = fnmatch.translate(pattern.replace("\\", "/"))
    return "^" + body.removeprefix("(?s:").removesuffix(r")\z").removesuffix(r")\Z") + "$"


def assigned(paths: DataFrame, path_col: str, globs: list[str], prefixes: list[str]) -> Column:
    """Whether a path matches one of a user's globs or prefixes (a list of settings, not data)."""
    own = F.replace(F.col(path_col), F.lit("\\"), F.lit("/"))
    hit = F.lit(False)
    for g in globs:
        hit = hit | own.rlike(glob_regex(g))
    for p in prefixes:
        hit = hit | own.startswith(p.replace("\\", "/"))
    return hit


def outcomes(changes: DataFrame, targets: DataFrame, stale: str = "StaleRevisionConflict", checks_assignment: bool = True) -> DataFrame:
    """Changes (target_id, project_id, revision_id, current_revision_id, base_revision, translation, may_edit) against
    targets (target_id, t_project_id, t_revision_id, t_revision, t_translation): result, conflict, new_revision."""
    joined = changes.join(targets, "target_id", "left")
    scope = F.col("t_project_id") != F.col("project_id")
    moved = F.col("current_revision_id") != F.col("revision_id")
    if checks_assignment:
        moved = moved | (F.col("t_revision_id") != F.col("revision_id"))
    equal = F.col("t_translation").eqNullSafe(F.col("translation"))
    fresh = F.col("t_revision") == F.col("base_revision")
    conflict = F.when(F.col("t_project_id").isNull(), None).when(scope, "ProjectScopeConflict").when(moved, "SourceChangedConflict")
    if checks_assignment:
        conflict = conflict.when(~F.col("may_edit"), "AssignmentConflict")
    conflict = conflict.when(~equal & ~fresh, stale)
    result = F.when(F.col("t_project_id").isNull(), "Rejected").when(F.col("conflict").isNotNull(), "Conflict").when(equal, "NoOp").otherwise("Applied")
    out = joined.withColumn("conflict", conflict).withColumn("result", result)
    return out.withColumn("new_revision", F.when(F.col("result") == "Applied", F.col("t_revision") + 1).otherwise(F.col("t_revision")))


def replayed(submissions: DataFrame, stored: DataFrame) -> DataFrame:
    """Submissions (project_id, submission_id, payload) with outcome new, replay (same payload) or duplicate."""
    s = stored.select("project_id", "submission_id", F.sha2("payload", 256).alias("hash"))
    own = submissions.withColumn("payload_hash", F.sha2("payload", 256)).join(s, ["project_id", "submission_id"], "left")
    return own.withColumn("outcome", F.when(F.col("hash").isNull(), "new").when(F.col("hash") == F.col("payload_hash"), "replay").otherwise("duplicate")).drop("hash")


def server_carry_over(items: DataFrame, earlier: DataFrame) -> DataFrame:
    """(segment_id, translation, tier): the latest translation of an earlier item of equal id and text, else of equal
    source key and text, else of equal text.  Each tier's side is reduced to one row a key before it is joined."""
    own = earlier.where("translation is not null")

    def latest(keys: list[str], tier: str) -> DataFrame:
        return own.groupBy(*keys).agg(F.max(F.struct("updated", "translation")).alias(tier))

    out = items.join(latest(["segment_id", "original_text"], "by_id"), ["segment_id", "original_text"], "left")
    out = out.join(latest(["source_key", "original_text"], "by_key"), ["source_key", "original_text"], "left")
    out = out.join(latest(["original_text"], "by_text"), ["original_text"], "left")
    tier = F.when(F.col("by_id").isNotNull(), "id").when(F.col("by_key").isNotNull(), "key").when(F.col("by_text").isNotNull(), "text")
    return out.select("segment_id", F.coalesce("by_id.translation", "by_key.translation", "by_text.translation").alias("translation"), tier.alias("tier"))


def resolved_value(choice: Column, server: Column, incoming: Column, custom: Column) -> Column:
    return F.when(choice == "accept_incoming", incoming).when(choice == "custom", custom).otherwise(server)
