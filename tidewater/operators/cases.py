"""Regulation cases: folds of the command log, review flags, queue, published view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Urgencies from the most to the least pressing.
URGENCY = ("critical", "high", "medium", "low")


def urgency_rank(column: str = "urgency") -> Column:
    rank = F.lit(len(URGENCY))
    for i, u in enumerate(URGENCY):
        rank = F.when(F.col(column) == u, i).otherwise(rank)
    return rank


def positions(revisions: DataFrame) -> DataFrame:
    """Revisions numbered from 0 within their case, with those that are first and current."""
    w = Window.partitionBy("case_id").orderBy("recorded_at", "revision_id")
    numbered = revisions.withColumn("position", F.row_number().over(w) - 1)
    whole = Window.partitionBy("case_id")
    return numbered.withColumns({"is_first": F.col("position") == 0, "is_current": F.col("position") == F.max("position").over(whole)})


def latest_verdict(validations: DataFrame, *keys: str) -> DataFrame:
    """The last receipt of each key: highest command sequence (none is lowest), then latest, then highest number."""
    w = Window.partitionBy(*keys).orderBy(F.col("command_sequence").desc_nulls_last(), F.desc("recorded_at"), F.desc("receipt"))
    return validations.withColumn("_turn", F.row_number().over(w)).filter("_turn = 1").drop("_turn")


def review_flags(revisions: DataFrame, validations: DataFrame) -> DataFrame:
    """``legal``, ``geometry``, ``n_areas`` of each revision. No area at all is not a validated geometry."""
    legal = latest_verdict(validations.filter("kind = 'legal'"), "revision_id").select("revision_id", F.col("passed").alias("legal"))
    areas = latest_verdict(validations.filter("kind = 'geometry'"), "revision_id", "area").join(revisions.select("revision_id", "n_areas"), "revision_id").filter("area < n_areas")
    done = areas.groupBy("revision_id").agg(F.count_if("passed").alias("n_passed"))
    joined = revisions.join(legal, "revision_id", "left").join(done, "revision_id", "left")
    geometry = (F.col("n_areas") > 0) & (F.coalesce("n_passed", F.lit(0)) == F.col("n_areas"))
    return joined.select("case_id", "revision_id", F.coalesce("legal", F.lit(False)).alias("legal"), geometry.alias("geometry"), "n_areas")


def lane(current: Column) -> Column:
    waiting_geometry = F.col("legal") & ~F.col("geometry") & (F.col("n_areas") > 0)
    return F.when(waiting_geometry, "awaiting_geometry_validation").when(~F.col("legal") & F.col("geometry"), "awaiting_regulatory_validation").otherwise(current)


def approval_outcome(current_revision: Column, revision: Column, metadata_only: Column) -> Column:
    """Why an approval is refused, the first reason that holds; null where it applies."""
    return F.when(~current_revision.eqNullSafe(revision), "stale revision").when(~F.col("legal"), "legal validation missing").when(~metadata_only & ~F.col("geometry"), "geometry validation missing")


def queue(cases: DataFrame, statuses: list[str], today: int, offset: int, limit: int) -> DataFrame:
    """A page of the queue, pressing ones first, then the most recently changed; snoozed cases are hidden."""
    awake = F.col("snoozed_until").isNull() | (F.col("snoozed_until") <= today)
    found = cases.filter(F.col("admin_status").isin(statuses) & awake)
    return found.orderBy(urgency_rank(), F.desc("updated_day"), "case_id").offset(offset).limit(limit)


def chain_breaks(commands: DataFrame) -> DataFrame:
    """Commands whose sequence is not the next one of their case, or whose stated predecessor is not the command before."""
    w = Window.partitionBy("case_id").orderBy("sequence")
    checked = commands.withColumns({"_place": F.row_number().over(w), "_before": F.lag("command_id").over(w)})
    return checked.filter((F.col("sequence") != F.col("_place")) | ~F.col("predecessor").eqNullSafe(F.col("_before"))).drop("_place", "_before")


def fold_actions(actions: DataFrame) -> DataFrame:
    """State of each case after its admin actions in order: ``read``, ``assignee``, ``urgency``, ``status``.

    Repeated action ids count once. The first ``mark_read`` moves an unread case to review; rejecting or marking a duplicate sets the status.
    """
    once = actions.groupBy("case_id", "action_id").agg(F.min(F.struct("seq", "kind", "value")).alias("a")).select("case_id", "a.*")
    last = lambda kind: F.max_by(F.struct(F.col("value")), F.when(F.col("kind") == kind, F.col("seq")))["value"]
    closed = F.max_by("kind", F.when(F.col("kind").isin("reject", "mark_duplicate"), F.col("seq")))
    folded = once.groupBy("case_id").agg((F.count_if(F.col("kind") == "mark_read") > 0).alias("read"), last("assign").alias("assignee"), last("set_urgency").alias("urgency"), closed.alias("closed"))
    status = F.when(F.col("closed") == "reject", "rejected").when(F.col("closed") == "mark_duplicate", "duplicate").when(F.col("read"), "under_review").otherwise("unread")
    return folded.select("case_id", "read", "assignee", "urgency", status.alias("status"))


def apply_in_order(commands: DataFrame, per_drain: int = 32) -> DataFrame:
    """Outcome of every command of each case (``applied``, ``refused``, ``pending``), and the ``drain`` that settles it.

    A command applies if it has the next sequence and names the command before it; a refusal takes its sequence but changes nothing.
    A gap, a repeated sequence or a wrong predecessor leaves it and all after it pending. A drain settles ``per_drain`` commands
    of a case at most; the next one goes on where it ended.
    """
    w = Window.partitionBy("case_id").orderBy("sequence", "command_id")
    placed = commands.withColumns({"_place": F.row_number().over(w), "_before": F.lag("command_id").over(w)})
    broken = (F.col("sequence") != F.col("_place")) | ~F.col("predecessor").eqNullSafe(F.col("_before"))
    blocked = F.bool_or(broken).over(w.rowsBetween(Window.unboundedPreceding, 0))
    outcome = F.when(blocked, "pending").when(F.col("refuse"), "refused").otherwise("applied")
    drain = F.when(~blocked, F.floor((F.col("_place") - 1) / per_drain) + 1)
    return placed.select("case_id", "sequence", "command_id", outcome.alias("outcome"), drain.cast("long").alias("drain"))


def in_case_order(commands: DataFrame, tasks: int | None = None) -> DataFrame:
    """``commands`` with all of a case in one partition and in order of ``sequence``; ``tasks`` cases or so run side by side."""
    dealt = commands.repartition(tasks, "case_id") if tasks else commands.repartition("case_id")
    return dealt.sortWithinPartitions("case_id", "sequence")


def published(cases: DataFrame, approvals: DataFrame, revisions: DataFrame) -> DataFrame:
    """Cases as published: fields come from the revision that the last applied approval pinned, never from the draft."""
    pin = approvals.filter("applied").groupBy("case_id").agg(F.max_by("revision_id", F.struct("sequence")).alias("revision_id"))
    return cases.select("case_id", "title", "region").join(pin, "case_id").join(revisions.select("case_id", "revision_id", "content", "recorded_at"), ["case_id", "revision_id"])


def shape_review(decisions: DataFrame, shapes: DataFrame) -> DataFrame:
    """Whether the last decision on each shape is positive and still about the shape as it is."""
    w = Window.partitionBy("revision_id", "shape_id").orderBy(F.desc(F.coalesce("command_sequence", F.lit(-1))), F.desc("receipt"))
    last = decisions.withColumn("_turn", F.row_number().over(w)).filter("_turn = 1").select("revision_id", "shape_id", "passed", F.col("shape_hash").alias("seen_hash"))
    joined = shapes.join(last, ["revision_id", "shape_id"], "left")
    return joined.select("revision_id", "shape_id", F.coalesce(F.col("passed") & (F.col("seen_hash") == F.col("shape_hash")), F.lit(False)).alias("validated"))


def name_conflicts(groups: DataFrame) -> DataFrame:
    """Active groups of one jurisdiction that share a name, apart from case and outer spaces."""
    w = Window.partitionBy("region", F.lower(F.trim("name")))
    return groups.filter("active").withColumn("_n", F.count("*").over(w)).filter("_n > 1").drop("_n")

