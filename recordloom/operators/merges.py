"""Merges that need no asking, their journal, and how they are undone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions import dates, identity, text
from recordloom.operators import matchers

# Statements about a record's way here, which two copies of one result may differ in.
IGNORED = ("core:sourceSystem", "core:sourceIdentity", "core:dataProvenance", "core:schemaVersion", "core:importedAt", "clinical:importedAt", "clinical:sourceEHR", "clinical:provenanceClass", "health:sourceRecordId", "clinical:sourceRecordId", "prov:wasDerivedFrom")


def tier0(records: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """(canonical ``ord``, members, code, instant, fingerprint): lab results that several organisations state alike.

    Same code, same stated instant (with a time of day), same content, all origins known and
    no two members of one origin.  One aggregation; nothing is paired.
    """
    p, scope = F.col("properties"), scope or []
    at = matchers.value(p, "health:performedDate")
    r = records.where((F.col("record_type") == "health:LabResultRecord") & text.is_known_origin(F.col("source_identity"))).select(
        *scope, "ord", "uri", "source_identity", text.code_value(matchers.value(p, "health:testCode")).alias("code"), at.alias("instant"), identity.property_fingerprint(p, IGNORED).alias("fingerprint")
    ).where((F.col("code") != "") & dates.states_time_of_day(F.col("instant")))
    g = r.groupBy(*scope, "code", "instant", "fingerprint").agg(
        F.min("ord").alias("canonical"), F.count("*").alias("n_members"), F.count_distinct("source_identity").alias("n_origins"), F.min_by("uri", "ord").alias("canonical_uri")
    )
    return g.where((F.col("n_members") > 1) & (F.col("n_members") == F.col("n_origins")))


def apply(live: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(live records left, journal rows): the discarded members of `merges` (``canonical_uri``, ``uri``) leave `live` (``uri``, ...), whole, into the journal.

    The canonical record stays; a member that is not there leaves nothing.
    """
    gone = merges.where(F.col("uri") != F.col("canonical_uri")).select("uri", "canonical_uri").distinct()
    one = gone.groupBy("uri").agg(F.min("canonical_uri").alias("canonical_uri"))
    return live.join(one.select("uri"), "uri", "left_anti"), live.join(one, "uri")


def undo_states(journal: DataFrame, live: DataFrame, buckets: DataFrame, restored: DataFrame) -> DataFrame:
    """(merge_id, status, reason): already-undone, restorable, or blocked by the first member that cannot come back.

    `journal`: ``merge_id``, ``uri``, ``record_type`` of each discarded member; `live`: ``uri``;
    `buckets`: ``record_type``, ``is_there``; `restored`: ``uri`` of members that are back.
    """
    j = (
        journal.join(restored.select("uri", F.lit(True).alias("back")).distinct(), "uri", "left")
        .join(live.select("uri", F.lit(True).alias("alive")).distinct(), "uri", "left")
        .join(buckets.groupBy("record_type").agg(F.bool_or("is_there").alias("is_there")), "record_type", "left")
    )
    why = (
        F.when(F.coalesce("alive", F.lit(False)), "live record").when(F.col("record_type").isNull(), "no type")
        .when(F.col("is_there").isNull(), "no bucket").when(~F.col("is_there"), "bucket gone")
    )
    g = j.groupBy("merge_id").agg(F.bool_and(F.coalesce("back", F.lit(False))).alias("done"), F.min(F.when(why.isNotNull(), F.struct("uri", why.alias("why"))))["why"].alias("reason"))
    status = F.when(F.col("done"), "already-undone").when(F.col("reason").isNotNull(), "blocked").otherwise("restorable")
    return g.select("merge_id", status.alias("status"), F.when(status == "blocked", F.col("reason")).alias("reason"))


def undo(live: DataFrame, journal: DataFrame, states: DataFrame) -> DataFrame:
    """`live` with the members of all restorable merges back in it."""
    back = journal.join(states.where("status = 'restorable'").select("merge_id"), "merge_id", "left_semi")
    return live.unionByName(back.select(*live.columns).dropDuplicates(["uri"]))


def resolutions(decisions: DataFrame) -> DataFrame:
    """Last decision on each conflict (``conflict_id``, ``resolved_at``, ``kept``, ``candidates``), with what it discards; in order of time."""
    last = decisions.groupBy("conflict_id").agg(F.max(F.struct("resolved_at", "kept", "candidates")).alias("d"))
    return last.select("conflict_id", "d.resolved_at", "d.kept", F.array_remove("d.candidates", F.col("d.kept")).alias("discarded")).orderBy("resolved_at", "conflict_id")


def open_conflicts(queue: DataFrame, decided: DataFrame) -> DataFrame:
    """The queue without decided conflicts."""
    return queue.join(decided.select("conflict_id").distinct(), "conflict_id", "left_anti")


def earliest(members: DataFrame, group: str, at: Column) -> DataFrame:
    """Earliest date of each group's members."""
    return members.groupBy(group).agg(F.min(at).alias("earliest"))
