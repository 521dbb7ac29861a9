"""Overlays, erasure, conflicts, undo, patches and reports over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.common import read
from recordloom.operators import advisory, graph, narrative, overlay, triples
from recordloom.plans.catalog import Catalog
from recordloom.streaming import jobs

CATALOG = Catalog()
query = CATALOG.query


@query(
    """WITH o AS (SELECT event_id, user_id AS record, CASE event_type WHEN 'error' THEN 'retract' WHEN 'signup' THEN 'note' ELSE 'amend' END AS kind, event_type AS property, value, ts FROM events),
    gone AS (SELECT record, max((ts, event_id)) AS g FROM o WHERE kind = 'retract' GROUP BY record),
    last AS (SELECT record, property, max((ts, event_id)) AS k, arg_max(value, (ts, event_id)) AS value FROM o WHERE kind = 'amend' GROUP BY record, property)
    SELECT record, property, value FROM last LEFT JOIN gone USING (record) WHERE g IS NULL OR k > g"""
)
def overlay_effective(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "retract").when(F.col("event_type") == "signup", "note").otherwise("amend")
    o = read(spark, sf, "events").select(F.col("event_id").alias("overlay_id"), F.col("user_id").alias("record"), kind.alias("kind"), F.col("event_type").alias("property"), "value", F.col("ts").alias("created"))
    return overlay.effective(o).select("record", "property", "value")


@query("SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id, event_type")
def last_write_wins(spark: SparkSession, sf: str) -> DataFrame:
    return overlay.last_wins(read(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"], ["value"])


@query(
    """WITH t AS (SELECT DISTINCT uri AS s, record_type FROM records WHERE uri IS NOT NULL), gone AS (SELECT DISTINCT uri FROM records WHERE tombstoned_at IS NOT NULL)
    SELECT record_type, count(*) AS n_left FROM t WHERE s NOT IN (SELECT uri FROM gone WHERE uri IS NOT NULL) GROUP BY record_type"""
)
def erase_records(spark: SparkSession, sf: str) -> DataFrame:
    r = read(spark, sf, "records").where("uri IS NOT NULL")
    gone = r.where("tombstoned_at IS NOT NULL").select("uri").distinct()
    return r.select("uri", "record_type").distinct().join(gone, "uri", "left_anti").groupBy("record_type").agg(F.count("*").alias("n_left"))


@query("SELECT uri, arg_max(tombstoned_at IS NULL, ord) AS is_live, count(*) AS n_rows FROM records WHERE uri IS NOT NULL GROUP BY uri")
def latest_state(spark: SparkSession, sf: str) -> DataFrame:
    r = read(spark, sf, "records").where("uri IS NOT NULL")
    return r.groupBy("uri").agg(F.max_by(F.col("tombstoned_at").isNull(), "ord").alias("is_live"), F.count("*").alias("n_rows"))


@query(
    """SELECT source_system, count(*) AS n_incoming, count(*) FILTER (uri IN (SELECT uri FROM records WHERE from_existing AND uri IS NOT NULL)) AS n_known
    FROM (SELECT DISTINCT source_system, uri FROM records WHERE NOT from_existing AND uri IS NOT NULL) GROUP BY source_system"""
)
def import_new_vs_existing(spark: SparkSession, sf: str) -> DataFrame:
    r = read(spark, sf, "records").where("uri IS NOT NULL")
    existing = r.where("from_existing").select("uri", F.lit(1).alias("known")).distinct()
    incoming = r.where("NOT from_existing").select("source_system", "uri").distinct()
    return incoming.join(existing, "uri", "left").groupBy("source_system").agg(F.count("*").alias("n_incoming"), F.count("known").alias("n_known"))


_CONFLICTS = """c AS (SELECT DISTINCT canonical_uri AS conflict, d.uri AS uri FROM (SELECT canonical_uri, unnest(discarded) AS d FROM merge_journal)),
alive AS (SELECT DISTINCT object_uri AS uri FROM record_edges UNION SELECT canonical_uri FROM merge_journal), merged AS (SELECT DISTINCT uri FROM records WHERE tombstoned_at IS NOT NULL)"""


@query(
    f"""WITH {_CONFLICTS} SELECT conflict, n_candidates, n_alive, CASE WHEN any_merged THEN 'cleared' WHEN n_alive >= 2 THEN 'kept' ELSE 'orphan' END AS disposition FROM (
    SELECT conflict, count(*) AS n_candidates, count(*) FILTER (uri IN (SELECT uri FROM alive)) AS n_alive, bool_or(coalesce(uri IN (SELECT uri FROM merged), false)) AS any_merged FROM c GROUP BY conflict)"""
)
def pending_disposition(spark: SparkSession, sf: str) -> DataFrame:
    j = read(spark, sf, "merge_journal")
    candidates = j.select(F.col("canonical_uri").alias("conflict"), F.explode("discarded").alias("d")).select("conflict", F.col("d.uri").alias("uri"))
    alive = read(spark, sf, "record_edges").select(F.col("object_uri").alias("uri")).unionByName(j.select(F.col("canonical_uri").alias("uri")))
    merged = read(spark, sf, "records").where("tombstoned_at IS NOT NULL").select("uri")
    return overlay.disposition(candidates, alive, merged)


@query(
    """WITH live AS (SELECT DISTINCT uri FROM records WHERE tombstoned_at IS NULL AND uri IS NOT NULL),
    m AS (SELECT merge_id, canonical_uri, record_type, len(discarded) AS n_members, row_number() OVER (PARTITION BY canonical_uri ORDER BY applied_at DESC, merge_id DESC) AS k FROM merge_journal)
    SELECT merge_id, CASE WHEN k > 1 THEN 'superseded' WHEN canonical_uri IN (SELECT uri FROM live) THEN 'blocked_live' WHEN record_type IS NULL THEN 'blocked_no_type' WHEN n_members < 2 THEN 'nothing_to_restore' ELSE 'restorable' END AS feasibility FROM m"""
)
def undo_feasibility(spark: SparkSession, sf: str) -> DataFrame:
    j = read(spark, sf, "merge_journal").select("merge_id", "canonical_uri", "record_type", "applied_at", F.size("discarded").alias("n_members"))
    newest = j.groupBy("canonical_uri").agg(F.max(F.struct("applied_at", "merge_id")).alias("n")).select("canonical_uri", F.col("n.merge_id").alias("newest"))
    live = graph.live_records(read(spark, sf, "records")).select(F.col("uri").alias("canonical_uri"), F.lit(True).alias("live"))
    f = (
        F.when(F.col("merge_id") != F.col("newest"), "superseded")
        .when(F.col("live"), "blocked_live")
        .when(F.col("record_type").isNull(), "blocked_no_type")
        .when(F.col("n_members") < 2, "nothing_to_restore")
        .otherwise("restorable")
    )
    return j.join(newest, "canonical_uri").join(live, "canonical_uri", "left").select("merge_id", f.alias("feasibility"))


_TEMPLATE = [("advisory:flag", "review"), ("advisory:level", "2")]


@query("SELECT 'urn:part:' || p_partkey AS s, unnest(['advisory:flag', 'advisory:level']) AS p, unnest(['review', '2']) AS o, 'urn:activity:1' AS activity FROM part WHERE p_type = 'ECONOMY'")
def advisory_apply(spark: SparkSession, sf: str) -> DataFrame:
    bound = read(spark, sf, "part").where("p_type = 'ECONOMY'").select(F.concat(F.lit("urn:part:"), F.col("p_partkey")).alias("s"))
    return overlay.apply_template(bound, _TEMPLATE, "urn:activity:1")


@query("SELECT 'urn:part:' || p_partkey AS s, unnest(['type', 'rdf:type']) AS p, unnest([p_type, 'Part']) AS o FROM part")
def advisory_revert(spark: SparkSession, sf: str) -> DataFrame:
    part = read(spark, sf, "part")
    base = triples.unpivot(part, F.concat(F.lit("urn:part:"), F.col("p_partkey")), {"p_type": "type"}, "Part").withColumn("activity", F.lit(None).cast("string"))
    return overlay.revert(base.unionByName(advisory_apply(spark, sf)), F.lit("urn:activity:1")).drop("activity")


@query(
    """WITH l AS (SELECT source_system, max(imported_at)::DATE AS last FROM import_reports GROUP BY source_system), t AS (SELECT source_system, CASE trust_rank % 4 WHEN 0 THEN 'immediate' WHEN 1 THEN 'monthly' WHEN 2 THEN 'quarterly' ELSE 'yearly' END AS tier FROM source_systems)
    SELECT source_system, tier, last::VARCHAR AS last_import, coalesce(date_diff('day', last, DATE '2026-02-01') >= CASE tier WHEN 'immediate' THEN 0 WHEN 'monthly' THEN 30 WHEN 'quarterly' THEN 91 ELSE 365 END, true) AS is_due FROM t LEFT JOIN l USING (source_system)"""
)
def cadence_due(spark: SparkSession, sf: str) -> DataFrame:
    """Sources whose next check is due, by the tier of their trust and their last import."""
    last = read(spark, sf, "import_reports").groupBy("source_system").agg(F.max("imported_at").cast("date").alias("last"))
    rank = F.col("trust_rank") % 4
    tier = F.when(rank == 0, "immediate").when(rank == 1, "monthly").when(rank == 2, "quarterly").otherwise("yearly")
    t = read(spark, sf, "source_systems").select("source_system", tier.alias("tier")).join(last, "source_system", "left")
    return t.select("source_system", "tier", F.col("last").cast("string").alias("last_import"), advisory.due(F.col("tier"), F.col("last"), F.lit("2026-02-01")).alias("is_due"))


# --- reports ---


@query("SELECT date_trunc('day', ts)::DATE::VARCHAR AS day, event_type, min(value) AS lowest, max(value) AS highest, count(*) AS n, round(avg(value), 1) AS mean FROM events GROUP BY ALL")
def daily_downsample(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").groupBy(F.col("ts").cast("date").cast("string").alias("day"), "event_type")
    return e.agg(F.min("value").alias("lowest"), F.max("value").alias("highest"), F.count("*").alias("n"), F.round(F.avg("value"), 1).alias("mean"))


@query(
    "SELECT coalesce(source_system, 'unknown') AS source_system, record_type, count(*) AS n_records, count(*) FILTER (tombstoned_at IS NOT NULL) AS n_deleted, count(*) FILTER (from_existing) AS n_existing FROM records GROUP BY ALL"
)
def source_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    r = read(spark, sf, "records").groupBy(F.coalesce("source_system", F.lit("unknown")).alias("source_system"), "record_type")
    return r.agg(F.count("*").alias("n_records"), F.count_if(F.col("tombstoned_at").isNotNull()).alias("n_deleted"), F.count_if("from_existing").alias("n_existing"))


@query(
    """SELECT r.report_id, r.resource_count, coalesce(n, 0) AS n_inputs, round(coalesce(n, 0) / nullif(r.resource_count, 0)::DOUBLE, 6) AS completeness, len(warnings) AS n_warnings
    FROM import_reports r LEFT JOIN (SELECT report_id, count(*) AS n FROM recon_inputs GROUP BY report_id) i ON i.report_id = r.report_id"""
)
def import_completeness(spark: SparkSession, sf: str) -> DataFrame:
    n = read(spark, sf, "recon_inputs").groupBy("report_id").agg(F.count("*").alias("n"))
    j = read(spark, sf, "import_reports").join(n, "report_id", "left")
    got = F.coalesce("n", F.lit(0))
    return j.select("report_id", "resource_count", got.alias("n_inputs"), F.round(got / F.nullif("resource_count", F.lit(0)), 6).alias("completeness"), F.when(F.col("warnings").isNotNull(), F.size("warnings")).alias("n_warnings"))


@query("SELECT warning, count(*) AS n FROM (SELECT unnest(warnings) AS warning FROM import_reports) GROUP BY warning")
def import_warnings(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "import_reports").select(F.explode("warnings").alias("warning")).groupBy("warning").agg(F.count("*").alias("n"))


@query()
def narrative_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Texts in chunks of at most 600 characters; joined they are the text, which the tests check."""
    return narrative.chunks(read(spark, sf, "documents"), "doc_id", "text", 600)


# --- streams, run to their end ---


@query("SELECT date_trunc('day', ts)::DATE::VARCHAR AS day, event_type, min(value) AS lowest, max(value) AS highest, count(*) AS n, round(avg(value), 1) AS mean FROM events GROUP BY ALL")
def stream_downsample(spark: SparkSession, sf: str) -> DataFrame:
    """The daily downsample as a stream."""
    return jobs.run_to_end(jobs.daily_downsample(jobs.events_stream(spark, sf)))


@query(
    """SELECT user_id, count(*) AS n_sessions, sum(n)::BIGINT AS n_events FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(CASE WHEN gap > INTERVAL 30 MINUTE OR gap IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
      FROM (SELECT user_id, ts, event_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)) GROUP BY ALL) GROUP BY user_id"""
)
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of the users, found by a stream."""
    s = jobs.run_to_end(jobs.sessions(jobs.events_stream(spark, sf)))
    return s.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.sum("n_events").alias("n_events"))


@query("SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type")
def stream_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """Events without repeats, by a stream."""
    e = jobs.run_to_end(jobs.distinct_events(jobs.events_stream(spark, sf), ["event_id"]), "append")
    return e.groupBy("event_type").agg(F.count("*").alias("n"))
