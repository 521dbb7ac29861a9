"""Reconciliation over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.common import read, small_side
from recordloom.functions import text
from recordloom.operators import reconcile, timestamps
from recordloom.plans.catalog import Catalog

CATALOG = Catalog()
query = CATALOG.query

BAND_SECONDS = 30 * 60
_VITALS = """ev AS (SELECT user_id, event_type, epoch_us(ts) // 1000000 AS sec, value, event_id % 2 AS src, event_id FROM events),
reps AS (SELECT user_id, event_type, sec, value, src, min(event_id) AS rep FROM ev GROUP BY ALL)"""
_VITAL_PAIRS = f"""{_VITALS}, vp AS (SELECT lo, hi, confidence FROM (SELECT a.rep AS lo, b.rep AS hi,
  CASE WHEN a.value IS NULL OR b.value IS NULL THEN 0.85 WHEN d = 0 THEN 1.0 WHEN d <= 0.05 THEN 0.95 WHEN d <= 0.15 THEN 0.75 END::DOUBLE AS confidence
  FROM (SELECT a, b, abs(a.value - b.value) / greatest(abs(a.value), abs(b.value), 0.001) AS d FROM reps a JOIN reps b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.rep < b.rep AND a.src <> b.src AND abs(a.sec - b.sec) <= {BAND_SECONDS}))
  WHERE confidence >= 0.65)"""


def _vital_reps(spark: SparkSession, sf: str) -> DataFrame:
    ev = read(spark, sf, "events").select("user_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), "value", (F.col("event_id") % 2).alias("src"), "event_id")
    return reconcile.representatives(ev, ["user_id", "event_type", "at", "value", "src"], "event_id").drop("n_members")


def _vital_pairs(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.col("a_value"), F.col("b_value")
    confidence = reconcile.value_confidence(a, b, [(0.0, 1.0), (0.05, 0.95), (0.15, 0.75)], 0.85, F.greatest(F.abs(a), F.abs(b)))
    return reconcile.band_pairs(_vital_reps(spark, sf), ["user_id", "event_type"], "at", BAND_SECONDS, "src", confidence)


@query(f"WITH {_VITAL_PAIRS} SELECT * FROM vp")
def match_band(spark: SparkSession, sf: str) -> DataFrame:
    return _vital_pairs(spark, sf)


def _lab_reps(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct lab statements by pod, code, UTC day, source and value: the day of the instant, else the date as stated."""
    o = read(spark, sf, "observations").where(F.col("code").startswith("LB-") & F.col("effective_date_time").isNotNull())
    labs = o.select("pod_id", "code", "source_system", F.col("effective_date_time").alias("value"), F.col("source_system").alias("src"), "quantity_value", "obs_id")
    timed = timestamps.normalise(labs, read(spark, sf, "source_systems")).withColumn("day", F.to_date(F.timestamp_micros("utc_us")).cast("string"))
    dated = labs.where(F.trim("value").rlike(r"^\d{4}-\d{2}-\d{2}$")).withColumn("day", F.trim("value").try_cast("date").cast("string")).where("day IS NOT NULL")
    cols = ["pod_id", "code", "day", "src", F.col("quantity_value").alias("value"), "obs_id"]
    return reconcile.representatives(timed.select(*cols).unionByName(dated.select(*cols)), ["pod_id", "code", "day", "src", "value"], "obs_id")


@query()
def match_labs(spark: SparkSession, sf: str) -> DataFrame:
    """Labs of one code on one day, from different sources; held against brute force in the tests."""
    a, b = F.col("a_value"), F.col("b_value")
    confidence = reconcile.value_confidence(a, b, [(0.0, 1.0), (0.05, 0.9), (1e300, 0.85)], 0.9, F.abs(a))
    return reconcile.equi_pairs(_lab_reps(spark, sf).drop("n_members"), ["pod_id", "code", "day"], "src", confidence)


@query()
def lab_representatives(spark: SparkSession, sf: str) -> DataFrame:
    return _lab_reps(spark, sf).select("rep", "pod_id", "code", "day", "src", "value", "n_members")


_MEDS = r"""m AS (SELECT med_id, pod_id, source_system AS src, drug_code AS code, trim(regexp_replace(regexp_replace(regexp_replace(lower(medication_text), '\d+(\.\d+)?\s*(mg|mcg|g|ml|%|iu|units?|meq)\b', '', 'g'), '\b(oral|tablet|capsule|solution|injection|extended|release|er|xr|cr|sr|hr)\b', '', 'g'), '\s+', ' ', 'g')) AS name FROM medications),
reps AS (SELECT pod_id, src, code, name, min(med_id) AS rep FROM m GROUP BY ALL),
by_code AS (SELECT a.rep AS lo, b.rep AS hi, 1.0::DOUBLE AS confidence, 'code' AS matched_on FROM reps a JOIN reps b ON a.pod_id = b.pod_id AND a.code = b.code AND a.rep < b.rep AND a.src <> b.src),
by_name AS (SELECT a.rep AS lo, b.rep AS hi, 0.85::DOUBLE AS confidence, 'name' AS matched_on FROM reps a JOIN reps b ON a.pod_id = b.pod_id AND a.name = b.name AND a.rep < b.rep AND a.src <> b.src WHERE a.name <> '')"""


@query(f"WITH {_MEDS} SELECT lo, hi, max(confidence) AS confidence, arg_max(matched_on, confidence) AS matched_on FROM (SELECT * FROM by_code UNION ALL SELECT * FROM by_name) GROUP BY lo, hi")
def match_ladder(spark: SparkSession, sf: str) -> DataFrame:
    """Medications by the strongest shared key: code before name, each tier its own equi-join."""
    m = read(spark, sf, "medications").select("med_id", "pod_id", F.col("source_system").alias("src"), F.col("drug_code").alias("code"), text.medication_name(F.col("medication_text")).alias("name"))
    reps = reconcile.representatives(m, ["pod_id", "src", "code", "name"], "med_id").drop("n_members")
    by_code = reconcile.equi_pairs(reps.where("code IS NOT NULL").drop("name"), ["pod_id", "code"], "src", F.lit(1.0)).withColumn("matched_on", F.lit("code"))
    by_name = reconcile.equi_pairs(reps.where("name <> ''").drop("code"), ["pod_id", "name"], "src", F.lit(0.85)).withColumn("matched_on", F.lit("name"))
    best = by_code.unionByName(by_name).groupBy("lo", "hi").agg(F.max(F.struct("confidence", "matched_on")).alias("b"))
    return best.select("lo", "hi", "b.confidence", "b.matched_on")


_PEOPLE = "reps AS (SELECT pod_id, birth_date, gender, source_system AS src, min(patient_id) AS rep FROM patients GROUP BY ALL)"


@query(
    f"""WITH {_PEOPLE} SELECT a.rep AS lo, b.rep AS hi, CASE WHEN a.gender = b.gender THEN 0.95 ELSE 0.75 END::DOUBLE AS confidence
    FROM reps a JOIN reps b ON a.pod_id = b.pod_id AND a.birth_date = b.birth_date AND a.rep < b.rep AND a.src <> b.src"""
)
def match_people(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "patients").select("pod_id", "birth_date", "gender", F.col("source_system").alias("src"), "patient_id")
    reps = reconcile.representatives(p, ["pod_id", "birth_date", "gender", "src"], "patient_id").drop("n_members")
    confidence = F.when(F.col("a_gender") == F.col("b_gender"), 0.95).otherwise(0.75)
    return reconcile.equi_pairs(reps, ["pod_id", "birth_date"], "src", confidence)


def _groups(spark: SparkSession, sf: str) -> DataFrame:
    reps = _vital_reps(spark, sf)
    return reconcile.greedy_groups(reps.select("rep", "user_id", "event_type"), _vital_pairs(spark, sf), ("user_id", "event_type"))


@query()
def greedy_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Seed of each representative; order-dependent, so checked against a literal loop in the tests."""
    return _groups(spark, sf)


@query()
def classify_groups(spark: SparkSession, sf: str) -> DataFrame:
    g = _groups(spark, sf).join(read(spark, sf, "events").select(F.col("event_id").alias("rep"), "value", "event_type"), "rep")
    return reconcile.classify(g, "seed", "rep", "value", "event_type")


@query()
def reconcile_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Groups by size, in one aggregation."""
    sizes = _groups(spark, sf).groupBy("seed").agg(F.count("*").alias("n_members"))
    return sizes.groupBy("n_members").agg(F.count("*").alias("n_groups"))


@query(
    """SELECT source_system, resource_id, count(*) AS n_members, min(obs_id) AS canonical FROM observations WHERE source_system IS NOT NULL AND resource_id IS NOT NULL
    GROUP BY ALL HAVING count(*) > 1 AND count(DISTINCT sha256(concat_ws('|', coalesce(code, ''), coalesce(effective_date_time, ''), coalesce(quantity_unit, ''), coalesce(value_string, ''), coalesce(note, '')))) = 1 AND count(DISTINCT quantity_value) <= 1"""
)
def tier0_merges(spark: SparkSession, sf: str) -> DataFrame:
    """Records delivered again with the same content: safe to merge without asking."""
    o = read(spark, sf, "observations").where("source_system IS NOT NULL AND resource_id IS NOT NULL")
    content = F.sha2(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ("code", "effective_date_time", "quantity_unit", "value_string", "note")]), 256)
    g = o.withColumn("content", content).groupBy("source_system", "resource_id").agg(
        F.count("*").alias("n_members"), F.min("obs_id").alias("canonical"), F.min("content").alias("c1"), F.max("content").alias("c2"),
        F.min("quantity_value").alias("v1"), F.max("quantity_value").alias("v2"),
    )
    return g.where((F.col("n_members") > 1) & (F.col("c1") == F.col("c2")) & F.col("v1").eqNullSafe(F.col("v2"))).select("source_system", "resource_id", "n_members", "canonical")


_RANKED = "ranked AS (SELECT p.*, s.trust_rank FROM patients p JOIN source_systems s USING (source_system))"


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "patients").join(small_side(read(spark, sf, "source_systems").select("source_system", "trust_rank")), "source_system")


@query(f"WITH {_RANKED} SELECT pod_id, count(*) AS n_members, arg_min(source_system, trust_rank * 1000000000::BIGINT + patient_id) AS winner_source, min_by(patient_id, trust_rank * 1000000000::BIGINT + patient_id) AS winner FROM ranked GROUP BY pod_id")
def resolve_trust(spark: SparkSession, sf: str) -> DataFrame:
    rank = F.struct("trust_rank", "patient_id")
    return _ranked(spark, sf).groupBy("pod_id").agg(F.count("*").alias("n_members"), F.min_by("source_system", rank).alias("winner_source"), F.min_by("patient_id", rank).alias("winner"))


@query(
    f"WITH {_RANKED} SELECT pod_id, count(*) AS n_members, "
    + ", ".join(f"arg_min({f}, trust_rank * 1000000000::BIGINT + patient_id) FILTER ({f} IS NOT NULL) AS {f}" for f in ("family_name", "gender", "birth_date"))
    + " FROM ranked GROUP BY pod_id"
)
def merge_values(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile.merge_values(_ranked(spark, sf), ["pod_id"], F.struct("trust_rank", "patient_id"), ["family_name", "gender", "birth_date"])


@query(
    """WITH c AS (SELECT lower(family_name) AS f, birth_date AS b, pod_id AS t FROM patients WHERE family_name IS NOT NULL AND birth_date IS NOT NULL),
    hit AS (SELECT sum(n * (n - 1) / 2) AS x FROM (SELECT count(*) AS n FROM c GROUP BY f, b, t)), said AS (SELECT sum(n * (n - 1) / 2) AS x FROM (SELECT count(*) AS n FROM c GROUP BY f, b)), meant AS (SELECT sum(n * (n - 1) / 2) AS x FROM (SELECT count(*) AS n FROM c GROUP BY t))
    SELECT hit.x::BIGINT AS n_hit, said.x::BIGINT AS n_predicted, meant.x::BIGINT AS n_true, round(hit.x / said.x, 6) AS precision, round(hit.x / meant.x, 6) AS recall FROM hit, said, meant"""
)
def pair_precision_recall(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "patients").where("family_name IS NOT NULL AND birth_date IS NOT NULL").select(F.lower("family_name").alias("f"), F.col("birth_date").alias("b"), F.col("pod_id").alias("t"))
    return reconcile.class_scores(p, ["f", "b"], ["t"])
