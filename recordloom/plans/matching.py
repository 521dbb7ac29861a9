"""Reconciliation of the journaled members: keys, pairs, groups, strategies, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.common import cut, read
from recordloom.operators import matchers
from recordloom.plans.catalog import Catalog

CATALOG = Catalog()
query = CATALOG.query

# What the journal calls the types and properties that the matchers read.
TYPES = {"clinical:LabResultRecord": "health:LabResultRecord", "clinical:ConditionRecord": "health:ConditionRecord", "clinical:MedicationRecord": "clinical:Medication", "profile:PatientProfile": "core:PatientProfile"}
RENAMED = {"profile:birthDate": "core:dateOfBirth"}


def members(spark: SparkSession, sf: str) -> DataFrame:
    """Members of the journaled merges as records; a pod is a scope, ``ord`` the place in the journal."""
    d = read(spark, sf, "merge_journal").select("merge_id", "pod_id", F.posexplode("discarded").alias("place", "d")).where(F.col("d").isNotNull())
    kind = F.col("d.record_type")
    renamed = F.transform_keys(F.col("d.properties"), lambda k, _: F.when(k == "profile:birthDate", "core:dateOfBirth").when((k == "clinical:status") & (kind == "clinical:ConditionRecord"), "health:status").otherwise(k))
    # The journal's drug codes are of one system.
    properties = F.transform_values(renamed, lambda k, v: F.when(k == "clinical:drugCode", F.transform(v, lambda x: x.withField("value", F.concat(F.lit("http://www.nlm.nih.gov/research/umls/rxnorm/"), x["value"])))).otherwise(v))
    named = F.coalesce(*[F.when(kind == old, new) for old, new in TYPES.items()], kind)
    return d.select(
        (F.col("merge_id") * 1000 + F.col("place")).alias("ord"), F.col("pod_id").alias("scope"), F.col("d.uri").alias("uri"), named.alias("record_type"), F.col("d.source_system").alias("source_system"),
        F.col("d.source_identity").alias("source_identity"), F.lit(False).alias("from_existing"), properties.alias("properties"),
    )


_MEMBERS = r"""m AS (SELECT merge_id * 1000 + i - 1 AS ord, pod_id AS scope, d.record_type AS t, d.source_system AS src, CASE WHEN starts_with(d.source_identity, 'org:') OR starts_with(d.source_identity, 'ns:') THEN d.source_identity END AS origin, d.properties AS p
  FROM (SELECT merge_id, pod_id, unnest(discarded) AS d, generate_subscripts(discarded, 1) AS i FROM merge_journal)),
f AS (SELECT ord, scope, t, src, origin, p['health:conditionName'][1].value AS cname, p['health:testCode'][1].value AS tcode, p['health:performedDate'][1].value AS tday, p['health:testName'][1].value AS tname,
  try_cast(nullif(regexp_extract(p['health:resultValue'][1].value, '^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)', 1), '') AS DOUBLE) AS x, p['profile:birthDate'][1].value AS born, p['clinical:drugCode'] AS drugs FROM m),
k AS (
  SELECT ord, scope, t, src, origin, NULL::DOUBLE AS x, 0.8::DOUBLE AS c, 'name:' || n AS key FROM (SELECT *, trim(regexp_replace(regexp_replace(lower(cname), '\([^)]*\)', '', 'g'), '\s+', ' ', 'g')) AS n FROM f WHERE t = 'clinical:ConditionRecord') WHERE n <> ''
  UNION ALL SELECT ord, scope, t, src, origin, x, 0.9, 'loinc:' || code || '+' || day FROM (SELECT *, regexp_extract(regexp_extract(tcode, '[^/]*$'), '[^#]*$') AS code, regexp_extract(tday, '^[^T]*') AS day FROM f WHERE t = 'clinical:LabResultRecord') WHERE code <> '' AND day <> ''
  UNION ALL SELECT ord, scope, t, src, origin, x, 0.75, 'name:' || n || '+' || day FROM (SELECT *, trim(lower(tname)) AS n, regexp_extract(tday, '^[^T]*') AS day FROM f WHERE t = 'clinical:LabResultRecord') WHERE n <> '' AND day <> ''
  UNION ALL SELECT ord, scope, t, src, origin, x, 0.75, 'dob:' || born FROM f WHERE t = 'profile:PatientProfile' AND born <> ''
  UNION ALL SELECT DISTINCT ord, scope, t, src, origin, x, 1.0, 'rxnorm:' || code FROM (SELECT *, regexp_extract(regexp_extract(d.value, '[^/]*$'), '[^#]*$') AS code FROM (SELECT *, unnest(drugs) AS d FROM f WHERE t = 'clinical:MedicationRecord')) WHERE code <> ''),
pairs AS (SELECT a.ord AS lo, b.ord AS hi, a.key AS key, CASE WHEN a.t = 'clinical:LabResultRecord' AND starts_with(a.key, 'loinc:') THEN
    CASE WHEN a.x IS NULL OR b.x IS NULL THEN a.c WHEN a.x = b.x THEN 1.0 WHEN abs(a.x - b.x) / greatest(abs(a.x), 0.001) <= 0.05 THEN 0.9 ELSE 0.85 END ELSE a.c END::DOUBLE AS c
  FROM k a JOIN k b ON a.scope = b.scope AND a.t = b.t AND a.key = b.key AND a.ord < b.ord AND NOT (a.src IS NOT DISTINCT FROM b.src AND coalesce(a.origin = b.origin, true)))"""


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return matchers.matches(members(spark, sf))


@query(f"WITH {_MEMBERS} SELECT lo, hi, max((c, key))[1] AS confidence, max((c, key))[2] AS matched_on FROM pairs WHERE c >= 0.65 GROUP BY lo, hi")
def match_records(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of members by the strongest key of their type's matcher."""
    return _pairs(spark, sf)


@query(f"WITH {_MEMBERS} SELECT t AS record_type, regexp_extract(key, '^[^:]*') AS tier, count(*) AS n_keys, count(DISTINCT key) AS n_distinct FROM k GROUP BY ALL")
def match_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys by type and tier."""
    p = matchers.prepared(members(spark, sf)).select("record_type", F.explode("keys").alias("k"))
    named = F.coalesce(*[F.when(F.col("record_type") == new, old) for old, new in TYPES.items()], F.col("record_type"))
    return p.groupBy(named.alias("record_type"), F.substring_index("k.key", ":", 1).alias("tier")).agg(F.count("*").alias("n_keys"), F.count_distinct("k.key").alias("n_distinct"))


def _resolution(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    m = members(spark, sf)
    groups = cut(matchers.grouped(m, cut(matchers.matches(m))))
    return m, groups, matchers.resolved(m, groups)


@query()
def resolve_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of two records or more: kind, strategy, winner, status, conflict key; a literal loop is the test."""
    return _resolution(spark, sf)[2].where("n_members > 1")


@query()
def reconciliation_counters(spark: SparkSession, sf: str) -> DataFrame:
    """All counters of the reconciliation."""
    m, _, resolution = _resolution(spark, sf)
    return matchers.summary(resolution, m.agg(F.count("*")).scalar())


@query()
def merged_records(spark: SparkSession, sf: str) -> DataFrame:
    """Surviving properties of the groups of several records."""
    m, groups, resolution = _resolution(spark, sf)
    several = resolution.where("n_members > 1")
    return matchers.merged_values(m, groups, several).select("canonical_uri", "predicate", F.transform("values", lambda v: v["value"]).alias("values"))


@query(f"WITH {_MEMBERS} SELECT record_type, conflict_id, count(*) AS n_rows FROM (SELECT t AS record_type, substr(regexp_replace(t || '::' || key, '[^a-zA-Z0-9:+./-]', '_', 'g'), 1, 80) AS conflict_id FROM k) GROUP BY ALL")
def conflict_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Keys under which decisions about conflicts would be kept."""
    from recordloom.functions import text

    p = matchers.prepared(members(spark, sf)).select("record_type", F.explode("keys").alias("k"))
    named = F.coalesce(*[F.when(F.col("record_type") == new, old) for old, new in TYPES.items()], F.col("record_type"))
    return p.select(named.alias("record_type"), F.col("k.key").alias("key")).groupBy("record_type", text.conflict_id(F.col("record_type"), F.col("key")).alias("conflict_id")).agg(F.count("*").alias("n_rows"))
