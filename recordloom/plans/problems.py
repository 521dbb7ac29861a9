"""The data-preparation queries (general problems) over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.common import cut, read
from recordloom.operators import nested, orphans, timestamps, units


def _instant_values(spark: SparkSession, sf: str) -> DataFrame:
    obs, med = read(spark, sf, "observations"), read(spark, sf, "medications")

    def field(df: DataFrame, table: str, key: str, name: str) -> DataFrame:
        return df.select(
            F.lit(table).alias("table_name"), F.col(key).alias("row_id"), F.lit(name).alias("field_name"), "source_system", F.col(name).alias("value")
        )

    return (
        field(obs, "observations", "obs_id", "effective_date_time")
        .unionByName(field(med, "medications", "med_id", "authored_on"))
        .unionByName(field(med, "medications", "med_id", "effective_start"))
    )


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """UTC instants of the three timestamp fields."""
    return timestamps.normalise(_instant_values(spark, sf), read(spark, sf, "source_systems")).drop("source_system")


def p2_zones(spark: SparkSession, sf: str) -> DataFrame:
    """Zones of the sources with the version of the transition tables that were used, and how many changes these hold."""
    return timestamps.zone_summary(read(spark, sf, "source_systems"))


def _orphans(spark: SparkSession, sf: str) -> orphans.Orphans:
    obs, med, rep = read(spark, sf, "observations"), read(spark, sf, "medications"), read(spark, sf, "reports")
    edges, patients, records = read(spark, sf, "record_edges"), read(spark, sf, "patients"), read(spark, sf, "records")

    def month(at: str) -> F.Column:
        return F.trunc(F.col(at).cast("date"), "MM")

    def subjects(df: DataFrame, table: str, key: str) -> DataFrame:
        return df.select(
            F.lit(table).alias("table_name"), F.col(key).alias("row_id"), F.col("subject_reference").alias("reference"),
            month("imported_at").alias("period"), *orphans.typed_reference("subject_reference", "source_system", "Patient"),
        )

    results = rep.select("report_id", "source_system", "imported_at", F.explode("result_references").alias("reference")).select(
        F.lit("reports").alias("table_name"), F.col("report_id").alias("row_id"), "reference",
        month("imported_at").alias("period"), *orphans.typed_reference("reference", "source_system", "Observation"),
    )
    objects = edges.select(
        F.lit("record_edges").alias("table_name"), F.col("edge_id").alias("row_id"), F.col("object_uri").alias("reference"),
        month("asserted_at").alias("period"), *orphans.plain_reference("object_uri", "record"),
    )
    refs = subjects(obs, "observations", "obs_id")
    for more in (subjects(med, "medications", "med_id"), subjects(rep, "reports", "report_id"), results, objects):
        refs = refs.unionByName(more)
    alive = F.col("tombstoned_at").isNull()
    targets = (
        orphans.resource_targets(patients, "Patient", alive)
        .unionByName(orphans.resource_targets(obs, "Observation"))
        .unionByName(orphans.iri_targets(records, "uri", "record", alive))
    )
    return orphans.Orphans(refs, targets)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Dangling references of every table, verbatim."""
    return _orphans(spark, sf).rows()


def p4_orphans_per_month(spark: SparkSession, sf: str) -> DataFrame:
    """Dangling references per table and month."""
    return _orphans(spark, sf).counts()


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Values in the common unit of their measure."""
    return units.convert(read(spark, sf, "observations"), read(spark, sf, "measures"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Given names with their links."""
    return nested.given_names(read(spark, sf, "raw_bundles"))


def p6_resources(spark: SparkSession, sf: str) -> DataFrame:
    """All nested resources with the resource around them."""
    return nested.resources(read(spark, sf, "raw_bundles"))


def p6_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Every path of the payloads: how many rows its flat table has, in how many payloads, under how many parents."""
    tree = nested.nodes(read(spark, sf, "raw_bundles"))
    return tree.groupBy("path", "kind").agg(
        F.count("*").alias("n_rows"), F.count_distinct("bundle_id").alias("n_payloads"), F.count("value").alias("n_values"), F.max("ix").alias("largest_ix")
    )


def p6_table(spark: SparkSession, sf: str) -> DataFrame:
    """The flat table of the bundles' resources, with the entries that hold them."""
    tree = cut(nested.nodes(read(spark, sf, "raw_bundles")))
    return nested.table(tree, "entry[].resource", ["resourceType", "id", "status", "gender"])


QUERIES = {
    "p2_found": p2_found,
    "p2_zones": p2_zones,
    "p4_found": p4_found,
    "p4_orphans_per_month": p4_orphans_per_month,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_resources": p6_resources,
    "p6_paths": p6_paths,
    "p6_table": p6_table,
}

_REFS = """refs AS (
  SELECT 'observations' AS table_name, obs_id AS row_id, subject_reference AS reference, source_system AS src, 'Patient' AS t, date_trunc('month', imported_at)::date AS period FROM observations
  UNION ALL SELECT 'medications', med_id, subject_reference, source_system, 'Patient', date_trunc('month', imported_at)::date FROM medications
  UNION ALL SELECT 'reports', report_id, subject_reference, source_system, 'Patient', date_trunc('month', imported_at)::date FROM reports
  UNION ALL SELECT 'reports', report_id, unnest(result_references), source_system, 'Observation', date_trunc('month', imported_at)::date FROM reports
  UNION ALL SELECT 'record_edges', edge_id, object_uri, '', 'record', date_trunc('month', asserted_at)::date FROM record_edges),
keyed AS (
  SELECT *, CASE WHEN t <> 'record' AND NOT regexp_matches(bare, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN 'id:' || bare ELSE 'url:' || bare END AS k
  FROM (SELECT *, regexp_replace(reference, '/_history(/.*)?$', '') AS bare FROM refs WHERE reference IS NOT NULL AND trim(reference) <> '' AND reference NOT LIKE '#%')),
targets AS (
  SELECT 'Patient' AS t, source_system AS src, 'id:Patient/' || resource_id AS k FROM patients WHERE tombstoned_at IS NULL
  UNION ALL SELECT 'Patient', source_system, 'url:' || full_url FROM patients WHERE tombstoned_at IS NULL
  UNION ALL SELECT 'Observation', source_system, 'id:Observation/' || resource_id FROM observations
  UNION ALL SELECT 'Observation', source_system, 'url:' || full_url FROM observations
  UNION ALL SELECT 'record', '', 'url:' || uri FROM records WHERE tombstoned_at IS NULL),
orphans AS (SELECT * FROM keyed r WHERE NOT EXISTS (SELECT 1 FROM targets g WHERE g.t = r.t AND g.src = r.src AND g.k = r.k))"""

ORACLE_SQL: dict[str, str] = {
    "p4_found": f"WITH {_REFS} SELECT DISTINCT table_name, row_id, reference FROM orphans",
    "p4_orphans_per_month": f"WITH {_REFS} SELECT table_name, strftime(period, '%Y-%m') AS period, count(*) AS n_orphans, count(DISTINCT (t, src, k)) AS n_missing_keys FROM orphans GROUP BY ALL",
}
