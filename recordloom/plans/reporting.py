"""Source scans over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.common import read
from recordloom.sources import fhir, formats, turtle
from recordloom.plans.catalog import Catalog

CATALOG = Catalog()
query = CATALOG.query


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return fhir.records(fhir.entries(read(spark, sf, "raw_bundles"), "bundle_id", "payload"), "bundle_id")


_ENTRIES = """p AS (SELECT bundle_id, CASE WHEN json_valid(t) THEN t END::JSON AS j FROM (SELECT bundle_id, regexp_replace(payload, '^\ufeff', '') AS t FROM raw_bundles)),
e AS (SELECT bundle_id, ix::INT AS ix, j -> ('$.entry[' || ix || '].resource') AS r FROM (SELECT bundle_id, j, unnest(range(json_array_length(j, '$.entry')::BIGINT)) AS ix FROM p WHERE j ->> '$.resourceType' = 'Bundle')
  UNION ALL SELECT bundle_id, 0, j FROM p WHERE j ->> '$.resourceType' <> 'Bundle')"""


@query(
    f"""WITH {_ENTRIES} SELECT bundle_id, ix, r ->> '$.resourceType' AS resource_type, r ->> '$.id' AS resource_id, r ->> '$.status' AS status,
    try_cast(r ->> '$.valueQuantity.value' AS DOUBLE) AS value, r ->> '$.valueQuantity.unit' AS unit FROM e WHERE r ->> '$.resourceType' IS NOT NULL"""
)
def fhir_records(spark: SparkSession, sf: str) -> DataFrame:
    return _records(spark, sf).select("bundle_id", "ix", "resource_type", "resource_id", "status", "value", "unit")


@query(
    f"""WITH {_ENTRIES} SELECT resource_type, CASE WHEN resource_type IN {fhir.MAPPED} THEN 'mapped' WHEN resource_type IN {fhir.EXCLUDED} THEN 'excluded' ELSE 'passthrough' END AS strategy, count(*) AS n_resources
    FROM (SELECT r ->> '$.resourceType' AS resource_type FROM e) WHERE resource_type IS NOT NULL GROUP BY ALL"""
)
def import_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return fhir.manifest(_records(spark, sf))


@query()
def turtle_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Triples of the Turtle inputs; documents that cannot be parsed have one row with their error."""
    r = read(spark, sf, "recon_inputs").select(F.col("input_id").cast("string").alias("file"), F.col("content").alias("text"))
    return turtle.scan(r)


@query(
    """SELECT format, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(h, '^[\\[{]') AND regexp_matches(h, '"resourceType"') THEN 'fhir' WHEN regexp_matches(h, '^[\\[{]') THEN 'json' ELSE 'unknown' END AS format
    FROM (SELECT ltrim(regexp_replace(substr(payload, 1, 512), '^\ufeff', '')) AS h FROM raw_bundles)) GROUP BY format"""
)
def sniff_formats(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "raw_bundles").groupBy(formats.sniff(F.substring("payload", 1, 512)).alias("format")).agg(F.count("*").alias("n"))


@query()
def fhir_bundles_out(spark: SparkSession, sf: str) -> DataFrame:
    """Observations of each report's source and month as bundles; read back in the tests."""
    o = read(spark, sf, "observations").withColumn("batch", F.concat_ws("/", "source_system", "code", F.date_format("imported_at", "yyyy-MM-dd")))
    return fhir.observations_to_bundles(o, "batch")
