"""FHIR JSON: bundles to typed records, and records to bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The first of these paths that a resource has is its label, its instant, its coded key.
LABELS = ["$.code.text", "$.code.coding[0].display", "$.medicationCodeableConcept.text", "$.vaccineCode.text", "$.name[0].text", "$.type.text", "$.description"]
INSTANTS = ["$.effectiveDateTime", "$.effectivePeriod.start", "$.authoredOn", "$.onsetDateTime", "$.recordedDate", "$.performedDateTime", "$.occurrenceDateTime", "$.period.start", "$.date", "$.created", "$.issued"]
CODES = ["$.code.coding[0].code", "$.medicationCodeableConcept.coding[0].code", "$.vaccineCode.coding[0].code"]
SUBJECTS = ["$.subject.reference", "$.patient.reference", "$.beneficiary.reference"]
# Resource types with a converter; the rest passes through whole.
MAPPED = (
    "MedicationStatement", "MedicationRequest", "Condition", "AllergyIntolerance", "Observation", "Procedure", "DocumentReference", "Encounter",
    "DiagnosticReport", "MedicationAdministration", "Device", "ImagingStudy", "Patient", "Immunization", "Coverage", "Claim", "ExplanationOfBenefit",
)
EXCLUDED = ("OperationOutcome", "Bundle", "Parameters", "CapabilityStatement", "StructureDefinition")


def _first(v: Column, paths: list[str]) -> Column:
    return F.coalesce(*[F.try_variant_get(v, p, "string") for p in paths])


def entries(df: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, ix, resource): entries of bundles, or the resource itself, as variants.

    Payloads that are not exactly one JSON value give none (values line by line are read
    by the structural index instead).
    """
    # Within brackets a second value without a comma is an error, which it is not at the end of a text.
    listed = F.try_parse_json(F.concat(F.lit("["), F.regexp_replace(payload, "^\ufeff", ""), F.lit("]")))
    v = df.select(F.col(key), listed.alias("l")).where(F.try_variant_get("l", "$[1]", "variant").isNull()).select(key, F.try_variant_get("l", "$[0]", "variant").alias("v")).where(F.col("v").isNotNull())
    kind = F.try_variant_get("v", "$.resourceType", "string")
    listed = F.try_variant_get("v", "$.entry", "array<variant>")
    inner = v.where(kind == "Bundle").select(key, F.posexplode(listed).alias("ix", "e")).select(key, "ix", F.try_variant_get("e", "$.resource", "variant").alias("resource"))
    lone = v.where(kind.isNotNull() & (kind != "Bundle")).select(key, F.lit(0).alias("ix"), F.col("v").alias("resource"))
    return inner.unionByName(lone).where(F.col("resource").isNotNull())


def records(resources: DataFrame, key: str) -> DataFrame:
    """One wide row per resource: what all converters share, with the strategy that applies to its type."""
    v = F.col("resource")
    kind = F.try_variant_get(v, "$.resourceType", "string")
    strategy = F.when(kind.isin(*MAPPED), "mapped").when(kind.isin(*EXCLUDED), "excluded").otherwise("passthrough")
    return resources.select(
        key, "ix", kind.alias("resource_type"), F.try_variant_get(v, "$.id", "string").alias("resource_id"), strategy.alias("strategy"),
        F.try_variant_get(v, "$.status", "string").alias("status"), _first(v, LABELS).alias("label"), _first(v, CODES).alias("code"),
        _first(v, INSTANTS).alias("effective"), _first(v, SUBJECTS).alias("subject"),
        F.try_variant_get(v, "$.valueQuantity.value", "double").alias("value"), F.try_variant_get(v, "$.valueQuantity.unit", "string").alias("unit"),
    ).where(F.col("resource_type").isNotNull())


def manifest(recs: DataFrame) -> DataFrame:
    """Resources by type and strategy."""
    return recs.groupBy("resource_type", "strategy").agg(F.count("*").alias("n_resources"))


def observations_to_bundles(df: DataFrame, group: str) -> DataFrame:
    """(group, bundle): observations of each group as one FHIR Bundle, in order of id.

    A bundle is one document, so its group must fit a task; group by something bounded.
    """
    resource = F.struct(
        F.lit("Observation").alias("resourceType"), F.col("resource_id").alias("id"), "status",
        F.struct(F.col("code_text").alias("text")).alias("code"), F.struct(F.col("subject_reference").alias("reference")).alias("subject"),
        F.col("effective_date_time").alias("effectiveDateTime"), F.struct(F.col("quantity_value").alias("value"), F.col("quantity_unit").alias("unit")).alias("valueQuantity"),
    )
    listed = F.transform(F.array_sort(F.collect_list(F.struct("obs_id", resource.alias("resource")))), lambda x: F.struct(x["resource"].alias("resource")))
    return df.groupBy(group).agg(F.to_json(F.struct(F.lit("Bundle").alias("resourceType"), F.lit("collection").alias("type"), listed.alias("entry"))).alias("bundle"))
