"""Typed records of the raw bundles, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.common import read
from recordloom.plans.catalog import Catalog
from recordloom.plans.reporting import _ENTRIES
from recordloom.sources import converters, fhir

CATALOG = Catalog()
query = CATALOG.query


def _resources(spark: SparkSession, sf: str) -> DataFrame:
    return fhir.entries(read(spark, sf, "raw_bundles"), "bundle_id", "payload")


def _family(spark: SparkSession, sf: str, family: str) -> DataFrame:
    return converters.convert(_resources(spark, sf), ["bundle_id", "ix"], family)


def _text(path: str) -> str:
    return f"nullif(r ->> '$.{path}', '')"


def _concept(path: str) -> str:
    return f"coalesce({_text(path + '.text')}, {_text(path + '.coding[0].display')})"


def _time(x: str) -> str:
    return rf"(SELECT CASE WHEN regexp_matches(y, '^\d{{4}}-\d{{2}}-\d{{2}}$') THEN y || 'T00:00:00Z' WHEN regexp_matches(y, '^\d{{4}}-\d{{2}}-\d{{2}}T\d{{2}}:\d{{2}}(:\d{{2}}(\.\d+)?)?$') THEN y || 'Z' ELSE y END FROM (SELECT {x} AS y))"


def _sql(types: str, record_type: str, rows: dict[str, tuple[str, str]], lists: dict[str, tuple[str, str]] | None = None, where: str = "true") -> str:
    """Rows of one family: single values by path, and lists of references."""
    of = f"(SELECT * FROM e WHERE r ->> '$.resourceType' IN ({types}) AND {where})"
    parts = [f"SELECT bundle_id, ix, '{p}' AS predicate, {_time(x) if kind == 'time' else x} AS value, '{kind}' AS kind FROM {of}" for p, (x, kind) in rows.items()]
    parts += [f"SELECT bundle_id, ix, '{p}', x ->> '$.reference', '{kind}' FROM (SELECT bundle_id, ix, unnest(CASE WHEN json_type(r, '{path}') = 'ARRAY' THEN (r -> '{path}')::JSON[] END) AS x FROM {of})" for p, (path, kind) in (lists or {}).items()]
    return f"WITH {_ENTRIES} SELECT bundle_id, ix, '{record_type}' AS record_type, predicate, value, kind FROM ({' UNION ALL '.join(parts)}) WHERE value IS NOT NULL AND value <> ''"


_NOTES = "nullif(array_to_string(list_filter(list_transform(CASE WHEN json_type(r, '$.note') = 'ARRAY' THEN (r -> '$.note')::JSON[] ELSE [] END, lambda n: n ->> '$.text'), lambda t: t IS NOT NULL AND t <> ''), '; '), '')"
_ENC = {"clinical:hasEncounter": (_text("encounter.reference"), "reference")}


@query(
    _sql("'Condition'", "health:ConditionRecord", {
        "health:conditionName": (f"coalesce({_concept('code')}, 'Unknown Condition')", "text"), "health:conditionCategory": (f"coalesce({_text('category[0].coding[0].code')}, {_text('category[0].text')})", "text"),
        "health:snomedSemanticTag": (f"nullif(regexp_extract(coalesce({_concept('code')}, 'Unknown Condition'), '\\(([^)]+)\\)$', 1), '')", "text"),
        "health:status": (f"coalesce({_text('clinicalStatus.coding[0].code')}, 'active')", "text"), "health:onsetDate": (f"coalesce({_text('onsetDateTime')}, {_text('onsetPeriod.start')})", "time"),
        "health:abatementDate": (_text("abatementDateTime"), "time"), "health:sourceRecordId": (_text("id"), "text"), "health:notes": (_NOTES, "text"), **_ENC,
    })
)
def convert_conditions(spark: SparkSession, sf: str) -> DataFrame:
    return _family(spark, sf, "condition")


@query(
    _sql("'Encounter'", "clinical:Encounter", {
        "clinical:encounterClass": (f"coalesce({_text('class.code')}, {_text('class.coding[0].code')})", "text"), "clinical:encounterStatus": (_text("status"), "text"), "clinical:encounterType": (_concept("type[0]"), "text"),
        "clinical:encounterStart": (_text("period.start"), "time"), "clinical:encounterEnd": (_text("period.end"), "time"), "clinical:providerName": (_text("participant[0].individual.display"), "text"),
        "clinical:facilityName": (_text("serviceProvider.display"), "text"), "clinical:sourceRecordId": (_text("id"), "text"),
    })
)
def convert_encounters(spark: SparkSession, sf: str) -> DataFrame:
    return _family(spark, sf, "encounter")


_AT = f"coalesce({_text('effectiveDateTime')}, {_text('effectivePeriod.start')})"


@query(
    _sql("'DiagnosticReport'", "clinical:LaboratoryReport", {
        "clinical:panelName": (f"coalesce({_concept('code')}, 'Unknown Panel')", "text"), "clinical:reportCategory": (f"coalesce({_text('category[0].coding[0].code')}, {_concept('category[0]')})", "text"),
        "clinical:performedDate": (_AT, "time"), "clinical:documentDate": (f"coalesce({_text('issued')}, {_AT})", "time"), "clinical:providerName": (_text("performer[0].display"), "text"),
        "clinical:sourceRecordId": (_text("id"), "text"), **_ENC,
    }, {"clinical:hasLabResult": ("$.result", "reference")})
)
def convert_reports(spark: SparkSession, sf: str) -> DataFrame:
    return _family(spark, sf, "report")


@query(
    _sql("'Patient'", "core:PatientProfile", {
        "core:dateOfBirth": (_text("birthDate"), "text"), "core:biologicalSex": (f"CASE {_text('gender')} WHEN 'other' THEN 'intersex' WHEN 'unknown' THEN 'intersex' ELSE {_text('gender')} END", "text"),
        "core:addressCity": (_text("address[0].city"), "text"), "core:addressState": (_text("address[0].state"), "text"), "core:addressPostalCode": (_text("address[0].postalCode"), "text"), "core:addressCountry": (_text("address[0].country"), "text"),
        "core:profileId": (_text("id"), "text"),
    })
)
def convert_patients(spark: SparkSession, sf: str) -> DataFrame:
    return _family(spark, sf, "patient").where("predicate NOT IN ('core:addressLine', 'core:maritalStatus')")


_NUM = r"regexp_replace({0}, '\.0+$', '')"


@query(
    f"""WITH {_ENTRIES}, o AS (SELECT bundle_id, ix, r FROM e WHERE r ->> '$.resourceType' = 'Observation'),
    parts AS (SELECT bundle_id, ix, string_agg(said, '; ' ORDER BY k) AS said FROM (SELECT bundle_id, ix, k, coalesce(nullif(c ->> '$.code.text', ''), nullif(c ->> '$.code.coding[0].display', '')) || ': ' || coalesce(nullif(c ->> '$.valueCodeableConcept.text', ''),
      nullif(c ->> '$.valueCodeableConcept.coding[0].display', ''), c ->> '$.valueString', CASE WHEN json_type(c, '$.valueQuantity') = 'OBJECT' THEN trim(coalesce({_NUM.format("c ->> '$.valueQuantity.value'")}, '') || ' ' || coalesce(c ->> '$.valueQuantity.unit', '')) END) AS said
      FROM (SELECT bundle_id, ix, unnest(CASE WHEN json_type(r, '$.component') = 'ARRAY' THEN (r -> '$.component')::JSON[] END) AS c, generate_subscripts(CASE WHEN json_type(r, '$.component') = 'ARRAY' THEN (r -> '$.component')::JSON[] END, 1) AS k FROM o)) WHERE said IS NOT NULL GROUP BY ALL)
    SELECT bundle_id, ix, coalesce({_concept('code')}, 'Unknown Lab Test') AS test_name, CASE WHEN json_type(r, '$.valueQuantity') = 'OBJECT' THEN {_NUM.format("r ->> '$.valueQuantity.value'")} ELSE coalesce({_text('valueString')}, {_concept('valueCodeableConcept')}, said, '') END AS result_value,
      CASE WHEN json_type(r, '$.valueQuantity') = 'OBJECT' THEN {_text('valueQuantity.unit')} END AS result_unit, {_text('id')} AS record_id
    FROM o LEFT JOIN parts USING (bundle_id, ix)"""
)
def convert_labs(spark: SparkSession, sf: str) -> DataFrame:
    """Results of the observations, one row each (none of the given ones is a vital sign)."""
    rows = _family(spark, sf, "lab")
    of = lambda p, n: F.max(F.when(F.col("predicate") == p, F.col("value"))).alias(n)
    return rows.groupBy("bundle_id", "ix").agg(of("health:testName", "test_name"), of("health:resultValue", "result_value"), of("health:resultUnit", "result_unit"), of("health:sourceRecordId", "record_id"))


@query(
    f"""WITH {_ENTRIES}, t AS (SELECT bundle_id, ix, r ->> '$.resourceType' AS k FROM e)
    SELECT CASE k WHEN 'Condition' THEN 'health:ConditionRecord' WHEN 'Encounter' THEN 'clinical:Encounter' WHEN 'DiagnosticReport' THEN 'clinical:LaboratoryReport' WHEN 'Patient' THEN 'core:PatientProfile' WHEN 'Observation' THEN 'health:LabResultRecord' ELSE 'clinical:FhirPassthrough' END AS record_type,
    count(*) AS n_records FROM t WHERE k IS NOT NULL AND k NOT IN ('OperationOutcome', 'Bundle', 'Parameters', 'CapabilityStatement', 'StructureDefinition') GROUP BY ALL"""
)
def converted_types(spark: SparkSession, sf: str) -> DataFrame:
    """Records by the type that they are converted to."""
    rows = _resources(spark, sf).select(converters.record_type().alias("record_type")).where(F.col("record_type").isNotNull())
    return rows.groupBy("record_type").agg(F.count("*").alias("n_records"))


@query(
    _sql("'Condition'", "x", {
        "name": (f"coalesce({_concept('code')}, 'Unknown Condition')", "text"), "status": (f"coalesce({_text('clinicalStatus.coding[0].code')}, 'active')", "text"), "id": (_text("id"), "text"),
        "onset": (f"coalesce({_text('onsetDateTime')}, {_text('onsetPeriod.start')})", "time"),
    }).replace("'x' AS record_type, predicate, value, kind", "predicate, value")
)
def conditions_and_back(spark: SparkSession, sf: str) -> DataFrame:
    """Conditions converted, written as resources again, and read."""
    rows = _family(spark, sf, "condition").where("kind <> 'iri'").groupBy("bundle_id", "ix", "predicate").agg(F.min("value").alias("value"))
    maps = rows.groupBy("bundle_id", "ix").agg(F.map_from_entries(F.collect_list(F.struct("predicate", "value"))).alias("p"))
    back = maps.select("bundle_id", "ix", F.parse_json(converters.to_resource("health:ConditionRecord", F.col("p"))).alias("v"))
    paths = {"name": "$.code.text", "status": "$.clinicalStatus.coding[0].code", "id": "$.id", "onset": "$.onsetDateTime"}
    pairs = F.array(*[F.struct(F.lit(n).alias("predicate"), F.try_variant_get("v", p, "string").alias("value")) for n, p in paths.items()])
    return back.select("bundle_id", "ix", F.inline(pairs)).where(F.col("value").isNotNull())


@query(
    f"""WITH {_ENTRIES} SELECT k AS section, count(*) AS n_in, count(*) FILTER (k NOT IN ('OperationOutcome', 'Bundle', 'Parameters', 'CapabilityStatement', 'StructureDefinition')) AS n_out, bool_or(k IN {fhir.MAPPED}) AS handled
    FROM (SELECT r ->> '$.resourceType' AS k FROM e) WHERE k IS NOT NULL GROUP BY k"""
)
def section_census(spark: SparkSession, sf: str) -> DataFrame:
    """Entries and records by resource type, and whether a converter handles it."""
    k = F.try_variant_get("resource", "$.resourceType", "string")
    r = _resources(spark, sf).select(k.alias("section")).where(F.col("section").isNotNull())
    return r.groupBy("section").agg(F.count("*").alias("n_in"), F.count_if(~F.col("section").isin(*converters.EXCLUDED)).alias("n_out"), F.bool_or(F.col("section").isin(*fhir.MAPPED)).alias("handled"))
