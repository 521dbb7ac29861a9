"""Typed records from FHIR resources: one projection template per resource family.

A template lists predicates with the Column that states each; all are evaluated in one
pass over the parsed variant, without Python.  A resource becomes rows (predicate, value,
kind of value).  Families without a template pass through as their whole JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.common import cut
from recordloom.functions import codes, dates, text

# Namespace of codes by the system as resources name it.
_RXNORM, _SNOMED, _NDC, _ATC, _LOINC, _ICD10 = (
    "http://www.nlm.nih.gov/research/umls/rxnorm/", "http://snomed.info/sct/", "http://hl7.org/fhir/sid/ndc/", "http://www.whocc.no/atc/", "http://loinc.org/rdf#", "http://hl7.org/fhir/sid/icd-10-cm/",
)
SYSTEMS = {
    "http://www.nlm.nih.gov/research/umls/rxnorm": _RXNORM, "urn:oid:2.16.840.1.113883.6.88": _RXNORM, "http://snomed.info/sct": _SNOMED, "urn:oid:2.16.840.1.113883.6.96": _SNOMED,
    "http://hl7.org/fhir/sid/ndc": _NDC, "urn:oid:2.16.840.1.113883.6.69": _NDC, "http://www.whocc.no/atc": _ATC, "urn:oid:2.16.840.1.113883.6.73": _ATC,
    "http://loinc.org": _LOINC, "https://loinc.org": _LOINC, "http://loinc.org/": _LOINC, "urn:oid:2.16.840.1.113883.6.1": _LOINC,
    "http://hl7.org/fhir/sid/icd-10-cm": _ICD10, "http://hl7.org/fhir/sid/icd-10": _ICD10,
}
# Vital signs that have a record type of their own.
MARITAL = {"S": "single", "M": "married", "D": "divorced", "W": "widowed", "A": "separated", "T": "domestic_partnership", "UNK": "prefer_not_to_say", "Never Married": "single", "Married": "married", "Divorced": "divorced", "Widowed": "widowed", "Separated": "separated"}
GENDERS = {"male": "male", "female": "female", "other": "intersex", "unknown": "intersex"}
CRITICALITY = {"low": "mild", "high": "severe", "unable-to-assess": "moderate"}
VITAL_WORDS = {"N": "normal", "H": "high", "L": "low", "A": "abnormal", "HH": "critical", "LL": "critical"}
TOTALS = {"totalBilled": ("submitted", "eligible"), "totalAllowed": ("allowed", "negotiated"), "totalPaid": ("benefit", "paid"), "patientResponsibility": ("patientpay", "copay", "deductible")}
EXCLUDED = ("OperationOutcome", "Bundle", "Parameters", "CapabilityStatement", "StructureDefinition")

_V = "resource"
_ROW = "struct<predicate:string,value:string,kind:string>"


def _s(path: str, v: str | Column = _V) -> Column:
    """Text at a path of the resource, null if it is missing or empty."""
    return F.nullif(F.try_variant_get(v, f"$.{path}", "string"), F.lit(""))


def _list(path: str, item: str) -> Column:
    empty = F.array().cast(f"array<{item}>")
    return F.coalesce(F.try_variant_get(_V, f"$.{path}", f"array<{item}>"), empty)


_CODING = "struct<system:string,code:string,display:string>"
_CONCEPT = f"struct<text:string,coding:array<{_CODING}>>"


def _concept(path: str) -> Column:
    """Text of a concept, else the display of its first coding."""
    return F.coalesce(_s(f"{path}.text"), _s(f"{path}.coding[0].display"))


def _concept_of(c: Column) -> Column:
    return F.coalesce(F.nullif(c["text"], F.lit("")), F.nullif(F.get(c["coding"], F.lit(0))["display"], F.lit("")))


def _codes(path: str, *spaces: str) -> Column:
    """IRIs of a concept's codes in the namespaces (all known ones if none is named)."""
    space = text.literal_map(SYSTEMS)
    stated = F.filter(_list(f"{path}.coding", _CODING), lambda c: c["system"].isNotNull() & F.nullif(c["code"], F.lit("")).isNotNull())
    named = F.transform(stated, lambda c: F.struct(F.element_at(space, c["system"]).alias("space"), c["code"].alias("code")))
    kept = F.filter(named, lambda c: c["space"].isin(*spaces) if spaces else c["space"].isNotNull())
    return F.transform(kept, lambda c: F.concat(c["space"], c["code"]))


def _one(predicate: str, value: Column, kind: str = "text") -> Column:
    v = dates.with_zone(value) if kind == "time" else value.cast("string")
    return F.when(v.isNotNull(), F.array(F.struct(F.lit(predicate).alias("predicate"), v.alias("value"), F.lit(kind).alias("kind"))))


def _many(predicate: str, values: Column, kind: str = "text") -> Column:
    known = F.filter(values, lambda x: F.nullif(x, F.lit("")).isNotNull())
    return F.transform(known, lambda x: F.struct(F.lit(predicate).alias("predicate"), x.alias("value"), F.lit(kind).alias("kind")))


def _notes(predicate: str) -> Column:
    return _one(predicate, F.nullif(F.array_join(F.filter(F.transform(_list("note", "struct<text:string>"), lambda n: n["text"]), lambda x: F.nullif(x, F.lit("")).isNotNull()), "; "), F.lit("")))


def _number(path: str) -> Column:
    """A number as it is written without needless digits."""
    return F.regexp_replace(F.try_variant_get(_V, f"$.{path}", "string"), r"\.0+$", "")


def _amount(path: str) -> Column:
    return F.nullif(F.trim(F.concat(F.coalesce(_number(f"{path}.value"), F.lit("")), F.lit(" "), F.coalesce(_s(f"{path}.unit"), F.lit("")))), F.lit(""))


def _links(encounter: bool = True, indication: bool = False) -> list[Column]:
    out = [_one("clinical:hasEncounter", _s("encounter.reference"), "reference")] if encounter else []
    if indication:
        out.append(_many("clinical:indicationReference", F.transform(_list("reasonReference", "struct<reference:string>"), lambda r: r["reference"]), "reference"))
        out.append(_many("clinical:parsedIndication", F.transform(_list("reasonCode", _CONCEPT), _concept_of)))
    return out


def _id(predicate: str = "health:sourceRecordId") -> Column:
    return _one(predicate, _s("id"))


def _medication() -> list[Column]:
    name = F.coalesce(_concept("medicationCodeableConcept"), _s("medicationReference.display"), F.lit("Unknown Medication"))
    first = lambda p: F.coalesce(_s(f"dosage[0].{p}"), F.when(F.try_variant_get(_V, "$.dosage[0]", "variant").isNull(), _s(f"dosageInstruction[0].{p}")))
    times, unit = first("timing.repeat.frequency"), F.coalesce(first("timing.repeat.periodUnit"), F.lit("d"))
    each = F.when(unit == "d", "daily").when(unit == "wk", "weekly").otherwise(unit)
    often = F.when(times == "1", F.concat(F.lit("once "), each)).when(times != "0", F.concat(times, F.lit(" times "), each))
    intent = F.when(_s("resourceType") == "MedicationStatement", "reportedUse").otherwise("prescribed")
    return [
        _one("clinical:drugName", name), _one("clinical:status", _s("status")), _many("clinical:drugCode", _codes("medicationCodeableConcept"), "iri"),
        _many("clinical:rxNormCode", _codes("medicationCodeableConcept", _RXNORM), "iri"), _one("clinical:dosage", first("text")),
        _one("clinical:route", F.coalesce(first("route.text"), first("route.coding[0].display"))), _one("clinical:frequency", often),
        _one("health:startDate", F.coalesce(_s("effectivePeriod.start"), _s("effectiveDateTime"), _s("authoredOn")), "time"), _one("health:endDate", _s("effectivePeriod.end"), "time"),
        _one("clinical:sourceFhirResourceType", _s("resourceType")), _one("clinical:clinicalIntent", intent), _one("clinical:provenanceClass", F.lit("imported")),
        _id(), _notes("health:notes"), *_links(indication=True),
    ]


def _condition() -> list[Column]:
    name = F.coalesce(_concept("code"), F.lit("Unknown Condition"))
    return [
        _one("health:conditionName", name), _one("health:conditionCategory", F.coalesce(_s("category[0].coding[0].code"), _s("category[0].text"))),
        _one("health:snomedSemanticTag", F.nullif(F.regexp_extract(name, r"\(([^)]+)\)$", 1), F.lit(""))), _one("health:status", F.coalesce(_s("clinicalStatus.coding[0].code"), F.lit("active"))),
        _one("health:onsetDate", F.coalesce(_s("onsetDateTime"), _s("onsetPeriod.start")), "time"), _one("health:abatementDate", _s("abatementDateTime"), "time"),
        _many("health:icd10Code", _codes("code", _ICD10), "iri"), _many("health:snomedCode", _codes("code", _SNOMED), "iri"), _id(), _notes("health:notes"), *_links(),
    ]


def _allergy() -> list[Column]:
    reactions = _list("reaction", f"struct<severity:string,manifestation:array<{_CONCEPT}>>")
    shown = F.filter(F.flatten(F.transform(reactions, lambda r: F.coalesce(F.transform(r["manifestation"], _concept_of), F.array().cast("array<string>")))), lambda x: x.isNotNull())
    critical = F.coalesce(F.element_at(text.literal_map(CRITICALITY), _s("criticality")), _s("criticality"))
    return [
        _one("health:allergen", F.coalesce(_concept("code"), F.lit("Unknown Allergen"))), _one("health:allergyCategory", _s("category[0]")),
        _one("health:reaction", F.nullif(F.array_join(shown, ", "), F.lit(""))), _one("health:allergySeverity", F.coalesce(_s("reaction[0].severity"), critical)),
        _one("health:onsetDate", _s("onsetDateTime"), "time"), _id(), _notes("health:notes"),
    ]


_COMPONENT = f"struct<code:{_CONCEPT},valueCodeableConcept:{_CONCEPT},valueString:string,valueQuantity:struct<value:string,unit:string>>"


def _lab() -> list[Column]:
    def answer(c: Column) -> Column:
        q = c["valueQuantity"]
        amount = F.when(q.isNotNull(), F.trim(F.concat(F.coalesce(F.regexp_replace(q["value"], r"\.0+$", ""), F.lit("")), F.lit(" "), F.coalesce(q["unit"], F.lit("")))))
        said = F.coalesce(_concept_of(c["valueCodeableConcept"]), c["valueString"], amount)
        return F.concat(_concept_of(c["code"]), F.lit(": "), said)

    parts = F.filter(F.transform(_list("component", _COMPONENT), answer), lambda x: x.isNotNull())
    stated = F.try_variant_get(_V, "$.valueQuantity", "variant").isNotNull()
    value = F.when(stated, _number("valueQuantity.value")).otherwise(F.coalesce(_s("valueString"), _concept("valueCodeableConcept"), F.array_join(parts, "; ")))
    low, high = _number("referenceRange[0].low.value"), _number("referenceRange[0].high.value")
    unit = F.coalesce(_s("referenceRange[0].low.unit"), _s("referenceRange[0].high.unit"), F.lit(""))
    limits = F.coalesce(F.trim(F.concat(low, F.lit("-"), high, F.lit(" "), unit)), _s("referenceRange[0].text"))
    cats = _list("category", _CONCEPT)
    said = F.flatten(F.transform(cats, lambda c: F.concat(F.coalesce(F.transform(c["coding"], lambda x: x["code"]), F.array().cast("array<string>")), F.array(c["text"]))))
    return [
        _one("health:testName", F.coalesce(_concept("code"), F.lit("Unknown Lab Test"))), _one("health:resultValue", value), _one("health:resultUnit", F.when(stated, _s("valueQuantity.unit"))),
        _one("health:interpretation", codes.interpretation(_s("interpretation[0].coding[0].code"))),
        _one("health:performedDate", F.coalesce(_s("effectiveDateTime"), _s("effectivePeriod.start"), _s("issued")), "time"),
        _many("health:testCode", _codes("code", _LOINC), "iri"), _many("health:labCategory", said), _one("health:referenceRange", limits), _id(), *_links(),
    ]


def _vital_code() -> Column:
    loinc = F.filter(_list("code.coding", _CODING), lambda c: (F.element_at(text.literal_map(SYSTEMS), c["system"]) == _LOINC) & c["code"].isin(*codes.VITALS))
    return F.get(loinc, F.lit(0))["code"]


def is_vital() -> Column:
    """Whether an observation is a vital sign: by category, else by its code (only one with a code has a type of its own)."""
    cats = _list("category", _CONCEPT)
    by_category = F.exists(cats, lambda c: F.coalesce(F.exists(c["coding"], lambda x: x["code"].isin("vital-signs", "vital-sign")), F.lit(False)) | F.coalesce(c["text"].rlike("(?i)vital"), F.lit(False)))
    return by_category | _vital_code().isNotNull()


def _vital() -> list[Column]:
    sign = codes.vital_sign(_vital_code())
    kind = F.when(sign["kind"] == "bloodPressurePanel", "bloodPressure").otherwise(sign["kind"])
    said = _s("interpretation[0].coding[0].code")
    return [
        _one("clinical:loincCode", F.concat(F.lit(_LOINC), _vital_code()), "iri"), _one("clinical:vitalType", kind), _one("clinical:vitalTypeName", sign["name"]),
        _one("clinical:snomedCode", F.concat(F.lit(_SNOMED), sign["snomed"]), "iri"),
        _one("clinical:value", F.coalesce(_number("valueQuantity.value"), _s("valueString"), _concept("valueCodeableConcept"), _number("valueInteger"))),
        _one("clinical:unit", F.when(F.try_variant_get(_V, "$.valueQuantity", "variant").isNotNull(), F.coalesce(_s("valueQuantity.unit"), sign["unit"]))),
        _one("clinical:effectiveDate", F.coalesce(_s("effectiveDateTime"), _s("effectivePeriod.start")), "time"),
        _one("clinical:referenceRangeLow", _number("referenceRange[0].low.value")), _one("clinical:referenceRangeHigh", _number("referenceRange[0].high.value")),
        _one("clinical:interpretation", F.coalesce(F.element_at(text.literal_map(VITAL_WORDS), said), said)), _id(), *_links(),
    ]


def _procedure() -> list[Column]:
    cpt = F.transform(F.filter(_list("code.coding", _CODING), lambda c: F.coalesce(c["system"].contains("cpt"), F.lit(False))), lambda c: c["code"])
    return [
        _one("clinical:procedureName", F.coalesce(_concept("code"), F.lit("Unknown Procedure"))), _many("clinical:procedureSnomedCode", _codes("code", _SNOMED), "iri"), _many("clinical:cptCode", cpt),
        _one("clinical:performedDate", F.coalesce(_s("performedDateTime"), _s("performedPeriod.start")), "time"), _one("clinical:procedureStatus", _s("status")), _id("clinical:sourceRecordId"), *_links(indication=True),
    ]


def _document() -> list[Column]:
    a = "content[0].attachment"
    return [
        _one("clinical:documentType", F.coalesce(_concept("type"), F.lit("Unknown Document"))), _one("clinical:documentDate", F.coalesce(_s("date"), _s("indexed")), "time"),
        _one("clinical:contentType", _s(f"{a}.contentType")), _one("clinical:documentUrl", _s(f"{a}.url")), _one("clinical:documentTitle", _s(f"{a}.title")), _id("clinical:sourceRecordId"), _id("clinical:fhirResourceId"),
        _many("clinical:hasEncounter", F.transform(_list("context.encounter", "struct<reference:string>"), lambda r: r["reference"]), "reference"),
    ]


def _encounter() -> list[Column]:
    return [
        _one("clinical:encounterClass", F.coalesce(_s("class.code"), _s("class.coding[0].code"))), _one("clinical:encounterStatus", _s("status")), _one("clinical:encounterType", _concept("type[0]")),
        _many("clinical:snomedCode", _codes("type[0]", _SNOMED), "iri"), _one("clinical:encounterStart", _s("period.start"), "time"), _one("clinical:encounterEnd", _s("period.end"), "time"),
        _one("clinical:providerName", _s("participant[0].individual.display")), _one("clinical:facilityName", _s("serviceProvider.display")), _id("clinical:sourceRecordId"),
    ]


def _report() -> list[Column]:
    at = F.coalesce(_s("effectiveDateTime"), _s("effectivePeriod.start"))
    return [
        _one("clinical:panelName", F.coalesce(_concept("code"), F.lit("Unknown Panel"))), _many("clinical:loincCode", _codes("code", _LOINC), "iri"),
        _one("clinical:reportCategory", F.coalesce(_s("category[0].coding[0].code"), _concept("category[0]"))), _one("clinical:performedDate", at, "time"), _one("clinical:documentDate", F.coalesce(_s("issued"), at), "time"),
        _one("clinical:providerName", _s("performer[0].display")), _many("clinical:hasLabResult", F.transform(_list("result", "struct<reference:string>"), lambda r: r["reference"]), "reference"), _id("clinical:sourceRecordId"), *_links(),
    ]


def _administration() -> list[Column]:
    return [
        _one("health:medicationName", F.coalesce(_concept("medicationCodeableConcept"), _s("medicationReference.display"), F.lit("Unknown Medication"))), _one("clinical:administrationStatus", _s("status")),
        _one("clinical:administeredDate", F.coalesce(_s("effectiveDateTime"), _s("effectivePeriod.start")), "time"), _one("clinical:administeredDose", _amount("dosage.dose")),
        _one("clinical:administeredRoute", _concept("dosage.route")), _id("clinical:sourceRecordId"), *_links(encounter=False, indication=True),
    ]


def _device() -> list[Column]:
    return [
        _one("clinical:deviceType", F.coalesce(_concept("type"), F.lit("Unknown Device"))), _one("clinical:deviceStatus", _s("status")), _one("clinical:deviceManufacturer", _s("manufacturer")),
        _one("clinical:udiCarrier", F.coalesce(_s("udiCarrier[0].deviceIdentifier"), _s("udiCarrier[0].carrierHRF"))), _one("clinical:implantDate", _s("manufactureDate"), "time"), _id("clinical:sourceRecordId"),
    ]


def _imaging() -> list[Column]:
    return [
        _one("clinical:imagingModality", F.coalesce(_s("series[0].modality.code"), _s("modality[0].code"))), _one("clinical:studyDescription", _s("description")), _one("clinical:numberOfSeries", _number("numberOfSeries")),
        _one("clinical:studyDate", _s("started"), "time"), _one("clinical:dicomStudyUid", F.coalesce(_s("uid"), _s("identifier[0].value"))), _id("clinical:sourceRecordId"), *_links(),
    ]


def _patient() -> list[Column]:
    said = _concept("maritalStatus")
    married = text.literal_map(MARITAL)
    return [
        _one("core:dateOfBirth", _s("birthDate")), _one("core:biologicalSex", F.coalesce(F.element_at(text.literal_map(GENDERS), _s("gender")), _s("gender"))),
        *[_one(f"core:address{n}", _s(f"address[0].{p}")) for n, p in (("City", "city"), ("State", "state"), ("PostalCode", "postalCode"), ("Country", "country"))],
        _one("core:addressLine", F.nullif(F.array_join(_list("address[0].line", "string"), ", "), F.lit(""))),
        _one("core:maritalStatus", F.when(said.isNotNull(), F.coalesce(F.element_at(married, _s("maritalStatus.coding[0].code")), F.element_at(married, said), F.lower(said)))), _id("core:profileId"),
    ]


def _immunization() -> list[Column]:
    cvx = F.transform(F.filter(_list("vaccineCode.coding", _CODING), lambda c: F.coalesce(c["system"].contains("cvx"), F.lit(False)) & c["code"].isNotNull()), lambda c: F.concat(F.lit("CVX-"), c["code"]))
    return [
        _one("health:vaccineName", F.coalesce(_concept("vaccineCode"), F.lit("Unknown Vaccine"))), _one("health:administrationDate", _s("occurrenceDateTime"), "time"),
        _one("health:status", F.coalesce(_s("status"), F.lit("completed"))), _many("health:vaccineCode", cvx), _one("health:manufacturer", _s("manufacturer.display")), _one("health:lotNumber", _s("lotNumber")),
        _one("health:doseQuantity", _amount("doseQuantity")), _one("health:route", _concept("route")), _one("health:site", _concept("site")),
        _one("health:administeringProvider", _s("performer[0].actor.display")), _one("health:administeringLocation", _s("location.display")), _notes("health:notes"), _id(), *_links(),
    ]


def _coverage() -> list[Column]:
    classes = _list("class", f"struct<type:{_CONCEPT},value:string,name:string>")
    of = lambda kind, pick: F.transform(F.filter(classes, lambda c: (F.get(c["type"]["coding"], F.lit(0))["code"] == kind) & c["value"].isNotNull()), pick)
    subscriber = _s("subscriberId")
    return [
        _one("coverage:providerName", F.coalesce(_s("payor[0].display"), F.lit("Unknown Insurance"))), _one("coverage:memberId", F.coalesce(subscriber, _s("identifier[0].value"))), _one("coverage:subscriberId", subscriber),
        _one("coverage:coverageType", F.coalesce(_s("type.coding[0].code"), _concept("type"), F.lit("primary"))), _many("coverage:groupNumber", of("group", lambda c: c["value"])),
        _many("coverage:planName", F.concat(of("group", lambda c: c["name"]), of("plan", lambda c: F.coalesce(c["name"], c["value"])))),
        _many("coverage:rxBin", of("rxbin", lambda c: c["value"])), _many("coverage:rxPcn", of("rxpcn", lambda c: c["value"])), _many("coverage:rxGroup", of("rxgroup", lambda c: c["value"])),
        _one("coverage:subscriberRelationship", F.when(F.try_variant_get(_V, "$.relationship", "variant").isNotNull(), F.coalesce(_s("relationship.coding[0].code"), F.lit("self")))),
        _one("coverage:effectiveStart", F.substring(_s("period.start"), 1, 10)), _one("coverage:effectiveEnd", F.substring(_s("period.end"), 1, 10)), _id(),
    ]


def _claim() -> list[Column]:
    coded = lambda path, field: F.flatten(F.transform(_list(path, f"struct<{field}:{_CONCEPT}>"), lambda d: F.coalesce(F.transform(d[field]["coding"], lambda c: c["code"]), F.array().cast("array<string>"))))
    return [
        _one("coverage:claimDate", F.coalesce(_s("billablePeriod.start"), _s("created")), "time"), _one("coverage:claimStatus", _s("status")), _one("coverage:claimType", F.coalesce(_s("type.coding[0].code"), _concept("type"))),
        _one("coverage:claimTotal", _number("total.value")), _one("coverage:billingProvider", F.coalesce(_s("provider.display"), _s("careTeam[0].provider.display"))),
        _many("coverage:hasDiagnosis", coded("diagnosis", "diagnosisCodeableConcept")), _many("coverage:hasProcedure", coded("procedure", "procedureCodeableConcept")), _id("coverage:sourceRecordId"),
    ]


def _benefit() -> list[Column]:
    totals = _list("total", f"struct<category:{_CONCEPT},amount:struct<value:string>>")
    of = lambda kinds: F.transform(F.filter(totals, lambda t: F.get(t["category"]["coding"], F.lit(0))["code"].isin(*kinds)), lambda t: F.regexp_replace(t["amount"]["value"], r"\.0+$", ""))
    return [
        _one("coverage:adjudicationDate", F.coalesce(_s("billablePeriod.end"), _s("created")), "time"), _one("coverage:adjudicationStatus", _s("status")), _one("coverage:outcomeCode", _s("outcome")),
        *[_many(f"coverage:{name}", of(kinds)) for name, kinds in TOTALS.items()], _one("coverage:relatedClaim", _s("claim.reference"), "reference"), _id("coverage:sourceRecordId"),
    ]


#: Family of resource types: the record type it becomes and its template.
TEMPLATES = {
    "medication": (("MedicationStatement", "MedicationRequest"), "clinical:Medication", _medication),
    "condition": (("Condition",), "health:ConditionRecord", _condition),
    "allergy": (("AllergyIntolerance",), "health:AllergyRecord", _allergy),
    "procedure": (("Procedure",), "clinical:Procedure", _procedure),
    "document": (("DocumentReference",), "clinical:ClinicalDocument", _document),
    "encounter": (("Encounter",), "clinical:Encounter", _encounter),
    "report": (("DiagnosticReport",), "clinical:LaboratoryReport", _report),
    "administration": (("MedicationAdministration",), "clinical:MedicationAdministration", _administration),
    "device": (("Device",), "clinical:ImplantedDevice", _device),
    "imaging": (("ImagingStudy",), "clinical:ImagingStudy", _imaging),
    "patient": (("Patient",), "core:PatientProfile", _patient),
    "immunization": (("Immunization",), "health:ImmunizationRecord", _immunization),
    "coverage": (("Coverage",), "coverage:InsurancePlan", _coverage),
    "claim": (("Claim",), "coverage:ClaimRecord", _claim),
    "benefit": (("ExplanationOfBenefit",), "coverage:BenefitStatement", _benefit),
}


def _stated(resources: DataFrame, keys: list[str], record_type: Column, template: list[Column]) -> DataFrame:
    none = F.array().cast(f"array<{_ROW}>")
    rows = F.flatten(F.array(*[F.coalesce(c.cast(f"array<{_ROW}>"), none) for c in template]))
    return resources.select(*keys, record_type.alias("record_type"), F.inline(rows))


def convert(resources: DataFrame, keys: list[str], family: str) -> DataFrame:
    """(keys, record_type, predicate, value, kind) of the resources of one family; ``lab`` and ``vital`` share Observation.

    `resources`: the keys and ``resource`` (a variant).  Kinds are text, time, iri and reference.
    Fields that are missing, empty or of another shape state nothing.
    """
    kind = F.try_variant_get(_V, "$.resourceType", "string")
    if family in ("lab", "vital"):
        # A vital sign whose code has no entry of its own is kept as a lab result.
        own = (kind == "Observation") & (_vital_code().isNotNull() if family == "vital" else _vital_code().isNull())
        return _stated(resources.where(own), keys, F.lit("clinical:VitalSign" if family == "vital" else "health:LabResultRecord"), _vital() if family == "vital" else _lab())
    types, record_type, template = TEMPLATES[family]
    return _stated(resources.where(kind.isin(*types)), keys, F.lit(record_type), template())


def record_type() -> Column:
    """Type of the record that a resource becomes; null for excluded types."""
    kind = F.try_variant_get(_V, "$.resourceType", "string")
    out = F.when(kind.isin(*EXCLUDED), F.lit(None).cast("string")).when(kind == "Observation", F.when(_vital_code().isNotNull(), "clinical:VitalSign").otherwise("health:LabResultRecord"))
    for types, name, _ in TEMPLATES.values():
        out = out.when(kind.isin(*types), name)
    return out.when(kind.isNotNull(), "clinical:FhirPassthrough")


def convert_all(resources: DataFrame, keys: list[str]) -> DataFrame:
    """All families, and what passes through as its JSON; excluded types give no rows.

    The resources are parsed once; each family then reads its own.
    """
    resources, out = cut(resources.where(F.try_variant_get(_V, "$.resourceType", "string").isNotNull())), None
    for family in (*TEMPLATES, "lab", "vital"):
        part = convert(resources, keys, family)
        out = part if out is None else out.unionByName(part)
    kind = F.try_variant_get(_V, "$.resourceType", "string")
    known = [t for types, *_ in TEMPLATES.values() for t in types] + ["Observation", *EXCLUDED]
    rest = resources.where(kind.isNotNull() & ~kind.isin(*known))
    return out.unionByName(_stated(rest, keys, F.lit("clinical:FhirPassthrough"), [_one("clinical:fhirResourceType", kind), _id("clinical:sourceRecordId"), _one("clinical:fhirJson", F.to_json(F.col(_V)), "json")]))


def to_resource(record_type: str, p: Column) -> Column:
    """JSON of the FHIR resource that a record (map of predicate to value) was or could have been."""
    g = lambda k: F.element_at(p, F.lit(k))
    concept = lambda k: F.struct(g(k).alias("text"))
    named = {
        "clinical:Medication": lambda: F.struct(
            F.coalesce(g("clinical:sourceFhirResourceType"), F.lit("MedicationStatement")).alias("resourceType"), g("health:sourceRecordId").alias("id"), g("clinical:status").alias("status"),
            concept("clinical:drugName").alias("medicationCodeableConcept"), F.struct(g("health:startDate").alias("start"), g("health:endDate").alias("end")).alias("effectivePeriod"),
            F.array(F.struct(g("clinical:dosage").alias("text"), F.struct(g("clinical:route").alias("text")).alias("route"))).alias("dosage"),
        ),
        "health:ConditionRecord": lambda: F.struct(
            F.lit("Condition").alias("resourceType"), g("health:sourceRecordId").alias("id"), F.struct(F.array(F.struct(g("health:status").alias("code"))).alias("coding")).alias("clinicalStatus"),
            concept("health:conditionName").alias("code"), g("health:onsetDate").alias("onsetDateTime"), g("health:abatementDate").alias("abatementDateTime"),
        ),
        "health:AllergyRecord": lambda: F.struct(
            F.lit("AllergyIntolerance").alias("resourceType"), g("health:sourceRecordId").alias("id"), concept("health:allergen").alias("code"), F.array(g("health:allergyCategory")).alias("category"),
            F.array(F.struct(F.array(concept("health:reaction")).alias("manifestation"), g("health:allergySeverity").alias("severity"))).alias("reaction"), g("health:onsetDate").alias("onsetDateTime"),
        ),
        "health:LabResultRecord": lambda: F.struct(
            F.lit("Observation").alias("resourceType"), g("health:sourceRecordId").alias("id"), F.lit("final").alias("status"), concept("health:testName").alias("code"), g("health:performedDate").alias("effectiveDateTime"),
            F.when(g("health:resultUnit").isNotNull(), F.struct(g("health:resultValue").try_cast("double").alias("value"), g("health:resultUnit").alias("unit"))).alias("valueQuantity"),
            F.when(g("health:resultUnit").isNull(), F.nullif(g("health:resultValue"), F.lit(""))).alias("valueString"),
        ),
        "clinical:Encounter": lambda: F.struct(
            F.lit("Encounter").alias("resourceType"), g("clinical:sourceRecordId").alias("id"), g("clinical:encounterStatus").alias("status"), F.struct(g("clinical:encounterClass").alias("code")).alias("class"),
            F.struct(g("clinical:encounterStart").alias("start"), g("clinical:encounterEnd").alias("end")).alias("period"), F.array(F.struct(F.struct(g("clinical:providerName").alias("display")).alias("individual"))).alias("participant"),
        ),
        "core:PatientProfile": lambda: F.struct(F.lit("Patient").alias("resourceType"), g("core:profileId").alias("id"), g("core:dateOfBirth").alias("birthDate"), g("core:biologicalSex").alias("gender")),
        "health:ImmunizationRecord": lambda: F.struct(
            F.lit("Immunization").alias("resourceType"), g("health:sourceRecordId").alias("id"), g("health:status").alias("status"), concept("health:vaccineName").alias("vaccineCode"),
            g("health:administrationDate").alias("occurrenceDateTime"), g("health:lotNumber").alias("lotNumber"),
        ),
    }
    if record_type == "clinical:FhirPassthrough":
        return g("clinical:fhirJson")
    return F.to_json(named[record_type]())
