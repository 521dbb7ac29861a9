"""Matchers, converters, shapes, merges, patches and genomic links on small authored tables."""

from __future__ import annotations

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from recordloom.operators import advisory, genomics, link, matchers, merges, records, shapes
from recordloom.plans import matching, reconciliation
from recordloom.sources import converters, fhir

RECORD = "ord long, scope string, uri string, record_type string, source_system string, source_identity string, from_existing boolean, properties map<string, array<struct<value:string, datatype:string, is_iri:boolean>>>"
RX = "http://www.nlm.nih.gov/research/umls/rxnorm/"


def rec(ord_, kind, props, source="a", origin=None, held=False, scope="p"):
    return (ord_, scope, f"u{ord_}", kind, source, origin, held, {k: [(x, None, False) for x in (v if isinstance(v, list) else [v])] for k, v in props.items()} if props is not None else None)


def frame(spark, rows):
    return spark.createDataFrame(rows, RECORD)


def med(name=None, codes=(), **more):
    return {k: v for k, v in {"clinical:drugName": name, "clinical:drugCode": list(codes) or None, **more}.items() if v is not None}


def lab(code, at, value=None, name=None):
    return {k: v for k, v in {"health:testCode": code, "health:performedDate": at, "health:resultValue": value, "health:testName": name}.items() if v is not None}


M, C, A, L, I, V, P = "clinical:Medication", "health:ConditionRecord", "health:AllergyRecord", "health:LabResultRecord", "health:ImmunizationRecord", "clinical:VitalSign", "core:PatientProfile"


def vital(code, at, value=None):
    return {k: v for k, v in {"clinical:loincCode": f"http://loinc.org/rdf#{code}", "clinical:effectiveDate": at, "clinical:value": value}.items() if v is not None}


def test_every_matcher(spark):
    rows = [
        rec(1, M, med("Zyrtec 10 mg")), rec(2, M, med("cetirizine", [RX + "5"]), "b"), rec(3, M, med("other", [RX + "5", "http://snomed.info/sct/9"]), "c"), rec(4, M, med("lisinopril oral tablet hctz"), "d"), rec(5, M, med("Lisinopril"), "e"),
        rec(10, C, {"health:conditionName": "Asthma (disorder)"}), rec(11, C, {"health:conditionName": "asthma", "health:icd10Code": "x/J45"}, "b"), rec(12, C, {"health:conditionName": "wheeze", "health:icd10Code": "y#J45"}, "c"),
        rec(20, A, {"health:allergen": " Penicillin"}), rec(21, A, {"health:allergen": "penicillin "}, "b"), rec(22, A, {"health:allergen": ""}, "c"),
        rec(30, L, lab("l/1", "2024-01-01T08:00:00Z", "5.0")), rec(31, L, lab("m#1", "2024-01-01", "5.2 mg"), "b"), rec(32, L, lab("l/1", "2024-01-02", "5.0"), "c"), rec(33, L, lab("l/2", "2024-01-01", "9", "Na")), rec(34, L, lab(None, "2024-01-01", None, "na "), "b"),
        rec(40, I, {"health:cvxCode": "http://hl7.org/fhir/sid/cvx/207", "health:administrationDate": "2024-01-01T10:00:00Z"}), rec(41, I, {"health:vaccineCode": "CVX-207", "health:administrationDate": "2024-01-01"}, "b"),
        rec(42, I, {"health:vaccineName": "Flu"}), rec(43, I, {"health:vaccineName": "flu"}, "b"), rec(44, I, {"health:vaccineName": "FLU", "core:documentType": "summarization"}, "c"), rec(45, I, {"health:vaccineName": "Unknown Vaccine"}), rec(46, I, {"health:vaccineName": "unknown vaccine", "core:documentType": "summarization"}, "b"),
        rec(50, V, vital("8867-4", "2024-01-01T10:00:00Z", "70")), rec(51, V, vital("8867-4", "2024-01-01T10:30:00Z", "72"), "b"), rec(52, V, vital("8867-4", "2024-01-01T10:31:00Z", "70"), "c"), rec(53, V, vital("8867-4", "2024-01-01T10:05:00Z", "99"), "d"), rec(54, V, vital("8867-4", "2024-01-01T10:10:00Z"), "e"),
        rec(60, P, {"core:dateOfBirth": "1990-01-01", "core:biologicalSex": "male"}), rec(61, P, {"core:dateOfBirth": "1990-01-01", "core:biologicalSex": "male"}, "b"), rec(62, P, {"core:dateOfBirth": "1990-01-01"}, "c"),
        rec(70, "coverage:InsurancePlan", {"coverage:memberId": "1"}), rec(71, "coverage:InsurancePlan", {"coverage:memberId": "1"}, "b"), rec(80, C, None), rec(81, C, None, "b"), rec(82, A, {"health:allergen": "penicillin"}, "b", scope="q"),
    ]
    got = {(r.lo, r.hi): (r.confidence, r.matched_on) for r in matchers.matches(frame(spark, rows)).collect()}
    want = {
        (1, 2): (0.85, "name:cetirizine"), (2, 3): (1.0, "rxnorm:5"), (4, 5): (0.70, "partial-name:lisinopril"), (10, 11): (0.80, "name:asthma"), (11, 12): (0.95, "icd10:J45"), (20, 21): (0.90, "allergen:penicillin"),
        (30, 31): (0.90, "loinc:1+2024-01-01"), (33, 34): (0.75, "name:na+2024-01-01"), (40, 41): (1.0, "cvx:207+2024-01-01"), (42, 44): (0.60, "name-only:flu"), (43, 44): (0.60, "name-only:flu"),
        (50, 51): (0.95, "loinc:8867-4+2024-01-01T10:00:00.000Z"), (51, 52): (0.95, "loinc:8867-4+2024-01-01T10:30:00.000Z"), **{(min(54, x), max(54, x)): None for x in (50, 51, 52, 53)}, (60, 61): (0.95, "dob:1990-01-01+sex:male"), (60, 62): (0.75, "dob:1990-01-01"), (61, 62): (0.75, "dob:1990-01-01"),
    }
    assert set(got) == set(want)
    assert {k: got[k] for k, v in want.items() if v} == {k: v for k, v in want.items() if v}
    assert {got[k][0] for k, v in want.items() if v is None} == {0.85}
    assert matchers.matches(frame(spark, rows).limit(0)).count() == 0


def test_same_source_and_cross_batch(spark):
    a = {"health:allergen": "nuts"}
    rows = [rec(1, A, a, "s", "org:x"), rec(2, A, a, "s", "org:x"), rec(3, A, a, "s", "org:y"), rec(4, A, a, "s", "transport:z"), rec(5, A, a, "t"), rec(6, A, a, "u", held=True), rec(7, A, a, "v", held=True)]
    got = {(r.lo, r.hi) for r in matchers.matches(frame(spark, rows)).collect()}
    assert got == {(1, 3), (2, 3), *((x, 5) for x in (1, 2, 3, 4)), *((x, y) for x in range(1, 6) for y in (6, 7))}
    ordered = matchers.in_order(frame(spark, [*rows, (9, "p", "u6", A, "w", None, False, rows[0][7])]))
    assert 9 not in {r.ord for r in ordered.collect()}  # held already
    g = matchers.grouped(ordered, matchers.matches(ordered)).collect()
    seeds = {r.rep % (1 << 50): r.seed % (1 << 50) for r in g}
    assert seeds[6] == seeds[7] == seeds[3] == seeds[5] == 1 and seeds[2] == 2


def test_partial_names_equal_brute_force(spark):
    rng = random.Random(1)
    names = sorted({"".join(rng.choices("abc", k=rng.randint(1, 6))) for _ in range(60)})
    rows = [rec(i, M, med(n), f"s{i}") for i, n in enumerate(names)]
    got = {(r.lo, r.hi) for r in matchers.partial_name_pairs(matchers.prepared(frame(spark, rows))).collect()}
    assert got == {(i, j) for (i, x), (j, y) in itertools.combinations(enumerate(names), 2) if x in y or y in x}


def _seeds(ords, pairs):
    match, seed = set(pairs), {}
    for a in sorted(ords):
        if a not in seed:
            seed[a] = a
            seed.update({b: a for b in sorted(ords) if b > a and b not in seed and (a, b) in match})
    return seed


def test_groups_equal_the_literal_loop(spark, sf):
    m = matching.members(spark, sf)
    pairs = matchers.matches(m)
    got = {r.rep: r.seed for r in matchers.grouped(m, pairs).collect()}
    assert got == _seeds([r.ord for r in m.select("ord").collect()], [(r.lo, r.hi) for r in pairs.collect()])


def test_resolution(spark):
    lis = lambda d, f, s="active", n="Lisinopril": med(n, [RX + "1"], **{"clinical:dosage": d, "clinical:frequency": f, "clinical:status": s})
    groups = [  # two records each: kind, field, strategy, status
        ([lis("10 mg", "daily"), lis("10 milligrams", "once daily")], M, ("exact_duplicate", None, "trust_priority", "merged")), ([lis("10 mg", "daily"), lis("20 mg", "daily")], M, ("value_conflict", "clinical:dosage", "flag_unresolved", "unresolved-conflict")),
        ([lis("10 mg", "daily"), lis("10 mg", "bid")], M, ("value_conflict", "clinical:frequency", "flag_unresolved", "unresolved-conflict")), ([lis("10 mg", None), lis("10 mg", "bid")], M, ("near_duplicate", None, "merge_values", "merged")),
        ([lis("10 mg", "daily"), lis("10 mg", "daily", "Stopped")], M, ("status_conflict", "clinical:status", "flag_unresolved", "unresolved-conflict")), ([lis("1", "daily"), lis("1", "daily", None, "Prinivil extra")], M, ("near_duplicate", None, "merge_values", "merged")),
        ([{"health:conditionName": "x", "health:status": "active"}, {"health:conditionName": "x", "health:status": "resolved"}], C, ("status_conflict", "health:status", "trust_priority", "conflict-resolved")),
        ([{"health:allergen": "x", "health:allergySeverity": "mild"}, {"health:allergen": "x", "health:allergySeverity": "severe"}], A, ("value_conflict", "health:allergySeverity", "trust_priority", "conflict-resolved")),
        ([lab("c", "2024-01-01", "10"), lab("c", "2024-01-01", "10.2")], L, ("near_duplicate", None, "merge_values", "merged")), ([lab("c", "2024-01-01", "10"), lab("c", "2024-01-01", "20")], L, ("value_conflict", "health:resultValue", "trust_priority", "conflict-resolved")),
    ]
    rows = [rec(10 * i + j, t, p, ("specialist", "hospital")[j], scope=f"g{i}") for i, (ps, t, _) in enumerate(groups) for j, p in enumerate(ps)] + [rec(999, A, {"health:allergen": "alone"})]
    m = frame(spark, rows)
    g = matchers.grouped(m, matchers.matches(m)).cache()
    res = matchers.resolved(m, g, F.col("source_system")).cache()
    got = {r.seed // 10: (r.kind, r.field, r.strategy, r.status) for r in res.where("n_members = 2").collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(groups)}
    assert {r.winner % 10 for r in res.where("n_members = 2").collect()} == {1}  # the hospital is trusted most
    near = res.where("confidence = 0.6 OR confidence >= 0.7")
    assert near.count() == res.count()
    s = matchers.summary(res, m.count()).first()
    assert (s.n_groups, s.n_merges, s.n_near, s.n_value_conflicts, s.n_status_conflicts, s.n_exact, s.n_unresolved, s.n_dropped) == (11, 10, 3, 4, 2, 1, 3, 0)
    values = {(r.canonical_uri, r.predicate): r.values[0].value for r in matchers.merged_values(m, g, res).collect()}
    assert values["u31", "clinical:frequency"] == "bid" and values["u81", "health:resultValue"] == "10.2"
    guard = spark.createDataFrame([("near_duplicate", 2, False), ("near_duplicate", 2, True), ("near_duplicate", 1, False), ("value_conflict", 2, False)], "kind string, n int, t boolean")
    assert [r[0] for r in guard.select(matchers.strategy(F.col("kind"), F.lit(L), F.lit(0.1), F.col("n"), F.col("t"), True)).collect()] == ["flag_cross_provenance", "merge_values", "merge_values", "trust_priority"]


def test_labs_of_a_day_equal_brute_force(spark, sf):
    reps = reconciliation.lab_representatives(spark, sf).collect()
    assert sum(r.n_members for r in reps) > 0 and len({r.rep for r in reps}) == len(reps)
    want = {(min(a.rep, b.rep), max(a.rep, b.rep)) for a, b in itertools.combinations(reps, 2) if (a.pod_id, a.code, a.day) == (b.pod_id, b.code, b.day) and a.src != b.src}
    assert {(r.lo, r.hi) for r in reconciliation.match_labs(spark, sf).collect()} == want
    stated = spark.read.parquet(f"{sf}/observations.parquet").where("code LIKE 'LB-%' AND effective_date_time RLIKE '^[0-9]{4}-[0-9]{2}-[0-9]{2}$'").count()
    assert sum(r.n_members for r in reps) > 1.3 * stated  # other forms than plain dates count, too


def test_converters(spark):
    cc = lambda text, *codings: {"text": text, "coding": [{"system": s, "code": c, "display": d} for s, c, d in codings]}
    resources = [
        {"resourceType": "MedicationRequest", "id": "m", "status": "active", "medicationCodeableConcept": cc("Drug", ("http://www.nlm.nih.gov/research/umls/rxnorm", "29046", None), ("urn:x", "1", None)), "authoredOn": "2024-01-02",
         "dosageInstruction": [{"text": "1 a day", "route": {"coding": [{"display": "Oral"}]}, "timing": {"repeat": {"frequency": 2, "periodUnit": "d"}}}], "reasonReference": [{"reference": "Condition/c"}], "note": [{"text": "a"}, {}, {"text": "b"}]},
        {"resourceType": "AllergyIntolerance", "code": {"coding": [{"display": "Nuts"}]}, "criticality": "high", "category": ["food"], "reaction": [{"manifestation": [cc("Hives"), cc("Rash")]}]},
        {"resourceType": "Observation", "id": "v", "category": [cc("Vital Signs")], "code": cc(None, ("http://loinc.org", "8867-4", "Heart rate")), "valueQuantity": {"value": 72.0}, "effectiveDateTime": "2024-01-01T10:00:00", "interpretation": [{"coding": [{"code": "H"}]}]},
        {"resourceType": "Observation", "id": "l", "code": cc("Panel", ("https://loinc.org", "1-1", None)), "component": [{"code": {"text": "q"}, "valueString": "yes"}, {"code": {"text": "n"}, "valueQuantity": {"value": 3, "unit": "mg"}}], "referenceRange": [{"low": {"value": 1, "unit": "g"}, "high": {"value": 2}}]},
        {"resourceType": "Immunization", "vaccineCode": cc("Flu", ("http://hl7.org/fhir/sid/cvx", "140", None)), "occurrenceDateTime": "2024-01-01", "doseQuantity": {"value": 0.5, "unit": "mL"}},
        {"resourceType": "Coverage", "payor": [{"display": "Payer"}], "subscriberId": "S", "class": [{"type": cc(None, ("x", "group", None)), "value": "G1", "name": "Gold"}, {"type": cc(None, ("x", "rxbin", None)), "value": "77"}]},
        {"resourceType": "ExplanationOfBenefit", "id": "e", "total": [{"category": cc(None, ("x", "submitted", None)), "amount": {"value": 100.0}}, {"category": cc(None, ("x", "benefit", None)), "amount": {"value": 80.5}}], "claim": {"reference": "Claim/1"}},
        {"resourceType": "Patient", "id": "p", "gender": "other", "maritalStatus": cc("Never Married"), "address": [{"city": "X", "line": ["1 St", "Apt 2"]}]}, {"resourceType": "Procedure", "code": cc("Cut"), "performedPeriod": {"start": "2024"}},
        {"resourceType": "DocumentReference", "type": cc("Note"), "content": [{"attachment": {"url": "u", "title": "t"}}]}, {"resourceType": "Device", "type": cc("Pump"), "udiCarrier": [{"carrierHRF": "h"}]}, {"resourceType": "ImagingStudy", "numberOfSeries": 2, "series": [{"modality": {"code": "CT"}}]},
        {"resourceType": "MedicationAdministration", "medicationReference": {"display": "IV"}, "dosage": {"dose": {"value": 5.0, "unit": "mg"}}}, {"resourceType": "Claim", "type": cc("professional"), "diagnosis": [{"diagnosisCodeableConcept": cc(None, ("x", "J45", None))}], "total": {"value": 9.5}},
        {"resourceType": "Basic", "id": "z", "odd": [1]}, {"resourceType": "OperationOutcome"}, {"resourceType": "Condition", "code": "not a concept", "onsetDateTime": 5},
    ]
    df = fhir.entries(spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(resources)], "k long, payload string"), "k", "payload")
    rows = converters.convert_all(df, ["k"]).collect()
    got = {(r.k, r.predicate.split(":")[1]): r.value for r in rows}
    want = {
        (0, "drugName"): "Drug", (0, "drugCode"): RX + "29046", (0, "rxNormCode"): RX + "29046", (0, "route"): "Oral", (0, "frequency"): "2 times daily", (0, "startDate"): "2024-01-02T00:00:00Z", (0, "clinicalIntent"): "prescribed", (0, "indicationReference"): "Condition/c", (0, "notes"): "a; b",
        (1, "allergen"): "Nuts", (1, "allergySeverity"): "severe", (1, "reaction"): "Hives, Rash", (2, "vitalType"): "heartRate", (2, "value"): "72", (2, "unit"): "bpm", (2, "interpretation"): "high", (2, "effectiveDate"): "2024-01-01T10:00:00Z",
        (3, "resultValue"): "q: yes; n: 3 mg", (3, "testCode"): "http://loinc.org/rdf#1-1", (3, "referenceRange"): "1-2 g", (3, "interpretation"): "unknown", (4, "vaccineCode"): "CVX-140", (4, "doseQuantity"): "0.5 mL", (4, "status"): "completed",
        (5, "groupNumber"): "G1", (5, "planName"): "Gold", (5, "rxBin"): "77", (5, "coverageType"): "primary", (6, "totalBilled"): "100", (6, "totalPaid"): "80.5", (6, "relatedClaim"): "Claim/1", (7, "biologicalSex"): "intersex", (7, "maritalStatus"): "single", (7, "addressLine"): "1 St, Apt 2",
        (8, "performedDate"): "2024", (9, "documentUrl"): "u", (10, "udiCarrier"): "h", (11, "imagingModality"): "CT", (11, "numberOfSeries"): "2", (12, "administeredDose"): "5 mg", (13, "hasDiagnosis"): "J45", (13, "claimTotal"): "9.5", (14, "fhirResourceType"): "Basic", (16, "conditionName"): "Unknown Condition", (16, "status"): "active",
    }
    assert {k: (v, got.get(k)) for k, v in want.items() if got.get(k) != v} == {}
    assert json.loads(got[14, "fhirJson"]) == resources[14] and 15 not in {k for k, _ in got}
    back = spark.createDataFrame([({"health:testName": "Na", "health:resultValue": "5", "health:resultUnit": "g"},)], "p map<string,string>").select(converters.to_resource("health:LabResultRecord", F.col("p"))).first()[0]
    assert json.loads(back)["valueQuantity"] == {"value": 5.0, "unit": "g"}


SHAPES = """@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . @prefix ex: <ex:> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
ex:Sub rdfs:subClassOf ex:Rec .
ex:RecShape a sh:NodeShape ; sh:targetClass ex:Rec ; sh:property [ sh:path ex:name ; sh:minCount 1 ; sh:maxCount 1 ; sh:datatype xsd:string ; sh:minLength 2 ; sh:message "name" ] ;
 sh:property [ sh:path ex:status ; sh:in ( "a" "b" ) ; sh:severity sh:Warning ] ; sh:property [ sh:path ex:age ; sh:minInclusive 0 ; sh:maxInclusive 120 ] ;
 sh:property [ sh:path ex:when ; sh:or ( [ sh:datatype xsd:date ] [ sh:datatype xsd:dateTime ] ) ] ; sh:property [ sh:path ex:of ; sh:class ex:Person ; sh:nodeKind sh:IRI ] ;
 sh:property [ sh:path ( ex:of ex:name ) ; sh:minCount 1 ] ; sh:xone ( [ sh:property [ sh:path ex:x ; sh:minCount 1 ] ] [ sh:property [ sh:path ex:y ; sh:minCount 1 ] ] ) ; sh:not [ sh:property [ sh:path ex:bad ; sh:hasValue "yes" ] ] .
ex:P a sh:NodeShape ; sh:targetObjectsOf ex:of ; sh:closed true ; sh:ignoredProperties ( ex:extra ) ; sh:property [ sh:path ex:name ; sh:pattern "^[A-Z]" ] .
ex:Q a sh:NodeShape ; sh:targetSubjectsOf ex:q ; sh:property [ sh:path ex:q ; sh:node ex:P ] . ex:N a sh:NodeShape ; sh:targetNode "n" ; sh:property [ sh:path [ sh:inversePath ex:of ] ; sh:minCount 1 ; sh:severity sh:Info ] .
"""


def test_shapes(spark):
    lit, iri, xsd = (lambda v, d=None: (v, d, False)), (lambda v: (v, None, True)), "http://www.w3.org/2001/XMLSchema#"
    rows = [
        ("r1", ["ex:Rec"], {"ex:name": [lit("Al")], "ex:status": [lit("a")], "ex:age": [lit("5", xsd + "integer")], "ex:when": [lit("2024-01-01", xsd + "date")], "ex:of": [iri("p1")], "ex:x": [lit("1")]}),
        ("r2", ["ex:Sub"], {"ex:name": [lit("A"), lit("B")], "ex:status": [lit("z")], "ex:age": [lit("500")], "ex:when": [lit("x")], "ex:of": [iri("p2")], "ex:x": [lit("1")], "ex:y": [lit("1")], "ex:bad": [lit("yes")]}),
        ("p1", ["ex:Person"], {"ex:name": [lit("Bo")], "ex:extra": [lit("1")]}), ("p2", ["ex:Other"], {"ex:odd": [lit("bo")]}), ("q1", None, {"ex:q": [iri("p1"), iri("p2")]}), ("n", None, None),
    ]
    df = spark.createDataFrame(rows, f"s string, types array<string>, props map<string,{shapes.VALUES}>")
    sh = shapes.Shapes(SHAPES)
    found = shapes.violations(df, sh).cache()
    got = {(r.focus, r.path, r.constraint, r.severity, r.value) for r in found.collect()}
    assert got == {
        ("p2", "", "closed", "violation", "ex:odd"), ("q1", "ex:q", "node", "violation", "p2"), ("r2", "", "not", "violation", None), ("r2", "", "xone", "violation", None), ("r2", "ex:age", "maxInclusive", "violation", "500"), ("r2", "ex:name", "maxCount", "violation", None),
        ("r2", "ex:name", "minLength", "violation", "A"), ("r2", "ex:of", "class", "violation", "p2"), ("r2", "ex:of/ex:name", "minCount", "violation", None), ("r2", "ex:status", "in", "warning", "z"), ("r2", "ex:when", "or", "violation", "x"), ("n", "^ex:of", "minCount", "info", None),
    }
    assert {r.s: r.passed for r in shapes.conforms(found, df).collect()} == {"r1": True, "r2": False, "p1": True, "p2": False, "q1": False, "n": True}
    ok, refused = shapes.gate(df, sh)
    assert {r.s for r in refused.collect()} == {"r2", "p2", "q1"} and ok.count() == 3
    assert shapes.violations(df.limit(0), sh).count() == 0 and shapes.violations(df, shapes.Shapes("")).count() == 0


def test_records_as_seen(spark):
    one = spark.createDataFrame([(["prov:Activity", "health:X"],), (["prov:Activity"],), ([],)], "t array<string>")
    assert [r[0] for r in one.select(records.meaningful_type(F.col("t"))).collect()] == ["health:X", "prov:Activity", None]
    with pytest.raises(ValueError):
        records.of_types(one, {"a": "b"}, ["zzz"], "t")
    flat = spark.createDataFrame([({"health:dose": "1", "z": "2"},), ({c: "1" for c in "gfedcba"},), ({},)], "m map<string,string>")
    assert [r[0] for r in flat.select(records.key_properties("medications", F.col("m"))).collect()] == [{"health:dose": "1"}, {c: "1" for c in "abcde"}, {}]
    paths = spark.createDataFrame([("analysis/x.ttl",), ("z/ai-extraction-1.ttl",), ("z/y.ttl",)], "p string")
    assert [r[0] for r in paths.select(records.bucket_class(F.col("p"))).collect()] == ["ai-extracted", "ai-extracted", "other"]
    t = spark.createDataFrame([("f", i, s, k, "p", o, ok) for i, (s, k, o, ok) in enumerate([("_:z", "bnode", "_:a", "bnode"), ("_:a", "bnode", "x", "literal"), ("s", "iri", "_:q", "bnode")])], "file string, ord long, s string, s_kind string, p string, o string, o_kind string")
    assert sorted((r.ord, r.s, r.o) for r in records.renumbered_blanks(t).collect()) in ([(0, "_:b1", "_:b0"), (1, "_:b0", "x"), (2, "s", "_:b2")], [(0, "_:b0", "_:b1"), (1, "_:b1", "x"), (2, "s", "_:b2")])
    stats = spark.createDataFrame([("b", "s", "rdf:type", "T"), ("b", "s", "core:sourceType", "healthKit"), ("c", "x", "rdf:type", "K"), ("c", "x", "core:dataProvenance", "Lab"), ("c", "y", "rdf:type", "T")], "bucket string, s string, p string, o string")
    assert {r.bucket: (r.n_records, r.provenances) for r in records.statistics(stats, ["K"]).collect()} == {"b": (1, "DeviceGenerated"), "c": (1, "Lab")}
    have = spark.createDataFrame([("T", "x")], "type string, container string")
    assert sorted(r.type for r in records.register(records.register(have, have, ["type"]), spark.createDataFrame([("U", "y"), ("U", "y")], have.schema), ["type"]).collect()) == ["T", "U"]
    typed = spark.createDataFrame([("s", "n", "5"), ("s", "n", "x"), ("s", "d", "2024-02-30"), ("s", "q", "any")], "s string, p string, o string")
    assert [r.error for r in records.typed_values(typed, {"n": "xsd:integer", "d": "xsd:date"}).collect()] == [None, "x is no xsd:integer", "2024-02-30 is no xsd:date", None]
    ld = spark.createDataFrame([("s", "rdf:type", "T", "iri", None, 0), ("s", "k:n", "1", "literal", "xsd:integer", 1), ("s", "k:n", "2", "literal", "xsd:integer", 2), ("s", "k:b", "true", "literal", "xsd:boolean", 3), ("s", "k:t", 'q"', "literal", None, 4)], "s string, p string, o string, o_kind string, datatype string, ord long")
    assert json.loads(records.json_ld(ld).first().json) == {"@context": "https://schema.example/context.jsonld", "@id": "s", "@type": "T", "k:n": 2, "k:b": True, "k:t": 'q"'}


def test_lifting(spark):
    conditions = spark.createDataFrame([("c1", ["a"], "Asthma"), ("c2", ["b"], "Flu"), ("c3", ["b"], "flu"), ("self", ["s"], "Own")], "target string, codes array<string>, name string")
    asked = spark.createDataFrame([("m", 1, ["zz", "a"], "x"), ("m", 2, [], "ASTHMA!"), ("m", 3, ["b"], "nothing"), ("m", 4, None, None), ("n", 5, ["b"], "asthma"), ("self", 6, ["s"], "own"), ("k", 7, ["a"], "")], "subject string, ref long, codes array<string>, text string")
    stated = spark.createDataFrame([("k", "c1")], "subject string, target string")
    got = {r.ref: (r.outcome, r.target) for r in link.lift_indications(asked, conditions, stated).collect()}
    assert got == {1: ("lifted", "c1"), 2: ("redundant", "c1"), 3: ("ambiguous", None), 4: ("unmatched", None), 5: ("lifted", "c1"), 6: ("unmatched", None), 7: ("redundant", "c1")}


def test_merges(spark):
    at = "2024-01-01T08:00:00Z"
    rows = [rec(1, L, lab("c", at, "5"), origin="org:a"), rec(2, L, lab("c", at, "5"), origin="org:b"), rec(3, L, lab("c", at, "6"), origin="org:c"), rec(4, L, lab("d", "2024-01-01", "5"), origin="org:a"), rec(5, L, lab("d", "2024-01-01", "5"), origin="org:b"), rec(6, L, lab("e", at, "5"), origin="org:a"), rec(7, L, lab("e", at, "5"), origin="org:a"), rec(8, L, lab("e", at, "5"))]
    assert [(r.canonical, r.n_members) for r in merges.tier0(frame(spark, rows), ["scope"]).collect()] == [(1, 2)]
    j = spark.createDataFrame([(1, "a", "T"), (1, "b", "T"), (2, "c", "T"), (3, "d", None), (4, "e", "U"), (5, "f", "V"), (6, "g", "T")], "merge_id long, uri string, record_type string")
    live, buckets = spark.createDataFrame([("c", "T")], "uri string, record_type string"), spark.createDataFrame([("T", True), ("V", False)], "record_type string, is_there boolean")
    states = merges.undo_states(j, live, buckets, spark.createDataFrame([("g",)], "uri string"))
    assert {r.merge_id: (r.status, r.reason) for r in states.collect()} == {1: ("restorable", None), 2: ("blocked", "live record"), 3: ("blocked", "no type"), 4: ("blocked", "no bucket"), 5: ("blocked", "bucket gone"), 6: ("already-undone", None)}
    assert {r.uri for r in merges.undo(live, j, states).collect()} == {"a", "b", "c"}
    d = spark.createDataFrame([("k", 1, "a", ["a", "b"]), ("k", 2, "b", ["a", "b"]), ("m", 1, "x", ["x", "y"])], "conflict_id string, resolved_at long, kept string, candidates array<string>")
    assert [(r.conflict_id, r.kept, r.discarded) for r in merges.resolutions(d).collect()] == [("m", "x", ["y"]), ("k", "b", ["a"])]
    assert [r.conflict_id for r in merges.open_conflicts(spark.createDataFrame([("k",), ("z",)], "conflict_id string"), d).collect()] == ["z"]


def test_patches(spark):
    text = '@envelope issuer "i" .\n@envelope advisoryClass "c" .\nBind ?x clinical:loincCode "4548-4" .\nAdd { ?x clinical:flag "review" . ?x a clinical:Flagged . } .'
    p = advisory.parse_patch(text)
    assert p.bind == ("?x", "clinical:loincCode", '"4548-4"') and len(p.adds) == 2 and advisory.check_patch(p) == []
    assert advisory.check_patch(advisory.Patch(("?x", "foaf:name", "<u>"), [("?y", "evil:p", '"1"')])) == ["C2", "C3", "C4", "C6"]
    assert advisory.check_patch(advisory.Patch(None, [("<u>", "prov:p", '"1"')] * 65, {"issuer": "i", "advisoryClass": "c"})) == ["C5"] and "C1" in advisory.check_patch(advisory.Patch())
    for bad in ("Delete { <a> <b> <c> } .", "Nonsense", "Bind ?x a:b \"1\" . Bind ?y a:b \"1\" ."):
        with pytest.raises(ValueError):
            advisory.parse_patch(bad)
    ads = spark.createDataFrame([("1", "i", "c", "s"), ("2", "i", "c", "t"), ("3", "z", "c", "s"), ("4", "i", "c", None)], "advisory string, issuer string, class string, s string")
    quality = spark.createDataFrame([("t", "consumer-grade", False)], "s string, tier string, requires_confirmation boolean")
    assert {r.advisory: r.decision for r in advisory.policy(ads, spark.createDataFrame([("i", "c")], "issuer string, class string"), quality).collect()} == {"1": "auto-apply", "2": "queue", "3": "queue", "4": "auto-apply"}
    t = spark.createDataFrame([("monthly", "2024-01-01"), ("monthly", "2023-12-01"), ("immediate", "2024-01-15"), ("yearly", None)], "tier string, last string")
    assert [r[0] for r in t.select(advisory.due(F.col("tier"), F.col("last"), F.lit("2024-01-15"))).collect()] == [False, True, True, True]


def test_genomics(spark):
    m = spark.createDataFrame([("g1", 0, "v1", "c.[1A>G];[2C>T]"), ("g1", 1, "v2", None), ("g2", 0, "v3", None), ("g2", 1, "v4", None), ("g2", 2, "v5", None), ("g3", 0, "v6", None), ("g4", 0, "a", "c.[1;2]"), ("g4", 1, "b", None), ("g4", 2, "c", None)], "genotype string, place int, variant string, notation string")
    links, gaps = genomics.phase_links(m)
    assert {tuple(r) for r in links.collect()} == {("g1", "v1", "v2", "InTrans"), ("g1", "v2", "v1", "InTrans"), ("g2", "v3", "v4", "PhaseUnknown"), ("g2", "v4", "v3", "PhaseUnknown")}
    assert [tuple(r) for r in gaps.collect()] == [("g2", 3)]
    o = spark.createDataFrame([("v", "Germline"), ("v", "de novo"), ("w", "somatic"), ("x", "somatic"), ("x", "maternal"), ("y", ""), ("z", "not provided")], "variant string, origin string")
    assert {r.variant: r.state for r in genomics.origin_states(o).collect()} == {"v": "Germline", "w": "Somatic", "x": "Unknown", "z": "Unknown"}
    stages = [spark.createDataFrame([("b", "1", "urn:1", "V1")], "scope string, id string, url string, target string"), spark.createDataFrame([("b", "1", "urn:2", "H1")], "scope string, id string, url string, target string")]
    refs = spark.createDataFrame([("b", "Observation/1"), ("b", "urn:2"), ("b", "Observation/9"), ("c", "Observation/1")], "scope string, ref string")
    assert {(r.scope, r.ref): r.target for r in genomics.resolve_members(refs, stages).collect()} == {("b", "Observation/1"): "V1", ("b", "urn:2"): "H1", ("b", "Observation/9"): None, ("c", "Observation/1"): None}
    rcv = spark.createDataFrame([("r", "t1", "Likely benign", "practice guideline"), ("q", "zz", "odd", None)], "rcv string, trait_set string, classification string, review_status string")
    sets = spark.createDataFrame([("t1", "a", "B"), ("t1", "b", "A")], "trait_set string, trait string, condition string")
    assert {r.rcv: (r.conditions, r["class"], r.stars) for r in genomics.interpretations(rcv, sets).collect()} == {"r": (["A", "B"], "LikelyBenign", 4), "q": ([], None, None)}
    scv = spark.createDataFrame([("s", "v", "t", "Laboratory")], "scv string, variant string, trait_name string, category string")
    got = genomics.assertions(scv, spark.createDataFrame([("s", "t", "A")], "scv string, trait_name string, condition string"), spark.createDataFrame([("r", "v", "A")], "rcv string, variant string, condition string")).first()
    assert (got.rcv, got.category) == ("r", "SubmitterLaboratory")
    fam = spark.createDataFrame([("f", "p", "d", "m", "MALE", True), ("f", "d", None, None, "MALE", False), ("f", "m", None, None, "FEMALE", False), ("f", "s", "d", "x", "female", False), ("f", "k", "p", None, "UNKNOWN", False), ("f", "j", "p", "0", "MALE", False), ("f", "o", "0", "0", "MALE", False)], "family string, member string, father string, mother string, sex string, is_proband boolean")
    assert {r.member: r.role for r in genomics.pedigree_roles(fam).collect()} == {"p": "Proband", "d": "FTH", "m": "MTH", "s": "SIS", "k": None, "j": "SON", "o": None}
    obs = {"resourceType": "Observation", "component": [{"code": {"coding": [{"code": "48018-6"}]}, "valueCodeableConcept": {"coding": [{"code": "HGNC:1", "display": "ABC"}]}}, {"code": {"coding": [{"code": "48018-6"}]}, "valueString": "later"}, {"code": {"coding": [{"code": "53034-5"}]}, "valueCodeableConcept": {"coding": [{"code": "LA6706-1"}]}}, {"code": {"text": "?"}}]}
    df = fhir.entries(spark.createDataFrame([(1, json.dumps(obs))], "k long, payload string"), "k", "payload")
    assert {(r.name, r.code, r.value) for r in genomics.components(df, ["k"]).collect()} == {("gene", "HGNC:1", "ABC"), ("zygosity", "LA6706-1", None)}
    pk = spark.createDataFrame([(1, json.dumps({"diseases": [{}], "measurements": [], "genes": [1, 2]})), (2, "{"), (3, None)], "k long, payload string")
    assert {tuple(r) for r in genomics.gaps(pk, "k", "payload").collect()} == {(1, "diseases", 1), (1, "genes", 2)}
