from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from recordloom.sources import fhir, folders, formats, turtle, vcf, xml

DOC = """@prefix ex: <http://x.example/> . # note
@base <http://b.example/> .
ex:a a ex:T , ex:U ; ex:p "one\\n\\"two\\"" , "drei"@de , 5 , 1.5 , true ; ex:q [ ex:r <rel> ] ; .
_:n ex:list ( 1 ex:b ) ; ex:long \"\"\"a "quoted" line
next\"\"\"^^<http://www.w3.org/2001/XMLSchema#string> .
"""


def test_turtle_terms():
    t = turtle.parse(DOC)
    by = {(r[0], r[2].rsplit("/", 1)[-1], r[3]): r for r in t}
    assert ("http://x.example/a", "22-rdf-syntax-ns#type", "http://x.example/U") in by
    assert ("http://x.example/a", "p", 'one\n"two"') in by
    assert by["http://x.example/a", "p", "drei"][6] == "de"
    assert {r[5] for r in t if r[3] in ("5", "1.5", "true")} == {turtle.XSD + k for k in ("integer", "decimal", "boolean")}
    assert any(r[3] == "http://b.example/rel" for r in t)
    assert sum(r[2] == turtle.RDF + "first" for r in t) == 2
    assert any(r[3] == 'a "quoted" line\nnext' and r[5] is None for r in t)


@pytest.mark.parametrize("bad", ["ex:a ex:b ex:c .", "<a> <b> ", "<a> <b> <c> ; ; <d>", "[ <a> <b>"])
def test_turtle_errors(bad):
    with pytest.raises(turtle.TurtleError):
        turtle.parse(bad)


def test_turtle_round_trip(spark):
    docs = spark.createDataFrame([("f1", DOC), ("f2", "garbage here"), ("f3", ""), ("f4", None)], "file string, text string")
    t = turtle.scan(docs).cache()
    assert [r.file for r in t.where("error IS NOT NULL").collect()] == ["f2"]
    named = t.where("s_kind = 'iri' AND o_kind <> 'bnode' AND error IS NULL")
    text = "\n".join(r.turtle for r in turtle.write(named).collect())
    want = {tuple(r) for r in named.select("s", "p", "o", "datatype", "lang").collect()}
    assert {(r[0], r[2], r[3], r[5], r[6]) for r in turtle.parse(text)} == want


def test_fhir_records(spark):
    bundle = {"resourceType": "Bundle", "entry": [
        {"resource": {"resourceType": "Observation", "id": "o1", "code": {"text": "Glucose", "coding": [{"code": "LB-1"}]}, "valueQuantity": {"value": 5.5, "unit": "mmol/L"}, "effectiveDateTime": "2024-01-01"}},
        {"fullUrl": "x"}, {"resource": {"resourceType": "Basic", "id": "b"}}]}
    rows = [(1, json.dumps(bundle)), (2, '{"resourceType": "Patient", "id": "p"}'), (3, "{broken"), (4, None), (5, "[]"), (6, "﻿" + json.dumps({"resourceType": "Bundle", "entry": []}))]
    df = spark.createDataFrame(rows, "bundle_id long, payload string")
    got = {(r.bundle_id, r.ix): r for r in fhir.records(fhir.entries(df, "bundle_id", "payload"), "bundle_id").collect()}
    assert set(got) == {(1, 0), (1, 2), (2, 0)}
    o = got[1, 0]
    assert (o.label, o.code, o.value, o.unit, o.effective, o.strategy) == ("Glucose", "LB-1", 5.5, "mmol/L", "2024-01-01", "mapped")
    assert got[1, 2].strategy == "passthrough"


def test_fhir_bundle_out(spark, sf):
    obs = spark.read.parquet(f"{sf}/observations.parquet")
    out = fhir.observations_to_bundles(obs, "pod_id").limit(3).collect()
    for r in out:
        b = json.loads(r.bundle)
        assert b["resourceType"] == "Bundle" and all(e["resource"]["resourceType"] == "Observation" for e in b["entry"])


VCF = """##fileformat=VCFv4.2
##INFO=<ID=AF,Number=A,Type=Float,Description="Frequency, of alleles">
##contig=<ID=chr1>
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1
chr1\t100\trs12;x\tA\tG,T\t50\tPASS\tAF=0.25,1.5;DB\tGT:DP\t1|1:9
chr1\t200\t.\tACG\tA\t.\tq10\tEND=250\tGT\t0/1
chrX\t5\t.\tC\tT\t1\tPASS\t.\tGT\t1
chrX\t6\t.\tC\tT\t1\tPASS\t.\tDP\t3
"""


def test_vcf(spark):
    lines = spark.createDataFrame([("f", x) for x in VCF.splitlines()], "file string, value string")
    h = {(r.kind, r.id): r.fields for r in vcf.header(lines).collect()}
    assert h["INFO", "AF"]["Description"] == "Frequency, of alleles" and h["fileformat", None]["value"] == "VCFv4.2"
    a = {(r.pos, r.alt): r for r in vcf.alleles(lines).collect()}
    assert len(a) == 5
    assert (a[100, "G"].frequency, a[100, "T"].frequency, a[100, "G"].rs_id, a[100, "G"].zygosity) == (0.25, None, "rs12", "Homozygous")
    assert (a[200, "A"].end, a[200, "A"].zygosity, a[200, "A"].qual) == (250, "Heterozygous", None)
    assert a[5, "T"].zygosity == "Hemizygous" and a[6, "T"].zygosity is None


CDA = """<ClinicalDocument xmlns="urn:hl7-org:v3"><component><structuredBody><component><section><code code="30954-2"/><title>Results</title>
<text><content ID="n1">Sodium, serum</content></text>
<entry><organizer><component><observation><id root="1.2" extension="x"/><code code="LB-7"><originalText><reference value="#n1"/></originalText></code>
<effectiveTime value="20240102"/><value value="140" unit="mmol/L"/></observation></component></organizer></entry>
<entry><observation><code nullFlavor="UNK"/></observation></entry></section></component>
<component><section><code code="10164-2"/><title>History</title><text>Nothing new.</text></section></component></structuredBody></component></ClinicalDocument>"""


def test_clinical_sections(spark):
    docs = spark.createDataFrame([("a", CDA), ("b", "<open>"), ("c", None)], "file string, text string")
    rows = xml.sections(docs).collect()
    assert [r.file for r in rows if r.error] == ["b"]
    ok = [r for r in rows if r.file == "a"]
    assert [(r.section_code, r.entry_ix) for r in ok] == [("30954-2", 0), ("30954-2", 1), ("10164-2", -1)]
    assert (ok[0].display, ok[0].value, ok[0].unit, ok[0].effective, ok[0].id_extension) == ("Sodium, serum", "140", "mmol/L", "20240102", "x")
    assert ok[1].absent_reason == "unknown" and ok[2].display == "Nothing new."


def test_variations(spark):
    text = '<ClinVarVariationRelease><VariationArchive VariationID="7" VariationName="n" VariationType="Deletion"><Gene Symbol="G1"/><ReviewStatus>reviewed</ReviewStatus><Description>Benign</Description><ClinicalAssertion/><ClinicalAssertion/></VariationArchive></ClinVarVariationRelease>'
    r = xml.variations(spark.createDataFrame([("f", text)], "file string, text string")).first()
    assert (r.variation_id, r.gene, r.significance, r.n_submissions) == ("7", "G1", "Benign", 2)


def test_sniff(spark):
    heads = {"zip": "PK\x03\x04zz", "vcf": VCF, "ccda": '<?xml version="1.0"?>\n' + CDA, "fhir": '﻿ {"resourceType": "Patient"}', "json": "[1]", "turtle": DOC, "unknown": "hello", "allele": '{"type": "Allele"}', "xml": "<?xml?><a/>"}
    df = spark.createDataFrame([(k, v[:512]) for k, v in heads.items()], "want string, head string")
    assert [r.want for r in df.where(formats.sniff(F.col("head")) != F.col("want")).collect()] == []


def test_alleles_and_phenotypes(spark):
    allele = {"type": "Allele", "id": "ga4gh:VA.x", "location": {"start": 1, "end": 2, "sequenceReference": {"refgetAccession": "SQ.abc"}}, "state": {"sequence": "T"}}
    df = spark.createDataFrame([(1, json.dumps(allele)), (2, "{}"), (3, None)], "k long, p string")
    r = formats.alleles(df, "k", "p").collect()
    assert len(r) == 1 and r[0].computed_id.startswith("ga4gh:VA.") and len(r[0].computed_id) == 41 and r[0].is_consistent is False
    packet = {"subject": {"id": "s"}, "phenotypicFeatures": [{"type": {"id": "HP:1", "label": "x"}}, {"type": {"id": "HP:2"}, "excluded": True}]}
    p = formats.phenotypes(spark.createDataFrame([(1, json.dumps(packet))], "k long, p string"), "k", "p").collect()
    assert [(x.ix, x.term, x.excluded) for x in p] == [(0, "HP:1", False), (1, "HP:2", True)]


def test_encryption_and_upsert(spark):
    df = spark.createDataFrame([(1, "secret text"), (2, "")], "k long, t string")
    key, other = F.lit("0123456789abcdef"), F.lit("fedcba9876543210")
    e = df.withColumn("e", formats.encrypted(F.col("t"), key)).cache()
    assert [r.d for r in e.select(formats.decrypted(F.col("e"), key).alias("d")).collect()] == ["secret text", ""]
    assert [r.s for r in e.select(formats.resource_state(F.col("e"), other).alias("s")).collect()] == ["unreadable"] * 2
    u = formats.upsert(df, spark.createDataFrame([(2, "new"), (3, "x")], "k long, t string"), "k")
    assert {(r.k, r.t) for r in u.collect()} == {(1, "secret text"), (2, "new"), (3, "x")}
    routed = formats.route(df.withColumn("type", F.lit("Lab")), "type", {"Lab": "clinical"})
    assert routed.first().bucket == "clinical"


def test_folders_and_archives(spark, tmp_path):
    import gzip
    import zipfile

    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.json").write_text('\ufeff{"resourceType": "Patient"}')
    (tmp_path / "in/sub/b.vcf.gz").write_bytes(gzip.compress(b"##fileformat=VCFv4.2"))
    with zipfile.ZipFile(tmp_path / "in/c.zip", "w") as z:
        z.writestr("x/doc.xml", "<ClinicalDocument/>")
        z.writestr("__MACOSX/doc.xml", "no")
    (tmp_path / "in/d.zip").write_bytes(b"PK\x03\x04broken")
    files = folders.walk(spark, str(tmp_path / "in"))
    name = lambda f: f.rsplit("/in/", 1)[-1]
    assert {name(r.file): r.format for r in folders.inventory(files).collect()} == {"a.json": "fhir", "sub/b.vcf.gz": "gzip", "c.zip": "zip", "d.zip": "zip"}
    got = {name(r.file): (r.text, r.error is not None) for r in folders.texts(folders.walk(spark, str(tmp_path / "in"), "*.[jz][si][op]*")).collect()}
    assert got["a.json"] == ('{"resourceType": "Patient"}', False) and got["c.zip!x/doc.xml"] == ("<ClinicalDocument/>", False) and got["d.zip"] == (None, True) and len(got) == 3
    c = folders.completeness(files, spark.createDataFrame([("a.json",), ("z.json",)], "name string")).first()
    assert (c.n_expected, c.n_found, c.share) == (2, 1, 0.5)


def test_document_types_and_ids(spark):
    d = spark.createDataFrame([("a", '<ClinicalDocument xmlns="u"><typeId root="1"/><code codeSystem="x" code="34133-9"/></ClinicalDocument>'), ("b", "<ClinicalDocument/>"), ("c", None)], "file string, text string")
    assert {r.file: r.document_type for r in xml.document_types(d).collect()} == {"a": "summarization", "b": "other", "c": "other"}
    e = spark.createDataFrame([("1", "x", "f1" * 10), ("1", "x", "f2" * 10), ("1", "y", "f3" * 10), (None, "z", "f4"), ("2", None, "f5")], "id_root string, id_extension string, fingerprint string")
    assert sorted(map(str, (r.record_id for r in xml.record_ids(e).collect()))) == ["1:x#f1f1f1f1f1f1", "1:x#f2f2f2f2f2f2", "1:y", "2", "None"]
    filled = xml.with_defaults(spark.createDataFrame([(None,), ("own",)], "source_system string"), "batch", "org:x").collect()
    assert [(r.source_system, r.source_identity) for r in filled] == [("batch", "org:x"), ("own", "org:x")]
