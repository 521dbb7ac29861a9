"""Sources and sinks over whole tables: rows are written in a format, read back by its scanner, and held against the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.common import read
from recordloom.operators import genomics
from recordloom.plans.catalog import Catalog
from recordloom.sources import formats, turtle, vcf, xml

CATALOG = Catalog()
query = CATALOG.query


def _vcf_lines(spark: SparkSession, sf: str) -> DataFrame:
    """One line an order line: position, two alternate alleles, frequencies and a genotype of its columns."""
    k = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    gt = F.element_at(F.array(*[F.lit(x) for x in ("0/1", "1/1", "0/0", "./.", "1")]), (F.pmod(k, F.lit(5)) + 1).cast("int"))
    info = F.concat(F.lit("AF="), F.col("l_discount"), F.lit(",1.5;DP="), F.col("l_quantity").cast("int"), F.lit(";DB"))
    line = F.concat_ws("\t", F.concat(F.lit("chr"), (F.col("l_suppkey") % 22 + 1).cast("string")), k.cast("string"), F.concat(F.lit("rs"), k.cast("string")), F.lit("ACG"), F.lit("A,T"), F.lit("50"), F.lit("PASS"), info, F.lit("DP:GT"), F.concat(F.lit("9:"), gt))
    return read(spark, sf, "lineitem").select(F.lit("lines").alias("file"), line.alias("value"))


@query(
    """WITH l AS (SELECT l_orderkey * 8 + l_linenumber AS k, l_suppkey, l_discount, l_quantity FROM lineitem)
    SELECT 'chr' || (l_suppkey % 22 + 1) AS chrom, k AS pos, k + 2 AS "end", unnest(['A', 'T']) AS alt, unnest([l_discount, NULL]) AS frequency, 'rs' || k AS rs_id, l_quantity::INT::VARCHAR AS depth,
      CASE k % 5 WHEN 0 THEN 'Heterozygous' WHEN 1 THEN 'Homozygous' WHEN 2 THEN 'HomRef' WHEN 4 THEN 'Hemizygous' END AS zygosity FROM l"""
)
def vcf_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Variant lines made of order lines, read as alleles."""
    return vcf.alleles(_vcf_lines(spark, sf)).select("chrom", "pos", "end", "alt", "frequency", "rs_id", F.col("info")["DP"].alias("depth"), "zygosity")


@query("SELECT 'FORMAT' AS kind, n_name AS id, 'about \"' || n_name || '\", all' AS description FROM nation")
def vcf_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Structured header lines with commas and quotes in them."""
    text = F.concat(F.lit("##FORMAT=<ID="), "n_name", F.lit(',Number=1,Description="about \\"'), "n_name", F.lit('\\", all">'))
    h = vcf.header(read(spark, sf, "nation").select(F.lit("f").alias("file"), text.alias("value")))
    return h.select("kind", "id", F.replace(F.col("fields")["Description"], F.lit('\\"'), F.lit('"')).alias("description"))


def _escaped(c: str) -> F.Column:
    out = F.col(c)
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


@query(
    """SELECT doc_id::VARCHAR AS file, 'S-1' AS section_code, doc_type AS title, doc_id::VARCHAR AS id_extension, source AS code, lang AS display, n_chars::VARCHAR AS value, CASE WHEN lang IS NULL THEN 'unknown' END AS absent_reason FROM documents WHERE doc_type IS NOT NULL"""
)
def clinical_xml_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Documents' columns written as clinical documents, with references into the narrative, and read back."""
    d = read(spark, sf, "documents").where("doc_type IS NOT NULL")
    name = F.when(F.col("lang").isNotNull(), F.concat(F.lit('<text><content ID="n1">'), _escaped("lang"), F.lit("</content></text>"))).otherwise("<text/>")
    coded = F.concat(F.lit('<code code="'), _escaped("source"), F.when(F.col("lang").isNull(), F.lit('" nullFlavor="UNK">')).otherwise('">'), F.when(F.col("lang").isNotNull(), F.lit('<originalText><reference value="#n1"/></originalText>')).otherwise(""), F.lit("</code>"))
    text = F.concat(
        F.lit('<ClinicalDocument xmlns="urn:hl7-org:v3"><component><structuredBody><component><section><code code="S-1"/><title>'), _escaped("doc_type"), F.lit("</title>"), name,
        F.lit('<entry><observation><id root="1.2" extension="'), F.col("doc_id"), F.lit('"/>'), coded, F.lit('<value value="'), F.col("n_chars"), F.lit('" unit="c"/></observation></entry></section></component></structuredBody></component></ClinicalDocument>'),
    )
    s = xml.sections(d.select(F.col("doc_id").cast("string").alias("file"), text.alias("text")))
    return s.select("file", "section_code", "title", "id_extension", "code", "display", "value", "absent_reason")


@query(
    """SELECT pod_id::VARCHAR AS packet, patient_id::VARCHAR AS code, 'T:' || (patient_id % 97) AS term, patient_id % 3 = 0 AS excluded FROM patients"""
)
def phenopacket_scan(spark: SparkSession, sf: str) -> DataFrame:
    """One packet a patient with one feature each, written and read."""
    p = read(spark, sf, "patients")
    feature = F.struct(F.struct(F.concat(F.lit("T:"), F.col("patient_id") % 97).alias("id")).alias("type"), (F.col("patient_id") % 3 == 0).alias("excluded"))
    packet = F.to_json(F.struct(F.struct(F.col("patient_id").cast("string").alias("id")).alias("subject"), F.array(feature).alias("phenotypicFeatures")))
    out = formats.phenotypes(p.select(F.col("pod_id").cast("string").alias("packet"), packet.alias("payload")), "packet", "payload")
    return out.select("packet", F.col("subject_id").alias("code"), "term", "excluded")


@query(
    """WITH p AS (SELECT patient_id::VARCHAR AS packet, gender, patient_id FROM patients) SELECT packet, 'subject' AS part, 0 AS ix, packet AS code, CASE gender WHEN 'male' THEN 'male' WHEN 'female' THEN 'female' ELSE 'intersex' END AS label, NULL AS status FROM p
    UNION ALL SELECT packet, 'interpretation', 0, 'D:' || (patient_id % 7), NULL, 'SOLVED' FROM p UNION ALL SELECT packet, 'variant', 0, packet, CASE patient_id % 2 WHEN 0 THEN 'Pathogenic' ELSE 'VUS' END, 'Causative' FROM p"""
)
def phenopacket_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Subjects, diagnoses and variant classes of packets."""
    p = read(spark, sf, "patients")
    name = F.col("patient_id").cast("string")
    sex = F.when(F.col("gender") == "male", "MALE").when(F.col("gender") == "female", "FEMALE").otherwise("OTHER_SEX")
    variant = F.struct(name.alias("subjectOrBiosampleId"), F.lit("CAUSATIVE").alias("interpretationStatus"), F.struct(F.when(F.col("patient_id") % 2 == 0, "PATHOGENIC").otherwise("UNCERTAIN_SIGNIFICANCE").alias("acmgPathogenicityClassification")).alias("variantInterpretation"))
    diagnosis = F.struct(F.struct(F.concat(F.lit("D:"), F.col("patient_id") % 7).alias("id")).alias("disease"), F.array(variant).alias("genomicInterpretations"))
    packet = F.to_json(F.struct(F.struct(name.alias("id"), sex.alias("sex")).alias("subject"), F.array(F.struct(F.lit("SOLVED").alias("progressStatus"), diagnosis.alias("diagnosis"))).alias("interpretations")))
    return genomics.packet_parts(p.select(name.alias("packet"), packet.alias("payload")), "packet", "payload")


_KEY = "0123456789abcdef0123456789abcdef"


@query("SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN 'encrypted' WHEN doc_id % 3 = 1 THEN 'plaintext' ELSE 'unreadable' END AS state FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text END AS text FROM documents WHERE text IS NOT NULL)")
def encryption_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Texts encrypted and read again; a third is left plain, a third has another key."""
    key, other = F.lit(_KEY), F.lit(_KEY[::-1])
    third = F.pmod("doc_id", F.lit(3))
    stored = F.when(third == 0, formats.encrypted(F.col("text"), key)).when(third == 1, F.lit("plain text: ") ).otherwise(formats.encrypted(F.col("text"), other))
    # The envelope differs each time it is made, so it is made once.
    d = read(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.explode(F.array(stored)).alias("stored"))
    return d.select("doc_id", formats.decrypted(F.col("stored"), key).alias("text"), formats.resource_state(F.col("stored"), key).alias("state"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'new' ELSE event_type END AS event_type FROM events UNION ALL SELECT event_id + 1000000000, 'new' FROM events WHERE event_id % 4 = 0")
def upsert_events(spark: SparkSession, sf: str) -> DataFrame:
    """A quarter of the events replaced by new rows of the same key, and as many added."""
    e = read(spark, sf, "events").select("event_id", "event_type")
    changed = e.where("event_id % 4 = 0").withColumn("event_type", F.lit("new"))
    return formats.upsert(e, changed.unionByName(changed.withColumn("event_id", F.col("event_id") + 1_000_000_000)), "event_id")


@query("SELECT CASE record_type WHEN 'clinical:LabResultRecord' THEN 'clinical/lab-results' WHEN 'clinical:ConditionRecord' THEN 'clinical/conditions' ELSE 'passthrough' END AS bucket, count(*) AS n FROM records GROUP BY ALL")
def route_records(spark: SparkSession, sf: str) -> DataFrame:
    r = formats.route(read(spark, sf, "records"), "record_type", {"clinical:LabResultRecord": "clinical/lab-results", "clinical:ConditionRecord": "clinical/conditions"})
    return r.groupBy("bucket").agg(F.count("*").alias("n"))


@query("SELECT customer.c_custkey::VARCHAR AS file, 'urn:c:' || c_custkey AS s, unnest(['http://x/balance', 'http://x/name']) AS p, unnest([c_acctbal::VARCHAR, c_name || ' \"q\" \\ ' || c_mktsegment]) AS o FROM customer")
def turtle_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Rows written as Turtle documents and parsed again, quotes and backslashes included."""
    c = read(spark, sf, "customer")
    pairs = F.array(
        F.struct(F.lit("http://x/balance").alias("p"), F.col("c_acctbal").cast("string").alias("o")), F.struct(F.lit("http://x/name").alias("p"), F.concat("c_name", F.lit(' "q" \\ '), "c_mktsegment").alias("o"))
    )
    t = c.select(F.concat(F.lit("urn:c:"), "c_custkey").alias("s"), F.lit("iri").alias("s_kind"), F.inline(pairs)).withColumns({"o_kind": F.lit("literal"), "datatype": F.lit(None).cast("string"), "lang": F.lit(None).cast("string")})
    docs = turtle.write(t).select(F.regexp_extract("s", r"(\d+)$", 1).alias("file"), F.col("turtle").alias("text"))
    return turtle.scan(docs).select("file", "s", "p", "o")
