"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.common import read
from recordloom.functions import codes, dates, identity, text
from recordloom.plans.catalog import Catalog

CATALOG = Catalog()
query = CATALOG.query


# The SQL below is written from the rules, not from the tables of `functions.text`, so that it can find errors in them.
_NAME_SQL = r"""trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '\d+(\.\d+)?\s*(mg|mcg|g|ml|%|iu|units?|meq)\b', '', 'g'), '\b(oral|tablet|capsule|solution|injection|extended|release|er|xr|cr|sr|hr)\b', '', 'g'), '\s+', ' ', 'g'))"""
_GENERIC_SQL = """CASE name WHEN 'zyrtec' THEN 'cetirizine' WHEN 'claritin' THEN 'loratadine' WHEN 'allegra' THEN 'fexofenadine' WHEN 'benadryl' THEN 'diphenhydramine' WHEN 'lipitor' THEN 'atorvastatin'
  WHEN 'crestor' THEN 'rosuvastatin' WHEN 'zocor' THEN 'simvastatin' WHEN 'tylenol' THEN 'acetaminophen' WHEN 'advil' THEN 'ibuprofen' WHEN 'norvasc' THEN 'amlodipine' WHEN 'lasix' THEN 'furosemide' ELSE name END"""


@query(f"SELECT med_id, {_GENERIC_SQL} AS name FROM (SELECT med_id, {_NAME_SQL.format('medication_text')} AS name FROM medications)")
def fn_medication_name(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "medications").select("med_id", text.medication_name(F.col("medication_text")).alias("name"))


@query(
    """SELECT med_id, trim(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(d, 'once daily', 'qd'), 'once a day', 'qd'), 'twice daily', 'bid'), 'twice a day', 'bid'), 'three times daily', 'tid'),
      'three times a day', 'tid'), 'four times daily', 'qid'), 'four times a day', 'qid'), 'every day', 'qd'), 'daily', 'qd')) AS frequency,
    CASE WHEN trim(d) IN ('po', 'by mouth', 'orally', 'oral') THEN 'oral' WHEN trim(d) IN ('inhaled', 'inhale', 'nebulized') THEN 'inhalation' WHEN trim(d) = 'iv' THEN 'intravenous' WHEN trim(d) = 'im' THEN 'intramuscular'
      WHEN trim(d) IN ('subcut', 'sc', 'sq') THEN 'subcutaneous' WHEN trim(d) = 'sl' THEN 'sublingual' WHEN trim(d) = 'pr' THEN 'rectal' WHEN trim(d) = 'intranasal' THEN 'nasal' ELSE trim(d) END AS route
    FROM (SELECT med_id, lower(dosage_text) AS d FROM medications)"""
)
def fn_frequency_route(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "medications").select("med_id", text.frequency(F.col("dosage_text")).alias("frequency"), text.route(F.col("dosage_text")).alias("route"))


@query("SELECT med_id, replace(replace(replace(replace(replace(replace(lower(medication_text), ' ', ''), 'milligram', 'mg'), 'microgram', 'mcg'), 'gram', 'g'), 'mgs', 'mg'), 'mcgs', 'mcg') AS dose FROM medications")
def fn_dose(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "medications").select("med_id", text.dose(F.col("medication_text")).alias("dose"))


@query(
    r"SELECT obs_id, trim(regexp_replace(regexp_replace(lower(code_text), '\([^)]*\)', '', 'g'), '\s+', ' ', 'g')) AS condition_name, trim(regexp_replace(lower(code_text), '[^a-z0-9]+', ' ', 'g')) AS index_name FROM observations"
)
def fn_index_names(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("code_text")
    return read(spark, sf, "observations").select("obs_id", text.condition_name(c).alias("condition_name"), text.index_name(c).alias("index_name"))


@query("SELECT obs_id, try_cast(nullif(regexp_extract(value_string, '^\\s*([+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?)', 1), '') AS DOUBLE) AS number FROM observations")
def fn_float_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "observations").select("obs_id", text.float_prefix(F.col("value_string")).alias("number"))


@query(
    r"""SELECT obs_id, nullif(regexp_extract(bare, '(?:^|/)([A-Z][A-Za-z]+)/[^/]+$', 1), '') AS ref_type,
    CASE WHEN starts_with(bare, 'urn:uuid:') THEN substr(bare, 10) ELSE regexp_extract(bare, '[^/]*$') END AS ref_id
    FROM (SELECT obs_id, regexp_replace(subject_reference, '/_history(/.*)?$', '') AS bare FROM observations)"""
)
def fn_parse_reference(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("subject_reference")
    return read(spark, sf, "observations").select("obs_id", text.reference_type(c).alias("ref_type"), text.reference_id(c).alias("ref_id"))


@query("SELECT edge_id, regexp_extract(regexp_extract(object_uri, '[^/]*$'), '[^#]*$') AS code FROM record_edges")
def fn_code_value(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "record_edges").select("edge_id", text.code_value(F.col("object_uri")).alias("code"))


_GENERIC_WORDS_SQL = (
    "health|healthcare|system|systems|service|services|medical|medicine|center|centre|centers|centres|hospital|hospitals|clinic|clinics|care|group|associates|association|network|partners|partnership|"
    "physicians|physician|practice|practices|regional|community|memorial|university|institute|foundation|laboratory|laboratories|labs|lab|diagnostics|imaging|radiology|pathology|family|urgent|primary|specialty|"
    "cardiology|oncology|orthopedic|orthopedics|pediatric|pediatrics|inc|llc|llp|ltd|plc|corp|corporation|co|pc|pa|pllc|of|and|the|for|at|in|on|a|an"
)


@query(
    f"""SELECT source_system, coalesce(w[1], nullif(replace(n, ' ', ''), '')) AS slug FROM (
      SELECT source_system, n, list_filter(string_split(n, ' '), lambda x: x <> '' AND NOT regexp_matches(x, '^({_GENERIC_WORDS_SQL}|[0-9]+)$')) AS w
      FROM (SELECT source_system, trim(regexp_replace(lower(replace(source_system, '_', ' ')), '[^a-z0-9]+', ' ', 'g')) AS n FROM source_systems))"""
)
def fn_organisation_slug(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "source_systems").select("source_system", text.organisation_slug(F.replace("source_system", F.lit("_"), F.lit(" "))).alias("slug"))


@query(r"SELECT obs_id, nullif(lower(regexp_extract(full_url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)', 1)), '') AS host FROM observations")
def fn_url_host(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "observations").select("obs_id", text.url_host(F.col("full_url")).alias("host"))


@query(
    """SELECT edge_id, NOT regexp_matches(object_uri, '[\x00-\x20<>"{}|^`\\\\]') AS legal, replace(replace(object_uri, ':', '%3A'), '/', '%2F') AS encoded FROM record_edges
    WHERE regexp_matches(object_uri, '^[A-Za-z0-9:/._~-]*$') OR object_uri IS NULL"""
)
def fn_iri_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Legality of object IRIs and their form as one part of another."""
    c = F.col("object_uri")
    e = read(spark, sf, "record_edges").where(c.rlike("^[A-Za-z0-9:/._~-]*$") | c.isNull())
    return e.select("edge_id", text.legal_iri(c).alias("legal"), text.percent_encoded(c).alias("encoded"))


@query(
    """SELECT DISTINCT p, CASE split_part(p, ':', 1) WHEN 'rdf' THEN 'http://www.w3.org/1999/02/22-rdf-syntax-ns#' || substr(p, 5) WHEN 'prov' THEN 'http://www.w3.org/ns/prov#' || substr(p, 6) WHEN 'foaf' THEN 'http://xmlns.com/foaf/0.1/' || substr(p, 6) END AS iri, p AS curie
    FROM (SELECT predicate AS p FROM record_edges UNION SELECT unnest(map_keys(properties)) FROM records) WHERE split_part(p, ':', 1) IN ('rdf', 'prov', 'foaf')"""
)
def fn_curies(spark: SparkSession, sf: str) -> DataFrame:
    """Predicates expanded and shortened again."""
    p = read(spark, sf, "record_edges").select(F.col("predicate").alias("p")).union(read(spark, sf, "records").select(F.explode(F.map_keys("properties")))).distinct()
    iri = text.expanded_iri(F.col("p"))
    return p.where(F.substring_index("p", ":", 1).isin("rdf", "prov", "foaf")).select("p", iri.alias("iri"), text.shortened_iri(iri).alias("curie"))


@query("SELECT source_system, CASE WHEN starts_with(source_identity, 'org:') THEN upper(substr(source_identity, 5, 1)) || substr(source_identity, 6) ELSE nullif(trim(source_system), '') END AS label FROM source_systems")
def fn_source_labels(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "source_systems").select("source_system", text.source_label(F.col("source_identity"), F.col("source_system")).alias("label"))


@query("SELECT med_id, CASE lower(trim(status)) WHEN 'active' THEN 'active' WHEN 'completed' THEN 'completed' WHEN 'stopped' THEN 'completed' WHEN 'inactive' THEN 'completed' WHEN 'discontinued' THEN 'completed' ELSE 'unknown' END AS status FROM medications")
def fn_medication_status(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "medications").select("med_id", codes.medication_status(F.col("status")).alias("status"))


@query(
    r"""SELECT obs_id, CASE WHEN regexp_matches(v, '^\d{4}-\d{2}-\d{2}$') THEN v || 'T00:00:00Z' WHEN regexp_matches(v, '^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?$') THEN v || 'Z' ELSE v END AS zoned,
    regexp_extract(v, '^[^T]*') AS day, regexp_matches(v, 'T\d{2}:\d{2}') AS has_time FROM (SELECT obs_id, effective_date_time AS v FROM observations WHERE effective_date_time IS NOT NULL)"""
)
def fn_iso_dates(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("effective_date_time")
    return (
        read(spark, sf, "observations").where(c.isNotNull())
        .select("obs_id", dates.with_zone(c).alias("zoned"), dates.date_only(c).alias("day"), dates.states_time_of_day(c).alias("has_time"))
    )


@query(
    r"""WITH v AS (SELECT med_id, trim(authored_on) AS c FROM medications WHERE authored_on IS NOT NULL), z AS (SELECT *, regexp_extract(c, '(Z|[+-]\d{2}:?\d{2})$', 1) AS zone FROM v),
    d AS (SELECT *, regexp_replace(substr(c, 1, length(c) - length(zone)), '\.\d+$', '') AS g FROM z)
    SELECT med_id, CASE WHEN regexp_matches(c, '^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})?)?$') THEN c WHEN regexp_matches(g, '^\d{8,}$') THEN
      g[1:4] || '-' || g[5:6] || '-' || g[7:8] || CASE WHEN length(g) IN (10, 12) OR length(g) >= 14 THEN 'T' || g[9:10] || ':' || CASE WHEN length(g) >= 12 THEN g[11:12] ELSE '00' END || ':' || CASE WHEN length(g) >= 14 THEN g[13:14] ELSE '00' END
        || CASE WHEN length(zone) = 5 THEN zone[1:3] || ':' || zone[4:5] ELSE zone END ELSE '' END END AS hl7 FROM d"""
)
def fn_hl7_dates(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("authored_on")
    return read(spark, sf, "medications").where(c.isNotNull()).select("med_id", dates.hl7_date(c).alias("hl7"))


@query(
    """SELECT patient_id, CASE WHEN b IS NULL THEN NULL WHEN y < 18 THEN 'pediatric' WHEN y < 40 THEN 'young_adult' WHEN y < 65 THEN 'adult' ELSE 'senior' END AS age_group
    FROM (SELECT patient_id, b, date_part('year', age(DATE '2025-01-01', b)) AS y FROM (SELECT patient_id, try_cast(birth_date AS DATE) AS b FROM patients))"""
)
def fn_age_group(spark: SparkSession, sf: str) -> DataFrame:
    birth = F.col("birth_date").try_cast("date")
    return read(spark, sf, "patients").select("patient_id", dates.age_group(birth, F.lit("2025-01-01").cast("date")).alias("age_group"))


_UUID_SQL = """substr(h,1,8) || '-' || substr(h,9,4) || '-5' || substr(h,14,3) || '-' || format('{:02x}', (('0x' || substr(h,17,2))::INT & 63) | 128) || substr(h,19,2) || '-' || substr(h,21,12)"""


@query(f"SELECT doc_id, {_UUID_SQL} AS uuid FROM (SELECT doc_id, sha1(text) AS h FROM documents WHERE text IS NOT NULL)")
def id_deterministic_uuid(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", identity.deterministic_uuid(F.col("text")).alias("uuid"))


@query(
    f"""SELECT patient_id, 'urn:uuid:' || {_UUID_SQL} AS uri FROM (SELECT patient_id, sha1('Patient' || coalesce('|born=' || birth_date, '') || coalesce('|family=' || family_name, '') || coalesce('|gender=' || gender, '')) AS h FROM patients)"""
)
def id_content_uri(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "patients").select("patient_id", identity.content_uri("Patient", family=F.col("family_name"), born=F.col("birth_date"), gender=F.col("gender")).alias("uri"))


@query()
def id_digest24(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "raw_bundles").select("bundle_id", identity.digest24(F.col("payload")).alias("digest"))


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def fn_json_props(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query("SELECT report_id, coalesce(array_to_string(list_sort(list_distinct(list_transform(list_filter(result_references, lambda x: x IS NOT NULL), lambda x: trim(x)))), '|'), '') AS key FROM reports WHERE result_references IS NOT NULL")
def fn_set_key(spark: SparkSession, sf: str) -> DataFrame:
    refs = F.filter("result_references", lambda x: x.isNotNull())
    return read(spark, sf, "reports").where("result_references IS NOT NULL").select("report_id", text.set_key(refs).alias("key"))


@query("SELECT mix.source AS source, CASE WHEN share >= 0.85 THEN 'accept' WHEN share >= 0.5 THEN 'review' ELSE 'discard' END AS route FROM (SELECT source, count(lang) / count(*)::DOUBLE AS share FROM documents GROUP BY source) mix")
def fn_confidence_route(spark: SparkSession, sf: str) -> DataFrame:
    """Sources by how sure their stated languages are (the part of their documents that states one)."""
    d = read(spark, sf, "documents").groupBy("source").agg((F.count("lang") / F.count("*")).alias("share"))
    return d.select("source", text.confidence_route(F.col("share")).alias("route"))


@query(
    "SELECT source_system, CASE WHEN starts_with(source_identity, 'org:') OR starts_with(source_identity, 'ns:') THEN true ELSE false END AS known_origin, substr(source_identity, strpos(source_identity, ':') + 1) AS label FROM source_systems"
)
def fn_source_identity(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("source_identity")
    return read(spark, sf, "source_systems").select(
        "source_system", F.coalesce(c.startswith("org:") | c.startswith("ns:"), F.lit(False)).alias("known_origin"), F.substring(c, F.instr(c, ":") + 1, F.lit(1 << 30)).alias("label")
    )
