"""Records as a user sees them, shapes read from Turtle, merges with their journal, patches: over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.common import read
from recordloom.operators import advisory, genomics, link, matchers, merges, shapes
from recordloom.operators import records as R
from recordloom.plans.catalog import Catalog
from recordloom.plans.graphs import _TRIPLES, _triples
from recordloom.plans.matching import members

CATALOG = Catalog()
query = CATALOG.query

_MEMBER = "d AS (SELECT merge_id * 1000 + i - 1 AS ord, pod_id, d.uri AS uri, d.record_type AS t, d.source_system AS src, d.source_identity AS ident, d.last_updated AS at, d.properties AS p FROM (SELECT merge_id, pod_id, unnest(discarded) AS d, generate_subscripts(discarded, 1) AS i FROM merge_journal))"


def _journal(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "merge_journal").select("merge_id", F.posexplode("discarded").alias("place", "d")).where(F.col("d").isNotNull())
    return d.select("merge_id", (F.col("merge_id") * 1000 + F.col("place")).alias("ord"), "d.*")


@query(f"WITH {_MEMBER} SELECT ord, coalesce(nullif(p['health:conditionName'][1].value, ''), nullif(p['health:testName'][1].value, ''), nullif(p['foaf:givenName'][1].value, '')) AS label FROM d")
def member_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Names of the journaled records by the first property that names them."""
    return _journal(spark, sf).select("ord", R.label(F.col("properties")).alias("label"))


@query(
    f"""WITH {_MEMBER}, e AS (SELECT ord, unnest(map_entries(p)) AS e FROM d WHERE t = 'clinical:ConditionRecord' AND p IS NOT NULL),
    v AS (SELECT ord, e.key AS k, array_to_string(list_sort(list_transform(list_filter(e.value, lambda x: x.value IS NOT NULL), lambda x: x.value)), ', ') AS value, row_number() OVER (PARTITION BY ord ORDER BY e.key) AS nth FROM e)
    SELECT ord, k AS property, value FROM v WHERE nth <= 5"""
)
def key_properties(spark: SparkSession, sf: str) -> DataFrame:
    """What is shown of the journaled conditions: none has a property of the list, so the first few."""
    d = _journal(spark, sf).where("record_type = 'clinical:ConditionRecord'")
    return d.select("ord", F.explode(R.key_properties("conditions", R.flat(F.col("properties")))).alias("property", "value"))


@query("SELECT source_system, CASE WHEN split_part(file_name, '/', 1) = 'analysis' OR starts_with(regexp_extract(file_name, '[^/]*$'), 'ai-extraction') THEN 'ai-extracted' ELSE 'other' END AS bucket, count(*) AS n FROM import_reports GROUP BY ALL")
def bucket_classes(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "import_reports").groupBy("source_system", R.bucket_class(F.col("file_name")).alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT uri, record_type FROM records WHERE record_type IN ('clinical:LabResultRecord', 'clinical:ConditionRecord')")
def records_of_types(spark: SparkSession, sf: str) -> DataFrame:
    """Records of the kinds asked for."""
    flags = {"lab-results": "clinical:LabResultRecord", "conditions": "clinical:ConditionRecord", "medications": "clinical:MedicationRecord"}
    return R.of_types(R.without_bookkeeping(read(spark, sf, "records")), flags, ["lab-results", "conditions"]).select("uri", "record_type")


@query(
    f"""WITH {_TRIPLES}, b AS (SELECT split_part(s, '/', 3) AS bucket, * FROM triples), per AS (SELECT bucket, s, bool_or(p = 'rdf:type' AND o IN ('clinical:LabResultRecord', 'clinical:ConditionRecord')) AS k, bool_or(p = 'rdf:type') AS t, count(*) AS n FROM b GROUP BY ALL)
    SELECT bucket, coalesce(nullif(count(*) FILTER (k), 0), count(*) FILTER (t)) AS n_records, sum(n)::BIGINT AS n_triples, NULL::VARCHAR AS provenances FROM per GROUP BY bucket"""
)
def store_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Records and triples by host, with the fallback to all typed subjects."""
    t = _triples(spark, sf).withColumn("bucket", F.coalesce(F.get(F.split("s", "/"), F.lit(2)), F.lit("")))
    return R.statistics(t, ["clinical:LabResultRecord", "clinical:ConditionRecord"])


@query(f"WITH {_TRIPLES} SELECT s, p, o, min(datatype) AS datatype, min(is_iri) AS is_iri FROM triples GROUP BY s, p, o")
def triples_by_value(spark: SparkSession, sf: str) -> DataFrame:
    return R.distinct_by_value(_triples(spark, sf))


@query(
    """WITH a AS (SELECT DISTINCT subject_uri AS s, predicate AS p, object_uri AS o FROM record_edges WHERE edge_id % 3 <> 0), b AS (SELECT DISTINCT subject_uri AS s, predicate AS p, object_uri AS o FROM record_edges WHERE edge_id % 3 <> 1) SELECT * FROM a UNION SELECT * FROM b"""
)
def union_of_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Two overlapping deliveries of edges as one set."""
    e = read(spark, sf, "record_edges").select("edge_id", F.col("subject_uri").alias("s"), F.col("predicate").alias("p"), F.col("object_uri").alias("o"))
    return R.union_distinct(e.where("edge_id % 3 <> 0").drop("edge_id"), e.where("edge_id % 3 <> 1").drop("edge_id"))


@query("SELECT subject_uri AS s, predicate AS p, min({'ord': edge_id, 'o': object_uri}).o AS o, count(*) AS n_stated FROM record_edges WHERE object_uri IS NOT NULL GROUP BY subject_uri, predicate, regexp_replace(object_uri, '/_history(/.*)?$', '')")
def equivalent_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of which none says what another does, versions of an object taken as one."""
    e = read(spark, sf, "record_edges").where(F.col("object_uri").isNotNull()).select(F.col("edge_id").alias("ord"), F.col("subject_uri").alias("s"), F.col("predicate").alias("p"), F.col("object_uri").alias("o"))
    same = e.withColumn("target", F.regexp_replace("o", r"/_history(/.*)?$", ""))
    return R.equivalent_edges(same)


@query(
    f"""WITH {_TRIPLES} SELECT s, '{{"@context":"https://schema.example/context.jsonld","@id":' || to_json(s) || ',' || string_agg(CASE WHEN p = 'rdf:type' THEN '"@type":' || to_json(o) WHEN is_iri THEN to_json(p) || ':{{"@id":' || to_json(o) || '}}'
      WHEN datatype IN ('xsd:date', 'xsd:dateTime') THEN to_json(p) || ':{{"@value":' || to_json(o) || ',"@type":"' || datatype || '"}}' ELSE to_json(p) || ':' || to_json(o) END, ',' ORDER BY p) || '}}' AS json
    FROM (SELECT s, p, arg_max(o, o) AS o, arg_max(datatype, o) AS datatype, arg_max(is_iri, o) AS is_iri FROM triples WHERE p <> 'clinical:note' GROUP BY s, p) GROUP BY s"""
)
def json_ld_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Records as JSON-LD, without their notes; of several values the last in order."""
    t = _triples(spark, sf).where("p <> 'clinical:note'").select("s", "p", "o", F.when(F.col("is_iri"), "iri").otherwise("literal").alias("o_kind"), "datatype", F.col("o").alias("ord"))
    return R.json_ld(t)


@query(
    f"""WITH {_MEMBER}, l AS (SELECT ord, uri, ident, p['health:testCode'][1].value AS code, p['health:performedDate'][1].value AS performed, p FROM d WHERE t = 'clinical:LabResultRecord' AND (starts_with(ident, 'org:') OR starts_with(ident, 'ns:')))
    SELECT count(*) AS n_members, count(DISTINCT code) AS n_codes, count(*) FILTER (regexp_matches(performed, 'T\\d{{2}}:\\d{{2}}')) AS n_timed FROM l"""
)
def tier0_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Journaled lab results of known origin, and those that state a time of day, which tier-0 merges ask for."""
    m = members(spark, sf).where("record_type = 'health:LabResultRecord'")
    from recordloom.functions import dates, text

    v = lambda p: matchers.value(F.col("properties"), p)
    return m.where(text.is_known_origin(F.col("source_identity"))).agg(F.count("*").alias("n_members"), F.count_distinct(v("health:testCode")).alias("n_codes"), F.count_if(dates.states_time_of_day(v("health:performedDate"))).alias("n_timed"))


@query(
    """WITH live AS (SELECT DISTINCT uri FROM records WHERE uri IS NOT NULL AND tombstoned_at IS NULL),
    j AS (SELECT merge_id, d.uri AS uri, d.record_type AS t FROM (SELECT merge_id, unnest(discarded) AS d FROM merge_journal)),
    w AS (SELECT merge_id, CASE WHEN uri IN (SELECT uri FROM live) THEN 'live record' WHEN t IS NULL THEN 'no type' WHEN t NOT IN ('clinical:LabResultRecord', 'clinical:ConditionRecord', 'clinical:MedicationRecord') THEN 'no bucket' WHEN t = 'clinical:MedicationRecord' THEN 'bucket gone' END AS why, uri FROM j)
    SELECT merge_id, CASE WHEN reason IS NULL THEN 'restorable' ELSE 'blocked' END AS status, reason FROM (SELECT merge_id, min({'uri': uri, 'why': why}) FILTER (why IS NOT NULL) .why AS reason FROM w GROUP BY merge_id)"""
)
def undo_states(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each journaled merge could be undone, in a store that has lost one bucket and never had another."""
    live = read(spark, sf, "records").where("uri IS NOT NULL AND tombstoned_at IS NULL").select("uri")
    buckets = spark.createDataFrame([("clinical:LabResultRecord", True), ("clinical:ConditionRecord", True), ("clinical:MedicationRecord", False)], "record_type string, is_there boolean")
    return merges.undo_states(_journal(spark, sf).select("merge_id", "uri", "record_type"), live, buckets, live.limit(0))


@query(
    """WITH one AS (SELECT uri, min(canonical_uri) AS canonical_uri FROM (SELECT canonical_uri, d.uri AS uri FROM (SELECT canonical_uri, unnest(discarded) AS d FROM merge_journal)) WHERE uri <> canonical_uri GROUP BY uri),
    live AS (SELECT DISTINCT d.uri AS uri, d.record_type AS record_type FROM (SELECT unnest(discarded) AS d FROM merge_journal))
    SELECT record_type, count(*) FILTER (uri NOT IN (SELECT uri FROM one)) AS n_left, count(*) FILTER (uri IN (SELECT uri FROM one)) AS n_journaled, count(*) AS n_after_undo FROM live GROUP BY record_type"""
)
def merge_and_undo(spark: SparkSession, sf: str) -> DataFrame:
    """The journaled merges applied to the records as they stood before, and all undone again."""
    j = _journal(spark, sf)
    live = j.select("uri", "record_type").distinct()
    pairs = read(spark, sf, "merge_journal").select("canonical_uri", F.explode("discarded").alias("d")).select("canonical_uri", F.col("d.uri").alias("uri"))
    left, gone = merges.apply(live, pairs)
    states = gone.select(F.xxhash64("canonical_uri").alias("merge_id"), F.lit("restorable").alias("status")).distinct()
    back = merges.undo(left, gone.withColumn("merge_id", F.xxhash64("canonical_uri")), states)
    n = lambda df, name: df.groupBy("record_type").agg(F.count("*").alias(name))
    j = n(back, "n_after_undo").join(n(left, "n_left"), "record_type", "left").join(n(gone, "n_journaled"), "record_type", "left")
    return j.select("record_type", F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_journaled", F.lit(0)).alias("n_journaled"), "n_after_undo")


@query(
    f"""WITH {_MEMBER}, c AS (SELECT uri AS target, trim(regexp_replace(lower(min(p['health:conditionName'][1].value)), '[^a-z0-9]+', ' ', 'g')) AS name FROM d WHERE t = 'clinical:ConditionRecord' AND p['health:conditionName'][1].value IS NOT NULL GROUP BY uri),
    k AS (SELECT name, count(*) AS n, min(target) AS target FROM c WHERE name <> '' GROUP BY name), a AS (SELECT obs_id, trim(regexp_replace(lower(code_text), '[^a-z0-9]+', ' ', 'g')) AS name FROM observations WHERE code_text IS NOT NULL)
    SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN n IS NULL THEN 'unmatched' WHEN n > 1 THEN 'ambiguous' ELSE 'lifted' END AS outcome FROM a LEFT JOIN k USING (name)) GROUP BY outcome"""
)
def lift_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """What becomes of the observations' texts as names of journaled conditions."""
    d = _journal(spark, sf).where("record_type = 'clinical:ConditionRecord'")
    names = d.select("uri", matchers.value(F.col("properties"), "health:conditionName").alias("name")).where("name IS NOT NULL").groupBy(F.col("uri").alias("target")).agg(F.min("name").alias("name"))
    none = F.array().cast("array<string>")
    asked = read(spark, sf, "observations").where("code_text IS NOT NULL").select(F.concat(F.lit("o"), "obs_id").alias("subject"), F.col("obs_id").alias("ref"), none.alias("codes"), F.col("code_text").alias("text"))
    return link.lift_stats(link.lift_indications(asked, names.select("target", none.alias("codes"), "name"), spark.createDataFrame([], "subject string, target string")))


#: Shapes of the given records, as a shapes document states them.
SHAPES = """
@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . @prefix clinical: <clinical:> . @prefix core: <core:> . @prefix shape: <shape:> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
clinical:LabResultRecord rdfs:subClassOf clinical:Record . clinical:ConditionRecord rdfs:subClassOf clinical:Record .
shape:Record a sh:NodeShape ; sh:targetClass clinical:Record ;
  sh:property [ sh:path clinical:status ; sh:minCount 1 ; sh:severity sh:Warning ; sh:in ( "active" "final" "resolved" ) ] ;
  sh:property [ sh:path clinical:effectiveDate ; sh:minCount 1 ; sh:maxCount 1 ; sh:or ( [ sh:datatype xsd:date ] [ sh:datatype xsd:dateTime ] ) ; sh:minInclusive "2021-06-01" ] ;
  sh:property [ sh:path clinical:note ; sh:maxLength 90 ; sh:pattern "^[A-Z]" ; sh:severity sh:Info ] .
shape:Claim a sh:NodeShape ; sh:targetSubjectsOf clinical:sourceEHR ;
  sh:xone ( [ sh:property [ sh:path clinical:note ; sh:minCount 1 ] ] [ sh:property [ sh:path clinical:status ; sh:minCount 1 ] ] ) .
"""
_SUBJECTS = "x AS (SELECT ord::VARCHAR AS s, record_type AS t, properties AS p FROM records WHERE record_type IS NOT NULL)"
_SHAPES_SQL = f"""{_SUBJECTS}, r AS (SELECT s, p FROM x WHERE t IN ('clinical:LabResultRecord', 'clinical:ConditionRecord')), a AS (
  SELECT s, 'shape:Record' AS shape, 'clinical:status' AS path, 'minCount' AS c, 'warning' AS severity, NULL AS value FROM r WHERE coalesce(len(p['clinical:status']), 0) < 1
  UNION ALL SELECT s, 'shape:Record', 'clinical:status', 'in', 'warning', list_filter(p['clinical:status'], lambda v: v.value NOT IN ('active', 'final', 'resolved'))[1].value FROM r WHERE len(list_filter(p['clinical:status'], lambda v: v.value NOT IN ('active', 'final', 'resolved'))) > 0
  UNION ALL SELECT s, 'shape:Record', 'clinical:effectiveDate', 'minCount', 'violation', NULL FROM r WHERE coalesce(len(p['clinical:effectiveDate']), 0) < 1
  UNION ALL SELECT s, 'shape:Record', 'clinical:effectiveDate', 'maxCount', 'violation', NULL FROM r WHERE len(p['clinical:effectiveDate']) > 1
  UNION ALL SELECT s, 'shape:Record', 'clinical:effectiveDate', 'or', 'violation', list_filter(p['clinical:effectiveDate'], lambda v: coalesce(v.datatype, '') NOT IN ('xsd:date', 'xsd:dateTime'))[1].value FROM r WHERE len(list_filter(p['clinical:effectiveDate'], lambda v: coalesce(v.datatype, '') NOT IN ('xsd:date', 'xsd:dateTime'))) > 0
  UNION ALL SELECT s, 'shape:Record', 'clinical:effectiveDate', 'minInclusive', 'violation', list_filter(p['clinical:effectiveDate'], lambda v: v.value < '2021-06-01')[1].value FROM r WHERE len(list_filter(p['clinical:effectiveDate'], lambda v: v.value < '2021-06-01')) > 0
  UNION ALL SELECT s, 'shape:Record', 'clinical:note', 'maxLength', 'info', list_filter(p['clinical:note'], lambda v: length(v.value) > 90)[1].value FROM r WHERE len(list_filter(p['clinical:note'], lambda v: length(v.value) > 90)) > 0
  UNION ALL SELECT s, 'shape:Record', 'clinical:note', 'pattern', 'info', list_filter(p['clinical:note'], lambda v: NOT regexp_matches(v.value, '^[A-Z]'))[1].value FROM r WHERE len(list_filter(p['clinical:note'], lambda v: NOT regexp_matches(v.value, '^[A-Z]'))) > 0
  UNION ALL SELECT s, 'shape:Claim', '', 'xone', 'violation', NULL FROM x WHERE len(p['clinical:sourceEHR']) > 0 AND (coalesce(len(p['clinical:note']), 0) > 0) = (coalesce(len(p['clinical:status']), 0) > 0))"""


def _subjects(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "records").where("record_type IS NOT NULL").select(F.col("ord").cast("string").alias("s"), F.array("record_type").alias("types"), F.col("properties").alias("props"))


@query(f'WITH {_SHAPES_SQL} SELECT s AS focus, shape, path, c AS "constraint", severity, value FROM a')
def shapes_on_records(spark: SparkSession, sf: str) -> DataFrame:
    """What the records break of shapes read from Turtle."""
    return shapes.violations(_subjects(spark, sf), shapes.Shapes(SHAPES)).drop("message")


@query(f"WITH {_SHAPES_SQL}, f AS (SELECT DISTINCT s FROM a WHERE severity = 'violation') SELECT s NOT IN (SELECT s FROM f) AS passed, count(*) AS n FROM x GROUP BY ALL")
def shapes_pass_fail(spark: SparkSession, sf: str) -> DataFrame:
    """Records that pass: warnings do not fail one."""
    x = _subjects(spark, sf)
    return shapes.conforms(shapes.violations(x, shapes.Shapes(SHAPES)), x).groupBy("passed").agg(F.count("*").alias("n"))


@query(f"WITH {_SHAPES_SQL}, f AS (SELECT DISTINCT s FROM a WHERE severity = 'violation') SELECT t AS record_type, count(*) AS n, count(*) FILTER (s NOT IN (SELECT s FROM f)) AS n_passed, count(*) FILTER (s IN (SELECT s FROM f)) AS n_failed FROM x GROUP BY t")
def conformance_by_type(spark: SparkSession, sf: str) -> DataFrame:
    """Records of each type that conform to the shapes."""
    x = _subjects(spark, sf)
    c = shapes.conforms(shapes.violations(x, shapes.Shapes(SHAPES)), x).join(x.select("s", F.get("types", F.lit(0)).alias("record_type")), "s")
    return c.groupBy("record_type").agg(F.count("*").alias("n"), F.count_if("passed").alias("n_passed"), F.count_if(~F.col("passed")).alias("n_failed"))


@query(f"WITH {_SUBJECTS} SELECT t AS type, count(DISTINCT s) AS n_subjects FROM x WHERE t NOT IN ('clinical:LabResultRecord', 'clinical:ConditionRecord', 'clinical:Record') GROUP BY t")
def shapes_uncovered(spark: SparkSession, sf: str) -> DataFrame:
    return shapes.uncovered_types(_subjects(spark, sf), shapes.Shapes(SHAPES))


@query(f"WITH {_TRIPLES} SELECT 'adv-1' AS advisory, s FROM triples WHERE p = 'clinical:status' AND o = 'active' AND datatype IS NULL UNION SELECT 'adv-2', s FROM triples WHERE p = 'rdf:type' AND o = 'coverage:ClaimRecord' UNION SELECT 'adv-3', NULL")
def advisory_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Records that three advisories bind, one of them none."""
    ads = spark.createDataFrame([("adv-1", "clinical:status", "active", None, None), ("adv-2", "rdf:type", "coverage:ClaimRecord", None, None), ("adv-3", None, None, None, None)], "advisory string, p string, o string, datatype string, lang string")
    return advisory.select(_triples(spark, sf).withColumn("lang", F.lit(None).cast("string")), ads)


@query("SELECT canonical_uri, min(d.last_updated)::DATE::VARCHAR AS earliest FROM (SELECT canonical_uri, unnest(discarded) AS d FROM merge_journal) WHERE canonical_uri IS NOT NULL GROUP BY canonical_uri")
def earliest_of_members(spark: SparkSession, sf: str) -> DataFrame:
    j = read(spark, sf, "merge_journal").where("canonical_uri IS NOT NULL").select("canonical_uri", F.explode("discarded").alias("d"))
    return merges.earliest(j, "canonical_uri", F.col("d.last_updated").cast("date")).withColumn("earliest", F.col("earliest").cast("string"))


@query(
    """WITH m AS (SELECT pod_id AS family, patient_id AS id, gender AS sex FROM patients), a AS (SELECT family, min(id) AS p FROM m GROUP BY family), b AS (SELECT m.family, min(id) AS fa FROM m JOIN a USING (family) WHERE id > p GROUP BY m.family),
    c AS (SELECT m.family, min(id) AS mo FROM m JOIN b USING (family) WHERE id > fa GROUP BY m.family)
    SELECT m.family, id::VARCHAR AS member, CASE WHEN id = p THEN 'Proband' WHEN id = fa THEN 'FTH' WHEN id = mo THEN 'MTH' WHEN id % 2 = 0 THEN CASE sex WHEN 'male' THEN 'SON' WHEN 'female' THEN 'DAU' END ELSE CASE sex WHEN 'male' THEN 'BRO' WHEN 'female' THEN 'SIS' END END AS role
    FROM m JOIN a USING (family) LEFT JOIN b USING (family) LEFT JOIN c USING (family)"""
)
def pedigree_roles(spark: SparkSession, sf: str) -> DataFrame:
    """Roles in families laid over the pods: the first three people are proband, father and mother, of the others every second a child, the rest siblings."""
    m = read(spark, sf, "patients").select(F.col("pod_id").alias("family"), F.col("patient_id").alias("id"), "gender")
    lead = m.groupBy("family").agg(F.min("id").alias("p"))
    for old, new in (("p", "fa"), ("fa", "mo")):
        following = m.join(lead.select("family", old), "family").where(F.col("id") > F.col(old)).groupBy("family").agg(F.min("id").alias(new))
        lead = lead.join(following, "family", "left")
    i, as_text = F.col("id"), lambda c: F.col(c).cast("string")
    parent = i.isin(F.col("fa"), F.col("mo"))
    j = m.join(lead, "family").select(
        "family", as_text("id").alias("member"), F.when((i == F.col("p")) | (~F.coalesce(parent, F.lit(False)) & (i % 2 == 1)), as_text("fa")).when(~F.coalesce(parent, F.lit(False)), as_text("p")).alias("father"),
        F.when(i == F.col("p"), as_text("mo")).alias("mother"), F.when(F.col("gender") == "male", "MALE").when(F.col("gender") == "female", "FEMALE").otherwise("").alias("sex"), (i == F.col("p")).alias("is_proband"),
    )
    return genomics.pedigree_roles(j)
