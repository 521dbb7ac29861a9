"""Triples, edges and links over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.common import read
from recordloom.functions import identity, text
from recordloom.operators import graph, link, triples
from recordloom.plans.catalog import Catalog

CATALOG = Catalog()
query = CATALOG.query

_TRIPLES = """triples AS (
  SELECT DISTINCT s, p, v.value AS o, v.datatype AS datatype, coalesce(v.is_iri, false) AS is_iri FROM (
    SELECT s, e.key AS p, unnest(e.value) AS v FROM (SELECT uri AS s, unnest(map_entries(properties)) AS e FROM records WHERE uri IS NOT NULL)) WHERE v.value IS NOT NULL
  UNION SELECT uri, 'rdf:type', record_type, NULL, true FROM records WHERE uri IS NOT NULL AND record_type IS NOT NULL)"""
_LIVE = "live AS (SELECT DISTINCT uri FROM records WHERE uri IS NOT NULL AND tombstoned_at IS NULL)"
_EDGES = f"{_LIVE}, edges AS (SELECT DISTINCT subject_uri AS subject, predicate, object_uri AS object FROM record_edges WHERE predicate <> 'rdf:type' AND subject_uri IN (SELECT uri FROM live) AND object_uri IN (SELECT uri FROM live))"


def _triples(spark: SparkSession, sf: str) -> DataFrame:
    return triples.to_triples(read(spark, sf, "records"))


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.record_edges(read(spark, sf, "record_edges"), graph.live_records(read(spark, sf, "records")))


@query(f"WITH {_TRIPLES} SELECT * FROM triples")
def triple_scan(spark: SparkSession, sf: str) -> DataFrame:
    return _triples(spark, sf)


@query(f"WITH {_TRIPLES} SELECT o AS record_type, count(*) AS n_subjects FROM triples WHERE p = 'rdf:type' GROUP BY o")
def type_counts(spark: SparkSession, sf: str) -> DataFrame:
    return triples.match(_triples(spark, sf), p="rdf:type").groupBy(F.col("o").alias("record_type")).agg(F.count("*").alias("n_subjects"))


@query(f"WITH {_TRIPLES} SELECT s FROM triples WHERE p = 'rdf:type' AND o = 'clinical:LabResultRecord'")
def subjects_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return triples.match(_triples(spark, sf), p="rdf:type", o="clinical:LabResultRecord").select("s")


@query(
    f"""WITH {_TRIPLES} SELECT s, {", ".join(f"string_agg(DISTINCT o, ', ' ORDER BY o) FILTER (p = '{p}') AS {p.split(':')[-1]}" for p in ("rdf:type", "clinical:effectiveDate", "clinical:status", "clinical:note"))}
    FROM triples WHERE p IN ('rdf:type', 'clinical:effectiveDate', 'clinical:status', 'clinical:note') GROUP BY s"""
)
def record_projection(spark: SparkSession, sf: str) -> DataFrame:
    return triples.pivot(_triples(spark, sf), ["rdf:type", "clinical:effectiveDate", "clinical:status", "clinical:note"])


@query(
    """SELECT * FROM (SELECT 'urn:order:' || o_orderkey AS s, unnest(['status', 'priority', 'price', 'rdf:type']) AS p, unnest([o_orderstatus, o_orderpriority, NULL, 'Order']) AS o FROM orders) WHERE o IS NOT NULL"""
)
def table_to_triples(spark: SparkSession, sf: str) -> DataFrame:
    return triples.unpivot(read(spark, sf, "orders"), F.concat(F.lit("urn:order:"), F.col("o_orderkey")), {"o_orderstatus": "status", "o_orderpriority": "priority"}, "Order")


@query(f"WITH {_TRIPLES} SELECT p, count(DISTINCT o) AS n_values, count(*) AS n_triples, count(DISTINCT s) AS n_subjects FROM triples GROUP BY p")
def predicate_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return _triples(spark, sf).groupBy("p").agg(F.count_distinct("o").alias("n_values"), F.count("*").alias("n_triples"), F.count_distinct("s").alias("n_subjects"))


@query(f"WITH {_TRIPLES} SELECT regexp_extract(p, '^[^:]*') AS prefix, count(*) AS n_uses FROM triples GROUP BY ALL")
def vocabulary_detection(spark: SparkSession, sf: str) -> DataFrame:
    return _triples(spark, sf).groupBy(F.substring_index("p", ":", 1).alias("prefix")).agg(F.count("*").alias("n_uses"))


@query(f"WITH {_TRIPLES} SELECT s, p, min(o) AS o FROM triples WHERE p = 'clinical:effectiveDate' GROUP BY s, p UNION ALL SELECT s, p, o FROM triples WHERE p <> 'clinical:effectiveDate'")
def single_cardinality(spark: SparkSession, sf: str) -> DataFrame:
    return triples.collapse_single(_triples(spark, sf), ["clinical:effectiveDate"])


@query(f"WITH {_TRIPLES} SELECT s, coalesce(max(o) FILTER (p = 'clinical:note'), max(o) FILTER (p = 'clinical:sourceEHR'), s) AS label FROM triples GROUP BY s")
def record_labels(spark: SparkSession, sf: str) -> DataFrame:
    t = _triples(spark, sf)
    return t.groupBy("s").agg(F.coalesce(F.max(F.when(F.col("p") == "clinical:note", F.col("o"))), F.max(F.when(F.col("p") == "clinical:sourceEHR", F.col("o"))), F.col("s")).alias("label"))


@query(f"WITH {_EDGES} SELECT * FROM edges")
def record_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(spark, sf).orderBy("predicate", "subject", "object")


@query(
    f"""WITH {_LIVE}, e AS (SELECT predicate, subject_uri IN (SELECT uri FROM live) AND object_uri IN (SELECT uri FROM live) AS ok FROM record_edges)
    SELECT coalesce(predicate, '*') AS predicate, count(*) FILTER (ok) AS resolved, count(*) FILTER (NOT ok) AS unresolved, count(*) AS total FROM e GROUP BY ROLLUP (predicate)"""
)
def edge_resolution_stats(spark: SparkSession, sf: str) -> DataFrame:
    live = graph.live_records(read(spark, sf, "records"))
    e = read(spark, sf, "record_edges").join(live.select(F.col("uri").alias("subject_uri"), F.lit(True).alias("has_subject")), "subject_uri", "left").join(
        live.select(F.col("uri").alias("object_uri"), F.lit(True).alias("has_object")), "object_uri", "left"
    )
    resolved = e.withColumn("target", F.when(F.col("has_subject") & F.col("has_object"), F.col("object_uri")))
    return link.edge_stats(resolved, "predicate").withColumn("predicate", F.coalesce("predicate", F.lit("*")))


def _hops_sql(hops: int, only: str = "") -> str:
    both = f"""{_EDGES}, both_ways AS (SELECT subject AS f, predicate, 'out' AS direction, object AS t FROM edges {only} UNION ALL SELECT object, predicate, 'in', subject FROM edges {only}),
    h0 AS (SELECT DISTINCT uri AS seed, uri AS iri FROM records WHERE uri IS NOT NULL AND ord % 20 = 0)"""
    seen = "SELECT seed, iri FROM h0"
    for h in range(1, hops + 1):
        both += f""", h{h} AS (SELECT seed, iri, {h} AS hop, m.predicate AS predicate, m.direction AS direction FROM (
        SELECT x.seed, b.t AS iri, min({{'predicate': b.predicate, 'direction': b.direction, 'f': b.f}}) AS m FROM h{h - 1} x JOIN both_ways b ON b.f = x.iri
        WHERE NOT EXISTS (SELECT 1 FROM ({seen}) s WHERE s.seed = x.seed AND s.iri = b.t) GROUP BY ALL))"""
        seen += f" UNION ALL SELECT seed, iri FROM h{h}"
    return f"WITH {both} " + " UNION ALL ".join(f"SELECT * FROM h{h}" for h in range(1, hops + 1))


def _seeds(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "records").where((F.col("ord") % 20 == 0) & F.col("uri").isNotNull()).select("uri")


@query(_hops_sql(1))
def neighbors_1hop(spark: SparkSession, sf: str) -> DataFrame:
    return graph.neighbourhood(_edges(spark, sf), _seeds(spark, sf), 1)


@query(_hops_sql(3))
def neighbors_3hop(spark: SparkSession, sf: str) -> DataFrame:
    return graph.neighbourhood(_edges(spark, sf), _seeds(spark, sf), 3)


@query(_hops_sql(2, "WHERE predicate IN ('clinical:hasLabResult', 'clinical:hasEncounter')"))
def neighbors_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return graph.neighbourhood(_edges(spark, sf), _seeds(spark, sf), 2, ["clinical:hasLabResult", "clinical:hasEncounter"])


@query(
    f"""WITH RECURSIVE {_EDGES}, parents AS (SELECT DISTINCT subject AS child, object AS ancestor FROM edges WHERE predicate = 'prov:wasDerivedFrom'),
    up AS (SELECT * FROM parents UNION SELECT u.child, p.ancestor FROM up u JOIN parents p ON p.child = u.ancestor) SELECT * FROM up"""
)
def derivation_closure(spark: SparkSession, sf: str) -> DataFrame:
    e = triples.match(_edges(spark, sf).select(F.col("subject").alias("s"), F.col("predicate").alias("p"), F.col("object").alias("o")), p="prov:wasDerivedFrom")
    return graph.closure(e.select(F.col("s").alias("child"), F.col("o").alias("parent")))


_REDIRECT = """pairs AS (SELECT old, min(new) AS new FROM (SELECT d.uri AS old, canonical_uri AS new FROM (SELECT canonical_uri, unnest(discarded) AS d FROM merge_journal)) WHERE old <> new GROUP BY old),
chain AS (SELECT old, new, 1 AS n FROM pairs UNION ALL SELECT c.old, p.new, n + 1 FROM chain c JOIN pairs p ON p.old = c.new WHERE n < 32 AND p.new <> c.old),
canon AS (SELECT old, arg_max(new, n) AS canonical FROM chain GROUP BY old)"""


def _redirects(spark: SparkSession, sf: str) -> DataFrame:
    gone = read(spark, sf, "merge_journal").select("canonical_uri", F.explode("discarded").alias("d")).select(F.col("d.uri").alias("old"), F.col("canonical_uri").alias("new"))
    return graph.redirect_map(gone)


@query(f"WITH RECURSIVE {_REDIRECT} SELECT * FROM canon")
def redirect_map(spark: SparkSession, sf: str) -> DataFrame:
    return _redirects(spark, sf)


@query(
    f"""WITH RECURSIVE {_REDIRECT} SELECT edge_id, CASE WHEN canonical IS NOT NULL AND predicate <> 'prov:wasDerivedFrom' THEN canonical ELSE object_uri END AS object_uri,
    canonical IS NOT NULL AND predicate <> 'prov:wasDerivedFrom' AS changed FROM record_edges LEFT JOIN canon ON old = object_uri"""
)
def redirect_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.redirect_edges(read(spark, sf, "record_edges"), _redirects(spark, sf)).select("edge_id", "object_uri", "changed")


_REFS = r"""refs AS (SELECT report_id, source_system AS scope, r AS reference, nullif(regexp_extract(b, '(?:^|/)([A-Z][A-Za-z]+)/[^/]+$', 1), '') AS ref_type,
  CASE WHEN starts_with(b, 'urn:uuid:') THEN substr(b, 10) ELSE regexp_extract(b, '[^/]*$') END AS ref_id
  FROM (SELECT *, regexp_replace(r, '/_history(/.*)?$', '') AS b FROM (SELECT report_id, source_system, unnest(result_references) AS r FROM reports)) WHERE r IS NOT NULL),
targets AS (SELECT source_system AS scope, 'Observation' AS type, resource_id AS id, full_url AS target FROM observations
  UNION ALL SELECT source_system, 'Observation', CASE WHEN starts_with(full_url, 'urn:uuid:') THEN substr(full_url, 10) ELSE resource_id END, full_url FROM observations
  UNION ALL SELECT source_system, 'Patient', resource_id, full_url FROM patients),
typed AS (SELECT scope, type, id, min(target) AS target FROM targets GROUP BY ALL),
bare AS (SELECT scope, id, min(target) AS target FROM targets GROUP BY ALL HAVING min(target) = max(target)),
resolved AS (SELECT report_id, reference, r.ref_type, coalesce(t.target, b.target) AS target FROM refs r LEFT JOIN typed t ON t.scope = r.scope AND t.type = r.ref_type AND t.id = r.ref_id LEFT JOIN bare b ON b.scope = r.scope AND b.id = r.ref_id)"""


def _resolved(spark: SparkSession, sf: str) -> DataFrame:
    obs, pat = read(spark, sf, "observations"), read(spark, sf, "patients")
    r = read(spark, sf, "reports").select("report_id", F.col("source_system").alias("scope"), F.explode("result_references").alias("reference")).where(F.col("reference").isNotNull())
    refs = r.select("report_id", "scope", "reference", text.reference_type(F.col("reference")).alias("ref_type"), text.reference_id(F.col("reference")).alias("ref_id"))

    def target(df: DataFrame, kind: str, key: F.Column) -> DataFrame:
        return df.select(F.col("source_system").alias("scope"), F.lit(kind).alias("type"), key.alias("id"), F.col("full_url").alias("target"))

    by_url = F.when(F.col("full_url").startswith("urn:uuid:"), F.substring("full_url", 10, 1 << 30)).otherwise(F.col("resource_id"))
    targets = target(obs, "Observation", F.col("resource_id")).unionByName(target(obs, "Observation", by_url)).unionByName(target(pat, "Patient", F.col("resource_id")))
    return link.resolve_references(refs, targets).select("report_id", "reference", "ref_type", "target")


@query(f"WITH {_REFS} SELECT report_id, reference, ref_type, target FROM resolved")
def reference_resolution(spark: SparkSession, sf: str) -> DataFrame:
    return _resolved(spark, sf)


@query(f"WITH {_REFS} SELECT coalesce(t, '*') AS ref_type, count(target) AS resolved, count(*) FILTER (target IS NULL) AS unresolved, count(*) AS total FROM (SELECT coalesce(ref_type, 'untyped') AS t, target FROM resolved) GROUP BY ROLLUP (t)")
def reference_stats(spark: SparkSession, sf: str) -> DataFrame:
    r = _resolved(spark, sf).withColumn("ref_type", F.coalesce("ref_type", F.lit("untyped")))
    return link.edge_stats(r, "ref_type").withColumn("ref_type", F.coalesce("ref_type", F.lit("*")))


@query(
    """WITH k AS (SELECT patient_id, lower(trim(family_name)) || '|' || birth_date || '|' || source_system AS key FROM patients),
    sole AS (SELECT key, min(patient_id) AS candidate FROM k WHERE key IS NOT NULL GROUP BY key HAVING min(patient_id) = max(patient_id))
    SELECT patient_id, key, candidate FROM k JOIN sole USING (key)"""
)
def sole_candidate_link(spark: SparkSession, sf: str) -> DataFrame:
    k = read(spark, sf, "patients").select("patient_id", F.concat(F.lower(F.trim("family_name")), F.lit("|"), "birth_date", F.lit("|"), "source_system").alias("key"))
    return link.sole_candidates(k, k, "key", "patient_id").select("patient_id", "key", "candidate")


@query(
    """WITH spoken AS (SELECT DISTINCT subject_uri AS subject, object_uri AS id FROM record_edges WHERE predicate = 'clinical:linkedCondition'),
    targets AS (SELECT DISTINCT uri AS id, uri AS target FROM records WHERE record_type = 'clinical:ConditionRecord'),
    stated AS (SELECT DISTINCT subject_uri AS subject, object_uri AS target FROM record_edges WHERE predicate = 'clinical:indicationReference')
    SELECT DISTINCT s.subject, t.target FROM spoken s JOIN targets t ON lower(t.id) = lower(s.id) WHERE s.subject <> t.target AND NOT EXISTS (SELECT 1 FROM stated x WHERE x.subject = s.subject AND x.target = t.target)"""
)
def literal_lifting(spark: SparkSession, sf: str) -> DataFrame:
    e, rec = read(spark, sf, "record_edges"), read(spark, sf, "records")
    texts = e.where("predicate = 'clinical:linkedCondition'").select(F.col("subject_uri").alias("subject"), F.col("object_uri").alias("packed"))
    targets = rec.where("record_type = 'clinical:ConditionRecord'").select(F.lower("uri").alias("id"), F.col("uri").alias("target")).distinct()
    stated = e.where("predicate = 'clinical:indicationReference'").select(F.col("subject_uri").alias("subject"), F.col("object_uri").alias("target")).distinct()
    return link.lift_literals(texts, text.linked_ids(F.col("packed")), targets, stated)


_PRINT = """prints AS (SELECT ord, uri, sha256(coalesce(array_to_string(list_sort(list_distinct(flatten(list_transform(map_entries(properties), lambda e: list_transform(coalesce(e.value, []), lambda v: e.key || chr(0) || coalesce(v.value, '') || chr(0) || coalesce(v.datatype, '')))))), chr(1)), '')) AS fingerprint FROM records WHERE uri IS NOT NULL)"""


@query(f"WITH {_PRINT} SELECT ord, fingerprint FROM prints")
def content_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    r = read(spark, sf, "records").where("uri IS NOT NULL")
    return r.select("ord", identity.property_fingerprint(F.col("properties")).alias("fingerprint"))


@query(
    f"WITH {_PRINT}, g AS (SELECT uri, fingerprint, min(ord) AS first_ord, count(*) AS n_rows, dense_rank() OVER (PARTITION BY uri ORDER BY fingerprint) AS k FROM prints GROUP BY uri, fingerprint) "
    "SELECT uri, fingerprint, first_ord, n_rows, CASE WHEN k = 1 THEN uri ELSE 'identity-collision:' || uri || '::' || fingerprint END AS split_key FROM g"
)
def identity_collision_split(spark: SparkSession, sf: str) -> DataFrame:
    """Same IRI, different content: the smallest fingerprint keeps the IRI, the others get keys of their own."""
    r = read(spark, sf, "records").where("uri IS NOT NULL").select("ord", "uri", identity.property_fingerprint(F.col("properties")).alias("fingerprint"))
    g = r.groupBy("uri", "fingerprint").agg(F.min("ord").alias("first_ord"), F.count("*").alias("n_rows"))
    smallest = g.groupBy("uri").agg(F.min("fingerprint").alias("smallest"))
    key = F.when(F.col("fingerprint") == F.col("smallest"), F.col("uri")).otherwise(F.concat(F.lit("identity-collision:"), "uri", F.lit("::"), "fingerprint"))
    return g.join(smallest, "uri").select("uri", "fingerprint", "first_ord", "n_rows", key.alias("split_key"))


@query("SELECT sha256(text) AS fingerprint, count(*) AS n_documents, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def exact_duplicate_groups(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("fingerprint"))
    return d.groupBy("fingerprint").agg(F.count("*").alias("n_documents"), F.min("doc_id").alias("first_doc")).where("n_documents > 1")
