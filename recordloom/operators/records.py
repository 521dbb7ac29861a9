"""What a user sees of records: types, labels, key properties, buckets, statistics; and how stores keep them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions import text

# Types that only structure a store, and those that keep book about its records.
STRUCTURAL = (
    "http://www.w3.org/ns/solid/terms#TypeRegistration", "http://www.w3.org/ns/solid/terms#TypeIndex", "http://www.w3.org/ns/solid/terms#ListedDocument",
    "http://www.w3.org/ns/solid/terms#UnlistedDocument", "http://www.w3.org/ns/ldp#BasicContainer",
)
BOOKKEEPING = (
    "core:PendingConflict", "core:UserResolution", "http://www.w3.org/ns/solid/terms#TypeIndex", "http://www.w3.org/ns/solid/terms#TypeRegistration",
    "http://www.w3.org/ns/pim/space#ConfigurationFile",
)
# The first of these properties that a record has is its label.
LABELS = (
    "health:medicationName", "health:conditionName", "health:allergen", "clinical:supplementName", "clinical:vaccineName", "health:vaccineName", "health:testName",
    "health:labTestName", "clinical:planName", "core:planName", "foaf:name", "foaf:givenName", "dcterms:title",
)
# Properties to show by kind of record, and always.
KEY_PROPERTIES = {
    "medications": ["health:dose", "health:frequency", "health:route", "health:isActive", "health:startDate", "health:prescriber", "health:rxNormCode", "health:medicationClass"],
    "conditions": ["health:status", "health:onsetDate", "health:icd10Code", "health:snomedCode", "health:conditionClass"],
    "allergies": ["health:allergyCategory", "health:reaction", "health:allergySeverity", "health:onsetDate"],
    "lab-results": ["health:value", "health:unit", "health:referenceRange", "health:interpretation", "health:effectiveDate"],
    "immunizations": ["health:vaccineDate", "health:lotNumber", "health:site", "health:manufacturer"],
    "supplements": ["clinical:dose", "clinical:frequency", "clinical:form", "clinical:isActive", "clinical:evidenceStrength"],
}
COMMON_PROPERTIES = ("core:dataProvenance", "core:schemaVersion")
#: Properties shown of a record that has none of those.
SHOWN = 5
# Data of devices, by what states it.
DEVICE_SOURCES = ("healthKit", "bluetoothDevice")


def is_structural(t: Column) -> Column:
    """Whether a type only structures the store or tells of provenance."""
    return t.startswith("http://www.w3.org/ns/prov#") | t.startswith("prov:") | t.isin(*STRUCTURAL)


def meaningful_type(types: Column) -> Column:
    """The first type in order that is not structural, else the first."""
    ordered = F.array_sort(types)
    return F.coalesce(F.get(F.filter(ordered, lambda t: ~is_structural(t)), F.lit(0)), F.get(ordered, F.lit(0)))


def without_bookkeeping(records: DataFrame, record_type: str = "record_type", include: bool = False) -> DataFrame:
    """Records a person means: not the store's own about them, unless asked for."""
    t = F.col(record_type)
    return records.where(~is_structural(t)) if include else records.where(~is_structural(t) & ~t.isin(*BOOKKEEPING))


def of_types(records: DataFrame, flags: dict[str, str], wanted: list[str] | None, record_type: str = "record_type") -> DataFrame:
    """Records of the named kinds (``None``: all, also of types without a flag); an unknown flag is an error."""
    if wanted is None:
        return records
    if unknown := sorted(set(wanted) - set(flags)):
        raise ValueError(f"unknown record types: {', '.join(unknown)}")
    return records.where(F.col(record_type).isin(*[flags[w] for w in wanted]))


def _first(properties: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.nullif(F.get(F.element_at(properties, F.lit(n)), F.lit(0))["value"], F.lit("")) for n in names])


def label(properties: Column) -> Column:
    """Name of a record, null if it states none."""
    return _first(properties, LABELS)


def flat(properties: Column) -> Column:
    """Map of predicate to its values joined by commas, in order of value."""
    return F.transform_values(properties, lambda _, v: F.array_join(F.array_sort(F.transform(F.filter(v, lambda x: x["value"].isNotNull()), lambda x: x["value"])), ", "))


def key_properties(kind: str, flat_properties: Column) -> Column:
    """The properties to show of a record of this kind; of one that has none of them the first few by name."""
    wanted = [*KEY_PROPERTIES.get(kind, []), *COMMON_PROPERTIES]
    chosen = F.map_filter(flat_properties, lambda k, v: k.isin(*wanted) & (v != ""))
    some = F.map_from_entries(F.slice(F.array_sort(F.map_entries(flat_properties)), 1, SHOWN))
    return F.when(F.size(chosen) > 0, chosen).otherwise(some)


def bucket_class(path: Column) -> Column:
    """ai-extracted or other, of a file outside the known buckets."""
    name = F.substring_index(path, "/", -1)
    return F.when((F.substring_index(path, "/", 1) == "analysis") | name.startswith("ai-extraction"), "ai-extracted").otherwise("other")


def statistics(triples: DataFrame, registered: list[str]) -> DataFrame:
    """(bucket, n_records, n_triples, provenances): records of registered types, or all typed subjects where there are none.

    `triples`: ``bucket``, ``s``, ``p``, ``o``.  A bucket that states no provenance but data of devices is DeviceGenerated.
    """
    p, o = F.col("p"), F.col("o")
    per_subject = triples.groupBy("bucket", "s").agg(
        F.bool_or((p == "rdf:type") & o.isin(*registered)).alias("known"), F.bool_or(p == "rdf:type").alias("typed"), F.count("*").alias("n"),
        F.bool_or(((p == "core:sourceType") & o.isin(*DEVICE_SOURCES)) | (p == "prov:wasGeneratedBy")).alias("device"), F.collect_set(F.when(p == "core:dataProvenance", o)).alias("said"),
    )
    g = per_subject.groupBy("bucket").agg(
        F.count_if("known").alias("k"), F.count_if("typed").alias("t"), F.sum("n").alias("n_triples"), F.bool_or("device").alias("device"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("said")))).alias("said"),
    )
    provenance = F.when(F.size("said") > 0, F.array_join("said", ", ")).when(F.col("device"), "DeviceGenerated")
    return g.select("bucket", F.coalesce(F.nullif("k", F.lit(0)), "t").alias("n_records"), "n_triples", provenance.alias("provenances"))


def union_distinct(*parts: DataFrame) -> DataFrame:
    """Union of triples without repeats; the object counts with datatype and language, blank nodes by their file."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def distinct_by_value(triples: DataFrame) -> DataFrame:
    """Triples without repeats of subject, predicate and object value, whatever the datatype (the smallest is kept)."""
    rest = [c for c in triples.columns if c not in ("s", "p", "o")]
    return triples.groupBy("s", "p", "o").agg(*[F.min(c).alias(c) for c in rest])


def renumbered_blanks(triples: DataFrame) -> DataFrame:
    """Blank nodes named b0, b1, ... by their first appearance in each file (``file``, ``ord``, ``s``, ``o``, kinds)."""
    seen = triples.where("s_kind = 'bnode'").select("file", "ord", F.col("s").alias("b")).unionByName(triples.where("o_kind = 'bnode'").select("file", F.col("ord"), F.col("o").alias("b")))
    first = seen.groupBy("file", "b").agg(F.min("ord").alias("at"))
    # A file's blank nodes are numbered by counting those before, within the file.
    listed = first.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("at", "b"))).alias("bs")).select("file", F.posexplode("bs").alias("n", "x")).select("file", F.col("x.b").alias("b"), F.concat(F.lit("_:b"), "n").alias("name"))
    s, o = listed.toDF("file", "s", "s_name"), listed.toDF("file", "o", "o_name")
    j = triples.join(s, ["file", "s"], "left").join(o, ["file", "o"], "left")
    return j.select(*[F.coalesce("s_name", "s").alias("s") if c == "s" else F.coalesce("o_name", "o").alias("o") if c == "o" else F.col(c) for c in triples.columns])


def legal_triples(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(legal, illegal) triples by whether their IRIs can be written."""
    ok = text.legal_iri(F.col("s")) & text.legal_iri(F.col("p")) & (text.legal_iri(F.col("o")) | (F.col("o_kind") == "literal"))
    return triples.where(ok), triples.where(~F.coalesce(ok, F.lit(False)))


def register(existing: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """`existing` registrations and those of `wanted` that are not there yet; doing it twice changes nothing."""
    return existing.unionByName(wanted.dropDuplicates(key).join(existing.select(*key).distinct(), key, "left_anti"))


def equivalent_edges(edges: DataFrame) -> DataFrame:
    """Edges of which none states what another does: per (subject, predicate, ``target``) a stated IRI goes before a placeholder.

    `edges`: ``s``, ``p``, ``o``, ``target`` (what a placeholder resolves to; else null), ``ord``.
    """
    placeholder = F.col("target").isNotNull()
    best = edges.groupBy("s", "p", F.coalesce("target", "o").alias("to")).agg(F.min(F.struct(placeholder.alias("ph"), "ord", "o")).alias("b"), F.count("*").alias("n_stated"))
    return best.select("s", "p", F.col("b.o").alias("o"), "n_stated")


def json_ld(triples: DataFrame, context: str = "https://schema.example/context.jsonld") -> DataFrame:
    """(s, json): one JSON-LD object a subject; of several values of a key the last stated counts.

    `triples`: ``s``, ``p``, ``o``, ``o_kind``, ``datatype``, ``ord``; predicates shortened.
    """
    last = triples.groupBy("s", "p").agg(F.max_by(F.struct("o", "o_kind", "datatype"), "ord").alias("v"))
    o, kind = F.col("v.o"), F.regexp_replace(F.col("v.datatype"), "^http://www.w3.org/2001/XMLSchema#", "xsd:")
    quoted = lambda c: F.substring(F.to_json(F.array(c)), 2, F.length(F.to_json(F.array(c))) - 2)
    value = (
        F.when(F.col("v.o_kind") == "iri", F.concat(F.lit('{"@id":'), quoted(o), F.lit("}")))
        .when(kind.isin("xsd:dateTime", "xsd:date"), F.concat(F.lit('{"@value":'), quoted(o), F.lit(',"@type":"'), kind, F.lit('"}')))
        .when(kind == "xsd:boolean", F.when(o == "true", "true").otherwise("false"))
        .when(kind.isin("xsd:integer", "xsd:double", "xsd:decimal"), F.coalesce(F.regexp_replace(o.try_cast("double").cast("string"), r"\.0$", ""), F.lit("null")))
        .otherwise(quoted(o))
    )
    is_type = F.col("p").isin("rdf:type", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type")
    pair = F.when(is_type, F.concat(F.lit('"@type":'), quoted(o))).otherwise(F.concat(quoted(F.col("p")), F.lit(":"), value))
    head = F.concat(F.lit('{"@context":'), quoted(F.lit(context)), F.lit(',"@id":'), quoted(F.col("s")))
    return last.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("p", pair.alias("pair")))).alias("pairs")).select(
        "s", F.concat(head, F.lit(","), F.array_join(F.transform("pairs", lambda x: x["pair"]), ","), F.lit("}")).alias("json")
    )


def typed_values(values: DataFrame, datatypes: dict[str, str]) -> DataFrame:
    """(s, p, o, datatype, error): values of single records typed as their shapes say; one that cannot be is an error.

    `values`: ``s``, ``p``, ``o`` (text).
    """
    kind = F.coalesce(F.element_at(text.literal_map(datatypes), F.col("p")), F.lit("xsd:string"))
    o = F.col("o")
    fits = (
        F.when(kind == "xsd:integer", o.rlike(r"^[+-]?\d+$")).when(kind.isin("xsd:double", "xsd:decimal"), o.try_cast("double").isNotNull()).when(kind == "xsd:boolean", o.isin("true", "false"))
        .when(kind == "xsd:date", o.rlike(r"^\d{4}-\d{2}-\d{2}$") & o.try_cast("date").isNotNull()).when(kind == "xsd:dateTime", o.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}")).otherwise(F.lit(True))
    )
    return values.select("s", "p", "o", kind.alias("datatype"), F.when(~F.coalesce(fits, F.lit(False)), F.concat(o, F.lit(" is no "), kind)).alias("error"))
