"""Which records state the same thing: match keys by record type, pairs, groups and what becomes of them.

Every rule of a matcher is a *key* with a confidence: records that share a key (and are
not the same source's own statement) match.  Keys of all types go through one equi-join;
times that need only be near are a band join; names that contain one another meet at
their rarest trigram.  The strongest key that two records share counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.common import cut
from recordloom.functions import dates, text
from recordloom.operators import reconcile

# Confidences of shared medication keys, strongest first.
MEDICATION_TIERS = {"rxnorm": 1.0, "snomed": 0.95, "ndc": 0.92, "atc": 0.85}
NAME_CONFIDENCE, PARTIAL_CONFIDENCE = 0.85, 0.70
#: Confidence from which records match, and from which they do if one comes from a summary document.
THRESHOLD, SUMMARY_THRESHOLD = 0.65, 0.50
#: Readings of one vital sign this near in time are one reading.
VITAL_SECONDS = 30 * 60
VITAL_TIERS = [(0.0, 1.0), (0.05, 0.95), (0.15, 0.75)]
# How far a source of a kind is trusted, and what a record's provenance adds.
TRUST = {"hospital": 0.95, "primary-care": 0.90, "specialist": 0.85}
DEFAULT_TRUST = 0.80
BOOSTS = {"healthKitFHIR": 0.30, "pharmacyClaim": 0.20, "userTracked": 0.10, "imported": 0.05}
# Predicates about a record's way here, which are no content.
BOOKKEEPING = ("rdf:type", "core:dataProvenance", "core:schemaVersion", "core:sourceSystem", "core:sourceIdentity")

_KEY = "struct<confidence:double,key:string>"


def value(properties: Column, *predicates: str) -> Column:
    """First value of the first of the predicates that a record has."""
    return F.coalesce(*[F.get(F.element_at(properties, F.lit(p)), F.lit(0))["value"] for p in predicates])


def values(properties: Column, *predicates: str) -> Column:
    """All values of the predicates."""
    empty = F.array().cast("array<string>")
    return F.concat(*[F.coalesce(F.transform(F.element_at(properties, F.lit(p)), lambda v: v["value"]), empty) for p in predicates])


def _key(confidence: float | Column, *parts: Column | str) -> Column:
    """A key, null if any part is null or empty."""
    cols = [F.nullif(p, F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts]
    c = F.lit(confidence) if not isinstance(confidence, Column) else confidence
    whole = F.concat(*cols)
    return F.when(whole.isNotNull(), F.struct(c.cast("double").alias("confidence"), whole.alias("key")))


def _keys(*keys: Column) -> Column:
    return F.filter(F.array(*keys), lambda k: k.isNotNull()).cast(f"array<{_KEY}>")


def medication_keys(codes: Column, name: Column) -> Column:
    """Code ladder, then the normalised name."""
    tier = text.literal_map(MEDICATION_TIERS)
    coded = F.transform(codes, lambda c: F.struct(F.element_at(tier, text.code_system(c)).alias("confidence"), F.concat(text.code_system(c), F.lit(":"), text.code_value(c)).alias("key")))
    coded = F.filter(coded, lambda k: k["confidence"].isNotNull() & ~k["key"].endswith(":"))
    return F.array_distinct(F.concat(coded.cast(f"array<{_KEY}>"), _keys(_key(NAME_CONFIDENCE, "name:", text.medication_name(name)))))


def condition_keys(snomed: Column, icd10: Column, name: Column) -> Column:
    return _keys(_key(1.0, "snomed:", text.code_value(snomed)), _key(0.95, "icd10:", text.code_value(icd10)), _key(0.80, "name:", text.condition_name(name)))


def allergy_keys(allergen: Column) -> Column:
    return _keys(_key(0.90, "allergen:", F.trim(F.lower(allergen))))


def lab_keys(code: Column, performed: Column, name: Column) -> Column:
    """Code and day (the values decide how sure), else name and day."""
    day = F.nullif(dates.date_only(performed), F.lit(""))
    return _keys(_key(0.90, "loinc:", text.code_value(code), "+", day), _key(0.75, "name:", F.trim(F.lower(name)), "+", day))


def immunization_keys(code: Column, given: Column, name: Column) -> Column:
    """Vaccine code and day, else name and day, else the name alone (enough for summaries only)."""
    day, said = F.nullif(dates.date_only(given), F.lit("")), F.nullif(F.trim(F.lower(name)), F.lit("unknown vaccine"))
    return _keys(_key(1.0, "cvx:", text.cvx(code), "+", day), _key(0.80, "name:", said, "+", day), _key(0.60, "name-only:", said))


def profile_keys(born: Column, sex: Column) -> Column:
    return _keys(_key(0.95, "dob:", born, "+sex:", sex), _key(0.75, "dob:", born))


def record_keys(record_type: Column, properties: Column) -> Column:
    """Keys of a record by its type; none for types that are not matched by key (as insurance plans)."""
    v = lambda *p: value(properties, *p)
    return (
        F.when(record_type == "clinical:Medication", medication_keys(values(properties, "clinical:rxNormCode", "clinical:drugCode"), v("clinical:drugName")))
        .when(record_type == "health:ConditionRecord", condition_keys(v("health:snomedCode"), v("health:icd10Code"), v("health:conditionName")))
        .when(record_type == "health:AllergyRecord", allergy_keys(v("health:allergen")))
        .when(record_type == "health:LabResultRecord", lab_keys(v("health:testCode"), v("health:performedDate"), v("health:testName")))
        .when(record_type == "health:ImmunizationRecord", immunization_keys(v("health:cvxCode", "health:vaccineCode"), v("health:administrationDate", "health:startDate"), v("health:vaccineName")))
        .when(record_type == "core:PatientProfile", profile_keys(v("core:dateOfBirth"), v("core:biologicalSex")))
        .otherwise(F.array().cast(f"array<{_KEY}>"))
    )


def prepared(records: DataFrame, scope: str = "scope") -> DataFrame:
    """Records as the matchers read them.

    `records`: `scope` (whose records may match), ``ord``, ``uri``, ``record_type``,
    ``source_system``, ``source_identity``, ``from_existing``, ``properties``.
    """
    p = F.col("properties")
    number = text.float_prefix(value(p, "health:resultValue", "clinical:value"))
    at = F.unix_seconds(value(p, "clinical:effectiveDate", "health:effectiveDate", "health:performedDate").try_cast("timestamp"))
    vital = F.col("record_type") == "clinical:VitalSign"
    return records.select(
        F.col(scope).alias("scope"), "ord", "record_type", F.col("source_system").alias("src"), F.when(text.is_known_origin(F.col("source_identity")), F.col("source_identity")).alias("origin"),
        F.coalesce("from_existing", F.lit(False)).alias("held"), record_keys(F.col("record_type"), p).alias("keys"), number.alias("number"),
        F.when(vital, text.code_value(value(p, "clinical:loincCode"))).alias("vital"), F.when(vital, at).alias("at"),
        F.coalesce(value(p, "core:documentType") == "summarization", F.lit(False)).alias("summary"),
        F.when(F.col("record_type") == "clinical:Medication", F.nullif(text.medication_name(value(p, "clinical:drugName")), F.lit(""))).alias("name"),
    )


def _pair_columns(side: str, cols: list[str]) -> list[Column]:
    return [F.col(c).alias(f"{side}_{c}") for c in cols]


_SIDE = ["ord", "src", "origin", "held", "summary", "number"]


def _may_match() -> Column:
    """Not one source's own statement: another system, or another known origin under the same one; not both held already."""
    same = F.col("a_src").eqNullSafe(F.col("b_src")) & F.coalesce(F.col("a_origin") == F.col("b_origin"), F.lit(True))
    return (F.col("a_ord") < F.col("b_ord")) & ~same & ~(F.col("a_held") & F.col("b_held"))


def key_pairs(p: DataFrame, number_types: tuple[str, ...] = ("health:LabResultRecord",), tolerance: float = 0.05) -> DataFrame:
    """(lo, hi, confidence, matched_on) by shared keys; of labs by code the values decide how sure."""
    k = p.select("scope", "record_type", F.explode("keys").alias("k"), *_SIDE)
    cols = ["scope", "record_type", F.col("k.key").alias("key")]
    a = k.select(*cols, F.col("k.confidence").alias("stated"), *_pair_columns("a", _SIDE))
    b = k.select(*cols, *_pair_columns("b", _SIDE))
    diff = F.abs(F.col("a_number") - F.col("b_number")) / F.greatest(F.abs("a_number"), F.lit(0.001))
    by_value = F.when(diff == 0, 1.0).when(diff <= tolerance, 0.90).when(diff.isNotNull(), 0.85).otherwise(F.col("stated"))
    sure = F.when(F.col("record_type").isin(*number_types) & F.col("key").startswith("loinc:"), by_value).otherwise(F.col("stated"))
    return a.join(b, ["scope", "record_type", "key"]).where(_may_match()).select(*_pair_rows(sure, F.col("key")))


def _pair_rows(confidence: Column, matched_on: Column) -> list[Column]:
    return [F.col("a_ord").alias("lo"), F.col("b_ord").alias("hi"), confidence.alias("confidence"), matched_on.alias("matched_on"), (F.col("a_summary") | F.col("b_summary")).alias("summary")]


def vital_pairs(p: DataFrame) -> DataFrame:
    """Readings of one code at most half an hour apart whose values agree."""
    v = p.where(F.col("vital").isNotNull() & F.col("at").isNotNull())
    bucket = F.floor(F.col("at") / VITAL_SECONDS)
    a = v.select("scope", "vital", F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"), F.col("at").alias("a_at"), *_pair_columns("a", _SIDE))
    b = v.select("scope", "vital", bucket.alias("bucket"), F.col("at").alias("b_at"), *_pair_columns("b", _SIDE))
    near = F.abs(F.col("a_at") - F.col("b_at")) <= VITAL_SECONDS
    x, y = F.col("a_number"), F.col("b_number")
    sure = reconcile.value_confidence(x, y, VITAL_TIERS, 0.85, F.greatest(F.abs(x), F.abs(y)))
    label = F.when(sure == 0.75, "loinc-approx:").otherwise("loinc:")
    first = F.date_format(F.timestamp_seconds(F.least("a_at", "b_at")), "yyyy-MM-dd'T'HH:mm:ss'.000Z'")
    pairs = a.join(b, ["scope", "vital", "bucket"]).where(_may_match() & near)
    return pairs.select(*_pair_rows(sure, F.concat(label, F.col("vital"), F.lit("+"), first))).where(F.col("confidence").isNotNull())


def _name_grams(name: Column) -> Column:
    """Trigrams of a name; a shorter name is its own, and so is every piece as short of a longer one."""
    def pieces(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - n + 1, F.lit(1))), lambda i: F.substring(name, i, F.lit(n)))

    return F.array_distinct(F.flatten(F.array(*[pieces(n) for n in (1, 2, 3)])))


def partial_name_pairs(p: DataFrame) -> DataFrame:
    """Medications of which one's name contains the other's.

    The shorter name is looked up at one of its grams only, the rarest within the scope:
    whatever contains the name holds that gram.  Distinct names are joined, then their records.
    """
    named = p.where(F.col("name").isNotNull())
    names = named.select("scope", "name").distinct()
    grams = names.select("scope", "name", F.explode(_name_grams(F.col("name"))).alias("gram"))
    uses = grams.groupBy("scope", "gram").agg(F.count("*").alias("n"))
    own = grams.where(F.length("gram") == F.least(F.length("name"), F.lit(3))).join(uses, ["scope", "gram"])
    rarest = own.groupBy("scope", "name").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram")).withColumnRenamed("name", "short")
    within = grams.withColumnRenamed("name", "long").join(rarest, ["scope", "gram"]).where((F.col("long") != F.col("short")) & F.contains(F.col("long"), F.col("short")))
    pairs = within.select("scope", "long", "short")
    a, b = named.select("scope", F.col("name").alias("a_name"), *_pair_columns("a", _SIDE)), named.select("scope", F.col("name").alias("b_name"), *_pair_columns("b", _SIDE))
    ways = pairs.select("scope", F.col("long").alias("a_name"), F.col("short").alias("b_name"), "short").unionByName(pairs.select("scope", F.col("short").alias("a_name"), F.col("long").alias("b_name"), "short"))
    found = ways.join(a, ["scope", "a_name"]).join(b, ["scope", "b_name"]).where(_may_match())
    return found.select(*_pair_rows(F.lit(PARTIAL_CONFIDENCE), F.concat(F.lit("partial-name:"), F.col("short"))))


def matches(records: DataFrame, scope: str = "scope") -> DataFrame:
    """(lo, hi, confidence, matched_on): the strongest way each pair of records matches, if it is sure enough.

    Records of one type and scope match; those of one source only across known origins;
    those both held already not at all.  Null values match nothing.
    """
    # Read once: three joins use it, and their plans stay small.
    p = cut(prepared(records, scope))
    every = key_pairs(p).unionByName(vital_pairs(p)).unionByName(partial_name_pairs(p))
    enough = every.where(F.col("confidence") >= F.when(F.col("summary"), SUMMARY_THRESHOLD).otherwise(THRESHOLD))
    best = enough.groupBy("lo", "hi").agg(F.max(F.struct("confidence", "matched_on")).alias("b"))
    return best.select("lo", "hi", "b.confidence", "b.matched_on")


def in_order(records: DataFrame) -> DataFrame:
    """`records` with new ones before those held already, which can join a new record but not found a group; new ones whose uri is held are left out."""
    held = records.where(F.coalesce("from_existing", F.lit(False))).select("uri").distinct()
    new = records.where(~F.coalesce("from_existing", F.lit(False))).join(held, "uri", "left_anti")
    old = records.where(F.coalesce("from_existing", F.lit(False))).withColumn("ord", F.col("ord") + F.lit(1 << 50))
    return new.unionByName(old.select(*new.columns))


def grouped(records: DataFrame, pairs: DataFrame, scope: str = "scope") -> DataFrame:
    """(rep, seed, confidence, matched_on): greedy groups, with how the first member joined the seed."""
    nodes = records.select(F.col("ord").alias("rep"), scope, "record_type")
    groups = reconcile.greedy_groups(nodes, pairs, (scope, "record_type"))
    how = groups.where(F.col("rep") != F.col("seed")).join(pairs.select(F.col("lo").alias("seed"), F.col("hi").alias("rep"), "confidence", "matched_on"), ["seed", "rep"])
    first = how.groupBy("seed").agg(F.min(F.struct("rep", "confidence", "matched_on")).alias("h"))
    return groups.join(first, "seed", "left").select("rep", "seed", F.coalesce("h.confidence", F.lit(1.0)).alias("confidence"), F.coalesce("h.matched_on", F.lit("")).alias("matched_on"))


def medication_activity(status: Column) -> Column:
    """active or inactive, by the status of a medication; null and unknown count as active."""
    return F.when(F.lower(F.trim(status)).isin("stopped", "discontinued", "inactive", "cancelled", "canceled", "completed", "entered-in-error"), "inactive").otherwise("active")


def _differ(a: Column, b: Column) -> Column:
    return F.coalesce((F.nullif(a, F.lit("")) != F.nullif(b, F.lit(""))), F.lit(False))


def _one_side(a: Column, b: Column) -> Column:
    return F.nullif(a, F.lit("")).isNull() != F.nullif(b, F.lit("")).isNull()


def kind_of_match(record_type: Column, a: Column, b: Column, tolerance: float = 0.05) -> Column:
    """Struct (kind, field) of a group by the properties of its first two records."""
    va, vb = (lambda *p: value(a, *p)), (lambda *p: value(b, *p))
    x, y = text.float_prefix(va("health:resultValue")), text.float_prefix(vb("health:resultValue"))
    diff = F.abs(x - y) / F.greatest(F.abs(x), F.lit(0.001))
    dose = (text.dose(va("clinical:dosage")), text.dose(vb("clinical:dosage")))
    often = (text.frequency(va("clinical:frequency", "health:frequency")), text.frequency(vb("clinical:frequency", "health:frequency")))
    name = (text.medication_name(va("clinical:drugName")), text.medication_name(vb("clinical:drugName")))

    def kind(k: str, field: str | None = None) -> Column:
        return F.struct(F.lit(k).alias("kind"), F.lit(field).cast("string").alias("field"))

    is_ = lambda t: record_type == t
    return (
        F.when(is_("health:ConditionRecord") & _differ(va("health:status"), vb("health:status")), kind("status_conflict", "health:status"))
        .when(is_("health:AllergyRecord") & _differ(va("health:allergySeverity"), vb("health:allergySeverity")), kind("value_conflict", "health:allergySeverity"))
        .when(is_("health:LabResultRecord") & (diff > tolerance), kind("value_conflict", "health:resultValue"))
        .when(is_("health:LabResultRecord") & (diff > 0), kind("near_duplicate"))
        .when(is_("clinical:Medication") & (medication_activity(va("clinical:status")) != medication_activity(vb("clinical:status"))), kind("status_conflict", "clinical:status"))
        .when(is_("clinical:Medication") & _differ(*dose), kind("value_conflict", "clinical:dosage"))
        .when(is_("clinical:Medication") & _differ(*often), kind("value_conflict", "clinical:frequency"))
        .when(is_("clinical:Medication") & (_differ(*name) | _one_side(*dose) | _one_side(*often)), kind("near_duplicate"))
        .otherwise(kind("exact_duplicate"))
    )


def provenance_score(source_kind: Column, provenance: Column) -> Column:
    """Trust of a record: of its kind of source, and what its provenance adds."""
    return F.coalesce(F.element_at(text.literal_map(TRUST), source_kind), F.lit(DEFAULT_TRUST)) + F.coalesce(F.element_at(text.literal_map(BOOSTS), provenance), F.lit(0.0))


def completeness(properties: Column) -> Column:
    """Properties of a record that are content."""
    return F.size(F.filter(F.map_keys(properties), lambda k: ~k.isin(*BOOKKEEPING)))


def strategy(kind: Column, record_type: Column, trust_gap: Column, provenances: Column | None = None, tier0: Column | None = None, guard: bool = False) -> Column:
    """How a group is resolved; ``flag_...`` ones wait for a person."""
    medication = record_type == "clinical:Medication"
    out = F.when(F.lit(False), "")
    if guard:
        crossing = kind.isin("near_duplicate", "exact_duplicate") & (provenances > 1)
        out = out.when(crossing & ~F.coalesce(tier0, F.lit(False)) if tier0 is not None else crossing, "flag_cross_provenance")
    return (
        out.when(kind == "near_duplicate", "merge_values")
        .when((kind == "status_conflict") & (medication | (trust_gap < 0.05)), "flag_unresolved")
        .when((kind == "value_conflict") & medication, "flag_unresolved")
        .otherwise("trust_priority")
    )


def resolved(records: DataFrame, groups: DataFrame, source_kind: Column | None = None, tolerance: float = 0.05, guard: bool = False) -> DataFrame:
    """One row per group: kind, strategy, winner, status, and the properties that survive.

    `groups`: ``rep``, ``seed``, ``confidence``, ``matched_on``.  Group sizes do not matter: first two,
    winner and runner-up are aggregates; merged values are taken property by property.
    """
    kind_col = source_kind if source_kind is not None else F.lit(None).cast("string")
    r = records.select(
        F.col("ord").alias("rep"), "uri", "record_type", "source_system", "properties",
        provenance_score(kind_col, value(F.col("properties"), "clinical:provenanceClass", "core:dataProvenance")).alias("score"),
        F.coalesce(F.element_at(text.literal_map(TRUST), kind_col), F.lit(DEFAULT_TRUST)).alias("trust"),
        completeness(F.col("properties")).alias("n_content"), value(F.col("properties"), "clinical:provenanceClass").alias("provenance"),
    )
    r = cut(r)
    m = groups.join(r, "rep")
    better = F.struct((-F.col("score")).alias("s"), (-F.col("n_content")).alias("c"), F.col("rep").alias("r"))
    g = m.groupBy("seed").agg(
        F.count("*").alias("n_members"), F.min("rep").alias("first"), F.min(better)["r"].alias("winner"),
        F.first("confidence").alias("confidence"), F.first("matched_on").alias("matched_on"), F.count_distinct("provenance").alias("n_provenances"),
    )
    after = m.join(g.select("seed", "first", "winner"), "seed")
    more = after.groupBy("seed").agg(
        F.min(F.when(F.col("rep") > F.col("first"), F.col("rep"))).alias("second"),
        F.min(F.when(F.col("rep") != F.col("winner"), better))["r"].alias("runner_up"),
    )
    g = g.join(more, "seed")
    as_ = lambda at, *cols: r.select(F.col("rep").alias(at), *[F.col(c).alias(f"{at}_{c}") for c in cols])
    g = g.join(as_("first", "properties", "record_type"), "first").join(as_("second", "properties"), "second", "left")
    g = g.join(as_("winner", "uri", "trust"), "winner").join(as_("runner_up", "trust"), "runner_up", "left")
    g = cut(g)
    k = F.when(F.col("n_members") < 2, F.struct(F.lit("pass_through").alias("kind"), F.lit(None).cast("string").alias("field"))).otherwise(
        kind_of_match(F.col("first_record_type"), F.col("first_properties"), F.col("second_properties"), tolerance)
    )
    g = g.withColumn("k", k)
    how = F.when(F.col("n_members") > 1, strategy(F.col("k.kind"), F.col("first_record_type"), F.abs(F.col("winner_trust") - F.col("runner_up_trust")), F.col("n_provenances"), None, guard))
    status = (
        F.when(F.col("n_members") < 2, "canonical").when(how.startswith("flag_"), "unresolved-conflict")
        .when(F.col("k.kind").isin("status_conflict", "value_conflict"), "conflict-resolved").otherwise("merged")
    )
    return g.select(
        "seed", F.col("first_record_type").alias("record_type"), "n_members", "confidence", "matched_on", F.col("k.kind").alias("kind"), F.col("k.field").alias("field"),
        how.alias("strategy"), "winner", F.col("winner_uri").alias("canonical_uri"), status.alias("status"),
        F.when(F.col("k.field").isNotNull(), text.conflict_id(F.col("first_record_type"), F.col("matched_on"))).alias("conflict_id"),
    )


def merged_values(records: DataFrame, groups: DataFrame, resolution: DataFrame) -> DataFrame:
    """(canonical_uri, predicate, values): the winner's properties, and in ``merge_values`` groups what only others have."""
    r = records.select(F.col("ord").alias("rep"), provenance_score(F.lit(None).cast("string"), value(F.col("properties"), "clinical:provenanceClass", "core:dataProvenance")).alias("score"), completeness(F.col("properties")).alias("n"), F.explode("properties").alias("predicate", "values"))
    m = groups.select("rep", "seed").join(r, "rep").join(resolution.select("seed", "winner", "strategy", "canonical_uri"), "seed")
    own = F.col("rep") == F.col("winner")
    m = m.where(own | ((F.col("strategy") == "merge_values") & ~F.col("predicate").isin(*BOOKKEEPING)))
    order = F.struct(F.when(own, 0).otherwise(1).alias("o"), (-F.col("score")).alias("s"), (-F.col("n")).alias("c"), F.col("rep").alias("r"))
    return m.groupBy("canonical_uri", "predicate").agg(F.min_by("values", order).alias("values"))


def summary(resolution: DataFrame, n_records: int | Column, n_passed: int | Column = 0) -> DataFrame:
    """Counters of a reconciliation, in one aggregate over its groups."""
    n, kind = F.col("n_members"), F.col("kind")
    counts = resolution.agg(
        F.count("*").alias("n_groups"), F.coalesce(F.sum("n_members"), F.lit(0)).alias("n_grouped"), F.count_if(n > 1).alias("n_merges"),
        F.coalesce(F.sum(F.when(n > 1, n - 1)), F.lit(0)).alias("n_removed"), F.count_if(kind == "exact_duplicate").alias("n_exact"),
        F.count_if(kind == "near_duplicate").alias("n_near"), F.count_if(kind == "status_conflict").alias("n_status_conflicts"),
        F.count_if(kind == "value_conflict").alias("n_value_conflicts"), F.count_if(F.col("status") == "conflict-resolved").alias("n_resolved"),
        F.count_if(F.col("status") == "unresolved-conflict").alias("n_unresolved"),
    )
    wrap = lambda x: x if isinstance(x, Column) else F.lit(x)
    return counts.withColumn("n_dropped", wrap(n_records) - F.col("n_grouped")).withColumn("n_passed", wrap(n_passed))
