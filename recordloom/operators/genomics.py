"""Links inside genomic reports, archives and phenopackets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions import codes, text

# Allelic origins that count as inherited.
INHERITED = ("germline", "de novo", "maternal", "paternal")
# Lists at the top of a phenopacket that no record is made of.
UNMAPPED_LISTS = ("diseases", "measurements", "genes", "variants", "files")


def components(resources: DataFrame, keys: list[str], v: str = "resource") -> DataFrame:
    """(keys, name, code, value): the known parts of genomic observations; of a part stated twice the first."""
    c = resources.select(*keys, F.posexplode(F.try_variant_get(v, "$.component", "array<variant>")).alias("place", "c"))
    name = F.element_at(text.literal_map(codes.COMPONENTS), F.try_variant_get("c", "$.code.coding[0].code", "string"))
    value = F.coalesce(
        F.try_variant_get("c", "$.valueCodeableConcept.coding[0].display", "string"), F.try_variant_get("c", "$.valueCodeableConcept.text", "string"),
        F.try_variant_get("c", "$.valueString", "string"), F.try_variant_get("c", "$.valueQuantity.value", "string"),
    )
    rows = c.select(*keys, name.alias("name"), "place", F.try_variant_get("c", "$.valueCodeableConcept.coding[0].code", "string").alias("code"), value.alias("value")).where(F.col("name").isNotNull())
    return rows.groupBy(*keys, "name").agg(F.min(F.struct("place", "code", "value")).alias("f")).select(*keys, "name", "f.code", "f.value")


def resolve_members(refs: DataFrame, stages: list[DataFrame]) -> DataFrame:
    """`refs` (``scope``, ``ref``, ...) with ``target``: local ids and URLs of what earlier passes made.

    `stages`: ``scope``, ``id``, ``url``, ``target``; of an id made twice the earliest stage counts.
    """
    known = None
    for i, stage in enumerate(stages):
        rows = stage.select("scope", F.explode(F.array("id", "url")).alias("key"), "target").where(F.col("key").isNotNull()).withColumn("stage", F.lit(i))
        known = rows if known is None else known.unionByName(rows)
    first = known.groupBy("scope", "key").agg(F.min(F.struct("stage", "target"))["target"].alias("target"))
    bare = F.when(F.col("ref").rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.col("ref")).otherwise(F.substring_index("ref", "/", -1))
    return refs.withColumn("key", bare).join(first, ["scope", "key"], "left").drop("key")


def hgvs_phase(notation: Column) -> Column:
    """In cis (one allele), in trans (two), or unknown; null without a phased notation."""
    return F.when(notation.rlike(r"\[[^\]]*\]\s*;\s*\[[^\]]*\]"), "InTrans").when(notation.rlike(r"\[[^\];]+;[^\]]+\]"), "InCis").when(notation.rlike(r"\(;\)"), "PhaseUnknown")


def phase_links(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, gaps) of genotypes (``genotype``, ``place``, ``variant``, ``notation``).

    Two members and a phased notation link both ways.  Without notation the first two of
    several are linked with unknown phase, which is a gap.
    """
    g = members.groupBy("genotype").agg(F.count("*").alias("n"), F.min(F.struct("place", "variant")).alias("a"), F.max(hgvs_phase(F.col("notation"))).alias("phase"))
    rest = members.join(g.select("genotype", F.col("a.place").alias("first")), "genotype").where(F.col("place") > F.col("first"))
    g = g.join(rest.groupBy("genotype").agg(F.min(F.struct("place", "variant")).alias("b")), "genotype")
    unknown = F.col("phase").isNull() & (F.col("n") >= 2)
    pairs = g.where(unknown | (F.col("n") == 2)).select("genotype", F.col("a.variant").alias("x"), F.col("b.variant").alias("y"), F.coalesce("phase", F.lit("PhaseUnknown")).alias("phase"))
    both = pairs.select("genotype", F.col("x").alias("variant"), F.col("y").alias("phased_with"), "phase").unionByName(pairs.select("genotype", F.col("y").alias("variant"), F.col("x").alias("phased_with"), "phase"))
    return both, g.where(unknown).select("genotype", "n")


def origin_states(observed: DataFrame) -> DataFrame:
    """(variant, state) by the origins (``variant``, ``origin``) of its observations; none where no origin is stated."""
    o = F.lower(F.col("origin"))
    g = observed.where(F.nullif("origin", F.lit("")).isNotNull()).groupBy("variant").agg(F.bool_or(o.isin(*INHERITED)).alias("g"), F.bool_or(o == "somatic").alias("s"))
    return g.select("variant", codes.origin_state(F.col("g"), F.col("s")).alias("state"))


def interpretations(rcv: DataFrame, trait_sets: DataFrame) -> DataFrame:
    """Interpretations (``rcv``, ``trait_set``, ``classification``, ``review_status``) with their conditions, class and stars.

    `trait_sets`: ``trait_set``, ``trait``, ``condition``; an unknown set leaves no condition.
    """
    named = trait_sets.groupBy("trait_set").agg(F.array_sort(F.collect_set("condition")).alias("conditions"))
    status = codes.review_status(F.col("review_status"))
    return rcv.join(named, "trait_set", "left").select(
        "rcv", F.coalesce("conditions", F.array().cast("array<string>")).alias("conditions"), codes.pathogenicity(F.col("classification")).alias("class"), status.alias("status"), codes.stars(status).alias("stars")
    )


def assertions(scv: DataFrame, mappings: DataFrame, rcv: DataFrame) -> DataFrame:
    """Submissions (``scv``, ``variant``, ``trait_name``, ``category``) with the mapped condition and the interpretation they went into.

    `mappings`: ``scv``, ``trait_name``, ``condition``; `rcv`: ``rcv``, ``variant``, ``condition``.
    """
    m = mappings.groupBy("scv", "trait_name").agg(F.min("condition").alias("condition"))
    by = rcv.groupBy("variant", "condition").agg(F.min("rcv").alias("rcv"))
    return scv.join(m, ["scv", "trait_name"], "left").join(by, ["variant", "condition"], "left").select("scv", "variant", "condition", "rcv", codes.submitter_category(F.col("category")).alias("category"))


def pedigree_roles(members: DataFrame) -> DataFrame:
    """(family, member, role): `members` have ``family``, ``member``, ``father``, ``mother``, ``sex``, ``is_proband``."""
    p = members.where("is_proband").groupBy("family").agg(F.min(F.struct("member", "father", "mother")).alias("p"))
    j = members.join(p, "family", "left")
    known = lambda c: F.nullif(F.nullif(c, F.lit("")), F.lit("0"))
    role = codes.pedigree_role(F.col("member"), F.col("p.member"), known(F.col("p.father")), known(F.col("p.mother")), F.upper("sex"), known(F.col("father")), known(F.col("mother")))
    return j.select("family", "member", role.alias("role"))


def gaps(payloads: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, list, n): top-level lists of phenopackets that no record is made of."""
    v = payloads.select(key, F.try_parse_json(payload).alias("v")).where(F.col("v").isNotNull())
    found = [F.struct(F.lit(n).alias("list"), F.size(F.try_variant_get("v", f"$.{n}", "array<variant>")).alias("n")) for n in UNMAPPED_LISTS]
    return v.select(key, F.inline(F.filter(F.array(*found), lambda x: x["n"] > 0)))


def packet_parts(payloads: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, part, ix, code, label, status): subjects, interpretations, biosamples, actions and diseases of phenopackets as rows."""
    v = payloads.select(key, F.try_parse_json(payload).alias("v")).where(F.col("v").isNotNull())
    get = lambda x, p: F.try_variant_get(x, p, "string")

    def part(name: str, path: str, code: str, label: str, status: str) -> DataFrame:
        x = v.select(key, F.posexplode(F.try_variant_get("v", path, "array<variant>")).alias("ix", "x"))
        return x.select(key, F.lit(name).alias("part"), "ix", get("x", code).alias("code"), get("x", label).alias("label"), get("x", status).alias("status"))

    subject = v.where(F.try_variant_get("v", "$.subject", "variant").isNotNull()).select(
        key, F.lit("subject").alias("part"), F.lit(0).alias("ix"), get("v", "$.subject.id").alias("code"), codes.biological_sex(get("v", "$.subject.sex")).alias("label"), get("v", "$.subject.vitalStatus.status").alias("status")
    )
    out = subject.unionByName(part("biosample", "$.biosamples", "$.id", "$.sampledTissue.label", "$.materialSample.label"))
    out = out.unionByName(part("action", "$.medicalActions", "$.treatment.agent.id", "$.treatment.agent.label", "$.responseToTreatment.label"))
    out = out.unionByName(part("interpretation", "$.interpretations", "$.diagnosis.disease.id", "$.diagnosis.disease.label", "$.progressStatus"))
    x = v.select(key, F.posexplode(F.try_variant_get("v", "$.interpretations", "array<variant>")).alias("n", "x")).select(key, F.posexplode(F.try_variant_get("x", "$.diagnosis.genomicInterpretations", "array<variant>")).alias("ix", "g"))
    cls = F.regexp_replace(F.lower(get("g", "$.variantInterpretation.acmgPathogenicityClassification")), "_", " ")
    return out.unionByName(x.select(key, F.lit("variant").alias("part"), "ix", get("g", "$.subjectOrBiosampleId").alias("code"), codes.pathogenicity(cls).alias("label"), codes.causality(get("g", "$.interpretationStatus")).alias("status")))
