"""Which format a file has, JSON genomics, encrypted resources, partitioned upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.identity import digest24


def sniff(head: Column) -> Column:
    """Format by the first bytes, as text: the first rule that holds."""
    t = F.ltrim(F.regexp_replace(head, "^﻿", ""))
    return (
        F.when(head.startswith("PK\x03\x04"), "zip")
        .when(t.startswith("##fileformat=VCF"), "vcf")
        .when(t.rlike(r"(?s)^(<\?xml.*?>\s*)?(<!--.*?-->\s*)*<(\w+:)?ClinicalDocument\b"), "ccda")
        .when(t.rlike(r"(?s)^(<\?xml.*?>\s*)?<(ClinVarVariationRelease|ClinVarResult-Set|VariationArchive)\b"), "variation-xml")
        .when(t.startswith("<?xml"), "xml")
        .when(t.rlike(r'^\{') & t.rlike(r'"phenotypicFeatures"|"subject"\s*:\s*\{[^}]*"timeAtLastEncounter"'), "phenopacket")
        .when(t.rlike(r'^\{') & t.rlike(r'"type"\s*:\s*"Allele"'), "allele")
        .when(t.rlike(r'^[\[{]') & t.rlike(r'"resourceType"'), "fhir")
        .when(t.rlike(r"^[\[{]"), "json")
        .when(t.rlike(r"(?i)^(@prefix|@base|prefix)\s|^<[^>]+>\s+(a|<|\w*:)"), "turtle")
        .otherwise("unknown")
    )


def alleles(df: DataFrame, key: str, payload: str) -> DataFrame:
    """Alleles with the digest of their canonical JSON, to compare with the stated id.

    The canonical form has sorted keys and no blanks: of a sequence location its own
    digest stands in for it.
    """
    v = df.select(key, F.try_parse_json(payload).alias("v")).where(F.try_variant_get("v", "$.type", "string") == "Allele")

    def get(path: str, kind: str = "string") -> Column:
        return F.try_variant_get("v", path, kind)

    start, end = get("$.location.start", "bigint"), get("$.location.end", "bigint")
    ref = get("$.location.sequenceReference.refgetAccession")
    location = F.concat(F.lit('{"end":'), end, F.lit(',"sequenceReference":{"refgetAccession":"'), ref, F.lit('","type":"SequenceReference"},"start":'), start, F.lit(',"type":"SequenceLocation"}'))
    state = F.concat(F.lit('{"sequence":"'), get("$.state.sequence"), F.lit('","type":"LiteralSequenceExpression"}'))
    allele = F.concat(F.lit('{"location":"'), digest24(location), F.lit('","state":'), state, F.lit(',"type":"Allele"}'))
    return v.select(key, get("$.id").alias("stated_id"), F.concat(F.lit("ga4gh:VA."), digest24(allele)).alias("computed_id"), start.alias("start"), end.alias("end"), get("$.state.sequence").alias("sequence")).withColumn(
        "is_consistent", F.col("stated_id") == F.col("computed_id")
    )


def phenotypes(df: DataFrame, key: str, payload: str) -> DataFrame:
    """Phenotypic features of phenopackets, excluded ones marked."""
    v = df.select(key, F.try_parse_json(payload).alias("v")).where(F.col("v").isNotNull())
    f = v.select(key, F.try_variant_get("v", "$.subject.id", "string").alias("subject_id"), F.posexplode(F.try_variant_get("v", "$.phenotypicFeatures", "array<variant>")).alias("ix", "f"))
    return f.select(
        key, "subject_id", "ix", F.try_variant_get("f", "$.type.id", "string").alias("term"), F.try_variant_get("f", "$.type.label", "string").alias("label"),
        F.coalesce(F.try_variant_get("f", "$.excluded", "boolean"), F.lit(False)).alias("excluded"),
    )


def encrypted(content: Column, key: Column) -> Column:
    """AES-GCM envelope of a text (key of 16, 24 or 32 bytes)."""
    return F.base64(F.aes_encrypt(content, key, F.lit("GCM")))


def decrypted(envelope: Column, key: Column) -> Column:
    """Text of an envelope; null where it was not made with the key."""
    return F.try_aes_decrypt(F.unbase64(envelope), key, F.lit("GCM")).cast("string")


def resource_state(envelope: Column, key: Column) -> Column:
    """encrypted, plaintext or unreadable."""
    # Envelopes may be wrapped in lines.
    looks = envelope.rlike(r"^[A-Za-z0-9+/\s]{38,}={0,2}\s*$") & ~envelope.rlike(r"[A-Za-z0-9+/] [A-Za-z0-9+/]")
    return F.when(envelope.isNull(), "unreadable").when(~looks, "plaintext").when(decrypted(envelope, key).isNotNull(), "encrypted").otherwise("unreadable")


def route(df: DataFrame, record_type: str, buckets: dict[str, str], rest: str = "passthrough") -> DataFrame:
    """`df` with the ``bucket`` its type is stored in."""
    table = F.create_map(*[F.lit(x) for kv in buckets.items() for x in kv]) if buckets else F.create_map().cast("map<string,string>")
    return df.withColumn("bucket", F.coalesce(F.element_at(table, F.col(record_type)), F.lit(rest)))


def upsert(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """`existing` with the rows of `incoming` in place of those of the same key."""
    return existing.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)
