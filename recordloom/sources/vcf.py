"""Variant call files: header fields, and one row per alternate allele."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def header(lines: DataFrame) -> DataFrame:
    """(file, kind, id, fields): structured ``##`` lines; plain ones have their value under ``value``."""
    h = lines.where(F.col("value").startswith("##"))
    kind = F.regexp_extract("value", "^##([^=]+)=", 1)
    body = F.regexp_extract("value", "^##[^=]+=<(.*)>$", 1)
    keys = F.regexp_extract_all(body, F.lit('([A-Za-z0-9_]+)=("(?:[^"\\\\]|\\\\.)*"|[^,]*)'), 1)
    vals = F.transform(F.regexp_extract_all(body, F.lit('([A-Za-z0-9_]+)=("(?:[^"\\\\]|\\\\.)*"|[^,]*)'), 2), lambda v: F.regexp_replace(v, '^"|"$', ""))
    fields = F.when(body != "", F.map_from_arrays(keys, vals)).otherwise(F.create_map(F.lit("value"), F.regexp_extract("value", "^##[^=]+=(.*)$", 1)))
    return h.select("file", kind.alias("kind"), fields.alias("fields")).withColumn("id", F.col("fields")["ID"])


def zygosity(gt: Column) -> Column:
    """Zygosity of a genotype; null where it is missing."""
    calls = F.filter(F.split(gt, r"[/|]"), lambda x: x != ".")
    alt = F.filter(calls, lambda x: x != "0")
    return (
        F.when(gt.isNull() | (F.size(calls) <= 0), None)
        .when(F.size(calls) == 1, F.when(F.size(alt) == 1, "Hemizygous").otherwise("HomRef"))
        .when(F.size(alt) == 0, "HomRef")
        .when(F.size(F.array_distinct(calls)) == 1, "Homozygous")
        .otherwise("Heterozygous")
    )


def alleles(lines: DataFrame) -> DataFrame:
    """One row per ALT: position, end, ids, zygosity of the first sample, frequency clamped to 0..1, INFO as a map."""
    c = F.split("value", "\t")
    r = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).select("file", c.alias("c")).where(F.size("c") >= 8)
    info = F.map_filter(F.str_to_map(F.col("c")[7], F.lit(";"), F.lit("=")), lambda k, v: k != ".")
    fmt, sample = F.split(F.get("c", F.lit(8)), ":"), F.split(F.get("c", F.lit(9)), ":")
    gt = F.get(sample, (F.array_position(fmt, "GT") - 1).cast("int"))
    r = r.select(
        "file", F.col("c")[0].alias("chrom"), F.col("c")[1].try_cast("bigint").alias("pos"), F.col("c")[2].alias("ids"), F.col("c")[3].alias("ref"),
        F.nullif(F.col("c")[5], F.lit(".")).try_cast("double").alias("qual"), F.col("c")[6].alias("filter"), info.alias("info"),
        F.when(F.array_contains(fmt, "GT"), gt).alias("gt"), F.posexplode(F.split(F.col("c")[4], ",")).alias("alt_ix", "alt"),
    )
    af = F.get(F.split(F.col("info")["AF"], ","), F.col("alt_ix")).try_cast("double")
    return r.select(
        "file", "chrom", "pos", F.coalesce(F.col("info")["END"].try_cast("bigint"), F.col("pos") + F.length("ref") - 1).alias("end"), "ref", "alt", "alt_ix", "qual", "filter", "info",
        F.nullif(F.regexp_extract("ids", r"(?:^|;)(rs\d+)", 1), F.lit("")).alias("rs_id"), F.when(af.between(0, 1), af).alias("frequency"), zygosity(F.col("gt")).alias("zygosity"),
        F.sha2(F.concat_ws("|", "chrom", "pos", "ref", "alt"), 256).alias("variant_key"),
    )


def read(spark, path: str) -> DataFrame:
    """Lines of VCF files (gzip is read as it is) with their file."""
    return spark.read.text(path).withColumn("file", F.input_file_name())
