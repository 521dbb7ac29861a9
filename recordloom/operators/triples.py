"""Records as triples, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_triples(records: DataFrame) -> DataFrame:
    """Distinct (s, p, o, datatype, is_iri) of the records' property maps, record types included.

    Records without uri, and null values, state nothing.
    """
    known = records.where(F.col("uri").isNotNull())
    props = known.select(F.col("uri").alias("s"), F.explode("properties").alias("p", "values")).select("s", "p", F.explode("values").alias("v"))
    stated = props.where(F.col("v.value").isNotNull()).select("s", "p", F.col("v.value").alias("o"), F.col("v.datatype").alias("datatype"), F.coalesce("v.is_iri", F.lit(False)).alias("is_iri"))
    types = known.where(F.col("record_type").isNotNull()).select(
        F.col("uri").alias("s"), F.lit("rdf:type").alias("p"), F.col("record_type").alias("o"), F.lit(None).cast("string").alias("datatype"), F.lit(True).alias("is_iri")
    )
    return stated.unionByName(types).distinct()


def unpivot(df: DataFrame, subject: Column, columns: dict[str, str], record_type: str) -> DataFrame:
    """Triples of a wide table: one per non-null cell of `columns` (column to predicate), and the type."""
    pairs = [F.struct(F.lit(p).alias("p"), F.col(c).cast("string").alias("o")) for c, p in columns.items()]
    pairs.append(F.struct(F.lit("rdf:type").alias("p"), F.lit(record_type).alias("o")))
    return df.select(subject.alias("s"), F.inline(F.array(*pairs))).where(F.col("s").isNotNull() & F.col("o").isNotNull())


def pivot(triples: DataFrame, predicates: list[str], sep: str = ", ") -> DataFrame:
    """One row per subject; several values of a predicate joined in order of value."""
    per = triples.where(F.col("p").isin(predicates)).groupBy("s", "p").agg(F.array_join(F.array_sort(F.collect_set("o")), sep).alias("o"))
    return per.groupBy("s").agg(*[F.max(F.when(F.col("p") == p, F.col("o"))).alias(p.split(":")[-1]) for p in predicates])


def match(triples: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """Triples by any of subject, predicate and object."""
    out = triples
    for name, want in (("s", s), ("p", p), ("o", o)):
        if want is not None:
            out = out.where(F.col(name) == want)
    return out


def collapse_single(triples: DataFrame, predicates: list[str]) -> DataFrame:
    """The smallest value only, for predicates that may have one."""
    single = F.col("p").isin(predicates)
    kept = triples.where(single).groupBy("s", "p").agg(F.min("o").alias("o"))
    return triples.where(~single).select("s", "p", "o").unionByName(kept)
