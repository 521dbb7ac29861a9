"""Declarative constraints: compiled to Columns, checked in one pass per table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.common import small_side


@dataclass(frozen=True)
class Constraint:
    """A rule on a row: `holds` must not be false (a null is not applicable, as for a missing value)."""

    name: str
    holds: Column
    value: Column
    severity: str = "violation"


def required(c: str) -> Column:
    """minCount 1."""
    return F.col(c).isNotNull()


def datatype(c: str, kind: str) -> Column:
    return F.when(F.col(c).isNotNull(), F.col(c).try_cast(kind).isNotNull())


def one_of(c: str, values: list) -> Column:
    return F.col(c).isin(values)


def pattern(c: str, regex: str) -> Column:
    return F.col(c).rlike(regex)


def length_between(c: str, low: int | None = None, high: int | None = None) -> Column:
    n = F.length(c)
    return (n >= low if low is not None else F.lit(True)) & (n <= high if high is not None else F.lit(True))


def in_range(c: str, low=None, high=None) -> Column:
    return (F.col(c) >= low if low is not None else F.lit(True)) & (F.col(c) <= high if high is not None else F.lit(True))


def _truth(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def any_of(*branches: Column) -> Column:
    """or: a null branch does not hold."""
    out = _truth(branches[0])
    for b in branches[1:]:
        out = out | _truth(b)
    return out


def exactly_one(*branches: Column) -> Column:
    """xone."""
    return sum((_truth(b).cast("int") for b in branches), F.lit(0)) == 1


def negated(branch: Column) -> Column:
    """not."""
    return ~_truth(branch)


def closed(properties: str, allowed: list[str]) -> Column:
    """No predicates but the allowed ones in a property map."""
    return F.size(F.array_except(F.map_keys(properties), F.array(*[F.lit(a) for a in allowed]))) == 0


def violations(df: DataFrame, focus: Column, table: str, rules: list[Constraint]) -> DataFrame:
    """(table_name, focus, rule, severity, value) of every rule a row breaks; all rules in one scan."""
    broken = [
        F.when(~r.holds, F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), r.value.cast("string").alias("value"))) for r in rules
    ]
    found = F.filter(F.array(*broken), lambda x: x.isNotNull())
    return df.select(F.lit(table).alias("table_name"), focus.cast("string").alias("focus"), F.inline(found))


def missing_class(df: DataFrame, focus: Column, table: str, rule: str, key: str, targets: DataFrame, target_key: str) -> DataFrame:
    """class: rows whose `key` names no row of `targets`."""
    known = targets.select(F.col(target_key).alias(key)).distinct()
    lost = df.where(F.col(key).isNotNull()).join(small_side(known), key, "left_anti")
    return lost.select(F.lit(table).alias("table_name"), focus.cast("string").alias("focus"), F.lit(rule).alias("rule"), F.lit("violation").alias("severity"), F.col(key).cast("string").alias("value"))


def cardinality(triples: DataFrame, subjects: DataFrame, predicate: str, low: int = 0, high: int | None = None) -> DataFrame:
    """(s, n) of subjects with fewer or more distinct values of `predicate` than allowed."""
    n = subjects.select("s").join(triples.where(F.col("p") == predicate).select("s", "o").distinct(), "s", "left").groupBy("s").agg(F.count("o").alias("n"))
    return n.where((F.col("n") < low) | (F.col("n") > high if high is not None else F.lit(False)))


def coverage(types: DataFrame, shaped: DataFrame) -> DataFrame:
    """Subjects by type (``s``, ``type``) and whether any shape (``type``) covers the type."""
    counts = types.groupBy("type").agg(F.count_distinct("s").alias("n_subjects"))
    return counts.join(small_side(shaped.select("type", F.lit(True).alias("shaped")).distinct()), "type", "left").fillna({"shaped": False})
