"""Append-only corrections and their effect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def effective(overlays: DataFrame) -> DataFrame:
    """Latest amendment per (record, property) that no later retraction of the record undoes.

    `overlays`: ``overlay_id``, ``record``, ``kind`` (amend, retract, other), ``property``, ``value``, ``created``.
    Of equal times the larger id is later.  One aggregation: nothing is sorted or windowed.
    """
    when = F.struct("created", "overlay_id")
    retracted = overlays.where("kind = 'retract'").groupBy("record").agg(F.max(when).alias("gone"))
    amended = overlays.where("kind = 'amend'").groupBy("record", "property").agg(F.max(F.struct("created", "overlay_id", "value")).alias("last"))
    j = amended.join(retracted, "record", "left")
    alive = F.col("gone").isNull() | (F.struct("last.created", "last.overlay_id") > F.col("gone"))
    return j.where(alive).select("record", "property", F.col("last.value").alias("value"), F.col("last.created").alias("created"))


def last_wins(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Upsert by key: the row with the largest `order`."""
    return df.groupBy(*keys).agg(F.max(F.struct(*order, *values)).alias("w")).select(*keys, *[f"w.{v}" for v in values])


def disposition(candidates: DataFrame, alive: DataFrame, merged: DataFrame) -> DataFrame:
    """Fate of queued conflicts (``conflict``, ``uri``): cleared if a candidate was merged, kept with two alive, else orphan."""
    j = (
        candidates.distinct()
        .join(alive.select("uri", F.lit(True).alias("is_alive")).distinct(), "uri", "left")
        .join(merged.select("uri", F.lit(True).alias("is_merged")).distinct(), "uri", "left")
    )
    g = j.groupBy("conflict").agg(F.count("is_alive").alias("n_alive"), F.bool_or(F.coalesce("is_merged", F.lit(False))).alias("any_merged"), F.count("*").alias("n_candidates"))
    fate = F.when(F.col("any_merged"), "cleared").when(F.col("n_alive") >= 2, "kept").otherwise("orphan")
    return g.select("conflict", "n_candidates", "n_alive", fate.alias("disposition"))


def apply_template(bound: DataFrame, template: list[tuple[str, str]], activity: str) -> DataFrame:
    """Triples of a patch: each template (predicate, object) for each bound subject, and the activity that made it."""
    pairs = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(o).alias("o")) for p, o in template])
    return bound.select(F.col("s"), F.inline(pairs)).withColumn("activity", F.lit(activity))


def revert(triples: DataFrame, activity: Column) -> DataFrame:
    """Triples without those of an activity."""
    return triples.where(~activity.eqNullSafe(F.col("activity")))
