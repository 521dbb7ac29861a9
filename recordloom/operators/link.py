"""References to edges, and sole-candidate links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions import text


def resolve_references(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """`refs` (``scope``, ``ref_type``, ``ref_id``, ...) with ``target``: typed key first, then the bare id.

    `targets`: ``scope``, ``type``, ``id``, ``target``.  The bare id counts only if it names
    one target in its scope.  Unresolved references keep a null ``target``.
    """
    typed = targets.groupBy("scope", F.col("type").alias("ref_type"), F.col("id").alias("ref_id")).agg(F.min("target").alias("typed_target"))
    bare = (
        targets.groupBy("scope", F.col("id").alias("ref_id"))
        .agg(F.min("target").alias("bare_target"), F.max("target").alias("other"))
        .where(F.col("bare_target") == F.col("other"))
        .drop("other")
    )
    j = refs.join(typed, ["scope", "ref_type", "ref_id"], "left").join(bare, ["scope", "ref_id"], "left")
    return j.withColumn("target", F.coalesce("typed_target", "bare_target")).drop("typed_target", "bare_target")


def edge_stats(resolved: DataFrame, by: str) -> DataFrame:
    """Resolved and unresolved references by `by`, with a total row (null)."""
    return resolved.rollup(by).agg(F.count_if(F.col("target").isNotNull()).alias("resolved"), F.count_if(F.col("target").isNull()).alias("unresolved"), F.count("*").alias("total"))


def sole_candidates(left: DataFrame, right: DataFrame, key: str, right_id: str) -> DataFrame:
    """`left` joined to the rows of `right` whose key is theirs alone.

    The check comes before the join, so an ambiguous hot key is dropped from `right`
    in its aggregation and never meets `left`.
    """
    sole = right.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(right_id).alias("candidate"), F.max(right_id).alias("other")).where(F.col("candidate") == F.col("other"))
    return left.join(sole.select(key, "candidate"), key)


def lift_literals(texts: DataFrame, ids: Column, targets: DataFrame, stated: DataFrame) -> DataFrame:
    """(subject, target) edges hidden in id lists of a text, without those already stated.

    `texts`: ``subject`` and what `ids` reads; `targets`: ``id``, ``target``; `stated`: ``subject``, ``target``.
    """
    spoken = texts.select("subject", F.explode(ids).alias("id")).distinct()
    edges = spoken.join(targets, "id").where(F.col("subject") != F.col("target")).select("subject", "target").distinct()
    return edges.join(stated, ["subject", "target"], "left_anti")


def lift_indications(candidates: DataFrame, conditions: DataFrame, stated: DataFrame) -> DataFrame:
    """(subject, ref, outcome, target) of each indication: lifted, ambiguous, unmatched or redundant.

    `candidates`: ``subject``, ``ref`` (its own key), ``codes`` (array, best first), ``text``.
    `conditions`: ``target``, ``codes`` (array), ``name``.  `stated`: ``subject``, ``target``.
    Codes go first, in their order, then the name; a key counts only where it names one
    condition other than the subject itself.  Keys with several are cut to two by an
    aggregation before anything meets them, so a hot key costs two rows.
    """
    by_code = conditions.select("target", F.explode("codes").alias("k")).select(F.concat(F.lit("c:"), "k").alias("key"), "target")
    by_name = conditions.where(F.col("name").isNotNull()).select(F.concat(F.lit("n:"), text.index_name(F.col("name"))).alias("key"), "target")
    several = by_code.unionByName(by_name).where(~F.col("key").isin("c:", "n:")).distinct().groupBy("key").agg(F.min("target").alias("t1"), F.max("target").alias("t2"), F.count("*").alias("n"))
    keys = F.concat(F.coalesce(F.transform("codes", lambda c: F.concat(F.lit("c:"), c)), F.array().cast("array<string>")), F.array(F.concat(F.lit("n:"), text.index_name(F.col("text")))))
    asked = candidates.select("subject", "ref", F.posexplode(keys).alias("place", "key"))
    own = (F.col("t1") == F.col("subject")) | (F.col("t2") == F.col("subject"))
    n = F.col("n") - F.when(own, 1).otherwise(0)
    other = F.when(F.col("t1") == F.col("subject"), F.col("t2")).otherwise(F.col("t1"))
    # With the subject itself among three or more the smallest two may hide another, but then there are several anyway.
    met = asked.join(several, "key").select("subject", "ref", "place", n.alias("n"), F.when(n == 1, other).alias("t"))
    best = met.groupBy("subject", "ref").agg(F.min(F.when(F.col("t").isNotNull(), F.struct("place", "t")))["t"].alias("target"), F.bool_or(F.col("n") > 1).alias("several"))
    j = candidates.select("subject", "ref").distinct().join(best, ["subject", "ref"], "left")
    known = stated.select("subject", "target").distinct().withColumn("is_stated", F.lit(True))
    j = j.join(known, ["subject", "target"], "left")
    first = j.groupBy("subject", "target").agg(F.min("ref").alias("first_ref"))
    j = j.join(first.where(F.col("target").isNotNull()), ["subject", "target"], "left")
    outcome = (
        F.when(F.col("target").isNull(), F.when(F.coalesce("several", F.lit(False)), "ambiguous").otherwise("unmatched"))
        .when(F.coalesce("is_stated", F.lit(False)) | (F.col("ref") != F.col("first_ref")), "redundant").otherwise("lifted")
    )
    return j.select("subject", "ref", outcome.alias("outcome"), "target")


def lift_stats(outcomes: DataFrame) -> DataFrame:
    """Counts of the outcomes."""
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))
