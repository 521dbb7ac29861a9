"""Edges between records: projection, neighbourhoods, closures, redirects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.common import cut

#: Longest neighbourhood.
MOST_HOPS = 3


def live_records(records: DataFrame) -> DataFrame:
    """Distinct uris with a row that is not tombstoned."""
    return records.where(F.col("uri").isNotNull() & F.col("tombstoned_at").isNull()).select("uri").distinct()


def record_edges(edges: DataFrame, live: DataFrame) -> DataFrame:
    """Distinct (subject, predicate, object) with both ends in `live` (``uri``); types are no edges."""
    e = edges.where(F.col("predicate") != "rdf:type").select(F.col("subject_uri").alias("subject"), "predicate", F.col("object_uri").alias("object")).distinct()
    return e.join(live.select(F.col("uri").alias("subject")), "subject", "left_semi").join(live.select(F.col("uri").alias("object")), "object", "left_semi").select("subject", "predicate", "object")


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int = 2, predicates: list[str] | None = None) -> DataFrame:
    """(seed, iri, hop, predicate, direction) of what lies within `hops` edges of each seed, either way.

    Of several ways to discover a record in the same hop the first by (predicate,
    direction, from) is reported; 'in' sorts before 'out'.  A seed is not its own
    neighbour.  More than `MOST_HOPS` hops are refused.
    """
    if not 1 <= hops <= MOST_HOPS:
        raise ValueError(f"a neighbourhood has 1 to {MOST_HOPS} hops")
    e = edges if predicates is None else edges.where(F.col("predicate").isin(predicates))
    both = e.select(F.col("subject").alias("from"), "predicate", F.lit("out").alias("direction"), F.col("object").alias("iri")).unionByName(
        e.select(F.col("object").alias("from"), "predicate", F.lit("in").alias("direction"), F.col("subject").alias("iri"))
    )
    frontier = seeds.select(F.col("uri").alias("seed"), F.col("uri").alias("from")).distinct()
    seen = frontier.select("seed", F.col("from").alias("iri"))
    found = None
    for hop in range(1, hops + 1):
        step = frontier.join(both, "from").join(seen, ["seed", "iri"], "left_anti")
        first = step.groupBy("seed", "iri").agg(F.min(F.struct("predicate", "direction", "from")).alias("f"))
        level = cut(first.select("seed", "iri", F.lit(hop).alias("hop"), F.col("f.predicate").alias("predicate"), F.col("f.direction").alias("direction")))
        found = level if found is None else found.unionByName(level)
        seen = seen.unionByName(level.select("seed", "iri"))
        frontier = level.select("seed", F.col("iri").alias("from"))
    return found


def closure(pairs: DataFrame, rounds: int = 32) -> DataFrame:
    """All (child, ancestor) pairs of a parent relation (``child``, ``parent``), by doubling.

    `rounds` doublings reach 2^rounds levels; cycles end by themselves as no new pair appears.
    """
    known = cut(pairs.where("child IS NOT NULL AND parent IS NOT NULL").select("child", F.col("parent").alias("ancestor")).distinct())
    for _ in range(rounds):
        more = known.join(known.select(F.col("child").alias("ancestor"), F.col("ancestor").alias("above")), "ancestor").select("child", F.col("above").alias("ancestor"))
        fresh = cut(more.distinct().join(known, ["child", "ancestor"], "left_anti"))
        if fresh.isEmpty():
            break
        known = cut(known.unionByName(fresh))
    return known


def redirect_map(pairs: DataFrame, rounds: int = 32) -> DataFrame:
    """(old, canonical) with chains followed to their end (``old``, ``new``; one new per old: the smallest).

    Members of a cycle keep the last target reached, which is the same in every run.
    """
    m = cut(pairs.where("old IS NOT NULL AND new IS NOT NULL AND old <> new").groupBy("old").agg(F.min("new").alias("canonical")))
    for _ in range(rounds):
        onward = m.select(F.col("old").alias("canonical"), F.col("canonical").alias("further"))
        nxt = m.join(onward, "canonical", "left").select("old", "canonical", F.when(F.col("further") != F.col("old"), F.col("further")).alias("further"))
        nxt = cut(nxt)
        if nxt.where(F.col("further").isNotNull()).isEmpty():
            break
        m = nxt.select("old", F.coalesce("further", "canonical").alias("canonical"))
    return m.select("old", "canonical")


def redirect_edges(edges: DataFrame, redirects: DataFrame, keep: tuple[str, ...] = ("prov:wasDerivedFrom",)) -> DataFrame:
    """Edges with objects redirected to their canonical record, lineage predicates excepted; ``changed`` tells which."""
    r = redirects.select(F.col("old").alias("object_uri"), "canonical")
    j = edges.join(r, "object_uri", "left")
    move = F.col("canonical").isNotNull() & ~F.col("predicate").isin(*keep)
    return j.withColumn("changed", move).withColumn("object_uri", F.when(move, F.col("canonical")).otherwise(F.col("object_uri"))).drop("canonical")
