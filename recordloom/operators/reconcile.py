"""Entity reconciliation: blocked matching, greedy grouping, classification, merging.

Pairs are only ever made between representatives: statements that agree in everything a
matcher reads are one representative, with its members kept beside.  A hot block is
thereby no larger than its distinct values.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.common import cut

#: Confidence from which a pair matches.
THRESHOLD = 0.65
#: Rounds of grouping, each of which decides every node whose lower neighbours are decided; long chains are then walked in order.
MOST_ROUNDS = 16


def representatives(df: DataFrame, keys: list[str], ord_: str) -> DataFrame:
    """One row per distinct `keys`: ``rep`` (smallest `ord_`) and ``n_members``."""
    return df.groupBy(*keys).agg(F.min(ord_).alias("rep"), F.count("*").alias("n_members"))


def value_confidence(a: Column, b: Column, tiers: list[tuple[float, float]], without: float, denominator: Column) -> Column:
    """Confidence by relative difference: the first tier that holds it; `without` if a value is missing."""
    diff = F.abs(a - b) / F.greatest(denominator, F.lit(0.001))
    out = F.when(a.isNull() | b.isNull(), without)
    for limit, confidence in tiers:
        out = out.when(diff <= limit, confidence)
    return out


def equi_pairs(reps: DataFrame, block: list[str], source: str, confidence: Column, threshold: float = THRESHOLD) -> DataFrame:
    """(lo, hi, confidence) of representatives that share a block and not the source.

    `confidence` reads columns prefixed ``a_`` and ``b_``.
    """
    a = reps.select(*block, *[F.col(c).alias(f"a_{c}") for c in reps.columns if c not in block])
    b = reps.select(*block, *[F.col(c).alias(f"b_{c}") for c in reps.columns if c not in block])
    pairs = a.join(b, block).where((F.col("a_rep") < F.col("b_rep")) & (F.col(f"a_{source}") != F.col(f"b_{source}")))
    return pairs.select(F.col("a_rep").alias("lo"), F.col("b_rep").alias("hi"), confidence.alias("confidence")).where(F.col("confidence") >= threshold)


def band_pairs(reps: DataFrame, block: list[str], at: str, width: int, source: str, confidence: Column, threshold: float = THRESHOLD) -> DataFrame:
    """As `equi_pairs`, for times (seconds, column `at`) at most `width` apart.

    Time is cut into buckets of `width`; one side looks into its own and both neighbouring
    buckets, so the band join is an equi-join on (block, bucket).
    """
    bucket = F.floor(F.col(at) / width)
    a = reps.withColumn("_b", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    b = reps.withColumn("_b", bucket)
    keys = [*block, "_b"]
    a = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in reps.columns if c not in block])
    b = b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in reps.columns if c not in block])
    near = F.abs(F.col(f"a_{at}") - F.col(f"b_{at}")) <= width
    pairs = a.join(b, keys).where((F.col("a_rep") < F.col("b_rep")) & (F.col(f"a_{source}") != F.col(f"b_{source}")) & near)
    return pairs.select(F.col("a_rep").alias("lo"), F.col("b_rep").alias("hi"), confidence.alias("confidence")).where(F.col("confidence") >= threshold)


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Decide the nodes of rows (block, rep, lo, known) in order of block and rep; holds the seeds of one block."""
    seeds, here, rep, has_seed = set(), None, None, False
    for batch in batches:
        decided = []
        for block, hi, lo, known in batch[["block", "rep", "lo", "known"]].itertuples(index=False, name=None):
            if (block, hi) != (here, rep):
                if here is not None:
                    decided.append((rep, not has_seed))
                    if not has_seed:
                        seeds.add(rep)
                if block != here:
                    seeds = set()
                here, rep, has_seed = block, hi, False
            has_seed = has_seed or known == 1 or known == -1 and lo in seeds
        yield pd.DataFrame(decided, columns=["rep", "is_seed"])
    if here is not None:
        yield pd.DataFrame([(rep, not has_seed)], columns=["rep", "is_seed"])


def greedy_groups(nodes: DataFrame, pairs: DataFrame, block: tuple[str, ...] = ()) -> DataFrame:
    """(rep, seed) of greedy star groups in order of ``rep``; not transitive.

    A node is a seed if no lower match is one, else it joins its lowest matching seed: the
    lexicographically first maximal independent set.  Each round decides the nodes
    without undecided lower matches, and those that already match a seed.  What long
    chains leave undecided is walked in order, each block of `nodes` by itself; no pair
    may cross blocks.
    """
    edges = cut(pairs.select("lo", "hi").distinct())
    state = cut(nodes.select("rep").distinct().join(edges.select(F.col("hi").alias("rep")).distinct(), "rep", "left_anti").select("rep", F.lit(True).alias("is_seed")))
    waiting = cut(edges.select(F.col("hi").alias("rep")).distinct())
    for _ in range(MOST_ROUNDS):
        if waiting.isEmpty():
            break
        lower = edges.withColumnRenamed("hi", "rep").join(waiting, "rep", "left_semi").join(state.select(F.col("rep").alias("lo"), "is_seed"), "lo", "left")
        seen = lower.groupBy("rep").agg(F.bool_or(F.coalesce("is_seed", F.lit(False))).alias("has_seed"), F.bool_or(F.col("is_seed").isNull()).alias("open"))
        decided = cut(seen.where(F.col("has_seed") | ~F.col("open")).select("rep", (~F.col("has_seed")).alias("is_seed")))
        state = cut(state.unionByName(decided))
        waiting = cut(waiting.join(decided, "rep", "left_anti"))
    if not waiting.isEmpty():
        # Blocks whose hashes agree are walked together, which changes nothing.
        blocks = nodes.select("rep", (F.xxhash64(*block) if block else F.lit(0)).alias("block")).distinct().join(waiting, "rep", "left_semi")
        known = state.select(F.col("rep").alias("lo"), F.col("is_seed").cast("int").alias("known"))
        rest = edges.withColumnRenamed("hi", "rep").join(blocks, "rep").join(known, "lo", "left").select("block", "rep", "lo", F.coalesce("known", F.lit(-1)).alias("known"))
        rest = rest.repartition("block").sortWithinPartitions("block", "rep")
        state = cut(state.unionByName(rest.mapInPandas(_walk, f"rep {edges.schema['hi'].dataType.simpleString()}, is_seed boolean")))
    seeds = state.where("is_seed").select(F.col("rep").alias("lo"))
    joined = edges.join(seeds, "lo").groupBy(F.col("hi").alias("rep")).agg(F.min("lo").alias("seed"))
    return state.join(joined, "rep", "left").select("rep", F.when(F.col("is_seed"), F.col("rep")).otherwise(F.col("seed")).alias("seed"))


def classify(members: DataFrame, group: str, ord_: str, value: str, status: str, tolerance: float = 0.05) -> DataFrame:
    """Kind of each group with two members or more, from its first two in order (lower two `ord_`)."""
    firsts = members.groupBy(group).agg(F.count("*").alias("n_members"), F.min(F.struct(ord_, value, status)).alias("a"))
    others = members.join(firsts.select(group, F.col(f"a.{ord_}").alias("_first")), group).where(F.col(ord_) > F.col("_first"))
    seconds = others.groupBy(group).agg(F.min(F.struct(ord_, value, status)).alias("b"))
    j = firsts.join(seconds, group)
    a, b = F.col(f"a.{value}"), F.col(f"b.{value}")
    diff = F.abs(a - b) / F.greatest(F.abs(a), F.lit(0.001))
    kind = (
        F.when(F.col(f"a.{status}") != F.col(f"b.{status}"), "status_conflict")
        .when(diff > tolerance, "value_conflict")
        .when(diff > 0, "near_duplicate")
        .otherwise("exact")
    )
    return j.select(group, "n_members", kind.alias("kind"))


def merge_values(members: DataFrame, group: list[str], rank: Column, fields: list[str]) -> DataFrame:
    """One record per group: each field from the best-ranked member that has it."""
    return members.groupBy(*group).agg(
        F.count("*").alias("n_members"), *[F.min_by(F.col(f), F.when(F.col(f).isNotNull(), rank)).alias(f) for f in fields]
    )


def class_scores(df: DataFrame, predicted: list[str], truth: list[str]) -> DataFrame:
    """Precision and recall of pairs, from class sizes alone: no pair is made."""
    def pairs(n: Column) -> Column:
        return F.sum(n * (n - 1) / 2)

    def total(keys: list[str]) -> DataFrame:
        return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(pairs(F.col("n")))

    counts = total(list(dict.fromkeys([*predicted, *truth]))).toDF("hit").select("hit", total(predicted).scalar().alias("said"), total(truth).scalar().alias("meant"))
    return counts.select(
        F.col("hit").cast("bigint").alias("n_hit"), F.col("said").cast("bigint").alias("n_predicted"), F.col("meant").cast("bigint").alias("n_true"),
        F.round(F.col("hit") / F.nullif("said", F.lit(0.0)), 6).alias("precision"), F.round(F.col("hit") / F.nullif("meant", F.lit(0.0)), 6).alias("recall"),
    )
