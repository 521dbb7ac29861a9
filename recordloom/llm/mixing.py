"""Documents of several sources mixed to target shares of the total size.

Method: iterative proportional fitting.  The tokens of each (source, language,
topic) cell are raked to the marginals of source, language and topic; the weight
of a cell is how often its documents are wanted.  Weights above a source's
repeat limit are cut and the loss is spread over the source's other cells.  Then
documents are drawn with these calibrated expectations: the whole part of a weight
is repeated, the fraction is drawn systematically over the cell in order of size,
so the shares are met up to about one document a source, not just on average.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordloom.common import cut, small_side

#: The table of cells is small by nature; more of them are refused, not cut.
MOST_CELLS = 500_000
#: Passes of the fitting, and the relative error that ends it.
PASSES, TOLERANCE = 200, 1e-9
#: Language and topic marginals: the natural share to this power (1: as the sources have them).
LANGUAGE_POWER, TOPIC_POWER = 0.9, 1.0
#: Size classes per doubling, and documents of a class that are ordered together.
CLASSES, SLICE_ROWS = 4, 20_000
_CELL = ["source", "language", "topic"]


def rake(cells: pd.DataFrame, targets: pd.DataFrame, language_power: float = LANGUAGE_POWER, topic_power: float = TOPIC_POWER) -> pd.DataFrame:
    """Weight of each cell: how often each of its tokens is wanted.

    `cells`: source, language, topic, tokens.  `targets`: source, target_share, max_repeats.
    The total is the largest at which every source can reach its share within its
    repeats.  Marginals that cannot all hold give way to the sources', fitted last.
    """
    c = cells.merge(targets, on="source", how="left")
    c["target_share"] = c["target_share"].fillna(0.0)
    c["max_repeats"] = c["max_repeats"].fillna(0)
    have = c.groupby("source")["tokens"].transform("sum")
    live = (c["target_share"] > 0) & (c["max_repeats"] > 0) & (c["tokens"] > 0)
    if not live.any():
        return c.assign(weight=0.0)
    share = c["target_share"] / c.loc[live].drop_duplicates("source")["target_share"].sum()
    total = (have * c["max_repeats"] / share)[live].min()
    want = np.where(live, share * total, 0.0)
    x = np.where(live, want * c["tokens"] / have, 0.0)
    margins = []
    for col, power in (("language", language_power), ("topic", topic_power)):
        natural = pd.Series(x).groupby(c[col].values).sum()
        wished = natural**power
        margins.append((c[col].values, (wished / wished.sum() * natural.sum())))
    most = np.where(live, c["max_repeats"] * c["tokens"], 0.0)
    source = c["source"].values
    per_source = pd.Series(want).groupby(source).first()
    for _ in range(PASSES):
        before = x.copy()
        for keys, wished in margins:
            got = pd.Series(x).groupby(keys).sum()
            factor = (wished / got.where(got > 0)).fillna(0.0)
            x = x * factor.reindex(keys).values
        for _ in range(20):  # to the source's total, never above what its repeats allow
            x = np.minimum(x, most)
            got = pd.Series(x).groupby(source).sum()
            free = pd.Series(np.where(x < most, x, 0.0)).groupby(source).sum()
            lack = (per_source - got).reindex(source).values
            room = free.reindex(source).values
            if np.all(np.abs(lack) <= TOLERANCE * np.maximum(want, 1)) or not np.any((np.abs(lack) > 0) & (room > 0)):
                break
            with np.errstate(divide="ignore", invalid="ignore"):
                grow = np.where((room > 0) & (x < most), 1 + lack / room, 1.0)
            x = x * np.maximum(grow, 0.0)
        x = np.minimum(x, most)
        if np.max(np.abs(x - before)) <= TOLERANCE * max(total, 1):
            break
    with np.errstate(divide="ignore", invalid="ignore"):
        c["weight"] = np.where(live, np.minimum(x / c["tokens"], c["max_repeats"]), 0.0)
    return c


def mix(sized: DataFrame, targets: DataFrame, seed: int = 0, **powers: float) -> DataFrame:
    """(doc_id, source, n_tokens, repeats) of every chosen document.

    `sized`: ``doc_id``, ``source``, ``language``, ``topic``, ``n_tokens``.  `targets`:
    ``source``, ``target_share``, ``max_repeats``.  Documents without tokens, of no
    source, or of a source that is not wanted are not chosen; null languages and
    topics are cells of their own; targets given twice count once (the larger).
    """
    spark = sized.sparkSession
    docs = cut(
        sized.where((F.col("n_tokens") > 0) & F.col("source").isNotNull()).select(
            "doc_id", "source", F.coalesce("language", F.lit("?")).alias("language"), F.coalesce("topic", F.lit("?")).alias("topic"), "n_tokens"
        )
    )
    cells = docs.groupBy(*_CELL).agg(F.sum("n_tokens").alias("tokens")).limit(MOST_CELLS + 1).toPandas()
    if len(cells) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells of source, language and topic")
    wanted = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    wanted = wanted.limit(MOST_CELLS + 1).toPandas()
    fitted = rake(cells, wanted, **powers)[[*_CELL, "weight"]]
    weights = spark.createDataFrame(fitted.values.tolist(), "source string, language string, topic string, weight double")
    draw = F.xxhash64("doc_id", F.lit(seed))
    d = docs.join(F.broadcast(weights.where("weight > 0")), _CELL).select(
        "doc_id", "source", "language", "topic", "n_tokens", F.floor("weight").alias("whole"), (F.col("weight") - F.floor("weight")).alias("part"),
        F.floor(F.log2("n_tokens") * CLASSES).alias("class"), draw.alias("draw"),
    )
    # Cells times sizes: as many rows as there are cells, times a few dozen.
    counts = d.groupBy("source", "language", "topic", "class").agg(F.ceil(F.count("*") / SLICE_ROWS).alias("n_slices"))
    d = d.join(small_side(counts), ["source", "language", "topic", "class"]).withColumn("slice", F.pmod("draw", "n_slices"))
    # Running sum of the fractions in order of cell and size.  It is taken in two steps, over the
    # classes (few) and inside their slices, so that no task orders a whole source.
    strata = ["source", "language", "topic", "class", "slice"]
    sums = cut(d.groupBy(*strata).agg(F.sum("part").alias("sum")))
    order = W.partitionBy("source").orderBy("language", "topic", "class", "slice")
    offsets = sums.select(*strata, (F.sum("sum").over(order) - F.col("sum") + F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(1000)) / 1000.0).alias("offset"))
    inner = W.partitionBy(*strata).orderBy("n_tokens", "draw", "doc_id")
    run = F.sum("part").over(inner.rowsBetween(W.unboundedPreceding, 0))
    placed = d.withColumn("run", run).join(offsets, strata)
    after, before = F.round(F.col("offset") + F.col("run"), 9), F.round(F.col("offset") + F.col("run") - F.col("part"), 9)
    chosen = placed.withColumn("repeats", (F.col("whole") + F.floor(after) - F.floor(before)).cast("int"))
    return chosen.where(F.col("repeats") > 0).select("doc_id", "source", "n_tokens", "repeats")


def shares(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """Shares reached by each wanted source."""
    got = chosen.groupBy("source").agg(
        F.count("*").alias("n_documents"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("repeats_used")
    )
    total = got.agg(F.sum("tokens")).scalar()
    wanted = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    return (
        wanted.join(got, "source", "left")
        .select(
            "source", "target_share", F.round(F.coalesce("tokens", F.lit(0)) / total, 6).alias("reached_share"),
            F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
            "max_repeats", F.coalesce("repeats_used", F.lit(0)).alias("repeats_used"),
        )
    )
