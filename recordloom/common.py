"""Shared plumbing: table access, proven-size broadcasts, durable lineage cuts."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes up to which a side may be broadcast.  A side beyond either still
#: works: the join is then left to Catalyst (sort-merge, AQE skew split).
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20

#: Characters stripped around values: blanks, tabs, line ends, no-break space, BOM.
BLANKS = " \t\r\n ﻿"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _is_table(df: DataFrame) -> bool:
    """Whether `df` is a scan of files (or of a checkpoint) with cheap projections on top."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.children().size() == 1 and plan.nodeName() in ("Project", "Filter", "SubqueryAlias", "LocalLimit", "GlobalLimit"):
        plan = plan.children().head()
    return plan.children().isEmpty()


def _bytes(df: DataFrame) -> Column:
    """Bytes of a row: strings as long as they are, 16 for anything of fixed size, other types by their text."""
    size = F.lit(0)
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(c), F.lit(0)) + 16
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
        else:
            size = size + 16
    return size


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """`df` hinted for broadcast if it has at most `rows` rows and `size` bytes, else as it is.

    Anything but a plain table is computed once, into the checkpoint folder, and measured
    there, so neither the check nor the several uses of the side compute it again.
    """
    side = df if _is_table(df) else cut(df)
    n, b = side.limit(rows + 1).agg(F.count("*"), F.sum(_bytes(side))).first()
    return F.broadcast(side) if n <= rows and (b or 0) <= size else side


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; a temporary one only where none is configured and all runs in one process."""
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="recordloom-checkpoint-")
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` once in the shared checkpoint folder (survives lost executors)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """`df` in a few parts per core of the cluster, for steps that compute much on few bytes."""
    return df.repartition(max(3 * df.sparkSession.sparkContext.defaultParallelism, 1), *keys)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a working table, inside the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{os.urandom(8).hex()}"


def trimmed(col) -> F.Column:
    """The value without surrounding blanks of any kind."""
    return F.btrim(F.col(col) if isinstance(col, str) else col, F.lit(BLANKS))


def staged(df: DataFrame, keep: list[str], **columns) -> DataFrame:
    """`keep` plus `columns`, computed once.

    A one-element generator stands between the stages: without it the optimiser
    inlines a column into each of its uses (and into pushed filters), and wide
    parsers outgrow the 64 KB a generated method may have.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
