"""The best value of each property in a group of duplicate records.

Method: currency reasoning.  Each group's usable statements about a property are
ordered partially: by time where they have one; where they have none, by which
value follows which, learned from the rows with timestamps and closed over chains.
The topologically latest statements remain, and of these the one from the most
trusted source survives.  Which values say only that nothing is known is learned,
too: they stand under properties that have nothing else in common.

Groups may be of any size: the timed order is one aggregation with partial sums,
the learned order meets only groups that have a statement without time, and
successions are read in time buckets whose seams are stitched afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordloom.common import BLANKS, cut, small_side
from recordloom.operators.graph import closure

# Texts that say only that nothing is known (lower case), for tables too small to learn them from.
PLACEHOLDERS = (
    "null", "nil", "nan", "n/a", "na", "n.a.", "n.a", "not applicable", "ni", "unk", "asku", "nask", "nav", "nav.", "msk", "nullflavor",
    "unknown", "not known", "unspecified", "not specified", "undefined", "not provided", "none provided", "none given", "not given",
    "none recorded", "not recorded", "none stated", "not stated", "not available", "unavailable", "not on file", "none on file",
    "not documented", "no data", "no information", "missing", "blank", "empty", "tbd", "to be determined",
    "see chart", "see note", "see notes", "see scan", "see list",
)
#: A value under so large a part of all properties (of so many at least) says nothing about any of them.
SPREAD, LEAST_PROPERTIES = 0.75, 8
#: Longest text that can be such a value.
LONGEST_PLACEHOLDER = 40
#: A succession counts if seen so often, and in so large a part of both directions.
SUPPORT, DOMINANCE = 3, 0.8
#: Trust of a source that is not in the list.
UNTRUSTED = 1 << 30
_GROUP = ["canonical_uri", "predicate"]


def _bare(value: Column) -> Column:
    """Lower case without blanks and brackets around."""
    return F.regexp_replace(F.lower(F.btrim(value, F.lit(BLANKS))), r"^[\[(<{*\s]+|[\])>}*.\s]+$", "")


def usable(value: Column) -> Column:
    """Whether a value says anything by itself: not blank, not only signs, no placeholder, no date of zeros."""
    t, bare = F.lower(F.btrim(value, F.lit(BLANKS))), _bare(value)
    return value.isNotNull() & bare.rlike(r"[\p{L}\p{N}%]") & ~bare.isin(*PLACEHOLDERS) & ~t.isin(*PLACEHOLDERS) & ~bare.rlike(r"^0+([-/.:]0+)+$|^x{2,}$")


def learn_placeholders(stated: DataFrame) -> DataFrame:
    """``key`` (hash) of each value that stands under most properties.

    Properties differ in what they can hold, so a value under most of them is none of
    their values.  Only hashes move, once per value and property of each task.
    """
    short = stated.where(F.length("value") <= LONGEST_PLACEHOLDER).select(F.xxhash64(_bare(F.col("value"))).alias("key"), F.xxhash64("predicate").alias("p"))
    pairs = short.distinct()
    many = pairs.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= F.lit(SPREAD * LEAST_PROPERTIES))
    total = stated.select("predicate").distinct().count()
    return many.where((F.col("n") >= SPREAD * total) & F.lit(total >= LEAST_PROPERTIES)).select("key")


def stated_values(journal: DataFrame) -> DataFrame:
    """One row per non-null value of a member's property, with its place among the member's values."""
    members = journal.select("canonical_uri", F.explode("discarded").alias("m")).where(F.col("canonical_uri").isNotNull())
    props = members.select("canonical_uri", F.col("m.source_system").alias("source_system"), F.col("m.last_updated").alias("at"), F.col("m.uri").alias("uri"), F.explode("m.properties").alias("predicate", "values"))
    values = props.select("canonical_uri", "predicate", "source_system", "at", "uri", F.posexplode("values").alias("place", "v")).select(
        "canonical_uri", "predicate", "source_system", "at", "uri", "place", F.col("v.value").alias("value")
    )
    return values.where(F.col("value").isNotNull())


def statements(journal: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per usable statement of a member about a property.

    Of several values in one member's property each usable one is a statement; ``place``
    keeps their order.
    """
    values = stated_values(journal)
    trust = sources.groupBy(F.col("source_system").alias("t_source")).agg(F.min("trust_rank").alias("trust"))
    said = values.where(usable(F.col("value"))).join(small_side(trust), F.col("source_system") == F.col("t_source"), "left")
    empty = small_side(learn_placeholders(values))
    said = said.withColumn("key", F.xxhash64(_bare(F.col("value")))).join(empty, "key", "left_anti")
    return said.select(*_GROUP, "value", "at", "uri", "place", F.coalesce("trust", F.lit(UNTRUSTED)).cast("bigint").alias("trust"))


def learn_precedence(said: DataFrame) -> DataFrame:
    """(predicate, earlier, later) value pairs of which the second follows the first.

    Successions are read per group, property and month, then between the months, so
    that no task holds more of a large group than one month of it.
    """
    month = F.date_format("at", "yyyyMM").cast("int")
    timed = said.where(F.col("at").isNotNull()).groupBy(*_GROUP, month.alias("month"), "at").agg(F.min(F.struct("trust", "place", "value"))["value"].alias("value"))
    inner = W.partitionBy(*_GROUP, "month").orderBy("at")
    within = timed.select(*_GROUP, F.lag("value").over(inner).alias("earlier"), F.col("value").alias("later")).where(F.col("earlier").isNotNull())
    seams = timed.groupBy(*_GROUP, "month").agg(F.min(F.struct("at", "value"))["value"].alias("first"), F.max(F.struct("at", "value"))["value"].alias("last"))
    outer = W.partitionBy(*_GROUP).orderBy("month")
    between = seams.select(*_GROUP, F.lag("last").over(outer).alias("earlier"), F.col("first").alias("later")).where(F.col("earlier").isNotNull())
    steps = within.unionByName(between).where(F.col("earlier") != F.col("later")).groupBy("predicate", "earlier", "later").agg(F.count("*").alias("n"))
    steps = cut(steps.where(F.col("n") >= 1))
    back = steps.select("predicate", F.col("later").alias("earlier"), F.col("earlier").alias("later"), F.col("n").alias("n_back"))
    return (
        steps.where(F.col("n") >= SUPPORT)
        .join(back, ["predicate", "earlier", "later"], "left")
        .where(F.col("n") >= DOMINANCE * (F.col("n") + F.coalesce("n_back", F.lit(0))))
        .select("predicate", "earlier", "later")
    )


def latest_by_precedence(candidates: DataFrame, precedence: DataFrame) -> DataFrame:
    """``candidates`` (group columns, ``value``, ...) without those that another of their group comes after.

    The learned order is closed over its chains, so a value may be superseded through
    values that the group does not have.  Two values that come after each other decide nothing.
    """
    wanted = small_side(candidates.select("predicate").distinct())
    node = lambda c: F.struct("predicate", F.col(c).alias("value"))
    steps = precedence.join(wanted, "predicate", "left_semi").select(node("earlier").alias("child"), node("later").alias("parent"))
    reach = closure(steps).select(F.col("child.predicate").alias("predicate"), F.col("child.value").alias("value"), F.col("ancestor.value").alias("later")).where(F.col("value") != F.col("later"))
    reach = cut(reach)
    circular = reach.select("predicate", F.col("later").alias("value"), F.col("value").alias("later"))
    order = small_side(reach.join(circular, ["predicate", "value", "later"], "left_anti"))
    superseded = (
        candidates.select(*_GROUP, "value").join(order, ["predicate", "value"])
        .join(candidates.select(*_GROUP, F.col("value").alias("later")), [*_GROUP, "later"], "left_semi")
        .select(*_GROUP, "value").distinct()
    )
    return candidates.join(superseded, [*_GROUP, "value"], "left_anti")


def survivors(journal: DataFrame, sources: DataFrame) -> DataFrame:
    """(canonical_uri, predicate, surviving_value): one row per property with a usable value.

    Defined results: null groups give no row; members without properties state
    nothing; merges journaled twice count once; statements of equal rank go by
    place in the member, then by member, then by value; if learned precedence runs
    in a circle it decides nothing between the values of the circle.
    """
    said = statements(journal, sources)
    # Where all statements have a time the latest are those of the latest time: one aggregation, most of it before the shuffle.
    rank = F.struct((-F.unix_micros(F.col("at").cast("timestamp"))).alias("age"), "trust", "place", "uri", "value")
    heads = cut(
        said.groupBy(*_GROUP).agg(
            F.min(F.when(F.col("at").isNotNull(), rank)).alias("head"),
            F.bool_or(F.col("at").isNull()).alias("loose"),
        )
    )
    timed = heads.where("NOT loose").select(*_GROUP, F.col("head.value").alias("surviving_value"))
    loose = heads.where("loose")
    if loose.isEmpty():
        return timed
    # Groups with statements out of time: the latest timed one and these are the candidates.
    untimed = said.where(F.col("at").isNull()).groupBy(*_GROUP, "value").agg(F.min(F.struct("trust", "place", "uri")).alias("rank"))
    first = loose.where("head IS NOT NULL").select(*_GROUP, F.col("head.value").alias("value"), F.struct("head.trust", "head.place", "head.uri").alias("rank"))
    candidates = cut(untimed.unionByName(first).groupBy(*_GROUP, "value").agg(F.min("rank").alias("rank")))
    latest = latest_by_precedence(candidates, learn_precedence(said))
    chosen = latest.groupBy(*_GROUP).agg(F.min(F.struct("rank", "value"))["value"].alias("surviving_value"))
    return timed.unionByName(chosen)
