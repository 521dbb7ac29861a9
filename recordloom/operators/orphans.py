"""References to records that do not exist.

Method: skew-aware split.  References are pre-aggregated per key, table and
period.  The few heavy keys (each at least ``1/HEAVY_PARTS`` of all references,
so never more than ``HEAVY_PARTS``) are checked by broadcasting them to the
targets; the remaining keys, now one row per key, table and period, go through a
shuffled anti-join.  Both orphan counts are united.  Where the rows are wanted,
heavy orphan keys find theirs by broadcast, and a bitmap of the light ones (of a
bounded size, whatever their number) sorts out nearly all other rows before anything
moves: the rows of a hot but valid key never do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.common import cut

#: A key with at least this part of all references is heavy; also the most heavy keys there can be.
HEAVY_PARTS = 2000
KEY = ["k1", "k2"]
#: Bits of the bitmap: so many per orphan key, within these bounds (2^26 bits are 8 MB).
BITS_PER_KEY, LEAST_BITS, MOST_BITS = 16, 1 << 12, 1 << 26


def _key(*parts: Column) -> list[Column]:
    """128 bits of a composite key; null if a part is null."""
    whole = F.concat_ws("\x01", *parts)
    known = F.lit(True)
    for p in parts:
        known = known & p.isNotNull()
    return [F.when(known, F.xxhash64(whole, F.lit(salt))).alias(f"k{i}") for i, salt in ((1, "a"), (2, "b"))]


def typed_reference(ref: str, source: str, target_type: str) -> list[Column]:
    """Key of a FHIR reference to `target_type`.

    ``Type/id`` is an id, anything with a scheme a full URL, each within its
    source; a trailing ``/_history/...`` is ignored.  A relative reference to
    another type keeps its type in the key and so meets no target.
    """
    bare = F.regexp_replace(F.col(ref), r"/_history(/.*)?$", "")
    absolute = bare.rlike("^[A-Za-z][A-Za-z0-9+.-]*:")
    form = F.when(absolute, F.lit("url")).otherwise(F.lit("id"))
    value = F.when(absolute, bare).when(bare.startswith(target_type + "/"), F.substring(bare, len(target_type) + 2, 1 << 30)).otherwise(F.concat(F.lit("\x02"), bare))
    return _key(F.lit(target_type), form, F.col(source), value)


def plain_reference(ref: str, space: str) -> list[Column]:
    """Key of a reference by IRI in one space of names, whatever its source."""
    return _key(F.lit(space), F.lit("url"), F.lit(""), F.regexp_replace(F.col(ref), r"/_history(/.*)?$", ""))


def resource_targets(df: DataFrame, resource_type: str, alive: Column | None = None) -> DataFrame:
    """Keys under which the rows of a resource table can be referred to."""
    live = df if alive is None else df.where(alive)
    return live.select(*_key(F.lit(resource_type), F.lit("id"), F.col("source_system"), F.col("resource_id"))).unionByName(
        live.select(*_key(F.lit(resource_type), F.lit("url"), F.col("source_system"), F.col("full_url")))
    )


def iri_targets(df: DataFrame, iri: str, space: str, alive: Column | None = None) -> DataFrame:
    """Keys of records that are referred to by IRI."""
    live = df if alive is None else df.where(alive)
    return live.select(*_key(F.lit(space), F.lit("url"), F.lit(""), F.col(iri)))


class Orphans:
    """Dangling references of `refs` against `targets`.

    `refs`: ``table_name``, ``row_id``, ``reference``, ``period`` (date), ``k1``, ``k2``.
    `targets`: ``k1``, ``k2`` of what is there; repeated keys and null keys do no harm.

    Null, empty and local (``#...``) references are not references.  A reference
    whose key is null (its source is unknown) can point to nothing: it is dangling.
    """

    def __init__(self, refs: DataFrame, targets: DataFrame):
        self.refs = refs.where(F.col("reference").isNotNull() & (F.trim("reference") != "") & ~F.col("reference").startswith("#")).withColumns(
            {"k1": F.coalesce("k1", F.lit(0)), "k2": F.coalesce("k2", F.lit(0))}
        )
        per_key = cut(self.refs.groupBy(*KEY, "table_name", "period").agg(F.count("*").alias("n_references")))
        total = per_key.agg(F.sum("n_references")).first()[0] or 0
        heavy = cut(
            per_key.groupBy(*KEY).agg(F.sum("n_references").alias("n")).where(F.col("n") >= max(2, total / HEAVY_PARTS)).select(*KEY)
        )
        found_heavy = targets.join(F.broadcast(heavy), KEY, "left_semi").distinct()
        self.heavy_orphans = cut(heavy.join(F.broadcast(found_heavy), KEY, "left_anti"))
        light = per_key.join(F.broadcast(heavy), KEY, "left_anti")
        # distinct() leaves the targets partitioned by the key: the anti-join adds no exchange on their side.
        light_orphans = light.join(targets.where(F.col("k1").isNotNull()).distinct(), KEY, "left_anti")
        self.light_counted = cut(light_orphans)
        self.counted = per_key.join(F.broadcast(self.heavy_orphans), KEY, "left_semi").select(*light_orphans.columns).unionByName(self.light_counted)

    def counts(self) -> DataFrame:
        """Orphan references per table and month (``yyyy-MM``)."""
        month = F.date_format("period", "yyyy-MM").alias("period")
        return self.counted.groupBy("table_name", month).agg(F.sum("n_references").alias("n_orphans"), F.count_distinct(*KEY).alias("n_missing_keys"))

    def rows(self) -> DataFrame:
        """Distinct (table_name, row_id, reference) of the orphans."""
        out = ["table_name", "row_id", "reference"]
        by_heavy = self.refs.join(F.broadcast(self.heavy_orphans), KEY, "left_semi").select(*out)
        keys = cut(self.light_counted.select(*KEY).distinct())
        maybe = self.refs.where(_in_bitmap(keys, F.col("k1")))
        return by_heavy.unionByName(maybe.join(keys.hint("shuffle_hash"), KEY, "left_semi").select(*out)).distinct()


def _in_bitmap(keys: DataFrame, key: Column) -> Column:
    """Whether the bit of `key` is set in a bitmap of the ``k1`` of `keys`: never false for one of them."""
    n = max(keys.count(), 1)
    bits = min(max(1 << (n * BITS_PER_KEY - 1).bit_length(), LEAST_BITS), MOST_BITS)
    word = lambda c: F.shiftrightunsigned(c.bitwiseAND(F.lit(bits - 1)), 5)
    set_ = keys.groupBy(word(F.col("k1")).alias("id")).agg(F.bit_or(_shifted(F.col("k1"))).alias("flags"))
    words = keys.sparkSession.range(bits >> 5).join(set_, "id", "left").select("id", F.coalesce("flags", F.lit(0).cast("bigint")).alias("flags"))
    bitmap = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "flags"))), lambda w: w["flags"])).scalar()
    return F.get(bitmap, word(key).cast("int")).bitwiseAND(_shifted(key)) != 0


def _shifted(c: Column) -> Column:
    """The bit of a key within its word (of 32 bits)."""
    flags = F.array(*[F.lit(1 << i).cast("bigint") for i in range(32)])
    return F.get(flags, c.bitwiseAND(F.lit(31)).cast("int"))
