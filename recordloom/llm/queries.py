"""Queries of the text operators over the driver's tables, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recordloom.common import read
from recordloom.llm import canonical, history, mixing, packing, survivor, tokens, truncation


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Inputs that state an accepted record again, in two waves of batches."""
    return history.find_repeats(spark, read(spark, sf, "recon_inputs"), read(spark, sf, "import_reports"), waves=2)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """The drug of the reference list that each medication text names."""
    return canonical.canonicalise(read(spark, sf, "medications"), read(spark, sf, "med_terms"), "med_id", "medication_text")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """The surviving value of each property of each merged group."""
    return survivor.survivors(read(spark, sf, "merge_journal"), read(spark, sf, "source_systems"))


def _sized(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "source", "lang", "doc_type", "text")
    return tokens.with_sizes(docs).withColumnsRenamed({"lang": "language", "doc_type": "topic"})


def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Containers of 2048 tokens with their fill."""
    return packing.containers(packing.pack(_sized(spark, sf)))


def p8_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Which piece of which document lies in which container."""
    return packing.pack(_sized(spark, sf))


def p9_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Documents chosen for the mixture, with their repeats."""
    return mixing.mix(_sized(spark, sf), read(spark, sf, "mix_targets"))


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of the total that the sources reach."""
    targets = read(spark, sf, "mix_targets")
    return mixing.shares(mixing.mix(_sized(spark, sf), targets), targets)


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.judged(read(spark, sf, "documents").select("doc_id", "source", "text"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that were cut off."""
    return _judged(spark, sf).where("is_cut").select("doc_id")


def p10_rates(spark: SparkSession, sf: str) -> DataFrame:
    """How often each source cuts its documents."""
    return truncation.rates(_judged(spark, sf))


def p10_limits(spark: SparkSession, sf: str) -> DataFrame:
    """Hidden field limits of the sources."""
    return truncation.field_limits(read(spark, sf, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p3_found": p3_found,
    "p7_found": p7_found,
    "p8_containers": p8_containers,
    "p8_pieces": p8_pieces,
    "p9_sample": p9_sample,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_rates": p10_rates,
    "p10_limits": p10_limits,
}
#: Where every statement has a time, the learned order is not asked and SQL can say the same.
ORACLE_SQL: dict[str, str] = {
    "p7_found": r"""WITH m AS (SELECT canonical_uri, unnest(discarded) AS d FROM merge_journal WHERE canonical_uri IS NOT NULL),
    v AS (SELECT canonical_uri, src, stamp, uri, e.key AS predicate, unnest(e.value) AS x, generate_subscripts(e.value, 1) AS place FROM (SELECT canonical_uri, d.source_system AS src, d.last_updated AS stamp, d.uri AS uri, unnest(map_entries(d.properties)) AS e FROM m)),
    u AS (SELECT canonical_uri, predicate, x.value AS value, src, stamp, uri, place, trim(regexp_replace(lower(trim(x.value)), '^[\[(<{*\s]+|[\])>}*.\s]+$', '', 'g')) AS bare FROM v WHERE x.value IS NOT NULL),
    w AS (SELECT * FROM u WHERE regexp_matches(bare, '[\p{L}\p{N}%]') AND NOT regexp_matches(bare, '^0+([-/.:]0+)+$|^x{2,}$') AND bare NOT IN ('unknown', 'unk', 'see chart', 'not on file', 'asku', 'ni', 'none given', 'null', 'not provided', 'tbd', 'n/a'))
    SELECT canonical_uri, predicate, arg_min(value, {'age': -epoch_us(stamp), 'trust': coalesce(trust_rank, 1073741824), 'place': place, 'uri': uri, 'value': value}) AS surviving_value FROM w LEFT JOIN source_systems ON source_system = src GROUP BY canonical_uri, predicate""",
}
