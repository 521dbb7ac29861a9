"""Content-addressed identity: hashes as keys, all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def deterministic_uuid(seed: Column) -> Column:
    """SHA-1 of the seed laid out as a name-based UUID (version 5)."""
    h = F.sha1(seed)
    variant = F.lpad(F.lower(F.hex((F.conv(F.substring(h, 17, 2), 16, 10).cast("bigint").bitwiseAND(63)).bitwiseOR(128))), 2, "0")
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 19, 2), F.lit("-"), F.substring(h, 21, 12)
    )


def content_uri(kind: str, **parts: Column) -> Column:
    """``urn:uuid:`` of the named parts, sorted by name; null parts are left out."""
    pieces = [F.when(c.isNotNull(), F.concat(F.lit(f"{n}="), c)) for n, c in sorted(parts.items())]
    return F.concat(F.lit("urn:uuid:"), deterministic_uuid(F.concat_ws("|", F.lit(kind), *pieces)))


def digest24(canonical: Column) -> Column:
    """First 24 bytes of SHA-512 as URL-safe base64."""
    return F.translate(F.base64(F.substring(F.unhex(F.sha2(canonical, 512)), 1, 24)), "+/", "-_")


def property_fingerprint(properties: Column, ignore: tuple[str, ...] = ()) -> Column:
    """SHA-256 over the sorted (predicate, value, datatype) of a property map, without `ignore`.

    Repeated values count once; a null map has the fingerprint of an empty record.
    """
    entries = F.filter(F.map_entries(properties), lambda e: ~e["key"].isin(*ignore)) if ignore else F.map_entries(properties)
    flat = F.flatten(
        F.transform(
            F.coalesce(entries, F.array().cast("array<struct<key:string,value:array<struct<value:string,datatype:string,is_iri:boolean>>>>")),
            lambda e: F.transform(
                F.coalesce(e["value"], F.array().cast("array<struct<value:string,datatype:string,is_iri:boolean>>")),
                lambda v: F.concat_ws("\x00", e["key"], F.coalesce(v["value"], F.lit("")), F.coalesce(v["datatype"], F.lit(""))),
            ),
        )
    )
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(flat)), "\x01"), 256)
