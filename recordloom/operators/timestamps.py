"""Timestamps of any format, precision and zone to one UTC instant.

Method: every value is tokenised into a character-class *shape mask* (digits
become ``9``, letters ``a``, everything else stays).  Each distinct mask is
compiled once into a parser: the positions of its fields, checked literals and
the rule for its zone.  The recognised masks are a closed, small set (free text
compiles to nothing), so they are broadcast and every row is converted by plain
``substring`` arithmetic inside whole-stage codegen; no row reaches Python.
Local times go through zone transition tables (one array per zone, indexed by
year) built from the tz database whose version `tz_version` reports.
"""

from __future__ import annotations

import datetime as dt
import functools
import importlib.metadata
import re
import zoneinfo
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.common import BLANKS, small_side, staged

# Offsets in minutes of the zone abbreviations in use; None is local time.
ZONE_ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "SAST": 120, "IST": 330, "SGT": 480, "HKT": 480,
    "AWST": 480, "JST": 540, "KST": 540, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660,
    "NZST": 720, "NZDT": 780, "NST": -210, "NDT": -150, "AST": -240, "ADT": -180,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360,
    "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
# Month names by their first three letters (English, German, French, Spanish where they differ).
MONTHS = {
    "JAN": 1, "FEB": 2, "MAR": 3, "APR": 4, "MAY": 5, "JUN": 6, "JUL": 7, "AUG": 8, "SEP": 9, "OCT": 10, "NOV": 11,
    "DEC": 12, "MAI": 5, "OKT": 10, "DEZ": 12, "ENE": 1, "ABR": 4, "AGO": 8, "DIC": 12,
}
WEEKDAYS = "|MON|TUE|WED|THU|FRI|SAT|SUN|"

FIRST_YEAR, LAST_YEAR = 1900, 2100
#: Most offset changes of one zone in one year that the tables hold (Morocco and Egypt reach 4).
CHANGES = 4
#: No mask of the grammar is longer; longer values need no mask.
LONGEST_MASK = 80


def tz_version() -> str:
    """Version of the tz database behind the transition tables."""
    for root in zoneinfo.TZPATH:
        try:
            head = (Path(root) / "tzdata.zi").read_text().split("\n", 1)[0]
            return head.split()[-1]
        except OSError:
            continue
    try:
        return importlib.metadata.version("tzdata")
    except importlib.metadata.PackageNotFoundError:
        return "unknown"


@functools.lru_cache(maxsize=1024)
def zone_years(name: str | None) -> tuple | None:
    """Offsets of a zone by local year: ``(offset at the start, t1, o1, ... t4, o4)``.

    ``t`` is in local seconds: from ``t`` on, offset ``o`` holds.  It is the later of
    the two local readings of the change, so a local time that occurs twice or not
    at all takes the offset in force before the change.  None for an unknown zone.
    """
    try:
        zone = zoneinfo.ZoneInfo(name)
    except (zoneinfo.ZoneInfoNotFoundError, ValueError, TypeError, OSError):
        return None
    utc = dt.timezone.utc

    def offset(t: int) -> int:
        at = dt.datetime(1970, 1, 1, tzinfo=utc) + dt.timedelta(seconds=t)
        return round(at.astimezone(zone).utcoffset().total_seconds())

    start = int(dt.datetime(FIRST_YEAR, 1, 1, tzinfo=utc).timestamp())
    end = int(dt.datetime(LAST_YEAR + 1, 1, 1, tzinfo=utc).timestamp())
    step, changes, t, now = 7 * 86400, [], start, offset(start)
    first = now
    while t < end:
        nxt = offset(t + step)
        if nxt != now:
            lo, hi = t, t + step
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if offset(mid) == now else (lo, mid)
            changes.append((hi + max(now, nxt), nxt))
            now = offset(hi)
            t, now = (t + step, nxt) if now == nxt else (hi, now)
        else:
            t += step
    table, k, now = [], 0, first
    for year in range(FIRST_YEAR, LAST_YEAR + 1):
        till = int(dt.datetime(year + 1, 1, 1, tzinfo=utc).timestamp())
        row = [now]
        while k < len(changes) and changes[k][0] < till:
            row += changes[k]
            now = changes[k][1]
            k += 1
        if len(row) > 1 + 2 * CHANGES:
            raise ValueError(f"{name} changes its offset more than {CHANGES} times in {year}")
        while len(row) < 1 + 2 * CHANGES:
            row += [2**60, now]
        table.append(tuple(row))
    return tuple(table)


_N = r"9{1,2}"
_TIME = rf"(?P<h>{_N}):(?P<mi>99)(?::(?P<s>99)(?:[.,](?P<f>9{{1,9}}))?)?(?: ?(?P<ap>aa)(?![a])|(?P<ap2>a\.a\.))?"
_ZONE = r"(?: ?(?:(?P<off>[+-](?:99:?99|99))|(?P<z>a)|(?P<abbr>aaa{1,3})|\[(?P<iana>[a9_/+-]+)\]))?"
# The date forms, as patterns over masks.  T: a letter that must be T.
_GRAMMAR = [
    ("ymd", re.compile(rf"(?P<y>9999)[-/.](?P<mo>99)[-/.](?P<d>99)(?: +|, ?|(?P<T>a)){_TIME}{_ZONE}")),
    ("ymd", re.compile(rf"(?P<y>9999)(?P<mo>99)(?P<d>99)(?:(?P<T>a)| )?(?P<h>99)(?P<mi>99)(?:(?P<s>99)(?:[.,](?P<f>9{{1,9}}))?)?{_ZONE}")),
    ("source", re.compile(rf"(?P<a>{_N})[/-](?P<b>{_N})[/-](?P<y>9999)(?:,? +){_TIME}{_ZONE}")),
    ("dmy", re.compile(rf"(?P<d>{_N})\.(?P<mo>{_N})\.(?P<y>9999)(?:,? +){_TIME}{_ZONE}")),
    ("dmy", re.compile(rf"(?:(?P<wd>aaa),? )?(?P<d>{_N})[- ](?P<mon>aaa)a*\.?[- ](?P<y>9999)(?:,? +){_TIME}{_ZONE}")),
    ("dmy", re.compile(rf"(?:(?P<wd>aaa),? )?(?P<mon>aaa)a*\.? (?P<d>{_N}),? (?P<y>9999)(?:,? +){_TIME}{_ZONE}")),
    ("epoch_s", re.compile(r"(?P<y>9{10})")),
    ("epoch_ms", re.compile(r"(?P<y>9{13})")),
    ("epoch_us", re.compile(r"(?P<y>9{16})")),
]
_FIELDS = ("y", "mo", "d", "a", "b", "mon", "h", "mi", "s", "f", "ap", "off", "abbr", "z", "T", "wd")
_PLAN_SCHEMA = (
    "shape string, kind string, iana string, zone_years array<struct<o0:bigint,"
    + ",".join(f"t{i}:bigint,o{i}:bigint" for i in range(1, CHANGES + 1))
    + ">>, "
    + ", ".join(f"{f}_at int, {f}_n int" for f in _FIELDS)
)


def compile_mask(mask: str) -> dict | None:
    """The parser of a mask: positions (from 1) and lengths of its fields; None for no instant."""
    for kind, pattern in _GRAMMAR:
        if m := pattern.fullmatch(mask):
            got = m.groupdict()
            plan = {"kind": kind, "iana_given": got.get("iana") is not None}
            for f in _FIELDS:
                at, end = m.span(f) if got.get(f) is not None else (-1, -1)
                if f == "ap" and got.get("ap2") is not None:
                    at, end = m.span("ap2")
                plan[f"{f}_at"], plan[f"{f}_n"] = at + 1, end - at
            return plan
    return None


def _compile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for shape in batch["shape"]:
            mask, _, iana = shape.partition("\x01")
            plan = compile_mask(mask)
            if plan is None:
                continue
            years = zone_years(iana) if plan.pop("iana_given") else None
            if iana and years is None:
                continue  # names a zone that does not exist
            rows.append(plan | {"shape": shape, "iana": iana or None, "zone_years": years and [list(y) for y in years]})
        if rows:
            names = ["o0", *(x for i in range(1, CHANGES + 1) for x in (f"t{i}", f"o{i}"))]
            out = pd.DataFrame(rows)
            out["zone_years"] = out["zone_years"].map(lambda t: None if t is None else [dict(zip(names, y)) for y in t])
            yield out[[c.split()[0] for c in _top_level(_PLAN_SCHEMA)]]


def _top_level(schema: str) -> list[str]:
    parts, depth, cur = [], 0, ""
    for ch in schema:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            parts.append(cur.strip())
            cur = ""
        else:
            cur += ch
    return [*parts, cur.strip()]


def _zones(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["o0", *(x for i in range(1, CHANGES + 1) for x in (f"t{i}", f"o{i}"))]
    for batch in batches:
        batch = batch.copy()
        batch["source_years"] = [
            None if (t := zone_years(z)) is None else [dict(zip(names, y)) for y in t] for z in batch["source_zone"]
        ]
        yield batch


def shape_mask(value: Column) -> Column:
    """Digits to ``9``, ASCII letters to ``a``, the rest as it is."""
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(value, "0123456789" + letters, "9" * 10 + "a" * len(letters))


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date (pure arithmetic, never raises)."""
    yy = y - F.when(m <= 2, 1).otherwise(0)
    era = F.floor(yy / 400)
    yoe = yy - era * 400
    doy = F.floor((F.lit(153) * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    return era * 146097 + yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy - 719468


def normalise(values: DataFrame, sources: DataFrame) -> DataFrame:
    """UTC instants of text timestamps.

    `values`: any columns plus ``value`` (text) and ``source_system``.
    `sources`: ``source_system``, ``zone_name`` (IANA), ``date_order`` (MDY or DMY).
    Returns the rows that denote an instant with ``utc_us`` (microseconds since
    1970-01-01T00:00Z) in place of ``value``; all other columns are kept (but a
    ``utc_us`` among them), whatever they are called.

    Defined results: a null, empty, over-long or unreadable value gives no row; a
    value without zone whose source is null, unknown or has no valid zone gives no
    row; a slash date of a source without order gives no row; repeated rows give
    repeated rows; without a stated offset the year must lie in 1900 to 2100, which the
    zone tables cover.  A hot source or mask needs no shuffle: both sides of the row
    conversion are broadcast dimensions.
    """
    own = [c for c in values.columns if c not in ("value", "utc_us")]
    # Whatever the other columns are called, they travel inside one.
    values = values.select(F.struct(*own).alias("_row"), "source_system", "value")
    keep = ["_row"]
    text = F.btrim("value", F.lit(BLANKS))
    iana = F.regexp_extract("_v", r"\[([A-Za-z0-9_/+-]+)\]$", 1)
    v = (
        values.withColumn("_v", text)
        .where(F.col("_v").isNotNull() & F.length("_v").between(8, LONGEST_MASK))
        .withColumn(
            "_shape",
            F.when(F.col("_v").endswith("]"), F.concat(shape_mask(F.col("_v")), F.lit("\x01"), iana)).otherwise(shape_mask(F.col("_v"))),
        )
    )
    plans = v.select(F.col("_shape").alias("shape")).distinct().mapInPandas(_compile, _PLAN_SCHEMA)
    years_type = _top_level(_PLAN_SCHEMA)[3].split(" ", 1)[1]
    zones = (
        sources.select(F.col("source_system").alias("source_key"), F.col("zone_name").alias("source_zone"), "date_order")
        .dropDuplicates(["source_key"])
        .mapInPandas(_zones, f"source_key string, source_zone string, date_order string, source_years {years_type}")
    )
    # Recognised masks are bounded by the grammar, whatever the data.
    j = v.join(F.broadcast(plans), v["_shape"] == plans["shape"]).join(
        small_side(zones), F.col("source_system") == F.col("source_key"), "left"
    )

    def part(f: str) -> Column:
        return F.when(F.col(f"{f}_n") > 0, F.col("_v").substr(F.col(f"{f}_at"), F.col(f"{f}_n")))

    def num(f: str) -> Column:
        return part(f).try_cast("bigint")

    def lookup(table: dict, key: Column) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)

    mdy = F.col("date_order") == "MDY"
    known_order = F.col("date_order").isin("MDY", "DMY")
    source = F.col("kind") == "source"
    month = F.when(source, F.when(known_order, F.when(mdy, num("a")).otherwise(num("b")))).otherwise(
        F.coalesce(num("mo"), lookup(MONTHS, F.upper(part("mon"))))
    )
    day = F.when(source, F.when(known_order, F.when(mdy, num("b")).otherwise(num("a")))).otherwise(num("d"))
    j = staged(
        j, [*keep, "kind", "zone_years", "source_years"],
        _y=num("y"), _m=month, _d=day, _h=num("h"), _mi=num("mi"), _s=F.coalesce(num("s"), F.lit(0)),
        _f=F.coalesce(F.rpad(F.substring(part("f"), 1, 6), 6, "0").try_cast("bigint"), F.lit(0)),
        _ap=F.upper(F.translate(part("ap"), ".", "")), _off=part("off"), _abbr=F.upper(part("abbr")),
        _z=F.upper(part("z")), _T=F.upper(part("T")), _wd=F.upper(part("wd")),
    )
    leap = (F.col("_y") % 4 == 0) & ((F.col("_y") % 100 != 0) | (F.col("_y") % 400 == 0))
    month_days = F.when(F.col("_m") == 2, F.when(leap, 29).otherwise(28)).when(F.col("_m").isin(4, 6, 9, 11), 30).otherwise(31)
    hour = F.when(F.col("_ap").isNull(), F.col("_h")).when(
        F.col("_ap").isin("AM", "PM") & F.col("_h").between(1, 12),
        F.col("_h") % 12 + F.when(F.col("_ap") == "PM", 12).otherwise(0),
    )
    hour_ok = hour.between(0, 23) | ((hour == 24) & F.col("_ap").isNull() & (F.col("_mi") == 0) & (F.col("_s") == 0) & (F.col("_f") == 0))
    # The zone tables end somewhere; a stated offset holds in any year.
    stated_zone = F.col("_off").isNotNull() | F.col("_z").isNotNull() | (F.col("_abbr").isNotNull() & (F.col("_abbr") != "UHR"))
    valid = (
        (F.col("_y").between(FIRST_YEAR, LAST_YEAR) | ((F.col("_y") > 0) & stated_zone)) & F.col("_m").between(1, 12) & F.col("_d").between(1, month_days)
        & hour_ok & F.col("_mi").between(0, 59) & F.col("_s").between(0, 59)
        & F.coalesce(F.col("_T") == "T", F.lit(True)) & F.coalesce(F.col("_z") == "Z", F.lit(True))
        & F.coalesce(F.instr(F.lit(WEEKDAYS), F.concat(F.lit("|"), F.col("_wd"), F.lit("|"))) > 0, F.lit(True))
    )
    local = _days(F.col("_y"), F.col("_m"), F.col("_d")) * 86400 + hour * 3600 + F.col("_mi") * 60 + F.col("_s")
    digits = F.regexp_replace(F.substring("_off", 2, 5), ":", "")
    off_h, off_m = F.substring(digits, 1, 2).try_cast("bigint"), F.coalesce(F.nullif(F.substring(digits, 3, 2), F.lit("")).try_cast("bigint"), F.lit(0))
    stated = F.when((off_h <= 18) & (off_m <= 59), (off_h * 3600 + off_m * 60) * F.when(F.col("_off").startswith("-"), -1).otherwise(1))
    j = staged(
        j, [*keep, "kind", "_y", "_f", "_abbr", "_z", "_off"],
        _ok=F.col("kind").startswith("epoch") | valid, _local=local, _stated=stated,
        _year=F.get(F.coalesce(F.col("zone_years"), F.col("source_years")), (F.col("_y") - FIRST_YEAR).try_cast("int")),
    ).where("_ok")
    year = F.col("_year")
    ruled = year["o0"]
    for i in range(1, CHANGES + 1):
        ruled = F.when(F.col("_local") >= year[f"t{i}"], year[f"o{i}"]).otherwise(ruled)
    # "Uhr" follows German times and names no zone.
    offset = (
        F.when(F.col("_off").isNotNull(), F.col("_stated"))
        .when(F.col("_z").isNotNull(), F.lit(0))
        .when(F.col("_abbr").isNotNull() & (F.col("_abbr") != "UHR"), lookup(ZONE_ABBREVIATIONS, F.col("_abbr")) * 60)
        .otherwise(ruled)
    )
    epoch = (
        F.when(F.col("kind") == "epoch_s", F.col("_y") * 1_000_000)
        .when(F.col("kind") == "epoch_ms", F.col("_y") * 1_000)
        .when(F.col("kind") == "epoch_us", F.col("_y"))
    )
    utc = F.coalesce(epoch, (F.col("_local") - offset) * 1_000_000 + F.col("_f")).cast("bigint")
    return staged(j, keep, utc_us=utc).where(F.col("utc_us").isNotNull()).select("_row.*", "utc_us")


def _versions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for name in batch["zone_name"]:
            years = zone_years(name)
            rows.append((name, tz_version(), None if years is None else sum(y[1 + 2 * i] < 2**60 for y in years for i in range(CHANGES))))
        yield pd.DataFrame(rows, columns=["zone_name", "tz_version", "n_changes"]).astype({"n_changes": "Int64"})


def zone_summary(sources: DataFrame) -> DataFrame:
    """(zone_name, tz_version, n_changes) of the sources' zones; null changes for a zone that does not exist."""
    return sources.where(F.col("zone_name").isNotNull()).select("zone_name").distinct().mapInPandas(_versions, "zone_name string, tz_version string, n_changes bigint")
