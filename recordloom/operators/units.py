"""Quantities in different units to the common unit of their measure.

Method: the distinct spellings (per measure) are mapped through a character
n-gram inverted index over the known spellings of the measure's units; the few
candidates that share n-grams are verified by a weighted edit distance, in which
case, blanks and punctuation are cheap and letters and digits are dear.  The
resulting alias dictionary is joined to all rows, which are then converted by
decimal arithmetic in the JVM.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.common import BLANKS, small_side, staged

# Known spellings of units by quantity, each with its size in a base unit: value * num / den + add.
# M stands for the molar mass in g/mol.  The base is the first unit's.
CATALOGUE: dict[str, list[tuple[str, str, str, list[str]]]] = {
    "rate": [
        ("1", "1", "0", ["/min", "{beats}/min", "beats/min", "beats per minute", "per minute", "bpm", "1/min", "min-1"]),
        ("60", "1", "0", ["Hz", "hertz", "/s", "per second", "beats/s"]),
    ],
    "pressure": [
        ("1", "1", "0", ["mm[Hg]", "mmHg", "mm Hg", "millimeters of mercury", "millimetres of mercury", "torr"]),
        ("1000000", "133322.387415", "0", ["kPa", "kilopascal", "kilopascals"]),
        ("10", "133.322387415", "0", ["hPa", "mbar", "hectopascal"]),
        ("1", "133.322387415", "0", ["Pa", "pascal"]),
    ],
    "temperature": [
        ("1", "1", "0", ["Cel", "C", "°C", "degC", "deg C", "celsius", "degrees celsius", "degrees C", "centigrade"]),
        ("5", "9", "-32", ["[degF]", "F", "°F", "degF", "deg F", "fahrenheit", "degrees fahrenheit", "degrees F"]),
        ("1", "1", "-273.15", ["K", "kelvin", "kelvins"]),
    ],
    "mass": [
        ("1", "1", "0", ["kg", "kgs", "kilogram", "kilograms", "kilo", "kilos"]),
        ("1", "1000", "0", ["g", "gm", "gram", "grams"]),
        ("0.45359237", "1", "0", ["[lb_av]", "lb", "lbs", "pound", "pounds"]),
        ("0.028349523125", "1", "0", ["[oz_av]", "oz", "ounce", "ounces"]),
        ("6.35029318", "1", "0", ["[stone_av]", "st", "stone", "stones"]),
    ],
    "length": [
        ("1", "1", "0", ["cm", "cms", "centimeter", "centimeters", "centimetre", "centimetres"]),
        ("100", "1", "0", ["m", "meter", "meters", "metre", "metres"]),
        ("1", "10", "0", ["mm", "millimeter", "millimeters", "millimetre", "millimetres"]),
        ("2.54", "1", "0", ["[in_i]", "in", "inch", "inches", '"']),
        ("30.48", "1", "0", ["[ft_i]", "ft", "foot", "feet", "'"]),
    ],
    "volume": [
        ("1", "1", "0", ["mL", "cc", "cm3", "milliliter", "milliliters", "millilitre", "millilitres"]),
        ("10", "1", "0", ["cL", "centiliter", "centiliters"]),
        ("100", "1", "0", ["dL", "deciliter", "deciliters"]),
        ("1000", "1", "0", ["L", "liter", "liters", "litre", "litres"]),
        ("1", "1000", "0", ["uL", "mcL", "microliter", "microliters"]),
        ("29.5735295625", "1", "0", ["[foz_us]", "fl oz", "fluid ounce", "fluid ounces"]),
    ],
    "ratio": [
        ("1", "1", "0", ["%", "percent", "pct", "per cent", "% SpO2", "%{O2}", "%{HbA1c}", "% NGSP"]),
        ("100", "1", "0", ["1", "fraction", "ratio"]),
    ],
    # IFCC to NGSP: % = 0.09148 * (mmol/mol) + 2.152, here as (x + 2.152 / 0.09148) * 0.09148.
    "glycation": [
        ("1", "1", "0", ["%", "percent", "pct", "per cent", "% NGSP", "%{HbA1c}", "% DCCT", "% Hb"]),
        ("0.09148", "1", "IFCC", ["mmol/mol", "mmol/mol Hb", "mmol/mol IFCC"]),
        ("100", "1", "0", ["1", "fraction", "ratio"]),
    ],
    "mass_concentration": [
        ("1", "1", "0", ["mg/dL", "mg%", "mg per dL", "mg/100mL", "mg/100 mL", "milligrams per deciliter"]),
        ("1000", "1", "0", ["g/dL", "g%", "gm/dL", "g per dL", "g/100mL", "grams per deciliter"]),
        ("100", "1", "0", ["g/L", "gm/L", "g per L", "mg/mL", "grams per liter"]),
        ("1", "10", "0", ["mg/L", "mg per L", "ug/mL", "mcg/mL", "milligrams per liter"]),
        ("1", "1000", "0", ["ug/dL", "mcg/dL", "microgram/dL"]),
        ("M", "10", "0", ["mmol/L", "mM", "mmol per L", "millimol/L", "millimoles per liter"]),
        ("M", "10000", "0", ["umol/L", "mcmol/L", "micromol/L", "uM", "micromoles per liter"]),
    ],
    "monovalent_concentration": [
        ("1", "1", "0", ["mmol/L", "mM", "mmol per L", "mEq/L", "meq per L", "milliequivalents per liter", "millimoles per liter"]),
        ("1", "1000", "0", ["umol/L", "mcmol/L", "micromol/L", "uM"]),
    ],
    "cell_count": [
        ("1", "1", "0", ["10*3/uL", "x10^3/uL", "10^3/uL", "x10E3/uL", "K/uL", "thou/mcL", "thou/uL", "thousand/uL", "10*9/L", "10^9/L", "x10^9/L", "x10E9/L", "G/L", "K/mm3"]),
        ("1", "1000", "0", ["/uL", "{cells}/uL", "cells/uL", "cells/mcL", "/mcL", "/mm3", "cells/mm3", "/cmm", "cells per microliter"]),
        ("1000", "1", "0", ["10*6/uL", "x10^6/uL", "M/uL", "10*12/L", "x10E12/L"]),
    ],
}
IFCC_SHIFT = Decimal("2.152") / Decimal("0.09148")

# Words that lead to the unit of the result in a note, and as many words after them as TAIL_WORDS.
CUES = r"(?i)(?:\bunits?\s*[:=]|\buom\s*[:=]|\breported in\b|\bresults? in\b|\brecorded in\b|\bmeasured in\b|\bexpressed in\b|\bgiven in\b|\bvalue (?:is|was)(?: in)?\b)\s*(?=(\S+(?:\s+\S+){0,3}))"
# Units of two-part readings, as 5 ft 8 in.
COMPOUND = r"^(?i)(ft|feet|foot|'|lb|lbs|pounds?|st|stones?)\.?\s*([0-9]+(?:[.,][0-9]+)?)\s*([^0-9].*)$"

#: Cost of an edit: letters and digits 1, case 0.01, blanks and punctuation 0.05.
CASE_COST, BLANK_COST = 0.01, 0.05
#: Accepted distance as a part of the spelling's length.
TOLERANCE = 0.08
#: Letters from which a unit written as a word may have one wrong letter.
SPELLED = 6
#: No longer text can lie within the tolerance of a known spelling, tail words included.
LONGEST = 96
#: A unit in running text has so many words at most.
TAIL_WORDS = 4

_UNIT = "num string, den string, add string"


def quantity_of(common_unit: str | None, display: str | None) -> str | None:
    """The kind of quantity whose catalogue holds `common_unit`."""
    if common_unit is None:
        return None
    if common_unit == "%" and display and re.search(r"a1c|glyc", display, re.I):
        return "glycation"
    for quantity, units in CATALOGUE.items():
        if quantity == "monovalent_concentration" or any(common_unit in names for *_, names in units):
            if quantity == "mass_concentration" and common_unit == "mmol/L":
                continue
            if quantity == "monovalent_concentration" and common_unit not in units[0][3]:
                continue
            return quantity
    return None


def _plain(text: str) -> str:
    text = unicodedata.normalize("NFKC", text).replace("µ", "u").replace("μ", "u")
    return " ".join(text.split())


@functools.lru_cache(maxsize=64)
def _index(quantity: str) -> tuple[list[tuple[str, int]], dict[str, list[int]]]:
    """Known spellings with their unit, and the n-gram inverted index over them."""
    spellings = [(name, u) for u, (*_, names) in enumerate(CATALOGUE[quantity]) for name in names]
    grams: dict[str, list[int]] = defaultdict(list)
    for i, (name, _) in enumerate(spellings):
        for gram in _grams(name):
            grams[gram].append(i)
    return spellings, grams


def _grams(text: str) -> set[str]:
    t = "^" + re.sub(r"[^0-9a-z%\"'°/]", "", _plain(text).lower()) + "$"
    return {t[i : i + 2] for i in range(len(t) - 1)}


def distance(a: str, b: str) -> float:
    """Weighted edit distance of two spellings."""

    def drop(c: str) -> float:
        return 1.0 if c.isalnum() or c in "%/\"'°" else BLANK_COST

    def swap(x: str, y: str) -> float:
        return 0.0 if x == y else CASE_COST if x.lower() == y.lower() else max(drop(x), drop(y))

    before, row = None, [0.0]
    for y in b:
        row.append(row[-1] + drop(y))
    for i, x in enumerate(a):
        nxt = [row[0] + drop(x)]
        for j, y in enumerate(b):
            least = min(row[j + 1] + drop(x), nxt[j] + drop(y), row[j] + swap(x, y))
            if i and j and x == b[j - 1] and a[i - 1] == y:  # neighbours in the wrong order
                least = min(least, before[j - 1] + max(drop(x), drop(y)))
            nxt.append(least)
        before, row = row, nxt
    return row[-1]


@functools.lru_cache(maxsize=200_000)
def match_unit(quantity: str, spelling: str) -> int | None:
    """Number of the unit of `quantity` that `spelling` means; None if it is none or undecided."""
    text = _plain(spelling).strip(" .,;:()")
    if not text or len(text) > LONGEST:
        return None
    spellings, grams = _index(quantity)
    shared: dict[int, int] = defaultdict(int)
    for gram in _grams(text):
        for i in grams.get(gram, ()):
            shared[i] += 1
    best: dict[int, float] = {}
    near: set[int] = set()
    for i, n in shared.items():
        name, unit = spellings[i]
        if 2 * n < len(_grams(name)):
            continue
        d = distance(text, name)
        if d <= TOLERANCE * max(len(text), len(name)) + CASE_COST:
            best[unit] = min(d, best.get(unit, 9e9))
        if d < 2 and min(len(text), len(name)) >= SPELLED and (text + name).replace(" ", "").isalpha():
            near.add(unit)
    if not best and len(near) == 1:  # a word with one wrong letter, where no other unit is as near
        return near.pop()
    ranked = sorted(best.items(), key=lambda kv: kv[1])
    if not ranked or len(ranked) > 1 and ranked[0][1] == ranked[1][1]:
        return None
    return ranked[0][0]


def match_tail(quantity: str, tail: str) -> int | None:
    """Unit at the beginning of running text: the longest run of words that is one; of several lines the first that has one."""
    for line in tail.split("\n"):
        words = line.split()
        for n in range(min(TAIL_WORDS, len(words)), 0, -1):
            unit = match_unit(quantity, " ".join(words[:n]))
            if unit is not None:
                return unit
    return None


def _map_spellings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for code, spelling, tail, common, display, molar in batch[["code", "spelling", "tail", "common_unit", "display", "molar_mass"]].itertuples(index=False):
            quantity = quantity_of(common, display)
            if quantity is None:
                continue
            unit = match_tail(quantity, spelling) if tail else match_unit(quantity, spelling)
            target = match_unit(quantity, common)
            if unit is None or target is None:
                continue
            num, den, add, _ = CATALOGUE[quantity][unit]
            tnum, tden, _, _ = CATALOGUE[quantity][target]
            if num == "M":
                if molar is None or pd.isna(molar):
                    continue
                num = str(Decimal(str(molar)))
            # value * num / den is in base units; tnum / tden base units make one common unit.
            n, d = Decimal(num) * Decimal(tden), Decimal(den) * Decimal(tnum)
            shift = IFCC_SHIFT if add == "IFCC" else Decimal(add)
            rows.append((code, spelling, tail, f"{n:.12f}", f"{d:.9f}", f"{shift:.9f}"))
        yield pd.DataFrame(rows, columns=["code", "spelling", "tail", "num", "den", "add"])


def alias_dictionary(spellings: DataFrame, measures: DataFrame) -> DataFrame:
    """(code, spelling, tail) to num, den, add for every recognised distinct spelling.

    common value = (value + add) * num / den, in the measure's common unit.
    """
    dims = measures.where(F.col("code").isNotNull()).dropDuplicates(["code"]).select("code", "common_unit", "display", F.col("molar_mass").cast("double"))
    named = spellings.distinct().join(small_side(dims), "code")
    return named.mapInPandas(_map_spellings, "code string, spelling string, tail boolean, num string, den string, add string").select(
        F.col("code").alias("a_code"), F.col("spelling").alias("a_spelling"), F.col("tail").alias("a_tail"),
        F.col("num").cast("decimal(26,12)").alias("num"), F.col("den").cast("decimal(20,9)").alias("den"), F.col("add").cast("decimal(14,9)").alias("add"),
    )


def _number(text: Column) -> Column:
    """A number with decimal point or decimal comma; a comma before a point groups thousands."""
    return F.when(text.contains(".") & text.contains(","), F.replace(text, F.lit(","), F.lit(""))).otherwise(F.translate(text, ",", ".")).try_cast("double")


def _beginning(text: Column) -> Column:
    """The first words of running text, which are all that `match_tail` reads; longer words than any unit are shortened, but stay too long."""
    words = F.regexp_extract(text, rf"^\s*(\S+(?:\s+\S+){{0,{TAIL_WORDS - 1}}})", 1)
    return F.regexp_replace(F.regexp_replace(words, rf"(\S{{{LONGEST + 1}}})\S+", "$1"), r"\s+", " ")


def read_rows(obs: DataFrame, measures: DataFrame) -> DataFrame:
    """Rows of known measures with everything that may state their value and unit."""
    dims = measures.where(F.col("code").isNotNull()).dropDuplicates(["code"]).select(
        F.col("code").alias("m_code"), F.lower("display").alias("m_display"), F.col("common_unit").alias("m_unit"), F.col("decimals").alias("m_decimals")
    )
    j = obs.select("obs_id", "code", "code_text", F.col("quantity_value").cast("double"), "quantity_unit", "value_string", "note").join(
        small_side(dims), F.col("code") == F.col("m_code")
    ).where(~F.col("quantity_unit").eqNullSafe(F.col("m_unit")))

    def without_name(col: str) -> Column:
        text = F.btrim(col, F.lit(BLANKS))
        return F.when(F.startswith(F.lower(text), F.col("m_display")), F.btrim(F.substring(text, F.length("m_display") + 1, F.lit(1 << 30)), F.lit(BLANKS))).otherwise(text)

    # The lower-cased display name may stand before the value or the unit.
    j = staged(
        j, ["obs_id", "code", "m_decimals", "quantity_value", "note"],
        unit=F.nullif(F.btrim("quantity_unit", F.lit(BLANKS)), F.lit("")), said=without_name("value_string"), named=without_name("code_text"),
    )
    number = r"^[^0-9+-]*([+-]?[0-9]+(?:,[0-9]{3})*(?:[.,][0-9]+)?)\s*(.*)$"
    j = staged(
        j, ["obs_id", "code", "m_decimals", "quantity_value", "unit"],
        said_n=F.regexp_extract("said", number, 1), said_rest=F.regexp_extract("said", number, 2),
        named_unit=F.btrim(F.regexp_extract("named", r"(?:^,|\[|\()\s*(\S.*?)\s*[\])]?$", 1)),
        # What follows each cue on a line of its own.
        noted=F.array_join(F.transform(F.regexp_extract_all("note", F.lit(CUES), F.lit(1)), _beginning), "\n"),
    )
    return staged(
        j, ["obs_id", "code", "m_decimals", "quantity_value", "unit"],
        said_value=_number(F.col("said_n")), said_unit=F.nullif(_beginning(F.col("said_rest")), F.lit("")),
        first_part=F.nullif(F.regexp_extract("said_rest", COMPOUND, 1), F.lit("")),
        second_value=_number(F.regexp_extract("said_rest", COMPOUND, 2)), second_part=F.nullif(_beginning(F.regexp_extract("said_rest", COMPOUND, 3)), F.lit("")),
        named_unit=F.nullif(_beginning(F.col("named_unit")), F.lit("")), noted=F.nullif("noted", F.lit("")),
    )


#: Where a unit may be stated, best first, and whether it is running text.
_PLACES = [("unit", False), ("said_unit", True), ("first_part", False), ("second_part", True), ("named_unit", True), ("noted", True)]


def convert(obs: DataFrame, measures: DataFrame) -> DataFrame:
    """``obs_id`` and ``scaled_value``: the value in the common unit times 10^decimals, rounded half up.

    One row per observation of a known measure whose ``quantity_unit`` is not exactly
    the common unit and whose value and unit can be read.  A readable
    ``quantity_unit`` goes before the text of the value, then that of the code,
    then a note that names the unit of the result.  Two-part readings (feet and
    inches, pounds and ounces) are added up.

    Defined results: a null code, value or unit that no text makes good gives no
    row; empty and over-long units are none; of a note the first cue that names a
    unit counts; repeated rows are converted each;
    a value beyond 10^9 common units is computed in doubles.
    """
    rows = read_rows(obs, measures)
    spelled = rows.select("code", F.explode(F.array(*[F.struct(F.col(p).alias("spelling"), F.lit(t).alias("tail")) for p, t in _PLACES])).alias("x")).select(
        "code", "x.spelling", "x.tail"
    ).where(F.col("spelling").isNotNull() & (F.col("tail") | (F.length("spelling") <= LONGEST)))
    aliases = small_side(alias_dictionary(spelled, measures))
    for place, tail in _PLACES:
        a = aliases.where(F.col("a_tail") == F.lit(tail)).select("a_code", "a_spelling", F.struct("num", "den", "add").alias(f"{place}_alias"))
        rows = rows.join(a, (F.col("code") == F.col("a_code")) & (F.col(place) == F.col("a_spelling")), "left").drop("a_code", "a_spelling")

    def common(value: Column, alias: str) -> tuple[Column, Column]:
        """Exact, and in doubles."""
        a = F.col(alias)
        return (
            ((value.try_cast("decimal(16,6)") + a["add"]).try_cast("decimal(17,9)") * a["num"]).try_cast("decimal(34,14)") / a["den"],
            (value + a["add"].cast("double")) * a["num"].cast("double") / a["den"].cast("double"),
        )

    value = F.col("quantity_value")
    two = F.col("first_part_alias").isNotNull() & F.col("second_part_alias").isNotNull()
    first, second = common(F.col("said_value"), "first_part_alias"), common(F.col("second_value"), "second_part_alias")
    said = common(F.col("said_value"), "said_unit_alias")
    spoken = F.coalesce(value, F.col("said_value"))
    by_unit = F.col("unit_alias").isNotNull()
    found = []
    for i in (0, 1):
        found.append(
            F.when(by_unit & spoken.isNotNull(), common(spoken, "unit_alias")[i])
            .when(value.isNull() & two, first[i] + second[i])
            .when(value.isNull() & F.col("said_unit_alias").isNotNull(), said[i])
            .when(value.isNotNull() & F.col("said_unit_alias").isNotNull() & F.col("said_value").eqNullSafe(value), said[i])
            .when(F.col("named_unit_alias").isNotNull(), common(spoken, "named_unit_alias")[i])
            .when(F.col("noted_alias").isNotNull(), common(spoken, "noted_alias")[i])
        )
    out = staged(rows, ["obs_id", "m_decimals"], exact=found[0].try_cast("decimal(30,12)"), near=found[1])
    scale = F.pow(F.lit(10.0), F.col("m_decimals"))
    exact = F.floor((F.col("exact") * scale.cast("decimal(8,0)") + F.lit("0.5").cast("decimal(2,1)")).try_cast("decimal(30,8)")).try_cast("bigint")
    near = F.floor(F.col("near") * scale + 0.5).try_cast("bigint")
    return out.select("obs_id", F.coalesce(exact, near).alias("scaled_value")).where(F.col("scaled_value").isNotNull())
