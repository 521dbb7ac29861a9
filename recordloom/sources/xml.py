"""Clinical XML: document sections with their entries, and variation archives."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.functions import codes


def absent_reason(flavor: str | None) -> str | None:
    """Reason of an absent value by its null flavour; the table is that of `codes`."""
    flavor = (flavor or "").strip().upper()
    return None if not flavor or flavor in codes.PRESENT_FLAVORS else codes.ABSENT_REASONS.get(flavor, "unknown")


def _name(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _find(e: ET.Element, *path: str) -> ET.Element | None:
    for step in path:
        e = next((x for x in e if _name(x) == step), None)
        if e is None:
            return None
    return e


def text_of(e: ET.Element | None) -> str | None:
    """All text below an element, blanks collapsed."""
    return " ".join("".join(e.itertext()).split()) if e is not None else None


_SECTIONS = "file string, section_ix int, section_code string, title string, entry_ix int, entry_kind string, id_root string, id_extension string, code string, display string, effective string, value string, unit string, absent_reason string, error string"


def _entries(text: str) -> Iterator[tuple]:
    root = ET.fromstring(text)
    sections = [s for s in root.iter() if _name(s) == "section"]
    for i, s in enumerate(sections):
        code, title, narrative = _find(s, "code"), text_of(_find(s, "title")), _find(s, "text")
        spoken = {x.get("ID"): text_of(x) for x in narrative.iter() if x.get("ID")} if narrative is not None else {}
        base = (i, code.get("code") if code is not None else None, title)
        statements = [x for entry in s if _name(entry) == "entry" for x in entry.iter() if _name(x) in ("observation", "substanceAdministration", "procedure", "act", "encounter") and not any(_name(y) in ("observation", "procedure") for y in x.iter() if y is not x)]
        if not statements:
            yield (*base, -1, None, None, None, None, text_of(narrative), None, None, None, None)
        for j, x in enumerate(statements):
            cid, c, at, value = _find(x, "id"), _find(x, "code"), _find(x, "effectiveTime"), _find(x, "value")
            if c is None:
                c = _find(x, "consumable", "manufacturedProduct", "manufacturedMaterial", "code")
            low = _find(at, "low") if at is not None else None
            display = None
            if c is not None:
                ref = _find(c, "originalText", "reference")
                display = c.get("displayName") or (spoken.get(ref.get("value", "").lstrip("#")) if ref is not None else None) or text_of(_find(c, "originalText"))
            flavor = next((y.get("nullFlavor") for y in (value, c, x) if y is not None and y.get("nullFlavor")), None)
            yield (
                *base, j, _name(x), cid.get("root") if cid is not None else None, cid.get("extension") if cid is not None else None,
                c.get("code") if c is not None else None, display,
                (at.get("value") or (low.get("value") if low is not None else None)) if at is not None else None,
                (value.get("value") or value.get("displayName") or text_of(value) or None) if value is not None else None,
                value.get("unit") if value is not None else None, absent_reason(flavor),
            )


def _scan_sections(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in _SECTIONS.split(", ")]
    for batch in batches:
        rows = []
        for file, text in zip(batch["file"], batch["text"]):
            if text is None:
                continue
            try:
                rows += [(file, *r, None) for r in _entries(text.lstrip("﻿ \r\n\t"))]
            except ET.ParseError as e:
                rows.append((file, *[None] * 13, str(e)))
        yield pd.DataFrame(rows, columns=names).astype({"section_ix": "Int32", "entry_ix": "Int32"})


def sections(documents: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """Entries of the sections of clinical documents; a section without entries has one row (``entry_ix`` -1, its narrative as ``display``).

    References into the narrative are resolved.  A document that cannot be parsed has one row with ``error``.
    """
    return documents.select(F.col(file).alias("file"), F.col(text).alias("text")).mapInPandas(_scan_sections, _SECTIONS)


def document_types(documents: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """(file, document_type): kind of each clinical document by the code at its head; other where there is none."""
    code = F.regexp_extract(F.col(text), r'(?s)<(?:\w+:)?ClinicalDocument\b.*?<(?:\w+:)?code\b[^>]*?\bcode="([^"]*)"', 1)
    return documents.select(F.col(file).alias("file"), codes.document_type(code).alias("document_type"))


def with_defaults(entries: DataFrame, source: str, identity: str | None = None, provenance: str = "ClinicalGenerated") -> DataFrame:
    """Entries with source, origin and provenance filled in where they state none."""
    have = set(entries.columns)
    out = entries
    for name, value in (("source_system", source), ("source_identity", identity), ("provenance", provenance)):
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in have else F.lit(value).cast("string"))
    return out


def record_ids(entries: DataFrame, fingerprint: str = "fingerprint") -> DataFrame:
    """Entries with ``record_id``: root and extension; an id that different contents claim is told apart by its content."""
    base = F.when(F.col("id_root").isNotNull(), F.concat_ws(":", "id_root", "id_extension"))
    ids = entries.withColumn("_base", base)
    twice = ids.where(F.col("_base").isNotNull()).groupBy("_base").agg(F.min(fingerprint).alias("_f1"), F.max(fingerprint).alias("_f2")).where("_f1 <> _f2").select("_base", F.lit(True).alias("_twice"))
    j = ids.join(twice, "_base", "left")
    return j.withColumn("record_id", F.when(F.col("_twice"), F.concat("_base", F.lit("#"), F.substring(fingerprint, 1, 12))).otherwise(F.col("_base"))).drop("_base", "_twice")


_VARIATIONS = "file string, variation_id string, name string, kind string, gene string, significance string, review_status string, n_submissions int, error string"


def _scan_variations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in _VARIATIONS.split(", ")]
    for batch in batches:
        rows = []
        for file, text in zip(batch["file"], batch["text"]):
            if text is None:
                continue
            try:
                for v in (x for x in ET.fromstring(text).iter() if _name(x) == "VariationArchive"):
                    first = {n: next((x for x in v.iter() if _name(x) == n), None) for n in ("Gene", "Description", "ReviewStatus")}
                    rows.append((
                        file, v.get("VariationID"), v.get("VariationName"), v.get("VariationType"), first["Gene"].get("Symbol") if first["Gene"] is not None else None,
                        text_of(first["Description"]), text_of(first["ReviewStatus"]), sum(_name(x) == "ClinicalAssertion" for x in v.iter()), None,
                    ))
            except ET.ParseError as e:
                rows.append((file, *[None] * 7, str(e)))
        yield pd.DataFrame(rows, columns=names).astype({"n_submissions": "Int32"})


def variations(documents: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """One row per variation archive, with the number of its submissions."""
    return documents.select(F.col(file).alias("file"), F.col(text).alias("text")).mapInPandas(_scan_variations, _VARIATIONS)
