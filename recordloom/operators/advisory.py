"""Patches for records: what they select, whether they are sound, whether they may be applied unasked."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.common import small_side

#: Triples that a patch may add for one subject.
MOST_TRIPLES = 64
# Predicates that name a record for good, and namespaces that a patch may write in.
STABLE = ("genomics:caId", "genomics:vrsId", "genomics:clinvarVariationId", "genomics:hgncId", "clinical:loincCode", "clinical:rxNormCode", "clinical:icd10Code", "clinical:snomedCode")
VOCABULARIES = ("core:", "health:", "clinical:", "genomics:", "pgx:", "advisory:", "checkup:", "coverage:", "prov:", "xsd:", "rdfs:", "owl:", "rdf:", "ldp:")
#: Days between checks by how urgent an advisory is.
CADENCE_DAYS = {"immediate": 0, "monthly": 30, "quarterly": 91, "yearly": 365}


@dataclass
class Patch:
    """A parsed patch: the one binding (variable, predicate, value) and the triples it adds."""

    bind: tuple[str, str, str] | None = None
    adds: list[tuple[str, str, str]] = field(default_factory=list)
    envelope: dict[str, str] = field(default_factory=dict)


_TERM = r'(?:\?\w+|<[^>]*>|[\w.-]*:[\w.-]+|"(?:[^"\\]|\\.)*"(?:\^\^\S+|@[\w-]+)?|a(?=\s))'


def parse_patch(text: str) -> Patch:
    """The patch in a text of ``Bind ?x / path value .`` and ``Add { s p o . ... } .`` statements; `ValueError` for anything else.

    Nothing may be deleted, cut or updated.
    """
    patch, rest = Patch(), re.sub(r"(?m)^\s*#.*$", "", text).strip()
    while rest:
        if m := re.match(r"@envelope\s+(\w+)\s+\"([^\"]*)\"\s*\.\s*", rest):
            patch.envelope[m[1]] = m[2]
        elif m := re.match(rf"Bind\s+(\?\w+)\s+({_TERM})\s+({_TERM})\s*\.\s*", rest):
            if patch.bind:
                raise ValueError("more than one Bind")
            patch.bind = (m[1], m[2], m[3])
        elif m := re.match(r"Add\s*\{(.*?)\}\s*\.\s*", rest, re.S):
            for line in re.finditer(rf"({_TERM})\s+({_TERM})\s+({_TERM})\s*(?:\.|$)\s*", m[1].strip() + " "):
                patch.adds.append((line[1], line[2], line[3]))
        elif m := re.match(r"(Delete|Cut|UpdateList)\b", rest):
            raise ValueError(f"{m[1]} is not allowed")
        else:
            raise ValueError(f"cannot read {rest[:40]!r}")
        rest = rest[m.end() :]
    return patch


def check_patch(p: Patch) -> list[str]:
    """Codes of the rules that a patch breaks.

    C1 it adds something; C2 it binds by a stable identifier with a literal; C3 it writes known
    vocabularies only; C4 it uses no variable but the bound one; C5 it adds few triples; C6 its
    envelope names issuer and class.
    """
    variables = {t for triple in p.adds for t in triple if t.startswith("?")}
    broken = {
        "C1": not p.adds,
        "C2": p.bind is not None and (p.bind[1] not in STABLE or not p.bind[2].startswith('"')),
        "C3": any(t[1] != "a" and not t[1].startswith(VOCABULARIES) for t in p.adds),
        "C4": bool(variables - ({p.bind[0]} if p.bind else set())),
        "C5": len(p.adds) > MOST_TRIPLES,
        "C6": not {"issuer", "advisoryClass"} <= set(p.envelope),
    }
    return [code for code, bad in broken.items() if bad]


def select(triples: DataFrame, advisories: DataFrame) -> DataFrame:
    """(advisory, s) of the subjects that each advisory binds: equality of predicate and value, datatype and language included.

    `advisories`: ``advisory``, ``p``, ``o``, ``datatype``, ``lang``; one without ``p`` binds nothing and applies once (null ``s``).
    """
    same = lambda c: F.coalesce(F.col(f"t.{c}"), F.lit("")) == F.coalesce(F.col(f"a.{c}"), F.lit(""))
    bound = advisories.where(F.col("p").isNotNull())
    hits = triples.alias("t").join(small_side(bound).alias("a"), (F.col("t.p") == F.col("a.p")) & (F.col("t.o") == F.col("a.o")) & same("datatype") & same("lang"))
    free = advisories.where(F.col("p").isNull()).select("advisory", F.lit(None).cast("string").alias("s"))
    return hits.select("a.advisory", "t.s").distinct().unionByName(free)


def policy(advisories: DataFrame, policies: DataFrame, quality: DataFrame) -> DataFrame:
    """(advisory, decision): auto-apply where a policy names its issuer and class and the bound record is sure enough, else queue.

    `advisories`: ``advisory``, ``issuer``, ``class``, ``s``; `policies`: ``issuer``, ``class``;
    `quality`: ``s``, ``tier``, ``requires_confirmation``.
    """
    j = advisories.join(small_side(policies.select("issuer", "class", F.lit(True).alias("allowed")).distinct()), ["issuer", "class"], "left").join(quality, "s", "left")
    unsure = (F.coalesce("tier", F.lit("")) == "consumer-grade") | F.coalesce("requires_confirmation", F.lit(False))
    ok = F.coalesce("allowed", F.lit(False)) & ~unsure
    return j.groupBy("advisory").agg(F.when(F.bool_and(ok), "auto-apply").otherwise("queue").alias("decision"))


def due(tier: Column, last: Column, now: Column) -> Column:
    """Whether a check of this tier is due; one that never ran is."""
    days = F.coalesce(*[F.when(tier == t, n) for t, n in CADENCE_DAYS.items()])
    return F.coalesce(F.date_diff(now.cast("date"), last.cast("date")) >= days, F.lit(True))
