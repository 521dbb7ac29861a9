"""String, code and numeric functions: Column to Column, no Python per row.

Null in gives null out; empty strings are values.  Patterns are ASCII-only where the
behaviour to match is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strengths and form words that are not part of a medication's name.
STRENGTH = r"\d+(\.\d+)?\s*(mg|mcg|g|ml|%|iu|units?|meq)\b"
FORM_WORDS = r"\b(oral|tablet|capsule|solution|injection|extended|release|er|xr|cr|sr|hr)\b"
# Replacements in doses and frequencies, in this order (longer phrases first).
DOSES = [("milligram", "mg"), ("microgram", "mcg"), ("gram", "g"), ("mgs", "mg"), ("mcgs", "mcg")]
FREQUENCIES = [
    ("once daily", "qd"), ("once a day", "qd"), ("twice daily", "bid"), ("twice a day", "bid"), ("three times daily", "tid"),
    ("three times a day", "tid"), ("four times daily", "qid"), ("four times a day", "qid"), ("every day", "qd"), ("daily", "qd"),
]
# Routes by the words for them.
ROUTES = {
    "oral": "oral", "po": "oral", "by mouth": "oral", "orally": "oral", "inhalation": "inhalation", "inhaled": "inhalation", "inhale": "inhalation", "nebulized": "inhalation",
    "iv": "intravenous", "intravenous": "intravenous", "im": "intramuscular", "intramuscular": "intramuscular", "subcutaneous": "subcutaneous", "subcut": "subcutaneous",
    "sc": "subcutaneous", "sq": "subcutaneous", "topical": "topical", "transdermal": "transdermal", "sublingual": "sublingual", "sl": "sublingual", "rectal": "rectal", "pr": "rectal",
    "nasal": "nasal", "intranasal": "nasal", "ophthalmic": "ophthalmic", "otic": "otic",
}
# Code systems by the beginning of their IRI or OID.
CODE_SYSTEMS = {
    "rxnorm": ["http://www.nlm.nih.gov/research/umls/rxnorm", "urn:oid:2.16.840.1.113883.6.88"],
    "snomed": ["http://snomed.info/sct", "urn:oid:2.16.840.1.113883.6.96"],
    "ndc": ["http://hl7.org/fhir/sid/ndc", "urn:oid:2.16.840.1.113883.6.69"],
    "atc": ["http://www.whocc.no/atc", "urn:oid:2.16.840.1.113883.6.73"],
    "loinc": ["http://loinc.org", "urn:oid:2.16.840.1.113883.6.1"],
    "icd10": ["http://hl7.org/fhir/sid/icd-10", "urn:oid:2.16.840.1.113883.6.90", "urn:oid:2.16.840.1.113883.6.3"],
    "cvx": ["http://hl7.org/fhir/sid/cvx", "urn:oid:2.16.840.1.113883.12.292"],
}
# Brands and the generic name of each.
GENERICS = {
    "zyrtec": "cetirizine", "claritin": "loratadine", "allegra": "fexofenadine", "benadryl": "diphenhydramine", "lipitor": "atorvastatin", "crestor": "rosuvastatin", "zocor": "simvastatin",
    "pravachol": "pravastatin", "tylenol": "acetaminophen", "advil": "ibuprofen", "motrin": "ibuprofen", "aleve": "naproxen", "prinivil": "lisinopril", "zestril": "lisinopril",
    "norvasc": "amlodipine", "glucophage": "metformin", "prilosec": "omeprazole", "nexium": "esomeprazole", "ventolin": "albuterol", "proventil": "albuterol", "coumadin": "warfarin",
    "synthroid": "levothyroxine", "amoxil": "amoxicillin", "zoloft": "sertraline", "prozac": "fluoxetine", "lexapro": "escitalopram", "lasix": "furosemide", "cozaar": "losartan",
    "plavix": "clopidogrel", "neurontin": "gabapentin",
}
# Words of organisation names that tell none apart, and public suffixes of two labels.
GENERIC_WORDS = (
    "health healthcare system systems service services medical medicine center centre centers centres hospital hospitals clinic clinics care group "
    "associates association network partners partnership physicians physician practice practices regional community memorial university institute foundation "
    "laboratory laboratories labs lab diagnostics imaging radiology pathology family urgent primary specialty cardiology oncology orthopedic orthopedics "
    "pediatric pediatrics inc llc llp ltd plc corp corporation co pc pa pllc of and the for at in on a an"
).split()
SUFFIXES = ("co.uk", "org.uk", "nhs.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "gov.au", "co.nz", "co.za", "co.jp", "or.jp", "com.br", "com.mx")
ABSENT = ("unknown", "unavailable", "asked-unknown", "not-asked", "masked", "temp-unknown")
# Organisations under a second name, and under the name to show.
ALIASES = {"kp": "kaiser"}
SHOWN = {"kaiser": "Kaiser Permanente", "providence": "Providence Health & Services"}


def literal_map(table: dict[str, str]) -> Column:
    """A map column of a small fixed table."""
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def squeeze(c: Column) -> Column:
    """Runs of blanks as one, none around."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def medication_name(c: Column, generic: bool = True) -> Column:
    """Lower case without strength and form words; a brand as its generic name (unless not `generic`)."""
    bare = squeeze(F.regexp_replace(F.regexp_replace(F.lower(c), STRENGTH, ""), FORM_WORDS, ""))
    return F.coalesce(F.element_at(literal_map(GENERICS), bare), bare) if generic else bare


def condition_name(c: Column) -> Column:
    """Lower case without parentheticals."""
    return squeeze(F.regexp_replace(F.lower(c), r"\([^)]*\)", ""))


def index_name(c: Column) -> Column:
    """Lower case letters and digits in words."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))


def _replaced(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def frequency(c: Column) -> Column:
    """Phrases of a dosing frequency as their abbreviation."""
    return F.trim(_replaced(F.lower(c), FREQUENCIES))


def route(c: Column) -> Column:
    """Canonical route; an unknown one in lower case."""
    key = F.trim(F.lower(c))
    return F.coalesce(F.element_at(literal_map(ROUTES), key), key)


def dose(c: Column) -> Column:
    """Without blanks, units abbreviated."""
    return _replaced(F.replace(F.lower(c), F.lit(" "), F.lit("")), DOSES)


def code_value(iri: Column) -> Column:
    """What follows the last slash, then the last hash."""
    return F.substring_index(F.substring_index(iri, "/", -1), "#", -1)


def code_system(iri: Column) -> Column:
    """System by the beginning of a code's IRI; ``unknown`` for others, null for null."""
    out = F.when(iri.isNull(), F.lit(None))
    for system, starts in CODE_SYSTEMS.items():
        for start in starts:
            out = out.when(iri.startswith(start), system)
    return out.otherwise("unknown")


def cvx(code: Column) -> Column:
    """Bare vaccine code of an IRI or a prefixed code."""
    return F.regexp_replace(code_value(code), "^CVX-", "")


def uuids(c: Column) -> Column:
    """All UUIDs in a text, lower case, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit("([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})"), 1)


def linked_ids(c: Column) -> Column:
    """Ids packed in one text, split at blanks, commas and semicolons."""
    return F.filter(F.split(F.lower(c), r"[\s,;]+"), lambda x: x != "")


def reference_type(ref: Column) -> Column:
    """Type of a relative or absolute reference; null for URNs and local ones."""
    bare = F.regexp_replace(ref, r"/_history(/.*)?$", "")
    return F.nullif(F.regexp_extract(bare, r"(?:^|/)([A-Z][A-Za-z]+)/[^/]+$", 1), F.lit(""))


def reference_id(ref: Column) -> Column:
    """Id part of a reference."""
    bare = F.regexp_replace(ref, r"/_history(/.*)?$", "")
    return F.when(bare.startswith("urn:uuid:"), F.substring(bare, 10, 1 << 30)).otherwise(F.substring_index(bare, "/", -1))


def float_prefix(c: Column) -> Column:
    """The number a text begins with, else null."""
    return F.nullif(F.regexp_extract(c, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1), F.lit("")).try_cast("double")


def relative_difference(a: Column, b: Column, floor: float = 0.001) -> Column:
    """|a - b| over the larger magnitude, at least `floor`."""
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(floor))


def set_key(values: Column, sep: str = "|") -> Column:
    """Canonical key of a set of texts: trimmed, distinct, sorted."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(values, lambda x: F.trim(x)))), sep)


_MARKED, _PLAIN = "áàâäãåāéèêëēíìîïīóòôöõøōúùûüūñçýÿ", "aaaaaaaeeeeeiiiiiooooooouuuuuncyy"


def is_host(c: Column) -> Column:
    """Whether a text is a bare host."""
    return c.rlike(r"(?i)^[a-z0-9][a-z0-9-]*(\.[a-z0-9][a-z0-9-]*)+\.?$")


def registrable_name(host: Column) -> Column:
    """The label of a host left of its public suffix."""
    labels = F.split(F.regexp_replace(F.lower(host), r"^www\.(?=.)|\.$", ""), r"\.")
    n = F.size(labels)
    two = F.concat_ws(".", F.get(labels, n - 2), F.get(labels, n - 1)).isin(*SUFFIXES)
    return F.coalesce(F.when(n - F.when(two, 2).otherwise(1) >= 1, F.get(labels, n - F.when(two, 3).otherwise(2))), F.get(labels, F.lit(0)))


def url_host(url: Column) -> Column:
    """Host of an absolute URL; null for anything else."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))


def organisation_slug(c: Column) -> Column:
    """One word for an organisation, from its name or a host of it; null where the text names none.

    Of a host it is the label left of the public suffix without generic words at its ends;
    of a name the first word that is neither generic nor a number, and all words together
    where every one is.
    """
    text = F.trim(c)
    words = "|".join(sorted((w for w in GENERIC_WORDS if len(w) > 2), key=len, reverse=True))
    label = registrable_name(text)
    # Generic words are taken off a label only where something is left of it.
    ends = F.regexp_replace(F.regexp_replace(label, rf"(?<=.{{3}})({words})+$", ""), rf"^({words})+(?=.{{3}})", "")
    named = F.filter(F.split(F.regexp_replace(F.translate(F.lower(text), _MARKED, _PLAIN), r"[^a-z0-9]+", " "), " "), lambda w: w != "")
    tokens = F.when(is_host(text), F.array(ends)).otherwise(named)
    telling = F.get(F.filter(tokens, lambda w: ~w.isin(*GENERIC_WORDS) & ~w.rlike(r"^\d+$")), F.lit(0))
    slug = F.nullif(F.coalesce(telling, F.array_join(tokens, "")), F.lit(""))
    return F.when((text != "") & ~F.lower(text).isin(*ABSENT), F.coalesce(F.element_at(literal_map(ALIASES), slug), slug))


def shown_name(slug: Column) -> Column:
    """Name to show for an organisation's slug."""
    return F.coalesce(F.element_at(literal_map(SHOWN), slug), F.concat(F.upper(F.substring(slug, 1, 1)), F.substring(slug, 2, 1 << 30)))


def source_identity(organisation: Column, host: Column, namespace: Column, label: Column) -> Column:
    """Origin of a record with the tier it comes from: organisation, else namespace, else the transport's label."""
    slug = F.coalesce(organisation_slug(organisation), organisation_slug(host))
    known = F.nullif(F.trim(namespace), F.lit(""))
    return F.coalesce(F.concat(F.lit("org:"), slug), F.concat(F.lit("ns:"), known), F.concat(F.lit("transport:"), F.coalesce(label, F.lit("unknown"))))


def is_known_origin(identity: Column) -> Column:
    """Whether an identity names an origin at all."""
    return F.coalesce(identity.startswith("org:") | identity.startswith("ns:"), F.lit(False))


def source_label(identity: Column, stated: Column) -> Column:
    """Name of an origin to show: the organisation's, else what the record states."""
    bare = F.nullif(F.trim(stated), F.lit(""))
    return F.when(identity.startswith("org:"), shown_name(F.substring(identity, 5, 1 << 30))).otherwise(bare)


def conflict_id(record_type: Column, matched_on: Column) -> Column:
    """Key under which a decision about a conflict is kept."""
    return F.substring(F.regexp_replace(F.concat(record_type, F.lit("::"), matched_on), r"[^a-zA-Z0-9:+./-]", "_"), 1, 80)


def confidence_route(confidence: Column) -> Column:
    """What happens to an extracted statement of this confidence; null is not trusted."""
    return F.when(confidence >= 0.85, "accept").when(confidence >= 0.50, "review").otherwise("discard")


def percent_encoded(c: Column) -> Column:
    """Text as one part of a URI: all but letters, digits and ``- _ . ! ~ * ' ( )`` escaped."""
    out = F.url_encode(c)
    for escaped, plain in (("+", "%20"), ("%21", "!"), ("%7E", "~"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        out = F.replace(out, F.lit(escaped), F.lit(plain))
    return out


def percent_decoded(c: Column) -> Column:
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def legal_iri(c: Column) -> Column:
    """Whether a text can stand between angle brackets."""
    return ~c.rlike(r"[\x00-\x20<>\"{}|^`\\\\]")


def turtle_escaped(c: Column) -> Column:
    """Text as it stands between double quotes in Turtle."""
    return _replaced(c, [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")])


# Namespaces by prefix.
PREFIXES = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "xsd": "http://www.w3.org/2001/XMLSchema#",
    "prov": "http://www.w3.org/ns/prov#", "foaf": "http://xmlns.com/foaf/0.1/", "ldp": "http://www.w3.org/ns/ldp#", "dcterms": "http://purl.org/dc/terms/",
    "sct": "http://snomed.info/sct/", "loinc": "http://loinc.org/rdf#", "icd10": "http://hl7.org/fhir/sid/icd-10-cm/", "fhir": "http://hl7.org/fhir/",
}


def shortened_iri(iri: Column, prefixes: dict[str, str] | None = None) -> Column:
    """``prefix:name`` by the longest namespace that fits; other IRIs as they are."""
    out = None
    for prefix, space in sorted((prefixes or PREFIXES).items(), key=lambda kv: (-len(kv[1]), kv[0])):
        fits, short = iri.startswith(space), F.concat(F.lit(f"{prefix}:"), F.substring(iri, len(space) + 1, 1 << 30))
        out = F.when(fits, short) if out is None else out.when(fits, short)
    return out.otherwise(iri)


def expanded_iri(curie: Column, prefixes: dict[str, str] | None = None) -> Column:
    """Full IRI of ``prefix:name``; null for an unknown prefix, absolute IRIs as they are."""
    space = F.element_at(literal_map(prefixes or PREFIXES), F.substring_index(curie, ":", 1))
    full = F.concat(space, F.substring(curie, F.instr(curie, ":") + 1, F.lit(1 << 30)))
    return F.when(curie.rlike(r"^(https?|urn):"), curie).when(curie.contains(":"), full)
