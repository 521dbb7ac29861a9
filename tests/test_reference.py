"""Record-graph operators: SQL equality on the small tables, brute force where SQL cannot express them."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recordloom.functions import codes, dates, text
from recordloom.operators import graph, link, narrative, overlay, reconcile, validate
from recordloom.plans import registry

WITHOUT_SQL = {"p2_found", "p2_zones", "p6_paths", "p6_table", "match_labs", "lab_representatives", "resolve_groups", "reconciliation_counters", "merged_records", "p5_found", "p6_found", "p6_resources", "id_digest24", "greedy_groups", "classify_groups", "reconcile_summary", "narrative_chunks", "turtle_scan", "fhir_bundles_out"}


def _plain(v):
    if v is None or isinstance(v, float) and v != v:
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 6))
    return str(list(v)) if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb

    c = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, sf, duck, name):
    got = registry.queries()[name](spark, sf)
    want = duck.sql(registry.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    order = [want.columns.index(c) for c in cols]
    assert sorted(tuple(map(_plain, r)) for r in got.select(*cols).collect()) == sorted(tuple(_plain(r[i]) for i in order) for r in want.fetchall())


def test_every_query_has_sql_or_a_reason():
    assert set(registry.queries()) - set(registry.oracle_sql()) == WITHOUT_SQL


def test_entry_points(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["subject", "predicate", "object"]
    assert set(e.oracle_sql()) <= set(e.queries())


def _loop(nodes, pairs):
    """The literal loop: each unassigned node is a seed and absorbs every unassigned match above it."""
    match = {frozenset(p) for p in pairs}
    seed = {}
    for a in sorted(nodes):
        if a not in seed:
            seed[a] = a
            for b in sorted(nodes):
                if b > a and b not in seed and frozenset((a, b)) in match:
                    seed[b] = a
    return seed


def test_greedy_groups_of_long_chains(spark):
    """More rounds would be needed than are taken, with and without blocks."""
    rng = random.Random(5)
    nodes = [(x, x % 2) for x in range(700)]
    pairs = {(x, x + 2) for x in range(698)} | {(x, x + 2 * rng.randint(2, 9)) for x in range(1, 680, 2)}
    df, edges = spark.createDataFrame(nodes, "rep long, side long"), spark.createDataFrame(sorted(pairs), "lo long, hi long")
    want = _loop([x for x, _ in nodes], pairs)
    for block in ((), ("side",)):
        got = [tuple(r) for r in reconcile.greedy_groups(df, edges, *([block] if block else [])).collect()]
        assert len(got) == len(nodes) and dict(got) == want


def test_no_source_is_cut_off(spark, tmp_path):
    n = 10_050
    ids = spark.range(n).withColumn("source_system", F.concat(F.lit("s"), "id"))
    ids.select("source_system", F.col("id").cast("int").alias("trust_rank")).coalesce(1).write.parquet(str(tmp_path / "source_systems.parquet"))
    people = ids.select(F.col("id").alias("patient_id"), F.col("id").alias("pod_id"), "source_system", *[F.lit("x").alias(c) for c in ("family_name", "gender", "birth_date")])
    people.coalesce(1).write.parquet(str(tmp_path / "patients.parquet"))
    for name in ("resolve_trust", "merge_values"):
        assert registry.queries()[name](spark, str(tmp_path)).count() == n


@pytest.mark.parametrize("n", range(4))
def test_greedy_groups(spark, n):
    rng = random.Random(n)
    nodes = list(range(60))
    pairs = {tuple(sorted(rng.sample(nodes, 2))) for _ in range((20, 60, 150, 600)[n])}
    df = spark.createDataFrame([(x,) for x in nodes], "rep long")
    got = {r.rep: r.seed for r in reconcile.greedy_groups(df, spark.createDataFrame(list(pairs), "lo long, hi long")).collect()}
    assert got == _loop(nodes, pairs)


def test_classify_and_merge(spark):
    rows = [("g", 1, 10.0, "a"), ("g", 2, 10.0, "a"), ("g", 3, 99.0, "z"), ("h", 4, 10.0, "a"), ("h", 5, 10.2, "a"), ("i", 6, 10.0, "a"), ("i", 7, 20.0, "a"), ("j", 8, 1.0, "a"), ("j", 9, 1.0, "b"), ("k", 10, 1.0, "a")]
    df = spark.createDataFrame(rows, "g string, o long, v double, s string")
    assert {r.g: r.kind for r in reconcile.classify(df, "g", "o", "v", "s").collect()} == {"g": "exact", "h": "near_duplicate", "i": "value_conflict", "j": "status_conflict"}
    m = reconcile.merge_values(spark.createDataFrame([("g", 1, None, "x"), ("g", 2, "B", "y"), ("g", 3, "C", None)], "g string, r int, a string, b string"), ["g"], F.col("r"), ["a", "b"]).first()
    assert (m.n_members, m.a, m.b) == (3, "B", "x")


def test_band_pairs_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), rng.randrange(0, 5000), rng.choice([1.0, 1.02, 1.1, 2.0, None]), rng.choice("xy")) for i in range(150)]
    df = spark.createDataFrame(rows, "rep long, code string, t long, value double, src string")
    a, b = F.col("a_value"), F.col("b_value")
    conf = reconcile.value_confidence(a, b, [(0.0, 1.0), (0.05, 0.95), (0.15, 0.75)], 0.85, F.greatest(F.abs(a), F.abs(b)))
    got = {(r.lo, r.hi): r.confidence for r in reconcile.band_pairs(df, ["code"], "t", 300, "src", conf).collect()}
    want = {}
    for x in rows:
        for y in rows:
            if x[0] < y[0] and x[1] == y[1] and x[4] != y[4] and abs(x[2] - y[2]) <= 300:
                if x[3] is None or y[3] is None:
                    c = 0.85
                else:
                    d = abs(x[3] - y[3]) / max(x[3], y[3])
                    c = 1.0 if d == 0 else 0.95 if d <= 0.05 else 0.75 if d <= 0.15 else 0
                if c >= 0.65:
                    want[x[0], y[0]] = c
    assert got == want


def test_graph_walks(spark):
    e = spark.createDataFrame([("a", "p", "b"), ("b", "p", "c"), ("c", "q", "d"), ("d", "p", "a"), ("x", "p", "x")], "subject string, predicate string, object string")
    n = graph.neighbourhood(e, spark.createDataFrame([("a",), ("x",)], "uri string"), 3).collect()
    # c is reached from b over p (out) and from d over q (in): the smaller predicate is reported.
    assert {(r.iri, r.hop, r.predicate, r.direction) for r in n if r.seed == "a"} == {("b", 1, "p", "out"), ("d", 1, "p", "in"), ("c", 2, "p", "out")}
    assert not [r for r in n if r.seed == "x"]
    c = graph.closure(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "b"), (None, "z")], "child string, parent string"))
    assert {(r.child, r.ancestor) for r in c.collect()} == {(x, y) for x in "abcd" for y in "bcd"}
    m = graph.redirect_map(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("s", "s"), ("u", "v"), ("v", "u")], "old string, new string"))
    got = {r.old: r.canonical for r in m.collect()}
    assert {k: got[k] for k in "abc"} == {"a": "d", "b": "d", "c": "d"} and "s" not in got


def test_ambiguous_bare_reference(spark):
    refs = spark.createDataFrame([("s", "Patient", "1"), ("s", None, "1"), ("s", None, "2"), ("s", "Device", "2"), ("s", "Patient", "9"), (None, "Patient", "1")], "scope string, ref_type string, ref_id string")
    targets = spark.createDataFrame([("s", "Patient", "1", "P1"), ("s", "Device", "1", "D1"), ("s", "Patient", "2", "P2")], "scope string, type string, id string, target string")
    got = [r.target for r in link.resolve_references(refs, targets).collect()]
    assert sorted(map(str, got)) == sorted(["P1", "None", "P2", "P2", "None", "None"])


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab \n", max_size=200), st.integers(4, 40))
def test_chunks_join_to_the_text(t, most):
    parts = narrative.split_text(t, most)
    assert "".join(parts) == t and all(len(p) <= most for p in parts) and (all(parts) or parts == [""])


def test_narrative(spark):
    df = spark.createDataFrame([(1, "a" * 50 + "\n\n" + "b" * 50), (2, ""), (3, None)], "k long, t string")
    assert [(r.k, r.n_chars) for r in narrative.chunks(df, "k", "t", 60).collect()] == [(1, 52), (1, 50), (2, 0)]
    html = "<style>x{}</style><p>One &amp; two</p><p>Three<br/>four</p><script>no</script>"
    assert spark.range(1).select(narrative.strip_markup(F.lit(html))).first()[0] == "One & two\nThree\nfour"


def test_overlay_and_disposition(spark):
    o = spark.createDataFrame(
        [(1, "r", "amend", "p", "a", 1), (2, "r", "amend", "p", "b", 2), (3, "r", "retract", None, None, 2), (4, "r", "amend", "q", "c", 2), (5, "s", "note", "p", "z", 9)],
        "overlay_id long, record string, kind string, property string, value string, created long",
    )
    assert [(r.record, r.property, r.value) for r in overlay.effective(o).collect()] == [("r", "q", "c")]
    c = spark.createDataFrame([("k", "1"), ("k", "2"), ("m", "1"), ("m", "3"), ("o", "1"), ("o", "9")], "conflict string, uri string")
    alive, merged = spark.createDataFrame([("1",), ("2",)], "uri string"), spark.createDataFrame([("3",)], "uri string")
    assert {r.conflict: r.disposition for r in overlay.disposition(c, alive, merged).collect()} == {"k": "kept", "m": "cleared", "o": "orphan"}


def test_constraints(spark):
    df = spark.createDataFrame([(1, "x", 5), (2, None, 50), (3, "toolong", None)], "k long, s string, n int")
    rules = [
        validate.Constraint("required", validate.required("s"), F.col("s")), validate.Constraint("length", validate.length_between("s", 1, 3), F.col("s"), "info"),
        validate.Constraint("range", validate.in_range("n", 0, 10), F.col("n")), validate.Constraint("xone", validate.exactly_one(validate.required("s"), validate.required("n")), F.col("k")),
    ]
    got = {(r.focus, r.rule) for r in validate.violations(df, F.col("k"), "t", rules).collect()}
    assert got == {("2", "required"), ("3", "length"), ("2", "range"), ("1", "xone")}


VECTORS = [
    (text.medication_name, {"Lisinopril 10 mg CR": "lisinopril", "Lisinopril 20 mg Oral Tablet": "lisinopril", "Zyrtec 10 mg": "cetirizine", "PRINIVIL": "lisinopril", "metformin hydrochloride 500 MG extended release": "metformin hydrochloride", "": ""}),
    (text.dose, {"10 mg": "10mg", "10 milligrams": "10mg", "5 Micrograms": "5mcg", "1 gram": "1g", "2 mgs": "2mg"}),
    (text.frequency, {"once daily": "qd", "Twice Daily": "bid", "three times a day": "tid", "every day": "qd", "daily": "qd", "at bedtime": "at bedtime", "1 tab four times daily": "1 tab qid"}),
    (text.route, {"PO": "oral", "by mouth": "oral", "IV": "intravenous", "subcut": "subcutaneous", "Intranasal": "nasal", " Topical ": "topical", "buccal": "buccal"}),
    (text.code_system, {"http://www.nlm.nih.gov/research/umls/rxnorm/29046": "rxnorm", "urn:oid:2.16.840.1.113883.6.69:1": "ndc", "http://hl7.org/fhir/sid/icd-10-cm/E11": "icd10", "urn:oid:2.16.840.1.113883.12.292:207": "cvx", "http://x/1": "unknown"}),
    (text.cvx, {"http://hl7.org/fhir/sid/cvx/207": "207", "CVX-207": "207", "207": "207"}),
    (text.organisation_slug, {
        "Meridian Health System, Inc.": "meridian", "Méridian Health System": "meridian", "fhir.meridianhealth.example": "meridian", "www.stonebridgehospital.example": "stonebridge", "Regional Medical Center": "regionalmedicalcenter",
        "kp.org": "kaiser", "Kaiser Permanente": "kaiser", "fhir.kp.org": "kaiser", "rw.example": "rw", "unknown": None, "  ": None, "12 Oak Street Clinic": "oak", "trust.nhs.uk": "trust",
    }),
    (text.percent_encoded, {"a b/c+d~(e)!": "a%20b%2Fc%2Bd~(e)!", "é": "%C3%A9"}),
    (text.expanded_iri, {"prov:x": "http://www.w3.org/ns/prov#x", "no:x": None, "urn:x": "urn:x"}),
    (text.shortened_iri, {"http://www.w3.org/ns/prov#x": "prov:x", "http://hl7.org/fhir/sid/icd-10-cm/E11": "icd10:E11", "http://other/x": "http://other/x"}),
    (text.legal_iri, {"http://x/a": True, "http://x/a b": False, "http://x/<": False, "a\\b": False}),
    (text.confidence_route, {0.85: "accept", 0.84: "review", 0.5: "review", 0.4: "discard", None: "discard"}),
    (dates.hl7_date, {
        "20250311": "2025-03-11", "2025031114": "2025-03-11T14:00:00", "202503111430": "2025-03-11T14:30:00", "20250311143000Z": "2025-03-11T14:30:00Z", "20250311143000.123-0500": "2025-03-11T14:30:00-05:00", "20250311-0500": "2025-03-11",
        "202503111": "2025-03-11", "2025031114300": "2025-03-11", "202503": None, "2025-03-11": "2025-03-11", "2025-03-11T14:30:00Z": "2025-03-11T14:30:00Z", "soon": None, "": None, None: None,
    }),
    (dates.file_date, {"20240102": "2024-01-02", "2024-01-02": "2024-01-02", "Jan 2": None}),
    (codes.interpretation, {"H": "H", "HH": "HH", None: "unknown", "": "unknown", "ZZ": None}),
    (codes.absent_reason, {"UNK": "unknown", "nask": "not-asked", "NAVU": "unknown", "QS": None, "XYZ": "unknown", "": None, None: None}),
    (codes.review_status, {"Reviewed by expert panel": "ExpertPanelReviewed", "criteria provided, conflicting classifications": "ConflictingSubmissions", "new": None}),
    (codes.pathogenicity, {"Likely pathogenic": "LikelyPathogenic", "LA26333-7": "VUS", "odd": None}),
    (codes.document_type, {"34133-9": "summarization", "1": "other"}),
    (codes.medication_status, {"Active": "active", "73425007": "completed", "413322009": "completed", "7087005": "unknown", "complete": "completed"}),
]


@pytest.mark.parametrize("n", range(len(VECTORS)))
def test_scalar_vectors(spark, n):
    f, want = VECTORS[n]
    kind = "double" if any(isinstance(k, float) for k in want) else "string"
    df = spark.createDataFrame([(k,) for k in want], f"t {kind}")
    assert dict(map(tuple, df.select("t", f(F.col("t"))).collect())) == want


def test_origins_and_labels(spark):
    df = spark.createDataFrame([("Meridian Health", None, "http://f", "batch"), (None, "fhir.kp.org", None, "b"), (None, None, "1.2.3", "b"), (None, None, None, None)], "org string, host string, ns string, label string")
    got = [tuple(r) for r in df.select(text.source_identity(*map(F.col, df.columns)).alias("i")).select("i", text.source_label(F.col("i"), F.lit(" EHR ")), text.is_known_origin(F.col("i"))).collect()]
    assert got == [("org:meridian", "Meridian", True), ("org:kaiser", "Kaiser Permanente", True), ("ns:1.2.3", "EHR", True), ("transport:unknown", "EHR", False)]
    pair = spark.createDataFrame([("2.16.840.1.113883.6.1", "4548-4"), ("urn:oid:2.16.840.1.113883.6.96", "7"), ("9.9", "x")], "oid string, code string")
    assert [r[0] for r in pair.select(codes.code_iri(F.col("oid"), F.col("code"))).collect()] == ["http://loinc.org/4548-4", "http://snomed.info/id/7", "urn:oid:9.9:x"]
    assert spark.range(1).select(codes.vital_sign(F.lit("8867-4"))["unit"], codes.vital_sign(F.lit("1"))["unit"]).first()[:] == ("bpm", None)


@pytest.mark.parametrize(("raw", "want"), [("12 mg", 12.0), (" -3.5e2x", -350.0), (".5", 0.5), ("x1", None), ("", None), (None, None)])
def test_float_prefix(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "t string").select(text.float_prefix(F.col("t"))).first()[0] == want


def test_text_functions(spark):
    one = spark.range(1)
    assert one.select(text.medication_name(F.lit("Cetirizine  10 MG Oral Tablet"))).first()[0] == "cetirizine"
    assert one.select(text.frequency(F.lit("Twice a Day"))).first()[0] == "bid"
    assert one.select(text.code_system(F.lit("http://loinc.org"))).first()[0] == "loinc"
    u = "0b9c59ad-4c88-5552-a43e-92932cd170e5"
    assert one.select(text.uuids(F.lit(f"see {u.upper()} and {u}"))).first()[0] == [u, u]
