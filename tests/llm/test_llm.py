"""The text operators: edge cases, brute force, exact round trips."""

from __future__ import annotations

import datetime as dt
import random
import string

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recordloom.llm import canonical, history, mixing, packing, queries, survivor, tokens, truncation

# --- history ---

history.PARTS = 2

NOTE = "The patient reports tingling in the left knee for six weeks, clearly worse after gardening. Lab values were 24.9 for vitamin D. Return sooner for fever."


def ttl(note=NOTE, patient="p1", code="C1", at="2024-01-01T10:00:00Z", value="1.50", style=0):
    if style == 0:
        return f'@prefix h: <http://h/> .\n<urn:x> a h:Lab ; h:patient <http://p/{patient}> ; h:testCode "{code}" ; h:effectiveDate "{at}" ; h:resultValue "{value}" ; h:note "{note}" .'
    return f'# copy <urn:y> <http://k/note> """{note}""" ; <http://k/resultValue> "{value}" ; <http://k/effectiveDate> "{at}" ; <http://k/testCode> "{code}" ; <http://k/patient> <http://p/{patient}> .'


INPUTS = [
    (1, 1, ttl()),
    (2, 1, ttl(value="1.5", at="2024-01-01T11:00:00+01:00", style=1)),  # written differently
    (3, 1, ttl(patient="p2")),  # another patient
    (4, 2, ttl(NOTE.upper().replace(",", " -").replace("KNEE", "KENE"))),  # layout and a typing error
    (5, 2, ttl(value="1.6")),
    (6, 2, ttl(at="2024-01-01T10:00:00+01:00")),
    (7, 3, ttl("Something else entirely was noted on this day by another person, quite unlike the first.")),  # same facts, other note
    (8, 3, ttl(NOTE.replace("Lab values were 24.9 for vitamin D. ", ""), patient="p2")),
    (9, 3, None), (10, 3, ""), (11, 3, " "), (12, 3, "no turtle at all"), (13, 3, "no  turtle\nat all"), (14, None, ttl("", patient="p3")), (15, 9, ttl("", patient="p3", style=1)),
    (16, 9, ttl(("word " * 20_000).strip(), patient="p4")), (17, 9, ttl(("word " * 20_000).strip() + " end", patient="p4")),
]
REPEATS = {(1, 2), (1, 4), (3, 8), (10, 11), (12, 13), (14, 15), (16, 17)}


def _inputs(spark, rows=INPUTS):
    return spark.createDataFrame([(*r, "extra", 0) for r in rows], "input_id long, report_id long, content string, hash string, total long")


def _batches(spark):
    t = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, t + dt.timedelta(days=i)) for i in (1, 2, 3, 9)], "report_id long, imported_at timestamp_ntz")


@pytest.mark.parametrize("waves", [1, 3])
def test_repeats_do_not_depend_on_waves(spark, waves):
    rows = [r for r in INPUTS if r[1] is not None] if waves > 1 else INPUTS
    got = {tuple(r) for r in history.find_repeats(spark, _inputs(spark, rows), _batches(spark), waves).collect()}
    assert got == {(a, b) for a, b in REPEATS if waves == 1 or 14 not in (a, b)}


def test_history_empty_and_table_cost(spark, tmp_path):
    assert history.find_repeats(spark, _inputs(spark).limit(0), _batches(spark)).count() == 0
    h = history.ChunkHistory(spark, str(tmp_path / "h"))
    h.add(history.parse(_inputs(spark, INPUTS[:3])))
    again = h.add(history.parse(_inputs(spark, [(101, 5, ttl()), (102, 5, ttl(patient="p9"))])))
    assert [tuple(r) for r in again.collect()] == [(1, 101)]
    # A repeat adds nothing to the table but its spelling.
    assert sorted(r.record_id for r in spark.read.parquet(str(tmp_path / "h/records")).collect()) == [1, 3, 102]


def test_history_goes_on_after_reopening(spark, tmp_path):
    path = str(tmp_path / "h")
    first = history.find_repeats(spark, _inputs(spark, INPUTS[:3]), _batches(spark), path=path)
    assert {tuple(r) for r in first.collect()} == {(1, 2)}
    h = history.ChunkHistory(spark, path, most_waves=2)
    assert h.waves == [0]
    assert [tuple(r) for r in h.add(history.parse(_inputs(spark, [(101, 5, ttl()), (102, 5, ttl(patient="p9"))]))).collect()] == [(1, 101)]
    # The same batch once more changes nothing; a write that was not committed does not count.
    h._write("records", 2, spark.createDataFrame([(7, 7, 7)], "record_id long, scope long, total long"))
    h = history.ChunkHistory(spark, path, most_waves=2)
    assert [tuple(r) for r in h.add(history.parse(_inputs(spark, [(101, 5, ttl()), (102, 5, ttl(patient="p9"))]))).collect()] == [(1, 101)]
    assert len(h.waves) == 1  # compacted
    h = history.ChunkHistory(spark, path)
    assert sorted(r.record_id for r in h._table("records", h.RECORDS).collect()) == [1, 3, 102]
    assert [tuple(r) for r in h.add(history.parse(_inputs(spark, [(201, 5, ttl(patient="p9"))]))).collect()] == [(102, 201)]


def _five():
    """Notes 1-4 each hold a quarter of note 5 (and much else); note 6 is note 5 and two words more."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices(string.ascii_lowercase, k=7))
    quarters = [" ".join(word() for _ in range(12)) for _ in range(4)]
    rows = [(i + 1, 1, ttl(" ".join(word() for _ in range(40)) + " " + q + " " + " ".join(word() for _ in range(40)))) for i, q in enumerate(quarters)]
    five = " ".join(quarters)
    return [*rows, (5, 2, ttl(five)), (6, 2, ttl(five + " two more"))]


@pytest.mark.parametrize("waves", [1, 2])
def test_every_holder_of_a_chunk_is_a_candidate(spark, waves):
    got = {tuple(r) for r in history.find_repeats(spark, _inputs(spark, _five()), _batches(spark), waves).collect()}
    assert (5, 6) in got and not {d for _, d in got} & {1, 2, 3, 4}


def test_coverage_decides_between_records_of_the_same_facts(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices(string.ascii_lowercase, k=7))
    short = " ".join(word() for _ in range(20))
    notes = [" ".join(word() for _ in range(30)) for _ in range(9)]  # more roots than rounds: the rest is walked
    rows = [(i + 1, 1, ttl(n)) for i, n in enumerate(notes)] + [(20, 2, ttl(short))]
    rows += [(30 + i, 3, ttl(n.replace(n.split()[3], "zz"))) for i, n in enumerate(notes)]
    rows += [(50, 3, ttl(" ".join(word() for _ in range(200)) + " " + short + " " + " ".join(word() for _ in range(200)))), (51, 3, ttl("Nothing of all this"))]
    want = {(i + 1, 30 + i) for i in range(9)} | {(20, 50)}  # a short note repeated whole in a long one counts
    for waves in (1, 2):
        assert {tuple(r) for r in history.find_repeats(spark, _inputs(spark, rows), _batches(spark), waves).collect()} == want
    lines = "@prefix a: <http://a/> .\n@prefix b: <http://b/> .\n@prefix c: <http://c/> .\n"
    odd = [(1, 1, lines + "a:x b:y c:z ."), (2, 1, lines + "c:u a:v b:w ."), (3, 2, lines + "a:x  b:y\nc:z .")]
    assert {tuple(r) for r in history.find_repeats(spark, _inputs(spark, odd), _batches(spark)).collect()} == {(1, 3)}


def test_hot_group_of_variants(spark):
    rng = random.Random(1)
    words = [rng.choice(string.ascii_lowercase) + "".join(rng.choices(string.ascii_lowercase, k=6)) for _ in range(60)]
    rows = [(i, 1, ttl(" ".join(w if k != i % 60 else "zz" for k, w in enumerate(words)))) for i in range(1, 200)]
    got = {tuple(r) for r in history.find_repeats(spark, _inputs(spark, rows), _batches(spark)).collect()}
    assert got == {(1, i) for i in range(2, 200)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abcé ", max_size=80), min_size=1, max_size=6), st.text(alphabet="xyz ", max_size=20))
def test_chunks_depend_on_content_only(notes, prefix):
    alone = [history.chunk([n])[0] for n in notes]
    together = history.chunk(notes)
    for (h1, n1), (h2, n2) in zip(alone, together):
        assert np.array_equal(h1, h2) and np.array_equal(n1, n2)
    for n, (_, sizes) in zip(notes, together):
        assert sizes.sum() <= len(n.encode())
    moved = history.chunk([prefix + n + n for n in notes])
    for n, (h, sizes), (m, _) in zip(notes, together, moved):
        lost = sizes[~np.isin(h, m)]
        assert len(lost) <= history.WINDOW + 1 + len(n.encode()) // history.LONGEST  # within a window of the seam, the last, and stretches without boundary


# --- canonical ---

TERMS = [(1, "fosdelxomab", ["Haldavux", "Sadrofenyn"]), (2, "tizabazophmine", []), (3, "dronavavex", None), (4, "alpha complex", ["Beta Forte"]), (5, "dronauphrine", ["Ä-Name"]), (6, "zyx", []), (7, "k2", [])]
TEXTS = {
    "Fosdelxomab 25 mg": 1, "HALDAVUX": 1, "*haldavuxx*  5mcg": 1, "f o s d e l x o m a b (refill)": 1, "fosd- elxomab tab": 1, "fosdelx.omab": 1, "F0sd3lx0mab": 1, "fosdel. 40mg": 1, "fosdelmoxab": 1,
    "take tizabazophmine HCl": 2, "tiazbazophmine": 2, "Dronavávex": 3, "dronauphrne": 5, "alpha complex 3": 4, "beta fort": 4, "complex alpha": 4, "zyx 5 mg": 6, "K2": 7, "zyw": 0,
    "see list": 0, "": 0, "  ": 0, "?": 0, "dron": 0, "zenokaaxin 5 mg": 0, "x" * 100_000: 0, "tablet " * 3000: 0, "dronavavex (dronavavex)": 3,
}


def test_canonical(spark):
    ref = spark.createDataFrame([(*t, "x") for t in TERMS], "term_id long, generic_name string, brand_names array<string>, token string")
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(900, None, "x")]
    df = spark.createDataFrame(rows, "med_id long, medication_text string, word string")
    got = {r.med_id: r.term_id for r in canonical.canonicalise(df, ref, "med_id", "medication_text").collect()}
    assert {t[:40]: (w, got.get(i)) for i, (t, w) in enumerate(TEXTS.items()) if got.get(i) != w} == {}
    assert 900 not in got and len(got) == len(TEXTS)
    assert {r.term_id for r in canonical.canonicalise(df, ref.limit(0), "med_id", "medication_text").collect()} == {0}
    assert canonical.canonicalise(df.limit(0), ref, "med_id", "medication_text").count() == 0


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_repair_finds_every_near_pair(spark):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdeinor", k=rng.randint(5, 14))) for _ in range(60)]
    found = set()
    for w in vocabulary:
        for _ in range(12):
            t = list(w)
            for _ in range(rng.randint(0, 3)):
                k, op = rng.randrange(len(t)), rng.randrange(3)
                t[k : k + (op != 1)] = [] if op == 0 and len(t) > 4 else [rng.choice("abcdeinorz")]
            found.add("".join(t))
    allowed = lambda n: 3 if n >= 9 else 2 if n >= 6 else 1
    want = {(t, v) for t in found for v in set(vocabulary) if len(t) >= 4 and _edits(t, v) <= allowed(min(len(t), len(v)))}
    got = canonical.repair(spark.createDataFrame([(t,) for t in found], "token string"), spark.createDataFrame([(v,) for v in set(vocabulary)], "word string"))
    assert want <= {(r.token, r.word) for r in got.collect()}


# --- survivor ---


def _member(uri, source, at, props):
    return (uri, "T", source, None, at, {k: [(v, None, False) for v in vs] if vs is not None else None for k, vs in props.items()} if props is not None else None)


MEMBER = "uri string, record_type string, source_system string, source_identity string, last_updated timestamp_ntz, properties map<string, array<struct<value:string, datatype:string, is_iri:boolean>>>"
JOURNAL = f"merge_id long, canonical_uri string, discarded array<struct<{MEMBER.replace(' string', ':string').replace(' timestamp_ntz', ':timestamp_ntz').replace(' map', ':map')}>>, trust string"


def _day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def test_survivors(spark):
    rows = [
        (1, "g1", [_member("a", "good", _day(9), {"name": ["N/A"], "city": ["  "], "x": ["A", "B"]}), _member("b", "mid", _day(5), {"name": ["Bo"], "city": ["Ulm"], "y": None}), _member("c", "bad", _day(1), {"name": ["Al"], "z": ["00/00/0000", "***"]})], "t"),
        (2, "g1", [_member("a", "good", _day(9), {"name": ["N/A"]})], "t"),  # journaled twice
        (3, "g2", None, "t"), (4, "g3", [], "t"), (5, None, [_member("a", "good", _day(1), {"name": ["Lost"]})], "t"), (6, "g4", [None, _member("q", None, None, {"name": ["Only"]})], "t"), (7, "g5", [_member("a", "good", _day(1), None)], "t"),
    ]
    # Elsewhere 'active' has often been followed by 'stopped'.
    rows += [(100 + i, f"h{i}", [_member("a", "mid", _day(1), {"status": ["active"]}), _member("b", "mid", _day(40 * (i % 3) + 2), {"status": ["stopped"]})], "t") for i in range(9)]
    rows += [(200, "u1", [_member("a", "good", None, {"status": ["active"]}), _member("b", "bad", None, {"status": ["stopped"]})], "t")]
    rows += [(201, "u2", [_member("a", "good", None, {"status": ["on hold"]}), _member("b", "bad", None, {"status": ["stopped"]})], "t")]
    df = spark.createDataFrame(rows, JOURNAL)
    src = spark.createDataFrame([("good", 1), ("mid", 2), ("bad", 3), ("good", 1)], "source_system string, trust_rank int")
    got = {(r.canonical_uri, r.predicate): r.surviving_value for r in survivor.survivors(df, src).collect()}
    assert {k: v for k, v in got.items() if k[0] in ("g1", "g4")} == {("g1", "name"): "Bo", ("g1", "city"): "Ulm", ("g1", "x"): "A", ("g4", "name"): "Only"}
    assert {v for k, v in got.items() if k[0][0] == "h"} == {"stopped"}
    assert (got["u1", "status"], got["u2", "status"]) == ("stopped", "on hold")  # learned order goes before trust, else trust decides
    assert not {k for k in got if k[0] in (None, "g2", "g3", "g5")}
    without = survivor.learn_precedence
    try:
        survivor.learn_precedence = lambda said: without(said).limit(0)
        plain = {(r.canonical_uri, r.predicate): r.surviving_value for r in survivor.survivors(df, src).collect()}
    finally:
        survivor.learn_precedence = without
    assert plain["u1", "status"] == "active"
    assert survivor.survivors(df.limit(0), src).count() == 0


def test_precedence_across_months(spark):
    said = spark.createDataFrame([("g", "p", f"v{i}", _day(20 * i), "u", 0, 1) for i in range(8)], "canonical_uri string, predicate string, value string, at timestamp_ntz, uri string, place int, trust long")
    many = said
    for k in range(1, 3):
        many = many.unionByName(said.withColumn("canonical_uri", F.lit(f"g{k}")))
    got = {(r.earlier, r.later) for r in survivor.learn_precedence(many).collect()}
    assert got == {(f"v{i}", f"v{i + 1}") for i in range(7)}


def test_order_is_closed_and_circles_decide_nothing(spark):
    order = spark.createDataFrame([("p", "a", "b"), ("p", "b", "c"), ("p", "x", "y"), ("p", "y", "x"), ("q", "c", "a")], "predicate string, earlier string, later string")
    groups = [("g1", "p", "a"), ("g1", "p", "c"), ("g2", "p", "x"), ("g2", "p", "y"), ("g3", "q", "a"), ("g3", "q", "c"), ("g4", "p", "z")]
    got = survivor.latest_by_precedence(spark.createDataFrame(groups, "canonical_uri string, predicate string, value string"), order)
    assert {tuple(r) for r in got.collect()} == {("g1", "p", "c"), ("g2", "p", "x"), ("g2", "p", "y"), ("g3", "q", "a"), ("g4", "p", "z")}


def test_placeholders_are_learned(spark):
    rows = [(f"p{p}", v) for p in range(12) for v in (["[pending]", f"v{p}"] if p % 2 else ["Pending", "yes"])] + [("p1", "yes")] * 50
    df = spark.createDataFrame(rows + [("p0", "x" * 1000)], "predicate string, value string")
    got = {r.key for r in survivor.learn_placeholders(df).collect()}
    assert got == {r.k for r in spark.createDataFrame([("pending",)], "v string").select(F.xxhash64("v").alias("k")).collect()}  # 'yes' under half of them is a value
    assert survivor.learn_placeholders(df.where("predicate < 'p2'")).count() == 0 and survivor.learn_placeholders(df.limit(0)).count() == 0


# --- packing ---


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=120), st.integers(1, 100), st.integers(1, 8))
def test_windows_hold_everything_once(sizes, capacity, most):
    w, out = packing.Windows(capacity, most), []
    for i, s in enumerate(sizes):
        out += w.put(min(s, capacity), i)
        assert len(w.rooms) <= most
    out += w.rest()
    assert sorted(i for *_, items in out for i in items) == list(range(len(sizes)))
    assert all(fill == sum(min(sizes[i], capacity) for i in items) <= capacity for _, fill, items in out)


def test_packing(spark):
    rng = random.Random(3)
    sizes = [rng.choice([0, 1, 7, 63, 64, 65, 128, 500, None, *range(2, 60)]) for _ in range(3000)]
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)], "doc_id long, n_tokens long, fill string").repartition(40)
    p = packing.pack(df, 64, 32).toPandas()
    assert p.groupby("container_id")["n_tokens"].sum().max() <= 64
    for doc, part in p.sort_values(["doc_id", "piece"]).groupby("doc_id"):
        assert part["n_tokens"].sum() == sizes[doc] and (len(part) == 1 or sizes[doc] > 64)
        assert part["start_token"].tolist() == np.concatenate([[0], part["n_tokens"].cumsum()[:-1]]).astype(int).tolist()
    assert set(p["doc_id"]) == {i for i, s in enumerate(sizes) if s is not None}
    total = sum(s or 0 for s in sizes)
    rooms: list[int] = []  # best fit, the largest first, with all windows open
    for s in sorted((s % 64 if s > 64 else s for s in sizes if s), reverse=True):
        fits = [k for k, room in enumerate(rooms) if room >= s]
        if fits:
            rooms[min(fits, key=lambda k: rooms[k])] -= s
        else:
            rooms.append(64 - s)
    assert p["container_id"].nunique() <= 1.05 * (len(rooms) + sum(s // 64 for s in sizes if s and s > 64)) + 2
    c = packing.containers(packing.pack(df, 64, 1), 64)
    assert c.agg(F.sum("fill_tokens")).first()[0] == total
    assert packing.pack(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, 0)


# --- mixing ---


def test_rake_meets_targets():
    rng = np.random.default_rng(1)
    cells = pd.DataFrame([(s, l, t, int(rng.integers(100, 5000))) for s in "abcd" for l in "xyz" for t in "uv"], columns=["source", "language", "topic", "tokens"])
    targets = pd.DataFrame({"source": list("abce"), "target_share": [0.5, 0.3, 0.2, 0.0], "max_repeats": [3, 1, 2, 1]})
    c = mixing.rake(cells, targets)
    c["mass"] = c["tokens"] * c["weight"]
    got = c.groupby("source")["mass"].sum()
    assert np.allclose((got / got.sum())[["a", "b", "c"]], [0.5, 0.3, 0.2], atol=1e-6) and got["d"] == 0
    assert (c["weight"] <= c["max_repeats"] + 1e-9).all()
    assert np.isclose(max((got / cells.groupby("source")["tokens"].sum() / targets.set_index("source")["max_repeats"])[["a", "b", "c"]]), 1)  # the total is the largest possible


def test_mix(spark):
    rng = random.Random(5)
    rows = [(i, rng.choices(["big", "mid", "tiny", "none", None], [60, 30, 3, 5, 2])[0], rng.choice(["en", "de", None]), rng.choice(["a", "b"]), rng.choice([None, 0, *range(5, 200)]), "x") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, language string, topic string, n_tokens long, weight string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.2, 10), ("absent", 0.0, 1)], "source string, target_share double, max_repeats int")
    got = mixing.mix(df, targets).cache()
    s = {r.source: r for r in mixing.shares(got, targets).collect()}
    for r in s.values():
        assert abs(r.reached_share - r.target_share) < 0.01 and r.repeats_used <= r.max_repeats
    assert got.count() == got.select("doc_id").distinct().count() and got.where("n_tokens IS NULL OR n_tokens = 0").count() == 0
    assert sorted(map(tuple, mixing.mix(df.repartition(7), targets).collect())) == sorted(map(tuple, got.collect()))
    assert mixing.mix(df.limit(0), targets).count() == 0 and mixing.mix(df, targets.limit(0)).count() == 0


def test_token_sizes(spark):
    pytest.importorskip("tiktoken")
    texts = ["", "Hello world", "é" * 100, "a" * 200_000, None, "<|endoftext|>"]
    df = spark.createDataFrame([(i, t, 99) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens long")
    got = {r.doc_id: r.n_tokens for r in tokens.with_sizes(df).collect()}
    assert got[0] == 0 and got[1] == 2 and got[4] is None and got[5] > 1 and got[3] > 1000
    enc = tokens.encoding(tokens.TOKENIZER)
    assert all(enc.decode(enc.encode_ordinary(t)) == t for t in texts if t is not None)


# --- truncation ---


def _corpus():
    rng = random.Random(11)
    subjects, verbs, things = ["The nurse", "A doctor", "The clinic", "Her brother"], ["ordered", "reviewed", "received", "described"], ["a stool sample", "the left knee", "two copies of the letter", "some of the results for übung"]
    def sentence():
        return f"{rng.choice(subjects)} {rng.choice(verbs)} {rng.choice(things)} on {rng.randint(1, 28)} March."
    whole = [" ".join(sentence() for _ in range(rng.randint(2, 12))) for _ in range(900)]
    rows, cut_ = [], set()
    for i, t in enumerate(whole):
        kind = i % 9
        if kind == 0 and len(t.encode()) > 256:  # a byte limit of one source
            rows.append((i, "limited", t.encode()[:256].decode(errors="ignore")))
            cut_.add(i)
        elif kind == 1:  # broken off inside a word
            k = len(t) // 2
            while not (t[k - 1].isalpha() and t[k].isalpha() and t[k - 3 : k].isalpha()):
                k += 1
            rows.append((i, "free", t[:k]))
            cut_.add(i)
        elif kind == 2:
            rows.append((i, "free", t + "\n\nSigned: Dr. No"))
        elif kind == 3:
            rows.append((i, "free", t + "\n- a stool sample"))
        elif kind == 4:
            rows.append((i, "limited", t.removesuffix(".") if i % 2 else t))
        else:
            rows.append((i, "free" if kind < 7 else None, t))
    rows += [(5000, "free", None), (5001, "free", ""), (5002, "free", "   "), (5003, "free", "..."), (5004, "free", "Nothing was foun�"), (5005, "free", rows[1][2])]
    return rows, cut_ | {5004, 5005}


def test_truncation(spark):
    rows, want = _corpus()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, text string, form string")
    limits = truncation.field_limits(df.where("text IS NOT NULL")).collect()
    assert [(r.source, r.form, r.limit_length) for r in limits] == [("limited", "utf8", 256)]
    flags = truncation.judged(df).cache()
    got = {r.doc_id for r in flags.where("is_cut").collect()}
    assert flags.count() == len(rows)
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.02 * len(want), (sorted(want - got)[:5], sorted(got - want)[:5])
    assert {5004, 5005} <= got and not got & {5000, 5001, 5002, 5003}
    r = {x.source: x for x in truncation.rates(flags).collect()}
    assert r["limited"].n_at_limit > 50 and r["free"].n_documents > 300
    assert truncation.judged(df.limit(0)).count() == 0


def test_several_limits_of_a_source(spark):
    rng = random.Random(2)
    text = lambda: " ".join("".join(rng.choices(string.ascii_lowercase, k=rng.randint(3, 9))) for _ in range(300))
    rows = [(i, "two", text()[: 255 if i % 2 else 900]) for i in range(240)] + [(1000 + i, "short", text()[:64]) for i in range(60)]
    rows += [(2000 + i, s, text()[: rng.randint(20, 1500)] + ".") for i, s in enumerate(["two", "short"] * 400)]
    rows += [(4000 + i, "free", text()[:80] + ".") for i in range(60)]  # just as long, but whole
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {(r.source, r.form, r.limit_length): r.n_texts for r in truncation.field_limits(df).collect()}
    assert set(got) == {("two", "chars", 255), ("two", "chars", 900), ("short", "chars", 64)} and all(n >= 55 for n in got.values())


def test_cut_endings_are_no_evidence_for_themselves(spark):
    whole = [f"Visit {w} went well. She says the left knee hurts {w}." for w in ("often", "rarely", "today", "again", "daily", "badly", "less", "more")]
    cut_ = ["Seen in March. For a week now the left knee"] * 20 + ["Seen in March. For a week now the left knee \n"]
    rows = [(i, "free", t) for i, t in enumerate([*whole, *cut_, "Seen in May. He says the left"])]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert {r.doc_id for r in truncation.judged(df).where("is_cut").collect()} == set(range(len(whole), len(rows)))


def test_storage_lengths(spark):
    text = 'a<b> & "q" \'s\'\n\té 你 𝄞\\'
    forms = spark.createDataFrame([(text,)], "text string").select(*[c.alias(n) for n, c in truncation.storage_lengths(F.col("text")).items()]).first().asDict()
    import html
    import json

    assert forms["chars"] == len(text) and forms["utf8"] == len(text.encode()) and forms["utf16"] == len(text.encode("utf-16-le"))
    assert forms["chars_crlf"] == len(text.replace("\n", "\r\n"))
    plain = html.escape(text, quote=True).replace("&#x27;", "'")
    assert forms["chars_entities"] == len(plain) and forms["chars_entities_apos"] == len(plain.replace("'", "&#39;"))
    assert forms["chars_json"] == len(json.dumps(text, ensure_ascii=False)) - 2 and forms["ascii_json"] == len(json.dumps(text)) - 2


def test_whole_tables(spark, sf):
    for name, q in queries.QUERIES.items():
        assert q(spark, sf).count() > 0 or name in ("p10_limits",), name
