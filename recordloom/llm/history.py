"""New batches against everything accepted so far.

Method: content-defined chunking.  An input is parsed into its facts (patient,
code, instant, value) and its note.  A rolling hash over the note sets chunk
boundaries that depend on the content only, so an edit spoils the chunks around
it and no others.  Chunk hashes, scoped to the facts, are kept in a persistent
chunk-to-record table.  A new input looks up its chunks there (an equi-join), gets
the bytes it shares with every record that holds any of them, and repeats the
earliest record that shares `COVERAGE` of the smaller note.  What is accepted
appends its chunks; what repeats a record appends nothing.
"""

from __future__ import annotations

import datetime as dt
import re
import unicodedata
from collections.abc import Iterator
from decimal import Decimal, InvalidOperation

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.common import cut, scratch_path, small_side
from recordloom.sources import turtle

#: Part of the smaller note that must be shared.
COVERAGE = 0.45
#: Bytes under the rolling window; a boundary falls after one byte in `BOUNDARY` on average.
WINDOW, BOUNDARY = 5, 16
#: Longer stretches without a boundary (as periodic text may have) are cut every so many bytes.
LONGEST = 64
#: Rounds in which a batch is compared with its own earliest inputs; what is left is walked in order.
ROUNDS = 6
#: Parts of the tables by fact hash (a batch reads only those it needs), and waves of appends that are kept apart.
PARTS, MOST_WAVES = 16, 24

# The statements that make up a record.
FACTS, NOTE = ("patient", "testCode", "effectiveDate", "resultValue"), "note"


def statements(text: str) -> dict[str, str]:
    """Local name of each predicate to its (first) object, with prefixes expanded.

    Reads on over errors: a record whose line breaks or punctuation were damaged still
    states what can be made out.
    """
    prefixes: dict[str, str] = {}
    terms: list[tuple[str, str]] = []
    for kind, token in turtle.tokenise(text):
        if kind == "word":
            if terms and terms[-1] == ("at", "prefix") or token.lower() == "prefix":
                kind = "prefix"
            elif ":" in token:
                head, tail = token.split(":", 1)
                kind, token = "iri", prefixes[head] + tail if head in prefixes else token
            else:
                kind = "text"
        elif kind not in ("text", "iri", "at"):
            continue
        if kind == "iri" and terms and terms[-1][0] == "prefix":
            prefixes[terms[-1][1].rstrip(":")] = token
        terms.append((kind, token))
    found: dict[str, str] = {}
    for (kind, name), (kind2, value) in zip(terms, terms[1:]):
        if kind == "iri" and kind2 in ("iri", "text"):
            found.setdefault(re.split(r"[#/:]", name)[-1], value)
    return found


def instant(text: str) -> str:
    """An ISO time as UTC microseconds (zone-less is UTC); other text as it is."""
    try:
        at = dt.datetime.fromisoformat(text.strip())
    except ValueError:
        return text.strip()
    at = at.replace(tzinfo=dt.timezone.utc) if at.tzinfo is None else at
    return str((at - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1))


def number(text: str) -> str:
    """A decimal in one spelling; other text as it is."""
    try:
        return f"{Decimal(text.strip()).normalize():f}"
    except (InvalidOperation, ValueError):
        return text.strip()


def plain_note(text: str) -> str:
    """Lower case letters and digits in words: what layout and punctuation cannot change."""
    folded = unicodedata.normalize("NFKD", text).lower()
    return " ".join(re.findall(r"[a-z0-9]+", "".join(c for c in folded if not unicodedata.combining(c))) or folded.split())


_GEAR = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_GEAR[0] = 0
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 2**64)


def chunk(notes: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct chunk hashes of each note with their bytes.

    The notes are laid end to end with `WINDOW` zero bytes between them, so the rolling
    hash, the sum of the last `WINDOW` bytes' values each shifted by its age, is taken
    over all of them in `WINDOW` array additions.  A chunk's hash is a difference of
    prefix sums of ``value * base^i``, brought to the same place by a power of the
    base's inverse: equal content has an equal hash wherever it stands.
    """
    raw = [n.encode() for n in notes]
    pad = b"\0" * WINDOW
    b = np.frombuffer(pad + pad.join(raw) + pad, np.uint8)
    g = _GEAR[b]
    rolling = g.copy()
    for k in range(1, WINDOW):
        rolling[k:] += g[:-k] << np.uint64(7 * k)
    boundary = (rolling >> np.uint64(20)) % np.uint64(BOUNDARY) == 0
    longest = max(map(len, raw), default=0)
    forth, back = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(longest, x, np.uint64)])) for x in (_BASE, _BACK))
    out, at = [], WINDOW
    for r in raw:
        n = len(r)
        ends = np.flatnonzero(boundary[at : at + n]) + 1
        if n and (not len(ends) or ends[-1] != n):
            ends = np.append(ends, n)
        starts = np.concatenate([np.zeros(1, np.int64), ends])[: len(ends)]
        if (parts := -(-(ends - starts) // LONGEST)).sum() > len(parts):
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            starts = np.repeat(starts, parts) + nth * LONGEST
            ends = np.minimum(starts + LONGEST, np.repeat(ends, parts))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(g[at : at + n] * forth[:n])])
        h = (sums[ends] - sums[starts]) * back[starts]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(32))).view(np.int64)
        h, first = np.unique(h, return_index=True)
        out.append((h, (ends - starts)[first]))
        at += n + WINDOW
    return out


#: The one chunk of an empty note: it is covered by an empty note.
_EMPTY = (np.zeros(1, np.int64), np.ones(1, np.int64))
_PARSED = "input_id bigint, batch_id bigint, facts string, note string, hashes array<bigint>, sizes array<int>"


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lo in range(0, len(batch), 2000):
            part = batch.iloc[lo : lo + 2000]
            facts, notes = [], []
            for content in part["content"]:
                st = statements(content)
                if all(f in st for f in FACTS):
                    facts.append("\x01".join((st["patient"], st["testCode"], instant(st["effectiveDate"]), number(st["resultValue"]))))
                    notes.append(plain_note(st.get(NOTE, "")))
                else:  # no whole record: it repeats only what says the same throughout
                    whole = " ".join(content.split())
                    facts.append("\x02" + whole)
                    notes.append("")
            chunks = [(h, n) if len(h) else _EMPTY for h, n in chunk(notes)]
            yield pd.DataFrame(
                {"input_id": part["input_id"].values, "batch_id": part["batch_id"].values, "facts": facts, "note": notes,
                 "hashes": [h for h, _ in chunks], "sizes": [n.astype(np.int32) for _, n in chunks]}
            )


def parse(inputs: DataFrame, key: str = "input_id", batch: str = "report_id", content: str = "content") -> DataFrame:
    """Inputs as a fact hash (``scope``), exact note key and chunk hashes scoped to the facts; null contents are left out."""
    rows = inputs.where(F.col(content).isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).cast("bigint").alias("input_id"), F.col(batch).cast("bigint").alias("batch_id"), F.col(content).alias("content")
    )
    p = rows.mapInPandas(_parse, _PARSED)
    scope = F.xxhash64("facts", F.lit("scope"))
    same = [F.xxhash64("facts", "note", F.lit(s)).alias(f"same{i}") for i, s in ((1, "a"), (2, "b"))]
    return p.select(
        "input_id", "batch_id", *same, scope.alias("scope"),
        F.transform("hashes", lambda h: F.xxhash64(h, scope)).alias("hashes"), "sizes",
        F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"),
    )


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Inputs in order of scope and id against the accepted ones of their scope, whose chunks alone are held."""
    here, holders, totals = None, {}, {}
    for batch in batches:
        out = []
        for scope, i, hashes, sizes, total in batch[["scope", "input_id", "hashes", "sizes", "total"]].itertuples(index=False, name=None):
            if scope != here:
                here, holders, totals = scope, {}, {}
            shared: dict[int, int] = {}
            for h, n in zip(hashes, sizes):
                for r in holders.get(h, ()):
                    shared[r] = shared.get(r, 0) + int(n)
            kept = min((r for r, n in shared.items() if n >= COVERAGE * min(total, totals[r])), default=i)
            if kept == i:
                totals[i] = total
                for h in hashes:
                    holders.setdefault(h, []).append(i)
            out.append((i, kept))
        yield pd.DataFrame(out, columns=["input_id", "kept_id"])


class ChunkHistory:
    """The persistent chunk-to-record table of one corpus.

    Two append-only tables under `path`: ``records`` (record_id, scope, total) and
    ``chunks`` (hash, size, record_id, scope: the chunks of each accepted record), both in
    `parts` folders by fact hash.  A manifest, written last, names the waves that count:
    a crash between the tables leaves nothing half done, and a history that is opened
    again goes on where it stood.  A batch reads the ``records`` of the parts that its
    facts fall into and of the ``chunks`` only those of the records that share facts with
    it; it never compares with all history.  After `most_waves` appends the waves are
    rewritten as one.
    """

    CHUNKS = "hash bigint, size int, record_id bigint, scope bigint, part int"
    RECORDS = "record_id bigint, scope bigint, total bigint, part int"

    def __init__(self, spark: SparkSession, path: str, parts: int | None = None, most_waves: int = MOST_WAVES):
        self.spark, self.path, self.most_waves = spark, path.rstrip("/"), most_waves
        committed = [n for n in self._names("manifest") if self._exists(f"manifest/{n}/_SUCCESS")]
        self.generation = max((int(n.partition("=")[2]) for n in committed), default=0)
        self.waves, self.parts = [], parts or PARTS
        if self.generation:
            m = spark.read.schema("parts int, waves array<int>").json(f"{self.path}/manifest/generation={self.generation}").first()
            self.waves, self.parts = list(m.waves), m.parts

    def _names(self, folder: str) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []

    def _exists(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _table(self, name: str, schema: str, parts: list[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/{name}/wave={w}" for w in self.waves]
        if not paths:
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(schema + ", wave int").option("basePath", f"{self.path}/{name}").parquet(*paths).drop("wave")
        return df if parts is None or len(parts) == self.parts else df.where(F.col("part").isin(parts))

    def _write(self, name: str, wave: int, df: DataFrame) -> None:
        # A few sorted files per part, so that readers skip what lies outside their facts.
        df = df.withColumn("part", F.pmod("scope", F.lit(self.parts)).cast("int"))
        df.repartitionByRange("part", "scope").sortWithinPartitions("part", "scope").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/{name}/wave={wave}")

    def _commit(self, waves: list[int]) -> None:
        g = self.generation + 1
        self.spark.createDataFrame([(self.parts, waves)], "parts int, waves array<int>").coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/generation={g}")
        self.generation, self.waves = g, waves

    def compact(self) -> None:
        """All waves as one."""
        wave = max(self.waves) + 1
        for name, schema in (("records", self.RECORDS), ("chunks", self.CHUNKS)):
            self._write(name, wave, self._table(name, schema).drop("part"))
        self._commit([wave])

    def add(self, parsed: DataFrame) -> DataFrame:
        """Check a batch (or several) against history and itself, accept what is new; (kept_id, dup_id) of the rest.

        An input repeats the earliest accepted record that covers it.  Inputs of the batch
        are compared with each other too, in order of ``input_id``.  A batch that was
        accepted before changes nothing when it comes again.
        """
        batch = cut(parsed)
        same = ["same1", "same2"]
        # Exact copies throughout are one representative, whatever the size of their group.
        groups = cut(batch.groupBy(*same, "scope").agg(F.min("input_id").alias("input_id"), F.count("*").alias("n")))
        reps = groups.select("input_id", "scope")
        part = F.pmod("scope", F.lit(self.parts)).cast("int")
        touched = [r[0] for r in reps.select(part).distinct().collect()]  # at most `parts` rows
        # Chunks are scoped to the facts: only inputs whose facts occur again have any to share.
        records = cut(self._table("records", self.RECORDS, touched).join(small_side(reps.select("scope").distinct()), "scope", "left_semi"))
        again = reps.select("scope").unionByName(records.select("scope")).groupBy("scope").agg(F.count("*").alias("n")).where("n > 1").select("scope")
        rivals = reps.join(again, "scope", "left_semi").select("input_id")
        open_ = cut(batch.join(small_side(rivals), "input_id", "left_semi").select("input_id", "scope", "hashes", "sizes", "total"))
        decided = []
        if self.waves:
            past = self._table("chunks", self.CHUNKS, touched).join(small_side(records.select("scope").distinct()), "scope", "left_semi")
            covered = cut(self._covered(open_, past.select("hash", "record_id"), records.select("record_id", F.col("total").alias("e_total"))))
            decided.append(covered)
            open_ = cut(open_.join(covered, "input_id", "left_anti"))
        # The earliest undecided input of some facts is accepted; the others are compared with it.  Who is
        # covered leaves; the rest go round again.  One root per scope and round: nothing is paired twice.
        for k in range(ROUNDS + 1):
            alone = open_.groupBy("scope").agg(F.min("input_id").alias("root"), F.count("*").alias("n")).where("n > 1")
            rest = open_.join(alone, "scope").where(F.col("input_id") > F.col("root"))
            if k == ROUNDS:
                left = cut(open_.join(alone.select("scope"), "scope", "left_semi"))
                if not left.isEmpty():
                    walked = left.repartition("scope").sortWithinPartitions("scope", "input_id").mapInPandas(_walk, "input_id bigint, kept_id bigint")
                    decided.append(cut(walked.where("kept_id < input_id")))
                break
            rest = cut(rest.drop("n"))
            if rest.isEmpty():
                break
            roots = open_.join(rest.select(F.col("root").alias("input_id")).distinct(), "input_id", "left_semi")
            held = roots.select(F.col("input_id").alias("record_id"), F.explode("hashes").alias("hash"))
            covered = cut(self._covered(rest, held, roots.select(F.col("input_id").alias("record_id"), F.col("total").alias("e_total"))))
            decided.append(covered)
            open_ = cut(rest.drop("root").join(covered, "input_id", "left_anti"))
        links = decided[0] if decided else self.spark.createDataFrame([], "input_id bigint, kept_id bigint")
        for more in decided[1:]:
            links = links.unionByName(more)
        resolved = groups.join(links, "input_id", "left").where((F.col("n") > 1) | F.col("kept_id").isNotNull())
        resolved = resolved.select(*same, F.coalesce("kept_id", "input_id").alias("kept_id"))
        found = cut(batch.select("input_id", *same).join(resolved, same).where(F.col("kept_id") < F.col("input_id")).select("kept_id", F.col("input_id").alias("dup_id")))
        gone = found.select(F.col("dup_id").alias("input_id")).unionByName(records.select(F.col("record_id").alias("input_id")))
        new = cut(batch.join(small_side(gone), "input_id", "left_anti").select("input_id", "scope", "total", "hashes", "sizes"))
        wave = max(self.waves, default=-1) + 1
        self._write("chunks", wave, new.select(F.col("input_id").alias("record_id"), "scope", F.inline(F.arrays_zip(F.col("hashes").alias("hash"), F.col("sizes").alias("size")))))
        self._write("records", wave, new.select(F.col("input_id").alias("record_id"), "scope", "total"))
        self._commit([*self.waves, wave])
        if len(self.waves) > self.most_waves:
            self.compact()
        return found

    def _covered(self, inputs: DataFrame, held: DataFrame, totals: DataFrame) -> DataFrame:
        """(input_id, kept_id) of `inputs` covered by a record, the earliest that does.

        `held`: ``hash``, ``record_id``, all holders of every chunk.  The join is on the
        scoped chunk hash, so a hot scope spreads over its chunks.
        """
        chunks = inputs.select("input_id", "total", F.inline(F.arrays_zip(F.col("hashes").alias("hash"), F.col("sizes").alias("size"))))
        shared = chunks.join(held, "hash").where(F.col("record_id") <= F.col("input_id")).groupBy("input_id", "record_id", "total").agg(F.sum("size").alias("bytes"))
        enough = shared.join(totals, "record_id").where(F.col("bytes") >= COVERAGE * F.least("total", "e_total"))
        return enough.groupBy("input_id").agg(F.min("record_id").alias("kept_id"))


def find_repeats(spark: SparkSession, inputs: DataFrame, batches: DataFrame, waves: int = 1, path: str | None = None) -> DataFrame:
    """(kept_id, dup_id) of all inputs, the batches taken in order of ``imported_at`` in `waves` parts.

    Defined results: null ids or contents give no row; an input whose batch is unknown
    comes after all others; unparsable contents, and records without one of their facts,
    repeat only what says the same but for layout; an empty note repeats an empty note;
    an empty table gives no rows.  An input is compared with accepted records only, so
    the number of waves does not change the result, only how much is checked at a time.
    With `path` the history there is read and gone on with.
    """
    history = ChunkHistory(spark, path or scratch_path(spark, "chunk-history"))
    parsed = parse(inputs)
    if waves == 1:
        return history.add(parsed)
    parsed = cut(parsed)
    # Batches are dimension-like (one row an import); the wave of each follows from its rank in time.
    when = batches.groupBy(F.col("report_id").alias("batch_id")).agg(F.min("imported_at").alias("at"))
    t = F.unix_micros(F.col("at").cast("timestamp"))
    edges = when.select(t.alias("t")).approxQuantile("t", [i / waves for i in range(1, waves)], 0.001)
    wave = F.lit(0)
    for e in edges:
        wave = wave + F.when(t > e, 1).otherwise(0)
    placed = cut(parsed.join(small_side(when.select("batch_id", wave.alias("wave"))), "batch_id", "left").fillna({"wave": waves - 1}))
    found = None
    for w in range(waves):
        part = history.add(placed.where(F.col("wave") == w).drop("wave"))
        found = part if found is None else found.unionByName(part)
    return found
