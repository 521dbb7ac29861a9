"""Texts that were cut off before their end.

Method: the length of each text is recomputed under several storage forms (code
points, UTF-8, UTF-16, entity escapes, JSON escapes, CRLF line ends).  Grouped by
source and form, a hidden field limit shows as a length that far more distinct
texts have than its neighbours.  Then the endings are inspected: a text that does
not close a sentence is judged by its last words, which all texts of the corpus
either use to close something (a sentence, a line, a text) or only pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordloom.common import cut, small_side

#: A limit: so many distinct texts, and so many times the mean of the lengths around.
LEAST_TEXTS, EXCESS = 8, 8.0
#: Part of the texts at a limit that may close a sentence.
MOST_CLOSED = 0.4
#: Lengths around that are compared, without the nearest (a cut inside a character shortens the text by up to 3 bytes).
AROUND, NEAREST = 40, 4
#: Shortest length that can be a field limit.
SHORTEST_LIMIT = 24
#: Last words close something if this part of their uses does, given enough uses of three, two or one words.
CLOSING_RATE, USES = 0.03, (4, 8, 30)
#: A number with fewer digits is broken off if the longer ones are so many times as frequent.
RARE = 20
_STOP, _END = "¶", "¶¶"


def storage_lengths(text: Column) -> dict[str, Column]:
    """Length of a text in each storage form; of forms that agree the first is reported."""

    def count(*ascii_chars: str) -> Column:
        """Occurrences by the bytes that go when they are removed (a byte search, unlike a translation)."""
        return sum((utf8 - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in ascii_chars), F.lit(0))

    chars, utf8 = F.length(text), F.octet_length(text)
    plain = utf8 == chars  # ASCII throughout: nothing to search for
    newlines, apostrophes, double = count("\n"), count("'"), count('"')
    astral = F.when(plain, 0).otherwise(F.length(F.regexp_replace(text, r"[\x{10000}-\x{10FFFF}]", "..")) - chars)
    entities = count("&") * 4 + count("<", ">") * 3 + double * 5
    escapes = double + newlines + count("\\", "\r", "\t")
    numeric = F.when(plain, chars).otherwise(F.length(F.regexp_replace(F.regexp_replace(text, r"[\x{80}-\x{3E7}]", "123456"), r"[\x{3E8}-\x{270F}]", "1234567")))
    # As an escape a character of the first plane takes 6 letters, a later one 12.
    ascii_json = F.when(plain, chars).otherwise(F.length(F.regexp_replace(text, r"[\x{80}-\x{FFFF}]", "123456")) + 11 * astral)
    return {
        "chars": chars,
        "utf8": utf8,
        "utf16": (chars + astral) * 2,
        "chars_crlf": chars + newlines,
        "utf8_crlf": utf8 + newlines,
        "chars_entities": chars + entities,
        "utf8_entities": utf8 + entities,
        "chars_entities_apos": chars + entities + apostrophes * 4,
        "ascii_entities": numeric + entities,
        "chars_json": chars + escapes,
        "utf8_json": utf8 + escapes,
        "ascii_json": ascii_json + escapes,
    }


def _tail(text: Column) -> Column:
    """The end of a text, without blanks after it."""
    return F.rtrim(F.regexp_replace(F.substring(text, -200, 200), r"\s+$", ""))


def _closed(tail: Column) -> Column:
    return tail.rlike(r"(?<![.])[.!?][\"'”»)\]]*$")


def field_limits(docs: DataFrame) -> DataFrame:
    """(source, form, limit_length, n_texts, n_around) of each hidden limit of a source, of which it may have several.

    `docs`: ``source``, ``text``.  Copies count once.  A text at several limits (as one
    form of it often goes with another) speaks for the one with the most texts, then the
    plainer form, then the longer; a limit must stand out by the texts that speak for it,
    and most of these must not close a sentence (as messages that just are as long do).
    """
    forms = storage_lengths(F.col("text"))
    sizes = F.array(*[c.cast("int") for c in forms.values()])
    # Texts are told apart by 128 bits of hash, so that the texts themselves stay where they are.
    texts = docs.select("source", F.xxhash64("text", F.lit("a")).alias("t1"), F.xxhash64("text", F.lit("b")).alias("t2"), sizes.alias("sizes"), _closed(_tail(F.col("text"))).alias("closed"))
    distinct = cut(texts.dropDuplicates(["source", "t1", "t2"]))
    lengths = distinct.select("source", "t1", "t2", "closed", F.posexplode("sizes").alias("rank", "length"))
    counts = lengths.groupBy("source", "rank", "length").agg(F.count("*").alias("n"))
    # One row per length a source has: a few thousand at most, however many texts.
    near = W.partitionBy("source", "rank").orderBy("length")
    total, inner = F.sum("n").over(near.rangeBetween(-AROUND, AROUND)), F.sum("n").over(near.rangeBetween(-NEAREST, NEAREST))
    around = (total - inner) / (2 * (AROUND - NEAREST))
    stands_out = (F.col("n") >= LEAST_TEXTS) & (F.col("n") >= EXCESS * (F.col("around") + 1))
    spikes = counts.withColumn("around", around).where((F.col("length") >= SHORTEST_LIMIT) & stands_out)
    named = small_side(spikes.select(F.col("source").alias("s_source"), F.col("rank").alias("s_rank"), F.col("length").alias("s_length"), "n", "around"))
    here = lengths.join(named, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("rank") == F.col("s_rank")) & (F.col("length") == F.col("s_length")))
    best = here.groupBy("source", "t1", "t2", "closed").agg(F.max(F.struct("n", (-F.col("rank")).alias("minus"), "length", "around")).alias("s"))
    said = best.groupBy("source", (-F.col("s.minus")).alias("rank"), "s.length", "s.around").agg(F.count("*").alias("n"), F.count_if("closed").alias("n_closed"))
    said = said.where(stands_out & (F.col("n_closed") <= MOST_CLOSED * F.col("n")))
    name = F.element_at(F.array(*[F.lit(n) for n in forms]), F.col("rank") + 1)
    return said.select("source", name.alias("form"), F.col("length").cast("bigint").alias("limit_length"), F.col("n").alias("n_texts"), F.round("around", 3).alias("n_around"))


def _words(text: Column) -> Column:
    """Lower-case words with digits as 0; ``¶`` where a sentence or line closes."""
    t = F.translate(F.lower(text), "123456789", "0" * 9)
    t = F.regexp_replace(t, r"[.!?]+[\"'”»)\]]*(?=\s|$)|\s*\n\s*", f" {_STOP} ")
    t = F.regexp_replace(t, r"[,;:()\[\]\"“”«»…*]", " ")
    return F.filter(F.split(t, r"\s+"), lambda w: w != "")


def distinct_texts(docs: DataFrame) -> DataFrame:
    """Each ``text`` of `docs` (with ``doc_id``) once, without blanks at its end.

    Copies are told by hash, and the first of them stands for all: no text is moved.
    (Rows repeated under one id count as often as they come.)
    """
    hashed = docs.select("doc_id", F.regexp_replace("text", r"\s+$", "").alias("text")).withColumns({"t1": F.xxhash64("text", F.lit("a")), "t2": F.xxhash64("text", F.lit("b"))})
    again = small_side(hashed.groupBy("t1", "t2").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1").drop("n"))
    return hashed.join(again, ["t1", "t2"], "left").where(F.col("first_id").isNull() | (F.col("doc_id") == F.col("first_id"))).select("text")


def word_uses(docs: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Uses over all distinct texts, in one pass, of the words that `ends` (``w1``, ``w2``, ``w3``) are about.

    The first table has (w1, w2, w3, uses, closings, endings) of triples whose last word
    ends some text, and with a null ``w1`` of other words after the same ``w2``;
    ``closings`` are followed by a full stop or line end, ``endings`` by nothing.  The
    second has lines of one word, by the word before the line.
    """
    words = F.concat(F.array(F.lit(_STOP), F.lit(_STOP)), F.col("words"), F.array(F.lit(_END)))
    grams = distinct_texts(docs).select(_words(F.col("text")).alias("words")).select(words.alias("w"))
    size = F.size("w")
    zipped = F.arrays_zip(
        F.col("w").alias("a"), F.slice("w", F.lit(2), size).alias("b"), F.slice("w", F.lit(3), size).alias("c"), F.slice("w", F.lit(4), size).alias("d")
    )
    rows = grams.select(F.inline(zipped)).toDF("w1", "w2", "w3", "next").where(F.col("next").isNotNull() & (F.col("w3") != _STOP))
    last = small_side(ends.select("w3").distinct().withColumn("is_last", F.lit(True)))
    led = small_side(ends.where(F.col("w2") != _STOP).select("w2").distinct().withColumn("is_led", F.lit(True)))
    # A line of one word, as a name under a greeting: what counts is the line above.
    lone = small_side(ends.where(F.col("w2") == _STOP).select("w1").distinct().withColumn("is_lone", F.lit(True)))
    near = rows.join(last, "w3", "left").join(led, "w2", "left").join(lone.withColumn("w2", F.lit(_STOP)), ["w1", "w2"], "left").where("is_last OR is_led OR is_lone")
    of_word = F.when(F.col("is_last") | F.col("is_led"), F.struct(F.lit(False).alias("alone"), F.when(F.col("is_last"), F.col("w1")).alias("w1"), "w2", "w3"))
    of_line = F.when(F.col("is_lone"), F.struct(F.lit(True).alias("alone"), F.col("w1").alias("w1"), F.lit(None).cast("string").alias("w2"), F.lit(None).cast("string").alias("w3")))
    asked = near.select("next", F.inline(F.filter(F.array(of_word, of_line), lambda x: x.isNotNull())))
    counts = [F.count("*").alias("uses"), F.count_if(F.col("next") == _STOP).alias("closings"), F.count_if(F.col("next") == _END).alias("endings")]
    found = cut(asked.groupBy("alone", "w1", "w2", "w3").agg(*counts))
    return found.where("NOT alone").drop("alone"), found.where("alone").drop("alone", "w2", "w3")


def cut_words(ends: DataFrame, uses: DataFrame, alone: DataFrame) -> DataFrame:
    """Those of `ends` that no text closes with, or that are a longer word broken off."""
    known = uses.where(F.col("w1").isNotNull())
    total = {"uses": F.sum("uses"), "closings": F.sum("closings"), "endings": F.sum("endings")}
    two = known.groupBy("w2", "w3").agg(*[c.alias(f"{n}2") for n, c in total.items()])
    one = known.groupBy("w3").agg(*[c.alias(f"{n}1") for n, c in total.items()])
    j = (
        ends.join(known, ["w1", "w2", "w3"], "left").join(two, ["w2", "w3"], "left").join(one, ["w3"], "left")
        .join(alone.select("w1", *[F.col(n).alias(f"{n}0") for n in total]), ["w1"], "left")
    )

    def closing(n: str, least: int) -> Column:
        """Rate in the other texts: an ending is no evidence for itself."""
        others = F.col(f"uses{n}") - 1
        return F.when(F.coalesce(others, F.lit(0)) >= least, (F.col(f"closings{n}") + F.col(f"endings{n}") - 1) / others)

    rate = F.coalesce(
        closing("", USES[0]), F.when(F.col("w2") == _STOP, closing("0", USES[1])), closing("2", USES[1]), closing("1", USES[2]), F.lit(0.0)
    )
    j = cut(j.select("w1", "w2", "w3", "uses2", (rate >= CLOSING_RATE).alias("closes"), (F.coalesce("closings2", F.lit(0)) > 0).alias("punctuated")))
    # Words that only ever end texts may be one word broken off in many texts: then the
    # whole word follows the same word elsewhere, at least as often.
    doubtful = small_side(j.where(F.col("closes") & ~F.col("punctuated")).select("w2", "w3", "uses2").distinct())
    followers = uses.groupBy("w2", F.col("w3").alias("whole")).agg(F.sum("uses").alias("n")).where(F.length("whole") > 1)
    heads = followers.join(doubtful.select("w2").distinct(), "w2", "left_semi").select(
        "w2", "whole", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("whole") - 1), lambda k: F.substring(F.col("whole"), F.lit(1), k))).alias("w3")
    )
    # Numbers come in several lengths: a shorter one is broken off only if it is rare beside the longer.
    more_digits = F.substring(F.col("whole"), F.length("w3") + 1, F.length("whole")).rlike("^0+$")
    evidence = F.sum(F.when(more_digits, F.col("n") / RARE).otherwise(F.col("n")))
    broken = heads.join(doubtful, ["w2", "w3"]).groupBy("w2", "w3", "uses2").agg(evidence.alias("n")).where(F.col("n") >= F.col("uses2")).select("w2", "w3", F.lit(True).alias("broken"))
    return j.join(broken, ["w2", "w3"], "left").where(~F.col("closes") | F.coalesce("broken", F.lit(False))).select("w1", "w2", "w3")


def judged(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``source``, ``at_limit`` and ``is_cut`` of each row of `docs` (which has a ``text``, too).

    Cut are texts exactly at a limit of their source that do not close a sentence, texts
    that end in a broken character, and texts whose last words close nothing in the
    corpus.  Null texts and texts without letters or digits are not cut; an unknown
    source has no limit; repeated rows are judged alike.
    """
    docs = docs.select("doc_id", "source", "text")
    limits = cut(field_limits(docs.where(F.col("text").isNotNull())))
    # A few limits a source at most: the sources of a corpus are few, which the size check proves.
    per_source = limits.groupBy(F.col("source").alias("l_source")).agg(F.collect_list(F.struct("form", "limit_length")).alias("limits"))
    j = docs.join(small_side(per_source), F.col("source").eqNullSafe(F.col("l_source")), "left")
    lengths = [(F.lit(n), c.cast("bigint")) for n, c in storage_lengths(F.col("text")).items()]
    at_limit = F.exists("limits", lambda x: x["limit_length"] == F.element_at(F.create_map(*[y for nc in lengths for y in nc]), x["form"]))
    tail = _tail(F.col("text"))
    keep = ["doc_id", "source"]
    j = j.select(
        *keep,
        F.when(F.col("limits").isNotNull(), F.coalesce(at_limit, F.lit(False))).otherwise(False).alias("at_limit"),
        _closed(tail).alias("closed"),
        tail.rlike(r"(…|\.\.\.)$").alias("trails_off"),
        tail.rlike("�$").alias("broken"),
        F.regexp_replace(F.col("text"), r"\s+$", "").alias("text"),
    )
    open_ends = j.where(~F.col("closed") & ~F.col("trails_off") & ~F.col("at_limit"))
    words = F.concat(F.array(*[F.lit(_STOP)] * 3), _words(F.substring(F.col("text"), -200, 200)))
    last = open_ends.select("doc_id", F.slice(words, -3, 3).alias("e")).select("doc_id", *[F.get("e", F.lit(i)).alias(f"w{i + 1}") for i in range(3)])
    last = cut(last.where(F.col("w3") != _STOP))
    ends = last.select("w1", "w2", "w3").distinct()
    uses, alone = word_uses(docs.where(F.col("text").isNotNull()), ends)
    cut_ends = cut_words(ends, uses, alone)
    cut_docs = last.join(small_side(cut_ends), ["w1", "w2", "w3"], "left_semi").select(F.col("doc_id").alias("c_doc")).distinct()
    # Ids only: the texts are not moved again.
    flags = j.select(*keep, "at_limit", (F.col("broken") | (F.col("at_limit") & ~F.col("closed"))).alias("_sure"))
    return flags.join(cut_docs, flags["doc_id"] == cut_docs["c_doc"], "left").select(
        *keep, "at_limit", (F.coalesce("_sure", F.lit(False)) | F.col("c_doc").isNotNull()).alias("is_cut")
    )


def rates(flags: DataFrame) -> DataFrame:
    """How often each source truncates."""
    return flags.groupBy("source").agg(
        F.count("*").alias("n_documents"), F.count_if("is_cut").alias("n_cut"), F.count_if(F.col("is_cut") & F.col("at_limit")).alias("n_at_limit")
    ).withColumn("cut_rate", F.round(F.col("n_cut") / F.col("n_documents"), 6))
