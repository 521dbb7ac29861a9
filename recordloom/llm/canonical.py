"""Free-typed values to the entries of a reference list.

Method: token-level repair.  Each distinct token of the values is joined to the
vocabulary of the reference list by edit distance: padded trigrams give the
candidates (an equi-join with a count bound that loses no pair within the
distance), ``levenshtein`` verifies them.  A cut token may also stand for the only
entries it begins.  The corrected tokens are then combined by soft TF-IDF into a
score of each complete entry, and the best entry above the threshold wins.
Everything runs on built-in functions; hot tokens are repaired once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.common import cut, small_side, spread

# Letters with marks and their plain form.
MARKED, PLAIN = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ", "aaaaaaeeeeiiiiooooouuuuncyy"
# Signs typed for letters.
SIGNS, LETTERS = "0134578$@", "oieastbsa"

# Fixed value: a number, with or without a unit.
STRENGTH = r"^[0-9]+[a-z]{0,3}$"
#: Shortest token that is repaired (shorter ones must be right), and shortest cut token.
SHORTEST, SHORTEST_CUT = 4, 5
#: Score from which an entry is taken.
THRESHOLD = 0.6


def allowed_edits(length: Column) -> Column:
    """Edits a token of this length may have."""
    return F.when(length >= 9, 3).when(length >= 6, 2).otherwise(1)


def plain_text(value: Column) -> Column:
    """Lower case without marks; single letters typed apart are joined."""
    low = F.translate(F.lower(value), MARKED, PLAIN)
    return F.regexp_replace(low, r"(?<=(?:^|[^a-z0-9])[a-z0-9]) +(?=[a-z0-9](?:[^a-z0-9]|$))", "")


def _words(value: Column) -> Column:
    return F.filter(F.split(plain_text(value), r"[^a-z0-9$@]+"), lambda w: w != "")


def tokens(value: Column) -> Column:
    """Words of a value as typed, and with signs read as letters; neighbours glued together for names broken in two.

    A number with its unit is no part of a name and is not glued.
    """
    words = _words(value)
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.when(~a.rlike(STRENGTH) & ~b.rlike(STRENGTH), F.concat(a, b)))
    lettered = F.filter(F.concat(words, pairs), lambda w: w.isNotNull() & (F.length(F.regexp_replace(w, "[^a-z]", "")) >= 3))
    return F.array_distinct(F.concat(words, F.transform(lettered, lambda w: F.translate(w, SIGNS, LETTERS))))


def _grams(word: Column) -> Column:
    """(place, gram) of the padded trigrams."""
    padded = F.concat(F.lit("^^"), word, F.lit("$$"))
    return F.transform(F.sequence(F.lit(1), F.length(word) + 2), lambda i: F.struct(i.alias("place"), F.substring(padded, i, F.lit(3)).alias("gram")))


def _letters(word: Column) -> Column:
    return F.array_join(F.array_sort(F.split(word, "")), "")


def entry_tokens(reference: DataFrame, key: str, name: str, names: str) -> DataFrame:
    """(term_id, entry, word, weight): every name of the list in words, weighted by normalised IDF."""
    entries = reference.select(F.col(key).alias("term_id"), F.explode(F.concat(F.array(name), F.coalesce(names, F.array().cast("array<string>")))).alias("entry"))
    words = entries.where(F.col("entry").isNotNull()).select(
        "term_id", "entry", F.explode(F.array_distinct(F.filter(F.split(plain_text(F.col("entry")), r"[^a-z0-9]+"), lambda w: w != ""))).alias("word")
    )
    idf = words.groupBy("word").agg(F.count("*").alias("df")).withColumn("idf", F.log1p(1 / F.col("df")))
    weighted = words.join(idf, "word")
    norm = weighted.groupBy("term_id", "entry").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm"))
    return weighted.join(norm, ["term_id", "entry"]).select("term_id", "entry", "word", (F.col("idf") / F.col("norm")).alias("weight"))


def repair(distinct: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token, word, similarity) of every token within the allowed edits of a vocabulary word, or cutting one.

    `distinct`: ``token``.  `vocabulary`: ``word`` (distinct).  Trigrams match within the
    allowed shift only, which loses no pair either.  All steps on tokens keep the one
    partitioning by token.
    """
    v = small_side(vocabulary.withColumns({"v_len": F.length("word"), "v_id": F.xxhash64("word")}))
    every = distinct.where(F.col("token").isNotNull()).withColumns({"t_len": F.length("token"), "t_id": F.xxhash64("token")})
    t = spread(every.where(F.col("t_len") >= SHORTEST), "t_id")
    tg = t.select("t_id", "t_len", F.inline(_grams(F.col("token"))))
    vg = small_side(v.select("v_id", "v_len", F.inline(_grams(F.col("word"))).alias("v_place", "gram")))
    may = allowed_edits(F.col("t_len"))
    # Each edit spoils three padded trigrams at most; one more may be lost to repeats.  Two swaps shift by one.
    ids = (
        tg.join(vg, "gram").where((F.abs(F.col("t_len") - F.col("v_len")) <= may) & (F.abs(F.col("place") - F.col("v_place")) <= may))
        .groupBy("t_id", "v_id", "t_len", "v_len").agg(F.count("*").alias("shared"))
        .where(F.col("shared") >= F.greatest(F.lit(1), F.greatest("t_len", "v_len") + 1 - 3 * may))
    )
    near = (
        ids.select("t_id", "v_id").join(t, "t_id").join(v, "v_id")
        .withColumn("edits", F.levenshtein("token", "word", 4))
        # Two swaps of neighbours cost four plain edits but leave the letters the same.
        .withColumn("edits", F.when((F.col("edits") == 4) & (F.col("t_len") >= 9) & (_letters(F.col("token")) == _letters(F.col("word"))), 2).otherwise(F.col("edits")))
        .where((F.col("edits") >= 0) & (F.col("edits") <= allowed_edits(F.least("t_len", "v_len"))))
        .select("token", "word", (1 - F.col("edits") / F.greatest("t_len", "v_len")).alias("similarity"))
    )
    short = every.where(F.col("t_len") < SHORTEST).select("token").join(v.select(F.col("word").alias("token")), "token").select("token", F.col("token").alias("word"), F.lit(1.0).alias("similarity"))
    heads = v.where(F.col("v_len") > SHORTEST_CUT).select(
        "word", F.explode(F.transform(F.sequence(F.lit(SHORTEST_CUT), F.col("v_len") - 1), lambda n: F.substring(F.col("word"), F.lit(1), n))).alias("token")
    )
    # A beginning is worth less than a repaired whole word.
    broken = t.select("token", "t_len").join(small_side(heads), "token").select("token", "word", (F.lit(0.61) + 0.1 * F.col("t_len") / F.length("word")).alias("similarity"))
    return near.unionByName(short).unionByName(broken).groupBy("token", "word").agg(F.max("similarity").alias("similarity"))


def canonicalise(values: DataFrame, reference: DataFrame, row: str, text: str, key: str = "term_id", name: str = "generic_name", names: str = "brand_names") -> DataFrame:
    """``row`` and ``term_id`` for every non-null text; 0 where the text names no entry.

    Ties go to the higher similarity, then the entry more often written without
    error, then the lower ``term_id``.  An empty text, and any text while the list
    is empty, comes out as 0; repeated rows come out once per row id.
    """
    rows = values.where(F.col(text).isNotNull()).select(F.col(row).alias("row_id"), F.col(text).alias("text"))
    entries = cut(entry_tokens(reference, key, name, names))
    mentions = rows.select("row_id", F.explode(tokens(F.col("text"))).alias("token"))
    counted = cut(mentions.groupBy("token").agg(F.count("*").alias("uses")))
    repaired = repair(counted.select("token"), entries.select("word").distinct())
    # How often each word is written correctly decides between equally good corrections.
    exact = counted.join(small_side(entries.select(F.col("word").alias("token")).distinct()), "token", "left_semi").select(F.col("token").alias("word"), "uses")
    parts = entries.join(small_side(exact), "word", "left")
    scored = (
        repaired.join(small_side(parts), "word")
        .select("token", "term_id", "entry", "word", (F.col("similarity") * F.col("weight")).alias("part"), F.coalesce("uses", F.lit(0)).alias("uses"), "weight")
    )
    # Of the entries a token may mean, the best few matter: those tied with its best one.
    best = (
        mentions.join(small_side(scored), "token")
        .groupBy("row_id", "term_id", "entry", "word", "weight")
        .agg(F.max(F.struct("part", "uses")).alias("m"))
        .groupBy("row_id", "term_id", "entry")
        .agg(F.sum(F.col("m.part") * F.col("weight")).alias("raw"), F.max("m.uses").alias("uses"))
        .where(F.round("raw", 9) >= THRESHOLD)
        .select("row_id", F.struct(F.round("raw", 6).alias("score"), "uses", (-F.col("term_id")).alias("minus")).alias("found"))
    )
    none = rows.select("row_id", F.struct(F.lit(0.0).alias("score"), F.lit(0).cast("bigint").alias("uses"), F.lit(0).cast("bigint").alias("minus")).alias("found"))
    return best.unionByName(none).groupBy("row_id").agg((-F.max("found")["minus"]).alias("term_id")).select(F.col("row_id").alias(row), "term_id")
