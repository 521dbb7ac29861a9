"""Narrative text: markup off, chunks of bounded length."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A break is taken only past this part of the chunk.
EARLIEST = 0.3


def strip_markup(html: Column) -> Column:
    """Text of flat HTML: scripts, styles and tags off, entities of markup resolved, blank lines collapsed."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?i)<(br|/p|/div|/li|/tr|/h[1-6])\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.regexp_replace(t, r"[ \t]*\n[ \t]*", "\n")
    return F.btrim(F.regexp_replace(t, r"\n{3,}", "\n\n"), F.lit(" \n\t\r"))


def split_text(text: str, most: int) -> list[str]:
    """Chunks of at most `most` characters, broken at a blank line, line or space past `EARLIEST`, else hard.

    Joined, the chunks are the text.
    """
    chunks, at = [], 0
    while len(text) - at > most:
        end = at + most
        for sep in ("\n\n", "\n", " "):
            k = text.rfind(sep, at, end)
            if k >= at + EARLIEST * most:
                end = k + len(sep) if k + len(sep) <= at + most else k
                break
        chunks.append(text[at:end])
        at = end
    return [*chunks, text[at:]] if text[at:] or not chunks else chunks


def chunks(df: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """(key, chunk_ix, n_chars, chunk) of every text; a null text has none, an empty one a single empty chunk."""
    if most < 4:
        raise ValueError("chunks must hold 4 characters at least")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, len(c), c) for k, t in zip(batch["k"], batch["t"]) if t is not None for i, c in enumerate(split_text(t, most))]
            yield pd.DataFrame(rows, columns=[key, "chunk_ix", "n_chars", "chunk"])

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"{key} bigint, chunk_ix int, n_chars int, chunk string")
