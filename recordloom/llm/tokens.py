"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Rank file of the tokenizer (one ``base64 rank`` a line); a path on every executor.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the word pattern of the byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@functools.lru_cache(maxsize=4)
def encoding(path: str):
    """The encoder of a rank file, loaded once per Python worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, path: str = TOKENIZER) -> int | None:
    """Tokens of a whole text; lone surrogates count as replacement characters."""
    if text is None:
        return None
    return len(encoding(path).encode_ordinary(text))


def with_sizes(docs: DataFrame, text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """`docs` with ``n_tokens`` in place of the text column (null for a null text) and of a column of that name."""
    kept = [f for f in docs.schema.fields if f.name not in (text, "n_tokens")]
    names = [f.name for f in kept]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", n_tokens bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[names].copy()
            out["n_tokens"] = pd.array([count_tokens(t, tokenizer) for t in batch[text]], dtype="Int64")
            yield out

    return docs.mapInPandas(run, schema)
