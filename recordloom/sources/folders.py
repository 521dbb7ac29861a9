"""Folders and archives as sources: what is in them, in which format, and their texts."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.sources import formats

#: Bytes that tell the format.
HEAD = 4096


def walk(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(file, size, content): the files below `path`, sub-folders included; content is read only where it is asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select(F.col("path").alias("file"), F.col("length").alias("size"), "content")


def inventory(files: DataFrame) -> DataFrame:
    """(file, size, format) of each file."""
    head = F.regexp_replace(F.decode(F.substring("content", 1, HEAD), "ISO-8859-1"), "^\u00ef\u00bb\u00bf", "")
    packed = F.hex(F.substring("content", 1, 2)) == "1F8B"
    return files.select("file", "size", F.when(packed, "gzip").otherwise(formats.sniff(head)).alias("format"))


_TEXTS = "file string, text string, error string"


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for file, content in zip(batch["file"], batch["content"]):
            rows = []
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    # One member at a time, in order of name; folders and hidden files are no documents.
                    for name in sorted(z.namelist()):
                        if not name.endswith("/") and not name.rsplit("/", 1)[-1].startswith((".", "_")) and not name.startswith("__MACOSX"):
                            rows.append((f"{file}!{name}", z.read(name).decode("utf-8", "replace"), None))
            except (zipfile.BadZipFile, RuntimeError, OSError, ValueError) as e:
                rows.append((file, None, str(e)[:200]))
            if rows:
                yield pd.DataFrame(rows, columns=["file", "text", "error"])


def texts(files: DataFrame) -> DataFrame:
    """(file, text, error): plain files as UTF-8, archives by member (``archive!member``); an archive that cannot be read has its error."""
    packed = F.hex(F.substring("content", 1, 4)) == "504B0304"
    plain = files.where(~F.coalesce(packed, F.lit(False))).select("file", F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "").alias("text"), F.lit(None).cast("string").alias("error"))
    return plain.unionByName(files.where(packed).select("file", "content").mapInPandas(_members, _TEXTS))


def completeness(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(n_expected, n_found, share): files that were to come (``name``) and did (``file`` ends with it)."""
    have = found.select(F.regexp_extract("file", r"[^/!]*$", 0).alias("name")).distinct().withColumn("here", F.lit(1))
    return expected.select("name").distinct().join(have, "name", "left").agg(F.count("*").alias("n_expected"), F.count("here").alias("n_found"), F.round(F.count("here") / F.nullif(F.count("*"), F.lit(0)), 6).alias("share"))
