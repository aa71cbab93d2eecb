"""Shared helpers: tables, the shared folder, byte-level word splitting."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from ..session import hadoop, scratch

_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Cut the lineage: write `df` once into the shared folder and return the written table.

    A lost executor loses nothing of it, and a costly step below never runs twice.
    """
    path = scratch(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def remove(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        files, at = hadoop(df.sparkSession, df.written_to)
        files.delete(at, True)


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-case A-Z only; words are runs of anything but x20 and x09-x0D."""
    return text.lower().split() if text else []


def word_runs(text: bytes, limit: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text in runs of about `limit` bytes, so that a huge text never becomes one list."""
    at, size = 0, len(text)
    while at < size:
        end = min(at + limit, size)
        if end < size:
            found = _SPACE.search(text, end)
            end = found.start() if found else size
        yield text[at:end].lower().split()
        at = end


def tokenizer_path(name: str) -> str:
    """Path of a public tokenizer file: $TOKENIZER_DIR, else the installed package."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
