"""Exact token counts of texts of any length (part of problems 4 and 9).

A document longer than ``chunk_chars`` is cut only where the tokenizer is
proven to start a new word whatever stands around: behind a letter, digit or
punctuation mark and before a blank or line feed. No alternative of the word
pattern holds a blank or line feed anywhere but in its first place or in a run
of white space, and the run to the right starts after the cut; so the words of
the parts are the words of the whole, and counts add up. A document without
such a place stays whole. Chunks of long documents are spread over workers by
a salt; short ones are counted where they are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warraq.llm.bpe import bpe, vocabulary_path

CHUNK_CHARS = 32_768


def _counted(df: DataFrame, path: str) -> DataFrame:
    """(key, text) to (key, n_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = bpe(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokenizer.count(batch.column(1).to_pylist()), pa.int64())], names=["key", "n_tokens"])

    return df.mapInArrow(run, f"key {df.schema['key'].dataType.simpleString()}, n_tokens bigint")


def count_tokens(df: DataFrame, key: str, text: str, vocabulary: str | None = None, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(key, n_tokens) of every row; NULL and empty texts have 0 tokens.

    ``key`` must be unique where texts are longer than ``chunk_chars``; rows
    of one key are then summed.
    """
    path = vocabulary or vocabulary_path()
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    long = F.coalesce(F.length("text") > chunk_chars, F.lit(False))
    cut = rf"(?s).{{{chunk_chars},}}?[\p{{L}}\p{{N}}\p{{P}}](?=[ \n])|.+"
    chunks = rows.filter(long).select("key", F.posexplode(F.regexp_extract_all("text", F.lit(cut), F.lit(0))).alias("at", "text"))
    spread = chunks.repartition(F.xxhash64("key", "at")).select("key", "text")
    parts = _counted(spread, path).groupBy("key").agg(F.sum("n_tokens").alias("n_tokens"))
    return _counted(rows.filter(~long), path).unionByName(parts).withColumnRenamed("key", key)
