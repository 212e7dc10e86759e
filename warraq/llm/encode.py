"""Token ids of every document under a public tokenizer (problem 8).

Defined results: NULL and empty texts have an empty list; names of special
tokens are ordinary text; repeated rows give repeated rows; an empty table
gives an empty one; columns other than the two named are not read. A narrow
pass without any shuffle: each task walks the trie of its own distinct words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warraq.llm.bpe import bpe, vocabulary_path


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(key, ids) of every row of ``df``."""
    path = vocabulary or vocabulary_path()
    rows = df.select(F.col(key).cast("bigint").alias(key), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = bpe(path)
        for batch in batches:
            # a bounded number of characters at a time: ids of a batch of long texts would not fit
            texts = batch.column(1).to_pylist()
            start = held = 0
            for at, t in enumerate([*texts, None]):
                held += len(t or "")
                if at == len(texts) or held > 4_000_000:
                    end = min(at + 1, len(texts))
                    if end > start:
                        ids = tokenizer.encode(texts[start:end])
                        offsets = np.zeros(len(ids) + 1, np.int32)
                        np.cumsum([len(x) for x in ids], out=offsets[1:])
                        flat = np.fromiter((i for x in ids for i in x), np.int32, count=int(offsets[-1]))
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[key, "ids"])
                    start, held = end, 0

    return rows.mapInArrow(run, f"`{key}` bigint, ids array<int>")
