"""Token totals by source, language and general field (problem 4).

One pass over the texts gives each document's exact token count and its
language, beside its slices, without a join; documents over ``chunk_chars`` are
cut at proven boundaries and spread by ``counting``, and only they are joined
with their languages. Counts are rolled up over slices, with the spellings of
a source and of a field counted together.
Missing values form a slice of their own (NULL). A third of all rows in one
slice is no harm: sums are made before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warraq.functions.dimensions import canonical_source, general_field
from warraq.llm.batches import map_rows
from warraq.llm.bpe import bpe, vocabulary_path
from warraq.llm.counting import CHUNK_CHARS, count_tokens
from warraq.llm.langid import WORD, Labeller, identify, main_language

SLICES = ("source", "lang", "general_field")


def page_texts(sample: DataFrame) -> DataFrame:
    """(doc_key, row_no, page_no, text, source, general_field) for both pages of every article row."""
    pages = F.explode(F.array(*(F.struct(F.lit(k).alias("page_no"), F.col(f"page{k}").alias("text")) for k in (1, 2))))
    rows = sample.select("row_no", pages.alias("p"), "source", "general_field")
    return rows.select((F.col("row_no") * 2 + F.col("p.page_no") - 1).alias("doc_key"), "row_no", "p.page_no", "p.text", "source", "general_field")


def count_documents(texts: DataFrame, model, source_map: DataFrame, vocabulary: str | None = None, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(doc_key, n_tokens, source, lang, general_field) of ``texts`` (doc_key, text, source, general_field); ``doc_key`` is unique."""
    path = vocabulary or vocabulary_path()
    rows = texts.select(F.col("doc_key").cast("bigint").alias("doc_key"), "text", F.col("source").cast("string").alias("source"), F.col("general_field").cast("string").alias("general_field"))
    long = F.coalesce(F.length("text") > chunk_chars, F.lit(False))

    def make() -> Callable[..., tuple]:
        tokenizer, labeller = bpe(path), Labeller(model)

        def each(keys: list, some: list, sources: list, fields: list) -> tuple:
            words = [WORD.findall(t) if t else [] for t in some]
            langs = [main_language(p, s, w)[0] for (p, s), w in zip(labeller.paths(words), words)]
            return keys, tokenizer.count(some), langs, sources, fields

        return each

    columns = [("doc_key", pa.int64()), ("n_tokens", pa.int64()), ("lang", pa.string()), ("source", pa.string()), ("general_field", pa.string())]
    counted = map_rows(rows.filter(~long), make, "doc_key bigint, n_tokens bigint, lang string, source string, general_field string", pa.schema(columns))
    some = rows.filter(long)
    apart = count_tokens(some, "doc_key", "text", path, chunk_chars).join(identify(some, "doc_key", "text", model).select("doc_key", "lang"), "doc_key").join(some.drop("text"), "doc_key")
    both = counted.unionByName(apart.select(*counted.columns))
    named = canonical_source(both, "source", source_map, "source")
    return named.select("doc_key", "n_tokens", "source", "lang", general_field(F.col("general_field")).alias("general_field"))


def roll_up(counted: DataFrame) -> DataFrame:
    """(slice_kind, slice, n_docs, n_tokens): totals over each kind of slice, from one pass."""
    cells = counted.groupBy(*SLICES).agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    long = cells.select(F.explode(F.array(*(F.struct(F.lit(k).alias("slice_kind"), F.col(k).alias("slice")) for k in SLICES))).alias("x"), "n_docs", "n_tokens")
    return long.groupBy(F.col("x.slice_kind").alias("slice_kind"), F.col("x.slice").alias("slice")).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
