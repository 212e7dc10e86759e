"""Documents whose language label is missing or wrong (problem 7).

Two passes over the documents give both models and both verdicts. The first
groups equal texts (digits apart) and counts, text by text, what the language
model and the prose model of the residue need: a text counts once, under the
label that most of its copies have. The second labels every text and judges it for residue
with the seed lines; what it hands on are the documents with a missing or
wrong label and the texts found to be residue. These few fit the residue model
anew and are judged by it, as in ``residue``.

Defined results: texts without letters and residue give no row; NULL and empty
texts neither; repeated rows give repeated rows; an empty table an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warraq.llm import langid, residue
from warraq.llm.batches import map_rows
from warraq.session import cut


def fit(documents: DataFrame, text: str = "text", lang: str = "lang") -> tuple[np.ndarray, np.ndarray]:
    """(language model, prose counts) from one pass over the distinct texts.

    At most a row for each counter of the two models comes to the driver.
    """
    wide = len(langid.LANGS) * langid.BUCKETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, prose = np.zeros((len(langid.LANGS), langid.BUCKETS), np.int64), np.zeros(residue.BUCKETS, np.int64)
        add_words, add_prose = langid.word_fold(), residue.prose_fold()
        for batch in batches:
            texts, codes = (c.to_pylist() for c in batch.columns)
            add_words(words, texts, codes)
            add_prose(prose, texts)
        yield residue.counted(np.concatenate([words.reshape(-1), prose]))

    rows = documents.select(residue.digitless(F.col(text)).alias("text"), langid.label_code(F.col(lang)).alias("code")).filter("text is not null")
    distinct = rows.groupBy("text").agg(F.mode(F.when(F.col("code").isin(*langid.LANGS), F.col("code")), True).alias("code"))
    got = distinct.mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(wide + residue.BUCKETS, np.int64)
    counts[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return langid.log_probabilities(counts[:wide].reshape(len(langid.LANGS), -1).astype(float)), counts[wide:]


def wrong_labels(documents: DataFrame, model: np.ndarray, prose: np.ndarray, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, lang): the language of every document whose label is missing or names another one, residue left out."""
    first = residue.ratios(prose)

    def make() -> Callable[..., tuple]:
        labeller, decide = langid.Labeller(model), residue.judge(first)

        def each(keys: list, texts: list, codes: list) -> tuple:
            words = [langid.WORD.findall(t) if t else [] for t in texts]
            found = [langid.main_language(p, s, w)[0] for (p, s), w in zip(labeller.paths(words), words)]
            rows = []
            for k, t, code, one in zip(keys, texts, codes, found):
                wrong = one is not None and one != code
                kind = decide(t)[0] if t else None
                if kind == "residue" or (wrong and kind is None):
                    rows.append((k, t, one, wrong, kind == "residue"))
            return tuple(zip(*rows)) if rows else ([],) * 5

        return each

    rows = documents.select(F.col(key).cast("bigint").alias(key), F.col(text).alias("text"), langid.label_code(F.col(lang)).alias("code"))
    arrow = pa.schema([(key, pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("wrong", pa.bool_()), ("residue", pa.bool_())])
    some = cut(map_rows(rows, make, f"`{key}` bigint, text string, lang string, wrong boolean, residue boolean", arrow))
    second = residue.ratios(prose, residue.residue_counts(some.filter("residue")))

    def again() -> Callable[..., tuple]:
        decide = residue.judge(second)

        def each(keys: list, texts: list, langs: list) -> tuple:
            rows = [(k, one) for k, t, one in zip(keys, texts, langs) if decide(t)[0] is None]
            return tuple(zip(*rows)) if rows else ([], [])

        return each

    left = some.filter("wrong").select(key, "text", "lang")
    return map_rows(left, again, f"`{key}` bigint, lang string", pa.schema([(key, pa.int64()), ("lang", pa.string())]))
