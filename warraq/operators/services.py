"""External services behind plain functions: language models, translators, recognisers.

A client maps a list of texts to a list of replies; one is made for each
task. Rows that need no call never reach Python, as the filter stands before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warraq.functions.lists import normalized_reply
from warraq.operators.relational import needs_extraction, prefer_existing

Client = Callable[[list[str]], list[str | None]]


def prompt(template: str, *columns: str) -> Column:
    """The template with the columns in place of ``%s``; NULL counts as empty."""
    return F.format_string(template, *(F.coalesce(F.col(c), F.lit("")) for c in columns))


def ask(df: DataFrame, text: str, make: Callable[[], Client], out: str = "reply", parts: int | None = None) -> DataFrame:
    """``df`` with the client's reply to ``text``; NULL texts aren't sent and have none. ``parts``: how many calls may run at once."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"`{out}` string"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for frame in frames:
            there = frame[text].notna()
            replies = pd.Series([None] * len(frame), index=frame.index, dtype=object)
            if there.any():
                replies[there] = client(frame.loc[there, text].tolist())
            yield frame.assign(**{out: replies})

    rows = df.repartition(parts) if parts else df
    return rows.mapInPandas(run, schema)


def ask_once(df: DataFrame, text: str, make: Callable[[], Client], out: str = "reply") -> DataFrame:
    """The same with one call for each distinct text."""
    asked = ask(df.select(F.col(text).alias("_t")).filter("_t is not null").distinct(), "_t", make, out)
    return df.join(asked, df[text] == asked["_t"], "left").drop("_t")


def echo() -> Client:
    """A client that replies with the text itself, for tests and as the identity translator."""
    return lambda texts: list(texts)


REQUEST = "Read the two pages and reply with one JSON object with the keys title_ar, title_en, abstract_ar, abstract_en, general_field and authors.\n\nPAGE 1:\n%s\n\nPAGE 2:\n%s"


def enrich(articles: DataFrame, make: Callable[[], Client], fields: tuple[str, ...], parts: int | None = None) -> DataFrame:
    """Articles with what a model extracts where something is missing.

    Complete rows make no call; of the others only what is missing is filled.
    ``parts`` is how many calls may run at once. To resume, leave out the
    articles that are done (``relational.resume``) before.
    """
    wanted = {"title": "title_ar", "abstract_ar": "abstract_ar", "general_field": "general_field", "authors": "authors"}
    missing = needs_extraction(list(wanted))
    asked = ask(articles.filter(missing).withColumn("_prompt", prompt(REQUEST, "page1", "page2")), "_prompt", make, "_reply", parts)
    reply = normalized_reply(F.col("_reply"), fields)
    got = asked.withColumn("_r", reply).withColumns({f"_{c}": (F.to_json(F.col("_r.authors")) if x == "authors" else F.nullif(F.col(f"_r.{x}"), F.lit(""))) for c, x in wanted.items()})
    filled = prefer_existing(got, {c: f"_{c}" for c in wanted}).drop("_prompt", "_reply", "_r")
    return articles.filter(~missing).unionByName(filled)


PAIRS = "array<struct<latin: string, ar: string>>"


def corrected_names(df: DataFrame, names: str, make: Callable[[], Client], out: str = "pairs") -> DataFrame:
    """(latin, ar) pairs of each row's names, as a service replies; a reply that isn't such a list gives an empty one."""
    asked = ask(df, names, make, "_reply")
    return asked.withColumn(out, F.coalesce(F.from_json("_reply", PAIRS), F.array().cast(PAIRS))).drop("_reply")
