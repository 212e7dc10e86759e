"""Subject areas of abstracts (problem 5).

Labelling functions vote on each pair of an abstract and a subject it
mentions: mentions of the subject's terms (a lexicon learned from the labelled
texts), sentences with such terms, the keyword section, the title, the
general_field, the source's ending and the address the article lies at: how
much more often than elsewhere the subject is mentioned several times under
this code. A latent model learns from all pairs, without their labels, how
often each vote occurs with pairs that are true and pairs that are not
(expectation-maximisation over the counts of vote patterns), and a pair's
posterior decides; an abstract may have any number of subjects.

The driver sees the labelled texts (at most ``LABEL_BOUND`` rows, a documented
bound) and the vote patterns, whose number doesn't follow the corpus.

Defined results: NULL, empty and blank abstracts give no row; an article
delivered several times has the union of its rows' pairs, with the highest
posterior; an abstract without any known term gives no row.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from warraq.functions.dimensions import general_field, source_ending
from warraq.llm.batches import map_rows
from warraq.session import cut

LABEL_BOUND = 20_000
VOTES = ("mentions", "sentences", "share", "keywords", "title", "field", "ending", "address")
_IN_TEXT = VOTES[:-1]
_WORD = re.compile(r"[^\W\d_]+")
_MARKS = re.compile("[ً-ْـ​-‏⁠﻿]")
_SENTENCE = re.compile(r"(?<=[.!?؟])\s+|\n")


def words(text: str) -> list[str]:
    """Words without marks, invisible characters and a joined "and"."""
    return [w[1:] if w[0] == "و" and len(w) > 4 else w for w in _WORD.findall(_MARKS.sub("", text))]


def learn_lexicon(labels: list[tuple[str, str]], longest: int = 3) -> dict[str, str]:
    """term -> subject: word sequences of at least two labelled texts of one subject and of none of another."""
    seen: dict[str, Counter[str]] = defaultdict(Counter)
    for text, subject in labels:
        w = words(text or "")
        for g in {" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)}:
            seen[g][subject] += 1
    return {g: next(iter(c)) for g, c in seen.items() if len(c) == 1 and sum(c.values()) >= 2}


class Finder:
    """Mentions of subjects in texts, by one automaton over all terms."""

    def __init__(self, lexicon: dict[str, str]) -> None:
        self.machine = ahocorasick.Automaton()
        for term, subject in lexicon.items():
            self.machine.add_word(f" {term} ", (len(term) + 2, subject))
        if lexicon:
            self.machine.make_automaton()
        self.empty = not lexicon

    def mentions(self, sentence: str) -> Counter[str]:
        """Mentions of each subject: runs of words covered by its terms."""
        text = f" {' '.join(words(sentence))} "
        out: Counter[str] = Counter()
        if self.empty:
            return out
        reach: dict[str, int] = {}
        spans = sorted((end - n + 1, end, s) for end, (n, s) in self.machine.iter(text))
        for start, end, subject in spans:
            if start >= reach.get(subject, -1):
                out[subject] += 1
            reach[subject] = max(reach.get(subject, -1), end)
        return out


def _votes(finder: Finder, abstract: str, keywords: str | None, title: str | None, field: str | None, ending: str | None) -> list[tuple[str, tuple[int, ...]]]:
    per = [finder.mentions(s) for s in _SENTENCE.split(abstract) if s.strip()]
    total = sum(per, Counter())
    inside = Counter(s for c in per for s in c)
    some = sum(1 for c in per if c)
    kw = finder.mentions(keywords) if keywords else None
    head = finder.mentions(title) if title else None
    rows = []
    for subject, n in total.items():
        share = inside[subject] / some
        rows.append(
            (
                subject,
                (
                    min(n, 4),
                    min(inside[subject], 3),
                    0 if share <= 0.2 else 1 if share <= 0.34 else 2 if share < 1 else 3,
                    3 if not kw else min(kw[subject], 2),
                    2 if not head else min(head[subject], 1),
                    2 if field is None else int(field == subject),
                    2 if ending is None else int(ending == subject),
                ),
            )
        )
    return rows


def votes(articles: DataFrame, lexicon: dict[str, str]) -> DataFrame:
    """(article_id, code, subject, a column for each vote): the pairs of all rows with an abstract. ``code`` is the letters that the file name in ``path`` starts with."""
    schema = ", ".join(["article_id bigint", "code string", "subject string", *(f"{v} int" for v in _IN_TEXT)])
    arrow = pa.schema([("article_id", pa.int64()), ("code", pa.string()), ("subject", pa.string()), *((v, pa.int32()) for v in _IN_TEXT)])

    def make() -> Callable[..., tuple]:
        finder = Finder(lexicon)

        def each(ids: list, codes: list, *columns: list) -> tuple:
            rows = [(i, c, s, *v) for i, c, *row in zip(ids, codes, *columns) for s, v in _votes(finder, *row)]
            return tuple(zip(*rows)) if rows else ([],) * len(arrow)

        return each

    rows = articles.filter(F.trim("abstract_ar") != "").select(
        F.col("article_id").cast("bigint"), F.upper(F.nullif(F.regexp_extract("path", r"([A-Za-z]+)[^/\\]*$", 1), F.lit(""))).alias("code"), "abstract_ar", "keywords", "title", general_field(F.col("general_field")).alias("field"), source_ending(F.col("source")).alias("ending")
    )
    return with_address(cut(map_rows(rows, make, schema, arrow)))


def with_address(pairs: DataFrame, prior: float = 20.0) -> DataFrame:
    """``pairs`` with the address's vote: 0 to 2 by how the subject's share under the code compares with its share of all, 3 without a code.

    Shares are of pairs with several mentions; ``prior`` pairs of the overall share are added, so a rare code says little.
    """
    counted = pairs.filter("mentions >= 2").groupBy("code", "subject").agg(F.count("*").alias("n"))
    everywhere = counted.groupBy("subject").agg(F.sum("n").alias("ns"))
    total = F.sum("ns").over(Window.partitionBy(F.lit(0)))  # a row for each subject of the labels
    shares = everywhere.select("subject", (F.col("ns") / total).alias("share"))
    here = counted.filter("code is not null").groupBy("code").agg(F.sum("n").alias("nc"))
    lift = (F.coalesce("n", F.lit(0)) + prior * F.col("p")) / (F.coalesce("nc", F.lit(0)) + prior) / F.col("p")
    vote = F.when(F.col("code").isNull() | F.col("p").isNull(), 3).when(lift < 0.8, 0).when(lift < 1.25, 1).otherwise(2)
    known = pairs.join(shares.withColumnRenamed("share", "p"), "subject", "left").join(counted, ["code", "subject"], "left").join(here, "code", "left")
    return known.select(*pairs.columns, vote.alias("address"))


def learn_accuracies(patterns: dict[tuple[int, ...], int], rounds: int = 60) -> dict[tuple[int, ...], float]:
    """Posterior of each vote pattern under a latent model with independent votes.

    A pair is the abstract's first subject, a second one or a mention in
    passing: keywords, title and field speak for the first only, so with two
    classes they would vote the second down. The posterior is that of the
    first two classes together.
    """
    if not patterns:
        return {}
    keys = np.array(list(patterns))
    n = np.array(list(patterns.values()), float)
    # the start: several mentions are likely a subject, one is likely in passing
    several, alone = keys[:, 0] >= 2, keys[:, 2] == 3
    q = np.where(several[:, None], np.where(alone[:, None], [0.85, 0.1, 0.05], [0.5, 0.45, 0.05]), np.where(alone[:, None], [0.6, 0.1, 0.3], [0.03, 0.07, 0.9]))
    for _ in range(rounds):
        prior = (n @ q + 1) / (n.sum() + 3)
        odds = np.tile(np.log(prior), (len(n), 1))
        for v in range(keys.shape[1]):
            levels = keys[:, v].max() + 1
            # mentions, sentences and share tell nearly the same: they count as two votes
            weight = 2 / 3 if v < 3 else 1.0
            for c in range(3):
                with_level = np.bincount(keys[:, v], weights=n * q[:, c], minlength=levels) + 0.5
                odds[:, c] += weight * np.log(with_level / with_level.sum())[keys[:, v]]
        q = np.exp(odds - odds.max(axis=1, keepdims=True))
        q /= q.sum(axis=1, keepdims=True)
    return {tuple(int(x) for x in k): float(1 - p) for k, p in zip(keys, q[:, 2])}


def assign_subjects(articles: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(article_id, subject, posterior): every subject whose posterior reaches the threshold, and at least the likeliest one."""
    labelled = [(r["text"], r["subject"]) for r in labels.select("text", "subject").filter("text is not null and subject is not null").orderBy(F.xxhash64("text", "subject"), "text", "subject").limit(LABEL_BOUND).collect()]
    pairs = votes(articles, learn_lexicon(labelled))
    patterns = {tuple(r[v] for v in VOTES): r["count"] for r in pairs.groupBy(*VOTES).count().collect()}
    learned = learn_accuracies(patterns)
    spark = articles.sparkSession
    table = spark.createDataFrame([(*k, p) for k, p in learned.items()], ", ".join([*(f"{v} int" for v in VOTES), "posterior double"]))
    scored = pairs.join(F.broadcast(table), list(VOTES)).groupBy("article_id", "subject").agg(F.max("posterior").alias("posterior"))
    ranked = F.reverse(F.array_sort(F.collect_list(F.struct("posterior", "subject"))))
    best = scored.groupBy("article_id").agg(ranked.alias("best"))
    kept = F.filter("best", lambda x, i: (x["posterior"] >= threshold) | (i == 0))
    return best.select("article_id", F.explode(kept).alias("x")).select("article_id", "x.subject", F.round("x.posterior", 4).alias("posterior"))
