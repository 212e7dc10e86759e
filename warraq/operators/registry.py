"""The author registry: cleaned names, first-seen ids, imputation, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from warraq.operators.relational import draw, numbered

#: Titles before a name.
AR_TITLES = r"^(?:(?:الأستاذ|الاستاذ|الدكتور|الدكتورة|الباحث|الباحثة|أستاذ|دكتور|أ\.د\.?|أ\.م\.د\.?|د\.|أ\.|م\.)\s+)+"
EN_TITLES = r"(?i)^(?:(?:prof|dr|mr|mrs|ms|eng)\.?\s+)+"


def clean_name(c: Column) -> Column:
    """A name without titles, brackets, marks and digits; NULL if fewer than three characters are left."""
    t = F.regexp_replace(F.regexp_replace(F.trim(c), AR_TITLES, ""), r"(?U)[_*()\[\]\d]", "")
    t = F.trim(F.regexp_replace(F.regexp_replace(F.trim(t), EN_TITLES, ""), r"(?U)\s+", " "))
    return F.when(F.length(t) >= 3, t)


def register(names: DataFrame, order: list[str], name: str = "name", prefix: str = "AUTH_", start: int = 1) -> DataFrame:
    """(id, name): an id for each distinct name, in first-seen order."""
    first = names.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.min(F.struct(*order)).alias("seen"))
    ranked = numbered(first, [F.col("seen"), F.col("name")], "n")
    return ranked.select(F.format_string(f"{prefix}%05d", F.col("n") + (start - 1)).alias("id"), "name")


def impute(articles: DataFrame, pool: DataFrame, seed: str = "42", candidates: int = 16) -> DataFrame:
    """(article_id, author_id, author_pos) for articles without authors.

    An article draws 1 to 4 authors with weights .60, .30, .08 and .02, and
    ``candidates`` places in the numbered pool by seeded hashes, of which the
    first distinct ones are taken; the pool is joined by number, so its size
    doesn't matter. A pool of fewer authors than drawn gives all of them.
    """
    size = pool.count()
    u = draw(seed, "article_id")
    k = F.when(u < 0.6, 1).when(u < 0.9, 2).when(u < 0.98, 3).otherwise(4)
    places = F.array(*(F.floor(draw(f"{seed}|{i}", "article_id") * size) + 1 for i in range(candidates)))
    drawn = articles.select("article_id", F.posexplode(F.slice(F.array_distinct(places), F.lit(1), k)).alias("at", "n"))
    ranked = numbered(pool.select("author_id"), [F.col("author_id")], "n")
    return drawn.join(ranked, "n").select("article_id", "author_id", (F.col("at") + 1).alias("author_pos"))


def author_ids(articles: DataFrame, names: str, registry: DataFrame, key: str = "article_id", name: str = "name") -> DataFrame:
    """(key, author_ids): the ids of each article's names, each once, in the order of the list.

    ``names`` is an array of names as they came; the registry has them
    cleaned, in ``name``. Articles without a known name have an empty array.
    """
    rows = articles.select(key, F.posexplode(names).alias("_at", "_raw")).select(key, "_at", clean_name(F.col("_raw")).alias("_name")).filter("_name is not null")
    first = rows.join(registry.select(F.col(name).alias("_name"), "id"), "_name").groupBy(key, "id").agg(F.min("_at").alias("_at"))
    lists = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_at", "id"))).alias("_ids"))
    return articles.select(key).distinct().join(lists, key, "left").select(key, F.coalesce(F.transform("_ids", lambda x: x["id"]), F.array().cast("array<string>")).alias("author_ids"))


#: Article numbers of so wide a range make one piece of an author's list.
SPAN = 100_000


def author_stats(links: DataFrame) -> DataFrame:
    """(author_id, articles_count): distinct articles of each author."""
    one = links.select("author_id", "article_id").filter("author_id is not null and article_id is not null").distinct()
    return one.groupBy("author_id").agg(F.count("*").alias("articles_count"))


def author_articles(links: DataFrame, span: int = SPAN) -> DataFrame:
    """(author_id, piece, articles_ids): distinct articles of each author, in order.

    A piece has the articles of one range of ``span`` numbers, so no row holds
    more than that, however many links an author has.
    """
    one = links.select("author_id", "article_id").filter("author_id is not null and article_id is not null").distinct()
    return one.groupBy("author_id", F.floor(F.col("article_id") / span).cast("bigint").alias("piece")).agg(F.array_sort(F.collect_list("article_id")).alias("articles_ids"))


def latest(df: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The latest delivery of each key; ties go to the greatest ``tie``."""
    w = Window.partitionBy(key).orderBy(F.col(at).desc_nulls_last(), F.col(tie).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
