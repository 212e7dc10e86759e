"""Queries of the problems tagged llm, over their whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warraq.llm import budget, encode, labels, langid, names, noise, packing, residue, subjects, unify
from warraq.sources import load

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """(row_no, page_no, kind): kinds of damage of each page."""
    found = noise.repair_pages(load(spark, d, "sample_articles"), with_text=False)
    return found.select("row_no", "page_no", F.explode("kinds").alias("kind")).distinct()


def p1_repaired(spark: SparkSession, d: str) -> DataFrame:
    """(row_no, page_no, text): continuous paragraphs of each page."""
    return noise.repair_pages(load(spark, d, "sample_articles")).select("row_no", "page_no", "text")


def _values(spark: SparkSession, d: str) -> DataFrame:
    return unify.unify(unify.text_fields(load(spark, d, "sample_articles"), load(spark, d, "authors06")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """(field, rec_key): values that the one form changes."""
    return _values(spark, d).filter("changed").select("field", "rec_key").distinct()


def p2_unified(spark: SparkSession, d: str) -> DataFrame:
    """(field, rec_key, value) in one form."""
    return _values(spark, d).select("field", "rec_key", F.col("unified").alias("value"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """(id_a, id_b): records of the same entity."""
    return names.entity_pairs(names.link_names(load(spark, d, "authors06"), load(spark, d, "authors")))


def p3_entities(spark: SparkSession, d: str) -> DataFrame:
    """(id, entity) of every record that is a name."""
    return names.link_names(load(spark, d, "authors06"), load(spark, d, "authors"))


def _model(spark: SparkSession, d: str):
    return langid.train(load(spark, d, "documents"))


def p4_page_totals(spark: SparkSession, d: str) -> DataFrame:
    """Token totals of the pages of sample_articles by source, language and general field."""
    texts = budget.page_texts(load(spark, d, "sample_articles"))
    return budget.roll_up(budget.count_documents(texts, _model(spark, d), load(spark, d, "source_map")))


def p4_document_totals(spark: SparkSession, d: str) -> DataFrame:
    """The same of documents."""
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("doc_key"), "text", "source", "general_field")
    return budget.roll_up(budget.count_documents(docs, _model(spark, d), load(spark, d, "source_map")))


def p4_page_tokens(spark: SparkSession, d: str) -> DataFrame:
    """(row_no, page_no, n_tokens) of every page."""
    pages = budget.page_texts(load(spark, d, "sample_articles"))
    counted = budget.count_tokens(pages, "doc_key", "text")
    return counted.select(F.floor(F.col("doc_key") / 2).cast("bigint").alias("row_no"), (F.col("doc_key") % 2 + 1).cast("int").alias("page_no"), "n_tokens")


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return subjects.assign_subjects(load(spark, d, "sample_articles"), load(spark, d, "subject_labels"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """(article_id, subject)."""
    return _subjects(spark, d).select("article_id", "subject")


def p5_composition(spark: SparkSession, d: str) -> DataFrame:
    """(subject, articles): what the corpus is made of."""
    return _subjects(spark, d).groupBy("subject").agg(F.count("*").alias("articles"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """(field, rec_key, lang): missing or wrong labels of documents, languages of pages and name lists."""
    docs, sample = load(spark, d, "documents"), load(spark, d, "sample_articles")
    model, prose = labels.fit(docs)
    text = labels.wrong_labels(docs, model, prose).select(F.lit("text").alias("field"), F.col("doc_id").alias("rec_key"), "lang")
    pages = langid.page_languages(sample, "row_no", "page1", model).select(F.lit("page1").alias("field"), F.col("row_no").alias("rec_key"), "lang")
    lists = langid.name_list_languages(sample, "row_no", "authors", model).select(F.lit("authors").alias("field"), F.col("row_no").alias("rec_key"), "lang")
    return text.unionByName(pages).unionByName(lists).distinct()


def p7_documents(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, lang, confidence) of every document."""
    docs = load(spark, d, "documents")
    return langid.identify(docs, "doc_id", "text", langid.train(docs))


def p7_segments(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, seg_no, start, end, lang, confidence): the spans of one language of every document."""
    docs = load(spark, d, "documents")
    return langid.segments(docs, "doc_id", "text", langid.train(docs))


def p7_field_segments(spark: SparkSession, d: str) -> DataFrame:
    """(field, rec_key, seg_no, start, end, lang, confidence): the spans of one language of every page and name list."""
    sample, model = load(spark, d, "sample_articles"), _model(spark, d)
    of = lambda found, field: found.select(F.lit(field).alias("field"), F.col("row_no").alias("rec_key"), *found.columns[1:])
    page1, authors = of(langid.segments(sample, "row_no", "page1", model), "page1"), of(langid.name_list_segments(sample, "row_no", "authors"), "authors")
    return page1.unionByName(authors)


def p7_field_languages(spark: SparkSession, d: str) -> DataFrame:
    """(field, rec_key, lang, confidence): the languages of every page and name list."""
    sample, model = load(spark, d, "sample_articles"), _model(spark, d)
    pages = langid.page_languages(sample, "row_no", "page1", model).select(F.lit("page1").alias("field"), F.col("row_no").alias("rec_key"), "lang", "confidence")
    lists = langid.name_list_languages(sample, "row_no", "authors", model).select(F.lit("authors").alias("field"), F.col("row_no").alias("rec_key"), "lang", "confidence")
    return pages.unionByName(lists)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, ids) of every document."""
    return encode.encode(load(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id): documents that alone exceed a container. The operator's first step tells it, before any container is planned."""
    return packing.split_parts(packing.measured(load(spark, d, "documents"))).filter("n_parts > 1").select("doc_id").distinct()


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, part_no, n_parts, size, container)."""
    return packing.pack(load(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id): documents without real content."""
    return residue.find_residue(load(spark, d, "documents")).filter("kind is not null").select("doc_id").distinct()


def p10_marked(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, kind, covered) of every document."""
    return residue.find_residue(load(spark, d, "documents"))


def queries() -> dict[str, Query]:
    """Every query of this subpackage, by name."""
    return {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    """None: the models and tokenizers here can't be told in SQL; tests hold them against plain versions."""
    return {}
