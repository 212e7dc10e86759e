"""Incremental ingest: new article files are cleaned, extracted and merged once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from warraq.functions.text import clean_page, token_estimate
from warraq.operators.extraction import extract_abstracts, extract_keywords, full_text

MIN_TOKENS = 400


def prepare(articles: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """Articles with cleaned pages, abstract and keywords; the same for streams and tables. Shorter ones fall out."""
    pages = articles.withColumns({"page1": clean_page(F.col("page1")), "page2": clean_page(F.col("page2"))})
    kept = pages.withColumn("tokens", token_estimate(F.col("page1")) + token_estimate(F.col("page2"))).filter(F.col("tokens") >= min_tokens)
    full = kept.withColumn("_full", full_text(F.col("page1"), F.col("page2")))
    return extract_keywords(extract_abstracts(full, "_full"), "_full").drop("_full")


def ingest(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, key: str = "article_id", min_tokens: int = MIN_TOKENS) -> StreamingQuery:
    """Reads the Parquet files that are new in ``source`` and adds their articles to ``target``.

    A batch is written to a folder of its own number, so a batch that is run
    again replaces what it wrote; an article already in an earlier folder is
    left out.
    """
    stream = prepare(spark.readStream.schema(schema).parquet(source), min_tokens)

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates([key])
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(target)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            earlier = spark.read.parquet(target).filter(F.col("batch") < number).select(key)
            rows = rows.join(earlier, key, "left_anti")
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str = "ts", width: str = "1 hour", late: str = "2 hours", by: str = "event_type") -> DataFrame:
    """Events of each kind and window; on a stream, events later than ``late`` fall out and windows close."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")
