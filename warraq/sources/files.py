"""CSV, text, folder and document sources; CSV, chunk and token sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from warraq.operators.relational import align, chunked, existing


def text_schema(columns: list[str]) -> StructType:
    """Every column as text, as a CSV file holds it."""
    return StructType([StructField(c, StringType()) for c in columns])


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A headed CSV file of text columns; cells may hold line ends and doubled quotes, the file may start with a byte order mark."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8")
    df = reader.schema(text_schema(columns)).csv(path) if columns else reader.option("inferSchema", False).csv(path)
    return df.toDF(*(c.lstrip("﻿") for c in df.columns))


def csv_columns(spark: SparkSession, path: str) -> list[str]:
    """The header alone."""
    return read_csv(spark, path).limit(0).columns


def read_maybe_headed(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV file with or without a header: a row that equals the column names is left out."""
    df = spark.read.option("multiLine", True).option("escape", '"').schema(text_schema(columns)).csv(path)
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.lit(c))
    return df.filter(~same)


def load_or_create(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """An output table as far as there is one, with the columns asked for; else an empty one."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], text_schema(columns))
    df = spark.read.parquet(path)
    empty = spark.createDataFrame([], text_schema(columns))
    return empty.unionByName(df.select(*(F.col(c).cast("string").alias(c) for c in df.columns if c in columns)), allowMissingColumns=True)


def read_whole_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): each file as one text."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def list_documents(spark: SparkSession, root: str, field_depth: int = 2, source: str | None = None) -> DataFrame:
    """(path, general_field, source) of the PDF files under a folder; the field is the folder a file lies in."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(root).select("path")
    return files.select("path", F.element_at(F.split("path", "/"), -field_depth).alias("general_field"), F.lit(source).cast("string").alias("source"))


PageReader = Callable[[bytes], list[str]]


def first_pages(spark: SparkSession, root: str, readers: list[Callable[[], PageReader]], pages: int = 2) -> DataFrame:
    """(path, page1.., error): the first pages' text of each PDF file.

    ``readers`` are tried in order (text layer, then a recogniser): a blank
    page is asked of the next one. A failure of the last one is the row's error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(root).select("path", "content")
    schema = ", ".join(["path string", *(f"page{k + 1} string" for k in range(pages)), "error string"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = [m() for m in readers]
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                found: list[str | None] = [None] * pages
                error = None
                for read in made:
                    if all(t and t.strip() for t in found):
                        break
                    try:
                        error = None
                        for k, t in enumerate(read(content)[:pages]):
                            found[k] = found[k] if found[k] and found[k].strip() else t
                    except Exception as x:  # noqa: BLE001  a bad file must not end the job
                        error = str(x)
                rows.append((path, *found, error))
            yield pd.DataFrame(rows, columns=["path", *(f"page{k + 1}" for k in range(pages)), "error"])

    return files.mapInPandas(run, schema)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, mode: str = "overwrite", quote_all: bool = False) -> None:
    """A headed CSV folder of the columns there are; ``append`` adds to it."""
    rows = existing(df, columns) if columns else df
    rows.write.mode(mode).option("header", True).option("escape", '"').option("quoteAll", quote_all).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_chunks(df: DataFrame, path: str, order: list[Column], rows: int = 200) -> None:
    """Chunks of ``rows`` rows, a folder each."""
    chunked(df, order, rows).write.mode("overwrite").partitionBy("chunk").parquet(path)


def write_snapshots(df: DataFrame, path: str, order: list[Column], rows: int = 100) -> None:
    """The state after each batch of ``rows`` rows: a folder for each batch, added to what is there."""
    chunked(df, order, rows, "batch_id").write.mode("append").partitionBy("batch_id").parquet(path)


def write_tokens(df: DataFrame, tokens: str, path: str) -> None:
    """One token a line."""
    df.select(F.explode(tokens).alias("value")).write.mode("overwrite").text(path)


def gather(sources: list[tuple[DataFrame, str | None]], columns: list[str], key: str = "path") -> DataFrame:
    """All sources as one table of text columns, each with its source's name, a row for each key."""
    parts = [align(df.withColumn("source", F.lit(name)) if name else df, columns) for df, name in sources]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates([key])
