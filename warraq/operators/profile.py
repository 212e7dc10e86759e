"""Profiles of tables: missing values, frequencies, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_counts(df: DataFrame) -> DataFrame:
    """(column_name, nulls, n_rows), one row for each column, in one pass."""
    one = df.agg(F.count("*").alias("_n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in df.columns)))
    return one.select(pairs.alias("x"), F.col("_n").alias("n_rows")).select("x.column_name", "x.nulls", "n_rows")


def table_info(df: DataFrame) -> DataFrame:
    """(column_name, dtype, non_null, n_rows, n_columns), one row for each column."""
    kinds = F.create_map(*(F.lit(x) for kv in df.dtypes for x in kv))
    return null_counts(df).select("column_name", kinds[F.col("column_name")].alias("dtype"), (F.col("n_rows") - F.col("nulls")).alias("non_null"), "n_rows", F.lit(len(df.columns)).alias("n_columns"))


def missing_share(df: DataFrame) -> DataFrame:
    """(column_name, pct) of the columns with NULLs."""
    return null_counts(df).filter("nulls > 0").select("column_name", (F.col("nulls") * 100.0 / F.col("n_rows")).alias("pct"))


def value_counts(df: DataFrame, column: str, drop_null: bool = True) -> DataFrame:
    """(value, n)."""
    rows = df.filter(F.col(column).isNotNull()) if drop_null else df
    return rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """(n_duplicates): rows that repeat an earlier one."""
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n_duplicates"))


def describe(df: DataFrame, column: str) -> DataFrame:
    """count, mean, sample deviation, least, exact quartiles, greatest."""
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("lo"), q.alias("q"), F.max(column).alias("hi")).select(
        "n", "mean", "std", "lo", *(F.col("q")[i].alias(f"q{25 * (i + 1)}") for i in range(3)), "hi"
    )


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, n) over equal widths, the last bin closed on the right; empty bins have no row."""
    span = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.when(F.col("_hi") == F.col("_lo"), F.lit(1)).otherwise(F.least(F.floor((F.col(column) - F.col("_lo")) / width) + 1, F.lit(bins)))
    # one row, so it may be joined to all
    return df.filter(F.col(column).isNotNull()).join(F.broadcast(span)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def box(df: DataFrame, column: str) -> DataFrame:
    """Quartiles, whiskers at most 1.5 ranges away, mean."""
    q = df.agg(F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q")).select(F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"))
    both = df.select(F.col(column).alias("_v")).filter("_v is not null").join(F.broadcast(q))
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside: Column = (F.col("_v") >= F.col("q1") - reach) & (F.col("_v") <= F.col("q3") + reach)
    return both.groupBy("q1", "median", "q3").agg(F.min(F.when(inside, F.col("_v"))).alias("low"), F.max(F.when(inside, F.col("_v"))).alias("high"), F.avg("_v").alias("mean"))
