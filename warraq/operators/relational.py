"""Table operators of the pipelines: alignment, merging, resuming, chunking, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from warraq.functions.text import is_missing


def existing(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that there are, in the order asked for."""
    return df.select(*(c for c in wanted if c in df.columns))


def align(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns as text, in order; a missing one is empty."""
    return df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in wanted))


def prefer_existing(df: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Each column, filled from its extracted one where it is missing; the extracted ones go."""
    return df.withColumns({c: F.when(is_missing(F.col(c)), F.col(x)).otherwise(F.col(c)) for c, x in pairs.items()}).drop(*pairs.values())


def needs_extraction(columns: list[str]) -> Column:
    """Whether any of the columns is missing."""
    out = F.lit(False)
    for c in columns:
        out = out | is_missing(F.col(c))
    return out


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows not done yet."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def orphans(referring: DataFrame, ref: str, existing_rows: DataFrame, key: str) -> DataFrame:
    """Distinct references to rows that don't exist."""
    refs = referring.select(F.col(ref).alias(key)).filter(F.col(key).isNotNull()).distinct()
    return refs.join(existing_rows.select(key), key, "left_anti")


def route_by_script(df: DataFrame, authors: str = "authors", english: str = "authors_en") -> DataFrame:
    """A cell with Arabic letters stays in ``authors``, any other moves to ``authors_en``; empty cells are NULL in both."""
    cell = F.when(F.col(authors) != "", F.col(authors))
    arabic = cell.rlike(r"[؀-ۿ]")
    return df.withColumns({authors: F.when(arabic, cell), english: F.when(~arabic, cell)})


def split_source(df: DataFrame, code: str, source: str = "source", field: str = "general_field", path: str = "path") -> DataFrame:
    """``CODE_x`` as source CODE and field x; a bare CODE takes its field from the path."""
    tail = F.regexp_extract(source, rf"^{code}_(.*)$", 1)
    from_path = F.nullif(F.regexp_extract(path, rf"(?:^|/){code}/([^/]*)", 1), F.lit(""))
    is_tailed = F.col(source).startswith(f"{code}_")
    return df.withColumns({field: F.when(is_tailed, tail).when(F.col(source) == code, from_path).otherwise(F.col(field)), source: F.when(is_tailed, F.lit(code)).otherwise(F.col(source))})


def numbered(df: DataFrame, order: list[Column], name: str = "n", parts: int | None = None) -> DataFrame:
    """Consecutive numbers from 1 in the order given, without one task that sees all rows.

    Rows are ranged into parts by the order; a part's rows are numbered in it,
    and the sizes of the parts before it are added. There are as many parts as
    the session shuffles to, unless ``parts`` says otherwise.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    from warraq.session import cut

    ranged = cut(ranged)  # the parts must be the same in both passes
    sizes = ranged.groupBy("_part").count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    offsets = sizes.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_part").orderBy(*order)
    return ranged.withColumn("_rn", F.row_number().over(within)).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_rn") + F.col("_before")).drop("_part", "_rn", "_before")


def chunked(df: DataFrame, order: list[Column], rows: int, name: str = "chunk") -> DataFrame:
    """The number of the chunk of ``rows`` rows that a row falls in, from 0."""
    return numbered(df, order, "_n").withColumn(name, F.floor((F.col("_n") - 1) / rows).cast("bigint")).drop("_n")


def draw(seed: str, *columns: str) -> Column:
    """A number for each row, in [0, 1), that depends on the seed and the columns alone."""
    text = F.concat_ws("|", F.lit(seed), *(F.col(c).cast("string") for c in columns))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def sample_rows(df: DataFrame, n: int, seed: str, key: str) -> DataFrame:
    """``n`` rows drawn by a seeded hash of their key: the same in any layout."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))), key).limit(n)


def train_test(df: DataFrame, seed: str, key: str, share: float = 0.2) -> DataFrame:
    """``is_test`` for the ceiling of ``share`` of the rows, by rank of the seeded hash."""
    total = df.count()
    order = [F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))), F.col(key)]
    return numbered(df, order, "_n").withColumn("is_test", F.col("_n") <= -int(-total * share // 1)).drop("_n")
