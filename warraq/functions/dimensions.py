"""One spelling for dirty dimension values: sources and general fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The subject areas, in order.
SUBJECTS = ("Art", "Agricultural", "Arabic", "Business", "Education", "Engineering", "Medical", "Music", "Science", "Social Science", "Computer Science", "History", "Psychology")
#: Other spellings of a subject area, in lower case.
FIELD_NAMES = {
    "bus": "Business", "edu": "Education", "cs": "Computer Science", "medicine": "Medical", "agriculture": "Agricultural", "arts": "Art",
    "تاريخ": "History", "إدارة أعمال": "Business", "علم النفس": "Psychology", "طب": "Medical", "فنون": "Art", "هندسة": "Engineering", "تربية": "Education",
    "زراعة": "Agricultural", "موسيقى": "Music", "علوم": "Science", "لغة عربية": "Arabic", "علوم اجتماعية": "Social Science", "علوم الحاسوب": "Computer Science",
}
_MISSING = ("", "-", "nan", "none", "null", "n/a", "unknown")


def general_field(value: Column) -> Column:
    """The subject area a general_field names; NULL if it names none of them."""
    low = F.lower(F.trim(F.translate(value, "_", " ")))
    names = F.create_map(*[F.lit(x) for kv in ({s.lower(): s for s in SUBJECTS} | FIELD_NAMES).items() for x in kv])
    return names[low]


def source_key(value: Column) -> Column:
    """A source without case, outer blanks and a field's ending (``_Art``); NULL for missing ones."""
    base = F.upper(F.regexp_replace(F.trim(value), r"_\w{2,4}$", ""))
    return F.when(value.isNull() | F.lower(F.trim(value)).isin(*_MISSING), None).otherwise(base)


def source_ending(value: Column) -> Column:
    """The subject area that a source's ending names (``NBA_Art``); NULL without one."""
    return general_field(F.nullif(F.regexp_extract(F.trim(value), r"_(\w{2,4})$", 1), F.lit("")))


def canonical_source(df: DataFrame, source: str, source_map: DataFrame, to: str = "source") -> DataFrame:
    """``df`` with the acronym of its source as column ``to``.

    A source is looked up in the map by acronym, full name and host; one that
    stands in none keeps its key, a missing one is NULL. The map is a small
    table by nature; a join hint is left to the optimizer's size check.
    """
    names = source_map.select(F.explode(F.array(*(F.upper(F.trim(c)) for c in ("acronym", "full_name", "host")))).alias("_name"), F.col("acronym").alias("_acronym")).filter("_name is not null").dropDuplicates(["_name"])
    keyed = df.withColumn("_key", source_key(F.col(source)))
    joined = keyed.join(names, F.col("_key") == F.col("_name"), "left")
    return joined.withColumn(to, F.coalesce("_acronym", "_key")).drop("_key", "_name", "_acronym")
