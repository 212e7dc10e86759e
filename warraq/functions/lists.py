"""Lists that came as text, and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from warraq.functions.text import publish_date

_ARRAY = "array<string>"


def literal_list(c: Column) -> Column:
    """A JSON or Python list literal of strings; anything else gives an empty array."""
    return F.coalesce(F.from_json(c, _ARRAY), F.array().cast(_ARRAY))


def list_or_commas(c: Column) -> Column:
    """A list literal, else the parts between commas; NULL gives an empty array."""
    parts = F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.from_json(c, _ARRAY), parts, F.array().cast(_ARRAY))


def bracket_list(c: Column, keep_empty: bool = False) -> Column:
    """The parts between commas without brackets and quotes; NULL, blank and ``[]`` give an empty array."""
    inner = F.regexp_replace(F.trim(c), r"^\[|\]$", "")
    parts = F.transform(F.split(inner, ","), lambda x: F.regexp_replace(F.trim(x), r"^[\"']+|[\"']+$", ""))
    parts = parts if keep_empty else F.filter(parts, lambda x: x != "")
    return F.when(F.coalesce(F.trim(inner), F.lit("")) == "", F.array().cast(_ARRAY)).otherwise(parts)


def id_list(c: Column) -> Column:
    """Ids of a list, also of one printed as ``np.str_('...')``."""
    return bracket_list(F.regexp_replace(F.regexp_replace(c, r"np\.str_\(", ""), r"\)", ""))


def int_list(c: Column) -> Column:
    """Whole numbers of a list; other parts fall out."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(c, r"[\[\]]", ""), ","), lambda x: F.trim(x)), lambda x: x.rlike(r"^\d+$"))
    return F.coalesce(F.transform(parts, lambda x: x.cast("bigint")), F.array().cast("array<bigint>"))


def split_any(c: Column) -> Column:
    """Parts between any of the common list delimiters, trimmed, none empty."""
    return F.filter(F.transform(F.split(c, r"[،,;؛|•]"), lambda x: F.trim(x)), lambda x: x != "")


def joined(c: Column, by: str = ", ") -> Column:
    """Non-blank items without quotes, as one text."""
    return F.array_join(F.filter(F.transform(c, lambda x: F.regexp_replace(F.trim(x), r"^[\"']+|[\"']+$", "")), lambda x: x != ""), by)


def first_json(c: Column, schema: str) -> Column:
    """The JSON object from the first opening to the last closing brace; NULL if it is none."""
    return F.from_json(F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit("")), schema, {"mode": "PERMISSIVE"})


REPLY = "title_ar string, title_en string, abstract_ar string, abstract_en string, general_field string, authors array<string>"


def normalized_reply(c: Column, fields: tuple[str, ...], default_field: str = "Education") -> Column:
    """A metadata reply with defaults; a field outside the list resets the whole to defaults."""
    r = first_json(c, REPLY)
    text = lambda n: F.coalesce(F.trim(r[n]), F.lit("")).alias(n)
    field = F.coalesce(F.nullif(F.trim(r["general_field"]), F.lit("")), F.lit(default_field))
    good = F.struct(text("title_ar"), text("title_en"), text("abstract_ar"), text("abstract_en"), field.alias("general_field"), F.coalesce(r["authors"], F.array().cast(_ARRAY)).alias("authors"))
    empty = F.struct(*(F.lit("").alias(n) for n in ("title_ar", "title_en", "abstract_ar", "abstract_en")), F.lit(default_field).alias("general_field"), F.array().cast(_ARRAY).alias("authors"))
    return F.when(r.isNotNull() & field.isin(*fields), good).otherwise(empty)


PAGES_REPLY = "title string, abstract_ar string, general_field string, authors array<string>, keywords array<string>, publish_date string"


def pages_reply(c: Column) -> Column:
    """The reply to a request over two pages: texts trimmed, lists without blank items, a date from its year at least; NULL and text that is no object give NULL."""
    r = first_json(c, PAGES_REPLY)
    some = lambda n: F.filter(F.transform(F.coalesce(r[n], F.array().cast(_ARRAY)), lambda x: F.trim(x)), lambda x: x != "").alias(n)
    text = lambda n: F.coalesce(F.trim(r[n]), F.lit("")).alias(n)
    there = F.coalesce(*(r[n].cast("string") for n in ("title", "abstract_ar", "general_field", "authors", "keywords", "publish_date")))
    return F.when(there.isNotNull(), F.struct(text("title"), text("abstract_ar"), text("general_field"), some("authors"), some("keywords"), publish_date(r["publish_date"]).alias("publish_date")))
