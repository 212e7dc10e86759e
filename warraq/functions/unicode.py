"""What Unicode and root stemming need Python for, as Arrow functions over whole batches."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


@F.pandas_udf(StringType())
def _nfkc(c: pd.Series) -> pd.Series:
    return c.map(lambda t: None if t is None else t if t.isascii() else unicodedata.normalize("NFKC", t))


def compatible(c: Column) -> Column:
    """Compatibility form without format signs; NULL stays NULL. Text of basic letters alone doesn't reach Python."""
    plain = ~c.rlike(r"[^\x00-\x7Fء-غف-ْ،؛؟]")
    return F.when(c.isNull() | plain, c).otherwise(F.regexp_replace(_nfkc(c), r"\p{Cf}", ""))


#: Fixed values of the published root stemmer for Arabic without a dictionary: affixes by length, longest first.
PREFIXES = (("كال", "بال", "ولل", "وال"), ("ال", "لل"), ("ل", "ب", "ف", "س", "و", "ي", "ت", "ن", "ا"))
SUFFIXES = (("تمل", "همل", "تان", "تين", "كمل"), ("ون", "ات", "ان", "ين", "تن", "كم", "هن", "نا", "يا", "ها", "تم", "كن", "ني", "وا", "ما", "هم"), ("ة", "ه", "ي", "ك", "ت", "ا", "ن"))
#: Its word patterns by length; the root stands at ف, ع and ل.
PATTERNS = {
    4: ("فاعل", "فعول", "فعال", "فعيل", "مفعل", "فعلة"),
    5: ("افتعل", "افاعل", "مفعول", "فاعول", "فعالة", "فعلان", "فعولة", "تفعلة", "تفعيل", "مفعلة", "مفتعل", "يفتعل", "تفتعل", "مفاعل", "تفاعل", "افعال", "فواعل", "فعائل", "منفعل", "انفعل", "فاعلة", "مفعال", "افعلل", "مفعلل", "تفعلل", "فعللة"),
    6: ("استفعل", "مفعالة", "افتعال", "افعوعل", "مستفعل", "انفعال", "متفاعل", "افعلال", "متفعلل"),
}


def _by_pattern(word: str) -> str | None:
    """The root of a word that fits a pattern of its length."""
    for p in PATTERNS.get(len(word), ()):
        if all(x in "فعل" or x == c for x, c in zip(p, word)):
            return "".join(c for x, c in zip(p, word) if x in "فعل")
    return None


@lru_cache(maxsize=200_000)
def root(word: str) -> str:
    """The root of an Arabic word: affixes off, longest first, until a pattern or three letters are left."""
    w = re.sub("[ً-ْ]", "", word)
    w = re.sub("[ءؤئ]", "ا", w) if re.search("^[أإآ]", w) is None else re.sub("^[أإآ]", "ا", w)
    if len(w) <= 3:
        return w
    for some, least in ((PREFIXES[0], 6), (PREFIXES[1], 5)):
        cut = next((p for p in some if len(w) >= least and w.startswith(p)), None)
        if cut:
            w = w[len(cut) :]
            break
    for some, least in ((SUFFIXES[0], 6), (SUFFIXES[1], 5)):
        cut = next((s for s in some if len(w) >= least and w.endswith(s)), None)
        if cut:
            w = w[: -len(cut)]
            break
    if len(w) >= 4 and w.startswith("وو"):
        w = w[1:]
    while len(w) > 3:
        found = _by_pattern(w)
        if found:
            return found
        if w[-1] in SUFFIXES[2]:
            w = w[:-1]
        elif w[0] in PREFIXES[2]:
            w = w[1:]
        else:
            break
    return w


@F.pandas_udf(ArrayType(StringType()))
def roots(tokens: pd.Series) -> pd.Series:
    """Roots of the tokens of each row; NULL stays NULL."""
    return tokens.map(lambda ts: None if ts is None else [root(t) for t in ts])
