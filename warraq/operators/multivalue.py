"""Several values packed in one field: one row per value, with its position.

Quoted spans, bracketed additions and reversed names ("Family, Given") are
taken out of the string first and stand there as indexed placeholders; what is
left is split at the delimiters; the spans come back through an array lookup.
A placeholder is U+E000, the index, U+E001. Text that holds U+E000 itself is
escaped before, so no text can be mistaken for a placeholder. Everything runs
as built-in expressions: no shuffle, no Python worker.

Defined results: NULL, blank, ``[]``, ``nan`` and ``None`` give no row;
repeated values are kept; empty values take no position; a table without rows
gives none; other columns of the input never take part, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "\ue000", "\ue001"
_CF = r"\p{Cf}*"

#: Delimiters that never stand inside a value, whatever surrounds them.
_HARD = r"[,،;؛|•\t\r\n]"
#: Slash and dash divide only between white space, as titles ("د/ ...") and compounds hold them too.
_SPACED = r"(?<=\s)[/\-–—](?=\s|$)"

_QUOTED = (
    r'"(?:[^"\\]|\\.)*"(?=[\s)]*(?:[,،;؛|\]})]|$))'
    r"|'(?:[^'\\]|\\.)*'(?=[\s)]*(?:[,،;؛|\]})]|$))"
)
_BRACKETED = r"\([^()]*\)"

NOTHING = ("", "[]", "{}", "()", "nan", "none", "null", "<na>", "na", "n/a")


def _spelled(word: str) -> str:
    """``word`` as a pattern that lets invisible characters stand between its letters."""
    return _CF.join(word) + _CF


_CLAN = "(?:" + "|".join(_spelled(w) for w in ("بني", "بنى", "بنی", "آل", "أبو", "Bani", "BANI", "bani")) + r")\s+"
_TITLE = r"(?:(?:[دم]|أ|أ\.? ?د|أ\.? ?م\.? ?د|Dr|Prof|Eng)[./]\s*|(?:ال)?(?:أستاذ|استاذ|دكتور|مهندس|باحث)ة?\s+){0,3}"
_GAP = r"[ \p{Zs}]"
_PART = r"[^\s,،;؛|•/&()" + OPEN + CLOSE + r"]"
#: A given name: no clan word, and no article but after "abd".
_GIVEN = rf"(?:(?:عبد|عبيد){_GAP}+ال{_PART}+|(?!{_CLAN}|ال|ﺍﻟ|[AEae]l[ \-]|AL-){_PART}+)"
_REVERSED = (
    rf"(?<=^\s{{0,4}}|[,،;؛|•\t\r\n&]\s{{0,4}}|\s[/\-–—و]\s{{1,4}})({_TITLE}(?:{_CLAN})?{_PART}{{2,}}){_GAP}*[,،]{_GAP}*"
    rf"({_GIVEN}(?:{_GAP}+(?!و{_GAP}|[\-–—]{_GAP}){_GIVEN}){{0,3}})(?=\s*(?:{_HARD}|&|\s[/\-–—و]\s|[/\-–—]?\s*$))"
)


@dataclass(frozen=True)
class Notation:
    """How one kind of field is packed.

    ``words``: delimiters that are words or signs of this field alone;
    ``reversed_names``: "Family, Given" is one value;
    ``closing_stop``: a full stop ends the list, not its last value;
    ``ids``: values are decimal integers, which white space divides too.
    """

    words: str = ""
    reversed_names: bool = False
    closing_stop: bool = False
    ids: bool = False


AUTHORS = Notation(words=r"&|(?<=\s)و(?=\s)", reversed_names=True)
KEYWORDS = Notation(closing_stop=True)
IDS = Notation(ids=True)


def _mask(text: Column, pattern: str, spans: Column) -> tuple[Column, Column]:
    """``text`` with each match of ``pattern`` as a placeholder, and ``spans`` with the matches appended."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    base = F.size(spans)
    marked = F.transform(
        pieces, lambda p, i: F.when(i < F.size(pieces) - 1, F.concat(p, F.lit(OPEN), (base + i).cast("string"), F.lit(CLOSE))).otherwise(p)
    )
    return F.array_join(marked, ""), F.concat(spans, found)


def _unquoted(span: Column) -> Column:
    """The value of a quoted span as the inner text of a JSON string."""
    # an escaped backslash is set aside, so no later step takes half of it for another escape
    pair = f"{OPEN}B{CLOSE}"
    inner = F.replace(span.substr(F.lit(2), F.length(span) - 2), F.lit("\\\\"), F.lit(pair))
    inner = F.regexp_replace(inner, r"\\x([0-9a-fA-F]{2})", r"\\u00$1")
    wide = F.array_distinct(F.regexp_extract_all(inner, F.lit(r"\\U[0-9a-fA-F]{8}"), F.lit(0)))
    shown = F.aggregate(wide, inner, lambda acc, m: F.replace(acc, m, F.decode(F.unhex(m.substr(F.lit(3), F.lit(8))), "UTF-32")))
    inner = F.when(F.contains(inner, F.lit("\\U")), shown).otherwise(inner)
    inner = F.regexp_replace(inner, r"\\'", "'")
    inner = F.regexp_replace(inner, r"\\(?![\"\\/bfnrtu])", r"\\\\")
    return F.replace(F.regexp_replace(inner, r'(?<!\\)"', r'\\"'), F.lit(pair), F.lit("\\\\"))


def split_values(value: Column, notation: Notation = Notation()) -> Column:
    """The values packed in ``value``, in the order of the string, as an array; NULL and "nothing" give an empty one."""
    empty = F.array().cast("array<string>")
    text = F.regexp_replace(F.coalesce(value, F.lit("")), OPEN, f"{OPEN}L{CLOSE}")
    text = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    listed = text.rlike(r"^[\[{(]") & text.rlike(r"[\]})]$")
    quoted = text.rlike(r"^[\[{(]?\s*(?:np\.\w+\(\s*)?[\"']")
    # 1. quoted spans, of one kind each per value, decoded as JSON strings in one parse
    q_text, q_spans = _mask(text, _QUOTED, empty)
    q_values = F.from_json(
        F.concat(F.lit("["), F.array_join(F.transform(q_spans, lambda s: F.concat(F.lit('"'), _unquoted(s), F.lit('"'))), ","), F.lit("]")),
        "array<string>",
        {"allowUnquotedControlChars": "true"},
    )
    q_values = F.when(F.size(q_values) == F.size(q_spans), q_values).otherwise(F.transform(q_spans, lambda s: s.substr(F.lit(2), F.length(s) - 2)))
    q_text = F.regexp_replace(q_text, r"np\.\w+\(|^\s*[\[{(]|[\]})]\s*$", "")
    q_text = F.regexp_replace(q_text, rf"({CLOSE})\)", "$1")
    # 2. bare values: bracketed additions, then reversed names
    bare = F.when(listed, F.regexp_replace(text, r"^[\[{(]|[\]})]$", "")).otherwise(text)
    if notation.ids:
        b_text, b_spans = F.regexp_replace(bare, r"np\.\w+\(|\)", ""), empty
    else:
        if notation.closing_stop:
            bare = F.regexp_replace(bare, r"\s*\.\s*$", "")
        b_text, b_spans = _mask(bare, _BRACKETED, empty)
        if notation.reversed_names:
            b_text, b_spans = _mask(b_text, "(?U)" + _REVERSED, b_spans)
    masked = F.when(quoted, q_text).otherwise(b_text)
    spans = F.when(quoted, q_values).otherwise(b_spans)
    # 3. split what is left
    delimiters = "|".join(x for x in (_HARD, _SPACED, notation.words, r"\s" if notation.ids else "") if x)
    items = F.split(masked, "(?U)" + delimiters, -1)

    def restored(item: Column) -> Column:
        # a reversed name may hold a bracketed addition, so its placeholder opens to another one
        for _ in range(2 if notation.reversed_names else 1):
            item = F.aggregate(
                F.regexp_extract_all(item, F.lit(f"{OPEN}(\\d+){CLOSE}"), F.lit(1)),
                item,
                lambda acc, k: F.replace(acc, F.concat(F.lit(OPEN), k, F.lit(CLOSE)), F.get(spans, k.cast("int"))),
            )
        return F.regexp_replace(F.regexp_replace(item, f"{OPEN}L{CLOSE}", OPEN), r"(?U)^\s+|\s+$", "")

    items = F.transform(items, restored)
    if notation.ids:
        digits = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
        items = F.transform(items, lambda x: F.regexp_replace(F.translate(x, digits, "01234567890123456789"), r"\.0+$", ""))
        items = F.transform(F.filter(items, lambda x: x.rlike(r"^\d+$")), lambda x: F.regexp_replace(x, r"^0+(?=\d)", ""))
    nothing = F.lower(text).isin(*NOTHING)
    return F.when(nothing, empty).otherwise(F.filter(items, lambda x: x.isNotNull() & ~F.lower(x).isin(*NOTHING)))


def explode_values(df: DataFrame, key: str, column: str, notation: Notation, field: str) -> DataFrame:
    """One row (field, rec_key, pos, item) per value of ``column``; pos counts from 1."""
    packed = df.select(F.col(key).cast("string").alias("rec_key"), split_values(F.col(column), notation).alias("items"))
    rows = packed.select("rec_key", F.posexplode("items").alias("at", "item"))
    return rows.select(F.lit(field).alias("field"), "rec_key", (F.col("at") + 1).alias("pos"), "item")
