"""One form for text that looks the same (problem 2).

Equivalences between strings (compatibility forms, composed and decomposed
letters, spaces, invisible characters, look-alike letters) are closed by
union-find into classes. The member most frequent in the corpus represents its
class; every other member goes into a multi-pattern automaton that rewrites
text greedily, longest match first. Look-alikes of other alphabets are
rewritten only inside a word that has letters of the class's own script, and
Arabic or Persian letters after the language of the words around them, so
whole Cyrillic words, formula symbols and Persian text stay.

Counts cover every value; a built-in filter keeps values that cannot hold a
variant away from Python. NULL stays NULL, an empty text stays empty, repeated
rows give repeated rows, an empty table an empty one.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warraq.llm.batches import map_rows

#: Letters of other alphabets that look like a Latin one.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ν": "v", "ι": "i", "α": "a", "ρ": "p", "υ": "u", "κ": "k", "τ": "t",
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "յ": "j", "Օ": "O", "Տ": "S", "Ս": "U", "Լ": "L",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮢ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    "ɑ": "a", "ɡ": "g", "ᴄ": "c", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ⲟ": "o", "ꓮ": "A", "ꓳ": "O",
}
#: Letters of neighbouring Arabic-script alphabets that look alike.
ARABIC_LOOKALIKES = [("ي", "ی"), ("ك", "ک"), ("ه", "ہ"), ("ه", "ھ")]
#: What is ordinary in a context where neither has been seen.
_ORDINARY = {"": "يكه", "fa": "یکه"}

_SCRIPT_WORDS = {
    "fa": frozenset("در است این به از را که شد میان بود با برای های می و".split()),
    "ar": frozenset("في من على إلى عن التي الذي هذه هذا بين مع قد خلال ما".split()),
}
_FA, _AR = re.compile("[پچژگ]"), re.compile("[ةأإؤئيكىءآ]|^ال|^وال|^بال|^لل")
#: What a value must hold to have any variant at all.
SUSPECT = (
    r"[\p{Cf}   -   　̀-ͯٓ-ٕکیہھﬀ-﷿ﹰ-￯]"
    r"|\p{IsLatin}[Ͱ-ӿԁ-ԝ]|[Ͱ-ӿԁ-ԝ]\p{IsLatin}"
    r"|[\u0251\u0261\u0531-\u0586\u13a0-\u13ff\u1d00-\u1d25\u2c80-\u2cff\ua4d0-\ua4ff\u2160-\u217f\u2460-\u249b\u24b6-\u24ea\x{1d400}-\x{1d7ff}]"
    r"|[0-9\u0660-\u0669](?=[\u0966-\u096f\u06f0-\u06f9])|[0-9\u06f0-\u06f9](?=[\u0966-\u096f\u0660-\u0669])|[\u0660-\u0669\u06f0-\u06f9\u0966-\u096f](?=[0-9])"
)
#: Compatibility forms that stand for a letter or digit itself; powers, fractions and signs mean something else.
_FORMS = ("<font>", "<circle>", "<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>", "<compat>")


class Classes:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: str, b: str) -> None:
        self.parent[self.find(a)] = self.find(b)

    def members(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in list(self.parent):
            out.setdefault(self.find(x), []).append(x)
        return {k: sorted(v) for k, v in out.items()}


def equivalences() -> Iterator[tuple[str, str]]:
    """Pairs of strings that look the same, from the Unicode database and the two tables above."""
    blocks = [*range(0xFB00, 0xFE00), *range(0xFE70, 0xFEFD), *range(0xFF01, 0xFFEF)]
    alike = [cp for cp in (*range(0x2160, 0x2180), *range(0x2460, 0x249C), *range(0x24B6, 0x24EB), *range(0x1D400, 0x1D800)) if unicodedata.decomposition(chr(cp)).startswith(_FORMS)]
    for cp in blocks + alike:
        c = chr(cp)
        plain = unicodedata.normalize("NFKC", c)
        # Greek letters of formulas stay what they are
        if plain != c and not plain.isspace() and not unicodedata.combining(plain[-1]) and (cp < 0x1D400 or cp > 0x1D7FF or plain.isascii()):
            yield c, plain.strip()
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0x622, 0x627), *range(0x6C0, 0x6D4)]:
        c = chr(cp)
        apart = unicodedata.normalize("NFD", c)
        if len(apart) > 1 and unicodedata.normalize("NFC", apart) == c:
            yield apart, c
    for cp in range(0x80, sys.maxunicode + 1):
        kind = unicodedata.category(chr(cp))
        if kind == "Zs":
            yield chr(cp), " "
        elif kind == "Cf" and not 0x600 <= cp <= 0x605 and cp != 0x6DD:
            yield chr(cp), ""
    yield from LOOKALIKES.items()
    yield from ARABIC_LOOKALIKES


def is_persian(words: list[str]) -> bool:
    """Whether a run of words is Persian rather than Arabic, by letters and small words."""
    fa = ar = 0
    for w in words:
        fa += (2 if _FA.search(w) else 0) + (w in _SCRIPT_WORDS["fa"] and w not in _SCRIPT_WORDS["ar"])
        ar += (1 if _AR.search(w) else 0) + (w in _SCRIPT_WORDS["ar"])
    return fa > ar


def codepoint_counts(df: DataFrame, column: str) -> dict[str, dict[str, int]]:
    """Occurrences of each code point in all values, in Persian lines ("fa") and elsewhere ("").

    At most one row per code point and context comes to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros(sys.maxunicode + 1, np.int64) for k in ("", "fa")}
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t]
            persian = [m for t in texts if _FA.search(t) for m in re.findall(r"[^\n]*[پچژگ][^\n]*", t)]
            for k, some in (("", texts), ("fa", persian)):
                if some:
                    points = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32)
                    n = np.bincount(points)
                    sums[k][: len(n)] += n
        rows = [(k, int(p), int(sums[k][p])) for k in sums for p in np.nonzero(sums[k])[0]]
        yield pa.RecordBatch.from_pydict({"context": pa.array([r[0] for r in rows], pa.string()), "point": pa.array([r[1] for r in rows], pa.int32()), "n": pa.array([r[2] for r in rows], pa.int64())})

    counted = df.select(column).mapInArrow(run, "context string, point int, n bigint").groupBy("context", "point").agg(F.sum("n").alias("n"))
    out: dict[str, dict[str, int]] = {"": {}, "fa": {}}
    for r in counted.collect():
        out[r["context"]][chr(r["point"])] = r["n"]
    return out


def variants(counts: dict[str, dict[str, int]]) -> dict[str, tuple[str, str, str]]:
    """variant -> (kind, form in Arabic or other text, form in Persian text).

    kind: ``always``, ``latin`` (only in a word with Latin letters) or
    ``arabic`` (by the language of the words around).
    """
    classes = Classes()
    for a, b in equivalences():
        if a != b:
            classes.join(a, b)

    def frequent(x: str, context: str) -> tuple[int, bool, int, str]:
        n = counts.get(context, {})
        return (min((n.get(c, 0) for c in x), default=0), x in _ORDINARY[context], -len(x), x)

    out: dict[str, tuple[str, str, str]] = {}
    for group in classes.members().values():
        if "" in group or " " in group:
            # what is not seen stands for nothing, and every space for the plain one
            out |= {x: ("always", *[" " if " " in group else ""] * 2) for x in group if x not in ("", " ")}
            continue
        ordinary = [x for x in group if unicodedata.normalize("NFKC", x) == x and unicodedata.normalize("NFC", x) == x] or group
        latin = [x for x in ordinary if all(unicodedata.name(c, "").startswith("LATIN") for c in x)]
        pool = [x for x in latin if x not in LOOKALIKES] or latin or ordinary
        plain = max(pool, key=lambda x: frequent(x, ""))
        persian = max(pool, key=lambda x: frequent(x, "fa"))
        for x in group:
            if x in LOOKALIKES:
                out[x] = ("latin", plain, plain)
            elif len(ordinary) > 1 and not latin and x in ordinary:
                if x != plain or x != persian:
                    out[x] = ("arabic", plain, persian)
            elif x != plain:
                out[x] = ("always", plain, persian)
    return out


_DIGITS = ("0123456789", "٠١٢٣٤٥٦٧٨٩", "۰۱۲۳۴۵۶۷۸۹", "०१२३४५६७८९")
_MIXED = re.compile(r"(?<!\w)(?=\d*(?:[0-9][^\W0-9_]|[٠-٩][^\W٠-٩_]|[۰-۹][^\W۰-۹_]|[०-९][^\W०-९_]))\d{2,}(?!\w)")


def _one_script(m: re.Match) -> str:
    """A number whose digits are of several scripts, in the one of most of them (ties: the first's)."""
    digits = m.group()
    best = max(_DIGITS, key=lambda some: (sum(c in some for c in digits), digits[0] in some))
    return "".join(best[int(c)] for c in digits)


def rewriter(table: dict[str, tuple[str, str, str]], span: int = 12) -> Callable[[str], str]:
    """A function that brings a text to its one form."""
    machine = ahocorasick.Automaton()
    for x, how in table.items():
        machine.add_word(x, (len(x), how))
    machine.make_automaton()
    word = re.compile(r"[^\s.,،;؛:!؟?()\[\]\"«»/]+")
    latin = re.compile("[A-Za-zÀ-ɏＡ-Ｚａ-ｚ]")
    compose = re.compile("[A-Za-zÀ-ɏء-ي][\u0300-\u036f\u0653-\u0655]+")

    def around(text: str, spans: list[tuple[int, int]], at: int) -> bool:
        """Whether the words of the same line near the word ``at`` are Persian."""
        a, b = text.rfind("\n", 0, spans[at][0]) + 1, text.find("\n", spans[at][1])
        near = [text[x:y] for x, y in spans[max(0, at - span) : at + span + 1] if x >= a and (b < 0 or y <= b)]
        return is_persian(near)

    def rewrite(text: str) -> str:
        text = _MIXED.sub(_one_script, text) if _MIXED.search(text) else text
        out: list[str] = []
        at = 0
        spans = None
        for end, (n, (kind, plain, persian)) in machine.iter_long(text):
            start = end - n + 1
            form = plain
            if kind != "always" or plain != persian:
                spans = spans or [m.span() for m in word.finditer(text)]
                lo, hi = 0, len(spans)
                while lo < hi:  # the word that holds ``start``
                    mid = (lo + hi) // 2
                    lo, hi = (mid + 1, hi) if spans[mid][1] <= start else (lo, mid)
                if lo < len(spans):
                    if kind == "latin":
                        if not latin.search(text, *spans[lo]):
                            continue
                    elif _FA.search(text, *spans[lo]) or around(text, spans, lo):
                        form = persian
            if form == text[start : end + 1]:
                continue
            out += [text[at:start], form]
            at = end + 1
        if not out:
            return text
        done = "".join([*out, text[at:]])
        # a rewritten letter may now stand before its mark
        return compose.sub(lambda m: unicodedata.normalize("NFC", m.group()), done)

    return rewrite


def suspicious(column: Column) -> Column:
    """Whether a value can hold a variant; NULL is none."""
    return F.coalesce(column.rlike(SUSPECT), F.lit(False)) | F.coalesce(column.rlike("[پچژگ]") & column.rlike("[يك]"), F.lit(False))


def unify(df: DataFrame, column: str = "value", counts: dict[str, dict[str, int]] | None = None) -> DataFrame:
    """``df`` with the columns ``unified`` and ``changed`` appended for the text in ``column``.

    The statistics come from ``df`` itself unless ``counts`` are given.
    """
    table = variants(counts if counts is not None else codepoint_counts(df, column))
    fields = df.schema.fields
    extra = [c for c in ("unified", "changed") if c in df.columns]
    if extra:
        raise ValueError(f"the result's columns {extra} stand in the input already")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "unified string", "changed boolean"])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(df.schema).append(pa.field("unified", pa.string())).append(pa.field("changed", pa.bool_()))
    at = df.columns.index(column)

    def make() -> Callable[..., tuple]:
        rewrite = rewriter(table)

        def each(*columns: list) -> tuple:
            new = [rewrite(t) for t in columns[at]]
            return (*columns, new, [a != b for a, b in zip(new, columns[at])])

        return each

    rest = df.filter(~suspicious(F.col(column))).withColumns({"unified": F.col(column), "changed": F.lit(False)})
    return map_rows(df.filter(suspicious(F.col(column))), make, schema, arrow).unionByName(rest)


def text_fields(sample: DataFrame, authors: DataFrame) -> DataFrame:
    """(field, rec_key, value): page1 and title of every article row, name of every author."""
    key = F.col("row_no").cast("string")
    pages = sample.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), key.alias("rec_key"), F.col(f).alias("value")) for f in ("page1", "title")))).alias("x")).select("x.*")
    return pages.unionByName(authors.select(F.lit("name").alias("field"), F.col("id").cast("string").alias("rec_key"), F.col("name").alias("value")))
