"""Abstracts, keywords, authors and metadata regions of article pages, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warraq.functions.text import ARABIC, collapse, fold_author_zone, fold_search, join_pages

_NOISE = r"[اوي\s_\-\.\+\*]*"


def skeleton(word: str) -> str:
    """A pattern for a word whose weak letters are lost, doubled or replaced by noise."""
    out = []
    for c in word:
        if c in "اأإآوي ":
            out.append(_NOISE)
        elif c == "ة":
            out.append(r"[هتة]" + _NOISE)
        else:
            out.append((rf"\{c}" if not c.isalnum() else c) + "+?" + _NOISE)
    return "".join(out)


def _any(words: tuple[str, ...], before: str = "") -> str:
    return "(?:" + "|".join(before + skeleton(w) for w in words) + ")"


#: The words that open and close abstracts and keyword lists.
ABSTRACT_ROOTS = ("ملخص", "مستخلص", "خلاصة", "موجز")
KEYWORD_SECOND = ("مفتاحية", "دالة", "رئيسية")
STOP_ROOTS = ("مقدمة", "تمهيد", "Introduction", "Correspondence", "المراجع")
PURPOSE_VERBS = ("هدفت", "استهدفت", "تهدف", "يهدف", "هدف", "سعت", "تسعى", "يسعى", "تناولت", "تتناول", "ركزت", "تركز", "تكمن", "aims", "aimed", "objective", "purpose")



@dataclass(frozen=True)
class Patterns:
    """Patterns over folded text.

    ``strict`` keeps the markers as they are written, so those with capitals
    or with letters that the fold changes never match; without it they are
    folded like the text, and match.
    """

    header: str
    keyword_start: str
    stop: str
    verbs: str

    @staticmethod
    def of(strict: bool = True) -> Patterns:
        fold = (lambda w: w) if strict else (lambda w: w.lower().translate(str.maketrans("أإآةىئ", "اااهيي")))
        some = lambda words, before="": _any(tuple(fold(w) for w in words), before)
        start = rf"(?:{skeleton('كلمات')}.{{0,15}}{some(KEYWORD_SECOND)}|{fold('Keywords')}|{fold('Key')}\s*words)"
        stop = "(?:" + "|".join([*(skeleton(fold(w)) for w in STOP_ROOTS), fold("Doi"), r"1\.", r"\*", fold("First"), fold("I") + r"\."]) + ")"
        return Patterns(some(ABSTRACT_ROOTS), start, stop, some(PURPOSE_VERBS, r"\b"))


STRICT = Patterns.of()


def full_text(page1: Column, page2: Column) -> Column:
    """Both pages as one text; a first line of page 2 that repeats page 1's is left out. NULL counts as empty."""
    p1, p2 = (F.regexp_replace(F.coalesce(p, F.lit("")), r"(?U)\A\s+|\s+\z", "") for p in (page1, page2))
    head = F.substring(F.trim(F.regexp_extract(F.substring(p1, 1, 40), r"(?d)^([^\n]*)", 1)), 1, 20)
    repeated = (F.length(p1) > 20) & (F.length(p2) > 20) & (head != "") & F.startswith(F.lower(p2), F.lower(head)) & F.contains(p2, F.lit("\n"))
    rest = F.regexp_replace(F.regexp_replace(p2, r"\A[^\n]*\n", ""), r"(?U)\A\s+", "")
    return F.concat(p1, F.lit(" \n "), F.when(repeated, rest).otherwise(p2))


def extract_abstracts(df: DataFrame, text: str, out: str = "abstract", patterns: Patterns = STRICT) -> DataFrame:
    """``df`` with the longest abstract behind a header; without one, what a purpose verb near the start opens; NULL if neither.

    The folded text, its headers and its windows are columns of their own, so
    each is computed once a row.
    """
    size = lambda parts: F.aggregate(parts, F.lit(0), lambda a, p: a + F.length(p))
    tidy = lambda c: F.regexp_replace(F.regexp_replace(c, r"(?U)\A\s+|\s+\z", ""), r"(?U)\A[:\-.]+\s*", "")
    verb = f"(?Uds)\\A(.*?){patterns.verbs}"
    rows = df.withColumn("_f", fold_search(F.col(text)))
    # one run of the pattern puts marks around the headers: what stands between marks is a piece and a header in turn
    rows = rows.withColumn("_f", F.translate("_f", "\ue000", " ")).withColumn("_marked", F.split(F.regexp_replace("_f", f"(?d)({patterns.header})", "\ue000$1\ue000"), "\ue000", -1))
    each = lambda start: F.filter("_marked", lambda x, i: i % 2 == start)
    rows = rows.withColumns({"_pieces": each(0), "_heads": each(1)}).drop("_marked")
    rows = rows.withColumn("_ends", F.transform("_heads", lambda h, i: size(F.slice("_pieces", F.lit(1), i + 1)) + size(F.slice("_heads", F.lit(1), i + 1)) + 1))
    rows = rows.withColumn("_windows", F.transform("_ends", lambda e: F.substring(F.col("_f"), e, F.lit(3000))))
    upto = lambda w: F.length(F.get(F.split(w, f"(?ds){patterns.keyword_start}|{patterns.stop}", 2), F.lit(0)))
    length = lambda w, end: F.when(end < F.length(w), end).otherwise(F.least(F.length(w), F.lit(1000)))
    rows = rows.withColumn("_stops", F.transform("_windows", upto))
    rows = rows.withColumn("_found", F.transform(F.arrays_zip("_ends", "_windows", "_stops"), lambda x: tidy(F.substring(F.col(text), x["_ends"], length(x["_windows"], x["_stops"])))))
    good = F.filter("_found", lambda c: (F.length(c) > 50) & c.rlike(ARABIC))
    rows = rows.withColumn("_best", F.aggregate(good, F.lit(""), lambda a, c: F.when(F.length(c) > F.length(a), c).otherwise(a)))
    rows = rows.withColumn("_before", F.when(F.col("_best") == "", F.regexp_extract("_f", verb, 1)))
    # an empty text before the verb: it stands first, or nowhere
    has_verb = (F.col("_before") != "") | F.col("_f").rlike(f"(?Ud)\\A{patterns.verbs}")
    rows = rows.withColumn("_window", F.when((F.col("_best") == "") & has_verb & (F.length("_before") < 3000), F.substring(F.col("_f"), F.length("_before") + 1, F.lit(3000))))
    rows = rows.withColumn("_stop", upto(F.col("_window")))
    opened = F.when(F.col("_window").isNotNull(), F.substring(F.col(text), F.length("_before") + 1, length(F.col("_window"), F.col("_stop"))))
    rows = rows.withColumn("_second", F.regexp_replace(opened, r"(?U)\A\s+|\s+\z", ""))
    result = F.when(F.col("_best") != "", collapse(F.col("_best"))).when(F.length("_second") > 50, collapse(F.col("_second")))
    return rows.withColumn(out, result).drop("_f", "_pieces", "_heads", "_ends", "_windows", "_stops", "_stop", "_found", "_best", "_before", "_window", "_second")


def keyword_line(patterns: Patterns = STRICT) -> str:
    """The head of a keyword list with the sign before it, up to a line end close behind, and the line."""
    return rf"(?s:.?){patterns.keyword_start}(?s:.{{0,4}}?\n)?[^\n]*"


def extract_keywords(df: DataFrame, text: str, out: str = "keywords", patterns: Patterns = STRICT) -> DataFrame:
    """``df`` with the keywords of the last keyword line that has any, as an array; NULL if there are none.

    The folded text, its keyword lines and what stands between them are
    columns of their own, so each pattern runs once a text.
    """
    line = f"(?d){keyword_line(patterns)}"
    head = rf"(?d)\A(?s:.?){patterns.keyword_start}(?s:.{{0,4}}?\n)?"
    stop = f"(?d){patterns.stop}|{patterns.header}"
    rows = df.withColumn("_f", fold_search(F.col(text)))
    rows = rows.withColumn("_found", F.when(F.col("_f").rlike(f"(?d){patterns.keyword_start}"), F.regexp_extract_all("_f", F.lit(line), F.lit(0))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("_pieces", F.when(F.size("_found") > 0, F.split("_f", line, -1)).otherwise(F.array().cast("array<string>")))
    size = lambda parts: F.aggregate(parts, F.lit(0), lambda n, p: n + F.length(p))
    rows = rows.withColumn("_at", F.transform("_found", lambda m, i: F.struct(m.alias("m"), F.length(F.regexp_extract(m, head, 0)).alias("head"), (size(F.slice("_pieces", F.lit(1), i + 1)) + size(F.slice("_found", F.lit(1), i)) + 1).alias("start"))))

    def raw(x: Column) -> Column:
        rest = F.substring(x["m"], x["head"] + 1, F.length(x["m"]))
        upto = F.when(F.substring(x["m"], 1, 1) == "(", F.length(F.get(F.split(rest, stop + r"|\)", 2), F.lit(0)))).otherwise(F.length(F.get(F.split(rest, stop, 2), F.lit(0))))
        return F.regexp_replace(F.regexp_replace(F.substring(F.col(text), x["start"] + x["head"], upto), r"(?U)\A\s+|\s+\z", ""), r"(?U)\A[:\-.]+\s*", "")

    rows = rows.withColumn("_raw", F.filter(F.transform("_at", raw), lambda c: F.length(c) > 3)).withColumn("_best", F.try_element_at("_raw", F.lit(-1)))
    parts = F.transform(F.split("_best", r"[،,;؛|•]"), lambda t: F.regexp_replace(F.trim(t), r"^[.\-:()\[\]]+|[.\-:()\[\]]+$", ""))
    rows = rows.withColumn("_kept", F.filter(parts, lambda t: (F.length(t) > 2) & (F.length(t) < 100) & ~t.rlike(r"(?U)^\d+$")))
    return rows.withColumn(out, F.when(F.size("_kept") > 0, F.col("_kept"))).drop("_f", "_found", "_pieces", "_at", "_raw", "_best", "_kept")


#: Titles before a name, and what no name holds.
TITLES = "Co-Prof|Prof|Dr|Mr|Mrs|Ms|Eng|Assoc|Lecturer|Researcher|Student|Candidate|د\\.|أ\\.د|ا\\.د|بروف|م\\.|الذكتور|الاستاذ|الدكتور|الباحث|الطالب|المعلم|د/|أ/"
NOT_NAMES = (
    "^اعداد|^إعداد|^اعسداد|إشراف|تقديم|Prepared by|This Article is brought|open access|rights reserved|Creative Commons|Edu Search|Dar Al Mandumah|دار المنظومة|معرفة|دوريات|المجلة|brought to you by|Digital Commons|Copyright"
    "|Kingdom|Republic|Saudi|Jordan|Oman|Egypt|Algeria|Yemen|Palestine|Kuwait|المملكة|الجمهورية|السعودية|الاردن|عمان|مصر|الجزائر|السودان|اليمن|فلسطين|الكويت|العراق"
    "|University|College|Department|Faculty|Ministry|School|Institute|Deanship|جامعة|كلية|قسم|وزارة|معهد|عمادة|رئاسة|الجامعة|للدراسات|Master|PhD|Thesis|Dissertation|ماجستير|دكتوراه|رسالة|اطروحة|طالب|مدرس|معلم|مدير"
    "|Journal|Vol|Issue|No\\.|pp\\.|Page|ISSN|مجلد|عدد|صفحة|طبعة|The researcher|The study|This paper|found that|aimed to|concluded|الباحث|الدراسة|هدفت|توصلت|نتائج|تناول|ملخص|مقدمة|مشكلة"
    "|The Degree|The Level|The Impact|The Effect|Developing|درجة|أثر|فاعلية|مستوى|واقع|تطوير|بناء"
)


def validate_name(c: Column) -> Column:
    """struct(valid, name): whether a text is a person's name, and the name without titles; NULL is none."""
    edges = r"(?U)^[.\-/_:,\s*]+|[.\-/_:,\s*]+$"
    name = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), edges, ""), rf"(?Ui)^\s*(?:{TITLES})\.?\s*", "")
    single = F.size(F.filter(F.split(name, r"(?U)\s+"), lambda t: F.length(t) == 1))
    valid = (
        (F.length(name) >= 3)
        & ~name.rlike(r"(?U)\d")
        & ~F.lower(name).rlike(r"@|www\.|\.com|\.edu|\.org|\.net")
        & ~name.rlike(f"(?i)(?:{NOT_NAMES})")
        & ~name.rlike("^[a-z]")
        & ~(name.rlike("[a-zA-Z]") & name.rlike(ARABIC))
        & (F.size(F.filter(F.split(name, r"(?U)\s+"), lambda t: t != "")) <= 5)
        & (single <= 2)
    )
    return F.struct(valid.alias("valid"), F.when(valid, name).otherwise("").alias("name"))


#: What ends the zone in which a page names its authors.
ZONE_ENDS = "تاريخ تسلم|تاريخ استلام|تاريخ قبول|Received|Accepted|ملخص|مستخلص|Abstract|Summary|المقدمة|مقدمة|Introduction|Correspondence|This Article is brought|هدفت الدراسة|هدف البحث|rights reserved|Open Access|Creative Commons"


def extract_authors(existing: Column, page1: Column) -> Column:
    """Authors already there, else those named on the page before its abstract; an empty array if none."""
    text = F.substring(F.coalesce(page1, F.lit("")), 1, 2500)
    folded = fold_author_zone(text)
    parts = F.split(folded, f"(?i)(?:{ZONE_ENDS})", 2)
    end = F.length(parts[0])
    start = F.greatest(end - 500, F.lit(0))
    zone = F.when(F.size(parts) > 1, F.substring(text, start + 1, end - start)).otherwise(F.substring(text, 1, 600))
    starred = F.regexp_extract(zone, r"(?md)\*\s*([^*\n]+)$", 1)
    lines = F.reverse(F.filter(F.transform(F.split(zone, "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != ""))
    scanned = F.try_element_at(F.filter(lines, lambda x: validate_name(x)["valid"]), F.lit(1))
    raw = F.when(F.trim(starred) != "", F.trim(starred)).otherwise(F.coalesce(scanned, F.lit("")))
    names = F.transform(F.split(raw, r"\s+و\s+|\s+and\s+|;|،|,|&"), lambda t: F.array_join(F.slice(F.filter(F.split(F.trim(F.regexp_replace(F.trim(t), r"^\*+|\*+$", "")), r"(?U)\s+"), lambda w: w != ""), 1, 4), " "))
    checked = F.transform(F.filter(F.transform(names, validate_name), lambda v: v["valid"]), lambda v: v["name"])
    there = (F.length(F.trim(F.coalesce(existing, F.lit("")))) > 1) & (F.lower(existing) != "nan")
    return F.when(there, F.array(existing)).otherwise(checked)


KEYWORD_HEADS = ("الكلمات المفتاحية", "كلمات مفتاحية", "الكلمات الدالة", "كلمات دالة", "keywords", "key words", "index terms")


@dataclass(frozen=True)
class Profile:
    """How the pages of one source are laid out.

    ``blocks`` and ``lines`` are patterns of what is taken out. ``marks`` are
    words of an author line wherever it stands, ``cues`` such words among the
    lines up to ``limit``; ``window`` is (lines before the first of them,
    lines in all), without it each cue's neighbours count. ``title_cut`` names
    the anchors that end the title besides e-mails and the abstract.
    """

    blocks: tuple[str, ...] = ()
    lines: tuple[str, ...] = ()
    abstract: tuple[str, ...] = ("الملخص", "ملخص", "الخلاصة", "مستخلص", "abstract")
    abstract_line: str = r"(?!)"
    keyword_line: str = r"(?!)"
    intro: tuple[str, ...] = ("المقدمة", "مقدمة", "introduction")
    abstract_cap: int | None = None
    keyword_lines: int = 2
    radius: int = 2
    marks: tuple[str, ...] = ()
    cues: tuple[str, ...] = ("جامعة", "كلية", "قسم", "أستاذ", "د.", "دكتور", "المؤلف", "المؤلفون", "باحث", "university", "college", "department", "author", "authors", "prof", "dr.")
    limit: int = 40
    window: tuple[int, int] | None = None
    without_links: bool = False
    title_cut: tuple[str, ...] = ()
    title_default: int = 25
    title_max: int = 30
    second_page: bool = True


_NUMBER_LINE = r"^\s*[0-9\u0660-\u0669\u06F0-\u06F9]+\s*\.?\s*$"
_LICENCE = (r"This article is an open\s*access article distributed.*?(?:\n\s*\n|$)", r"under the terms and\s*conditions of the Creative Commons.*?(?:\n\s*\n|$)")
RECEIVED = r"(?i)^\s*Received\s*:\s*\d{2}/\d{2}/\d{4}\s*"

#: Profiles by source code, in upper case. Their patterns and words are fixed values.
PROFILES = {
    "AJP": Profile(
        blocks=(r"Follow this and additional works at:.*?Recommended Citation", r"Recommended Citation.*?Available at:\s*https?://\S+", r"This Article is brought to you.*?(?:\n\s*\n|$)", r"It has been accepted for.*?(?:\n\s*\n|$)"),
        lines=(
            r"^Association of Arab Universities Journal for Education and\s*Psychology\s*$", r"^Volume\s+\d+\s*\|\s*Issue\s+\d+\s*Article\s+\d+\s*$", r"^مجلة اتحاد الجامعات العربية للتربية وعلم النفس.*$",
            r"^.*المجلد.*العدد.*$", r"^\s*[0-9\u0660-\u0669\u06F0-\u06F9]+\s*$", r"^\s*Available at:\s*https?://\S+\s*$", r"^[^\n]{20,200}(?:\.\.\.|؛).*$",
        ),
        abstract=("الملخص", "ملخص", "الخلاصة", "مستخلص", "abstract", "summary"), abstract_line=r"(?i)\babstract\b", keyword_line=r"(?i)\bkeywords?\b", intro=(),
    ),
    "AJSP": Profile(
        blocks=(r"Arab Journal for Scientific Publishing\s*\(AJSP\)\s*ISSN:\s*2663-5798.*?(?:\n\s*\n|$)",),
        lines=(
            r"^المجلة\s+الع(?:ب|ر)بية\s+للنشر.*$", r"^ISSN:\s*2663-5798\s*\|\|\s*Arab Journal for Scientific Publishing.*$", r"^Arab Journal for Scientific Publishing\s*\(AJSP\)\s*ISSN:\s*2663-5798.*$", r"^www\.\S+\s*$",
            r"^https?://doi\.org/\S+\s*$", r"^الإصدار.*$", r"^العدد.*$", r"^تاريخ الإصدار.*$", _NUMBER_LINE,
        ),
        abstract_cap=60, marks=("إعداد الباحثة", "إعداد الباحث", "إعداد", "الباحثة", "الباحث", "الكاتبة", "الكاتب", "researchers", "researcher", "author", "authors"),
        cues=("جامعة", "كلية", "قسم", "أستاذ", "دكتور", "المؤلف", "المؤلفون", "باحث", "university", "college", "department", "faculty", "prof"), limit=50, window=(0, 10), title_cut=("marks", "doi"), title_max=35,
    ),
    "AJSRP": Profile(
        blocks=(*_LICENCE, r"\d{4}\s*©\s*AISRP.*?all\s*rights\s*reserved\.(?:\n\s*\n|$)"),
        lines=(
            r"^Arab Journal of Sciences\s*&\s*Research Publishing\s*\(AJSRP\).*$", r"^https?://journals\.\S*\s*$", r"^ISSN:\s*2518-5780.*$", r"^.*Vol\s*\d+,\s*Issue\s*\d+\s*\(\d{4}\)\s*.*P:\s*\d+.*$",
            r"^\s*Received:\s*$", r"^\s*Revised:\s*$", r"^\s*Accepted:\s*$", r"^\s*Published:\s*$", r"^\s*\*?\s*Corresponding author:\s*$", r"^\s*Citation:\s*.*$", _NUMBER_LINE, r"^\s*°\s*Open Access\s*$", r"^\s*\*\s*NCO\s*ND\s*$",
        ),
        abstract=("المستخلص", "الملخص", "ملخص", "الخلاصة", "abstract"), keyword_line=r"(?i)^\s*keywords?\s*[:：]?\s*$", abstract_cap=80, keyword_lines=3, radius=3,
        cues=("أ.", "د.", "دكتور", "المؤلف", "المؤلفون", "ms.", "mr.", "dr.", "prof.", "author", "authors", "eng.", "جامعة", "كلية", "قسم", "وزارة", "المملكة", "السودان", "اليمن", "university", "faculty", "department", "ministry", "ksa", "yemen", "sudan"),
        limit=60, window=(2, 18), title_cut=("cues",), title_default=30, title_max=40, second_page=False,
    ),
    "AM": Profile(
        blocks=_LICENCE,
        lines=(
            r"^Manarah,\s*.*?Series,\s*Vol\.\s*\d+,\s*No\.\s*\d+,\s*\d{4}\s*\(\s*[0-9\u0660-\u0669\u06F0-\u06F9]+\s*\)\s*$", r"^\s*DO[IL]\s*:?\s*https?://\S+\s*$", r"^\s*Received\s*:\s*$", r"^\s*Revised\s*:\s*$",
            r"^\s*Accepted\s*:\s*$", r"^\s*Published\s*:\s*$", r"^\s*\*+\s*Corresponding\s*Author\s*:?\s*$", _NUMBER_LINE, r"^\s*(https?://\S+|www\.\S+)\s*$",
        ),
        abstract=("ملخص", "المستخلص", "الملخص", "الخلاصة", "abstract"), abstract_line=RECEIVED + r"Abstract\b", abstract_cap=80, keyword_lines=3, radius=3,
        cues=("جامعة", "كلية", "قسم", "أستاذ", "د.", "دكتور", "باحث", "باحثة", "university", "college", "school", "department", "researcher", "prof", "dr.", "eng."),
        limit=70, window=(3, 20), without_links=True, title_cut=("cues",), title_default=30, title_max=45,
    ),
    "ARPD": Profile(
        blocks=(r"المجلة\s+معرفة\s+على\s+دوريات\s+بنك\s+المعرفة\s+المصرى.*?(?:\n\s*\n|$)", r"دار\s+المنظومة.*?(?:\n\s*\n|$)"),
        lines=(
            r"^المجلة\s+المصرية\s+للتربية\s+العلمية.*$", r"^\s*رقم\s+الإيداع\s*:.*$", r"^\s*E\.\s*ISSN\s*:.*$", r"^\s*ISSN\s*:.*$", r"^\s*Edu\s*Search\s*$", r"^\s*دار\s+المنظومة\s*$",
            r"^\s*المجلة\s+معرفة\s+على\s+دوريات\s+بنك\s+المعرفة\s+المصرىء.*$", _NUMBER_LINE, r"^\s*(https?://\S+|www\.\S+)\s*$", r"^جامعة.*$",
        ),
        abstract=("ملخص البحث", "المستخلص", "الملخص", "ملخص", "الخلاصة", "مستخلص", "abstract"), intro=("مقدمة", "المقدمة", "تمهيد", "introduction"), abstract_cap=90, keyword_lines=3, radius=3,
        cues=("إعداد", "اعداد", "بقلم", "الباحث", "الباحثة", "د/", "د.", "أ.د", "أ.م.د", "أستاذ", "أستاذة", "جامعة", "كلية", "قسم", "by", "author", "researcher", "prof", "dr.", "university", "college", "department"),
        limit=80, window=(4, 25), without_links=True, title_cut=("cues",), title_default=35, title_max=50,
    ),
}

EMAIL = r"(?U)\b[\w.\-]+@[\w.\-]+\.\w+\b"
URL = r"(?i)https?://\S+|www\.\S+"


def strip_boilerplate(text: Column, p: Profile) -> Column:
    """A source's blocks and lines taken out."""
    for b in p.blocks:
        text = F.regexp_replace(text, f"(?Uisd){b}", "")
    for x in p.lines:
        text = F.regexp_replace(text, f"(?Uimd){x}", "")
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"(?U)\A\s+|\s+\z", "")


def _places(test: Callable[[Column], Column]) -> Column:
    """Places of the lines that pass a test."""
    return F.filter(F.transform("_lines", lambda x, i: F.when(test(x), i)), lambda i: i.isNotNull())


def pinpoint(df: DataFrame, source: str = "source", profiles: dict[str, Profile] = PROFILES, default: Profile | None = None, page1: str = "page1", page2: str = "page2", out: str = "regions", max_chars: int = 9000) -> DataFrame:
    """``df`` with the labelled title, author, abstract and keyword regions of its pages.

    The profile is that of a row's source, its case ignored; a source without
    one takes the default, else NULL. One pass over the rows: what depends on
    the profile is a choice inside each column, and lines and anchors are
    columns of their own, so each is computed once a row.
    """
    code = F.upper(F.trim(F.col(source)))

    def by(f: Callable[[Profile], Column]) -> Column:
        chosen = F.when(F.lit(False), f(next(iter(profiles.values()))))
        for name, p in profiles.items():
            chosen = chosen.when(code == name, f(p))
        return chosen.otherwise(f(default)) if default else chosen

    tidy = lambda x: F.regexp_replace(x, r"(?U)\A\s+|\s+\z", "")
    first = lambda test: F.array_min(_places(test))
    starts = lambda x, heads: F.lower(x).rlike("^(?:" + "|".join(re.escape(h) for h in heads) + ")") if heads else F.lit(False)
    holds = lambda x, words: F.lower(x).rlike("|".join(re.escape(c) for c in words)) if words else F.lit(False)

    def region(a: Column, b: Column) -> Column:
        # greatest and least skip NULLs: no anchor, no region
        return F.when(a.isNotNull(), F.array_join(F.slice("_lines", a + 1, F.greatest(F.least(b, F.col("_n")) - a, F.lit(0))), "\n"))

    def around(idx: Column, by_lines: int) -> Column:
        wanted = F.array_sort(F.array_distinct(F.flatten(F.transform(idx, lambda i: F.sequence(i - by_lines, i + by_lines)))))
        return F.array_join(F.transform(F.filter(wanted, lambda i: (i >= 0) & (i < F.col("_n"))), lambda i: F.get("_lines", i)), "\n")

    def hinted(p: Profile) -> Column:
        """The author region without an e-mail."""
        if p.window is None:
            return around(F.col("_cues"), 1)
        anchor = F.array_min("_marks" if p.marks else "_cues")
        start = F.greatest(anchor - p.window[0], F.lit(0))  # 0 without an anchor, and then not used
        some = F.slice("_lines", start + 1, F.lit(p.window[1]))
        some = F.array_join(F.filter(some, lambda x: ~x.rlike(URL)) if p.without_links else some, "\n")
        return F.when(anchor.isNotNull(), some).otherwise(around(F.col("_cues"), 1) if p.marks else F.lit(""))

    def title_end(p: Profile) -> Column:
        cuts = [F.array_min("_mails"), F.col("_abs"), *({"cues": F.array_min("_cues"), "marks": F.array_min("_marks"), "doi": F.col("_doi")}[c] for c in p.title_cut)]
        return F.coalesce(F.least(*cuts), F.least(F.col("_n"), F.lit(p.title_default)))

    rows = df.withColumn("_text", by(lambda p: strip_boilerplate(join_pages(F.col(page1), F.col(page2) if p.second_page else F.lit(None).cast("string")), p)))
    rows = rows.withColumn("_lines", F.filter(F.transform(F.split("_text", "\n"), lambda x: tidy(x)), lambda x: x != "")).withColumn("_n", F.size("_lines"))
    rows = rows.withColumns(
        {
            "_abs": by(lambda p: first(lambda x: starts(x, p.abstract) | x.rlike(p.abstract_line))),
            "_key": by(lambda p: first(lambda x: starts(x, KEYWORD_HEADS) | x.rlike(p.keyword_line))),
            "_intro": by(lambda p: first(lambda x: starts(x, p.intro))),
            "_mails": _places(lambda x: x.rlike(EMAIL)),
            "_marks": by(lambda p: _places(lambda x: holds(x, p.marks))),
            "_cues": by(lambda p: F.filter(_places(lambda x: holds(x, p.cues)), lambda i: i <= p.limit)),
            "_doi": first(lambda x: F.lower(x).contains("doi.org")),
        }
    )
    # the keywords end an abstract wherever the introduction stands
    capped = by(lambda p: F.least(F.col("_n"), F.col("_abs") + p.abstract_cap) if p.abstract_cap else F.col("_n"))
    end = F.when(F.col("_key") > F.col("_abs"), F.col("_key")).when(F.col("_intro") > F.col("_abs"), F.col("_intro")).otherwise(capped)
    abstract = F.coalesce(region(F.col("_abs"), end), F.lit(""))
    dated = by(lambda p: F.get("_lines", F.col("_abs")).rlike(p.abstract_line) if p.abstract_line.startswith(RECEIVED) else F.lit(False))
    abstract = F.when(dated, F.regexp_replace(abstract, RECEIVED, "")).otherwise(abstract)
    authors = by(lambda p: F.when(F.size("_mails") > 0, around(F.col("_mails"), p.radius)).otherwise(hinted(p)))
    titles = by(lambda p: F.array_join(F.slice(F.filter(F.slice("_lines", F.lit(1), title_end(p)), lambda x: ~x.rlike(URL)), 1, p.title_max), "\n"))
    keywords = by(lambda p: region(F.col("_key"), F.col("_key") + p.keyword_lines))
    labelled = F.concat(F.lit("TITLE_REGION:\n"), titles, F.lit("\n\nAUTHORS_REGION:\n"), authors, F.lit("\n\nABSTRACT_REGION:\n"), abstract, F.lit("\n\nKEYWORDS_REGION:\n"), F.coalesce(keywords, F.lit("")))
    result = F.when(F.col("_lines").isNotNull(), F.substring(tidy(labelled), 1, max_chars))
    return rows.withColumn(out, result).drop("_text", "_lines", "_n", "_abs", "_key", "_intro", "_mails", "_marks", "_cues", "_doi")
