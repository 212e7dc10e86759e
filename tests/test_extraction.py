import re

import pytest
from pyspark.sql import functions as F

from warraq.operators import extraction as x


def fold(t):
    return t.lower().translate(str.maketrans("أإآةىئ", "اااهيي"))


def plain_abstract(t, p=x.STRICT):
    """The extraction again, as a plain loop."""
    s = fold(t)

    def until(a):
        w = s[a : a + 3000]
        m = re.search(p.keyword_start + "|" + p.stop, w, re.S)
        return a + (m.start() if m else min(len(w), 1000))

    found = []
    for m in re.finditer(p.header, s):
        c = re.sub(r"^[:\-.]+\s*", "", t[m.end() : until(m.end())].strip())
        if len(c) > 50 and re.search("[؀-ۿ]", c):
            found.append(c)
    if found:
        return re.sub(r"\s+", " ", max(found, key=len)).strip()
    m = re.search(p.verbs, s)
    if m and m.start() < 3000:
        c = t[m.start() : until(m.start())].strip()
        if len(c) > 50:
            return re.sub(r"\s+", " ", c).strip()
    return None


BODY = "بحث تجريبي في ظروف العمل لدي المعلمين ونتج عنه قدر كبير من البيانات " * 2
TEXTS = [
    "", "عنوان", f"عنوان\nملخص: {BODY}\nالكلمات المفتاحية: أ، ب", f"المستخلص\n{BODY}\n1. شيء", f"عنوان\nخلاصه: قصير\nملخص - {BODY}",
    f"عنوان فقط هدفت الدراسة إلى {BODY}", f"Aims to {BODY}", "ملخص: short latin only text that is longer than fifty characters for sure", f"ملخص {BODY * 20}",
]


def test_abstracts_are_those_of_the_plain_loop(values):
    got = x.extract_abstracts(values(*TEXTS), "v").orderBy("k").collect()
    assert [r.abstract for r in got] == [plain_abstract(t) for t in TEXTS]


def test_markers_that_the_fold_changes(values):
    loose = x.Patterns.of(strict=False)
    texts = [f"ملخص {BODY}Introduction {BODY}", f"تسعى الدراسة إلى {BODY}", f"Keywords: one, two\n{BODY}"]
    got = x.extract_abstracts(values(*texts), "v", patterns=loose).orderBy("k").collect()
    assert [r.abstract for r in got] == [plain_abstract(t, loose) for t in texts]
    assert got[0].abstract == BODY.strip() and got[1].abstract.startswith("تسعى")
    strict, free = (x.extract_keywords(values(texts[2]), "v", "w", p).first().w for p in (x.STRICT, loose))
    assert strict is None and free == ["one", "two"]


@pytest.mark.parametrize(
    "page,want",
    [
        ("كلمات مفتاحية: ري، تربة؛ قمح.\nبعد", ["تربة", "قمح"]),
        ("كلمات مفتاحية:\nتربة, قمح, شعير\nبعد", ["تربة", "قمح", "شعير"]),
        ("(كلمات مفتاحية: تربة، قمح) بعد", ["تربة", "قمح"]),
        ("كلمات مفتاحية: 123", None),
        ("لا شيء هنا", None),
        ("كلمات مفتاحية: أول، ثان\nنص\nكلمات مفتاحية: تربة، قمح", ["تربة", "قمح"]),
    ],
)
def test_keywords(values, page, want):
    rows = values(page).withColumn("full", x.full_text(F.col("v"), F.lit(None).cast("string")))
    # two letters are no keyword
    assert x.extract_keywords(rows, "full").first().keywords == want


def test_names(values):
    cases = {"د. أحمد علي": (True, "أحمد علي"), "جامعة بغداد": (False, ""), "Ann Lee": (True, "Ann Lee"), "lower case": (False, ""), "Ann علي": (False, ""), "a@b.com": (False, ""), "A B C Lee": (False, ""), "ab": (False, ""), "واحد اثنان ثلاثة اربعة خمسة ستة": (False, "")}
    got = values(*cases, None).select("k", x.validate_name(F.col("v")).alias("n")).orderBy("k").collect()
    assert [tuple(r.n) for r in got] == [*cases.values(), (False, "")]


def test_authors(values):
    page = "عنوان البحث\n* أحمد سامي و منى كامل\nملخص: نص"
    rows = values(page, "عنوان\nسامي كامل\nAbstract", "").select("k", x.extract_authors(F.lit(None).cast("string"), F.col("v")).alias("a")).orderBy("k").collect()
    assert [list(r.a) for r in rows] == [["أحمد سامي", "منى كامل"], ["سامي كامل"], []]
    assert values(page).select(x.extract_authors(F.lit("قديم"), F.col("v")).alias("a")).first().a == ["قديم"]


def test_regions(spark):
    page = "عنوان البحث\nwww.site.org\nأحمد سامي a@b.org\nالملخص\nنص أول\nنص ثان\nالكلمات المفتاحية: أ\nب\nالمقدمة\nبقية"
    df = spark.createDataFrame([(1, "am", page, None), (2, "ajsrp", page, "صفحة"), (3, "none", page, None), (4, None, None, None)], "k int, source string, page1 string, page2 string")
    got = {r.k: r.regions for r in x.pinpoint(df).collect()}
    assert got[3] is None and got[4] is None
    assert got[1].startswith("TITLE_REGION:\nعنوان البحث\n\nAUTHORS_REGION:")
    assert "ABSTRACT_REGION:\nالملخص\nنص أول\nنص ثان\n\nKEYWORDS_REGION:\nالكلمات المفتاحية: أ\nب\nالمقدمة" in got[1]
    assert "صفحة" not in got[2]


def plain_regions(lines, p):
    """The regions again, as plain loops over lines without boilerplate."""
    low = [x.lower() for x in lines]
    n = len(lines)
    first = lambda test: next((i for i in range(n) if test(i)), None)
    every = lambda test: [i for i in range(n) if test(i)]
    heads = first(lambda i: low[i].startswith(p.abstract) or re.search(p.abstract_line, lines[i]))
    keys = first(lambda i: low[i].startswith(x.KEYWORD_HEADS) or re.search(p.keyword_line, lines[i]))
    intro = first(lambda i: bool(p.intro) and low[i].startswith(p.intro))
    mails = every(lambda i: re.search(r"\b[\w.\-]+@[\w.\-]+\.\w+\b", lines[i]))
    marks = every(lambda i: any(m in low[i] for m in p.marks))
    cues = every(lambda i: i <= p.limit and any(c in low[i] for c in p.cues))
    links = lambda some: [t for t in some if not re.search(x.URL, t)]
    near = lambda idx, r: "\n".join(lines[j] for j in sorted({j for i in idx for j in range(max(0, i - r), min(n, i + r + 1))}))
    abstract = ""
    if heads is not None:
        end = keys if keys is not None and keys > heads else intro if intro is not None and intro > heads else min(n, heads + p.abstract_cap) if p.abstract_cap else n
        abstract = "\n".join(lines[heads:end])
        if p.abstract_line.startswith("(?i)^\\s*Received"):
            abstract = re.sub(r"(?i)^\s*Received\s*:\s*\d{2}/\d{2}/\d{4}\s*(?=Abstract)", "", abstract)
    anchor = (marks or [None])[0] if p.marks else (cues or [None])[0]
    if mails:
        authors = near(mails, p.radius)
    elif p.window and anchor is not None:
        start = max(0, anchor - p.window[0])
        some = lines[start : start + p.window[1]]
        authors = "\n".join(links(some) if p.without_links else some)
    else:
        authors = near(cues, 1) if not p.window or p.marks else ""
    doi = every(lambda i: "doi.org" in low[i])
    cuts = [c[0] for c in (mails, [heads] if heads is not None else [], *({"cues": cues, "marks": marks, "doi": doi}[k] for k in p.title_cut)) if c]
    title = "\n".join(links(lines[: min(cuts) if cuts else min(n, p.title_default)])[: p.title_max])
    keywords = "" if keys is None else "\n".join(lines[keys : keys + p.keyword_lines])
    return f"TITLE_REGION:\n{title}\n\nAUTHORS_REGION:\n{authors}\n\nABSTRACT_REGION:\n{abstract}\n\nKEYWORDS_REGION:\n{keywords}".strip()[:9000]


PIECES = [
    "عنوان البحث في التربية", "A title of the study", "جامعة السلام كلية التربية", "إعداد الباحثة منى", "Dr. Ann Lee, University of Karsan", "ann@karsan.org", "www.karsan.org/page", "see https://doi.org/10.1/x now", "الملخص", "ملخص البحث: نص",
    "Abstract: text", "Received: 12/03/2020 Abstract of it", "Summary of all", "نص عادي أول", "plain text here", "الكلمات المفتاحية: ري، تربة", "Keyword:", "the keywords follow", "المقدمة", "تمهيد للبحث", "Introduction",
]


@pytest.mark.parametrize("code", sorted(x.PROFILES))
def test_every_profile_gives_the_regions_of_plain_loops(spark, code):
    random = __import__("random").Random(code)
    pages = [[random.choice(PIECES) for _ in range(random.choice((0, 3, 8, 20, 95)))] for _ in range(60)]
    df = spark.createDataFrame([(k, code.lower() if k % 2 else code, "\n".join(ls), None) for k, ls in enumerate(pages)], "k int, source string, page1 string, page2 string")
    p = x.PROFILES[code]
    out = [t for t in PIECES if any(re.search(f"(?im){b}", t) for b in p.lines)]
    got = {r.k: r.regions for r in x.pinpoint(df).collect()}
    for k, ls in enumerate(pages):
        assert got[k] == plain_regions([t for t in ls if t not in out], p), k


@pytest.mark.parametrize(
    "code,line",
    [
        ("AM", "Manarah, Human Series, Vol. 4, No. 2, 2025 (255)"), ("AM", "DOL: https://x.org/1"), ("AM", "** Corresponding Author:"), ("AJP", "Association of Arab Universities Journal for Education and Psychology"), ("AJP", "مجلة المجلد 4 العدد 2"), ("AJP", "Volume 3 | Issue 2 Article 5"),
        ("AJSP", "المجلة العربية للنشر العلمي"), ("AJSP", "الإصدار الثامن"), ("AJSRP", "° Open Access"), ("AJSRP", "ISSN: 2518-5780 (Online)"), ("AJSRP", "x Vol 11, Issue 3 (2025) P: 69"), ("ARPD", "المجلة المصرية للتربية العلمية 4"), ("ARPD", "E. ISSN : 1234"), ("ARPD", "جامعة كذا"), ("ARPD", "٤٥."),
    ],
)
def test_boilerplate_lines(values, code, line):
    got = values(f"قبل\n{line}\nبعد").select(x.strip_boilerplate(F.col("v"), x.PROFILES[code]).alias("t")).first().t
    assert got.split() == ["قبل", "بعد"]


def test_boilerplate_blocks(values):
    for code, text in (("AJP", "Recommended Citation one\ntwo Available at: https://x.org/1"), ("AM", "This article is an open access article distributed under\nterms\n\n"), ("ARPD", "دار المنظومة سطر\nسطر\n\n"), ("AJSRP", "2024 © AISRP text all rights reserved.\n\n")):
        got = values(f"قبل\n{text}\nبعد").select(x.strip_boilerplate(F.col("v"), x.PROFILES[code]).alias("t")).first().t
        assert got.split() == ["قبل", "بعد"], code


def test_repeated_first_line(values):
    a, b = "رأس الصفحة المكرر هنا\nنص أول طويل", "رأس الصفحة المكرر هنا\nنص ثان طويل"
    got = values(a).select(x.full_text(F.col("v"), F.lit(b)).alias("t")).first().t
    assert got == a + " \n " + "نص ثان طويل"
