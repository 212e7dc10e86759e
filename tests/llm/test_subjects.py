from warraq.llm import subjects

TERMS = {"Art": ["النحت البارز", "الخزف المزجج", "المنمنمات المذهبة"], "Music": ["آلة الناي", "السلم الخماسي", "تدوين النوتة"]}
FRAMES = ["تناقش الورقة {} في قرية مذكورة.", "أوصت الدراسة بموضوع {} لاحقا.", "يعد {} من القضايا المهمة."]


def text(*terms):
    return " ".join(FRAMES[k % 3].format(t) for k, t in enumerate(terms))


LABELS = [(k, text(t, u), s) for s, ts in TERMS.items() for k, (t, u) in enumerate((t, u) for t in ts for u in ts)]


def test_lexicon():
    lex = subjects.learn_lexicon([(t, s) for _, t, s in LABELS])
    assert lex["النحت البارز"] == "Art" and lex["آلة الناي"] == "Music" and "الورقة" not in lex


def test_assignment(spark):
    a, m = TERMS["Art"], TERMS["Music"]
    rows = [(k, text(*a, *a[:2]), "x", None, None, "") for k in range(40)] + [(100 + k, text(*m, m[0]), "x", None, "Music", "S_Art") for k in range(40)]
    rows += [(200 + k, text(a[0], a[1], a[2], a[0], m[0], m[1], m[2]), None, None, "Art", None) for k in range(12)]
    rows += [(300 + k, text(a[0], a[1], a[2], m[k % 3], a[1]), None, None, "Art", None) for k in range(12)]
    rows += [(900, None, "x", "x", "Art", None), (901, "  ", None, None, None, None), (902, "نص بلا مصطلح", None, None, None, None), (0, text(*a, *a[:2]), "x", None, None, "")]
    paths = {0: "pdf/ART_1.pdf", 1: "pdf\\MUS_2.pdf"}
    df = spark.createDataFrame([(*r, paths.get((r[0] or 0) // 100)) for r in rows], "article_id long, abstract_ar string, title string, keywords string, general_field string, source string, path string")
    labels = spark.createDataFrame(LABELS, "label_id int, text string, subject string")
    got = {}
    for r in subjects.assign_subjects(df, labels).collect():
        got.setdefault(r.article_id, set()).add(r.subject)
    assert all(got[k] == {"Art"} for k in range(40)) and all(got[100 + k] == {"Music"} for k in range(40))
    assert all(got[200 + k] == {"Art", "Music"} for k in range(12)) and all(got[300 + k] == {"Art"} for k in range(12))
    assert not {900, 901, 902} & set(got)
    assert subjects.assign_subjects(df.limit(0), labels).collect() == []
    assert subjects.assign_subjects(df, labels.limit(0)).collect() == []


def test_address_votes(spark):
    rows = [(k, "ART", "Art", 2) for k in range(60)] + [(k, "MUS", "Music", 2) for k in range(60)] + [(500, "ART", "Music", 1), (501, None, "Music", 1), (502, "NEW", "Art", 1), (503, "ART", "Law", 1)]
    df = spark.createDataFrame(rows, "article_id long, code string, subject string, mentions int")
    got = {r.article_id: r.address for r in subjects.with_address(df).collect() if r.article_id >= 500}
    assert got == {500: 0, 501: 3, 502: 1, 503: 3}
    assert {r.address for r in subjects.with_address(df).filter("article_id < 60").collect()} == {2}


def test_more_than_two_subjects(spark):
    sets = {"Art": ["النحت البارز", "الخزف المزجج"], "Music": ["آلة الناي", "السلم الخماسي"], "Law": ["العقد المدني", "الدفوع الشكلية"]}
    labels = [(0, text(*ts, *ts), s) for s, ts in sets.items() for _ in range(2)]
    all_three = [t for ts in sets.values() for t in ts]
    rows = [(k, text(*all_three, *all_three)) for k in range(30)] + [(100 + k, text(*sets["Art"], *sets["Art"])) for k in range(30)]
    df = spark.createDataFrame([(k, t, None, None, None, None, None) for k, t in rows], "article_id long, abstract_ar string, title string, keywords string, general_field string, source string, path string")
    got = {}
    for r in subjects.assign_subjects(df, spark.createDataFrame(labels, "label_id int, text string, subject string")).collect():
        got.setdefault(r.article_id, set()).add(r.subject)
    assert all(got[k] == {"Art", "Music", "Law"} for k in range(30)) and all(got[100 + k] == {"Art"} for k in range(30))
