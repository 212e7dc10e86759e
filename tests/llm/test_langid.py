import numpy as np
import pytest

from warraq.llm import langid

TEXTS = {
    "ar": "أظهرت النتائج وجود فروق ذات دلالة إحصائية في طرائق التدريس تعزى إلى المناهج الدراسية وبلغت النسبة عشرة في المئة",
    "fa": "این پژوهش به بررسی کیفیت آموزش و رابطه آن با یادگیری گروهی در شهر نمونه پرداخته است و یافته ها نشان داد",
    "en": "The results showed significant differences in teaching methods attributed to school curricula and the authors recommend further research",
    "fr": "Les résultats ont montré des différences significatives dans les réseaux sans fil liées à la salinité des sols et les auteurs recommandent",
    "tr": "Bulgular çömlek sanatı ile halk şiiri arasında olumlu bir ilişki olduğunu göstermiştir ve yazarlar yeni araştırmalar önermektedir",
}


@pytest.fixture(scope="module")
def model(spark):
    rows = [(t, code) for code, t in TEXTS.items()] * 30 + [(TEXTS["ar"], "en"), (TEXTS["en"], "ar"), (None, "ar"), ("x", None)]
    return langid.train(spark.createDataFrame(rows, "text string, lang string"))


def test_labels(spark):
    cases = {"AR": "ar", "ara": "ar", "ar_EG": "ar", "العربية": "ar", "English": "en", "en-US": "en", "Persian": "fa", "fre": "fr", "Türkçe": "tr", "und": None, "": None, " N/A ": None, "xx": None, "de": "other"}
    df = spark.createDataFrame([(k,) for k in [*cases, None]], "l string")
    got = {r.l: r.c for r in df.select("l", langid.label_code(df.l).alias("c")).collect()}
    assert got == cases | {None: None}


def test_main_language(spark, model):
    rows = [(k, t) for k, t in enumerate(TEXTS.values())] + [(10, None), (11, ""), (12, "12 %"), (13, TEXTS["en"] + " نص قصير"), (0, TEXTS["ar"])]
    got = [(r.doc_id, r.lang, r.confidence) for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", model).collect()]
    assert sorted((k, x) for k, x, _ in got if x) == sorted([*enumerate(TEXTS), (13, "en"), (0, "ar")])
    assert all((x is None) == (c == 0) for _, x, c in got) and all(0 <= c <= 1 for _, _, c in got)


def test_segments_of_mixed_text(spark, model):
    text = f"{TEXTS['ar']}. {TEXTS['en']}. {TEXTS['fr']} {TEXTS['fa']}"
    got = langid.segments(spark.createDataFrame([(1, text), (2, None)], "k long, t string"), "k", "t", model).orderBy("seg_no").collect()
    assert [r.lang for r in got] == ["ar", "en", "fr", "fa"]
    assert text[got[1].start : got[1].end] == TEXTS["en"]


def test_long_texts_and_single_foreign_words(model):
    lab = langid.Labeller(model)
    words = [langid.WORD.findall(TEXTS["ar"] + " VIs " + TEXTS["ar"]), langid.WORD.findall((TEXTS["en"] + " ") * 500), []]
    (a, _), (b, _), (c, _) = lab.paths(words)
    assert {langid.LANGS[k] for k in a} == {"ar"} and {langid.LANGS[k] for k in b} == {"en"} and not len(c)


def test_whole_sentences_of_pages(spark, model):
    page = f"ISSN: 0001-900X   Karsan Journal\n{TEXTS['fr'][:40]}\nAbstract: {TEXTS['en']}.\nKeywords: one two three four five six, seven eight.\nالملخص: {TEXTS['ar']}.\nالمراجع: Revue des études générales de la langue, Vol. 3, 2001."
    df = spark.createDataFrame([(1, page), (2, None), (3, "no end here at all"), (4, TEXTS["tr"] + ".")], "row_no long, page1 string")
    got = {(r.row_no, r.lang) for r in langid.page_languages(df, "row_no", "page1", model).collect()}
    assert got == {(1, "en"), (1, "ar"), (4, "tr")}


def test_name_lists(spark, model):
    df = spark.createDataFrame([(1, "['Ann Lee', 'أمل علي']"), (2, "nan"), (3, None), (4, '["\\u0623\\u0645\\u0644"]'), (5, "A. Lee; B. Roe")], "row_no long, authors string")
    assert {(r.row_no, r.lang) for r in langid.name_list_languages(df, "row_no", "authors", model).collect()} == {(1, "ar"), (1, "en"), (4, "ar"), (5, "en")}


def test_nothing_to_learn_from(spark):
    m = langid.train(spark.createDataFrame([], "text string, lang string"))
    assert np.isfinite(m).all()
    assert langid.identify(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text", m).collect() == []


def test_pages_and_name_lists_have_segments_and_confidence(spark, tmp_path):
    from warraq.llm import queries

    ar, en = "تهدف الدراسة إلى قياس أثر الذاكرة العاملة في التحصيل الدراسي لدى الطلاب.", "The paper aims to measure the effect of working memory on the students."
    spark.createDataFrame([(k, t, c) for k in range(20) for t, c in ((ar, "ar"), (en, "en"))], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, f"{ar}\n{en}", "منى الشلنغري; Mona Kamel"), (2, None, None)], "row_no long, page1 string, authors string").write.parquet(f"{tmp_path}/sample_articles.parquet")
    page, names = f"{ar}\n{en}", "منى الشلنغري; Mona Kamel"
    got = queries.queries()["p7_field_segments"](spark, str(tmp_path)).collect()
    text = {"page1": page, "authors": names}
    spans = {(r.field, r.rec_key, r.lang, text[r.field][r.start : r.end]) for r in got}
    assert {("page1", 1, "ar", ar[:-1]), ("page1", 1, "en", en[:-1]), ("authors", 1, "en", "Mona Kamel")} <= spans and all(0 < r.confidence <= 1 for r in got)
    found = queries.queries()["p7_field_languages"](spark, str(tmp_path)).collect()
    assert {(r.field, r.rec_key, r.lang) for r in found} == {(f, 1, c) for f in ("page1", "authors") for c in ("ar", "en")} and all(0 < r.confidence <= 1 for r in found)


def test_wrong_and_missing_labels(spark):
    from warraq.llm import labels

    turned = lambda t, n: " ".join(t.split()[n % 12 :] + t.split()[: n % 12])
    docs = [(k, turned(t, k // 5), code) for k, (code, t) in enumerate(list(TEXTS.items()) * 30)]
    docs += [(900, TEXTS["ar"] + " 12", None), (901, TEXTS["fr"] + " 34", "English"), (902, TEXTS["tr"] + " 5", "Türkçe"), (903, TEXTS["en"] + " 6", "und"), (904, None, "ar"), (905, "", "xx"), (906, "12 %", None), (907, "404 Not Found", "ar"), (900, TEXTS["ar"] + " 12", None)]
    df = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, lang string, found int, code string")
    got = sorted(tuple(r) for r in labels.wrong_labels(df, *labels.fit(df)).collect())
    assert got == [(900, "ar"), (900, "ar"), (901, "fr"), (903, "en")]
    empty = df.limit(0)
    assert labels.wrong_labels(empty, *labels.fit(empty)).collect() == []


def test_a_text_counts_once_under_its_usual_label(spark):
    from warraq.llm import labels

    rows = [(TEXTS["ar"], "ar")] * 9 + [(TEXTS["ar"], "fr")] * 2 + [(TEXTS["fr"], "fr")]
    model, prose = labels.fit(spark.createDataFrame(rows, "text string, lang string"))
    single, _ = labels.fit(spark.createDataFrame([(TEXTS["ar"], "ar"), (TEXTS["fr"], "fr")], "text string, lang string"))
    assert np.array_equal(model, single) and prose.sum() > 0
