import unicodedata

import pytest

from warraq.llm import unify

COUNTS = {"": {"ي": 900, "ى": 200, "ك": 800, "ک": 20, "ی": 30, "ه": 900, "ہ": 1, "a": 500, "o": 400, "fi": 1}, "fa": {"ی": 300, "ک": 200, "ه": 100, "ي": 1}}


@pytest.fixture(scope="module")
def rewrite():
    return unify.rewriter(unify.variants(COUNTS))


@pytest.mark.parametrize(
    "text,want",
    [
        ("ab​c", "abc"), ("a b　c", "a b c"), ("Ａｂ１，", "Ab1,"), ("ﺍﻟﺸﻌﺮ", "الشعر"), ("ﬁeld", "field"), ("ét", "ét"), ("السیاسات العامة", "السياسات العامة"), ("المناہج", "المناهج"),
        ("wοrking", "working"), ("ресtаtiоns", "pectations"), ("Аbstract", "Abstract"), ("أ", "أ"), ("ﻻ", "لا"),
    ],
)
def test_variants(rewrite, text, want):
    assert rewrite(text) == want
    assert rewrite(want) == want


@pytest.mark.parametrize("text", ["", "Вестник 2006", "(α = 0.05)", "چکیده: این پژوهش به بررسی کیفیت آموزش", "دراسةٌ متأنيةٌ", "إلى على مدرسة", "été", "٢٠١٨", "x" * 50_000, "m² x³ ½ H₂O № 5 𝛼", "ᏣᎳᎩ", "Հայաստան", "2024 ٢٠٢٤"])
def test_what_is_no_case_stays(rewrite, text):
    assert rewrite(text) == text


def test_equal_looking_values_become_equal(rewrite):
    word = "قسم é الشعر field"
    seen = {rewrite(f(word)) for f in (str, lambda s: unicodedata.normalize("NFD", s), lambda s: s.replace(" ", " "), lambda s: "‏".join(s), lambda s: s.replace("fi", "ﬁ"))}
    assert seen == {word}


def test_classes_are_transitive():
    c = unify.Classes()
    c.join("a", "b"), c.join("b", "c")
    assert c.members()[c.find("a")] == ["a", "b", "c"]


def test_operator(spark):
    rows = [("f", "1", "السیاسات"), ("f", "2", "plain"), ("f", "3", None), ("f", "4", ""), ("f", "1", "السیاسات"), ("f", "5", "يكه " * 50)]
    df = spark.createDataFrame(rows, "field string, rec_key string, value string")
    got = unify.unify(df).collect()
    assert sorted((r.rec_key, r.unified) for r in got if r.changed) == [("1", "السياسات")] * 2
    assert len(got) == len(rows) and {r.rec_key: r.unified for r in got}["3"] is None
    assert unify.unify(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        unify.unify(df.withColumnRenamed("field", "changed"))


def test_ties_go_to_the_text_around():
    r = unify.rewriter(unify.variants({"": {}, "fa": {}}))
    assert r("في البيت") == r("فی البیت") == "في البيت"
    assert r("این کتاب در ایران است") == r("اين كتاب در ايران است و چاپ شد")[: len("این کتاب در ایران است")] == "این کتاب در ایران است"
