import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from warraq.operators.multivalue import AUTHORS, CLOSE, IDS, KEYWORDS, OPEN, explode_values, split_values

CASES = [
    (AUTHORS, None, []),
    (AUTHORS, "", []),
    (AUTHORS, "  \t", []),
    (AUTHORS, "nan", []),
    (AUTHORS, "None", []),
    (AUTHORS, "[]", []),
    (AUTHORS, '["A B", "C D"]', ["A B", "C D"]),
    (AUTHORS, "['A B', 'C D', 'A B']", ["A B", "C D", "A B"]),
    (AUTHORS, "[np.str_('A B'), np.str_('C D')]", ["A B", "C D"]),
    (AUTHORS, '"A, B";"C"', ["A, B", "C"]),
    (AUTHORS, "['W.\\' X', 'a\\xa0b', 'c\\u200bd']", ["W.' X", "a\xa0b", "c​d"]),
    (AUTHORS, '["\\u0623\\u0645\\u0644 \\u0627"]', ["أمل ا"]),
    (AUTHORS, '["a \\"b\\" c"]', ['a "b" c']),
    (AUTHORS, "الشلنغري، منى", ["الشلنغري، منى"]),
    (AUTHORS, "بني جقهاجم، زياد وائل • أمل الشلنغري", ["بني جقهاجم، زياد وائل", "أمل الشلنغري"]),
    (AUTHORS, "Rufkhatara, Wafa;علي لوسغاجلة", ["Rufkhatara, Wafa", "علي لوسغاجلة"]),
    (AUTHORS, "ط. الغفدبسي، علي بني دتزاهج", ["ط. الغفدبسي", "علي بني دتزاهج"]),
    (AUTHORS, "أمل الشلنغري و منى لوسغاجلة و Ann Lee", ["أمل الشلنغري", "منى لوسغاجلة", "Ann Lee"]),
    (AUTHORS, "د/ موسى بني قلسابس / منى شوبشاكسة /", ["د/ موسى بني قلسابس", "منى شوبشاكسة"]),
    (AUTHORS, "Da'oud Mahmoud Q & Ann Al-Lee", ["Da'oud Mahmoud Q", "Ann Al-Lee"]),
    (KEYWORDS, "a, b (c, d), e.", ["a", "b (c, d)", "e"]),
    (KEYWORDS, "a ، ، b", ["a", "b"]),
    (KEYWORDS, "socio-economic - b - c", ["socio-economic", "b", "c"]),
    (KEYWORDS, "[\"plate motion's history\", 'x']", ["plate motion's history", "x"]),
    (IDS, "[22.0, 31.0]", ["22", "31"]),
    (IDS, "{٢٢،٣١}", ["22", "31"]),
    (IDS, "[np.int64(4), np.int64(63)]", ["4", "63"]),
    (IDS, "61, 103 / 132,232;356", ["61", "103", "132", "232", "356"]),
    (IDS, "[1 2 2]", ["1", "2", "2"]),
]


def test_notations(values):
    for notation in (AUTHORS, KEYWORDS, IDS):
        own = [(v, want) for n, v, want in CASES if n is notation]
        got = values(*(v for v, _ in own)).select("k", split_values(F.col("v"), notation).alias("x")).orderBy("k").collect()
        assert [(v, list(r.x)) for (v, _), r in zip(own, got)] == own


def test_marks_in_the_text_are_no_placeholders(values):
    text = f"a{OPEN}0{CLOSE}b; c (d; e)"
    assert values(text).select(split_values(F.col("v"), KEYWORDS).alias("x")).first().x == [f"a{OPEN}0{CLOSE}b", "c (d; e)"]


def test_positions_and_clashing_names(spark):
    df = spark.createDataFrame([("r1", "a; ; b; a", 1, "x"), ("r2", None, 2, "y")], "row_no string, v string, pos int, item string")
    rows = explode_values(df, "row_no", "v", KEYWORDS, "keywords").collect()
    assert [tuple(r) for r in rows] == [("keywords", "r1", 1, "a"), ("keywords", "r1", 2, "b"), ("keywords", "r1", 3, "a")]


def test_empty_table(spark):
    df = spark.createDataFrame([], "row_no string, v string")
    assert explode_values(df, "row_no", "v", AUTHORS, "authors").collect() == []


def test_very_long_value(values):
    items = [f"word {i}" for i in range(5000)]
    assert values("; ".join(items)).select(split_values(F.col("v"), KEYWORDS).alias("x")).first().x == items


item = st.text(st.characters(codec="utf-8", exclude_categories=("Cs", "Cc", "Cf", "Co", "Zs", "Zl", "Zp")), min_size=1, max_size=12).filter(lambda s: s.strip() == s and s.lower() not in ("nan", "none", "null", "na", "n/a", "[]", "{}", "()", "<na>"))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(item, min_size=1, max_size=6))
def test_json_and_python_lists_round_trip(values, items):
    got = values(json.dumps(items), json.dumps(items, ensure_ascii=False), repr(items)).select(split_values(F.col("v"), AUTHORS).alias("x")).collect()
    assert [r.x for r in got] == [items] * 3
