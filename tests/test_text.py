import re

from pyspark.sql import functions as F

from warraq.functions import lists, text


def one(values, f, *rows, rest=()):
    """``f(v, *rest)`` of each row; what needs a session in ``rest`` comes as a function."""
    df = values(*rows)
    made = f(F.col("v"), *(r() if callable(r) else r for r in rest))
    return [r[0] for r in df.select("k", made.alias("x")).orderBy("k").select("x").collect()]


def plain_clean(t):
    """The page cleaning again, as plain Python."""
    t = re.sub("[ً-ْ]", "", t or "").replace("ـ", "").translate(str.maketrans("أإآٱىٰة", "ااااااه"))
    t = re.sub(r"(\w)-\s*\n\s*(\w)", r"\1\2", t).replace("|", " ")
    t = re.sub(r"_{3,}|-{3,}", " ", t)
    t = re.sub(r"^\s*\d+\s*$", "", t, flags=re.M)
    t = re.sub(r"[^\w\s؀-ۿ.,:;\-()\[\]/@+*]", " ", t)
    t = "\n\n".join(b for b in re.split(r"\n\s*\n", t) if re.search("[؀-ۿ]", b) or len(b.strip()) < 50)
    return re.sub(r"\n\s*\n*", "\n", re.sub(r"[ \t]+", " ", t)).strip()


PAGES = [
    None, "", "   ", "الخصا-\nئص docu- \n ment", "نص | آخر\n____\n---\n12\nبعد", "عَرَبِيّ ـــ أإآى ة",
    "عنوان\n\n" + "long Latin block " * 5 + "\n\nDoi: 10.1/2\n\nخاتمة", "x" * 49 + "\n\n" + "y" * 50, "ن" * 30000, "a\n\n\n\nb\tc  d!؟٪",
]


def test_clean_page_is_the_plain_version(values):
    assert one(values, text.clean_page, *PAGES) == [plain_clean(p) for p in PAGES]


def test_folds_keep_length(values):
    t = "إلى أين يا آدم فى المدرسة"
    assert one(values, text.fold_search, t) == ["الي اين يا ادم في المدرسه"]
    assert one(values, text.fold_arabic, t) == ["الي اين يا ادم في المدرسه"]
    assert one(values, text.fold_alef, t, None) == ["الا اين يا ادم فا المدرسة", None]


def test_small_functions(values):
    assert one(values, text.truncate, "abcd", "abc", None, rest=(3,)) == ["abc…", "abc", None]
    assert one(values, text.pdf_name, "http://x/download/1/2", "http://x/view/1") == ["1-2.pdf", None]
    assert one(values, text.query_value, "http://x/v?article=7&b=1", "http://x", rest=("article",)) == ["7", None]
    assert one(values, text.segment_after, "pdfs/AM/Art/x.pdf", "x", rest=("AM",)) == ["Art", None]
    assert one(values, text.light_stem, "والمدارس", "كتابها", "و") == ["مدارس", "كتاب", "و"]
    assert [str(x) for x in one(values, text.publish_date, "2016-01-01", "3/4/2019", "٢٠١١", "سنة 1999 م", "?", None)] == ["2016-01-01", "2019-04-03", "2011-01-01", "1999-01-01", "None", "None"]
    assert one(values, text.join_pages, "a\r\nb", None, rest=(lambda: F.lit(None).cast("string"),)) == ["a\nb", ""]
    assert one(values, text.token_estimate, "a b", None, " ") == [4, 0, 0]
    assert one(values, text.is_missing, None, "  ", "x") == [True, True, False]


def test_titles_by_stop_and_script(values):
    assert [tuple(x) for x in one(values, text.split_title, "أ. B", "x")] == [("أ.", "B"), ("x", None)]
    assert [tuple(x) for x in one(values, text.split_script, "عنوان Title 2", "عنوان", "Title")] == [("عنوان", "Title 2"), ("عنوان", None), (None, "Title")]


def test_index_tokens(values):
    assert one(values, text.index_tokens, "الكِتابُ! في 3 abc المدرسة 😀", None) == [["كتاب", "مدرس"], []]


def test_lists(values):
    assert one(values, lists.literal_list, "['a', 'b,c']", "x", None) == [["a", "b,c"], [], []]
    assert one(values, lists.list_or_commas, "[\"a\"]", "a, b,", None) == [["a"], ["a", "b"], []]
    assert one(values, lists.id_list, "[np.str_('AUTH_1'), np.str_('AUTH_2')]", "[]", "", None) == [["AUTH_1", "AUTH_2"], [], [], []]
    assert one(values, lists.int_list, "[1, x, 30]", None) == [[1, 30], []]


def test_replies(values):
    fields = ("Art", "Education")
    good = '{"title_ar": " t ", "general_field": "Art", "authors": ["a"]}'
    rows = one(values, lists.normalized_reply, good, "chatter " + good + " more", '{"general_field": "Cooking", "title_ar": "t"}', '{"title_ar": "t"}', "no json", None, rest=(fields,))
    assert [(r.title_ar, r.general_field, r.authors) for r in rows] == [("t", "Art", ["a"])] * 2 + [("", "Education", []), ("t", "Education", [])] + [("", "Education", [])] * 2


def test_roots_and_compatible_forms(values):
    from warraq.functions.unicode import compatible, root

    assert {w: root(w) for w in ("كاتب", "مكتوب", "المدرسون", "استخرج", "كتب", "والكتاب")} == {"كاتب": "كتب", "مكتوب": "كتب", "المدرسون": "درس", "استخرج": "خرج", "كتب": "كتب", "والكتاب": "كتب"}
    assert one(values, compatible, "ﻻ Ａ\u200f", "plain نص", None) == ["لا A", "plain نص", None]


def test_paths_and_models(values):
    assert one(values, text.normal_path, "a/./b/../c.pdf", "x\\y//z", "../a", "/a/b/c/d/../../../../../e", "p/q/r/s/../../../t", None) == ["a/c.pdf", "x/y/z", "../a", "/../e", "p/t", None]
    assert one(values, text.source_of_url, "http://s/Art/issue/1", "x", rest=("AM",)) == ["AM_Art", None]
    assert one(values, text.model_cleanup, "a\r\n\n\n\nb…… = == c____d•", None) == ["a\n\nb. = cd", ""]


def test_addresses_and_titles(values):
    assert one(values, text.tail_name, "https://x.org/download/9161/8053/", "http://x.org/a?b=c/d", "x", None) == ["9161-8053.pdf", "-a.pdf", "file.pdf", None]
    assert one(values, text.query_value, "http://x/v?article=7", "http://x", rest=("article", F.lit("unk1"))) == ["7", "unk1"]
    pairs = one(values, text.title_pair, "عنوان Title 2", "عنوان", "Title", " ", None, rest=(F.lit("ترجمة"), F.lit("translation")))
    assert [tuple(p) for p in pairs] == [("عنوان", "Title 2"), ("عنوان", "translation"), ("ترجمة", "Title"), ("", ""), ("", "")]
    assert [tuple(p) for p in one(values, text.title_pair, "Title", rest=(F.lit(None).cast("string"), F.lit(None).cast("string")))] == [("Title", "Title")]
    assert one(values, text.arabic_whitelist, "نص abc 12, «x» (é)", None) == ["نص  12,  ()", None]


def test_replies_over_two_pages(values):
    good = '{"title": " t ", "authors": ["a", " "], "keywords": null, "publish_date": "2019"}'
    rows = one(values, lists.pages_reply, "so: " + good, "no json", None)
    assert (rows[0].title, rows[0].authors, rows[0].keywords, str(rows[0].publish_date), rows[0].abstract_ar) == ("t", ["a"], [], "2019-01-01", "") and rows[1:] == [None, None]


def test_lists_without_items(values):
    assert [lists and r for r in one(values, lambda c: text.is_missing_list(lists.split_any(c)), "a؛b", "; ,", None)] == [False, True, True]
