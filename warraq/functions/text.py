"""Text functions as column expressions, for Arabic and mixed-script text.

Patterns take Unicode classes (``(?U)``) and ``\\n`` as the only line end
(``(?d)``). NULL gives NULL unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from warraq.functions.unicode import compatible

MARKS = r"[\u064B-\u0652]"
ARABIC = r"[\u0600-\u06FF]"
ARABIC_BLOCKS = r"[\u0600-\u06FF\u0750-\u077F\u08A0-\u08FF\uFB50-\uFDFF\uFE70-\uFEFF]"
TATWEEL = "\u0640"


def strip_tashkeel(c: Column) -> Column:
    """Without vowel marks."""
    return F.regexp_replace(c, MARKS, "")


def strip_tatweel(c: Column) -> Column:
    """Without the stretching sign."""
    return F.translate(c, TATWEEL, "")


def fold_alef(c: Column) -> Column:
    """Every alef, the broken one too, as a bare alef."""
    return F.translate(c, "أإآٱىٰ", "اااااا")


def fold_teh(c: Column) -> Column:
    """Teh marbuta as heh."""
    return F.translate(c, "ة", "ه")


def fold_arabic(c: Column) -> Column:
    """The index fold: alefs to alef, broken alef and yeh with hamza to yeh, teh marbuta to heh."""
    return F.translate(c, "أإآىئة", "اااييه")


def fold_search(c: Column) -> Column:
    """The search fold, letter for letter in lower case, so that offsets hold."""
    return F.translate(F.lower(F.translate(c, "İ", "i")), "أإآةىئ", "اااهيي")


def fold_author_zone(c: Column) -> Column:
    """The author zone's fold: no stretching sign, alefs to alef."""
    return F.translate(strip_tatweel(c), "أإآ", "ااا")


def is_arabic(c: Column) -> Column:
    """Whether a value holds a letter of the Arabic blocks."""
    return c.rlike(ARABIC_BLOCKS)


def is_latin(c: Column) -> Column:
    """Whether a value holds a basic Latin letter."""
    return c.rlike("[A-Za-z]")


def is_missing(c: Column) -> Column:
    """NULL or blank."""
    return c.isNull() | (F.regexp_replace(c, r"(?U)\s+", "") == "")


def is_missing_list(c: Column) -> Column:
    """NULL or without an item."""
    return F.coalesce(F.size(c) <= 0, F.lit(True))


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def clean_page(c: Column) -> Column:
    """A scanned page: folded, joined at line ends, without layout marks, number lines and long blocks that hold no Arabic; NULL gives an empty text."""
    t = fold_teh(fold_alef(strip_tatweel(strip_tashkeel(F.coalesce(c, F.lit(""))))))
    t = F.regexp_replace(t, r"(?U)(\w)-\s*\n\s*(\w)", "$1$2")
    t = F.regexp_replace(F.replace(t, F.lit("|"), F.lit(" ")), r"_{3,}|-{3,}", " ")
    t = F.regexp_replace(t, r"(?Umd)^\s*\d+\s*$", "")
    t = F.regexp_replace(t, r"(?U)[^\w\s\u0600-\u06FF\.,:;\-\(\)\[\]/@\+\*]", " ")
    blocks = F.filter(F.split(t, r"(?U)\n\s*\n", -1), lambda b: b.rlike(ARABIC) | (F.length(_strip(b)) < 50))
    t = F.regexp_replace(F.array_join(blocks, "\n\n"), r"[ \t]+", " ")
    return _strip(F.regexp_replace(t, r"(?U)\n\s*\n*", "\n"))


def clean_spaces(c: Column) -> Column:
    """Without white space but line ends and single blanks."""
    return _strip(F.regexp_replace(F.regexp_replace(c, r"(?U)[^\S\r\n ]+", ""), " +", " "))


def remove_decorative(c: Column) -> Column:
    """Without decorative signs; runs of stops as one; plain quotation marks."""
    t = F.regexp_replace(c, r"[•●▪♦■★☆※…—–―‐\u2022\u2023\u25A0-\u25FF]", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\.{3,}", "."), r"[_~^`]+|=", "")
    return F.translate(t, "“”‘’", "\"\"''")


def basic_cleanup(c: Column) -> Column:
    """Light cleanup before extraction: compatibility form, one line end, no format signs, no decorative marks, collapsed blanks; NULL gives an empty text."""
    t = F.regexp_replace(compatible(F.coalesce(c, F.lit(""))), r"\r\n?", "\n")
    t = F.regexp_replace(t, r"[•●▪♦■★☆※…—–―\u2010-\u2043\u204E-\u205E]", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"\.{3,}", "."), r"={2,}|[_~^`]+", " ")
    return _strip(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


PAGE_BREAK = "\n\n===== PAGE 2 =====\n\n"


def join_pages(a: Column, b: Column) -> Column:
    """Both cleaned pages with a mark between them; an empty one is left out."""
    pages = F.filter(F.array(basic_cleanup(a), basic_cleanup(b)), lambda p: p != "")
    return F.array_join(pages, PAGE_BREAK)


def remove_latin_digits(c: Column) -> Column:
    """Without Latin letters and digits."""
    return F.regexp_replace(c, r"[\p{IsLatin}\p{Nd}]+", "")


def remove_punctuation(c: Column) -> Column:
    """Without punctuation, signs, emoji and invisible marks."""
    return F.regexp_replace(F.regexp_replace(c, r"[\p{P}\p{S}]+", ""), r"[\uFE0F\u200B-\u200F\u2060]", "")


def whitelist(c: Column) -> Column:
    """Arabic and Latin letters, digits, white space and a few signs; everything else out."""
    return F.regexp_replace(c, r"[^0-9A-Za-z\u0600-\u06FF\u0750-\u077F\u08A0-\u08FF\uFB50-\uFDFF\uFE70-\uFEFF\s_\-'.,()/\\]", "")


def fix_author_cell(c: Column) -> Column:
    """An authors cell: footnote marks out, other delimiters to commas."""
    for old, new in (("1", ""), (",2", ""), ("*", ""), ("&", ","), ("/", ","), ("\u200c", "")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def strip_researcher(c: Column) -> Column:
    """Without the word "researcher" and the blanks and backslashes around it."""
    return F.trim(F.regexp_replace(c, r"[\s\\]*الباحث[\s\\]*", ""))


def truncate(c: Column, n: int = 30) -> Column:
    """At most ``n`` characters and an ellipsis."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def pdf_name(url: Column) -> Column:
    """The path segments after "download", joined by dashes, with ``.pdf``; NULL without them."""
    tail = F.regexp_extract(url, r"/download/([^?#]+)", 1)
    return F.when(tail != "", F.concat(F.array_join(F.filter(F.split(tail, "/"), lambda s: s != ""), "-"), F.lit(".pdf")))


def tail_name(url: Column) -> Column:
    """The last two path segments of an address, joined by a dash, with ``.pdf``; ``file.pdf`` if there are fewer."""
    path = F.regexp_replace(F.regexp_extract(url, r"^(?:[A-Za-z][\w+.-]*://[^/?#]*)?([^?#]*)", 1), r"/+$", "")
    parts = F.split(path, "/")
    return F.when(F.size(parts) >= 2, F.concat(F.array_join(F.slice(parts, -2, 2), "-"), F.lit(".pdf"))).when(url.isNotNull(), F.lit("file.pdf"))


def query_value(url: Column, name: str, default: Column | None = None) -> Column:
    """A query parameter of an address; the default, or NULL, without it."""
    found = F.nullif(F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1), F.lit(""))
    return found if default is None else F.coalesce(found, default)


def split_title(c: Column) -> Column:
    """(ar, en): a title cut at its first stop; the second part is NULL without one."""
    parts = F.split(c, r"\. ", 2)
    return F.struct(F.when(F.size(parts) > 1, F.concat(parts[0], F.lit("."))).otherwise(c).alias("ar"), F.get(parts, F.lit(1)).alias("en"))


def split_script(c: Column) -> Column:
    """(ar, en): the Arabic and the Latin letters of a title, each NULL if there are none."""
    ar = F.nullif(collapse(F.regexp_replace(c, r"[^\u0600-\u06FF\u0750-\u077F\u08A0-\u08FF\uFB50-\uFDFF\uFE70-\uFEFF\s]", "")), F.lit(""))
    en = F.nullif(collapse(F.regexp_replace(c, r"[^A-Za-z\s\d]", "")), F.lit(""))
    return F.struct(ar.alias("ar"), F.when(is_latin(c), en).alias("en"))


def title_pair(c: Column, arabic: Column, english: Column) -> Column:
    """(ar, en) of a title: its two scripts apart where it has both, else itself beside its translation.

    ``arabic`` and ``english`` are the translations into these languages, as a
    service gives them; without a service the title itself stands for them.
    NULL and blank titles give two empty texts.
    """
    t = _strip(F.coalesce(c, F.lit("")))
    apart = split_script(t)
    ar = F.when(is_arabic(t) & is_latin(t), apart["ar"]).when(is_arabic(t), t).otherwise(F.coalesce(arabic, t))
    en = F.when(is_arabic(t) & is_latin(t), apart["en"]).when(is_arabic(t), F.coalesce(english, t)).otherwise(t)
    none = F.lit("")
    return F.struct(F.when(t == "", none).otherwise(F.coalesce(collapse(ar), none)).alias("ar"), F.when(t == "", none).otherwise(F.coalesce(collapse(en), none)).alias("en"))


def arabic_whitelist(c: Column) -> Column:
    """Letters and digits of the Arabic blocks, basic digits, white space and plain punctuation; everything else out."""
    return F.regexp_replace(c, r"(?U)[^\u0600-\u06FF\u0750-\u077F\u08A0-\u08FF0-9.,;:!?()\[\]{}\-–—'\"“”\s]", "")


def segment_after(path: Column, folder: str) -> Column:
    """The path segment behind a folder; NULL without it."""
    return F.nullif(F.regexp_extract(path, rf"(?:^|/){folder}/([^/]*)", 1), F.lit(""))


def words(c: Column) -> Column:
    """Words by white space; NULL and blank give an empty array."""
    return F.filter(F.split(collapse(F.coalesce(c, F.lit(""))), " "), lambda w: w != "")


def terms(c: Column) -> Column:
    """Lower-case runs of two or more word characters; NULL gives an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def token_estimate(c: Column) -> Column:
    """Two tokens a word, the plain stand-in for a tokenizer; NULL has 0."""
    return 2 * F.size(words(c))


#: Light-stemming affixes, longest first.
PREFIXES = ("وال", "بال", "كال", "فال", "لل", "ال", "و")
SUFFIXES = ("ها", "ان", "ات", "ون", "ين", "يه", "ية", "ه", "ة", "ي")


def light_stem(w: Column) -> Column:
    """A word without one prefix and its suffixes, while two letters or more are left."""
    w = F.regexp_replace(w, rf"^(?:{'|'.join(PREFIXES[:-1])})(?=.{{2,}})|^و(?=.{{3,}})", "")
    for s in SUFFIXES:
        w = F.regexp_replace(w, rf"(?<=..){s}$", "")
    return w


#: Arabic stop words, before and after stemming alike.
STOPWORDS = tuple("في من على إلى عن أن إن هذا هذه التي الذي الذين ما لا لم لن كان كانت قد هو هي هم مع بين أو أم ثم كل بعض غير عند حتى إذا كما لكن بل منها فيها عليها به له لها بها ذلك تلك هناك حيث أي و".split())


def stem_text(c: Column) -> Column:
    """Every word stemmed; NULL stays NULL."""
    return F.when(c.isNotNull(), F.array_join(F.transform(words(c), light_stem), " "))


def combined_text(abstract: Column, keywords: Column) -> Column:
    """An abstract, a blank and its keywords, an array; NULL without an abstract."""
    return F.concat(abstract, F.lit(" "), F.array_join(F.coalesce(keywords, F.array().cast("array<string>")), " "))


def retrieval_text(combined: Column) -> Column:
    """What retrieval compares: every word stemmed, then without stop words; NULL gives an empty text."""
    return F.coalesce(F.array_join(drop_stopwords(F.split(stem_text(combined), " ")), " "), F.lit(""))


def drop_stopwords(tokens: Column) -> Column:
    """Tokens but stop words."""
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.filter(tokens, lambda w: ~F.array_contains(stop, w))


def index_tokens(c: Column) -> Column:
    """The seven-step index pipeline: no Latin or digits, no punctuation, collapsed, no marks, folded, stemmed, without stop words."""
    t = fold_arabic(strip_tatweel(strip_tashkeel(collapse(remove_punctuation(remove_latin_digits(c))))))
    return drop_stopwords(F.filter(F.transform(words(t), light_stem), lambda w: w != ""))


def publish_date(c: Column) -> Column:
    """A date of the forms Y-M-D, D/M/Y, D.M.Y or a year alone (its first day); NULL otherwise."""
    t = F.translate(F.trim(c), "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")
    year = F.regexp_extract(t, r"(?:^|\D)((?:19|20)\d{2})(?:\D|$)", 1)
    return F.coalesce(
        F.try_to_date(F.regexp_extract(t, r"^(\d{4}-\d{1,2}-\d{1,2})", 1), "yyyy-M-d"),
        F.try_to_date(F.regexp_replace(F.regexp_extract(t, r"^(\d{1,2}[/.]\d{1,2}[/.]\d{4})$", 1), r"\.", "/"), "d/M/yyyy"),
        F.when(year != "", F.make_date(year.cast("int"), F.lit(1), F.lit(1))),
    )


def model_cleanup(c: Column) -> Column:
    """Cleanup before a text goes to a model: like ``basic_cleanup``, but decorative signs vanish and quotation marks become plain; NULL gives an empty text."""
    t = F.regexp_replace(compatible(F.coalesce(c, F.lit(""))), r"\r\n?", "\n")
    t = F.regexp_replace(t, r"[•●▪♦■★☆※…‐-⁃]", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\.{3,}", "."), r"={2,}|[_~^`]+", "")
    return _strip(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def normal_path(c: Column) -> Column:
    """A path with forward slashes, without ``.``, empty segments and ``x/..``, however deep."""
    parts = F.filter(F.split(F.translate(c, "\\", "/"), "/"), lambda x: (x != "") & (x != "."))
    back = lambda done, x: (x == "..") & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("..")) != "..")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda done, x: F.when(back(done, x), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x))))
    return F.concat(F.when(F.translate(c, "\\", "/").startswith("/"), F.lit("/")).otherwise(F.lit("")), F.array_join(kept, "/"))


def source_of_url(url: Column, prefix: str) -> Column:
    """``PREFIX_x`` where x is the third segment from an address's end."""
    parts = F.split(url, "/")
    return F.when(F.size(parts) >= 3, F.concat(F.lit(f"{prefix}_"), F.element_at(parts, -3)))
