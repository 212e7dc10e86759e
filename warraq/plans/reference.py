"""Queries for the operators of scholarly-document pipelines, with their SQL."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warraq.functions import lists, text
from warraq.functions.dimensions import FIELD_NAMES, SUBJECTS, canonical_source, general_field
from warraq.functions.unicode import compatible, roots
from warraq.operators import extraction, profile, registry, relational, retrieval
from warraq.session import ensure_checkpoint_dir
from warraq.sources import files, load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name, with its SQL if it has one."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


WORD = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}]"
SPACE = r"[\t\n\x0B\f\r \x{85}\p{Z}]"



def _compatible_sql(column: str) -> str:
    """Compatibility form in SQL: characters that have a one-letter form by translation, the others of common blocks one by one."""
    one, many = {}, {}
    for cp in [*range(0xA0, 0xD800), *range(0xF900, 0xFFEF), *range(0x1D400, 0x1D800)]:
        c = chr(cp)
        form = unicodedata.normalize("NFKC", c)
        if form != unicodedata.normalize("NFC", c):
            if len(form) == 1:
                one[c] = form
            elif cp < 0x100 or 0x2000 <= cp < 0x2180 or 0xFB00 <= cp < 0xFB07 or 0xFE70 <= cp < 0xFF00:
                many[c] = form
    text_of = lambda x: "'" + "".join(x).replace("'", "''") + "'"
    sql = f"translate({column}, {text_of(one)}, {text_of(one.values())})"
    for c, form in many.items():
        sql = f"replace({sql}, {text_of(c)}, {text_of(form)})"
    return f"nfc_normalize({sql})"


# projections, filters, functions of single rows


@query("select cast(row_no as varchar) as row_no, coalesce(title, '') as title, '' as title_en, coalesce(source, '') as source, coalesce(path, '') as path from sample_articles")
def align_schema(spark: SparkSession, d: str) -> DataFrame:
    return relational.align(load(spark, d, "sample_articles"), ["row_no", "title", "title_en", "source", "path"])


@query(
    """select row_no, regexp_replace(title, '[\\x{064B}-\\x{0652}]', '', 'g') as bare, replace(title, 'ـ', '') as unstretched, translate(title, 'أإآٱىٰ', 'اااااا') as alef,
    translate(title, 'ة', 'ه') as teh, translate(title, 'أإآىئة', 'اااييه') as folded, translate(lower(title), 'أإآةىئ', 'اااهيي') as searched from sample_articles"""
)
def fold_titles(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("title")
    return load(spark, d, "sample_articles").select(
        "row_no", text.strip_tashkeel(t).alias("bare"), text.strip_tatweel(t).alias("unstretched"), text.fold_alef(t).alias("alef"), text.fold_teh(t).alias("teh"), text.fold_arabic(t).alias("folded"), text.fold_search(t).alias("searched")
    )


_CLEAN = f"""
with a as (select row_no, translate(translate(replace(regexp_replace(coalesce(page1, ''), '[\\x{{064B}}-\\x{{0652}}]', '', 'g'), 'ـ', ''), 'أإآٱىٰ', 'اااااا'), 'ة', 'ه') as t from sample_articles),
b as (select row_no, regexp_replace(t, '({WORD})-{SPACE}*\\n{SPACE}*({WORD})', '\\1\\2', 'g') as t from a),
c as (select row_no, regexp_replace(replace(t, '|', ' '), '_{{3,}}|-{{3,}}', ' ', 'g') as t from b),
e as (select row_no, regexp_replace(t, '(?m)^{SPACE}*\\p{{Nd}}+{SPACE}*$', '', 'g') as t from c),
f as (select row_no, regexp_replace(t, '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}\\x{{200C}}\\x{{200D}}\\t\\n\\x0B\\f\\r \\x{{85}}\\p{{Z}}\\x{{0600}}-\\x{{06FF}}.,:;\\-()\\[\\]/@+*]', ' ', 'g') as t from e),
g as (select row_no, array_to_string(list_filter(string_split_regex(t, '\\n{SPACE}*\\n'), lambda x: regexp_matches(x, '[\\x{{0600}}-\\x{{06FF}}]') or length(regexp_replace(x, '^{SPACE}+|{SPACE}+$', '', 'g')) < 50), chr(10) || chr(10)) as t from f)
select row_no, regexp_replace(regexp_replace(regexp_replace(t, '[ \\t]+', ' ', 'g'), '\\n{SPACE}*\\n*', chr(10), 'g'), '^{SPACE}+|{SPACE}+$', '', 'g') as cleaned from g"""


@query(_CLEAN)
def clean_pages(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "sample_articles").select("row_no", text.clean_page(F.col("page1")).alias("cleaned"))


@query(
    """select row_no, regexp_replace(title, '[\\p{Latin}\\p{Nd}]+', '', 'g') as no_latin, trim(regexp_replace(title, '[\\t\\n\\x0B\\f\\r \\x{85}\\p{Z}\\x1c-\\x1f]+', ' ', 'g')) as collapsed,
    regexp_replace(regexp_replace(title, '[\\p{P}\\p{S}]+', '', 'g'), '[\\x{FE0F}\\x{200B}-\\x{200F}\\x{2060}]', '', 'g') as no_signs,
    case when length(title) > 30 then left(title, 30) || '…' else title end as short,
    regexp_matches(title, '[\\x{0600}-\\x{06FF}\\x{0750}-\\x{077F}\\x{08A0}-\\x{08FF}\\x{FB50}-\\x{FDFF}\\x{FE70}-\\x{FEFF}]') as arabic, regexp_matches(title, '[A-Za-z]') as latin,
    title is null or regexp_replace(title, '[\\t\\n\\x0B\\f\\r \\x{85}\\p{Z}]+', '', 'g') = '' as missing from sample_articles"""
)
def clean_titles(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("title")
    return load(spark, d, "sample_articles").select(
        "row_no", text.remove_latin_digits(t).alias("no_latin"), text.collapse(t).alias("collapsed"), text.remove_punctuation(t).alias("no_signs"), text.truncate(t).alias("short"),
        text.is_arabic(t).alias("arabic"), text.is_latin(t).alias("latin"), text.is_missing(t).alias("missing"),
    )


@query("select row_no, replace(replace(replace(replace(replace(replace(authors, '1', ''), ',2', ''), '*', ''), '&', ','), '/', ','), chr(8204), '') as authors from sample_articles")
def fix_author_cells(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "sample_articles").select("row_no", text.fix_author_cell(F.col("authors")).alias("authors"))


@query(
    """select row_no, split_part(path, '/', -1) as file, regexp_matches(path, '(?i)\\.pdf$') as is_pdf, nullif(regexp_extract(path, '(?:^|/)finalpdfs/([^/]*)', 1), '') as behind,
    case when source like 'NBA\\_%' escape '\\' then 'NBA' else source end as source, case when source like 'NBA\\_%' escape '\\' then substr(source, 5)
    when source = 'NBA' then nullif(regexp_extract(path, '(?:^|/)NBA/([^/]*)', 1), '') else general_field end as general_field from sample_articles"""
)
def path_and_source_parts(spark: SparkSession, d: str) -> DataFrame:
    rows = relational.split_source(load(spark, d, "sample_articles"), "NBA")
    p = F.col("path")
    return rows.select("row_no", F.element_at(F.split(p, "/"), -1).alias("file"), p.rlike(r"(?i)\.pdf$").alias("is_pdf"), text.segment_after(p, "finalpdfs").alias("behind"), "source", "general_field")


@query(
    """select row_no, case when regexp_matches(a, '[\\x{0600}-\\x{06FF}]') then a end as authors, case when not regexp_matches(a, '[\\x{0600}-\\x{06FF}]') then a end as authors_en
    from (select row_no, nullif(authors, '') as a from sample_articles)"""
)
def route_authors(spark: SparkSession, d: str) -> DataFrame:
    return relational.route_by_script(load(spark, d, "sample_articles").select("row_no", "authors")).select("row_no", "authors", "authors_en")


@query(
    r"""select row_no, regexp_replace(title, '[^0-9A-Za-z\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}\t\n\x0B\f\r _\-''.,()/\\]', '', 'g') as listed,
    regexp_replace(title, '[^\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}0-9.,;:!?()\[\]{}\-–—''"“”\t\n\x0B\f\r \x{85}\p{Z}]', '', 'g') as arabic_listed,
    regexp_replace(regexp_replace(regexp_replace(title, '[\t\x0B\f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', '', 'g'), ' +', ' ', 'g'), '^[\t\n\x0B\f\r \x{85}\p{Z}]+|[\t\n\x0B\f\r \x{85}\p{Z}]+$', '', 'g') as spaced,
    translate(regexp_replace(regexp_replace(regexp_replace(title, '[•●▪♦■★☆※…—–―‐\x{2022}\x{2023}\x{25A0}-\x{25FF}]', '', 'g'), '\.{3,}', '.', 'g'), '[_~^`]+|=', '', 'g'), '“”‘’', '""''''') as undecorated,
    trim(regexp_replace(authors, '[\t\n\x0B\f\r \\]*الباحث[\t\n\x0B\f\r \\]*', '', 'g'), ' ') as without_researcher from sample_articles"""
)
def listed_titles(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("title")
    return load(spark, d, "sample_articles").select(
        "row_no", text.whitelist(t).alias("listed"), text.arabic_whitelist(t).alias("arabic_listed"), text.clean_spaces(t).alias("spaced"), text.remove_decorative(t).alias("undecorated"), text.strip_researcher(F.col("authors")).alias("without_researcher")
    )


@query(
    """select row_no, array_to_string(list_filter(list_transform(list_filter(list_transform(string_split_regex(keywords, '[،,;؛|•]'), lambda x: trim(x, ' ')), lambda x: x <> ''), lambda x: regexp_replace(trim(x, ' '), '^["'']+|["'']+$', '', 'g')), lambda x: x <> ''), ', ') as joined,
    keywords is null or len(list_filter(list_transform(string_split_regex(keywords, '[،,;؛|•]'), lambda x: trim(x, ' ')), lambda x: x <> '')) = 0 as empty from sample_articles"""
)
def joined_keywords(spark: SparkSession, d: str) -> DataFrame:
    parts = lists.split_any(F.col("keywords"))
    return load(spark, d, "sample_articles").select("row_no", lists.joined(parts).alias("joined"), text.is_missing_list(parts).alias("empty"))


@query(
    """with u as (select row_no, article_id, 'https://x.test/a/download/' || row_no || '/' || article_id || case when row_no % 3 = 0 then '?article=' || article_id || '&v=1' else '' end as url from sample_articles)
    select row_no, row_no || '-' || article_id || '.pdf' as file, split_part(split_part(url, '?', 1), '/', -2) || '-' || split_part(split_part(url, '?', 1), '/', -1) || '.pdf' as tail,
    case when row_no % 3 = 0 then split_part(split_part(url, 'article=', 2), '&', 1) else 'unk' || row_no end as article from u"""
)
def address_names(spark: SparkSession, d: str) -> DataFrame:
    asked = F.when(F.col("row_no") % 3 == 0, F.concat(F.lit("?article="), F.col("article_id").cast("string"), F.lit("&v=1"))).otherwise(F.lit(""))
    url = F.concat(F.lit("https://x.test/a/download/"), F.col("row_no").cast("string"), F.lit("/"), F.col("article_id").cast("string"), asked)
    rows = load(spark, d, "sample_articles").select("row_no", url.alias("url"))
    return rows.select("row_no", text.pdf_name(F.col("url")).alias("file"), text.tail_name(F.col("url")).alias("tail"), text.query_value(F.col("url"), "article", F.concat(F.lit("unk"), F.col("row_no").cast("string"))).alias("article"))


@query(
    """select row_no, coalesce(trim(title, ' '), '') as title, coalesce(trim(abstract_ar, ' '), '') as abstract_ar, coalesce(trim(general_field, ' '), '') as general_field
    from sample_articles where coalesce(title, abstract_ar, general_field) is not null"""
)
def model_replies(spark: SparkSession, d: str) -> DataFrame:
    reply = F.concat(F.lit("Here it is:\n"), F.to_json(F.struct("title", "abstract_ar", "general_field")), F.lit("\nDone."))
    rows = load(spark, d, "sample_articles").select("row_no", lists.pages_reply(reply).alias("r")).filter("r is not null")
    return rows.select("row_no", "r.title", "r.abstract_ar", "r.general_field")


@query("select row_no, coalesce(title, '') as title, coalesce(keywords, '') as keywords from sample_articles")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = f"{ensure_checkpoint_dir(spark)}/{uuid4().hex}"
    files.write_csv(load(spark, d, "sample_articles").select("row_no", "title", "keywords"), path, quote_all=True)
    back = files.read_csv(spark, path, ["row_no", "title", "keywords"])
    return back.select(F.col("row_no").cast("bigint").alias("row_no"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("keywords", F.lit("")).alias("keywords"))


_DATE = """
with a as (select row_no, translate(trim(publish_date), '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789') as t from sample_articles)
select row_no, coalesce(cast(try_strptime(nullif(regexp_extract(t, '^(\\d{4}-\\d{1,2}-\\d{1,2})', 1), ''), '%Y-%m-%d') as date),
 cast(try_strptime(nullif(replace(regexp_extract(t, '^(\\d{1,2}[/.]\\d{1,2}[/.]\\d{4})$', 1), '.', '/'), ''), '%d/%m/%Y') as date),
 make_date(cast(nullif(regexp_extract(t, '(?:^|\\D)((?:19|20)\\d{2})(?:\\D|$)', 1), '') as integer), 1, 1)) as published from a"""


@query(_DATE)
def publish_dates(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "sample_articles").select("row_no", text.publish_date(F.col("publish_date")).alias("published"))


@query(
    """select row_no, coalesce(len(p), 0) as n_values, coalesce(array_to_string(p, ' | '), '') as joined from (select row_no,
    case when trim(regexp_replace(trim(keywords), '^\\[|\\]$', '', 'g')) = '' then [] else list_filter(list_transform(string_split(regexp_replace(trim(keywords), '^\\[|\\]$', '', 'g'), ','),
    lambda x: regexp_replace(trim(x), '^["'']+|["'']+$', '', 'g')), lambda x: x <> '') end as p from sample_articles)"""
)
def parse_bracket_lists(spark: SparkSession, d: str) -> DataFrame:
    parts = lists.bracket_list(F.col("keywords"))
    return load(spark, d, "sample_articles").select("row_no", F.size(parts).cast("bigint").alias("n_values"), F.array_join(parts, " | ").alias("joined"))


@query(
    """select id, coalesce(list_sum(v), 0)::bigint as total, coalesce(len(v), 0) as n_ids from (select id, list_transform(list_filter(list_transform(string_split(regexp_replace(articles_ids, '[\\[\\]]', '', 'g'), ','), lambda x: trim(x)),
    lambda x: regexp_matches(x, '^[0-9]+$')), lambda x: cast(x as bigint)) as v from authors06)"""
)
def parse_int_lists(spark: SparkSession, d: str) -> DataFrame:
    ids = lists.int_list(F.col("articles_ids"))
    return load(spark, d, "authors06").select("id", F.aggregate(ids, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), F.size(ids).cast("bigint").alias("n_ids"))


@query("select row_no, coalesce(json_extract_string(try_cast(authors_en as json), '$[0]'), '') as first_name, coalesce(json_array_length(try_cast(authors_en as json)), 0)::bigint as n_names from sample_articles")
def parse_json_lists(spark: SparkSession, d: str) -> DataFrame:
    names = lists.literal_list(F.col("authors_en"))
    return load(spark, d, "sample_articles").select("row_no", F.coalesce(F.get(names, F.lit(0)), F.lit("")).alias("first_name"), F.size(names).cast("bigint").alias("n_names"))


_STEM_PREFIX = """case when regexp_matches(w, '^(?:وال|بال|كال|فال|لل|ال).{2,}') and regexp_replace(w, '^(?:وال|بال|كال|فال|لل|ال)(.{2,})$', '\\1') <> w then regexp_replace(w, '^(?:وال|بال|كال|فال|لل|ال)(.{2,})$', '\\1')
 when regexp_matches(w, '^و.{3,}') then substr(w, 2) else w end"""


def _stem_only() -> str:
    """The light stem of a word ``w``."""
    stem = _STEM_PREFIX
    for s in text.SUFFIXES:
        stem = f"regexp_replace({stem}, '(..){s}$', '\\1')"
    return stem


def _stops() -> str:
    return ", ".join(f"'{w}'" for w in text.STOPWORDS)


def _stem_sql() -> str:
    stem, stop = _stem_only(), _stops()
    return f"""with a as (select doc_id, unnest(string_split(trim(regexp_replace(regexp_replace(text, '[\\x{{064B}}-\\x{{0652}}]', '', 'g'), '[\\t\\n\\x0B\\f\\r \\x{{85}}\\p{{Z}}\\x1c-\\x1f]+', ' ', 'g')), ' ')) as w from documents where text is not null)
    select stem, count(*) as n from (select {stem} as stem from a where w <> '') where stem not in ({stop}) and stem <> '' group by stem"""


@query(_stem_sql())
def stem_counts(spark: SparkSession, d: str) -> DataFrame:
    # words are counted before they are stemmed, so each is stemmed once
    words = load(spark, d, "documents").select(F.explode(text.words(text.strip_tashkeel(F.col("text")))).alias("w")).groupBy("w").agg(F.count("*").alias("k"))
    stems = words.select(text.light_stem(F.col("w")).alias("stem"), "k").groupBy("stem").agg(F.sum("k").alias("n"), F.max("stem").alias("_s"))
    # the filter asks an aggregate, or it would be pushed below the count and stem every occurrence
    return stems.filter(~F.col("_s").isin(*text.STOPWORDS) & (F.col("_s") != "")).drop("_s")


_BLANK = "[\\t\\n\\x0B\\f\\r \\x{85}\\p{Z}\\x1c-\\x1f]+"
_BARE = "regexp_replace(regexp_replace(regexp_replace({}, '[\\p{{Latin}}\\p{{Nd}}]+', '', 'g'), '[\\p{{P}}\\p{{S}}]+', '', 'g'), '[\\x{{FE0F}}\\x{{200B}}-\\x{{200F}}\\x{{2060}}]', '', 'g')"


@query(
    f"""with a as (select doc_id, translate(replace(regexp_replace(trim(regexp_replace({_BARE.format("coalesce(text, '')")}, '{_BLANK}', ' ', 'g')), '[\\x{{064B}}-\\x{{0652}}]', '', 'g'), 'ـ', ''), 'أإآىئة', 'اااييه') as t from documents),
    b as (select doc_id, list_filter(list_transform(list_filter(string_split(trim(regexp_replace(t, '{_BLANK}', ' ', 'g')), ' '), lambda x: x <> ''), lambda w: {_stem_only()}), lambda x: x <> '') as stems from a)
    select doc_id, array_to_string(list_filter(stems, lambda x: not list_contains([{_stops()}], x)), ' ') as tokens from b"""
)
def index_pipeline(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", F.array_join(text.index_tokens(F.col("text")), " ").alias("tokens"))


@query(
    """select row_no, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(__NFKC__, '\\r\\n?', chr(10), 'g'),
    '\\p{Cf}', '', 'g'), '[•●▪♦■★☆※…\\x{2010}-\\x{2043}]', '', 'g'), '\\.{3,}', '.', 'g'), '={2,}|[_~^`]+', '', 'g'), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'),
    '^[\\t\\n\\x0B\\f\\r \\x{85}\\p{Z}]+|[\\t\\n\\x0B\\f\\r \\x{85}\\p{Z}]+$', '', 'g') as cleaned from sample_articles""".replace("__NFKC__", _compatible_sql("coalesce(page2, '')"))
)
def model_ready_pages(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "sample_articles").select("row_no", text.model_cleanup(F.col("page2")).alias("cleaned"))


_WORDS = "len(list_filter(string_split(trim(regexp_replace(coalesce({}, ''), '[\\t\\n\\x0B\\f\\r \\x{{85}}\\p{{Z}}\\x1c-\\x1f]+', ' ', 'g')), ' '), lambda x: x <> ''))"


@query(f"select count(*) as n_rows, count(*) filter (where t >= 400) as kept, count(*) filter (where t < 400) as removed, round(avg(t), 6) as mean_tokens from (select 2 * {_WORDS.format('page1')} + 2 * {_WORDS.format('page2')} as t from sample_articles)")
def token_filter(spark: SparkSession, d: str) -> DataFrame:
    t = text.token_estimate(F.col("page1")) + text.token_estimate(F.col("page2"))
    return load(spark, d, "sample_articles").select(t.alias("t")).agg(F.count("*").alias("n_rows"), F.count_if(F.col("t") >= 400).alias("kept"), F.count_if(F.col("t") < 400).alias("removed"), F.round(F.avg("t"), 6).alias("mean_tokens"))


@query("select name, piece, count(*) as article_count, array_to_string(list_sort(list(article_id)), ',') as article_ids from (select article_id, cast(floor(article_id / 100000) as bigint) as piece, trim(unnest(from_json(authors_en, '[\"VARCHAR\"]'))) as name from sample_articles where authors_en like '[%') where name <> '' group by name, piece")
def inverted_index(spark: SparkSession, d: str) -> DataFrame:
    names = load(spark, d, "sample_articles").filter("authors_en like '[%'").select("article_id", F.explode(lists.literal_list(F.col("authors_en"))).alias("raw")).select("article_id", F.trim("raw").alias("name"))
    piece = F.floor(F.col("article_id") / registry.SPAN).cast("bigint").alias("piece")
    rows = names.filter("name <> ''").groupBy("name", piece).agg(F.count("*").alias("article_count"), F.array_sort(F.collect_list("article_id")).alias("ids"))
    return rows.select("name", "piece", "article_count", F.array_join(F.col("ids").cast("array<string>"), ",").alias("article_ids"))


@query("select source, row_number() over (order by source) as place from (select distinct source from sample_articles where source is not null)")
def distinct_sources(spark: SparkSession, d: str) -> DataFrame:
    sources = load(spark, d, "sample_articles").select("source").filter("source is not null").distinct()
    return relational.numbered(sources, [F.col("source")], "place")


@query("select author_id, articles_count from (select author_id, count(distinct article_id) as articles_count from author_links where author_id is not null group by author_id) order by articles_count desc, author_id limit 5")
def busiest_authors(spark: SparkSession, d: str) -> DataFrame:
    return registry.author_stats(load(spark, d, "author_links")).select("author_id", "articles_count").orderBy(F.col("articles_count").desc(), "author_id").limit(5)


@query("select round(avg(n), 6) as authors_per_article, (select round(avg(m), 6) from (select count(distinct article_id) as m from author_links where author_id is not null group by author_id)) as articles_per_author from (select count(distinct author_id) as n from author_links where author_id is not null group by article_id)")
def link_means(spark: SparkSession, d: str) -> DataFrame:
    links = load(spark, d, "author_links").filter("author_id is not null").select("article_id", "author_id").distinct()
    per_article = links.groupBy("article_id").count().agg(F.round(F.avg("count"), 6).alias("authors_per_article"))
    per_author = links.groupBy("author_id").count().agg(F.round(F.avg("count"), 6).alias("articles_per_author"))
    # a row each
    return per_article.join(F.broadcast(per_author))


@query("select article_id, loaded_at, row_no from (select article_id, max(loaded_at) as loaded_at, max(row_no) as row_no, count(*) as n from sample_articles group by article_id) where n > 1")
def repeated_deliveries(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "sample_articles").groupBy("article_id").agg(F.max("loaded_at").alias("loaded_at"), F.max("row_no").alias("row_no"), F.count("*").alias("n"))
    return rows.filter("n > 1").select("article_id", "loaded_at", "row_no")


@query("select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n from events group by 1, 2")
def hourly_events(spark: SparkSession, d: str) -> DataFrame:
    from warraq.streaming.ingest import windowed_counts

    return windowed_counts(load(spark, d, "events"))


# merging, resuming, chunks, samples


@query("select row_no, case when trim(title) = '' or title is null then title_x else title end as title, case when trim(keywords) = '' or keywords is null then kw_x else keywords end as keywords from (select *, 'untitled' as title_x, 'none given' as kw_x from sample_articles)")
def fill_missing(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "sample_articles").select("row_no", "title", "keywords", F.lit("untitled").alias("title_x"), F.lit("none given").alias("kw_x"))
    return relational.prefer_existing(rows, {"title": "title_x", "keywords": "kw_x"})


@query("select count(*) as n_rows, count(*) filter (where title is null or trim(title) = '' or abstract_ar is null or trim(abstract_ar) = '' or keywords is null or trim(keywords) = '') as incomplete from sample_articles")
def incomplete_rows(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "sample_articles").agg(F.count("*").alias("n_rows"), F.count_if(relational.needs_extraction(["title", "abstract_ar", "keywords"])).alias("incomplete"))


@query("select row_no, article_id from sample_articles where article_id not in (select article_id from author_links where article_id is not null)")
def unlinked_articles(spark: SparkSession, d: str) -> DataFrame:
    return relational.resume(load(spark, d, "sample_articles").select("row_no", "article_id"), load(spark, d, "author_links"), "article_id")


@query("select distinct author_id as id from author_links where author_id is not null and author_id not in (select id from authors06)")
def orphan_authors(spark: SparkSession, d: str) -> DataFrame:
    return relational.orphans(load(spark, d, "author_links"), "author_id", load(spark, d, "authors06"), "id")


@query("select row_no, cast(floor((row_number() over (order by row_no) - 1) / 200) as bigint) as chunk from sample_articles")
def chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    return relational.chunked(load(spark, d, "sample_articles").select("row_no"), [F.col("row_no")], 200)


@query("select row_no, row_number() over (order by md5(concat_ws('|', '42', cast(row_no as varchar))), row_no) <= (select ceil(count(*) * 0.2) from sample_articles) as is_test from sample_articles")
def split_train_test(spark: SparkSession, d: str) -> DataFrame:
    return relational.train_test(load(spark, d, "sample_articles").select("row_no"), "42", "row_no")


@query("select doc_id from documents order by md5(concat_ws('|', '7', cast(doc_id as varchar))), doc_id limit 25")
def sample_documents(spark: SparkSession, d: str) -> DataFrame:
    return relational.sample_rows(load(spark, d, "documents").select("doc_id"), 25, "7", "doc_id")


@query("select row_no, article_id, loaded_at from (select *, row_number() over (partition by article_id order by loaded_at desc nulls last, row_no desc) as rn from sample_articles) where rn = 1")
def latest_deliveries(spark: SparkSession, d: str) -> DataFrame:
    return registry.latest(load(spark, d, "sample_articles"), "article_id", "loaded_at", "row_no").select("row_no", "article_id", "loaded_at")


# profiles


@query("select column_name, dtype, non_null, n_rows, 3 as n_columns from (" + " union all ".join(f"select '{c}' as column_name, '{t}' as dtype, count({c}) as non_null, count(*) as n_rows from documents" for c, t in (("doc_id", "bigint"), ("text", "string"), ("n_chars", "bigint"))) + ")")
def table_info(spark: SparkSession, d: str) -> DataFrame:
    return profile.table_info(load(spark, d, "documents").select("doc_id", "text", "n_chars"))


@query("select 'row_no' as column_name, count(*) - count(row_no) as nulls, count(*) as n_rows from sample_articles union all " + " union all ".join(f"select '{c}', count(*) - count({c}), count(*) from sample_articles" for c in ("title", "abstract_ar", "authors", "keywords", "page1", "page2", "source")))
def count_nulls(spark: SparkSession, d: str) -> DataFrame:
    return profile.null_counts(load(spark, d, "sample_articles").select("row_no", "title", "abstract_ar", "authors", "keywords", "page1", "page2", "source"))


@query("select * from (" + " union all ".join(f"select '{c}' as column_name, round(100.0 * (count(*) - count({c})) / count(*), 6) as pct from documents" for c in ("text", "lang", "source", "article_id", "general_field", "doc_kind")) + ") where pct > 0")
def missing_percentages(spark: SparkSession, d: str) -> DataFrame:
    rows = profile.missing_share(load(spark, d, "documents").select("text", "lang", "source", "article_id", "general_field", "doc_kind"))
    return rows.select("column_name", F.round("pct", 6).alias("pct"))


@query("select lang as value, count(*) as n from documents where lang is not null group by lang")
def language_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return profile.value_counts(load(spark, d, "documents"), "lang")


@query("select cast(count(*) - (select count(*) from (select distinct * from author_links)) as bigint) as n_duplicates from author_links")
def duplicate_links(spark: SparkSession, d: str) -> DataFrame:
    return profile.duplicate_rows(load(spark, d, "author_links"))


@query("select count(n_chars) as n, round(avg(n_chars), 6) as mean, round(stddev_samp(n_chars), 6) as std, min(n_chars) as lo, quantile_cont(n_chars, 0.25) as q25, quantile_cont(n_chars, 0.5) as q50, quantile_cont(n_chars, 0.75) as q75, max(n_chars) as hi from documents")
def describe_lengths(spark: SparkSession, d: str) -> DataFrame:
    return profile.describe(load(spark, d, "documents"), "n_chars").withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("with s as (select min(l) as lo, max(l) as hi from (select length(abstract_ar) as l from sample_articles)) select cast(case when hi = lo then 1 else least(floor((l - lo) / ((hi - lo) / 20.0)) + 1, 20) end as integer) as bin, count(*) as n from (select length(abstract_ar) as l from sample_articles), s where l is not null group by 1")
def abstract_histogram(spark: SparkSession, d: str) -> DataFrame:
    return profile.histogram(load(spark, d, "sample_articles").select(F.length("abstract_ar").alias("l")), "l", 20)


@query(
    """with q as (select quantile_cont(articles_count, 0.25) as q1, quantile_cont(articles_count, 0.5) as median, quantile_cont(articles_count, 0.75) as q3 from authors06)
    select q1, median, q3, min(articles_count) filter (where articles_count between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as low, max(articles_count) filter (where articles_count between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as high,
    round(avg(articles_count), 6) as mean from authors06, q where articles_count is not null group by q1, median, q3"""
)
def author_box(spark: SparkSession, d: str) -> DataFrame:
    return profile.box(load(spark, d, "authors06"), "articles_count").withColumn("mean", F.round("mean", 6))


_FIELD_CASE = "case lower(trim(replace(general_field, '_', ' '))) " + " ".join(f"when '{k}' then '{v}'" for k, v in ({s.lower(): s for s in SUBJECTS} | FIELD_NAMES).items()) + " end"
_SOURCE_CASE = "case when source is null or lower(trim(source)) in ('', '-', 'nan', 'none', 'null', 'n/a', 'unknown') then null else upper(regexp_replace(trim(source), '_[0-9A-Za-z_]{2,4}$', '')) end"


@query(f"select source, general_field, count(*) as n from (select coalesce(m.acronym, k) as source, f as general_field from (select {_SOURCE_CASE} as k, {_FIELD_CASE} as f from documents) d left join source_map m on d.k = upper(trim(m.acronym))) group by 1, 2")
def dimension_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select("source", "general_field")
    rows = canonical_source(docs, "source", load(spark, d, "source_map")).withColumn("general_field", general_field(F.col("general_field")))
    return rows.groupBy("source", "general_field").agg(F.count("*").alias("n"))


# authors


_AR = registry.AR_TITLES.replace("'", "''")
_NAME = f"regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(trim(author), '{_AR}', ''), '[_*()\\[\\]\\p{{Nd}}]', '', 'g')), '{registry.EN_TITLES}', ''), '[\\t\\n\\x0B\\f\\r \\x{{85}}\\p{{Z}}]+', ' ', 'g')"


@query(
    """with l as (select distinct author_id, article_id from author_links where author_id is not null and article_id is not null), c as (select author_id, count(*) as articles_count from l group by 1)
    select author_id, piece, articles_count, articles_ids from (select author_id, cast(floor(article_id / 100000) as bigint) as piece, array_to_string(list_sort(list(article_id)), ',') as articles_ids from l group by 1, 2) join c using (author_id)"""
)
def author_statistics(spark: SparkSession, d: str) -> DataFrame:
    links = load(spark, d, "author_links")
    pieces = registry.author_articles(links).join(registry.author_stats(links), "author_id")
    return pieces.select("author_id", "piece", "articles_count", F.array_join(F.col("articles_ids").cast("array<string>"), ",").alias("articles_ids"))


_FULL_NAMES = "list_concat(list_filter(list_transform(string_split_regex(coalesce(authors, ''), '[،,;؛|•]'), lambda x: trim(x, ' ')), lambda x: x <> ''), coalesce(try_cast(try_cast(authors_en as json) as varchar[]), []))"


@query(
    f"""with a as (select row_no, {_FULL_NAMES} as names from sample_articles), e as (select row_no, unnest(names) as author, generate_subscripts(names, 1) as at_no from a),
    n as (select row_no, at_no, case when length(trim({_NAME})) >= 3 then trim({_NAME}) end as name from e), k as (select row_no, at_no, name from n where name is not null),
    r as (select name, format('AUTH_{{:05d}}', row_number() over (order by s, p, name)) as id from (select name, min(row_no) as s, arg_min(at_no, row_no * 1000000 + at_no) as p from k group by name)),
    o as (select row_no, id, min(at_no) as at_no from k join r using (name) group by 1, 2)
    select s.row_no, coalesce(x.ids, '') as author_ids from sample_articles s left join (select row_no, string_agg(id, ',' order by at_no) as ids from o group by 1) x using (row_no)"""
)
def article_author_ids(spark: SparkSession, d: str) -> DataFrame:
    names = F.concat(lists.split_any(F.coalesce("authors", F.lit(""))), lists.literal_list(F.col("authors_en")))
    articles = load(spark, d, "sample_articles").select("row_no", names.alias("names"))
    seen = articles.select("row_no", F.posexplode("names").alias("at", "raw")).select("row_no", "at", registry.clean_name(F.col("raw")).alias("name"))
    known = registry.register(seen, ["row_no", "at"])
    return registry.author_ids(articles, "names", known, "row_no").select("row_no", F.array_join("author_ids", ",").alias("author_ids"))




@query(f"select format('AUTH_{{:05d}}', row_number() over (order by seen, name)) as id, name from (select name, min(rec_id) as seen from (select rec_id, case when length(trim({_NAME})) >= 3 then trim({_NAME}) end as name from authors) where name is not null group by name)")
def author_registry(spark: SparkSession, d: str) -> DataFrame:
    names = load(spark, d, "authors").select("rec_id", registry.clean_name(F.col("author")).alias("name"))
    return registry.register(names, ["rec_id"])


@query("select coalesce(a.name, 'Unknown (' || l.author_id || ')') as name, count(*) as n from (select coalesce(author_id, 'N/A') as author_id from author_links) l left join authors06 a on a.id = l.author_id group by 1")
def named_links(spark: SparkSession, d: str) -> DataFrame:
    links = load(spark, d, "author_links").select(F.coalesce("author_id", F.lit("N/A")).alias("author_id"))
    # counted before the join: one author holds a tenth of all links
    counted = links.groupBy("author_id").agg(F.count("*").alias("k"))
    joined = counted.join(load(spark, d, "authors06").select("id", "name"), counted["author_id"] == F.col("id"), "left")
    return joined.groupBy(F.coalesce("name", F.concat(F.lit("Unknown ("), "author_id", F.lit(")"))).alias("name")).agg(F.sum("k").alias("n"))


_U = "(('0x' || substr(md5({}), 1, 8))::bigint / 4294967296.0)"
_PLACES = ", ".join(f"cast(floor({_U.format(f"concat_ws('|', '42|{i}', cast(article_id as varchar))")} * size) as bigint) + 1" for i in range(16))


@query(
    f"""with p as (select id as author_id, row_number() over (order by id) as n from authors06), s as (select count(*) as size from p),
    a as (select distinct article_id from sample_articles where authors is null or trim(authors) in ('', '[]', 'nan', 'None')),
    d as (select article_id, {_U.format("concat_ws('|', '42', cast(article_id as varchar))")} as u, [{_PLACES}] as places from a, s),
    e as (select article_id, list_slice(list_transform(list_sort(list_transform(list_distinct(places), lambda x: list_position(places, x))), lambda x: places[x]), 1, case when u < 0.6 then 1 when u < 0.9 then 2 when u < 0.98 then 3 else 4 end) as chosen from d),
    f as (select article_id, unnest(chosen) as n, generate_subscripts(chosen, 1) as author_pos from e)
    select f.article_id, p.author_id, cast(f.author_pos as integer) as author_pos from f join p on p.n = f.n"""
)
def imputed_links(spark: SparkSession, d: str) -> DataFrame:
    nobody = F.col("authors").isNull() | F.trim("authors").isin("", "[]", "nan", "None")
    articles = load(spark, d, "sample_articles").filter(nobody).select("article_id").distinct()
    return registry.impute(articles, load(spark, d, "authors06").select(F.col("id").alias("author_id")))


# retrieval


@query("select term, count(*) as df, sum(tf)::bigint as tf from (select row_no, term, count(*) as tf from (select row_no, unnest(regexp_extract_all(lower(abstract_ar), '[\\p{L}\\p{N}_]{2,}')) as term from sample_articles) group by 1, 2) group by term having count(*) >= 2")
def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    counts = retrieval.term_counts(load(spark, d, "sample_articles"), "row_no", "abstract_ar")
    return counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")).filter("df >= 2")


_KEPT = "list_transform(string_split(regexp_replace(trim(keywords), '^\\[|\\]$', '', 'g'), ','), lambda x: regexp_replace(trim(x), '^[\"'']+|[\"'']+$', '', 'g'))"
_COMBINED = f"abstract_ar || ' ' || coalesce(case when trim(regexp_replace(trim(keywords), '^\\[|\\]$', '', 'g')) = '' then '' else array_to_string({_KEPT}, ' ') end, '')"
_TERMS = f"""
x as (select row_no, unnest(string_split(trim(regexp_replace({_COMBINED}, '[\\t\\n\\x0B\\f\\r \\x{{85}}\\p{{Z}}\\x1c-\\x1f]+', ' ', 'g')), ' ')) as w from sample_articles),
y as (select row_no, {_stem_only()} as stem from x where w <> ''),
c as (select row_no, term, count(*) as tf from (select row_no, unnest(regexp_extract_all(lower(stem), '[\\p{{L}}\\p{{N}}_]{{2,}}')) as term from y where stem not in ({_stops()})) group by 1, 2)"""
_NEIGHBOURS = f"""
with {_TERMS},
train as (select row_no from sample_articles where row_no % 20 <> 0), test as (select row_no as query_no from sample_articles where row_no % 20 = 0),
v as (select term, count(*) as df from c where row_no % 20 <> 0 group by term having count(*) >= 2), n as (select count(*) as n from train),
r as (select row_no, c.term, (1 + ln(tf)) * (ln((1.0 + n) / (1.0 + df)) + 1) as raw from c join v on c.term = v.term, n),
w as (select row_no, term, raw / sqrt(sum(raw * raw) over (partition by row_no)) as w from r),
s as (select q.row_no as query_no, d.row_no, sum(q.w * d.w) as score from w q join w d on q.term = d.term where q.row_no % 20 = 0 and d.row_no % 20 <> 0 group by 1, 2),
p as (select query_no, row_no, 0.0 as score from test, (select row_no from train order by row_no limit 40)),
u as (select * from s union all select * from p anti join s using (query_no, row_no)),
k as (select *, row_number() over (partition by query_no order by round(score, 9) desc, row_no) as rank from u)"""


@query(_NEIGHBOURS + "\nselect query_no, rank, round(score, 6) as score from k where rank <= 20")
def similar_abstracts(spark: SparkSession, d: str) -> DataFrame:
    return _similar(spark, d).select("query_no", "rank", F.round("score", 6).alias("score"))


def _similar(spark: SparkSession, d: str, k: int = 20) -> DataFrame:
    combined = text.combined_text(F.col("abstract_ar"), lists.bracket_list(F.col("keywords"), keep_empty=True))
    docs = load(spark, d, "sample_articles").select("row_no", text.retrieval_text(combined).alias("prepared"))
    return retrieval.neighbours(docs, "row_no", "prepared", F.col("row_no") % 20 == 0, k)


@query()
def root_counts(spark: SparkSession, d: str) -> DataFrame:
    tokens = text.words(text.remove_punctuation(text.remove_latin_digits(F.col("abstract_ar"))))
    # tokens are counted before Python sees them, so each is taken to its root once
    counted = load(spark, d, "sample_articles").select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("k"))
    return counted.select(roots(F.array("token"))[0].alias("root"), "k").groupBy("root").agg(F.sum("k").alias("n"))


@query(f"select row_no, regexp_replace({_compatible_sql('title')}, '\\p{{Cf}}', '', 'g') as title from sample_articles")
def compatible_titles(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "sample_articles").select("row_no", compatible(F.col("title")).alias("title"))


_RECOMMENDED = f"""{_NEIGHBOURS.replace("with ", "with recursive ", 1)},
l as (select article_id, list_sort(list(distinct author_id)) as authors from author_links where author_id is not null group by article_id),
m as (select k.query_no, k.rank, k.score, coalesce(l.authors, []) as authors from k join sample_articles a on a.row_no = k.row_no left join l on l.article_id = a.article_id where k.rank <= 20),
z as (select query_no, 1::bigint as rank, score, authors as pool, 0::bigint as tie from m where rank = 1
 union all select z.query_no, m.rank, z.score,
 case when len(z.pool) > 1 and len(list_intersect(z.pool, m.authors)) > 0 then list_sort(list_intersect(z.pool, m.authors)) else z.pool end,
 case when len(z.pool) > 1 and len(list_intersect(z.pool, m.authors)) = 1 then m.rank else z.tie end from z join m on m.query_no = z.query_no and m.rank = z.rank + 1),
e as (select query_no, max(rank) as last from z group by 1),
f as (select z.query_no, z.score, z.pool, z.tie, b.authors as anchor from z join e on z.query_no = e.query_no and z.rank = e.last join m b on b.query_no = z.query_no and b.rank = 1),
chosen as (select query_no, case when score = 0 or len(anchor) = 0 then null when len(pool) = 1 then pool[1] else list_sort(list_transform(pool, lambda a: md5(concat_ws('|', '42', cast(query_no as varchar), a)) || a))[1][33:] end as winner,
 case when score = 0 then 'No Matches' when len(anchor) = 0 then 'No Candidates' when len(anchor) = 1 then 'Direct Match' when tie > 0 then 'Tie broken by rank ' || cast(tie as varchar) else 'Random Fallback (Tie)' end as method from f)"""


@query(
    _RECOMMENDED
    + """,
nm as (select id, name from authors06), act as (select distinct a.row_no as query_no, al.author_id from sample_articles a join author_links al on al.article_id = a.article_id where al.author_id is not null),
own as (select query_no, list_sort(list(distinct coalesce(name, 'Unknown (' || author_id || ')'))) as actual, list(author_id) as ids from act left join nm on nm.id = author_id group by 1)
select c.query_no, coalesce(nm.name, case when winner is null then 'N/A' else 'Unknown (' || winner || ')' end) as recommended, coalesce(array_to_string(own.actual, ' | '), '') as actual, coalesce(list_contains(own.ids, winner), false) as hit
from chosen c left join nm on nm.id = c.winner left join own on own.query_no = c.query_no"""
)
def reviewer_summaries(spark: SparkSession, d: str) -> DataFrame:
    ids = load(spark, d, "sample_articles").select(F.col("row_no").alias("query_no"), "article_id")
    links = load(spark, d, "author_links").filter("author_id is not null").select("article_id", "author_id").distinct()
    actual = ids.join(links, "article_id").select("query_no", "author_id")
    rows = retrieval.reviewer_summary(recommended_reviewers(spark, d), actual, load(spark, d, "authors06").select("id", "name"), "query_no")
    return rows.withColumn("actual", F.array_join("actual", " | "))


@query(_RECOMMENDED + "\nselect query_no, winner, method from chosen")
def recommended_reviewers(spark: SparkSession, d: str) -> DataFrame:
    ranked = _similar(spark, d)
    ids = load(spark, d, "sample_articles").select("row_no", "article_id")
    links = load(spark, d, "author_links").filter("author_id is not null").select("article_id", "author_id").distinct().groupBy("article_id").agg(F.array_sort(F.collect_list("author_id")).alias("authors"))
    known = ranked.join(ids, "row_no").join(links, "article_id", "left").withColumn("authors", F.coalesce("authors", F.array().cast("array<string>")))
    return retrieval.choose_reviewer(known.select("query_no", "rank", "score", "authors"), "query_no")


@query(
    """with s as (select q.vec_id as query_id, d.vec_id as id, list_cosine_similarity(q.embedding::double[], d.embedding::double[]) as score from embeddings q, embeddings d where q.vec_id % 20 = 0 and q.vec_id <> d.vec_id),
    k as (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from s) select query_id, rank, round(score, 6) as score from k where rank <= 10"""
)
def similar_vectors(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings")
    return retrieval.dense_neighbours(e.filter("vec_id % 20 = 0"), e, 10).select("query_id", "rank", F.round("score", 6).alias("score"))


# extraction: patterns that SQL dialects don't share; tests hold them against plain versions


_EDGE = "^[\\t\\n\\x0B\\f\\r \\x{85}\\p{Z}]+|[\\t\\n\\x0B\\f\\r \\x{85}\\p{Z}]+$"
_P = extraction.STRICT
_FULL_SQL = f"""
p as (select row_no, regexp_replace(coalesce(page1, ''), '{_EDGE}', '', 'g') as p1, regexp_replace(coalesce(page2, ''), '{_EDGE}', '', 'g') as p2 from sample_articles),
h as (select *, left(trim(regexp_extract(left(p1, 40), '^([^\\n]*)', 1)), 20) as head from p),
t as (select row_no, p1 || ' ' || chr(10) || ' ' || case when length(p1) > 20 and length(p2) > 20 and head <> '' and starts_with(lower(p2), lower(head)) and contains(p2, chr(10))
 then regexp_replace(substr(p2, strpos(p2, chr(10)) + 1), '{_EDGE.split("|")[0]}', '') else p2 end as body from h),
f as (select row_no, body, translate(lower(translate(body, 'İ', 'i')), 'أإآةىئ', 'اااهيي') as folded from t)"""


def _q(pattern: str) -> str:
    """A pattern inside an SQL text."""
    return pattern.replace("'", "''")


def _before(column: str, pattern: str) -> str:
    """What stands before the first match of a pattern."""
    return f"regexp_extract({column}, '(?s)\\A(.*?)(?:{_q(pattern)}|\\z)', 1)"


_TIDY = "regexp_replace(regexp_replace({}, '{}', '', 'g'), '\\A[:\\-.]+[\\t\\n\\x0B\\f\\r \\x{{85}}\\p{{Z}}]*', '')"
_SUM = "coalesce(list_sum(list_transform({}, lambda x: length(x))), 0)::bigint"
_KEYWORDS_SQL = f"""with {_FULL_SQL},
m as (select row_no, body, regexp_extract_all(folded, '{_q(extraction.keyword_line())}') as found, string_split_regex(folded, '{_q(extraction.keyword_line())}') as pieces from f),
c as (select row_no, body, unnest(found) as m, generate_subscripts(found, 1) as i, found, pieces from m),
d as (select row_no, body, m, i, {_SUM.format("pieces[1:i]")} + {_SUM.format("found[1:i-1]")} + 1 as start, length(regexp_extract(m, '\\A(?s:.?){_q(_P.keyword_start)}(?s:.{{0,4}}?\\n)?')) as head from c),
e as (select row_no, i, {_TIDY.format(f"substr(body, start + head, length(case when left(m, 1) = '(' then {_before('substr(m, head + 1)', _P.stop + '|' + _P.header + '|[)]')} else {_before('substr(m, head + 1)', _P.stop + '|' + _P.header)} end))", _EDGE)} as raw from d),
b as (select row_no, arg_max(raw, i) as raw from e where length(raw) > 3 group by row_no),
k as (select row_no, list_filter(list_transform(string_split_regex(raw, '[،,;؛|•]'), lambda x: regexp_replace(trim(x, ' '), '^[.\\-:()\\[\\]]+|[.\\-:()\\[\\]]+$', '', 'g')), lambda x: length(x) > 2 and length(x) < 100 and not regexp_matches(x, '^\\p{{Nd}}+$')) as kept from b)
select s.row_no, case when len(kept) > 0 then array_to_string(kept, ' | ') end as keywords from sample_articles s left join k using (row_no)"""

_CUT = "case when length({0}) < length({1}) then length({0}) else least(length({1}), 1000) end"
_WINDOW_STOP = _P.keyword_start + "|" + _P.stop
_IN, _OUT = WORD[1:-1], f"[^{WORD[1:-1]}]"
_NOISE = extraction.skeleton("و")
_ROOTS = [extraction.skeleton(v) for v in extraction.PURPOSE_VERBS]
#: A word border before a verb, without looking around: the verb starts with a letter behind none, or with noise behind a letter.
_STARTING = "|".join(f"(?:[اوي_]{_NOISE})?{v.removeprefix(_NOISE)}" if v.startswith(_NOISE) else v for v in _ROOTS)
_ENDING = "|".join(rf"[\t\n\x0B\f\r \-.+*]{v}" for v in _ROOTS if v.startswith(_NOISE))
_FIRST_VERB = f"(?s)\\A((?:.*?{_OUT})??)(?:{_STARTING})"
_LATER_VERB = f"(?s)\\A(.*?[{_IN}])(?:{_ENDING})"
_ABSTRACTS_SQL = f"""with {_FULL_SQL},
m as (select row_no, body, folded, regexp_extract_all(folded, '{_q(_P.header)}') as heads, string_split_regex(folded, '{_q(_P.header)}') as pieces from f),
c as (select row_no, body, folded, i, {_SUM.format("pieces[1:i]")} + {_SUM.format("heads[1:i]")} + 1 as start from (select *, unnest(generate_series(1, len(heads))) as i from m where len(heads) > 0)),
w as (select *, substr(folded, start, 3000) as win from c),
x as (select *, {_before("win", _WINDOW_STOP)} as upto from w),
y as (select row_no, i, {_TIDY.format("substr(body, start, " + _CUT.format("upto", "win") + ")", _EDGE)} as found from x),
b as (select row_no, found as best from y where length(found) > 50 and regexp_matches(found, '[\\x{{0600}}-\\x{{06FF}}]') qualify row_number() over (partition by row_no order by length(found) desc, i) = 1),
v as (select f.row_no, body, folded, best, least(case when best is null and regexp_matches(folded, '{_q(_FIRST_VERB)}') then length(regexp_extract(folded, '{_q(_FIRST_VERB)}', 1)) end,
 case when best is null and regexp_matches(folded, '{_q(_LATER_VERB)}') then length(regexp_extract(folded, '{_q(_LATER_VERB)}', 1)) end) as away from f left join b using (row_no)),
o as (select row_no, best, body, away, case when away < 3000 then substr(folded, away + 1, 3000) end as win from v),
z as (select row_no, best, regexp_replace(substr(body, away + 1, {_CUT.format(_before("win", _WINDOW_STOP), "win")}), '{_EDGE}', '', 'g') as second from o)
select row_no, case when best is not null then trim(regexp_replace(best, '{_BLANK}', ' ', 'g'), ' ') when length(second) > 50 then trim(regexp_replace(second, '{_BLANK}', ' ', 'g'), ' ') end as abstract from z"""


def _full(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "sample_articles").select("row_no", "source", "authors", "page1", "page2", extraction.full_text(F.col("page1"), F.col("page2")).alias("full"))


@query(_ABSTRACTS_SQL)
def extracted_abstracts(spark: SparkSession, d: str) -> DataFrame:
    return extraction.extract_abstracts(_full(spark, d), "full").select("row_no", "abstract")


@query(_KEYWORDS_SQL)
def extracted_keywords(spark: SparkSession, d: str) -> DataFrame:
    return extraction.extract_keywords(_full(spark, d).select("row_no", "full"), "full").select("row_no", F.array_join("keywords", " | ").alias("keywords"))


_NAME_EDGES = "^[.\\-/_:,\\t\\n\\x0B\\f\\r \\x{85}\\p{Z}*]+|[.\\-/_:,\\t\\n\\x0B\\f\\r \\x{85}\\p{Z}*]+$"
_GAP = "[\\t\\n\\x0B\\f\\r \\x{85}\\p{Z}]"


def _bare_name(x: str) -> str:
    """A name without marks at its ends and titles."""
    return f"regexp_replace(regexp_replace(coalesce({x}, ''), '{_NAME_EDGES}', '', 'g'), '(?i)^{_GAP}*(?:{extraction.TITLES})\\.?{_GAP}*', '')"


def _is_name(n: str) -> str:
    """Whether a bare name is a person's."""
    return f"""length({n}) >= 3 and not regexp_matches({n}, '\\p{{Nd}}') and not regexp_matches(lower({n}), '@|www\\.|\\.com|\\.edu|\\.org|\\.net') and not regexp_matches({n}, '(?i)(?:{extraction.NOT_NAMES})')
    and not regexp_matches({n}, '^[a-z]') and not (regexp_matches({n}, '[a-zA-Z]') and regexp_matches({n}, '[\\x{{0600}}-\\x{{06FF}}]'))
    and len(list_filter(string_split_regex({n}, '{_GAP}+'), lambda w: w <> '')) <= 5 and len(list_filter(string_split_regex({n}, '{_GAP}+'), lambda w: length(w) = 1)) <= 2"""


_AUTHORS_SQL = f"""with a as (select row_no, authors, left(coalesce(page1, ''), 2500) as body from sample_articles),
b as (select *, translate(replace(body, 'ـ', ''), 'أإآ', 'ااا') as folded from a),
c as (select *, regexp_matches(folded, '(?i)(?:{extraction.ZONE_ENDS})') as ends, length(regexp_extract(folded, '(?is)\\A(.*?)(?:{extraction.ZONE_ENDS}|\\z)', 1)) as stop from b),
d as (select row_no, authors, case when ends then substr(body, greatest(stop - 500, 0) + 1, stop - greatest(stop - 500, 0)) else left(body, 600) end as zone from c),
e as (select *, trim(regexp_extract(zone, '(?m)\\*[\\t\\n\\x0B\\f\\r ]*([^*\\n]+)$', 1), ' ') as starred,
 list_filter(list_transform(list_reverse(list_filter(list_transform(string_split(zone, chr(10)), lambda x: regexp_replace(x, '{_EDGE}', '', 'g')), lambda x: x <> '')), lambda x: {{'raw': x, 'n': {_bare_name("x")}}}), lambda r: {_is_name("r.n")}) as scanned from d),
f as (select *, case when starred <> '' then starred else coalesce(scanned[1].raw, '') end as raw from e),
g as (select row_no, authors, list_transform(string_split_regex(raw, '[\\t\\n\\x0B\\f\\r ]+و[\\t\\n\\x0B\\f\\r ]+|[\\t\\n\\x0B\\f\\r ]+and[\\t\\n\\x0B\\f\\r ]+|;|،|,|&'),
 lambda t: array_to_string(list_filter(string_split_regex(trim(regexp_replace(trim(t, ' '), '^\\*+|\\*+$', '', 'g'), ' '), '{_GAP}+'), lambda w: w <> '')[1:4], ' ')) as names from f),
h as (select row_no, authors, list_filter(list_transform(names, lambda x: {_bare_name("x")}), lambda n: {_is_name("n")}) as good from g)
select row_no, case when length(trim(coalesce(authors, ''), ' ')) > 1 and lower(authors) <> 'nan' then authors else array_to_string(good, ' | ') end as authors from h"""


@query(_AUTHORS_SQL)
def extracted_authors(spark: SparkSession, d: str) -> DataFrame:
    return _full(spark, d).select("row_no", F.array_join(extraction.extract_authors(F.col("authors"), F.col("page1")), " | ").alias("authors"))


#: The test tables have other sources: these stand in for the ones that have a profile.
STAND_INS = {"KJR": "AJP", "WTR": "AJSP", "NBA": "AJSRP", "DHB": "AM", "TLJ": "ARPD"}


_SPACES = r"\t\n\x0B\f\r \x{85}\p{Z}"


def _re2(pattern: str) -> str:
    """A pattern with Unicode classes as RE2 writes them, inside an SQL text."""
    for old, new in ((r"\s", f"[{_SPACES}]"), (r"\S", f"[^{_SPACES}]"), (r"\d", r"\p{Nd}")):
        pattern = pattern.replace(old, new)
    return _q(re.sub(r"\\u([0-9A-Fa-f]{4})", r"\\x{\1}", pattern))


def _tested(test: str) -> str:
    """Places, from 0, of the lines ``x`` that pass a test."""
    return f"list_filter(list_transform(lines, lambda x, i: case when {test} then i - 1 end), lambda v: v is not null)"


def _page_sql(column: str) -> str:
    """The light cleanup of a page."""
    t = f"regexp_replace(regexp_replace({_compatible_sql(f"coalesce({column}, '')")}, '\\p{{Cf}}', '', 'g'), '\\r\\n?', chr(10), 'g')"
    t = f"regexp_replace(regexp_replace(regexp_replace({t}, '[•●▪♦■★☆※…—–―\\x{{2010}}-\\x{{2043}}\\x{{204E}}-\\x{{205E}}]', ' ', 'g'), '\\.{{3,}}', '.', 'g'), '={{2,}}|[_~^`]+', ' ', 'g')"
    return f"regexp_replace(regexp_replace(regexp_replace({t}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '{_EDGE}', '', 'g')"


def _regions_sql(name: str, source: str, p: extraction.Profile) -> str:
    """The regions of one source's rows, from the table ``pages`` of cleaned pages."""
    starts = lambda heads: f"regexp_matches(lower(x), '^(?:{_q('|'.join(re.escape(h) for h in heads))})')" if heads else "false"
    holds = lambda words: f"regexp_matches(lower(x), '{_q('|'.join(re.escape(w) for w in words))}')" if words else "false"
    pattern = lambda r: "false" if r == "(?!)" else f"regexp_matches(x, '{_re2(r)}')"
    stripped = f"case when p1 <> '' and p2 <> '' then p1 || '{text.PAGE_BREAK}' || p2 else p1 || p2 end" if p.second_page else "p1"
    for r, flags in [*((b, "is") for b in p.blocks), *((x, "im") for x in p.lines)]:
        stripped = f"regexp_replace({stripped}, '(?{flags}){_re2(r)}', '', 'g')"
    around = lambda idx, r: f"array_to_string(list_transform(list_filter(list_sort(list_distinct(flatten(list_transform({idx}, lambda i: range(i - {r}, i + {r} + 1))))), lambda j: j >= 0 and j < n), lambda j: lines[j + 1]), chr(10))"
    unlinked = lambda some: f"list_filter({some}, lambda x: not regexp_matches(x, '{_re2(extraction.URL)}'))"
    anchor = "list_min(marks)" if p.marks else "list_min(cues)"
    if p.window is None:
        hinted = around("cues", 1)
    else:
        some = f"lines[greatest({anchor} - {p.window[0]}, 0) + 1:greatest({anchor} - {p.window[0]}, 0) + {p.window[1]}]"
        hinted = f"case when {anchor} is not null then array_to_string({unlinked(some) if p.without_links else some}, chr(10)) else {around('cues', 1) if p.marks else "''"} end"
    cuts = ", ".join(["list_min(mails)", "heads", *({"cues": "list_min(cues)", "marks": "list_min(marks)", "doi": "doi"}[c] for c in p.title_cut)])
    cap = f"least(n, heads + {p.abstract_cap})" if p.abstract_cap else "n"
    abstract = f"case when heads is null then '' else array_to_string(lines[heads + 1:case when keys > heads then keys when intro > heads then intro else {cap} end], chr(10)) end"
    if p.abstract_line.startswith(extraction.RECEIVED):
        abstract = f"case when regexp_matches(lines[heads + 1], '{_re2(p.abstract_line)}') then regexp_replace({abstract}, '{_re2(extraction.RECEIVED)}', '') else {abstract} end"
    return f"""select row_no, left(regexp_replace('TITLE_REGION:' || chr(10) || array_to_string(({unlinked(f"lines[1:coalesce(least({cuts}), least(n, {p.title_default}))]")})[1:{p.title_max}], chr(10))
    || chr(10) || chr(10) || 'AUTHORS_REGION:' || chr(10) || case when len(mails) > 0 then {around("mails", p.radius)} else {hinted} end
    || chr(10) || chr(10) || 'ABSTRACT_REGION:' || chr(10) || {abstract}
    || chr(10) || chr(10) || 'KEYWORDS_REGION:' || chr(10) || case when keys is null then '' else array_to_string(lines[keys + 1:keys + {p.keyword_lines}], chr(10)) end, '{_EDGE}', '', 'g'), 9000) as regions
    from (select *, len(lines) as n, list_min({_tested(starts(p.abstract) + " or " + pattern(p.abstract_line))}) as heads, list_min({_tested(starts(extraction.KEYWORD_HEADS) + " or " + pattern(p.keyword_line))}) as keys, list_min({_tested(starts(p.intro))}) as intro,
     {_tested(f"regexp_matches(x, '[{_IN}][{_IN}.-]*@[{_IN}.-]+[.][{_IN}]')")} as mails, {_tested(holds(p.marks))} as marks, list_filter({_tested(holds(p.cues))}, lambda v: v <= {p.limit}) as cues, list_min({_tested("contains(lower(x), 'doi.org')")}) as doi
     from (select row_no, list_filter(list_transform(string_split(regexp_replace({stripped}, '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '{_EDGE}', '', 'g')), lambda x: x <> '') as lines from pages where code = '{source}'))"""


_REGIONS = " union all ".join(_regions_sql(name, source, extraction.PROFILES[name]) for source, name in STAND_INS.items())


@query(
    f"""with pages as (select row_no, upper(trim(source, ' ')) as code, {_page_sql("page1")} as p1, {_page_sql("page2")} as p2 from sample_articles), r as ({_REGIONS})
    select s.row_no, r.regions from sample_articles s left join r using (row_no)"""
)
def pinpointed_regions(spark: SparkSession, d: str) -> DataFrame:
    codes = F.create_map(*(F.lit(x) for kv in STAND_INS.items() for x in kv))
    rows = load(spark, d, "sample_articles").select("row_no", "page1", "page2", codes[F.upper(F.trim("source"))].alias("source"))
    return extraction.pinpoint(rows).select("row_no", "regions")


@query(f"with a as (select id, {_bare_name('name')} as n from authors06) select id, {_is_name('n')} as valid, case when {_is_name('n')} then n else '' end as name from a")
def valid_names(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "authors06").select("id", extraction.validate_name(F.col("name")).alias("v")).select("id", "v.valid", "v.name")
