"""Template rests, filler, error pages and script notices (problem 10).

Character four-gram models of filler, of error and access notices and of
natural prose give each four-gram a log-likelihood ratio; windows in which the
ratio speaks for residue are marked, and a document is residue if marked
windows cover at least ``coverage`` of it. The prose model counts each distinct
text once, without texts and windows made up of the seed lines' four-grams, so
that copies of a notice can't make it prose; the two others are fitted on the
seed lines below, which come from public conventions alone. One step of
expectation-maximisation follows: the distinct texts that these models take for
residue are a third model of it and leave the prose model, so wordings akin to
what was found are found too. Four-grams are hashed into ``BUCKETS`` counters,
so a model's size doesn't follow the corpus.

Unfilled placeholders are found by their notation. One that is quoted or named
in a sentence about templates isn't a case, and what stands between quotation
marks inside a sentence doesn't count as covered.

Defined results: NULL, empty and blank texts are no residue (kind NULL); every
row gives one row, repeated rows too; columns but the two named are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warraq.llm.batches import map_rows

BUCKETS = 1 << 17
COVERAGE = 2 / 3
WINDOW = 24
#: Line ends between joined texts. The share of four-grams known from the seed lines that keeps a text, or a window, out of the prose model.
GAP = 4
SEED_TEXT, SEED_WINDOW = 0.5, 0.9

#: Seed lines of the filler model: words of common filler generators, Latin classics, what editors show in empty boxes. Numbers stand as 0.
FILLER = """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum
Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium, totam rem aperiam, eaque ipsa quae ab illo inventore veritatis et quasi architecto beatae vitae dicta sunt explicabo.
Nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit, sed quia consequuntur magni dolores eos qui ratione voluptatem sequi nesciunt.
Neque porro quisquam est, qui dolorem ipsum quia dolor sit amet, consectetur, adipisci velit, sed quia non numquam eius modi tempora incidunt ut labore et dolore magnam aliquam quaerat voluptatem.
At vero eos et accusamus et iusto odio dignissimos ducimus qui blanditiis praesentium voluptatum deleniti atque corrupti quos dolores et quas molestias excepturi sint occaecati cupiditate non provident, similique sunt in culpa.
Temporibus autem quibusdam et aut officiis debitis aut rerum necessitatibus saepe eveniet ut et voluptates repudiandae sint et molestiae non recusandae. Itaque earum rerum hic tenetur a sapiente delectus.
Gallia est omnis divisa in partes tres, quarum unam incolunt Belgae, aliam Aquitani, tertiam qui ipsorum lingua Celtae, nostra Galli appellantur. Hi omnes lingua, institutis, legibus inter se differunt.
Arma virumque cano, Troiae qui primus ab oris Italiam fato profugus Laviniaque venit litora, multum ille et terris iactatus et alto vi superum saevae memorem Iunonis ob iram.
Quousque tandem abutere, Catilina, patientia nostra? Quam diu etiam furor iste tuus nos eludet? Vivamus atque amemus, rumoresque senum severiorum omnes unius aestimemus assis.
xxx xxxx xxxxx xxxxxx xxxxxxx. xxx xxx, xxxx xxxxx.
text text text. text goes here. your text here. enter your text here. insert your text here. add text here. add a title. your title here. subtitle here. content goes here. content here. description goes here.
sample text. dummy text. filler text. placeholder text. example paragraph. sample paragraph. sample page. sample content. sample heading. heading placeholder. placeholder heading. heading one. this is a sample. this is just placeholder text. this text is only a placeholder. for demonstration purposes only. for layout purposes.
click to add text. click here to edit. double-click to edit. type here. type your text. start typing here. write something here. replace this text. replace this with your own text. this paragraph is a placeholder. paste the abstract here. enter the introduction. to be completed. to be announced. to be added. coming soon. under construction. no content yet. no abstract available yet. abstract to come. add abstract.
tbd. tbd tbd. tba. tba tba. todo. todo todo. todo: write. todo: fill in. fixme: add. tk. n/a n/a n/a. foo bar baz qux. asdf. qwerty. test test test. hello world. blah blah blah. abc abc abc. aaa bbb ccc.
null. null null. undefined. undefined undefined. undefined, undefined. (undefined). [undefined]. nan. nan nan. none none. [object object]. [object object],[object object]. vol. null, no. null. pp. undefined-undefined. invalid date. (null). nil nil.
the quick brown fox jumps over the lazy dog.
نص تجريبي. نص شكلي. نص افتراضي. نص مؤقت. نص بديل. نص مثال. نص نموذجي. عنوان تجريبي. عنوان فرعي. عنوان نموذجي. فقرة تجريبية. محتوى تجريبي. هذه فقرة للتجربة. هذا النص للتجربة فقط. هذا مجرد نص مؤقت لعرض شكل الصفحة. نموذج لشكل الصفحة.
هذا النص هو مثال لنص يمكن أن يستبدل في نفس المساحة، لقد تم توليد هذا النص من مولد النص العربى. حيث يمكنك أن تولد مثل هذا النص أو العديد من النصوص الأخرى. نص بلا معنى. ليس للنص معنى. لا معنى لهذا النص.
اكتب هنا. اكتب النص هنا. اكتب عنوانك هنا. اكتب الملخص. أدخل النص هنا. أدخل العنوان. أضف المحتوى هنا. ضع النص هنا. العنوان هنا. الملخص هنا. المراجع هنا. المحتوى هنا. سيتم استبدال هذا النص لاحقا. يستبدل هذا النص بالنص الأصلي. سوف يضاف لاحقا. يضاف المحتوى لاحقا. قيد الإعداد. تحت الإنشاء. قريبا.
لوريم إيبسوم هو ببساطة نص شكلي يستخدم في صناعة الطباعة والتنضيد. لوريم ايبسوم دولار سيت اميت كونسيكتيتور اديبيسسينج اليت.
texte d'exemple. texte de remplissage. votre texte ici. saisissez votre texte. cliquez ici pour modifier. faux texte. titre de la page. à compléter. contenu à venir.
örnek metin. yer tutucu metin. metni buraya yazın. başlık buraya. içerik yakında eklenecek. deneme yazısı.
متن نمونه. متن آزمایشی. لورم ایپسوم متن ساختگی با تولید سادگی نامفهوم از صنعت چاپ. متن خود را اینجا بنویسید. عنوان را وارد کنید."""

#: Seed lines of the model of errors, access and waiting notices and program output: phrases of HTTP and of common servers, browsers and languages.
NOTICES = """400 bad request. 401 unauthorized. 402 payment required. 403 forbidden. 404 not found. 405 method not allowed. 406 not acceptable. 408 request timeout. 409 conflict. 410 gone. 413 payload too large. 414 uri too long. 415 unsupported media type. 418 i'm a teapot. 421 misdirected request. 422 unprocessable content. 423 locked. 429 too many requests. 451 unavailable for legal reasons.
500 internal server error. 501 not implemented. 502 bad gateway. 503 service unavailable. 504 gateway timeout. 505 http version not supported. 507 insufficient storage. 511 network authentication required. 301 moved permanently. 302 found. 307 temporary redirect.
http/1.1 200 ok. http/1.1 404 not found server: apache. http/2 503. server: nginx. content-type: text/html. connection: close. retry-after: 0. date: gmt. content-length: 0. location: /.
error 404. error 500. http error 403. error code: 0. status code 0. server returned status 0. reference: #0. ray id. request id. error id. incident number. ref #0.
the requested url was not found on this server. the requested resource could not be found. the requested page could not be found. the requested url could not be retrieved. could not be served. the page you requested does not exist. this page does not exist. page not found. file not found. article not found. the resource has been removed. sorry, we couldn't find that page. the link may be broken. go back home. return to the homepage.
you don't have permission to access this resource. you do not have access to this page. access denied. access to this resource is denied. access blocked. your ip address has been blocked. your ip has been banned. request blocked. you have been blocked. login required. please log in. please sign in. sign in to continue. log in to view. session expired. your session has timed out. subscription required. you are not authorized to view this page.
the server encountered an internal error or misconfiguration and was unable to complete your request. the server is temporarily unable to service your request due to maintenance downtime or capacity problems. please try again later. something went wrong. an error occurred while processing your request. an unexpected error has occurred. oops. service temporarily unavailable. site under maintenance. down for maintenance. the proxy server received an invalid response from an upstream server.
please enable javascript. please enable javascript to continue. javascript is required. javascript is disabled. your browser does not support javascript. you need to enable javascript to run this application. enable javascript and cookies to continue. please turn on javascript and reload the page. this site requires javascript. scripts are required. scripting is disabled. scripts must be enabled. turn on scripts. allow scripts and cookies. browser with scripting enabled. cookies must be enabled. please enable cookies. your browser is out of date. unsupported browser. upgrade your browser. noscript.
loading. loading... please wait. please wait while we load the page. just a moment. one moment please. wait a moment. checking your browser before accessing. checking if the site connection is secure. checking connection. verify you are human by completing the action below. complete the captcha. redirecting. you are being redirected. you will be redirected shortly. please stand by. this process is automatic. your download will begin shortly. your download will start automatically. if the download does not begin, click here. if it does not start, click this link. preparing your file.
database error. error establishing a database connection. database is locked. table is locked. table doesn't exist. sql error. you have an error in your sql syntax; check the manual for the right syntax to use near line 0. could not connect to database. connection refused. connection reset by peer. connection timed out. deadlock found when trying to get lock. ora-00000. sqlstate[00000]. too many connections.
warning: undefined variable $id in /var/www/html/index.php on line 0. notice: undefined index: title in /home/site/public_html/page.php on line 0. fatal error: uncaught error: call to undefined function in /var/www/index.php:0 stack trace: #0 {main} thrown in. parse error: syntax error, unexpected end of file. warning: cannot modify header information - headers already sent by. deprecated: function is deprecated in /var/www.
traceback file "main.py", line 0, in <module> keyerror: 'id' valueerror: invalid literal typeerror: 'nonetype' object is not iterable attributeerror: 'nonetype' object has no attribute 'text' indexerror: list index out of range modulenotfounderror: no module named. filenotfounderror. unicodedecodeerror: 'utf-8' codec can't decode byte. importerror. runtimeerror. recursionerror.
exception in thread "main" java.lang.nullpointerexception at com.example.app.main(main.java:0) at java.lang.thread.run(thread.java:0) java.lang.illegalargumentexception java.io.ioexception java.util.concurrent. caused by: java.sql.sqlexception ... 0 more. org.springframework. at sun.reflect. at java.base/java.lang.reflect.method.invoke(method.java:0) nullreferenceexception: object reference not set to an instance of an object. at system.web.ui.page. stack trace:
uncaught typeerror: cannot read properties of undefined (reading 'title') at object.<anonymous> (app.js:0:0) referenceerror: $ is not defined. uncaught (in promise) error. segmentation fault (core dumped). killed. permission denied. command not found. no such file or directory. out of memory. disk quota exceeded. panic: runtime error: index out of range goroutine 0 [running]. undefined reference to. errno 0. exit status 0. [error] [warn] [info]
يرجى تفعيل جافا سكريبت. يرجى تفعيل جافاسكربت في متصفحك للمتابعة. يجب تمكين جافا سكريبت لعرض المحتوى. متصفحك لا يدعم جافا سكريبت. يتطلب هذا الموقع تشغيل البرامج النصية. فعل النصوص البرمجية. تفعيل النصوص البرمجية وملفات تعريف الارتباط. فعل ملفات الارتباط. يرجى تحديث المتصفح ثم إعادة تحميل الصفحة.
الصفحة غير موجودة. الصفحة المطلوبة غير موجودة. عذرا، لم نتمكن من العثور على الصفحة. لم يتم العثور على الملف. الرابط غير صحيح. العودة إلى الصفحة الرئيسية. حدث خطأ ما. حدث خطأ أثناء معالجة الطلب. خطأ داخلي في الخادم. خطأ في قاعدة البيانات. خطأ رقم 0. رمز الخطأ 0. الخادم غير متاح. الخدمة غير متوفرة مؤقتا. الموقع تحت الصيانة. يرجى المحاولة مرة أخرى لاحقا. تعذر الاتصال بالخادم. انتهت مهلة الاتصال.
تم رفض الوصول. ليس لديك صلاحية الوصول إلى هذه الصفحة. غير مسموح بالدخول. غير مصرح بالدخول. يرجى تسجيل الدخول للمتابعة. سجل الدخول لعرض المحتوى. انتهت صلاحية الجلسة. تم حظر عنوان الشبكة الخاص بك. جار التحميل. جاري تحميل الصفحة، يرجى الانتظار. لحظة من فضلك. يرجى الانتظار قليلا. جاري التحقق من المتصفح. التحقق من أنك إنسان ولست روبوتا. سيتم تحويلك تلقائيا. جاري إعادة التوجيه. سيبدأ التنزيل تلقائيا خلال لحظات. إذا لم يبدأ التنزيل فانقر هنا.
veuillez activer javascript pour continuer. javascript est désactivé. votre navigateur ne prend pas en charge javascript. page non trouvée. erreur 404. page introuvable. accès refusé. accès interdit. erreur interne du serveur. service indisponible. veuillez patienter. chargement en cours. vous allez être redirigé. veuillez vous connecter. votre session a expiré. activez les cookies.
devam etmek için javascript'i etkinleştirin. tarayıcınız javascript desteklemiyor. sayfa bulunamadı. erişim reddedildi. sunucu hatası. hizmet kullanılamıyor. yükleniyor, lütfen bekleyin. yönlendiriliyorsunuz. oturum süreniz doldu. giriş yapın. çerezleri etkinleştirin.
لطفا جاوااسکریپت را فعال کنید. مرورگر شما پشتیبانی نمی‌کند. صفحه مورد نظر یافت نشد. دسترسی غیرمجاز. دسترسی ممنوع است. خطای سرور. در حال بارگذاری، لطفا صبر کنید. در حال انتقال. وارد شوید. کوکی‌ها را فعال کنید."""

_FIELD = r"(?:[^\W\d_][\w.]*(?:[ _][\w.]+){0,3})"
_KNOWN = r"(?:title|authors?|author_?name|full_?name|name|abstract|keywords?|doi|issue|volume|journal|affiliation|publish_?date|date|(?:first|last)_?page|pages?|email|year|issn|university|department|\w+_\w+|[a-z]+[A-Z]\w*|[^\W\d_A-Za-z]*(?:عنوان|اسم|ملخص|كلمات|تاريخ|مجلة|مؤلف|باحث|جامعة|بريد)[^\[\]<>]{0,30})"
#: Notations of a value still to be filled in. Square and angle brackets hold other things too, so there the field's name decides.
PLACEHOLDER = regex.compile(
    rf"\{{\{{\s*{_FIELD}\s*\}}\}}|\{{%\s*{_FIELD}\s*%\}}|<%=?\s*{_FIELD}\s*%>|\$\{{\s*{_FIELD}\s*\}}|\[\[\s*{_FIELD}\s*\]\]|@@{_FIELD}@@"
    rf"|(?<![\w_])__{_FIELD}__(?![\w_])|(?<![\w%])%[^\W\d][\w ]{{1,40}}[^\W\d]%(?![\w%])|(?<![\w#])#[^\W\d][\w ]{{1,40}}[^\W\d]#(?![\w#])|(?<![\w$])\$[^\W\d][\w ]{{1,40}}[^\W\d]\$(?![\w$])"
    rf"|\[insert [^\[\]\n]{{1,60}}\]|\[(?:أدخل|ادخل|اكتب) [^\[\]\n]{{1,60}}\]|«(?:أدخل|ادخل|اكتب) [^«»\n]{{1,60}}»|\[{_KNOWN}\]|<{_KNOWN}>",
)
#: A sentence that speaks of templates names a placeholder; it doesn't leave one open.
_ABOUT = regex.compile(r"\b(?:templat\w*|placeholder\w*|markup|syntax|gabarits?|modèles? de page|şablon\w*)\b|قوالب|القالب|قالب|الگو", regex.I)
_SENTENCE_END = regex.compile(r"(?<=[.!?؟])\s+|\n")
_QUOTED = regex.compile(r"«[^«»\n]{1,400}»|“[^“”\n]{1,400}”|\"[^\"\n]{1,400}\"")


_OTHER_DIGIT = re.compile(r"[^\D0]")


def grams(text: str) -> np.ndarray:
    """Hashed four-grams of a text in lower case, one for each place but the last three."""
    low = text.lower()
    points = np.frombuffer((_OTHER_DIGIT.sub("0", low) if _OTHER_DIGIT.search(low) else low).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(points) < 4:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = points[:-3] * np.uint64(0x9E3779B1) + points[1:-2] * np.uint64(0x85EBCA77) + points[2:-1] * np.uint64(0xC2B2AE3D) + points[3:] * np.uint64(0x27D4EB2F)
        h ^= h >> np.uint64(15)
        h *= np.uint64(0x2C1B3C6D)
    return ((h >> np.uint64(12)) % np.uint64(BUCKETS)).astype(np.int64)


def _of_seeds() -> np.ndarray:
    known = np.zeros(BUCKETS, bool)
    known[grams(FILLER)] = known[grams(NOTICES)] = True
    return known


def _kept(g: np.ndarray, sizes: list[int], known: np.ndarray) -> np.ndarray:
    """The four-grams ``g`` of joined texts, of so many places each, without what the seed lines alone tell for residue."""
    sums = np.concatenate([[0], np.cumsum(known[g])])
    starts = np.cumsum([0, *sizes[:-1]])
    ends = np.minimum(starts + np.maximum(np.array(sizes) - GAP - 3, 0), len(g))
    starts = np.minimum(starts, ends)
    drop = np.repeat(sums[ends] - sums[starts] >= SEED_TEXT * np.maximum(ends - starts, 1), sizes)[: len(g)]
    if len(g) >= WINDOW:
        edge = np.zeros(len(g) + 1, np.int32)
        full = (sums[WINDOW:] - sums[:-WINDOW] >= SEED_WINDOW * WINDOW).astype(np.int32)
        edge[: len(full)] += full
        edge[WINDOW : WINDOW + len(full)] -= full
        drop |= np.cumsum(edge)[:-1] > 0
    return g[~drop]


def prose_counts(df: DataFrame, text: str = "text") -> np.ndarray:
    """Four-gram counts of the distinct texts, digits apart, less what the seed lines know; at most ``BUCKETS`` rows come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, fold = np.zeros(BUCKETS, np.int64), prose_fold()
        for batch in batches:
            fold(sums, batch.column(0).to_pylist())
        yield counted(sums)

    return _summed(df.select(digitless(F.col(text)).alias("text")).distinct(), run)


def prose_fold() -> Callable[[np.ndarray, list], None]:
    """A function that adds the four-grams of texts to counters, but those that the seed lines know."""
    known = _of_seeds()

    def fold(sums: np.ndarray, texts: list) -> None:
        low = [t.lower() for t in texts if t]
        for some in [[t] for t in low if len(t) > 20_000] + [[t for t in low if len(t) <= 20_000]]:
            if some:
                sums += np.bincount(_kept(grams(("\n" * GAP).join(some)), [len(t) + GAP for t in some], known), minlength=BUCKETS)

    return fold


def counted(sums: np.ndarray) -> pa.RecordBatch:
    """Counters that are not 0, as rows (bucket, n)."""
    at = np.nonzero(sums)[0]
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at], pa.int64())], names=["bucket", "n"])


def digitless(text: Column) -> Column:
    """A text in lower case with every digit as 0."""
    return F.regexp_replace(F.lower(text), r"\p{Nd}", "0")


def _summed(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> np.ndarray:
    out = np.zeros(BUCKETS, np.int64)
    for r in df.mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def found_counts(df: DataFrame, ratio: np.ndarray, text: str = "text", coverage: float = COVERAGE) -> np.ndarray:
    """Four-gram counts of the distinct texts, digits apart, that ``ratio`` tells for residue (placeholders are no such text)."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = judge(ratio, coverage)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([t for t in batch.column(0).to_pylist() if decide(t)[0] == "residue"], pa.string())], names=["text"])

    return residue_counts(df.select(F.col(text).alias("text")).filter("text is not null").mapInArrow(keep, "text string"))


def residue_counts(found: DataFrame, text: str = "text") -> np.ndarray:
    """Four-gram counts of the distinct texts, digits apart, of ``found``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                sums += np.bincount(grams(t), minlength=BUCKETS)
        yield counted(sums)

    return _summed(found.select(digitless(F.col(text)).alias("text")).distinct(), run)


def ratios(prose: np.ndarray, found: np.ndarray | None = None) -> np.ndarray:
    """The log-likelihood ratio of each four-gram, residue (the likeliest of its models) against prose.

    ``found``: counts of texts found before, which are residue and no prose.
    """
    found = np.zeros(BUCKETS, np.int64) if found is None else found
    prose = np.maximum(prose - found, 0)
    n = max(int(prose.sum()), 1)

    def fitted(counts: np.ndarray) -> np.ndarray:
        return (counts + 0.02) / (counts.sum() + 0.02 * BUCKETS)

    seen = np.maximum.reduce([fitted(np.bincount(grams(lines), minlength=BUCKETS)) for lines in (FILLER, NOTICES)] + [fitted(found)] * bool(found.any()))
    ratio = np.log(seen) - np.log((prose + 0.02) / (n + 0.02 * BUCKETS))
    base = float(np.log(0.02 / (len(NOTICES) + 0.02 * BUCKETS))) + 1
    # seen by neither: no evidence but that prose has been seen a lot
    return np.clip(np.where(np.log(seen) <= base, np.where(prose <= 3, 0.3, ratio), ratio), -4, 4).astype(np.float32)


def fit(df: DataFrame, text: str = "text", coverage: float = COVERAGE) -> np.ndarray:
    """The ratios of all four-grams for the texts of ``df``."""
    prose = prose_counts(df, text)
    return ratios(prose, found_counts(df, ratios(prose), text, coverage))


def judge(ratio: np.ndarray, coverage: float = COVERAGE, window: int = WINDOW) -> Callable[[str | None], tuple[str | None, float]]:
    """A function from a text to its kind of residue (NULL: none) and the share that residue covers."""
    def covered(text: str) -> float:
        g = grams(text)
        if len(g) < 4:
            return 0.0
        scores = ratio[g]
        width = min(window, len(scores))
        total = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
        hit = (total[width:] - total[:-width] > 0.5 * width).view(np.int8)
        # every window's places once: up at its start, down behind its end
        edge = np.zeros(len(scores) + 1, np.int32)
        edge[: len(hit)] += hit
        edge[width : width + len(hit)] -= hit
        return float((np.cumsum(edge)[:-1] > 0).mean())

    def decide(text: str | None) -> tuple[str | None, float]:
        if text is None or not text.strip():
            return None, 0.0
        for m in PLACEHOLDER.finditer(text):
            start = max((e.end() for e in _SENTENCE_END.finditer(text, max(0, m.start() - 300), m.start())), default=max(0, m.start() - 300))
            end = _SENTENCE_END.search(text, m.end(), m.end() + 300)
            if not _ABOUT.search(text, start, m.start()) and not _ABOUT.search(text, m.end(), end.start() if end else m.end() + 300):
                return "placeholder", 1.0
        share = covered(text)
        if share >= coverage and _QUOTED.search(text):
            bare = _QUOTED.sub(" ", text)
            share = min(share, covered(bare)) if len(bare.strip()) >= 40 else share
        return ("residue" if share >= coverage else None), share

    return decide


def find_residue(df: DataFrame, key: str = "doc_id", text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """(key, kind, covered) of every row; kind is ``placeholder``, ``residue`` or NULL."""
    ratio = fit(df, text, coverage)

    def make() -> Callable[..., tuple]:
        decide = judge(ratio, coverage)

        def each(keys: list, texts: list) -> tuple:
            found = [decide(t) for t in texts]
            return keys, [f[0] for f in found], [f[1] for f in found]

        return each

    rows = df.select(F.col(key).cast("bigint").alias(key), F.col(text).alias("text"))
    return map_rows(rows, make, f"`{key}` bigint, kind string, covered double", pa.schema([(key, pa.int64()), ("kind", pa.string()), ("covered", pa.float64())]))
