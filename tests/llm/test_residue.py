import numpy as np
import pytest

from warraq.llm import residue

PROSE = "The results showed significant differences in soil salinity between the two regions, and the authors recommend further research on palm pollination. "
ARABIC = "أظهرت النتائج وجود فروق ذات دلالة إحصائية في ملوحة التربة بين المنطقتين، وأوصت الدراسة بإجراء بحوث لاحقة حول تلقيح النخيل. "


@pytest.fixture(scope="module")
def decide():
    prose = np.bincount(residue.grams((PROSE + ARABIC) * 300), minlength=residue.BUCKETS)
    return residue.judge(residue.ratios(prose))


@pytest.mark.parametrize(
    "text",
    [
        "Title: {{ title }}\nAuthors: #author_name#", PROSE + "The [[journal]] was asked.", "%اسم الباحث% " + ARABIC, "Dear <first_page>, hello there", PROSE.replace("soil", "__keywords__ soil"), "نص «أدخل doi هنا» نص",
        "404 Not Found", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Xxxx xxx xxxxx.",
    ],
)
def test_cases(decide, text):
    assert decide(text)[0]


#: Wordings that stand in no seed line: other sites' notices, other programs' output, other editors' filler.
HELD_OUT = [
    "JavaScript must be switched on to use this website.", "Scripts are turned off in your browser; please switch them on.", "This application needs JavaScript enabled.", "Your browser must accept cookies to open this page.",
    "Sorry! The page you were looking for was not found.", "The document you requested is no longer on this server.", "HTTP 502 - Bad Gateway", "Error 503 Service Unavailable (nginx/1.18)", "Server error 500: the request could not be completed.",
    "Access to the requested page is forbidden.", "You must log in to view this file.", "Your session has ended, please sign in again.", "Your address 10.0.0.1 has been blocked.",
    "Please wait while your page is being loaded...", "You will be redirected in 5 seconds.", "Checking your browser, please wait.", "Your download will begin in a few seconds. If it doesn't, click here.",
    "Traceback: File 'run.py', line 12, in load, TypeError: 'NoneType' object is not callable", "java.lang.NullPointerException: null at com.acme.Servlet.service(Servlet.java:88)", "Warning: undefined index page in /var/www/site/list.php on line 20",
    "SQL error: table users does not exist", "Could not connect to the database: connection timed out", "Uncaught ReferenceError: x is not defined at main.js:3:14",
    "يرجى تمكين جافا سكريبت في المتصفح ثم إعادة تحميل هذه الصفحة.", "عذرا، لم نجد الصفحة المطلوبة على هذا الخادم.", "ليس لديك صلاحية لعرض هذا الملف، يرجى تسجيل الدخول.", "جاري تحميل المقال، يرجى الانتظار.", "خطأ 500: حدث خطأ داخلي في الخادم.", "متصفحك قديم ولا يدعم ملفات تعريف الارتباط.",
    "Veuillez activer JavaScript dans votre navigateur.", "La page demandée est introuvable (erreur 404).", "Lütfen tarayıcınızda JavaScript'i etkinleştirin.", "لطفا جاوااسکریپت مرورگر خود را فعال کنید.",
    "This is placeholder text for the page layout.", "Insert your title here. Enter the abstract text here.", "Sample heading. Replace this text with your content.", "هذا نص مؤقت لعرض شكل الصفحة وسوف يستبدل لاحقا.", "أدخل الملخص هنا. أدخل عنوان المقال هنا.", "Ceci est un texte de remplissage.",
    "Quis autem vel eum iure reprehenderit qui in ea voluptate velit.", "TODO: fill in abstract", "NaN NaN undefined",
]


def test_held_out_wordings(decide):
    seeds = residue.FILLER + residue.NOTICES
    assert not [t for t in HELD_OUT if t.lower().rstrip(".") in seeds]
    missed = [t for t in HELD_OUT if not decide(t)[0]]
    assert len(missed) <= 0.1 * len(HELD_OUT), missed


def test_no_seed_sentence_in_test_tables():
    import pathlib
    import re

    import pyarrow.parquet as pq

    found = sorted(pathlib.Path("/root/testdata").glob("sf*/documents.parquet"))
    if not found:
        pytest.skip("no test tables here")
    plain = lambda t: re.sub(r"\d+", "0", t.lower())
    texts = "\n".join(plain(t) for p in found for t in pq.read_table(p, columns=["text"]).column(0).to_pylist() if t)
    sentences = {s.strip(" .") for s in re.split(r"(?<=[.!?؟:])\s+|\n", plain(residue.FILLER + "\n" + residue.NOTICES))}
    assert not [s for s in sentences if len(s.split()) >= 5 and s in texts]


def test_second_step_learns_wordings(spark):
    invented = ["Domerun califex orbant", "veltora quintam serulix", "pandiqua morbentis calur"]
    half = [(500 + k, f"Lorem ipsum dolor sit amet consectetur adipiscing elit {invented[k % 3]} {chr(97 + k)}.") for k in range(12)]
    rows = [(k, PROSE + f"sample {k} " + ARABIC) for k in range(60)] + half + [(900, f"{invented[0]}, {invented[1]}. {invented[2]}, {invented[0]}.")]
    got = {r.doc_id for r in residue.find_residue(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.kind}
    assert got == {k for k, _ in half} | {900}


@pytest.mark.parametrize(
    "text",
    [
        None, "", " \n", PROSE, ARABIC, PROSE * 300, PROSE + "The lesson shows students a template such as {{ title }} and asks them what it prints. " + PROSE,
        ARABIC + "تشرح هذه الفقرة كيف يملأ محرك القوالب حقولا مثل «{% block doi %}» بقيم. " + ARABIC, PROSE + "The value [sic] and the interval [a, b] are kept, and <s> too.", ARABIC + "رصد الباحثون عبارة «يجب تفعيل جافا سكربت» في المواقع. " + ARABIC, "12% و 13% من العينة " + ARABIC,
    ],
)
def test_no_cases(decide, text):
    assert decide(text)[0] is None


def test_operator(spark):
    rows = [(k, PROSE + ARABIC, 1) for k in range(50)] + [(90, "503 Service Unavailable", 1), (91, None, 1), (92, "", 1), (90, "503 Service Unavailable", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind int")
    got = residue.find_residue(df).collect()
    assert sorted((r.doc_id, r.kind) for r in got if r.kind) == [(90, "residue")] * 2 and len(got) == len(rows)
    assert residue.find_residue(df.limit(0)).collect() == []


def test_copies_are_no_prose(spark):
    notices = ["Please enable JavaScript to read the text on this site.", "هذا الموقع يتطلب تشغيل البرامج النصية (رمز {}).", "Access denied. Your IP address has been blocked by the server {}."]
    filled = [(k, PROSE + f"sample {chr(97 + k // 8)}{chr(97 + k % 8)} " + ARABIC * 3) for k in range(60)]
    for notice in notices:
        rows = filled + [(1000 + k, notice.format(k)) for k in range(60)]
        got = {r.doc_id for r in residue.find_residue(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.kind}
        assert got == set(range(1000, 1060))


def test_windows_of_notices_are_left_out(spark):
    mixed = [(PROSE * 3 + f"sample {k} Please enable JavaScript to continue to the site.",) for k in "abcdefgh"]
    counts = residue.prose_counts(spark.createDataFrame(mixed, "text string"))
    assert counts[residue.grams("JavaScript")].sum() == 0 and counts[residue.grams("salinity")].min() > 0
