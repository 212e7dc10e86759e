import datetime

import pytest

from warraq.sources import files, html
from warraq.streaming import ingest


def test_csv_round_trip(spark, tmp_path):
    rows = [("1", '  a "quoted"\nline ', "ب"), ("2", None, "x,y")]
    df = spark.createDataFrame(rows, "id string, text string, n string")
    files.write_csv(df, str(tmp_path / "c"))
    back = files.read_csv(spark, str(tmp_path / "c"), ["id", "text", "n"])
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    assert files.csv_columns(spark, str(tmp_path / "c")) == ["id", "text", "n"]
    files.write_csv(df, str(tmp_path / "c"), mode="append")
    assert files.read_csv(spark, str(tmp_path / "c")).count() == 4


def test_header_is_optional(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,t\n1,x\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("2,y\n", encoding="utf-8")
    got = files.read_maybe_headed(spark, str(tmp_path), ["id", "t"]).collect()
    assert sorted(map(tuple, got)) == [("1", "x"), ("2", "y")]


def test_output_table_is_made_when_missing(spark, tmp_path):
    p = str(tmp_path / "out")
    assert files.load_or_create(spark, p, ["a", "b"]).collect() == []
    spark.createDataFrame([("1",)], "b string").write.parquet(p)
    assert [tuple(r) for r in files.load_or_create(spark, p, ["a", "b"]).collect()] == [(None, "1")]


def test_documents_and_pages(spark, tmp_path):
    (tmp_path / "Art").mkdir()
    (tmp_path / "Art" / "x.PDF").write_bytes(b"one|")
    (tmp_path / "Art" / "y.pdf").write_bytes(b"bad")
    assert {r.general_field for r in files.list_documents(spark, str(tmp_path), source="S").collect()} == {"Art"}

    def layer(content):
        if content == b"bad":
            raise ValueError("unreadable")
        return content.decode().split("|")

    got = {r.path[-5:]: (r.page1, r.page2, r.error) for r in files.first_pages(spark, str(tmp_path), [lambda: layer, lambda: lambda c: layer(c) and ["ocr1", "ocr2"]]).collect()}
    assert got["x.PDF"] == ("one", "ocr2", None) and got["y.pdf"] == (None, None, "unreadable")


def test_chunks_and_tokens(spark, tmp_path):
    df = spark.range(450).withColumnRenamed("id", "k")
    files.write_chunks(df, str(tmp_path / "ch"), [df.k])
    assert {r.chunk: r["count"] for r in spark.read.parquet(str(tmp_path / "ch")).groupBy("chunk").count().collect()} == {0: 200, 1: 200, 2: 50}
    files.write_tokens(spark.createDataFrame([(["a", "b"],)], "t array<string>"), "t", str(tmp_path / "tok"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "tok")).collect()) == ["a", "b"]
    assert files.read_whole_text(spark, str(tmp_path / "tok")).count() >= 1


def test_snapshots_are_added(spark, tmp_path):
    df = spark.range(250).withColumnRenamed("id", "k")
    files.write_snapshots(df.filter("k < 150"), str(tmp_path / "s"), [df.k])
    files.write_snapshots(df.filter("k >= 150"), str(tmp_path / "s"), [df.k])
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 250 and {r.batch_id for r in back.select("batch_id").distinct().collect()} == {0, 1}


def test_gathering_aligns_and_takes_each_path_once(spark):
    a = spark.createDataFrame([("p1", "t")], "path string, title string")
    b = spark.createDataFrame([("p1", 1), ("p2", 2)], "path string, other int")
    got = files.gather([(a, "A"), (b, "B")], ["title", "path", "source"])
    assert sorted(r.path for r in got.collect()) == ["p1", "p2"] and got.columns == ["title", "path", "source"]


def test_listing_records(spark):
    page = '<div class="doc x"><h3 class="title"><a href="/view/1">A &amp; B</a></h3><span class="auth">M</span><span class="auth">N</span><br></div><div class="doc"><h3 class="title"></h3></div>'
    fields = {"title": html.Rule("h3", "title"), "authors": html.Rule("span", "auth", many=True), "link": html.Rule("a", attr="href")}
    df = spark.createDataFrame([("http://s/x", page), ("http://s/y", None)], "url string, html string")
    got = [tuple(r) for r in html.extract_records(df, html.Rule("div", "doc"), fields).orderBy("pos").collect()]
    assert got == [("http://s/x", 1, "A & B", ["M", "N"], "http://s/view/1"), ("http://s/x", 2, None, [], None)]
    assert html.download_link("http://s/view/1") == "http://s/download/1"


def test_new_articles_are_taken_once(spark, tmp_path):
    schema = "article_id long, page1 string, page2 string"
    long = "كلمة " * 250
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    spark.createDataFrame([(1, long, None), (2, "قصير", None)], schema).write.parquet(src)
    run = lambda: ingest.ingest(spark, src, spark.createDataFrame([], schema).schema, out, cp).awaitTermination(120)
    run()
    spark.createDataFrame([(1, long, None), (3, long, long)], schema).write.mode("append").parquet(src)
    run()
    assert sorted(r.article_id for r in spark.read.parquet(out).collect()) == [1, 3]


@pytest.mark.parametrize("n", [0, 3])
def test_windows(spark, n):
    at = datetime.datetime(2024, 1, 1, 10, 30)
    df = spark.createDataFrame([(at, "a")] * n, "ts timestamp, event_type string")
    assert [(r.event_type, r.n) for r in ingest.windowed_counts(df).collect()] == ([("a", 3)] if n else [])
