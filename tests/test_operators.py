import collections
import math
import random
from pathlib import Path

from pyspark.sql import functions as F

from warraq.operators import profile, registry, relational, retrieval, services
from warraq.session import ensure_checkpoint_dir


def test_numbers_are_those_of_a_sort(spark):
    df = spark.createDataFrame([(i * 7919 % 1000, "x") for i in range(1000)], "id int, n string")
    got = relational.numbered(df.select("id"), [F.col("id")], "n", parts=7).orderBy("id").collect()
    assert [(r.id, r.n) for r in got] == [(i, i + 1) for i in range(1000)]


def test_split_is_exact_and_independent_of_layout(spark):
    df = spark.range(103).withColumnRenamed("id", "k")
    a = {r.k for r in relational.train_test(df, "42", "k").filter("is_test").collect()}
    b = {r.k for r in relational.train_test(df.repartition(5), "42", "k").filter("is_test").collect()}
    assert a == b and len(a) == 21


def test_prefer_existing_and_alignment(spark):
    df = spark.createDataFrame([(1, None, "n"), (2, " ", "n"), (3, "old", "n")], "id int, t string, t_new string")
    assert [r.t for r in relational.prefer_existing(df, {"t": "t_new"}).orderBy("id").collect()] == ["n", "n", "old"]
    assert relational.align(df, ["id", "zzz"]).first() == ("1", "")


def test_histogram_and_box(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 3, 10)] + [(None,)], "v double")
    assert {r.bin: r.n for r in profile.histogram(df, "v", 5).collect()} == {1: 2, 2: 2, 5: 1}
    r = profile.box(df, "v").first()
    assert (r.q1, r.median, r.q3, r.low, r.high) == (1.0, 2.0, 3.0, 0.0, 3.0)
    one = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    assert [tuple(r) for r in profile.histogram(one, "v", 4).collect()] == [(1, 2)]


def test_null_counts_and_duplicates(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    assert {r.column_name: r.nulls for r in profile.null_counts(df).collect()} == {"a": 0, "b": 2}
    assert profile.duplicate_rows(df).first().n_duplicates == 1
    assert profile.duplicate_rows(df.limit(0)).first().n_duplicates == 0


def test_registry(spark):
    names = spark.createDataFrame([(2, "د. منى"), (1, "Dr. Ann Lee (1)"), (3, "منى"), (4, "x"), (5, None)], "pos int, raw string").withColumn("name", registry.clean_name(F.col("raw")))
    assert [tuple(r) for r in registry.register(names, ["pos"]).orderBy("id").collect()] == [("AUTH_00001", "Ann Lee"), ("AUTH_00002", "منى")]


def test_imputation_draws_distinct_known_authors(spark):
    pool = spark.createDataFrame([(f"A{i:03d}",) for i in range(50)], "author_id string")
    got = registry.impute(spark.range(2000).withColumnRenamed("id", "article_id"), pool).collect()
    per = collections.defaultdict(list)
    for r in got:
        per[r.article_id].append((r.author_pos, r.author_id))
    sizes = collections.Counter(len(v) for v in per.values())
    assert len(per) == 2000 and all(len({a for _, a in v}) == len(v) for v in per.values())
    assert abs(sizes[1] / 2000 - 0.6) < 0.05 and abs(sizes[2] / 2000 - 0.3) < 0.05 and max(sizes) <= 4


def test_author_stats_skew(spark):
    links = spark.createDataFrame([("hot", i % 40) for i in range(3000)] + [("b", 1), (None, 2)], "author_id string, article_id long")
    assert {tuple(r) for r in registry.author_stats(links).collect()} == {("hot", 40), ("b", 1)}
    # no row holds more than a range of numbers, and together they hold all
    pieces = {(r.author_id, r.piece): list(r.articles_ids) for r in registry.author_articles(links, span=16).collect()}
    assert pieces == {("hot", 0): list(range(16)), ("hot", 1): list(range(16, 32)), ("hot", 2): list(range(32, 40)), ("b", 0): [1]}


def test_author_ids_stand_in_the_list_s_order(spark):
    articles = spark.createDataFrame([(1, ["د. منى", "Ann Lee", "منى", "x"]), (2, []), (3, None), (4, ["Nobody Known"])], "article_id long, names array<string>")
    known = spark.createDataFrame([("AUTH_00001", "Ann Lee"), ("AUTH_00002", "منى")], "id string, name string")
    got = {r.article_id: r.author_ids for r in registry.author_ids(articles, "names", known).collect()}
    assert got == {1: ["AUTH_00002", "AUTH_00001"], 2: [], 3: [], 4: []}


def test_every_query_row_has_neighbours(spark):
    docs = [(k, f"alpha beta word{k % 3} again") for k in range(1, 9)] + [(20, "alpha word1"), (40, "nothing known here"), (60, None)]
    df = spark.createDataFrame(docs, "row_no long, t string")
    got = {}
    for r in retrieval.neighbours(df, "row_no", "t", F.col("row_no") % 20 == 0, k=5).collect():
        got.setdefault(r.query_no, []).append((r.rank, r.row_no, round(r.score, 3)))
    assert set(got) == {20, 40, 60} and all(sorted(x[0] for x in v) == [1, 2, 3, 4, 5] for v in got.values())
    assert all(x[2] == 0 for q in (40, 60) for x in got[q]) and [x[1] for x in sorted(got[40])] == [1, 2, 3, 4, 5]
    assert sorted(got[20])[0][2] > 0 and {x[1] for x in sorted(got[20])[:3]} == {1, 4, 7}
    assert retrieval.neighbours(df.filter("row_no % 20 = 0"), "row_no", "t", F.col("row_no") % 20 == 0).collect() == []


def test_hot_terms_are_split_without_loss(spark, monkeypatch):
    df = spark.createDataFrame([(k, f"common term{k % 5} term{k % 7}") for k in range(1, 200)], "row_no long, t string")
    asks = F.col("row_no") % 20 == 0
    whole = {(r.query_no, r.row_no, round(r.score, 9), r.rank) for r in retrieval.neighbours(df, "row_no", "t", asks).collect()}
    monkeypatch.setattr(retrieval, "HOT", 10)
    assert {(r.query_no, r.row_no, round(r.score, 9), r.rank) for r in retrieval.neighbours(df, "row_no", "t", asks).collect()} == whole


def test_neighbours_in_blocks_are_those_of_brute_force(spark, monkeypatch):
    random = __import__("random").Random(3)
    # frequent words, rare ones, equal texts
    words = [f"word{int(40 * random.random() ** 3)}" if random.random() < 0.9 else f"rare{random.randrange(60)}" for _ in range(1500)]
    texts = {k: " ".join(words[6 * (k % 150) : 6 * (k % 150) + 9]) for k in range(1, 301)}
    df = spark.createDataFrame(list(texts.items()), "row_no long, t string")
    told = {k: collections.Counter(t.split()) for k, t in texts.items()}
    held = collections.Counter(w for k, c in told.items() if k % 20 for w in c)
    raw = {k: {w: (1 + math.log(n)) * (math.log(286 / (1 + held[w])) + 1) for w, n in c.items() if held[w] >= 2} for k, c in told.items()}
    unit = {k: {w: x / math.sqrt(sum(y * y for y in v.values())) for w, x in v.items()} for k, v in raw.items()}
    want = set()
    for q in (k for k in texts if k % 20 == 0):
        scores = {d: sum(x * unit[d].get(w, 0) for w, x in unit[q].items()) for d in texts if d % 20}
        want |= {(q, d, r) for r, d in enumerate(sorted(scores, key=lambda d: (-round(scores[d], 9), d))[:7], 1)}
    for block in (1_500_000, 50):
        monkeypatch.setattr(retrieval, "BLOCK", block, raising=False)
        got = retrieval.neighbours(df, "row_no", "t", F.col("row_no") % 20 == 0, k=7).collect()
        assert {(r.query_no, r.row_no, r["rank"]) for r in got} == want and len(got) == 15 * 7


def test_neighbours_shuffle_no_pairs(spark):
    df = spark.createDataFrame([(k, f"common other term{k % 50}") for k in range(1, 1001)], "row_no long, t string")
    store = spark.sparkContext._jsc.sc().statusStore()

    def shuffled() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = shuffled()
    # as with tables that are too large for one partition
    large = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    was = {c: spark.conf.get(c) for c in large}
    try:
        for c, v in large.items():
            spark.conf.set(c, v)
        assert retrieval.neighbours(df, "row_no", "t", F.col("row_no") % 2 == 0, k=3).count() == 1500
    finally:
        for c, v in was.items():
            spark.conf.set(c, v)
    # 500 queries and 500 documents have 250,000 pairs
    assert 0 < shuffled() - before < 50_000


def test_vectors_in_blocks(spark):
    random = __import__("random").Random(1)
    rows = [(k, [random.random() - 0.5 for _ in range(6)]) for k in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    one = sorted(map(tuple, retrieval.dense_neighbours(df.filter("vec_id % 20 = 0"), df, 4).select("query_id", "id", "rank").collect()))
    many = sorted(map(tuple, retrieval.dense_neighbours(df.filter("vec_id % 20 = 0"), df, 4, block=2).select("query_id", "id", "rank").collect()))
    assert one == many and len(one) == 6 * 4


def test_reviewers(spark):
    rows = [
        (1, 1, 0.9, ["a"]), (1, 2, 0.8, ["b"]),
        (2, 1, 0.9, ["a", "b"]), (2, 2, 0.8, ["c"]), (2, 3, 0.7, ["b"]),
        (3, 1, 0.9, ["a", "b", "c"]), (3, 2, 0.8, ["a", "b"]), (3, 3, 0.7, ["a", "b"]),
        (4, 1, 0.0, ["a"]), (5, 1, 0.5, []),
    ]
    df = spark.createDataFrame(rows, "q int, rank int, score double, authors array<string>")
    got = {r.q: (r.winner, r.method) for r in retrieval.choose_reviewer(df, "q").collect()}
    assert got[1] == ("a", "Direct Match") and got[2] == ("b", "Tie broken by rank 3")
    assert got[3][0] in ("a", "b") and got[3][1] == "Random Fallback (Tie)"
    assert got[4] == (None, "No Matches") and got[5] == (None, "No Candidates")


def test_clients_are_asked_for_what_is_needed(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, "x")], "k int, t string")
    out = services.ask_once(df, "t", lambda: lambda ts: [t.upper() for t in ts]).orderBy("k").collect()
    assert [r.reply for r in out] == ["X", None, "X"]
    assert [r.reply for r in services.ask(df, "t", services.echo).orderBy("k").collect()] == ["x", None, "x"]


def test_enrichment_asks_for_incomplete_rows_alone(spark):
    schema = "article_id int, title string, abstract_ar string, general_field string, authors string, page1 string, page2 string"
    df = spark.createDataFrame([(1, "t", "a", "Art", "x", "p", "q"), (2, None, "kept", None, "", "p", None)], schema)

    def client():
        def reply(prompts):
            assert len(prompts) == 1 and "PAGE 1:\np" in prompts[0]
            return ['so: {"title_ar": "new", "abstract_ar": "other", "general_field": "Music", "authors": ["m"]}']

        return reply

    got = services.enrich(df, client, ("Art", "Music", "Education")).orderBy("article_id").collect()
    assert [tuple(r)[1:5] for r in got] == [("t", "a", "Art", "x"), ("new", "kept", "Music", '["m"]')]


def test_corrected_names(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, n string")
    client = lambda: lambda ts: ['[{"latin": "A", "ar": "ا"}]' if t == "a" else "no list" for t in ts]
    got = services.corrected_names(df, "n", client).orderBy("k").collect()
    assert [[tuple(p) for p in r.pairs] for r in got] == [[("A", "ا")], [], []]


def test_summaries(spark):
    chosen = spark.createDataFrame([(1, "a", "m"), (2, "z", "m"), (3, None, "m")], "q int, winner string, method string")
    actual = spark.createDataFrame([(1, "a"), (1, "b"), (2, "y")], "q int, author_id string")
    names = spark.createDataFrame([("a", "Ann"), ("b", "Bob")], "id string, name string")
    got = {r.q: (r.recommended, list(r.actual), r.hit) for r in retrieval.reviewer_summary(chosen, actual, names, "q").collect()}
    assert got == {1: ("Ann", ["Ann", "Bob"], True), 2: ("Unknown (z)", ["Unknown (y)"], False), 3: ("N/A", [], False)}


def test_neighbours_keep_little_on_disk(spark):
    draw = random.Random(7)
    rows = [(k, " ".join(f"kelime{draw.randrange(900)}" for _ in range(200))) for k in range(2000)]
    df = spark.createDataFrame(rows, "row_no long, text string").repartition(4)
    there = Path(ensure_checkpoint_dir(spark))
    size = lambda: sum(f.stat().st_size for f in there.rglob("*") if f.is_file())
    before = size()
    got = retrieval.neighbours(df, "row_no", "text", F.col("row_no") % 20 == 0, 3)
    # texts and packed blocks of 400,000 occurrences
    assert size() - before < 6 * 400_000
    assert got.count() == 300
