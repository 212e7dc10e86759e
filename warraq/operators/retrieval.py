"""TF-IDF retrieval and the sequential choice among a neighbour's authors."""

from __future__ import annotations

import io
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from warraq.functions.text import terms
from warraq.session import cut, stored


def term_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf)."""
    return docs.select(key, F.explode(terms(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


#: The terms of most documents, up to so many, are broadcast; only rarer ones meet their documents in a shuffle.
HOT = 50_000
#: Terms of documents, and of queries, that one task compares.
BLOCK = 1_500_000


#: Occurrences that a task gathers before it hands them on.
GATHERED = 400_000
_PACKED = pa.schema([("_asks", pa.bool_()), ("_b", pa.int32()), ("data", pa.binary())])
_PACKED_SQL = "_asks boolean, _b int, data binary"


def _summed(key: np.ndarray, term: np.ndarray, df: np.ndarray, tf: np.ndarray) -> bytes:
    """Occurrences (key, id, df, tf) as one compressed string, those of one key and id summed up: keys with their number of terms, ids with their df once, a place among the ids and a tf for each pair."""
    order = np.lexsort((term, key))
    key, term, df, tf = key[order], term[order], df[order], tf[order]
    first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (term[1:] != term[:-1])])
    tf = np.add.reduceat(tf, first)
    keys, n = np.unique(key[first], return_counts=True)
    ids, at, place = np.unique(term[first], return_index=True, return_inverse=True)
    least = lambda x: x.astype(np.min_scalar_type(int(x.max())))
    out = io.BytesIO()
    np.savez(out, keys=keys, n=least(n), ids=ids, df=least(df[first][at]), place=least(place), tf=least(tf))
    return zlib.compress(out.getbuffer(), 1)


def _occurrences(data: bytes) -> tuple[np.ndarray, ...]:
    """(key, id, df, tf) of ``_summed``, by key and id."""
    x = np.load(io.BytesIO(zlib.decompress(data)))
    place = x["place"]
    return np.repeat(x["keys"], x["n"]), x["ids"][place], x["df"][place].astype(np.int64), x["tf"].astype(np.int64)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences (_asks, _b, key, id, df) as a few rows (_asks, _b, data), so that no single one is shuffled."""

    def handed_on(some: list[pa.RecordBatch]) -> pa.RecordBatch:
        asks, b, key, term, df = (np.concatenate([x.column(c).to_numpy(zero_copy_only=False) for x in some]) for c in range(5))
        group = b.astype(np.int64) * 2 + asks
        order = np.argsort(group, kind="stable")
        cuts = np.flatnonzero(np.diff(group[order])) + 1
        parts = np.split(order, cuts) if len(order) else []
        data = [_summed(key[p], term[p], df[p], np.ones(len(p), np.int64)) for p in parts]
        return pa.RecordBatch.from_arrays([pa.array([bool(asks[p[0]]) for p in parts], pa.bool_()), pa.array([int(b[p[0]]) for p in parts], pa.int32()), pa.array(data, pa.binary())], schema=_PACKED)

    some: list[pa.RecordBatch] = []
    for batch in batches:
        some.append(batch)
        if sum(x.num_rows for x in some) >= GATHERED:
            yield handed_on(some)
            some = []
    if some:
        yield handed_on(some)


def _pack(block: pa.Table) -> pa.Table:
    """All rows (_asks, _b, data) of a block as one."""
    parts = zip(*(_occurrences(x.as_py()) for x in block.column("data")))
    data = _summed(*(np.concatenate(x) for x in parts))
    return pa.table({"_asks": [block.column("_asks")[0].as_py()], "_b": [block.column("_b")[0].as_py()], "data": [data]}, schema=_PACKED)


def _weights(data: bytes, n_docs: int) -> tuple[np.ndarray, ...]:
    """(keys, place among them, id, weight) of a block.

    Weights: sublinear tf times smooth idf, of length 1 for each document.
    """
    key, term, df, tf = _occurrences(data)
    raw = (1.0 + np.log(tf)) * (np.log((1.0 + n_docs) / (1.0 + df)) + 1.0)
    keys, at = np.unique(key, return_inverse=True)
    return keys, at, term, raw / np.sqrt(np.bincount(at, raw * raw))[at]


def _best(k: int, n_docs: int) -> Callable[[pa.Table], pa.Table]:
    """(query, key, score, _r): the ``k`` best documents of a block for each query of a block, all pairs with a term in common compared.

    Terms in a sixteenth of the documents are multiplied as full matrices, the
    others by their lists of documents.
    """
    schema = pa.schema([("query", pa.int64()), ("key", pa.int64()), ("score", pa.float64()), ("_r", pa.int64())])

    def best(pair: pa.Table) -> pa.Table:
        sides = {r["_asks"]: _weights(r["data"], n_docs) for r in pair.to_pylist()}
        if len(sides) < 2:
            return schema.empty_table()
        (qkeys, qat, qid, qw), (dkeys, dat, did, dw) = sides[True], sides[False]
        ids, did = np.unique(did, return_inverse=True)
        there = np.isin(qid, ids)
        qat, qid, qw = qat[there], np.searchsorted(ids, qid[there]), qw[there]
        n, groups = len(dkeys), 8 * k
        wide = -(-n // groups) * groups
        dense = np.flatnonzero(np.bincount(did) * 16 >= n)
        place = np.full(len(ids), -1)
        place[dense] = np.arange(len(dense))
        frequent = place[did] >= 0
        matrix = np.zeros((len(dense), wide))
        matrix[place[did[frequent]], dat[frequent]] = dw[frequent]
        dat, did, dw = dat[~frequent], did[~frequent], dw[~frequent]
        order = np.argsort(did, kind="stable")
        dat, dw, ends = dat[order], dw[order], np.r_[0, np.cumsum(np.bincount(did, minlength=len(ids)))]
        found = []
        step = max(1, 8_000_000 // wide)
        for lo in range(0, len(qkeys), step):
            some = np.flatnonzero((qat >= lo) & (qat < lo + step))
            rows, terms_, weights = qat[some] - lo, qid[some], qw[some]
            often = place[terms_] >= 0
            asked = np.zeros((min(step, len(qkeys) - lo), len(dense)))
            asked[rows[often], place[terms_[often]]] = weights[often]
            scores = asked @ matrix
            rows, terms_, weights = rows[~often], terms_[~often], weights[~often]
            order = np.argsort(terms_, kind="stable")
            rows, terms_, weights = rows[order], terms_[order], weights[order]
            cuts = np.flatnonzero(np.diff(terms_)) + 1
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(terms_)]) if len(terms_) else ():
                docs = slice(ends[terms_[a]], ends[terms_[a] + 1])
                scores[np.ix_(rows[a:b], dat[docs])] += np.outer(weights[a:b], dw[docs])
            # the k-th of the groups' best scores: k documents at least have as much
            least = np.partition(scores.reshape(len(scores), groups, -1).max(axis=2), groups - k, axis=1)[:, groups - k]
            q, d = np.nonzero(scores >= np.maximum(least - 2e-9, 1e-300)[:, None])
            score = scores[q, d]
            rounded = np.floor(score * 1e9 + 0.5).astype(np.int64)
            order = np.lexsort((dkeys[d], -rounded, q))
            q, d, score, rounded = q[order], d[order], score[order], rounded[order]
            kept = np.arange(len(q)) - np.searchsorted(q, q) < k
            found.append((qkeys[lo + q[kept]], dkeys[d[kept]], score[kept], rounded[kept]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*found)], schema=schema)

    return best


def _weighed(texts: DataFrame, vocabulary: DataFrame, size: int) -> DataFrame:
    """(key, _asks, id, df) of every occurrence of a known term."""
    told = texts.select("key", "_asks", F.explode(terms(F.col("text"))).alias("term"))
    if size <= HOT:
        return told.join(F.broadcast(vocabulary), "term").drop("term")
    hot = cut(vocabulary.orderBy(F.desc("df"), "term").limit(HOT))
    met = told.join(F.broadcast(hot), "term", "left")
    rare = met.filter("id is null").select("key", "_asks", "term").join(vocabulary, "term")
    return met.filter("id is not null").drop("term").unionByName(rare.drop("term"))


def neighbours(docs: DataFrame, key: str, text: str, asks: Column, k: int = 20, qkey: str = "query_no", min_df: int = 2) -> DataFrame:
    """(qkey, key, score, rank): the ``k`` best documents of every query by TF-IDF cosine.

    Rows where ``asks`` holds are the queries. The vocabulary, its document
    frequencies and the documents searched are the other rows alone, as a
    model fitted on the train part has them. Every query has its rows: where
    fewer than ``k`` documents have a term in common, the first others by key
    follow with score 0.

    Every block of queries meets every block of documents in one task, which
    hands on the ``k`` best documents of a query, so no pair is shuffled.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"), F.coalesce(asks, F.lit(False)).alias("_asks"))
    texts = stored(rows.groupBy("key", "_asks").agg(F.concat_ws(" ", F.collect_list("text")).alias("text"), F.count("*").alias("_rows")))
    n = texts.filter("not _asks").agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    seen = texts.select("_asks", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.when(~F.col("_asks"), 1)).alias("df"), F.count(F.when(F.col("_asks"), 1)).alias("asked"))
    vocabulary = cut(seen.filter(F.col("df") >= min_df).withColumn("id", F.monotonically_increasing_id()))
    size, held, asked = vocabulary.agg(F.count("*"), F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("asked"), F.lit(0))).first()
    d_blocks, q_blocks = max(1, -(-held // BLOCK)), max(1, -(-asked // BLOCK))
    block = F.pmod(F.xxhash64("key"), F.when(F.col("_asks"), q_blocks).otherwise(d_blocks)).cast("int")
    known = _weighed(texts, vocabulary.drop("asked"), size).select("_asks", block.alias("_b"), "key", "id", "df")
    packed = cut(known.mapInArrow(_gather, _PACKED_SQL).groupBy("_asks", "_b").applyInArrow(_pack, _PACKED_SQL))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    what = ("_asks", "data")
    pairs = packed.filter("_asks").select(F.col("_b").alias("_i"), every(d_blocks).alias("_j"), *what).unionByName(packed.filter("not _asks").select(every(q_blocks).alias("_i"), F.col("_b").alias("_j"), *what))
    met = pairs.groupBy("_i", "_j").applyInArrow(_best(k, n), "query bigint, key bigint, score double, _r bigint")
    best = met.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("_r"), "key"))).filter(F.col("rank") <= k)
    best = cut(best.select(F.col("query").alias(qkey), F.col("key").alias(key), "score", "rank"))
    # 2k rows at most; the k of a query that are no match of its own are among them
    first = [r["key"] for r in texts.filter("not _asks").select("key").orderBy("key").limit(2 * k).collect()]
    test = texts.filter("_asks").select(F.col("key").alias(qkey))
    short = test.join(best.groupBy(qkey).agg(F.count("*").alias("_n")), qkey, "left").withColumn("_n", F.coalesce("_n", F.lit(0))).filter(F.col("_n") < k)
    pads = short.select(qkey, "_n", F.explode(F.array(*(F.lit(x) for x in first)) if first else F.array().cast("array<bigint>")).alias(key)).join(best.select(qkey, key), [qkey, key], "left_anti")
    w = Window.partitionBy(qkey).orderBy(key)
    pads = pads.withColumn("rank", F.row_number().over(w) + F.col("_n")).filter(F.col("rank") <= k)
    return best.unionByName(pads.select(qkey, key, F.lit(0.0).alias("score"), F.col("rank").cast("int").alias("rank")))


def choose_reviewer(ranked: DataFrame, qkey: str, authors: str = "authors", seed: str = "42") -> DataFrame:
    """(qkey, winner, method).

    ``ranked`` has the authors of each neighbour with its rank and score. The
    first neighbour's authors are narrowed by those of the next ones until one
    is left; a hash of query and author decides what stays tied.
    """
    lists = ranked.groupBy(qkey).agg(F.array_sort(F.collect_list(F.struct("rank", "score", F.array_distinct(F.col(authors)).alias("authors")))).alias("n"))
    anchor = F.col("n")[0]
    start = F.struct(anchor["authors"].alias("left"), F.lit(0).cast("int").alias("at"))

    def narrow(state, x):
        common = F.array_intersect(state["left"], x["authors"])
        undecided = (F.size(state["left"]) > 1) & (F.size(common) > 0)
        return F.struct(
            F.when(undecided, common).otherwise(state["left"]).alias("left"),
            F.when(undecided & (F.size(common) == 1), x["rank"].cast("int")).otherwise(state["at"]).alias("at"),
        )

    end = F.aggregate(F.slice("n", F.lit(2), F.size("n")), start, narrow)
    tied = F.array_sort(F.transform(F.col("e.left"), lambda a: F.struct(F.md5(F.concat_ws("|", F.lit(seed), F.col(qkey).cast("string"), a)).alias("h"), a.alias("a"))))[0]["a"]
    method = (
        F.when(F.coalesce(anchor["score"], F.lit(0.0)) == 0, "No Matches")
        .when(F.size(anchor["authors"]) == 0, "No Candidates")
        .when(F.size(anchor["authors"]) == 1, "Direct Match")
        .when(F.col("e.at") > 0, F.concat(F.lit("Tie broken by rank "), F.col("e.at").cast("string")))
        .otherwise("Random Fallback (Tie)")
    )
    out = lists.withColumn("e", end).withColumn("method", method)
    winner = F.when(F.col("method").isin("No Matches", "No Candidates"), None).when(F.size("e.left") == 1, F.col("e.left")[0]).otherwise(tied)
    return out.select(qkey, winner.alias("winner"), "method")


def dense_neighbours(queries: DataFrame, corpus: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block: int = 2048) -> DataFrame:
    """(query_id, id, score, rank): exact cosine top-k of a stated query set against all rows, in blocks of queries.

    Queries are gathered into blocks of about ``block`` vectors; each corpus
    row is sent to each block by the block's number, so neither side is
    broadcast, and no pair is shuffled before the first cut: a partition hands
    on its best k of a query.
    """
    unit = lambda v: F.transform(v, lambda x: x / F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, y: a + y * y)))
    q = queries.select(F.col(key).alias("query_id"), unit(F.col(vector).cast("array<double>")).alias("q"))
    c = corpus.select(F.col(key).alias("id"), unit(F.col(vector).cast("array<double>")).alias("c"))
    n = max(1, -(-queries.count() // block))
    blocks = q.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(n)).alias("_b")).agg(F.collect_list(F.struct("query_id", "q")).alias("some"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    sent = c.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))
    met = sent.join(blocks, "_b").select("id", F.explode(F.transform("some", lambda s: F.struct(s["query_id"].alias("query_id"), dot(s["q"], F.col("c")).alias("score")))).alias("x"))
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id")
    return met.select("x.query_id", "id", "x.score").filter("query_id <> id").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def reviewer_summary(chosen: DataFrame, actual: DataFrame, names: DataFrame, qkey: str) -> DataFrame:
    """(qkey, recommended, actual, hit): the chosen reviewer's name beside the names of the query's own authors.

    ``actual`` has (qkey, author_id), ``names`` (id, name). An unknown id shows
    as ``Unknown (id)``, no winner as ``N/A``.
    """
    known = lambda c: F.coalesce("name", F.when(F.col(c).isNull(), F.lit("N/A")).otherwise(F.concat(F.lit("Unknown ("), F.col(c), F.lit(")"))))
    own = actual.join(names, F.col("author_id") == F.col("id"), "left").groupBy(qkey).agg(F.array_sort(F.collect_set(known("author_id"))).alias("actual"), F.collect_set("author_id").alias("_ids"))
    won = chosen.join(names, F.col("winner") == F.col("id"), "left").select(qkey, "winner", known("winner").alias("recommended"))
    none = F.array().cast("array<string>")
    both = won.join(own, qkey, "left").select(qkey, "winner", "recommended", F.coalesce("actual", none).alias("actual"), F.coalesce("_ids", none).alias("_ids"))
    return both.select(qkey, "recommended", "actual", F.coalesce(F.array_contains("_ids", F.col("winner")), F.lit(False)).alias("hit"))
