"""Lexical and vector retrieval: BM25, character n-gram TF-IDF, cosine, rank fusion.

Queries and documents are tables; every score is exact. Document frequencies and lengths are those of the whole table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions.text import col, normalize, overlap_jaccard, retrieval_tokens
from lodestrand.session import cut


def ranked(scores: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The ``k`` best of each query with their rank; ties by document."""
    rn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), "doc_id"))
    return scores.withColumn("rank", rn).where(F.col("rank") <= k)


def bm25(docs: DataFrame, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, part: int = 4096) -> DataFrame:
    """The ``k`` best documents (``doc_id``, ``text``) of each query (``query_id``, ``text``) of positive score.

    Terms count once in a text; rows of one id add up. Documents are in parts of about ``part`` by their id, and every part meets all
    queries: frequent terms as a product of matrices, the others by the part's inverted index. Only the ``k`` best of a part are shuffled.
    """
    d = docs.where("text is not null").select("doc_id", retrieval_tokens("text").alias("ts"))
    size = d.agg(F.count("*").alias("n"), F.avg(F.size("ts")).alias("avg_len"))
    idf = d.select(F.explode("ts").alias("t")).groupBy("t").agg(F.count("*").alias("df")).join(F.broadcast(size)).select("t", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    q = queries.where("text is not null").select("query_id", F.explode(retrieval_tokens("text")).alias("t")).groupBy("query_id", "t").agg(F.count("*").alias("n"))
    q = cut(q.join(idf, "t").groupBy("query_id").agg(F.collect_list(F.struct("t", (F.col("n") * F.col("idf")).alias("w"))).alias("x")).select("query_id", F.array_join("x.t", " ").alias("ts"), F.col("x.w").alias("ws")))
    n = docs.count()
    parts = max(-(-n // part), min(docs.sparkSession.sparkContext.defaultParallelism * 3, n // 64), 1)
    each = k1 * (1 - b + b * F.size("ts") / F.col("avg_len")) + 1
    held = d.where(F.size("ts") > 0).join(F.broadcast(size)).select(F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("p"), "doc_id", F.array_join("ts", " ").alias("ts"), ((k1 + 1) / each).alias("f"))
    asked = q.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def best(ds: pa.Table, qs: pa.Table) -> pa.Table:
        ds = ds.sort_by("doc_id")
        rows, ids = ds.num_rows, ds["doc_id"].combine_chunks()
        code = ids.dictionary_encode(null_encoding="encode").indices.to_numpy() if rows else np.zeros(0, int)
        starts = np.flatnonzero(np.diff(code, prepend=-1))
        words = pc.split_pattern(ds["ts"].combine_chunks(), " ")
        own = words.flatten().dictionary_encode()
        term, row = own.indices.to_numpy(), np.repeat(np.arange(rows), pc.list_value_length(words).to_numpy())
        df = np.bincount(term, minlength=len(own.dictionary))
        posting, first = row[np.argsort(term, kind="stable")], np.cumsum(df) - df
        often = np.flatnonzero(df * 32 > rows)
        column = np.full(len(df), -1)
        column[often] = np.arange(len(often))
        dense = np.zeros((len(often), rows))
        here = column[term] >= 0
        dense[column[term[here]], row[here]] = 1.0
        found: list[tuple] = []
        for at in range(0, qs.num_rows if rows else 0, 256):
            block = qs.slice(at, 256).combine_chunks()
            asks = pc.split_pattern(block["ts"].combine_chunks(), " ")
            t = pc.fill_null(pc.index_in(asks.flatten(), value_set=own.dictionary), -1).to_numpy()
            i, w = np.repeat(np.arange(block.num_rows), pc.list_value_length(asks).to_numpy()), block["ws"].combine_chunks().flatten().to_numpy()
            i, w, t = i[t >= 0], w[t >= 0], t[t >= 0]
            m, c = np.zeros((block.num_rows, len(often))), column[t]
            m[i[c >= 0], c[c >= 0]] = w[c >= 0]
            i, w, t = i[c < 0], w[c < 0], t[c < 0]
            many = df[t]
            to = posting[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[t], many)]
            s = m @ dense + np.bincount(np.repeat(i, many) * rows + to, np.repeat(w, many), block.num_rows * rows).reshape(-1, rows)
            s *= ds["f"].to_numpy()
            s = np.round(np.add.reduceat(s, starts, axis=1) if len(starts) < rows else s, 6)
            least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.zeros(len(s))
            y, x = np.nonzero((s >= least[:, None]) & (s > 0))
            order = np.lexsort((x, -s[y, x], y))
            y, x = y[order], x[order]
            kept = np.arange(len(y)) - np.searchsorted(y, y) < k
            found.append((block["query_id"].take(pa.array(y[kept])), ids.take(pa.array(starts[x[kept]])), s[y[kept], x[kept]]))
        cast = lambda j, c: pa.chunked_array([z for f in found for z in (f[j].chunks if isinstance(f[j], pa.ChunkedArray) else [f[j]])], c)
        return pa.table({"query_id": cast(0, qs.schema.field("query_id").type), "doc_id": cast(1, ds.schema.field("doc_id").type), "score": pa.array(np.concatenate([np.zeros(0), *(f[2] for f in found)]))})

    out = f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double"
    return ranked(held.groupBy("p").cogroup(asked.groupBy("p")).applyInArrow(best, out), k)


def char_grams(c: str | Column, low: int = 2, high: int = 4) -> Column:
    """Character n-grams of each word with a space at either end, as often as they occur."""
    words = F.filter(F.split(normalize(c), " "), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of(n: int) -> Column:
        def runs(w: Column) -> Column:
            at = F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1)))
            return F.when(F.length(w) >= n, F.transform(at, lambda i: F.substring(w, i, n))).otherwise(F.array().cast("array<string>"))

        return F.flatten(F.transform(padded, runs))

    grams = [of(n) for n in range(low, high + 1)]
    return F.concat(*grams)


def tfidf(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Cosine of sub-linear TF-IDF vectors of character n-grams; n-grams no document has do not count."""
    tf = lambda x, i: x.where("text is not null").select(i, F.explode(char_grams("text")).alias("g")).groupBy(i, "g").agg((1 + F.log(F.count("*").cast("double"))).alias("tf"))
    dt = tf(docs, "doc_id")
    n = docs.where("text is not null").agg(F.count("*").alias("n"))
    idf = dt.groupBy("g").agg(F.count("*").alias("df")).join(F.broadcast(n)).select("g", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    dw = dt.join(idf, "g").select("doc_id", "g", (F.col("tf") * F.col("idf")).alias("w"))
    qw = tf(queries, "query_id").join(idf, "g").select("query_id", "g", (F.col("tf") * F.col("idf")).alias("v"))
    dn = dw.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("dn"))
    qn = qw.groupBy("query_id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("qn"))
    dot = qw.join(dw, "g").groupBy("query_id", "doc_id").agg(F.sum(F.col("v") * F.col("w")).alias("dot"))
    s = dot.join(dn, "doc_id").join(qn, "query_id").select("query_id", "doc_id", F.round(F.col("dot") / (F.col("dn") * F.col("qn")), 6).alias("score"))
    return ranked(s, k)


def fuse(*lists: DataFrame, k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists."""
    both = lists[0].select("query_id", "doc_id", "rank")
    for x in lists[1:]:
        both = both.unionByName(x.select("query_id", "doc_id", "rank"))
    s = both.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 8).alias("score"))
    return ranked(s, k)


def rerank(fused: DataFrame, queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Fused score plus Jaccard overlap and .2 for a title of more than half overlap (``docs`` has ``title``)."""
    j = fused.select("query_id", "doc_id", "score").join(queries.select("query_id", F.col("text").alias("q")), "query_id").join(docs.select("doc_id", "title", "text"), "doc_id")
    s = F.round(F.col("score") + overlap_jaccard("q", "text") + F.when(overlap_jaccard("q", "title") > 0.5, 0.2).otherwise(0.0), 6)
    return ranked(j.select("query_id", "doc_id", s.alias("score")), k)


def unit_vector(c: str | Column) -> Column:
    """A vector divided by its length; null for a null vector or one of length 0."""
    v = F.transform(col(c), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm))


def cosine_top(rows: DataFrame, queries: DataFrame, k: int, block: int = 1024) -> DataFrame:
    """The ``k`` rows (``doc_id``, ``vec``) of largest cosine for each query (``query_id``, ``vec``).

    Queries against all rows in blocks: rows and queries are packed into matrices of ``block`` vectors, every matrix of rows
    meets every matrix of queries once, and only the ``k`` best of a pair of blocks are shuffled. A row is no match of itself.
    """
    r, q = rows.where("vec is not null"), queries.where("vec is not null")

    def pack(x: DataFrame, i: str, name: str) -> DataFrame:
        n = max(1, -(-x.count() // block))
        return x.select(F.pmod(F.xxhash64(i), F.lit(n)).alias(name), F.struct(i, "vec").alias("e")).groupBy(name).agg(F.collect_list("e").alias(f"{name}s"))

    qs = pack(q, "query_id", "qb")
    names = [x["qb"] for x in qs.select("qb").collect()]
    pairs = pack(r, "doc_id", "rb").withColumn("qb", F.explode(F.array(*(F.lit(n) for n in names)).cast("array<bigint>"))) if names else pack(r, "doc_id", "rb").withColumn("qb", F.lit(-1).cast("bigint"))
    both = pairs.join(qs.withColumn("qb", F.col("qb").cast("bigint")), "qb").select("rbs", "qbs")

    def best(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for rs, qx in zip(b["rbs"], b["qbs"]):
                ids, qids = np.array([x["doc_id"] for x in rs]), np.array([x["query_id"] for x in qx])
                m = np.stack([np.asarray(x["vec"], float) for x in qx]) @ np.stack([np.asarray(x["vec"], float) for x in rs]).T
                m[qids[:, None] == ids[None, :]] = -9.0
                m = np.round(m, 6)
                order = np.lexsort((np.broadcast_to(ids, m.shape), -m), axis=1)[:, :k]
                top = np.take_along_axis(m, order, axis=1)
                out = pd.DataFrame({"query_id": np.repeat(qids, order.shape[1]), "doc_id": ids[order].ravel(), "score": top.ravel()})
                yield out[out["score"] > -2]

    return ranked(both.mapInPandas(best, "query_id bigint, doc_id bigint, score double"), k)
