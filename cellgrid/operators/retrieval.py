"""Ranking pages: BM25 (two idf forms), cosine, late interaction, lexical fallback, oracle; unions and page scores.

Token statistics are aggregates over (document, token) and (document, page, token); a query
touches only the postings of its own tokens. No step gathers a document's pages in one task
beyond the top-k window, which is limited before its shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import casefold
from ..session import cut_lineage

K1, B = 1.5, 0.75


def page_text(spans: Column) -> Column:
    """Non-empty span texts, one per line."""
    texts = F.transform(F.coalesce(spans, F.array()), lambda s: F.coalesce(s["text"], F.lit("")))
    return F.array_join(F.filter(texts, lambda t: F.trim(t) != ""), "\n")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(casefold(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def postings(pages: DataFrame) -> DataFrame:
    """doc_id, page, dl (tokens of the page), tok, tf; a page without tokens is one row with null tok. Each page is read and tokenised once."""
    t = pages.select("doc_id", "page", tokens(F.col("text")).alias("t")).select("doc_id", "page", F.size("t").alias("dl"), F.explode_outer("t").alias("tok"))
    return t.groupBy("doc_id", "page", "dl", "tok").agg(F.count(F.lit(1)).alias("tf"))


def bm25_hits(posted: DataFrame, queries: DataFrame, okapi: bool = False) -> DataFrame:
    """query_id, doc_id, page, score of the pages that share a token with the query.

    queries: query_id, doc_id, text. A query token that repeats counts as often.
    okapi: idf without the added one, negatives raised to a quarter of the document's mean idf.
    """
    length = posted.select("doc_id", "page", "dl").distinct()
    stat = length.groupBy("doc_id").agg(F.count(F.lit(1)).alias("N"), F.avg("dl").alias("avgdl"))
    tf = posted.filter("tok is not null")
    df = tf.groupBy("doc_id", "tok").agg(F.count(F.lit(1)).alias("df")).join(stat, "doc_id")
    raw = (F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5)
    if okapi:
        df = df.withColumn("idf", F.ln(raw))
        mean = df.groupBy("doc_id").agg(F.avg("idf").alias("mean"))
        df = df.join(mean, "doc_id").withColumn("idf", F.when(F.col("idf") < 0, F.col("mean") * 0.25).otherwise(F.col("idf"))).drop("mean")
    else:
        df = df.withColumn("idf", F.ln(1 + raw))
    q = queries.select("query_id", "doc_id", F.explode(tokens(F.col("text"))).alias("tok")).groupBy("query_id", "doc_id", "tok").agg(F.count(F.lit(1)).alias("qn"))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.greatest("avgdl", F.lit(1e-9)))
    hit = q.join(df, ["doc_id", "tok"]).join(tf, ["doc_id", "tok"]).groupBy("query_id", "doc_id", "page").agg(F.sum(F.col("qn") * F.col("idf") * F.col("tf") * (K1 + 1) / norm).alias("score"))
    return hit.withColumn("score", F.round("score", 6))


def lexical_hits(posted: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, doc_id, page, score of the pages that share a token with the query: shared distinct tokens, plus 1 / (1 + page)."""
    q = queries.select("query_id", "doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("tok"))
    n = q.join(posted.filter("tok is not null").select("doc_id", "page", "tok"), ["doc_id", "tok"]).groupBy("query_id", "doc_id", "page").agg(F.count(F.lit(1)).alias("n"))
    return n.select("query_id", "doc_id", "page", F.round(F.col("n") + 1 / (1 + F.col("page")), 6).alias("score"))


def bm25(posted: DataFrame, queries: DataFrame, okapi: bool = False) -> DataFrame:
    """query_id, doc_id, page, score of every page of the query's document (0 where no token is shared)."""
    every = queries.select("query_id", "doc_id").join(posted.select("doc_id", "page").distinct(), "doc_id")
    hit = bm25_hits(posted, queries, okapi)
    return every.join(hit, ["query_id", "doc_id", "page"], "left").select("query_id", "doc_id", "page", F.coalesce("score", F.lit(0.0)).alias("score"))


def best_pages(hits: DataFrame, posted: DataFrame, queries: DataFrame, k: int, miss: Column | None = None) -> DataFrame:
    """query_id, doc_id, page, score, rank of the k best pages, without scoring the others.

    Every page that is no hit scores `miss` (0; or a falling function of the page), less than
    any hit, so the first pages of the document fill up the queries with fewer than k hits;
    of a document no more than its first 2 k pages can be needed.
    """
    miss = F.lit(0.0) if miss is None else miss
    top = cut_lineage(ranked(hits.filter("score > 0"), k))  # read three times; k rows a query
    first = posted.select("doc_id", "page").distinct().withColumn("__n", F.row_number().over(Window.partitionBy("doc_id").orderBy("page"))).filter(F.col("__n") <= 2 * max(k, 0)).select("doc_id", "page")
    few = queries.select("query_id", "doc_id").join(top.groupBy("query_id").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= k), "query_id", "left_anti")
    rest = few.join(first, "doc_id").join(top.select("query_id", "page"), ["query_id", "page"], "left_anti").withColumn("score", F.round(miss, 6))
    both = top.select("query_id", "doc_id", "page", "score").unionByName(rest.select("query_id", "doc_id", "page", "score"))
    return ranked(both, k)


def ranked(scores: DataFrame, k: int | None = None) -> DataFrame:
    """With rank from 1: score descending, page ascending."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "page")
    out = scores.withColumn("rank", F.row_number().over(w))
    return out if k is None else out.filter(F.col("rank") <= max(k, 0))


def normalized(scores: DataFrame) -> DataFrame:
    """Scores scaled to 0..1 per query; non-finite ones and constant queries give 0."""
    s = F.when(F.isnan("score") | F.col("score").isNull() | (F.abs("score") == float("inf")), 0.0).otherwise(F.col("score"))
    w = Window.partitionBy("query_id")
    x = scores.withColumn("score", s).withColumn("lo", F.min("score").over(w)).withColumn("hi", F.max("score").over(w))
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return x.withColumn("score", scaled).drop("lo", "hi")


def dot(a: Column, b: Column) -> Column:
    n = F.least(F.size(a), F.size(b))
    products = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """Over the shorter length; 0 where a norm is 0 or a vector is empty."""
    n = F.least(F.size(a), F.size(b))
    ok = (n > 0) & (norm(F.slice(a, 1, n)) > 0) & (norm(F.slice(b, 1, n)) > 0)
    return F.when(ok, dot(a, b) / (norm(F.slice(a, 1, n)) * norm(F.slice(b, 1, n)))).otherwise(0.0)


def max_sim(query: Column, page: Column) -> Column:
    """Sum over query vectors of the greatest dot product with a page vector."""
    each = F.transform(query, lambda q: F.array_max(F.transform(page, lambda p: dot(q, p))))
    return F.aggregate(each, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block: int = 1024) -> DataFrame:
    """query_id, page, score, rank: the k most similar vectors to each query, those of its own id aside.

    Both sides go in blocks of `block` rows; a task takes a pair of blocks and keeps the k best of each of
    its queries, so neither side is ever held whole. Scores as in cosine(); a vector with a null in it
    counts as empty, a row without an id is no page and no query.
    """
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def side(df: DataFrame, a: str) -> DataFrame:
        def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for at in range(0, len(pdf), block):
                    part = pdf.iloc[at : at + block]
                    yield pd.DataFrame({f"{a}_ids": [part["vec_id"].to_numpy()], f"{a}_sizes": [part["v"].map(len).to_numpy(np.int32)], f"{a}_flat": [np.concatenate(part["v"].to_list())]})

        v = F.col("embedding").cast("array<double>")
        whole = F.when(F.forall(v, lambda x: x.isNotNull()), v).otherwise(F.array().cast("array<double>")).alias("v")
        return df.filter("vec_id is not null").select("vec_id", whole).mapInPandas(packed, f"{a}_ids array<{kind}>, {a}_sizes array<int>, {a}_flat array<double>")

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                score = np.round(_cosines(r.q_sizes, r.q_flat, r.v_sizes, r.v_flat), 6) + 0.0
                by_id = np.argsort(r.v_ids, kind="stable")
                ids, score = r.v_ids[by_id], score[:, by_id]
                own = r.q_ids[:, None] == ids[None, :]
                order = np.argsort(np.where(own, np.inf, np.where(np.isnan(score), -np.inf, -score)), axis=1, kind="stable")[:, : max(k, 0)]
                at = np.arange(len(score))[:, None]
                some = ~own[at, order]
                yield pd.DataFrame({"query_id": np.broadcast_to(r.q_ids[:, None], order.shape)[some], "page": ids[order][some], "score": score[at, order][some]})

    pairs = side(vectors, "v").crossJoin(side(queries, "q"))
    return ranked(pairs.mapInPandas(best, f"query_id {kind}, page {kind}, score double"), k)


def _cosines(q_sizes: np.ndarray, q_flat: np.ndarray, v_sizes: np.ndarray, v_flat: np.ndarray) -> np.ndarray:
    """cosine() of every query and vector of two blocks, one product per pair of lengths."""
    out = np.zeros((len(q_sizes), len(v_sizes)))

    def rows(sizes: np.ndarray, flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        start = np.cumsum(sizes) - sizes
        return [(i, flat[start[i][:, None] + np.arange(n)]) for n in np.unique(sizes) if n for i in [np.flatnonzero(sizes == n)]]

    others = rows(v_sizes, v_flat)
    for i, x in rows(q_sizes, q_flat):
        for j, y in others:
            n = min(x.shape[1], y.shape[1])
            a, b = x[:, :n], y[:, :n]
            na, nb = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
            with np.errstate(divide="ignore", invalid="ignore"):
                c = a @ b.T / (na[:, None] * nb[None, :])
            c[(na == 0)[:, None] | (nb == 0)[None, :]] = 0.0
            out[np.ix_(i, j)] = c
    return out


def fallback_scores(pages: DataFrame, queries: DataFrame) -> DataFrame:
    """Shared distinct tokens, plus 1 / (1 + page)."""
    q = queries.select("query_id", "doc_id", F.array_distinct(tokens(F.col("text"))).alias("qt"))
    p = pages.select("doc_id", "page", F.array_distinct(tokens(F.col("text"))).alias("pt"))
    s = F.size(F.array_intersect("qt", "pt")) + 1 / (1 + F.col("page"))
    return q.join(p, "doc_id").select("query_id", "doc_id", "page", F.round(s, 6).alias("score"))


def _listed(scores: DataFrame) -> DataFrame:
    r = scores.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "page"))).alias("r"))
    return r.select("query_id", F.col("r.page").alias("ranking"))


def rankings(scores: DataFrame, k: int) -> DataFrame:
    """query_id, ranking: the k best pages in rank order; the rest is dropped before the shuffle."""
    return _listed(ranked(scores, k))


def listed(best: DataFrame) -> DataFrame:
    """query_id, ranking of ranked pages."""
    return _listed(best)


def rule_rankings(scores: DataFrame, gold: DataFrame, distractors: int) -> DataFrame:
    """query_id, ranking, gold: the gold pages and the best other ones that a rule can use, in rank order.

    A rule looks at no other page, so a document of any length gives a short list.
    """
    g = gold.select("query_id", F.explode("gold").alias("page"), F.lit(True).alias("own"))
    s = scores.join(g, ["query_id", "page"], "left").withColumn("own", F.coalesce("own", F.lit(False)))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "page")
    rest = s.filter(~F.col("own")).withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= max(distractors, 1)).drop("__n")
    return _listed(s.filter("own").unionByName(rest)).join(gold, "query_id")


def oracle_ranking(gold: Column, pages: Column) -> Column:
    """Gold pages in range first, in evidence order, then the rest ascending."""
    every = F.when(pages > 0, F.sequence(F.lit(0), pages - 1)).otherwise(F.array().cast("array<int>"))
    first = F.filter(F.array_distinct(gold), lambda g: (g >= 0) & (g < pages))
    return F.concat(first, F.array_except(every, first))


def top(ranking: Column, k: int) -> Column:
    return F.slice(ranking, 1, max(k, 0)) if k > 0 else F.array().cast("array<int>")


def union(a: Column, b: Column, cap: int | None = None) -> Column:
    u = F.array_union(a, b)
    return u if cap is None else F.slice(u, 1, cap)


def page_prf(got: Column, gold: Column) -> dict[str, Column]:
    """precision, recall, f1 of page sets."""
    g, w = F.array_distinct(F.coalesce(got, F.array())), F.array_distinct(F.coalesce(gold, F.array()))
    tp, n, m = F.size(F.array_intersect(g, w)), F.size(g), F.size(w)
    p = F.when((n == 0) & (m == 0), 1.0).when(n == 0, 0.0).otherwise(tp / n)
    r = F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0), 0.0).otherwise(tp / m)
    return {"precision": p, "recall": r, "f1": F.when((n == 0) & (m == 0), 1.0).when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))}


def evaluate(rank: DataFrame, gold: DataFrame, retriever: str, ks: tuple[int, ...]) -> DataFrame:
    """query_id, retriever, k, retrieved, precision, recall, f1 for every k."""
    r = rank.join(gold, "query_id").withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    r = r.withColumn("retrieved", F.expr("slice(ranking, 1, k)"))
    return r.select("query_id", F.lit(retriever).alias("retriever"), "k", "retrieved", "gold", *[c.alias(n) for n, c in page_prf(F.col("retrieved"), F.col("gold")).items()])


def summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "f1")])


def best_k(summaries: DataFrame) -> DataFrame:
    """The k of the best mean F1 per retriever; ties: the least k."""
    w = Window.partitionBy("retriever").orderBy(F.desc("f1"), "k")
    return summaries.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def truncation(lengths: Column, cap: int) -> dict[str, Column]:
    """Token lengths over a cap: pages cut and tokens lost."""
    return {"truncated_pages": F.size(F.filter(lengths, lambda n: n > cap)),
            "lost_tokens": F.aggregate(lengths, F.lit(0).cast("long"), lambda s, n: s + F.greatest(n - cap, F.lit(0)))}


def summary_with_total(rows: DataFrame, keys: list[str], detail: str) -> DataFrame:
    """summary() per (keys, detail) and pooled over detail ('(all)')."""
    every = [F.col(k) for k in [*keys, detail]]
    out = rows.groupingSets([every, every[:-1]], *every).agg(
        F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "f1")], F.grouping(detail).alias("__g"))
    return out.withColumn(detail, F.when(F.col("__g") == 1, "(all)").otherwise(F.col(detail))).drop("__g")


def first_pages(pages: Column, k: int) -> Column:
    """The first k pages of a document; nothing for k of 0."""
    n = F.least(F.lit(max(k, 0)), pages)
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _first(posted: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The stub: the first k pages, in order."""
    w = Window.partitionBy("doc_id").orderBy("page")
    first = posted.select("doc_id", "page").distinct().withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max(k, 0))
    return queries.select("query_id", "doc_id").join(first, "doc_id").select("query_id", "doc_id", "page", F.lit(0.0).alias("score"), "rank")


#: Retrievers by name: (postings, queries, k) -> query_id, doc_id, page, score, rank.
RETRIEVERS: dict[str, Callable[[DataFrame, DataFrame, int], DataFrame]] = {
    "none": _first,
    "bm25": lambda p, q, k: best_pages(bm25_hits(p, q), p, q, k),
    "bm25_okapi": lambda p, q, k: ranked(bm25(p, q, okapi=True), k),
    "lexical": lambda p, q, k: best_pages(lexical_hits(p, q), p, q, k, 1 / (1 + F.col("page"))),
}


def build(name: str | None) -> Callable[[DataFrame, DataFrame, int], DataFrame]:
    """The retriever of a name; no name is the stub, an unknown one raises and is never replaced silently."""
    key = (name or "none").strip().lower()
    if key not in RETRIEVERS:
        raise ValueError(f"unknown retriever {name!r}; known: {sorted(RETRIEVERS)}")
    return RETRIEVERS[key]


def as_vectors(c: Column, matrix: bool) -> Column:
    """array<array<double>> of an embedding column that holds one vector or a matrix; null gives no vector."""
    m = c if matrix else F.array(c)
    return F.coalesce(F.transform(F.filter(m, lambda v: v.isNotNull() & (F.size(v) > 0)), lambda v: v.cast("array<double>")), F.array().cast("array<array<double>>"))


def dense(pages: DataFrame, queries: DataFrame, posted: DataFrame, texts: DataFrame, k: int, fallback: bool = True) -> DataFrame:
    """query_id, doc_id, page, score, rank by cosine of vectors; queries without a vector, or whose document has none, fall back to BM25 where that is allowed.

    pages: doc_id, page, vector. queries: query_id, doc_id, vector. posted, texts: see bm25.
    """
    ok = F.col("vector").isNotNull() & (F.size("vector") > 0)
    p, q = pages.filter(ok), queries.filter(ok).withColumnRenamed("vector", "qv")
    scores = q.join(p, "doc_id").select("query_id", "doc_id", "page", F.round(cosine(F.col("qv"), F.col("vector")), 6).alias("score"))
    out = ranked(scores, k)
    rest = texts.join(scores.select("query_id").distinct(), "query_id", "left_anti")
    if fallback:
        return out.unionByName(best_pages(bm25_hits(posted, rest), posted, rest, k))
    if not rest.isEmpty():
        raise ValueError("questions without vectors and no fallback allowed")
    return out
