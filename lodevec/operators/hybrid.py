"""Hybrid retrieval: lexical scores over a candidate pool, fused with similarity by rank or by weight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodevec.functions import text as T
from lodevec.operators import search

RRF_K = 60


def rerank(hits: DataFrame, query: Column | str, k: int | None = None, fusion: str = "rrf", weight: float = 0.5, rrf_k: int = RRF_K, text: str = "text", by: tuple[str, ...] = ()) -> DataFrame:
    """hits (score, rank from 1) with ann_score, lexical_score, hybrid_score and hybrid_rank (from 1).

    by names the columns that tell several queries' pools apart; query may be a column then. The
    pool is what was asked for in the first stage, so its windows hold candidate_k rows a query.
    All scores are rounded to four places before sorting, ties keep the similarity order. A query
    without usable tokens keeps that order, with lexical score 0 and its similarity as hybrid score.
    """
    if fusion not in ("rrf", "weighted"):
        raise ValueError("fusion must be 'rrf' or 'weighted'")
    w = min(1.0, max(0.0, float(weight)))
    pool = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    q = T.tokens(F.lit(query) if isinstance(query, str) else query)
    h = hits.withColumns({"__q": q, "__d": T.tokens(F.coalesce(F.col(text), F.lit("")))})
    h = h.withColumn("__avg", F.avg(F.size("__d")).over(pool))
    h = h.withColumn("__raw", T.bm25(F.col("__q"), F.col("__d"), F.when(F.col("__avg") > 0, F.col("__avg")).otherwise(1.0)))
    h = h.withColumn("__lex", F.col("__raw") / F.greatest(F.max("__raw").over(pool), F.lit(1e-9)))
    h = h.withColumn("__ann", F.col("rank") - 1)
    h = h.withColumn("__lrank", F.row_number().over(pool.orderBy(F.desc("__lex"), "__ann")) - 1)
    if fusion == "rrf":
        fused = 1.0 / (F.lit(float(rrf_k)) + F.col("__ann") + 1) + 1.0 / (F.lit(float(rrf_k)) + F.col("__lrank") + 1)
    else:
        fused = F.lit(1 - w) * F.col("score") + F.lit(w) * F.col("__lex")
    none = F.size("__q") == 0
    h = h.withColumns({
        "ann_score": T.js_round(F.col("score")),
        "lexical_score": F.when(none, 0.0).otherwise(T.js_round(F.col("__lex"))),
        "hybrid_score": T.js_round(F.when(none, F.col("score")).otherwise(fused)),
    })
    order = [F.asc("__ann")]
    h = h.withColumn("hybrid_rank", F.row_number().over(pool.orderBy(F.when(none, 0.0).otherwise(-F.col("hybrid_score")), *order)))
    h = h.drop("__q", "__d", "__avg", "__raw", "__lex", "__ann", "__lrank")
    return h.where(F.col("hybrid_rank") <= k) if k else h


def retrieve(collection: DataFrame, query_vector, query_text: str, k: int = 5, *, start: str | None = None, end: str | None = None, candidate_k: int = 0, hybrid: bool = False, fusion: str = "rrf", weight: float = 0.5, wanted: dict | None = None, tags: str = "tags", mode: str = "post", metric: str = "cosine", facts: DataFrame | None = None) -> DataFrame:
    """The whole pipeline: candidate pool, time window, fusion, tag filter, trim.

    mode 'post' cuts the pool first and filters after; 'pre' filters first, with full recall.
    facts (id, text, ts, tags, as far as needed) may be a table of its own: 'post' joins it to the
    pool only, 'pre' joins the columns that filter.
    """
    search.check_k(k, 500)
    pool_k = candidate_k if candidate_k >= k else search.CANDIDATES * k
    pooled = hybrid or bool(wanted)
    pre = mode == "pre"
    rows = collection
    if pre and facts is not None:
        rows = rows.join(facts.select("id", *(["ts"] if start or end else []), *([tags] if wanted else [])), "id", "left")
    if pre:
        rows = rows.where(search.in_window(F.col("ts"), start, end)) if start or end else rows
        rows = rows.where(T.matches(F.col(tags), wanted)) if wanted else rows
    n = pool_k if pooled else k
    if not pre and (start or end):
        hits = search.topk_in_window(rows, query_vector, n, start, end, n * search.CANDIDATES if pooled else pool_k, metric=metric, times=None if facts is None else facts.select("id", "ts"))
    else:
        hits = search.topk(rows, query_vector, n, metric)
    if facts is not None:
        hits = search.settled(hits)
        hits = search.attach(hits, facts.drop(*(c for c in hits.columns if c != "id")))
    if hybrid:
        hits = rerank(hits, query_text, None if wanted and not pre else k, fusion, weight)
        order = "hybrid_rank"
    else:
        order = "rank"
    if wanted and not pre:
        hits = hits.where(T.matches(F.col(tags), wanted))
    hits = hits.orderBy(order).limit(k)
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(order))).withColumn("score", T.js_round(F.col("score")))
