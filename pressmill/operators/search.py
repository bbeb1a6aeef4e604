"""Vector, keyword and hybrid search over titles and passages.

Exact vector search is one scan with column pruning, the filter before the distance, top-k by Spark's bounded heap. Keywords
and their index are in textindex.py.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressmill.functions.scalars import InvalidRequest
from pressmill.operators import textindex
from pressmill.operators.articles import top_per_group
from pressmill.operators.textindex import TextIndex

LEG_ORDER = ("vector", "body_vector", "keyword", "body_keyword")
PASSAGE_CANDIDATES = 150


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def cosine_distance(v: Column, query: list[float]) -> Column:
    """1 - cosine; null for a vector of length zero. The query's length is worked out once, on the driver."""
    q = F.array(*[F.lit(float(x)) for x in query])
    norm_q = sum(float(x) ** 2 for x in query) ** 0.5
    norm = F.sqrt(dot(v, v))
    return F.when((norm > 0) & F.lit(norm_q > 0), 1 - dot(v, q) / (norm * norm_q))


def vector_leg(articles: DataFrame, query: list[float], limit: int, model: str | None = None, key: str = "article_id", index=None) -> DataFrame:
    """Nearest articles as (key, distance, similarity, ...), nearest first, ids break ties: exactly, or through a VectorIndex,
    which holds `limit` of them under any filter and nearly always the nearest."""
    if model is not None:
        articles = articles.where(F.col("embedding_model") == model)
    if index is not None:
        asked = articles.sparkSession.createDataFrame([(0, [float(x) for x in query])], "query int, embedding array<double>")
        hits = index.search(asked, limit, among=articles.where("embedding is not null")).select(key, "distance")
        found = articles.join(F.broadcast(hits), key)  # at most `limit` rows
        return found.withColumn("similarity", 1 - F.col("distance")).orderBy("distance", key).limit(limit)
    scored = articles.where("embedding is not null").withColumn("distance", cosine_distance(F.col("embedding"), query)).where("distance is not null")
    return scored.withColumn("similarity", 1 - F.col("distance")).orderBy("distance", key).limit(limit)


def fold_passages(candidates: DataFrame, order: list, limit: int, key: str = "article_id") -> DataFrame:
    """The best passage of every article among the candidates, then the best articles."""
    return top_per_group(candidates, key, order, 1).orderBy(*order).limit(limit)


def passage_vector_leg(passages: DataFrame, articles: DataFrame, query: list[float], limit: int, candidates: int = PASSAGE_CANDIDATES, model: str | None = None, index=None) -> DataFrame:
    """passages (article_id, idx, passage, embedding); articles (article_id, published_at), already filtered. An index of
    passages has the key passage_id: (article_id, idx)."""
    rows = passages.join(articles.select("article_id", "published_at"), "article_id").withColumn("passage_id", F.struct("article_id", "idx"))
    near = vector_leg(rows, query, candidates, model, key="passage_id", index=index)
    return fold_passages(near, [F.asc("distance"), F.asc("article_id"), F.asc("idx")], limit)


# --- keywords -------------------------------------------------------------------------


def keyword_leg(articles: DataFrame, text: str, limit: int, column: str = "title", key: str = "article_id", published: str = "published_at", index: TextIndex | None = None) -> DataFrame:
    """Matching articles with their rank: best first, then newest, then id. An empty query matches nothing.

    With an index no text is analysed; without one every text of `articles` is."""
    hits = index.search(text, limit, articles) if index else textindex.scan(articles, text, limit, column=column, key=key, published=published)
    # At most `limit` rows.
    return articles.join(F.broadcast(hits.select(key, "rank")), key).orderBy(F.desc("rank"), F.desc(published), F.asc(key)).limit(limit)


def passage_keyword_leg(passages: DataFrame, articles: DataFrame, text: str, limit: int, candidates: int = PASSAGE_CANDIDATES, index: TextIndex | None = None) -> DataFrame:
    """The best matching passage of every article. An index of passages has the key passage_id: (article_id, idx)."""
    keyed, known = passages.withColumn("passage_id", F.struct("article_id", "idx")), articles.select("article_id", "published_at")
    if index is None:
        found = keyword_leg(keyed.join(known, "article_id"), text, candidates, column="passage", key="passage_id")
    else:
        # The ids alone are looked up; the passages' texts meet the few hits before anything is shuffled.
        hits = index.search(text, candidates, keyed.select("article_id", "passage_id").join(known.select("article_id"), "article_id", "left_semi"))
        found = keyed.join(F.broadcast(hits.select("passage_id", "rank")), "passage_id").join(known, "article_id")
    return fold_passages(found, [F.desc("rank"), F.desc("published_at"), F.asc("article_id"), F.asc("idx")], limit)


# --- fusion ---------------------------------------------------------------------------


def ranked(leg: DataFrame, order: list, name: str, key: str = "article_id", published: str = "published_at") -> DataFrame:
    """(id, published_at, leg, rank) of a leg; an id counts once, at its first place. A leg is a cut list, not a table."""
    first = top_per_group(leg, key, order, 1)
    return first.select(F.col(key).alias("id"), F.col(published).alias("published_at"), F.lit(name).alias("leg"), F.row_number().over(Window.orderBy(*order)).alias("rank"))


def fuse(legs: list[DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: (id, score, matched_by), best first, then newest, then id. Legs in the order of matched_by."""
    if k <= 0:
        raise InvalidRequest("k must be positive")
    both = None
    for n, leg in enumerate(legs):
        part = leg.withColumn("leg_no", F.lit(n))
        both = part if both is None else both.unionByName(part)
    by_leg = F.array_sort(F.collect_list(F.struct("leg_no", "leg", (F.lit(1.0) / (F.col("rank") + k)).alias("part"))))
    fused = both.groupBy("id").agg(by_leg.alias("parts"), F.min_by("published_at", "leg_no").alias("published_at"))
    score = F.aggregate("parts", F.lit(0.0), lambda t, p: t + p["part"])
    return fused.select("id", score.alias("score"), F.transform("parts", lambda p: p["leg"]).alias("matched_by"), "published_at").orderBy(F.desc("score"), F.desc("published_at"), F.asc("id"))


def best_passages(body_legs: list[DataFrame]) -> DataFrame:
    """(id, passage): of each article from the body leg where it stands highest; the first leg wins ties. Legs (id, rank, passage)."""
    both = None
    for n, leg in enumerate(body_legs):
        part = leg.select("id", "rank", "passage", F.lit(n).alias("leg_no"))
        both = part if both is None else both.unionByName(part)
    return both.where("passage is not null").groupBy("id").agg(F.min_by("passage", F.struct("rank", "leg_no")).alias("passage"))


class EmbeddingUnavailable(RuntimeError):
    """The query cannot be embedded now."""


def semantic_search(articles: DataFrame, text: str, embed_query, *, mode: str = "hybrid", scope: str = "titles", passages: DataFrame | None = None, model: str | None = None, limit: int = 20, candidates: int = 50, k: int = 60, max_query: int = 500, title_index: TextIndex | None = None, passage_index: TextIndex | None = None, title_vectors=None, passage_vectors=None) -> tuple[DataFrame, bool]:
    """(hits, degraded): id, score, matched_by, passage. articles are already filtered.

    Vector mode over one leg scores by cosine, everything else by fusion. If the query cannot be embedded, vector mode
    fails and hybrid mode answers from keywords alone, marked degraded."""
    text = text.strip()
    if not text or len(text) > max_query:
        raise InvalidRequest("query is empty or too long")
    if mode not in ("vector", "hybrid") or scope not in ("titles", "body", "all"):
        raise InvalidRequest("unknown mode or scope")
    titles, body = scope != "body", scope != "titles"
    if body and passages is None:
        raise InvalidRequest("searching page text is not available")
    depth, legs, degraded = max(candidates, limit), {}, False
    try:
        vector = embed_query(text)
    except EmbeddingUnavailable:
        if mode == "vector":
            raise
        vector, degraded = None, True
    near, good = [F.asc("distance"), F.asc("article_id")], [F.desc("rank"), F.desc("published_at"), F.asc("article_id")]
    hits: dict[str, DataFrame] = {}
    if vector is not None:
        if titles:
            hits["vector"] = vector_leg(articles, vector, depth, model, index=title_vectors)
            legs["vector"] = ranked(hits["vector"], near, "vector")
        if body:
            hits["body_vector"] = passage_vector_leg(passages, articles, vector, depth, model=model, index=passage_vectors)
            legs["body_vector"] = ranked(hits["body_vector"], near, "body_vector")
    if mode == "hybrid":
        if titles:
            legs["keyword"] = ranked(keyword_leg(articles, text, depth, index=title_index), good, "keyword")
        if body:
            hits["body_keyword"] = passage_keyword_leg(passages, articles, text, depth, index=passage_index)
            legs["body_keyword"] = ranked(hits["body_keyword"], good, "body_keyword")
    names = [n for n in LEG_ORDER if n in legs]
    if mode == "vector" and len(names) == 1:
        out = hits[names[0]].select(F.col("article_id").alias("id"), F.col("similarity").alias("score"), F.array(F.lit(names[0])).alias("matched_by"), "published_at")
        out = out.orderBy(F.desc("score"), F.asc("id")).limit(limit)
    else:
        out = fuse([legs[n] for n in names], k).limit(limit)
    bodies = [legs[n].join(hits[n].select(F.col("article_id").alias("id"), "passage"), "id") for n in ("body_vector", "body_keyword") if n in legs]
    if bodies:
        return out.join(best_passages(bodies), "id", "left"), degraded
    return out.withColumn("passage", F.lit(None).cast("string")), degraded
