"""Recall: branches of a question, sizes of pools, scoring again on the pool, exact search, the guard after retrieval, parents of hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import lexical, security

#: Identifiers that one batch of questions may ask for; they travel to the tasks.
MOST_IDENTIFIERS = 1000


def pool_size(k: int, multiplier: int, rerank_documents: int | None = None, allowed: int | None = None, chunks_a_document: int = 3) -> int:
    """How many chunks to recall for the k best documents: more if a reranker wants candidates, no more than an allow-list holds."""
    k = k if allowed is None else min(k, allowed)
    size = max(k * multiplier, k)
    if rerank_documents is None:
        return size
    wanted = max(4 * k, rerank_documents)
    wanted = wanted if allowed is None else min(wanted, allowed)
    return max(size, wanted * multiplier, wanted * chunks_a_document)


def branches(docs: DataFrame, queries: DataFrame, limit: int, *, key: str = "doc_id") -> DataFrame:
    """query_id, branch, key, rank: the best `limit` documents of each branch by BM25.

    `docs` has title and content. Branches: the question and its focused form on the content, the focused form on titles, and the question's features on the documents' features.
    """
    asked = queries.select("query_id", "query", T.retrieval_queries(F.col("query")).alias("_q"), T.feature_text(F.col("query")).alias("_f"))
    focused = F.element_at("_q", -1)
    content = asked.select(F.lit("sparse").alias("branch"), "query_id", "query").unionByName(asked.where(F.size("_q") > 1).select(F.lit("focused").alias("branch"), "query_id", focused.alias("query")))
    sides = [
        (docs.select(key, F.col("content").alias("text")), content),  # both branches from one pass
        (docs.select(key, F.col("title").alias("text")), asked.select(F.lit("title").alias("branch"), "query_id", focused.alias("query"))),
        (docs.select(key, T.feature_text(F.concat_ws(" ", "title", "content")).alias("text")), asked.where("_f <> ''").select(F.lit("feature").alias("branch"), "query_id", F.col("_f").alias("query"))),
    ]
    out, kind = None, dict(queries.dtypes)["query_id"]
    for texts, questions in sides:
        both = questions.select(F.concat_ws(":", "branch", F.col("query_id").cast("string")).alias("query_id"), "query")
        raw = lexical.bm25_best(texts, both, limit, key=key, text="text").select("query_id", key, F.round("raw", 6).alias("raw"))
        at = F.instr("query_id", ":")
        best = lexical.top(raw, limit, "raw", key).select(F.substring("query_id", at + 1, F.length("query_id")).cast(kind).alias("query_id"), F.substring("query_id", F.lit(1), at - 1).alias("branch"), key, "rank")
        out = best if out is None else out.unionByName(best)
    return out


def rescored(ranked: DataFrame, docs: DataFrame, queries: DataFrame, *, key: str = "doc_id", weight: float = 0.5, rrf: int = 60) -> DataFrame:
    """query_id, key, lexical, recall, score: the union of the branches' documents, scored on that pool.

    lexical is BM25 with the pool's own statistics, recall the sum of 1 / (rrf + rank) over branches, both divided by the question's maximum; explicit features add their bonus.
    """
    pool = ranked.groupBy("query_id", key).agg(F.sum(1.0 / (rrf + F.col("rank"))).alias("recall"))
    lex = lexical.max_normalised(lexical.bm25_of_pools(pool.select("query_id", key), docs, queries, key=key), out="lexical")
    both = lexical.max_normalised(pool, "recall", "recall").join(lex.select("query_id", key, "lexical"), ["query_id", key])
    wanted = queries.select("query_id", T.features(F.col("query")).alias("_fq"))
    held = docs.join(pool.select(key).distinct(), key, "left_semi").select(key, T.features(F.concat_ws(" ", "title", "content")).alias("_fd"))
    both = both.join(wanted, "query_id").join(held, key)
    score = (1 - weight) * F.col("lexical") + weight * F.col("recall") + T.feature_boost(F.col("_fq"), F.col("_fd"))
    return both.select("query_id", key, F.round("lexical", 6).alias("lexical"), F.round("recall", 6).alias("recall"), F.round(score, 6).alias("score"))


def exact(docs: DataFrame, queries: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """query_id, key, score: documents that hold one of the question's identifiers, or are named by it after the words document id or number, by BM25 on these alone.

    Questions without identifiers search all documents. The identifiers of a batch are a bounded list, so no question meets documents row by row.
    """
    asked = queries.select("query_id", "query", T.identifiers(F.col("query")).alias("ids"), F.col("query").rlike(r"(?i)\bdocument\s+(?:id|number)\b").alias("named"))
    wanted = [r[0] for r in asked.select(F.explode("ids")).distinct().limit(MOST_IDENTIFIERS + 1).collect()]
    if len(wanted) > MOST_IDENTIFIERS:
        raise ValueError("too many identifiers for one batch of questions")
    hay = F.lower(F.concat_ws(" ", "document_id", "title", "content"))
    each = F.explode(F.filter(F.array(*[F.lit(w) for w in wanted]) if wanted else F.array().cast("array<string>"), lambda i: F.contains(F.col("_hay"), i)))
    held = docs.select(key, F.lower("document_id").alias("_id"), hay.alias("_hay")).select(key, "_id", each.alias("ident"))
    met = asked.select("query_id", "named", F.explode("ids").alias("ident")).join(held, "ident")
    pools = met.where(~F.col("named") | (F.col("_id") == F.col("ident"))).select("query_id", key).distinct()
    raw = lexical.bm25_of_pools(pools, docs, queries, key=key)
    free = asked.where(F.size("ids") == 0).select("query_id", "query")
    raw = raw.select("query_id", key, "raw").unionByName(lexical.bm25(docs, free, key=key).select("query_id", key, "raw"))
    return lexical.max_normalised(raw).select("query_id", key, F.round("score", 6).alias("score"))


def guarded(hits: DataFrame, docs: DataFrame, principal: list[str], tenant: str | None = None, allowed: DataFrame | None = None, *, key: str = "doc_id") -> DataFrame:
    """`hits` with `refused`: whether a second look at status, roles, tenant or allow-list would keep the document from the principal.

    A search over authorised documents has no such row; rows of documents that are gone are refused.
    """
    fine = security.authorized(docs, principal, tenant).select(key).distinct().withColumn("_ok", F.lit(True))
    if allowed is not None:
        fine = security.among(fine, allowed, key)
    return hits.join(fine, key, "left").withColumn("refused", F.col("_ok").isNull()).drop("_ok")


def hydrated(hits: DataFrame, parents: DataFrame, *, parent: str = "parent_id", content: str = "parent_content") -> DataFrame:
    """`hits` with the parents' text where it is missing; a parent of many hits is read once, after the hits are chosen."""
    known = parents.select(F.col(parent).alias("_p"), F.col(content).alias("_c")).join(hits.where(F.col(content).isNull()).select(F.col(parent).alias("_p")).distinct(), "_p", "left_semi")
    return hits.join(known, F.col(parent) == F.col("_p"), "left").withColumn(content, F.coalesce(content, "_c")).drop("_p", "_c")


def chunk_maxima(chunks: DataFrame, *, parent: str = "parent_id", tokens: str = "token_count") -> DataFrame:
    """One row: chunks, distinct parents, largest chunk, and the most chunks of a parent."""
    by = chunks.groupBy(parent).agg(F.count(F.lit(1)).alias("n"), F.max(tokens).alias("m"))
    return by.agg(F.sum("n").alias("chunks"), F.count(parent).alias("parents"), F.max("m").alias("most_tokens"), F.max("n").alias("most_chunks"))


def distinct_within(hits: DataFrame, limit: int, target: int, *, key: str = "doc_id", order: str = "rank") -> DataFrame:
    """The smallest doubling of `limit` that yields `target` distinct documents for each question: query_id, limit, documents; the last limit where all hits don't suffice."""
    w = W.partitionBy("query_id").orderBy(order)
    seen = hits.withColumn("_new", (F.row_number().over(W.partitionBy("query_id", key).orderBy(order)) == 1).cast("int")).withColumn("_docs", F.sum("_new").over(w)).withColumn("_at", F.row_number().over(w))
    step = lambda at: F.greatest(F.ceil(F.log2(at / limit)), F.lit(0))
    rounds = seen.groupBy("query_id").agg(F.min(F.when(F.col("_docs") >= target, step(F.col("_at")))).alias("_need"), F.max(step(F.col("_at"))).alias("_all"))
    rounds = rounds.select("query_id", (limit * F.pow(F.lit(2), F.coalesce("_need", "_all"))).cast("long").alias("limit"))
    return seen.join(rounds, "query_id").where(F.col("_at") <= F.col("limit")).groupBy("query_id", "limit").agg(F.max("_docs").alias("documents"))
