"""Registered queries: fusion, reranking, diversification and generation support."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import fusion as E
from tessera.operators import postings as P
from tessera.operators import vectors as V

from .lexical import PLAIN, full_text_sql, of, strategies_sql
from .registry import register
from .vectors import SIM, asked, search_sql


def rows_():
    return F.count(F.lit(1))


def as_of_():
    return F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")


def texts(t):
    """(query_id, query): the search text of each query vector."""
    return t.hybrid_queries.select("query_id", "query")


def vector_branch(t, k=50):
    return V.vector_search(t.embedded_chunks, asked(t), k, 0.05)


def keyword_branch(t, k=50):
    return P.scan_text(t.chunks, texts(t), k)


def hybrid(t, limit=10):
    return E.fused(vector_branch(t), keyword_branch(t), limit)


VEC = search_sql("SELECT * FROM embedded_chunks", k=50, threshold=0.05)
KEY = f"SELECT query_id, rank, id, document_id FROM ({full_text_sql('SELECT id, content FROM chunks', 50, queries='hybrid_queries')}) JOIN (SELECT id, document_id FROM chunks) USING (id)"
FUSE = """
 b AS (SELECT query_id, id, coalesce(v.document_id, k.document_id) AS document_id, v.rank AS vr, k.rank AS kr, count(v.rank) OVER (PARTITION BY query_id) = 0 AS lone FROM v FULL JOIN k USING (query_id, id)),
 r AS (SELECT *, round(coalesce(CASE WHEN lone THEN 0.1 ELSE 0.7 END::DOUBLE / (60 + vr), 0) + coalesce(CASE WHEN lone THEN 0.9 ELSE 0.3 END::DOUBLE / (60 + kr), 0), 9) AS s FROM b),
 d AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY s DESC, id) AS n FROM r),
 f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id)::INT AS rank, max(s) OVER (PARTITION BY query_id) AS top FROM d WHERE n <= 3)"""
FUSED = f"v AS ({VEC}), k AS ({KEY}),{FUSE}"
FINAL = "SELECT query_id, rank, id, document_id, round(s / top, 6) AS score, concat_ws(',', CASE WHEN vr IS NOT NULL THEN 'vector' END, CASE WHEN kr IS NOT NULL THEN 'keyword' END) AS sources FROM f WHERE rank <= {0}"
register("E01_rank_fusion", lambda t: hybrid(t, 20), f"WITH {FUSED} {FINAL.format(20)}")
register("E02_diversified", lambda t: E.diversified(vector_branch(t).withColumn("score", F.col("similarity"))).select("query_id", "id", "document_id"), f"WITH v AS ({VEC}) SELECT query_id, id, document_id FROM v QUALIFY row_number() OVER (PARTITION BY query_id, document_id ORDER BY similarity DESC, id) <= 3")
register("E03_sources", lambda t: hybrid(t).groupBy("sources").agg(rows_().alias("n")), f"WITH {FUSED}, z AS ({FINAL.format(10)}) SELECT sources, count(*) AS n FROM z GROUP BY 1")


def fields():
    return {"title": F.when(F.col("document_id") % 2 == 0, "x"), "author": F.when(F.col("document_id") % 3 == 0, "y")}


register("E04_boosted", lambda t: vector_branch(t).withColumn("boosted", F.round(E.boosted(F.col("similarity"), fields(), {"title": 1.2, "author": 1.5}), 6)).withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("boosted"), "id"))).select("query_id", "id", "boosted", "place"), f"WITH v AS ({VEC}), b AS (SELECT query_id, id, round(similarity * CASE WHEN document_id % 2 = 0 THEN 1.2::DOUBLE ELSE 1 END * CASE WHEN document_id % 3 = 0 THEN 1.5::DOUBLE ELSE 1 END, 6) AS boosted FROM v) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY boosted DESC, id)::INT AS place FROM b")
DAYS = "date_diff('second', created_at, TIMESTAMP '2024-03-01') / 86400.0::DOUBLE"
dated = lambda t: vector_branch(t).join(t.docs.select(F.col("id").alias("document_id"), "created_at"), "document_id")
register("E05_time_decay", lambda t: dated(t).select("query_id", "id", F.round(E.decayed(F.col("similarity"), F.when(F.col("document_id") % 3 > 0, F.col("created_at")), as_of_()), 9).alias("score")), f"WITH v AS ({VEC}) SELECT query_id, v.id, round(CASE WHEN document_id % 3 > 0 THEN similarity * exp(-0.1 * {DAYS}) ELSE similarity END, 9) AS score FROM v JOIN docs d ON d.id = document_id")
register("E06_quality_threshold", lambda t: hybrid(t, 50).where("score >= 0.9").select("query_id", "id"), f"WITH {FUSED}, z AS ({FINAL.format(50)}) SELECT query_id, id FROM z WHERE score >= 0.9")


def tenant_hybrid(t):
    """Hybrid search of each query within its tenant, with the beginnings of the chunks found."""
    docs = t.docs.select(F.col("id").alias("document_id"), "tenant_slug", "source")
    chunks = t.embedded_chunks.join(docs, "document_id")
    texts = t.sliced(t.load("documents").withColumnRenamed("source", "tenant_slug"), "tenant_slug")
    found = E.hybrid_search(t.hybrid_queries, chunks, None, None, texts=texts)
    return found.join(t.chunks.select("id", F.substring("content", 1, 200).alias("preview")), "id")


#: The four gates in turn: text strategies over chunks without vectors, the two fused branches, containment of the query.
OWN = "SELECT e.*, d.tenant_slug, d.source FROM embedded_chunks e JOIN docs d ON d.id = e.document_id"
HYBRID = f"""WITH own AS ({OWN}),
 plain AS ({strategies_sql("SELECT id, content, tenant_slug FROM own WHERE embedding IS NULL AND source = 'bypass_upload'", 0.05, 10, 'hybrid_queries', 'tenant_slug')}),
 rest AS (SELECT * FROM hybrid_queries WHERE query_id NOT IN (SELECT query_id FROM plain)),
 v AS (SELECT query_id, id, document_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id)::INT AS rank FROM (
   SELECT query_id, id, document_id, {SIM} AS similarity FROM own JOIN rest USING (tenant_slug) WHERE embedding IS NOT NULL AND qv IS NOT NULL) WHERE similarity >= 0.05) WHERE rank <= 50),
 k AS (SELECT query_id, rank, id, document_id FROM ({full_text_sql('SELECT id, content, tenant_slug FROM own', 50, queries='rest', strict=True, scope=', tenant_slug')}) JOIN (SELECT id, document_id FROM chunks) USING (id)),{FUSE},
 z AS ({FINAL.format(10)}),
 last AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY id)::INT AS rank, id, document_id FROM own JOIN rest USING (tenant_slug)
   WHERE embedding IS NOT NULL AND contains(lower(content), lower(query)) AND query_id NOT IN (SELECT query_id FROM z)),
 found AS (SELECT query_id, rank, id, document_id, score, 'bypass' AS sources FROM plain JOIN (SELECT id, document_id FROM chunks) USING (id)
   UNION ALL SELECT query_id, rank, id, document_id, score, sources FROM z
   UNION ALL SELECT query_id, rank, id, document_id, 1.0, 'fallback' FROM last WHERE rank <= 10)
 SELECT found.*, substring(content, 1, 200) AS preview FROM found JOIN (SELECT id, content FROM chunks) USING (id)"""
register("E07_hybrid_search", tenant_hybrid, HYBRID)


def candidates(t, k=12):
    """Vector hits with the vectors, texts and times that rerankers read; what they compare with is the query's neighbour."""
    v = vector_branch(t, k).join(t.vectors, "document_id").join(t.chunks.select("id", "content"), "id").join(t.docs.select(F.col("id").alias("document_id"), "created_at"), "document_id")
    other = t.load("embeddings").where("vec_id % 100 = 1").select((F.col("vec_id") - 1).alias("query_id"), F.col("embedding").cast("array<double>").alias("qv"))
    return v.join(other, "query_id").join(texts(t), "query_id")


OTHER = "SELECT vec_id - 1 AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 100 = 1"
CAND = f"""SELECT v.*, e.embedding, c.content, d.created_at, q.qv, w.query FROM ({search_sql('SELECT * FROM embedded_chunks', k=12, threshold=0.05)}) v
  JOIN vectors e USING (document_id) JOIN chunks c ON c.id = v.id JOIN docs d ON d.id = v.document_id JOIN ({OTHER}) q USING (query_id) JOIN (SELECT query_id, query FROM hybrid_queries) w USING (query_id)"""
register("E08_semantic_rerank", lambda t: E.semantic_rerank(candidates(t)), f"WITH c AS ({CAND}), s AS (SELECT query_id, id, rank AS old, {SIM} AS score FROM c), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old, id)::INT AS rank FROM s) SELECT query_id, id, rank, old - rank AS rank_change, score FROM n")
register("E09_pseudo_cross_encoder", lambda t: candidates(t).select("query_id", "id", V.local_embedding(F.concat("query", F.lit(" [SEP] "), F.substring("content", 1, 512)), 16).alias("v")).select("query_id", "id", F.round(E.pseudo_cross_score(F.col("v")), 9).alias("score")), f"WITH c AS ({CAND}), v AS (SELECT query_id, id, list_transform(range(16), lambda i: round((('0x' || substring(sha1(query || ' [SEP] ' || substring(content, 1, 512) || '|' || i), 1, 8))::BIGINT % 1000000) / 500000.0::DOUBLE - 1, 6)) AS v FROM c) SELECT query_id, id, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, sqrt(list_sum(list_transform(v, lambda x: x * x))) * list_var_pop(v) / 100)), 9) AS score FROM v")
QW = r"list_distinct(regexp_extract_all(lower(query), '[a-z''-]+'))"
LEX = rf"coalesce(len(list_intersect({QW}, regexp_extract_all(lower(content), '[a-z''-]+')))::DOUBLE / nullif(len({QW}), 0), 0)"
PEN = "SELECT a.query_id, a.id, round(coalesce(sum(list_cosine_similarity(a.embedding, b.embedding) * 0.1::DOUBLE * (1 - (b.rank - 1) / a.n::DOUBLE)), 0), 6) AS penalty FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM c) a LEFT JOIN c b ON a.query_id = b.query_id AND b.rank < a.rank GROUP BY 1, 2"
register("E10_hybrid_rerank", lambda t: E.hybrid_rerank(candidates(t), as_of_()), f"WITH c AS ({CAND}), p AS ({PEN}), s AS (SELECT query_id, id, round(similarity * 0.5 + {LEX} * 0.3 + exp(-{DAYS} / 30) * 0.1 - penalty, 6) AS score FROM c JOIN p USING (query_id, id)) SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank, score FROM s")
register("E11_lexical_share", lambda t: E.lexical_shares(t.chunks, texts(t)), f"SELECT query_id, id, round({LEX}, 6) AS score FROM chunks, (SELECT query_id, query FROM hybrid_queries) w")
register("E12_recency", lambda t: t.docs.select("id", F.round(E.recency(F.col("created_at"), as_of_()), 9).alias("score")), f"SELECT id, round(exp(-{DAYS} / 30), 9) AS score FROM docs")
register("E13_diversity_penalty", lambda t: E.diversity_penalty(candidates(t)), f"WITH c AS ({CAND}) {PEN}")
register("E14_marginal_relevance", lambda t: E.mmr(candidates(t)))
register("E15_keyword_boost", lambda t: candidates(t).select("query_id", "id", F.round(E.keyword_boost(F.col("query"), F.col("content")), 6).alias("boost")), rf"WITH c AS ({CAND}) SELECT query_id, id, round(len(list_filter(regexp_split_to_array(lower(query), '\s+'), lambda w: strlen(w) > 2 AND contains(lower(content), w))) * 0.1::DOUBLE, 6) AS boost FROM c")
register("E16_rerank_window", lambda t: E.semantic_rerank(candidates(t), 4).select("query_id", "id"), f"WITH c AS ({CAND}) SELECT query_id, id FROM c WHERE rank <= 4")
register("E17_neighbour_context", lambda t: E.neighbours(t.chunks).select("id", F.md5("context").alias("digest")), "SELECT id, md5(concat_ws(' ', lag(content) OVER w, content, lead(content) OVER w)) AS digest FROM chunks WINDOW w AS (PARTITION BY document_id ORDER BY ord)")
answers = lambda t: candidates(t).groupBy("query_id").agg(F.avg("similarity").alias("s"), rows_().alias("n"), F.max_by("content", F.struct("rank")).alias("answer"))
ANS = f"SELECT query_id, avg(similarity) AS s, count(*) AS n, arg_max(content, rank) AS answer FROM ({CAND}) GROUP BY 1"
register("E18_answer_confidence", lambda t: answers(t).select("query_id", F.round(E.answer_confidence(F.col("s"), F.col("answer"), F.col("n")), 6).alias("confidence")), f"SELECT query_id, round(least(1.0::DOUBLE, s * 0.6 + least(1.0::DOUBLE, strlen(answer) / 200::DOUBLE) * 0.2 + least(1.0::DOUBLE, n / 5::DOUBLE) * 0.2), 6) AS confidence FROM ({ANS})")


def say():
    return F.concat(F.lit("I'm not sure. "), F.substring("answer", 1, 80), F.lit(" [1] and [Source 2], [9]"))


register("E19_generation_confidence", lambda t: answers(t).select("query_id", E.generation_confidence(F.col("s"), say(), F.lit(2), F.col("n")).alias("confidence")), f"SELECT query_id, round(s * 0.4 + least(1.0::DOUBLE, strlen(a) / 500::DOUBLE) * 0.2 + least(1.0::DOUBLE, 2 / greatest(1, n)::DOUBLE) * 0.3 + 0.9::DOUBLE * 0.1, 3) AS confidence FROM (SELECT *, 'I''m not sure. ' || substring(answer, 1, 80) || ' [1] and [Source 2], [9]' AS a FROM ({ANS}))")
register("E20_citations", lambda t: E.citations(t.queries.select(F.col("query_id").alias("answer_id"), F.concat(F.lit("[1] and [Source 2], [9] or [1] "), F.substring("query", 1, 9)).alias("answer")), t.chunks.select(F.col("document_id").alias("answer_id"), (F.col("ord") + 1).alias("ordinal"), "id")), "SELECT answer_id, pos, c.id FROM (SELECT query_id AS answer_id, unnest([0, 1, 2, 3]) AS pos, unnest([1, 2, 9, 1]) AS ordinal FROM search_queries) a JOIN chunks c ON c.document_id = a.answer_id AND c.ord + 1 = a.ordinal")
register("E21_context_budget", lambda t: E.budgeted(candidates(t), 1000).select("query_id", "id", "used"), f"SELECT query_id, id, used::BIGINT AS used FROM (SELECT *, row_number() OVER w AS n, sum(strlen(content) // 4) OVER w AS used FROM ({CAND}) WINDOW w AS (PARTITION BY query_id ORDER BY similarity DESC, id ROWS UNBOUNDED PRECEDING)) WHERE n <= 10 AND used <= 1000")
register("E22_prompt_context", lambda t: E.prompt_context(candidates(t)).select("query_id", F.md5("context").alias("digest")), f"SELECT query_id, md5(string_agg('[Source ' || rank || ']' || chr(10) || content, chr(10) || chr(10) ORDER BY rank)) AS digest FROM ({CAND}) GROUP BY 1")


def bullets(t):
    from tessera.operators import answering as A

    return A.summary_bullets(t.load("documents").select(F.col("doc_id").alias("document_id"), F.posexplode(A.loose_sentences(F.col("text"))).alias("ord", "text")))


register("E23_bullet_selection", bullets)
register(
    "E24_jaccard",
    lambda t: candidates(t).select("query_id", "id", F.round(T.jaccard(T.plain_tokens(F.col("query")), T.plain_tokens(F.col("content"))), 6).alias("score")),
    f"""SELECT query_id, id, round(coalesce(len(list_intersect(a, b))::DOUBLE / nullif(len(list_distinct(a || b)), 0), 0), 6) AS score
      FROM (SELECT query_id, id, {of(PLAIN)} AS a, {of(PLAIN, 'content')} AS b FROM ({CAND}))""",
)
register("E25_search_comparison", lambda t: t.metrics.where("type = 'query'").groupBy("query_hash").agg(F.avg(F.when(F.col("strategy") == "vector", F.col("duration_ms"))).alias("a"), F.avg("duration_ms").alias("b"), F.count_if("success").alias("n"), rows_().alias("m")).select("query_hash", E.compared(F.coalesce("a", F.lit(100.0)), F.coalesce("b", F.lit(0.0)), F.col("n"), F.lit(20)).alias("c")).select("query_hash", "c.*"), "SELECT query_hash, CASE WHEN a < b THEN 'first' WHEN b < a THEN 'second' ELSE 'tie' END AS faster, CASE WHEN n > 20 THEN 'first' WHEN 20 > n THEN 'second' ELSE 'tie' END AS more FROM (SELECT query_hash, coalesce(avg(duration_ms) FILTER (WHERE strategy = 'vector'), 100.0) AS a, avg(duration_ms) AS b, count(*) FILTER (WHERE success) AS n FROM rag_metrics WHERE type = 'query' GROUP BY 1)")
register("E26_conversation_history", lambda t: E.history(t.load("conversations")).select("conv_id", F.md5("history").alias("digest"), "next_turn"), "SELECT conv_id, md5(string_agg(CASE role WHEN 'user' THEN 'Human: ' ELSE 'Assistant: ' END || text, chr(10) ORDER BY turn)) AS digest, count(*) FILTER (WHERE role = 'user') + 1 AS next_turn FROM conversations WHERE role IN ('user', 'assistant') GROUP BY 1")
register("E27_response_pieces", lambda t: t.chunks.select("id", F.posexplode(E.word_pieces(E.cleaned(F.concat(F.lit("Answer: "), F.col("content"))))).alias("pos", "piece")).select("id", "pos", F.md5("piece").alias("digest")), r"SELECT id, unnest(range(len(range(1, len(w) + 1, 10))))::INT AS pos, unnest(list_transform(range(1, len(w) + 1, 10), lambda i: md5(array_to_string(w[i:i + 9], ' ') || ' '))) AS digest FROM (SELECT id, string_split(trim(replace(replace(replace(regexp_replace('Answer: ' || content, '\s+', ' ', 'g'), 'Answer:', ''), 'Response:', ''), 'Based on the context:', '')), ' ') AS w FROM chunks)")
register("E27b_reasoning_steps", lambda t: t.queries.select("query_id", F.posexplode(F.regexp_extract_all(F.concat(F.lit("1. first\n* second "), F.substring("query", 1, 5), F.lit("\nStep 3 third")), F.lit(r"(?im)(?:Step \d+|^\d+\.|\*)\s*([^\n]+)"), F.lit(1))).alias("pos", "step")), r"SELECT query_id, unnest([0, 1, 2])::INT AS pos, unnest(['first', 'second ' || substring(query, 1, 5), 'third']) AS step FROM search_queries")
