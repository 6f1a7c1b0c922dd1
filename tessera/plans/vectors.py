"""Registered queries: embeddings and vector search."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import nearest as N
from tessera.operators import vectors as V
from tessera.sources.storage import state_of

from .registry import register


def rows_():
    return F.count(F.lit(1))


def asked(t):
    """Every vector whose id is divisible by 100 as a query."""
    return t.load("embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("qv"))


register("C01_local_embedding", lambda t: t.queries.select("query_id", V.local_embedding(F.col("query"), 16).alias("v")).select("query_id", F.round(V.total(F.col("v")), 6).alias("total"), F.round(F.get("v", 3), 6).alias("v3")), "WITH e AS (SELECT query_id, list_transform(range(16), lambda i: round((('0x' || substring(sha1(query || '|' || i), 1, 8))::BIGINT % 1000000) / 500000.0::DOUBLE - 1, 6)) AS v FROM search_queries) SELECT query_id, round(list_sum(v), 6) AS total, v[4] AS v3 FROM e")
register("C02_fitted_vector", lambda t: t.vectors.where("embedding IS NOT NULL").select("document_id", F.size(V.fitted(F.col("embedding"), 80)).alias("n"), F.round(V.total(V.fitted(F.col("embedding"), 32)), 6).alias("total")), "SELECT document_id, 80 AS n, round(list_sum(embedding[1:32]), 6) AS total FROM vectors WHERE embedding IS NOT NULL")
register("C03_rows_to_embed", lambda t: t.embedded_chunks.where("embedding IS NULL").select("id", F.floor((F.row_number().over(Window.partitionBy("document_id").orderBy("id")) - 1) / 100).cast("int").alias("batch")), "SELECT id, ((row_number() OVER (PARTITION BY document_id ORDER BY id) - 1) // 100)::INT AS batch FROM embedded_chunks WHERE embedding IS NULL")
register("C04_cached_embedding", lambda t: V.embed_misses(t.chunks, t.chunks.where("document_id % 3 = 0").select(F.sha2(F.btrim("content"), 256).alias("key"), F.sha2("content", 256).alias("whole"), V.local_embedding(F.col("content"), 4).alias("embedding")).dropDuplicates(["whole"]), lambda c: V.local_embedding(c, 4)).select("id", "cached", F.round(V.total(F.col("embedding")), 6).alias("total")), "WITH k AS (SELECT DISTINCT sha256(trim(content)) AS key FROM chunks WHERE document_id % 3 = 0) SELECT id, k.key IS NOT NULL AS cached, round(list_sum(list_transform(range(4), lambda i: round((('0x' || substring(sha1(content || '|' || i), 1, 8))::BIGINT % 1000000) / 500000.0::DOUBLE - 1, 6))), 6) AS total FROM chunks c LEFT JOIN k ON k.key = sha256(trim(c.content))")
SIM = "round(list_cosine_similarity(embedding, qv), 6)"
ASKED = "SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 100 = 0"


def search_sql(chunks, k=5, threshold=0.3, per=""):
    return f"""SELECT query_id, rank, id, document_id, similarity FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id{per} ORDER BY similarity DESC, id)::INT AS rank FROM (
        SELECT query_id, id, document_id, {SIM} AS similarity FROM ({chunks}) c, ({ASKED}) q WHERE embedding IS NOT NULL)
      WHERE similarity >= {threshold}) WHERE rank <= {k}"""


def document_vectors(t):
    """(id, document_id, embedding): one vector for each document."""
    return t.vectors.select(F.col("document_id").alias("id"), "document_id", "embedding")


DOCUMENT_VECTORS = "SELECT document_id AS id, document_id, embedding FROM vectors"
register("C05_cosine", lambda t: N.similarities(t.vectors, asked(t)), f"SELECT query_id, document_id, {SIM} AS similarity FROM vectors, ({ASKED}) q WHERE embedding IS NOT NULL")
register("C06_vector_search", lambda t: V.vector_search(t.embedded_chunks, asked(t)), search_sql("SELECT * FROM embedded_chunks"))
register("C07_brute_force_first", lambda t: V.vector_search(t.embedded_chunks.where("embedding IS NOT NULL").orderBy("document_id", "ord").limit(1000), asked(t)), search_sql("SELECT * FROM embedded_chunks WHERE embedding IS NOT NULL ORDER BY document_id, ord LIMIT 1000"))
register("C08_search_with_retry", lambda t: V.search_with_retry(t.embedded_chunks, asked(t), F.col("document_id") == 3, 3, 0.5), "WITH near AS (" + search_sql("SELECT * FROM embedded_chunks WHERE document_id = 3", k=3, threshold=0.5) + "), far AS (" + search_sql("SELECT * FROM embedded_chunks", k=5, threshold=0.05) + ") SELECT * FROM near UNION ALL SELECT * FROM far WHERE query_id NOT IN (SELECT query_id FROM near)")
register("C09_search_by_documents", lambda t: V.vector_search(t.embedded_chunks.where("document_id IN (1, 5, 9, 40)"), asked(t), 2, -1.0, ["document_id"]), search_sql("SELECT * FROM embedded_chunks WHERE document_id IN (1, 5, 9, 40)", k=2, threshold=-1, per=", document_id"))
register("C10_similar_chunks", lambda t: V.vector_search(t.embedded_chunks.where("id <> 12582912"), t.embedded_chunks.where("id = 12582912").select(F.lit(0).alias("query_id"), F.col("embedding").alias("qv")), 5, 0.0), f"SELECT 0::BIGINT AS query_id, rank, id, document_id, similarity FROM (SELECT *, row_number() OVER (ORDER BY similarity DESC, id)::INT AS rank FROM (SELECT c.id, c.document_id, {SIM} AS similarity FROM embedded_chunks c, (SELECT embedding AS qv FROM embedded_chunks WHERE id = 12582912) q WHERE embedding IS NOT NULL AND id <> 12582912) WHERE similarity >= 0) WHERE rank <= 5")


def tenant_search(t):
    meta = F.to_json(F.struct(F.col("lang").alias("lang")))
    docs = t.docs.where("tenant_slug = 'src0'").withColumn("meta", meta).where(F.get_json_object("meta", "$.lang") == "en").select(F.col("id").alias("document_id"), "title")
    hits = V.vector_search(t.embedded_chunks.join(docs.select("document_id"), "document_id", "left_semi"), asked(t), 50, 0.05)
    return hits.join(t.chunks.select("id", "content"), "id").join(docs, "document_id").select("query_id", "rank", "id", "title", "similarity", F.substring("content", 1, 100).alias("preview"), F.length("content").alias("chars"))


register("C11_tenant_search", tenant_search, "WITH h AS (" + search_sql("SELECT e.* FROM embedded_chunks e JOIN docs d ON d.id = e.document_id WHERE tenant_slug = 'src0' AND lang = 'en'", k=50, threshold=0.05) + ") SELECT query_id, rank, h.id, title, similarity, substring(c.content, 1, 100) AS preview, length(c.content)::INT AS chars FROM h JOIN chunks c ON c.id = h.id JOIN docs d ON d.id = h.document_id")
register("C12_index_cells", lambda t: V.cells(t.vectors, t.load("embeddings").where(f"vec_id < {V.CELLS}").select(F.col("vec_id").alias("cell"), F.col("embedding").cast("array<double>").alias("centroid"))), "SELECT document_id, arg_max(cell, (s, -cell)) AS cell FROM (SELECT document_id, e.vec_id AS cell, round(list_cosine_similarity(v.embedding, e.embedding::DOUBLE[]), 6) AS s FROM vectors v, embeddings e WHERE e.vec_id < 100 AND v.embedding IS NOT NULL) GROUP BY 1")


def cells(t):
    """The trained index over the documents' vectors, made once in an application as long as the vectors stay the same."""
    key = (t.spark.sparkContext.applicationId, *(state_of(t.spark, f"{t.dir}/{n}.parquet") for n in ("documents", "embeddings")))
    if key not in INDEXES:
        INDEXES[key] = N.cell_index(document_vectors(t))
    return INDEXES[key]


INDEXES: dict[tuple, N.CellIndex] = {}
PROBES = 30


def recall(t):
    """(query_id, wanted, found): how many of each query's five most similar documents the probing search returns."""
    exact = V.vector_search(document_vectors(t), asked(t), 5, -1.0).select("query_id", "id")
    got = cells(t).search(asked(t), 5, PROBES).select("query_id", "id", F.lit(1).alias("hit"))
    return exact.join(got, ["query_id", "id"], "left").groupBy("query_id").agg(rows_().alias("wanted"), F.count("hit").alias("found"))


register("C12b_cell_search", lambda t: cells(t).search(asked(t), 5, PROBES))
register("C12c_all_cells", lambda t: cells(t).search(asked(t), 5, N.LISTS), search_sql(DOCUMENT_VECTORS, 5, -1))
register("C12d_recall", recall)
register("C13_coverage", lambda t: V.coverage(t.embedded_chunks), "SELECT document_id, count(*) AS total, count(embedding) AS embedded, round(count(embedding) * 100.0::DOUBLE / count(*), 2) AS percent, count(*) = count(embedding) AS completed, count(embedding) > 0 AND count(embedding) < count(*) AS in_progress FROM embedded_chunks GROUP BY 1")
register("C14_needs_embedding", lambda t: t.docs.join(t.embedded_chunks.where("embedding IS NOT NULL").select(F.col("document_id").alias("id")), "id", "left_anti").select("id"), "SELECT id FROM docs d WHERE NOT EXISTS (SELECT 1 FROM embedded_chunks c WHERE c.document_id = d.id AND embedding IS NOT NULL)")
register("C15_time_estimate", lambda t: t.load("orders").select("o_orderkey", (F.col("o_orderkey") % 9000).alias("n")).select("o_orderkey", F.round(V.embed_time(F.col("n")), 2).alias("seconds"), V.time_text(V.embed_time(F.col("n"))).alias("text")).where("seconds < 3600"), "SELECT o_orderkey, round(s, 2) AS seconds, CASE WHEN s < 60 THEN ceil(s)::INT || 's' ELSE ceil(s / 60)::INT || 'min' END AS text FROM (SELECT o_orderkey, greatest(2.0::DOUBLE, n * CASE WHEN n < 100 THEN 0.1::DOUBLE WHEN n < 500 THEN 0.05 ELSE 0.02 END) AS s FROM (SELECT o_orderkey, o_orderkey % 9000 AS n FROM orders))")
register("C16_bypass_documents", lambda t: t.embedded_chunks.groupBy("document_id").agg(F.avg(F.col("embedding").isNull().cast("int")).alias("share")).where("share > 0.5").select("document_id"), "SELECT document_id FROM embedded_chunks GROUP BY 1 HAVING avg((embedding IS NULL)::INT) > 0.5")
register("C17_missing_by_tenant", lambda t: t.embedded_chunks.where("embedding IS NULL").join(t.docs.select(F.col("id").alias("document_id"), "tenant_slug"), "document_id").groupBy("tenant_slug").agg(rows_().alias("missing"), F.count_distinct("document_id").alias("documents")), "SELECT tenant_slug, count(*) AS missing, count(DISTINCT document_id) AS documents FROM embedded_chunks c JOIN docs d ON d.id = c.document_id WHERE embedding IS NULL GROUP BY 1")
