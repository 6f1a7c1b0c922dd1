"""Input tables, and the platform's own tables derived from them.

Each derivation is given twice: as DataFrame expressions and, in DERIVED_SQL, as the SQL of the oracle.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import kept

CHUNK = 1000
CHUNK_IDS = 1 << 20  # ids of one document's chunks
DOCUMENTS_A_BLOCK = 16
METRIC_TYPES = {"view": "query", "click": "embedding", "purchase": "generation", "signup": "performance", "error": "error"}


def lookup(pairs: dict, key: Column) -> Column:
    out = F.lit(None)
    for k, v in reversed(list(pairs.items())):
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def index_block(document_id: Column) -> Column:
    """The block of the positional index in which a document's chunks are."""
    return F.floor(document_id / DOCUMENTS_A_BLOCK)


#: Ways in which people begin questions; derived queries put them before texts of the tables.
LEADS = (
    "Lista de 3 motivos para o contrato", "Resumo em linhas", "the and that", "O que é preço e como funciona?", "tabela de preços dos planos 2024", "", "me fale", "capital da frança", "?!", "erst thon shat nthe of it",
    "compare versus mercado and nosso produto or 12 24 36 48 60 extra words", "cite a frase exata", "ththere ofs anand", "  Suporte ao cliente e prazo da dosagem ",
)
SHEET_LEADS = ("Soma de p_retailprice", "média dos preços", "quantos itens", "filtrar onde p_size maior que 10", "red widget", "valor máximo", "menor que 3")


class Tables:
    """The tables of one folder, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def frame(self, rows: list[tuple], schema: str) -> DataFrame:
        """A small constant table."""
        return self.spark.createDataFrame(rows, schema)

    @cached_property
    def docs(self) -> DataFrame:
        d = self.load("documents")
        return d.select(
            F.col("doc_id").alias("id"),
            F.col("source").alias("tenant_slug"),
            F.concat(F.lit("Document "), F.col("doc_id")).alias("title"),
            F.when((F.col("doc_id") % 4 == 0) & F.rlike("source", F.lit("[02468]$")), F.lit("bypass_upload")).otherwise(F.lit("file")).alias("source"),
            "lang",
            F.col("text").alias("content"),
            (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("doc_id").cast("int"))).alias("created_at"),
        )

    @cached_property
    def chunks(self) -> DataFrame:
        return self.sliced(self.load("documents"))

    def sliced(self, documents: DataFrame, *more: str) -> DataFrame:
        """Slices of 1000 characters of the documents, with more columns of theirs."""
        c = documents.where(F.length("text") > 0).select(
            F.col("doc_id").alias("document_id"),
            F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / CHUNK).cast("int")), lambda i: F.substring(F.col("text"), i * CHUNK + 1, F.lit(CHUNK)))).alias("ord", "content"),
            *more,
        )
        return c.select((F.col("document_id") * CHUNK_IDS + F.col("ord")).alias("id"), "document_id", "ord", "content", *more)

    @cached_property
    def vectors(self) -> DataFrame:
        """(document_id, embedding): documents without a vector keep a null."""
        e = self.load("embeddings").select(F.col("vec_id").alias("document_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        return self.load("documents").select(F.col("doc_id").alias("document_id")).join(e, "document_id", "left")

    @cached_property
    def embedded_chunks(self) -> DataFrame:
        return self.chunks.join(self.vectors, "document_id")

    @cached_property
    def metrics(self) -> DataFrame:
        e = self.load("events")
        k = F.get_json_object("props", "$.k").cast("int")
        return e.select(
            F.col("event_id").alias("id"),
            lookup(METRIC_TYPES, F.col("event_type")).alias("type"),
            "ts",
            "user_id",
            F.concat(F.lit("t"), F.col("user_id") % 5).alias("tenant_id"),
            (F.col("event_type") != "error").alias("success"),
            F.round(F.col("value") * 10, 4).alias("duration_ms"),
            (k % 2 == 0).alias("cached"),
            (k / 100.0).cast("double").alias("confidence"),
            k.alias("batch_size"),
            k.alias("query_hash"),
            F.element_at(F.array(F.lit("vector"), F.lit("keyword"), F.lit("hybrid")), (k % 3 + 1).cast("int")).alias("strategy"),
            F.element_at(F.array(F.lit("query"), F.lit("embedding"), F.lit("generation")), (k % 3 + 1).cast("int")).alias("operation"),
            F.concat(F.lit("E"), (k % 7).cast("string")).alias("error_type"),
            F.concat(F.lit("message "), (k % 4).cast("string")).alias("error_message"),
        )

    @cached_property
    def feedbacks(self) -> DataFrame:
        e = self.load("events")
        k = F.get_json_object("props", "$.k").cast("long")
        return e.select(
            F.col("event_id").alias("id"), F.concat(F.lit("q"), k).alias("query"), k.alias("document_id"),
            F.when(F.col("value") >= 30, 1).otherwise(-1).alias("rating"), F.col("ts").alias("created_at"),
        )

    @cached_property
    def payments(self) -> DataFrame:
        return self.load("orders").select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_totalprice").cast("decimal(12,2)").alias("amount"),
            lookup({"F": "approved", "O": "pending", "P": "rejected"}, F.col("o_orderstatus")).alias("status"),
            F.col("o_orderpriority").alias("payment_method"), F.col("o_orderdate").alias("created_at"),
        )

    @cached_property
    def subscriptions(self) -> DataFrame:
        o = self.load("orders")
        monthly = F.col("o_orderkey") % 2 == 0
        return o.select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_totalprice").cast("decimal(12,2)").alias("amount"),
            lookup({"F": "active", "O": "cancelled", "P": "expired"}, F.col("o_orderstatus")).alias("status"),
            F.when(monthly, "monthly").otherwise("yearly").alias("billing_cycle"),
            F.col("o_orderdate").alias("starts_at"),
            F.when(monthly, F.col("o_orderdate") + F.expr("INTERVAL '1' MONTH")).otherwise(F.col("o_orderdate") + F.expr("INTERVAL '1' YEAR")).alias("ends_at"),
            F.when(F.col("o_orderstatus") == "O", F.col("o_orderdate")).alias("cancelled_at"),
        )

    @cached_property
    def users(self) -> DataFrame:
        return self.load("customer").select(
            F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("."))), F.lit("@example.com")).alias("email"),
            F.col("c_mktsegment").alias("plan_name"), (F.col("c_custkey") % 50 == 0).alias("is_admin"), F.col("c_acctbal").alias("balance"),
        )

    @cached_property
    def plans(self) -> DataFrame:
        """One plan for each market segment; -1 is an unlimited quota."""
        rows = [("AUTOMOBILE", 100, 1, 10.0), ("BUILDING", 10_000, 50, 20.0), ("FURNITURE", 50_000, 200, 30.0), ("HOUSEHOLD", 200_000, 1000, 40.0), ("MACHINERY", -1, -1, 50.0)]
        return self.frame(rows, "plan_name string, tokens_limit long, documents_limit long, margin double")

    @cached_property
    def usage(self) -> DataFrame:
        return self.load("lineitem").select(
            F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("provider"),
            (F.col("l_quantity") * 100).cast("long").alias("input_tokens"), (F.col("l_quantity") * 10).cast("long").alias("output_tokens"), F.col("l_shipdate").alias("ts"),
        )

    @cached_property
    def providers(self) -> DataFrame:
        rows = [("A", 0.0005, 0.0015, 30.0, 10.0, 25.0), ("N", 0.01, 0.03, 20.0, 15.0, 60.0), ("R", 0.0, 0.0, 50.0, 5.0, 90.0)]
        return self.frame(rows, "provider string, input_cost double, output_cost double, base_markup double, min_markup double, max_markup double")

    @cached_property
    def cache_ops(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        return self.load("events").select(
            F.col("event_id").alias("id"), "ts",
            F.concat(F.lit("rag:"), lookup({"view": "search", "click": "embedding", "purchase": "answer", "signup": "document", "error": "x"}, F.col("event_type")), F.lit(":"), k).alias("key"),
            (k % 3 != 0).alias("hit"), (F.col("value") / 10).alias("latency_ms"), (F.col("value") * 1000).cast("int").alias("size_bytes"),
            ((k - 5) * 10_000).alias("ttl"), k.cast("long").alias("document_id"),
        )

    @cached_property
    def queries(self) -> DataFrame:
        """(query_id, query): all benchmark texts as search queries."""
        return self.load("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))

    def asked_texts(self, leads: tuple[str, ...] = LEADS) -> DataFrame:
        """(query_id, query): every benchmark text and every turn of a conversation as a question, most of them after a lead."""
        said = self.load("conversations").select((1_000_000 + F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
        both = self.load("benchmark").select(F.col("item_id").alias("query_id"), "text").unionByName(said).withColumn("text", F.coalesce("text", F.lit("")))
        lead = F.get(F.array(*map(F.lit, leads)), F.col("query_id") % len(leads))
        short = F.concat(lead, F.lit(" "), F.substring_index("text", " ", 3))
        kinds = [F.col("text"), F.concat(lead, F.lit(" "), F.col("text")), short, lead]
        return both.select("query_id", F.get(F.array(*kinds), F.floor(F.col("query_id") / len(leads)) % 4).alias("query"))

    @cached_property
    def hybrid_queries(self) -> DataFrame:
        """(query_id, query, qv, tenant_slug): every vector whose id is divisible by 100, asked by its document's tenant.

        Its text is the first four words of a benchmark text; the vector of every third is missing, as after a failed call.
        """
        items = self.load("benchmark").select("item_id", F.substring_index("text", " ", 4).alias("query"))
        many = items.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("many"))
        asked = self.load("embeddings").where("vec_id % 100 = 0").crossJoin(many)  # of one row
        asked = asked.select(
            F.col("vec_id").alias("query_id"), (F.floor(F.col("vec_id") / 100) % F.col("many")).alias("item_id"),
            F.when(F.col("vec_id") % 300 > 0, F.col("embedding").cast("array<double>")).alias("qv"),
        )
        tenants = self.docs.select(F.col("id").alias("query_id"), "tenant_slug")
        return asked.join(items, "item_id").join(tenants, "query_id").select("query_id", "query", "qv", "tenant_slug")

    @cached_property
    def index(self) -> DataFrame:
        """The positional index of the chunks' tokens, built once in an application as long as the documents stay the same."""
        from tessera.operators.postings import positional_index  # an operator, which the tables else don't need

        make = lambda: positional_index(self.chunks, index_block(F.col("document_id"))).sortWithinPartitions("token", "block")
        return kept(self.spark, "postings", [f"{self.dir}/documents.parquet"], make)




def asked_texts_sql(leads: tuple[str, ...]) -> str:
    kinds = "text, lead || ' ' || text, lead || ' ' || array_to_string(string_split(text, ' ')[1:3], ' '), lead"
    return f"""SELECT query_id, ([{kinds}])[(query_id // {len(leads)}) % 4 + 1] AS query FROM (
      SELECT query_id, coalesce(text, '') AS text, ({list(leads)})[query_id % {len(leads)} + 1] AS lead FROM (
        SELECT item_id AS query_id, text FROM benchmark UNION ALL SELECT 1000000 + conv_id * 1000 + turn, text FROM conversations))"""


DERIVED_SQL = {
    "asked_texts": asked_texts_sql(LEADS),
    "sheet_questions": asked_texts_sql(SHEET_LEADS),
    "docs": "SELECT doc_id AS id, source AS tenant_slug, 'Document ' || doc_id AS title, CASE WHEN doc_id % 4 = 0 AND regexp_matches(source, '[02468]$') THEN 'bypass_upload' ELSE 'file' END AS source, lang, text AS content, TIMESTAMP '2024-01-01' + to_hours(doc_id) AS created_at FROM documents",
    "chunks": "SELECT doc_id * 1048576 + ord AS id, doc_id AS document_id, ord::INT AS ord, substring(text, (ord * 1000 + 1)::BIGINT, 1000) AS content FROM (SELECT doc_id, text, unnest(range(0, (length(text) - 1) // 1000 + 1)) AS ord FROM documents WHERE length(text) > 0)",
    "vectors": "SELECT d.doc_id AS document_id, e.embedding::DOUBLE[] AS embedding FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id",
    "embedded_chunks": "SELECT c.*, v.embedding FROM chunks c JOIN vectors v USING (document_id)",
    "rag_metrics": "SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'query' WHEN 'click' THEN 'embedding' WHEN 'purchase' THEN 'generation' WHEN 'signup' THEN 'performance' WHEN 'error' THEN 'error' END AS type, ts, user_id, 't' || user_id % 5 AS tenant_id, event_type <> 'error' AS success, round(value * 10, 4) AS duration_ms, k % 2 = 0 AS cached, k / 100.0::DOUBLE AS confidence, k AS batch_size, k AS query_hash, (['vector', 'keyword', 'hybrid'])[k % 3 + 1] AS strategy, (['query', 'embedding', 'generation'])[k % 3 + 1] AS operation, 'E' || k % 7 AS error_type, 'message ' || k % 4 AS error_message FROM (SELECT *, (props ->> '$.k')::INT AS k FROM events)",
    "rag_feedbacks": "SELECT event_id AS id, 'q' || k AS query, k AS document_id, CASE WHEN value >= 30 THEN 1 ELSE -1 END AS rating, ts AS created_at FROM (SELECT *, (props ->> '$.k')::BIGINT AS k FROM events)",
    "payments": "SELECT o_orderkey AS id, o_custkey AS user_id, o_totalprice::DECIMAL(12,2) AS amount, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'pending' WHEN 'P' THEN 'rejected' END AS status, o_orderpriority AS payment_method, o_orderdate AS created_at FROM orders",
    "subscriptions": "SELECT o_orderkey AS id, o_custkey AS user_id, o_totalprice::DECIMAL(12,2) AS amount, CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN 'cancelled' WHEN 'P' THEN 'expired' END AS status, CASE WHEN o_orderkey % 2 = 0 THEN 'monthly' ELSE 'yearly' END AS billing_cycle, o_orderdate AS starts_at, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 1 MONTH ELSE o_orderdate + INTERVAL 1 YEAR END AS ends_at, CASE WHEN o_orderstatus = 'O' THEN o_orderdate END AS cancelled_at FROM orders",
    "users": "SELECT c_custkey AS id, c_name AS name, lower(replace(c_name, '#', '.')) || '@example.com' AS email, c_mktsegment AS plan_name, c_custkey % 50 = 0 AS is_admin, c_acctbal AS balance FROM customer",
    "plans": "SELECT * FROM (VALUES ('AUTOMOBILE', 100::BIGINT, 1::BIGINT, 10.0::DOUBLE), ('BUILDING', 10000, 50, 20.0), ('FURNITURE', 50000, 200, 30.0), ('HOUSEHOLD', 200000, 1000, 40.0), ('MACHINERY', -1, -1, 50.0)) p(plan_name, tokens_limit, documents_limit, margin)",
    "ai_usage": "SELECT l_orderkey AS order_id, l_linenumber AS line, l_returnflag AS provider, (l_quantity * 100)::BIGINT AS input_tokens, (l_quantity * 10)::BIGINT AS output_tokens, l_shipdate AS ts FROM lineitem",
    "providers": "SELECT * FROM (VALUES ('A', 0.0005::DOUBLE, 0.0015::DOUBLE, 30.0::DOUBLE, 10.0::DOUBLE, 25.0::DOUBLE), ('N', 0.01, 0.03, 20.0, 15.0, 60.0), ('R', 0.0, 0.0, 50.0, 5.0, 90.0)) p(provider, input_cost, output_cost, base_markup, min_markup, max_markup)",
    "cache_ops": "SELECT event_id AS id, ts, 'rag:' || CASE event_type WHEN 'view' THEN 'search' WHEN 'click' THEN 'embedding' WHEN 'purchase' THEN 'answer' WHEN 'signup' THEN 'document' ELSE 'x' END || ':' || k AS key, k % 3 <> 0 AS hit, value / 10 AS latency_ms, trunc(value * 1000)::INT AS size_bytes, (k - 5) * 10000 AS ttl, k::BIGINT AS document_id FROM (SELECT *, (props ->> '$.k')::INT AS k FROM events)",
    "hybrid_queries": """SELECT vec_id AS query_id, array_to_string(string_split(benchmark.text, ' ')[1:4], ' ') AS query,
      CASE WHEN vec_id % 300 > 0 THEN embedding::DOUBLE[] END AS qv, source AS tenant_slug
      FROM embeddings JOIN benchmark ON item_id = (vec_id // 100) % (SELECT count(*) FROM benchmark) JOIN documents ON doc_id = vec_id WHERE vec_id % 100 = 0""",
    "search_queries": "SELECT item_id AS query_id, text AS query FROM benchmark",
}
