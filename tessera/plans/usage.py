"""Registered queries: usage metrics, caches and rate limits."""

from pyspark.sql import functions as F

from tessera.operators import caching as C
from tessera.operators import usage as U
from tessera.operators.folds import burst_limited
from tessera.sources.storage import kept

from .registry import register

A, B = "2024-01-08 00:00:00", "2024-01-15 00:00:00"
HOUR, DAY, NOW = "2024-01-14 23:00:00", "2024-01-14 00:00:00", "2024-01-15 00:00:00"
W = f"ts BETWEEN TIMESTAMP '{A}' AND TIMESTAMP '{B}'"


def rows_():
    return F.count(F.lit(1))


def one(kind, figures):
    return lambda t: U.of_type(t.metrics, kind, A, B).agg(*figures())


register("H01_metric_count", lambda t: U.of_type(t.metrics, "embedding", A, B).where("cached").agg(rows_().alias("n")), f"SELECT count(*) AS n FROM rag_metrics WHERE type = 'embedding' AND {W} AND cached")
register("H02_success_rate", lambda t: U.within(t.metrics, A, B).groupBy("tenant_id").agg(U.success_rate().alias("success_rate")), f"SELECT tenant_id, coalesce(round(count(*) FILTER (WHERE success) * 100.0::DOUBLE / count(*), 2), 100.0) AS success_rate FROM rag_metrics WHERE {W} GROUP BY 1")
register("H03_average_duration", one("query", lambda: (F.round(F.avg("duration_ms"), 4).alias("avg_duration"),)), f"SELECT round(avg(duration_ms), 4) AS avg_duration FROM rag_metrics WHERE type = 'query' AND {W}")
register("H04_percentile_duration", lambda t: U.within(t.metrics, A, B).groupBy("type").agg(*(U.nearest_rank("duration_ms", p / 100).alias(f"p{p}") for p in (50, 95, 99))), f"SELECT type, quantile_disc(nullif(duration_ms, 0), 0.5) AS p50, quantile_disc(nullif(duration_ms, 0), 0.95) AS p95, quantile_disc(nullif(duration_ms, 0), 0.99) AS p99 FROM rag_metrics WHERE {W} GROUP BY 1")
register("H05_cache_hit_rate", lambda t: U.within(t.metrics, A, B).groupBy("type").agg(U.hit_rate().alias("hit_rate")), f"SELECT type, round(count(*) FILTER (WHERE cached) * 100.0::DOUBLE / count(*), 2) AS hit_rate FROM rag_metrics WHERE {W} GROUP BY 1")
register("H06_error_rate", lambda t: U.operation_error_rate(t.metrics, "query", A, B), f"SELECT coalesce(round(count(*) FILTER (WHERE type = 'error' AND operation = 'query') * 100.0::DOUBLE / nullif(count(*) FILTER (WHERE type = 'query'), 0), 2), 0.0) AS error_rate FROM rag_metrics WHERE {W}")
register("H06b_window_error_rate", lambda t: U.within(t.metrics, A, B).agg(U.window_error_rate().alias("error_rate")), f"SELECT round(count(*) FILTER (WHERE type = 'error') * 100.0::DOUBLE / count(*), 2) AS error_rate FROM rag_metrics WHERE {W}")
register("H07_health_state", lambda t: U.within(t.metrics, A, B).groupBy("tenant_id").agg(U.health_state(U.window_error_rate(), F.avg(F.when(F.col("type") == "query", F.col("duration_ms")))).alias("state")), f"SELECT tenant_id, CASE WHEN e > 10 OR d > 5000 THEN 'critical' WHEN e > 5 OR d > 2000 THEN 'warning' WHEN e > 1 OR d > 1000 THEN 'degraded' ELSE 'healthy' END AS state FROM (SELECT tenant_id, round(count(*) FILTER (WHERE type = 'error') * 100.0 / count(*), 2) AS e, coalesce(avg(duration_ms) FILTER (WHERE type = 'query'), 0) AS d FROM rag_metrics WHERE {W} GROUP BY 1)")
register("H08_batch_and_confidence", lambda t: U.within(t.metrics, A, B).agg(F.round(F.avg(F.when(F.col("type") == "embedding", F.col("batch_size"))), 6).alias("avg_batch_size"), F.round(F.avg(F.when(F.col("type") == "generation", F.col("confidence"))), 6).alias("avg_confidence")), f"SELECT round(avg(batch_size) FILTER (WHERE type = 'embedding'), 6) AS avg_batch_size, round(avg(confidence) FILTER (WHERE type = 'generation'), 6) AS avg_confidence FROM rag_metrics WHERE {W}")
register("H09_top_errors", lambda t: U.top(U.of_type(t.metrics, "error", A, B), ["error_type", "error_message"], 5), f"SELECT error_type, error_message, count(*) AS count FROM rag_metrics WHERE type = 'error' AND {W} GROUP BY 1, 2 ORDER BY count DESC, 1, 2 LIMIT 5")
register("H10_slow_queries", one("query", lambda: (F.count_if(F.col("duration_ms") > 1000).alias("slow"),)), f"SELECT count(*) FILTER (WHERE duration_ms > 1000) AS slow FROM rag_metrics WHERE type = 'query' AND {W}")
register("H11_throughput", one("query", lambda: (F.round(rows_() / (7 * 1440), 2).alias("per_minute"), F.round(rows_() / 7, 2).alias("per_day"),)), f"SELECT round(count(*) / (7 * 1440.0::DOUBLE), 2) AS per_minute, round(count(*) / 7.0::DOUBLE, 2) AS per_day FROM rag_metrics WHERE type = 'query' AND {W}")
register("H12_peak_hour", lambda t: U.of_type(t.metrics, "query", A, B).groupBy(F.hour("ts").alias("hour")).agg(rows_().alias("count")).orderBy(F.desc("count"), "hour").limit(1), f"SELECT hour(ts)::INT AS hour, count(*) AS count FROM rag_metrics WHERE type = 'query' AND {W} GROUP BY 1 ORDER BY count DESC, hour LIMIT 1")
register("H13_unique_users", one(["query", "generation"], lambda: (F.count_distinct("user_id").alias("users"),)), f"SELECT count(DISTINCT user_id) AS users FROM rag_metrics WHERE type IN ('query', 'generation') AND {W}")
register("H14_top_queries", lambda t: U.top(U.of_type(t.metrics, "query", A, B), ["query_hash"], 10), f"SELECT query_hash, count(*) AS count FROM rag_metrics WHERE type = 'query' AND {W} GROUP BY 1 ORDER BY count DESC, 1 LIMIT 10")
register("H15_most_queried_documents", lambda t: U.top(U.of_type(t.metrics, "query", A, B).withColumn("document_id", F.get_json_object(F.to_json(F.struct(F.array("query_hash").alias("document_ids"))), "$.document_ids[0]").cast("int")), ["document_id"], 10), f"SELECT query_hash AS document_id, count(*) AS count FROM rag_metrics WHERE type = 'query' AND {W} GROUP BY 1 ORDER BY count DESC, 1 LIMIT 10")
register("H16_document_coverage", lambda t: U.of_type(t.metrics, "query", A, B).agg(F.count_distinct(F.array("query_hash")).alias("queried")).crossJoin(t.docs.agg(rows_().alias("total"))).select("queried", "total", U.percent(F.col("queried"), F.col("total")).alias("coverage")), f"SELECT queried, total, round(queried * 100.0::DOUBLE / total, 2) AS coverage FROM (SELECT count(DISTINCT [query_hash]) AS queried FROM rag_metrics WHERE type = 'query' AND {W}), (SELECT count(*) AS total FROM docs)")
register("H17_duration_trend", lambda t: U.duration_trend(t.metrics, "query", A, B), f"SELECT strftime(ts, '%Y-%m-%d') AS day, round(avg(duration_ms), 4) AS avg_duration, count(*) AS count FROM rag_metrics WHERE type = 'query' AND {W} GROUP BY 1")
register("H18_error_trend", lambda t: U.error_trend(t.metrics, A, B), f"SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS total_ops, count(*) FILTER (WHERE type = 'error') AS errors, round(count(*) FILTER (WHERE type = 'error') * 100.0::DOUBLE / count(*), 2) AS error_rate FROM rag_metrics WHERE {W} GROUP BY 1")
register("H19_cache_trend", lambda t: U.cache_trend(t.metrics, A, B), f"SELECT strftime(ts, '%Y-%m-%d') AS day, type, count(*) AS total_ops, count(*) FILTER (WHERE cached) AS cache_hits, round(count(*) FILTER (WHERE cached) * 100.0::DOUBLE / count(*), 2) AS hit_rate FROM rag_metrics WHERE type IN ('embedding', 'generation') AND {W} GROUP BY 1, 2")
register("H20_tenant_usage", lambda t: U.tenant_usage(t.metrics, A, B), f"SELECT tenant_id, type, count(*) AS count, round(avg(duration_ms), 4) AS avg_duration FROM rag_metrics WHERE type IN ('query', 'embedding', 'generation') AND {W} GROUP BY 1, 2")
register("H20b_active_tenants", lambda t: U.within(t.metrics, A, B).groupBy("tenant_id").agg(rows_().alias("operations")), f"SELECT tenant_id, count(*) AS operations FROM rag_metrics WHERE {W} GROUP BY 1")
register("H21_confidence_distribution", lambda t: U.of_type(t.metrics, "generation", A, B).groupBy(U.confidence_band(F.col("confidence")).alias("band")).agg(rows_().alias("count")), f"SELECT CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' WHEN confidence >= 0.4 THEN 'low' ELSE 'very_low' END AS band, count(*) AS count FROM rag_metrics WHERE type = 'generation' AND {W} GROUP BY 1")
register("H22_strategies_used", lambda t: U.top(U.of_type(t.metrics, "query", A, B), ["strategy"], 100), f"SELECT strategy, count(*) AS count FROM rag_metrics WHERE type = 'query' AND {W} GROUP BY 1 ORDER BY count DESC, 1 LIMIT 100")
register("H23_performance_category", lambda t: t.metrics.groupBy(U.performance_category(F.col("duration_ms")).alias("category")).agg(rows_().alias("count")), "SELECT CASE WHEN duration_ms < 100 THEN 'fast' WHEN duration_ms < 500 THEN 'medium' WHEN duration_ms < 2000 THEN 'slow' ELSE 'very_slow' END AS category, count(*) AS count FROM rag_metrics GROUP BY 1")
register("H24_token_estimate", lambda t: t.docs.select("id", U.estimated_tokens(F.col("content")).alias("tokens")), "SELECT id, strlen(content) // 4 AS tokens FROM docs")
register("H25_health_dashboard", lambda t: U.health_dashboard(t.metrics, NOW, HOUR, DAY), f"""WITH d AS (SELECT *, ts >= TIMESTAMP '{HOUR}' AS h FROM rag_metrics WHERE ts BETWEEN TIMESTAMP '{DAY}' AND TIMESTAMP '{NOW}'),
 r AS (SELECT count(*) FILTER (WHERE h AND type = 'query') AS query_last_hour, count(*) FILTER (WHERE h AND type = 'embedding') AS embedding_last_hour, count(*) FILTER (WHERE h AND type = 'generation') AS generation_last_hour, count(*) FILTER (WHERE h AND type = 'error') AS error_last_hour,
 count(*) FILTER (WHERE type = 'query') AS query_last_day, count(*) FILTER (WHERE type = 'embedding') AS embedding_last_day, count(*) FILTER (WHERE type = 'generation') AS generation_last_day, count(*) FILTER (WHERE type = 'error') AS error_last_day,
 coalesce(round(count(*) FILTER (WHERE h AND type = 'query' AND success) * 100.0 / nullif(count(*) FILTER (WHERE h AND type = 'query'), 0), 2), 100.0) AS query_success_rate,
 round(avg(duration_ms) FILTER (WHERE h AND type = 'query'), 4) AS query_avg_duration, quantile_disc(CASE WHEN h AND type = 'query' AND duration_ms <> 0 THEN duration_ms END, 0.95) AS query_p95_duration,
 coalesce(round(count(*) FILTER (WHERE h AND type = 'embedding' AND cached) * 100.0 / nullif(count(*) FILTER (WHERE h AND type = 'embedding'), 0), 2), 0.0) AS embedding_hit_rate,
 round(avg(batch_size) FILTER (WHERE h AND type = 'embedding'), 4) AS avg_batch_size, round(avg(confidence) FILTER (WHERE h AND type = 'generation'), 4) AS avg_confidence,
 coalesce(round(count(*) FILTER (WHERE h AND type = 'error') * 100.0 / nullif(count(*) FILTER (WHERE h), 0), 2), 0.0) AS error_rate, count(*) FILTER (WHERE h AND type = 'query' AND duration_ms > 5000) AS slow_queries,
 round(count(*) FILTER (WHERE h AND type = 'query') / 60, 2) AS throughput_qpm, count(*) AS operations FROM d)
 SELECT metric, value FROM (SELECT COLUMNS(*)::DOUBLE FROM r) UNPIVOT INCLUDE NULLS (value FOR metric IN (COLUMNS(*)))""")
register("H25b_usage_report", lambda t: U.usage_report(t.metrics, A, B, 7), f"""WITH r AS (SELECT count(*) FILTER (WHERE type = 'query') AS queries, round(count(*) FILTER (WHERE type = 'query') / 7, 2) AS daily_average, count(DISTINCT user_id) FILTER (WHERE type IN ('query', 'generation')) AS unique_users, count(DISTINCT query_hash) FILTER (WHERE type = 'query') AS documents_queried, count(DISTINCT tenant_id) AS active_tenants FROM rag_metrics WHERE {W})
 SELECT metric, value FROM (SELECT COLUMNS(*)::DOUBLE FROM r) UNPIVOT INCLUDE NULLS (value FOR metric IN (COLUMNS(*)))""")
register("H26_metric_envelope", lambda t: U.envelope(t.metrics))
register("H27_summary_stats", lambda t: U.summary_stats(t.metrics, ["type"], "duration_ms"), "SELECT type, count(*) AS count, round(sum(duration_ms), 4) AS sum, min(duration_ms) AS min, max(duration_ms) AS max, round(avg(duration_ms), 6) AS mean, s[floor(len(s) * 0.5)::INT + 1] AS p50, s[floor(len(s) * 0.9)::INT + 1] AS p90, s[floor(len(s) * 0.95)::INT + 1] AS p95, s[floor(len(s) * 0.99)::INT + 1] AS p99 FROM (SELECT *, list_sort(list(duration_ms) OVER (PARTITION BY type)) AS s FROM rag_metrics) GROUP BY type, s")
register("H27b_histogram", lambda t: U.histogram(t.metrics.withColumn("seconds", F.col("duration_ms") / 1000), ["type"], "seconds"), "WITH b AS (SELECT * FROM (VALUES (0.005::DOUBLE, '0.005'), (0.01, '0.01'), (0.025, '0.025'), (0.05, '0.05'), (0.075, '0.075'), (0.1, '0.1'), (0.25, '0.25'), (0.5, '0.5'), (0.75, '0.75'), (1.0, '1.0'), (2.5, '2.5'), (5.0, '5.0'), (7.5, '7.5'), (10.0, '10.0'), ('inf'::DOUBLE, '+Inf')) x(bound, le)) SELECT type, le, count(*) FILTER (WHERE duration_ms / 1000 <= bound) AS count FROM rag_metrics, b GROUP BY 1, 2")
register("H28_recent_points", lambda t: U.recent_points(t.metrics, "type", 86_400, B, 40).select("id", "type"), f"SELECT id, type FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY ts DESC, id DESC) AS n FROM rag_metrics) WHERE n <= 40 AND ts >= TIMESTAMP '{B}' - INTERVAL 86400 SECONDS")
register("H29_request_metrics", lambda t: t.metrics.select("type", (F.element_at(F.array(*map(F.lit, (200, 201, 404, 500))), (F.col("query_hash") % 4 + 1))).alias("status")).groupBy(F.concat_ws(":", F.lit("http"), "type", F.col("status").cast("string")).alias("label")).agg(rows_().alias("requests"), F.count_if(F.col("status") >= 400).alias("errors")), "SELECT 'http:' || type || ':' || status AS label, count(*) AS requests, count(*) FILTER (WHERE status >= 400) AS errors FROM (SELECT type, ([200, 201, 404, 500])[query_hash % 4 + 1] AS status FROM rag_metrics) GROUP BY 1")
register("H48_rate_limit", lambda t: U.rate_limited(t.metrics.withColumn("who", F.col("tenant_id")), "who", 1).select("id", "allowed"), "SELECT id, row_number() OVER (PARTITION BY tenant_id, date_trunc('minute', ts) ORDER BY ts, id) <= 1 AS allowed FROM rag_metrics")


def user_sketches(t):
    """Sketches of the users of each hour and tenant, written once as long as the events stay the same."""
    return kept(t.spark, "user-sketches", [f"{t.dir}/events.parquet"], lambda: U.hourly_sketches(t.metrics.where("type IN ('query', 'generation')"), "user_id"))


register("H13b_users_by_day", lambda t: U.distinct_from(user_sketches(t).withColumn("day", F.to_date("hour")), ["day"]))
register("H20b_users_by_tenant", lambda t: U.distinct_from(user_sketches(t), ["tenant_id"]))
#: The rule as a fold, row by row: a counter for each hour, and one that ends an hour after the last allowed request.
BURST_SQL = """WITH RECURSIVE e AS (
      SELECT id, tenant_id AS who, epoch_us(ts) AS us, row_number() OVER (PARTITION BY tenant_id ORDER BY ts, id) AS n FROM rag_metrics),
    f AS (
      SELECT who, n, id, us // {window}000000 AS win, 1 AS c, 1 AS b, us AS last, true AS allowed FROM e WHERE n = 1
      UNION ALL
      SELECT who, n, id, win, c + ok::INT, b + ok::INT, CASE WHEN ok THEN us ELSE last END, ok FROM (SELECT *, c < {limit} AND b < {burst} AS ok FROM (
        SELECT e.who, e.n, e.id, e.us, e.us // {window}000000 AS win, CASE WHEN e.us // {window}000000 = f.win THEN f.c ELSE 0 END AS c,
          CASE WHEN e.us - f.last >= {idle}000000 THEN 0 ELSE f.b END AS b, f.last FROM f JOIN e ON e.who = f.who AND e.n = f.n + 1)))
    SELECT id, allowed FROM f"""
register("H48b_burst_limit", lambda t: burst_limited(t.metrics, "tenant_id", 1, 3), BURST_SQL.format(window=60, limit=1, burst=3, idle=60))
register("H48c_hourly_burst_limit", lambda t: burst_limited(t.metrics, "tenant_id", 3, 10, 3600, 3600), BURST_SQL.format(window=3600, limit=3, burst=10, idle=3600))
TYPE = "CASE WHEN contains(key, 'embedding') THEN 'embedding' WHEN contains(key, 'search') OR contains(key, 'query') THEN 'search' WHEN contains(key, 'generation') OR contains(key, 'answer') THEN 'generation' WHEN contains(key, 'rerank') THEN 'rerank' WHEN contains(key, 'document') THEN 'document' ELSE 'other' END"
register("H49_cache_by_type", lambda t: C.by_type(t.cache_ops), f"SELECT {TYPE} AS type, count(*) AS ops, round(count(*) FILTER (WHERE hit) * 100.0::DOUBLE / count(*), 2) AS hit_rate, round(avg(latency_ms), 4) AS avg_latency FROM cache_ops GROUP BY 1")
register("H50_cache_key", lambda t: t.queries.select("query_id", C.cache_key(F.col("query"), F.col("query_id"), F.lit("auto"), F.lit("plain"), F.lit(2), F.lit(5)).alias("key")), r"SELECT query_id, md5(trim(regexp_replace(lower(query), '\s+', ' ', 'g')) || '|doc:' || query_id || '|mode:auto|format:plain|strictness:2|topk:5') AS key FROM search_queries")
register("H51_cache_histograms", lambda t: t.cache_ops.orderBy("key", "id").limit(100).groupBy(C.size_class(F.col("size_bytes")).alias("size"), C.ttl_class(F.col("ttl")).alias("ttl")).agg(rows_().alias("count")), "SELECT CASE WHEN size_bytes < 1024 THEN '<1KB' WHEN size_bytes < 10240 THEN '1-10KB' WHEN size_bytes < 51200 THEN '10-50KB' WHEN size_bytes < 102400 THEN '50-100KB' ELSE '>100KB' END AS size, CASE WHEN ttl < 0 THEN 'No TTL' WHEN ttl < 3600 THEN '<1h' WHEN ttl < 86400 THEN '1-24h' WHEN ttl < 604800 THEN '1-7d' ELSE '>7d' END AS ttl, count(*) AS count FROM (SELECT * FROM cache_ops ORDER BY key, id LIMIT 100) GROUP BY 1, 2")
register("H52_document_cache", lambda t: t.cache_ops.join(t.chunks.select("document_id"), "document_id", "left_semi").groupBy("document_id").agg(F.count_if("hit").alias("hits"), rows_().alias("ops"), U.hit_rate("hit").alias("hit_rate")).orderBy(F.desc("hits"), "document_id").limit(10), "SELECT document_id, count(*) FILTER (WHERE hit) AS hits, count(*) AS ops, round(count(*) FILTER (WHERE hit) * 100.0::DOUBLE / count(*), 2) AS hit_rate FROM cache_ops o WHERE EXISTS (SELECT 1 FROM chunks c WHERE c.document_id = o.document_id) GROUP BY 1 ORDER BY hits DESC, 1 LIMIT 10")
register("H53_cache_admission", lambda t: t.cache_ops.select("id", C.lifetime(F.col("key")).alias("ttl"), C.admitted(F.col("size_bytes")).alias("admitted"), (F.col("ttl") <= 0).alias("expired")), "SELECT id, CASE WHEN contains(key, 'embedding') THEN 86400 WHEN contains(key, 'search') THEN 1800 WHEN contains(key, 'answer') THEN 7200 WHEN contains(key, 'document') THEN 43200 ELSE 3600 END AS ttl, size_bytes BETWEEN 100 AND 1048576 AS admitted, ttl <= 0 AS expired FROM (SELECT * FROM cache_ops)".replace("ttl <= 0 AS expired FROM (SELECT * FROM cache_ops)", "c.ttl <= 0 AS expired FROM cache_ops c"))
register("H60_cache_service", lambda t: t.cache_ops.select(F.element_at(F.array(*map(F.lit, ("no_cache", "short_term", "long_term", "persistent"))), (F.col("document_id") % 4 + 1).cast("int")).alias("strategy"), "hit").groupBy("strategy", C.strategy_ttl(F.col("strategy")).alias("ttl")).agg(rows_().alias("ops"), U.hit_rate("hit").alias("hit_rate")), "SELECT strategy, CASE strategy WHEN 'no_cache' THEN 0 WHEN 'short_term' THEN 300 WHEN 'long_term' THEN 3600 ELSE 86400 END AS ttl, count(*) AS ops, round(count(*) FILTER (WHERE hit) * 100.0::DOUBLE / count(*), 2) AS hit_rate FROM (SELECT *, (['no_cache', 'short_term', 'long_term', 'persistent'])[document_id % 4 + 1] AS strategy FROM cache_ops) GROUP BY 1, 2")
register("H62_overall_hit_rate", lambda t: t.cache_ops.agg(U.hit_rate("hit").alias("hit_rate")), "SELECT round(count(*) FILTER (WHERE hit) * 100.0::DOUBLE / count(*), 2) AS hit_rate FROM cache_ops")
