"""Registered queries: streaming flows, run over the tables at hand."""

from pyspark.sql import functions as F

from tessera.operators.upserts import UpsertTable
from tessera.operators.vectors import total
from tessera.sources.storage import scratch
from tessera.streaming import flows as S

from .registry import register


def rows_():
    return F.count(F.lit(1))


def events(t, files=None):
    return S.stream(t.spark, t.dir, "events", files)


def stamp(column):
    """Event times as text, whatever the session's zone: they were read from times without one."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


register("T01_minute_counters", lambda t: S.drained(S.minute_counters(events(t), "user_id"), "complete").select("user_id", stamp("minute").alias("minute"), "n"), "SELECT user_id, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS minute, count(*) AS n FROM events GROUP BY 1, 2")
#: The watermark that events up to the last one leave behind; what ends after it is still open.
MARK = "(SELECT max(ts) FROM events) - INTERVAL {0}"
register(
    "T02_api_rate",
    lambda t: S.drained(S.minute_counters(events(t), "event_type"), "append").select("event_type", stamp("minute").alias("minute"), "n"),
    f"""SELECT event_type, strftime(m, '%Y-%m-%d %H:%M:%S') AS minute, count(*) AS n FROM (SELECT event_type, date_trunc('minute', ts) AS m FROM events)
      WHERE m + INTERVAL 1 MINUTE <= date_trunc('millisecond', {MARK.format('2 MINUTES')}) GROUP BY ALL""",
)
register("T03_bursts", lambda t: S.drained(S.bursts(events(t), "event_type"), "complete").select("event_type", stamp("start").alias("start"), "n"), "WITH g AS (SELECT event_type, ts, (ts - lag(ts) OVER w > INTERVAL 60 SECONDS OR lag(ts) OVER w IS NULL)::INT AS s FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)), r AS (SELECT *, sum(s) OVER (PARTITION BY event_type ORDER BY ts) AS run FROM g) SELECT event_type, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM r GROUP BY event_type, run")
register("T04_metric_flushes", lambda t: S.drained(events(t).select("event_id", "event_type"), "append", 100).groupBy("batch", "flush").agg(rows_().alias("n")))
register("A25_metric_sink", lambda t: S.drained(events(t).select("event_id", "event_type", "value"), "append", 100).select("event_id", "event_type", "value"), "SELECT event_id, event_type, value FROM events")
register("T05_hourly_health", lambda t: S.drained(S.hourly_health(events(t)), "complete").select(stamp("start").alias("start"), "n", "errors"), "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1")
register(
    "T05b_sliding_health",
    lambda t: S.drained(S.hourly_health(events(t), "15 minutes"), "append").select(stamp("start").alias("start"), "n", "errors"),
    f"""SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors
      FROM (SELECT event_type, time_bucket(INTERVAL 15 MINUTES, ts) - to_minutes(15 * unnest([0, 1, 2, 3])) AS start FROM events)
      WHERE start + INTERVAL 1 HOUR <= date_trunc('millisecond', {MARK.format('1 HOUR')}) GROUP BY ALL""",
)
register("T06_job_states", lambda t: S.drained(S.job_states(events(t)), "update").groupBy("job").agg(F.max_by("state", "batch").alias("state"), F.max("steps").alias("steps")), "SELECT user_id AS job, CASE arg_max(event_type, event_id) WHEN 'view' THEN 'pending' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'processing' END AS state, count(*) AS steps FROM events GROUP BY 1")
register("T07_first_seen", lambda t: S.drained(S.first_seen(events(t), ["event_id"]), "append").select("event_id"), "SELECT DISTINCT event_id FROM events")
ENTRY_SECONDS = 2 * 86_400
register(
    "T08_expired_entries",
    lambda t: S.drained(S.expired_entries(events(t), ENTRY_SECONDS), "append", rocks=True).select("key", "ended"),
    f"""WITH w AS (SELECT event_type || ':' || user_id AS key, epoch_us(ts) // 1000 AS ms FROM events),
      n AS (SELECT key, ms + {ENTRY_SECONDS * 1000} AS ended, lead(ms) OVER (PARTITION BY key ORDER BY ms) AS next FROM w)
      SELECT key, ended FROM n WHERE coalesce(next >= ended, ended <= (SELECT max(ms) FROM w) - 3600000)""",
)
register("T09_incremental_embedding", lambda t: S.drained(S.embedded_rows(S.stream(t.spark, t.dir, "documents")), "append").select("doc_id", F.round(total(F.col("embedding")), 6).alias("total")), "SELECT doc_id, round(list_sum(list_transform(range(8), lambda i: round((('0x' || substring(sha1(text || '|' || i), 1, 8))::BIGINT % 1000000) / 500000.0::DOUBLE - 1, 6))), 6) AS total FROM documents")


def last_actions(t):
    """Each user's metadata after a stream of events: the last event's type and value, merged into a table by user."""
    table = UpsertTable(t.spark, scratch(t.spark, "actions"), "user_id long, event_id long, event_type string, value double", ["user_id"], "event_id")
    return S.upserted(events(t).select("user_id", "event_id", "event_type", "value"), table)


register("A26b_metadata_upserts", last_actions, "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1")


def embeddings_by_upsert(t):
    """The documents' embeddings after two runs, the second of which brings what the first one lacked and some rows again."""
    table = UpsertTable(t.spark, scratch(t.spark, "embedded"), "doc_id long, version int, embedding array<double>", ["doc_id"], "version")
    docs = S.embedded_rows(t.load("documents")).withColumn("version", F.lit(1))
    table.merge(docs.where("doc_id % 2 = 0"))
    table.merge(docs.where("doc_id % 2 = 1 OR doc_id % 3 = 0"))
    return table.rows().select("doc_id", F.round(total(F.col("embedding")), 6).alias("total"))


register(
    "C03b_embedding_upserts", embeddings_by_upsert,
    "SELECT doc_id, round(list_sum(list_transform(range(8), lambda i: round((('0x' || substring(sha1(text || '|' || i), 1, 8))::BIGINT % 1000000) / 500000.0::DOUBLE - 1, 6))), 6) AS total FROM documents",
)
