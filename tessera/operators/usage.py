"""Usage analytics over metric events: counts, rates, durations, trends and reports.

`metrics` frames have the columns of Tables.metrics. Windows are inclusive at both ends and always given, so that no
result depends on the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def within(df: DataFrame, start: str, end: str, ts: str = "ts") -> DataFrame:
    return df.where(F.col(ts).between(at(start), at(end)))


def of_type(metrics: DataFrame, kinds: str | list[str], start: str, end: str) -> DataFrame:
    return within(metrics.where(F.col("type").isin([kinds] if isinstance(kinds, str) else kinds)), start, end)


def percent(part: Column, whole: Column, empty: float = 0.0, digits: int = 2) -> Column:
    """part of whole in percent; `empty` where whole is zero."""
    return F.coalesce(F.round(F.try_divide(part * 100.0, whole), digits), F.lit(empty))


def success_rate() -> Column:
    return percent(F.count_if("success"), F.count(F.lit(1)), 100.0)


def hit_rate(flag: str = "cached") -> Column:
    return percent(F.count_if(flag), F.count(F.lit(1)))


def nearest_rank(column: str, p: float) -> Column:
    """The p-th percentile by nearest rank; zero and null values are dropped first."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY CASE WHEN {column} <> 0 THEN {column} END)")


def operation_error_rate(metrics: DataFrame, operation: str, start: str, end: str) -> DataFrame:
    """Errors of an operation against the operation's metrics."""
    errors = F.count_if((F.col("type") == "error") & (F.col("operation") == operation))
    return within(metrics, start, end).agg(percent(errors, F.count_if(F.col("type") == operation)).alias("error_rate"))


def window_error_rate() -> Column:
    return percent(F.count_if(F.col("type") == "error"), F.count(F.lit(1)))


def health_state(error_rate: Column, avg_duration: Column) -> Column:
    over = lambda e, d: (error_rate > e) | (F.coalesce(avg_duration, F.lit(0.0)) > d)
    return F.when(over(10, 5000), "critical").when(over(5, 2000), "warning").when(over(1, 1000), "degraded").otherwise("healthy")


def top(df: DataFrame, keys: list[str], n: int, count: str = "count") -> DataFrame:
    """The n most frequent keys; ties by key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count)).orderBy(F.desc(count), *keys).limit(n)


def performance_category(ms: Column) -> Column:
    return F.when(ms < 100, "fast").when(ms < 500, "medium").when(ms < 2000, "slow").otherwise("very_slow")


def confidence_band(c: Column) -> Column:
    return F.when(c >= 0.8, "high").when(c >= 0.6, "medium").when(c >= 0.4, "low").otherwise("very_low")


def estimated_tokens(text: Column) -> Column:
    return F.floor(F.octet_length(text) / 4).cast("long")


def duration_trend(metrics: DataFrame, kind: str, start: str, end: str) -> DataFrame:
    return of_type(metrics, kind, start, end).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.round(F.avg("duration_ms"), 4).alias("avg_duration"), F.count(F.lit(1)).alias("count"))


def error_trend(metrics: DataFrame, start: str, end: str) -> DataFrame:
    return within(metrics, start, end).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("total_ops"), F.count_if(F.col("type") == "error").alias("errors"), window_error_rate().alias("error_rate")
    )


def cache_trend(metrics: DataFrame, start: str, end: str) -> DataFrame:
    return of_type(metrics, ["embedding", "generation"], start, end).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "type").agg(
        F.count(F.lit(1)).alias("total_ops"), F.count_if("cached").alias("cache_hits"), hit_rate().alias("hit_rate")
    )


def tenant_usage(metrics: DataFrame, start: str, end: str) -> DataFrame:
    return of_type(metrics, ["query", "embedding", "generation"], start, end).groupBy("tenant_id", "type").agg(
        F.count(F.lit(1)).alias("count"), F.round(F.avg("duration_ms"), 4).alias("avg_duration")
    )


def unpivoted(one_row: DataFrame) -> DataFrame:
    """(metric, value) of a row of figures."""
    pairs = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in one_row.columns]
    return one_row.select(F.explode(F.array(*pairs)).alias("p")).select("p.metric", "p.value")


def health_dashboard(metrics: DataFrame, as_of: str, hour_ago: str, day_ago: str) -> DataFrame:
    """(metric, value): the last hour's and day's figures, from one pass over the window."""
    hour = F.col("ts") >= at(hour_ago)
    kind = lambda k: hour & (F.col("type") == k)
    n = F.count(F.lit(1))
    row = within(metrics, day_ago, as_of).agg(
        *(F.count_if(kind(k)).alias(f"{k}_last_hour") for k in ("query", "embedding", "generation", "error")),
        *(F.count_if(F.col("type") == k).alias(f"{k}_last_day") for k in ("query", "embedding", "generation", "error")),
        percent(F.count_if(kind("query") & F.col("success")), F.count_if(kind("query")), 100.0).alias("query_success_rate"),
        F.round(F.avg(F.when(kind("query"), F.col("duration_ms"))), 4).alias("query_avg_duration"),
        F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY CASE WHEN type = 'query' AND duration_ms <> 0 AND ts >= TIMESTAMP_NTZ '{hour_ago}' THEN duration_ms END)").alias("query_p95_duration"),
        percent(F.count_if(kind("embedding") & F.col("cached")), F.count_if(kind("embedding"))).alias("embedding_hit_rate"),
        F.round(F.avg(F.when(kind("embedding"), F.col("batch_size"))), 4).alias("avg_batch_size"),
        F.round(F.avg(F.when(kind("generation"), F.col("confidence"))), 4).alias("avg_confidence"),
        percent(F.count_if(kind("error")), F.count_if(hour)).alias("error_rate"),
        F.count_if(kind("query") & (F.col("duration_ms") > 5000)).alias("slow_queries"),
        F.round(F.count_if(kind("query")) / 60, 2).alias("throughput_qpm"),
        n.alias("operations"),
    )
    return unpivoted(row)


def usage_report(metrics: DataFrame, start: str, end: str, days: int) -> DataFrame:
    """(metric, value): totals of the period, from one pass."""
    query = F.col("type") == "query"
    row = within(metrics, start, end).agg(
        F.count_if(query).alias("queries"),
        F.round(F.count_if(query) / max(1, days), 2).alias("daily_average"),
        F.count_distinct(F.when(F.col("type").isin("query", "generation"), F.col("user_id"))).alias("unique_users"),
        F.count_distinct(F.when(query, F.col("query_hash"))).alias("documents_queried"),
        F.count_distinct("tenant_id").alias("active_tenants"),
    )
    return unpivoted(row)


def envelope(metrics: DataFrame) -> DataFrame:
    """Metric events as they are stored: typed columns and the rest as JSON in `data`; query hashes are opaque keys."""
    data = F.to_json(F.struct("duration_ms", "cached", "confidence", "batch_size", "query_hash", "strategy", "operation"))
    return metrics.select("id", "type", F.col("ts").alias("timestamp"), data.alias("data"), "success", performance_category(F.col("duration_ms")).alias("performance_category"), "tenant_id", "user_id", F.hex(F.xxhash64(F.col("query_hash").cast("string"))).alias("query_key"))


BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)


def summary_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, sum, extremes, mean and the values at index int(n * p) of the sorted series.

    The index percentile is a rank, found by counting in a window over the group's distinct values, so that no group is
    gathered into one row.
    """
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*keys).orderBy(value)
    ranked = counted.withColumn("_to", F.sum("_n").over(upto)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    at_index = lambda p: F.min(F.when(F.col("_to") > F.least(F.floor(F.col("_all") * p), F.col("_all") - 1), F.col(value)))
    return ranked.groupBy(*keys).agg(
        F.sum("_n").alias("count"), F.round(F.sum(F.col(value) * F.col("_n")), 4).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.round(F.sum(F.col(value) * F.col("_n")) / F.sum("_n"), 6).alias("mean"), *(at_index(p / 100).alias(f"p{p}") for p in (50, 90, 95, 99)),
    )


def histogram(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Cumulative bucket counts: one row for each key and upper bound, the last one without limit."""
    sums = df.groupBy(*keys).agg(*(F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(BUCKETS)), F.count(value).alias("binf"))
    rows = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("count")) for i, b in enumerate(BUCKETS)] + [F.struct(F.lit("+Inf").alias("le"), F.col("binf").alias("count"))]
    return sums.select(*keys, F.explode(F.array(*rows)).alias("r")).select(*keys, "r.le", "r.count")


def recent_points(df: DataFrame, key: str, seconds: int, as_of: str, keep: int = 10_000) -> DataFrame:
    """Points of the last seconds, no more than the newest `keep` of each key."""
    newest = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("id"))
    held = df.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= keep).drop("_n")
    return held.where(F.col("ts") >= at(as_of) - F.make_dt_interval(secs=F.lit(seconds)))


LG_K = 14  # of a sketch's registers: a relative standard error of about 0.65 in 100


def hourly_sketches(metrics: DataFrame, column: str) -> DataFrame:
    """(hour, tenant_id, sketch): mergeable sketches of the distinct values of a column; small sets are counted exactly."""
    return metrics.where(F.col(column).isNotNull()).groupBy(F.date_trunc("hour", "ts").alias("hour"), "tenant_id").agg(F.hll_sketch_agg(column, LG_K).alias("sketch"))


def distinct_from(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, estimate): distinct values of any set of hours, from their sketches alone."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


def rate_limited(df: DataFrame, identity: str, limit: int) -> DataFrame:
    """Adds `allowed`: the first `limit` requests of an identity in each minute. Rejected ones use nothing up."""
    order = Window.partitionBy(identity, F.date_trunc("minute", "ts")).orderBy("ts", "id")
    return df.withColumn("allowed", F.row_number().over(order) <= limit)
