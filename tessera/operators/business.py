"""Feedback, billing, subscriptions, quotas, AI costs and jobs. Every result that depends on time takes its clock as a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .usage import at, percent


def rows_():
    return F.count(F.lit(1))


def approved():
    return F.col("status") == "approved"


def active():
    return F.col("status") == "active"


def feedback_totals(feedbacks: DataFrame) -> DataFrame:
    positive = F.count_if(F.col("rating") == 1)
    return feedbacks.agg(rows_().alias("total"), positive.alias("positive"), F.count_if(F.col("rating") == -1).alias("negative"), percent(positive, rows_()).alias("satisfaction"))


def rated(feedbacks: DataFrame, key: str, least: int, n: int, best: bool = True) -> DataFrame:
    """The n best or worst keys by mean rating, of those with at least `least` ratings; ties by key."""
    groups = feedbacks.where(F.col(key).isNotNull()).groupBy(key).agg(F.avg("rating").alias("_avg"), rows_().alias("count")).where(F.col("count") >= least)
    return groups.orderBy(F.desc("_avg") if best else F.asc("_avg"), key).limit(n).select(key, F.round("_avg", 6).alias("avg_rating"), "count")


def feedback_trend(feedbacks: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    recent = feedbacks.where(F.col("created_at") >= at(as_of) - F.make_dt_interval(F.lit(days)))
    return recent.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(rows_().alias("total"), F.count_if(F.col("rating") == 1).alias("positive"), F.count_if(F.col("rating") == -1).alias("negative"))


def valid_feedback(feedbacks: DataFrame, documents: DataFrame) -> DataFrame:
    """Feedback that may be stored: a query, a rating of 1 or -1, and no document or a known one."""
    fine = feedbacks.where(F.col("rating").isin(1, -1) & (F.length(F.btrim("query")) > 0))
    known = fine.join(documents.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    return known.unionByName(fine.where(F.col("document_id").isNull()))


def in_month(ts: str, as_of: str, year: bool = True) -> Column:
    same = F.month(ts) == F.month(at(as_of))
    return same & (F.year(ts) == F.year(at(as_of))) if year else same


def monthly_chart(df: DataFrame, ts: str, value: Column, as_of: str, months: int) -> DataFrame:
    """(month, value): the aggregate for each of the last months, zero where there are no rows."""
    first = F.trunc(at(as_of).cast("date"), "month")
    calendar = df.sparkSession.range(1).select(F.explode(F.sequence(F.add_months(first, 1 - months), first, F.expr("INTERVAL 1 MONTH"))).alias("m"))
    sums = df.where(F.col(ts).cast("date") >= F.add_months(first, 1 - months)).groupBy(F.trunc(F.col(ts).cast("date"), "month").alias("m")).agg(value.cast("double").alias("v"))
    return calendar.join(F.broadcast(sums.where(F.col("m") <= first)), "m", "left").select(F.date_format("m", "yyyy-MM").alias("month"), F.coalesce("v", F.lit(0.0)).alias("value"))


def is_active(as_of: str) -> Column:
    return active() & (F.col("ends_at") > at(as_of))


def days_left(as_of: str) -> Column:
    return F.greatest(F.lit(0), F.datediff(F.col("ends_at").cast("date"), at(as_of).cast("date")))


def renewed() -> Column:
    return F.when(F.col("billing_cycle") == "monthly", F.col("ends_at") + F.expr("INTERVAL '1' MONTH")).otherwise(F.col("ends_at") + F.expr("INTERVAL '1' YEAR"))


def recurring_revenue() -> Column:
    amount = F.col("amount").cast("double")
    return F.round(F.sum(F.when(active(), F.when(F.col("billing_cycle") == "monthly", amount).otherwise(amount / 12))), 2)


def churn(subscriptions: DataFrame, as_of: str) -> DataFrame:
    cancelled = F.count_if((F.col("status") == "cancelled") & in_month("cancelled_at", as_of))
    return subscriptions.agg(percent(cancelled, F.count_if(active()), digits=6).alias("churn"))


def conversion(users: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Users with an active subscription, in percent of all."""
    paying = users.join(subscriptions.where(active()).select(F.col("user_id").alias("id")), "id", "left_semi")
    return users.agg(rows_().alias("users")).crossJoin(paying.agg(rows_().alias("paying"))).select("users", "paying", percent(F.col("paying"), F.col("users"), digits=6).alias("conversion"))


def costed(usage: DataFrame, providers: DataFrame, multiplier: float = 1.0, markup: Column | None = None) -> DataFrame:
    """Adds base_cost, adjusted_cost, markup, final_price and roi; the provider's markup serves where none is given."""
    joined = usage.join(F.broadcast(providers), "provider")
    base = F.col("input_tokens") / 1000 * F.col("input_cost") + F.col("output_tokens") / 1000 * F.col("output_cost")
    rate = F.col("base_markup") if markup is None else F.coalesce(markup, F.col("base_markup"))
    out = joined.withColumn("base_cost", base).withColumn("adjusted_cost", F.col("base_cost") * multiplier).withColumn("markup", rate)
    out = out.withColumn("final_price", F.col("adjusted_cost") * (1 + F.col("markup") / 100))
    return out.withColumn("roi", F.when(F.col("adjusted_cost") <= 0, 0.0).otherwise((F.col("final_price") - F.col("adjusted_cost")) / F.nullif(F.col("adjusted_cost"), F.lit(0.0)) * 100))


def clamped_price() -> Column:
    """Price of a base cost at the markup held between a provider's least and greatest."""
    return F.col("base_cost") * (1 + F.least(F.greatest(F.col("markup"), F.col("min_markup")), F.col("max_markup")) / 100)


def quota_state(used: Column, limit: Column, needed: Column) -> Column:
    """Struct of `allowed`, `remaining` (-1: unlimited) and `used_percent`."""
    free = limit == -1
    return F.struct(
        (free | (used + needed <= limit)).alias("allowed"),
        F.when(free, F.lit(-1).cast("long")).otherwise(F.greatest(F.lit(0).cast("long"), limit - used)).alias("remaining"),
        F.when(free, 0.0).otherwise(F.coalesce(F.round(F.try_divide(used * 100.0, limit), 2), F.lit(100.0))).alias("used_percent"),
    )


def current_subscription(payments: DataFrame) -> DataFrame:
    """What approvals in order leave each user with: the last approved payment's, with the number of replaced ones."""
    return payments.where(approved()).groupBy("user_id").agg(F.max_by("id", F.struct("created_at", "id")).alias("payment_id"), (rows_() - 1).alias("replaced"))


#: Percentage done after each step of a job.
STEPS = {"downloading": 20, "uploading_audio": 40, "transcribing": 70, "saving_transcription": 90, "integrating_rag": 100}


def job_progress(log: Column) -> Column:
    """Percentage of a job by the last step of its log; 0 without one."""
    last = F.get(log, F.size(log) - 1)
    out = F.lit(0)
    for step, done in STEPS.items():
        out = F.when(last == step, done).otherwise(out)
    return out


#: Seconds by size in MB (upper bounds), plain, OCR and table extraction.
TIMEOUTS = ((1, 15, 30, 20), (5, 30, 60, 40), (10, 60, 120, 80), (25, 120, 240, 150), (50, 180, 360, 240), (100, 300, 600, 360), (200, 450, 900, 540), (300, 600, 1200, 720), (400, 750, 1500, 900), (None, 900, 1800, 1080))
#: Estimated time by size in MB.
ESTIMATES = ((50, "2-5 minutos"), (100, "5-10 minutos"), (200, "10-20 minutos"), (300, "20-30 minutos"), (400, "30-45 minutos"), (None, "45-60 minutos"))


def by_size(mb: Column, table: tuple, column: int) -> Column:
    out = F.lit(table[-1][column])
    for row in reversed(table[:-1]):
        out = F.when(mb < row[0], F.lit(row[column])).otherwise(out)
    return out


def typed_config(value: Column, kind: Column, want: str, default) -> Column:
    """A configuration value read as its type tag says; the default where it is missing or doesn't parse."""
    cast = {"boolean": F.lower(value).isin("1", "true", "yes", "on"), "integer": F.expr("try_cast(value AS BIGINT)"), "float": F.expr("try_cast(value AS DOUBLE)"), "string": value}[want]
    return F.coalesce(F.when(kind == want, cast), F.lit(default))


def masked(key: Column) -> Column:
    return F.concat(F.substring(key, 1, 7), F.lit("..."), F.substring(key, -4, 4))


def with_chunk_counts(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    counts = chunks.groupBy(F.col("document_id").alias("id")).agg(rows_().alias("chunks"))
    return docs.join(counts, "id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0).cast("long")))


def stale(updated: Column, status: Column, as_of: str, hours: int = 1) -> Column:
    return status.isin("pending", "processing") & (updated < at(as_of) - F.make_dt_interval(F.lit(0), F.lit(hours)))


def latest_rank(keys: list[str], *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
