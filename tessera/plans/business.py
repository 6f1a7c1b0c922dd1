"""Registered queries: feedback, billing, quotas, costs and jobs."""

from pyspark.sql import functions as F

from tessera.operators import business as B
from tessera.operators.asof import asof_join
from tessera.operators.folds import charged
from tessera.operators.usage import at, percent

from .registry import register


def rows_():
    return F.count(F.lit(1))


EVENTS, ORDERS = "2024-01-31 00:00:00", "2001-08-01 00:00:00"

register("H30_feedback_totals", lambda t: B.feedback_totals(t.feedbacks), "SELECT count(*) AS total, count(*) FILTER (WHERE rating = 1) AS positive, count(*) FILTER (WHERE rating = -1) AS negative, round(count(*) FILTER (WHERE rating = 1) * 100.0::DOUBLE / count(*), 2) AS satisfaction FROM rag_feedbacks")
for name, best, order in (("H31_top_queries", True, "DESC"), ("H31b_worst_queries", False, "ASC")):
    register(name, lambda t, best=best: B.rated(t.feedbacks, "query", 2, 5, best), f"SELECT query, round(a, 6) AS avg_rating, count FROM (SELECT query, avg(rating) AS a, count(*) AS count FROM rag_feedbacks GROUP BY 1 HAVING count(*) >= 2 ORDER BY a {order}, query LIMIT 5)")
register("H31c_top_documents", lambda t: B.rated(t.feedbacks, "document_id", 3, 5).join(t.docs.select(F.col("id").alias("document_id"), "title"), "document_id", "left"), "SELECT f.document_id, round(a, 6) AS avg_rating, count, title FROM (SELECT document_id, avg(rating) AS a, count(*) AS count FROM rag_feedbacks WHERE document_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 3 ORDER BY a DESC, 1 LIMIT 5) f LEFT JOIN docs d ON d.id = f.document_id")
register("H32_feedback_trend", lambda t: B.feedback_trend(t.feedbacks, EVENTS), f"SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS total, count(*) FILTER (WHERE rating = 1) AS positive, count(*) FILTER (WHERE rating = -1) AS negative FROM rag_feedbacks WHERE created_at >= TIMESTAMP '{EVENTS}' - INTERVAL 7 DAYS GROUP BY 1")
register("H32b_recent_feedback", lambda t: t.feedbacks.orderBy(F.desc("created_at"), F.desc("id")).limit(50).select("id", "query", "rating"), "SELECT id, query, rating FROM rag_feedbacks ORDER BY created_at DESC, id DESC LIMIT 50")
register("H33_store_feedback", lambda t: B.valid_feedback(t.feedbacks, t.docs.where("id % 3 = 0")).select("id", "document_id", "rating"), "SELECT id, document_id, rating FROM rag_feedbacks f WHERE rating IN (1, -1) AND length(trim(query)) > 0 AND (document_id IS NULL OR EXISTS (SELECT 1 FROM docs d WHERE d.id = f.document_id AND d.id % 3 = 0))")
register(
    "H34_admin_totals",
    lambda t: t.users.agg(rows_().alias("users"), F.count_if("is_admin").alias("admins"))
    .crossJoin(t.docs.agg(rows_().alias("documents"), F.count_if(B.in_month("created_at", "2024-01-31 00:00:00", year=False)).alias("documents_this_month")))
    .crossJoin(t.chunks.agg(rows_().alias("chunks")))
    .crossJoin(t.subscriptions.agg(rows_().alias("subscriptions"), F.count_if(B.active()).alias("active_subscriptions"), F.count_if(F.col("status") == "cancelled").alias("cancelled_subscriptions")))
    .crossJoin(t.payments.agg(rows_().alias("payments"), F.count_if(B.approved()).alias("approved_payments"), F.count_if(F.col("status") == "pending").alias("pending_payments"), F.round(F.sum(F.when(B.approved(), F.col("amount"))).cast("double"), 2).alias("revenue"))),
    "SELECT * FROM (SELECT count(*) AS users, count(*) FILTER (WHERE is_admin) AS admins FROM users), (SELECT count(*) AS documents, count(*) FILTER (WHERE month(created_at) = 1) AS documents_this_month FROM docs), (SELECT count(*) AS chunks FROM chunks), (SELECT count(*) AS subscriptions, count(*) FILTER (WHERE status = 'active') AS active_subscriptions, count(*) FILTER (WHERE status = 'cancelled') AS cancelled_subscriptions FROM subscriptions), (SELECT count(*) AS payments, count(*) FILTER (WHERE status = 'approved') AS approved_payments, count(*) FILTER (WHERE status = 'pending') AS pending_payments, round(sum(amount) FILTER (WHERE status = 'approved')::DOUBLE, 2) AS revenue FROM payments)",
)
CAL = "(SELECT unnest(generate_series(TIMESTAMP '{0}', TIMESTAMP '2001-08-01', INTERVAL 1 MONTH)) AS m)"
register("H35_revenue_chart", lambda t: B.monthly_chart(t.payments.where(B.approved()), "created_at", F.sum("amount"), ORDERS, 6), f"SELECT strftime(c.m, '%Y-%m') AS month, coalesce(v, 0)::DOUBLE AS value FROM {CAL.format('2001-03-01')} c LEFT JOIN (SELECT date_trunc('month', created_at) AS m, sum(amount) AS v FROM payments WHERE status = 'approved' GROUP BY 1) s ON s.m = c.m")
register("H35b_users_chart", lambda t: B.monthly_chart(t.subscriptions, "starts_at", F.count_distinct("user_id"), ORDERS, 6), f"SELECT strftime(c.m, '%Y-%m') AS month, coalesce(v, 0)::DOUBLE AS value FROM {CAL.format('2001-03-01')} c LEFT JOIN (SELECT date_trunc('month', starts_at) AS m, count(DISTINCT user_id) AS v FROM subscriptions GROUP BY 1) s ON s.m = c.m")
register("H36_payment_stats", lambda t: B.monthly_chart(t.payments.where(B.approved()), "created_at", F.sum("amount"), ORDERS, 12).crossJoin(t.payments.agg(percent(F.count_if(B.approved()), rows_()).alias("conversion"))), f"SELECT strftime(c.m, '%Y-%m') AS month, coalesce(v, 0)::DOUBLE AS value, k.conversion FROM {CAL.format('2000-09-01')} c LEFT JOIN (SELECT date_trunc('month', created_at) AS m, sum(amount) AS v FROM payments WHERE status = 'approved' GROUP BY 1) s ON s.m = c.m, (SELECT round(count(*) FILTER (WHERE status = 'approved') * 100.0::DOUBLE / count(*), 2) AS conversion FROM payments) k")
register("H36b_status_chart", lambda t: t.payments.groupBy("status").agg(rows_().alias("count")), "SELECT status, count(*) AS count FROM payments GROUP BY 1")
for name, n, active in (("H37_popular_plans", 5, False), ("H37b_active_plans", 3, True)):
    register(
        name,
        lambda t, n=n, active=active: t.subscriptions.where(B.active() if active else F.lit(True)).join(t.users.select(F.col("id").alias("user_id"), "plan_name"), "user_id").groupBy("plan_name").agg(rows_().alias("count")).orderBy(F.desc("count"), "plan_name").limit(n),
        f"SELECT plan_name, count(*) AS count FROM subscriptions s JOIN users u ON u.id = s.user_id {'WHERE status = ' + chr(39) + 'active' + chr(39) if active else ''} GROUP BY 1 ORDER BY count DESC, 1 LIMIT {n}",
    )
register("H38_payment_methods", lambda t: t.payments.where(B.approved()).groupBy("payment_method").agg(rows_().alias("count"), F.round(F.sum("amount").cast("double"), 2).alias("total")), "SELECT payment_method, count(*) AS count, round(sum(amount)::DOUBLE, 2) AS total FROM payments WHERE status = 'approved' GROUP BY 1")
register("H38b_subscription_status", lambda t: t.subscriptions.groupBy("status").agg(rows_().alias("count")), "SELECT status, count(*) AS count FROM subscriptions GROUP BY 1")
register("H39_recurring_revenue", lambda t: t.subscriptions.agg(B.recurring_revenue().alias("mrr")), "SELECT round(sum(CASE WHEN billing_cycle = 'monthly' THEN amount::DOUBLE ELSE amount::DOUBLE / 12 END) FILTER (WHERE status = 'active'), 2) AS mrr FROM subscriptions")
register("H40_churn", lambda t: B.churn(t.subscriptions, "2001-07-15 00:00:00"), "SELECT round(count(*) FILTER (WHERE status = 'cancelled' AND date_trunc('month', cancelled_at) = TIMESTAMP '2001-07-01') * 100.0::DOUBLE / count(*) FILTER (WHERE status = 'active'), 6) AS churn FROM subscriptions")
register("H40b_conversion", lambda t: B.conversion(t.users, t.subscriptions), "SELECT users, paying, round(paying * 100.0::DOUBLE / users, 6) AS conversion FROM (SELECT count(*) AS users, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM subscriptions s WHERE s.user_id = u.id AND status = 'active')) AS paying FROM users u)")
register(
    "H41_finance",
    lambda t: t.payments.where(B.approved()).agg(F.round(F.sum("amount").cast("double"), 2).alias("total"), F.round(F.sum(F.when(B.in_month("created_at", "2001-07-15 00:00:00"), F.col("amount"))).cast("double"), 2).alias("month"), F.round(F.avg(F.col("amount").cast("double")), 4).alias("ticket")).crossJoin(t.subscriptions.agg(rows_().alias("subscriptions"), F.count_if(B.active()).alias("active"))),
    "SELECT * FROM (SELECT round(sum(amount)::DOUBLE, 2) AS total, round(sum(amount) FILTER (WHERE date_trunc('month', created_at) = TIMESTAMP '2001-07-01')::DOUBLE, 2) AS month, round(avg(amount::DOUBLE), 4) AS ticket FROM payments WHERE status = 'approved'), (SELECT count(*) AS subscriptions, count(*) FILTER (WHERE status = 'active') AS active FROM subscriptions)",
)
COST = "SELECT u.*, p.*, u.input_tokens / 1000 * input_cost + u.output_tokens / 1000 * output_cost AS base_cost FROM ai_usage u JOIN providers p USING (provider)"
register("H42_ai_cost", lambda t: B.costed(t.usage, t.providers, 1.5).groupBy("provider").agg(rows_().alias("n"), F.round(F.sum("base_cost"), 4).alias("base"), F.round(F.sum("final_price"), 4).alias("price")), f"SELECT provider, count(*) AS n, round(sum(base_cost), 4) AS base, round(sum(base_cost * 1.5 * (1 + base_markup / 100)), 4) AS price FROM ({COST}) GROUP BY 1")
register(
    "H42b_ai_cost_by_plan",
    lambda t: B.costed(
        t.usage.join(t.subscriptions.where(B.active()).select(F.col("id").alias("order_id"), "user_id"), "order_id", "left").join(t.users.select(F.col("id").alias("user_id"), "plan_name"), "user_id", "left").join(F.broadcast(t.plans), "plan_name", "left"), t.providers, 1.5, F.col("margin"),
    ).groupBy("provider", "plan_name").agg(F.round(F.sum("final_price"), 4).alias("price"), F.round(F.sum(B.clamped_price()), 4).alias("clamped")),
    f"SELECT provider, plan_name, round(sum(base_cost * 1.5 * (1 + coalesce(margin, base_markup) / 100)), 4) AS price, round(sum(base_cost * (1 + least(greatest(coalesce(margin, base_markup), min_markup), max_markup) / 100)), 4) AS clamped FROM ({COST}) c LEFT JOIN (SELECT * FROM subscriptions WHERE status = 'active') s ON s.id = c.order_id LEFT JOIN users u ON u.id = s.user_id LEFT JOIN plans l USING (plan_name) GROUP BY 1, 2",
)
register("H43_roi", lambda t: B.costed(t.usage, t.providers).groupBy("provider").agg(F.round(F.max("roi"), 6).alias("roi"), F.round(F.sum("base_cost") / F.sum("input_tokens"), 9).alias("cost_per_input_token")), f"SELECT provider, round(max(CASE WHEN base_cost <= 0 THEN 0.0::DOUBLE ELSE base_cost * base_markup / 100 / nullif(base_cost, 0) * 100 END), 6) AS roi, round(sum(base_cost) / sum(input_tokens), 9) AS cost_per_input_token FROM ({COST}) GROUP BY 1")
USED = "SELECT u.id, l.tokens_limit, coalesce(used, 0)::BIGINT AS used FROM users u JOIN plans l USING (plan_name) LEFT JOIN (SELECT o_custkey AS id, sum(input_tokens)::BIGINT AS used FROM ai_usage a JOIN orders ON o_orderkey = order_id WHERE ts >= TIMESTAMP '2001-07-01' AND ts < TIMESTAMP '2001-08-01' GROUP BY 1) x USING (id)"


def used_this_month(t):
    month = t.usage.where((F.col("ts") >= at("2001-07-01 00:00:00")) & (F.col("ts") < at(ORDERS)))
    used = month.join(t.payments.select(F.col("id").alias("order_id"), "user_id"), "order_id").groupBy(F.col("user_id").alias("id")).agg(F.sum("input_tokens").alias("used"))
    return t.users.select("id", "plan_name").join(F.broadcast(t.plans), "plan_name").join(used, "id", "left").select("id", "tokens_limit", F.coalesce("used", F.lit(0).cast("long")).alias("used"))


register("H44_quota_check", lambda t: used_this_month(t).select("id", B.quota_state(F.col("used"), F.col("tokens_limit"), F.lit(500)).alias("q")).select("id", "q.*"), f"SELECT id, tokens_limit = -1 OR used + 500 <= tokens_limit AS allowed, CASE WHEN tokens_limit = -1 THEN -1 ELSE greatest(0, tokens_limit - used) END::BIGINT AS remaining, CASE WHEN tokens_limit = -1 THEN 0.0 ELSE round(used * 100.0::DOUBLE / tokens_limit, 2) END::DOUBLE AS used_percent FROM ({USED})")


def charges(t):
    """(charge, user_id, month, ts, input_tokens): each use of tokens, by the user whose order it belongs to."""
    used = t.usage.join(t.payments.select(F.col("id").alias("order_id"), "user_id"), "order_id")
    return used.select((F.col("order_id") * 10 + F.col("line")).alias("charge"), "user_id", F.date_format("ts", "yyyy-MM").alias("month"), "ts", "input_tokens")


register(
    "H44b_quota_charges",
    lambda t: charged(charges(t), 4000, ["user_id", "month"], ["ts", "charge", "input_tokens"], "input_tokens", "charge"),
    """WITH RECURSIVE e AS (
      SELECT order_id * 10 + line AS charge, (o_custkey, strftime(ts, '%Y-%m')) AS who, input_tokens AS cost,
        row_number() OVER (PARTITION BY o_custkey, strftime(ts, '%Y-%m') ORDER BY ts, order_id * 10 + line) AS n
      FROM ai_usage JOIN orders ON o_orderkey = order_id),
    f AS (
      SELECT who, n, charge, CASE WHEN cost <= 4000 THEN cost ELSE 0 END AS used, cost <= 4000 AS accepted FROM e WHERE n = 1
      UNION ALL
      SELECT e.who, e.n, e.charge, CASE WHEN used + cost <= 4000 THEN used + cost ELSE used END, used + cost <= 4000 FROM f JOIN e ON e.who = f.who AND e.n = f.n + 1)
    SELECT charge, accepted FROM f""",
)


def subscribed(t):
    """(charge, subscription): the subscription that was the user's latest when tokens were used."""
    subscriptions = t.subscriptions.select("user_id", "starts_at", F.col("id").alias("subscription"))
    found = asof_join(charges(t).select("charge", "user_id", "ts"), subscriptions, ["user_id"], "ts", "starts_at", ["subscription"])
    return found.select("charge", F.col("match.subscription").alias("subscription"))


register(
    "H45b_subscription_as_of", subscribed,
    """SELECT charge, subscription FROM (SELECT order_id * 10 + line AS charge, o_custkey AS user_id, ts FROM ai_usage JOIN orders ON o_orderkey = order_id) u
      ASOF LEFT JOIN (SELECT user_id, starts_at, max(id) AS subscription FROM subscriptions GROUP BY 1, 2) s ON u.user_id = s.user_id AND u.ts >= s.starts_at""",
)
register("H45_subscription_state", lambda t: t.subscriptions.select("id", B.is_active("2000-06-01 00:00:00").alias("active"), B.days_left("2000-06-01 00:00:00").alias("days_left"), F.date_format(B.renewed(), "yyyy-MM-dd").alias("renewed_until")), "SELECT id, status = 'active' AND ends_at > TIMESTAMP '2000-06-01' AS active, greatest(0, date_diff('day', DATE '2000-06-01', ends_at::DATE))::INT AS days_left, strftime(CASE billing_cycle WHEN 'monthly' THEN ends_at + INTERVAL 1 MONTH ELSE ends_at + INTERVAL 1 YEAR END, '%Y-%m-%d') AS renewed_until FROM subscriptions")
register("H46_payment_approval", lambda t: B.current_subscription(t.payments), "SELECT user_id, arg_max(id, (created_at, id)) AS payment_id, count(*) - 1 AS replaced FROM payments WHERE status = 'approved' GROUP BY 1")
JOB = "SELECT event_id, user_id, ts, (props ->> '$.k')::INT AS k FROM events"
register(
    "H47_job_progress",
    lambda t: t.load("events").select("event_id", "ts", F.get_json_object("props", "$.k").cast("int").alias("k")).select(
        "event_id", B.job_progress(F.slice(F.array(*map(F.lit, B.STEPS)), 1, F.col("k") % 6)).alias("progress"), B.stale(F.col("ts"), F.when(F.col("k") % 2 == 0, "processing").otherwise("completed"), "2024-01-10 00:00:00").alias("stale")),
    f"SELECT event_id, ([0, 20, 40, 70, 90, 100])[k % 6 + 1] AS progress, k % 2 = 0 AND ts < TIMESTAMP '2024-01-10' - INTERVAL 1 HOUR AS stale FROM ({JOB})",
)
register("H47b_job_quota", lambda t: t.load("events").where("event_type = 'purchase'").groupBy("user_id").agg(F.greatest(F.lit(0).cast("long"), 10 - F.count_if(F.to_date("ts") == F.lit("2024-01-15").cast("date"))).alias("today_left"), F.greatest(F.lit(0).cast("long"), 20 - rows_()).alias("month_left")), "SELECT user_id, greatest(0, 10 - count(*) FILTER (WHERE ts::DATE = DATE '2024-01-15')) AS today_left, greatest(0, 20 - count(*)) AS month_left FROM events WHERE event_type = 'purchase' GROUP BY 1")
MB = "(o_totalprice / 1000)"


def case(column):
    return "CASE " + " ".join(f"WHEN {MB} < {r[0]} THEN {r[column]}" for r in B.TIMEOUTS[:-1]) + f" ELSE {B.TIMEOUTS[-1][column]} END"


register(
    "H54_adaptive_timeout",
    lambda t: t.load("orders").withColumn("mb", F.col("o_totalprice") / 1000).select("o_orderkey", *(B.by_size(F.col("mb"), B.TIMEOUTS, i).alias(n) for i, n in ((1, "plain"), (2, "ocr"), (3, "tables"))), (F.col("mb") > 100).alias("very_large"), B.by_size(F.col("mb"), B.ESTIMATES, 1).alias("estimate")),
    f"SELECT o_orderkey, {case(1)} AS plain, {case(2)} AS ocr, {case(3)} AS tables, {MB} > 100 AS very_large, CASE " + " ".join(f"WHEN {MB} < {r[0]} THEN '{r[1]}'" for r in B.ESTIMATES[:-1]) + f" ELSE '{B.ESTIMATES[-1][1]}' END AS estimate FROM orders",
)
register("H55_document_listing", lambda t: B.with_chunk_counts(t.docs, t.chunks).select("id", "title", "tenant_slug", "chunks"), "SELECT d.id, title, tenant_slug, coalesce(n, 0) AS chunks FROM docs d LEFT JOIN (SELECT document_id, count(*) AS n FROM chunks GROUP BY 1) c ON c.document_id = d.id")
register("H56_preview", lambda t: t.chunks.where("document_id = 7").orderBy("ord").limit(5).select("ord", F.substring("content", 1, 600).alias("preview")), "SELECT ord, substring(content, 1, 600) AS preview FROM chunks WHERE document_id = 7 ORDER BY ord LIMIT 5")


def settings(t):
    """A setting of each part: its key, its value as text and the type it was stored with."""
    n = F.col("p_partkey")
    values = [F.col("p_retailprice").cast("string"), F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, "Yes").otherwise("off"), F.col("p_name"), F.concat(F.lit("x"), F.col("p_size").cast("string"))]
    kinds = [F.lit(k) for k in ("float", "integer", "boolean", "string", "integer")]
    return t.load("part").select(n.alias("key"), F.get(F.array(*values), n % 5).alias("value"), F.get(F.array(*kinds), n % 5).alias("kind"))


SETTINGS = """SELECT p_partkey AS key, ([p_retailprice::VARCHAR, p_size::VARCHAR, CASE WHEN p_size % 2 = 0 THEN 'Yes' ELSE 'off' END, p_name, 'x' || p_size])[p_partkey % 5 + 1] AS value,
  (['float', 'integer', 'boolean', 'string', 'integer'])[p_partkey % 5 + 1] AS kind FROM part"""
register(
    "H57_typed_config",
    lambda t: settings(t).select("key", *(B.typed_config(F.col("value"), F.col("kind"), k, d).alias(f"as_{k}") for k, d in (("float", 1.0), ("integer", -1), ("boolean", False), ("string", "")))),
    f"""SELECT key, coalesce(CASE kind WHEN 'float' THEN try_cast(value AS DOUBLE) END, 1.0)::DOUBLE AS as_float, coalesce(CASE kind WHEN 'integer' THEN try_cast(value AS BIGINT) END, -1) AS as_integer,
      coalesce(CASE kind WHEN 'boolean' THEN lower(value) IN ('1', 'true', 'yes', 'on') END, false) AS as_boolean, coalesce(CASE kind WHEN 'string' THEN value END, '') AS as_string FROM ({SETTINGS})""",
)
register("H58_usage_cost", lambda t: t.metrics.agg((F.count_if(F.col("type") == "embedding") * 0.00025 + F.count_if(F.col("type") == "generation") * 0.002).alias("cost")).select(F.round("cost", 6).alias("cost")), "SELECT round(count(*) FILTER (WHERE type = 'embedding') * 0.00025::DOUBLE + count(*) FILTER (WHERE type = 'generation') * 0.002::DOUBLE, 6) AS cost FROM rag_metrics")
register("H59_masked_identity", lambda t: t.users.select("id", B.masked(F.concat(F.lit("rag_"), F.md5("email"))).alias("masked"), F.substring(F.sha2("email", 256), 1, 16).alias("identity")), "SELECT id, substring('rag_' || md5(email), 1, 7) || '...' || right(md5(email), 4) AS masked, substring(sha256(email), 1, 16) AS identity FROM users")
register(
    "H61_jobs",
    lambda t: t.load("events").select(F.col("event_type").alias("kind"), F.element_at(F.array(*map(F.lit, ("pending", "processing", "completed", "failed"))), (F.get_json_object("props", "$.k").cast("int") % 4 + 1)).alias("status"), "ts").where(~(F.col("status").isin("completed", "failed") & (F.col("ts") < at("2024-01-30 00:00:00") - F.expr("INTERVAL '24' HOUR")))).groupBy("kind", "status").agg(rows_().alias("jobs")),
    "SELECT kind, status, count(*) AS jobs FROM (SELECT event_type AS kind, (['pending', 'processing', 'completed', 'failed'])[(props ->> '$.k')::INT % 4 + 1] AS status, ts FROM events) WHERE NOT (status IN ('completed', 'failed') AND ts < TIMESTAMP '2024-01-30' - INTERVAL 24 HOURS) GROUP BY 1, 2",
)
