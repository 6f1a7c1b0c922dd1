"""Registered queries: structured sheets."""

from pyspark.sql import functions as F

from tessera.operators import sheets as S
from tessera.sources.tables import SHEET_LEADS

from .registry import register

def rules(table, default):
    return "CASE " + " ".join(f"WHEN regexp_matches(lower(query), '{p}') THEN '{n}'" for n, p in table) + f" ELSE '{default}' END"


def asked(t):
    return t.asked_texts(SHEET_LEADS)


def parts(t):
    return t.load("part").withColumn("price", F.replace(F.col("p_retailprice").cast("string"), F.lit("."), F.lit(",")))


def items(t):
    return t.load("lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("string").alias("price"))


register("S01_query_type", lambda t: asked(t).select("query_id", S.query_type(F.col("query")).alias("type")), f"SELECT query_id, {rules(S.TYPES, 'search')} AS type FROM sheet_questions")
register("S02_operation", lambda t: asked(t).select("query_id", S.operation(F.col("query")).alias("op")), f"SELECT query_id, {rules(S.OPERATIONS, 'count')} AS op FROM sheet_questions")
register("S03_column", lambda t: t.frame([("named", S.column_for(parts(t), "Soma de p_size")), ("first", S.column_for(parts(t), "tudo"))], "how string, name string"), "SELECT * FROM (VALUES ('named', 'p_size'), ('first', 'p_partkey')) v(how, name)")
register("S04_aggregation", lambda t: S.aggregated({"parts": parts(t), "items": items(t)}, "price"), "WITH v AS (SELECT p_retailprice AS v FROM part UNION ALL SELECT l_extendedprice FROM lineitem) SELECT unnest(['sum', 'avg', 'count', 'max', 'min']) AS operation, unnest([round(sum(v), 4), round(avg(v), 4), count(v)::DOUBLE, max(v), min(v)]) AS value FROM v")
register("S05_cell_search", lambda t: S.search(S.long_cells(t.load("part").select("p_partkey", "p_name", "p_type"), "parts", "p_partkey"), "WIDGET"), "WITH c AS (SELECT 'parts' AS sheet, p_partkey + 2 AS row, 'p_name' AS column, p_name AS cell FROM part UNION ALL SELECT 'parts', p_partkey + 2, 'p_type', p_type FROM part), h AS (SELECT * FROM c WHERE contains(lower(cell), 'widget')) SELECT *, (SELECT count(*) FROM h) AS matches FROM h ORDER BY sheet, row, \"column\" LIMIT 10".replace("AS column", 'AS "column"'))
register("S06_filter", lambda t: S.filtered(parts(t), "p_size", ">", 40).select("p_partkey"), "SELECT p_partkey FROM part WHERE p_size > 40")
register("S07_summary", lambda t: S.summary({"parts": (t.load("part").select("p_partkey", "p_name"), "p_partkey"), "items": (t.load("orders").select("o_orderkey", "o_orderpriority"), "o_orderkey")}), "SELECT 'parts' AS sheet, count(*) AS rows, 2 AS columns, arg_min(to_json({'p_partkey': p_partkey, 'p_name': p_name}), p_partkey)::VARCHAR AS sample FROM part UNION ALL SELECT 'items', count(*), 2, arg_min(to_json({'o_orderkey': o_orderkey, 'o_orderpriority': o_orderpriority}), o_orderkey)::VARCHAR FROM orders")
