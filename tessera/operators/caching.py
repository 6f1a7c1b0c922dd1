"""Cache analytics: key types, keys, lifetimes, admission and size classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .usage import hit_rate

TYPE_OF = (("embedding", "embedding"), ("search", "search"), ("query", "search"), ("generation", "generation"), ("answer", "generation"), ("rerank", "rerank"), ("document", "document"))
LIFETIMES = (("embedding", 86_400), ("search", 1800), ("answer", 7200), ("document", 43_200))


def first_match(text: Column, table: tuple, default) -> Column:
    """The value of the first entry whose key the text contains."""
    out = F.lit(default)
    for part, value in reversed(table):
        out = F.when(F.contains(text, F.lit(part)), F.lit(value)).otherwise(out)
    return out


def key_type(key: Column) -> Column:
    return first_match(key, TYPE_OF, "other")


def lifetime(key: Column) -> Column:
    return first_match(key, LIFETIMES, 3600)


def admitted(size: Column, least: int = 100, most: int = 1 << 20) -> Column:
    return size.between(least, most)


def size_class(size: Column) -> Column:
    return F.when(size < 1024, "<1KB").when(size < 10_240, "1-10KB").when(size < 51_200, "10-50KB").when(size < 102_400, "50-100KB").otherwise(">100KB")


def ttl_class(ttl: Column) -> Column:
    return F.when(ttl < 0, "No TTL").when(ttl < 3600, "<1h").when(ttl < 86_400, "1-24h").when(ttl < 604_800, "1-7d").otherwise(">7d")


def by_type(ops: DataFrame) -> DataFrame:
    return ops.groupBy(key_type(F.col("key")).alias("type")).agg(F.count(F.lit(1)).alias("ops"), hit_rate("hit").alias("hit_rate"), F.round(F.avg("latency_ms"), 4).alias("avg_latency"))


def cache_key(query: Column, doc: Column, mode: Column, fmt: Column, strictness: Column, top_k: Column) -> Column:
    """md5 of the query, lower-cased and with white space squeezed, and of all parameters that change an answer."""
    plain = F.btrim(F.regexp_replace(F.lower(query), r"\s+", " "))
    parts = [plain, F.concat(F.lit("doc:"), F.coalesce(doc.cast("string"), F.lit("None"))), F.concat(F.lit("mode:"), mode), F.concat(F.lit("format:"), fmt), F.concat(F.lit("strictness:"), strictness.cast("string")), F.concat(F.lit("topk:"), top_k.cast("string"))]
    return F.md5(F.concat_ws("|", *parts))


def strategy_ttl(strategy: Column) -> Column:
    return F.when(strategy == "no_cache", 0).when(strategy == "short_term", 300).when(strategy == "long_term", 3600).when(strategy == "persistent", 86_400).otherwise(3600)
