"""Corpus-wide line deduplication with DataFrame functions only.

Each document's lines are normalised and hashed; one row per document and distinct hash is counted by hash in two
steps, so that a line held by a third of all documents is summed before it meets in one place. Lines over the threshold
are joined back to the documents that lose them, which gives each document the positions to drop; what stays is put
together again in the order of positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

STRIP = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends and with A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(STRIP)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashed(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit("line"), key).alias("b"))


def _exploded(docs: DataFrame, min_chars: int) -> DataFrame:
    """(id, body, pos, h): every line whose key is long enough to count."""
    keyed = docs.select("id", F.xxhash64("text").alias("body"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    keyed = keyed.where(F.length("line") >= min_chars).withColumn("key", line_key(F.col("line")))
    return keyed.where(F.length("key") >= min_chars).select("id", "body", "pos", _hashed(F.col("key")).alias("h"))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5
) -> DataFrame:
    """(id, row columns of docs, lines, kept): docs with `n_lines`, `n_dropped` and `kept_text`, in columns of these names.

    A line counts if its key has min_chars code points or more. A key held by min_docs distinct ids or more goes from
    all documents but the one with the largest id, which keeps each of its occurrences. A null or empty text is one
    empty line. Rows repeated under one id are one document; rows with a null id lose common lines, never hold them and
    don't count. Equal keys are recognised by 128 bits of hash. An empty table gives an empty result; input columns
    named like the added ones are replaced. One document's lines are held by the task that reads its text.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    occurrences = _exploded(source, min_chars)
    common = (
        occurrences.select("id", "h").distinct().groupBy("h").agg(F.count("id").alias("n"), F.max("id").alias("last"))
        .where(F.col("n") >= min_docs)
        .select(F.struct(F.col("h.a").bitwiseXOR(F.lit(0)).alias("a"), F.col("h.b").alias("b")).alias("h"), "last")
    )  # h is written anew, so that the join deals both sides and a frequent line's rows can be split
    lost = (
        occurrences.join(common, "h")
        .where(F.col("id").isNull() | (F.col("id") != F.col("last")))
        .groupBy("id", "body")
        .agg(F.collect_set("pos").alias("__tessera_lost"))
        .select(F.col("id").alias("__tessera_id"), F.col("body").alias("__tessera_body"), "__tessera_lost")
    )
    text = F.col(text_col).cast("string")
    joined = docs.join(lost, F.col(id_col).eqNullSafe(F.col("__tessera_id")) & (F.xxhash64(text) == F.col("__tessera_body")), "left")
    lines = _lines(text)
    positions = F.sequence(F.lit(0), F.size("__tessera_all") - 1)
    stay = F.transform(F.array_except(positions, F.col("__tessera_lost")), lambda i: F.get("__tessera_all", i))
    return (
        joined.withColumn("__tessera_all", lines)
        .withColumn("n_lines", F.size("__tessera_all").cast("long"))
        .withColumn("n_dropped", F.coalesce(F.size("__tessera_lost"), F.lit(0)).cast("long"))
        .withColumn("kept_text", F.when(F.col("__tessera_lost").isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(stay, "\n")))
        .drop("__tessera_id", "__tessera_body", "__tessera_lost", "__tessera_all")
    )


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
common AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.last AS gone
  FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
