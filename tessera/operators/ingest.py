"""Ingest: validation, page estimates, scores, status, exports, merges and cascading deletes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T


def rows_():
    return F.count(F.lit(1))
#: Names that Windows reserves.
RESERVED = (
    "CON", "PRN", "AUX", "NUL", "COM1", "COM2", "COM3", "COM4", "COM5", "COM6", "COM7", "COM8", "COM9", "LPT1", "LPT2", "LPT3", "LPT4", "LPT5", "LPT6", "LPT7", "LPT8", "LPT9",
)
#: MIME types that uploads may have.
ALLOWED = ("application/pdf", "text/plain", "text/csv", "text/html", "application/rtf", "application/xml", "image/png", "image/jpeg")


def page_estimate(kind: Column, size: Column, rows: Column) -> Column:
    """Pages of a file: 50 rows or 10 KB of a sheet, 200 KB of slides, 4 KB of anything else; one at least."""
    up = lambda x: F.ceil(x).cast("long")
    sheet = F.when(rows > 0, up(rows / 50)).otherwise(up(size / 10_240))
    return F.greatest(F.lit(1).cast("long"), F.when(kind == "xlsx", sheet).when(kind == "pptx", up(size / 204_800)).otherwise(up(size / 4096)))


def extraction_score(text: Column) -> Column:
    """0 to 1 by length in bytes, sentence ends and odd characters."""
    c = T.strip(text)
    n = F.octet_length(c)
    score = 0.5 + F.least(F.lit(0.3), n / 10_000) + F.when(T.times(c, "[.!?]+") > n / 100, 0.1).otherwise(0.0) - F.when(T.times(c, r"[^\w\s.,!?;:-]") > n / 20, 0.2).otherwise(0.0)
    return F.when(n < 10, 0.0).when(n < 100, 0.3).otherwise(F.round(T.clamp(score), 6))


def cleaned_pdf(text: Column) -> Column:
    """Form feeds as line ends, blank lines as one, list numbers as `1. `, each item after a blank line, spaces squeezed."""
    out = F.regexp_replace(F.regexp_replace(text, "\f", "\n"), r"\s*\n\s*\n\s*", "\n\n")
    out = F.regexp_replace(F.regexp_replace(out, r"(\d+)\s*[.)\-]\s*([^\n])", "$1. $2"), r"(?<=\n)(\d+\.\s)", "\n$1")
    return T.strip(F.regexp_replace(out, "[ \t]+", " "))


def table_text(rows: Column, page: Column, number: Column) -> Column:
    """A table's rows, arrays of cells, under its title; null for fewer than two rows."""
    title = F.concat(F.lit("=== TABELA (Página "), page.cast("string"), F.lit(", Tabela "), number.cast("string"), F.lit(") ==="))
    body = F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, lambda c: F.btrim(F.coalesce(c, F.lit("")))), " | ")), "\n")
    return F.when(F.size(rows) > 1, F.concat(title, F.lit("\n"), body))


def storable(chunks: DataFrame, least: int = 10) -> DataFrame:
    return chunks.where(F.length(T.strip(F.col("content"))) > least)


def stored(frame: DataFrame, path: str, partitions: list[str] | None = None) -> DataFrame:
    """Writes a frame as Parquet, at once or not at all by the committer, and gives what was written."""
    writer = frame.write.mode("overwrite")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)
    return frame.sparkSession.read.parquet(path)


def batch_summary(results: DataFrame, key: str) -> DataFrame:
    """(key, total, succeeded, failed, chunks, percent). results: key, ok, chunks."""
    ok = F.count_if("ok")
    return results.groupBy(key).agg(rows_().alias("total"), ok.alias("succeeded"), (rows_() - ok).alias("failed"), F.sum("chunks").alias("chunks"), F.round(ok * 100.0 / rows_(), 2).alias("percent"))


def merged_text(files: DataFrame, key: str, order: str, name: str, text: str) -> DataFrame:
    """(key, text): the files of each batch in order under `=== name ===`; failed ones, with null text, left out."""
    part = F.struct(order, F.concat(F.lit("=== "), F.col(name), F.lit(" ===\n"), F.col(text)).alias("t"))
    rows = files.where(F.col(text).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_list(part)).alias("p"))
    return rows.select(key, F.array_join(F.transform("p", lambda x: x["t"]), "\n\n").alias("text"))


def upload_status(docs: DataFrame, chunks: DataFrame, expected: Column) -> DataFrame:
    """(id, chunks, status, progress)."""
    counts = chunks.groupBy(F.col("document_id").alias("id")).agg(rows_().alias("chunks"))
    joined = docs.join(counts, "id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0).cast("long")))
    return joined.select("id", "chunks", F.when(F.col("chunks") > 0, "completed").otherwise("processing").alias("status"), F.round(F.least(F.lit(100.0), F.coalesce(F.try_divide(F.col("chunks") * 100.0, expected), F.lit(0.0))), 2).alias("progress"))


def csv_line(fields: list[Column], quoted: Column) -> Column:
    return F.concat(F.concat_ws(",", *fields), F.lit(',"'), F.replace(quoted, F.lit('"'), F.lit('""')), F.lit('"'))


def prometheus(metrics: DataFrame) -> DataFrame:
    """(name, value): the last value of each gauge."""
    gauges = (("query", "duration_ms"), ("embedding", "duration_ms"), ("embedding", "batch_size"), ("generation", "duration_ms"), ("generation", "confidence"))
    rows = F.array(*(F.struct(F.lit(f"rag_{k}_{c}").alias("name"), F.lit(k).alias("kind"), F.col(c).cast("double").alias("value")) for k, c in gauges))
    return metrics.select("ts", "id", "type", F.explode(rows).alias("r")).where("type = r.kind").groupBy("r.name").agg(F.max_by("r.value", F.struct("ts", "id")).alias("value"))


def merged_metadata(left: Column, right: Column) -> Column:
    """Top-level merge of two JSON objects as JSON, the right one's values winning; null counts as empty."""
    parse = lambda c: F.from_json(F.coalesce(c, F.lit("{}")), "map<string,string>")
    kept = F.map_filter(parse(left), lambda k, _: ~F.map_contains_key(parse(right), k))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(kept, parse(right))))))


def without(tables: dict[str, tuple[DataFrame, str]], ids: DataFrame) -> dict[str, DataFrame]:
    """Each table without the rows whose key is among ids: a cascading delete of documents."""
    return {name: table.join(ids.select(F.col("id").alias(key)), key, "left_anti") for name, (table, key) in tables.items()}


def valid_upload(name: Column, size: Column, mime: Column, most: int = 50 << 20) -> Column:
    """Code of the first thing wrong with an upload, or ok."""
    return F.when(size <= 0, "empty").when(size > most, "too_large").when(~mime.isin(*ALLOWED), "bad_type").when(filename_problem(name) != "ok", "bad_name").otherwise("ok")


def url_problem(url: Column) -> Column:
    scheme, host = F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1), F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)
    label = "[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"
    return F.when(~F.lower(scheme).isin("http", "https"), "scheme").when(host == "", "host").when(~host.rlike(rf"^(?:{label}\.)*{label}$"), "domain").otherwise("ok")


def filename_problem(name: Column) -> Column:
    base = F.upper(F.substring_index(name, ".", 1))
    return F.when(name == "", "empty").when(F.length(name) > 255, "long").when(name.rlike(r"[/\\]"), "path").when(base.isin(*RESERVED), "reserved").when(name.rlike(r'[<>:"|?*\x00-\x1f]'), "characters").otherwise("ok")


def metadata_problem(meta: Column) -> Column:
    """meta: map of strings. Codes for too many keys, long or odd keys and long values."""
    keys = F.map_keys(meta)
    return F.when(F.size(keys) > 50, "keys").when(F.exists(keys, lambda k: F.length(k) > 100), "long_key").when(F.exists(keys, lambda k: ~k.rlike(r"^[a-zA-Z0-9_\-.]+$")), "odd_key").when(F.exists(F.map_values(meta), lambda v: F.length(v) > 1000), "long_value").otherwise("ok")


def window_problem(seconds: Column) -> Column:
    return F.when(seconds < 60, "short").when(seconds > 86_400, "long").otherwise("ok")


def page_problem(offset: Column, limit: Column) -> Column:
    return F.when(offset < 0, "offset").when(limit < 1, "small").when(limit > 1000, "large").otherwise("ok")


def chosen_input(file_text: Column, title: Column, text: Column, body: Column) -> Column:
    """The first of file, title and text, and a raw body that is no JSON."""
    full = lambda c: c.isNotNull() & (F.btrim(c) != "")
    return F.when(full(file_text), file_text).when(full(title) & full(text), F.concat(title, F.lit("\n\n"), text)).when(full(body) & ~F.ltrim(body).rlike(r"^[{\[]"), body)


def outcome(status: Column, text: Column) -> Column:
    return (status == "success") & (F.btrim(F.coalesce(text, F.lit(""))) != "")


def text_stats(text: Column) -> dict[str, Column]:
    return {"bytes": F.octet_length(text), "chars": F.length(text), "words": F.size(T.words(text)), "lines": F.size(F.split(text, "\n"))}


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
