"""Registered queries: sources, extraction and sinks."""

import json

from pyspark.sql import functions as F

from tessera.operators import ingest as I
from tessera.operators import usage as U
from tessera.sources import formats as S
from tessera.sources.files import read_folder
from tessera.sources.storage import scratch, state_of

from .registry import register


def rows_():
    return F.count(F.lit(1))


def text_():
    return F.col("text")


EXT = ["pdf", "docx", "XLSX", "pptx", "html", "csv", "rtf", "png", "bin", "txt"]


def file_name():
    return F.concat(F.lit("dir.x/file"), F.col("doc_id").cast("string"), F.lit("."), F.element_at(F.array(*map(F.lit, EXT)), (F.col("doc_id") % 10 + 1).cast("int")))


NAME_SQL = f"'dir.x/file' || doc_id || '.' || ({EXT})[doc_id % 10 + 1]"
KINDS = "CASE lower(regexp_extract(name, '\\.([A-Za-z0-9]+)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.EXTENSIONS.items()) + " ELSE 'unknown' END"
register("A01_filtered_scan", lambda t: t.docs.where("tenant_slug = 'src3' AND id BETWEEN 100 AND 700").select("id", "title"), "SELECT id, title FROM docs WHERE tenant_slug = 'src3' AND id BETWEEN 100 AND 700")
register("A02_type_by_extension", lambda t: t.load("documents").select("doc_id", S.type_by_extension(file_name()).alias("kind")), f"SELECT doc_id, {KINDS} AS kind FROM (SELECT doc_id, {NAME_SQL} AS name FROM documents)")
register("A03_type_by_content", lambda t: t.load("documents").withColumn("c", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("<HTML><body>"), text_())).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("import x\n"), text_())).otherwise(text_())).select("doc_id", S.type_by_content(file_name(), F.col("c")).alias("d")).select("doc_id", "d.*"), f"""WITH c AS (SELECT doc_id, {NAME_SQL} AS name, substring(CASE doc_id % 3 WHEN 0 THEN '<HTML><body>' || text WHEN 1 THEN 'import x' || chr(10) || text ELSE text END, 1, 10000) AS h FROM documents), l AS (SELECT *, string_split(h, chr(10))[1:10] AS x, {KINDS} AS k FROM c), f AS (SELECT *, list_filter(x, lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g') <> '') AS y FROM l), m AS (SELECT *, len(x) > 1 AND regexp_matches(h, '[\\t,]') AND ({' OR '.join(f"len(list_filter(y, lambda s: NOT contains(s, {d}))) = 0" for d in ("','", "chr(9)", "';'", "'|'"))}) AS st, regexp_matches(lower(h), '<html|<xml|<\\?xml|<body') AS mk FROM f), n AS (SELECT *, NOT mk AND regexp_matches(h, 'def |function |class |import ') AS cd FROM m)
 SELECT doc_id, CASE WHEN k <> 'unknown' THEN k WHEN mk THEN 'html' ELSE 'txt' END AS kind, concat_ws(',', CASE WHEN st THEN 'structured' END, CASE WHEN mk THEN 'markup' END, CASE WHEN cd THEN 'code' END, 'plain_text') AS subtype, round(0.8::DOUBLE + st::INT * 0.1 + (mk OR cd)::INT * 0.1, 2) AS confidence FROM n""")
pages = lambda t: t.load("pages")
register("A04_html_text", lambda t: S.parsed(pages(t), "page_id", "html", S.html_text, "string").select("id", F.length("value").alias("n"), F.md5("value").alias("digest")))


def xml_of():
    return F.concat(F.lit("<doc><id>"), F.col("doc_id"), F.lit("</id><body><p>"), F.regexp_replace("text", "[<>&]", ""), F.lit("</p><empty/></body></doc>"))


register("A05_xml_text", lambda t: S.parsed(t.load("documents").withColumn("xml", xml_of()), "doc_id", "xml", S.xml_text, "string").select(F.col("id").alias("doc_id"), F.md5("value").alias("digest")), r"SELECT doc_id, md5('=== doc ===' || chr(10) || '  id: ' || doc_id || CASE WHEN p <> '' THEN chr(10) || '  === body ===' || chr(10) || '    p: ' || p ELSE '' END) AS digest FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '[<>&]', '', 'g'), '^\s+|\s+$', '', 'g') AS p FROM documents)")


def table_of():
    return F.concat(F.lit("<table><tr><th>Name</th><th>Size</th></tr><tr><td>"), F.col("p_name"), F.lit("</td><td>"), F.col("p_size").cast("string"), F.lit("</td></tr></table><table><tr><td>x</td></tr></table>"))


register("A06_html_tables", lambda t: S.parsed(t.load("part").withColumn("html", table_of()), "p_partkey", "html", S.html_tables, "tables").select("id", F.explode("value").alias("v")).select("id", "v.*"), "SELECT p_partkey AS id, i::INT AS index, CASE i WHEN 0 THEN 2 ELSE 1 END::INT AS rows, CASE i WHEN 0 THEN '=== TABELA HTML 0 ===' || chr(10) || 'Name | Size' || chr(10) || '-----------' || chr(10) || p_name || ' | ' || p_size ELSE '=== TABELA HTML 1 ===' || chr(10) || 'x' || chr(10) || '-' END AS text FROM part, (SELECT unnest([0, 1]) AS i)")
BATCH = "p_partkey // 100"
SEP = f"([',', ';', chr(9), '|'])[({BATCH}) % 4 + 1]"


def csv_files(t):
    """One CSV text for each hundred parts: a header without the third name, a row for each part, an empty row at the end."""
    p = t.load("part").withColumn("batch", F.floor(F.col("p_partkey") / 100)).withColumn("sep", F.get(F.array(F.lit(","), F.lit(";"), F.lit("\t"), F.lit("|")), F.col("batch") % 4))
    cell = F.when(F.col("p_size") % 7 == 0, "").otherwise(F.concat(F.lit('"a'), F.col("sep"), F.lit('""b""'), F.col("p_size").cast("string"), F.lit('"')))
    line = F.concat(F.col("p_partkey").cast("string"), F.col("sep"), F.col("p_name"), F.col("sep"), cell, F.col("sep"), F.col("p_retailprice").cast("string"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", line.alias("l")))), lambda x: x["l"])
    head = F.concat(F.lit("id"), F.first("sep"), F.lit("name"), F.first("sep"), F.lit(""), F.first("sep"), F.lit("price"))
    return p.groupBy("batch").agg(F.concat(head, F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n"), F.first("sep"), F.first("sep")).alias("text"))


CELL = f"CASE WHEN p_size % 7 = 0 THEN NULL ELSE 'a' || {SEP} || '\"b\"' || p_size END"
register("A07_csv_rows", lambda t: S.csv_rows(csv_files(t), "batch", "text").select("id", "row", F.element_at("cells", "id").alias("a"), F.element_at("cells", "name").alias("b"), F.element_at("cells", "Column_3").alias("c"), F.element_at("cells", "price").alias("d")), f"SELECT {BATCH} AS id, (row_number() OVER (PARTITION BY {BATCH} ORDER BY p_partkey))::INT AS row, p_partkey::VARCHAR AS a, p_name AS b, {CELL} AS c, p_retailprice::VARCHAR AS d FROM part")
CELLS = ["12", " 3,5 ", "4.25", "", "abc", "-7", "1e3"]
register("A08_typed_cells", lambda t: t.load("part").select("p_partkey", S.typed_cell(F.element_at(F.array(*map(F.lit, CELLS)), (F.col("p_partkey") % 7 + 1).cast("int"))).alias("c")).select("p_partkey", "c.*"), f"SELECT p_partkey, CASE WHEN c = '' THEN NULL WHEN regexp_matches(c, '^[+-]?\\d{{1,18}}$') THEN 'int' WHEN try_cast(replace(c, ',', '.') AS DOUBLE) IS NOT NULL THEN 'float' ELSE 'text' END AS kind, try_cast(replace(nullif(c, ''), ',', '.') AS DOUBLE) AS number, nullif(c, '') AS text FROM (SELECT p_partkey, trim(({CELLS})[p_partkey % 7 + 1]) AS c FROM part)")
register("A09_csv_text", lambda t: t.load("part").select("p_partkey", F.concat_ws(" | ", "p_name", F.when(F.col("p_size") % 7 != 0, F.col("p_type")), F.col("p_size").cast("string")).alias("line")), "SELECT p_partkey, concat_ws(' | ', p_name, CASE WHEN p_size % 7 <> 0 THEN p_type END, p_size) AS line FROM part")


def rtf_of():
    return F.concat(F.lit(r"{\rtf1\ansi\b bold\b0 caf\'e9 \{x\} "), F.regexp_replace("text", r"[\\{}]", ""), F.lit("}"))


register("A11_rtf_text", lambda t: S.parsed(t.load("documents").withColumn("rtf", rtf_of()), "doc_id", "rtf", S.rtf_text, "string").select("id", F.md5("value").alias("digest")))
register("A12_decoded_text", lambda t: S.parsed(t.load("documents").withColumn("b", F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8")))), "doc_id", "b", S.plain_text, "string").select(F.col("id").alias("doc_id"), F.md5("value").alias("digest")), "SELECT doc_id, md5(text) AS digest FROM documents")
register("A13_json_text", lambda t: S.parsed(t.load("events").select("event_id", F.to_json(F.struct("event_type", F.struct("user_id", F.array("user_id", "event_id").alias("list")).alias("who"))).alias("j")), "event_id", "j", S.json_text, "string"), "SELECT event_id AS id, 'event_type: ' || event_type || chr(10) || 'who:' || chr(10) || '  user_id: ' || user_id || chr(10) || '  list:' || chr(10) || '    0: ' || user_id || chr(10) || '    1: ' || event_id AS value FROM events")
register("A14_cleaned_pdf", lambda t: t.load("documents").select("doc_id", F.md5(I.cleaned_pdf(F.regexp_replace("text", "\n", "\f\n 2 ) "))).alias("digest")))


def cell_rows():
    return F.array(F.array("p_name", F.lit(None).cast("string")), F.array("p_type", F.col("p_size").cast("string")))


register("A15_table_text", lambda t: t.load("part").select("p_partkey", I.table_text(F.slice(cell_rows(), 1, F.when(F.col("p_size") % 5 == 0, 1).otherwise(2)), F.col("p_size"), F.lit(1)).alias("text")), "SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN '=== TABELA (Página ' || p_size || ', Tabela 1) ===' || chr(10) || p_name || ' | ' || chr(10) || p_type || ' | ' || p_size END AS text FROM part")


def kind_of_three():
    return F.element_at(F.array(F.lit("xlsx"), F.lit("pptx"), F.lit("txt")), (F.col("o_orderkey") % 3 + 1).cast("int"))


PAGES = "greatest(1, CASE o_orderkey % 3 WHEN 0 THEN CASE WHEN o_custkey % 10 > 0 THEN ceil(o_custkey % 10 * 100 / 50.0) ELSE ceil(o_totalprice / 10240) END WHEN 1 THEN ceil(o_totalprice / 204800) ELSE ceil(o_totalprice / 4096) END)::BIGINT"
register("A17_page_estimate", lambda t: t.load("orders").select("o_orderkey", I.page_estimate(kind_of_three(), F.col("o_totalprice"), F.col("o_custkey") % 10 * 100).alias("pages")), f"SELECT o_orderkey, {PAGES} AS pages FROM orders")
register("A18_page_limit", lambda t: t.load("orders").select("o_orderkey", (I.page_estimate(kind_of_three(), F.col("o_totalprice"), F.col("o_custkey") % 10 * 100) <= 50).alias("valid")), f"SELECT o_orderkey, {PAGES} <= 50 AS valid FROM orders")
TRIM = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
register("A19_extraction_score", lambda t: t.load("documents").select("doc_id", I.extraction_score(text_()).alias("score")), rf"SELECT doc_id, CASE WHEN n < 10 THEN 0.0 WHEN n < 100 THEN 0.3 ELSE round(least(1.0, greatest(0.0, 0.5 + least(0.3::DOUBLE, n / 10000::DOUBLE) + CASE WHEN len(regexp_extract_all(c, '[.!?]+')) > n / 100 THEN 0.1 ELSE 0 END - CASE WHEN len(regexp_extract_all(c, '[^\w\s.,!?;:-]')) > n / 20 THEN 0.2 ELSE 0 END)), 6) END::DOUBLE AS score FROM (SELECT doc_id, {TRIM} AS c, strlen({TRIM}) AS n FROM documents)")
register("A20_storable_chunks", lambda t: I.storable(t.chunks).select("id"), r"SELECT id FROM chunks WHERE length(regexp_replace(content, '^\s+|\s+$', '', 'g')) > 10")
register("A21_batch_summary", lambda t: I.batch_summary(t.load("events").select("user_id", (F.col("event_type") != "error").alias("ok"), F.when(F.col("event_type") != "error", F.col("user_id") % 7).otherwise(0).alias("chunks")), "user_id"), "SELECT user_id, count(*) AS total, count(*) FILTER (WHERE event_type <> 'error') AS succeeded, count(*) FILTER (WHERE event_type = 'error') AS failed, sum(CASE WHEN event_type <> 'error' THEN user_id % 7 ELSE 0 END)::BIGINT AS chunks, round(count(*) FILTER (WHERE event_type <> 'error') * 100.0::DOUBLE / count(*), 2) AS percent FROM events GROUP BY 1")
register("A22_merged_batch", lambda t: I.merged_text(t.load("documents").select(F.floor(F.col("doc_id") / 5).alias("batch"), "doc_id", F.concat(F.lit("f"), F.col("doc_id")).alias("name"), F.when(F.col("doc_id") % 7 != 0, text_()).alias("text")), "batch", "doc_id", "name", "text").select("batch", F.md5("text").alias("digest")), "SELECT doc_id // 5 AS batch, md5(string_agg('=== f' || doc_id || ' ===' || chr(10) || text, chr(10) || chr(10) ORDER BY doc_id)) AS digest FROM documents WHERE doc_id % 7 <> 0 GROUP BY 1")


def mixed_files(t):
    """(name, value): every page as a file of one of seven kinds; each eleventh name is cut off in its markup or braces."""
    url, n = F.col("url"), F.col("page_id")
    plain = F.regexp_replace("url", "[<>&]", " ")
    kinds = [
        ("html", F.col("html")), ("xml", F.concat(F.lit("<page><url>"), plain, F.lit("</url></page>"))), ("json", F.concat(F.lit('{"url": "'), url, F.lit('"}'))), ("csv", F.concat(F.lit("id,url\n"), n.cast("string"), F.lit(","), url)),
        ("txt", url), ("rtf", F.concat(F.lit("{\\rtf1 "), plain, F.lit("}"))), ("pdf", F.concat(F.lit("%PDF "), url)),
    ]
    pick = lambda of: F.get(F.array(*of), n % len(kinds))
    value = pick([v for _, v in kinds])
    cut = F.when(n % 11 == 0, F.substring(value, F.lit(1), F.length(value) - 3)).otherwise(value)
    return t.load("pages").select(F.concat(F.lit("page"), n.cast("string"), F.lit("."), pick([F.lit(k) for k, _ in kinds])).alias("name"), cut.alias("value"))


def folder(t):
    """A folder of these files, each in a folder of its name, as Spark's writer names the files themselves; written once."""
    key = (t.spark.sparkContext.applicationId, *state_of(t.spark, f"{t.dir}/pages.parquet"))
    if key not in FOLDERS:
        FOLDERS[key] = scratch(t.spark, "files")
        mixed_files(t).repartition("name").write.partitionBy("name").text(FOLDERS[key])
    return read_folder(t.spark, FOLDERS[key], name=F.regexp_extract("path", r"/name=([^/]+)/", 1))


FOLDERS: dict[tuple, str] = {}
register(
    "A22b_folder_of_files",
    lambda t: folder(t).select("name", "kind", F.col("error").isNotNull().alias("failed"), F.when(F.col("kind").isin("txt", "json"), F.md5(F.rtrim(F.regexp_replace("text", "\n+$", "")))).alias("digest")),
    """SELECT 'page' || page_id || '.' || kind AS name, kind, kind = 'pdf' OR (page_id % 11 = 0 AND kind IN ('xml', 'json')) AS failed,
      CASE kind WHEN 'txt' THEN md5(CASE WHEN page_id % 11 = 0 THEN left(url, length(url) - 3) ELSE url END) WHEN 'json' THEN CASE WHEN page_id % 11 > 0 THEN md5('url: ' || url) END END AS digest
      FROM (SELECT page_id, url, (['html', 'xml', 'json', 'csv', 'txt', 'rtf', 'pdf'])[page_id % 7 + 1] AS kind FROM pages)""",
)
register("A23_upload_status", lambda t: I.upload_status(t.docs, t.chunks.where("document_id % 4 <> 0"), F.lit(8)), "SELECT d.id, coalesce(n, 0) AS chunks, CASE WHEN n > 0 THEN 'completed' ELSE 'processing' END AS status, round(least(100.0::DOUBLE, coalesce(n, 0) * 100.0::DOUBLE / 8), 2) AS progress FROM docs d LEFT JOIN (SELECT document_id, count(*) AS n FROM chunks WHERE document_id % 4 <> 0 GROUP BY 1) c ON c.document_id = d.id")
register("A24_csv_export", lambda t: t.metrics.select("id", I.csv_line([F.col("id").cast("string"), F.col("type"), F.col("success").cast("string"), U.performance_category(F.col("duration_ms"))], F.concat(F.lit('{"k": "'), F.col("query_hash").cast("string"), F.lit('"}'))).alias("line")), "SELECT id, id || ',' || type || ',' || success || ',' || CASE WHEN duration_ms < 100 THEN 'fast' WHEN duration_ms < 500 THEN 'medium' WHEN duration_ms < 2000 THEN 'slow' ELSE 'very_slow' END || ',\"{\"\"k\"\": \"\"' || query_hash || '\"\"}\"' AS line FROM rag_metrics")
register("A24b_prometheus_export", lambda t: I.prometheus(t.metrics), "SELECT name, arg_max(value, (ts, id)) AS value FROM (SELECT ts, id, 'rag_' || type || '_duration_ms' AS name, duration_ms AS value FROM rag_metrics WHERE type IN ('query', 'embedding', 'generation') UNION ALL SELECT ts, id, 'rag_embedding_batch_size', batch_size::DOUBLE FROM rag_metrics WHERE type = 'embedding' UNION ALL SELECT ts, id, 'rag_generation_confidence', confidence FROM rag_metrics WHERE type = 'generation') GROUP BY 1")


def old_metadata():
    return F.concat(F.lit('{"a":"1","id":"'), F.col("doc_id"), F.lit('"}'))


def new_metadata():
    return F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('{"a":"2","z":"'), F.col("lang"), F.lit('"}')))


register("A26_merged_metadata", lambda t: t.load("documents").select("doc_id", I.merged_metadata(old_metadata(), new_metadata()).alias("metadata")), """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '{"a":"2","id":"' || doc_id || '","z":"' || lang || '"}' ELSE '{"a":"1","id":"' || doc_id || '"}' END AS metadata FROM documents""")
register("A27_cascading_delete", lambda t: I.union_all([d.agg(F.lit(n).alias("name"), rows_().alias("rows")) for n, d in I.without({"documents": (t.docs, "id"), "chunks": (t.chunks, "document_id"), "feedbacks": (t.feedbacks, "document_id")}, t.docs.where("tenant_slug = 'src1'")).items()]), "WITH g AS (SELECT id FROM docs WHERE tenant_slug = 'src1') SELECT 'documents' AS name, count(*) AS rows FROM docs WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT 'chunks', count(*) FROM chunks WHERE document_id NOT IN (SELECT id FROM g) UNION ALL SELECT 'feedbacks', count(*) FROM rag_feedbacks WHERE document_id NOT IN (SELECT id FROM g)")
register("A28_text_metadata", lambda t: t.load("documents").select("doc_id", *(c.alias(k) for k, c in I.text_stats(text_()).items())), r"SELECT doc_id, strlen(text)::INT AS bytes, length(text)::INT AS chars, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))::INT AS words, len(string_split(text, chr(10)))::INT AS lines FROM documents")
MIMES = ["application/pdf", "text/plain", "application/zip", "image/png"]
register("A29_valid_upload", lambda t: t.load("documents").select("doc_id", I.valid_upload(F.concat(F.lit("file"), F.col("doc_id"), F.when(F.col("doc_id") % 9 == 0, "?").otherwise(".txt")), F.col("doc_id") % 13 * 10_000_000, F.element_at(F.array(*map(F.lit, MIMES)), (F.col("doc_id") % 4 + 1).cast("int"))).alias("state")), "SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'empty' WHEN doc_id % 13 * 10000000 > 52428800 THEN 'too_large' WHEN doc_id % 4 = 2 THEN 'bad_type' WHEN doc_id % 9 = 0 THEN 'bad_name' ELSE 'ok' END AS state FROM documents")


def outline(t):
    made = S.parsed(pages(t), "page_id", "html", lambda h: json.dumps(S.html_outline(h)), "string")
    shape = "title string, description string, headings int, paragraphs int, links int, images int, tables int, forms int, lists int, chars int, share double, remarks array<string>, rating string"
    return made.select("id", F.from_json("value", shape).alias("o")).select("id", "o.*").withColumn("remarks", F.array_join("remarks", ","))


register("A30_html_outline", outline)


def contents(t):
    """The parts of every page; lists of parts as JSON."""
    made = S.parsed(pages(t), "page_id", "html", lambda h: json.dumps(S.html_contents(h)), "string")
    parts = made.select("id", F.from_json("value", S.CONTENTS).alias("c")).select("id", "c.*")
    return parts.select("id", *(F.to_json(c).alias(c) if kind.startswith("array") else F.col(c) for c, kind in parts.dtypes if c != "id"))


register("A30b_html_contents", contents)
register("A31_csv_delimiter", lambda t: csv_files(t).select("batch", S.delimiter(text_()).alias("sep"), F.size(F.filter(F.split(text_(), "\n"), lambda x: x.rlike(r"[A-Za-z0-9]"))).alias("rows_with_data")), f"SELECT {BATCH} AS batch, max({SEP}) AS sep, count(*)::INT + 1 AS rows_with_data FROM part GROUP BY 1")
register("A32_extraction_outcome", lambda t: t.load("documents").select("doc_id", I.outcome(F.when(F.col("doc_id") % 5 == 0, "error").otherwise("success"), F.when(F.col("doc_id") % 3 > 0, text_())).alias("ok")).groupBy("ok").agg(rows_().alias("n")), "SELECT doc_id % 5 <> 0 AND doc_id % 3 > 0 AND trim(text) <> '' AS ok, count(*) AS n FROM documents GROUP BY 1")


def requests(t):
    """Every page's address, bent in some rows, with a file name, a metadata key, a span of time and a page made from it."""
    url, n = F.col("url"), F.col("page_id")
    bent = [url, F.replace(url, F.lit("http"), F.lit("ftp")), F.concat(F.lit("https:///"), F.substring_index(url, "/", -1)), F.replace(url, F.lit("://"), F.lit("://-")), F.replace(url, F.lit("."), F.lit("_")), F.substring_index(url, "/", -1)]
    tail = F.substring_index(url, "/", -1)
    names = [F.concat(tail, F.lit(".txt")), F.lit(""), url, F.concat(F.lit("CON."), tail), F.concat(tail, F.lit("|b")), F.concat(F.lit("lpt1.x"), tail), F.repeat(tail, 200)]
    keys = [tail, F.concat(F.lit("key_"), n.cast("string")), F.repeat(F.lit("k"), (n % 200).cast("int") + 1)]
    pick = lambda of: F.get(F.array(*of), n % len(of))
    return t.load("pages").select("page_id", pick(bent).alias("url"), pick(names).alias("name"), pick(keys).alias("key"), F.repeat(url, (n % 60).cast("int")).alias("value"))


REQUESTS = """SELECT page_id, ([url, replace(url, 'http', 'ftp'), 'https:///' || tail, replace(url, '://', '://-'), replace(url, '.', '_'), tail])[page_id % 6 + 1] AS url,
  ([tail || '.txt', '', url, 'CON.' || tail, tail || '|b', 'lpt1.x' || tail, repeat(tail, 200)])[page_id % 7 + 1] AS name,
  ([tail, 'key_' || page_id, repeat('k', page_id % 200 + 1)])[page_id % 3 + 1] AS key, repeat(url, page_id % 60) AS value
  FROM (SELECT page_id, url, list_last(string_split(url, '/')) AS tail FROM pages)"""
LABEL = "[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"
register(
    "A33_validators",
    lambda t: requests(t).select(
        "page_id", I.url_problem(F.col("url")).alias("url"), I.filename_problem(F.col("name")).alias("name"), I.window_problem(F.col("page_id") * 700).alias("seconds"),
        I.page_problem(F.col("page_id") - 3, F.col("page_id") * 9).alias("page"), I.metadata_problem(F.create_map("key", "value")).alias("meta"),
    ),
    rf"""WITH r AS ({REQUESTS}), h AS (SELECT *, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1) AS host FROM r)
      SELECT page_id, CASE WHEN scheme NOT IN ('http', 'https') THEN 'scheme' WHEN host = '' THEN 'host' WHEN NOT regexp_matches(host, '^(?:{LABEL}\.)*{LABEL}$') THEN 'domain' ELSE 'ok' END AS url,
        CASE WHEN name = '' THEN 'empty' WHEN length(name) > 255 THEN 'long' WHEN contains(name, '/') OR contains(name, chr(92)) THEN 'path' WHEN upper(split_part(name, '.', 1)) IN ({', '.join(f"'{r}'" for r in I.RESERVED)}) THEN 'reserved'
          WHEN regexp_matches(name, '[<>:"|?*\x00-\x1f]') THEN 'characters' ELSE 'ok' END AS name,
        CASE WHEN page_id * 700 < 60 THEN 'short' WHEN page_id * 700 > 86400 THEN 'long' ELSE 'ok' END AS seconds,
        CASE WHEN page_id < 3 THEN 'offset' WHEN page_id * 9 > 1000 THEN 'large' ELSE 'ok' END AS page,
        CASE WHEN length(key) > 100 THEN 'long_key' WHEN NOT regexp_matches(key, '^[a-zA-Z0-9_.-]+$') THEN 'odd_key' WHEN length(value) > 1000 THEN 'long_value' ELSE 'ok' END AS meta FROM h""",
)
register("A34_input_precedence", lambda t: t.load("documents").select("doc_id", F.md5(I.chosen_input(F.when(F.col("doc_id") % 4 == 0, text_()), F.when(F.col("doc_id") % 4 == 1, F.lit("T")), text_(), F.when(F.col("doc_id") % 4 == 2, F.lit('{"a": 1}')).otherwise("raw"))).alias("digest")), "SELECT doc_id, md5(CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN 'T' || chr(10) || chr(10) || text WHEN 3 THEN 'raw' END) AS digest FROM documents")
