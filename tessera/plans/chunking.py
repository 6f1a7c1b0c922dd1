"""Registered queries: chunking and deduplication of chunks."""

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chunking as C

from .registry import register


def rows_():
    return F.count(F.lit(1))


TYPES = ["pdf", "docx", "xlsx", "pptx", "html", "txt", "csv", "other"]


def text_():
    return F.col("text")


def typed(t):
    return t.load("documents").withColumn("kind", F.element_at(F.array(*map(F.lit, TYPES)), (F.col("doc_id") % 8 + 1).cast("int")))


def pieces(column):
    return lambda t: C.exploded(t.load("documents"), column()).select("document_id", "ord", F.md5("content").alias("digest"), F.length("content").alias("n"))


def sliced(text, size, step, stop):
    """SQL for pieces of a text: starts from 0 to below `stop`, `step` apart."""
    return f"SELECT doc_id AS document_id, unnest(list_transform(range(0, {stop}, {step}), lambda p: substring({text}, (p + 1)::BIGINT, {size}))) AS content, unnest(range(len(range(0, {stop}, {step})))) AS pos FROM documents"


def trimmed_sql(inner):
    clean = r"regexp_replace(content, '^\s+|\s+$', '', 'g')"
    return f"SELECT document_id, (row_number() OVER (PARTITION BY document_id ORDER BY pos) - 1)::INT AS ord, {clean} AS content FROM ({inner}) WHERE {clean} <> ''"


DIGEST = "SELECT document_id, ord, md5(content) AS digest, length(content)::INT AS n FROM"
sizes = " ".join(f"WHEN '{k}' THEN {v[0]}" for k, v in C.SIZES.items())
overlaps = " ".join(f"WHEN '{k}' THEN {v[0] - v[1]}" for k, v in C.SIZES.items())
KIND = "(['pdf', 'docx', 'xlsx', 'pptx', 'html', 'txt', 'csv', 'other'])[doc_id % 8 + 1]"
register(
    "B01_chunk_by_type",
    lambda t: C.exploded(typed(t), C.by_type(text_(), F.col("kind"))).select("document_id", "ord", F.md5("content").alias("digest"), F.length("content").alias("n")),
    f"{DIGEST} ({trimmed_sql(sliced('text', f'CASE {KIND} {sizes} ELSE 1000 END', f'CASE {KIND} {overlaps} ELSE 850 END', 'length(text)'))})",
)
register("B02_size_chunks", pieces(lambda: T.trimmed(T.slices(text_(), 1000, 150))), f"{DIGEST} ({trimmed_sql(sliced('text', 1000, 850, 'length(text)'))})")
NORM = r"regexp_replace(regexp_replace(text, '\r\n|\r', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')"
for name, size, overlap in (("B03_chunk_text", 1000, 200), ("B04_chunk_large_text", 1000, 200), ("B06_legacy_chunks", 2000, 200)):
    register(name, pieces(lambda size=size, overlap=overlap: C.chunk_text(text_(), size, overlap)), f"SELECT document_id, pos::INT AS ord, md5(content) AS digest, length(content)::INT AS n FROM ({sliced(NORM, size, size - overlap, f'greatest(1, length({NORM}) - {overlap})')}) WHERE content <> ''")
register("B05_fixed_slices", pieces(lambda: T.slices(text_(), 1000)), f"SELECT document_id, pos::INT AS ord, md5(content) AS digest, length(content)::INT AS n FROM ({sliced('text', 1000, 1000, 'length(text)')})")
register("B07_sentence_chunks", pieces(lambda: C.by_sentences(text_(), 1000)))
WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"
register("B08_word_windows", pieces(lambda: C.word_windows(text_(), 900, 120)), f"SELECT document_id, pos::INT AS ord, md5(content) AS digest, length(content)::INT AS n FROM (SELECT doc_id AS document_id, unnest(list_transform(range(1, len(w) + 1, 130), lambda i: array_to_string(w[i:i + 149], ' '))) AS content, unnest(range(len(range(1, len(w) + 1, 130)))) AS pos FROM (SELECT doc_id, {WORDS} AS w FROM documents))")
register("B09_paragraph_or_size", pieces(lambda: C.by_paragraphs_or_size(F.regexp_replace(text_(), "\n", "\n\n"), 800, 120)))
register("B10_paragraph_bytes", pieces(lambda: C.by_paragraphs(F.regexp_replace(text_(), "\n", "\n\n"))))


def numbered():
    return F.array_join(F.transform(F.split(text_(), "\n"), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


register("B11_structure_chunks", lambda t: C.by_structure(t.load("documents").withColumn("text", F.when(F.col("doc_id") % 2 == 0, numbered()).otherwise(text_())), "doc_id", "text").select("id", "ord", "kind", "number", F.md5("content").alias("digest")))
register("B12_pages", lambda t: C.exploded(t.load("documents"), F.split(F.regexp_replace(text_(), "\n", "\f"), "\f")).select("document_id", F.col("ord").alias("page"), F.length("content").alias("n")), "SELECT doc_id AS document_id, unnest(range(len(p)))::INT AS page, unnest(list_transform(p, lambda x: length(x)))::INT AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)")


def titled():
    return F.array_join(F.transform(F.split(text_(), "\n"), lambda x, i: F.when(i % 3 == 0, F.concat((i + 1).cast("string"), F.lit(") T"), F.substring(x, 1, 20))).otherwise(x)), "\n")


register(
    "B12b_sections",
    lambda t: C.sections(t.load("documents").withColumn("text", titled()), "doc_id", "text").select("document_id", "section", "title", F.md5("content").alias("digest")),
    r"""WITH l AS (SELECT doc_id AS document_id, unnest(range(len(x))) AS pos, unnest(x) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
 m AS (SELECT document_id, pos, regexp_replace(CASE WHEN pos % 3 = 0 THEN (pos + 1) || ') T' || substring(raw, 1, 20) ELSE raw END, '^\s+|\s+$', '', 'g') AS line FROM l),
 k AS (SELECT *, regexp_matches(line, '^[A-Z\s\d]{5,50}$') OR regexp_matches(line, '^\d+[.)]\s+[A-Z]') OR regexp_matches(line, '^[A-Z][a-z\s]+:$') AS is_title FROM m),
 s AS (SELECT *, sum(is_title::INT) OVER (PARTITION BY document_id ORDER BY pos) AS section FROM k)
 SELECT document_id, section::INT AS section, coalesce(max(line) FILTER (WHERE is_title), 'Início') AS title, md5(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT is_title) || chr(10)) AS digest FROM s GROUP BY 1, 2 HAVING count(*) FILTER (WHERE NOT is_title) > 0""",
)


def sheet_lines(t):
    p = t.load("part")
    return p.select(F.col("p_brand").alias("sheet"), F.col("p_partkey").alias("row"), F.concat_ws(" | ", "p_name", "p_type", F.col("p_size").cast("string")).alias("line"))


LINES = "SELECT p_brand AS sheet, p_partkey AS row, p_name || ' | ' || p_type || ' | ' || p_size AS line FROM part"
for name, size, head in (("B13_sheet_groups", 10, "=== Sheet ==="), ("B16_csv_groups", 20, "name,type,size")):
    register(name, lambda t, size=size, head=head: C.row_groups(sheet_lines(t), "sheet", "row", "line", F.lit(head), size), f"SELECT sheet, batch, count(*) AS rows, '{head}' || chr(10) || string_agg(line, chr(10) ORDER BY row) AS content FROM (SELECT *, ((row_number() OVER (PARTITION BY sheet ORDER BY row) - 1) // {size})::INT AS batch FROM ({LINES})) GROUP BY 1, 2")
register("B14_slide_chunks", lambda t: C.exploded(t.load("documents").withColumn("text", F.regexp_replace(text_(), "(?m)^", "Slide 1: ")), F.filter(F.split(text_(), r"(?=Slide \d+:|\[Slide \d+\]|--- Slide)"), lambda x: T.strip(x) != "")).select("document_id", "ord", F.length("content").alias("n")))
register("B15_html_sections", lambda t: C.exploded(t.load("documents").withColumn("text", F.regexp_replace(text_(), "(?m)^", "H2: ")), F.filter(F.split(text_(), r"(?=H\d+: )"), lambda x: T.strip(x) != "")).select("document_id", "ord", F.regexp_extract("content", r"^H(\d+)", 1).alias("level"), F.length("content").alias("n")))
register("B17_row_chunks", lambda t: t.load("part").select("p_partkey", F.concat_ws(" | ", F.lit("Sheet: parts"), *(F.when(F.col(c) != "", F.concat(F.lit(f"{c}: "), F.col(c))) for c in ("p_name", "p_brand", "p_type"))).alias("content")), "SELECT p_partkey, concat_ws(' | ', 'Sheet: parts', CASE WHEN p_name <> '' THEN 'p_name: ' || p_name END, CASE WHEN p_brand <> '' THEN 'p_brand: ' || p_brand END, CASE WHEN p_type <> '' THEN 'p_type: ' || p_type END) AS content FROM part")
TRIM = r"regexp_replace(content, '^\s+|\s+$', '', 'g')"
register("B18_minimum_length", lambda t: t.chunks.where(F.length(T.strip(F.col("content"))) >= C.MIN_CHARS).select("id"), f"SELECT id FROM chunks WHERE length({TRIM}) >= 50")
LINE_CHUNKS = "SELECT doc_id AS document_id, unnest(range(len(x)))::INT AS ord, unnest(x) AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)"
line_chunks = lambda t: C.exploded(t.load("documents"), F.split(text_(), "\n"))
register("B19_deduplicated", lambda t: C.deduplicated(line_chunks(t)).select("document_id", "ord"), f"SELECT document_id, min(ord) AS ord FROM ({LINE_CHUNKS}) GROUP BY document_id, sha256({TRIM})")
register("B20_dedup_ratio", lambda t: line_chunks(t).groupBy("document_id").agg(F.round((1 - F.count_distinct(T.strip(F.col("content"))) / rows_()) * 100, 2).alias("ratio")), f"SELECT document_id, round((1 - count(DISTINCT {TRIM}) / count(*)::DOUBLE) * 100, 2) AS ratio FROM ({LINE_CHUNKS}) GROUP BY 1")
register(
    "B21_chunk_metadata",
    lambda t: t.chunks.select(
        "id", F.size(T.words(F.col("content"))).alias("word_count"), F.length("content").alias("char_count"), F.substring("content", 1, 200).alias("preview"), T.times(F.col("content"), "[.!?]").alias("sentence_count"),
        (T.times(F.col("content"), "\n\n") + 1).alias("paragraph_count"), F.substring(F.md5("content"), 1, 8).alias("content_hash"), F.col("content").rlike(r"\d").alias("has_numbers"), F.col("content").rlike(r"(^|\n)[\d\-*•][.)\-\s]").alias("has_list_items"),
    ),
    r"SELECT id, len(list_filter(regexp_split_to_array(content, '\s+'), lambda w: w <> ''))::INT AS word_count, length(content)::INT AS char_count, substring(content, 1, 200) AS preview, len(regexp_extract_all(content, '[.!?]'))::INT AS sentence_count, len(regexp_extract_all(content, '\n\n'))::INT + 1 AS paragraph_count, substring(md5(content), 1, 8) AS content_hash, regexp_matches(content, '\d') AS has_numbers, regexp_matches(content, '(^|\n)[\d\-*•][.)\-\s]') AS has_list_items FROM chunks",
)
register("B22_keywords", lambda t: C.keywords(t.load("documents"), "doc_id", "text"), "WITH w AS (SELECT doc_id AS id, unnest(range(len(x))) AS pos, unnest(x) AS word FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-záàâãéêíóôõúç]{3,}') AS x FROM documents)), c AS (SELECT id, word, count(*) AS count, min(pos) AS first FROM w WHERE word NOT IN (" + ", ".join(f"'{w}'" for w in T.KEYWORD_STOP) + ") GROUP BY 1, 2) SELECT id, rank, word, count FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY count DESC, first)::INT AS rank FROM c) WHERE rank <= 10")
register("B23_guaranteed_chunk", lambda t: t.load("documents").select("doc_id", F.filter(T.slices(text_(), 1000), lambda x: F.length(x) > 400).alias("kept"), "text").select("doc_id", F.explode(F.when(F.size("kept") > 0, F.col("kept")).otherwise(F.array(F.substring(text_(), 1, 2000)))).alias("c")).groupBy("doc_id").agg(rows_().alias("n"), F.sum(F.length("c")).alias("chars")), "WITH s AS (SELECT doc_id, text, list_filter(list_transform(range(0, length(text), 1000), lambda p: substring(text, (p + 1)::BIGINT, 1000)), lambda x: length(x) > 400) AS kept FROM documents) SELECT doc_id, count(*) AS n, sum(length(c))::BIGINT AS chars FROM (SELECT doc_id, unnest(CASE WHEN len(kept) > 0 THEN kept ELSE [substring(text, 1, 2000)] END) AS c FROM s) GROUP BY 1")
register("B24_ten_percent_overlap", pieces(lambda: T.trimmed(T.slices(text_(), 600, 60))), f"{DIGEST} ({trimmed_sql(sliced('text', 600, 540, 'length(text)'))})")
register(
    "B25_chunking_metrics",
    lambda t: t.load("documents").select(F.octet_length("text").alias("n"), (F.size(T.slices(text_(), 1000))).alias("k"), "doc_id").select("doc_id", F.round(F.least(F.lit(1.0), F.when(F.col("n") > 1000, 0.9).otherwise(F.col("n") / 1000 * 0.9)), 6).alias("content_score"), F.round(F.coalesce(F.least(F.lit(1.0), F.try_divide("n", F.col("k") * 1000)), F.lit(0.0)), 6).alias("efficiency"), F.coalesce(F.round(F.try_divide("n", "k"), 2), F.lit(0.0)).alias("ratio")),
    "SELECT doc_id, round(least(1.0::DOUBLE, CASE WHEN n > 1000 THEN 0.9 ELSE n / 1000::DOUBLE * 0.9 END), 6) AS content_score, round(coalesce(least(1.0::DOUBLE, n / nullif(k * 1000, 0)::DOUBLE), 0.0), 6) AS efficiency, coalesce(round(n / nullif(k, 0)::DOUBLE, 2), 0.0) AS ratio FROM (SELECT doc_id, strlen(text) AS n, ceil(length(text) / 1000.0)::INT AS k FROM documents)",
)
