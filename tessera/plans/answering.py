"""Registered queries: extractive answering."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import answering as A

from .fusion import texts, vector_branch
from .lexical import of
from .registry import register
from .vectors import search_sql


def rows_():
    return F.count(F.lit(1))


def content():
    return F.col("content")
#: Four short documents, one for each answer mode: summary, list, quote, table.
FIXTURES = [
    (9001, 0, "The first plan covers storage and retrieval. It was approved in March. Costs stay flat."), (9001, 1, "The second plan adds search. It starts in June."), (9002, 0, "1. Collect\n2. Clean\n3. Split\n4. Embed\n5. Store"),
    (9003, 0, "The chair said “we keep every promise” at the end."), (9004, 0, "Name: Alpha\nPrice: 10 | net\nTerm: 12 months"),
]


def best(t):
    """(query_id, document_id, best): the ord of each query's most similar chunk, the first on ties."""
    top = vector_branch(t, 5).join(t.chunks.select("id", "ord"), "id")
    return top.groupBy("query_id").agg(F.max_by(F.struct("document_id", "ord"), F.struct("similarity", -F.col("id"))).alias("b")).select("query_id", "b.document_id", F.col("b.ord").alias("best"))


VEC = search_sql("SELECT * FROM embedded_chunks", k=5, threshold=0.05)
BEST = f"SELECT query_id, arg_max(c.document_id, (similarity, -v.id)) AS document_id, arg_max(c.ord, (similarity, -v.id)) AS best FROM ({VEC}) v JOIN chunks c ON c.id = v.id GROUP BY 1"


def window(t, mode):
    return A.ord_window(t.chunks, best(t), *A.WINDOWS[mode])


for m, (before, after) in A.WINDOWS.items():
    register(f"F01_window_{m}", lambda t, m=m: window(t, m).select("query_id", "id"), f"SELECT query_id, c.id FROM chunks c JOIN ({BEST}) b ON c.document_id = b.document_id AND c.ord BETWEEN b.best - {before} AND b.best + {after}")
TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
HYPHEN = r"regexp_replace({0}, '([A-Za-zÀ-ÿ])-[ \t]*\n\s*([A-Za-zÀ-ÿ])', '\1\2', 'g')"
FIX = r"regexp_replace(regexp_replace(" + HYPHEN + r", '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
register("F02_combined_chunks", lambda t: A.combined(t.chunks, ["document_id"]).select("document_id", F.md5("text").alias("digest")), rf"SELECT document_id, md5(regexp_replace(string_agg({of(FIX, 'content')}, chr(10) ORDER BY ord), '^\s+|\s+$', '', 'g')) AS digest FROM chunks GROUP BY 1")
register("F03_repaired_text", lambda t: t.load("documents").select("doc_id", F.md5(A.repaired(F.regexp_replace("text", "(?<=[a-z])\n", "-\n"))).alias("flat"), F.md5(A.repaired_lines(F.col("text"))).alias("lines")), rf"SELECT doc_id, md5({of(FIX, chr(114) + 'egexp_replace(text, ' + chr(39) + '([a-z])' + chr(92) + 'n' + chr(39) + ', ' + chr(39) + chr(92) + '1-' + chr(39) + ' || chr(10), ' + chr(39) + 'g' + chr(39) + ')')}) AS flat, md5(regexp_replace(regexp_replace(regexp_replace({of(HYPHEN, 'text')}, '[ \t]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS lines FROM documents")
SENT = r"""list_filter(list_transform(string_split(regexp_replace({0}, '([.!?”"])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"""
register("F04_sentences", lambda t: t.load("documents").select("doc_id", F.size(A.split_sentences(F.col("text"))).alias("n"), F.md5(F.array_join(A.split_sentences(F.col("text")), "|")).alias("digest")), f"SELECT doc_id, len({of(SENT, 'text')})::INT AS n, md5(array_to_string({of(SENT, 'text')}, '|')) AS digest FROM documents")
register("F04b_loose_sentences", lambda t: t.load("documents").select("doc_id", F.posexplode(A.loose_sentences(F.col("text"))).alias("pos", "sentence")).select("doc_id", "pos", F.md5("sentence").alias("digest")), rf"WITH b AS (SELECT doc_id, list_transform(list_filter(list_transform(regexp_split_to_array(text, '\n+'), lambda x: {of(TRIM, 'x')}), lambda x: x <> ''), lambda x: regexp_replace(x, '^\s*(?:[-–—*•]\s+|\d{{1,3}}[.)\-]\s+)', '')) AS l FROM documents), s AS (SELECT doc_id, flatten(list_transform(l, lambda y: {of(SENT, 'y')})) AS v FROM b) SELECT doc_id, unnest(range(len(v)))::INT AS pos, unnest(list_transform(v, lambda x: md5(x))) AS digest FROM s")
register("F05_best_sentence", lambda t: A.best_sentence(A.combined(window(t, "direct"), ["query_id"]).join(texts(t), "query_id")))
register("F06_extractive_summary", lambda t: A.combined(t.chunks, ["document_id"]).select("document_id", *(F.md5(A.summary(F.col("text"), n)).alias(n) for n in A.SUMMARY_SENTENCES)), rf"WITH c AS (SELECT document_id, regexp_replace(string_agg({of(FIX, 'content')}, chr(10) ORDER BY ord), '^\s+|\s+$', '', 'g') AS text FROM chunks GROUP BY 1), s AS (SELECT document_id, {of(SENT, 'text')} AS s FROM c) SELECT document_id, " + ", ".join(f"md5(CASE WHEN len(s) > 0 THEN array_to_string(s[1:{n}], ' ') ELSE '{A.NOTHING}' END) AS {k}" for k, n in A.SUMMARY_SENTENCES.items()) + " FROM s")


def numbered():
    return F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.concat((i % 7 + 1).cast("string"), F.lit(") "), x)), "\n")


LINES = "SELECT doc_id, unnest(range(len(x))) AS pos, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)"
register("F07_numbered_lines", lambda t: A.numbered_lines(t.load("documents").withColumn("text", numbered()), "doc_id", "text"), rf"WITH l AS (SELECT doc_id, pos, (pos % 7 + 1)::INT AS number, {of(TRIM, 'line')} AS v FROM ({LINES})), m AS (SELECT doc_id, number, trim(regexp_replace(arg_max(v, pos), '\s+', ' ', 'g'), ' -–—') AS item FROM l WHERE v <> '' GROUP BY 1, 2) SELECT * FROM m WHERE item <> ''")


def inline(t):
    items = F.udf(A.numbered_items, "array<struct<number:int,item:string>>", useArrow=True)
    return t.chunks.select("id", F.explode(items("content")).alias("i")).select("id", "i.*")


register("F07b_inline_numbers", inline)


def pairs():
    return F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit("Key "), (i % 5).cast("string"), F.lit(": "), x)), "\n")


KV = rf"SELECT doc_id, 'Key ' || pos % 5 AS name, arg_max({of(TRIM, 'line')}, pos) AS value, max(pos)::INT AS pos FROM ({LINES}) WHERE {of(TRIM, 'line')} <> '' GROUP BY 1, 2"
register("F08_key_values", lambda t: A.key_values(t.load("documents").withColumn("text", pairs()), "doc_id", "text"), KV)


def said():
    return F.when(F.col("document_id") % 3 == 0, F.concat(F.lit("a “"), F.substring_index("content", "\n", 1), F.lit("” b"))).when(F.col("document_id") % 3 == 1, content()).otherwise("")


register("F09_quote", lambda t: t.chunks.select("id", F.md5(A.quote(said())).alias("digest")), rf"WITH c AS (SELECT id, CASE document_id % 3 WHEN 0 THEN 'a “' || split_part(content, chr(10), 1) || '” b' WHEN 1 THEN content ELSE '' END AS t FROM chunks), q AS (SELECT id, {of(TRIM, "regexp_extract(t, '[“" + chr(34) + "]([^\n]*?)[”" + chr(34) + "]', 1)")} AS a, coalesce(({of(SENT, 't')})[1], '') AS b, {of(TRIM, 'substring(t, 1, 220)')} AS c FROM c) SELECT id, md5('“' || CASE WHEN a <> '' THEN a WHEN b <> '' THEN b WHEN c <> '' THEN c ELSE '{A.NO_QUOTE}' END || '”') AS digest FROM q")
register("F10_best_chunk", best, BEST)
register("F11_list_cut", lambda t: t.load("documents").select("doc_id", *(F.size(F.slice(F.split("text", "\n"), 1, n)).alias(k) for k, n in A.LIST_ITEMS.items())), "SELECT doc_id, least(6, n)::INT AS short, least(15, n)::INT AS medium FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents)")


def rendered(t):
    items = F.slice(F.split("text", "\n"), 1, 6)
    table = F.transform(F.slice(F.split("text", "\n"), 1, 4), lambda x, i: F.struct(F.concat(F.lit("k|"), i.cast("string")).alias("name"), x.alias("value")))
    return t.load("documents").select("doc_id", *(F.md5(A.rendered_list(items, f)).alias(f"list_{f}") for f in ("html", "plain")), *(F.md5(A.rendered_table(table, f)).alias(f"table_{f}") for f in ("html", "markdown", "plain")), F.md5(A.rendered_text(F.col("text"), "html")).alias("text_html"))


ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;')"
NL = "chr(10)"
register(
    "F12_rendering", rendered,
    f"WITH d AS (SELECT doc_id, text, string_split(text, {NL})[1:6] AS i, string_split(text, {NL})[1:4] AS v FROM documents) SELECT doc_id, md5('<ol>' || {NL} || array_to_string(list_transform(i, lambda x: '<li>' || {of(ESC, 'x')} || '</li>'), {NL}) || {NL} || '</ol>') AS list_html, md5(array_to_string(list_transform(i, lambda x, n: n || '. ' || x), {NL})) AS list_plain, "
    f"md5('<table>' || {NL} || array_to_string(list_transform(v, lambda x, n: '<tr><th>k|' || (n - 1) || '</th><td>' || {of(ESC, 'x')} || '</td></tr>'), {NL}) || {NL} || '</table>') AS table_html, md5('| Chave | Valor |' || {NL} || '|---|---|' || {NL} || array_to_string(list_transform(v, lambda x, n: '| k\\|' || (n - 1) || ' | ' || replace(x, '|', '\\|') || ' |'), {NL})) AS table_markdown, md5(array_to_string(list_transform(v, lambda x, n: 'k|' || (n - 1) || ': ' || x), {NL})) AS table_plain, "
    rf"md5(array_to_string(list_transform(list_filter(string_split({of(TRIM, 'text')}, {NL}), lambda x: x <> ''), lambda x: '<p>' || {of(ESC, 'x')} || '</p>'), {NL})) AS text_html FROM d",
)
register("F13_window_citations", lambda t: window(t, "list").withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("ord"))).where("n <= 3").select("query_id", "document_id", "ord"), f"SELECT query_id, document_id, ord FROM (SELECT query_id, c.document_id, ord, row_number() OVER (PARTITION BY query_id ORDER BY ord) AS n FROM chunks c JOIN ({BEST}) b ON c.document_id = b.document_id AND c.ord BETWEEN b.best - 2 AND b.best + 40) WHERE n <= 3")
register("F14_guards", lambda t: t.load("documents").select("doc_id", F.size(F.split("text", "\n")).alias("n")).select("doc_id", F.when(F.col("n") < 3, "summary").otherwise("list").alias("list_mode"), F.when(F.col("n") < 2, "direct").otherwise("table").alias("table_mode")), "SELECT doc_id, CASE WHEN n < 3 THEN 'summary' ELSE 'list' END AS list_mode, CASE WHEN n < 2 THEN 'direct' ELSE 'table' END AS table_mode FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents)")
bulleted = lambda t: t.load("documents").select(F.col("doc_id").alias("document_id"), F.posexplode(A.loose_sentences(F.col("text"))).alias("ord", "text"))
register("F15_bullet_candidates", lambda t: A.bullet_candidates(bulleted(t)).select("document_id", "ord", F.md5("text").alias("digest"), "score"))
STOP = ", ".join(f"'{w}'" for w in sorted(A.BULLET_STOP))
TOK = rf"list_filter(regexp_split_to_array(regexp_replace(lower(content), '[^\p{{L}}\p{{N}}\s]+', ' ', 'g'), '\s+'), lambda w: w <> '' AND w NOT IN ({STOP}))"
register("F16_sentence_score", lambda t: t.chunks.select("id", F.round(A.sentence_score(content()), 6).alias("score")), f"SELECT id, round(len(list_filter(t, lambda w: " + " OR ".join(f"contains(w, '{k}')" for k in A.SCORE_WORDS) + f")) + least(len(t), 30) / 30.0::DOUBLE, 6) AS score FROM (SELECT id, {TOK} AS t FROM chunks)")
LOOK = "certificado(?! de an[aá]lise)"
TOPIC = "CASE " + " ".join(
    f"WHEN regexp_matches(t, '{p.replace('|' + LOOK, '')}')" + (" OR len(regexp_extract_all(t, 'certificado')) > len(regexp_extract_all(t, 'certificado de an[aá]lise'))" if LOOK in p else "") + f" THEN '{k}'" for k, p in A.TOPICS
) + " ELSE 'misc' END"
register("F17_topic", lambda t: t.chunks.select("id", A.topic(content()).alias("topic")).groupBy("topic").agg(rows_().alias("n")), f"SELECT {TOPIC} AS topic, count(*) AS n FROM (SELECT lower(content) AS t FROM chunks) GROUP BY 1")


def answered(t):
    """Each query's answer in its own mode, rendered as plain text, from the window around its best chunk."""
    asked = texts(t).withColumn("mode", F.get(F.array(*map(F.lit, ("direct", "list", "table", "quote", "summary"))), F.floor(F.col("query_id") / 100) % 5))
    out = None
    for mode in ("direct", "list", "table", "quote", "summary"):
        rows = A.combined(window(t, mode if mode in A.WINDOWS else "direct"), ["query_id"], A.repaired_lines).join(asked.where(F.col("mode") == mode), "query_id")
        if mode == "direct":
            part = A.best_sentence(rows)
        elif mode == "list":
            part = A.numbered_lines(rows, "query_id", "text").groupBy("query_id").agg(A.rendered_list(F.transform(F.sort_array(F.collect_list(F.struct("number", "item"))), lambda x: x["item"]), "plain").alias("answer"))
            part = rows.join(part, "query_id", "left").select("query_id", F.coalesce("answer", A.summary(F.col("text"), "auto")).alias("answer"))
        elif mode == "table":
            part = A.key_values(rows, "query_id", "text").groupBy("query_id").agg(A.rendered_table(F.sort_array(F.collect_list(F.struct("pos", "name", "value"))), "plain").alias("answer"))
            part = rows.join(part, "query_id", "left").select("query_id", F.coalesce("answer", A.summary(F.col("text"), "auto")).alias("answer"))
        else:
            part = rows.select("query_id", (A.quote(F.col("text")) if mode == "quote" else A.summary(F.col("text"), "medium")).alias("answer"))
        part = part.withColumn("mode", F.lit(mode))
        out = part if out is None else out.unionByName(part)
    return out


register("F18_answers", answered)
register("F19_video_context", lambda t: t.chunks.withColumn("all", F.sum(F.octet_length("content")).over(Window.partitionBy("document_id"))).where("all <= 20000 OR ord < 15").groupBy("document_id").agg(rows_().alias("chunks"), F.sum(F.octet_length("content")).alias("bytes")), "SELECT document_id, count(*) AS chunks, sum(strlen(content))::BIGINT AS bytes FROM (SELECT *, sum(strlen(content)) OVER (PARTITION BY document_id) AS a FROM chunks) WHERE a <= 20000 OR ord < 15 GROUP BY 1")
register("F20_hints", lambda t: A.hints(t.chunks), r"WITH f AS (SELECT document_id, ord, list_filter(regexp_split_to_array(content, '\s+'), lambda w: w <> '') AS a, list_filter(regexp_split_to_array(substring(content, 1, 200), '\s+'), lambda w: length(w) > 4) AS w FROM chunks WHERE ord < 5), u AS (SELECT document_id, w, min((ord, i)) AS first FROM (SELECT document_id, ord, unnest(range(len(w))) AS i, unnest(w) AS w FROM f) GROUP BY 1, 2), h AS (SELECT document_id, string_agg(w, ' ' ORDER BY first) AS hints FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY first) AS n FROM u) WHERE n <= 8 GROUP BY 1) SELECT f.document_id, sum(len(a))::BIGINT AS words, coalesce(any_value(hints), '') AS hints FROM f LEFT JOIN h USING (document_id) GROUP BY 1")
register("F21_display_cut", lambda t: vector_branch(t, 5).withColumn("shown", F.get(F.array(*map(F.lit, (5, 3, 2, 5, 3))), F.floor(F.col("query_id") / 100) % 5)).where("rank <= shown").select("query_id", "rank", F.concat(F.format_number(F.col("similarity") * 100, 1), F.lit("%")).alias("share")), f"SELECT query_id, rank, printf('%.1f', similarity * 100) || '%' AS share FROM ({VEC}) WHERE rank <= ([5, 3, 2, 5, 3])[(query_id // 100) % 5 + 1]")
