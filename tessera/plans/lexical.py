"""Registered queries: text search and query understanding."""

from pyspark.sql import functions as F

from tessera.functions import queries as Q
from tessera.functions import text as T
from tessera.operators import lexical as L
from tessera.operators import postings as P
from tessera.sources.storage import scratch
from tessera.sources.tables import index_block

from .registry import register

ASKED = [
    (1, "Lista de 3 motivos para o contrato", 3), (2, "Resumo em linhas", 5), (3, "the and that", 7), (4, "O que é preço e como funciona?", 8), (5, "tabela de preços dos planos 2024", 11),
    (6, "", 12), (7, "me fale", 13), (8, "capital da frança", 14), (9, "?!", 15), (10, "erst thon shat nthe of it", 16), (11, "compare versus mercado and nosso produto or 12 24 36 48 60 extra words", 17),
    (12, "cite a frase exata", 18), (13, "ththere ofs anand", 19), (14, "  Suporte ao cliente e prazo da dosagem ", 20),
]
VALUES = "(VALUES " + ", ".join(f"({i}, '{q}', {d})" for i, q, d in ASKED) + ") q(query_id, query, document_id)"


def asked(t):
    return t.frame(ASKED, "query_id int, query string, document_id long")


def per_query(columns):
    return lambda t: t.asked_texts().select("query_id", *(c.alias(n) for n, c in columns().items()))


def query_():
    return F.col("query")


STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
TOKENS = rf"list_filter(regexp_split_to_array(regexp_replace(lower({{0}}), '[^\p{{{{L}}}}\p{{{{N}}}}_\s]', ' ', 'g'), '\s+'), lambda w: (length(w) >= 2 OR regexp_matches(w, '^\d+$')) AND w NOT IN ({STOP}) AND w <> '')".replace("{{{{", "{").replace("}}}}", "}")
TOKENS = TOKENS.replace("{{", "{").replace("}}", "}")
RAW = r"regexp_extract_all(lower({0}), '\p{L}{3,}')"
PLAIN = f"list_filter(regexp_split_to_array(regexp_replace(translate(lower({{0}}), '{T.ACCENTED}', '{T.PLAIN}'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) >= 3)"
TERMS = rf"list_filter(regexp_split_to_array(regexp_replace(lower({{0}}), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+'), lambda w: strlen(w) > 2 AND w NOT IN ({STOP}) AND w <> '')".replace("{{", "{").replace("}}", "}")


def of(expr, column="query"):
    return expr.replace("{0}", column)


ALL_TOKENS = TOKENS.replace(f"w NOT IN ({STOP}) AND ", "")


def full_text_sql(chunks, k, cap=False, queries="search_queries", strict=False, scope=""):
    """SQL of the token-set search of all search queries over chunks (a query with id and content, and a scope if asked for)."""
    t = of(TOKENS)
    score = "least(score, 1.0)" if cap else "score"
    return rf"""WITH q AS (SELECT query_id{scope}, list_filter(t, lambda x, i: list_position(t, x) = i) AS tokens FROM (SELECT query_id{scope}, {t} AS t FROM {queries})),
 i AS (SELECT *, list_filter(tokens, lambda x: length(x) > 3 AND NOT regexp_matches(x, '^\d+$')) AS important FROM q),
 a AS (SELECT query_id{scope}, tokens, CASE WHEN len(tokens) <= 3 THEN tokens ELSE important END AS strict, CASE WHEN len(tokens) <= 3 THEN [] ELSE important[1:2] END AS two FROM i),
 w AS (SELECT query_id{scope}, strict, two, unnest(tokens) AS token FROM a),
 p AS (SELECT id{scope}, n, token, count(*) AS tf FROM (SELECT id{scope}, len(x) AS n, unnest(x) AS token FROM (SELECT id{scope}, {of(ALL_TOKENS, 'content')} AS x FROM ({chunks}))) GROUP BY ALL),
 h AS (SELECT query_id, id, sum(ln(1 + tf)) AS s, any_value(n) AS n, any_value(strict) AS strict, any_value(two) AS two, count(*) FILTER (WHERE list_contains(strict, token)) AS ns, count(*) FILTER (WHERE list_contains(two, token)) AS nt FROM p JOIN w USING (token{scope}) GROUP BY 1, 2),
 l AS (SELECT *, CASE WHEN len(strict) > 0 AND ns = len(strict) THEN 1 WHEN len(two) = 2 AND nt = 2 THEN 2 ELSE 3 END AS lv, round(s / (1 + ln(n)), 6) AS score FROM h),
 m AS (SELECT *, min(lv) OVER (PARTITION BY query_id) AS best FROM l),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM m WHERE lv <= best{' AND lv = 1' * strict})
 SELECT query_id, best AS level, rank, id, {score} AS score FROM r WHERE rank <= {k}"""


PLACES = "list_transform(list_filter(list_filter(terms, lambda x, i: list_position(terms, x) = i), lambda w: contains(c, w)), lambda w: strlen(split_part(c, w, 1)))"
WORD = r"CASE WHEN len(terms) = 0 THEN 0.0 ELSE list_sum(list_transform(terms, lambda w: CASE WHEN contains(c, w) THEN 1.0::DOUBLE + CASE WHEN regexp_matches(content, '(?i)(^|[.!?]\s+)' || regexp_escape(w)) THEN 0.3 ELSE 0 END + CASE WHEN regexp_matches(content, '(?im)^\s*\d+\.\s*.*' || regexp_escape(w)) THEN 0.2 ELSE 0 END ELSE 0 END)) / len(terms) END"


def strategies_sql(chunks, threshold, k, queries=VALUES, scope=""):
    """SQL of the scored text strategies over chunks; with a scope, of the chunks that share it."""
    pairs = f"JOIN a USING ({scope})" if scope else ", a"
    return rf"""WITH a AS (SELECT query_id{', ' + scope if scope else ''}, trim(lower(query)) AS q, {of(TERMS, 'trim(lower(query))')} AS terms, regexp_extract(trim(lower(query)), '(\d+)\s*motivos?', 1) AS num FROM {queries} WHERE query <> ''),
 x AS (SELECT query_id, q, terms, num, id, content, lower(content) AS c FROM ({chunks}) {pairs}), y AS (SELECT *, string_split(q, ' ') AS parts, {PLACES} AS pl FROM x),
 z AS (SELECT query_id, id, [round(CASE WHEN contains(c, q) THEN 1.0 ELSE 0.0 END::DOUBLE, 6), round(len(list_filter(parts, lambda w: contains(c, w)))::DOUBLE / len(parts) * 0.9, 6), round({WORD} * 0.8::DOUBLE, 6),
   round(CASE WHEN num = '' THEN 0.0 WHEN regexp_matches(c, num || '\s*motivos?') THEN 0.95 WHEN regexp_matches(c, '(?m)^\s*' || num || '\.\s*') THEN 0.8 ELSE 0.0 END::DOUBLE * 0.7, 6),
   round(CASE WHEN len(terms) >= 2 AND len(pl) >= 2 THEN greatest(0.0::DOUBLE, 1 - list_sum(list_transform(range(1, len(pl)), lambda i: abs(pl[i + 1] - pl[i])))::DOUBLE / (len(pl) - 1) / 1000) ELSE 0 END * 0.6, 6)] AS v FROM y),
 b AS (SELECT query_id, id, list_max(v) AS score, (['exact_phrase', 'partial_phrase', 'word_match', 'fuzzy_numbered', 'proximity'])[list_position(v, list_max(v))] AS strategy FROM z),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM b WHERE score > 0 AND score >= {threshold})
 SELECT query_id, rank, id, score, strategy FROM r WHERE rank <= {k}"""


register("D01_query_tokens", per_query(lambda: dict(tokens=F.array_join(T.query_tokens(query_()), "|"))), f"SELECT query_id, array_to_string({of(TOKENS)}, '|') AS tokens FROM asked_texts")
register("D02_raw_tokens", lambda t: t.load("documents").select("doc_id", F.size(T.raw_tokens(F.col("text"))).alias("n"), F.md5(F.array_join(T.raw_tokens(F.col("text")), " ")).alias("digest")), f"SELECT doc_id, len({of(RAW, 'text')})::INT AS n, md5(array_to_string({of(RAW, 'text')}, ' ')) AS digest FROM documents")
register("D03_plain_tokens", lambda t: t.load("documents").select("doc_id", F.size(T.plain_tokens(F.col("text"))).alias("n"), F.md5(F.array_join(T.plain_tokens(F.col("text")), " ")).alias("digest")), f"SELECT doc_id, len({of(PLAIN, 'text')})::INT AS n, md5(array_to_string({of(PLAIN, 'text')}, ' ')) AS digest FROM documents")
register("D04_search_terms", per_query(lambda: dict(terms=F.array_join(T.search_terms(query_()), "|"))), f"SELECT query_id, array_to_string({of(TERMS)}, '|') AS terms FROM asked_texts")
register("D05_search_keywords", per_query(lambda: dict(n=F.size(F.array_distinct(T.search_terms(query_()))))), f"SELECT query_id, len(list_distinct({of(TERMS)}))::INT AS n FROM asked_texts")
register(
    "D06_full_text",
    lambda t: P.scan_text(t.chunks, t.queries, 5).drop("document_id"),
    full_text_sql("SELECT id, content FROM chunks", 5),
)
register(
    "D06b_positional_index",
    lambda t: t.index.groupBy("token").agg(
        F.sum(F.size("hits")).alias("chunks"),
        F.sum(F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + F.size(h["places"]))).alias("occurrences"),
        F.round(F.max("top"), 6).alias("top"),
    ),
    f"""SELECT token, count(*) AS chunks, sum(tf)::BIGINT AS occurrences, round(max(ln(1 + tf) / (1 + ln(n))), 6) AS top FROM (
      SELECT id, n, token, count(*) AS tf FROM (SELECT id, len(x) AS n, unnest(x) AS token FROM (SELECT id, {of(ALL_TOKENS, 'content')} AS x FROM chunks))
      GROUP BY ALL) GROUP BY token""",
)


def keyword_branch(t, slug, k=50):
    """The keyword half of hybrid search within one tenant, scores held at 1."""
    found = P.scan_text(t.sliced(t.load("documents").where(F.col("source") == slug)), t.queries, k)
    return found.drop("document_id").withColumn("score", F.least("score", F.lit(1.0)))


TENANT_CHUNKS = "SELECT c.id, c.content FROM chunks c JOIN docs d ON d.id = c.document_id WHERE d.tenant_slug = '{0}'"
register("D07_keyword_branch", lambda t: keyword_branch(t, "src3"), full_text_sql(TENANT_CHUNKS.format("src3"), 50, cap=True))


def syntax_queries(t):
    """All search queries as they stand and, under ids from a million, with a phrase, an alternative and an exclusion."""
    w = T.words(F.col("query"))
    made = F.concat(F.lit('"'), F.get(w, F.lit(0)), F.lit(" "), F.get(w, F.lit(1)), F.lit('" '), F.get(w, F.lit(2)), F.lit(" OR "), F.get(w, F.lit(3)), F.lit(" -"), F.get(w, F.size(w) - 1))
    return t.queries.unionByName(t.queries.select((F.col("query_id") + 1_000_000).alias("query_id"), made.alias("query")))


register("D08_cover_rank", lambda t: P.scan_covers(t.chunks, syntax_queries(t), 10))


def clean_query():
    return T.nonempty(F.filter(T.words(F.regexp_replace(query_(), r"[^\p{L}\p{N}_\s\-'\"]", " ")), lambda w: F.length(w) >= 2))


register("D09_clean_query", per_query(lambda: dict(clean=F.array_join(clean_query(), " "))), rf"""SELECT query_id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(query, '[^\p{{L}}\p{{N}}_\s\-''"]', ' ', 'g'), '\s+'), lambda w: length(w) >= 2), ' ') AS clean FROM asked_texts""")
register("D10_like_all", lambda t: L.like_all(t.chunks, asked(t), 5), f"WITH a AS (SELECT query_id, {of(TOKENS)} AS tokens FROM {VALUES}), h AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY length(content) DESC, id)::INT AS rank FROM chunks, a WHERE len(tokens) > 0 AND len(list_filter(tokens, lambda t: NOT contains(lower(content), t))) = 0) SELECT query_id, rank, id, 1.0::DOUBLE AS score FROM h WHERE rank <= 5")
register("D11_like_some", lambda t: L.like_some(t.chunks, asked(t), F.slice(T.raw_tokens(query_()), 1, 12), 5), f"WITH a AS (SELECT query_id, {of(RAW)}[1:12] AS terms FROM {VALUES}), h AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY ord, id)::INT AS rank FROM chunks, a WHERE len(list_filter(terms, lambda t: contains(lower(content), t))) > 0), f AS (SELECT id, row_number() OVER (ORDER BY ord, id)::INT AS rank FROM chunks QUALIFY rank <= 5) SELECT query_id, rank, id FROM h WHERE rank <= 5 UNION ALL SELECT a.query_id, f.rank, f.id FROM a, f WHERE a.query_id NOT IN (SELECT query_id FROM h)")
PHRASES = [(1, "the the"), (2, "of erst"), (3, "die die"), (4, "no such phrase here")]
register("D12_phrase", lambda t: L.phrase_search(t.chunks, t.frame(PHRASES, "query_id int, query string"), 10), "SELECT query_id, rank, id, 1.0::DOUBLE AS score FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id)::INT AS rank FROM chunks, (VALUES " + ", ".join(map(str, PHRASES)) + ") q(query_id, query) WHERE contains(lower(content), query)) WHERE rank <= 10")
register("D13_text_strategies", lambda t: L.advanced_search(t.chunks, asked(t).where("query <> ''"), 0.3, 10), strategies_sql("SELECT * FROM chunks", 0.3, 10))
register("D14_word_score", lambda t: t.chunks.join(F.broadcast(asked(t)), F.lit(True)).select("query_id", "id", F.round(L.word_score(T.search_terms(query_()), F.lower("content"), F.col("content")), 6).alias("score")).where("score > 0"), f"SELECT * FROM (SELECT query_id, id, round({WORD}, 6) AS score FROM (SELECT query_id, id, content, lower(content) AS c, {of(TERMS)} AS terms FROM chunks, {VALUES})) WHERE score > 0")
register("D15_proximity", lambda t: t.chunks.join(F.broadcast(asked(t)), F.lit(True)).select("query_id", "id", F.round(L.proximity(T.search_terms(query_()), F.lower("content")), 6).alias("score")).where("score > 0"), f"WITH p AS (SELECT query_id, id, list_transform(list_filter(terms, lambda w: contains(lower(content), w)), lambda w: strlen(split_part(lower(content), w, 1))) AS s FROM chunks, (SELECT query_id, {of(TERMS)} AS terms FROM {VALUES})), r AS (SELECT query_id, id, round(greatest(0.0::DOUBLE, 1 - list_sum(list_transform(range(1, len(s)), lambda i: abs(s[i + 1] - s[i])))::DOUBLE / (len(s) - 1) / 1000), 6) AS score FROM p WHERE len(s) >= 2) SELECT * FROM r WHERE score > 0")
register("D16_numbered", lambda t: t.load("documents").select("doc_id", F.concat((F.col("doc_id") % 4).cast("string"), F.lit(". "), F.when(F.col("doc_id") % 3 == 0, F.lit("3 motivos ")).otherwise(F.lit("")), F.col("text")).alias("c")).select("doc_id", L.numbered_score(F.lit("lista 3 motivos"), F.lower("c")).alias("score")), r"SELECT doc_id, CASE WHEN regexp_matches(c, '3\s*motivos?') THEN 0.95 WHEN regexp_matches(c, '(?m)^\s*3\.\s*') THEN 0.8 ELSE 0.0 END::DOUBLE AS score FROM (SELECT doc_id, lower((doc_id % 4) || '. ' || CASE WHEN doc_id % 3 = 0 THEN '3 motivos ' ELSE '' END || text) AS c FROM documents)")
register("D17_bypass_search", lambda t: L.advanced_search(t.embedded_chunks.where("embedding IS NULL").join(t.docs.where("source = 'bypass_upload' AND tenant_slug = 'src4'").select(F.col("id").alias("document_id")), "document_id", "left_semi"), asked(t).where("query <> ''"), 0.3, 10), strategies_sql("SELECT e.id, e.content FROM embedded_chunks e JOIN docs d ON d.id = e.document_id WHERE embedding IS NULL AND d.source = 'bypass_upload' AND d.tenant_slug = 'src4'", 0.3, 10))
register("D18_pattern_cascade", lambda t: L.pattern_cascade(t.chunks, asked(t).where("query <> ''")), f"WITH p AS (SELECT query_id, id, ord, CASE WHEN regexp_matches(lower(query), '\\d+\\s*motivos?|lista|razões?|pontos?') AND (contains(lower(content), 'motivos') OR contains(lower(content), '1.') OR contains(lower(content), '2.') OR contains(lower(content), '3.')) THEN 1 WHEN len(k) > 0 AND len(list_filter(k, lambda w: NOT contains(lower(content), w))) = 0 THEN 2 WHEN contains(lower(content), lower(query)) THEN 3 END AS level FROM chunks, (SELECT *, {of(TERMS)} AS k FROM {VALUES} WHERE query <> '') q), b AS (SELECT *, min(level) OVER (PARTITION BY query_id) AS best FROM p WHERE level IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ord, id) AS rank FROM b WHERE level = best) SELECT query_id, id, ([0.9, 0.7, 0.5])[level]::DOUBLE AS score, (['numbered', 'keywords', 'phrase'])[level] AS method FROM r WHERE level = 1 OR (level = 2 AND rank <= 10) OR rank <= 5")
register("D19_expanded_terms", lambda t: L.expanded_terms(asked(t), t.chunks).select("query_id", F.size("terms").alias("n"), F.array_join(F.array_sort("terms"), "|").alias("terms")), f"WITH x AS (SELECT document_id, ord, {of(PLAIN, 'content')} AS w FROM chunks WHERE ord < 5), y AS (SELECT document_id, token, count(*) AS n, min((ord, i)) AS first FROM (SELECT document_id, ord, unnest(range(len(w))) AS i, unnest(w) AS token FROM x) GROUP BY 1, 2), z AS (SELECT document_id, list(token) AS top FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY n DESC, first) AS r FROM y) WHERE r <= 8 GROUP BY 1), q AS (SELECT query_id, document_id, {of(RAW)} AS t FROM {VALUES}), e AS (SELECT query_id, list_sort(list_distinct(t || list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) || list_transform(list_filter(t, lambda w: length(w) >= 6), lambda w: substring(w, 1, 5)) || list_transform(t, lambda w: CASE WHEN suffix(w, 's') THEN substring(w, 1, length(w) - 1) ELSE w || 's' END) || coalesce(top, []))) AS v FROM q LEFT JOIN z USING (document_id)) SELECT query_id, len(v)::INT AS n, array_to_string(v, '|') AS terms FROM e")
def expanded_sql(source, more=""):
    """SQL for (query_id, query) with synonyms, and further columns of the source."""
    found = "flatten([" + ", ".join(f"CASE WHEN contains(lower(query), '{w}') THEN {list(s)} ELSE [] END" for w, s in Q.SYNONYMS.items()) + "])"
    return f"SELECT query_id{more}, CASE WHEN len(a) > 0 THEN query || ' ' || array_to_string(a[1:3], ' ') ELSE query END AS query FROM (SELECT *, {found} AS a FROM {source})"


register("D20_synonyms", per_query(lambda: dict(expanded=Q.with_synonyms(query_()))), f"SELECT query_id, query AS expanded FROM ({expanded_sql('asked_texts')})")
register("D21_variants", per_query(lambda: dict(variants=F.array_join(Q.variants(query_()), "|"))), "SELECT query_id, array_to_string(v[1:5], '|') AS variants FROM (SELECT query_id, CASE " + " ".join(f"WHEN contains(lower(query), '{w}') THEN [query, " + ", ".join(f"replace(lower(query), '{w}', '{o}'), query || ' {o}'" for o in os) + "]" for w, os in Q.VARIANTS.items()) + f" ELSE [query] END AS v FROM asked_texts)")
def simplified_sql(source, more=""):
    """SQL for (query_id, query) of key words alone, and further columns of the source."""
    return rf"""WITH k AS (SELECT query_id, query{more}, list_filter(regexp_split_to_array(lower(query), '\s+'), lambda w: length(w) > 2 AND w NOT IN ({', '.join(repr(w) for w in Q.SIMPLE_STOP)})) AS keys FROM {source}),
      d AS (SELECT *, list_filter(keys, lambda w: regexp_matches(w, '\d')) AS digits, list_filter(keys, lambda w, i: NOT regexp_matches(w, '\d') AND list_position(keys, w) = i) AS others FROM k),
      o AS (SELECT query_id, query{more}, digits || CASE WHEN len(digits) >= 5 AND regexp_matches(keys[1], '\d') THEN [] ELSE others[1:CASE WHEN len(digits) >= 5 THEN 1 ELSE 5 - len(digits) END] END AS v FROM d)
      SELECT query_id{more}, CASE WHEN len(v) > 0 THEN array_to_string(v, ' ') ELSE query END AS query FROM o"""


register("D22_simplified", per_query(lambda: dict(simple=Q.simplified(query_()))), f"SELECT query_id, query AS simple FROM ({simplified_sql('asked_texts')})")


def asked_of_documents(t):
    """Each benchmark question, put to the document of its number."""
    return t.asked_texts().where("query_id < 1000000").withColumn("document_id", F.col("query_id"))


def fallbacks(t):
    """Only the documents that are asked are sliced and indexed; no other one can answer."""
    wordings, path = [query_(), Q.with_synonyms(query_()), Q.simplified(query_())], scratch(t.spark, "questions")
    asked_of_documents(t).write.parquet(path)  # written, so that Spark knows how few they are
    asked = t.spark.read.parquet(path)
    chunks = t.sliced(t.load("documents").join(asked.select(F.col("document_id").alias("doc_id")).distinct(), "doc_id", "left_semi"))
    path = scratch(t.spark, "asked")
    P.positional_index(chunks, index_block(F.col("document_id"))).write.parquet(path)
    return P.with_fallbacks(t.spark.read.parquet(path), index_block, chunks, asked, wordings, 5)


OF_DOCUMENTS = "SELECT query_id, query, query_id AS document_id FROM asked_texts WHERE query_id < 1000000"
IN_DOCUMENT = [full_text_sql("SELECT id, document_id, content FROM chunks", 5, queries=f"({source})", scope=", document_id") for source in (OF_DOCUMENTS, expanded_sql(f"({OF_DOCUMENTS})", ", document_id"), simplified_sql(f"({OF_DOCUMENTS})", ", document_id"))]
register(
    "D23_fallback_cascade", fallbacks,
    "WITH " + ", ".join(f"l{n} AS (SELECT query_id, {n} AS level, id FROM ({sql}))" for n, sql in enumerate(IN_DOCUMENT, 1)) + f""",
      l4 AS (SELECT query_id, 4 AS level, id FROM (SELECT *, count(*) OVER (PARTITION BY document_id) AS n FROM chunks) JOIN ({OF_DOCUMENTS}) USING (document_id) WHERE n <= 100 OR ord < 50),
      levels AS (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3 UNION ALL SELECT * FROM l4)
      SELECT query_id, level, id FROM levels QUALIFY level = min(level) OVER (PARTITION BY query_id)""",
)


def cases(table, text, default):
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({text}, '{p}')" for p in parts) + f" THEN '{name}'" for name, parts in table.items()) + f" ELSE '{default}' END"


register("D24_answer_mode", per_query(lambda: dict(auto=Q.mode(F.lit("auto"), query_()), fixed=Q.mode(F.lit("Table"), query_()), unknown=Q.mode(F.lit("x"), query_()))), f"SELECT query_id, {cases(Q.MODES, 'lower(query)', 'direct')} AS auto, 'table' AS fixed, 'direct' AS unknown FROM asked_texts")
CLASS = cases(Q.CLASSES, "lower(query)", "other")
register("D25_query_class", per_query(lambda: dict(kind=Q.query_class(query_()))), f"SELECT query_id, {CLASS} AS kind FROM asked_texts")
register("D26_grounding", per_query(lambda: dict(grounded=Q.needs_grounding(query_()))), f"SELECT query_id, {CLASS} IN ('conceptual', 'comparative') OR " + " OR ".join(f"contains(lower(query), '{w}')" for w in Q.OUTSIDE) + f" AS grounded FROM asked_texts")
register("D27_complexity", lambda t: t.asked_texts().select("query_id", Q.complexity(query_()).alias("kind")).withColumn("max_tokens", F.when(F.col("kind") == "simple", 512).when(F.col("kind") == "complex", 2048).otherwise(1024)), f"SELECT query_id, kind, CASE kind WHEN 'simple' THEN 512 WHEN 'complex' THEN 2048 ELSE 1024 END AS max_tokens FROM (SELECT query_id, CASE WHEN n <= 5 AND m <= 1 AND NOT p THEN 'simple' WHEN n > 20 OR m > 1 OR p THEN 'complex' ELSE 'moderate' END AS kind FROM (SELECT query_id, len(regexp_extract_all(query, '[A-Za-z''-]+')) AS n, length(query) - length(replace(query, '?', '')) AS m, contains(query, ' and ') OR contains(query, ' or ') AS p FROM asked_texts))")
has = lambda parts: " OR ".join(f"contains(lower(trim(query)), '{p}')" for p in parts)
register("D28_query_problems", per_query(lambda: dict(problems=F.array_join(Q.problems(query_()), "|"))), rf"SELECT query_id, CASE WHEN trim(query) = '' THEN 'empty' WHEN length(trim(query)) < 3 THEN 'short' ELSE concat_ws('|', CASE WHEN ({has(Q.GENERIC)}) AND len(list_filter(regexp_split_to_array(trim(query), '\s+'), lambda w: w <> '')) < 5 THEN 'generic' END, CASE WHEN {has(Q.SCOPE)} THEN 'out_of_scope' WHEN length(regexp_replace(query, '[^\p{{L}}\p{{N}}]', '', 'g')) < 3 THEN 'no_letters' END) END AS problems FROM asked_texts")
register("D29_document_problems", lambda t: asked(t).select(F.col("document_id") * 60).toDF("id").join(t.docs.select("id", F.lit(1).alias("there")), "id", "left").join(t.embedded_chunks.groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.count("embedding").alias("e")), "id", "left").select("id", F.when(F.col("there").isNull(), "missing").when(F.coalesce("n", F.lit(0)) == 0, "no_chunks").when(F.col("e") == 0, "no_embeddings").when(F.col("n") < 3, "few_chunks").otherwise("ok").alias("state")), f"SELECT q.document_id * 60 AS id, CASE WHEN d.id IS NULL THEN 'missing' WHEN coalesce(n, 0) = 0 THEN 'no_chunks' WHEN e = 0 THEN 'no_embeddings' WHEN n < 3 THEN 'few_chunks' ELSE 'ok' END AS state FROM {VALUES} LEFT JOIN docs d ON d.id = q.document_id * 60 LEFT JOIN (SELECT document_id, count(*) AS n, count(embedding) AS e FROM embedded_chunks GROUP BY 1) c ON c.document_id = d.id")
register("D30_clamped_parameters", lambda t: t.load("part").select("p_partkey", F.least(F.greatest(F.col("p_size") - 5, F.lit(1)), F.lit(30)).alias("top_k"), F.least(F.greatest(F.col("p_size") - 20, F.lit(0)), F.lit(10)).alias("citations"), F.least(F.greatest(F.col("p_size") - 10, F.lit(0)), F.lit(3)).alias("strictness"), F.when(F.lower("p_type").isin("plain", "markdown", "html"), F.lower("p_type")).otherwise("plain").alias("format")), "SELECT p_partkey, least(greatest(p_size - 5, 1), 30) AS top_k, least(greatest(p_size - 20, 0), 10) AS citations, least(greatest(p_size - 10, 0), 3) AS strictness, CASE WHEN lower(p_type) IN ('plain', 'markdown', 'html') THEN lower(p_type) ELSE 'plain' END AS format FROM part")
TITLES = ("Bula do remédio", "Contrato 7", "Estudo de caso", "Manual de venda", "Curso livre", "Outro")
register(
    "D31_document_type",
    lambda t: t.docs.select("id", F.get(F.array(*map(F.lit, TITLES)), F.col("id") % len(TITLES)).alias("title"))
    .join(t.chunks.where("ord < 3").groupBy(F.col("document_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_list(F.struct("ord", "content")))["content"], " ").alias("sample")), "id", "left")
    .select("id", Q.title_type(F.col("title"), F.col("sample")).alias("kind")),
    f"""SELECT id, CASE WHEN t <> '' THEN t WHEN s IS NULL THEN 'generic' ELSE {cases({k: Q.TITLE_TYPES[k] for k in ('medical', 'legal', 'academic')}, 's', 'generic')} END AS kind FROM (
      SELECT id, {cases(Q.TITLE_TYPES, 'lower(title)', '')} AS t FROM (SELECT id, ({list(TITLES)})[id % {len(TITLES)} + 1] AS title FROM docs))
      LEFT JOIN (SELECT document_id AS id, lower(string_agg(content, ' ' ORDER BY ord)) AS s FROM chunks WHERE ord < 3 GROUP BY 1) USING (id)""",
)


def best_language():
    return F.array_max(F.transform(L.language_scores(F.col("text")), lambda x: F.struct(x["score"], x["language"])))


def language_sql(name):
    """SQL of a language's score."""
    common, telling, chars = L.LANGUAGES[name]
    hits = " + ".join(rf"regexp_matches(x, '(^|[^\p{{L}}\p{{N}}_]){w}($|[^\p{{L}}\p{{N}}_])')::INT * 2" for w in common.split())
    more = " + ".join([f"contains(x, '{w}')::INT" for w in telling.split()] + [f"contains(x, '{c}')::INT * 0.5::DOUBLE" for c in chars])
    return f"({hits} + {more})::DOUBLE"


register("D32_pattern_language", lambda t: t.load("documents").select("doc_id", best_language().alias("b"), F.size(T.words(F.col("text"))).alias("n")).select("doc_id", F.least(F.lit(0.9), F.round(F.col("b.score") / F.greatest(F.col("n") / 10, F.lit(10.0)), 6)).alias("confidence"), F.col("b.language").alias("language")).withColumn("language", F.when(F.col("confidence") >= 0.3, F.col("language")).otherwise("unknown")), rf"WITH s AS (SELECT doc_id, n, unnest([{', '.join(map(language_sql, L.LANGUAGES))}]) AS score, unnest({list(L.LANGUAGES)}) AS language FROM (SELECT doc_id, lower(text) AS x, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS n FROM documents)), b AS (SELECT doc_id, any_value(n) AS n, max(score) AS score, arg_max(language, (score, language)) AS language FROM s GROUP BY 1), c AS (SELECT doc_id, least(0.9::DOUBLE, round(score / greatest(0.1 * n, 10), 6)) AS confidence, language FROM b) SELECT doc_id, confidence, CASE WHEN confidence >= 0.3 THEN language ELSE 'unknown' END AS language FROM c")


def cleaned_sql(text):
    """SQL of a text without what tells nothing of its language."""
    for pattern, instead in L.CLEANING:
        text = f"regexp_replace({text}, '{pattern}', '{instead}', 'g')"
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


#: Every third document is cut to its first characters, so that some texts are too short to tell.
SAMPLE = "CASE doc_id % 3 WHEN 0 THEN substring(text, 1, doc_id % 20) ELSE text END"
register(
    "D32b_cleaned_language",
    lambda t: L.told_languages(t.load("documents").withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.substring(F.col("text"), F.lit(1), (F.col("doc_id") % 20).cast("int"))).otherwise(F.col("text"))), "doc_id", "text"),
    rf"""WITH x AS (SELECT doc_id, {cleaned_sql(f'coalesce({SAMPLE}, chr(32))')} AS clean, coalesce({SAMPLE}, '') AS raw FROM documents),
      s AS (SELECT doc_id, unnest([{', '.join(map(language_sql, L.LANGUAGES))}]) AS score, unnest({list(L.LANGUAGES)}) AS language FROM (SELECT doc_id, lower(clean) AS x FROM x)),
      b AS (SELECT doc_id, max(score) AS score, arg_max(language, (score, language)) AS language FROM s GROUP BY 1),
      c AS (SELECT doc_id, language, CASE WHEN regexp_replace(raw, '\s', '', 'g') = '' THEN 'no_text' WHEN length(clean) < 10 THEN 'insufficient_text' ELSE 'patterns' END AS method,
        least(0.9::DOUBLE, round(score / greatest(0.1 * len(list_filter(regexp_split_to_array(clean, '\s+'), lambda w: w <> '')), 10), 6)) AS sure FROM b JOIN x USING (doc_id))
      SELECT doc_id, method, CASE WHEN method = 'patterns' THEN sure ELSE 0.0 END::DOUBLE AS confidence, CASE WHEN method = 'patterns' AND sure >= 0.3 THEN language ELSE 'unknown' END AS language FROM c""",
)
pad = "lower(substring(text, 1, 1000))"
counts = lambda ws: " + ".join(f"(length({pad}) - length(replace({pad}, ' {w} ', ''))) / {len(w) + 2}" for w in ws)
register("D33_two_languages", lambda t: t.load("documents").select("doc_id", L.two_languages(F.col("text")).alias("language")), f"SELECT doc_id, CASE WHEN p > e THEN 'pt' WHEN e > p THEN 'en' ELSE 'unknown' END AS language FROM (SELECT doc_id, {counts(L.PT_WORDS)} AS p, {counts(L.EN_WORDS)} AS e FROM documents)")
region = lambda base: "CASE WHEN " + " + ".join(f"contains(lower(text), '{w}')::INT" for w in L.REGIONS[base][1].split()) + " > " + " + ".join(f"contains(lower(text), '{w}')::INT" for w in L.REGIONS[base][0].split()) + f" THEN '{L.REGIONS[base][3]}' ELSE '{L.REGIONS[base][2]}' END"
register("D34_regional_variant", lambda t: t.load("documents").select("doc_id", L.regional(F.col("lang"), F.col("text")).alias("variant")), f"SELECT doc_id, CASE lang WHEN 'pt' THEN {region('pt')} WHEN 'es' THEN {region('es')} WHEN 'en' THEN {region('en')} ELSE lang END AS variant FROM documents")
PLANROWS = [(k, *v) for k, v in Q.PLAN_SETTINGS.items()]
register("D35_plan_parameters", lambda t: t.users.select("id", F.element_at(F.array(*map(F.lit, ("free", "pro", "enterprise", "trial"))), (F.col("id") % 4 + 1).cast("int")).alias("plan")).join(F.broadcast(t.frame(PLANROWS, "plan string, top_k int, threshold double, rerank boolean, max_tokens int")), "plan", "left").select("id", F.coalesce("top_k", F.lit(5)).alias("top_k"), F.coalesce("threshold", F.lit(0.08)).alias("threshold"), F.coalesce("rerank", F.lit(False)).alias("rerank"), F.coalesce("max_tokens", F.lit(1024)).alias("max_tokens")), "SELECT id, CASE p WHEN 'enterprise' THEN 15 WHEN 'pro' THEN 10 ELSE 5 END AS top_k, CASE p WHEN 'enterprise' THEN 0.03 WHEN 'pro' THEN 0.05 ELSE 0.08 END::DOUBLE AS threshold, p IN ('enterprise', 'pro') AS rerank, CASE p WHEN 'enterprise' THEN 4096 WHEN 'pro' THEN 2048 ELSE 1024 END AS max_tokens FROM (SELECT id, (['free', 'pro', 'enterprise', 'trial'])[id % 4 + 1] AS p FROM users)")
register("D36_resolved_document", lambda t: t.docs.agg(F.max(F.when(F.col("id") == 7, F.col("id"))).alias("by_id"), F.max_by("id", F.when(F.col("title").contains("Document 1"), F.struct("created_at", "id"))).alias("by_title"), F.max_by("id", F.struct("created_at", "id")).alias("newest")), "SELECT max(id) FILTER (WHERE id = 7) AS by_id, arg_max(id, (created_at, id)) FILTER (WHERE contains(title, 'Document 1')) AS by_title, arg_max(id, (created_at, id)) AS newest FROM docs")
register("D37_preferred_document", lambda t: L.top_per(t.docs, ["tenant_slug"], 1, F.when(F.col("source").isin("bypass_upload", "enterprise"), 0).otherwise(1), F.desc("created_at"), F.desc("id")).select("tenant_slug", "id"), "SELECT tenant_slug, id FROM docs QUALIFY row_number() OVER (PARTITION BY tenant_slug ORDER BY CASE WHEN source IN ('bypass_upload', 'enterprise') THEN 0 ELSE 1 END, created_at DESC, id DESC) = 1")
register("D38_user_search", lambda t: t.users.where((F.contains(F.lower("name"), F.lit("00")) | F.contains("email", F.lit("00"))) & ~F.col("is_admin")).join(t.subscriptions.where("status = 'active'").select(F.col("user_id").alias("id")), "id", "left_semi").orderBy("id").offset(20).limit(20).select("id", "name"), "SELECT id, name FROM users u WHERE (contains(lower(name), '00') OR contains(email, '00')) AND NOT is_admin AND EXISTS (SELECT 1 FROM subscriptions s WHERE s.user_id = u.id AND status = 'active') ORDER BY id LIMIT 20 OFFSET 20")
