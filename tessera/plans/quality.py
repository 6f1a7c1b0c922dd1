"""Registered queries: quality and structure of documents."""

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import advice as D
from tessera.operators import quality as G

from .registry import register


def rows_():
    return F.count(F.lit(1))


def text_():
    return F.col("text")
#: Lines of every document with marks of structure put in, so that all rules have something to find.
MARKS = ["1. ", "- ", "# Results ", "", "a) ", "àé &amp; ", "x | y | ", "[3] (2) ", "> said ", ""]


def marked():
    return F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.element_at(F.array(*map(F.lit, MARKS)), i % 10 + 1), x)), "\n")


MARKED_SQL = "SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: (" + str(MARKS) + ")[(i - 1) % 10 + 1] || x), chr(10)) AS text FROM documents"


def docs(t):
    return t.load("documents").withColumn("text", marked())


def kind(column="doc_id"):
    return F.element_at(F.array(*map(F.lit, ("pdf", "docx", "html", "csv", "txt"))), (F.col(column) % 5 + 1).cast("int"))


def n(pattern, column="text"):
    """SQL for the number of matches of a pattern."""
    return f"len(regexp_extract_all({column}, '{pattern}'))::INT"


TRIM = r"regexp_replace(x, '^\s+|\s+$', '', 'g')"
WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"


def steps(x, table):
    return "CASE " + " ".join(f"WHEN {x} > {a} THEN {b}" for a, b in table) + " ELSE 0 END"


def pts(test, k):
    return f"CASE WHEN {test} THEN {k} ELSE 0 END"


def m(pattern):
    return f"regexp_matches(text, '{pattern}')"


STRUCT = " + ".join(pts(m(p), k) for p, k in ((r"\n\s*\n", 5), (r"[.!?]\s+[A-Z]", 5), (r"(?m)^\s*\d+\.?\s+", 3), (r"(?m)^\s*[•\-*]\s+", 3), ("===.*===", 4), (r"Title:|H\d+:", 5)))
COMMON = " + ".join(f"contains(lower(text), '{w}')::INT" for w in G.COMMON)
SCORE = (
    rf"""SELECT doc_id, c, least(greatest(CASE WHEN c > 1000 THEN 30 WHEN c > 500 THEN 20 WHEN c > 100 THEN 10 WHEN c > 0 THEN 5 ELSE 0 END + {steps('w', ((200, 20), (100, 15), (50, 10), (10, 5)))} + least({STRUCT}, 25) + least({steps(n('[a-zA-Z]') + ' / greatest(c, 1)::DOUBLE', ((0.7, 8), (0.5, 5), (0.3, 2)))} + {steps('(' + COMMON + ')', ((4, 7), (1, 3)))}, 15)
 - least({pts(m(r'[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]'), 5)} + {pts(n(r'[^\p{L}\p{N}_\s.,!?\-()\[\]{}' + chr(39) * 2 + r'"\\/:;]') + ' > c * 0.1', 3)} + {pts("(c - length(replace(text, '?', ''))) > c * 0.05", 2)}, 10)
 + least(CASE k WHEN 'pdf' THEN {pts("contains(text, '|')", 3)} + {pts(m(r'Page \d+'), 2)} WHEN 'docx' THEN {pts("contains(text, '|')", 3)} + {pts(m('===.*==='), 2)} WHEN 'html' THEN {pts("contains(text, 'Title:')", 3)} + {pts(m(r'H\d+:'), 3)} + {pts("contains(text, '•')", 2)} WHEN 'csv' THEN {pts("contains(text, '|')", 5)} ELSE 0 END, 10), 0), 100)::INT AS score
 FROM (SELECT doc_id, text, length(text) AS c, len({WORDS}) AS w, (['pdf', 'docx', 'html', 'csv', 'txt'])[doc_id % 5 + 1] AS k FROM ({MARKED_SQL}))"""
)
register(
    "G01_quality_score",
    lambda t: docs(t).select("doc_id", F.length("text").alias("c"), G.quality_score(text_(), kind()).alias("score")).select("doc_id", "score", G.rating(F.col("score")).alias("rating"), G.success_rate(F.col("score"), F.col("c"), F.lit(3)).alias("success")),
    f"SELECT doc_id, score, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 70 THEN 'good' ELSE 'poor' END AS rating, round(least(100.0::DOUBLE, greatest(1, least(3, c // 2000)) / 3::DOUBLE * score), 1) AS success FROM ({SCORE})",
)
register(
    "G02_structure_counts", lambda t: docs(t).select("doc_id", *(c.alias(k) for k, c in G.structure_counts(text_()).items())),
    rf"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\n\s*\n'), lambda x: {TRIM} <> ''))::INT AS paragraphs, {n(r'[.!?]+(?:\s+|$)')} AS sentences, {n(r'(?m)^\s*\d+\.?\s+')} AS numbered, {n(r'(?m)^\s*[•\-*]\s+')} AS bulleted, {n('===.*===')} + {n(r'Title:|H\d+:')} AS headers, len(list_filter(string_split(text, chr(10)), lambda x: length(x) - length(replace(x, '|', '')) >= 2))::INT AS table_rows FROM ({MARKED_SQL})",
)
LENS = rf"list_transform({WORDS}, lambda w: length(trim(w, '.,!?;:()[]{{}}\"''-')))"
register(
    "G03_content_metrics", lambda t: docs(t).select("doc_id", *(c.alias(k) for k, c in G.content_metrics(text_()).items())),
    rf"SELECT doc_id, round({n(r'\p{L}')} / greatest(length(text), 1)::DOUBLE, 6) AS alphabetic, round({n(r'\p{Nd}')} / greatest(length(text), 1)::DOUBLE, 6) AS numeric, round({n(r'\s')} / greatest(length(text), 1)::DOUBLE, 6) AS whitespace, round(list_sum(l) / len(l)::DOUBLE, 6) AS word_mean, list_max(l)::INT AS word_max, list_min(l)::INT AS word_min FROM (SELECT *, {LENS} AS l FROM ({MARKED_SQL}))",
)
register("G04_encoding_issues", lambda t: docs(t).select("doc_id", T.times(text_(), "�").alias("replacements"), ((F.length("text") - F.length(F.replace(text_(), F.lit("?"), F.lit("")))) / F.greatest(F.length("text"), F.lit(1)) > 0.05).alias("many_marks")), f"SELECT doc_id, {n('�')} AS replacements, (length(text) - length(replace(text, '?', ''))) / greatest(length(text), 1) > 0.05 AS many_marks FROM ({MARKED_SQL})")
register(
    "G05_density", lambda t: docs(t).select("doc_id", *(c.alias(k) for k, c in G.density(text_()).items())),
    rf"SELECT doc_id, len(x)::INT AS lines, (len(x) - len(f))::INT AS empty, round((len(x) - len(f)) / len(x)::DOUBLE, 6) AS empty_ratio, round(list_sum(list_transform(x, lambda s: length(s))) / len(x)::DOUBLE, 6) AS mean_line, round(coalesce(list_sum(list_transform(f, lambda s: length(s))), 0) / greatest(len(f), 1)::DOUBLE, 6) AS mean_full_line FROM (SELECT doc_id, string_split(text, chr(10)) AS x, list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '\S')) AS f FROM ({MARKED_SQL}))",
)
found = lambda t: G.headers(docs(t), "doc_id", "text")
secs = lambda t: G.sections(docs(t), found(t), "doc_id", "text")
elements = lambda t: docs(t).select(F.col("doc_id").alias("document_id"), *(c.alias(k) for k, c in G.content_elements(text_()).items()), G.structure_counts(text_())["paragraphs"].alias("paragraphs"), F.size(T.words(text_())).alias("words"))
def stripped(x):
    """SQL of a text without white space at its ends."""
    return r"regexp_replace({0}, '^\s+|\s+$', '', 'g')".replace("{0}", x)


def header_case(value):
    """SQL CASE over the kinds of headers in their order; value(kind, pattern, title, confidence) gives each one's SQL."""
    out = []
    for kind, pattern, group, sure in G.HEADERS:
        title = stripped(f"regexp_extract(s, '{pattern}', {group})")
        fine = f"length({title}) BETWEEN 2 AND 200 AND {n(ODD, title)} <= length({title}) * 0.3 AND {n(DIGIT, title)} <= length({title}) * 0.5"
        out.append(f"WHEN regexp_matches(s, '{pattern}') AND {fine} THEN {value(kind, pattern, title, sure)}")
    return "CASE " + " ".join(out) + " END"


ODD, DIGIT = r"[^\p{L}\p{N}_\s]", r"\d"
LEVEL = {"numbered": lambda p: f"len(string_split(regexp_extract(s, '{p}', 1), '.'))", "markdown": lambda p: f"length(regexp_extract(s, '{p}', 1))", "caps": lambda _: "2", "title_case": lambda _: "3", "decorated": lambda _: "1"}
HEADERS = f"""hl AS (SELECT doc_id AS document_id, unnest(range(len(x)))::INT AS line, unnest(x) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM ({MARKED_SQL}))),
 hs AS (SELECT *, {stripped('raw')} AS s, coalesce(sum(length(raw) + 1) OVER (PARTITION BY document_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start FROM hl),
 hk AS (SELECT *, {header_case(lambda k, p, t, c: f"'{k}'")} AS kind, {header_case(lambda k, p, t, c: t)} AS title, {header_case(lambda k, p, t, c: LEVEL.get(k, lambda _: '2')(p))} AS lv, {header_case(lambda k, p, t, c: f'{c}::DOUBLE')} AS sure FROM hs WHERE s <> ''),
 hf AS (SELECT *, min(line) OVER (PARTITION BY document_id, lv) AS f FROM hk WHERE kind IS NOT NULL),
 headers AS (SELECT document_id, line, start, kind, dense_rank() OVER (PARTITION BY document_id ORDER BY f)::INT AS level, title, round(sure * CASE WHEN length(s) > 100 THEN 0.8 ELSE 1 END * CASE WHEN regexp_matches(s, '[.!?]$') THEN 0.7 ELSE 1 END, 6) AS confidence FROM hf)"""
TYPES = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(coalesce(title, '')), '{w}')" for w in ws) + f" THEN '{k}'" for k, ws in G.SECTION_TYPES.items()) + " ELSE 'main_content' END"
SECTIONS = rf"""{HEADERS}, sp AS (SELECT *, lead(start) OVER w AS stop, row_number() OVER w AS number FROM headers WINDOW w AS (PARTITION BY document_id ORDER BY start)),
 sj AS (SELECT d.doc_id AS document_id, d.text, coalesce(number, 1)::INT AS number, coalesce(level, 1) AS level, title, coalesce(start, 0) AS start, coalesce(stop, length(text))::INT AS stop FROM ({MARKED_SQL}) d LEFT JOIN sp ON sp.document_id = d.doc_id),
 sections AS (SELECT document_id, number, level, coalesce(title, 'Document Content') AS title, {TYPES} AS type, start, stop, len(list_filter(regexp_split_to_array(substring(text, start + 1, stop - start), '\s+'), lambda w: w <> ''))::INT AS words FROM sj)"""
BALANCE = "SELECT document_id, count(*) AS depth, round(1 / (1 + var_pop(n) / avg(n)), 6) AS balance FROM (SELECT document_id, level, count(*) AS n FROM sections GROUP BY 1, 2) GROUP BY 1"
register("G06_headers", found, f"WITH {HEADERS} SELECT * FROM headers")
register("G07_sections", secs, f"WITH {SECTIONS} SELECT * FROM sections")
register("G08_hierarchy", lambda t: G.parents(secs(t)).select("document_id", "number", "level", "parent"), f"WITH {SECTIONS} SELECT s.document_id, s.number, s.level, max(p.number) AS parent FROM sections s LEFT JOIN sections p ON p.document_id = s.document_id AND p.number < s.number AND p.level < s.level GROUP BY 1, 2, 3")
#: The tree by recursion from the top.
TREE = f"""{SECTIONS},
 up AS (SELECT s.document_id, s.number, max(p.number) AS parent FROM sections s LEFT JOIN sections p ON p.document_id = s.document_id AND p.number < s.number AND p.level < s.level GROUP BY 1, 2),
 tree AS (SELECT document_id, number, parent, [number] AS path FROM up WHERE parent IS NULL
   UNION ALL SELECT u.document_id, u.number, u.parent, list_append(t.path, u.number) FROM tree t JOIN up u ON u.document_id = t.document_id AND u.parent = t.number)"""
register("G08c_contents", lambda t: G.contents(secs(t)), f"WITH RECURSIVE {TREE} SELECT document_id, number, len(path)::INT AS depth, title, type, start, words FROM tree JOIN sections USING (document_id, number)")
register(
    "G08d_navigation",
    lambda t: G.navigation(secs(t)).withColumn("children", F.array_join(F.transform("children", lambda c: c.cast("string")), ",")),
    f"""WITH RECURSIVE {TREE},
      inner_nodes AS (SELECT document_id, parent AS number, string_agg(number, ',' ORDER BY number) AS children FROM tree WHERE parent IS NOT NULL GROUP BY 1, 2),
      under AS (SELECT document_id, number, count(*) - 1 AS below FROM (SELECT document_id, unnest(path) AS number FROM tree) GROUP BY 1, 2)
      SELECT document_id, number, 'section_' || start AS node, title, type, start, parent, coalesce(children, '') AS children, below
      FROM tree JOIN sections USING (document_id, number) LEFT JOIN inner_nodes USING (document_id, number) JOIN under USING (document_id, number)""",
)
register("G08b_balance", lambda t: G.balance(secs(t)), f"WITH {SECTIONS} {BALANCE}")
CITES, URLS, DOIS = r"\[[\p{L}\p{N}_\s,.-]+\]|\([A-Za-z]+,?\s*\d{4}\)", r"https?://[^\s]+", r"(?i)doi:\s*[\d./]+"
EL = {"numbered": r"(?m)^\s*\d+[.)]\s+", "bulleted": r"(?m)^\s*[-*•]\s+", "lettered": r"(?m)^\s*[a-zA-Z][.)]\s+", "pipe_tables": r".*\|.*\|.*", "tab_tables": r".*\t.*\t.*", "code_blocks": r"(?s)```.*?```", "keywords": r"\b(?:def|function|class|import|return|if|else|for|while)\b"}
register(
    "G09_content_elements", lambda t: elements(t).drop("paragraphs", "words"),
    "SELECT doc_id AS document_id, " + ", ".join(f"{n(p)} AS {k}" for k, p in EL.items()) + rf", {n(r'\[[\p{L}\p{N}_\s,.-]+\]|\([A-Za-z]+,?\s*\d{4}\)')} + {n(r'https?://[^\s]+')} + {n(r'(?i)doi:\s*[\d./]+')} AS citations, greatest({n(r'\[\d+\]|\(\d+\)')}, {n(r'(?m)^\s*\d+\.\s+')}) AS footnotes, " + n('"[^"]{10,}"') + " + " + n("''[^'']{10,}''") + " + " + n(r"(?m)^\s*>[^\n]+") + f" AS quotes FROM ({MARKED_SQL})",
)
PARAGRAPHS = r"len(list_filter(regexp_split_to_array(text, '\n\s*\n'), lambda x: " + TRIM + " <> ''))"
CITED = f"{n(CITES)} + {n(URLS)} + {n(DOIS)}"
COMPLETE = " + ".join(pts(test, k) for test, k in ((PARAGRAPHS + " > 0", 0.3), (f"{n(EL['numbered'])} + {n(EL['bulleted'])} + {n(EL['lettered'])} > 0", 0.1), (f"{n(EL['pipe_tables'])} + {n(EL['tab_tables'])} > 0", 0.1), (CITED + " > 0", 0.2), (f"len({WORDS}) > 100", 0.1), (f"len({WORDS}) > 500", 0.1), (f"len({WORDS}) > 1000", 0.1)))
register(
    "G10_structural_quality", lambda t: G.structural_quality(secs(t), elements(t)),
    f"""WITH {SECTIONS}, b AS ({BALANCE}), e AS (SELECT doc_id AS document_id, least(1.0, {COMPLETE})::DOUBLE AS c FROM ({MARKED_SQL})),
 p AS (SELECT document_id, count(*) AS n, max(level) AS deep, max((type = 'introduction')::INT) AS i, max((type = 'conclusion')::INT) AS o, avg(words) FILTER (WHERE words > 0) AS m, var_pop(words) FILTER (WHERE words > 0) AS v FROM sections GROUP BY 1),
 q AS (SELECT p.document_id, CASE WHEN deep > 4 THEN 0.6 WHEN n < 2 THEN 0.5 ELSE 0.85 END::DOUBLE AS consistency, balance, least(1.0::DOUBLE, 0.5::DOUBLE + i * 0.2::DOUBLE + o * 0.2::DOUBLE + coalesce(0.1::DOUBLE / (1 + v / greatest(m, 1.0)), 0)) AS f, c FROM p JOIN b USING (document_id) JOIN e USING (document_id))
 SELECT document_id, consistency, balance, round(f, 4) AS flow, round(c, 4) AS completeness, round((consistency + balance + f + c) / 4, 4) AS overall FROM q""",
)
issues = lambda t: G.failures(docs(t), "doc_id", "text")


def quoted(pattern):
    return pattern.replace("'", "''")


def matches(kind, name, severity, base, pattern, source=MARKED_SQL):
    """SQL for all matches of a failure pattern with their positions: the lengths of what lies before each."""
    p = quoted(pattern)
    place = "list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))"
    return f"SELECT doc_id AS document_id, '{kind}' AS kind, '{name}' AS pattern, '{severity}' AS severity, {base}::DOUBLE AS base, unnest(m) AS content, unnest({place})::INT AS position FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS m, regexp_split_to_array(text, '{p}') AS g FROM ({source})) WHERE len(m) > 0"


#: Which matches of two patterns count, and how sure the patterns are that do not go by the match's length.
COUNTS = {"corrupted_table": "length(x) - length(replace(x, '|', '')) < 3 OR length(x) > 200 OR contains(x, '|||')", "large_whitespace_gap": "length(x) > 20"}
SURE = "CASE pattern WHEN 'non_standard_chars' THEN 0.6::DOUBLE WHEN 'mixed_alphanumeric' THEN 0.5 WHEN 'repeated_punctuation' THEN 0.7 WHEN 'corrupted_table' THEN 0.6 WHEN 'large_whitespace_gap' THEN 0.5 ELSE least(0.95::DOUBLE, base * (0.5 + 0.5 * least(1.0::DOUBLE, length(x) / 10::DOUBLE))) END"
FOUND = f"failures AS (SELECT document_id, kind, pattern, severity, position, x AS content, {SURE} AS confidence FROM (SELECT *, content AS x FROM (" + " UNION ALL ".join(matches(*f) for f in G.FAILURES) + ")) WHERE CASE pattern " + " ".join(f"WHEN '{name}' THEN {test}" for name, test in COUNTS.items()) + " ELSE true END)"


def picked(key, table, default):
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in table.items()) + f" ELSE {default!r} END"


CLASSIFIED = f"""{FOUND}, c1 AS (SELECT *, round(least(1.0::DOUBLE, {picked('severity', G.IMPACT, 0.5)} * 0.4::DOUBLE + confidence * 0.3 + least(1.0::DOUBLE, length(content) / 100::DOUBLE) * 0.2 + greatest(0.3::DOUBLE, 1 - position / 10000::DOUBLE) * 0.1), 6) AS impact,
 CASE WHEN pattern IN ('utf8_corruption', 'html_entities') THEN 'low' WHEN pattern IN ('mojibake', 'mixed_scripts') THEN 'high' ELSE {picked('kind', {k: v[0] for k, v in G.KINDS.items()}, 'medium')} END AS complexity, round(least(0.95::DOUBLE, {picked('kind', {k: v[1] for k, v in G.KINDS.items()}, 0.5)} * (0.5 + confidence * 0.5)), 6) AS probability FROM failures),
 classified AS (SELECT *, round({picked('severity', G.SEVERITY, 25)} * impact + probability * 20 + {picked('complexity', G.PENALTY, 0)}, 6) AS priority FROM c1)"""
def counted(name, pattern):
    return f"len(list_filter(regexp_extract_all(text, '{quoted(pattern)}'), lambda x: {COUNTS[name]}))" if name in COUNTS else n(quoted(pattern))


register("G11_failures", issues, f"WITH {FOUND} SELECT * FROM failures")
register("G11b_failure_counts", lambda t: G.failure_counts(docs(t), "doc_id", "text"), f"WITH d AS ({MARKED_SQL}) SELECT * FROM (" + " UNION ALL ".join(f"SELECT doc_id AS document_id, '{name}' AS pattern, {counted(name, p)} AS n FROM d" for _, name, _, _, p in G.FAILURES) + ") WHERE n > 0")


def files(t):
    """Documents as extracted files: their type, and a size of which the text may be a small part."""
    return docs(t).select(F.col("doc_id").alias("document_id"), "text", kind().alias("kind"), (F.octet_length("text") * (F.col("doc_id") % 300 + 1)).alias("size"))


FILES = f"SELECT doc_id AS document_id, text, (['pdf', 'docx', 'html', 'csv', 'txt'])[doc_id % 5 + 1] AS kind, strlen(text) * (doc_id % 300 + 1) AS size FROM ({MARKED_SQL})"
PDF_SQL = f"SELECT * FROM ({MARKED_SQL}) WHERE doc_id % 5 = 0"
OTHER = f"""files AS ({FILES}),
 ocr AS (SELECT document_id, kind, pattern, severity, position, content, base AS confidence FROM ({" UNION ALL ".join(matches(k, name, sev, base, "(?i)" + p, PDF_SQL) for k, name, sev, base, p in G.OCR)})),
 lost AS (SELECT document_id, n FROM (SELECT document_id, count(*) AS n FROM sections GROUP BY 1) JOIN files USING (document_id)
   WHERE n < greatest(CASE WHEN size < 10000 THEN 1 WHEN size < 50000 THEN 2 WHEN size < 200000 THEN 3 ELSE 5 END, CASE kind WHEN 'pdf' THEN 2 WHEN 'docx' THEN 1 ELSE 0 END)),
 part AS (SELECT document_id, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS n, greatest(100, size // 100) AS wanted FROM files WHERE size > 0),
 other AS (SELECT * FROM ocr
   UNION ALL SELECT document_id, 'structure_loss', 'insufficient_sections', 'high', 0, 'Only ' || n || ' sections found', 0.8 FROM lost
   UNION ALL SELECT document_id, 'content_gaps', 'short_section', 'medium', start, title, 0.7 FROM sections WHERE words < 10 AND level <= 2
   UNION ALL SELECT document_id, 'incomplete_extraction', CASE WHEN n < wanted * 0.1 THEN 'severely_incomplete' ELSE 'potentially_incomplete' END, CASE WHEN n < wanted * 0.1 THEN 'critical' ELSE 'high' END, 0,
     CASE WHEN n < wanted * 0.1 THEN 'Only ' ELSE '' END || n || ' characters extracted', CASE WHEN n < wanted * 0.1 THEN 0.9 ELSE 0.7 END FROM part WHERE n < wanted * 0.5)"""
register("G11c_all_failures", lambda t: G.all_failures(files(t), secs(t)), f"WITH {SECTIONS}, {FOUND}, {OTHER} SELECT * FROM failures UNION ALL SELECT * FROM other")
EVERY = f"{SECTIONS}, {FOUND.replace('failures AS (', 'matched AS (', 1)}, {OTHER}, failures AS (SELECT * FROM matched UNION ALL SELECT * FROM other)"
register("G13b_all_classified", lambda t: G.classified(G.all_failures(files(t), secs(t))), f"WITH {EVERY}, {CLASSIFIED[len(FOUND) + 2:]} SELECT * FROM classified")
register("G12_failure_confidence", lambda t: docs(t).select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("&[a-zA-Z][a-zA-Z0-9]*;"), F.lit(0))).alias("pos", "c")).select("doc_id", "pos", F.round(G.failure_confidence(F.lit(0.85), F.col("c")), 6).alias("confidence")), f"SELECT doc_id, unnest(range(len(x)))::INT AS pos, unnest(list_transform(x, lambda c: round(least(0.95::DOUBLE, 0.85::DOUBLE * (0.5 + 0.5 * least(1.0::DOUBLE, length(c) / 10::DOUBLE))), 6))) AS confidence FROM (SELECT doc_id, regexp_extract_all(text, '&[a-zA-Z][a-zA-Z0-9]*;') AS x FROM ({MARKED_SQL}))")
register("G13_classified_issues", lambda t: G.classified(issues(t)), f"WITH {CLASSIFIED} SELECT * FROM classified")
register("G14_severity_and_effort", lambda t: t.load("part").select("p_partkey", G.adjusted_severity(F.element_at(F.array(*map(F.lit, G.LEVELS)), F.col("p_size") % 4 + 1), F.col("p_size") / 50).alias("severity"), G.fix_hours(F.element_at(F.array(*map(F.lit, G.HOURS)), F.col("p_size") % 5 + 1), F.lit("high"), F.lit(0.5)).alias("hours")), "SELECT p_partkey, (['low', 'medium', 'high', 'critical'])[CASE WHEN p_size / 50 > 0.8 THEN least(4, p_size % 4 + 2) WHEN p_size / 50 < 0.3 THEN greatest(1, p_size % 4) ELSE p_size % 4 + 1 END] AS severity, round(([0.5, 2.0, 8.0, 24.0, 40.0])[p_size % 5 + 1]::DOUBLE * 1.2 * 1.5, 1) AS hours FROM part")
register("G15_prioritised_issues", lambda t: G.classified(issues(t)).orderBy(F.desc("priority"), "document_id", "position", "pattern").select("document_id", "position", "pattern", "priority"), f"WITH {CLASSIFIED} SELECT document_id, position, pattern, priority FROM classified ORDER BY priority DESC, document_id, position, pattern")
register("G16_recommendations", lambda t: G.recommendations(issues(t)), f"WITH {FOUND}, a AS (SELECT * FROM (VALUES " + ", ".join(map(str, G.ADVICE)) + ") v(kind, action, type, priority)) SELECT document_id, lower(action) AS action, type, min(priority) AS priority, sum(n)::BIGINT AS issues FROM (SELECT document_id, kind, count(*) AS n FROM failures GROUP BY 1, 2) f JOIN a USING (kind) GROUP BY 1, 2, 3")


def case(column, table, default):
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in table.items()) + f" ELSE {default!r} END"


TEMPLATES = ", ".join(f"({', '.join(repr(list(v)) if isinstance(v, tuple) and v else '[]::VARCHAR[]' if v == () else repr(v) for v in row)})" for row in D.templates())
PHASE = "CASE " + " ".join(f"WHEN action_type IN ({', '.join(map(repr, kinds))}) THEN '{name}'" for name, kinds in D.PHASES) + " END"
ADVICE = f"""{EVERY},
 firsts AS (SELECT document_id, kind, min({{'s': list_position({list(D.SEVERITIES)}, severity), 'p': list_position({list(D.DETECTED)}, pattern), 'position': position, 'confidence': confidence, 'severity': severity}}) AS f FROM failures GROUP BY 1, 2),
 made AS (SELECT document_id, kind, f, nth, action_type, action, effort, tools, prerequisites,
   CASE WHEN action_type = 'validation' THEN own WHEN f.severity = 'critical' THEN 'urgent' WHEN f.severity = 'high' AND f.position < 1000 THEN 'high' ELSE own END AS priority,
   round(CASE WHEN action_type = 'validation' THEN chance ELSE least(0.95::DOUBLE, chance::DOUBLE * (0.5 + f.confidence * 0.5)) END::DOUBLE, 6) AS probability
   FROM firsts JOIN (SELECT * FROM (VALUES {TEMPLATES}) v(kind, nth, action_type, action, own, chance, effort, tools, prerequisites)) USING (kind)),
 advice AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY list_position({list(D.ACTIONS)}, action_type), list_position({list(D.PRIORITIES)}, priority), f, nth)::INT AS place, {PHASE} AS phase,
   round({case('priority', D.WEIGHTS, 50)} + probability * {D.CHANCE} - {case('effort', D.PENALTIES, 15)}, 6) AS score FROM made)"""


def advice(t):
    return D.recommendations(G.all_failures(files(t), secs(t)))


register(
    "G16b_ordered_advice", lambda t: advice(t).drop("tools", "prerequisites"),
    f"WITH {ADVICE} SELECT document_id, place, kind, action_type, action, priority, probability, effort, phase, score FROM advice",
)
NAMED = " || ".join(f"coalesce('; {name}: ' || string_agg(place, ',' ORDER BY score DESC, place) FILTER (phase = '{name}'), '')" for name, _ in D.PHASES)
register(
    "G16c_action_plans", lambda t: D.joined(D.action_plans(advice(t)), "tools", "prerequisites"),
    f"""WITH {ADVICE}, p AS (SELECT document_id, count(*) AS recommendations, ({NAMED})[3:] AS phases, sum({case('effort', D.HOURS, 8)})::BIGINT AS hours,
      array_to_string(list_sort(list_distinct(flatten(list(tools)))), ', ') AS tools, array_to_string(list_sort(list_distinct(flatten(list(prerequisites)))), ', ') AS prerequisites FROM advice GROUP BY 1)
      SELECT *, greatest(1, hours // 8) AS days, CASE WHEN hours > 40 THEN 'high' WHEN hours > 16 THEN 'medium' ELSE 'low' END AS complexity FROM p""",
)
CORR = " + ".join(f"{w}::DOUBLE * log10({n(quoted(p))} + 1) / 2" for p, w in G.CORRUPTION)
def coherence(text):
    """SQL of the coherence of a text."""
    sents = f"list_filter(list_transform(regexp_split_to_array({text}, '[.!?]+'), lambda x: {TRIM}), lambda x: x <> '')"
    words = rf"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+')"
    a = rf"CASE WHEN len({sents}) > 0 THEN greatest(0.0::DOUBLE, 1 - abs(list_sum(list_transform({sents}, lambda x: len(list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> ''))))::DOUBLE / len({sents}) - 17.5) / 17.5) END"
    b = f"CASE WHEN len({words}) > 0 THEN least(1.0::DOUBLE, len(list_distinct({words}))::DOUBLE / len({words}) + 0.1) END"
    c = f"CASE WHEN length({text}) > 0 THEN greatest(0.0::DOUBLE, 1 - abs({n('[.!?,;:]', text)} / length({text})::DOUBLE - 0.1) / 0.1) END"
    return rf"CASE WHEN regexp_replace({text}, '\s', '', 'g') = '' THEN 0.0 ELSE list_avg(list_filter([{a}, {b}, {c}], lambda x: x IS NOT NULL)) END"


def quality(text):
    """SQL of the quality of a section's text."""
    k = rf"len(list_filter(regexp_split_to_array({text}, '\s+'), lambda w: w <> ''))"
    corrupt = " + ".join(f"{w}::DOUBLE * log10({n(quoted(p), text)} + 1) / 2" for p, w in G.CORRUPTION)
    return f"round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.8 - CASE WHEN {k} < 5 THEN 0.3 WHEN {k} < 15 THEN 0.1 ELSE 0 END - least(1.0::DOUBLE, {corrupt}) + ({coherence(text)} - 0.5) * 0.2)), 6)"


register("G17_section_quality", lambda t: docs(t).select("doc_id", F.round(G.coherence(text_()), 6).alias("coherence"), G.section_quality(text_()).alias("quality")), f"SELECT doc_id, round({coherence('text')}, 6) AS coherence, {quality('text')} AS quality FROM ({MARKED_SQL})")
register("G18_corruption", lambda t: docs(t).select("doc_id", F.round(G.corruption(text_()), 6).alias("severity")), f"SELECT doc_id, round(least(1.0::DOUBLE, {CORR}), 6) AS severity FROM ({MARKED_SQL})")


def tables(t):
    p = t.load("part")
    line = F.concat_ws("|", F.col("p_name"), F.when(F.col("p_size") % 7 == 0, "").otherwise(F.col("p_type")), F.when(F.col("p_size") % 11 != 0, F.col("p_size").cast("string")))
    return p.groupBy(F.floor(F.col("p_partkey") / 100).alias("batch")).agg(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", line.alias("l")))), lambda x: x["l"]).alias("lines"))


register(
    "G19_table_integrity", lambda t: tables(t).select("batch", *(c.alias(k) for k, c in G.table_integrity(F.col("lines")).items())),
    "WITH l AS (SELECT p_partkey // 100 AS batch, list(concat_ws('|', p_name, CASE WHEN p_size % 7 = 0 THEN '' ELSE p_type END, CASE WHEN p_size % 11 <> 0 THEN p_size::VARCHAR END) ORDER BY p_partkey) AS lines FROM part GROUP BY 1), c AS (SELECT batch, len(lines)::INT AS rows, list_transform(lines, lambda x: len(string_split(x, '|'))) AS k, flatten(list_transform(lines, lambda x: list_transform(string_split(x, '|'), lambda s: trim(s)))) AS f FROM l) SELECT batch, k[1]::INT AS columns, rows, len(list_distinct(k)) <= 1 AS steady, round(len(list_filter(f, lambda s: s = ''))::DOUBLE / len(f), 6) AS empty_ratio, round(greatest(0.0::DOUBLE, 1.0 - CASE WHEN len(list_distinct(k)) <= 1 THEN 0.0 ELSE 0.3 END - CASE WHEN k[1] < 2 THEN 0.2 ELSE 0.0 END - CASE WHEN rows < 2 THEN 0.2 ELSE 0.0 END - len(list_filter(f, lambda s: s = ''))::DOUBLE / len(f) * 0.5), 6) AS score FROM c",
)
LANG = " + ".join(f"({n('[' + s + ']')} / greatest(length(text), 1) >= 0.1)::INT" for s in G.LANGUAGE_SETS.values())
register("G20_language_consistency", lambda t: t.load("documents").select("doc_id", G.language_consistency(text_()).alias("score")), f"SELECT doc_id, CASE WHEN regexp_replace(text, '\\s', '', 'g') = '' THEN 0.0 WHEN {LANG} > 1 THEN 0.7 ELSE 1.0 END::DOUBLE AS score FROM documents")
lines = lambda t: docs(t).select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("line", "t"))
KIND = r"CASE WHEN regexp_matches(t, '^\s*\d+[.)]\s+') THEN 'numbered' WHEN regexp_matches(t, '^\s*[-*•]\s+') THEN 'bulleted' WHEN regexp_matches(t, '(?i)^\s*[ivx]+[.)]\s+') THEN 'roman' WHEN regexp_matches(t, '^\s*[a-zA-Z][.)]\s+') THEN 'lettered' END"
LINES = f"SELECT doc_id AS document_id, unnest(range(len(x)))::INT AS line, unnest(x) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM ({MARKED_SQL}))"
register("G21_list_runs", lambda t: G.runs(lines(t), G.list_kind(F.col("t"))), f"WITH k AS (SELECT *, {KIND} AS kind FROM ({LINES})), r AS (SELECT *, (kind IS DISTINCT FROM lag(kind) OVER w)::INT AS s FROM k WINDOW w AS (PARTITION BY document_id ORDER BY line)), g AS (SELECT *, sum(s) OVER (PARTITION BY document_id ORDER BY line) AS run FROM r) SELECT document_id, kind, min(line) AS first, count(*) AS n FROM g WHERE kind IS NOT NULL GROUP BY document_id, run, kind")
register("G21b_cited_domains", lambda t: t.load("pages").select("page_id", F.parse_url("url", F.lit("HOST")).alias("host")).groupBy("host").agg(rows_().alias("n")), "SELECT regexp_extract(url, '^https?://([^/:]+)', 1) AS host, count(*) AS n FROM pages GROUP BY 1")
register("G22_profiled_sections", lambda t: G.profiled_sections(docs(t), "doc_id", "text"))
CLS = r"CASE WHEN s = '' THEN 'empty' WHEN regexp_matches(s, '^#{1,6}\s') THEN 'heading' WHEN " + KIND.replace("CASE WHEN", "(CASE WHEN") + r") IS NOT NULL THEN 'list' WHEN contains(t, '|') THEN 'table' WHEN regexp_matches(s, '^[A-Z][A-Z\s]{2,}$') THEN 'heading' WHEN regexp_matches(s, '^>') THEN 'quote' ELSE 'text' END"
register("G23_line_classes", lambda t: lines(t).groupBy("document_id", G.line_class(F.col("t")).alias("class")).agg(rows_().alias("n")), rf"SELECT document_id, {CLS} AS class, count(*) AS n FROM (SELECT *, regexp_replace(t, '^\s+|\s+$', '', 'g') AS s FROM ({LINES})) GROUP BY 1, 2")
register("G24_located_failures", lambda t: G.located(issues(t).where("severity = 'high'"), docs(t), "doc_id", "text").select("document_id", "pattern", "position", "line", "column", "page", F.md5("around").alias("around")), f"WITH {FOUND} SELECT document_id, pattern, position, (length(b) - length(replace(b, chr(10), '')) + 1)::INT AS line, (length(list_last(string_split(b, chr(10)))) + 1)::INT AS \"column\", (position // 2000 + 1)::INT AS page, md5(substring(text, greatest(1, position - 49), 100)) AS around FROM (SELECT f.*, text, substring(text, 1, position) AS b FROM failures f JOIN ({MARKED_SQL}) d ON d.doc_id = f.document_id WHERE severity = 'high')")
register("G25_failures_in_sections", lambda t: G.in_sections(issues(t), secs(t)).groupBy("document_id", "title").agg(rows_().alias("n")), f"WITH {SECTIONS}, {FOUND} SELECT f.document_id, coalesce(title, 'Unknown section') AS title, count(*) AS n FROM failures f LEFT JOIN sections s ON s.document_id = f.document_id AND position >= start AND position < stop GROUP BY 1, 2")


def report(t):
    """Histogram of section quality and the document's overall score."""
    quality = G.sections(docs(t), found(t), "doc_id", "text").join(docs(t).select(F.col("doc_id").alias("document_id"), "text"), "document_id").select("document_id", G.section_quality(F.substring(text_(), F.col("start") + 1, F.col("stop") - F.col("start"))).alias("q"))
    bins = quality.groupBy("document_id").agg(F.count_if(F.col("q") >= 0.7).alias("high"), F.count_if((F.col("q") >= 0.4) & (F.col("q") < 0.7)).alias("medium"), F.count_if(F.col("q") < 0.4).alias("low"))
    penalty = issues(t).groupBy("document_id").agg(F.least(F.lit(0.8), F.sum(G.pick(F.col("severity"), {"critical": 0.3, "high": 0.2, "medium": 0.1, "low": 0.05}, 0.1))).alias("p"))
    score = docs(t).select(F.col("doc_id").alias("document_id"), G.quality_score(text_(), kind()).alias("s"))
    return bins.join(score, "document_id").join(penalty, "document_id", "left").select("document_id", "high", "medium", "low", F.round(F.greatest(F.lit(0.0), F.col("s") / 100 - F.coalesce("p", F.lit(0.0))), 6).alias("overall"))


register(
    "G26_quality_report", report,
    f"""WITH {SECTIONS}, {FOUND}, q AS (SELECT document_id, {quality('substring(text, start + 1, stop - start)')} AS q FROM sections s JOIN ({MARKED_SQL}) d ON d.doc_id = s.document_id), b AS (SELECT document_id, count(*) FILTER (WHERE q >= 0.7) AS high, count(*) FILTER (WHERE q >= 0.4 AND q < 0.7) AS medium, count(*) FILTER (WHERE q < 0.4) AS low FROM q GROUP BY 1),
 p AS (SELECT document_id, least(0.8::DOUBLE, sum(CASE severity WHEN 'critical' THEN 0.3::DOUBLE WHEN 'high' THEN 0.2 WHEN 'medium' THEN 0.1 ELSE 0.05 END)) AS p FROM failures GROUP BY 1)
 SELECT b.*, round(greatest(0.0::DOUBLE, score / 100::DOUBLE - coalesce(p, 0)), 6) AS overall FROM b JOIN ({SCORE}) g ON g.doc_id = b.document_id LEFT JOIN p ON p.document_id = b.document_id""",
)
register("G27_hierarchy_check", lambda t: G.hierarchy_check(secs(t)), f"WITH {SECTIONS}, m AS (SELECT document_id, words, coalesce(level - lag(level) OVER (PARTITION BY document_id ORDER BY number) > 1, false) AS s, avg(words) OVER (PARTITION BY document_id) AS a FROM sections), k AS (SELECT document_id, count(*) FILTER (WHERE s) AS skips, count(*) FILTER (WHERE words > 5 * a OR words < 0.1 * a) AS imbalance, count(*) FILTER (WHERE words = 0) AS empties FROM m GROUP BY 1) SELECT *, round(greatest(0.0::DOUBLE, 1 - 0.2 * skips - 0.1 * imbalance - 0.05 * empties), 6) AS score FROM k")
