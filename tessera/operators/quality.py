"""Quality and structure of extracted text: scores, headers, sections, failures and issues.

Scores are Column expressions on one text; structure is lines with a document key and running windows within the
document. `\\w` is read as letters, digits and underscore of any script.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

from .asof import asof_join
from .folds import nested

W = r"\p{L}\p{N}_"
#: Common English words of the content score.
COMMON = ("the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by")


def steps(x: Column, table: tuple[tuple[float, float], ...]) -> Column:
    """The value of the first bound that x is over; 0 under all."""
    out = F.lit(0)
    for bound, value in reversed(table):
        out = F.when(x > bound, value).otherwise(out)
    return out


def points(test: Column, n: int) -> Column:
    return F.when(test, n).otherwise(0)


#: Signs of structure and their points, and the most they give.
STRUCTURE, MOST_STRUCTURE = ((r"\n\s*\n", 5), (r"[.!?]\s+[A-Z]", 5), (r"(?m)^\s*\d+\.?\s+", 3), (r"(?m)^\s*[•\-*]\s+", 3), ("===.*===", 4), (r"Title:|H\d+:", 5)), 25
#: Points of the share of letters, of common words, of words and of characters (each over a bound).
LETTER_POINTS, COMMON_POINTS, WORD_POINTS, SIZE_POINTS = ((0.7, 8), (0.5, 5), (0.3, 2)), ((4, 7), (1, 3)), ((200, 20), (100, 15), (50, 10), (10, 5)), ((1000, 30), (500, 20), (100, 10), (0, 5))
#: Signs of errors: control characters, odd characters (share) and question marks (share), with their points.
CONTROL, ODD = (r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", 5), (rf"[^{W}\s.,!?\-()\[\]{{}}'\"\\/:;]", 0.1, 3)
ASKING = (0.05, 2)
ASCII_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def quality_score(text: Column, kind: Column) -> Column:
    """0 to 100: length, words, structure, content and a bonus by type, less signs of errors."""
    n, words = F.length(text), F.size(T.words(text))
    structure = reduce(lambda a, b: a + b, (points(text.rlike(p), k) for p, k in STRUCTURE))
    alpha = (n - F.length(F.translate(text, ASCII_LETTERS, ""))) / F.greatest(n, F.lit(1))
    common = reduce(lambda a, b: a + b, (F.contains(F.lower(text), F.lit(w)).cast("int") for w in COMMON))
    content = steps(alpha, LETTER_POINTS) + steps(common, COMMON_POINTS)
    marks = n - F.length(F.replace(text, F.lit("?"), F.lit("")))
    errors = points(text.rlike(CONTROL[0]), CONTROL[1]) + points(T.times(text, ODD[0]) > n * ODD[1], ODD[2]) + points(marks > n * ASKING[0], ASKING[1])
    pipe, rule, heads = F.contains(text, F.lit("|")), text.rlike("===.*==="), text.rlike(r"H\d+:")
    bonus = (
        F.when(kind == "pdf", points(pipe, 3) + points(text.rlike(r"Page \d+"), 2)).when(kind.isin("docx", "doc"), points(pipe, 3) + points(rule, 2))
        .when(kind.isin("html", "htm"), points(F.contains(text, F.lit("Title:")), 3) + points(heads, 3) + points(F.contains(text, F.lit("•")), 2)).when(kind == "csv", points(pipe, 5)).otherwise(0)
    )
    score = steps(n, SIZE_POINTS) + steps(words, WORD_POINTS) + F.least(structure, F.lit(MOST_STRUCTURE)) + F.least(content, F.lit(15)) - F.least(errors, F.lit(10)) + F.least(bonus, F.lit(10))
    return F.least(F.greatest(score, F.lit(0)), F.lit(100))


def rating(score: Column) -> Column:
    return F.when(score >= 90, "excellent").when(score >= 70, "good").otherwise("poor")


def success_rate(score: Column, chars: Column, pages: Column) -> Column:
    """The score weighed with the share of pages that the text can fill at 2000 characters each."""
    done = F.when(pages > 1, F.greatest(F.lit(1), F.least(pages, F.floor(chars / 2000)))).otherwise(pages)
    return F.round(F.when(pages > 0, F.least(F.lit(100.0), done / pages * score)).otherwise(score.cast("double")), 1)


def structure_counts(text: Column) -> dict[str, Column]:
    table = F.filter(F.split(text, "\n"), lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 2)
    return {
        "paragraphs": F.size(T.trimmed(F.split(text, r"\n\s*\n"))), "sentences": T.times(text, r"[.!?]+(\s+|$)"), "numbered": T.times(text, r"(?m)^\s*\d+\.?\s+"), "bulleted": T.times(text, r"(?m)^\s*[•\-*]\s+"),
        "headers": T.times(text, "===.*===") + T.times(text, r"Title:|H\d+:"), "table_rows": F.size(table),
    }


def content_metrics(text: Column) -> dict[str, Column]:
    n = F.greatest(F.length(text), F.lit(1))
    lengths = F.transform(T.words(text), lambda w: F.length(F.btrim(w, F.lit(".,!?;:()[]{}\"'-"))))
    mean = F.try_divide(F.aggregate(lengths, F.lit(0), lambda a, x: a + x).cast("double"), F.size(lengths).cast("double"))
    return {
        "alphabetic": F.round(T.times(text, r"\p{L}") / n, 6), "numeric": F.round(T.times(text, r"\p{Nd}") / n, 6), "whitespace": F.round(T.times(text, r"\s") / n, 6),
        "word_mean": F.round(mean, 6), "word_max": F.array_max(lengths), "word_min": F.array_min(lengths),
    }


def density(text: Column) -> dict[str, Column]:
    lines = F.split(text, "\n")
    full = F.filter(lines, lambda x: x.rlike(r"\S"))
    chars = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + F.length(x))
    return {
        "lines": F.size(lines), "empty": F.size(lines) - F.size(full), "empty_ratio": F.round((F.size(lines) - F.size(full)) / F.size(lines), 6),
        "mean_line": F.round(chars(lines) / F.size(lines), 6), "mean_full_line": F.round(chars(full) / F.greatest(F.size(full), F.lit(1)), 6),
    }


#: Letters of headers in capitals and in title case.
UP, LOW = "A-ZÁÉÍÓÚÀÂÊÔÃŨÇ", "a-záéíóúàâêôãũç"
#: Kinds of headers in the order of precedence: pattern, group of the title, confidence.
HEADERS = (
    ("numbered", r"^\s*(\d+(?:\.\d+)*)\s*\.?\s*(.+?)\s*$", 2, 0.9), ("roman", r"^\s*([IVX]+)\.\s+(.+?)\s*$", 2, 0.8), ("letter", r"^\s*([A-Za-z])[.)]\s+(.+?)\s*$", 2, 0.7),
    ("caps", rf"^\s*([{UP}][{UP}\s]{{2,}})\s*$", 1, 0.6), ("title_case", rf"^\s*([{UP}][{LOW}\s]{{3,}})\s*$", 1, 0.5),
    ("decorated", r"^\s*[=-]{3,}\s*([^\n]+?)\s*[=-]{3,}\s*$", 1, 0.95), ("markdown", r"^\s*(#{1,6})\s+([^\n]+)\s*$", 2, 0.9),
)


def headers(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(document_id, line, start, kind, level, title, confidence): header lines, levels renumbered in the order they appear."""
    lines = docs.select(F.col(id_col).alias("document_id"), F.posexplode(F.split(text_col, "\n")).alias("line", "raw")).withColumn("s", T.strip(F.col("raw")))
    lines = lines.withColumn("start", F.coalesce(F.sum(F.length("raw") + 1).over(Window.partitionBy("document_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    candidates = []
    for kind, pattern, group, sure in HEADERS:
        level = {"numbered": F.size(F.split(F.regexp_extract("s", pattern, 1), r"\.")), "markdown": F.length(F.regexp_extract("s", pattern, 1)), "caps": F.lit(2), "title_case": F.lit(3), "decorated": F.lit(1)}.get(kind, F.lit(2))
        candidates.append(F.struct(F.lit(kind).alias("kind"), T.strip(F.regexp_extract("s", pattern, group)).alias("title"), level.cast("int").alias("level"), F.lit(sure).alias("confidence")))
    # An array and a filter keep the generated code small; a kind whose pattern does not match has an empty title.
    fine = lambda h: F.length(h["title"]).between(2, 200) & (T.times(h["title"], rf"[^{W}\s]") <= F.length(h["title"]) * 0.3) & (T.times(h["title"], r"\d") <= F.length(h["title"]) * 0.5)
    got = lines.where("s <> ''").withColumn("h", F.get(F.filter(F.array(*candidates), fine), 0)).where("h IS NOT NULL").select("document_id", "line", "start", "s", "h.*")
    sure = F.col("confidence") * F.when(F.length("s") > 100, 0.8).otherwise(1.0) * F.when(F.col("s").rlike("[.!?]$"), 0.7).otherwise(1.0)
    first = got.withColumn("_f", F.min("line").over(Window.partitionBy("document_id", "level")))
    return first.select("document_id", "line", "start", "kind", F.dense_rank().over(Window.partitionBy("document_id").orderBy("_f")).alias("level"), "title", F.round(sure, 6).alias("confidence"))


#: Section types by words of the title, in the order of precedence.
SECTION_TYPES = {
    "introduction": ("introdução", "introduction", "início"), "conclusion": ("conclusão", "conclusion", "final"), "methodology": ("método", "methodology", "approach"), "results": ("resultado", "results", "findings"),
    "discussion": ("discussão", "discussion", "analysis"), "references": ("referência", "references", "bibliography"), "appendix": ("anexo", "appendix", "apêndice"),
}


def section_type(title: Column) -> Column:
    out = F.lit("main_content")
    for kind, parts in reversed(list(SECTION_TYPES.items())):
        out = F.when(reduce(lambda a, b: a | b, (F.contains(F.lower(title), F.lit(p)) for p in parts)), kind).otherwise(out)
    return out


def sections(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(document_id, number, level, title, type, start, stop, words): from each header to the next; a text without headers is one."""
    order = Window.partitionBy("document_id").orderBy("start")
    texts = docs.select(F.col(id_col).alias("document_id"), F.col(text_col).alias("t"))
    spans = found.withColumn("stop", F.lead("start").over(order)).withColumn("number", F.row_number().over(order))
    joined = texts.join(spans, "document_id", "left").withColumn("start", F.coalesce("start", F.lit(0))).withColumn("stop", F.coalesce("stop", F.length("t")))
    body = F.substring(F.col("t"), F.col("start") + 1, F.col("stop") - F.col("start"))
    return joined.select("document_id", F.coalesce("number", F.lit(1)).alias("number"), F.coalesce("level", F.lit(1)).alias("level"), F.coalesce("title", F.lit("Document Content")).alias("title"), section_type(F.coalesce("title", F.lit(""))).alias("type"), "start", "stop", F.size(T.words(body)).alias("words"))


def parents(rows: DataFrame) -> DataFrame:
    """Adds `path`, the numbers of the sections that a section lies in and its own, and `parent`, the innermost of them (null at the top).

    A section lies in the last earlier one of a smaller level, however deep.
    """
    return nested(rows, ["document_id"], "number", "level").withColumn("parent", F.try_element_at("path", F.lit(-2)))


def contents(rows: DataFrame) -> DataFrame:
    """(document_id, number, depth, title, type, start, words): the table of contents, by depth of nesting and not by level."""
    return parents(rows).select("document_id", "number", F.size("path").alias("depth"), "title", "type", "start", "words")


def navigation(rows: DataFrame) -> DataFrame:
    """(document_id, number, node, title, type, start, parent, children, below): the tree as rows, each node with its children in order.

    below: how many sections lie in a node at any depth.
    """
    tree = parents(rows)
    inner = tree.where("parent IS NOT NULL").groupBy("document_id", F.col("parent").alias("number")).agg(F.sort_array(F.collect_list("number")).alias("children"))
    below = tree.select("document_id", F.explode("path").alias("number")).groupBy("document_id", "number").agg((F.count(F.lit(1)) - 1).alias("below"))
    nodes = tree.join(inner, ["document_id", "number"], "left").join(below, ["document_id", "number"])
    node = F.concat(F.lit("section_"), F.col("start").cast("string")).alias("node")
    return nodes.select("document_id", "number", node, "title", "type", "start", "parent", F.coalesce("children", F.array().cast("array<int>")).alias("children"), "below")


def balance(rows: DataFrame) -> DataFrame:
    """(document_id, depth, balance): 1 / (1 + variance / mean) of the sections by level."""
    by_level = rows.groupBy("document_id", "level").agg(F.count(F.lit(1)).alias("n"))
    return by_level.groupBy("document_id").agg(F.count(F.lit(1)).alias("depth"), F.round(1 / (1 + F.var_pop("n") / F.avg("n")), 6).alias("balance"))


def content_elements(text: Column) -> dict[str, Column]:
    """Counts of lists, tables, citations, code and quotes. A table row is a line of two bars (or tabs), found in one pass over the line."""
    times = lambda p: T.times(text, T.ascii_bounds(p))
    cites, urls, dois = times(r"\[[" + W + r"\s,.-]+\]|\([A-Za-z]+,?\s*\d{4}\)"), times(r"https?://[^\s]+"), times(r"(?i)doi:\s*[\d./]+")
    return {
        "numbered": times(r"(?m)^\s*\d+[.)]\s+"), "bulleted": times(r"(?m)^\s*[-*•]\s+"), "lettered": times(r"(?m)^\s*[a-zA-Z][.)]\s+"),
        "pipe_tables": times(r"(?m)^[^\n|]*+\|[^\n|]*+\|"), "tab_tables": times(r"(?m)^[^\n\t]*+\t[^\n\t]*+\t"), "citations": cites + urls + dois, "footnotes": F.greatest(times(r"\[\d+\]|\(\d+\)"), times(r"(?m)^\s*\d+\.\s+")),
        "code_blocks": times(r"(?s)```.*?```"), "keywords": times(r"\b(?:def|function|class|import|return|if|else|for|while)\b"), "quotes": times('"[^"]{10,}"') + times("'[^']{10,}'") + times(r"(?m)^\s*>[^\n]+"),
    }


def structural_quality(secs: DataFrame, elements: DataFrame) -> DataFrame:
    """(document_id, consistency, balance, flow, completeness, overall). elements: content_elements() with paragraphs and words."""
    per = secs.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("level").alias("deep"), F.max((F.col("type") == "introduction").cast("int")).alias("intro"), F.max((F.col("type") == "conclusion").cast("int")).alias("end"),
        F.avg(F.when(F.col("words") > 0, F.col("words"))).alias("m"), F.var_pop(F.when(F.col("words") > 0, F.col("words"))).alias("v"),
    ).join(balance(secs), "document_id").join(elements, "document_id")
    flow = 0.5 + F.col("intro") * 0.2 + F.col("end") * 0.2 + F.coalesce(0.1 / (1 + F.col("v") / F.greatest("m", F.lit(1.0))), F.lit(0.0))
    has = lambda c, w: F.when(c, w).otherwise(0.0)
    complete = has(F.col("paragraphs") > 0, 0.3) + has(F.col("numbered") + F.col("bulleted") + F.col("lettered") > 0, 0.1) + has(F.col("pipe_tables") + F.col("tab_tables") > 0, 0.1) + has(F.col("citations") > 0, 0.2) + has(F.col("words") > 100, 0.1) + has(F.col("words") > 500, 0.1) + has(F.col("words") > 1000, 0.1)
    consistent = F.when(F.col("deep") > 4, 0.6).when(F.col("n") < 2, 0.5).otherwise(0.85)
    out = per.select("document_id", consistent.alias("consistency"), "balance", F.least(F.lit(1.0), flow).alias("flow"), F.least(F.lit(1.0), complete).alias("completeness"))
    mean = (F.col("consistency") + F.col("balance") + F.col("flow") + F.col("completeness")) / 4
    return out.withColumn("overall", F.round(mean, 4)).withColumn("flow", F.round("flow", 4)).withColumn("completeness", F.round("completeness", 4))


#: Failure patterns: kind, name, severity, base confidence, pattern.
FAILURES = (
    ("encoding_error", "utf8_corruption", "high", 0.95, "�+"), ("encoding_error", "latin1_in_utf8", "high", 0.7, "[àáâãäåæçèéêëìíîïñòóôõöøùúûüý]{2,}"), ("encoding_error", "windows1252_quotes", "high", 0.6, '["]'),
    ("encoding_error", "escaped_unicode", "high", 0.8, r"\\u[0-9a-fA-F]{4}"), ("encoding_error", "html_entities", "high", 0.85, r"&[a-zA-Z][a-zA-Z0-9]*;|&#[0-9]+;|&#x[0-9a-fA-F]+;"),
    ("encoding_error", "mojibake", "high", 0.75, r"[^\x00-\x7FÀ-ɏḀ-ỿ]+"), ("encoding_error", "mixed_alphanumeric", "medium", 0.5, "[A-Za-z][0-9]{2,}[A-Za-z]"), ("encoding_error", "repeated_punctuation", "medium", 0.7, "[.,;:]{3,}"),
    ("encoding_error", "non_standard_chars", "medium", 0.6, "[^\x20-\x7e\u00a0-\u024f\u1e00-\u1eff]{3,}"),
    ("table_corruption", "corrupted_table", "medium", 0.6, r"\|[^|\n]*\|[^|\n]*\||\t[^\t\n]*\t[^\t\n]*\t"), ("content_gaps", "large_whitespace_gap", "low", 0.5, r"\n\s*\n\s*\n\s*\n+"),
)
#: Patterns whose confidence is the base one, whatever the length of the match.
FLAT = ("mixed_alphanumeric", "repeated_punctuation", "non_standard_chars", "corrupted_table", "large_whitespace_gap")
RULES = "struct<kind:string,pattern:string,severity:string,position:int,content:string,confidence:double>"


def failure_confidence(base: Column, content: Column) -> Column:
    return F.least(F.lit(0.95), base * (0.5 + 0.5 * F.least(F.lit(1.0), F.length(content) / 10)))


def is_failure(name: str, content: str) -> bool:
    """Whether a match counts: table rows with few or running bars or over 200 characters, gaps of more than 20 characters."""
    if name == "corrupted_table":
        return content.count("|") < 3 or len(content) > 200 or "|||" in content
    return name != "large_whitespace_gap" or len(content) > 20


#: Signs of bad character recognition: kind, name, severity, confidence, pattern; letters stand for either case.
OCR = (
    ("ocr_failure", "vertical_line_confusion", "medium", 0.8, "[Il1|]{3,}"), ("ocr_failure", "zero_letter_confusion", "medium", 0.7, "[O0]{4,}"), ("ocr_failure", "rn_m_confusion", "medium", 0.75, "rn[^a-z]"),
    ("ocr_failure", "cl_d_confusion", "medium", 0.7, "[^a-z]cl[^a-z]"), ("ocr_failure", "letter_number_mix", "medium", 0.6, r"\b[a-z]{1,2}[0-9]+[a-z]*\b"), ("ocr_failure", "no_spaces_long_string", "medium", 0.8, r"[^\s]{20,}"),
)
#: Least number of sections by size of the file (upper bounds), and by type.
LEAST_SECTIONS, LEAST_BY_TYPE = ((10_000, 1), (50_000, 2), (200_000, 3), (None, 5)), {"pdf": 2, "docx": 1, "doc": 1}
#: Words of a section that is too short, the deepest level that is looked at, and its confidence.
SHORT_WORDS, SHORT_LEVEL, SHORT_SURE = 10, 2, 0.7
#: A text is expected to have a character for so many bytes, and so many at least; shares of that, their names, severities and confidences.
BYTES_A_CHARACTER, LEAST_CHARACTERS = 100, 100
INCOMPLETE = ((0.1, "severely_incomplete", "critical", 0.9), (0.5, "potentially_incomplete", "high", 0.7))
ISSUE = ["document_id", "kind", "pattern", "severity", "position", "content", "confidence"]


def failures(docs: DataFrame, id_col: str, text_col: str, table: tuple = FAILURES, flags: int = 0) -> DataFrame:
    """(document_id, kind, pattern, severity, position, content, confidence): every match of every failure pattern that counts."""
    compiled = [(k, n, s, b, regex.compile(p, flags)) for k, n, s, b, p in table]
    flat = (*FLAT, *(n for k, n, *_ in table if k == "ocr_failure"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (i, k, n, s, m.start(), m[0], base if n in flat else min(0.95, base * (0.5 + 0.5 * min(1.0, len(m[0]) / 10))))
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for k, n, s, base, p in compiled for m in p.finditer(t.as_py() or "") if is_failure(n, m[0])
            ]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["document_id", "kind", "pattern", "severity", "position", "content", "confidence"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(found, "document_id long, kind string, pattern string, severity string, position int, content string, confidence double")


def ocr_failures(docs: DataFrame, id_col: str, text_col: str, kind: Column) -> DataFrame:
    """Signs of bad character recognition, in the texts of PDF files alone."""
    return failures(docs.where(F.lower(kind) == "pdf"), id_col, text_col, OCR, regex.IGNORECASE)


def least_sections(kind: Column, size: Column) -> Column:
    by_size = F.lit(LEAST_SECTIONS[-1][1])
    for below, n in reversed(LEAST_SECTIONS[:-1]):
        by_size = F.when(size < below, n).otherwise(by_size)
    return F.greatest(by_size, pick(F.lower(kind), LEAST_BY_TYPE, 0))


def _issue(kind: str, pattern, severity, position: Column, content: Column, confidence) -> list[Column]:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    values = (F.lit(kind), as_column(pattern), as_column(severity), position.cast("int"), content, as_column(confidence))
    return ["document_id", *(v.alias(n) for v, n in zip(values, ISSUE[1:], strict=True))]


def structure_loss(files: DataFrame, secs: DataFrame) -> DataFrame:
    """Documents with fewer sections than their file's type and size let expect. files: (document_id, kind, size)."""
    counted = files.join(secs.groupBy("document_id").agg(F.count(F.lit(1)).alias("n")), "document_id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    found = F.concat(F.lit("Only "), F.col("n").cast("string"), F.lit(" sections found"))
    return counted.where(F.col("n") < least_sections(F.col("kind"), F.col("size"))).select(*_issue("structure_loss", "insufficient_sections", "high", F.lit(0), found, 0.8))


def short_sections(secs: DataFrame) -> DataFrame:
    """Sections of the upper levels with few words."""
    short = secs.where((F.col("words") < SHORT_WORDS) & (F.col("level") <= SHORT_LEVEL))
    return short.select(*_issue("content_gaps", "short_section", "medium", F.col("start"), F.col("title"), SHORT_SURE))


def incomplete(files: DataFrame) -> DataFrame:
    """Texts that are short for the size of their file. files: (document_id, text, size); files without a size are left out."""
    chars, wanted = F.length(T.strip(F.col("text"))), F.greatest(F.lit(LEAST_CHARACTERS), F.floor(F.col("size") / BYTES_A_CHARACTER))
    (few, name, severity, sure), (half, name2, severity2, sure2) = INCOMPLETE
    severe = chars < wanted * few
    content = F.concat(F.when(severe, "Only ").otherwise(""), chars.cast("string"), F.lit(" characters extracted"))
    either = lambda a, b: F.when(severe, a).otherwise(b)
    return files.where((F.col("size") > 0) & (chars < wanted * half)).select(*_issue("incomplete_extraction", either(name, name2), either(severity, severity2), F.lit(0), content, either(sure, sure2)))


def all_failures(files: DataFrame, secs: DataFrame) -> DataFrame:
    """Failures of every kind. files: (document_id, text, kind, size); secs: their sections."""
    parts = [failures(files, "document_id", "text"), ocr_failures(files, "document_id", "text", F.col("kind")), structure_loss(files, secs), short_sections(secs), incomplete(files)]
    return reduce(lambda a, b: a.unionByName(b), (p.select(*ISSUE) for p in parts))


def failure_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(document_id, pattern, n), in the JVM, for patterns that occur."""
    bars = lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit("")))
    tests = {"corrupted_table": lambda x: (bars(x) < 3) | (F.length(x) > 200) | F.contains(x, F.lit("|||")), "large_whitespace_gap": lambda x: F.length(x) > 20}

    def times(name: str, pattern: str) -> Column:
        if name not in tests:
            return T.times(F.col(text_col), pattern)
        return F.size(F.filter(F.regexp_extract_all(text_col, F.lit(pattern), F.lit(0)), tests[name]))

    counts = F.array(*(F.struct(F.lit(n).alias("pattern"), times(n, p).alias("n")) for _, n, _, _, p in FAILURES))
    return docs.select(F.col(id_col).alias("document_id"), F.explode(counts).alias("c")).select("document_id", "c.*").where("n > 0")


#: Fixed values by kind: fix complexity, probability, base severity, category.
KINDS = {
    "encoding_error": ("low", 0.85, "high"), "ocr_failure": ("medium", 0.65, "medium"), "structure_loss": ("high", 0.45, "high"), "content_gaps": ("medium", 0.60, "medium"),
    "table_corruption": ("medium", 0.55, "medium"), "formatting_loss": ("high", 0.30, "low"), "language_inconsistency": ("medium", 0.70, "medium"), "incomplete_extraction": ("high", 0.40, "critical"),
}
#: Weights of severity, hours and penalty of complexity.
IMPACT = {"critical": 1.0, "high": 0.8, "medium": 0.6, "low": 0.4}
SEVERITY = {"critical": 100, "high": 75, "medium": 50, "low": 25}
HOURS = {"trivial": 0.5, "low": 2.0, "medium": 8.0, "high": 24.0, "expert": 40.0}
PENALTY = {"trivial": 0, "low": -5, "medium": -10, "high": -20, "expert": -30}


def pick(key: Column, table: dict, default) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def classified(issues: DataFrame) -> DataFrame:
    """Adds impact, complexity, probability and priority to failures."""
    impact = pick(F.col("severity"), IMPACT, 0.5) * 0.4 + F.col("confidence") * 0.3 + F.least(F.lit(1.0), F.length("content") / 100) * 0.2 + F.greatest(F.lit(0.3), 1 - F.col("position") / 10_000) * 0.1
    complexity = F.when(F.col("pattern").isin("utf8_corruption", "html_entities"), "low").when(F.col("pattern").isin("mojibake", "mixed_scripts"), "high").otherwise(pick(F.col("kind"), {k: v[0] for k, v in KINDS.items()}, "medium"))
    chance = F.least(F.lit(0.95), pick(F.col("kind"), {k: v[1] for k, v in KINDS.items()}, 0.5) * (0.5 + F.col("confidence") * 0.5))
    out = issues.withColumn("impact", F.round(F.least(F.lit(1.0), impact), 6)).withColumn("complexity", complexity).withColumn("probability", F.round(chance, 6))
    return out.withColumn("priority", F.round(pick(F.col("severity"), SEVERITY, 25) * F.col("impact") + F.col("probability") * 20 + pick(F.col("complexity"), PENALTY, 0), 6))


LEVELS = ("low", "medium", "high", "critical")


def adjusted_severity(base: Column, factor: Column) -> Column:
    """One level up over .8, one down under .3."""
    at = F.array_position(F.array(*map(F.lit, LEVELS)), base)
    moved = F.when(factor > 0.8, F.least(at + 1, F.lit(4))).when(factor < 0.3, F.greatest(at - 1, F.lit(1))).otherwise(at)
    return F.element_at(F.array(*map(F.lit, LEVELS)), moved.cast("int"))


def fix_hours(complexity: Column, severity: Column, probability: Column) -> Column:
    """Base hours of the complexity, more for severe and for unlikely fixes."""
    return F.round(pick(complexity, HOURS, 8.0) * pick(severity, {"critical": 1.5, "high": 1.2, "medium": 1.0, "low": 0.8}, 1.0) * (2 - probability), 1)


#: Advice by kind of failure: action, kind of action, priority.
ADVICE = (("encoding_error", "reprocess as UTF-8", "automatic", "high"), ("encoding_error", "repair entities", "automatic", "medium"), ("table_corruption", "extract tables again", "automatic", "medium"), ("content_gaps", "compare with the source", "manual", "medium"), ("structure_loss", "review headings", "manual", "high"))


def recommendations(issues: DataFrame) -> DataFrame:
    """(document_id, action, type, priority, issues): advice for the kinds of failures of each document, once each."""
    advice = issues.sparkSession.createDataFrame(list(ADVICE), "kind string, action string, type string, priority string")
    kinds = issues.groupBy("document_id", "kind").agg(F.count(F.lit(1)).alias("issues"))
    return kinds.join(F.broadcast(advice), "kind").groupBy("document_id", F.lower("action").alias("action"), "type").agg(F.min("priority").alias("priority"), F.sum("issues").alias("issues"))


def coherence(text: Column) -> Column:
    """Mean of how near sentences are to 17.5 words, punctuation to a tenth of the characters, and of the share of distinct words."""
    sents = T.trimmed(F.split(text, "[.!?]+"))
    mean = F.try_divide(F.aggregate(sents, F.lit(0), lambda a, s: a + F.size(T.words(s))).cast("double"), F.size(sents).cast("double"))
    words = F.regexp_extract_all(F.lower(text), F.lit(f"[{W}]+"), F.lit(0))
    near = lambda x, at: F.greatest(F.lit(0.0), 1 - F.abs(x - at) / at)
    parts = F.array_compact(F.array(F.when(F.size(sents) > 0, near(mean, 17.5)), F.when(F.size(words) > 0, F.least(F.lit(1.0), F.size(F.array_distinct(words)) / F.size(words) + 0.1)), F.when(F.length(text) > 0, near(T.times(text, "[.!?,;:]") / F.length(text), 0.1))))
    return F.when(T.strip(text) == "", 0.0).otherwise(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts))


#: Weights of corruption by pattern.
CORRUPTION = (("�", 0.8), ("[àáâãäåæçèéêëìíîïñòóôõöøùúûüý]{3,}", 0.6), ('["]', 0.3), (r"&[a-zA-Z][a-zA-Z0-9]*;|&#[0-9]+;", 0.4), (r"\\u[0-9a-fA-F]{4}", 0.5), (r"[\x00-\x08\x0B-\x0C\x0E-\x1F\x7F]", 0.9), (rf"[^{W}\s]{{5,}}", 0.5))


def corruption(text: Column) -> Column:
    """Sum of weight * log10(n + 1) / 2 over corruption patterns, 1 at most."""
    return F.least(F.lit(1.0), reduce(lambda a, b: a + b, (w * F.log10(T.times(text, p) + 1) / 2 for p, w in CORRUPTION)))


def section_quality(text: Column) -> Column:
    """.8 less penalties for length and corruption, more or less for coherence, held in [0, 1]."""
    n = F.size(T.words(text))
    length = F.when(n < 5, 0.3).when(n < 15, 0.1).otherwise(0.0)
    return F.round(T.clamp(0.8 - length - corruption(text) + (coherence(text) - 0.5) * 0.2), 6)


def table_integrity(lines: Column) -> dict[str, Column]:
    """Columns by the separator of the first line, consistency, share of empty cells and a score."""
    head = F.get(lines, 0)
    sep = F.when(F.contains(head, F.lit("|")), r"\|").when(F.contains(head, F.lit("\t")), "\t").when(F.contains(head, F.lit(";")), ";").otherwise(",")
    cells = F.transform(lines, lambda x: F.transform(F.split(x, sep), T.strip))
    counts = F.transform(cells, F.size)
    flat = F.flatten(cells)
    empty = F.try_divide(F.size(F.filter(flat, lambda c: c == "")).cast("double"), F.size(flat).cast("double"))
    steady = F.size(F.array_distinct(counts)) <= 1
    score = 1.0 - F.when(steady, 0.0).otherwise(0.3) - F.when(F.get(counts, 0) < 2, 0.2).otherwise(0.0) - F.when(F.size(lines) < 2, 0.2).otherwise(0.0) - F.coalesce(empty, F.lit(0.0)) * 0.5
    return {"columns": F.get(counts, 0), "rows": F.size(lines), "steady": steady, "empty_ratio": F.round(empty, 6), "score": F.round(T.clamp(score), 6)}


#: Character sets of the language test; each holds the plain letters, so that plain text fits all.
LANGUAGE_SETS = {"en": "a-zA-Z", "pt": "a-zA-ZáàâãéêíóôõúçÁÀÂÃÉÊÍÓÔÕÚÇ", "es": "a-zA-ZáéíóúñüÁÉÍÓÚÑÜ", "fr": "a-zA-Zàâçéèêëîïôùûüÿ"}


def language_consistency(text: Column) -> Column:
    """.7 if more than one language has a tenth of the letters, else 1; nearly any plain text fits several (kept as it is)."""
    n = F.greatest(F.length(text), F.lit(1))
    many = reduce(lambda a, b: a + b, ((T.times(text, f"[{s}]") / n >= 0.1).cast("int") for s in LANGUAGE_SETS.values()))
    return F.when(T.strip(text) == "", 0.0).when(many > 1, 0.7).otherwise(1.0)


def runs(lines: DataFrame, kind: Column) -> DataFrame:
    """(document_id, kind, first, n): islands of neighbouring lines of one kind; null kinds belong to none."""
    tagged = lines.withColumn("kind", kind)
    order = Window.partitionBy("document_id").orderBy("line")
    new = (~F.col("kind").eqNullSafe(F.lag("kind").over(order))).cast("int")
    return tagged.withColumn("_new", new).withColumn("run", F.sum("_new").over(order)).where("kind IS NOT NULL").groupBy("document_id", "run", "kind").agg(F.min("line").alias("first"), F.count(F.lit(1)).alias("n")).drop("run")


def list_kind(line: Column) -> Column:
    return F.when(line.rlike(r"^\s*\d+[.)]\s+"), "numbered").when(line.rlike(r"^\s*[-*•]\s+"), "bulleted").when(line.rlike(r"(?i)^\s*[ivx]+[.)]\s+"), "roman").when(line.rlike(r"^\s*[a-zA-Z][.)]\s+"), "lettered")


#: Words that mark sections, by profile.
PROFILES = {
    "academic": ("abstract", "resumo", "introdução", "introduction", "método", "results", "conclusion", "conclusão"), "technical": ("install", "usage", "configuration", "requirements", "api"),
    "legal": ("cláusula", "clause", "artigo", "article", "whereas"), "business": ("executive", "market", "strategy", "financial", "revenue"), "narrative": ("chapter", "capítulo", "part", "parte"),
}


def profiled_sections(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(document_id, section, profile, words, confidence): sections that start at short lines after blank ones, or at profile words.

    Sections of under five words go; small neighbours of one profile are merged.
    """
    lines = docs.select(F.col(id_col).alias("document_id"), F.posexplode(F.split(text_col, "\n")).alias("line", "t"))
    order = Window.partitionBy("document_id").orderBy("line")
    profile = F.lit(None).cast("string")
    for name, parts in reversed(list(PROFILES.items())):
        profile = F.when(reduce(lambda a, b: a | b, (F.contains(F.lower("t"), F.lit(p)) for p in parts)), name).otherwise(profile)
    blank = F.coalesce(T.strip(F.lag("t").over(order)) == "", F.lit(True))
    n = F.size(T.words(F.col("t")))
    sure = F.when(blank, 0.4).otherwise(0.0) + F.when(n.between(1, 8), 0.3).otherwise(0.0) + F.when(profile.isNotNull() & (n <= 8), 0.3).otherwise(0.0)
    cut = lines.withColumn("sure", sure).withColumn("profile", profile).withColumn("section", F.sum((F.col("sure") >= 0.6).cast("int")).over(order))
    whole = cut.groupBy("document_id", "section").agg(F.coalesce(F.min_by("profile", F.when(F.col("profile").isNotNull(), F.col("line"))), F.lit("general")).alias("profile"), F.sum(n).alias("words"), F.max("sure").alias("confidence")).where("words >= 5")
    by = Window.partitionBy("document_id").orderBy("section")
    apart = ~((F.lag("profile").over(by) == F.col("profile")) & (F.lag("words").over(by) < 100) & (F.col("words") < 100))
    merged = whole.withColumn("_g", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(by))
    return merged.groupBy("document_id", F.col("_g").cast("int").alias("section"), "profile").agg(F.sum("words").alias("words"), F.round(F.max("confidence"), 6).alias("confidence"))


def line_class(line: Column) -> Column:
    s = T.strip(line)
    return F.when(s == "", "empty").when(s.rlike(r"^#{1,6}\s"), "heading").when(list_kind(line).isNotNull(), "list").when(F.contains(line, F.lit("|")), "table").when(s.rlike("^[A-Z][A-Z\\s]{2,}$"), "heading").when(s.rlike("^>"), "quote").otherwise("text")


def located(issues: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Adds line, column, page and the text around each failure's position."""
    texts = docs.select(F.col(id_col).alias("document_id"), F.col(text_col).alias("_t"))
    before = F.substring(F.col("_t"), F.lit(1), F.col("position"))
    joined = issues.join(texts, "document_id")
    return joined.withColumn("line", F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).withColumn("column", F.length(F.substring_index(before, "\n", -1)) + 1).withColumn("page", (F.floor(F.col("position") / 2000) + 1).cast("int")).withColumn(
        "around", F.substring(F.col("_t"), F.greatest(F.lit(1), F.col("position") - 49), F.lit(100))
    ).drop("_t")


def in_sections(issues: DataFrame, secs: DataFrame) -> DataFrame:
    """Failures with the title of the section that holds their position: the last one that starts no later."""
    found = asof_join(issues, secs.select("document_id", "start", "number", "title"), ["document_id"], "position", "start", ["number"])
    return found.withColumn("title", F.coalesce("match.title", F.lit("Unknown section"))).drop("match")


def hierarchy_check(secs: DataFrame) -> DataFrame:
    """(document_id, skips, imbalance, empties, score): level jumps over one, sections five times or a tenth of the mean, empty ones."""
    order = Window.partitionBy("document_id").orderBy("number")
    mean = F.avg("words").over(Window.partitionBy("document_id"))
    marked = secs.withColumn("_skip", (F.col("level") - F.lag("level").over(order) > 1)).withColumn("_odd", (F.col("words") > 5 * mean) | (F.col("words") < 0.1 * mean))
    out = marked.groupBy("document_id").agg(F.count_if("_skip").alias("skips"), F.count_if("_odd").alias("imbalance"), F.count_if(F.col("words") == 0).alias("empties"))
    return out.withColumn("score", F.round(F.greatest(F.lit(0.0), 1 - 0.2 * F.col("skips") - 0.1 * F.col("imbalance") - 0.05 * F.col("empties")), 6))
