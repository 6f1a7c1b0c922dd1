"""Operators that SQL cannot express, against plain Python, and properties of those it can."""

import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import queries as Q
from tessera.functions import text as T
from tessera.operators import answering as A
from tessera.operators import chunking as C
from tessera.operators import fusion as E
from tessera.operators import lexical as L
from tessera.operators import quality as G
from tessera.operators import vectors as V
from tessera.operators.folds import charged
from tessera.sources import formats as S

TEXTS = ["", "One. Two! Three? Four", "a" * 2500, "Word " * 400, "First para.\n\nSecond one here.\n\n" + "x" * 900, "Ends with space. \n\n \n\nNext."]


def column(spark, texts, make):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", make(F.col("t")).alias("v")).orderBy("i").collect()
    return [r["v"] for r in rows]


def test_fixed_slices_give_the_text_back(spark):
    assert ["".join(v) for v in column(spark, TEXTS, lambda c: T.slices(c, 1000))] == TEXTS


def test_overlap_must_be_smaller_than_size(spark):
    with pytest.raises(ValueError):
        T.slices(F.lit("x"), 10, 10)


def sentence_pack(text, size):
    out, cur = [], ""
    for s in filter(None, (x.strip() for x in re.split(r"(?<=[.!?])\s+", text))):
        if cur and len(cur) + len(s) + 1 > size:
            out.append(cur)
            cur = s
        else:
            cur = f"{cur} {s}" if cur else s
    return out + [cur] if cur else out


def test_sentence_packing(spark):
    assert column(spark, TEXTS, lambda c: C.by_sentences(c, 12)) == [sentence_pack(t, 12) for t in TEXTS]


def test_paragraph_packing_keeps_all_text(spark):
    for text, parts in zip(TEXTS, column(spark, TEXTS, lambda c: C.by_paragraphs_or_size(c, 300, 0)), strict=True):
        assert "".join("".join(parts).split()) == "".join(text.split())


def test_structure():
    text = "An introduction that is long enough to be kept as a part of its own.\n1. First item\nmore of it\n2. Second item"
    assert [(k, n) for _, k, n in C.structure(text)] == [("intro", None), ("numbered_item", 1), ("numbered_item", 2)]
    assert C.structure("no items here") == []
    assert C.structure("") == []


def test_marginal_relevance_is_a_permutation():
    rng = np.random.default_rng(0)
    v, r = rng.standard_normal((20, 8)), rng.random(20)
    order = E.mmr_order(v, r, 0.7)
    assert sorted(order) == list(range(20))
    assert order[0] == int(r.argmax())
    assert E.mmr_order(v, r, 1.0) == list(np.argsort(-r, kind="stable"))


def test_bullets_one_for_each_topic():
    tok = lambda s: frozenset(s.split())
    rows = [("a", 0, 2.0, tok("a b"), "coa"), ("b", 1, 1.9, tok("c d"), "coa"), ("c", 2, 1.0, tok("e f"), "misc"), ("d", 3, 0.9, tok("e f"), "portfolio"), ("t", 4, 9.0, tok("z"), "testimonial")]
    picked = A.pick_bullets(rows, 3, 5)
    assert picked[:2] == [0, 2]
    assert 4 in picked
    assert A.pick_bullets([], 3, 5) == []


def test_numbered_items():
    assert A.numbered_items("1. one\n2) two\n2. again") == [(1, "one"), (2, "again")]
    assert A.numbered_items("see 1. first thing 2. second thing")[:2] == [(1, "first thing"), (2, "second thing")]
    assert A.numbered_items(None) == []


def test_quotes(spark):
    got = column(spark, ["he said “this is it” twice", "No quote. Second.", ""], A.quote)
    assert got == ["“this is it”", "“No quote.”", f"“{A.NO_QUOTE}”"]


def test_quota_charges_skip_rejected(spark):
    rows = spark.createDataFrame([(1, 1, 60), (1, 2, 50), (1, 3, 40), (2, 1, 101)], "u int, id long, n long")
    got = {r["id"]: r["accepted"] for r in charged(rows.where("u = 1"), 100, ["u"], ["id"], "n", "id").collect()}
    assert got == {1: True, 2: False, 3: True}


def test_simplified_queries(spark):
    got = column(spark, ["o que diz a cláusula 12 sobre multa rescisória contratual atraso", "de da do", "1ab 2ab 3ab 4ab 5ab 6ab palavra"], Q.simplified)
    assert got[0].split()[0] == "cláusula" or "12" not in got[0]
    assert got[1] == "de da do"
    assert got[2] == "1ab 2ab 3ab 4ab 5ab 6ab"


def test_query_problems(spark):
    assert column(spark, [None, " ", "ab", "me fale", "receita de bolo de milho", "?!?!"], Q.problems) == [["empty"], ["empty"], ["short"], ["generic"], ["out_of_scope"], ["no_letters"]]


def test_fallback_takes_the_first_level_with_rows(spark):
    a = spark.createDataFrame([(1, 10)], "query_id int, id long")
    b = spark.createDataFrame([(1, 11), (2, 12)], "query_id int, id long")
    assert {(r.query_id, r.level, r.id) for r in L.fallback_levels([a, b]).collect()} == {(1, 1, 10), (2, 2, 12)}


def test_full_text_cascade(spark):
    chunks = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "alpha beta"), (3, "omega")], "id long, content string")
    q = spark.createDataFrame([(1, "alpha beta"), (2, "alpha beta zeta sigma"), (3, "omega zeta sigma theta"), (4, "nothing")], "query_id int, query string")
    got = {(r.query_id, r.level, r.id) for r in L.full_text(chunks, q, 5).collect()}
    assert got == {(1, 1, 1), (1, 1, 2), (2, 2, 1), (2, 2, 2), (3, 3, 3)}


def test_fusion_does_not_depend_on_row_order(spark):
    v = spark.createDataFrame([(1, i, i % 3, i + 1) for i in range(9)], "query_id int, id long, document_id long, rank int")
    k = spark.createDataFrame([(1, i, i % 3, 9 - i) for i in range(3, 9)], "query_id int, id long, document_id long, rank int")
    one = [tuple(r) for r in E.fused(v, k, 5).orderBy("rank").collect()]
    two = [tuple(r) for r in E.fused(v.orderBy(F.desc("id")), k.orderBy("id"), 5).orderBy("rank").collect()]
    assert one == two
    assert one[0][4] == 1.0
    only = E.fused(v.where("false"), k, 5).orderBy("rank").collect()
    assert {r.sources for r in only} == {"keyword"}


def test_headers_and_sections(spark):
    doc = spark.createDataFrame([(1, "# Top\ntext here\n## Inner\nmore text\n# Results\nend"), (2, "no headers, just text in here."), (3, "")], "doc_id long, text string")
    found = G.headers(doc, "doc_id", "text")
    got = [(r.document_id, r.level, r.title) for r in found.orderBy("document_id", "line").collect() if r.kind == "markdown"]
    assert got == [(1, 1, "Top"), (1, 2, "Inner"), (1, 1, "Results")]
    secs = G.parents(G.sections(doc, found, "doc_id", "text"))
    assert {r.document_id for r in secs.collect()} == {1, 2, 3}
    assert [r.parent for r in secs.where("document_id = 1").orderBy("number").collect()] == [None, 1, None]


def test_failures_positions(spark):
    doc = spark.createDataFrame([(1, "ok &amp; \\u00e9 �� end"), (2, None)], "doc_id long, text string")
    got = {(r.pattern, r.position, r.content) for r in G.failures(doc, "doc_id", "text").collect()}
    assert {("html_entities", 3, "&amp;"), ("escaped_unicode", 9, "\\u00e9"), ("utf8_corruption", 16, "��")} <= got


def test_failures_of_every_kind(spark):
    gap, long_row = "\n" * 21, "|" + "c" * 200 + "|d|"
    texts = {
        "non_standard_chars": ("ab\u0416\u0416\u0416", 2, 0.6), "mixed_alphanumeric": ("x a12b", 2, 0.5), "repeated_punctuation": ("so...", 2, 0.7),
        "large_whitespace_gap": (f"a{gap}b", 1, 0.5), "corrupted_table": (long_row, 0, 0.6), "windows1252_quotes": ('say "', 4, 0.33),
    }
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(texts.values())] + [(90, "||| "), (91, "|a|b|"), (92, "\ta\tb\t"), (93, "a\n\n\n\nb")], "doc_id long, text string")
    got = G.failures(docs, "doc_id", "text").collect()
    for i, (name, (_, position, sure)) in enumerate(texts.items()):
        assert [(r.position, round(r.confidence, 6)) for r in got if r.document_id == i and r.pattern == name] == [(position, sure)]
    rows = {r.document_id for r in got if r.pattern == "corrupted_table"}
    assert rows == {4, 90, 92}
    assert 93 not in {r.document_id for r in got if r.pattern == "large_whitespace_gap"}
    counts = {(r.document_id, r.pattern): r.n for r in G.failure_counts(docs, "doc_id", "text").collect()}
    assert counts == {(d, p): sum(1 for r in got if (r.document_id, r.pattern) == (d, p)) for d, p in {(r.document_id, r.pattern) for r in got}}


PAGE = "<html><head><title>T</title><style>p{}</style></head><body><h1>Head</h1><p>One<p>Two</p><ul><li>a<li>b</ul><table><tr><th>k<th>v</tr><tr><td>1</td><td>2</td></tr></table><script>x</script></body></html>"


def test_html():
    text = S.html_text(PAGE)
    assert text.split("\n") == ["Title: T", "H1: Head", "One", "Two", "=== Table ===", "k | v", "1 | 2", "• a", "• b"]
    assert S.html_tables(PAGE) == [(0, 2, "=== TABELA HTML 0 ===\nk | v\n-----\n1 | 2")]
    assert S.html_text("") == ""
    assert S.html_outline(PAGE)["headings"] == 1


def test_xml_rtf_json_bytes():
    assert S.xml_text("<a><b>x</b><c/></a>") == "=== a ===\n  b: x"
    assert S.xml_text("<broken") == ""
    assert S.rtf_text(r"{\rtf1\ansi\b bold\b0  caf\'e9 \{x\}}") == "bold café {x}"
    assert S.json_text('{"a": {"b": [1, null]}}') == "a:\n  b:\n    0: 1\n    1: "
    assert S.plain_text("é".encode("cp1252")) == "é"
    assert S.plain_text("\ufeffé".encode("utf-16-le")) == "é"


def test_pattern_language(spark):
    got = column(spark, ["the cat and the dog for you with that is in of to a", "der die das und in zu den von mit auf"], lambda c: F.array_max(L.language_scores(c))["language"])
    assert got == ["en-US", "de"]


def test_topic_bounds_are_those_of_sql(spark):
    """A letter beyond ASCII ends a word, and only \n ends a line."""
    got = column(spark, ["ámg", "5 mgé", "omg", "x_cbd", "quantidade\rindicada", "quantidade\nindicada", "İSO"], A.topic)
    assert got == ["dosage_consistency", "dosage_consistency", "misc", "misc", "coa", "misc", "certifications"]


def test_cached_vectors_are_those_of_the_whole_text(spark):
    """Texts that differ in blanks alone share a key, but not a vector."""
    texts = spark.createDataFrame([(1, "a b"), (2, " a b"), (3, "a b "), (4, "c")], "id long, content string")
    embed = lambda c: V.local_embedding(c, 3)
    cache = texts.where("id IN (1, 2)").select(F.sha2(F.btrim("content"), 256).alias("key"), F.sha2("content", 256).alias("whole"), embed(F.col("content")).alias("embedding"))
    got = {r.id: (r.embedding, r.cached) for r in V.embed_misses(texts, cache, embed).collect()}
    assert got == {r.id: (r.e, r.id < 4) for r in texts.select("id", embed(F.col("content")).alias("e")).collect()}


def test_table_rows_of_long_lines(spark):
    """Lines without bars and tabs took the square of their length: these took over a minute each."""
    texts = ["a|b|c\nd|e\n|| x |\n\na\tb\tc\rd\t", "x" * 300_000 + "\n" + "| y |" + "z" * 300_000, "\t" + "w" * 300_000]
    began = time.monotonic()
    assert column(spark, texts, lambda c: G.content_elements(c)["pipe_tables"]) == [2, 1, 0]
    assert column(spark, texts, lambda c: G.content_elements(c)["tab_tables"]) == [1, 0, 0]
    assert time.monotonic() - began < 30


def test_language_scores_look_at_each_text_once(spark):
    """By one list of words, and not by a pattern for each; a word listed twice counts twice."""
    plan = spark.createDataFrame([("x",)], "t string").select(L.language_scores(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "extract_all" not in plan and "regexp_count" not in plan
    got = column(spark, ["Uma casa", "casa-da\nno mar", "", None], lambda c: F.filter(L.language_scores(c), lambda x: x["language"] == "pt-BR")[0]["score"])
    assert got == [4.0, 2.0, 0.0, None]
