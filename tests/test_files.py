"""A folder of mixed files, and documents whose sentences are all unfit for bullets."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import answering as A
from tessera.operators import postings as P
from tessera.sources.files import read_folder


@pytest.fixture
def folder(tmp_path):
    files = {
        "a.txt": "plain words\n".encode(), "b.HTML": b"<html><head><title>T</title></head><body><h1>Head</h1><p>Para</p></body></html>", "c.xml": b"<r><x>1</x></r>", "broken.xml": b"<r><x>1</r>", "d.json": b'{"k": [1, 2]}',
        "broken.json": b'{"k": ', "e.csv": b"id;name\n1;\"x;y\"\n;;\n", "f.rtf": rb"{\rtf1 Hello\par World}", "g.pdf": b"%PDF-1.4", "noext": b"<!doctype><HTML><body><p>hi</p></body></HTML>", "latin.txt": "café".encode("cp1252"),
        "empty.txt": b"", "sub/deep.txt": b"below", "large.txt": b"x" * 5000,
    }
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    return str(tmp_path)


def test_folder(spark, folder):
    got = {r.name: r for r in read_folder(spark, folder, most=2000).collect()}
    assert len(got) == 13  # Spark's reader leaves out the empty one
    text = {n: r.text for n, r in got.items()}
    assert text["a.txt"].strip() == "plain words" and text["deep.txt"] == "below" and text["latin.txt"] == "café"
    assert "Title: T" in text["b.HTML"] and "Head" in text["b.HTML"] and "hi" in text["noext"]
    assert text["e.csv"] == "id | name\n1 | x;y" and "Hello" in text["f.rtf"] and "x: 1" in text["c.xml"] and text["d.json"].startswith("k:")
    assert {n: r.kind for n, r in got.items() if r.error} == {"broken.xml": "xml", "broken.json": "json", "g.pdf": "pdf", "large.txt": "oversized"}
    assert got["large.txt"].size == 5000 and got["g.pdf"].error == "ValueError: no reader for pdf"


def test_policies(spark, folder):
    assert {r.name for r in read_folder(spark, folder, "drop").collect()} & {"broken.xml", "broken.json", "g.pdf"} == set()
    with pytest.raises(Exception, match="no reader for pdf|not well-formed|mismatched|Expecting"):
        read_folder(spark, folder, "fail").collect()
    with pytest.raises(ValueError, match="policies"):
        read_folder(spark, folder, "ignore")


def test_bullets_of_unfit_sentences(spark):
    rows = [(1, i, t) for i, t in enumerate(["  short one ", "tiny", "small bit", "scrap", "more"])] + [(2, 0, "A sentence that is long enough to be a bullet of its own.")]
    got = {}
    for r in A.summary_bullets(spark.createDataFrame(rows, "document_id long, ord int, text string")).orderBy("document_id", "pos").collect():
        got.setdefault(r.document_id, []).append(r.text)
    assert got == {1: ["short one", "tiny", "small bit"], 2: ["A sentence that is long enough to be a bullet of its own"]}


def test_fallback_levels(spark):
    rows = [(1, n, f"alpha beta number{n}") for n in range(3)] + [(2, n, f"gamma delta number{n}") for n in range(9)] + [(3, 0, "omega")]
    chunks = spark.createDataFrame([(d * 100 + n, d, n, c) for d, n, c in rows], "id long, document_id long, ord int, content string")
    block = lambda d: F.floor(d / 2)
    index = P.positional_index(chunks, block(F.col("document_id")))
    asked = [(1, "alpha", 1), (2, "nothing gamma", 2), (3, "nothing", 1), (4, "nothing", 2), (5, "alpha", 2), (6, "alpha", 9)]
    queries = spark.createDataFrame(asked, "query_id long, query string, document_id long")
    wordings = [F.col("query"), F.concat("query", F.lit(" omega")), F.when(F.col("query_id") == 5, "delta number4").otherwise(F.col("query"))]
    got = {}
    for r in P.with_fallbacks(index, block, chunks, queries, wordings, 2, whole=5, beginning=4).collect():
        got.setdefault((r.query_id, r.level), set()).add(r.id)
    assert got == {(1, 1): {100, 101}, (2, 1): {200, 201}, (3, 4): {100, 101, 102}, (4, 4): {200, 201, 202, 203}, (5, 3): {204}}


PAGE = """<html><head><title> T </title><meta name="description" content=" about "><style>p{}</style></head><body><h2>Two</h2><h1>One</h1><p>First <b>bold</b><p>Second
<a href="/x">link</a><a name="no">none</a><img src="i.png" alt="pic"><img>
<table><thead><tr><th>A</th><th>B</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr></tbody></table><table><tr><th>k</th></tr><tr><td>v</td></tr></table>
<form action="/go" method="post"><input name="q" required><textarea id="t"></textarea><select name="s"><option>a<option>b</select></form><ul><li>x<li>y</ul><script>var p = "</p>";</script></body></html>"""


def test_contents_of_a_page():
    from tessera.sources import formats

    c = formats.html_contents(PAGE)
    assert (c["title"], c["description"]) == ("T", "about")
    assert [(h["level"], h["text"]) for h in c["headings"]] == [(1, "One"), (2, "Two")]
    assert c["paragraphs"][0] == "First bold" and c["paragraphs"][1].startswith("Second") and len(c["paragraphs"]) == 2
    assert c["links"] == [{"url": "/x", "text": "link"}]
    assert c["images"] == [{"src": "i.png", "alt": "pic", "title": ""}, {"src": "", "alt": "", "title": ""}]
    assert c["tables"] == [{"headers": ["A", "B"], "rows": [["1", "2"]], "columns": 2}, {"headers": ["k"], "rows": [["v"]], "columns": 1}]
    (form,) = c["forms"]
    assert (form["action"], form["method"]) == ("/go", "POST")
    assert [(f["type"], f["name"], f["required"], f["input_type"], f["options"]) for f in form["fields"]] == [("input", "q", True, "text", None), ("textarea", "", False, None, None), ("select", "s", False, None, ["a", "b"])]
    assert c["lists"] == [{"kind": "ul", "items": ["x", "y"]}]
    assert "var p" not in c["text"] and c["text"].startswith("T Two One First bold Second link")
    assert c["extracted"] == 1 + 1 + 2 + 2 + 1 + 2 + 2 + 1 + 1 and c["elements"] == PAGE.count("<") - PAGE.count("</") and 0 < c["percent"] < 100
    assert formats.html_contents("")["percent"] == 0.0
