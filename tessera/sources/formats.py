"""Readers of text formats: HTML, XML, RTF, JSON and plain bytes to text, HTML tables, CSV to rows, and the type of a file.

Binary office formats, PDF, images, audio and video need libraries that are not at hand; what they yield enters as text
or as rows. HTML, XML, RTF and JSON are parsed in Arrow batches by the standard library; all else runs in the JVM.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

#: File types by extension.
EXTENSIONS = {
    "pdf": "pdf", "docx": "docx", "doc": "docx", "xlsx": "xlsx", "xls": "xlsx", "pptx": "pptx", "ppt": "pptx", "txt": "txt", "csv": "csv", "rtf": "rtf",
    "html": "html", "htm": "html", "xml": "xml", "png": "image", "jpg": "image", "jpeg": "image", "gif": "image", "bmp": "image", "tiff": "image", "tif": "image", "webp": "image",
}
#: First bytes by type, in hexadecimal.
MAGIC = (("25504446", "pdf"), ("504B0304", "docx"), ("89504E47", "image"), ("FFD8FF", "image"), ("47494638", "image"), ("7B5C727466", "rtf"))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def type_by_extension(path: Column) -> Column:
    kinds = F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair))
    return F.coalesce(F.get(F.array(F.element_at(kinds, extension(path))), 0), F.lit("unknown"))


def _lacks(part: str):
    return lambda x: ~F.contains(x, F.lit(part))


def type_by_content(path: Column, content: Column) -> Column:
    """Struct (kind, subtype, confidence): by extension, first bytes and marks in the first ten thousand characters."""
    head = F.substring(content, 1, 10_000)
    low, magic = F.lower(head), F.hex(F.substring(content, 1, 8))
    kind = type_by_extension(path)
    by_bytes = F.lit(None).cast("string")
    for first, name in reversed(MAGIC):
        by_bytes = F.when(F.startswith(magic, F.lit(first)), name).otherwise(by_bytes)
    kind = F.when(kind != "unknown", kind).otherwise(F.coalesce(by_bytes, F.when(low.rlike("<html|<body"), "html").when(F.startswith(F.ltrim(low), F.lit("<?xml")), "xml").otherwise("txt")))
    lines = F.slice(F.split(head, "\n"), 1, 10)
    full = F.filter(lines, lambda x: T.strip(x) != "")
    rows = F.lit(False)
    for d in (",", "\t", ";", "|"):
        rows |= F.size(F.filter(full, _lacks(d))) == 0
    structured = (F.size(lines) > 1) & head.rlike("[\t,]") & rows
    markup = low.rlike(r"<html|<xml|<\?xml|<body")
    code = ~markup & head.rlike("def |function |class |import ")
    sub = F.array_join(F.array_compact(F.array(F.when(structured, "structured"), F.when(markup, "markup"), F.when(code, "code"), F.lit("plain_text"))), ",")
    sure = 0.8 + F.when(structured, 0.1).otherwise(0.0) + F.when(markup | code, 0.1).otherwise(0.0)
    return F.struct(kind.alias("kind"), sub.alias("subtype"), F.round(T.clamp(sure, 0.1), 2).alias("confidence"))


class Node:
    """An element of a parsed page: tag, attributes and children, texts being strings among them."""

    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []

    def find(self, *tags: str) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            if node is not self and node.tag in tags:
                yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def strings(self) -> list[str]:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                stack += reversed(node.children)
        return out

    def text(self) -> str:
        return "".join(self.strings()).strip()


VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SKIPPED = frozenset(("script", "style"))
CLOSES = {"li": ("li",), "p": ("p",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


class Tree(HTMLParser):
    def __init__(self, markup: str) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open, self.skip, self.elements = [self.root], 0, 0
        self.feed(markup)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.elements += 1
        if tag in SKIPPED:
            self.skip += 1
            return
        if tag in CLOSES and self.open[-1].tag in CLOSES[tag]:
            while self.open[-1].tag in CLOSES[tag]:
                self.open.pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif any(n.tag == tag for n in self.open[1:]):
            while self.open.pop().tag != tag:
                pass

    def handle_data(self, data):
        if not self.skip:
            self.open[-1].children.append(data)


def html_text(markup: str) -> str:
    """Title, headers by level, block texts, tables row by row, and list items of a page."""
    root = Tree(markup).root
    out = [f"Title: {t}" for n in list(root.find("title"))[:1] if (t := n.text())]
    out += [f"H{i}: {t}" for i in range(1, 7) for n in root.find(f"h{i}") if (t := n.text())]
    out += [t for n in root.find("p", "div", "article", "section", "main") if (t := n.text()) and not re.match(r"H[1-6]:", t)]
    for table in root.find("table"):
        out.append("=== Table ===")
        out += [" | ".join(cells) for row in table.find("tr") if (cells := [t for c in row.find("td", "th") if (t := c.text())])]
    out += [f"• {t}" for lst in root.find("ul", "ol") for n in lst.find("li") if (t := n.text())]
    return "\n".join(out)


def html_tables(markup: str) -> list[tuple[int, int, str]]:
    """(index, rows, text) of a page's tables with content: cells joined, a rule of dashes under the first row."""
    out = []
    for i, table in enumerate(Tree(markup).root.find("table")):
        rows, lines = list(table.find("tr")), [f"=== TABELA HTML {i} ==="]
        for k, row in enumerate(rows):
            if cells := [c.text() for c in row.find("th", "td")]:
                lines.append(" | ".join(cells))
                if k == 0:
                    lines.append("-" * min(80, len(lines[-1])))
        if len(lines) > 2:
            out.append((i, len(rows), "\n".join(lines)))
    return out


def html_outline(markup: str) -> dict:
    """Counts and parts of a page: title, description, headings, links, images, tables, forms, lists, text share, remarks."""
    root = Tree(markup).root
    title = next((n.text() for n in root.find("title")), "")
    description = next((n.attrs.get("content", "") for n in root.find("meta") if n.attrs.get("name", "").lower() == "description"), "")
    count = lambda *tags: sum(1 for _ in root.find(*tags))
    text = root.text()
    remarks = [r for r, bad in (("no title", not title), ("no description", not description), ("no h1", not count("h1")), ("several h1", count("h1") > 1), ("images without alt", any(not n.attrs.get("alt") for n in root.find("img")))) if bad]
    share = round(100 * len(text) / max(1, len(markup)), 2)
    return {
        "title": title, "description": description, "headings": count("h1", "h2", "h3", "h4", "h5", "h6"), "paragraphs": count("p"), "links": count("a"), "images": count("img"), "tables": count("table"), "forms": count("form"),
        "lists": count("ul", "ol"), "chars": len(text), "share": share, "remarks": remarks, "rating": "GOOD" if len(remarks) <= 1 else "FAIR" if len(remarks) <= 3 else "POOR",
    }


CONTENTS = (
    "title string, description string, headings array<struct<level:int,text:string>>, paragraphs array<string>, links array<struct<url:string,text:string>>, images array<struct<src:string,alt:string,title:string>>, "
    "tables array<struct<headers:array<string>,rows:array<array<string>>,columns:int>>, "
    "forms array<struct<action:string,method:string,fields:array<struct<type:string,name:string,id:string,placeholder:string,required:boolean,input_type:string,options:array<string>>>>>, "
    "lists array<struct<kind:string,items:array<string>>>, text string, elements int, extracted int, percent double"
)


def _table(node: Node) -> dict:
    """Headers are those of the table's head or of the first row with a header cell; the other rows with cells are its rows."""
    cells = lambda of: [c.text() for c in of.find("th", "td")]
    head, body = next(node.find("thead"), None), next(node.find("tbody"), node)
    headers, rows = cells(head) if head else [], []
    for row in body.find("tr"):
        if not headers and next(row.find("th"), None):
            headers = cells(row)
        elif found := cells(row):
            rows.append(found)
    return {"headers": headers, "rows": rows, "columns": len(headers) or (len(rows[0]) if rows else 0)}


def _form(node: Node) -> dict:
    fields = []
    for f in node.find("input", "textarea", "select"):
        given = {k: f.attrs.get(k, "") for k in ("name", "id", "placeholder")}
        kind = f.attrs.get("type", "text") if f.tag == "input" else None
        fields.append({"type": f.tag, **given, "required": "required" in f.attrs, "input_type": kind, "options": [o.text() for o in f.find("option")] if f.tag == "select" else None})
    return {"action": node.attrs.get("action", ""), "method": node.attrs.get("method", "GET").upper(), "fields": fields}


def html_contents(markup: str) -> dict:
    """All parts of a page with their contents, as CONTENTS lists them; percent: parts that were taken among all elements."""
    tree = Tree(markup)
    root = tree.root
    title = next((n.text() for n in root.find("title")), None)
    meta = next((n.attrs.get("content", "") for n in root.find("meta") if n.attrs.get("name") == "description"), "").strip()
    out = {
        "title": title or "", "description": meta, "headings": [{"level": i, "text": n.text()} for i in range(1, 7) for n in root.find(f"h{i}")], "paragraphs": [t for n in root.find("p") if (t := n.text())],
        "links": [{"url": n.attrs["href"], "text": n.text()} for n in root.find("a") if "href" in n.attrs], "images": [{k: n.attrs.get(k, "") for k in ("src", "alt", "title")} for n in root.find("img")],
        "tables": [_table(n) for n in root.find("table")], "forms": [_form(n) for n in root.find("form")], "lists": [{"kind": n.tag, "items": [i.text() for i in n.find("li")]} for n in root.find("ul", "ol")],
    }
    parts = (title is not None) + bool(meta) + sum(len(out[k]) for k in ("headings", "paragraphs", "links", "images", "tables", "forms", "lists"))
    text = " ".join(t for s in root.strings() if (t := s.strip()))
    return out | {"text": text, "elements": tree.elements, "extracted": parts, "percent": round(100 * parts / tree.elements, 4) if tree.elements else 0.0}


def xml_text(markup: str) -> str:
    """`tag: text` lines of leaves and `=== tag ===` of other elements with text, two spaces deeper for each level; nothing for broken XML."""
    try:
        root = ElementTree.fromstring(markup)
    except ElementTree.ParseError:
        return ""
    out, stack = [], [(root, 0)]
    while stack:
        node, depth = stack.pop()
        if text := "".join(node.itertext()).strip():
            out.append("  " * depth + (f"{node.tag}: {text}" if len(node) == 0 else f"=== {node.tag} ==="))
        stack += [(c, depth + 1) for c in reversed(node)]
    return "\n".join(out)


RTF = re.compile(r"\\([\\{}])|\\'([0-9a-fA-F]{2})|\\[^\s{}]*[ \n\r\t]?|[{}]")


def rtf_text(markup: str) -> str:
    """RTF without control words and groups, `\\'hh` as characters; lines stripped, empty ones left out."""
    plain = RTF.sub(lambda m: m[1] or (chr(int(m[2], 16)) if m[2] else ""), markup)
    return "\n".join(x for line in plain.split("\n") if (x := line.strip()))


def plain_text(data: bytes) -> str:
    """Bytes as text: UTF-8 with or without its mark, UTF-16 with its mark, else Latin-1 in its Windows form."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(name, "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("cp1252", "replace")


def json_text(value: str) -> str:
    """Nested JSON as `key: value` lines, two spaces deeper for each level; nothing for broken JSON."""
    try:
        top = json.loads(value)
    except ValueError:
        return ""
    out = []

    def walk(x, depth: int) -> None:
        for k, v in x.items() if isinstance(x, dict) else enumerate(x):
            nested = isinstance(v, (dict, list))
            out.append("  " * depth + f"{k}:" + ("" if nested else f" {'' if v is None else v}"))
            if nested:
                walk(v, depth + 1)

    walk(top if isinstance(top, (dict, list)) else [top], 0)
    return "\n".join(out)


def parsed(frame: DataFrame, id_col: str, content_col: str, function: Callable, kind: str) -> DataFrame:
    """(id, value) of a parser applied to every row in Arrow batches; null content gives null."""
    kinds = {"string": pa.string(), "tables": pa.list_(pa.struct([("index", pa.int32()), ("rows", pa.int32()), ("text", pa.string())]))}
    schema = {"string": "string", "tables": "array<struct<index:int,rows:int,text:string>>"}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [None if v is None else function(v) for v in batch.column(1).to_pylist()]
            if kind == "tables":
                values = [v if v is None else [{"index": i, "rows": r, "text": t} for i, r, t in v] for v in values]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, kinds[kind])], ["id", "value"])

    return frame.select(F.col(id_col).cast("long").alias("id"), content_col).mapInArrow(run, f"id long, value {schema}")


DELIMITERS = (",", ";", "\t", "|")


def delimiter(text: Column) -> Column:
    """The first of comma, semicolon, tab and bar that stands in the first kilobyte; comma without any."""
    out = F.lit(",")
    for d in reversed(DELIMITERS):
        out = F.when(F.contains(F.substring(text, 1, 1024), F.lit(d)), F.lit(d)).otherwise(out)
    return out


def csv_cells(line: Column, sep: Column) -> Column:
    """Fields of one line; quoted ones may hold the separator and doubled quotes."""
    s = F.when(sep == "|", r"\|").when(sep == "\t", r"\t").otherwise(sep)
    pattern = F.concat(F.lit("(?:^|"), s, F.lit(')("(?:[^"]|"")*"|[^'), s, F.lit("]*)"))
    plain = lambda c: F.when(F.startswith(c, F.lit('"')), F.replace(F.regexp_replace(c, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(c)
    return F.transform(F.regexp_extract_all(line, pattern, F.lit(1)), plain)


def csv_rows(files: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row, cells): rows of CSV texts as maps of header to cell, all-empty rows left out; headers without names are Column_n."""
    lines = files.select(F.col(id_col).alias("id"), delimiter(F.col(text_col)).alias("sep"), F.posexplode(F.split(text_col, "\r?\n")).alias("row", "line"))
    cells = lines.withColumn("cells", csv_cells(F.col("line"), F.col("sep")))
    names = F.transform(F.first("cells").over(Window.partitionBy("id").orderBy("row")), lambda h, i: F.when(F.btrim(h) == "", F.concat(F.lit("Column_"), (i + 1).cast("string"))).otherwise(F.btrim(h)))
    full = cells.withColumn("names", names).where((F.col("row") > 0) & F.exists("cells", lambda c: F.btrim(c) != ""))
    n = F.least(F.size("names"), F.size("cells"))
    return full.select("id", "row", F.map_from_arrays(F.slice("names", 1, n), F.transform(F.slice("cells", 1, n), lambda c: F.nullif(F.btrim(c), F.lit("")))).alias("cells"))


def typed_cell(cell: Column) -> Column:
    """Struct (kind, number, text): int, then float with a decimal comma or point, else text; empty is null."""
    c = F.nullif(F.btrim(cell), F.lit(""))
    number = F.replace(c, F.lit(","), F.lit(".")).try_cast("double")
    kind = F.when(c.isNull(), None).when(c.rlike(r"^[+-]?\d{1,18}$"), "int").when(number.isNotNull(), "float").otherwise("text")
    return F.struct(kind.alias("kind"), number.alias("number"), c.alias("text"))
