"""Chunkers: Column -> array of pieces, and frames of numbered chunks. Folds over one document's pieces run in the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

#: Chunk size, overlap and rows a chunk by document type.
SIZES = {"pdf": (1000, 150, None), "docx": (800, 120, None), "xlsx": (500, 50, 10), "pptx": (600, 80, None), "html": (900, 100, None), "txt": (1000, 150, None), "csv": (300, 30, 20)}
MIN_CHARS = 50


def by_type(text: Column, kind: Column) -> Column:
    """Size chunks at the size and overlap of the document's type; text settings for unknown types."""
    out = T.trimmed(T.slices(text, *SIZES["txt"][:2]))
    for name, (size, overlap, _) in SIZES.items():
        out = F.when(kind == name, T.trimmed(T.slices(text, size, overlap))).otherwise(out)
    return out


def normalised(text: Column) -> Column:
    """Line ends as NL, no more than one empty line in a row."""
    return F.regexp_replace(F.regexp_replace(text, "\r\n|\r", "\n"), "\n{3,}", "\n\n")


def chunk_text(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    return T.slices(normalised(text), size, overlap, whole_tail=False)


def word_windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of size / 6 words, (size - overlap) / 6 apart, started until the words end."""
    n, step = size // 6, size // 6 - overlap // 6
    w = T.words(text)
    starts = F.when(F.size(w) > 0, F.sequence(F.lit(1), F.size(w), F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " "))


def pack(pieces: Column, size: int, between: str, measure=F.length, glue: int = 0) -> Column:
    """Greedily joins pieces: one is added while the chunk's measure, the piece's and `glue` are within size.

    An empty chunk takes any piece. A fold over one document's pieces.
    """
    start = F.struct(F.lit("").alias("now"), F.array().cast("array<string>").alias("done"))

    def step(acc, x):
        full = (acc["now"] != "") & (measure(acc["now"]) + measure(x) + glue > size)
        return F.struct(
            F.when(full | (acc["now"] == ""), x).otherwise(F.concat(acc["now"], F.lit(between), x)).alias("now"),
            F.when(full, F.array_append(acc["done"], acc["now"])).otherwise(acc["done"]).alias("done"),
        )

    return F.aggregate(pieces, start, step, lambda a: F.when(a["now"] == "", a["done"]).otherwise(F.array_append(a["done"], a["now"])))


def by_sentences(text: Column, size: int) -> Column:
    """Sentences packed while they fit, each with the space that follows it counted; no overlap."""
    return pack(T.trimmed(T.sentences(text)), size, " ", glue=1)


def paragraphs(text: Column) -> Column:
    return T.trimmed(F.split(text, r"\n\s*\n"))


def by_paragraphs(text: Column, target: int = 800) -> Column:
    """Paragraphs packed up to `target` bytes."""
    return pack(paragraphs(text), target, "\n\n", F.octet_length)


def by_paragraphs_or_size(text: Column, size: int, overlap: int) -> Column:
    """Paragraphs packed up to size, a blank line counted for each; a longer one is cut by size on its own."""
    start = F.struct(F.lit("").alias("now"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("done"))

    def step(acc, x):
        flushed = F.when(acc["now"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["now"]))
        big, fits = F.length(x) > size, acc["n"] + F.length(x) + 2 <= size
        return F.struct(
            F.when(big, "").when(~fits, x).when(acc["now"] == "", x).otherwise(F.concat(acc["now"], F.lit("\n\n"), x)).alias("now"),
            F.when(big, 0).when(fits, acc["n"] + F.length(x) + 2).otherwise(F.length(x)).alias("n"),
            F.when(big, F.concat(flushed, T.trimmed(T.slices(x, size, overlap)))).when(fits, acc["done"]).otherwise(flushed).alias("done"),
        )

    return F.aggregate(paragraphs(text), start, step, lambda a: F.when(a["now"] == "", a["done"]).otherwise(F.array_append(a["done"], a["now"])))


#: Numbered items and bullets with the lines that belong to them; the groups name the item and its number.
ITEM = re.compile(r"(?:^|\n)(?P<all>(?P<n>\d+)[.)\-\s][^\n]+(?:\n(?!\d+[.)\-\s])[^\n]*)*)")
BULLET = re.compile(r"(?:^|\n)(?P<all>[•*\-]\s+[^\n]+(?:\n(?![•*\-]\s)[^\n]*)*)")
LEAST_BETWEEN = 50


def structure(text: str) -> list[tuple[str, str, int | None]]:
    """(content, kind, number) of a text's numbered items, else of its bullets, with longer text around them; else nothing."""
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r"\r\n?", "\n", text)).strip()
    for pattern, kind in ((ITEM, "numbered_item"), (BULLET, "bullet")):
        items, out, end = list(pattern.finditer(text)), [], 0
        for m in items:
            before = text[end : m.start()].strip()
            if len(before.encode()) > LEAST_BETWEEN:
                out.append((before, "intro", None))
            out.append((m["all"].strip(), kind, int(m["n"]) if kind == "numbered_item" else None))
            end = m.end()
        if items:
            rest = text[end:].strip()
            return [*out, (rest, "conclusion", None)] if len(rest.encode()) > LEAST_BETWEEN else out
    return []


def by_structure(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, ord, kind, number, content); documents without items have no rows."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k, kind, n, c) for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for k, (c, kind, n) in enumerate(structure(t.as_py() or ""))]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string()), strict=True)], ["id", "ord", "kind", "number", "content"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(found, "id long, ord int, kind string, number long, content string")


def exploded(docs: DataFrame, pieces: Column, id_col: str = "doc_id") -> DataFrame:
    return docs.select(F.col(id_col).alias("document_id"), F.posexplode(pieces).alias("ord", "content"))


TITLE = (r"^[A-Z\s\d]{5,50}$", r"^\d+[.)]\s+[A-Z]", r"^[A-Z][a-z\s]+:$")


def sections(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(document_id, section, title, content): lines that look like titles start sections; sections without text go."""
    lines = docs.select(F.col(id_col).alias("document_id"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line")).withColumn("line", T.strip(F.col("line")))
    title = F.lit(False)
    for pattern in TITLE:
        title |= F.col("line").rlike(pattern)
    numbered = lines.withColumn("is_title", title).withColumn("section", F.sum(F.col("is_title").cast("int")).over(Window.partitionBy("document_id").orderBy("pos")))
    body = F.filter(F.sort_array(F.collect_list(F.struct("pos", "is_title", "line"))), lambda x: ~x["is_title"])
    out = numbered.groupBy("document_id", "section").agg(F.coalesce(F.max(F.when(F.col("is_title"), F.col("line"))), F.lit("Início")).alias("title"), F.concat(F.array_join(F.transform(body, lambda x: x["line"]), "\n"), F.lit("\n")).alias("content"), F.count_if(~F.col("is_title")).alias("_n"))
    return out.where(F.col("_n") > 0).select("document_id", F.col("section").cast("int").alias("section"), "title", "content")


def row_groups(rows: DataFrame, key: str, order: str, line: str, header: Column, size: int, skip_header: bool = False) -> DataFrame:
    """(key, batch, rows, content): each group of `size` lines under the header."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    grouped = rows.withColumn("header", header).withColumn("batch", F.floor(n / size).cast("int")).groupBy(key, "batch")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, line))), lambda x: x[line]), "\n")
    return grouped.agg(F.count(F.lit(1)).alias("rows"), F.concat(F.first("header"), F.lit("\n"), body).alias("content"))


def deduplicated(chunks: DataFrame) -> DataFrame:
    """The first chunk of each content, white space at its ends apart, within a document."""
    first = Window.partitionBy("document_id", F.sha2(T.strip(F.col("content")), 256)).orderBy("ord")
    return chunks.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def keywords(chunks: DataFrame, id_col: str, text_col: str, n: int = 10, stop: tuple[str, ...] = T.KEYWORD_STOP) -> DataFrame:
    """(id, rank, word, count): the most frequent words of three letters or more, ties in the order of appearance."""
    found = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit("[a-záàâãéêíóôõúç]{3,}"), F.lit(0))
    counted = chunks.select(F.col(id_col).alias("id"), F.posexplode(found).alias("pos", "word")).where(~F.col("word").isin(*stop)).groupBy("id", "word").agg(F.count(F.lit(1)).alias("count"), F.min("pos").alias("first"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("count"), "first"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= n).select("id", "rank", "word", "count")
