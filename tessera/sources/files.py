"""A folder of mixed files as a table: kind, text and what went wrong, one row for each file.

Files are read by Spark's own binary reader, which packs them into tasks by size and works on any store that Spark reads.
A file that can't be read doesn't end a run: its row says why, and the caller's policy decides what becomes of it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import formats

POLICIES = ("keep", "drop", "fail")


def csv_text(text: str) -> str:
    """Rows of a delimited file as lines of cells; the separator is the commonest of four in the first line."""
    import csv
    import io

    first = text.split("\n", 1)[0]
    sep = max(",;\t|", key=first.count)
    return "\n".join(" | ".join(c for c in row if c) for row in csv.reader(io.StringIO(text), delimiter=sep) if any(row))


def json_text(text: str) -> str:
    json.loads(text)  # broken JSON is an error here, and not an empty text
    return formats.json_text(text)


def xml_text(text: str) -> str:
    ElementTree.fromstring(text)
    return formats.xml_text(text)


#: What reads the text of each kind; kinds without a reader need libraries that are not at hand.
READERS = {
    "txt": str, "csv": csv_text, "html": formats.html_text, "xml": xml_text, "rtf": formats.rtf_text, "json": json_text,
}
OUT = "path string, name string, kind string, size long, text string, error string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):  # a file at a time, so that one task holds the texts of one
            path, name, kind, size = (batch.column(i)[row].as_py() for i in range(4))
            text, error = None, None
            try:
                if kind not in READERS:
                    raise ValueError(f"no reader for {kind}")
                text = READERS[kind](formats.plain_text(batch.column(4)[row].as_py()))
            except Exception as why:  # any fault of a file is a row of its own
                error = f"{type(why).__name__}: {why}"[:500]
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if n == "size" else pa.string()) for v, n in ((path, "path"), (name, "name"), (kind, "kind"), (size, "size"), (text, "text"), (error, "error"))], [c.split()[0] for c in OUT.split(", ")])


def read_folder(spark: SparkSession, path: str, policy: str = "keep", name: Column | None = None, most: int = 1 << 30) -> DataFrame:
    """(path, name, kind, size, text, error) of every file below a folder.

    The kind is that of the name's extension or, where that says nothing, of the first bytes and marks of the content.
    `name` is a column over `path`, the file's own name by default. Policies: broken files are kept with their error and
    no text, dropped, or end the run. Files of over `most` bytes are not opened and count as broken. Files
    without a byte have no row, as Spark's reader leaves them out; an empty folder gives none.
    """
    if policy not in POLICIES:
        raise ValueError(f"policies are {', '.join(POLICIES)}")
    own = F.substring_index("path", "/", -1) if name is None else name
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).withColumn("name", own)
    small = F.col("length") <= most
    head = F.decode(F.substring("content", 1, 10_000), "iso-8859-1")
    by_name = formats.type_by_extension(F.col("name"))
    braced = F.ltrim(head).rlike(r"^[\[{]")
    kind = F.when(F.endswith(F.lower("name"), F.lit(".json")), "json").when(by_name != "unknown", by_name).when(braced, "json").otherwise(formats.type_by_content(F.col("name"), head)["kind"])
    rows = found.select("path", "name", F.when(small, kind).otherwise("oversized").alias("kind"), F.col("length").alias("size"), F.when(small, F.col("content")).alias("content")).mapInArrow(_read, OUT)
    if policy == "drop":
        return rows.where("error IS NULL")
    if policy == "fail":
        return rows.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.concat_ws(": ", "path", "error"))))
    return rows
