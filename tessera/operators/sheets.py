"""Structured sheets: query detection, aggregation, search, filters and summaries over named tables of rows.

A sheet is a DataFrame; a workbook is a dict of them. Cells are compared as text, numbers read with a decimal comma or point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of queries by type and by operation, in the order of precedence.
TYPES = (("aggregation", r"soma|total|média|media|average|sum|count|quantos|quantas|máximo|maximo|mínimo|minimo|max|min"), ("filter", r"filtr|onde|where|maior que|menor que|igual a"))
OPERATIONS = (("sum", "soma|total|sum"), ("avg", "média|media|average|avg"), ("count", "count|quantos|quantas|contar"), ("max", "máximo|maximo|max|maior"), ("min", "mínimo|minimo|min|menor"))


def first_rule(query: Column, rules: tuple, default: str) -> Column:
    out = F.lit(default)
    for name, pattern in reversed(rules):
        out = F.when(F.lower(query).rlike(pattern), name).otherwise(out)
    return out


def query_type(query: Column) -> Column:
    return first_rule(query, TYPES, "search")


def operation(query: Column) -> Column:
    return first_rule(query, OPERATIONS, "count")


def numeric(cell: Column) -> Column:
    """The cell as a number, or null."""
    return F.replace(cell.cast("string"), F.lit(","), F.lit(".")).try_cast("double")


def column_for(sheet: DataFrame, query: str) -> str | None:
    """The first header that the query holds, else the first column of numbers by the first row (one row is read)."""
    named = next((c for c in sheet.columns if c.lower() in query.lower()), None)
    if named:
        return named
    row = sheet.select(*(numeric(F.col(c)).alias(c) for c in sheet.columns)).first()
    return next((c for c in sheet.columns if row is not None and row[c] is not None), None)


def aggregated(book: dict[str, DataFrame], column: str) -> DataFrame:
    """(operation, value): of all numeric cells of a column over all sheets that have it; zero for none, extremes null."""
    cells = None
    for sheet in book.values():
        if column in sheet.columns:
            part = sheet.select(numeric(F.col(column)).alias("v"))
            cells = part if cells is None else cells.unionByName(part)
    if cells is None:
        raise ValueError(f"no sheet has a column {column}")
    figures = cells.where("v IS NOT NULL").agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("sum"), F.coalesce(F.avg("v"), F.lit(0.0)).alias("avg"), F.count("v").cast("double").alias("count"), F.max("v").alias("max"), F.min("v").alias("min"))
    return figures.select(F.explode(F.array(*(F.struct(F.lit(c).alias("operation"), F.round(c, 4).alias("value")) for c in figures.columns))).alias("r")).select("r.*")


def long_cells(sheet: DataFrame, name: str, order: str) -> DataFrame:
    """(sheet, row, column, cell): one row for each non-null cell, rows numbered by the order column from 2."""
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("cell")) for c in sheet.columns))
    return sheet.select(F.lit(name).alias("sheet"), (F.col(order) + 2).alias("row"), F.explode(cells).alias("c")).select("sheet", "row", "c.*").where("cell IS NOT NULL")


def search(cells: DataFrame, term: str, n: int = 10) -> DataFrame:
    """(sheet, row, column, cell, matches): the first n cells that hold the term, in any case, and how many there are."""
    hits = cells.where(F.contains(F.lower("cell"), F.lit(term.lower())))
    return hits.orderBy("sheet", "row", "column").limit(n).crossJoin(hits.agg(F.count(F.lit(1)).alias("matches")))


def filtered(sheet: DataFrame, column: str, comparison: str, value: float) -> DataFrame:
    """Rows whose numeric cell compares so (<, <=, =, >=, >); an extension of a query that only counted rows."""
    x = numeric(F.col(column))
    return sheet.where({"<": x < value, "<=": x <= value, "=": x == value, ">=": x >= value, ">": x > value}[comparison])


def summary(book: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(sheet, rows, columns, sample): of each sheet, given with its order column; the sample is its first row as JSON."""
    out = None
    for name, (sheet, order) in book.items():
        part = sheet.agg(F.lit(name).alias("sheet"), F.count(F.lit(1)).alias("rows"), F.lit(len(sheet.columns)).alias("columns"), F.to_json(F.min_by(F.struct(*sheet.columns), order)).alias("sample"))
        out = part if out is None else out.unionByName(part)
    return out
