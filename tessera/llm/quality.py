"""Quality rules as a short-circuit cascade, cheapest rejection first.

On a sample it is measured how long each fact that rules ask for takes to work out, and which rules reject which rows.
The order is greedy: next comes the rule that rejects most, of the rows that no earlier rule rejects, for each second that
its facts take beyond those that are there already. Each document leaves at the first rule that rejects it. A document is
kept if no rule rejects it, so that the order never changes a verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
CONTINUATION = bytes(range(0x80, 0xC0))
LARGE = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SMALL = LARGE.lower()
LETTER = regex.compile(r"\p{L}")


class Facts:
    """What rules ask of a text, each worked out at the first question."""

    def __init__(self, text: bytes | None) -> None:
        self.text = text or b""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text.translate(None, SPACE + CONTINUATION))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.text) - len(self.text.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.text.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        n = self.n_words
        if n < 4:
            return 0
        seen: dict[bytes, int] = {}
        ids = np.fromiter((seen.setdefault(w, len(seen)) for w in self.words), dtype=np.int64, count=n)
        pairs = ids[:-1] * len(seen) + ids[1:]
        if len(seen) > 1_000_000:
            pairs = np.unique(pairs, return_inverse=True)[1]
        _, first, number = np.unique(pairs[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
        if len(number) == n - 2:
            return 0
        again = number[first] > 1
        covered = np.zeros(n, dtype=bool)
        for k in range(3):
            covered[k : n - 2 + k] |= again
        return int(covered.sum())

    @cached_property
    def bangs(self) -> int:
        return self.text.count(b"!!")

    @cached_property
    def capitals(self) -> int:
        return len(self.text) - len(self.text.translate(None, LARGE))

    @cached_property
    def latin(self) -> int:
        """Letters A-Z and a-z."""
        return self.capitals + len(self.text) - len(self.text.translate(None, SMALL))

    @cached_property
    def n_lettered(self) -> int:
        """Words with a letter of any script."""
        return sum(1 for w in self.words if w.isalpha() or LETTER.search(w.decode("utf-8", "replace")))


#: name -> does the rule reject? The first two are the base.
RULES: dict[str, Callable[[Facts], bool]] = {
    "few_words": lambda f: f.n_words < 50,
    "repeated_words": lambda f: 100 * f.n_repeat_words > 50 * f.n_words,
    "symbols": lambda f: 10 * f.n_symbols > 3 * f.n_words,
    "duplicate_lines": lambda f: 2 * f.n_dup_lines > len(f.lines),
    "word_length": lambda f: not 2 * f.n_words <= f.word_chars <= 20 * f.n_words,
    "capitals": lambda f: 10 * f.capitals > 6 * f.latin,
    "exclamation": lambda f: 2 * f.bangs > f.n_words,
    "letters": lambda f: 2 * f.n_lettered < f.n_words,
}
BASE = ("few_words", "repeated_words")
#: The facts a rule asks for; each takes those before it as given.
FACTS: dict[str, tuple[str, ...]] = {
    "few_words": ("n_words",),
    "repeated_words": ("n_words", "n_repeat_words"),
    "symbols": ("n_words", "n_symbols"),
    "duplicate_lines": ("lines", "n_dup_lines"),
    "word_length": ("n_words", "word_chars"),
    "capitals": ("capitals", "latin"),
    "exclamation": ("n_words", "bangs"),
    "letters": ("n_words", "n_lettered"),
}
ALL_FACTS = tuple(dict.fromkeys(f for facts in FACTS.values() for f in facts))


def passes(facts: Facts, order: list[str]) -> bool:
    return not any(RULES[name](facts) for name in order)


def measure(docs: DataFrame, text_col: str = "text", sample_rows: int = 2000) -> tuple[dict[str, float], dict[frozenset[str], int]]:
    """On about sample_rows rows: mean seconds of each fact, and how many rows each set of rules rejects.

    Rows are chosen by a hash of their place in the table, so that copies of a text are chosen apart, and are timed on
    the executors; one row for each fact and one for each set of rules reach the driver. On an empty table all is zero.
    """
    text = F.col(text_col).cast("string").cast("binary").alias("text")
    every = max(1, docs.count() // sample_rows)

    def timed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, verdicts = dict.fromkeys(ALL_FACTS, 0.0), {}
        for batch in batches:
            for value in batch.column(0):
                facts = Facts(value.as_py())
                for name in ALL_FACTS:
                    began = time.perf_counter()
                    getattr(facts, name)
                    spent[name] += time.perf_counter() - began
                no = ",".join(name for name in RULES if RULES[name](facts))
                verdicts[no] = verdicts.get(no, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([*spent, *verdicts]), pa.array([*spent.values(), *([0.0] * len(verdicts))]), pa.array([0] * len(spent) + [*verdicts.values()], pa.int64())], ["what", "s", "n"])

    sample = docs.select(text).where(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(every)) == 0)
    sums = {r["what"]: r for r in sample.mapInArrow(timed, "what string, s double, n long").groupBy("what").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()}
    rejected = {frozenset(filter(None, what.split(","))): r["n"] for what, r in sums.items() if what not in ALL_FACTS}
    rows = max(1, sum(rejected.values()))
    return {name: sums[name]["s"] / rows if name in sums else 0.0 for name in ALL_FACTS}, rejected


def ordered(seconds: dict[str, float], rejected: dict[frozenset[str], int], rules: list[str], known: set[str] | None = None) -> list[str]:
    """Rules by rejections of what is left per second of the facts not yet known; ties by their order in RULES."""
    known, left, rules, out = set(known or ()), dict(rejected), list(rules), []
    while rules:
        gain = lambda r: sum(n for no, n in left.items() if r in no) / max(1e-9, sum(seconds[f] for f in FACTS[r] if f not in known))  # noqa: E731, B023
        best = max(rules, key=gain)
        rules.remove(best)
        out.append(best)
        known |= set(FACTS[best])
        left = {no: n for no, n in left.items() if best not in no}
    return out


def quality_facts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for each row of docs.

    A null text counts as empty, has no words and fails the base. Repeated rows come back repeated; an empty table gives
    an empty result; a null id stays null; other columns play no part. Texts are read whole, one at a time.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    order = ordered(*measure(docs, text_col), [r for r in RULES if r not in BASE], {*names, "lines"})

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(1):
                facts = Facts(value.as_py())
                failed = not passes(facts, list(BASE))
                rows.append((*(getattr(facts, x) for x in names), failed, not failed and passes(facts, order)))
            columns = list(zip(*rows, strict=True)) or [()] * (len(names) + 2)
            kinds = [pa.int64()] * len(names) + [pa.bool_()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, kinds)], ["id", *names, "base_failed", "kept"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return source.mapInArrow(judged, "id long, " + ", ".join(f"{x} long" for x in names) + ", base_failed boolean, kept boolean")


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that pass all rules, with all their columns; nulls, repeated and empty input as in quality_facts()."""
    order = ordered(*measure(docs, text_col), list(RULES))

    @F.arrow_udf("boolean")
    def good(texts: pa.Array) -> pa.Array:
        return pa.array([passes(Facts(x.as_py()), order) for x in texts], pa.bool_())

    return docs.where(good(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")))


def op6(spark, sf_dir: str) -> DataFrame:
    return quality_facts(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
f AS (
  SELECT rid, doc_id, text, words, lines, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS latin,
         (length(text) - length(replace(text, '!!', ''))) // 2 AS bangs, len(list_filter(words, lambda x: regexp_matches(x, '\p{L}'))) AS n_lettered
  FROM w),
t AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
      FROM (SELECT rid, words, unnest(range(1, n_words - 1)) AS i FROM f WHERE n_words >= 3)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM t) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
b AS (SELECT f.*, coalesce(n_repeat_words, 0) AS n_repeat_words FROM f LEFT JOIN covered USING (rid)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (10 * n_symbols > 3 * n_words) AND NOT (2 * n_dup_lines > len(lines))
         AND word_chars BETWEEN 2 * n_words AND 20 * n_words AND NOT (10 * capitals > 6 * latin)
         AND NOT (2 * bangs > n_words) AND NOT (2 * n_lettered < n_words) AS kept
FROM j
"""
