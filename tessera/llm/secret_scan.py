"""Secret scan: fixed formats, and formats learned from what those find.

Values of the three base patterns are labelled credentials. An automaton over character classes is inferred for each
kind, and one from ordinary tokens. Every other token of at least the shortest labelled length is then scored: it is a
secret, of kind `like_` and the base kind, if that kind's automaton finds it at least as likely, per character, as nearly
all of its own held-out values and no likelier than these are, and likelier by a margin than ordinary tokens' automaton
does. Shorter tokens say less: their likelihoods scatter more, so bounds are wider for them, and the margin is larger.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from statistics import mean, pstdev

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automata import Automaton
from .common import cut

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # maximal runs: shorter ones never hold a longer one
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{8,}")
WORD = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
KINDS = ("assign", "access", "hex")
ADDED = tuple(f"like_{k}" for k in KINDS)
ORDER = {k: i for i, k in enumerate(KINDS + ADDED)}
CLASSES = str.maketrans({**dict.fromkeys("0123456789", "0"), **dict.fromkeys("abcdef", "a"), **dict.fromkeys("ghijklmnopqrstuvwxyz", "l"), **dict.fromkeys("ABCDEF", "A"), **dict.fromkeys("GHIJKLMNOPQRSTUVWXYZ", "L")})
Span = tuple[str, int, int]


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) in code points, end exclusive, by start and then kind."""
    found = [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], ORDER[x[0]]))


@dataclass
class Format:
    """A kind's automaton, and the likelihoods and the mean length of its held-out values."""

    automaton: Automaton
    least: float
    mean: float
    spread: float
    length: float

    def bounds(self, n: int) -> tuple[float, float]:
        """Of the likelihood, without its end, of a token of n characters.

        A token shorter than labelled values has wider bounds, and the upper one at fewer deviations: a short number is
        likely in any format that has digits.
        """
        wider = max(1.0, math.sqrt(self.length / n))
        return self.mean + (self.least - self.mean) * wider, self.mean + self.spread * wider * (2.5 if n >= self.length else 2.0)


@dataclass
class Formats:
    """The formats of the base kinds, and the automaton of ordinary tokens."""

    known: dict[str, Format]
    ordinary: Automaton
    margin: float = 0.25  # of log-likelihood a character, where this is more than
    whole: float = 5.0  # in all, which shorter tokens need
    seen: dict[str, str | None] = field(default_factory=dict, repr=False, compare=False)

    def kind(self, token: str) -> str | None:
        word = token.translate(CLASSES)
        if len(word) > 64:
            return self._kind(word)
        if word not in self.seen:
            if len(self.seen) >= 1 << 16:
                self.seen.clear()
            self.seen[word] = self._kind(word)
        return self.seen[word]

    def _kind(self, word: str) -> str | None:
        usual = self.ordinary.log_likelihood(word) + max(self.margin, self.whole / len(word))
        best: tuple[float, str] | None = None
        for kind, form in self.known.items():
            score, (low, high) = form.automaton.log_likelihood(word, ended=False), form.bounds(len(word))
            if low <= score <= high and form.automaton.log_likelihood(word) >= usual:
                best = max(best or (score - low, kind), (score - low, kind))
        return f"like_{best[1]}" if best else None


def all_spans(text: str, formats: Formats | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and these with what the formats add; added ones never overlap a base span."""
    base = [x[:3] for x in base_spans(text)]
    if formats is None or not formats.known:
        return base, base
    covered: list[list[int]] = []
    for _, a, b in base:
        if covered and a < covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], b)
        else:
            covered.append([a, b])
    more, at = [], 0
    for m in TOKEN.finditer(text):
        start, end = m.span()
        while at < len(covered) and covered[at][1] <= start:
            at += 1
        if (at == len(covered) or end <= covered[at][0]) and (kind := formats.kind(m[0])):
            more.append((kind, start, end))
    return base, sorted(base + more, key=lambda x: (x[1], ORDER[x[0]])) if more else base


def learn_formats(docs: DataFrame, text_col: str = "text", per_kind: int = 800, held_out: int = 200, least: int = 30, longest: int = 512) -> Formats:
    """Fits the automata on at most per_kind + held_out distinct values of each kind, those of the smallest hashes.

    Values of more than `longest` characters are none of them, so that a prefix tree has a bounded number of states. A
    kind of under `least` values gets no automaton. Ordinary tokens are one of each document, none of a credential, as
    many at most. An empty table, or one without credentials, gives no formats.
    """

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, values = [], []
            for value in batch.column(0):
                text = value.as_py() or ""
                base = base_spans(text)
                for kind, _, _, x in base:
                    if len(x) <= longest:
                        kinds.append(kind)
                        values.append(x)
                word = WORD.search(text, zlib.crc32((text[:64] + text[-64:]).encode("utf-8", "replace")) % (len(text) + 1)) or WORD.search(text)
                if word and word.end() - word.start() <= longest and not any(a < word.end() and word.start() < b for _, a, b, _ in base):
                    kinds.append("ordinary")
                    values.append(word[0])
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string())], ["kind", "value"])

    values = cut(docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(gathered, "kind string, value string").distinct())
    fitted: dict[str, Format] = {}
    ordinary = Automaton([])
    for kind in (*KINDS, "ordinary"):
        rows = values.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(per_kind + held_out).collect()
        words = [r["value"].translate(CLASSES) for r in rows]
        if kind == "ordinary":
            ordinary = Automaton(words)
        elif len(words) >= least:
            at = len(words) * held_out // (per_kind + held_out)
            automaton = Automaton(words[at:])
            scores = sorted(automaton.log_likelihood(w, ended=False) for w in words[:at])
            fitted[kind] = Format(automaton, scores[len(scores) // 20], mean(scores), max(0.02, pstdev(scores)), mean(map(len, words[:at])))
    return Formats(fitted, ordinary)


def scan(docs: DataFrame, formats: Formats | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans): `kind:start:end` lists of each row's secrets, in code points, before and after the formats' additions.

    A null text counts as empty. Repeated rows come back repeated, a null id stays null, an empty table gives an empty
    result, and other columns play no part. Texts are scanned whole. Added spans have kinds after the base kinds.
    """

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [all_spans(value.as_py() or "", formats) for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([[f"{k}:{a}:{b}" for k, a, b in x[i]] for x in both], pa.list_(pa.string())) for i in (0, 1))], ["id", "base", "spans"]
            )

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(scanned, "id long, base array<string>, spans array<string>")


def redact(docs: DataFrame, formats: Formats | None, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span replaced in the text column, overlapping spans as one; null texts stay null."""

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        out, at = [], 0
        for _, start, end in all_spans(text, formats)[1]:
            if start >= at:
                out += [text[at:start], mark]
            at = max(at, end)
        return "".join((*out, text[at:])) if out else text

    @F.arrow_udf("string")
    def cleaned(texts: pa.Array) -> pa.Array:
        return pa.array([clean(x.as_py()) for x in texts], pa.string())

    return docs.withColumn(text_col, cleaned(F.col(text_col).cast("string")))


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(docs, learn_formats(docs))
    number = lambda kind: F.size(F.filter("base", lambda x: F.startswith(x, F.lit(f"{kind}:")))).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("id").alias("doc_id"),
        *map(number, KINDS),
        F.sha2(F.array_join("base", ","), 256).alias("base_sha256"),
        F.array_join("spans", ",").alias("spans"),
    )
