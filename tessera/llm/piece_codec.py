"""SentencePiece encoding and decoding over an Aho-Corasick automaton of the model's pieces.

One pass reads the pieces that end at each position off the automaton's output links and relaxes that position. For a
unigram model the best sum of scores wins, as in Viterbi's algorithm. For a BPE model sums of scores give other ids than
the model's own merges do, so that a step is admitted, instead, only where the last piece before it and the new piece
stay apart when merged by themselves; exactly one piece is then admitted at each position, which is the model's own
encoding. Pieces never cross a word's start in the models this serves, so words are encoded apart and remembered.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
MEMO, MEMO_CHARS = 300_000, 64
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol-buffer message: numbers for varints, bytes for the rest."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else 4 if kind == 5 else 8
            yield tag >> 3, data[at : at + size]
            at += size


class Codec:
    """Encoder and decoder of one model file; identity normalisation, spaces as U+2581 and one put in front."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            data = f.read()
        self.kind, rows, options = UNIGRAM, [], {}
        for field, value in _fields(data):
            if field == 1:
                parts = dict(_fields(value))
                rows.append((parts[1].decode(), float(np.frombuffer(parts.get(2, b"\0" * 4), "<f4")[0]), parts.get(3, 1)))
            elif field == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                options = dict(_fields(value))
        if self.kind not in (UNIGRAM, BPE) or options.get(2) or options.get(4, 1):
            raise ValueError("only unigram and BPE models with identity normalisation that keep spaces are served")
        self.prefix = SPACE if options.get(3, 1) else ""
        self.unknown = next((i for i, r in enumerate(rows) if r[2] == 2), 0)
        self.byte_ids = {int(r[0][3:5], 16): i for i, r in enumerate(rows) if r[2] == 6}
        self.score = {r[0]: r[1] for r in rows if r[2] in (1, 4)}
        self.ids = {r[0]: i for i, r in enumerate(rows) if r[2] in (1, 4)}
        self.by_words = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        words = [v for p, v in self.score.items() if p.strip(SPACE)]
        self.by_words &= self.kind == UNIGRAM or max((v for p, v in self.score.items() if len(p) > 1 and not p.strip(SPACE)), default=-np.inf) < min(words, default=0)
        self.known = {c for p in self.ids for c in p if self.kind == UNIGRAM or c in self.ids}
        self.least = min(self.score.values(), default=0.0) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (i, len(p), self.score[p], p))
        self.automaton.make_automaton()
        self.apart: dict[int, bool] = {}
        self.edges: dict[str, tuple[list, list] | None] = {}
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pieces = [bytes([int(r[0][3:5], 16)]) if r[2] == 6 else b" \xe2\x81\x87 " if r[2] == 2 else b"" if r[2] == 3 else r[0].replace(SPACE, " ").encode() for r in rows]

    def merged(self, symbols: list[str]) -> list[str]:
        """Merges adjacent symbols into pieces, best score first and then leftmost."""
        left, right = list(range(-1, len(symbols) - 1)), list(range(1, len(symbols) + 1))
        symbols, queue = list(symbols), []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(symbols):
                joint = symbols[i] + symbols[j]
                if joint in self.score:
                    heapq.heappush(queue, (-self.score[joint], i, j, joint))

        for i in range(len(symbols) - 1):
            offer(i, i + 1)
        while queue:
            _, i, j, joint = heapq.heappop(queue)
            if symbols[i] and symbols[j] and right[i] == j and symbols[i] + symbols[j] == joint:
                symbols[i], symbols[j], right[i] = joint, "", right[j]
                if right[j] < len(symbols):
                    left[right[j]] = i
                offer(left[i], i)
                offer(i, right[i])
        return [s for s in symbols if s]

    def _edges(self, piece: str) -> tuple[list, list] | None:
        """How a piece's first and last symbol grow while it is merged: (symbol, score of the merge that ends it) in order.

        None if the scores of its merges don't fall throughout, as the reasoning of _stay_apart() asks for.
        """
        symbols, first, last, latest = list(piece), [], [], np.inf
        while len(symbols) > 1:
            best, i = max(((self.score[x + y], -k) for k, (x, y) in enumerate(zip(symbols, symbols[1:], strict=False)) if x + y in self.score), default=(None, 0))
            if best is None or best > latest:
                return None
            latest, i = best, -i
            if i == 0:
                first.append((symbols[0], best))
            if i == len(symbols) - 2:
                last.append((symbols[-1], best))
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return [*first, (piece, -np.inf)], [*last, (piece, -np.inf)]

    def _stay_apart(self, a: tuple, b: tuple) -> bool:
        """Are two pieces the encoding of their joint text? Remembered by both ids.

        They are unless some symbol at the end of the one and some at the start of the other, there at the same time, make
        a piece of a better score than those of the merges that end either symbol.
        """
        if len(self.apart) >= 4 * MEMO:
            self.apart.clear()
        left, right = (self.edges.get(x[3], 0) for x in (a, b))
        if left == 0:
            left = self.edges[a[3]] = self._edges(a[3])
        if right == 0:
            right = self.edges[b[3]] = self._edges(b[3])
        if left is None or right is None:
            found = self.merged(list(a[3] + b[3])) == [a[3], b[3]]
        else:
            found, i, j, score = True, 0, 0, self.score.get
            while True:
                (x, ends_x), (y, ends_y) = left[1][i], right[0][j]
                joint = score(x + y)
                if joint is not None and joint > ends_x and joint >= ends_y:
                    found = False
                    break
                if ends_x == ends_y == -np.inf:
                    break
                if ends_x >= ends_y:
                    i += 1
                else:
                    j += 1
        self.apart[a[0] << 32 | b[0]] = found
        return found

    def _known_span(self, span: str) -> list[int]:
        """Ids of a text all of whose characters are pieces."""
        last = self._relaxed_by_score(span) if self.kind == UNIGRAM else self._relaxed_by_merges(span)
        out, at = [], len(span)
        while at:
            piece = last[at]
            if piece is None:
                return [self.ids[s] for s in self.merged(list(span))]
            out.append(piece[0])
            at -= piece[1]
        out.reverse()
        return out

    def _relaxed_by_score(self, span: str) -> list[tuple | None]:
        """The last piece of the best encoding up to each position."""
        last: list[tuple | None] = [None] * (len(span) + 1)
        best = [0.0] + [-np.inf] * len(span)
        for end, piece in self.automaton.iter(span):
            total = best[end + 1 - piece[1]] + piece[2]
            if total > best[end + 1]:
                best[end + 1], last[end + 1] = total, piece
        return last

    def _relaxed_by_merges(self, span: str) -> list[tuple | None]:
        """The last piece of the merged encoding up to each position; output links give the longest pieces first."""
        last: list[tuple | None] = [None] * (len(span) + 1)
        apart, done = self.apart.get, -1
        for end, piece in self.automaton.iter(span):
            if end == done:
                continue
            start = end + 1 - piece[1]
            if start:
                before = last[start]
                if before is None:
                    continue
                fits = apart(before[0] << 32 | piece[0])
                if fits is None:
                    fits = self._stay_apart(before, piece)
                if not fits:
                    continue
            last[end + 1], done = piece, end
        return last

    def _fallback(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode("utf-8", "replace")] if len(self.byte_ids) == 256 else [self.unknown]

    def _span(self, text: str) -> list[int]:
        if self.known.issuperset(text):
            return self._known_span(text)
        out, at = [], 0
        for i, c in enumerate(text):
            if c not in self.known:
                out += (self._known_span(text[at:i]) if i > at else []) + self._fallback(c)
                at = i + 1
        return out + (self._known_span(text[at:]) if at < len(text) else [])

    def _segment(self, text: str) -> bytes:
        if text[0] == SPACE and text[1:2] not in ("", SPACE):
            return array("i", self._span(text)).tobytes()
        spaces = len(text) - len(text.lstrip(SPACE))
        word = self._span(text[max(0, spaces - 1) :]) if spaces < len(text) else []
        lone = self.ids.get(SPACE)
        if spaces and word and word[0] != lone:
            spaces -= 1
        elif spaces and word:
            word = word[1:]
        run = [self.ids.get(s, self.unknown) for s in self.merged([SPACE] * spaces)] if self.kind == BPE else self._span(SPACE * spaces) if spaces else []
        return array("i", run + word).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.int32)
        text = self.prefix + text.replace(" ", SPACE)
        if not self.by_words or self.kind == UNIGRAM:
            return np.array(self._span(text), dtype=np.int32)
        memo, out = self.memo, []
        for s in SEGMENT.findall(text):
            ids = memo.get(s)
            if ids is None:
                ids = self.older.get(s) or self._segment(s)
                if len(s) <= MEMO_CHARS:
                    if len(memo) >= MEMO:  # words met since the last turn stay for another
                        self.older, self.memo = memo, {}
                        memo = self.memo
                    memo[s] = ids
            out.append(ids)
        return np.frombuffer(b"".join(out), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the piece ids of each row's whole text.

    Null and empty texts have no ids. Repeated rows come back repeated, an empty table gives an empty result, a null id
    stays null, and other columns play no part. The model is a path that executors can read.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([one.encode(t.as_py()) for t in batch.column(1)], pa.list_(pa.int32()))], ["id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(encoded, "id long, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(id, text) of (id, ids); null ids give a null text. Bytes that are no UTF-8 become U+FFFD."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(model)
        for batch in batches:
            texts = [None if x is None else one.decode(np.array(x, dtype=np.int32)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return encoded.select("id", "ids").mapInArrow(decoded, "id long, text string")


def digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_ids, ids_crc32, decoded_chars, round_trip) in one pass: what encode() gives, and whether decode() gives the text back."""
    import zlib

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(model)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py() or ""
                ids = one.encode(text)
                back = one.decode(ids)
                rows.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), len(back), back == text))
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, kinds)], ["id", "n_ids", "ids_crc32", "decoded_chars", "round_trip"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(digested, "id long, n_ids long, ids_crc32 long, decoded_chars long, round_trip boolean")


def op8(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = str(public_tokenizers.path("piece_bpe_32k.model"))
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), model).withColumnRenamed("id", "doc_id")
