"""Byte-level BPE against the tiktoken library, with chunks small enough that most texts are stitched."""

import base64
import hashlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import byte_codec

SF = "/root/testdata/sf0.001"
PUBLIC = byte_codec.byte_bpe_50k()


@pytest.fixture(scope="module")
def library():
    import tiktoken

    with open(PUBLIC["ranks"], "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PUBLIC["pattern"], mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def sha(ids):
    return hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()


def test_query_by_the_library(spark, library):
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{SF}/documents.parquet*')").fetchall())
    got = {r.doc_id: r for r in byte_codec.op11(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for i, r in got.items():
        ids = library(texts[i] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(ids), hashlib.sha256((texts[i] or "").encode()).hexdigest())


@pytest.mark.parametrize(("chunk", "overlap"), [(8, 8), (32, 6), (100, 40)])
def test_stitched_chunks(spark, library, chunk, overlap):
    """Texts whose tokens cross chunks: runs longer than an overlap, contractions and white space at every place."""
    texts = ["we'll they've don't I'm 're  \n\n  x" * 9, "a" * 500, " " * 300 + "b", "x" + "\n \t" * 70, "1234567890" * 30, "é漢字🙂 " * 40, "word " * 100, "'" * 90 + "ll", "a'l" * 60 + "l", "ab  cd" * 50 + "   "]
    texts += [("z" * k + "'re ") * 12 for k in range(1, 9)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    coded = byte_codec.encode(docs, chunk=chunk, overlap=overlap, **PUBLIC)
    assert {r.id: list(r.ids) for r in coded.collect()} == {i: library(t) for i, t in enumerate(texts)}
    assert {r.id: r.data.decode() for r in byte_codec.decode(coded, **PUBLIC).collect()} == dict(enumerate(texts))


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60))
def test_any_text(library, text):
    one = byte_codec.codec(**PUBLIC)
    (ids,) = one.ids([one.pieces(text)])
    assert np.frombuffer(ids, dtype="<u4").tolist() == library(text)
    assert one.text_bytes(np.frombuffer(ids, dtype="<u4")) == text.encode()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abcehilnorst ", min_size=1, max_size=64), max_size=20))
def test_both_ways_of_merging(texts):
    one, pieces = byte_codec.codec(**PUBLIC), [t.encode() for t in texts]
    assert one.merged(pieces) == [np.array(one.merged_long(p), dtype="<u4").tobytes() for p in pieces]


def test_long_piece_and_memory(library, monkeypatch):
    monkeypatch.setattr(byte_codec, "MEMO", 3)
    one = byte_codec.Codec(**PUBLIC)
    for text in ("ab" * 20_000, "one two three four five one two", "漢" * 5000):
        assert np.frombuffer(one.ids([one.pieces(text)])[0], dtype="<u4").tolist() == library(text)
    assert len(one.memo) < 9 and not any(len(p) > byte_codec.MEMO_CHARS for p in one.memo)


def test_odd_rows(spark, library):
    long = "a long text " * 9000
    rows = [(1, None), (2, ""), (3, long), (3, long), (4, "x"), (4, "x"), (None, "no id"), (None, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("id", "ids", "key", "n", "last", "cuts", "head", "tail", "at", "a", "b", "parts", "data"):
        docs = docs.withColumn(name, F.lit("x"))
    got = sorted(((r.id, list(r.ids)) for r in byte_codec.encode(docs, **PUBLIC).collect()), key=repr)
    assert got == sorted(((i, library(t or "")) for i, t in rows), key=repr)
    none = byte_codec.encode(docs.where("false"), packed=True, **PUBLIC)
    assert none.collect() == [] and byte_codec.decode(none, **PUBLIC).collect() == []
    assert byte_codec.decode(spark.createDataFrame([(1, None)], "id long, ids binary"), **PUBLIC).first().data is None
    with pytest.raises(ValueError, match="overlap"):
        byte_codec.encode(docs, chunk=10, overlap=20, **PUBLIC)
