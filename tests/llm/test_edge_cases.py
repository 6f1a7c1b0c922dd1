"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import chat, langid, line_dedup, packing, piece_codec, quality, secret_scan, simhash, toxicity, vafile

LONG = "long words here again and again until the text is large enough to matter " * 3000
LINE = "a line that is long enough to count as one that many documents share"
ROWS = [
    (1, None), (2, ""), (3, "  \n\t "), (4, LONG), (5, "same text\n" + LINE), (5, "same text\n" + LINE), (6, "Same Text\n" + LINE.upper()), (7, LINE), (8, LINE), (9, LINE + "\n" + LINE),
    (None, "no id\n" + LINE), (10, "token = 'abcdef123456' and é ü 漢字 🙂"), (11, "!!! ???"), (12, "\u0000 odd �"), (None, None),
]
#: Names that operators use inside.
EXTRA = ["id", "key", "fp", "h", "line", "lines", "pos", "features", "kept", "base", "spans", "root", "node", "rank", "score", "query", "n_lines", "body", "h2", "value", "y", "rn"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    for name in EXTRA:
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def by_id(df, key="id"):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], []).append(r)
    return out


def test_simhash(docs, none):
    got = by_id(simhash.near_duplicates(docs))
    assert sum(map(len, got.values())) == len(ROWS)
    assert {r.fp for i in (1, 2, 3) for r in got[i]} == {0}
    assert {r.component for i in (1, 2, 3) for r in got[i]} == {1}
    assert {r.component for i in (5, 6) for r in got[i]} == {5}
    assert {r.component for i in (7, 8) for r in got[i]} == {7}
    assert {r.component for r in got[None]} >= {1}
    assert simhash.near_duplicates(none).collect() == []
    kept = [r.doc_id for r in simhash.keep_one(docs).collect()]
    assert sorted(i for i in kept if i is not None) == sorted({1, 4, 5, 7, 10, 11, 12} | ({9} & set(kept)))
    assert kept.count(None) == 2
    assert simhash.keep_one(docs).columns == docs.columns


def test_line_dedup(docs, none):
    got = by_id(line_dedup.dedup_lines(docs), "doc_id")
    assert [(r.n_lines, r.n_dropped, r.kept_text) for r in got[1] + got[2]] == [(1, 0, "")] * 2
    assert [(r.n_lines, r.n_dropped) for r in got[9]] == [(2, 0)]  # the largest id keeps both
    assert {(r.n_lines, r.n_dropped, r.kept_text) for r in got[5]} == {(2, 1, "same text")}
    assert [r.kept_text for r in got[7]] == [""]
    assert sorted((r.n_lines, r.n_dropped) for r in got[None]) == [(1, 0), (2, 1)]
    assert line_dedup.dedup_lines(none).collect() == []


def test_line_dedup_counts_repeated_rows_once(spark):
    rows = spark.createDataFrame([(1, LINE)] * 6 + [(2, LINE)] * 6, "doc_id long, text string")
    assert {r.n_dropped for r in line_dedup.dedup_lines(rows).collect()} == {0}


def test_quality(docs, none):
    got = by_id(quality.quality_facts(docs))
    assert all(r.n_words == 0 and r.base_failed and not r.kept for i in (1, 2, 3) for r in got[i])
    assert got[4][0].n_words == 42_000
    assert len(got[5]) == 2
    assert quality.quality_facts(none).collect() == []
    assert quality.keep_good(none).collect() == []
    assert quality.keep_good(docs).columns == docs.columns
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == set()


def test_secrets(docs, none):
    formats = secret_scan.learn_formats(docs)
    assert formats.known == {}
    got = by_id(secret_scan.scan(docs, formats))
    assert got[1][0].base == [] and got[None][0].spans == []
    assert got[10][0].base == ["assign:0:21"]
    assert secret_scan.scan(none, secret_scan.learn_formats(none)).collect() == []
    red = by_id(secret_scan.redact(docs, formats), "doc_id")
    assert red[1][0].text is None
    assert red[10][0].text == "[SECRET]' and é ü 漢字 🙂"


def test_packing(docs, none):
    args = packing.byte_bpe_50k()
    got = by_id(packing.pack(docs, **args))
    assert [(r.start, r.length, r.doc_tokens) for r in got[1]] == [(0, 1, 1)]
    assert sum(r.length for r in got[4]) == got[4][0].doc_tokens > 1024
    assert len(got[None]) >= 2
    assert packing.pack(none, **args).collect() == []


def test_language(docs, none):
    model = langid.train(docs.withColumn("lang", F.when(F.col("doc_id") < 6, "en").when(F.col("doc_id") < 10, "xx")))
    got = by_id(langid.identify(docs, model))
    for i in (1, 2, 3, 11):
        assert [(r.lang_pred, r.score) for r in got[i]] == [("und", 0.0)]
    assert all(r.lang_pred in ("en", "xx") and 0 <= r.score <= 1 for i in (4, 5, 10) for r in got[i])
    assert langid.identify(none, langid.train(none)).collect() == []
    assert {r.lang_pred for r in langid.identify(docs, langid.train(none)).collect()} == {"und"}


def test_toxicity(spark, docs, none):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    odd = spark.createDataFrame([(1, None), (None, 1), (99, 1), (4, 0), (4, 0)], "doc_id long, toxic int")
    for labels in (empty, odd):
        model = toxicity.train(docs, labels)
        assert {r.score for r in toxicity.score(docs, model).collect()} == {0.0}
    assert toxicity.score(none, model).collect() == []
    both = spark.createDataFrame([(i, int(i % 2)) for i in range(60)], "doc_id long, toxic int")
    texts = spark.createDataFrame([(i, "you awful brute thing" if i % 2 else "a calm and pleasant note") for i in range(60)], "doc_id long, text string")
    model = toxicity.train(texts, both)
    scores = {r.id: r.score for r in toxicity.score(texts, model).collect()}
    assert all((scores[i] > 0.5) == bool(i % 2) for i in range(60))
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, model).collect())


def test_pieces(docs, none):
    import public_tokenizers

    model = str(public_tokenizers.path("piece_bpe_32k.model"))
    got = by_id(piece_codec.encode(docs, model))
    assert got[1][0].ids == got[2][0].ids == []
    assert all(r.round_trip for r in piece_codec.digests(docs, model).collect())
    assert piece_codec.encode(none, model).collect() == []
    back = by_id(piece_codec.decode(piece_codec.encode(docs, model), model))
    assert back[10][0].text == ROWS[11][1]


def test_search(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5]), (4, None), (5, [nan, 0.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (8, []), (9, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("x")).withColumn("v", F.lit("y"))
    got = by_id(vafile.search(df, df.where("vec_id IN (1, 4, 8)"), k=3), "query")
    assert {k: [(r["rank"], r.id, r.score) for r in sorted(v, key=lambda r: r["rank"])] for k, v in got.items()} == {1: [(1, 2, 65_536), (2, 3, 32_768), (3, 8, 0)], 8: [(1, 1, 0), (2, 2, 0), (3, 3, 0)]}
    assert vafile.search(df.where("false"), df, 3).collect() == []
    assert vafile.search(df, df.where("false"), 3).collect() == []


def test_chats(spark):
    rows = [(1, 2, "user", "b"), (1, 1, "user", "a"), (1, None, None, None), (1, 3, "assistant", "</turn>\n<turn:user>\n<turn/> \\b \\l <turn"), (None, 1, "a>b\n", ""), (2, 1, "assistant", "t"), (2, 1, "assistant", "t")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("conv", F.lit(1)).withColumn("turns", F.lit(2))
    got = {r.conv: r for r in chat.format_chats(df).select("*", chat.read_chats(F.col("formatted")).alias("back")).collect()}
    assert [(t.role, t.text) for t in got[1].back] == [("", ""), ("user", "a"), ("user", "b"), ("assistant", rows[3][3])]
    assert [(t.role, t.text) for t in got[None].back] == [("a>b\n", "")]
    assert [(t.role, t.text) for t in got[2].back] == [("assistant", "t")] * 2
    assert got[1].formatted.count("<turn:user>") == 1
    assert len(got[2].loss) == 2
    assert chat.format_chats(df.where("false")).collect() == []


def test_pipeline(spark, docs, none, tmp_path):
    shape = docs.select("doc_id", "text").withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long")).withColumn("key", F.lit("x"))
    varied = spark.range(60).selectExpr("id + 100 AS doc_id", "array_join(transform(sequence(1, 80), i -> concat('w', (id * 31 + i * i * (id + 7)) % 997)), ' ') AS text", "'en' AS lang", "'s' AS source", "0L AS n_chars", "'k' AS key")
    for table, least in ((none.withColumn("key", F.lit("x")), 0), (shape, 0), (shape.unionByName(varied).unionByName(varied), 30)):
        step = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            step = stage(spark, step, "")
            assert step.columns == corpus_pipeline.COLUMNS, name
        assert step.count() >= least
        assert corpus_pipeline.STAGES[-1][1](spark, step, "").columns[0] == "doc_id"
