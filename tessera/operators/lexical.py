"""Lexical retrieval: containment search, token-set ranking and scored text strategies.

Query tables are small by nature and broadcast; chunk tables are scanned once for all queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T


def top_per(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each key, with their `rank`."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def lowered(chunks: DataFrame) -> DataFrame:
    """Adds `_lower`, the content in lower case: worked out once for a chunk and not for each query and token."""
    return chunks.withColumn("_lower", F.lower("content"))


def contains_all(lower: Column, tokens: Column) -> Column:
    return (F.size(tokens) > 0) & F.forall(tokens, lambda t: F.contains(lower, t))


def contains_some(lower: Column, tokens: Column) -> Column:
    return F.exists(tokens, lambda t: F.contains(lower, t))


def like_all(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, score): chunks that hold all of a query's tokens, the longest first."""
    asked = queries.select("query_id", T.query_tokens(F.col("query")).alias("tokens"))
    hits = lowered(chunks).join(F.broadcast(asked), contains_all(F.col("_lower"), F.col("tokens")))
    return top_per(hits, ["query_id"], k, F.desc(F.length("content")), F.col("id")).select("query_id", "rank", "id", F.lit(1.0).alias("score"))


def like_some(chunks: DataFrame, queries: DataFrame, terms: Column, k: int) -> DataFrame:
    """(query_id, rank, id): chunks that hold one of a query's terms, in their order; a query without hits gets the first chunks."""
    asked = queries.select("query_id", terms.alias("terms"))
    hits = top_per(lowered(chunks).join(F.broadcast(asked), contains_some(F.col("_lower"), F.col("terms"))), ["query_id"], k, F.col("ord"), F.col("id"))
    missed = asked.join(hits.select("query_id").distinct(), "query_id", "left_anti")
    first = chunks.orderBy("ord", "id").limit(k).withColumn("rank", F.row_number().over(Window.orderBy("ord", "id")))
    return hits.select("query_id", "rank", "id").unionByName(missed.crossJoin(F.broadcast(first)).select("query_id", "rank", "id"))


def phrase_search(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    hits = lowered(chunks).join(F.broadcast(queries.withColumn("query", F.lower("query"))), F.contains(F.col("_lower"), F.col("query")))
    return top_per(hits, ["query_id"], k, F.col("id")).select("query_id", "rank", "id", F.lit(1.0).alias("score"))


def inverted_index(chunks: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(token, id, tf, len): postings of the chunks' tokens, to be kept bucketed by token where searches repeat.

    With a small frame `only` of tokens, other tokens go before anything is counted or moved.
    """
    words = chunks.select("id", T.query_tokens(F.col("content"), ("",)).alias("w"))
    tokens = words.select("id", F.size("w").alias("len"), F.explode("w").alias("token"))
    tokens = tokens if only is None else tokens.join(F.broadcast(only), "token", "left_semi")
    return tokens.groupBy("token", "id", "len").agg(F.count(F.lit(1)).alias("tf"))


def full_text(chunks: DataFrame, queries: DataFrame, k: int, all_and: bool = False) -> DataFrame:
    """(query_id, level, rank, id, score): token-set search with a cascade of strictness.

    Level 1 asks for all tokens (up to three) or all important ones (over three characters, no digits), level 2 for the
    first two important ones, level 3 for any token; a query takes its first level with hits, only level 1 with all_and.
    The score sums log(1 + tf) over matched tokens and divides by 1 + log of the chunk's tokens; there is no stemming.
    The postings are joined on the token, so that a chunk is touched only where it shares one with a query.
    """
    tokens = F.array_distinct(T.query_tokens(F.col("query")))
    asked = queries.select("query_id", tokens.alias("tokens")).withColumn("important", F.filter("tokens", lambda t: (F.length(t) > 3) & ~t.rlike(r"^\d+$")))
    short = F.size("tokens") <= 3
    asked = asked.withColumn("strict", F.when(short, F.col("tokens")).otherwise(F.col("important"))).withColumn("two", F.when(short, F.array().cast("array<string>")).otherwise(F.slice("important", 1, 2)))
    wanted = asked.select("query_id", "strict", "two", F.explode("tokens").alias("token"))
    hits = inverted_index(chunks, wanted.select("token")).join(F.broadcast(wanted), "token").groupBy("query_id", "id").agg(
        F.sum(F.log1p("tf")).alias("s"), F.first("len").alias("len"), F.first("strict").alias("strict"), F.first("two").alias("two"),
        F.count_if(F.array_contains("strict", F.col("token"))).alias("n_strict"), F.count_if(F.array_contains("two", F.col("token"))).alias("n_two"),
    )
    level = F.when((F.size("strict") > 0) & (F.col("n_strict") == F.size("strict")), 1).when((F.size("two") == 2) & (F.col("n_two") == 2), 2).otherwise(3)
    leveled = hits.withColumn("level", level).withColumn("score", F.round(F.col("s") / (1 + F.log("len")), 6))
    # A query's strictest level comes first in its top k, of which only that level stays.
    top = top_per(leveled.where("level = 1") if all_and else leveled, ["query_id"], k, F.col("level"), F.desc("score"), F.col("id"))
    best = F.min("level").over(Window.partitionBy("query_id"))
    return top.withColumn("best", best).where("level = best").select("query_id", "level", "rank", "id", "score")


def partial_phrase(query: Column, content: Column) -> Column:
    parts = F.split(query, " ")
    return F.size(F.filter(parts, lambda w: F.contains(content, w))) / F.size(parts)


def quoted(word: Column) -> Column:
    return F.concat(F.lit(r"\Q"), word, F.lit(r"\E"))


def word_score(terms: Column, content: Column, original: Column) -> Column:
    """Mean over terms of 1 for a hit, .3 more at a sentence's start, .2 more in a numbered line."""
    one = lambda w: F.when(
        F.contains(content, w),
        1.0 + F.when(F.rlike(original, F.concat(F.lit(r"(?i)(^|[.!?]\s+)"), quoted(w))), 0.3).otherwise(0.0) + F.when(F.rlike(original, F.concat(F.lit(r"(?im)^\s*\d+\.\s*.*"), quoted(w))), 0.2).otherwise(0.0),
    ).otherwise(0.0)
    return F.coalesce(F.try_divide(F.aggregate(F.transform(terms, one), F.lit(0.0), lambda a, x: a + x), F.size(terms).cast("double")), F.lit(0.0))


def proximity(terms: Column, content: Column) -> Column:
    """1 less the mean gap of the terms' first places, in thousands of bytes; 0 for fewer than two terms found."""
    before = lambda w: F.octet_length(F.substring(content, F.lit(1), F.position(w, content) - 1))
    places = F.transform(F.filter(F.array_distinct(terms), lambda w: F.contains(content, w)), before)
    gaps = F.zip_with(F.slice(places, 2, F.greatest(F.lit(1), F.size(places) - 1)), F.slice(places, 1, F.greatest(F.lit(1), F.size(places) - 1)), lambda a, b: F.abs(a - b))
    mean = F.aggregate(F.filter(gaps, lambda g: g.isNotNull()), F.lit(0.0), lambda a, x: a + x) / (F.size(places) - 1)
    return F.when(F.size(places) >= 2, F.greatest(F.lit(0.0), 1 - mean / 1000)).otherwise(0.0)


def numbered_score(query: Column, content: Column) -> Column:
    number = F.regexp_extract(query, r"(\d+)\s*motivos?", 1)
    return F.when(number == "", 0.0).when(F.rlike(content, F.concat(number, F.lit(r"\s*motivos?"))), 0.95).when(F.rlike(content, F.concat(F.lit(r"(?m)^\s*"), number, F.lit(r"\.\s*"))), 0.8).otherwise(0.0)


def strategies(query: Column, content: Column) -> Column:
    """The best of the scored strategies as a struct (score, strategy); on equal scores the first."""
    q, c = F.btrim(F.lower(query)), F.lower(content)
    terms = T.search_terms(q)
    scored = [
        ("exact_phrase", F.when(F.contains(c, q), 1.0).otherwise(0.0)), ("partial_phrase", partial_phrase(q, c) * 0.9), ("word_match", word_score(terms, c, content) * 0.8),
        ("fuzzy_numbered", numbered_score(q, c) * 0.7), ("proximity", F.when(F.size(terms) >= 2, proximity(terms, c)).otherwise(0.0) * 0.6),
    ]
    ranked = F.array(*(F.struct(F.round(s, 6).alias("score"), F.lit(-i).alias("order"), F.lit(n).alias("strategy")) for i, (n, s) in enumerate(scored)))
    return F.array_max(ranked)


def advanced_search(chunks: DataFrame, queries: DataFrame, threshold: float, k: int) -> DataFrame:
    """(query_id, rank, id, score, strategy): chunks by their best strategy, at or over the threshold."""
    scored = chunks.join(F.broadcast(queries), F.lit(True)).withColumn("best", strategies(F.col("query"), F.col("content"))).where((F.col("best.score") > 0) & (F.col("best.score") >= threshold))
    return top_per(scored, ["query_id"], k, F.desc("best.score"), F.col("id")).select("query_id", "rank", "id", "best.score", "best.strategy")


def pattern_cascade(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id, score, method): numbered passages for queries that ask for them, else all keywords, else the phrase."""
    low = F.lower(F.col("content"))
    pairs = chunks.join(F.broadcast(queries.withColumn("keys", T.search_terms(F.col("query")))), F.lit(True))
    asks = F.lower("query").rlike(r"\d+\s*motivos?|lista|razões?|pontos?")
    numbered = asks & (F.contains(low, F.lit("motivos")) | F.contains(low, F.lit("1.")) | F.contains(low, F.lit("2.")) | F.contains(low, F.lit("3.")))
    level = F.when(numbered, 1).when(contains_all(low, F.col("keys")), 2).when(F.contains(low, F.lower("query")), 3)
    found = pairs.withColumn("level", level).where("level IS NOT NULL")
    first = found.groupBy("query_id").agg(F.min("level").alias("best"))
    kept = found.join(F.broadcast(first), "query_id").where("level = best")
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("ord", "id"))).where("level = 1 OR (level = 2 AND rank <= 10) OR rank <= 5")
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), F.col("level"))
    return kept.select("query_id", "id", pick(0.9, 0.7, 0.5).alias("score"), pick("numbered", "keywords", "phrase").alias("method"))


def expanded_terms(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, terms): tokens, their bigrams, five-letter beginnings, plural toggles, and the eight commonest tokens of the document's first five chunks.

    queries: (query_id, query, document_id).
    """
    sample = chunks.where("ord < 5").select("document_id", "ord", F.posexplode(T.plain_tokens(F.col("content"))).alias("pos", "token"))
    counted = sample.groupBy("document_id", "token").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ord", "pos")).alias("first"))
    common = top_per(counted, ["document_id"], 8, F.desc("n"), F.col("first")).groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("rank", "token"))).alias("top"))
    base = queries.join(common, "document_id", "left").withColumn("t", T.raw_tokens(F.col("query")))
    t = F.col("t")
    bigrams = F.when(F.size(t) > 1, F.zip_with(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(1))), F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    starts = F.transform(F.filter(t, lambda w: F.length(w) >= 6), lambda w: F.substring(w, 1, 5))
    toggled = F.transform(t, lambda w: F.when(F.endswith(w, F.lit("s")), F.regexp_replace(w, "s$", "")).otherwise(F.concat(w, F.lit("s"))))
    return base.select("query_id", F.array_distinct(F.concat(t, bigrams, starts, toggled, F.coalesce(F.col("top.token"), F.array().cast("array<string>")))).alias("terms"))


def fallback_levels(levels: list[DataFrame]) -> DataFrame:
    """(query_id, level, id): for each query the rows of the first level that has any."""
    tagged = [df.select("query_id", F.lit(i).alias("level"), "id") for i, df in enumerate(levels, 1)]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df)
    best = out.groupBy("query_id").agg(F.min("level").alias("level"))
    return out.join(best, ["query_id", "level"])


#: Common words, telling words and telling characters by language.
LANGUAGES = {
    "pt-BR": ("da do para com em que uma uma ção ão", "você não muito fazer brasil português então também porque quando onde como", "ãçõá"),
    "en-US": ("the and for with in that is to of a", "english america united states dollar you your have will can would", ""),
    "es-MX": ("el la de y en que con por un una", "español mexicano méxico peso usted muy hacer tener estar cuando donde", "ñáéíóú"),
    "fr": ("le la de et du un une pour dans que", "français france euro vous très faire avoir être quand comment", "àâéèêëîïôùûüÿç"),
    "de": ("der die das und in zu den von mit auf", "deutsch deutschland euro sie sehr machen haben sein wann wie", "äöüß"),
}
#: Signs of regional variants, (first, second); the second wins only if it has more.
REGIONS = {
    "pt": ("você vocês ção brasileir brasil reais cpf cnpj cep açúcar coração não", "vós estás português portugal euros açúcar coração", "pt-BR", "pt-PT"),
    "es": ("ustedes plata computadora carro chévere", "vosotros ordenador coche vale guay", "es-MX", "es-ES"),
    "en": ("color flavor center theater realize organize while among dollars bucks", "colour flavour centre theatre realise organise whilst amongst pounds quid", "en-US", "en-GB"),
}


def language_scores(text: Column) -> Column:
    """Structs (score, language): 2 for each common word found, 1 for each telling word, .5 for each telling character."""
    listed = sorted({w for common, *_ in LANGUAGES.values() for w in common.split()})
    words = F.array_intersect(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), F.array(*map(F.lit, listed)))

    def scores(x: Column) -> Column:
        rows = []
        for name, (common, telling, chars) in LANGUAGES.items():
            hits = sum((F.array_contains(x["words"], w).cast("int") for w in common.split()), F.lit(0)) * 2
            hits = hits + sum((F.contains(x["low"], F.lit(w)).cast("int") for w in telling.split()), F.lit(0))
            hits = hits + sum((F.contains(x["low"], F.lit(c)).cast("int") for c in chars), F.lit(0)) * 0.5
            rows.append(F.struct(hits.cast("double").alias("score"), F.lit(name).alias("language")))
        return F.array(*rows)

    # The text is read by a lambda's variable, so that it is split once and not for each word.
    return F.get(F.transform(F.array(F.struct(F.lower(text).alias("low"), words.alias("words"))), scores), 0)


#: What is taken out of a text before its language is told, and what is put in its place; the least length of what is left.
CLEANING = ((r"https?://[^\s]+", ""), (r"\S+@\S+\.\S+", ""), (r"\s+", " "), ("[0-9]+", ""), (r"[^\p{L}\p{N}_\s.,!?;:\-()]", " "))
LEAST_SAMPLE, LEAST_SURE, MOST_SURE = 10, 0.3, 0.9


def cleaned_sample(text: Column) -> Column:
    """A text without addresses, numbers and marks that tell nothing of its language."""
    for pattern, instead in CLEANING:
        text = F.regexp_replace(text, pattern, instead)
    return T.strip(text)


def told_language(text: Column, clean: Column) -> Column:
    """Struct (method, confidence, language) of a whole text by words and characters; unknown if there is too little or it isn't sure.

    clean: a column with cleaned_sample() of the text, which is read once for each word and so should be worked out before.
    """
    best = F.array_max(F.transform(language_scores(clean), lambda x: F.struct(x["score"], x["language"])))
    sure = F.least(F.lit(MOST_SURE), F.round(best["score"] / F.greatest(F.size(T.words(clean)) / 10, F.lit(10.0)), 6))
    method = F.when(T.strip(F.coalesce(text, F.lit(""))) == "", "no_text").when(F.length(clean) < LEAST_SAMPLE, "insufficient_text").otherwise("patterns")
    return F.struct(method.alias("method"), sure.alias("sure"), best["language"].alias("best"))


def told_languages(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, method, confidence, language) of each text."""
    clean = docs.select(id_col, text_col, cleaned_sample(F.coalesce(text_col, F.lit(""))).alias("_clean"))
    told = clean.select(id_col, told_language(F.col(text_col), F.col("_clean")).alias("b")).select(id_col, "b.*")
    usable = F.col("method") == "patterns"
    return told.select(id_col, "method", F.when(usable, F.col("sure")).otherwise(0.0).alias("confidence"), F.when(usable & (F.col("sure") >= LEAST_SURE), F.col("best")).otherwise("unknown").alias("language"))


def regional(lang: Column, text: Column) -> Column:
    low, out = F.lower(text), lang
    for base, (first, second, a, b) in REGIONS.items():
        count = lambda words: sum((F.contains(low, F.lit(w)).cast("int") for w in words.split()), F.lit(0))
        out = F.when(lang == base, F.when(count(second) > count(first), b).otherwise(a)).otherwise(out)
    return out


#: Words of the two-language count.
PT_WORDS, EN_WORDS = "de da do para com em um uma que não por como".split(), "the and to of a in is it you that he was".split()


def two_languages(text: Column) -> Column:
    """pt or en by how often their words stand between spaces in the first thousand characters; unknown on a tie."""
    low = F.lower(F.substring(text, 1, 1000))
    count = lambda ws: sum(((F.length(low) - F.length(F.replace(low, F.lit(f" {w} "), F.lit("")))) / (len(w) + 2) for w in ws), F.lit(0.0))
    pt, en = count(PT_WORDS), count(EN_WORDS)
    return F.when(pt > en, "pt").when(en > pt, "en").otherwise("unknown")
