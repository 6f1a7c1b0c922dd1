"""Column functions that read a search query: intent, class, complexity, expansion, validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

#: Parts of a query that name an answer mode, in the order of precedence.
MODES = {
    "list": ("lista", "listar", "list ", "enumerar", "enumera", "enumere", "numerando", "uma a uma", "um a um", "todas", "todos", "sem resumir"),
    "summary": ("resumo", "resuma", "resumir", "sumário", "executivo", "em linhas", "síntese", "sintese"),
    "quote": ("citação", "cite a frase", "frase exata", "trecho exato", "entre aspas", "o que disse", "o que afirma"),
    "table": ("tabela", "tabelar", "colunas", "chave valor", "key value", "kv", "preços", "planos", "especificações", "especificacao"),
    "document_full": ("documento completo", "texto completo", "documento inteiro"),
}
#: Parts of a query that name its class.
CLASSES = {"document_specific": ("nosso", "do contrato", "neste documento"), "conceptual": ("o que é", "como funciona", "defina"), "comparative": ("compare", "versus", "mercado")}
#: Topics that need outside knowledge.
OUTSIDE = ("cep", "cnpj", "preço", "cotação")
#: Synonyms by word.
SYNONYMS = {
    "qual": ("quais", "que"), "como": ("de que forma", "de que maneira"), "quando": ("em que momento", "em que época"), "onde": ("em que lugar", "em qual local"),
    "por que": ("porque", "qual motivo", "qual razão"), "preço": ("valor", "custo", "quanto custa"), "dosagem": ("dose", "quantidade", "posologia"),
    "benefício": ("vantagem", "ganho", "proveito"), "problema": ("questão", "dificuldade", "desafio"), "solução": ("resposta", "resolução", "alternativa"),
}
#: Variants by keyword.
VARIANTS = {
    "motivo": ("razões", "benefícios", "vantagens", "lista motivos"), "contrato": ("cláusula", "obrigações", "termos", "acordo"), "declara": ("responsabilidade", "compromisso", "afirma"),
    "suporte": ("atendimento", "help", "assistência", "apoio"), "preço": ("valor", "custo", "investimento", "pagamento"), "prazo": ("tempo", "período", "cronograma", "duração"), "produto": ("solução", "serviço", "oferece", "disponível"),
}
#: Words that a simplified query drops.
SIMPLE_STOP = tuple("o a os as um uma de da do das dos em no na nos nas para por com sem me te se lhe vos lhes e ou mas porém contudo que qual quais quando onde como porque".split())
#: Generic questions and topics outside any document.
GENERIC = ("me fale", "fale sobre", "me explique", "explique sobre", "o que é isso", "sobre o que", "do que trata")
SCOPE = ("capital da frança", "capital do brasil", "presidente do", "quem descobriu", "quando foi descoberto", "história do mundo", "como fazer", "receita de", "como cozinhar", "previsão do tempo", "cotação do dólar", "notícias de hoje")
#: Words of titles by document type, in the order of precedence.
TITLE_TYPES = {
    "medical": tuple("bula medicamento remédio farmaco fármaco dosagem posologia cannabis cbd thc tratamento terapia protocolo paciente".split()),
    "legal": tuple("contrato acordo termo lei artigo cláusula clausula jurisprudência jurisprudencia petição peticao parecer sentença sentenca".split()),
    "academic": tuple("artigo paper estudo pesquisa análise analise tese dissertação dissertacao monografia revista journal metodologia".split()),
    "commercial": tuple("catálogo catalogo produto preço preco especificação especificacao manual guia venda compra oferta".split()),
    "educational": tuple("apostila aula curso livro capítulo capitulo exercício exercicio lição licao tutorial".split()),
}
#: Search settings by plan: top_k, threshold, rerank, max_tokens.
PLAN_SETTINGS = {"enterprise": (15, 0.03, True, 4096), "pro": (10, 0.05, True, 2048), "free": (5, 0.08, False, 1024)}


def has_any(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(p)) for p in parts))


def first_class(text: Column, table: dict[str, tuple[str, ...]], default: str) -> Column:
    out = F.lit(default)
    for name, parts in reversed(list(table.items())):
        out = F.when(has_any(text, parts), name).otherwise(out)
    return out


def mode(asked: Column, query: Column) -> Column:
    """The answer mode: the one asked for, if it is a mode, else what the query hints at, else direct."""
    asked = F.coalesce(F.nullif(F.lower(asked), F.lit("")), F.lit("auto"))
    return F.when(asked.isin("direct", *MODES), asked).when(asked != "auto", "direct").otherwise(first_class(F.lower(query), MODES, "direct"))


def query_class(query: Column) -> Column:
    return first_class(F.lower(query), CLASSES, "other")


def needs_grounding(query: Column) -> Column:
    return query_class(query).isin("conceptual", "comparative") | has_any(F.lower(query), OUTSIDE)


def complexity(query: Column) -> Column:
    n = F.size(F.regexp_extract_all(query, F.lit("[A-Za-z'-]+"), F.lit(0)))
    marks, parts = F.length(query) - F.length(F.replace(query, F.lit("?"), F.lit(""))), F.contains(query, F.lit(" and ")) | F.contains(query, F.lit(" or "))
    return F.when((n <= 5) & (marks <= 1) & ~parts, "simple").when((n > 20) | (marks > 1) | parts, "complex").otherwise("moderate")


def with_synonyms(query: Column) -> Column:
    """The query and the first three synonyms of the words it holds."""
    lists = [F.when(F.contains(F.lower(query), F.lit(w)), F.array(*map(F.lit, s))).otherwise(F.array().cast("array<string>")) for w, s in SYNONYMS.items()]
    added = F.slice(F.flatten(F.array(*lists)), 1, 3)
    return F.when(F.size(added) > 0, F.concat(query, F.lit(" "), F.array_join(added, " "))).otherwise(query)


def variants(query: Column) -> Column:
    """The query and, for its first known keyword, forms with each variant put in its place or behind; five at most."""
    low, out = F.lower(query), F.array(query)
    for word, others in reversed(list(VARIANTS.items())):
        forms = [x for o in others for x in (F.replace(low, F.lit(word), F.lit(o)), F.concat(query, F.lit(f" {o}")))]
        out = F.when(F.contains(low, F.lit(word)), F.array(query, *forms)).otherwise(out)
    return F.array_distinct(F.slice(out, 1, 5))


def simplified(query: Column) -> Column:
    """Keywords only, those with digits first, filled up to five (all with digits stay, and one more may follow)."""
    keys = F.filter(T.words(F.lower(query)), lambda w: ~w.isin(*SIMPLE_STOP) & (F.length(w) > 2))
    digits = F.filter(keys, lambda w: w.rlike(r"\d"))
    others = F.array_except(keys, digits)
    room = F.when(F.size(digits) >= 5, F.lit(1)).otherwise(5 - F.size(digits))
    # After five words the loop stops at its next look, which comes after each keyword in turn, the first included.
    some = F.when((F.size(digits) >= 5) & F.get(keys, 0).rlike(r"\d"), F.array().cast("array<string>")).otherwise(F.slice(others, 1, room))
    out = F.concat(digits, some)
    return F.when(F.size(out) > 0, F.array_join(out, " ")).otherwise(query)


def problems(query: Column, scoped: bool = True) -> Column:
    """Codes of what is wrong with a query: empty, short, out_of_scope, no_letters end the test, generic is a warning."""
    q = F.btrim(F.coalesce(query, F.lit("")))
    generic = F.when(has_any(F.lower(q), GENERIC) & (F.size(T.words(q)) < 5), F.array(F.lit("generic"))).otherwise(F.array().cast("array<string>"))
    fatal = F.when(F.lit(scoped) & has_any(F.lower(q), SCOPE), F.array(F.lit("out_of_scope"))).when(F.length(F.regexp_replace(q, r"[^\p{L}\p{N}]", "")) < 3, F.array(F.lit("no_letters"))).otherwise(F.array().cast("array<string>"))
    return F.when(q == "", F.array(F.lit("empty"))).when(F.length(q) < 3, F.array(F.lit("short"))).otherwise(F.concat(generic, fatal))


def title_type(title: Column, sample: Column) -> Column:
    """The document's type by its title, else by a sample of its text (medical, legal and academic words only)."""
    by_text = first_class(F.lower(F.coalesce(sample, F.lit(""))), {k: TITLE_TYPES[k] for k in ("medical", "legal", "academic")}, "generic")
    return F.coalesce(F.nullif(first_class(F.lower(title), TITLE_TYPES, ""), F.lit("")), by_text)
