"""Text functions of search and scoring, all built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.core import bind, strings

# Words that a question's search terms leave out.
QUESTION_WORDS = (
    "quais qual como onde quando quanto quanta quantos quantas porque porquê será seria poderia pode posso gostaria preciso quero "
    "favor obrigado obrigada por sobre entre durante após antes através ainda também muito mais menos todos todas cada outro outra "
    "outros outras esse essa esses essas este esta estes estas aquele aquela aqueles aquelas isso isto aquilo foram sido sendo está "
    "estão são era eram liste listar mostre mostrar apresente apresentar informe informar busque buscar encontre encontrar traga "
    "trazer diga dizer me mim meu minha meus minhas os as de do da dos das ao aos à às no na nos nas em um uma uns umas o a e"
).split()

# What a search is widened by.
SYNONYMS = {
    "diárias": ["ajuda de custo", "indenização de viagem", "diárias pagas"],
    "diarias": ["ajuda de custo", "indenização de viagem", "diárias"],
    "viagens": ["deslocamento", "missão oficial", "diárias"],
    "licitações": ["pregão", "concorrência", "dispensa", "contratação"],
    "licitacoes": ["pregão", "concorrência", "dispensa", "contratação"],
    "contratos": ["ajuste", "acordo", "contratação", "convênio"],
    "servidores": ["funcionários", "colaboradores", "quadro de pessoal"],
    "salários": ["remuneração", "vencimentos", "folha de pagamento"],
    "salarios": ["remuneração", "vencimentos", "folha de pagamento"],
    "orçamento": ["dotação", "receita", "despesa", "LOA"],
    "orcamento": ["dotação", "receita", "despesa", "LOA"],
    "compras": ["aquisições", "licitações", "pregão eletrônico"],
    "gastos": ["despesas", "valores pagos", "custos"],
}

# Words that tell a question's intent, in order of priority.
INTENTS = {
    "followup": "isso aquilo disse mencionou falou anterior acima antes continue".split(),
    "document_query": "pdf documento arquivo baixar download anexo relatório planilha xlsx csv".split(),
    "data_query": "quantos quanto total valor média porcentagem percentual número dado dados tabela lista servidores funcionários contratos".split(),
    "navigation": ["onde", "como chego", "como acesso", "link", "endereço", "seção", "aba", "menu", "página", "portal"],
}

ACCENTED, PLAIN = "áàâãäéèêëíìîïóòôõöúùûüçñ", "aaaaaeeeeiiiiooooouuuucn"
LEXEME = r"[\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    """Words between white space; none for null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def fold(text: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def lexemes(text: Column) -> Column:
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(LEXEME), F.lit(0))


def clean_query(text: Column) -> Column:
    """A question's search terms: no punctuation, lower case, without question words."""
    words = tokens(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}_\s]", " ")))
    return F.array_join(F.filter(words, lambda w: ~w.isin(QUESTION_WORDS)), " ")


def clean(question: str) -> str:
    """clean_query of one question, on the driver."""
    words = re.sub(r"[^\w\s]", " ", question).lower().split()
    return " ".join(w for w in words if w not in QUESTION_WORDS)


def plain_lexemes(question: str) -> list[str]:
    """lexemes of one question's terms, on the driver."""
    folded = clean(question).translate(str.maketrans(ACCENTED, PLAIN))
    return list(dict.fromkeys(re.findall(r"\w+", folded)))


def expand_query(text: Column) -> Column:
    """The text followed by the synonyms of its words; null if none has any."""
    table = F.create_map(*(x for k, v in SYNONYMS.items() for x in (F.lit(k), F.lit(" ".join(v)))))
    extra = F.filter(F.transform(tokens(F.lower(text)), lambda w: F.try_element_at(table, w)), lambda x: x.isNotNull())
    return bind(extra, lambda e: F.when(F.size(e) > 0, F.concat(text, F.lit(" "), F.array_join(e, " "))))


def intent(text: Column) -> Column:
    """The first intent that shares a word with the text; words are split at white space only."""

    def classified(words: Column) -> Column:
        out = F.lit("general_search")
        for name, keys in reversed(INTENTS.items()):
            out = F.when(F.arrays_overlap(words, strings(keys)), F.lit(name)).otherwise(out)
        return out

    return bind(tokens(F.lower(text)), classified)


def estimated_tokens(n_words: Column) -> Column:
    return F.floor(n_words * F.lit(1.3)).cast("int")


def normal_hash(text: Column) -> Column:
    """SHA-256 of the text in lower case with single blanks: equal for texts that differ in neither word nor order."""
    return F.sha2(F.array_join(tokens(F.lower(text)), " "), 256)


def summary(text: Column, most: int = 500) -> Column:
    """At most `most` characters, cut at the last blank, with an ellipsis if cut."""
    head = F.substring(text, 1, most)
    cut = F.regexp_extract(head, r"(?s)^(.*)\x20", 1)
    return F.when(F.length(text) > most, F.concat(F.when(head.contains(" "), cut).otherwise(head), F.lit("..."))).otherwise(text)


def squeezed(text: Column) -> Column:
    """Runs of blanks and tabs as one blank, more than two line ends as two."""
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n")


def relevant_section(content: Column, question: str, most: int = 40_000) -> Column:
    """The part of content that starts at the question's terms.

    A year anchors at `digits/YEAR` (from its line's start), else at a line that is the year alone, and then no other
    term counts; otherwise the furthest first occurrence of a term of more than three letters is the start.
    """
    text = squeezed(content)
    terms = [w for w in clean(question).split() if len(w) > 3]
    years = [w for w in terms if re.fullmatch(r"20\d{2}", w)]

    def cut(body: Column) -> Column:
        best = F.lit(0)
        for term in terms:
            if term not in years:
                best = F.greatest(best, F.instr(F.lower(body), term) - 1)
        for year in years:
            numbered = F.regexp_instr(body, F.lit(rf"(?m)^.*?\d+/{year}"))
            alone = F.regexp_instr(body, F.lit(rf"(?m)^[ \t]*{year}[ \t]*$"))
            best = F.when(numbered > 0, numbered - 1).when(alone > 0, alone - 1).otherwise(best)
        return body.substr(F.greatest(best, F.lit(0)) + 1, F.lit(most))

    return bind(text, cut)


def years(question: Column) -> Column:
    """The years of this century that a question names, each once."""
    return F.array_distinct(F.regexp_extract_all(question, F.lit(r"\b(20\d{2})\b"), F.lit(1)))


def names_year(url: Column, question: Column) -> Column:
    """Whether a URL holds a year of the question."""
    return F.coalesce(F.exists(years(question), lambda y: url.contains(y)), F.lit(False))
