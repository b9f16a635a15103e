"""Stems of Portuguese words, of words without accents, by regions and tables of suffixes.

The rules are those of the published Snowball stemmer. Words come unaccented, so suffixes with accents or cedillas can't
occur and are left out. A word is read from its end: the longest suffix of a table counts, and goes if it lies in its
region. Everything is a built-in expression; each rule is also given as SQL (`stem_sql`), from the same tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.core import bind
from folio.functions.text import ACCENTED, LEXEME, PLAIN, fold

# Words that a Portuguese text index leaves out, without accents.
STOP_WORDS = (
    "de a o que e do da em um para com nao uma os no se na por mais as dos como mas ao ele das seu sua ou quando muito nos ja eu tambem so "
    "pelo pela ate isso ela entre depois sem mesmo aos seus quem nas me esse eles voce essa num nem suas meu minha numa pelos elas qual nos "
    "lhe deles essas esses pelas este dele tu te voces vos lhes meus minhas teu tua teus tuas nosso nossa nossos nossas dela delas esta estes "
    "estas aquele aquela aqueles aquelas isto aquilo estou estamos estao estive esteve estivemos estiveram estava estavamos estavam estivera "
    "esteja estejamos estejam estivesse estivessem estiver estivermos estiverem hei ha havemos hao houve houvemos houveram houvera haja hajamos "
    "hajam houvesse houvessem houver houvermos houverem sou somos sao era eramos eram fui foi fomos foram fora seja sejamos sejam fosse fossem "
    "for formos forem serei sera seremos serao seria seriamos seriam tenho tem temos tinha tinhamos tinham tive teve tivemos tiveram tivera "
    "tenha tenhamos tenham tivesse tivessem tiver tivermos tiverem terei tera teremos terao teria teriamos teriam"
).split()

# Suffixes that go in R2; what replaces others, by region and what must stand before.
PLAIN_SUFFIXES = (
    "eza ezas ico ica icos icas ismo ismos ista istas oso osa osos osas amento amentos imento imentos adora ador adoras adores ante antes"
).split()
REPLACED = {"logia": "log", "logias": "log"}
MENTE, IDADE, IVO, IRA = ["mente"], ["idade", "idades"], ["iva", "ivo", "ivas", "ivos"], ["ira", "iras"]
BEFORE_AMENTE, BEFORE_MENTE, BEFORE_IDADE = ["os", "ic", "ad"], ["ante", "avel"], ["abil", "ic", "iv"]

# Endings of verbs, which go in RV.
VERB_SUFFIXES = (
    "ada ida ia aria eria iria ara era ira ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam em "
    "arem erem irem assem essem issem ado ido ando endo indo ar er ir as adas idas ias arias erias irias aras eras iras avas es ardes erdes "
    "irdes ares eres ires asses esses isses astes estes istes is ais eis ados idos amos emos aremos eremos iremos imos armos ermos irmos eu iu ou"
).split()
LAST_VOWELS = ["os", "a", "i", "o"]

_V, _C = "[aeiou]", "[^aeiou]"
_R1 = rf"^{_C}*{_V}+{_C}"
_RV = rf"^(?:.{_C}+{_V}|{_V}{_V}+{_C}|{_C}{_V}.)"


def _ending(suffixes: list[str]) -> str:
    return f"(?:{'|'.join(suffixes)})$"


_FIRST = _ending([*PLAIN_SUFFIXES, *REPLACED, "amente", *MENTE, *IDADE, *IVO, *IRA])


class _Spark:
    """The few operations on words that the rules need, as columns."""

    text = staticmethod(F.lit)
    find = staticmethod(lambda w, pattern: F.regexp_extract(w, pattern, 0))
    size = staticmethod(F.length)
    is_in = staticmethod(lambda w, words: w.isin(list(words)))
    ends = staticmethod(lambda w, suffix: w.endswith(suffix))
    head = staticmethod(lambda w, n: F.substring(w, F.lit(1), n))
    tail = staticmethod(lambda w, n: w.substr(n + F.lit(1), F.lit(1_000_000)))
    join = staticmethod(lambda w, s: F.concat(w, F.lit(s)))
    when = staticmethod(lambda c, a, b: F.when(c, a).otherwise(b))
    both = staticmethod(lambda a, b: a & b)
    minus = staticmethod(lambda a, b: a - b)
    plus = staticmethod(lambda a, b: a + b)
    fits = staticmethod(lambda a, b: a >= b)
    let = staticmethod(bind)


class _Sql:
    """The same as SQL text."""

    text = staticmethod(lambda s: f"'{s}'")
    find = staticmethod(lambda w, pattern: f"regexp_extract({w}, '{pattern}')")
    size = staticmethod(lambda w: f"length({w})")
    is_in = staticmethod(lambda w, words: f"({w} IN ({', '.join(repr(x) for x in words)}))")
    ends = staticmethod(lambda w, suffix: f"ends_with({w}, '{suffix}')")
    head = staticmethod(lambda w, n: f"substr({w}, 1, {n})")
    tail = staticmethod(lambda w, n: f"substr({w}, {n} + 1)")
    join = staticmethod(lambda w, s: f"({w} || '{s}')")
    when = staticmethod(lambda c, a, b: f"CASE WHEN {c} THEN {a} ELSE {b} END")
    both = staticmethod(lambda a, b: f"({a} AND {b})")
    minus = staticmethod(lambda a, b: f"({a} - {b})")
    plus = staticmethod(lambda a, b: f"({a} + {b})")
    fits = staticmethod(lambda a, b: f"({a} >= {b})")
    _names = iter(range(1_000_000_000))

    @classmethod
    def let(cls, value: str, body) -> str:
        name = f"v{next(cls._names)}"
        return f"list_transform([{value}], lambda {name}: {body(name)})[1]"


def _regions(o, word, then):
    """then(r1, r2, rv): the lengths before the three regions, the word's own length where a region is empty."""

    def length(before, rest, pattern):
        """The place behind the pattern's match in rest, which starts behind `before` letters."""
        return o.let(o.size(o.find(rest, pattern)), lambda n: o.when(o.fits(n, 1), o.plus(before, n), o.size(word)))

    return o.let(length(0, word, _R1), lambda r1: o.let(length(r1, o.tail(word, r1), _R1), lambda r2: o.let(length(0, word, _RV), lambda rv: then(r1, r2, rv))))


def _without(o, word, suffixes: list[str], region, otherwise=None):
    """word without the first of suffixes that it ends with, if that lies behind region letters."""
    out = word if otherwise is None else otherwise
    for s in reversed(suffixes):
        out = o.when(o.ends(word, s), o.when(o.fits(o.minus(o.size(word), len(s)), region), o.head(word, o.minus(o.size(word), len(s))), word), out)
    return out


def _standard(o, word, suffix, r1, r2, rv):
    """The first step: word changed by its longest suffix of the first table."""
    stem = o.head(word, o.minus(o.size(word), o.size(suffix)))
    at = o.minus(o.size(word), o.size(suffix))
    gone = lambda region, then: o.when(o.fits(at, region), then, word)
    out = word
    rules = [
        (PLAIN_SUFFIXES, gone(r2, stem)),
        (list(REPLACED), gone(r2, o.join(stem, "log"))),
        (["amente"], gone(r1, o.let(stem, lambda s: o.when(o.ends(s, "iv"), o.let(_without(o, s, ["iv"], r2), lambda t: o.when(o.both(o.fits(o.minus(o.size(s), 1), o.size(t)), o.ends(t, "at")), _without(o, t, ["at"], r2), t)), _without(o, s, BEFORE_AMENTE, r2))))),
        (MENTE, gone(r2, o.let(stem, lambda s: _without(o, s, BEFORE_MENTE, r2)))),
        (IDADE, gone(r2, o.let(stem, lambda s: _without(o, s, BEFORE_IDADE, r2)))),
        (IVO, gone(r2, o.let(stem, lambda s: _without(o, s, ["at"], r2)))),
        (IRA, o.when(o.both(o.fits(at, rv), o.ends(stem, "e")), o.join(stem, "ir"), word)),
    ]
    for suffixes, then in reversed(rules):
        out = o.when(o.is_in(suffix, suffixes), then, out)
    return out


def _verb(o, word, rv):
    """The second step: word without the longest verb ending that lies in RV."""
    return o.let(o.size(o.find(o.tail(word, rv), _ending(VERB_SUFFIXES))), lambda n: o.head(word, o.minus(o.size(word), n)))


def _last(o, word, rv):
    """The last step: a final e in RV goes, and the u of gu or the i of ci before it."""

    def bare(w):
        short = o.head(w, o.minus(o.size(w), 1))
        cut = o.let(short, lambda s: o.when(o.both(o.is_in(o.find(s, "(?:gu|ci)$"), ["gu", "ci"]), o.fits(o.minus(o.size(s), 1), rv)), o.head(s, o.minus(o.size(s), 1)), s))
        return o.when(o.both(o.ends(w, "e"), o.fits(o.minus(o.size(w), 1), rv)), cut, w)

    return o.let(word, bare)


def _stem(o, word):
    def within(r1, r2, rv):
        first = o.let(o.find(word, _FIRST), lambda s: o.when(o.fits(o.size(s), 1), _standard(o, word, s, r1, r2, rv), word))

        def second(w1):
            return o.let(o.when(o.is_in(w1, [word]) if o is _Spark else f"({w1} = {word})", _verb(o, word, rv), w1), third)

        def third(w2):
            same = w2 == word if o is _Spark else f"({w2} = {word})"
            changed = o.when(o.both(o.ends(w2, "ci"), o.fits(o.minus(o.size(w2), 1), rv)), o.head(w2, o.minus(o.size(w2), 1)), w2)
            return _last(o, o.when(same, _without(o, w2, LAST_VOWELS, rv), changed), rv)

        return o.let(first, second)

    return _regions(o, word, within)


def stem(word: Column) -> Column:
    """The stem of an unaccented word in lower case."""
    return bind(word, lambda w: _stem(_Spark, w))


def stem_sql(word: str) -> str:
    """SQL that gives the same, word being SQL too."""
    return _Sql.let(word, lambda w: _stem(_Sql, w))


def stemmed_lexemes(text: Column) -> Column:
    """The stems of a text's words, in order, without stop words; accents and case don't count."""
    words = F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(LEXEME), F.lit(0))
    return F.transform(F.filter(words, lambda w: ~w.isin(STOP_WORDS)), stem)


def tally(text: Column, wanted: list[str]) -> Column:
    """A struct of n, a text's words without stop words, and hits, how many of them have each wanted stem.

    Every rule leaves a beginning of the word, so only words that begin with a wanted stem are stemmed.
    """
    words = F.filter(F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(LEXEME), F.lit(0)), lambda w: ~w.isin(STOP_WORDS))
    begins = lambda w: reduce(lambda x, q: x | w.startswith(q), wanted, F.lit(False))
    alike = lambda own: F.transform(F.filter(own, begins), stem)
    counts = lambda own: bind(alike(own), lambda found: F.array(*(F.size(F.filter(found, lambda w: w == q)) for q in wanted)))
    return bind(words, lambda own: F.struct(F.size(own).alias("n"), counts(own).alias("hits")))


#: SQL of a text's words without accents and stop words; {x} is the text.
WORDS_SQL = f"list_filter(regexp_extract_all(translate(lower(coalesce({{x}}, '')), '{ACCENTED}', '{PLAIN}'), '[\\p{{{{L}}}}\\p{{{{N}}}}_]+'), lambda w: w NOT IN ({', '.join(map(repr, STOP_WORDS))}))"

__all__ = ["STOP_WORDS", "stem", "stem_sql", "stemmed_lexemes", "tally"]
