"""Lexical and vector search.

Lexical search needs every lexeme of the question; its rank adds, for each, the weight of the best field that holds it
times its count over 1 + ln(number of lexemes). A question's lexemes are a few literals, so a search is one scan with a
filter and a bounded top-k per task. Fields of different tables are tallied where they are, and only the tallies, a few
numbers a row, are joined. Ties go to the smaller id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.core import bind, no_strings
from folio.functions.text import LEXEME, fold, lexemes, plain_lexemes
from folio.functions.vectors import cosine

WEIGHT_A, WEIGHT_B, WEIGHT_C, UNWEIGHTED = 1.0, 0.4, 0.2, 0.1


def _count(words: Column, lexeme: str) -> Column:
    return F.size(F.filter(words, lambda w: w == lexeme))


def _may_hold(columns: list[Column], lexeme: str) -> Column:
    """Whether a column's text holds the letters of a lexeme anywhere: cheap, and true wherever the lexeme stands."""
    found = F.lit(False)
    for c in columns:
        found = found | fold(F.coalesce(c, F.lit(""))).contains(lexeme)
    return found


def _holds(text: Column, lexeme: str) -> Column:
    """Whether a text has a lexeme, without cutting it into words."""
    folded = fold(F.coalesce(text, F.lit("")))
    return folded.contains(lexeme) & folded.rlike(rf"(?<![\p{{L}}\p{{N}}_]){lexeme}(?![\p{{L}}\p{{N}}_])")


def matching(df: DataFrame, question: str, fields: dict[str, float]) -> DataFrame:
    """Rows that hold every lexeme of question in one of the fields (text column: weight), with rank."""
    wanted = plain_lexemes(question)
    if not wanted:
        return df.limit(0).withColumn("rank", F.lit(0.0))
    for lexeme in wanted:
        df = df.filter(_may_hold([F.col(c) for c in fields], lexeme))
    held = df.withColumns({f"_l_{c}": lexemes(F.col(c)) for c in fields})
    for lexeme in wanted:
        found = F.lit(False)
        for c in fields:
            found = found | F.array_contains(f"_l_{c}", lexeme)
        held = held.filter(found)
    length = sum(F.size(f"_l_{c}") for c in fields)
    rank = F.lit(0.0)
    for lexeme in wanted:
        best = F.greatest(F.lit(0.0), *(F.when(F.array_contains(f"_l_{c}", lexeme), F.lit(w)).otherwise(F.lit(0.0)) for c, w in fields.items()))
        rank = rank + best * sum(_count(F.col(f"_l_{c}"), lexeme) for c in fields)
    return held.withColumn("rank", rank / (1 + F.log(F.greatest(length, F.lit(1)).cast("double")))).drop(*(f"_l_{c}" for c in fields))


def tally(text: Column, wanted: list[str], lexer=lexemes) -> Column:
    """A struct of n, a text's lexemes, and hits, how often each wanted one is among them."""
    return bind(lexer(text), lambda own: F.struct(F.size(own).alias("n"), F.array(*(_count(own, q) for q in wanted)).alias("hits")))


def tallied(tallies: dict[str, Column], fields: dict[str, float], wanted: list[str]) -> Column:
    """The rank of a row from its fields' tallies, null unless every wanted lexeme stands in a field; a null tally is an empty text's."""
    hits = lambda c, i: F.coalesce(F.get(tallies[c]["hits"], F.lit(i)), F.lit(0))
    rank, held = F.lit(0.0), F.lit(bool(wanted))
    for i in range(len(wanted)):
        count = sum(hits(c, i) for c in fields)
        rank = rank + F.greatest(F.lit(0.0), *(F.when(hits(c, i) > 0, F.lit(float(w))).otherwise(F.lit(0.0)) for c, w in fields.items())) * count
        held = held & (count > 0)
    length = sum(F.coalesce(tallies[c]["n"], F.lit(0)) for c in fields)
    return F.when(held, rank / (1 + F.log(F.greatest(length, F.lit(1)).cast("double"))))


def scanned(df: DataFrame, key: str, fields: dict[str, float], wanted: list[str]) -> DataFrame:
    """id and rank of the rows that hold every wanted lexeme, in one pass: texts are cut once, and what doesn't match goes there."""
    one = bind(F.struct(*(tally(F.col(c), wanted).alias(c) for c in fields)), lambda x: tallied({c: x[c] for c in fields}, fields, wanted))
    return df.select(F.col(key).alias("id"), F.explode(F.filter(F.array(one), lambda r: r.isNotNull())).alias("rank"))


def top(df: DataFrame, score: str, k: int, key: str = "id") -> DataFrame:
    return df.orderBy(F.desc(score), key).limit(k)


def highlight(text: Column, question: str, width: int = 20) -> Column:
    """The words around the first one that the question holds, its own in <b> marks."""
    wanted = plain_lexemes(question)
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    hit = lambda w: F.arrays_overlap(lexemes(w), F.array(*map(F.lit, wanted)))
    at = F.array_position(F.transform(words, hit), True)
    shown = F.slice(words, F.greatest(at, F.lit(1)).cast("int"), F.lit(width))
    return F.array_join(F.transform(shown, lambda w: F.when(hit(w), F.concat(F.lit("<b>"), w, F.lit("</b>"))).otherwise(w)), " ")


def headline(text: Column, wanted: Column, lexer=lexemes, most: int = 20, least: int = 5) -> Column:
    """The shortest stretch of words that holds all wanted lexemes (an array), its own in <b> marks; ties go to the first.

    A stretch of fewer than `least` words goes on behind, then before it, as far as the text goes; of one of more than
    `most` words the first ones are shown. A text that lacks a lexeme is shown from its start, `least` words long.
    """
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")

    def shown(parts: Column) -> Column:
        own = parts["own"]
        places = F.transform(F.array_distinct(parts["wanted"]), lambda q: F.filter(F.sequence(F.lit(1), F.greatest(F.size(own), F.lit(1))), lambda i: F.array_contains(F.coalesce(F.get(own, i - 1), F.array(F.lit(""))), q)))
        starts = F.array_distinct(F.flatten(places))
        end = lambda i: F.array_max(F.transform(places, lambda p: F.coalesce(F.array_min(F.filter(p, lambda j: j >= i)), F.lit(1 << 30))))
        covers = F.filter(F.transform(starts, lambda i: F.struct((end(i) - i + 1).alias("n"), i.alias("i"))), lambda c: c["n"] < (1 << 29))
        best = F.array_min(covers)
        size = F.size(own)
        n = F.least(F.greatest(F.coalesce(best["n"], F.lit(0)), F.lit(least)), F.lit(most), size)
        first = F.greatest(F.least(F.coalesce(best["i"], F.lit(1)), size - n + 1), F.lit(1))
        marked = F.zip_with(parts["words"], own, lambda w, x: F.when(F.arrays_overlap(x, parts["wanted"]), F.concat(F.lit("<b>"), w, F.lit("</b>"))).otherwise(w))
        return F.array_join(F.slice(marked, first, n), " ")

    return bind(bind(words, lambda w: F.struct(w.alias("words"), F.transform(w, lexer).alias("own"), F.coalesce(wanted, no_strings()).alias("wanted"))), shown)


def bm25(df: DataFrame, key: str, text: str, question: str, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The k rows of best BM25 score that hold any word of at least two letters of question."""
    wanted = [w for w in plain_lexemes(question) if len(w) >= 2]
    body = F.col(text)
    stats = df.agg(
        F.count("*").alias("n"),
        F.avg(F.regexp_count(F.coalesce(body, F.lit("")), F.lit(LEXEME))).alias("mean"),
        *(F.count_if(_holds(body, q)).alias(f"df{i}") for i, q in enumerate(wanted)),
    )
    words = df.filter(F.greatest(F.lit(False), F.lit(False), *(_holds(body, q) for q in wanted))).select(key, lexemes(body).alias("w"))
    joined = words.select(key, F.size("w").alias("len"), *(_count(F.col("w"), q).alias(f"tf{i}") for i, q in enumerate(wanted))).crossJoin(F.broadcast(stats))  # stats is one row
    score = F.lit(0.0)
    for i in range(len(wanted)):
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        score = score + idf * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return top(joined.select(key, score.alias("score")), "score", k, key)


def table_search(df: DataFrame, question_terms: list[str], columns: list[Column]) -> DataFrame:
    """Rows of which every term of at least three letters occurs in some column, whatever the case."""
    out = df
    for term in (t for t in question_terms if len(t) >= 3):
        found = F.lit(False)
        for c in columns:
            found = found | F.coalesce(c.ilike(f"%{term}%"), F.lit(False))
        out = out.filter(found)
    return out


def similar(vectors: DataFrame, query: list[float]) -> DataFrame:
    """vectors with similarity to one query vector; zero vectors are left out."""
    return vectors.withColumn("similarity", cosine(F.col("embedding"), query)).filter("similarity IS NOT NULL")


def best_per(df: DataFrame, key: list[str], score: str, tie: str) -> DataFrame:
    """Each key's row of best score."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(score), tie))
    return df.withColumn("_n", n).filter("_n = 1").drop("_n")


def ranked(df: DataFrame, score: str, tie: str) -> DataFrame:
    """Adds pos, the place from 0. For result lists of bounded length."""
    return df.withColumn("pos", F.row_number().over(Window.orderBy(F.desc(score), tie)) - 1)


def fuse(lists: DataFrame, key: str = "id", constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (list, key, pos) rows: score is the sum of 1 / (constant + pos + 1); first_seen orders ties."""
    seen = F.col("list") * F.lit(1_000_000) + F.col("pos")
    return lists.groupBy(key).agg(F.sum(1.0 / (constant + F.col("pos") + 1)).alias("score"), F.min(seen).alias("first_seen"))


#: Fewer results than this make a search widen its question.
FEW = 3


def lists_of(parts: list[DataFrame], number: int) -> DataFrame | None:
    """Result lists (id, pos) one after another as list `number`: places run on, as if they were one list."""
    out, shift = None, 0
    for part in parts:
        rows = part.select("id", (F.col("pos") + shift).alias("pos"), F.lit(number).alias("list"))
        out, shift = rows if out is None else out.union(rows), shift + part.count()  # result lists are of bounded length
    return out


def hybrid(words: list[DataFrame], vectors: list[DataFrame], k: int) -> DataFrame:
    """The k best of word hits and vector hits by reciprocal rank; without vectors, as when no embedder answers, the word hits alone."""
    both = [x for x in (lists_of(words, 0), lists_of(vectors, 1)) if x is not None]
    rows = both[0] if len(both) == 1 else both[0].unionByName(both[1])
    fused = fuse(rows).orderBy(F.desc("score"), "first_seen", "id").limit(k)
    return fused.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("score"), "first_seen", "id")) - 1)


def widened(found: DataFrame, search_again, k: int) -> DataFrame:
    """found, or if it has fewer than FEW rows, its fusion with what search_again gives: (word hits, vector hits) of the wider question."""
    if found.count() >= FEW:
        return found
    words, vectors = search_again()
    return hybrid([found, words], [vectors] if vectors is not None else [], k)


# Kinds of sources that a vector search knows, and those whose rows have a category to filter by.
KINDS = ("chunk", "page", "page_chunk", "page_summary", "question", "section")
WITH_CATEGORY = ("chunk", "page", "page_summary")


def semantic(vectors: DataFrame, kind: str, query: list[float], k: int, category: str | None = None) -> DataFrame:
    """The k nearest vectors of a kind of source; none for an unknown kind. Only some kinds heed the category."""
    rows = vectors.filter(F.col("source_type") == kind) if kind in KINDS else vectors.limit(0)
    if category is not None and kind in WITH_CATEGORY:
        rows = rows.filter(F.col("category") == category)
    return top(similar(rows, query), "similarity", k, "source_id")
