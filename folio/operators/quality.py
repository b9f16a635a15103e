"""Quality of chunks: six scores, their weighted mean, and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.core import bind
from folio.functions.text import normal_hash, tokens

# Limits in tokens, and the weights of the scores.
LEAST_TOKENS, MOST_TOKENS = 30, 1200
WEIGHTS = {"length": 0.15, "density": 0.25, "no_ocr": 0.20, "coherence": 0.15, "no_dup": 0.10, "information": 0.15}
LETTERS = "a-záéíóúãõâêîôûàç"
PASSING = 0.5


#: Ends of lines, as universal newlines have them.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
WORD_OF_LETTERS = rf"(?<![\p{{L}}\p{{N}}_])[{LETTERS}]{{3,}}(?![\p{{L}}\p{{N}}_])"


def _distinct_share(hashes: Column, n: int) -> Column:
    """Distinct n-grams over all, by hashes of words; null if there is none."""
    grams = F.transform(F.sequence(F.lit(0), F.size(hashes) - n), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(n))))
    return F.when(F.size(hashes) >= n, bind(grams, lambda g: F.size(F.array_distinct(g)) / F.size(g)))


def measured(text: Column) -> Column:
    """A struct of the raw measures of a text."""
    body = F.coalesce(text, F.lit(""))
    junk = F.regexp_count(body, F.lit(r"[^\p{L}\p{N}_\s.,;:()\-/]"))
    sentences = F.split(F.regexp_replace(body, r"^\s+|\s+$", ""), r"(?<=[.!?])\s+")
    lines = F.split(body, LINE_END)
    repeated = bind(lines, lambda x: F.exists(F.transform(x, lambda a, i: (F.length(a) >= 20) & F.coalesce(F.get(x, i + 1) == a, F.lit(False))), lambda b: b))
    good = bind(sentences, lambda s: F.size(F.filter(s, lambda x: x.rlike(r"\S\s+\S+\s+\S"))) / F.size(s))
    return bind(
        F.transform(tokens(body), lambda w: F.xxhash64(w)),
        lambda w: F.struct(
            F.floor(F.size(w) * F.lit(1.3)).cast("int").alias("tokens"),
            (F.regexp_count(F.lower(body), F.lit(WORD_OF_LETTERS)) / F.greatest(F.floor(F.size(w) * F.lit(1.3)), F.lit(1))).alias("density"),
            (junk / F.greatest(F.length(body), F.lit(1))).alias("junk"),
            good.alias("coherence"),
            repeated.alias("repeated"),
            _distinct_share(w, 2).alias("pairs"),
            _distinct_share(w, 3).alias("triples"),
        ),
    )


def judged(m: Column) -> Column:
    """score, flags and quarantined of a struct of measures."""
    short, long = m["tokens"] < LEAST_TOKENS, m["tokens"] > MOST_TOKENS
    pairs = F.coalesce(m["pairs"], F.lit(1.0))
    information = F.when(m["triples"].isNull(), F.lit(0.0)).otherwise(F.least(m["triples"] / 0.8, F.lit(1.0)))
    scores = {
        "length": F.when(short, F.lit(0.0)).when(long, F.lit(0.5)).otherwise(F.lit(1.0)),
        "density": F.least(m["density"] / 0.6, F.lit(1.0)),
        "no_ocr": F.greatest(1.0 - m["junk"] * 10, F.lit(0.0)),
        "coherence": m["coherence"],
        "no_dup": F.when(m["repeated"], F.lit(0.3)).otherwise(pairs),
        "information": information,
    }
    score = sum(scores[k] * w for k, w in WEIGHTS.items())
    flags = F.filter(
        F.array(
            F.when(short, F.lit("too_short")).when(long, F.lit("too_long")),
            F.when(m["density"] < 0.3, F.lit("low_density")),
            F.when(m["junk"] > 0.05, F.lit("ocr_artifacts")),
            F.when(m["coherence"] < 0.4, F.lit("incoherent")),
            F.when(m["repeated"] | (pairs < 0.5), F.lit("internal_dup")),
            F.when(information < 0.3, F.lit("low_information")),
        ),
        lambda f: f.isNotNull(),
    )
    return bind(score, lambda s: F.struct(s.alias("score"), flags.alias("flags"), (s < PASSING).alias("quarantined")))


def scored(df: DataFrame, text: str) -> DataFrame:
    """Adds score, flags and quarantined."""
    return df.withColumn("_j", bind(measured(F.col(text)), judged)).select("*", "_j.*").drop("_j")


def duplicates(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """Rows whose text stands in an earlier row too, by order of key, with that row's key as first_<key>. Shuffles the hash, not the text."""
    slim = df.select(*key, normal_hash(F.col(text)).alias("text_hash"))
    order = Window.partitionBy("text_hash").orderBy(*key)
    first = [F.first(k).over(order).alias(f"first_{k}") for k in key]
    return slim.select("*", F.row_number().over(order).alias("_n"), *first).filter("_n > 1").drop("_n")


def sound_duplicates(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """duplicates among the rows that aren't quarantined; only texts that stand twice are scored."""
    slim = df.select(*key, normal_hash(F.col(text)).alias("text_hash"))
    twice = slim.groupBy("text_hash").agg(F.count("*").alias("_n")).filter("_n > 1").select("text_hash")
    copies = df.join(slim.join(twice, "text_hash").select(*key), key, "left_semi")
    return duplicates(scored(copies, text).filter("NOT quarantined"), key, text)


def flagged(flags: Column, flag: str) -> Column:
    """flags with flag, each once."""
    return F.array_sort(F.array_distinct(F.concat(flags, F.array(F.lit(flag)))))


def score_pending(chunks: DataFrame, text: str, stored: str = "quality_score") -> DataFrame:
    """chunks (with columns stored, flags and quarantined) as they are to be written back: those without a score get one."""
    fresh = scored(chunks.filter(F.col(stored).isNull()).drop(stored, "flags", "quarantined"), text).withColumnRenamed("score", stored)
    return chunks.filter(F.col(stored).isNotNull()).unionByName(fresh)
