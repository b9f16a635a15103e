"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

RULES is data: each row names a metric, the bounds it must keep, and why. `verdict` turns the rows into one boolean
expression over a struct of metrics, so adding a rule changes no code. All work stays in the JVM; a row is judged by
itself, so there is no shuffle, and repeated rows get equal results.

The stop-word rule knows the languages of STOP_WORDS, 28 of Latin, Cyrillic or Greek script; marks around a word don't
matter. Texts that are mainly of other scripts (OTHER_SCRIPT of their characters) aren't judged by it. Running text of a
Latin, Cyrillic or Greek language that isn't listed may fail it: give rules of your own then.

Nulls and empty texts have no words: all counts are 0, base_failed is true and kept is false. Very long texts take time
in proportion to n log n, only where windows do repeat. Extra columns, also with the names of ours, pass `judge` by;
one with the name of the column that it adds is refused.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.shared import BLANKS, let, words

WINDOW = 8


class Rule(NamedTuple):
    metric: str
    least: float | None
    most: float | None
    why: str


#: Thresholds of the method; the base rules stand before them.
RULES = (
    Rule("mean_word_chars", 1.5, 30.0, "words of a usual length"),
    Rule("symbols_per_word", None, 0.25, "not a run of symbols"),
    Rule("stop_word_ratio", 0.05, None, "running text has function words"),
    Rule("dup_line_ratio", None, 0.5, "lines aren't mostly repeats"),
)
#: Checked in whole numbers besides: 100 * n_repeat_words may not exceed 30 * n_words.
BASE_RULES = (Rule("n_words", 20, None, "long enough to judge"),)
#: Marks that don't belong to the word that they stand at.
MARKS = ".,;:!?()[]{}*_\"'«»„“”‘’…-"
#: Share of characters of other scripts from which the stop-word rule doesn't judge, and these characters.
OTHER_SCRIPT = 0.25
OTHER_LETTER = r"[\x{530}-\x{1DFF}\x{2C00}-\x{D7FF}\x{F900}-\x{10FFFF}]"
#: The most frequent function words of English, German, French and Spanish, then of other languages: Italian,
#: Portuguese, Dutch, Swedish, Danish, Norwegian, Finnish, Polish, Czech, Slovak, Hungarian, Romanian, Turkish, Croatian,
#: Slovene, Estonian, Latvian, Lithuanian, Indonesian, Vietnamese, Russian, Ukrainian, Bulgarian, Greek.
STOP_WORDS = (
    "the of and to a in is it that for on with as was be by are this from at or an not have "
    "der die das und ist nicht ein eine zu von mit den dem im für auf auch sich des als "
    "le la les et est un une de du des en que pour dans sur pas avec par au qui "
    "el los las y es una del se con por para no lo su al como más "
    "il di che e non per è o da do em um os het een van niet och att som är på og det til af ikke å "
    "ja on ei että oli w z i na nie to się v že je s a az és hogy egy și cu nu care ve bir bu da için "
    "u su za ki pa ne un ar ir tai yang dan ini và là của có и в не на что с і у та що от за се και το η της"
).split()


def _repeated_words(tokens: Column) -> Column:
    """Words covered by 8-word windows that occur at least twice in tokens."""

    def covered(pairs: Column) -> Column:
        # pairs: (hash, start), sorted; equal neighbours are the windows that occur again
        def again(x: Column, i: Column) -> Column:
            same_before = F.get(pairs, i - 1)["h"] == x["h"]
            same_after = F.get(pairs, i + 1)["h"] == x["h"]
            return F.coalesce(same_before, F.lit(False)) | F.coalesce(same_after, F.lit(False))

        starts = F.array_sort(F.transform(F.filter(pairs, again), lambda x: x["i"]))
        return let(
            starts,
            lambda at: F.aggregate(
                F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW)))),
                F.lit(0).cast("long"),
                lambda acc, x: acc + x,
            ),
        )

    def of_hashes(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(pairs, covered)).otherwise(F.lit(0).cast("long"))

    def of_words(hashed: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(hashed) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashed, i, WINDOW)))
        return F.when(F.size(hashed) > WINDOW, let(windows, of_hashes)).otherwise(F.lit(0).cast("long"))

    return let(F.transform(tokens, lambda w: F.xxhash64(w)), of_words)


def metrics(text: Column) -> Column:
    """A struct of all counts and ratios of a text."""
    body = F.coalesce(text, F.lit(""))
    n_other = F.regexp_count(body, F.lit(OTHER_LETTER))
    n_symbols = F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long")
    lines = F.filter(F.split(body, "\n"), lambda x: F.regexp_replace(x, BLANKS, "") != "")

    def with_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda acc, x: acc + F.length(x)).alias("word_chars"),
            F.size(F.filter(w, lambda x: F.btrim(F.lower(x), F.lit(MARKS)).isin(sorted(set(STOP_WORDS))))).cast("long").alias("n_stop_words"),
            _repeated_words(w).alias("n_repeat_words"),
        )

    def with_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    def joined(w: Column) -> Column:
        return let(
            let(lines, with_lines),
            lambda x: F.struct(
                w["n_words"].alias("n_words"),
                w["word_chars"].alias("word_chars"),
                n_symbols.alias("n_symbols"),
                x["n_dup_lines"].alias("n_dup_lines"),
                w["n_repeat_words"].alias("n_repeat_words"),
                (w["word_chars"] / F.greatest(w["n_words"], F.lit(1))).alias("mean_word_chars"),
                (n_symbols / F.greatest(w["n_words"], F.lit(1))).alias("symbols_per_word"),
                F.when(n_other > OTHER_SCRIPT * w["word_chars"], 1.0).otherwise(w["n_stop_words"] / F.greatest(w["n_words"], F.lit(1))).alias("stop_word_ratio"),
                (x["n_dup_lines"] / F.greatest(x["n_lines"], F.lit(1))).alias("dup_line_ratio"),
            ),
        )

    return let(let(words(body), with_words), joined)


def verdict(m: Column, rules=RULES) -> Column:
    """The rules as one boolean over the struct of metrics."""
    held = F.lit(True)
    for rule in rules:
        if rule.least is not None:
            held = held & (m[rule.metric] >= rule.least)
        if rule.most is not None:
            held = held & (m[rule.metric] <= rule.most)
    return held


def base_failed(m: Column) -> Column:
    return ~verdict(m, BASE_RULES[:1]) | (100 * m["n_repeat_words"] > 30 * m["n_words"])


def judge(df: DataFrame, text: str = "text", out: str = "quality", rules=RULES) -> DataFrame:
    """Adds the struct column out with all metrics, base_failed and kept. A column of that name is an error, as nothing is overwritten."""
    if out.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"there is a column {out} already; name another one to add")

    def judged(m: Column) -> Column:
        return F.struct(m.alias("metrics"), base_failed(m).alias("base_failed"), (~base_failed(m) & verdict(m, rules)).alias("kept"))

    return df.withColumn(out, let(metrics(F.col(text)), judged))


def keep(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """Only the rows that pass, with their own columns."""
    return df.filter(let(metrics(F.col(text)), lambda m: ~base_failed(m) & verdict(m, rules)))


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    q = judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    m = "quality.metrics."
    return q.select("doc_id", *(F.col(m + c).alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "quality.base_failed", "quality.kept")


_STOPS = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
_MARKS = MARKS.replace("'", "''")
ORACLE = rf"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (SELECT rid, unnest(range(1, len(w) - 6)) AS i, w FROM t WHERE len(w) >= 8),
keyed AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS k FROM win),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM keyed) WHERE n > 1),
cover AS (SELECT rid, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n_repeat_words
          FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM again) GROUP BY rid),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(body) - length(translate(body, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x: trim(lower(x), '{_MARKS}') IN ({_STOPS}))) AS n_stop, length(regexp_replace(body, '[^{OTHER_LETTER[1:]}', '', 'g')) AS n_other
  FROM t LEFT JOIN cover USING (rid)),
f AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND word_chars::DOUBLE / greatest(n_words, 1) BETWEEN 1.5 AND 30.0
        AND n_symbols::DOUBLE / greatest(n_words, 1) <= 0.25 AND (n_other > {OTHER_SCRIPT} * word_chars OR n_stop::DOUBLE / greatest(n_words, 1) >= 0.05)
        AND n_dup_lines::DOUBLE / greatest(n_lines, 1) <= 0.5) AS kept
FROM f
"""
