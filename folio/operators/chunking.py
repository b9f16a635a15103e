"""Cutting texts into chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.core import bind
from folio.functions.text import tokens

TOKENS_A_WORD = 1.3


def _steps(size: int, overlap: int) -> tuple[int, int]:
    """Words of a chunk, and from its start to the next one's."""
    width = int(size / TOKENS_A_WORD)
    return width, max(1, width - int(overlap / TOKENS_A_WORD))


def _last(n_words: Column, width: int, step: int) -> Column:
    return F.greatest(F.lit(0), F.ceil((n_words - width) / F.lit(step))).cast("int")


def window_indexes(text: Column, size: int = 500, overlap: int = 50) -> Column:
    """The chunk_index of each of a text's fixed_windows, without the chunks."""
    return bind(F.size(tokens(text)), lambda n: F.when(n > 0, F.sequence(F.lit(0), _last(n, *_steps(size, overlap)))))


def fixed_windows(text: Column, size: int = 500, overlap: int = 50) -> Column:
    """Chunks of size tokens by estimate, each starting `overlap` before the last one's end: structs chunk_index, chunk_text, token_count."""
    width, step = _steps(size, overlap)

    def cut(words: Column) -> Column:
        last = _last(F.size(words), width, step)

        def chunk(k: Column) -> Column:
            own = F.slice(words, k * step + 1, F.lit(width))
            count = F.greatest(F.lit(1), F.floor(F.size(own) * F.lit(TOKENS_A_WORD))).cast("int")
            return F.struct(k.alias("chunk_index"), F.array_join(own, " ").alias("chunk_text"), count.alias("token_count"))

        return F.transform(F.sequence(F.lit(0), last), chunk)

    return bind(tokens(text), lambda w: F.when(F.size(w) > 0, cut(w)))


def chunked(df: DataFrame, key: str, text: str, size: int = 500, overlap: int = 50) -> DataFrame:
    """A row for each chunk; texts without words have none."""
    return df.select(key, F.explode(fixed_windows(F.col(text), size, overlap)).alias("c")).select(key, "c.*")


def rechunk_counts(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, before, after: chunks of each document that has any, as stored and as cut anew."""
    counted = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    both = counted(old, "before").join(counted(new, "after"), key, "full_outer")
    return both.select(key, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("before", "after")))
