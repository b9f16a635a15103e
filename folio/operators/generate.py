"""Summaries of pages, of sections and questions to chunks, as a model gives them, for what has none yet.

A model is asked in batches inside the tasks; a batch that fails costs its own texts alone: their reply is null, and they
stay pending for the next run. Replies are JSON lists, bare or in a fence; what is none gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUESTIONS = "array<struct<chunk_id:bigint,questions:array<string>>>"
SUMMARIES = "array<struct<page_id:bigint,summary:string>>"
SECTIONS = "array<struct<section_title:string,page_range:string,summary_text:string>>"
AT_ONCE = 20


def pending(items: DataFrame, covered: DataFrame, key: str = "id") -> DataFrame:
    """items whose key isn't covered yet."""
    return items.join(covered.select(key).distinct(), key, "left_anti")


def replies(items: DataFrame, ask: Callable[[list[tuple[int, str]]], list[str]], key: str = "id", text: str = "text", at_once: int = AT_ONCE) -> DataFrame:
    """key and reply: ask gets (key, text) pairs, `at_once` at most, and gives a reply for each; null where it fails.

    Of the texts that a task is handed, only those of one call are made strings at a time.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, at_once):
                own = part.slice(at, at_once)
                some = [(k, x or "") for k, x in zip(own.column("key").to_pylist(), own.column("text").to_pylist())]
                try:
                    got = list(ask(some))
                except Exception:  # noqa: BLE001  whatever a model's client raises: the batch stays pending
                    got = []
                out = pa.array(got if len(got) == len(some) else [None] * len(some), pa.string())
                yield pa.RecordBatch.from_arrays([own.column("key"), out], [key, "reply"])

    slim = items.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return slim.mapInArrow(run, f"`{key}` long, reply string")


def listed(reply: Column, form: str) -> Column:
    """The JSON list of a reply, bare or in a fence; null if it has none."""
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(\[.*?\])\s*```", 1)
    bare = F.regexp_extract(reply, r"(?s)\[.*\]", 0)
    return F.coalesce(*(F.when(x != "", F.from_json(x, form)) for x in (fenced, bare)))


def questions(answered: DataFrame, key: str = "id") -> DataFrame:
    """key, place and question: the questions that replies give to their own chunk, blank ones left out."""
    own = F.filter(listed(F.col("reply"), QUESTIONS), lambda x: x["chunk_id"] == F.col(key))
    asked = F.filter(F.flatten(F.transform(own, lambda x: F.coalesce(x["questions"], F.array().cast("array<string>")))), lambda q: F.trim(q) != "")
    return answered.select(key, F.posexplode(asked).alias("place", "question"))


def summaries(answered: DataFrame, key: str = "id") -> DataFrame:
    """key and summary: the first summary that a reply gives of its own page, if it isn't blank."""
    own = F.filter(listed(F.col("reply"), SUMMARIES), lambda x: (x["page_id"] == F.col(key)) & (F.trim(x["summary"]) != ""))
    return answered.select(key, F.trim(F.get(own, F.lit(0))["summary"]).alias("summary")).filter("summary IS NOT NULL")


def sections(answered: DataFrame, key: str = "id") -> DataFrame:
    """key, place, section_title, page_range and summary_text of all sections that have a summary."""
    own = F.filter(listed(F.col("reply"), SECTIONS), lambda x: F.trim(x["summary_text"]) != "")
    return answered.select(key, F.posexplode(own).alias("place", "x")).select(key, "place", "x.section_title", "x.page_range", "x.summary_text")


# --- deterministic stand-ins for models ------------------------------------------------------------------------------


def two_questions(rows: list[tuple[int, str]]) -> list[str]:
    """Asks after a text's first and last pair of words."""
    out = []
    for key, text in rows:
        words = text.split()
        asked = [f"O que se diz de {' '.join(pair)}?" for pair in (words[:2], words[-2:]) if len(pair) == 2]
        out.append(json.dumps([{"chunk_id": key, "questions": asked}], ensure_ascii=False))
    return out


def first_words(rows: list[tuple[int, str]]) -> list[str]:
    """Summarises by the first twenty words, in a fence."""
    return [f"```json\n{json.dumps([{'page_id': key, 'summary': ' '.join(text.split()[:20])}], ensure_ascii=False)}\n```" for key, text in rows]


def thirds(rows: list[tuple[int, str]]) -> list[str]:
    """Three sections, a third of a text's words each, summarised by their first five words."""
    out = []
    for _, text in rows:
        words = text.split()
        n = -(-len(words) // 3)
        parts = [words[k * n : (k + 1) * n] for k in range(3)]
        out.append(json.dumps([{"section_title": f"Parte {k + 1}", "page_range": str(k + 1), "summary_text": " ".join(p[:5])} for k, p in enumerate(parts)], ensure_ascii=False))
    return out
