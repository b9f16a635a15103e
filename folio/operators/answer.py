"""Putting answers together: batches for models, their replies, context for a prompt, tools by name.

Models are functions that a caller passes in: `ask` maps a list of texts to a list of replies. Those here are
deterministic stand-ins, so that every plan runs without a network.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import cells
from folio.functions.core import bind, no_strings

# The limits of one call of an embedding model.
MOST_TEXTS, MOST_TOKENS = 100, 15_000
REPLY = "array<struct<page_id:bigint,tags:array<string>,periodo_referencia:string>>"


def batches(sizes: Column, most_texts: int = MOST_TEXTS, most_tokens: int = MOST_TOKENS) -> Column:
    """The batch of each size in an array, in order: a batch ends before the text that would pass a limit."""

    def step(acc: Column, size: Column) -> Column:
        full = (acc["n"] >= most_texts) | ((acc["n"] > 0) & (acc["sum"] + size > most_tokens))
        number = F.when(full, acc["k"] + 1).otherwise(acc["k"])
        return F.struct(
            number.alias("k"),
            F.when(full, F.lit(1)).otherwise(acc["n"] + 1).alias("n"),
            F.when(full, size).otherwise(acc["sum"] + size).cast("long").alias("sum"),
            F.concat(acc["out"], F.array(number)).alias("out"),
        )

    start = F.struct(F.lit(0).alias("k"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("sum"), F.transform(no_strings(), lambda x: F.lit(0)).alias("out"))
    return F.aggregate(sizes, start, step, lambda acc: acc["out"])


_LOOSE = r'"page_id"\s*:\s*([0-9]+)\s*,\s*"tags"\s*:\s*(\[[^\]]*\])'


def parse_reply(reply: Column) -> Column:
    """A model's JSON list, with or without code fences around it; else the pages and tags that a broken one holds; null if none."""
    bare = F.trim(F.regexp_replace(reply, r"(?m)^```[a-z]*\s*$", ""))
    whole = F.from_json(F.regexp_extract(bare, r"(?s)(\[.*\])", 1), REPLY, {"mode": "PERMISSIVE"})
    ids, tags = (F.regexp_extract_all(reply, F.lit(_LOOSE), F.lit(g)) for g in (1, 2))
    loose = F.zip_with(ids, tags, lambda i, t: F.struct(i.try_cast("bigint").alias("page_id"), F.from_json(t, "array<string>").alias("tags"), F.lit(None).cast("string").alias("periodo_referencia")))
    loose = F.filter(loose, lambda x: x["page_id"].isNotNull() & x["tags"].isNotNull())
    sound = F.exists(whole, lambda x: x["page_id"].isNotNull() | x["tags"].isNotNull())
    return F.when(sound, whole).otherwise(F.when(F.size(loose) > 0, loose))


def asked(df: DataFrame, key: str, text: str, ask: Callable[[list[str]], list[str]], at_once: int = 20) -> DataFrame:
    """key and the model's reply to each text, asked in batches inside the tasks."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            replies = []
            for at in range(0, len(part), at_once):
                replies += ask(part["text"].iloc[at : at + at_once].tolist())
            yield pd.DataFrame({key: part["key"], "reply": replies})

    slim = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return slim.mapInPandas(run, f"`{key}` {slim.schema['key'].dataType.simpleString()}, reply string")


def embedded(df: DataFrame, key: str, text: str, embed: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """key and embedding of each text: an embedder gets batches of at most MOST_TEXTS texts and about MOST_TOKENS tokens of four letters."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            vectors, held, size = [], [], 0
            for x in part["text"]:
                n = max(1, len(x or "") // 4)
                if held and (len(held) >= MOST_TEXTS or size + n > MOST_TOKENS):
                    vectors += embed(held)
                    held, size = [], 0
                held.append(x or "")
                size += n
            vectors += embed(held) if held else []
            yield pd.DataFrame({key: part["key"], "embedding": vectors})

    slim = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return slim.mapInPandas(run, f"`{key}` {slim.schema['key'].dataType.simpleString()}, embedding array<double>")


def letter_vectors(texts: list[str]) -> list[list[float]]:
    """Stand-in for an embedder: shares of eight letters."""
    return [[x.count(c) / max(1, len(x)) for c in "aeinorst"] for x in texts]


def keyword_tags(texts: list[str]) -> list[str]:
    """Stand-in for a model that tags pages: names a tag for each keyword it finds, in the model's form of reply."""
    words = {"en": "receita", "de": "despesa", "la": "contrato"}
    replies = []
    for text in texts:
        found = [tag for word, tag in words.items() if f" {word} " in (text or "")] or ["unknown"]
        tags = ", ".join(f'"{x}"' for x in found)
        replies.append(f'```json\n[{{"page_id": 0, "tags": [{tags}], "periodo_referencia": null}}]\n```')
    return replies


def context(pages: DataFrame, chunks: DataFrame, tables: DataFrame, k: int = 5) -> DataFrame:
    """One row of text for a prompt: pages, chunks of documents that have no table, tables as Markdown.

    Each input is a short result list: id, pos and text (tables and chunks also document).
    """
    own = chunks.join(tables.select("document"), "document", "left_anti")
    parts = [("Paginas", pages), ("Trechos", own), ("Tabelas", tables)]
    rows = None
    for turn, (name, df) in enumerate(parts):
        part = df.filter(F.col("pos") < k).select(F.lit(turn).alias("turn"), "pos", "id", F.concat(F.lit(f"[{name}] "), "text").alias("line"))
        rows = part if rows is None else rows.union(part)
    ordered = F.array_sort(F.collect_list(F.struct("turn", "pos", "id", "line")))
    return rows.agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("context"))


def dialogue(messages: DataFrame, results: DataFrame, most: int = 10) -> DataFrame:
    """session and context: its last `most` messages (turn, role, text), oldest first, then what tools gave (name, result).

    A session holds `most` messages and its tools' results at most; nulls are empty texts.
    """
    last = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("turn"), F.desc("role"), F.desc("text")))
    line = F.concat_ws(": ", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    said = messages.withColumn("_n", last).filter(F.col("_n") <= most).select("session", F.lit(0).alias("part"), (-F.col("_n")).alias("pos"), line.alias("line"))
    given = results.select("session", F.lit(1).alias("part"), F.row_number().over(Window.partitionBy("session").orderBy("name", "result")).alias("pos"), F.concat_ws(": ", F.lit("[Resultado] "), "name", F.coalesce("result", F.lit(""))).alias("line"))
    ordered = F.array_sort(F.collect_list(F.struct("part", "pos", "line")))
    return said.unionByName(given).groupBy("session").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("context"))


def markdown(headers: Column, rows: Column, most: int = 30) -> Column:
    """A table as Markdown; its form takes at most 30 rows."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.transform(headers, lambda h: F.lit("---")), "|"), F.lit("|"))
    return F.concat_ws("\n", line(headers), rule, F.array_join(F.transform(F.slice(rows, 1, most), line), "\n"))


def _at(headers: Column, args: dict, name: str = "column") -> Column:
    return cells.column_index(headers, args[name])


#: Tools by name: (headers, rows, arguments) to the result as text.
TOOLS: dict[str, Callable[[Column, Column, dict], Column]] = {
    "count_rows": lambda h, r, a: cells.count_rows(r, _at(h, a) if "column" in a else None, a.get("value")).cast("string"),
    "sum_column": lambda h, r, a: cells.brl(cells.sum_column(r, _at(h, a)).cast("decimal(38,2)")),
    "filter_rows": lambda h, r, a: F.to_json(cells.filter_rows(r, _at(h, a), a.get("op", "eq"), a["value"])),
    "sort_rows": lambda h, r, a: F.to_json(cells.sort_rows(r, _at(h, a), a.get("descending", False))),
    "extract_value": lambda h, r, a: cells.extract_value(r, _at(h, a), a["value"], _at(h, a, "target")),
}


def call_tool(tables: DataFrame, name: str, args: dict) -> DataFrame:
    """id, result and error of a tool on every table: unknown tools and missing columns are errors, not failures."""
    headers, rows = F.col("headers"), F.col("rows")
    if name not in TOOLS:
        return tables.select("id", F.lit(None).cast("string").alias("result"), F.lit(f"unknown tool: {name}").alias("error"))
    missing = F.lit(None).cast("string")
    for key in ("column", "target"):
        if key in args:
            missing = F.when(cells.column_index(headers, args[key]).isNull(), F.lit(f"no column: {args[key]}")).otherwise(missing)
    return tables.select("id", bind(missing, lambda m: F.struct(F.when(m.isNull(), TOOLS[name](headers, rows, args)).alias("result"), m.alias("error"))).alias("x")).select("id", "x.result", "x.error")


def call_indexed(calls: DataFrame, tables: DataFrame, name: str, args: dict) -> DataFrame:
    """id, result and error of a tool on the table that each call (id, owner, table_index) names among its owner's tables.

    tables has owner, table_index (from 0), headers and rows; an index beyond the owner's tables, below 0 or null is an error.
    """
    own = calls.join(tables.select("owner", "table_index", "headers", "rows"), ["owner", "table_index"], "left")
    done = call_tool(own.filter("headers IS NOT NULL"), name, args)
    missing = own.filter("headers IS NULL").select("id", F.lit(None).cast("string").alias("result"), F.concat(F.lit("no table: "), F.coalesce(F.col("table_index").cast("string"), F.lit("null"))).alias("error"))
    return done.unionByName(missing)


def suggestions(pages: DataFrame, k: int = 4) -> DataFrame:
    """Up to k page titles to go on with, of each category."""
    n = F.row_number().over(Window.partitionBy("category").orderBy("depth", "id"))
    return pages.withColumn("n", n).filter(F.col("n") <= k).select("category", "n", "title")


MOST_ROUNDS = 5


def analyse(tables: DataFrame, plan: Callable[[list[tuple]], tuple[str, dict] | list[int] | None], rounds: int = MOST_ROUNDS) -> tuple[list[tuple], list[int]]:
    """A planner's loop over tools: it sees the results so far and names a tool and arguments, or the tables to show.

    Tables are accepted only after a tool was called; None ends the loop. tables is the short list of an answer.
    """
    seen: list[tuple] = []
    for _ in range(rounds):
        step = plan(seen)
        if step is None:
            break
        if isinstance(step, list):
            if seen:
                return seen, step
            continue
        name, args = step
        seen.append((name, args, [tuple(r) for r in call_tool(tables, name, args).collect()]))
    return seen, []


def embed_text(caption: Column, headers: Column, rows: Column) -> Column:
    """What a table is embedded by: caption, headers and first five rows."""
    return F.concat_ws(" ", caption, F.array_join(headers, " "), F.array_join(F.flatten(F.slice(rows, 1, 5)), " "))


def with_total(headers: Column, rows: Column) -> Column:
    """A table's rows for an answer: those that are no totals, and the total row if there is one to compute."""
    total = cells.total_row(headers, rows)
    return bind(F.struct(cells.body_rows(rows).alias("body"), total.alias("total")), lambda x: F.when(x["total"].isNotNull(), F.concat(x["body"], F.array(x["total"]))).otherwise(x["body"]))


def assembled(tables: DataFrame, metrics: DataFrame, citations: DataFrame, suggested: DataFrame) -> DataFrame:
    """One row with all parts of an answer, each a short list: tables (id, caption, headers, rows), metrics (label, value),
    citations (url, score) and up to four suggestions (title), in order."""
    listed = lambda df, order: df.agg(F.array_sort(F.collect_list(F.struct(*order))).alias("x"))
    shown = listed(tables.withColumn("rows", with_total(F.col("headers"), F.col("rows"))), ["id", "caption", "headers", "rows"]).withColumnRenamed("x", "tables")
    parts = [listed(metrics, ["label", "value"]).withColumnRenamed("x", "metrics"), listed(citations.withColumn("_far", -F.col("score")), ["_far", "url"]).select(F.transform("x", lambda c: F.struct(c["url"].alias("url"), (-c["_far"]).alias("score"))).alias("citations"))]
    parts.append(listed(suggested.limit(4), ["title"]).select(F.transform("x", lambda c: c["title"]).alias("suggestions")))
    for part in parts:
        shown = shown.crossJoin(part)  # one row each
    return shown


# A question that users ask of each category, and those that stand for an unknown portal.
FREQUENT = {
    "Gestão de Pessoas": "Remuneração dos servidores",
    "Licitações, Contratos e Instrumentos de Cooperação": "Licitações em andamento",
    "Licitações e Contratos": "Licitações em andamento",
    "Orçamento e Finanças": "Execução orçamentária",
    "Prestação de Contas": "Relatório de gestão",
    "LGPD": "LGPD e proteção de dados",
    "Tecnologia da Informação": "Contratos de TI",
    "Auditoria": "Plano de auditoria interna",
    "Dados Abertos": "Dados abertos disponíveis",
    "Acesso à Informação": "Serviço de Informação ao Cidadão",
    "Responsabilidade Socioambiental": "Ações socioambientais",
    "Gestão e Governança": "Estrutura organizacional",
}
FALLBACK = ["Licitações em andamento", "Remuneração dos servidores", "Relatório de gestão", "LGPD e proteção de dados", "Contratos de TI", "Prestação de contas"]


def frequent_questions(categories: DataFrame, k: int = 6) -> DataFrame:
    """place, question: of categories (category, n), largest first, the first k different questions; FALLBACK if none is known."""
    spark = categories.sparkSession
    table = spark.createDataFrame(list(FREQUENT.items()), "category string, question string")
    known = categories.join(F.broadcast(table), "category").groupBy("question").agg(F.min(F.struct((-F.col("n")).alias("n"), "category")).alias("first"))  # table: a dozen rows
    rows = known.withColumn("place", F.row_number().over(Window.orderBy("first"))).filter(F.col("place") <= k).select("place", "question")
    spare = spark.createDataFrame(list(enumerate(FALLBACK, 1)), "place int, question string")
    return rows.union(spare.join(rows.limit(1).select(F.lit(True).alias("any")), F.lit(True), "left_anti"))
