"""Snapshots over several tables, tools on one of many tables, and what models write about pages and chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text
from folio.operators import answer, enrich, generate, records, search
from folio.plans.analytics import damaged_tables, ingestion_status
from folio.plans.indexed import _LEX
from folio.plans.records import _CHUNKS, document_chunks
from folio.plans.register import query
from folio.plans.retrieval import _HREF, _RELATED, _TARGETS, _page_entities, link_relations
from folio.sources import tables as t
from folio.sources.tables import with_tables as sql


@query(
    sql(
        "dc",
        "di",
        "ct",
        then=f""", {_CHUNKS} SELECT count(*) FILTER (processing_status = 'pending') AS pending, count(*) FILTER (processing_status = 'processing') AS processing,
      count(*) FILTER (processing_status = 'done') AS done, count(*) FILTER (processing_status = 'error') AS error,
      (SELECT count(*) FROM di WHERE status = 'open') AS open_inconsistencies, (SELECT count(*) FROM ch) AS total_chunks, (SELECT count(*) FROM ct) AS total_tables FROM dc""",
    )
)
def ingestion_snapshot(spark, d):
    """Documents by state, with open inconsistencies and how many chunks and tables there are."""
    chunks = document_chunks(spark, d).agg(F.count("*").alias("total_chunks"))
    tables = t.raw(spark, d, "orders").agg(F.count_distinct("o_custkey").alias("total_tables"))  # a table a customer
    return ingestion_status(spark, d).crossJoin(chunks).crossJoin(tables)  # one row each


@query(
    f"""WITH {_RELATED}, {_HREF}, {_TARGETS}, lr AS (SELECT DISTINCT source_id, target, target_id FROM lk LEFT JOIN tg USING (target) WHERE NOT regexp_matches(lower(target), '\\.(pdf|csv|xls|xlsx)$')
      AND (starts_with(target, '/') OR contains(regexp_extract(target, '^[a-z]+://([^/?#]*)', 1), 'example.com')) AND target_id IS DISTINCT FROM source_id)
    SELECT 'entity' AS strategy, relation_type, count(*) AS n FROM er GROUP BY ALL UNION ALL SELECT 'link', 'referencia', count(*) FROM lr HAVING count(*) > 0"""
)
def relation_counts_by_strategy(spark, d):
    """Relations by how they were found and of what type they are."""
    return enrich.counts_by_strategy(_page_entities(spark, d), link_relations(spark, d))


@query(
    sql(
        "ct",
        then=""", o AS (SELECT c_nationkey AS owner, (row_number() OVER (PARTITION BY c_nationkey ORDER BY id) - 1)::INTEGER AS table_index, rows FROM ct JOIN customer ON c_custkey = id),
    k AS (SELECT c_custkey AS id, c_nationkey AS owner, (c_custkey % 70 - 3)::INTEGER AS table_index FROM customer)
    SELECT id, CASE WHEN rows IS NOT NULL THEN (len(rows) - 1)::VARCHAR END AS result, CASE WHEN rows IS NULL THEN 'no table: ' || table_index END AS error FROM k LEFT JOIN o USING (owner, table_index)""",
    )
)
def indexed_tool_calls(spark, d):
    """Rows counted in the table that each call names by its place among its owner's tables; places beyond them are errors."""
    owners = t.raw(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("owner"))
    place = F.row_number().over(Window.partitionBy("owner").orderBy("id")) - 1
    numbered = t.customer_tables(spark, d).select("id").join(owners, "id").withColumn("table_index", place)
    tables = t.customer_tables(spark, d).join(numbered, "id").select("owner", "table_index", "headers", "rows")
    calls = owners.withColumn("table_index", (F.col("id") % 70 - 3).cast("int"))
    return answer.call_indexed(calls, tables, "count_rows", {})


# --- models ----------------------------------------------------------------------------------------------------------

_WORDS = r"list_filter(string_split_regex(coalesce({x}, ''), '\s+'), lambda w: w <> '')"


def _uncovered(items, spark, d, kind):
    return generate.pending(items, t.embeddings(spark, d).filter(F.col("source_type") == kind).select(F.col("source_id").alias("id")))


@query(
    sql(
        "em",
        then=f""", w AS (SELECT doc_id AS id, {_WORDS.format(x='text')} AS w FROM documents WHERE doc_id NOT IN (SELECT source_id FROM em WHERE source_type = 'question'))
    SELECT id, place, question FROM (SELECT id, unnest([0, 1])::INTEGER AS place, unnest(['O que se diz de ' || w[1] || ' ' || w[2] || '?', 'O que se diz de ' || w[-2] || ' ' || w[-1] || '?']) AS question FROM w WHERE len(w) > 1)""",
    )
)
def model_questions(spark, d):
    """Questions to the documents that have none yet, as the stand-in model asks them."""
    documents = t.raw(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return generate.questions(generate.replies(_uncovered(documents, spark, d, "question"), generate.two_questions))


@query(
    sql(
        "em",
        "pg",
        then=f", w AS (SELECT id, {_WORDS.format(x='main_content')} AS w FROM pg WHERE id NOT IN (SELECT source_id FROM em WHERE source_type = 'page_summary')) SELECT id, array_to_string(w[1:20], ' ') AS summary FROM w WHERE len(w) > 0",
    )
)
def model_summaries(spark, d):
    """Summaries of the pages that have none yet, as the stand-in model writes them."""
    pages = t.pages(spark, d).select("id", F.col("main_content").alias("text"))
    return generate.summaries(generate.replies(_uncovered(pages, spark, d, "page_summary"), generate.first_words))


@query(
    sql(
        "em",
        then=f""", w AS (SELECT doc_id AS id, {_WORDS.format(x='text')} AS w FROM documents WHERE doc_id NOT IN (SELECT source_id FROM em WHERE source_type = 'section')),
    k AS (SELECT id, w, (len(w) + 2) // 3 AS n, unnest([0, 1, 2])::INTEGER AS place FROM w)
    SELECT id, place, 'Parte ' || (place + 1) AS section_title, (place + 1)::VARCHAR AS page_range, array_to_string(list_slice(w[place * n + 1:least((place + 1) * n, len(w))], 1, 5), ' ') AS summary_text FROM k WHERE place * n < len(w)""",
    )
)
def model_sections(spark, d):
    """Summaries of the sections of documents that have none yet."""
    documents = t.raw(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    found = generate.sections(generate.replies(_uncovered(documents, spark, d, "section"), generate.thirds))
    return found.withColumn("place", (F.col("page_range").cast("int") - 1))


# --- what belongs together -------------------------------------------------------------------------------------------


@query(
    sql(
        "ct",
        then=f""", {_CHUNKS}, bad AS (SELECT id FROM ct WHERE id % 7 IN (1, 2))
    SELECT 'tables' AS part, id, count(*) AS n FROM ct WHERE id NOT IN (SELECT id FROM bad) GROUP BY id UNION ALL SELECT 'chunks', id, count(*) FROM ch WHERE id NOT IN (SELECT id FROM bad) GROUP BY id
    UNION ALL SELECT 'contents', doc_id, count(*) FROM documents WHERE doc_id NOT IN (SELECT id FROM bad) GROUP BY doc_id""",
    )
)
def corrupt_cascade(spark, d):
    """What stays of tables, chunks and contents once damaged tables go with all that belongs to their document."""
    joined = F.array_join("headers", " ")
    bad = damaged_tables(spark, d).filter((F.size("headers") <= 1) | joined.contains(";") | joined.contains("|||")).select("id")
    parts = {"tables": t.customer_tables(spark, d).select("id"), "chunks": document_chunks(spark, d).select("id"), "contents": t.raw(spark, d, "documents").select(F.col("doc_id").alias("id"))}
    kept = [df.groupBy("id").agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "id", "n") for name, df in records.cascade(parts, bad).items()]
    return reduce(DataFrame.unionByName, kept)


@query(f"WITH {_CHUNKS} SELECT id, count(*) AS n_chunks, sha256(string_agg(chunk_text, chr(10) || chr(10) ORDER BY chunk_index)) AS content_hash FROM ch GROUP BY id")
def chunk_contents(spark, d):
    """Documents put together from their chunks, a blank line between them."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_text")))
    joined = F.array_join(F.transform(ordered, lambda x: x["chunk_text"]), "\n\n")
    return document_chunks(spark, d).groupBy("id").agg(F.count("*").alias("n_chunks"), F.sha2(joined, 256).alias("content_hash"))


@query(
    sql(
        "ct",
        then="""SELECT session, string_agg(line, chr(10) ORDER BY part, pos) AS context FROM (
      SELECT conv_id AS session, 0 AS part, -row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS pos, coalesce(role, '') || ': ' || coalesce(text, '') AS line FROM conversations QUALIFY pos >= -10
      UNION ALL SELECT id, 1, 1, '[Resultado] : count_rows: ' || (len(rows) - 1) FROM ct WHERE id IN (SELECT conv_id FROM conversations)) GROUP BY session""",
    )
)
def dialogue_contexts(spark, d):
    """The context of every conversation: its last messages and what a tool gave on the table of its number."""
    messages = t.raw(spark, d, "conversations").withColumnRenamed("conv_id", "session")
    tables = t.customer_tables(spark, d).join(messages.select(F.col("session").alias("id")).distinct(), "id", "left_semi")
    results = answer.call_tool(tables, "count_rows", {}).select(F.col("id").alias("session"), F.lit("count_rows").alias("name"), "result")
    return answer.dialogue(messages, results)


_WIDE = {"trash": "trash the", "the of": "the of and"}


@query(
    sql(
        "pg",
        then=" UNION ALL ".join(
            f"""(WITH w AS (SELECT id, {_LEX.format(x='title')} AS l FROM pg), h AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS pos FROM w WHERE {' AND '.join(f"list_contains(l, '{q}')" for q in asked.split())} ORDER BY id LIMIT 10),
      v AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS pos FROM w WHERE {' OR '.join(f"list_contains(l, '{q}')" for q in wide.split())} ORDER BY id LIMIT 10),
      b AS (SELECT id, pos FROM h UNION ALL SELECT id, pos + (SELECT count(*) FROM h) FROM v),
      f AS (SELECT id, row_number() OVER (ORDER BY sum(1.0 / (61 + pos)) DESC, min(pos), id) - 1 AS pos FROM b GROUP BY id)
      SELECT '{asked}' AS asked, id, pos::INTEGER AS pos FROM h WHERE (SELECT count(*) FROM h) >= 3 UNION ALL SELECT '{asked}', id, pos::INTEGER FROM f WHERE (SELECT count(*) FROM h) < 3 AND pos < 10)"""
            for asked, wide in _WIDE.items()
        ),
    )
)
def widened_searches(spark, d):
    """Titles by a question that finds enough, and by one that finds too little and is asked again more widely."""
    titles = t.pages(spark, d, content=False, title=True).select("id", text.lexemes(F.col("title")).alias("l"))

    def found(words, every):
        held = [F.array_contains("l", w) for w in words.split()]
        rows = titles.filter(reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), held)).select("id")
        return rows.orderBy("id").limit(10).withColumn("pos", F.row_number().over(Window.orderBy("id")) - 1)  # ten rows

    out = [search.widened(found(asked, True), lambda wide=wide: (found(wide, False), None), 10).select(F.lit(asked).alias("asked"), "id", F.col("pos").cast("int").alias("pos")) for asked, wide in _WIDE.items()]
    return reduce(DataFrame.unionByName, out)
