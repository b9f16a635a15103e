"""Batches, replies, context, tools and joined search results."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.functions import text
from folio.operators import answer, enrich, search
from folio.plans.records import _CHUNKS, _VECTOR_CHUNKS, document_chunks, vector_chunks
from folio.plans.register import query
from folio.plans.retrieval import _PAGE_HITS, _SIM, page_hits, similar
from folio.sources import store
from folio.sources import tables as t
from folio.sources.tables import with_tables as sql


@query(
    f"""WITH RECURSIVE {_CHUNKS}, s AS MATERIALIZED (SELECT id, row_number() OVER (PARTITION BY id ORDER BY chunk_index) AS r, greatest(1, length(chunk_text) // 4)::BIGINT AS n FROM ch),
    w AS (SELECT id, r, n AS total, 1 AS held, 0 AS k FROM s WHERE r = 1 UNION ALL
      SELECT id, r, CASE WHEN ends THEN n ELSE total + n END, CASE WHEN ends THEN 1 ELSE held + 1 END, CASE WHEN ends THEN k + 1 ELSE k END
      FROM (SELECT s.id, s.r, s.n, w.total, w.held, w.k, w.held >= {answer.MOST_TEXTS} OR w.total + s.n > {answer.MOST_TOKENS} AS ends FROM w JOIN s ON s.id = w.id AND s.r = w.r + 1))
    SELECT id, count(*)::INTEGER AS n_chunks, (max(k) + 1)::INTEGER AS n_batches FROM w GROUP BY id"""
)
def token_batches(spark, d):
    """Chunks of each document in batches of at most 100 texts and 15,000 tokens, by estimate of four characters each."""
    sizes = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", F.greatest(F.lit(1), F.floor(F.length("chunk_text") / 4)).alias("n")))), lambda x: x["n"])
    grouped = document_chunks(spark, d).groupBy("id").agg(sizes.alias("sizes"))
    return grouped.select("id", F.size("sizes").alias("n_chunks"), (F.array_max(answer.batches(F.col("sizes"))) + 1).alias("n_batches"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 3 = 2 THEN NULL ELSE 'receita,ata' END AS tags FROM documents")
def parse_replies(spark, d):
    """Tags from replies in fences, bare, and from one that isn't JSON."""
    body = F.lit('[{"page_id": 1, "tags": ["receita", "outra", "ata"], "periodo_referencia": null}]')
    reply = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("doc_id") % 3 == 1, body).otherwise(F.lit("no tags here"))
    parsed = F.get(answer.parse_reply(reply), F.lit(0))
    return t.raw(spark, d, "documents").select(F.col("doc_id").alias("id"), F.array_join(enrich.valid_tags(parsed["tags"]), ",").alias("tags"))


@query("SELECT tag, count(*) AS n FROM (SELECT unnest([CASE WHEN contains(text, ' en ') THEN 'receita' END, CASE WHEN contains(text, ' de ') THEN 'despesa' END, CASE WHEN contains(text, ' la ') THEN 'contrato' END]) AS tag FROM documents) WHERE tag IS NOT NULL GROUP BY tag")
def model_tags(spark, d):
    """Tags that the stand-in model gives, of which only valid ones stay."""
    replies = answer.asked(t.raw(spark, d, "documents").withColumnRenamed("doc_id", "id"), "id", "text", answer.keyword_tags)
    tags = F.get(answer.parse_reply(F.col("reply")), F.lit(0))["tags"]
    return replies.select("id", F.explode(enrich.valid_tags(tags)).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query(
    sql(
        "em",
        "dc",
        "pg",
        then=f", {_CHUNKS}, {_VECTOR_CHUNKS} SELECT em.source_id AS id, chunk_index::INTEGER AS chunk_index, document_url, coalesce(pg.title, document_title) AS title, quality, round({_SIM}, 6) AS similarity FROM em JOIN vc ON vc.id = em.source_id JOIN dc ON dc.id = vc.id LEFT JOIN labels l ON l.doc_id = dc.id LEFT JOIN pg ON pg.id = dc.page_id WHERE source_type = 'chunk' ORDER BY {_SIM} DESC, em.source_id LIMIT 10",
    )
)
def semantic_chunks_joined(spark, d):
    """The nearest chunks with their document, its label and page: the vectors are cut to k before anything is joined."""
    owned = similar(spark, d, "chunk").join(vector_chunks(document_chunks(spark, d)), "id")
    best = search.top(owned, "similarity", 10).select("id", "chunk_index", "similarity")
    docs = t.documents(spark, d).select("id", "page_id", "document_url", "document_title")
    labels = t.raw(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality")
    pages = t.pages(spark, d, content=False, title=True).select(F.col("id").alias("page_id"), "title")
    joined = best.join(docs, "id").join(labels, "id", "left").join(pages, "page_id", "left")
    return joined.select("id", "chunk_index", "document_url", F.coalesce("title", "document_title").alias("title"), "quality", F.round("similarity", 6).alias("similarity"))


@query(sql("ct", then="SELECT id, CASE WHEN id % 2 = 0 THEN (len(rows) - 1)::VARCHAR END AS result, CASE WHEN id % 2 = 1 THEN 'no column: Cor' END AS error FROM ct"))
def tool_calls(spark, d):
    ct = t.customer_tables(spark, d)
    good = answer.call_tool(ct.filter("id % 2 = 0"), "count_rows", {})
    return good.union(answer.call_tool(ct.filter("id % 2 = 1"), "sum_column", {"column": "Cor"}))


@query(sql("pg", then="SELECT category, n, title FROM (SELECT category, title, row_number() OVER (PARTITION BY category ORDER BY depth, id)::INTEGER AS n FROM pg) WHERE n <= 4"))
def suggestions(spark, d):
    return answer.suggestions(t.pages(spark, d, content=False, title=True))


@query(
    sql(
        "pg",
        "em",
        "ct",
        then=f""", {_CHUNKS}, {_VECTOR_CHUNKS}, {_PAGE_HITS}, p AS (SELECT 0 AS turn, row_number() OVER (ORDER BY rank DESC, ph.id) - 1 AS pos, ph.id, '[Paginas] ' || title AS line FROM (SELECT * FROM ph ORDER BY rank DESC, id LIMIT 5) ph JOIN pg ON pg.id = ph.id),
    c AS (SELECT 1, pos, n.id, '[Trechos] ' || left(chunk_text, 300) FROM (SELECT source_id AS id, row_number() OVER (ORDER BY {_SIM} DESC, source_id) - 1 AS pos FROM em WHERE source_type = 'chunk' ORDER BY pos LIMIT 3) n JOIN vc ON vc.id = n.id JOIN ch ON ch.id = vc.id AND ch.chunk_index = vc.chunk_index WHERE n.id <> 0),
    m AS (SELECT 2, 0, id, '[Tabelas] ' || '| ' || array_to_string(headers, ' | ') || ' |' || chr(10) || '|' || repeat('---|', len(headers)) || chr(10) || array_to_string(list_transform(rows[1:30], lambda r: '| ' || array_to_string(r, ' | ') || ' |'), chr(10)) FROM ct ORDER BY id LIMIT 1)
    SELECT string_agg(line, chr(10) ORDER BY turn, pos, id) AS context FROM (SELECT * FROM p UNION ALL SELECT * FROM c UNION ALL SELECT * FROM m)""",
    )
)
def prompt_context(spark, d):
    """The context of one question: five pages by words, three chunks by meaning, and a table."""
    pages = search.ranked(page_hits(spark, d, 5), "rank", "id").select("id", "pos", F.col("title").alias("text"))
    near = search.ranked(search.top(similar(spark, d, "chunk"), "similarity", 3), "similarity", "id").select("id", "pos")
    texts = document_chunks(spark, d).select("id", "chunk_index", F.left("chunk_text", F.lit(300)).alias("text"))
    chunks = near.join(vector_chunks(texts), "id").join(texts, ["id", "chunk_index"]).drop("chunk_index").withColumn("document", F.concat(F.lit("d"), "id"))
    tables = t.customer_tables(spark, d).orderBy("id").limit(1).select("id", F.lit(0).alias("pos"), answer.markdown(F.col("headers"), F.col("rows")).alias("text"), F.lit("d0").alias("document"))
    return answer.context(pages, chunks, tables)


@query(sql("dc", then="SELECT id, CASE WHEN lower(full_text) LIKE '%trash%' THEN 'words' WHEN contains(document_url, '2024') OR contains(document_url, '2025') THEN 'year' ELSE 'none' END AS found_by FROM dc"))
def url_year_match(spark, d):
    """Documents found by a word, else by a year of the question in their URL."""
    by_year = text.names_year(F.col("document_url"), F.lit("Trash de 2024 e 2025?"))
    return t.documents(spark, d).select("id", F.when(F.lower("full_text").contains("trash"), "words").when(by_year, "year").otherwise("none").alias("found_by"))


@query(sql("ct", then="SELECT id, caption || ' ' || array_to_string(headers, ' ') || ' ' || array_to_string(flatten(rows[1:5]), ' ') AS content FROM ct"))
def table_embed_text(spark, d):
    return t.customer_tables(spark, d).select("id", answer.embed_text(F.col("caption"), F.col("headers"), F.col("rows")).alias("content"))


@query("SELECT doc_id AS id, CASE WHEN length(text) > 500 THEN CASE WHEN contains(substr(text, 1, 500), ' ') THEN regexp_extract(substr(text, 1, 500), '(?s)^(.*) ', 1) ELSE substr(text, 1, 500) END || '...' ELSE text END AS summary FROM documents")
def content_summaries(spark, d):
    return t.raw(spark, d, "documents").select(F.col("doc_id").alias("id"), text.summary(F.col("text")).alias("summary"))


@query(
    """WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS source, 'n' || n_nationkey AS target FROM nation UNION SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION SELECT 's' || s_suppkey, 'n' || (s_suppkey % 25) FROM supplier),
    w AS (SELECT 'r0' AS url, 0 AS depth UNION SELECT target, depth + 1 FROM w JOIN e ON source = url WHERE depth < 7) SELECT url, min(depth) AS depth FROM w GROUP BY url"""
)
def crawl_depths(spark, d):
    """How far pages are from the start, over links with cycles."""
    nation, supplier = t.raw(spark, d, "nation"), t.raw(spark, d, "supplier")
    name = lambda letter, column: F.concat(F.lit(letter), column.cast("string"))
    edges = (
        nation.select(name("r", F.col("n_regionkey")).alias("source"), name("n", F.col("n_nationkey")).alias("target"))
        .union(supplier.select(name("n", F.col("s_nationkey")), name("s", F.col("s_suppkey"))))
        .union(supplier.select(name("s", F.col("s_suppkey")), name("n", F.col("s_suppkey") % 25)))
        .distinct()
    )
    return store.crawl_order(edges, spark.createDataFrame([("r0",)], "url string"))
