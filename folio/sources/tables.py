"""The engine's tables as views over a folder of Parquet files.

The folder holds the raw tables (documents, pages, labels, embeddings, events, conversations and a sales schema). Each
function gives one table of the document model; TABLES_SQL has the same definitions as SQL, for the catalogue's oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PATH_PART = r"^https?://[^/]+/([^/?#]+)"
TITLE = r"<title>([^<]*)</title>"


def raw(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pages(spark: SparkSession, folder: str, content: bool = True, title: bool | None = None) -> DataFrame:
    """id, url, category, subcategory, content_type, depth; with title (as with content) the title, with content also main_content.

    Contents are joined, so a plan that wants titles alone should say content=False, title=True.
    """
    p = raw(spark, folder, "pages")
    kind = F.when(F.col("page_id") % 10 == 0, "pdf").when(F.col("page_id") % 10 == 1, "csv").otherwise("page")
    out = p.select(
        F.col("page_id").alias("id"),
        "url",
        F.regexp_extract("url", PATH_PART, 1).alias("category"),
        F.concat(F.lit("s"), F.col("page_id") % 5).alias("subcategory"),
        kind.alias("content_type"),
        (F.col("page_id") % 4).alias("depth"),
        *([F.regexp_extract("html", TITLE, 1).alias("title")] if (content if title is None else title) else []),
    )
    if not content:
        return out
    texts = raw(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("main_content"))
    return out.join(texts, "id", "left")


def document_url() -> Column:
    """A document's URL, of the raw table's columns."""
    return F.concat("source", F.lit("/"), (2019 + F.col("doc_id") % 7).cast("string"), F.lit("/"), "doc_id")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """id, page_id, document_url, document_title, document_type, full_text, category, processing_status, processed_at."""
    d, labels = raw(spark, folder, "documents"), raw(spark, folder, "labels")
    kind = F.when(F.col("doc_id") % 3 == 0, "pdf").when(F.col("doc_id") % 3 == 1, "csv").otherwise("xlsx")
    status = F.when(F.col("quality") == 1, "done").when(F.col("quality") == 0, "error").when(F.col("doc_id") % 4 == 0, "processing").otherwise("pending")
    return d.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        (F.col("doc_id") % 97).alias("page_id"),
        document_url().alias("document_url"),
        F.concat(F.lit("doc "), "doc_id").alias("document_title"),
        kind.alias("document_type"),
        F.col("text").alias("full_text"),
        F.col("lang").alias("category"),
        status.alias("processing_status"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(mins=(F.col("doc_id") % 1000).cast("int"))).alias("processed_at"),
    )


def query_logs(spark: SparkSession, folder: str) -> DataFrame:
    e = raw(spark, folder, "events")
    feedback = F.when(F.col("event_type") == "purchase", "positive").when(F.col("event_type") == "error", "negative")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), F.col("ts").alias("created_at"), F.col("event_type").alias("intent_type"), F.col("value").alias("response_time_ms"), feedback.alias("feedback"))


def inconsistencies(spark: SparkSession, folder: str) -> DataFrame:
    """Audit records: id, resource_url, resource_type, inconsistency_type, severity, status, detected_at, last_checked_at, retry_count."""
    e = raw(spark, folder, "events").filter(F.col("event_type").isin("error", "click"))
    severity = F.when(F.col("value") > 15, "critical").when(F.col("value") > 8, "warning").otherwise("info")
    status = F.when(F.col("event_id") % 3 == 0, "open").when(F.col("event_id") % 3 == 1, "resolved").otherwise("acknowledged")
    return e.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("u/"), "user_id").alias("resource_url"),
        F.when(F.col("event_type") == "error", "page").otherwise("link").alias("resource_type"),
        F.concat(F.lit("k"), F.get_json_object("props", "$.k").cast("int") % 7).alias("inconsistency_type"),
        severity.alias("severity"),
        status.alias("status"),
        F.col("ts").alias("detected_at"),
        F.expr("ts + INTERVAL 1 HOUR").alias("last_checked_at"),
        (F.col("event_id") % 2).cast("int").alias("retry_count"),
    )


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """source_id, source_type (those of EMBEDDED by turns), category and embedding."""
    kinds = F.array(*map(F.lit, EMBEDDED))
    e = raw(spark, folder, "embeddings")
    return e.select(F.col("vec_id").alias("source_id"), F.get(kinds, (F.col("vec_id") % len(EMBEDDED)).cast("int")).alias("source_type"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("category"), "embedding")


EMBEDDED = ("chunk", "page", "page_chunk", "question", "section", "page_summary")


def customer_tables(spark: SparkSession, folder: str) -> DataFrame:
    """A table in a cell for each customer with orders: id, caption, headers, rows (strings, by order key), with a TOTAL row."""
    orders = raw(spark, folder, "orders")
    money = brl(F.col("o_totalprice").cast("decimal(18,2)"))
    row = F.array(F.col("o_orderkey").cast("string"), "o_orderstatus", F.concat(F.lit("R$ "), money), "o_orderpriority")
    grouped = orders.groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), row.alias("r")))).alias("x"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("t"))
    total = F.array(F.lit("TOTAL"), F.lit(""), F.concat(F.lit("R$ "), brl(F.col("t"))), F.lit(""))
    return grouped.select(
        "id",
        F.concat(F.lit("Pedidos do cliente "), "id").alias("caption"),
        F.array(F.lit("Numero"), F.lit("Status"), F.lit("Valor"), F.lit("Prioridade")).alias("headers"),
        F.concat(F.transform("x", lambda s: s["r"]), F.array(total)).alias("rows"),
    )


def brl(amount: Column) -> Column:
    """A decimal with two places as 1.234,56."""
    return F.translate(F.format_number(amount, 2), ",.", ".,")


#: The same tables in SQL, as named subqueries.
_BRL = "translate(format('{{:,.2f}}', {x}), ',.', '.,')"
TABLES_SQL = {
    "pg": rf"""pg AS (SELECT page_id AS id, url, regexp_extract(url, '{PATH_PART}', 1) AS category, 's' || (page_id % 5) AS subcategory,
      CASE WHEN page_id % 10 = 0 THEN 'pdf' WHEN page_id % 10 = 1 THEN 'csv' ELSE 'page' END AS content_type, page_id % 4 AS depth,
      regexp_extract(html, '{TITLE}', 1) AS title, d.text AS main_content FROM pages LEFT JOIN documents d ON d.doc_id = page_id)""",
    "dc": """dc AS (SELECT d.doc_id AS id, d.doc_id % 97 AS page_id, source || '/' || (2019 + d.doc_id % 7) || '/' || d.doc_id AS document_url, 'doc ' || d.doc_id AS document_title,
      CASE WHEN d.doc_id % 3 = 0 THEN 'pdf' WHEN d.doc_id % 3 = 1 THEN 'csv' ELSE 'xlsx' END AS document_type, text AS full_text, lang AS category,
      CASE WHEN quality = 1 THEN 'done' WHEN quality = 0 THEN 'error' WHEN d.doc_id % 4 = 0 THEN 'processing' ELSE 'pending' END AS processing_status,
      TIMESTAMP '2024-01-01' + to_minutes((d.doc_id % 1000)::INTEGER) AS processed_at
      FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)""",
    "ql": """ql AS (SELECT event_id AS id, user_id AS session_id, ts AS created_at, event_type AS intent_type, value AS response_time_ms,
      CASE WHEN event_type = 'purchase' THEN 'positive' WHEN event_type = 'error' THEN 'negative' END AS feedback FROM events)""",
    "di": """di AS (SELECT event_id AS id, 'u/' || user_id AS resource_url, CASE WHEN event_type = 'error' THEN 'page' ELSE 'link' END AS resource_type,
      'k' || (json_extract_string(props, '$.k')::INTEGER % 7) AS inconsistency_type,
      CASE WHEN value > 15 THEN 'critical' WHEN value > 8 THEN 'warning' ELSE 'info' END AS severity,
      CASE WHEN event_id % 3 = 0 THEN 'open' WHEN event_id % 3 = 1 THEN 'resolved' ELSE 'acknowledged' END AS status,
      ts AS detected_at, ts + INTERVAL 1 HOUR AS last_checked_at, (event_id % 2)::INTEGER AS retry_count
      FROM events WHERE event_type IN ('error', 'click'))""",
    "em": f"""em AS (SELECT vec_id AS source_id, {list(EMBEDDED)!r}[(vec_id % {len(EMBEDDED)} + 1)::INTEGER] AS source_type, 'c' || label AS category, embedding FROM embeddings)""",
    "ct": f"""ct AS (SELECT id, 'Pedidos do cliente ' || id AS caption, ['Numero', 'Status', 'Valor', 'Prioridade'] AS headers,
      list_append(r, ['TOTAL', '', 'R$ ' || {_BRL.format(x='t')}, '']) AS rows FROM (
      SELECT o_custkey AS id, list([o_orderkey::VARCHAR, o_orderstatus, 'R$ ' || {_BRL.format(x='o_totalprice::DECIMAL(18,2)')}, o_orderpriority] ORDER BY o_orderkey) AS r,
      sum(o_totalprice::DECIMAL(18,2)) AS t FROM orders GROUP BY o_custkey))""",
}


def with_tables(*names: str, then: str) -> str:
    """A statement that starts with the named tables."""
    return "WITH " + ",\n".join(TABLES_SQL[n] for n in names) + "\n" + then
