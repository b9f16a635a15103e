"""Counts, statistics and reports over logs, pages, documents and audit records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folio.functions import cells
from folio.operators import records
from folio.plans.register import query
from folio.sources import tables as t
from folio.sources.tables import with_tables as sql

#: The moment that time windows end at.
AS_OF = "2024-01-31 00:00:00"


@query(sql("ql", then="SELECT created_at::DATE AS day, count(*) AS n, round(avg(response_time_ms), 6) AS avg_ms FROM ql GROUP BY 1"))
def daily_query_stats(spark, d):
    logs = t.query_logs(spark, d)
    return logs.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"), F.round(F.avg("response_time_ms"), 6).alias("avg_ms")).orderBy(F.desc("day"))


@query(
    sql(
        "ql",
        then="""SELECT n AS days, count(id) AS total, round(coalesce(avg(response_time_ms), 0), 6) AS avg_ms, count(*) FILTER (feedback = 'positive') AS positive,
      count(*) FILTER (feedback = 'negative') AS negative FROM (VALUES (7), (30)) w(n) LEFT JOIN ql ON created_at >= TIMESTAMP '2024-01-31' - to_days(n) GROUP BY n""",
    )
)
def query_metrics(spark, d):
    def window(days):
        logs = t.query_logs(spark, d).filter(F.col("created_at") >= F.lit(AS_OF).cast("timestamp") - F.make_interval(days=F.lit(days)))
        return logs.agg(
            F.lit(days).alias("days"),
            F.count("*").alias("total"),
            F.round(F.coalesce(F.avg("response_time_ms"), F.lit(0.0)), 6).alias("avg_ms"),
            F.count_if(F.col("feedback") == "positive").alias("positive"),
            F.count_if(F.col("feedback") == "negative").alias("negative"),
        )

    return window(7).union(window(30))


@query(sql("ql", then="SELECT intent_type, CASE WHEN count(feedback) > 0 THEN round(count(*) FILTER (feedback = 'positive') / count(feedback), 6) ELSE 0.0 END AS rate FROM ql GROUP BY 1"))
def satisfaction_rate(spark, d):
    known = F.count("feedback")
    return t.query_logs(spark, d).groupBy("intent_type").agg(F.when(known > 0, F.round(F.count_if(F.col("feedback") == "positive") / known, 6)).otherwise(F.lit(0.0)).alias("rate"))


@query(sql("pg", then="SELECT category, count(*) AS n FROM pg GROUP BY 1"))
def category_counts(spark, d):
    return t.pages(spark, d, content=False).groupBy("category").agg(F.count("*").alias("n")).orderBy("category")


@query(
    sql(
        "pg",
        "dc",
        then="""SELECT (SELECT count(*) FROM pg) AS n_pages, (SELECT count(*) FROM dc) AS n_documents, (SELECT count(*) FROM dc WHERE processing_status = 'done') AS n_done,
      (SELECT count(DISTINCT category) FROM pg) AS n_categories, (SELECT count(*) FROM embeddings) AS n_embeddings, (SELECT count(DISTINCT conv_id) FROM conversations) AS n_sessions""",
    )
)
def corpus_stats(spark, d):
    docs = t.documents(spark, d).agg(F.count("*").alias("n_documents"), F.count_if(F.col("processing_status") == "done").alias("n_done"))
    pages = t.pages(spark, d, content=False).agg(F.count("*").alias("n_pages"), F.countDistinct("category").alias("n_categories"))
    vectors = t.raw(spark, d, "embeddings").agg(F.count("*").alias("n_embeddings"))
    sessions = t.raw(spark, d, "conversations").agg(F.countDistinct("conv_id").alias("n_sessions"))
    return pages.crossJoin(docs).crossJoin(vectors).crossJoin(sessions)  # one row each


@query(
    sql(
        "pg",
        "dc",
        then="""SELECT pg.category, subcategory, count(DISTINCT pg.id) AS n_pages, count(DISTINCT document_url) AS n_documents,
      array_to_string(list_sort(list(DISTINCT document_type) FILTER (document_type IS NOT NULL)), ',') AS document_types
      FROM pg LEFT JOIN dc ON dc.page_id = pg.id GROUP BY ALL""",
    )
)
def category_map(spark, d):
    docs = t.documents(spark, d).select("page_id", "document_url", "document_type")
    joined = t.pages(spark, d, content=False).join(docs, F.col("id") == F.col("page_id"), "left")
    kinds = F.array_join(F.sort_array(F.collect_set("document_type")), ",")
    return joined.groupBy("category", "subcategory").agg(F.countDistinct("id").alias("n_pages"), F.countDistinct("document_url").alias("n_documents"), F.when(F.count("document_type") > 0, kinds).alias("document_types"))


@query(sql("pg", then="SELECT *, sum(n) OVER (PARTITION BY category)::BIGINT AS category_total FROM (SELECT category, subcategory, content_type, count(*) AS n FROM pg GROUP BY ALL)"))
def category_tree(spark, d):
    leaves = t.pages(spark, d, content=False).groupBy("category", "subcategory", "content_type").agg(F.count("*").alias("n"))
    return leaves.withColumn("category_total", F.sum("n").over(Window.partitionBy("category")))


@query(
    sql(
        "pg",
        then="""SELECT count(*) AS n, count(*) FILTER (content_type = 'page') AS n_page, count(*) FILTER (content_type = 'pdf') AS n_pdf,
      count(*) FILTER (content_type = 'csv') AS n_csv, count(DISTINCT category) AS n_categories, max(depth) AS deepest FROM pg""",
    )
)
def type_counts(spark, d):
    kind = lambda k: F.count_if(F.col("content_type") == k).alias(f"n_{k}")
    return t.pages(spark, d, content=False).agg(F.count("*").alias("n"), kind("page"), kind("pdf"), kind("csv"), F.countDistinct("category").alias("n_categories"), F.max("depth").alias("deepest"))


@query(sql("dc", "di", then="SELECT 'document' AS kind, processing_status AS status, count(*) AS n FROM dc GROUP BY 2 UNION ALL SELECT 'inconsistency', status, count(*) FROM di GROUP BY 2"))
def status_counts(spark, d):
    docs = t.documents(spark, d).groupBy(F.lit("document").alias("kind"), F.col("processing_status").alias("status")).agg(F.count("*").alias("n"))
    return docs.union(t.inconsistencies(spark, d).groupBy(F.lit("inconsistency"), "status").agg(F.count("*")))


@query(sql("di", then="SELECT inconsistency_type, count(*) AS n FROM di WHERE status = 'open' GROUP BY 1"))
def open_by_type(spark, d):
    return t.inconsistencies(spark, d).filter("status = 'open'").groupBy("inconsistency_type").agg(F.count("*").alias("n"))


@query(
    sql(
        "di",
        then="""SELECT 'status' AS dimension, status AS value, count(*) AS n, min(detected_at) FILTER (status = 'open') AS oldest_open, max(last_checked_at) AS last_check FROM di GROUP BY 2
      UNION ALL SELECT 'severity', severity, count(*), min(detected_at) FILTER (status = 'open'), max(last_checked_at) FROM di GROUP BY 2
      UNION ALL SELECT 'resource_type', resource_type, count(*), min(detected_at) FILTER (status = 'open'), max(last_checked_at) FROM di GROUP BY 2
      UNION ALL SELECT 'inconsistency_type', inconsistency_type, count(*), min(detected_at) FILTER (status = 'open'), max(last_checked_at) FROM di GROUP BY 2""",
    )
)
def inconsistency_summary(spark, d):
    return records.summary_by(t.inconsistencies(spark, d), ["status", "severity", "resource_type", "inconsistency_type"])


@query(
    sql(
        "dc",
        "di",
        then="""SELECT count(*) FILTER (processing_status = 'pending') AS pending, count(*) FILTER (processing_status = 'processing') AS processing,
      count(*) FILTER (processing_status = 'done') AS done, count(*) FILTER (processing_status = 'error') AS error,
      (SELECT count(*) FROM di WHERE status = 'open') AS open_inconsistencies FROM dc""",
    )
)
def ingestion_status(spark, d):
    kinds = [F.count_if(F.col("processing_status") == s).alias(s) for s in ("pending", "processing", "done", "error")]
    opened = t.inconsistencies(spark, d).agg(F.count_if(F.col("status") == "open").alias("open_inconsistencies"))
    return t.documents(spark, d).agg(*kinds).crossJoin(opened)  # one row each


@query(
    sql(
        "em",
        "pg",
        then="""SELECT category, count(*) AS total, count(*) FILTER (covered) AS done, greatest(0, count(*) - count(*) FILTER (covered)) AS pending
      FROM (SELECT category, id IN (SELECT source_id FROM em WHERE source_type = 'page') AS covered FROM pg) GROUP BY 1""",
    )
)
def coverage_status(spark, d):
    covered = t.embeddings(spark, d).filter("source_type = 'page'").select(F.col("source_id").alias("id"), F.lit(True).alias("covered")).distinct()
    pages = t.pages(spark, d, content=False).join(covered, "id", "left")
    done = F.count_if(F.coalesce("covered", F.lit(False)))
    return pages.groupBy("category").agg(F.count("*").alias("total"), done.alias("done"), F.greatest(F.lit(0), F.count("*") - done).alias("pending"))


@query(sql("em", then="SELECT source_type, count(*) AS n, count(DISTINCT source_id) AS n_sources FROM em GROUP BY 1"))
def embeddings_by_type(spark, d):
    return t.embeddings(spark, d).groupBy("source_type").agg(F.count("*").alias("n"), F.countDistinct("source_id").alias("n_sources"))


@query("SELECT 'pages' AS name, count(*) AS n FROM pages UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'conversations', count(*) FROM conversations")
def table_sizes(spark, d):
    counts = [t.raw(spark, d, n).agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in ("pages", "documents", "events", "conversations")]
    out = counts[0]
    for c in counts[1:]:
        out = out.union(c)
    return out


#: Damaged copies of the tables of customers, by turns.
DAMAGED = """SELECT id, caption, CASE id % 7 WHEN 1 THEN ['Tudo'] WHEN 2 THEN ['a;b', 'c', 'd', 'e'] ELSE headers END AS headers,
      CASE id % 7 WHEN 3 THEN list_transform(rows, lambda r: ['', ' ', '', '']) WHEN 4 THEN list_transform(rows, lambda r: [';;;;', r[2], '|||', '[x]']) WHEN 5 THEN list_transform(rows, lambda r: ['x', 'y', '1', 'z']) ELSE rows END AS rows FROM ct"""


def damaged_tables(spark, d):
    turn = F.col("id") % 7
    ct = t.customer_tables(spark, d)
    fixed = lambda *c: F.array(*(F.lit(x) for x in c))
    return ct.select(
        "id",
        "caption",
        F.when(turn == 1, fixed("Tudo")).when(turn == 2, fixed("a;b", "c", "d", "e")).otherwise(F.col("headers")).alias("headers"),
        F.when(turn == 3, F.transform("rows", lambda r: fixed("", " ", "", "")))
        .when(turn == 4, F.transform("rows", lambda r: F.array(F.lit(";;;;"), F.get(r, F.lit(1)), F.lit("|||"), F.lit("[x]"))))
        .when(turn == 5, F.transform("rows", lambda r: fixed("x", "y", "1", "z")))
        .otherwise(F.col("rows"))
        .alias("rows"),
    )


@query(sql("ct", then=f"SELECT count(*) AS n, count(*) FILTER (len(headers) <= 1 OR array_to_string(headers, ' ') LIKE '%;%' OR array_to_string(headers, ' ') LIKE '%|||%') AS corrupt FROM ({DAMAGED})"))
def corrupt_share(spark, d):
    joined = F.array_join("headers", " ")
    return damaged_tables(spark, d).agg(F.count("*").alias("n"), F.count_if((F.size("headers") <= 1) | joined.contains(";") | joined.contains("|||")).alias("corrupt"))


VERDICT_SQL = r"""CASE WHEN len(headers) <= 1 THEN 'single_column'
      WHEN len(list_filter(headers, lambda h: contains(h, ';') OR contains(h, '|||'))) > 0 THEN 'raw_separators_in_headers'
      WHEN len(list_filter(flatten(rows), lambda c: trim(c) <> '')) = 0 THEN 'all_rows_empty'
      WHEN len(list_filter(flatten(rows), lambda c: regexp_matches(c, '^;{3,}|^\|{3,}|^\[.+\]$'))) > 0.3::DOUBLE * len(flatten(rows)) THEN 'corrupted_cells'
      WHEN len(rows) > 3 AND len(list_distinct(rows)) = 1 THEN 'all_rows_identical' ELSE 'ok' END"""


@query(sql("ct", then=f"SELECT id, {VERDICT_SQL} AS verdict FROM ({DAMAGED})"))
def validate_tables(spark, d):
    return damaged_tables(spark, d).select("id", cells.verdict(F.col("headers"), F.col("rows")).alias("verdict"))
