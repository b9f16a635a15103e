"""Lists, look-ups, upserts and state changes of documents, pages, audit records and sessions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folio.operators import chunking, records
from folio.plans.register import query
from folio.sources import tables as t
from folio.sources.tables import with_tables as sql


@query(sql("dc", then="SELECT id, document_url, document_type, processing_status FROM dc WHERE document_type = 'pdf' AND category = 'en' ORDER BY id LIMIT 20 OFFSET 20"))
def list_documents_filtered(spark, d):
    return documents_page(t.documents(spark, d), page=2, size=20, document_type="pdf", category="en").select("id", "document_url", "document_type", "processing_status")


def documents_page(df, page: int, size: int, **wanted):
    """One page of a listing, with the filters that aren't None."""
    for column, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df.orderBy("id").offset((page - 1) * size).limit(size)


@query(sql("dc", "pg", then="SELECT dc.id, document_url, coalesce(pg.title, document_url) AS title, substr(coalesce(nullif(full_text, ''), document_title), 1, 300) AS preview FROM dc LEFT JOIN pg ON pg.id = dc.page_id WHERE document_url LIKE '%/7' OR document_url = 'src3/2022/3'"))
def document_lookup(spark, d):
    docs = t.documents(spark, d).filter(F.col("document_url").endswith("/7") | (F.col("document_url") == "src3/2022/3"))
    pages = t.pages(spark, d, content=False, title=True).select(F.col("id").alias("page_id"), "title")
    preview = F.left(F.coalesce(F.nullif("full_text", F.lit("")), F.col("document_title")), F.lit(300))
    return docs.join(pages, "page_id", "left").select("id", "document_url", F.coalesce("title", "document_url").alias("title"), preview.alias("preview"))


@query(sql("pg", "em", then="SELECT id, url FROM pg WHERE length(main_content) > 100 AND NOT EXISTS (SELECT 1 FROM em WHERE source_type = 'page_chunk' AND source_id = pg.id)"))
def pages_without_chunks(spark, d):
    covered = t.embeddings(spark, d).filter("source_type = 'page_chunk'").select(F.col("source_id").alias("id"))
    return t.pages(spark, d).filter(F.length("main_content") > 100).join(covered, "id", "left_anti").select("id", "url")


@query(sql("em", "dc", then="SELECT source_id, source_type FROM em WHERE source_id NOT IN (SELECT id FROM dc WHERE processing_status = 'done')"))
def orphan_embeddings(spark, d):
    owners = t.documents(spark, d).filter("processing_status = 'done'")
    return records.orphans(t.embeddings(spark, d), owners, "source_id", "id").select("source_id", "source_type")


@query(sql("pg", "em", then="SELECT id FROM pg WHERE id NOT IN (SELECT source_id FROM em WHERE source_type = 'page') AND content_type = 'page'"))
def pending_pages(spark, d):
    covered = t.embeddings(spark, d).filter("source_type = 'page'").select(F.col("source_id").alias("id")).distinct()
    return t.pages(spark, d, content=False).filter("content_type = 'page'").join(covered, "id", "left_anti").select("id")


@query(
    sql(
        "pg",
        then=r"""SELECT DISTINCT page_id AS source_id, target FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages)
      WHERE page_id IN (SELECT id FROM pg WHERE content_type <> 'csv')""",
    )
)
def links_with_known_source(spark, d):
    known = t.pages(spark, d, content=False).filter("content_type <> 'csv'").select(F.col("id").alias("source_id"))
    return t.raw(spark, d, "pages").select(F.col("page_id").alias("source_id"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target")).distinct().join(known, "source_id", "left_semi")


_CHUNKS = r"""ch AS (SELECT id, k AS chunk_index, array_to_string(w[k * 346 + 1:k * 346 + 384], ' ') AS chunk_text, greatest(1, floor(least(384, len(w) - k * 346) * 1.3::DOUBLE))::INTEGER AS token_count
      FROM (SELECT id, w, unnest(range(0, 1 + greatest(0, ceil((len(w) - 384) / 346.0)::BIGINT))) AS k FROM
      (SELECT doc_id AS id, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM documents) WHERE len(w) > 0))"""


def document_chunks(spark, d):
    return chunking.chunked(t.raw(spark, d, "documents").withColumnRenamed("doc_id", "id"), "id", "text")


def vector_chunks(chunks):
    """id and chunk_index of the chunk that the vector of a document or page stands for: number id % n of its n chunks."""
    n = F.count("*").over(Window.partitionBy("id"))
    return chunks.select("id", "chunk_index", n.alias("n")).filter("chunk_index = pmod(id, n)").drop("n")


#: The same in SQL, after _CHUNKS.
_VECTOR_CHUNKS = "vc AS (SELECT id, chunk_index FROM (SELECT id, chunk_index, count(*) OVER (PARTITION BY id) AS n FROM ch) WHERE chunk_index = id % n)"


def page_chunks(spark, d):
    """Chunks of the pages' content, by page."""
    texts = t.pages(spark, d).filter("main_content IS NOT NULL").select("id", "main_content")
    return chunking.chunked(texts, "id", "main_content")


@query(f"WITH {_CHUNKS} SELECT id, chunk_index::INTEGER AS chunk_index, chunk_text, token_count FROM ch")
def fixed_window_chunks(spark, d):
    return document_chunks(spark, d)


@query(f"WITH {_CHUNKS} SELECT id, chunk_index::INTEGER AS chunk_index, token_count FROM ch WHERE id IN (3, 14, 15, 92, 65)")
def chunks_by_id_list(spark, d):
    return document_chunks(spark, d).filter(F.col("id").isin(3, 14, 15, 92, 65)).select("id", "chunk_index", "token_count")


@query(f"WITH {_CHUNKS} SELECT d.doc_id AS id, coalesce(n, 0) AS n_chunks FROM documents d LEFT JOIN (SELECT id, count(*) AS n FROM ch WHERE token_count >= 100 GROUP BY 1) c ON c.id = d.doc_id")
def chunk_counts_per_document(spark, d):
    counts = document_chunks(spark, d).filter("token_count >= 100").groupBy("id").agg(F.count("*").alias("n"))
    return t.raw(spark, d, "documents").select(F.col("doc_id").alias("id")).join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n_chunks"))


@query(
    sql(
        "pg",
        then=r"""SELECT id, k AS chunk_index, len(w[k * 269 + 1:k * 269 + 307]) AS n_words FROM (SELECT id, w, unnest(range(0, 1 + greatest(0, ceil((len(w) - 307) / 269.0)::BIGINT)))::INTEGER AS k FROM
      (SELECT id, list_filter(string_split_regex(main_content, '\s+'), lambda x: x <> '') AS w FROM pg
      WHERE length(main_content) >= 2000 AND id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 6 = 2)) WHERE len(w) > 0)""",
    )
)
def page_chunk_backfill(spark, d):
    """Pages of at least 2,000 characters that have no chunks yet are cut into chunks of 400 tokens."""
    covered = t.embeddings(spark, d).filter("source_type = 'page_chunk'").select(F.col("source_id").alias("id"))
    todo = t.pages(spark, d).filter(F.length("main_content") >= 2000).join(covered, "id", "left_anti")
    chunks = chunking.chunked(todo, "id", "main_content", 400, 50)
    return chunks.select("id", "chunk_index", F.size(F.split("chunk_text", " ")).cast("long").alias("n_words"))


@query(sql("dc", then="SELECT id, document_url FROM dc WHERE processing_status = 'processing' AND processed_at < TIMESTAMP '2024-01-01 10:00:00' - INTERVAL 30 MINUTE"))
def stuck_documents(spark, d):
    limit = F.lit("2024-01-01 10:00:00").cast("timestamp") - F.make_interval(mins=F.lit(30))
    return t.documents(spark, d).filter((F.col("processing_status") == "processing") & (F.col("processed_at") < limit)).select("id", "document_url")


@query(sql("pg", then="SELECT id, url, 'kept' AS state FROM pg WHERE coalesce(main_content, '') <> '' AND depth < 3 UNION ALL SELECT id, url, 'empty' FROM pg WHERE coalesce(main_content, '') = '' OR depth >= 3"))
def empty_pages_split(spark, d):
    """Pages without content, or too deep, go to the log; the others stay."""
    empty = (F.coalesce("main_content", F.lit("")) == "") | (F.col("depth") >= 3)
    return t.pages(spark, d).select("id", "url", F.when(empty, "empty").otherwise("kept").alias("state"))


@query("SELECT page_id AS id, url, CASE WHEN page_id % 3 = 0 THEN 'new' ELSE 'old' END AS version FROM pages UNION ALL SELECT 1000000 + page_id, url || '/new', 'new' FROM pages WHERE page_id % 50 = 0")
def page_upsert(spark, d):
    pages = t.raw(spark, d, "pages").select(F.col("page_id").alias("id"), "url")
    old = pages.withColumn("version", F.lit("old"))
    changed = pages.filter("id % 3 = 0").union(pages.filter("id % 50 = 0").select(F.col("id") + 1000000, F.concat("url", F.lit("/new")))).withColumn("version", F.lit("new"))
    return records.upsert(old, changed, ["id"])


@query("SELECT page_id AS id, 'old' AS version FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id, 'new' FROM pages WHERE page_id % 2 = 1")
def insert_only_missing(spark, d):
    pages = t.raw(spark, d, "pages").select(F.col("page_id").alias("id"))
    new = pages.withColumn("version", F.lit("new"))
    return records.insert_missing(pages.filter("id % 2 = 0").withColumn("version", F.lit("old")), new.union(new), ["id"])


@query(f"WITH {_CHUNKS} SELECT id, chunk_index::INTEGER AS chunk_index, CASE WHEN id % 10 = 0 THEN 'rewritten' ELSE 'kept' END AS state FROM ch WHERE id % 10 <> 0 OR chunk_index = 0")
def content_replace(spark, d):
    """All chunks of the documents that come anew are replaced at once."""
    chunks = document_chunks(spark, d).select("id", "chunk_index")
    new = chunks.filter("id % 10 = 0 AND chunk_index = 0").withColumn("state", F.lit("rewritten"))
    return records.replace_all(chunks.withColumn("state", F.lit("kept")), new, ["id"])


_OPEN = "op AS (SELECT resource_url, inconsistency_type, severity, retry_count, detected_at FROM (SELECT *, row_number() OVER (PARTITION BY resource_url, inconsistency_type ORDER BY detected_at, id) AS n FROM di WHERE status = 'open') WHERE n = 1)"
_SEEN = "sn AS (SELECT resource_url, inconsistency_type, severity, retry_count, detected_at FROM (SELECT *, row_number() OVER (PARTITION BY resource_url, inconsistency_type ORDER BY detected_at DESC, id DESC) AS n FROM di WHERE status = 'acknowledged') WHERE n = 1)"


def _open_and_seen(spark, d):
    key, columns = ["resource_url", "inconsistency_type"], ["resource_url", "inconsistency_type", "severity", "retry_count", "detected_at"]
    di = t.inconsistencies(spark, d)
    opened = records.latest(di.filter("status = 'open'"), key, ["detected_at", "id"]).select(*columns)
    seen = records.latest(di.filter("status = 'acknowledged'"), key, [F.desc("detected_at"), F.desc("id")]).select(*columns)
    return key, opened, seen


@query(
    sql(
        "di",
        then=f", {_OPEN}, {_SEEN} SELECT resource_url, inconsistency_type, coalesce(sn.severity, op.severity) AS severity, CASE WHEN op.severity IS NULL THEN sn.retry_count WHEN sn.severity IS NULL THEN op.retry_count ELSE op.retry_count + 1 END AS retry_count, coalesce(op.detected_at, sn.detected_at) AS detected_at FROM op FULL JOIN sn USING (resource_url, inconsistency_type)",
    )
)
def inconsistency_upsert(spark, d):
    """One open record a resource and type: seen again it counts a retry and takes the new severity."""
    key, opened, seen = _open_and_seen(spark, d)
    return records.merge(opened, seen, key, {"severity": F.col("fresh.severity"), "retry_count": F.col("stored.retry_count") + 1})


@query(sql("di", then="SELECT id, CASE WHEN status = 'open' AND healthy THEN 'resolved' ELSE status END AS status, CASE WHEN status = 'open' AND healthy THEN 'auto' END AS note FROM (SELECT *, resource_url IN (SELECT 'u/' || user_id FROM events WHERE event_type = 'purchase' AND value > 18) AS healthy FROM di)"))
def auto_resolve(spark, d):
    """Open records of resources that a probe found healthy are resolved."""
    healthy = t.raw(spark, d, "events").filter("event_type = 'purchase' AND value > 18").select(F.concat(F.lit("u/"), "user_id").alias("resource_url"), F.lit(True).alias("healthy")).distinct()
    joined = t.inconsistencies(spark, d).join(healthy, "resource_url", "left")
    solved = (F.col("status") == "open") & F.coalesce("healthy", F.lit(False))
    return joined.select("id", F.when(solved, "resolved").otherwise(F.col("status")).alias("status"), F.when(solved, "auto").alias("note"))


@query(sql("di", then="SELECT id, CASE WHEN id % 5 = 0 THEN 'resolved' ELSE status END AS status, CASE WHEN id % 5 = 0 THEN last_checked_at END AS resolved_at FROM di"))
def status_update(spark, d):
    chosen = F.col("id") % 5 == 0
    return t.inconsistencies(spark, d).select("id", F.when(chosen, "resolved").otherwise(F.col("status")).alias("status"), F.when(chosen, F.col("last_checked_at")).alias("resolved_at"))


@query(sql("em", then="SELECT source_id, source_type FROM em WHERE NOT (source_type = 'question' AND source_id < 200)"))
def delete_by_source(spark, d):
    em = t.embeddings(spark, d).select("source_id", "source_type")
    return records.delete(em, em.filter("source_type = 'question' AND source_id < 200"), ["source_id", "source_type"])


@query(sql("ct", then="SELECT id, len(rows)::INTEGER AS n_rows FROM ct WHERE id NOT IN (SELECT id FROM ct WHERE id % 7 IN (1, 2))"))
def corrupt_cleanup(spark, d):
    """Tables with one column or raw separators go, and with them what belongs to them; the set is taken before anything is deleted."""
    from folio.plans.analytics import damaged_tables

    joined = F.array_join("headers", " ")
    bad = damaged_tables(spark, d).filter((F.size("headers") <= 1) | joined.contains(";") | joined.contains("|||")).select("id")
    return records.delete(t.customer_tables(spark, d).select("id", F.size("rows").alias("n_rows")), bad, ["id"])


@query("SELECT doc_id AS id, sha256(text) AS text_hash FROM documents LEFT JOIN embeddings ON vec_id = doc_id WHERE vec_id IS NULL OR doc_id % 7 = 0")
def embeddings_to_refresh(spark, d):
    """Documents whose text has another hash than their embedding was made from (every seventh), or that have none."""
    docs = t.raw(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("text_hash"))
    stale = F.when(F.col("id") % 7 == 0, F.lit("stale")).otherwise(F.col("text_hash"))
    known = t.raw(spark, d, "embeddings").select(F.col("vec_id").alias("id")).join(docs.select("id", stale.alias("known_hash")), "id")
    return docs.join(known, "id", "left").filter(~F.col("text_hash").eqNullSafe(F.col("known_hash"))).select("id", "text_hash")


_PROBES = "pr AS (SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'page' WHEN 'click' THEN 'link' ELSE 'document' END AS kind, CASE WHEN value < 2 THEN 200 WHEN value < 5 THEN 301 WHEN value < 12 THEN 404 ELSE 503 END AS status FROM events)"
_OUTCOME = "CASE WHEN status BETWEEN 200 AND 399 THEN 'healthy' WHEN kind = 'page' THEN CASE WHEN status >= 500 THEN 'critical' ELSE 'warning' END WHEN kind = 'document' THEN CASE WHEN status >= 500 THEN 'warning' ELSE 'critical' END ELSE 'warning' END"


def probes(spark, d):
    e = t.raw(spark, d, "events")
    kind = F.when(F.col("event_type") == "view", "page").when(F.col("event_type") == "click", "link").otherwise("document")
    status = F.when(F.col("value") < 2, 200).when(F.col("value") < 5, 301).when(F.col("value") < 12, 404).otherwise(503)
    return e.select(F.col("event_id").alias("id"), kind.alias("kind"), status.alias("status"))


@query(f"WITH {_PROBES} SELECT id, kind, {_OUTCOME} AS outcome FROM pr")
def health_outcomes(spark, d):
    return probes(spark, d).select("id", "kind", records.probe_outcome(F.col("kind"), F.col("status")).alias("outcome"))


@query(f"WITH {_PROBES}, o AS (SELECT kind, {_OUTCOME} AS outcome FROM pr) SELECT coalesce(kind, 'all') AS kind, count(*) AS checked, count(*) FILTER (outcome = 'healthy') AS healthy, count(*) FILTER (outcome = 'critical') AS critical FROM o GROUP BY ROLLUP (kind)")
def health_report(spark, d):
    """Counters of each check, and of all together."""
    outcomes = probes(spark, d).select("kind", records.probe_outcome(F.col("kind"), F.col("status")).alias("outcome"))
    by = outcomes.rollup("kind").agg(F.count("*").alias("checked"), F.count_if(F.col("outcome") == "healthy").alias("healthy"), F.count_if(F.col("outcome") == "critical").alias("critical"))
    return by.withColumn("kind", F.coalesce("kind", F.lit("all")))


@query(
    """WITH x AS (SELECT doc_id AS id, CASE WHEN doc_id % 11 = 0 THEN 404 WHEN doc_id % 13 = 0 THEN 500 ELSE 200 END AS status,
      CASE WHEN doc_id % 17 = 0 THEN 'file size exceeded' WHEN doc_id % 19 = 0 THEN 'cannot decode' WHEN doc_id % 23 = 0 THEN 'broken' END AS message, length(text) > 200 AS has FROM documents),
    y AS (SELECT id, CASE WHEN status = 404 THEN 'document_not_found' WHEN status >= 400 THEN 'http_error' WHEN message LIKE '%size%' THEN 'oversized' WHEN message LIKE '%decod%' THEN 'encoding_error' WHEN message IS NOT NULL THEN 'document_corrupted' WHEN NOT has THEN 'empty_content' END AS kind FROM x)
    SELECT id, CASE WHEN kind IS NULL THEN 'done' ELSE 'error' END AS next_status, kind, CASE WHEN kind IN ('document_not_found', 'document_corrupted', 'empty_content') THEN 'critical' WHEN kind IN ('http_error', 'encoding_error') THEN 'warning' WHEN kind = 'oversized' THEN 'info' END AS severity FROM y"""
)
def ingestion_outcomes(spark, d):
    i = F.col("doc_id")
    status = F.when(i % 11 == 0, 404).when(i % 13 == 0, 500).otherwise(200)
    message = F.when(i % 17 == 0, "file size exceeded").when(i % 19 == 0, "cannot decode").when(i % 23 == 0, "broken")
    out = records.ingested(t.raw(spark, d, "documents").select("doc_id", "text"), (F.length("text") > 200).cast("int"), status, message)
    return out.select(F.col("doc_id").alias("id"), "next_status", "kind", "severity")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3")
def session_history(spark, d):
    """The last three messages of each session."""
    last = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return t.raw(spark, d, "conversations").withColumn("n", last).filter("n <= 3").select("conv_id", "turn", "role")


@query("SELECT conv_id, count(*) AS message_count, max(turn) AS last_turn, min_by(substr(text, 1, 60), turn) AS title FROM conversations GROUP BY 1 ORDER BY last_turn DESC, conv_id LIMIT 20")
def session_list(spark, d):
    """The sessions that were active last; the turn stands for the time of a message."""
    sessions = t.raw(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("message_count"), F.max("turn").alias("last_turn"), F.min_by(F.substring("text", 1, 60), "turn").alias("title"))
    return sessions.orderBy(F.desc("last_turn"), "conv_id").limit(20)


@query(sql("ql", then="SELECT id, CASE WHEN id % 9 = 0 THEN 'positive' ELSE feedback END AS feedback FROM ql"))
def feedback_update(spark, d):
    logs = t.query_logs(spark, d).select("id", "feedback")
    return records.merge(logs, logs.filter("id % 9 = 0").withColumn("feedback", F.lit("positive")), ["id"], {"feedback": F.col("fresh.feedback")})


@query("SELECT text, min(doc_id) AS id, nullif(min_by(source, doc_id), 'src0') AS source FROM documents WHERE lang IN ('en', 'fr') GROUP BY text")
def deduplicated_copy(spark, d):
    """One row a text, the smallest id's, of known languages, with a placeholder turned into null."""
    known = spark.createDataFrame([("en",), ("fr",)], "lang string")
    rows = t.raw(spark, d, "documents").join(known, "lang", "left_semi")
    return rows.groupBy("text").agg(F.min("doc_id").alias("id"), F.nullif(F.min_by("source", "doc_id"), F.lit("src0")).alias("source"))


@query("SELECT coalesce(a.url, b.url) AS url, coalesce(b.depth, a.depth) AS depth, a.url IS NOT NULL AS in_sitemap FROM (SELECT url, 0 AS depth FROM pages WHERE page_id % 3 <> 0) a FULL JOIN (SELECT url, (page_id % 4)::INTEGER AS depth FROM pages WHERE page_id % 2 = 0) b ON a.url = b.url")
def merge_sources(spark, d):
    """Sitemap and crawl by URL; what the crawl knows goes first."""
    pages = t.raw(spark, d, "pages")
    sitemap = pages.filter("page_id % 3 <> 0").select("url", F.lit(0).alias("d1"), F.lit(True).alias("known"))
    crawl = pages.filter("page_id % 2 = 0").select("url", (F.col("page_id") % 4).cast("int").alias("d2"))
    return sitemap.join(crawl, "url", "full_outer").select("url", F.coalesce("d2", "d1").alias("depth"), F.coalesce("known", F.lit(False)).alias("in_sitemap"))


@query("SELECT page_id AS id, CASE WHEN page_id % 4 = 0 THEN 'new' ELSE 'changed' END AS why FROM pages WHERE page_id % 4 = 0 OR page_id % 6 = 1")
def incremental_crawl(spark, d):
    """Pages that aren't stored, or whose modification date isn't the stored one."""
    pages = t.raw(spark, d, "pages").select(F.col("page_id").alias("id"), F.when(F.col("page_id") % 6 == 1, "2024-02-02").otherwise("2024-01-01").alias("lastmod"))
    stored = t.raw(spark, d, "pages").filter("page_id % 4 <> 0").select(F.col("page_id").alias("id"), F.lit("2024-01-01").alias("stored"))
    joined = pages.join(stored, "id", "left").filter(F.col("stored").isNull() | (F.col("lastmod") != F.col("stored")))
    return joined.select("id", F.when(F.col("stored").isNull(), "new").otherwise("changed").alias("why"))


@query("SELECT l_orderkey AS id, string_agg(l_partkey::VARCHAR, ' ' ORDER BY l_linenumber, l_partkey) AS content FROM lineitem GROUP BY 1")
def document_content(spark, d):
    """Parts of a document joined in their order."""
    parts = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    return t.raw(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_join(F.transform(parts, lambda x: x["l_partkey"].cast("string")), " ").alias("content"))


@query("SELECT n_nationkey AS id, n_name AS title, r_name AS parent, coalesce(string_agg(s_name, '|' ORDER BY s_name), '') AS children, (SELECT count(*) - 1 FROM nation m WHERE m.n_regionkey = n.n_regionkey) AS n_siblings FROM nation n JOIN region ON r_regionkey = n_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL")
def page_with_context(spark, d):
    """A node of the navigation tree with its parent, children and number of siblings."""
    nation, region, supplier = (t.raw(spark, d, n) for n in ("nation", "region", "supplier"))
    children = supplier.groupBy(F.col("s_nationkey").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("s_name")), "|").alias("children"))
    siblings = F.count("*").over(Window.partitionBy("n_regionkey")) - 1
    nodes = nation.withColumn("n_siblings", siblings).join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("title"), F.col("r_name").alias("parent"), "n_siblings")
    return nodes.join(children, "id", "left").withColumn("children", F.coalesce("children", F.lit("")))
