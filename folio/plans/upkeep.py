"""Names of sections and categories, resolving of links, write-backs, sessions, dispatch of vector searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.functions import text
from folio.operators import answer, blocks, chunking, pages, quality, records, search
from folio.plans.records import _CHUNKS, _VECTOR_CHUNKS, document_chunks, page_chunks, vector_chunks
from folio.plans.register import query
from folio.plans.retrieval import _LIST, _SCORED, _SIM, _query_vector, citations, metric_items
from folio.sources import tables as t
from folio.sources.tables import with_tables as sql

_MAP = lambda names: "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in names.items()) + "}"


def _by_turns(names, key, otherwise):
    """The known names by turns, and now and then another."""
    return F.coalesce(F.get(F.array(*map(F.lit, names)), F.pmod(key, F.lit(len(names) + 2)).cast("int")), otherwise)


@query(sql("pg", then=f"SELECT id, name, coalesce(({_MAP(pages.CATEGORIES)})[name], name) AS canonical, ({_MAP(pages.CATEGORIES)})[name] IS NULL AS unmapped FROM (SELECT id, coalesce(({_LIST(pages.CATEGORIES)})[(id % {len(pages.CATEGORIES) + 2} + 1)::INTEGER], category) AS name FROM pg)"))
def normalize_categories(spark, d):
    """Categories by the name that they stand for; others stay and are logged as unmapped."""
    rows = t.pages(spark, d, content=False).select("id", _by_turns(list(pages.CATEGORIES), F.col("id"), F.col("category")).alias("name"))
    known = pages.canonical_category(F.col("name"))
    return rows.select("id", "name", F.coalesce(known, "name").alias("canonical"), known.isNull().alias("unmapped"))


@query(rf"SELECT page_id AS id, slug, coalesce(({_MAP(pages.SLUGS)})[slug], array_to_string(list_transform(regexp_extract_all(translate(slug, '-_', '  '), '\p{{L}}+|[^\p{{L}}]+'), lambda r: upper(r[1]) || lower(r[2:])), '')) AS title FROM (SELECT page_id, coalesce(({_LIST(pages.SLUGS)})[(page_id % {len(pages.SLUGS) + 2} + 1)::INTEGER], 'plano-' || page_id || 'b_ação-d''água') AS slug FROM pages)")
def slug_titles(spark, d):
    other = F.concat(F.lit("plano-"), F.col("page_id").cast("string"), F.lit("b_ação-d'água"))
    rows = t.raw(spark, d, "pages").select(F.col("page_id").alias("id"), _by_turns(list(pages.SLUGS), F.col("page_id"), other).alias("slug"))
    return rows.select("id", "slug", pages.slug_title(F.col("slug")).alias("title"))


@query("""WITH g AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN substr(url, 9) ELSE 'nowhere/' || page_id END AS target FROM pages)
    SELECT g.page_id AS source_id, target, coalesce((SELECT min(page_id) FROM pages p WHERE p.url = target), (SELECT min(page_id) FROM pages p WHERE suffix(p.url, target))) AS page_id FROM g""")
def resolve_targets(spark, d):
    """Targets of links: whole URLs, ends of URLs, and unknown ones."""
    own = t.raw(spark, d, "pages").select(F.col("page_id").alias("id"), "url")
    i = F.col("id")
    target = F.when(i % 3 == 0, F.col("url")).when(i % 3 == 1, F.expr("substr(url, 9)")).otherwise(F.concat(F.lit("nowhere/"), i.cast("string")))
    return pages.resolved(own.select(i.alias("source_id"), target.alias("target")), own)


@query(sql("dc", then="SELECT id FROM dc WHERE contains(document_url, '2024') OR contains(document_url, '2021')"))
def documents_by_year(spark, d):
    """Documents whose URL holds a year that the question names."""
    question = F.lit("Contratos de 2024, e os de 2021? (12024 não)")
    return t.documents(spark, d).filter(text.names_year(F.col("document_url"), question)).select("id")


@query(sql("pg", then=f", {_CHUNKS} SELECT pg.id, chunk_index::INTEGER AS chunk_index, title, token_count FROM ch JOIN pg ON pg.id = ch.id WHERE depth = 1"))
def page_chunks_joined(spark, d):
    """Chunks of pages with their page."""
    own = t.pages(spark, d, content=False, title=True).filter("depth = 1").select("id", "title")
    return page_chunks(spark, d).join(own, "id").select("id", "chunk_index", "title", "token_count")


@query(f"WITH {_SCORED} SELECT id, chunk_index::INTEGER AS chunk_index, CASE WHEN id % 2 = 0 THEN 0.9 ELSE round(score, 6) END AS quality_score, CASE WHEN id % 2 = 0 THEN 'stored' ELSE array_to_string(flags, ',') END AS flags FROM sc")
def quality_write_back(spark, d):
    """Chunks without a stored score get one; the others keep theirs."""
    stored = F.col("id") % 2 == 0
    chunks = document_chunks(spark, d).withColumns({"quality_score": F.when(stored, 0.9), "flags": F.when(stored, F.array(F.lit("stored"))), "quarantined": F.when(stored, False)})
    return quality.score_pending(chunks, "chunk_text").select("id", "chunk_index", F.round("quality_score", 6).alias("quality_score"), F.array_join("flags", ",").alias("flags"))


_ASKED = ("chunk", "page", "page_chunk", "page_summary", "question", "section", "video")


@query(sql("em", then="SELECT source_type, id, round(similarity, 6) AS similarity FROM (" + " UNION ALL ".join(f"(SELECT source_type, source_id AS id, {_SIM} AS similarity FROM em WHERE source_type = '{k}'{chr(32)}{'AND category = ' + chr(39) + 'c3' + chr(39) if k in search.WITH_CATEGORY else ''} ORDER BY similarity DESC, id LIMIT 5)" for k in _ASKED) + ")"))
def semantic_dispatch(spark, d):
    """Every kind of source, and one that isn't known, with a category that only some heed."""
    out, vector, vectors = None, _query_vector(spark, d), t.embeddings(spark, d)
    for kind in _ASKED:
        best = search.semantic(vectors, kind, vector, 5, "c3").select("source_type", F.col("source_id").alias("id"), F.round("similarity", 6).alias("similarity"))
        out = best if out is None else out.union(best)
    return out


_NEAR = "(SELECT source_type, source_id, {sim} AS sim FROM em WHERE source_type = '{kind}' AND {known} ORDER BY sim DESC, source_id LIMIT 10)"


@query(sql("em", "pg", then=f", {_CHUNKS}, {_VECTOR_CHUNKS} SELECT source_type, source_id AS id, title, NULL::INTEGER AS chunk_index, round(sim, 6) AS similarity FROM ({' UNION ALL '.join(_NEAR.format(sim=_SIM, kind=k, known='source_id IN (SELECT id FROM pg)') for k in ('page', 'page_summary'))}) n JOIN pg ON pg.id = source_id UNION ALL SELECT source_type, source_id, title, chunk_index::INTEGER, round(sim, 6) FROM {_NEAR.format(sim=_SIM, kind='page_chunk', known='source_id IN (SELECT ch.id FROM ch JOIN pg ON pg.id = ch.id)')} n JOIN vc ON vc.id = source_id JOIN pg ON pg.id = source_id"))
def semantic_pages_joined(spark, d):
    """Nearest pages and summaries with their page, nearest page chunks with chunk and page: vectors are cut to k first."""
    vector, vectors = _query_vector(spark, d), t.embeddings(spark, d)
    own = t.pages(spark, d, content=False, title=True).select("id", "title")
    first = vector_chunks(page_chunks(spark, d))
    out = None
    for kind in ("page", "page_summary", "page_chunk"):
        known = (first if kind == "page_chunk" else own).select(F.col("id").alias("source_id"))
        best = search.semantic(vectors.join(known, "source_id", "left_semi"), kind, vector, 10).select("source_type", F.col("source_id").alias("id"), "similarity")
        rows = best.join(own, "id")
        rows = rows.join(first, "id") if kind == "page_chunk" else rows.withColumn("chunk_index", F.lit(None).cast("int"))
        rows = rows.select("source_type", "id", "title", "chunk_index", F.round("similarity", 6).alias("similarity"))
        out = rows if out is None else out.union(rows)
    return out


@query(sql("em", "pg", "dc", then=f""", q AS (SELECT CASE WHEN source_id % 2 = 0 THEN 'page' ELSE 'document' END AS kind, source_id // 20 AS target, source_id, {_SIM} AS sim FROM em WHERE source_type = 'question' ORDER BY sim DESC, source_id LIMIT 30)
    SELECT kind, target, pg.title, round(sim, 6) AS similarity FROM q JOIN pg ON pg.id = target WHERE kind = 'page' UNION ALL SELECT kind, target, document_title, round(sim, 6) FROM q JOIN dc ON dc.id = target WHERE kind = 'document'"""))
def questions_resolved(spark, d):
    """The nearest stored questions, each with the page or document that it was made of."""
    near = search.semantic(t.embeddings(spark, d), "question", _query_vector(spark, d), 30)
    q = near.select(F.when(F.col("source_id") % 2 == 0, "page").otherwise("document").alias("kind"), F.floor(F.col("source_id") / 20).cast("long").alias("target"), F.round("similarity", 6).alias("similarity"))
    titles = t.pages(spark, d, content=False, title=True).select(F.lit("page").alias("kind"), F.col("id").alias("target"), "title").union(t.documents(spark, d).select(F.lit("document"), "id", "document_title"))
    return titles.join(F.broadcast(q), ["kind", "target"]).select("kind", "target", "title", "similarity")  # q: 30 rows


@query(sql("em", "pg", then=f", s AS (SELECT source_id // 25 AS page, max(sim) AS sim FROM (SELECT source_id, {_SIM} AS sim FROM em WHERE source_type = 'section' ORDER BY sim DESC, source_id LIMIT 30) GROUP BY 1) SELECT page, title, length(main_content) AS n_chars, round(sim, 6) AS similarity FROM s JOIN pg ON pg.id = page"))
def sections_resolved(spark, d):
    """The nearest sections' pages with title and content."""
    near = search.semantic(t.embeddings(spark, d), "section", _query_vector(spark, d), 30)
    best = near.groupBy(F.floor(F.col("source_id") / 25).cast("long").alias("page")).agg(F.round(F.max("similarity"), 6).alias("similarity"))
    own = t.pages(spark, d).select(F.col("id").alias("page"), "title", F.length("main_content").cast("long").alias("n_chars"))
    return own.join(F.broadcast(best), "page").select("page", "title", "n_chars", "similarity")  # best: 30 rows at most


@query("SELECT conv_id AS session_id, count(*) AS message_count, max(turn) AS last_active, coalesce(min_by(left(text, 60), turn) FILTER (turn < 2), min_by(left(text, 60), turn)) AS title FROM conversations GROUP BY 1")
def session_save(spark, d):
    """Sessions of the first two turns, after all later messages were saved."""
    messages = t.raw(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("sent"), "text")
    none = spark.createDataFrame([], f"session_id {messages.schema['session_id'].dataType.simpleString()}, message_count long, last_active {messages.schema['sent'].dataType.simpleString()}, title string")
    return records.saved_messages(records.saved_messages(none, messages.filter("sent < 2")), messages.filter("sent >= 2"))


@query()
def rechunked(spark, d):
    """How many chunks each document had by fixed windows, and has by its structure."""
    new = blocks.semantic_chunks(t.raw(spark, d, "documents").withColumnRenamed("doc_id", "id"), "id", "text")
    return chunking.rechunk_counts(document_chunks(spark, d), new, "id")


@query(sql("ct", then="SELECT id, array_to_string(list_transform(rows, lambda r: array_to_string(r, '|')), chr(10)) AS shown FROM ct"))
def tables_with_total(spark, d):
    """Tables as answers show them, their total row computed anew."""
    ct = t.customer_tables(spark, d)
    return ct.select("id", F.array_join(F.transform(answer.with_total(F.col("headers"), F.col("rows")), lambda r: F.array_join(r, "|")), "\n").alias("shown"))


@query()
def assembled_answer(spark, d):
    tables = t.customer_tables(spark, d).orderBy("id").limit(2)
    titles = t.pages(spark, d, content=False, title=True).filter("depth = 0").orderBy("id").limit(6).select("title")
    return answer.assembled(tables, metric_items(spark, d).orderBy("label").limit(5), citations(spark, d).orderBy(F.desc("score"), "url").limit(5), titles)


@query(
    r"""WITH g AS (SELECT page_id, 'https://www.example.org/a/b/' || page_id AS base, (['c?x=1', '/a/d', '//cdn.example.org/a/f.pdf', 'https://www.example.org/z/g.csv?v=2', 'mailto:x@y', '?q=1', 'http://other.com/a/b'])[(page_id % 7 + 1)::INTEGER] AS href FROM pages),
    u AS (SELECT *, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN 'https:' || href WHEN starts_with(href, '/') THEN 'https://www.example.org' || href WHEN starts_with(href, '?') THEN base || href ELSE 'https://www.example.org/a/b/' || href END AS url FROM g WHERE href <> 'mailto:x@y')
    SELECT page_id AS source_id, CASE WHEN contains(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/a/') THEN regexp_extract(url, '^([^?#]*)', 1) ELSE url END AS url FROM u WHERE contains(regexp_extract(url, '://([^/?#]*)', 1), 'example.org')"""
)
def crawl_candidates(spark, d):
    """Links of pages as the URLs to crawl: pages below a prefix of the domain, and its files."""
    i = F.col("page_id")
    href = F.get(F.array(*map(F.lit, ("c?x=1", "/a/d", "//cdn.example.org/a/f.pdf", "https://www.example.org/z/g.csv?v=2", "mailto:x@y", "?q=1", "http://other.com/a/b"))), (i % 7).cast("int"))
    rows = t.raw(spark, d, "pages").select(i.alias("source_id"), F.concat(F.lit("https://www.example.org/a/b/"), i.cast("string")).alias("base"), href.alias("href")).filter(pages.wanted_link(F.col("href")))
    return rows.select("source_id", pages.candidate(pages.absolute(F.col("base"), F.col("href")), "example.org", "/a/").alias("url")).filter("url IS NOT NULL").distinct()


@query()
def page_fields(spark, d):
    """All that pages say of themselves, with the section of their path."""
    url = F.concat(F.lit("https://www.example.org/portal/"), F.get(F.array(*map(F.lit, pages.SLUGS)), (F.col("page_id") % 25).cast("int")), F.lit("/outra-pagina"))
    rows = t.raw(spark, d, "pages").select(F.col("page_id").alias("id"), F.coalesce(url, "url").alias("url"), "html")
    x = pages.extract_page("html", "url", "example.org")
    return rows.select("id", "url", x.alias("x")).select("id", "x.title", "x.description", F.size("x.documents").alias("n_documents"), F.size("x.links").alias("n_links"), F.array_join("x.tags", ",").alias("tags"), pages.path_category(F.col("url"), "portal").alias("category"), pages.path_category(F.col("url"), "portal", 1).alias("subcategory"))


_FREQUENT_SQL = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in answer.FREQUENT.items()) + ") f(category, question)"


@query(sql("pg", then=f", c AS (SELECT coalesce(({_LIST(answer.FREQUENT)})[(id % 20 + 1)::INTEGER], category) AS category, count(*) AS n FROM pg GROUP BY 1) SELECT row_number() OVER (ORDER BY first)::INTEGER AS place, question FROM (SELECT question, min({{'n': -n, 'category': category}}) AS first FROM c JOIN {_FREQUENT_SQL} USING (category) GROUP BY question) ORDER BY place LIMIT 6"))
def frequent_questions(spark, d):
    """Questions of the largest categories."""
    name = F.coalesce(F.get(F.array(*map(F.lit, answer.FREQUENT)), (F.col("id") % 20).cast("int")), F.col("category"))
    return answer.frequent_questions(t.pages(spark, d, content=False).groupBy(name.alias("category")).agg(F.count("*").alias("n")))


@query("SELECT doc_id AS id, 'chunk' AS source_type, 'letters' AS model, sha256(text) AS text_hash, 8 AS dimensions, doc_id % 3 <> 2 AS refreshed FROM documents")
def incremental_embedding(spark, d):
    """Documents without a vector, or whose text has changed since, are embedded anew and upserted by source, kind and model."""
    docs = t.raw(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.sha2("text", 256).alias("text_hash"))
    key = ["id", "source_type", "model"]
    named = lambda df: df.withColumns({"source_type": F.lit("chunk"), "model": F.lit("letters")})
    known = named(docs.filter("id % 3 <> 0")).select(*key, F.when(F.col("id") % 3 == 1, "stale").otherwise(F.col("text_hash")).alias("text_hash"), F.array_repeat(F.lit(0.5), 8).alias("embedding"), F.lit(False).alias("refreshed"))
    todo = docs.join(known.select("id", F.col("text_hash").alias("known")), "id", "left").filter(~F.col("text_hash").eqNullSafe(F.col("known")))
    fresh = named(answer.embedded(todo, "id", "text", answer.letter_vectors).join(todo.select("id", "text_hash"), "id")).withColumn("refreshed", F.lit(True))
    return records.upsert(known, fresh.select(known.columns), key).select(*key, "text_hash", F.size("embedding").alias("dimensions"), "refreshed")


@query("""WITH c AS (SELECT page_id AS id, unnest(range(page_id % 3)) AS n FROM pages)
    SELECT page_id AS id, CASE WHEN page_id % 4 = 0 THEN 'new' ELSE 'old' END AS version, CASE WHEN page_id % 4 = 0 THEN 1 ELSE page_id % 3 END AS n_links FROM pages WHERE page_id % 11 <> 0""")
def pages_with_children(spark, d):
    """Pages that come anew bring their links along; pages that go take theirs with them."""
    ids = t.raw(spark, d, "pages").select(F.col("page_id").alias("id"))
    links = ids.select("id", F.explode(F.expr("CASE WHEN id % 3 > 0 THEN sequence(1, id % 3) ELSE array() END")).alias("n"))
    fresh = ids.filter("id % 4 = 0")
    tables = records.upsert_with_children({"pages": ids.withColumn("version", F.lit("old")), "links": links}, {"pages": fresh.withColumn("version", F.lit("new")), "links": fresh.withColumn("n", F.lit(9).cast("long"))}, "id", "pages")
    left = records.delete_with_children(tables, ids.filter("id % 11 = 0"), "id")
    counted = left["links"].groupBy("id").agg(F.count("*").alias("n_links"))
    return left["pages"].join(counted, "id", "left").select("id", "version", F.coalesce("n_links", F.lit(0)).alias("n_links"))
