"""States of ingestion across failures, sitemaps, trees, crawls with a limit, and replies of a chat."""

import gzip
import json
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from folio.operators import chat
from folio.sources import segments, store
from folio.streaming import ingestion

RNG = random.Random(9)
ARRIVALS = "key string, content string, at timestamp"


def at(minute):
    return f"2024-01-01 {9 + minute // 60:02d}:{minute % 60:02d}:00"


def states(spark, path):
    return {r["key"]: (r["state"], r["attempts"], r["content"]) for r in segments.current(spark, path).collect()}


def test_states_through_failed_and_repeated_batches(spark, tmp_path):
    source, path, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "states", "checkpoint"))
    clock = [at(0)]

    def arrive(*rows):
        spark.createDataFrame([(k, c, m) for k, c, m in rows], "key string, content string, at string").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(source)

    def run(broken=False):
        def work(content):
            fault = F.raise_error(F.lit("the worker is lost")).cast("string") if broken else F.lit(None).cast("string")
            return F.when(content == "bad", "unreadable").when(content == "good", fault)

        rows = spark.readStream.schema(ARRIVALS).parquet(source)
        ingestion.ingest(rows, path, checkpoint, work, now=lambda: F.lit(clock[0]).cast("timestamp")).awaitTermination()

    arrive(("a", "good", at(0)), ("b", "bad", at(0)), ("a", "old", at(-5)), (None, "x", at(0)))
    with pytest.raises(Exception):
        run(broken=True)
    assert states(spark, path)["a"] == ("processing", 0, "good")  # claimed, and then the batch was lost
    run()
    assert states(spark, path) == {"a": ("done", 1, "good"), "b": ("error", 1, "bad")}
    before = segments.numbers(spark, path)
    assert before == [0, 1]  # the batch that ran again replaced its own segments
    clock[0] = at(5)
    arrive(("a", "good", at(4)), ("c", None, at(4)))  # a key that comes again in a later batch
    run()
    assert states(spark, path) == {"a": ("done", 1, "good"), "b": ("error", 2, "bad"), "c": ("done", 1, None)}
    assert segments.current(spark, path).count() == 3
    arrive(("a", "bad", at(5)), ("a", "better", at(6)))
    run()
    assert states(spark, path) == {"a": ("done", 1, "better"), "b": ("error", 3, "bad"), "c": ("done", 1, None)}
    arrive(("d", "x", at(7)))
    run()
    assert states(spark, path)["b"] == ("error", 3, "bad")  # tried often enough
    arrive(("b", "bad", at(8)))
    run()
    assert states(spark, path)["b"] == ("error", 4, "bad")  # asked for again
    run()
    assert len(states(spark, path)) == 4


def test_stuck_documents_are_taken_up(spark):
    before = spark.createDataFrame([("s", "x", "h", "processing", 1, at(0)), ("n", "y", "h", "processing", 1, at(20)), ("p", "z", "h", "pending", 0, at(49)), ("d", "w", "h", "done", 1, at(0))], "key string, content string, hash string, state string, attempts int, since string")
    before = before.withColumns({"since": F.col("since").cast("timestamp"), "error": F.lit(None).cast("string")})
    taken = ingestion.queued(before, spark.createDataFrame([], ARRIVALS), F.lit(at(49)).cast("timestamp"))
    assert sorted(tuple(r) for r in taken.select("key", "content", "state", "attempts").collect()) == [("p", "z", "pending", 0), ("s", "x", "pending", 1)]


def test_first_sitemap_that_can_be_read(spark, tmp_path):
    body = '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://x/a/1 </loc><lastmod>2024</lastmod></url><url><loc>https://x/b/2</loc></url><url/><url><loc>https://x/a/3</loc></url></urlset>'
    (tmp_path / "cut.xml.gz").write_bytes(gzip.compress(body.encode())[:-20])
    (tmp_path / "broken.xml").write_text(body[:200])
    (tmp_path / "good.xml.gz").write_bytes(gzip.compress(body.encode()))
    (tmp_path / "empty.xml").write_text("<urlset/>")
    listed = lambda *names: sorted(tuple(r) for r in store.first_sitemap(spark, [f"{tmp_path}/{n}" for n in names], "/a/").collect())
    want = [("https://x/a/1", "2024"), ("https://x/a/3", None)]
    assert listed("none.xml.gz", "cut.xml.gz", "broken.xml", "good.xml.gz", "empty.xml") == want
    assert listed("empty.xml", "good.xml.gz") == [] == listed("none.xml") == listed()


def test_tree_in_parts(spark, tmp_path):
    pages = spark.createDataFrame([("u1", "t", "c", "s", "page", 1), ("u2", None, "c", None, "pdf", 2), ("u3", "t", None, "s", "page", 0)], "url string, title string, category string, subcategory string, content_type string, depth int")
    documents = spark.createDataFrame([("u1", f"d{i:02d}", None, "pdf") for i in range(25)] + [(None, "x", "y", "csv")], "url string, document_url string, document_title string, document_type string")
    rows = {(r["kind"], r["key"], r["part"]): json.loads(r["json"]) for r in store.tree(pages, documents, 10).collect()}
    assert [len(rows["page", "u1", k]["documents"]) for k in range(3)] == [10, 10, 5] and rows["page", "u2", 0]["documents"] == [] and rows["page", "u2", 0]["title"] is None
    assert sum((rows["page", "u1", k]["documents"] for k in range(3)), [])[13] == {"document_url": "d13", "document_title": None, "document_type": "pdf"}
    assert rows["category", "c", 0] == {"category": "c", "pages": 2, "documents": 25, "subcategories": [{"subcategory": None, "pages": 1, "documents": 0}, {"subcategory": "s", "pages": 1, "documents": 25}]}
    assert rows["metadata", "all", 0] == {"categories": 1, "pages": 3, "documents": 25} and rows["category", None, 0]["pages"] == 1
    store.export_tree(pages, documents, f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out/kind=page").count() == 3
    assert store.tree(pages.limit(0), documents, 10).count() == 1


@pytest.mark.parametrize("most", [1, 4, 9, 1000])
def test_limited_crawl_equals_a_queue(spark, most):
    edges = [(f"p{RNG.randrange(30)}", f"p{RNG.randrange(30)}", i) for i in range(70)] + [("p0", None, 99)]
    links = {}
    for source, target, position in edges:
        links.setdefault(source, []).append((position, target))
    seen, queue = {}, deque([("p3", 0), ("p0", 0)])
    while queue and len(seen) < most:
        url, depth = queue.popleft()
        if url in seen or depth > 4 or url is None:
            continue
        seen[url] = (depth, len(seen))
        queue += [(target, depth + 1) for _, target in sorted(links.get(url, []), key=lambda x: x[0])]
    got = store.crawl_first(spark.createDataFrame(edges, "source string, target string, position long"), spark.createDataFrame([("p0", 7), ("p3", 2), ("p0", 9), (None, 0)], "url string, position long"), most, 4)
    assert {r["url"]: (r["depth"], r["place"]) for r in got.collect()} == seen


REPLIES = [
    ('{"text": " oi ", "links": [{"url": "/a"}, {"title": "x"}, {"title": "b", "url": "/b", "type": "pdf"}], "suggestions": ["1", "2", "3", "4", "5"], "category": "c"}', ("oi", [("/a", "/a", "page"), ("b", "/b", "pdf")], 4, "c")),
    ('antes ```json\n{"text": "x"}\n``` depois', ("x", None, 3, None)),
    ('veja {"text": "", "category": ""} fim', (chat.WITHOUT_TEXT, None, 3, None)),
    ("sem forma", ("sem forma", None, 3, None)),
    ("{quebrado", ("{quebrado", None, 3, None)),
    ("", (chat.APOLOGY, None, 3, None)),
    (None, (chat.APOLOGY, [], 3, None)),
]


@pytest.mark.parametrize("reply,want", REPLIES)
def test_replies(spark, reply, want):
    pages = [(k, f"/p{k}", f"t{k}", "page", None) for k in range(5)]
    df = spark.createDataFrame([(1, "none", pages, reply)], "id int, source string, pages array<struct<place:int,url:string,title:string,content_type:string,main_content:string>>, reply string")
    got = chat.answered(df).first()
    text, links, n, category = want
    assert (got["text"], len(got["suggestions"]), got["category"]) == (text, n, category)
    assert [tuple(x) for x in got["links"]] == ([(f"t{k}", f"/p{k}", "page") for k in range(3)] if links is None else links)


def test_contents_fall_back(spark):
    page = lambda kind, text: [(0, "/u", "t", kind, text)]
    rows = [(1, "quais", page("page", "guardado")), (2, "Quais são", page("page", None)), (3, "oi", page("page", "")), (4, "quais", page("pdf", None)), (5, "quais", []), (6, "quais", page("page", "x" * 4000))]
    df = spark.createDataFrame(rows, "id int, message string, pages array<struct<place:int,url:string,title:string,content_type:string,main_content:string>>")
    got = {r["id"]: (r["source"], r["content"]) for r in chat.contents(df, spark.createDataFrame([("/u", "buscado")], "url string, text string")).collect()}
    assert got[1] == ("stored", "guardado") and got[2] == ("fetched", "buscado") and got[3] == got[4] == got[5] == ("none", None)
    assert got[6] == ("stored", "x" * 3000 + chat.CUT)
