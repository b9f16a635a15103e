"""Reading and writing tables: single-writer copy-on-write Parquet, delimited files of unknown form, exports."""

from __future__ import annotations

import gzip
import io
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What a delimited file is tried as, in order.
ENCODINGS = ("utf-8", "iso-8859-1")  # what the latter reads, windows-1252 does too, but for 27 marks; Spark takes no such charset
SEPARATORS = (",", ";", "\t")


def _files(spark: SparkSession, path: str):
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def versions(spark: SparkSession, path: str) -> list[int]:
    """The finished versions of a table, oldest first."""
    fs, make = _files(spark, path)
    if not fs.exists(make(path)):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(make(path))]
    numbers = [int(n.removeprefix("version=")) for n in names if n.startswith("version=")]
    return sorted(k for k in numbers if fs.exists(make(f"{path}/version={k}/_SUCCESS")))


def current(spark: SparkSession, path: str) -> DataFrame:
    """A table's newest finished version."""
    return spark.read.parquet(f"{path}/version={versions(spark, path)[-1]}")


def rewrite(df: DataFrame, path: str, kept: int = 2) -> int:
    """Writes df, which may have been read from the table, as the table's next version; readers find it once it is finished.

    The last `kept` versions stay, so plans that read the one before go on. Single writer.
    """
    spark = df.sparkSession
    known = versions(spark, path)
    number = known[-1] + 1 if known else 0
    df.write.mode("overwrite").parquet(f"{path}/version={number}")  # what an unfinished write left goes
    fs, make = _files(spark, path)
    for old in [*known, number][:-kept]:
        fs.delete(make(f"{path}/version={old}"), True)
    return number


def delimited(spark: SparkSession, path: str) -> DataFrame:
    """A delimited file as strings: of all encodings and separators, the parse with the most named columns, if it has more than one."""
    best, most = None, 1
    for encoding in ENCODINGS:
        for separator in SEPARATORS:
            df = spark.read.csv(path, header=True, sep=separator, encoding=encoding, mode="DROPMALFORMED", inferSchema=False)
            named = sum(not c.startswith("_c") and bool(c.strip()) and "�" not in c for c in df.columns)
            if named > most:
                best, most = df, named
    return best if best is not None else spark.read.csv(path, header=True, sep=";", encoding="iso-8859-1", mode="DROPMALFORMED")


def tabular(spark: SparkSession, path: str) -> DataFrame:
    """A file of a kind that the engine reads, by its name's end; others are an error."""
    if path.lower().endswith(".csv"):
        return delimited(spark, path)
    raise ValueError(f"can't read {path}: PDF and spreadsheet files need libraries that aren't there")


def sitemap(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """url and lastmod of a sitemap's entries below prefix."""
    rows = spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path)
    return rows.filter(F.trim("loc").startswith(prefix)).select(F.trim("loc").alias("url"), "lastmod")


SITEMAP = "path string, url string, lastmod string, broken boolean"


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The entries of sitemap files, which may be compressed; a file that can't be read is one broken row."""
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            rows = []
            try:
                body = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                for _, e in ElementTree.iterparse(io.BytesIO(body)):
                    if e.tag.rpartition("}")[2] == "url":
                        own = {c.tag.rpartition("}")[2]: c.text for c in e}
                        if own.get("loc"):
                            rows.append((path, own["loc"].strip(), own.get("lastmod"), False))
                        e.clear()
            except (OSError, EOFError, zlib.error, ElementTree.ParseError):
                rows = [(path, None, None, True)]
            yield pd.DataFrame(rows or [(path, None, None, False)], columns=["path", "url", "lastmod", "broken"])


def first_sitemap(spark: SparkSession, candidates: list[str], allowed: str) -> DataFrame:
    """url and lastmod of the entries whose URL holds `allowed`, of the first of the candidates (plain or gzip) that can be read.

    One that is missing, broken or no XML is passed over; one without entries counts. Without any, there are no rows.
    """
    for path in candidates:
        fs, make = _files(spark, path)
        if not fs.exists(make(path)):
            continue
        rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_entries, SITEMAP)
        if rows.filter("broken").isEmpty():
            return rows.filter(F.contains("url", F.lit(allowed))).select("url", "lastmod")
    return spark.createDataFrame([], "url string, lastmod string")


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


#: Documents of a page that are nested in one row of an export; more of them fill further rows.
NESTED = 1000


def tree(pages: DataFrame, documents: DataFrame, most: int = NESTED) -> DataFrame:
    """kind, key, part and json: a collection as nested JSON, level by level from below.

    A `page` row nests its documents, at most `most` a row; a `category` row its subcategories with their numbers of pages
    and documents; the `metadata` row the totals. A page with more documents has more parts, so no row holds a level.
    pages: url, title, category, subcategory, content_type and depth; documents: url (the page's), document_url,
    document_title and document_type. Nulls are written.
    """
    text = lambda *columns: F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json")
    place = F.row_number().over(Window.partitionBy("url").orderBy("document_url", "document_title")) - 1
    parts = documents.filter("url IS NOT NULL").withColumn("part", F.floor(place / most).cast("int")).groupBy("url", "part").agg(F.array_sort(F.collect_list(F.struct("document_url", "document_title", "document_type"))).alias("documents"))
    none = F.array().cast("array<struct<document_url:string,document_title:string,document_type:string>>")
    nested = pages.join(parts, "url", "left").withColumns({"part": F.coalesce("part", F.lit(0)), "documents": F.coalesce("documents", none)})
    of_pages = nested.select(F.lit("page").alias("kind"), F.col("url").alias("key"), "part", text("url", "title", "category", "subcategory", "content_type", "depth", "documents"))
    leaves = nested.groupBy("category", "subcategory").agg(F.count_if(F.col("part") == 0).alias("pages"), F.sum(F.size("documents")).cast("long").alias("documents"))
    below = F.array_sort(F.collect_list(F.struct("subcategory", "pages", "documents"))).alias("subcategories")
    totals = [F.sum("pages").alias("pages"), F.sum("documents").alias("documents")]
    categories = leaves.groupBy("category").agg(*totals, below)
    of_categories = categories.select(F.lit("category"), "category", F.lit(0), text("category", "pages", "documents", "subcategories"))
    whole = leaves.agg(F.count_distinct("category").alias("categories"), *(F.coalesce(x, F.lit(0)).alias(n) for x, n in zip(totals, ("pages", "documents"))))
    return of_pages.unionByName(of_categories.toDF("kind", "key", "part", "json")).unionByName(whole.select(F.lit("metadata"), F.lit("all"), F.lit(0), text("categories", "pages", "documents")).toDF("kind", "key", "part", "json"))


def export_tree(pages: DataFrame, documents: DataFrame, path: str) -> None:
    """Writes a collection's tree as JSON lines, a folder for each kind of row."""
    tree(pages, documents).select("kind", F.col("json").alias("value")).write.mode("overwrite").partitionBy("kind").text(path)


def crawl_order(edges: DataFrame, roots: DataFrame, deepest: int = 7) -> DataFrame:
    """url and depth of all pages that links (source, target) lead to from roots (url): one frontier join a level.

    With a checkpoint folder each level is written there, so plans stay short; levels end when nothing new is found.
    """
    spark = edges.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        spark.sparkContext.setCheckpointDir(folder)
    cut = lambda df: df.checkpoint() if folder else df
    frontier = seen = cut(roots.select("url").distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, deepest + 1):
        found = edges.join(frontier, F.col("source") == F.col("url"), "left_semi").select(F.col("target").alias("url")).distinct()
        frontier = cut(found.join(seen, "url", "left_anti").withColumn("depth", F.lit(depth)))
        seen = cut(seen.union(frontier))
        if folder and frontier.isEmpty():
            break
    return seen


#: Pages of a crawl, at most.
MOST_PAGES = 500


def crawl_first(edges: DataFrame, roots: DataFrame, most: int = MOST_PAGES, deepest: int = 7) -> DataFrame:
    """url, depth and place (from 0) of the first `most` pages that a breadth-first crawl visits.

    edges are source, target and position (of a link in its page); roots url and position. Pages of a level are visited in
    the order of the page that names them first, then of its link; a level that would pass the limit is cut there. A level
    is one join with the links and a bounded top, so what is kept is never more than `most` pages, ties by URL.
    """
    spark = edges.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        spark.sparkContext.setCheckpointDir(folder)
    cut = lambda df: df.checkpoint() if folder else df.cache()

    def visited(found: DataFrame, depth: int, n: int) -> DataFrame:
        """The first of found (url, first) that fit, with places from n on."""
        kept = found.orderBy("first", "url").limit(most - n)
        place = F.row_number().over(Window.orderBy("first", "url")) - 1 + n  # of `most` rows at most
        return cut(kept.select("url", F.lit(depth).alias("depth"), place.cast("int").alias("place")))

    level = seen = visited(roots.filter("url IS NOT NULL").groupBy("url").agg(F.min("position").alias("first")), 0, 0)
    n = seen.count()
    for depth in range(1, deepest + 1):
        if n >= most:
            break
        named = edges.join(F.broadcast(level), F.col("source") == F.col("url")).select(F.col("target").alias("url"), F.struct("place", "position").alias("first"))
        found = named.filter("url IS NOT NULL").groupBy("url").agg(F.min("first").alias("first")).join(F.broadcast(seen.select("url")), "url", "left_anti")
        level = visited(found, depth, n)
        if level.isEmpty():
            break
        seen = cut(seen.union(level))
        n = seen.count()
    return seen
