"""Helpers that several corpus operators use: staged tables, let-bindings and distributed running sums."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space between words: blank and the five controls from tab to carriage return.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_own_dir: dict[str, str] = {}
_staged: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in a single-JVM session one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own_dir:
        _own_dir[context.applicationId] = tempfile.mkdtemp(prefix="spark-folio-")
    return _own_dir[context.applicationId]


def staged(df: DataFrame, label: str, a_file: int = 0) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back, which cuts the lineage and survives lost executors.

    A file takes a_file rows at most, if given, for rows so large that Spark should not read thousands of them at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.option("maxRecordsPerFile", a_file) if a_file else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    _staged.append(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Deletes a staged table that no later plan reads."""
    _delete(df.sparkSession, df.staged_path)
    _staged.remove(df.staged_path)


def discard_all(spark: SparkSession) -> int:
    """Deletes all staged tables of this process, once results are written, as plans read them until then; their number."""
    n = len(_staged)
    while _staged:
        _delete(spark, _staged.pop())
    return n


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row, however often body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text as an array; none for a null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


#: Rows of a bucket of a running sum, about; the number of buckets grows with the table.
BUCKET_ROWS = 1 << 18


def running_start(rows: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Adds out: the sum of value over all earlier rows of the row's keys, in the order of columns.

    rows is a staged table with the column part, the partition that wrote a row; keys must not be null. order begins with
    a hash in hexadecimal, of whose first digits buckets are made; rows that are equal in order must be equal in value
    too, and stand by part. A key may hold any share of the rows, and so may equal rows: those of a part count as one in
    the sums of their bucket, so no task sees more than a bucket's different rows or a part's equal ones, and only the
    buckets' totals are put in sequence per key.
    """
    n, digits = rows.count(), 2
    while n > BUCKET_ROWS * 16**digits:
        digits += 1
    same = [*keys, *order, "part"]
    bucket = [*keys, "_bucket"]
    equal = Window.partitionBy(*same)
    numbered = rows.withColumn("_again", F.row_number().over(equal.orderBy(order[0])) - 1).withColumn("_alike", F.count("*").over(equal)).withColumn("_bucket", F.substring(order[0], 1, digits))
    numbered = staged(numbered, "running-numbered")
    first = numbered.filter("_again = 0").withColumn("_sum", F.col("_alike") * F.col(value))
    totals = first.groupBy(*bucket).agg(F.sum("_sum").alias("_total"))
    sequence = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = totals.withColumn("_offset", F.sum("_total").over(sequence) - F.col("_total")).drop("_total")
    inside = Window.partitionBy(*bucket).orderBy(*order, "part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = first.withColumn("_within", F.sum("_sum").over(inside) - F.col("_sum")).join(offsets, bucket).withColumn(out, F.col("_offset") + F.col("_within"))
    columns = [*rows.columns, out]
    if numbered.filter("_again > 0").isEmpty():
        return summed.select(*columns)
    others = numbered.filter("_again > 0").join(summed.select(*same, out), same).withColumn(out, F.col(out) + F.col("_again") * F.col(value))
    return summed.select(*columns).union(others.select(*columns))
