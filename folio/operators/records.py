"""Keeping records: copy-on-write upserts, replacements, deletions, and the states of documents and audit records.

Every function takes DataFrames and returns the table's new content; `folio.sources.store` writes it in one step.
Keys that come twice in new rows must be told apart by the caller (`latest`). Rows whose key is null match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row a key, the first by order."""
    first = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_n", first).filter("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """new, and the old rows of other keys."""
    return new.unionByName(old.join(new.select(*key), key, "left_anti"))


def insert_missing(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old, and the new rows of keys that it lacks, one a key."""
    return old.unionByName(new.join(old.select(*key), key, "left_anti").dropDuplicates(key))


def merge(old: DataFrame, new: DataFrame, key: list[str], change: dict[str, Column]) -> DataFrame:
    """Upsert in which columns of rows that both hold are computed from stored.* and fresh.*; other columns of theirs stay stored."""
    both = old.alias("stored").join(new.alias("fresh"), key, "full_outer")
    in_both = F.col(f"stored.{key[0]}").isNotNull() & F.col(f"fresh.{key[0]}").isNotNull()
    rest = [F.when(in_both, change.get(c, F.col(f"stored.{c}"))).otherwise(F.coalesce(F.col(f"stored.{c}"), F.col(f"fresh.{c}"))).alias(c) for c in old.columns if c not in key]
    return both.select(*key, *rest).select(*old.columns)


def replace_all(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """All old rows of the keys that new holds go, and all of new's rows come."""
    return upsert(old, new, key)


def upsert_with_children(old: dict[str, DataFrame], new: dict[str, DataFrame], key: str, owner: str) -> dict[str, DataFrame]:
    """Tables after an upsert of parents: the table owner by key; of every other table (children by the parent's key) the rows of
    parents that come anew are replaced by the new ones."""
    fresh = new[owner].select(key)
    out = {owner: upsert(old[owner], new[owner], [key])}
    for name in old.keys() - {owner}:
        kept = old[name].join(fresh, key, "left_anti")
        out[name] = kept.unionByName(new[name]) if name in new else kept
    return out


def delete_with_children(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """All tables without the rows of the keys that go, parents and children alike."""
    return {name: delete(df, gone, [key]) for name, df in tables.items()}


def delete(old: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return old.join(gone.select(*key), key, "left_anti")


def orphans(rows: DataFrame, owners: DataFrame, key: str, owner_key: str) -> DataFrame:
    """Rows without an owner."""
    return rows.join(owners.select(F.col(owner_key).alias(key)), key, "left_anti")


def summary_by(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """Counts, oldest open and last check by each dimension on its own, in one pass over the rows."""
    values = F.explode(F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in dimensions))).alias("x")
    long = rows.select(values, "status", "detected_at", "last_checked_at")
    return long.groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"), F.min(F.when(F.col("status") == "open", F.col("detected_at"))).alias("oldest_open"), F.max("last_checked_at").alias("last_check"))


def probe_outcome(kind: Column, status: Column) -> Column:
    """What a check of a resource found: healthy, or the severity of its failure by kind of resource."""
    ok = (status >= 200) & (status < 400)
    page = F.when(status >= 500, "critical").otherwise("warning")
    document = F.when(status >= 500, "warning").otherwise("critical")
    return F.when(ok, "healthy").when(kind == "page", page).when(kind == "document", document).otherwise("warning")


def failure_kind(status: Column, message: Column) -> Column:
    """Kind and severity of an ingestion's failure."""
    low = F.lower(F.coalesce(message, F.lit("")))
    answer = lambda kind, severity: F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"))
    return (
        F.when(status == 404, answer("document_not_found", "critical"))
        .when(status >= 400, answer("http_error", "warning"))
        .when(low.contains("size"), answer("oversized", "info"))
        .when(low.contains("encod") | low.contains("decod"), answer("encoding_error", "warning"))
        .otherwise(answer("document_corrupted", "critical"))
    )


def ingested(documents: DataFrame, chunks: Column, status: Column, message: Column) -> DataFrame:
    """The next state of each document: done, or error with kind and severity; documents without chunks are errors too."""
    failed = (status >= 400) | message.isNotNull()
    outcome = F.when(failed, failure_kind(status, message)).when(chunks == 0, F.struct(F.lit("empty_content").alias("kind"), F.lit("critical").alias("severity")))
    return documents.withColumn("_o", outcome).withColumns({"next_status": F.when(F.col("_o").isNull(), "done").otherwise("error"), "kind": F.col("_o.kind"), "severity": F.col("_o.severity")}).drop("_o")


def saved_messages(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """sessions (session_id, message_count, last_active, title) after messages (session_id, sent, text) were saved; new ones are created."""
    new = messages.groupBy("session_id").agg(F.count("*").alias("n"), F.max("sent").alias("sent"), F.min_by(F.substring("text", 1, 60), "sent").alias("first"))
    return sessions.join(new, "session_id", "full_outer").select(
        "session_id",
        (F.coalesce("message_count", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("message_count"),
        F.greatest("last_active", "sent").alias("last_active"),
        F.coalesce("title", "first").alias("title"),
    )


def cascade(parts: dict[str, DataFrame], bad: DataFrame, key: str = "id") -> dict[str, DataFrame]:
    """Each part (chunks, tables, contents, by name) without the rows whose key is bad; bad is taken once, before anything goes.

    Rows with a null key stay, as they belong to nothing that is bad.
    """
    gone = bad.select(key).distinct()
    return {name: df.join(gone, key, "left_anti") for name, df in parts.items()}
