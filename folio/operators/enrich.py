"""Entities in texts, and relations between pages that share them or link to each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.core import bind

# Kinds of entities and their patterns, in order.
PATTERNS = (
    ("date_range", r"\b\d{2}/\d{2}/\d{4}\b"),
    ("date_range", r"(?i)\bexerc[íi]cio\s+\d{4}\b"),
    ("date_range", r"(?i)\b\d{1,2}[°º]\s*semestre(?:\s+de)?\s+\d{4}\b"),
    ("monetary_value", r"R\$\s?[\d.,]{3,}"),
    ("monetary_value", r"(?i)\b\d+[\d.,]*\s*(?:mil|milh[õo]es|bilh[õo]es)\b"),
    ("process_number", r"\b\d{7}-\d{2}\.\d{4}\.\d\.\d{2}\.\d{4}\b"),
    ("contract_number", r"(?i)\bContrato\s+n[°º]?\.?\s*[\d.]+/\d{4}\b"),
    ("pregao", r"(?i)\bPreg[ãa]o\s+(?:Eletr[ôo]nico|Presencial)\s+n[°º]?\.?\s*[\d.]+/\d{4}\b"),
    ("cpf_cnpj", r"\b\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}\b"),
)
# What a shared entity makes of two pages; other kinds give a reference.
RELATION_OF = {"contract": "origina", "pregao": "origina", "process": "referencia"}
# Tags that a page may have.
TAGS = (
    "licitacao contrato convenio diaria passagem folha_pagamento relatorio_gestao orcamento receita despesa patrimonio "
    "prestacao_contas auditoria ata resolucao portaria"
).split()
FILES = (".pdf", ".csv", ".xls", ".xlsx")


def entities(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, entity_type, entity_value: each type and value (whatever its case) once a row, as first found. No shuffle."""

    def of(kind: str, pattern: str) -> Column:
        value = lambda m: F.regexp_replace(F.trim(m), r"[.,;:]+$", "")
        return F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)), lambda m: F.struct(F.lit(kind).alias("entity_type"), value(m).alias("entity_value")))

    def once(found: Column) -> Column:
        names = F.transform(found, lambda x: F.concat_ws("|", x["entity_type"], F.lower(x["entity_value"])))
        return bind(names, lambda n: F.filter(found, lambda x, i: F.array_position(n, F.get(n, i)) == i + 1))

    found = bind(F.flatten(F.array(*(of(kind, p) for kind, p in PATTERNS))), once)
    return df.select(key, F.explode(found).alias("e")).select(key, "e.*")


def _relation() -> Column:
    kind = F.lit("referencia")
    for name, relation in RELATION_OF.items():
        kind = F.when(F.col("entity_type") == name, relation).otherwise(kind)
    return kind


def groups(entity_rows: DataFrame, key: str = "id") -> DataFrame:
    """entity_type, entity_value, n, first, second: number of pages of each entity and the two smallest keys.

    Both are aggregated before the shuffle, so an entity that most pages hold costs no more than another.
    """
    entity = ["entity_type", "entity_value"]
    place = F.row_number().over(Window.partitionBy(*entity).orderBy(key))
    ends = entity_rows.withColumn("_n", place).filter("_n <= 2").groupBy(*entity).agg(F.min(key).alias("first"), F.max(key).alias("second"))
    return entity_rows.groupBy(*entity).agg(F.count("*").alias("n")).join(ends, entity)


def peers(entity_rows: DataFrame, key: str = "id") -> DataFrame:
    """key, entity_type, entity_value, n_peers, first_peer for each page that shares an entity with others."""
    shared = groups(entity_rows, key).filter("n > 1")
    other = F.when(F.col(key) == F.col("first"), F.col("second")).otherwise(F.col("first"))
    return entity_rows.join(shared, ["entity_type", "entity_value"]).select(key, "entity_type", "entity_value", (F.col("n") - 1).alias("n_peers"), other.alias("first_peer"))


def entity_relations(entity_rows: DataFrame, key: str = "id") -> DataFrame:
    """Edges between pages that share an entity, with the relation that its kind makes and confidence 0.9.

    The pages of an entity form a star around that of the smallest key: as many edges as pages, in place of all pairs;
    two pages are related by an entity if both are its hub or have an edge to it. `relations_of` gives a page's own.
    """
    rows = peers(entity_rows, key).join(groups(entity_rows, key).select("entity_type", "entity_value", F.col("first").alias("hub")), ["entity_type", "entity_value"])
    return rows.filter(F.col(key) != F.col("hub")).select(F.col(key).alias("source_id"), F.col("hub").alias("target_id"), _relation().alias("relation_type"), F.col("entity_value").alias("entity_key"), F.lit(0.9).alias("confidence")).distinct()


def relation_counts(entity_rows: DataFrame, key: str = "id") -> DataFrame:
    """relation_type, n: pairs of pages in either direction, counted by entity. A value is of one type, as patterns exclude each other."""
    pairs = groups(entity_rows, key).filter("n > 1").select(_relation().alias("relation_type"), (F.col("n") * (F.col("n") - 1)).alias("pairs"))
    return pairs.groupBy("relation_type").agg(F.sum("pairs").alias("n"))


def counts_by_strategy(entity_rows: DataFrame, link_rows: DataFrame, key: str = "id") -> DataFrame:
    """strategy, relation_type and n: relations that entities make, counted by entity, and those of links (relation_type)."""
    by_entity = relation_counts(entity_rows, key).select(F.lit("entity").alias("strategy"), "relation_type", F.col("n").cast("long").alias("n"))
    by_link = link_rows.groupBy("relation_type").agg(F.count("*").alias("n")).select(F.lit("link").alias("strategy"), "relation_type", "n")
    return by_entity.unionByName(by_link)


def relations_of(entity_rows: DataFrame, page: int, key: str = "id") -> DataFrame:
    """The edges of one page, in both directions: the page's few entities first, then the pages that hold them."""
    own = entity_rows.filter(F.col(key) == page).select("entity_type", "entity_value").distinct()
    others = entity_rows.filter(F.col(key) != page).join(F.broadcast(own), ["entity_type", "entity_value"])  # own: the entities of one page
    ends = F.array(F.struct(F.lit(page).alias("source_id"), F.col(key).alias("target_id")), F.struct(F.col(key).alias("source_id"), F.lit(page).alias("target_id")))
    edges = others.select(F.explode(ends).alias("e"), _relation().alias("relation_type"), F.col("entity_value").alias("entity_key"), F.lit(0.9).alias("confidence"))
    return edges.select("e.*", "relation_type", "entity_key", "confidence").distinct()


def is_internal_page(url: Column, domain: str) -> Column:
    """A link to a page of the domain or below the root, not to a file."""
    low = F.lower(url)
    a_file = F.lit(False)
    for end in FILES:
        a_file = a_file | low.endswith(end)
    host = F.regexp_extract(url, r"^[a-z]+://([^/?#]*)", 1)
    return ~a_file & (host.contains(domain) | url.startswith("/"))


def related(entity_rows: DataFrame, page: int, k: int = 10, kinds: list[str] | None = None) -> DataFrame:
    """Edges of a page in either direction, surest first; of some kinds of relation if they are given."""
    edges = relations_of(entity_rows, page)
    if kinds is not None:
        edges = edges.filter(F.col("relation_type").isin(kinds))
    return edges.orderBy(F.desc("confidence"), "source_id", "target_id", "relation_type", "entity_key").limit(k)


def valid_tags(tags: Column) -> Column:
    return F.filter(tags, lambda x: x.isin(*TAGS))
