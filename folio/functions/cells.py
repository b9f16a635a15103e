"""Functions over cells and rows of tables that are stored in a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.core import bind

# First cells of rows that sum others, and headers of columns that can be summed.
TOTAL_LABELS = ("TOTAL", "SUBTOTAL", "GRAND TOTAL", "TOTAIS", "TOTAL GERAL")
REPAIR_LABELS = ("TOTAL", "SUBTOTAL", "TOTAL GERAL")
MONEY_HEADERS = ("valor", "value", "total", "preço", "preco", "montante", "custo")


def number(cell: Column) -> Column:
    """The number in a cell as decimal(38,6), or null: 1.234,56 and 1234.56; the sign is lost, 001/2025 is 1."""
    found = F.regexp_extract(F.regexp_replace(F.trim(cell), r"^[R$]+", ""), r"([0-9.,]+)", 1)
    plain = F.when(found.contains(","), F.replace(F.replace(found, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(found)
    return plain.try_cast("decimal(38,6)")


def brl(amount: Column) -> Column:
    """1.234,56 of a decimal, half-even."""
    return F.translate(F.format_number(F.bround(amount, 2), 2), ",.", ".,")


def is_total(row: Column, labels=TOTAL_LABELS) -> Column:
    return F.coalesce(F.upper(F.trim(F.get(row, F.lit(0)))).isin(*labels), F.lit(False))


def column_index(headers: Column, name: str) -> Column:
    """Place of a header from 0, whatever its case; null if there is none."""
    at = F.array_position(F.transform(headers, lambda h: F.lower(F.trim(h))), name.lower())
    return F.when(at > 0, (at - 1).cast("int"))


def matches(cell: Column, op: str, value: str) -> Column:
    """eq neq gt gte lt lte contains startswith; by number if both are numbers, else eq and neq by text without case."""
    text, wanted = F.lower(F.trim(cell)), F.lit(value.strip().lower())
    if op == "contains":
        return text.contains(wanted)
    if op == "startswith":
        return text.startswith(wanted)
    a, b = number(cell), number(F.lit(value))
    by_number = {"eq": a == b, "neq": a != b, "gt": a > b, "gte": a >= b, "lt": a < b, "lte": a <= b}[op]
    by_text = {"eq": text == wanted, "neq": text != wanted}.get(op, F.lit(False))
    return F.when(a.isNotNull() & b.isNotNull(), by_number).otherwise(by_text)


def body_rows(rows: Column, labels=TOTAL_LABELS) -> Column:
    return F.filter(rows, lambda r: ~is_total(r, labels))


def filter_rows(rows: Column, at: Column, op: str, value: str) -> Column:
    """Rows whose cell matches; rows that are too short are left out."""
    return F.filter(rows, lambda r: F.coalesce(matches(F.get(r, at), op, value), F.lit(False)))


def count_rows(rows: Column, at: Column | None = None, value: str | None = None) -> Column:
    """Rows that aren't totals, of which a cell equals value without case if one is given."""
    body = body_rows(rows)
    if value is None:
        return F.size(body)
    return F.size(F.filter(body, lambda r: F.coalesce(F.lower(F.trim(F.get(r, at))) == value.strip().lower(), F.lit(False))))


def sum_column(rows: Column, at: Column, labels=TOTAL_LABELS) -> Column:
    zero = F.lit(0).cast("decimal(38,6)")
    return F.aggregate(body_rows(rows, labels), zero, lambda acc, r: (acc + F.coalesce(number(F.get(r, at)), zero)).cast("decimal(38,6)"))


def sort_rows(rows: Column, at: Column, descending: bool = False) -> Column:
    """Numbers before texts, each in order, input order among equals; descending turns classes and values round."""
    keyed = F.transform(
        rows,
        lambda r, i: bind(
            number(F.get(r, at)),
            lambda n: F.struct(
                (n.isNull() if not descending else n.isNotNull()).alias("c"),
                (F.coalesce(n, F.lit(0).cast("decimal(38,6)")) * (-1 if descending else 1)).alias("n"),
                F.when(n.isNull(), F.lower(F.get(r, at))).otherwise(F.lit("")).alias("t"),
                i.alias("i"),
                r.alias("r"),
            ),
        ),
    )
    if not descending:
        return F.transform(F.array_sort(keyed), lambda s: s["r"])
    order = lambda a, b: (
        F.when(a["c"] != b["c"], F.when(a["c"], 1).otherwise(-1)).when(a["n"] != b["n"], F.when(a["n"] < b["n"], -1).otherwise(1)).when(a["t"] != b["t"], F.when(a["t"] > b["t"], -1).otherwise(1)).otherwise(F.when(a["i"] < b["i"], -1).otherwise(1))
    )
    return F.transform(F.array_sort(keyed, order), lambda s: s["r"])


def extract_value(rows: Column, find_at: Column, value: str, take_at: Column) -> Column:
    """The cell at take_at of the first row whose cell at find_at contains value."""
    hit = F.filter(rows, lambda r: F.coalesce(F.lower(F.get(r, find_at)).contains(value.lower()), F.lit(False)))
    return F.get(F.get(hit, F.lit(0)), take_at)


def total_row(headers: Column, rows: Column) -> Column:
    """The sum under each header of money whose column holds a number, TOTAL in the first cell unless that is one; null if there is none."""
    money = lambda h: F.exists(F.array(*map(F.lit, MONEY_HEADERS)), lambda w: F.lower(h).contains(w))
    known = lambda i: F.exists(body_rows(rows), lambda r: number(F.get(r, i)).isNotNull())
    sums = F.transform(headers, lambda h, i: F.when(money(h) & known(i), F.concat(F.lit("R$ "), brl(sum_column(rows, i)))))
    row = lambda s: F.transform(s, lambda x, i: F.coalesce(x, F.when(i == 0, "TOTAL").otherwise("")))
    return bind(sums, lambda s: F.when(F.exists(s, lambda x: x.isNotNull()), row(s)))


def verdict(headers: Column, rows: Column) -> Column:
    """Why a table can't be used (single_column, raw_separators_in_headers, all_rows_empty, corrupted_cells, all_rows_identical), or ok."""
    cells = F.flatten(rows)
    corrupt = F.size(F.filter(cells, lambda c: c.rlike(r"^;{3,}|^\|{3,}|^\[.+\]$")))
    return (
        F.when(F.size(headers) <= 1, F.lit("single_column"))
        .when(F.exists(headers, lambda h: h.contains(";") | h.contains("|||")), F.lit("raw_separators_in_headers"))
        .when(F.forall(cells, lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""), F.lit("all_rows_empty"))
        .when(corrupt > F.lit(0.3) * F.size(cells), F.lit("corrupted_cells"))
        .when((F.size(rows) > 3) & (F.size(F.array_distinct(rows)) == 1), F.lit("all_rows_identical"))
        .otherwise(F.lit("ok"))
    )
