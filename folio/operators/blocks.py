"""Semantic chunks: blocks of plain text or HTML told apart as headings, tables, lists and paragraphs, and packed.

A heading names the section of what follows; a table is a chunk of its own; paragraphs and lists join up to MOST tokens
and carry the section of their last block; a chunk of fewer than LEAST tokens joins the one before it if both fit.
Packing is a state machine over a document's blocks, so it runs in Python, a document at a time inside batches; Spark
spreads the documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

from folio.functions.html import Element, parsed

# Limits in tokens, of headings and of tables, and what a heading and a sentence's end look like.
MOST, LEAST = 800, 100
LIST_MOST = 300
HEADING_WORDS, HEADING_CHARS = 12, 80
SHORTEST_PARAGRAPH = 20
TABLE_ROWS = 50
TABLE_CUT = "... (tabela truncada)"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÁÉÍÓÚÂÊÎÔÛÀÃÕÇ"
_SENTENCE = re.compile(r"(?<=[.!?…])\s+")
CHUNK = "chunk_index int, section_title string, chunk_text string, token_count int, has_table boolean"

# Elements that are left out, and those whose children are read; "" is a page without body.
HIDDEN = {"script", "style", "nav", "head", "footer"}
OPENED = {"div", "section", "article", "main", "body", "span", "td", "li", "html", ""}


class Block(NamedTuple):
    text: str
    section: str | None
    table: bool = False


def tokens(text: str) -> int:
    return max(1, int(len(text.split()) * 1.3))


# --- plain text ------------------------------------------------------------------------------------------------------


def is_heading(block: str) -> bool:
    """One line of at most 12 words and 80 characters that begins with a capital or digit and holds no sentence mark."""
    line = block.strip()
    if not line or len(line.splitlines()) != 1 or len(line) > HEADING_CHARS or len(line.split()) > HEADING_WORDS:
        return False
    return (line[0] in _CAPITALS or line[0].isdecimal()) and line[-1] not in ":,;" and not any(c in ".!?" for c in line[1:])


def is_table(block: str) -> bool:
    """More than half of the lines, and two at least, hold a bar."""
    lines = block.splitlines()
    barred = sum("|" in x for x in lines)
    return barred >= 2 and 2 * barred > len(lines)


def _labelled(breadcrumb: str | None, heading: str) -> str:
    return f"{breadcrumb} > {heading}" if breadcrumb else heading


def text_blocks(text: str | None, breadcrumb: str | None = None) -> Iterator[Block]:
    section = breadcrumb
    for block in re.split(r"\n\s*\n", (text or "").strip()):
        block = block.strip()
        if is_heading(block):
            section = _labelled(breadcrumb, block)
        elif block:
            yield Block(block, section, is_table(block))


# --- HTML ------------------------------------------------------------------------------------------------------------


def _table_text(table: Element) -> str:
    rows = []
    for row in table.below(HIDDEN):
        if row.tag != "tr":
            continue
        cells = [c.text(hidden=HIDDEN) for c in row.below(HIDDEN) if c.tag in ("td", "th")]
        if cells:
            rows.append(" | ".join(cells))
        if len(rows) == TABLE_ROWS:
            rows.append(TABLE_CUT)
            break
    return "\n".join(rows)


def html_blocks(html: str | None, breadcrumb: str | None = None) -> Iterator[Block]:
    """Blocks of the body of a page, of the whole page if it has none."""
    root = parsed(html)
    headings: list[str] = []
    waiting = [next((e for e in root.below(HIDDEN) if e.tag == "body"), root)]
    while waiting:
        node = waiting.pop()
        tag, section = node.tag, _labelled(breadcrumb, headings[-1]) if headings else breadcrumb
        inner = [c for c in node.children if isinstance(c, Element) and c.tag not in HIDDEN]
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            if title := node.text(hidden=HIDDEN):
                headings = [*headings[: int(tag[1]) - 1], title]
        elif tag == "p":
            if len(text := node.text(hidden=HIDDEN)) > SHORTEST_PARAGRAPH:
                yield Block(text, section)
        elif tag == "table":
            if text := _table_text(node):
                yield Block(text, section, True)
        elif tag in ("ul", "ol"):
            items = [f"• {x}" for c in inner if c.tag == "li" and (x := c.text(hidden=HIDDEN))]
            whole = "\n".join(items)
            yield from (Block(x, section) for x in ([whole] if tokens(whole) <= LIST_MOST else items))
        elif tag in OPENED:
            waiting += reversed(inner)


# --- packing ---------------------------------------------------------------------------------------------------------


def _lines(text: str, most: int) -> Iterator[str]:
    """A table's lines joined up to most tokens."""
    held: list[str] = []
    for line in text.splitlines():
        if held and tokens("\n".join([*held, line])) > most:
            yield "\n".join(held)
            held = []
        held.append(line)
    yield "\n".join(held)


def _sentences(text: str) -> list[str]:
    """The sentences of a long block, or its halves if it is one."""
    parts = [p.strip() for p in _SENTENCE.split(text) if p.strip()]
    words = text.split()
    return parts if len(parts) > 1 else [" ".join(words[: len(words) // 2]), " ".join(words[len(words) // 2 :])]


def packed(blocks: Iterator[Block], most: int = MOST) -> Iterator[Block]:
    held: Block | None = None
    for block in blocks:
        joined = f"{held.text}\n\n{block.text}" if held and not block.table else block.text
        if not block.table and tokens(joined) <= most:
            held = Block(joined, block.section)
            continue
        if held:
            yield held
        held = None
        if tokens(block.text) <= most and not block.table:
            held = block
        elif block.table:
            yield from (Block(part, block.section, True) for part in (_lines(block.text, most) if tokens(block.text) > most else [block.text]))
        else:
            yield from (Block(part, block.section) for part in _sentences(block.text) if part)
    if held:
        yield held


def chunks(blocks: Iterator[Block], most: int = MOST, least: int = LEAST) -> list[tuple[int, str | None, str, int, bool]]:
    """(index, section, text, tokens, holds a table) of each chunk."""
    out: list[Block] = []
    for block in packed(blocks, most):
        if out and tokens(block.text) < least and tokens(out[-1].text) + tokens(block.text) <= most:
            out[-1] = Block(f"{out[-1].text}\n\n{block.text}", out[-1].section, out[-1].table or block.table)
        else:
            out.append(block)
    return [(k, b.section, b.text, tokens(b.text), b.table) for k, b in enumerate(out)]


def semantic_chunks(df: DataFrame, key: str, text: str, html: bool = False, breadcrumb: str | None = None, most: int = MOST, least: int = LEAST) -> DataFrame:
    """key and the chunks of each text or page; breadcrumb names the column with the path of a page."""
    cut = html_blocks if html else text_blocks

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *c) for k, t, b in zip(batch["key"], batch["text"], batch["breadcrumb"]) for c in chunks(cut(t, b), most, least)]
            yield pd.DataFrame(rows, columns=[key, "chunk_index", "section_title", "chunk_text", "token_count", "has_table"])

    slim = df.selectExpr(f"`{key}` AS key", f"`{text}` AS text", f"`{breadcrumb}` AS breadcrumb" if breadcrumb else "CAST(NULL AS STRING) AS breadcrumb")
    return slim.mapInPandas(run, f"`{key}` {slim.schema['key'].dataType.simpleString()}, {CHUNK}")
