"""Tables in Markdown and HTML: conversion, parsing, building and splitting under a token limit."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from longleaf.functions.text import once

Table = tuple[list[str], list[list[str]]]
_CJK = re.compile("[一-鿿]")
#: Characters that a cell keeps when it is cut, and columns that a wide table's parts take beside the first.
CELL, BESIDE = 200, (4, 3, 2, 1)


def tokens(text: str) -> int:
    """Estimate for mixed text, as the column function of the same rule."""
    cjk = 0 if text.isascii() else len(_CJK.findall(text))
    return int(cjk / 1.8 + (len(text) - cjk) / 4.0) + 1


def html_rows(c: Column) -> Column:
    """Rows of cells of an HTML table: tags inside cells go, white space is one blank, a cell that spans columns is repeated."""
    rows = F.regexp_extract_all(c, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))

    def cells(row: Column) -> Column:
        whole = F.regexp_extract_all(row, F.lit(r"(?is)<(?:td|th)\b[^>]*>.*?</(?:td|th)>"), F.lit(0))
        text = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"(?s)<[^>]+>", ""), r"(?U)\s+", " "))
        span = lambda x: F.greatest(F.lit(1), F.coalesce(F.nullif(F.regexp_extract(x, r"(?i)colspan\s*=\s*[\"']?(\d{1,4})", 1), F.lit("")).cast("int"), F.lit(1)))
        return F.flatten(F.transform(whole, lambda x: F.array_repeat(text(x), span(x))))

    return F.filter(F.transform(rows, cells), lambda r: F.size(r) > 0)


def html_to_markdown(c: Column) -> Column:
    """Markdown of an HTML table, all rows as wide as the widest; null without rows."""
    rule = lambda width: F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))

    def markdown(rows: Column, width: Column) -> Column:
        lines = F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |")))
        return once(lines, lambda x: F.array_join(F.concat(F.slice(x, 1, 1), F.array(rule(width)), F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0)))), "\n"))

    def whole(rows: Column) -> Column:
        return F.when(F.size(rows) > 0, once(F.array_max(F.transform(rows, lambda r: F.size(r))), lambda width: markdown(rows, width)))

    return once(html_rows(c), whole)


def parse(text: str) -> Table:
    """Header and rows of a Markdown table; empty cells are left out."""
    lines = [[c.strip() for c in line.split("|") if c.strip()] for line in text.splitlines() if "|" in line and not re.fullmatch(r"[\s|:-]+", line)]
    return (lines[0], lines[1:]) if lines else ([], [])


def build(header: list[str], rows: list[list[str]]) -> str:
    """Markdown of a table; rows are cut or filled to the header's width."""
    n = len(header)
    fit = [(r + [""] * n)[:n] for r in rows]
    return "\n".join("| " + " | ".join(r) + " |" for r in [header, ["---"] * n, *fit])


def _batches(header: list[str], rows: list[list[str]], limit: int) -> list[list[list[str]]]:
    """Rows, in order, in batches whose estimates, with the header's, sum to at most the limit (a larger row alone)."""
    empty = tokens(build(header, []))
    out: list[list[list[str]]] = []
    used = empty
    for r in rows:
        n = tokens(build(header, [r])) - empty
        if not out or used + n > limit:
            out.append([])
            used = empty
        out[-1].append(r)
        used += n
    return out


def _hard(text: str, limit: int) -> list[str]:
    n = max(1, int(limit / 1.5))
    return [text[i : i + n] for i in range(0, len(text), n)]


def split_tall(text: str, limit: int) -> list[str]:
    """Parts of a table under the limit: by rows; rows too large by columns if there are many, else with cells cut."""
    header, rows = parse(text)
    if not header or not rows:
        return _hard(text, limit)
    out: list[str] = []
    for batch in _batches(header, rows, limit):
        part = build(header, batch)
        if tokens(part) <= limit:
            out.append(part)
        elif len(header) > 3:
            out += split_wide(part, limit)
        else:
            out.append(cut_cells(part, limit))
    return out


def _groups(header: list[str], first: list[str], limit: int) -> Iterator[list[int]]:
    """Columns 1, 2, ... in groups, each as large as BESIDE has it and as the first row, beside column 0, allows."""
    at = 1
    while at < len(header):
        for n in BESIDE:
            columns = [0, *range(at, min(at + n, len(header)))]
            if n == BESIDE[-1] or tokens(build([header[c] for c in columns], [[first[c] for c in columns]])) <= limit:
                yield columns
                at += n
                break


def split_wide(text: str, limit: int) -> list[str]:
    """Parts of a table by groups of columns, each beside the first column; numbered through where there are several."""
    header, rows = parse(text)
    if len(header) < 2 or not rows:
        return [cut_cells(text, limit)]
    rows = [(r + [""] * len(header))[: len(header)] for r in rows]
    parts: list[tuple[list[str], list[list[str]]]] = []
    groups = list(_groups(header, rows[0], limit))
    for columns in groups:
        head = [header[c] for c in columns]
        parts += [(head, batch) for batch in _batches(head, [[r[c] for c in columns] for r in rows], limit)]
    out = []
    for k, (head, batch) in enumerate(parts, 1):
        label = f"[表 {k}]\n" if len(groups) > 1 or len(batch) < len(rows) else ""
        part = build(head, batch)
        out.append(label + (part if tokens(label + part) <= limit else cut_cells(part, limit - (tokens(label) if label else 1))))
    return out


def cut_cells(text: str, limit: int) -> str:
    """The table's lines up to the limit; the line that passes it stays, with its long cells cut, if it fits then.  The header always stays."""
    lines = text.split("\n")
    kept = lines[:2]
    if tokens(text) <= limit:
        return text
    for line in lines[2:]:
        if tokens("\n".join([*kept, line])) > limit:
            line = "| " + " | ".join(c[:CELL] + "..." * (len(c) > CELL) for c in map(str.strip, line.split("|"))) + " |"
            if tokens("\n".join([*kept, line])) > limit:
                break
        kept.append(line)
    return "\n".join(kept)


def rows_to_markdown(html: str) -> str:
    """Markdown of an HTML table, for code that works on single documents."""
    rows = []
    for row in re.findall(r"(?is)<tr\b[^>]*>(.*?)</tr>", html):
        cells: list[str] = []
        for mark, inside in re.findall(r"(?is)<(?:td|th)\b([^>]*)>(.*?)</(?:td|th)>", row):
            span = re.search(r"(?i)colspan\s*=\s*[\"']?(\d{1,4})", mark)
            cells += [" ".join(re.sub(r"<[^>]+>", "", inside).split())] * max(1, int(span[1]) if span else 1)
        if cells:
            rows.append(cells)
    width = max(map(len, rows), default=0)
    return build((rows[0] + [""] * width)[:width], rows[1:]) if rows else ""


def pieces(text: str) -> tuple[list[str], list[str]]:
    """Paragraphs of a section, with each table as one (HTML ones as Markdown), and its image links."""
    images = re.findall(r"!\[[^\]]*\]\([^)]*\)", text)
    text = re.sub(r"!\[[^\]]*\]\([^)]*\)", "", text)
    text = re.sub(r"(?is)<table>.*?</table>", lambda m: f"\n\n{rows_to_markdown(m[0])}\n\n", text)
    out: list[str] = []
    for block in re.split(r"\n\s*\n", text):
        run: list[str] = []
        was = None
        for line in block.split("\n"):
            table = line.strip().startswith("|") and line.strip().endswith("|") and len(line.strip()) > 1
            if was is not None and table != was:
                out.append("\n".join(run))
                run = []
            run.append(line)
            was = table
        out.append("\n".join(run))
    return [p.strip() for p in out if p.strip()], images
