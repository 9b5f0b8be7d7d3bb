"""Reports to raw tables, tables to matrices, matrices to the cell relation.

Segmentation, HTML parsing and the structure of tables run in one Arrow pass over
reports (`parse_reports`, or `parse_cells` for the cells themselves), as spans,
carried sections and offsets have no built-in.  `with_structure` and `to_cells`
give the same of tables that are parsed already, as Columns.
"""

from __future__ import annotations

import html.parser
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import plain
from ..functions.numbers import is_numeric, parse_number
from ..functions.plain import LONGEST_KEPT, kept
from ..functions.text import ascii_words, let, tidy
from ..functions.units import UNKNOWN, detect_unit, table_unit, to_base

# The marks of tables, pages and numbered sections in report text.
TABLE = re.compile(r"<table\b[^>]*>.*?</table\s*>", re.I | re.S)
PAGE = re.compile(r"^=====\s*PAGE\s+(\d+)\s*=====\s*$", re.I)
NUMBERED = re.compile(r"^\d+(\.\d+)*\.?\s+\S")
CONTEXT_LINES = 8
PARSED = (
    "table_id int, page_no int, line_no int, char_offset int, html string, context array<string>, local_section string, "
    "numbered_section string, declaration string, matrix array<array<string>>"
)
#: Characters of markup and cells that one output batch holds.
BATCH_CHARACTERS, BATCH_CELLS = 4_000_000, 100_000
#: Labels of a table that its manifest row holds.
MOST_LABELS = 80


class _Rows(html.parser.HTMLParser):
    """The rows of the first table: lists of (text, colspan, rowspan).

    Cells and rows that are not closed end where the next begins.  The rows of
    tables inside cells count as rows too.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[tuple[str, int, int]]] = []
        self.parts: list[str] | None = None
        self.span = (1, 1)
        self.open = False

    def _close_cell(self) -> None:
        if self.parts is not None and self.rows:
            self.rows[-1].append((tidy(" ".join(self.parts)) or "", *self.span))
        self.parts = None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self._close_cell()
            self.rows.append([])
            self.open = True
        elif tag in ("td", "th"):
            self._close_cell()
            if not self.open:
                self.rows.append([])
                self.open = True
            named = dict(attrs)
            self.span = (_count(named.get("colspan")), _count(named.get("rowspan")))
            self.parts = []

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self._close_cell()
        elif tag in ("tr", "table"):
            self._close_cell()
            self.open = False

    def handle_data(self, data):
        if self.parts is not None:
            self.parts.append(data)


def _count(text: str | None) -> int:
    try:
        return int(text) if text and int(text) > 0 else 1
    except ValueError:
        return 1


_TAG = re.compile("<([^<>]*)>")
# Tags whose parsing is plain, and the white space and attributes in them.
_PLAIN_TAG = re.compile(r"(table|tr|td|th|tbody|thead|b|i|br|p|em|strong|sub|sup|span)((?:[ \t\n\r\f]+[a-z-]+=(?:\"[^\"<>&]*\"|[0-9]+))*)[ \t\n\r\f]*", re.I | re.A)
_ROW, _CELL, _END_CELL, _END_ROW, _OTHER = range(5)


@lru_cache(maxsize=4096)
def _tag(tag: str) -> tuple[int, tuple[int, int] | None] | None:
    """What a tag does and its (colspan, rowspan) if not both 1; None if only the full parser can tell."""
    ends = tag.startswith("/")
    if tag.lower() in ("br/", "br /"):
        return _OTHER, None
    found = _PLAIN_TAG.fullmatch(tag, 1 if ends else 0)
    if found is None or (ends and found[2]):
        return None
    name = found[1].lower()
    if ends:
        return {"td": _END_CELL, "th": _END_CELL, "tr": _END_ROW, "table": _END_ROW}.get(name, _OTHER), None
    if name not in ("td", "th"):
        return (_ROW if name == "tr" else _OTHER), None
    named = {k.lower(): v for k, v in re.findall(r"([a-z-]+)=(\"[^\"]*\"|[0-9]+)", found[2], re.I | re.A)}
    span = tuple(_count(named[k].strip('"') if k in named else None) for k in ("colspan", "rowspan"))
    return _CELL, None if span == (1, 1) else span


_Found = list[tuple[list[str], dict[int, tuple[int, int]]]]


def _chunk(chunk: str, begun: bool, ends: bool) -> _Found | None:
    """Rows of the markup behind ``<tr>`` (if ``begun``); an open cell ends where the next row begins (if ``ends``)."""
    pieces = _TAG.split(chunk)
    if 2 * chunk.count("<") + 1 != len(pieces):
        return None
    rows: _Found = [([], {})] if begun else []
    parts, span, open_ = None, None, begun

    def close() -> None:
        if parts is not None and rows:
            texts, spans = rows[-1]
            if span is not None:
                spans[len(texts)] = span
            texts.append(_tidied(" ".join(parts)))

    for i in range(1, len(pieces), 2):
        found = _tag(pieces[i])
        if found is None:
            return None
        what, own = found
        if what != _OTHER:
            close()
            parts = None
            if what == _CELL:
                if not open_:
                    rows.append(([], {}))
                    open_ = True
                span, parts = own, []
            elif what == _ROW:
                rows.append(([], {}))
                open_ = True
            elif what == _END_ROW:
                open_ = False
        if parts is not None:
            parts.append(pieces[i + 1])
    if ends:
        close()
    return rows


_known_chunk = lru_cache(maxsize=4096)(_chunk)


def _plain_rows(markup: str) -> _Found | None:
    """Rows as `_Rows` finds them, as texts and the spans of those cells that have any; None if the markup is not plain."""
    if "&" in markup:
        return None
    chunks = markup.split("<tr>")
    rows: _Found = []
    last = len(chunks) - 1
    for k, chunk in enumerate(chunks):
        if k and chunk.startswith("<td>"):  # cells of bare text
            end = -10 if chunk.endswith("</td></tr>") else -18 if chunk.endswith("</td></tr></table>") else 0
            if end:
                texts = chunk[4:end].split("</td><td>")
                if chunk.count("<") == 2 * len(texts) + (1 if end == -10 else 2):
                    rows.append(([" ".join(x.split()) if x.isascii() else _tidied(x) for x in texts], {}))
                    continue
        found = (_known_chunk if len(chunk) <= LONGEST_KEPT else _chunk)(chunk, k > 0, k < last)
        if found is None:
            return None
        rows += found
    return rows


@kept
def _tidied(text: str) -> str:
    return tidy(text) or ""


def _spread(rows: tuple[tuple[tuple[str, ...], tuple[tuple[int, tuple[int, int]], ...]], ...]) -> list[dict[int, str]]:
    """Rows with their spans as texts by column."""
    held: dict[int, tuple[int, str]] = {}  # of each column under a rowspan, the row at which it ends and its text
    grid: list[dict[int, str]] = []
    for number, (texts, own) in enumerate(rows):
        held, spans = {c: h for c, h in held.items() if h[0] > number}, dict(own)
        row, at = {c: text for c, (_, text) in held.items()}, 0
        for i, text in enumerate(texts):
            across, down = spans.get(i, (1, 1))
            while at in row:
                at += 1
            row.update(dict.fromkeys(range(at, at + across), text))
            if down > 1:
                held.update(dict.fromkeys(range(at, at + across), (number + down, text)))
            at += across
        if row:
            grid.append(row)
    return grid


_known_spread = lru_cache(maxsize=1024)(_spread)


def to_matrix(markup: str | None) -> list[list[str]]:
    """A rectangle of cell texts; spans repeat their cell, missing cells are empty."""
    rows = _plain_rows(markup or "")
    if rows is None:
        parser = _Rows()
        parser.feed(markup or "")
        parser.close()
        rows = [([c[0] for c in cells], {i: c[1:] for i, c in enumerate(cells) if c[1:] != (1, 1)}) for cells in parser.rows]
    reach = 0  # the rows that spans touch are the first
    for number, (_, spans) in enumerate(rows):
        if spans:
            reach = max(reach, number + max(down for _, down in spans.values()))
    grid: list[dict[int, str]] = []
    if reach:
        top = tuple((tuple(texts), tuple(spans.items())) for texts, spans in rows[:reach])
        grid = (_known_spread if sum(len(x) for texts, _ in top for x in texts) <= 5 * LONGEST_KEPT else _spread)(top)
    rest = [texts for texts, _ in rows[reach:] if texts]
    width = max(max((max(row) + 1 for row in grid), default=0), max(map(len, rest), default=0))
    return [[row.get(c, "") for c in range(width)] for row in grid] + [list(row) if len(row) == width else row + [""] * (width - len(row)) for row in rest]


_DECLARES = re.compile(r"^\s*(đơn vị|don vi|đvt|dvt|unit|currency)\b", re.I)
_CLOSES = re.compile(r"</table\s*>", re.I)


@kept
def _line(line: str) -> tuple[str, bool, bool, bool]:
    """A line tidied, and whether it is numbered, declares a unit or closes a table."""
    own = tidy(line) or ""
    return own, NUMBERED.match(own) is not None, _DECLARES.match(own) is not None, _CLOSES.search(own) is not None


_OPENING, _CLOSING = re.compile(r"<table\b[^>]*>", re.I), re.compile(r"</table\s*>", re.I)


def _spans(text: str) -> Iterator[tuple[int, int, int]]:
    """Begin, begin of the closing tag and end of every match of `TABLE`."""
    low = text.lower()
    if len(low) != len(text) or not low.isascii() and "ſ" in low:  # letters that fold to others
        for m in TABLE.finditer(text):
            yield m.start(), m.start() + m[0].lower().rindex("</"), m.end()
        return
    at = 0
    while (start := low.find("<table", at)) >= 0:
        opening = _OPENING.match(text, start)
        at = start + 6
        if opening:
            close = low.find("</table", opening.end())
            while close >= 0 and not (closing := _CLOSING.match(text, close)):
                close = low.find("</table", close + 7)
            if close < 0:
                return
            yield start, close, closing.end()
            at = closing.end()


def _above(lines: list[str]) -> tuple[list[str], str | None]:
    """The context that lines give the table under them, and its own section."""
    above: list[str] = []
    local = None
    for text in reversed(lines):
        line, numbered, _, closes = _line(text)
        if closes or len(above) == CONTEXT_LINES:
            break
        if line and not PAGE.match(line):
            above.append(line)
            local = line if numbered and local is None else local
    if local is None:
        local = next((x for x in above if not x.startswith("<")), None)
    return above[::-1], local


def _gap(gap: str, first: bool) -> tuple[str | None, str | None, list[str], str | None]:
    """Of the text between two tables (or above the first) the last numbered line and declaration, the context and own section."""
    pieces = gap.split("\n")
    section = declared = None
    for piece in pieces:
        line, numbered, declares, _ = _line(piece)
        section = line if numbered else section
        declared = line if declares else declared
    return section, declared, *_above(pieces[0 if first else 1 : -1])


_known_gap = lru_cache(maxsize=4096)(_gap)


def _walk(text: str) -> Iterator[dict]:
    """Raw tables of one report, in order, with what the lines above them carry."""
    page = section = declared = None
    line_no = begin = end = 0  # the line of the last table and where that begins; where the last table ends
    closed_in_line = True
    for number, (start, close, stop) in enumerate(_spans(text), 1):
        own = text.rfind("\n", begin, start) + 1 or begin  # where this table's line begins
        if "=====" in (lines := text[begin:own]):
            for line in lines.split("\n"):
                if mark := PAGE.match(line):
                    page = int(mark[1])
        line_no += text.count("\n", begin, own)
        gap = text[end:start]
        numbered, declares, context, local = (_known_gap if len(gap) <= 5 * LONGEST_KEPT else _gap)(gap, number == 1)
        if number > 1 and not ("\n" in gap and closed_in_line):  # the lines above begin before the last table ends
            context, local = _above(text[:own].split("\n")[:-1])
        section = section if numbered is None else numbered
        declared = declared if declares is None else declares
        yield {
            "table_id": number, "page_no": page, "line_no": line_no + 1, "char_offset": start, "html": text[start:stop], "context": context,
            "local_section": local, "numbered_section": section, "declaration": declared,
        }
        begin, end, closed_in_line = own, stop, "\n" not in text[close:stop]


def _header_rows(matrix: list[list[str]], most: int = 3) -> int:
    """As `header_rows`."""
    rows = 0
    for row in matrix[1:most]:
        filled = [c for c in row if c]
        if not filled or 1 - sum([plain.parse_number(c)[0] is not None for c in filled]) / len(filled) < 0.75:
            break
        rows += 1
    return rows + 1 if matrix else 0


@lru_cache(maxsize=1024)
def _headers(top: tuple[tuple[str, ...], ...]) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """As `combined_headers`, and the unit that each names."""
    labels = []
    for c, column in enumerate(zip(*top, strict=True)):
        cells = [v for v in column if v != ""]
        labels.append(" | ".join(v for i, v in enumerate(cells) if i == 0 or cells[i - 1] != v) or f"column_{c + 1}")
    seen: dict[str, int] = {}
    out = []
    for v in labels:
        seen[v] = seen.get(v, 0) + 1
        out.append(v if seen[v] == 1 else f"{v}__{seen[v]}")
    return tuple(out), tuple(map(plain.detect_unit, out))


_table_unit = lru_cache(maxsize=1024)(plain.table_unit)


def _row_labels(rows: list[list[str]], limit: int) -> list[str]:
    """As `distinct_labels` over all body cells."""
    out: dict[str, str] = {}
    for row in rows:
        for v in row:
            if v != "" and not plain.is_numeric(v):
                out.setdefault(v.lower(), v)
    return list(out.values())[:limit]


def _structured(t: dict) -> dict:
    """Adds what `with_structure` adds, and the labels and sizes that a manifest holds."""
    matrix = to_matrix(t["html"])
    n = _header_rows(matrix)
    headers, units = _headers(tuple(map(tuple, matrix[:n])))
    t |= {
        "matrix": matrix, "header_rows": n, "headers": headers, "header_units": units, "rows": matrix[n:], "n_rows": len(matrix) - n, "n_cols": len(headers),
        "section_title": t["local_section"] if t["numbered_section"] is None else t["numbered_section"], "unit": _table_unit(tuple(t["context"]), headers, t["declaration"]),
    }
    return t


#: What needs the markup's cells, and which columns there are beside `PARSED`.
STRUCTURE = "header_rows int, headers array<string>, rows array<array<string>>, section_title string, unit string"
SIZES = "n_rows int, n_cols int, n_numbers int, row_labels array<string>"
_KINDS = dict(x.split(" ", 1) for x in ", ".join((PARSED, STRUCTURE, SIZES)).split(", "))
_LINES_ALONE = {"table_id", "page_no", "line_no", "char_offset", "html", "context", "local_section", "numbered_section", "declaration"}
_ARROW = {"int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<array<string>>": pa.list_(pa.list_(pa.string()))}
#: What `to_manifest` reads.
FOR_MANIFEST = ["table_id", "page_no", "line_no", "char_offset", "html", "context", "headers", "header_rows", "section_title", "unit", "n_rows", "n_cols", "row_labels"]


def parse_reports(reports: DataFrame, keep: list[str], columns: list[str] | None = None) -> DataFrame:
    """A row per ``<table>`` of ``text``: ``keep`` and ``columns`` (by default those of `PARSED`).

    Null and empty texts have no table.  Nested tables end at the first closing
    tag.  Lines are separated by line feeds alone.  Only what ``columns`` names
    is worked out.
    """
    columns = [c.split()[0] for c in PARSED.split(", ")] if columns is None else columns
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in reports.select(*keep).schema), *(f"{c} {_KINDS[c]}" for c in columns)])
    lines_alone = set(columns) <= _LINES_ALONE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:

            def made(at: list[int], rows: list[dict], own=batch) -> pa.RecordBatch:
                held = own.select(keep).take(pa.array(at, pa.int32()))
                return pa.RecordBatch.from_arrays([*held.columns, *(pa.array([t[c] for t in rows], _ARROW[_KINDS[c]]) for c in columns)], [*keep, *columns])

            at, rows, size = [], [], 0
            for i, text in enumerate(batch.column("text").to_pylist()):
                for t in _walk(text or ""):
                    t = t if lines_alone else _structured(t)
                    if "n_numbers" in columns:
                        t["n_numbers"] = sum(plain.is_numeric(c) for row in t["rows"] for c in row)
                    if "row_labels" in columns:
                        t["row_labels"] = _row_labels(t["rows"], MOST_LABELS)
                    at.append(i)
                    rows.append(t)
                    size += len(t["html"])
                    if size > BATCH_CHARACTERS:
                        yield made(at, rows)
                        at, rows, size = [], [], 0
            if rows:
                yield made(at, rows)

    return reports.select(*keep, "text").mapInArrow(run, kinds)


def parse_cells(reports: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The cell relation of reports (``doc_id``, ``ticker``, ``year``, ``scope``, ``text``) in one pass, as `to_cells` gives it of their tables.

    ``columns`` names those of `CELL_COLUMNS` that are wanted.
    """
    columns = CELL_COLUMNS if columns is None else columns
    keys = {"doc_id": "doc_id", "ticker": "ticker", "report_year": "year", "scope": "scope"}
    own = {f.name: f.dataType.simpleString() for f in reports.schema}
    kinds = {c: own[keys[c]] if c in keys else _CELL_KINDS[c] for c in columns}
    arrow = {"int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    used = list(dict.fromkeys(["doc_id", *(keys[c] for c in columns if c in keys)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column("doc_id").to_pylist()
            tables: list[tuple[int, str | None, int]] = []  # report, reference, cells
            out: dict[str, list] = {c: [] for c in _CELL_KINDS}

            def made(own=batch) -> pa.RecordBatch:
                counts = np.array([t[2] for t in tables])
                index = pa.array(np.repeat(np.array([t[0] for t in tables], np.int32), counts))
                refs = pa.array([t[1] for t in tables], pa.string()).take(pa.array(np.repeat(np.arange(len(tables), dtype=np.int32), counts)))
                arrays = [refs if c == "table_ref" else own.column(keys[c]).take(index) if c in keys else pa.array(out[c], arrow[kinds[c]]) for c in columns]
                return pa.RecordBatch.from_arrays(arrays, columns)

            for i, text in enumerate(batch.column("text").to_pylist()):
                for t in _walk(text or ""):
                    t = _structured(t)
                    width, unit, rows = t["n_cols"], t["unit"], t["rows"]
                    if not rows or not width:
                        continue
                    tables.append((i, None if docs[i] is None else f"{docs[i]}|table_{t['table_id']}", len(rows) * width))
                    named = [u if u != UNKNOWN else None for u in t["header_units"]]
                    for at, row in enumerate(rows):
                        rest = plain.detect_unit(row[0])
                        rest = unit if rest == UNKNOWN else rest
                        units = [u or rest for u in named]
                        numbers = list(map(plain.parse_number, row))
                        out["source_unit"] += units
                        out["row_index"] += [at] * width
                        out["column_index"] += range(width)
                        out["row_label"] += [row[0]] * width
                        out["column_label"] += t["headers"]
                        out["raw_value"] += row
                        out["numeric_value"] += [n[0] for n in numbers]
                        out["base_value"] += [plain.to_base(n[0], u) for n, u in zip(numbers, units, strict=True)]
                        out["is_missing"] += [n[1] for n in numbers]
                        out["is_dash"] += [n[2] for n in numbers]
                    if len(out["row_index"]) > BATCH_CELLS:
                        yield made()
                        tables, out = [], {c: [] for c in _CELL_KINDS}
            if tables:
                yield made()

    return reports.select(*used, "text").mapInArrow(run, ", ".join(f"{c} {k}" for c, k in kinds.items()))


def markup_counts(text: Column) -> Column:
    """struct(openings, closings, matched) of table tags."""
    n = lambda pattern: F.regexp_count(text, F.lit(pattern))
    return F.struct(
        n(r"(?i)<table\b").alias("openings"), n(r"(?i)</table\s*>").alias("closings"), n(r"(?is)<table\b[^>]*>.*?</table\s*>").alias("matched")
    )


def header_rows(matrix: Column, most: int = 3) -> Column:
    """Leading header rows: the first, then those of which 3/4 of the filled cells are no number."""

    def is_header(row: Column) -> Column:
        filled = F.filter(row, lambda c: c != "")
        numbers = F.size(F.filter(filled, is_numeric))
        return (F.size(filled) > 0) & (1 - numbers / F.size(filled) >= 0.75)

    follow = F.lit(0)
    for i in range(most - 1, 0, -1):
        row = F.get(matrix, F.lit(i))
        follow = F.when(row.isNotNull() & is_header(row), 1 + follow).otherwise(0)
    return F.when(F.size(matrix) == 0, 0).otherwise(1 + follow)


def combined_headers(matrix: Column, rows: Column) -> Column:
    """A label per column: its header cells joined, repeats in a row once; blanks and repeats are numbered."""
    width = F.size(F.get(matrix, F.lit(0)))
    top = F.slice(matrix, 1, F.greatest(rows, F.lit(0)))

    def label(c: Column) -> Column:
        cells = F.filter(F.transform(top, lambda row: F.get(row, c)), lambda v: v != "")
        distinct = F.filter(F.transform(cells, lambda v, i: F.when((i == 0) | (F.get(cells, i - 1) != v), v)), lambda v: v.isNotNull())
        return F.coalesce(F.nullif(F.concat_ws(" | ", distinct), F.lit("")), F.concat(F.lit("column_"), (c + 1).cast("string")))

    labels = F.transform(F.sequence(F.lit(0), width - 1), label)

    def number(all_: Column) -> Column:
        seen = lambda i, v: F.size(F.filter(F.slice(all_, F.lit(1), i + 1), lambda w: w == v))
        return F.transform(all_, lambda v, i: let(seen(i, v), lambda n: F.when(n == 1, v).otherwise(F.concat(v, F.lit("__"), n.cast("string")))))

    numbered = let(labels, number)
    return F.when(F.coalesce(width, F.lit(0)) <= 0, F.array().cast("array<string>")).otherwise(numbered)


def with_structure(parsed: DataFrame) -> DataFrame:
    """Adds ``header_rows``, ``headers``, ``rows``, ``section_title`` and ``unit``."""
    out = parsed.withColumn("header_rows", header_rows(F.col("matrix")))
    out = out.withColumn("headers", combined_headers(F.col("matrix"), F.col("header_rows")))
    body = F.slice("matrix", F.col("header_rows") + 1, F.greatest(F.size("matrix") - F.col("header_rows"), F.lit(0)))
    out = out.withColumn("rows", F.when(F.size("matrix") > F.col("header_rows"), body).otherwise(F.array().cast("array<array<string>>")))
    out = out.withColumn("section_title", F.coalesce("numbered_section", "local_section"))
    return out.withColumn("unit", table_unit(F.col("context"), F.col("headers"), F.col("declaration")))


_CELL_KINDS = {
    "table_ref": "string", "source_unit": "string", "row_index": "int", "column_index": "int", "row_label": "string", "column_label": "string", "raw_value": "string",
    "numeric_value": "double", "base_value": "double", "is_dash": "boolean", "is_missing": "boolean",
}
CELL_KEYS = ["table_ref", "doc_id", "ticker", "report_year", "scope"]
CELL_COLUMNS = [*CELL_KEYS, "source_unit", "row_index", "column_index", "row_label", "column_label", "raw_value", "numeric_value", "base_value", "is_dash", "is_missing"]


def to_cells(tables: DataFrame) -> DataFrame:
    """The cell relation: a row per body cell, labels included.  Needs `with_structure` and the keys."""
    # The matrix itself is exploded, not an expression over it that the optimizer would copy into filters.
    # Units are read once for each header and each row, not for each cell.
    rows = tables.withColumn("header_units", F.transform("headers", detect_unit))
    rows = rows.select(*CELL_KEYS, "unit", "headers", "header_units", "header_rows", F.posexplode("matrix").alias("at", "row"))
    rows = rows.where("at >= header_rows").withColumn("row_label", F.coalesce(F.get("row", F.lit(0)), F.lit("")))
    rows = rows.select(*CELL_KEYS, "unit", "headers", "header_units", (F.col("at") - F.col("header_rows")).alias("row_index"), "row_label", detect_unit(F.col("row_label")).alias("row_unit"), "row")
    cells = rows.select(*[c for c in rows.columns if c != "row"], F.posexplode("row").alias("column_index", "raw_value"))
    cells = cells.withColumn("column_label", F.coalesce(F.get("headers", F.col("column_index")), F.concat(F.lit("column_"), (F.col("column_index") + 1).cast("string"))))
    named = lambda u: F.nullif(u, F.lit("UNKNOWN"))
    cells = cells.withColumn("source_unit", F.coalesce(named(F.get("header_units", F.col("column_index"))), named(F.col("row_unit")), F.col("unit")))
    cells = cells.withColumn("n", parse_number(F.col("raw_value"))).withColumn("numeric_value", F.col("n.value")).withColumn("base_value", to_base(F.col("numeric_value"), F.col("source_unit")))
    return cells.withColumn("is_dash", F.col("n.is_dash")).withColumn("is_missing", F.col("n.is_missing")).select(*CELL_COLUMNS)


def distinct_labels(values: Column, limit: int) -> Column:
    """First occurrences of labels that are no number, compared without case, at most ``limit``."""

    def first(words: Column) -> Column:
        alike = lambda folded: F.transform(words, lambda v, i: F.when(F.array_position(folded, F.lower(v)) == i + 1, v))
        return F.filter(let(F.transform(words, lambda v: F.lower(v)), alike), lambda v: v.isNotNull())

    return F.slice(let(F.filter(values, lambda v: (v != "") & ~is_numeric(v)), first), 1, limit)


def retrieval_text(ticker: Column, year: Column, scope: Column, section: Column, context: Column, headers: Column, labels: Column) -> Column:
    """The searchable description of a table and its accent-free copy (the line names are fixed values)."""
    line = lambda name, x: F.when(F.coalesce(F.length(x), F.lit(0)) > 0, F.concat(F.lit(f"{name}: "), x))
    joined = lambda x: F.concat_ws(" | ", x)
    near = distinct_labels(F.slice(context, F.greatest(F.size(context) - 3, F.lit(1)), F.lit(4)), 4)
    text = F.concat_ws(
        "\n", F.concat(F.lit("ma co phieu: "), ticker), F.concat(F.lit("nam bao cao: "), year.cast("string")), F.concat(F.lit("pham vi: "), scope),
        line("muc", section), line("ngu canh", joined(near)), line("cot", joined(headers)), line("dong", joined(labels)),
    )
    return F.concat(text, F.lit("\nkhong dau: "), ascii_words(text))


def to_manifest(tables: DataFrame) -> DataFrame:
    """One row per table with its identity, unit, labels, retrieval text and hash."""
    out = tables if "row_labels" in tables.columns else tables.withColumn("row_labels", distinct_labels(F.flatten("rows"), MOST_LABELS))
    n_rows = F.col("n_rows") if "n_rows" in tables.columns else F.size("rows")
    text = retrieval_text(*(F.col(c) for c in ("ticker", "report_year", "scope", "section_title", "context", "headers", "row_labels")))
    return out.select(
        *CELL_KEYS, "table_id", "page_no", "line_no", "char_offset", "section_title", "unit", "header_rows", n_rows.alias("n_rows"),
        F.size("headers").alias("n_cols"), "headers", "row_labels", text.alias("retrieval_text"), "source_path", F.sha2("html", 256).alias("html_sha256"),
        F.lit("raw_ordinal_1_based").alias("identity_status"),
    )


def numeric_coordinates(cells: DataFrame) -> DataFrame:
    """Rows and columns that hold a number, per table."""
    at = F.struct("row_index", "column_index")
    return cells.where("numeric_value is not null").groupBy("table_ref").agg(F.array_sort(F.collect_set(at)).alias("at"))


# The outline marks of row labels (letters, numbers, bullets).
LETTERED, NUMERIC, BULLET = r"(?iu)^\s*([a-zđ]+)\s*[.)]\s+", r"^\s*\d+(\.\d+)*\s*[.)]\s+", r"^\s*[-+•▪●○◦]\s+"


def outline_level(label: Column) -> Column:
    """0 for a lettered group, 1 for a Roman one, 2 for a numbered row, 3 for a bullet; else null."""
    letters = F.upper(F.regexp_extract(label, LETTERED, 1))
    return (
        F.when(letters.rlike("^[IVX]+$"), 1)
        .when(letters != "", 0)
        .when(label.rlike(NUMERIC), 2)
        .when(label.rlike(BULLET), 3)
    )


def row_parents(rows: Column) -> Column:
    """For each row the labels of its ancestors in the outline, outermost first.

    A row that repeats its label in every filled column (two at least) starts a
    new group as a numbered row would; rows without a level have no parents and
    change nothing.
    """
    kind = "struct<stack: array<struct<level: int, label: string>>, out: array<array<string>>>"
    start = F.struct(F.array().cast("array<struct<level: int, label: string>>").alias("stack"), F.array().cast("array<array<string>>").alias("out")).cast(kind)

    def step(state: Column, row: Column) -> Column:
        label = F.trim(F.coalesce(F.get(row, F.lit(0)), F.lit("")))
        filled = F.filter(F.transform(row, lambda c: F.trim(c)), lambda c: c != "")
        group = (label != "") & (F.size(filled) >= 2) & F.forall(filled, lambda c: c == label)
        level = outline_level(label)
        above = F.filter(state["stack"], lambda s: s["level"] < level)
        own = lambda n: F.array(F.struct(n.cast("int").alias("level"), label.alias("label")))
        stack = F.when(group, own(F.lit(2))).when(level.isNull(), state["stack"]).otherwise(F.concat(above, own(level)))
        parents = F.when(group | level.isNull(), F.array().cast("array<string>")).otherwise(F.transform(above, lambda s: s["label"]))
        return F.struct(stack.alias("stack"), F.concat(state["out"], F.array(parents)).alias("out")).cast(kind)

    return F.aggregate(rows, start, step, lambda s: s["out"])


def schema_text(tables: DataFrame) -> DataFrame:
    """``table_ref`` and a text of its columns, rows (with parents) and where numbers stand; no values."""
    columns = F.concat_ws("\n", F.transform("headers", lambda h, i: F.concat(F.lit("  c"), i.cast("string"), F.lit(": "), h)))

    def row_line(row: Column, i: Column) -> Column:
        parents = F.get(F.col("parents"), i)
        at = F.filter(F.transform(row, lambda c, k: F.when(is_numeric(c), F.concat(F.lit("c"), k.cast("string")))), lambda c: c.isNotNull())
        inside = F.when(F.size(parents) > 0, F.concat(F.lit(" [in "), F.concat_ws(" > ", parents), F.lit("]"))).otherwise("")
        numbers = F.when(F.size(at) > 0, F.concat(F.lit(" -> "), F.concat_ws(",", at))).otherwise(" -> no number")
        return F.concat(F.lit("  r"), i.cast("string"), F.lit(": "), F.coalesce(F.get(row, F.lit(0)), F.lit("")), inside, numbers)

    out = tables.withColumn("parents", row_parents(F.col("rows")))
    lines = F.concat_ws("\n", F.transform("rows", row_line))
    return out.select("table_ref", F.concat(F.lit("columns:\n"), columns, F.lit("\nrows:\n"), lines).alias("schema_text"))


def carry_forward(df: DataFrame, value: str, partition: list[str], order: list[str]) -> DataFrame:
    """The last non-null value up to and including each row."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(w))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Left rows with the value of the last right row at or before them (inclusive)."""
    marked = left.withColumn("_side", F.lit(1)).withColumn(value, F.lit(None).cast(right.schema[value].dataType))
    both = marked.unionByName(right.select(key, at, value).withColumn("_side", F.lit(0)), allowMissingColumns=True)
    return carry_forward(both, value, [key], [at, "_side"]).where("_side = 1").drop("_side")
