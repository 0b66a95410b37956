"""Table cells of a page with their coordinates, spans resolved, tables inside tables kept apart."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache
from html.parser import HTMLParser
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .expr import let, text

CELL = StructType([*[StructField(n, IntegerType()) for n in ("grid", "parent", "row", "col", "rows", "cols")], StructField("text", StringType())])
# The greatest spans of the HTML standard.
MAX_COLS, MAX_ROWS = 1000, 65534


class _Cells(HTMLParser):
    """Cells in page order. A cell, row or table that is not closed ends where the next one begins."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.places: list[tuple[int, ...]] = []
        self.lines: list[list[str]] = []
        self.grids: list[dict] = []
        self.grid_count = 0
        self.silent = 0

    @property
    def open(self) -> int | None:
        """The cell that takes the next text."""
        return self.grids[-1]["open"] if self.grids and not self.silent else None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.silent += 1
        elif tag == "table":
            parent = self.grids[-1]["open"] if self.grids else None
            self.grids.append({"id": self.grid_count, "parent": -1 if parent is None else parent, "row": -1, "col": 0, "busy": {}, "open": None})
            self.grid_count += 1
        elif tag == "tr" and self.grids:
            self.grids[-1].update(row=self.grids[-1]["row"] + 1, col=0, open=None)
        elif tag in ("td", "th") and self.grids:
            self._place(self.grids[-1], dict(attrs))

    def _place(self, grid: dict, attrs: dict) -> None:
        row, col, busy = max(grid["row"], 0), grid["col"], grid["busy"]
        while busy.get(col, -1) >= row:
            col += 1
        cols = min(max(_span(attrs.get("colspan")), 1), MAX_COLS)
        rows = min(_span(attrs.get("rowspan")) or MAX_ROWS, MAX_ROWS)
        busy.update((c, max(busy.get(c, -1), row + rows - 1)) for c in range(col, col + cols))
        grid.update(row=row, col=col + cols, open=len(self.places))
        self.places.append((grid["id"], grid["parent"], row, col, rows, cols))
        self.lines.append([])

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.silent = max(self.silent - 1, 0)
        elif tag == "table" and self.grids:
            self.grids.pop()
        elif tag in ("td", "th", "tr") and self.grids:
            self.grids[-1]["open"] = None

    def handle_data(self, data: str) -> None:
        if self.open is not None:
            self.lines[self.open] += _lines(data)


def _lines(data: str) -> list[str]:
    return [line for part in data.splitlines() if (line := part.strip())]


def _span(value: str | None) -> int:
    value = (value or "").strip()
    return int(value[:6]) if value.isascii() and value.isdigit() else 1


# Tags written plainly; a page that holds anything else, such as comments, references or raw text, goes to the full parser.
_SPACE = r"[ \t\n\r\f]"
_ATTRIBUTE = r"([A-Za-z][A-Za-z-]*)(?:=(?:\"([^\"<>]*)\"|'([^'<>]*)'|([A-Za-z0-9%#._-]+)))?"
_PLAIN = re.compile(rf"<(/?)([A-Za-z][A-Za-z0-9]*)((?:{_SPACE}+{re.sub(r'[(](?![?])', '(?:', _ATTRIBUTE)})*+){_SPACE}*>")
_TAG = re.compile("(" + re.sub(r"[(](?![?])", "(?:", _PLAIN.pattern) + ")")
_PLAIN_ATTRIBUTE = re.compile(_SPACE + _ATTRIBUTE)
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"}
# Pages of one template have the same tags, so their cells stand in the same places: a worker keeps the layouts of
# the last templates it met. Longer pages are laid out each for itself.
KEPT_LAYOUTS, KEPT_TAGS = 256, 1000


def _laid_out(tags: tuple[str, ...]) -> tuple[bytes, int, list[tuple[int, int]]] | None:
    """Places and number of the cells of a page with these plain tags, and the texts in them: (text, cell) by numbers.

    Text ``i`` stands before tag ``i``. Nothing where a tag needs the full parser.
    """
    page, inside = _Cells(), []
    for i, tag in enumerate(tags, 1):
        m = _PLAIN.fullmatch(tag)
        name = m[2].lower()
        if name in _RAW or (m[1] and m[3]):
            return None
        if m[1]:
            page.handle_endtag(name)
        else:
            page.handle_starttag(name, _attributes(m[3]))
        if page.open is not None:
            inside.append((i, page.open))
    return _packed(page), len(page.places), inside


_kept_layout = lru_cache(KEPT_LAYOUTS)(_laid_out)


def _packed(page: _Cells) -> bytes:
    return np.array(page.places, np.int32).tobytes()


def _plain_tags(html: str) -> tuple[list[str], tuple] | None:
    """Texts and tags of a page by turns, and its layout, if every ``<`` begins a plain tag, else nothing."""
    if "&" in html:
        return None
    pieces = _TAG.split(html)
    if len(pieces) // 2 != html.count("<"):
        return None
    layout = (_kept_layout if len(pieces) < 2 * KEPT_TAGS else _laid_out)(tuple(pieces[1::2]))
    return None if layout is None else (pieces, layout)


def _read(html: str) -> tuple[bytes, list[str]]:
    """The places of all cells of a page, six numbers each, and their texts."""
    plain = _plain_tags(html)
    if plain is None:
        page = _Cells()
        page.feed(html.replace("<![", "<!x["))  # HTML reads a marked section as a comment up to the next ">"
        page.close()
        return _packed(page), ["\n".join(lines) for lines in page.lines]
    pieces, (places, count, inside) = plain
    texts = [""] * count
    for i, cell in inside:
        if (data := pieces[2 * i]) and (lines := _lines(data)):
            texts[cell] = "\n".join([texts[cell], *lines] if texts[cell] else lines)
    return places, texts


def _attributes(written: str) -> list[tuple[str, str | None]]:
    return [(a[1].lower(), next((v for v in a.groups()[1:] if v is not None), None)) for a in _PLAIN_ATTRIBUTE.finditer(written)] if written else []


@F.arrow_udf(ArrayType(CELL))
def _grid_cells(pages: pa.Array) -> pa.Array:
    read = [_read(html) for html in pages.to_pylist()]
    places = np.frombuffer(b"".join(page for page, _ in read), np.int32).reshape(-1, len(CELL) - 1)
    columns = [*(pa.array(places[:, i]) for i in range(len(CELL) - 1)), pa.array([x for _, texts in read for x in texts], pa.string())]
    offsets = pa.array(list(accumulate((len(texts) for _, texts in read), initial=0)), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, names=CELL.names))


def grid_cells(html: Column | str) -> Column:
    """All cells of a page in order: number of the table, the cell around it (-1: none), place, spans and lines.

    Null and empty pages have none. The text of a cell leaves out the tables inside it: their cells come on their own.
    A ``rowspan`` of 0 reaches to the end of the table; spans that are no number count as 1.
    """
    return _grid_cells(text(html))


def cell_at(cells: Column, grid: Column, row: Column, col: Column) -> Column:
    """The cell that covers a place of a table, null when none does."""
    return F.get(F.filter(cells, lambda x: (x["grid"] == grid) & _covers(x, row, col)), F.lit(0))


def _covers(x: Column, row: Column, col: Column) -> Column:
    return (x["row"] <= row) & (row < x["row"] + x["rows"]) & (x["col"] <= col) & (col < x["col"] + x["cols"])


def right_of(cells: Column, cell: Column, steps: int = 1) -> Column:
    """The cell next to a cell, at the height of its first row."""
    for _ in range(steps):
        cell = let(F.struct(cells.alias("all"), cell.alias("at")), lambda x: cell_at(x["all"], x["at"]["grid"], x["at"]["row"], x["at"]["col"] + x["at"]["cols"]))
    return cell


def below(cells: Column, cell: Column) -> Column:
    """The cell under a cell, at its first column."""
    return let(F.struct(cells.alias("all"), cell.alias("at")), lambda x: cell_at(x["all"], x["at"]["grid"], x["at"]["row"] + x["at"]["rows"], x["at"]["col"]))


def first_cell(cells: Column, test: Callable[[Column], Column]) -> Column:
    """The first cell whose text passes, null when none does."""
    return F.get(F.filter(cells, lambda x: test(x["text"])), F.lit(0))


def lines(cell: Column) -> Column:
    return F.coalesce(F.filter(F.split(cell["text"], "\n"), lambda x: x != ""), F.array().cast("array<string>"))


def one_line(cell: Column) -> Column:
    return F.coalesce(F.replace(cell["text"], F.lit("\n"), F.lit(" ")), F.lit(""))
