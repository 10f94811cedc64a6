"""Table rows and links of HTML pages as a table function: SELECT ... FROM pages, LATERAL html_rows(html).

The tokeniser takes what pages hold: attributes in double, single or no quotes, cells, rows and tables that are never
closed, tables inside cells, comments, scripts, all character references. Each sign is read a constant number of times.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[^\s/>][^\s/=>]*")
_EQUALS = re.compile(r"\s*=+\s*")
_BARE = re.compile(r"[^>\s]*")
_GAP = re.compile(r"[\s/]*")
#: Elements whose content is no markup, with what ends them.
_RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in ("script", "style")}

Token = tuple[str, str, dict[str, str]]


class _Reader:
    def __init__(self, html: str) -> None:
        self.html, self.at, self.gone = html, 0, set()

    def find(self, sign: str, at: int) -> int:
        """As str.find; once a sign is found nowhere ahead, it is not looked for again."""
        if sign in self.gone:
            return -1
        found = self.html.find(sign, at)
        if found < 0:
            self.gone.add(sign)
        return found

    def tokens(self) -> Iterator[Token]:
        """("text", text, {}), ("open", name, attributes) and ("close", name, {}), in order."""
        html = self.html
        while self.at < len(html):
            sign = self.find("<", self.at)
            if sign < 0:
                sign = len(html)
            if sign > self.at:
                yield "text", unescape(html[self.at : sign]), {}
            self.at = sign
            if sign == len(html):
                return
            if html.startswith("<!--", sign):
                end = self.find("-->", sign + 4)
                self.at = len(html) if end < 0 else end + 3
            elif html.startswith(("<!", "<?"), sign):
                end = self.find(">", sign)
                self.at = len(html) if end < 0 else end + 1
            elif (name := _NAME.match(html, sign + 2)) and html[sign + 1] == "/":
                end = self.find(">", name.end())
                self.at = len(html) if end < 0 else end + 1
                yield "close", name[0].lower(), {}
            elif name := _NAME.match(html, sign + 1):
                if self.find(">", name.end()) < 0:
                    self.at = len(html)  # a tag that is never closed holds the rest
                    return
                attributes = self.attributes(name.end())
                yield "open", name[0].lower(), attributes
                if raw := _RAW.get(name[0].lower()):
                    end = raw.search(html, self.at)
                    self.at = end.start() if end else len(html)
            else:
                yield "text", "<", {}
                self.at = sign + 1

    def attributes(self, at: int) -> dict[str, str]:
        """A tag's attributes, the first of a name; moves behind the tag's end."""
        html, out = self.html, {}
        while True:
            at = _GAP.match(html, at).end()
            if at >= len(html) or html[at] == ">":
                self.at = min(at + 1, len(html))
                return out
            name = _ATTRIBUTE.match(html, at)
            at, value = name.end(), ""
            if equals := _EQUALS.match(html, at):
                at = equals.end()
                quote = html[at : at + 1]
                end = self.find(quote, at + 1) if quote in ("'", '"') else -1
                if end >= 0:
                    value, at = html[at + 1 : end], end + 1
                else:
                    bare = _BARE.match(html, at)
                    value, at = bare[0], bare.end()
            out.setdefault(name[0].lower(), unescape(value))


class _Cell:
    def __init__(self) -> None:
        self.text: list[str] = []
        self.link: list[str] = []
        self.href: str | None = None
        self.in_link = False

    def add(self, piece: str) -> None:
        self.text.append(piece)
        if self.in_link:
            self.link.append(piece)

    def row(self) -> tuple[str, str | None, str | None]:
        return "".join(self.text), None if self.href is None else "".join(self.link), self.href


class _Table:
    def __init__(self, number: int, name: str | None, depth: int) -> None:
        self.number, self.name, self.depth = number, name, depth
        self.rows: list[list[_Cell]] = []
        self.row: list[_Cell] | None = None
        self.cell: _Cell | None = None

    def end_row(self) -> None:
        self.row = self.cell = None

    def new_row(self) -> None:
        self.row, self.cell = [], None
        self.rows.append(self.row)

    def new_cell(self) -> None:
        if self.row is None:
            self.new_row()
        self.cell = _Cell()
        self.row.append(self.cell)


def table_rows(html: str | None) -> list[tuple[int, str | None, int, int, list[tuple[str, str | None, str | None]]]]:
    """(table, its id, how many tables it lies in, row, cells) of every row, tables and rows by the places where they
    begin. A cell is (text, text of its first link, that link's href): a text's pieces without the space around each,
    those of tables inside it included; link and href are NULL without a link, href is empty for a link without one."""
    tables: list[_Table] = []
    inside: list[_Table] = []
    for kind, name, attributes in _Reader(html or "").tokens():
        if kind == "text":
            if piece := name.strip():
                for table in inside:
                    if table.cell:
                        table.cell.add(piece)
        elif kind == "open":
            if name == "table":
                tables.append(_Table(len(tables), attributes.get("id"), len(inside)))
                inside.append(tables[-1])
            elif name == "tr" and inside:
                inside[-1].new_row()
            elif name in ("td", "th") and inside:
                inside[-1].new_cell()
            elif name == "a":
                for table in inside:
                    if table.cell:
                        table.cell.in_link = table.cell.href is None
                        if table.cell.href is None:
                            table.cell.href = attributes.get("href", "")
        elif name == "table" and inside:
            inside.pop()
        elif name == "tr" and inside:
            inside[-1].end_row()
        elif name in ("td", "th") and inside:
            inside[-1].cell = None
        elif name == "a":
            for table in inside:
                if table.cell:
                    table.cell.in_link = False
    return [(t.number, t.name, t.depth, k, [c.row() for c in row]) for t in tables for k, row in enumerate(t.rows)]


def links(html: str | None) -> list[tuple[int, str, str]]:
    """(position, href, text) of every link with a href; a link that is never closed ends where the next begins."""
    out: list[tuple[int, str, list[str]]] = []
    now: list[str] | None = None
    for kind, name, attributes in _Reader(html or "").tokens():
        if kind == "text":
            if now is not None and (piece := name.strip()):
                now.append(piece)
        elif name == "a":
            now = None
            if kind == "open" and "href" in attributes:
                now = []
                out.append((len(out), attributes["href"], now))
    return [(k, href, "".join(text)) for k, href, text in out]


@udtf(returnType="table_no int, table_id string, depth int, row_no int, cells array<struct<text:string,link:string,href:string>>", useArrow=True)
class HtmlRows:
    def eval(self, html: str) -> Iterator[tuple]:
        yield from table_rows(html)


@udtf(returnType="position int, href string, link string", useArrow=True)
class HtmlLinks:
    def eval(self, html: str) -> Iterator[tuple]:
        yield from links(html)


def register(spark: SparkSession) -> None:
    """html_rows(html) and html_links(html) for SQL."""
    spark.udtf.register("html_rows", HtmlRows)
    spark.udtf.register("html_links", HtmlLinks)
