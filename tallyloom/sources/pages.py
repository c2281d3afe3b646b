"""Result pages in HTML as rows of table cells, and what their file names say."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CELL = "struct<text:string,wide:boolean,parts:array<struct<tag:string,kind:string,text:string>>>"
ROW = f"table_no int, table_id string, nested boolean, header string, row_no int, part string, part_kind string, page_row int, cells array<{CELL}>"
#: Tags that a cell's texts are told apart by.
MARKED = ("a", "b", "small")
#: Pages and bytes of them that go to a Python worker at a time, and rows that come back.
MOST_PAGES, MOST_BYTES, MOST_ROWS = 100, 8 << 20, 1000
#: A tag that the parser of the standard library and a plain scan read alike, and elements whose contents are no tags.
PLAIN_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[\t\n\r\f ]+[a-zA-Z][a-zA-Z_:-]*(?:=(?:"[^"<>&]*"|'[^'<>&]*'|[^\t\n\r\f "'<>=`&/]+))?)*)[\t\n\r\f ]*(/?)>""")
PLAIN_ATTRIBUTE = re.compile(r"""([a-zA-Z][a-zA-Z_:-]*)(?:=("[^"]*"|'[^']*'|[^\t\n\r\f "']+))?""")
RAW = {"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"}
VOID = ("br", "img", "hr", "input", "meta", "link", "wbr", "col")


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(file_name, html) of every .html and .htm file of a folder, one row a file."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.{html,htm}")
    return files.select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("html"))


def file_facts(name: Column) -> Column:
    """Struct (environment, gender, code) of ``[outdoor_]gender_code.html``; null for other names."""
    parts = F.split(F.regexp_replace(name, r"\.html$", ""), "_")
    fact = lambda environment, i: F.struct(F.lit(environment).alias("environment"), F.get(parts, F.lit(i)).alias("gender"), F.get(parts, F.lit(i + 1)).alias("code"))
    return F.when(name.endswith(".html") & (F.size(parts) == 3) & (parts[0] == "outdoor"), fact("outdoor", 1)).when(name.endswith(".html") & (F.size(parts) == 2), fact("indoor", 0))


class _Cells(HTMLParser):
    """Rows of all tables in document order; each text is told by the innermost of the tags MARKED that it is in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[dict] = []
        self.open: list[dict] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        facts = dict(attrs)
        if tag == "table":
            for outer in self.open:
                outer["nested"] = True
            table = {"id": facts.get("id"), "nested": False, "header": None, "rows": [], "part": ("", None), "row": None, "cell": None, "tags": []}
            self.tables.append(table)
            self.open.append(table)
            return
        if not self.open:
            return
        top = self.open[-1]
        if tag in ("thead", "tbody", "tfoot"):
            self._end_row()
            top["part"] = (tag, facts.get("class"))
        elif tag == "tr":
            self._end_row()
            top["row"] = []
        elif tag in ("td", "th") and top["row"] is not None:
            self._end_cell()
            top["cell"] = {"wide": "colspan" in facts, "is_data": tag == "td", "parts": []}
        elif tag in MARKED:
            top["tags"].append((tag, facts.get("class")))

    def handle_endtag(self, tag: str) -> None:
        if not self.open:
            return
        top = self.open[-1]
        if tag == "table":
            self._end_row()
            self.open.pop()
        elif tag == "tr":
            self._end_row()
        elif tag in ("td", "th"):
            self._end_cell()
        elif tag in ("thead", "tbody", "tfoot"):
            self._end_row()
            top["part"] = ("", None)
        elif tag in MARKED:
            for i in range(len(top["tags"]) - 1, -1, -1):
                if top["tags"][i][0] == tag:
                    del top["tags"][i:]
                    break

    def handle_data(self, data: str) -> None:
        text = data.strip()
        if not text:
            return
        # A text also belongs to the cells of the tables around its own one.
        for table in self.open:
            if table["cell"] is not None:
                tag, kind = table["tags"][-1] if table["tags"] else (None, None)
                table["cell"]["parts"].append({"tag": tag, "kind": kind, "text": text})

    def _end_cell(self) -> None:
        top = self.open[-1]
        cell, top["cell"], top["tags"] = top["cell"], None, []
        if cell is None:
            return
        text = "".join(p["text"] for p in cell["parts"])
        if cell["wide"] and cell["is_data"] and text[:4].isdigit() and len(text) >= 4:
            for table in self.open:
                table["header"] = text
        top["row"].append({"text": text, "wide": cell["wide"], "parts": cell["parts"]})

    def _end_row(self) -> None:
        self._end_cell()
        top = self.open[-1]
        if top["row"] is not None:
            top["rows"].append((*top["part"], top["row"]))
            top["row"] = None

    def finish(self) -> list[dict]:
        while self.open:
            self.handle_endtag("table")
        return self.tables


def _fed_plainly(parser: _Cells, html: str) -> bool:
    """Feeds a page by a plain scan, several times as fast as HTMLParser; False, with nothing fed, if it isn't plain."""
    pieces = PLAIN_TAG.split(html)
    names = [name.lower() for name in pieces[2::5]]
    if "<" in "".join(pieces[::5]) or not RAW.isdisjoint(names) or any(pieces[i] and (pieces[i + 2] or pieces[i + 3]) for i in range(1, len(pieces), 5)):
        return False
    for i, name in enumerate(names):
        text, closes, _, attributes, ends = pieces[5 * i : 5 * i + 5]
        if text and parser.open:
            parser.handle_data(unescape(text) if "&" in text else text)
        if closes:
            parser.handle_endtag(name)
            continue
        parser.handle_starttag(name, [(n.lower(), v.strip(v[0]) if v[:1] in ("'", '"') else v or None) for n, v in PLAIN_ATTRIBUTE.findall(attributes)] if attributes else [])
        if ends:
            parser.handle_endtag(name)
    if pieces[-1] and parser.open:
        parser.handle_data(unescape(pieces[-1]))
    return True


def page_tables(html: str) -> list[dict]:
    parser = _Cells()
    if not _fed_plainly(parser, html):
        parser.feed(html)
        parser.close()
    return parser.finish()


def cell_rows(df: DataFrame, html: str, keep: list[str], least_length: int = 0) -> DataFrame:
    """The columns ``keep`` with each table row of the pages: table_no, table_id, whether the table holds others
    (nested), the last wide cell in it that begins with a year (header), row_no, the table part that the row is in with
    its class, its number in the page from 0 (page_row), and cells (text, wide, parts). A cell's text is its pieces without white space around each.

    Null pages, and those shorter than ``least_length``, give no rows.
    """
    kinds = pa.schema([("table_no", pa.int32()), ("table_id", pa.string()), ("nested", pa.bool_()), ("header", pa.string()), ("row_no", pa.int32()), ("part", pa.string()), ("part_kind", pa.string()), ("page_row", pa.int32())])

    def listed(lists: list[list], values: list[pa.Array], names: list[str]) -> pa.Array:
        """Lists of structs, whose fields come flat."""
        ends = [0]
        for x in lists:
            ends.append(ends[-1] + len(x))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(values, names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, made, rows = [], [], []

            def out() -> pa.RecordBatch:
                own = [batch.column(c).take(pa.array(at, pa.int32())) for c in keep]
                cells = [cell for row in rows for cell in row]
                parts = [cell["parts"] for cell in cells]
                pieces = [p for part in parts for p in part]
                inner = listed(parts, [pa.array([p[f] for p in pieces], pa.string()) for f in ("tag", "kind", "text")], ["tag", "kind", "text"])
                outer = listed(rows, [pa.array([c["text"] for c in cells], pa.string()), pa.array([c["wide"] for c in cells], pa.bool_()), inner], ["text", "wide", "parts"])
                columns = [pa.array(values, f.type) for values, f in zip(zip(*made, strict=True), kinds, strict=True)]
                return pa.RecordBatch.from_arrays([*own, *columns, outer], [*keep, *kinds.names, "cells"])

            for i in range(batch.num_rows):
                page_row = -1
                for table_no, table in enumerate(page_tables(batch.column("_html")[i].as_py())):
                    for row_no, (part, kind, cells) in enumerate(table["rows"]):
                        at.append(i)
                        page_row += 1
                        made.append((table_no, table["id"], table["nested"], table["header"], row_no, part, kind, page_row))
                        rows.append(cells)
                        if len(rows) == MOST_ROWS:
                            yield out()
                            at, made, rows = [], [], []
            if rows:
                yield out()

    # A batch holds whole pages; the session's own default is meant for rows of a few numbers.
    for setting, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", MOST_PAGES), ("spark.sql.execution.arrow.maxBytesPerBatch", MOST_BYTES)):
        if not 0 < int(df.sparkSession.conf.get(setting).rstrip("bB")) <= most:
            df.sparkSession.conf.set(setting, str(most))
    pages = df.filter(F.length(html) >= least_length).select(*keep, F.col(html).alias("_html"))
    return pages.mapInArrow(run, ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), ROW]))


def marked_text(cell: Column, tag: str, kind: str | None = None) -> Column:
    """The texts of a cell within a tag (of a class, if given), put together; null if there is none."""
    inside = F.filter(cell["parts"], lambda p: (p["tag"] == tag) & (F.lit(True) if kind is None else F.coalesce(p["kind"] == kind, F.lit(False))))
    return F.when(F.size(inside) > 0, F.array_join(F.transform(inside, lambda p: p["text"]), ""))


def page_links(html: Column, pattern: Column) -> Column:
    """The distinct targets of a page's anchors that match a pattern as a whole, in order."""
    found = F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: F.regexp_like(x, F.concat(F.lit("^"), pattern, F.lit("$"))))))
