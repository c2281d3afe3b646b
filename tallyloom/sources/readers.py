"""Readers: lines of text documents, HTML tables and links, patch files in JSON, reviewed pairs in TSV."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def patches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of objects, by a schema of its own so that an empty array is no problem."""
    return spark.read.schema(schema).json(path, multiLine=True)


def reviewed_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True)


def nested_entries(spark: SparkSession, path: str, entry: str) -> DataFrame:
    """A JSON file of three nested maps (year, gender, discipline) of entry lists as rows."""
    kind = f"map<string,map<string,map<string,array<{entry}>>>>"
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("m"))
    rows = rows.select(F.explode("m").alias("year", "m")).select("year", F.explode("m").alias("gender", "m"))
    rows = rows.select("year", "gender", F.explode("m").alias("discipline", "e"))
    return rows.select("year", "gender", "discipline", F.posexplode("e").alias("position", "e")).select("year", "gender", "discipline", "position", "e.*")


def lines(df: DataFrame, identifier: str, text: str) -> DataFrame:
    """A row for each line of a document, numbered from 0."""
    return df.select(identifier, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def between_tags(html: Column, tag: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, f"(?s)<{tag}[^>]*>([^<]*)</{tag}>", 1)), F.lit(""))


def links(html: Column) -> Column:
    """The distinct targets of a page's anchors, in order."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(html, F.lit('<a href="([^"]*)"'), F.lit(1))))


class _Tables(HTMLParser):
    """Cells of all tables: (table number, row number, cells), in the order in which rows end."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables, self.open, self.rows = 0, [], []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.open.append({"no": self.tables, "row": -1, "cells": None, "cell": None})
            self.tables += 1
        elif self.open:
            top = self.open[-1]
            if tag == "tr":
                self._end_row()
                top["row"] += 1
                top["cells"] = []
            elif tag in ("td", "th") and top["cells"] is not None:
                self._end_cell()
                top["cell"] = []

    def handle_endtag(self, tag: str) -> None:
        if not self.open:
            return
        if tag in ("td", "th"):
            self._end_cell()
        elif tag == "tr":
            self._end_row()
        elif tag == "table":
            self._end_row()
            self.open.pop()

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1]["cell"] is not None:
            self.open[-1]["cell"].append(data)

    def _end_cell(self) -> None:
        top = self.open[-1]
        if top["cell"] is not None:
            top["cells"].append(" ".join("".join(top["cell"]).split()))
            top["cell"] = None

    def _end_row(self) -> None:
        self._end_cell()
        top = self.open[-1]
        if top["cells"] is not None:
            self.rows.append((top["no"], top["row"], top["cells"]))
            top["cells"] = None


def table_rows(html: str) -> list[tuple[int, int, list[str]]]:
    parser = _Tables()
    parser.feed(html)
    parser.close()
    while parser.open:
        parser.handle_endtag("table")
    return parser.rows


def html_tables(df: DataFrame, identifier: str, html: str, least_length: int = 0) -> DataFrame:
    """(identifier, table_no, row_no, cells) of every table row; shorter pages count as blank ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, *row) for i, text in zip(batch[identifier], batch["_html"], strict=True) for row in table_rows(text)]
            yield pd.DataFrame(rows, columns=[identifier, "table_no", "row_no", "cells"])

    pages = df.filter(F.length(html) >= least_length).select(identifier, F.col(html).alias("_html"))
    return pages.mapInPandas(run, f"{identifier} {df.schema[identifier].dataType.simpleString()}, table_no int, row_no int, cells array<string>")
