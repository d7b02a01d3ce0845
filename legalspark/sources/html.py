"""Rows of listing tables in HTML pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame


class _Tables(HTMLParser):
    """Cells (text, links) of the rows of one table, or of all tables."""

    def __init__(self, table_id: str | None):
        super().__init__(convert_charrefs=True)
        self.table_id, self.depth, self.rows, self.cell = table_id, 0, [], None

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag == "table" and (self.depth or self.table_id is None or attrs.get("id") == self.table_id):
            self.depth += 1
        if not self.depth:
            return
        if tag == "tr":
            self.rows.append([])
        elif tag == "td" and self.rows:
            self.cell = ["", []]
            self.rows[-1].append(self.cell)
        elif tag == "a" and self.cell is not None and attrs.get("href"):
            self.cell[1].append(attrs["href"])

    def handle_endtag(self, tag):
        if tag == "table" and self.depth:
            self.depth -= 1
        elif tag == "td":
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell[0] += data


def parse_listing_html(pages: DataFrame, columns: dict[str, int], min_columns: int, table_id: str | None = None, link_column: str = "link", link_contains: str = "", key: str = "page_id") -> DataFrame:
    """key, row, the named cells by position, and the first link of the row that contains a string (empty if none).

    Rows of fewer cells are left out. One page is parsed at a time inside a task; pages are not shuffled.
    """
    names = list(columns)
    schema = f"{key} {pages.schema[key].dataType.simpleString()}, row int, " + ", ".join(f"{c} string" for c in [*names, link_column])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for page, html in zip(pdf[key], pdf["html"], strict=True):
                parser = _Tables(table_id)
                parser.feed(html or "")
                good = [r for r in parser.rows if len(r) >= min_columns]
                for n, cells in enumerate(good):
                    links = [x for _, own in cells for x in own if link_contains in x]
                    out.append((page, n, *[" ".join(cells[columns[c]][0].split()) for c in names], links[0] if links else ""))
            yield pd.DataFrame(out, columns=[key, "row", *names, link_column])

    return pages.select(key, "html").mapInPandas(run, schema)
