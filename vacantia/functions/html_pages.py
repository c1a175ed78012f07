"""Readable text of full HTML pages, partition by partition."""
from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from vacantia.functions.text import clean_lines

# --- Fixed values: elements whose whole subtree is dropped ---
CHROME = frozenset(("script", "style", "nav", "header", "footer", "noscript", "svg"))
# elements that never have content, so they open no subtree
VOID = frozenset((
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr",
))
# --- end of fixed values ---


class _TextNodes(HTMLParser):
    """Collects text nodes outside page chrome; unclosed elements end with their parent."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.hidden = 0
        self.nodes: list[str] = []
        self.same_node = False

    def handle_starttag(self, tag, attrs):
        self.same_node = False
        if tag not in VOID:
            self.open.append(tag)
            self.hidden += tag in CHROME

    def handle_startendtag(self, tag, attrs):
        self.same_node = False

    def handle_endtag(self, tag):
        self.same_node = False
        if tag in self.open:
            while True:
                closed = self.open.pop()
                self.hidden -= closed in CHROME
                if closed == tag:
                    break

    def handle_comment(self, data):
        self.same_node = False

    def handle_data(self, data):
        if self.hidden:
            return
        if self.same_node:
            self.nodes[-1] += data
        else:
            self.nodes.append(data)
            self.same_node = True


def _page_text(html: str | None) -> str:
    parser = _TextNodes()
    parser.feed(html or "")
    parser.close()
    return "\n".join(parser.nodes)


def main_text(pages: DataFrame, html: str = "html", out: str = "main_text") -> DataFrame:
    """Replace the ``html`` column by the page's main text. Narrow: no shuffle.

    Python only walks the markup; trimming and line cleaning run on the JVM.
    """
    schema = T.StructType([f for f in pages.schema.fields if f.name != html] + [T.StructField(out, T.StringType())])

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch[out] = [_page_text(h) for h in batch.pop(html)]
            yield batch

    return pages.mapInPandas(convert, schema).withColumn(out, clean_lines(F.col(out)))
