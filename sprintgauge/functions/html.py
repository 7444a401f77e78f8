"""HTML to text with the standard library's tolerant parser."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Elements whose strings are not part of a page's text.
SILENT_ELEMENTS = {"script", "style", "template", "rt", "rp"}


# Elements that have no content and no end tag.
VOID_ELEMENTS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_CDATA = "CDATA["


class _TextNodes(HTMLParser):
    """Collects text nodes outside silent elements; entities are decoded by the base class.

    The open elements are kept on a stack: an end tag closes what was opened inside
    it, so a silent element left open ends with its parent. CDATA sections are text.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.open: list[str] = []
        self.silent = 0

    def handle_starttag(self, tag, attrs):
        if tag not in VOID_ELEMENTS:
            self.open.append(tag)
            self.silent += tag in SILENT_ELEMENTS

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        if tag in self.open:
            while True:
                closed = self.open.pop()
                self.silent -= closed in SILENT_ELEMENTS
                if closed == tag:
                    break

    def handle_data(self, data):
        if not self.silent:
            self.pieces.append(data)

    def unknown_decl(self, data):
        if data.startswith(_CDATA):
            self.handle_data(data[len(_CDATA):].removesuffix("]]"))

    def handle_comment(self, data):  # newer parsers report CDATA outside foreign content here
        if data.startswith("[" + _CDATA):
            self.handle_data(data[len(_CDATA) + 1:].removesuffix("]]"))


def _text_of(markup: str | None) -> str | None:
    if markup is None:
        return None
    parser = _TextNodes()
    parser.feed(markup)
    parser.close()
    return "".join(parser.pieces)


@F.pandas_udf(T.StringType())
def _parse(markups: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in markups:
        yield batch.map(_text_of, na_action="ignore")


def html_to_text(text: Column) -> Column:
    """Text nodes joined without a separator.

    Only rows that can hold markup or an entity travel to Python: the others
    are sent as NULL and answered by the JVM side of the ``coalesce``.
    """
    suspect = text.rlike("[<&]")
    return F.coalesce(_parse(F.when(suspect, text)), text)
