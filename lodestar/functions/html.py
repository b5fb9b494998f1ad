"""Text and links of HTML pages."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SILENT = ("script", "style", "template")


class _Reader(HTMLParser):
    """Collects the visible text and the targets of links."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.links: list[str] = []
        self.silent = 0

    def handle_starttag(self, tag, attrs) -> None:
        if tag in _SILENT:
            self.silent += 1
        elif tag == "a":
            self.links.extend(v for k, v in attrs if k == "href" and v is not None)

    def handle_endtag(self, tag) -> None:
        if tag in _SILENT and self.silent:
            self.silent -= 1

    def handle_data(self, data) -> None:
        if not self.silent:
            self.pieces.append(data)


def _read(html: str | None) -> _Reader | None:
    if html is None:
        return None
    reader = _Reader()
    reader.feed(html)
    reader.close()
    return reader


@F.pandas_udf(T.StringType())
def html_text(html: pd.Series) -> pd.Series:
    """The text of a page without scripts, styles and comments; NULL for NULL."""
    return html.map(lambda h: None if (r := _read(h)) is None else "".join(r.pieces))


@F.pandas_udf(T.ArrayType(T.StringType()))
def html_links(html: pd.Series, base: pd.Series) -> pd.Series:
    """Targets of all links, made absolute, those with a host; fragments and repetitions stay. NULL for NULL."""

    def links(h: str | None, b: str | None) -> list[str] | None:
        reader = _read(h)
        if reader is None:
            return None
        out = []
        for link in reader.links:
            try:
                url = urljoin(b or "", link)
                if urlparse(url).netloc:
                    out.append(url)
            except ValueError:
                continue
        return out

    return pd.Series([links(h, b) for h, b in zip(html, base, strict=True)])


def accepted(status: Column, content_type: Column) -> Column:
    """Whether a response is a page: status 200 and HTML."""
    return (status == 200) & F.lower(content_type).contains("text/html")
