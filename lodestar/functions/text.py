"""Column expressions over text and URLs; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Unicode defines it, besides the four ASCII separators.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
# The stopwords of the index.
INDEX_STOPWORDS = ("the", "a", "an", "and", "or", "but", "is", "in", "on", "at", "to", "for", "with")


def strip(c: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def normalise_url(c: Column) -> Column:
    return F.lower(strip(c))


def url_host(c: Column) -> Column:
    """Host in lower case without user, port and leading ``www.``; NULL where there is none."""
    authority = r"^(?:[a-z][a-z0-9+.\-]*:)?(?://)?(?:[^/?#@]*@)?(?:www\.)?(\[[^\]]*\]|[^/?#:]+)"
    host = F.regexp_extract(normalise_url(c), authority, 1)
    return F.when(host != "", host)


def url_depth_weight(url: Column) -> Column:
    """0.3 for at most three slashes (the scheme's two count), 2 for five or more, else 1."""
    slashes = F.length(url) - F.length(F.replace(url, F.lit("/")))
    return F.when(slashes <= 3, 0.3).when(slashes >= 5, 2.0).otherwise(1.0)


def anchorless(url: Column) -> Column:
    return F.substring_index(F.lower(url), "#", 1)


def tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores that consist of three or more letters a-z, in order."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}_]+")
    return F.filter(words, lambda w: w.rlike("^[a-z]{3,}$"))


def index_tokens(text: Column, stopwords: tuple[str, ...] = INDEX_STOPWORDS) -> Column:
    return F.filter(tokens(text), lambda w: ~w.isin(*stopwords))


def content_lines(text: Column) -> Column:
    """Stripped lines that aren't blank."""
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")


def title(text: Column, default: Column | str = "Untitled Page", width: int = 100) -> Column:
    default = F.lit(default) if isinstance(default, str) else default
    return F.coalesce(F.substring(F.try_element_at(content_lines(text), F.lit(1)), 1, width), default)


def snippet(text: Column, default: str = "No snippet available.", width: int = 200) -> Column:
    """The first ``width`` characters of the lines joined by blanks, always with three dots after them."""
    lines = content_lines(text)
    return F.when(F.size(lines) > 0, F.concat(F.substring(F.array_join(lines, " "), 1, width), F.lit("..."))).otherwise(F.lit(default))
