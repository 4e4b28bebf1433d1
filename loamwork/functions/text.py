"""Column builders for text, money, URLs and HTML; all stay in generated code but the full urljoin."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The number inside a money string, and what marks a script as data.
MONEY = r"[-+]?\d[\d,]*\.?\d*"
DATA_SCRIPT = r"(?is)<script\b[^>]*(?:application/(?:ld\+)?json|__NEXT_DATA__)[^>]*>(.*?)</script>"
BLANK = r"(?U)\s+"
# What a page loses before it is read.
UNREAD = (r"(?is)<style\b[^>]*>.*?</style>|<svg\b[^>]*>.*?</svg>", r"(?is)<script\b[^>]*>.*?</script>", r"(?s)<!--.*?-->")


def parse_money(raw: Column) -> Column:
    """First number of a string, commas dropped, as a decimal; null if there is none."""
    return F.nullif(F.regexp_extract(F.replace(raw, F.lit(","), F.lit("")), MONEY, 0), F.lit("")).try_cast("decimal(38,18)")


def clean_text(raw: Column) -> Column:
    return F.trim(F.regexp_replace(raw, BLANK, " "))


def strip(raw: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(raw, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def is_blank(value: Column) -> Column:
    return value.isNull() | (clean_text(value) == "")


def to_float(value: Column) -> Column:
    """Number of a text, commas and outer space dropped; null if it isn't one."""
    return strip(F.replace(value, F.lit(","), F.lit(""))).try_cast("double")


def host(url: Column) -> Column:
    """Lower-case host name without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def first_segment(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/+([^/?#]+)", 1)


def derive_family(url: Column) -> Column:
    """host/first path segment, or the host alone."""
    return F.when(first_segment(url) != "", F.concat(host(url), F.lit("/"), first_segment(url))).otherwise(host(url))


def escaped(text: Column) -> Column:
    """As a literal inside a regular expression."""
    return F.regexp_replace(text, r"([^A-Za-z0-9_\n\r\t])", r"\\$1")


def derive_pattern(url: Column) -> Column:
    """Pattern of the host's URLs that have the first path segment somewhere, followed by / or the end."""
    base = F.concat(F.lit("^https?://"), escaped(host(url)))
    return F.when(first_segment(url) != "", F.concat(base, F.lit(".*/"), escaped(first_segment(url)), F.lit("(/|$)"))).otherwise(base)


def slug(family: Column) -> Column:
    """Readable path segment; null if nothing is left of the family."""
    return F.nullif(F.regexp_replace(F.replace(F.replace(family, F.lit("/"), F.lit("__")), F.lit("."), F.lit("_")), "[^A-Za-z0-9_]", ""), F.lit(""))


def family_dir(family: Column) -> Column:
    return F.concat(slug(family), F.lit("-"), F.substring(F.sha2(family, 256), 1, 8))


def snapshot_name(url: Column) -> Column:
    return F.concat(F.sha2(url, 256), F.lit(".html"))


def class_name(family: Column, suffix: str = "Crawler") -> Column:
    """Alphanumeric runs of a family, each with a capital first letter, and a suffix."""
    parts = F.filter(F.split(family, "[^A-Za-z0-9]+"), lambda x: x != "")
    return F.concat(F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 20))), ""), F.lit(suffix))


def absolutize_rooted(base: Column, href: Column) -> Column:
    """Root-relative and absolute links in generated code; null for none. Others need absolutize."""
    origin = F.regexp_extract(base, r"^([^:/?#]+://[^/?#]*)", 1)
    return F.when(href.isNull() | (href == ""), None).when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("/") & ~href.startswith("//"), F.concat(origin, href))


@F.pandas_udf(T.StringType())
def absolutize(base: pd.Series, href: pd.Series) -> pd.Series:
    """RFC 3986 reference resolution; null for a null or empty link."""
    return pd.Series([urljoin(b, h) if h else None for b, h in zip(base, href)])


def strip_fences(text: Column) -> Column:
    """Without a code fence at either end."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)^\s*```[A-Za-z0-9_-]*\s*", ""), r"\s*```\s*$", "")


def code_block(text: Column) -> Column:
    """Body of the first fenced block, or all of the text, trimmed."""
    body = F.regexp_extract(text, r"(?s)```[A-Za-z0-9_-]*\s*\n(.*?)```", 1)
    return F.btrim(F.when(body != "", body).otherwise(text), F.lit(" \t\r\n"))


def data_islands(html: Column) -> Column:
    """Trimmed bodies of scripts marked as data, in order, without empty ones."""
    bodies = F.transform(F.regexp_extract_all(html, F.lit(DATA_SCRIPT), 1), lambda x: F.btrim(x, F.lit(" \t\r\n\f\u000b")))
    return F.filter(bodies, lambda x: x != "")


def json_islands(html: Column) -> Column:
    """Islands that are JSON, as text; what follows a value makes it none."""
    return F.filter(data_islands(html), lambda x: F.try_parse_json(x).isNotNull() & x.rlike(r"(?s)^(\{.*\}|\[.*\]|\".*\"|-?[0-9.eE+-]+|true|false|null)$"))


def trim_html(html: Column, max_chars: int = 8000, json_max_chars: int | None = None) -> Column:
    """Page text for reading: data islands first, then the page without style, svg, scripts and comments,
    white space collapsed, cut at max_chars code points; islands may have a limit of their own."""
    body = html
    for what in UNREAD:
        body = F.regexp_replace(body, what, "")
    body = clean_text(body)
    islands = data_islands(html)
    front = clean_text(F.concat(F.lit("[[STRUCTURED-DATA-JSON]] "), F.array_join(islands, " ")))
    if json_max_chars is None:
        joined = F.substring(F.concat(front, F.lit(" [[HTML]] "), body), 1, max_chars)
    else:
        joined = F.concat(F.substring(front, 1, json_max_chars), F.lit(" [[HTML]] "), F.substring(body, 1, max_chars))
    return F.when(F.size(islands) == 0, F.substring(body, 1, max_chars)).otherwise(joined)


def soft_404(body: Column, markers: list[str]) -> Column:
    """Whether any marker is in the text, whatever the case; no markers, no match."""
    found = F.lit(False)
    for m in markers:
        found = found | F.contains(F.lower(body), F.lit(m.lower()))
    return found


def is_challenge(body: Column) -> Column:
    # Phrases of challenge pages.
    return F.contains(F.lower(body), F.lit("cf-challenge")) | F.contains(F.lower(body), F.lit("attention required"))
