"""Reading shop pages, sitemaps and model answers that are stored as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cotejo.functions.catalog import url_part
from cotejo.functions.text import clean_text, let

# fixed values: paths and parameters that a crawl must not follow
BLOCKED_PREFIXES = ("/search/", "/_next/", "/login/", "/checkout/", "/quick-view/", "/espiar/", "/tienda/", "/cluster/", "/eventos/", "/account/")
BLOCKED_PARAMS = ("sort", "shop", "page", "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "gclid", "gclsrc", "gbraid", "wbraid", "gad_source", "gad_campaignid", "fbclid", "fbadid", "srsltid", "ref", "idsku", "skuid")


def first_text(page: Column, patterns: Sequence[str]) -> Column:
    """Text of the first pattern (one group each) that finds any; markup removed, '' if none does."""
    found = (F.nullif(clean_text(F.regexp_replace(F.regexp_extract(page, p, 1), "<[^>]*>", " ")), F.lit("")) for p in patterns)
    return F.coalesce(*found, F.lit(""))


def attribute(tag: Column, name: str) -> Column:
    """Value of a tag's attribute; null if absent or empty."""
    return F.nullif(F.regexp_extract(tag, rf"""(?i)\s{name}\s*=\s*["']([^"']*)["']""", 1), F.lit(""))


def absolute(url: Column, base: str) -> Column:
    """URL joined to a base of scheme and host."""
    return F.when(url.rlike("(?i)^https?://"), url).when(url.startswith("//"), F.concat(F.lit(base.split("//")[0]), url)).when(url.startswith("/"), F.concat(F.lit(base), url)).otherwise(F.concat(F.lit(base + "/"), url))


def image_url(page: Column, base: str) -> Column:
    """Image of the first img tag: last srcset entry, else a source attribute that isn't inline data; null if none."""

    def pick(tag: Column) -> Column:
        entries = F.filter(F.transform(F.split(attribute(tag, "srcset"), ", "), F.trim), lambda e: e != "")
        last = F.substring_index(F.get(entries, F.size(entries) - 1), " ", 1)
        plain = (F.when(~attribute(tag, a).startswith("data:"), attribute(tag, a)) for a in ("src", "data-src", "data-lazy-src", "data-original"))
        return absolute(F.coalesce(F.when(last.contains("/"), last), *plain), base)

    return let(F.regexp_extract(page, r"(?is)(<img\b[^>]*>)", 1), pick)


def links(page: Column) -> Column:
    """All href targets in order, without repeats."""
    return F.array_distinct(F.regexp_extract_all(page, F.lit(r"""(?i)<a\b[^>]*?\shref\s*=\s*["']([^"'#]+)"""), F.lit(1)))


def sitemap_locations(xml: Column) -> Column:
    """Array of the loc elements of any namespace; empty for text that isn't a sitemap."""
    return F.transform(F.regexp_extract_all(xml, F.lit(r"(?s)<(?:\w+:)?loc>\s*([^<]*?)\s*</(?:\w+:)?loc>"), F.lit(1)), clean_text)


def crawlable(url: Column) -> Column:
    """Whether a URL is neither under a blocked prefix, nor a filter page, nor carries a blocked parameter."""
    low = F.lower(F.coalesce(url, F.lit("")))
    path = url_part(low, "path")
    blocked = path.contains("/filter/")
    for p in BLOCKED_PREFIXES:
        blocked = blocked | path.startswith(p)
    params = F.regexp_extract_all(url_part(low, "query"), F.lit(r"([a-z0-9_]+)="), F.lit(1))
    return ~(blocked | F.arrays_overlap(params, F.array(*(F.lit(p) for p in BLOCKED_PARAMS))))


def name_from_text(text: Column) -> Column:
    """Card text without a leading discount or 'product' marker."""
    return clean_text(F.regexp_replace(F.regexp_replace(clean_text(text), r"(?i)^\d+%\s*dcto\s+", ""), r"(?i)^products?\s+", ""))


def sku_from_text(text: Column) -> Column:
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)\bSKU\s*:\s*([0-9]{3,})\b", 1)


def json_from_noise(text: Column) -> Column:
    """The JSON object in a model's answer: the whole text, else from the first to the last brace; null if neither parses."""
    valid = lambda x: F.when(F.json_object_keys(x).isNotNull(), x)
    return F.coalesce(valid(F.trim(text)), valid(F.regexp_extract(text, r"(?s)(\{.*\})", 1)))
