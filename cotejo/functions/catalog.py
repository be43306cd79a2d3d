"""Normalisation of names, brands, units, URLs and prices as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cotejo.functions.text import clean_text, html_unescape, let, strip_accents

# fixed values: words that carry no meaning in a product name
STOP_WORDS = ("de", "del", "la", "las", "el", "los", "para", "con", "sin", "en", "por", "y", "o", "un", "una", "x", "tipo", "modelo", "kit", "set", "pack")
MIN_TOKEN = 3
# fixed values: spellings of brands
BRAND_ALIASES = {
    "black and decker": "BLACK+DECKER", "black decker": "BLACK+DECKER", "black+decker": "BLACK+DECKER", "dewalt": "DEWALT", "makita": "MAKITA", "stanley": "STANLEY",
    "bosch": "BOSCH", "sika": "SIKA", "ceresita": "CERESITA", "tricolor": "TRICOLOR", "sherwin": "SHERWIN", "sherwin williams": "SHERWIN WILLIAMS",
    "sin marca": "SIN MARCA", "sinmarca": "SIN MARCA", "generico": "GENERICO",
}
NO_BRAND = "SIN MARCA"
# fixed values: spellings of units
UNIT_ALIASES = {
    "m": "m", "mt": "m", "metro": "m", "metros": "m", "m2": "m2", "m3": "m3", "kg": "kg", "kgs": "kg", "kilo": "kg", "kilos": "kg", "g": "gr", "gr": "gr", "gramo": "gr", "gramos": "gr",
    "lt": "lt", "lts": "lt", "litro": "lt", "litros": "lt", "ml": "ml", "u": "un", "un": "un", "unidad": "un", "unidades": "un",
}
# fixed values: query parameters that only track visitors (besides utm_*)
TRACKING_KEYS = ("sponsoredclickdata", "gclid", "gclsrc", "gbraid", "wbraid", "fbclid", "gad_source", "gad_campaignid", "srsltid", "ref", "source")
# fixed values: measures that a name states: key, pattern, suffix
SPEC_PATTERNS = (
    ("voltaje", r"(\d+(?:[.,]\d+)?)\s*v\b", "V"),
    ("capacidad", r"(\d+(?:[.,]\d+)?)\s*ah\b", "Ah"),
    ("diametro", r"(\d+(?:[.,]\d+)?)\s*mm\b", "mm"),
    ("peso", r"(\d+(?:[.,]\d+)?)\s*(?:kg|kilos?)\b", "kg"),
    ("volumen", r"(\d+(?:[.,]\d+)?)\s*(?:lt|l|litros?)\b", "lt"),
    ("presentacion_galon", r"(\d+\s*/\s*\d+)\s*gal\b", "gal"),
)
# fixed value: how a unit price is written
UNIT_PRICE = r"\$\s*([\d.,]+)\s*(?:por|/)\s*(m[23]?|kgs?|kilos?|gr|gramos?|g|lts?|litros?|ml|un(?:idad(?:es)?)?|u)\b"


def _lookup(mapping: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv)), key)


def plain(x: Column) -> Column:
    """Unescaped, lower case, accent-free, single blanks."""
    return clean_text(strip_accents(F.lower(html_unescape(F.coalesce(x, F.lit(""))))))


def name_words(name: Column) -> Column:
    """Array of the meaningful words of a name."""
    words = F.split(F.regexp_replace(plain(name), r"[^a-z0-9\s]", " "), r"\s+")
    return F.filter(words, lambda w: (F.length(w) >= MIN_TOKEN) & ~w.isin(*STOP_WORDS))


def normalize_name(name: Column) -> Column:
    return F.array_join(name_words(name), " ")


def normalize_brand(brand: Column) -> Column:
    return let(plain(brand), lambda b: F.when(b == "", F.lit(NO_BRAND)).otherwise(F.coalesce(_lookup(BRAND_ALIASES, b), F.upper(b))))


def normalize_unit(unit: Column) -> Column:
    """Canonical unit or null."""
    u = F.translate(F.lower(clean_text(unit)), "²³", "23")
    return _lookup(UNIT_ALIASES, F.regexp_replace(u, "[^a-z0-9]", ""))


def name_tokens(normalized: Column) -> Column:
    """Distinct tokens of at least three letters or digits."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(normalized), F.lit("([a-z0-9]+)"), F.lit(1)), lambda t: F.length(t) >= MIN_TOKEN))


def numeric_specs(name: Column) -> Column:
    """Map of the measures that a name states, first occurrence each."""

    def cells(t: Column) -> Column:
        found = []
        for key, pattern, suffix in SPEC_PATTERNS:
            v = F.replace(F.replace(F.regexp_extract(t, pattern, 1), F.lit(","), F.lit(".")), F.lit(" "), F.lit(""))
            found.append(F.when(v != "", F.struct(F.lit(key).alias("key"), F.concat(v, F.lit(suffix)).alias("value"))))
        return F.array_compact(F.array(*found))

    return F.map_from_entries(let(plain(name), cells))


def spec_text(specs: Column) -> Column:
    """A map of measures as sorted text: k=v;k=v."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(specs), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")


def effective_price(*prices: Column) -> Column:
    """Smallest positive price; null if there is none."""
    return F.least(*(F.when(p.cast("long") > 0, p.cast("long")) for p in prices))


def quality_flags(brand: Column, sku: Column, price: Column, unit: Column, unit_price: Column, name: Column) -> Column:
    """Flags in fixed order; brand, unit and name are normalised values."""
    checks = (
        ("missing_brand", brand == NO_BRAND),
        ("missing_sku", F.coalesce(sku, F.lit("")) == ""),
        ("missing_effective_price", price.isNull()),
        ("unknown_unit", unit.isNull() & unit_price.isNotNull()),
        ("empty_name_normalized", F.coalesce(name, F.lit("")) == ""),
    )
    return F.array_compact(F.array(*(F.when(c, F.lit(f)) for f, c in checks)))


def parse_number(value: Column) -> Column:
    """A numeric price as a whole number, halves to the even one."""
    return F.rint(value.cast("double")).cast("bigint")


def parse_price(text: Column) -> Column:
    """All digits of a text as one number; null without digits."""
    return F.nullif(F.regexp_replace(text, r"[^0-9]", ""), F.lit("")).try_cast("bigint")


def unit_price_from_text(text: Column) -> Column:
    """struct<amount, unit> of the first '$ n por unit' in a text."""
    t = F.translate(F.lower(clean_text(text)), "²³", "23")
    pairs = F.arrays_zip(F.regexp_extract_all(t, F.lit(UNIT_PRICE), F.lit(1)).alias("a"), F.regexp_extract_all(t, F.lit(UNIT_PRICE), F.lit(2)).alias("u"))
    read = F.transform(pairs, lambda p: F.struct(parse_price(p["a"]).alias("amount"), normalize_unit(p["u"]).alias("unit")))
    return F.get(F.filter(read, lambda p: p["amount"].isNotNull() & p["unit"].isNotNull()), F.lit(0))


def bag_difference(bag: Column, used: Column) -> Column:
    """``bag`` without one occurrence of each element of ``used``; order kept, nulls in ``used`` ignored."""

    def drop_one(acc: Column, u: Column) -> Column:
        at = F.coalesce(F.array_position(acc, u), F.lit(0)).cast("int")
        return F.when(at == 0, acc).otherwise(F.filter(acc, lambda _x, i: i != at - 1))

    return F.aggregate(F.filter(used, lambda u: u.isNotNull()), bag, drop_one)


# RFC 3986: scheme, authority, path, query; used instead of parse_url, which rejects what shops really write
_URL = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def url_part(url: Column, part: str) -> Column:
    return F.regexp_extract(clean_text(url), _URL, {"scheme": 1, "host": 2, "path": 3, "query": 4}[part])


def canonical_url(url: Column) -> Column:
    """Without query and fragment, a repeated /p suffix collapsed."""
    bare = F.regexp_replace(clean_text(F.coalesce(url, F.lit(""))), r"[?#].*$", "")
    return F.regexp_replace(bare, r"(?i)(/p)(?:/p)+$", "$1")


def lookup_url(url: Column) -> Column:
    """canonical_url with scheme and host in lower case and no trailing slashes."""
    c = canonical_url(url)
    head = F.regexp_extract(c, r"^([^:/?#]+://[^/]*)", 1)
    return F.regexp_replace(F.concat(F.lower(head), F.substring(c, F.length(head) + 1, F.length(c))), r"/+$", "")


def untracked_url(url: Column) -> Column:
    """URL without fragment and without tracking parameters; other parameters stay in order."""
    u = clean_text(F.coalesce(url, F.lit("")))
    bare = F.regexp_replace(u, r"[?#].*$", "")
    kept = F.filter(F.split(url_part(u, "query"), "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING_KEYS) & ~F.lower(p).startswith("utm_"))
    q = F.array_join(kept, "&")
    return F.when(q == "", bare).otherwise(F.concat(bare, F.lit("?"), q))


def bare_url(url: Column) -> Column:
    """URL up to the first # or ?."""
    return F.substring_index(F.substring_index(url, "#", 1), "?", 1)


def listing_url(url: Column) -> Column:
    """URL without fragment, a repeated /p suffix collapsed; the query stays."""
    u = clean_text(F.coalesce(url, F.lit("")))
    q = url_part(u, "query")
    return F.concat(canonical_url(u), F.when(q == "", F.lit("")).otherwise(F.concat(F.lit("?"), q)))


def search_url(base: str, query: Column) -> Column:
    """Search page of a shop for a normalised query; null if nothing of it is left."""
    q = normalize_name(query)
    return F.when(q != "", F.concat(F.lit(f"{base}/search?q="), F.url_encode(q)))


def url_decoded(x: Column) -> Column:
    """Percent-decoding in which '+' stays '+'; undecodable text stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)


def url_segments(url: Column) -> Column:
    return F.filter(F.split(url_decoded(url_part(url, "path")), "/"), lambda s: s != "")


# fixed values: where shops' paths hold the SKU
SKU_PATTERNS = (r"/articulo/\d+/[^/]+/(\d+)", r"-([0-9]{5,})/p", r"/(\d{5,})$")


def sku_from_url(url: Column) -> Column:
    path = url_decoded(url_part(url, "path"))
    found = (F.nullif(F.regexp_extract(path, p, 1), F.lit("")) for p in SKU_PATTERNS)
    return F.coalesce(*found, F.lit(""))


def slug(url: Column) -> Column:
    """Last path segment; the one before where the last is only digits."""

    def pick(s: Column) -> Column:
        last, before = F.get(s, F.size(s) - 1), F.get(s, F.size(s) - 2)
        return F.coalesce(F.when(last.rlike(r"^\d+$") & (F.size(s) >= 2), before).otherwise(last), F.lit(""))

    return let(url_segments(url), pick)


def category_from_url(url: Column) -> Column:
    """The category that a shop's URL names, by the shops' URL layouts; '' if none."""
    named = lambda s: normalize_name(F.replace(s, F.lit("-"), F.lit(" ")))

    def pick(s: Column) -> Column:
        low = F.transform(s, F.lower)
        at = lambda w: F.array_position(low, w).cast("int")  # noqa: E731  (1-based, 0: absent)
        key = lambda x, keep: F.regexp_replace(strip_accents(F.lower(x)), f"[^a-z0-9{keep}]", "")
        tail = F.reverse(F.slice(s, at("lista") + 1, F.greatest(F.size(s) - at("lista"), F.lit(0))))
        listed = F.get(F.filter(F.transform(F.filter(tail, lambda x: ~key(x, "").rlike(r"^(\d*|cat[a-z0-9]*)$")), named), lambda x: x != ""), F.lit(0))
        first = F.get(F.filter(s, lambda x: ~key(x, "-").rlike(r"^\d*$") & ~key(x, "-").isin("sodimac-cl", "articulo", "product", "category", "lista")), F.lit(0))
        before = lambda i: named(F.get(s, i))
        return (
            F.when((F.size(s) == 0) | (at("articulo") > 0), F.lit(""))
            .when((at("lista") > 0) & listed.isNotNull(), listed)
            .when(at("category") > 1, before(at("category") - 2))
            .when(at("product") > 2, before(at("product") - 3))
            .when(at("product") > 1, before(at("product") - 2))
            .when((F.size(s) <= 2) & F.get(low, F.size(s) - 1).isin("p", "pdp"), F.lit(""))
            .otherwise(F.coalesce(named(first), F.lit("")))
        )

    return let(url_segments(F.coalesce(url, F.lit(""))), pick)


def short_id(*parts: Column) -> Column:
    """16 hex digits of the SHA-1 of parts joined by '|'; nulls count as ''."""
    return F.substring(F.sha1(F.concat_ws("|", *(F.coalesce(p, F.lit("")) for p in parts))), 1, 16)


def pair_key(left_id: Column, right_id: Column, left_sku: Column, right_sku: Column) -> Column:
    """Order-free key of a pair: by row ids where both exist, else by store:sku."""
    blank = lambda x: F.coalesce(x, F.lit("")) == ""
    both = lambda a, b: F.array_join(F.array_sort(F.array(a, b)), "|")
    return F.when(~blank(left_id) & ~blank(right_id), F.concat(F.lit("row:"), both(left_id, right_id))).otherwise(F.concat(F.lit("sku:"), both(left_sku, right_sku)))


def decision_label(x: Column) -> Column:
    """MATCH, NO_MATCH or UNSURE of a free-text verdict."""
    t = F.upper(F.trim(F.coalesce(x, F.lit(""))))
    return F.when(t.isin("MATCH", "NO_MATCH", "UNSURE"), t).when(t.contains("NO") & t.contains("MATCH"), "NO_MATCH").when(t.contains("MATCH"), "MATCH").otherwise("UNSURE")


def product_title(name: Column) -> Column:
    """Words capitalised, single blanks."""
    return F.initcap(clean_text(F.lower(name)))


def pesos(amount: Column) -> Column:
    """$ with dots between thousands."""
    return F.concat(F.lit("$"), F.translate(F.format_number(amount, 0), ",", "."))


def in_uf(amount: Column, rate: Column) -> Column:
    """Amount in UF with four decimals; '-' without a positive rate."""
    return F.when(rate > 0, F.format_string("%.4f UF", (amount / rate).cast("double"))).otherwise("-")


def initials(name: Column) -> Column:
    return F.array_join(F.transform(F.filter(F.split(clean_text(name), " "), lambda w: w != ""), lambda w: F.upper(F.substring(w, 1, 1))), "")
