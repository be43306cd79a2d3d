"""What a product listing says about its article: words, measures, colour, model, brand.

Measures are brought into one unit and rounded so coarsely that the usual ways
of writing one size (1/2", 12,7 mm, 13 mm) come out equal.
"""

from __future__ import annotations

import html
import re
import unicodedata

# fixed values: colour words
COLOURS = {
    **dict.fromkeys(("azul", "azl", "blue", "azules"), "azul"),
    **dict.fromkeys(("rojo", "rjo", "red", "roja"), "rojo"),
    **dict.fromkeys(("negro", "ngo", "black", "negra"), "negro"),
    **dict.fromkeys(("blanco", "blco", "bco", "white", "blanca"), "blanco"),
    **dict.fromkeys(("gris", "grs", "gray", "grey"), "gris"),
    **dict.fromkeys(("verde", "vde", "green"), "verde"),
    **dict.fromkeys(("terracota", "terrac", "terracotta"), "terracota"),
    **dict.fromkeys(("amarillo", "amarilla", "aml", "yellow"), "amarillo"),
    **dict.fromkeys(("cafe", "marron", "brown"), "cafe"),
    **dict.fromkeys(("beige", "bge"), "beige"),
}
# fixed values: factors into millimetres, kilograms, litres
_LENGTH = {**dict.fromkeys(("mm", "mms", "milimetro", "milimetros"), 1.0), **dict.fromkeys(("cm", "cms", "centimetro", "centimetros"), 10.0), **dict.fromkeys(("m", "mt", "mts", "metro", "metros"), 1000.0), **dict.fromkeys(("in", "pulg", "pulgada", "pulgadas", "inch"), 25.4), **dict.fromkeys(("ft", "pie", "pies"), 304.8)}
_MASS = {**dict.fromkeys(("kg", "kgs", "kilo", "kilos", "kilogramos"), 1.0), **dict.fromkeys(("g", "gr", "gramo", "gramos"), 0.001), **dict.fromkeys(("lb", "lbs", "libra", "libras"), 0.45359237)}
_VOLUME = {**dict.fromkeys(("l", "lt", "lts", "litro", "litros"), 1.0), **dict.fromkeys(("ml", "cc", "cm3"), 0.001), **dict.fromkeys(("gal", "gl", "galon", "galones"), 3.785411784)}
_SMALL = {"mm", "mms", "milimetro", "milimetros", "cm", "cms", "g", "gr", "grs", "gramo", "gramos", "ml", "cc", "cm3"}
# fixed values: company forms and lines of trade behind a brand
_BRAND_TAIL = re.compile(r"\s+(?:s\.?a\.?|ltda\.?|chile|pro|spa|inc\.?)$")
# fixed values: what stands in a brand field that names no brand (letters only)
_NO_BRAND = {"", "sinmarca", "sm", "na", "nd", "noinforma", "noaplica", "generico", "generica", "null", "none", "otro", "otros", "varios"}

_NUM = r"\d+(?:[.,]\d+)*"
_MIXED = rf"(?:\d+\s+\d+/\d+|\d+/\d+|{_NUM})"
_UNITS = "|".join(sorted([*_LENGTH, *_MASS, *_VOLUME], key=len, reverse=True))
_PRICE_PER = re.compile(rf"[(\-]?\s*(?:(?:precio|valor)\s+(?:por|x)\s+|\$\s*/\s*)(?:{_NUM}\s*)?[a-z/]+[23]?(?:\s+(?:lineal(?:es)?|cuadrados?))?\s*\)?")
_SECTION = re.compile(rf"({_NUM})\s*(?:mm2|mm\s+cuadrados?|milimetros?\s+cuadrados?)(?![a-z0-9])")
_TILE = re.compile(rf"(?<![\d.,/])({_NUM})\s*x\s*({_NUM})\s*({'|'.join(sorted(_LENGTH, key=len, reverse=True))})(?![a-z0-9])")
_ONE = re.compile(rf"(?<![\d.,/a-z])({_MIXED})\s*({_UNITS})(?![a-z0-9])")
_MODEL = re.compile(r"(?<![a-z0-9])([a-z]{2,4})[\s\-]?(\d{3,5})(?![a-z0-9]|[.,/]\d)")
_POWER = re.compile(rf"(?<![\d.,/a-z])({_NUM})\s*(?:w|watt|watts|vatios)(?![a-z0-9])")
_VOLT = re.compile(rf"(?<![\d.,/a-z])({_NUM})\s*(?:v|volt|volts|voltios)(?![a-z0-9])")
_COUNT = re.compile(
    r"(?:pack|set|caja|bolsa|kit|paquete|blister|estuche)\s+(?:de\s+)?(?:x\s*)?(\d+)(?!\d|[.,/]\d)"
    r"|(?<![\d.,/a-z])(\d+)\s*(?:un|und|unid|unidad|unidades|u|uds|piezas|pzas)\.?(?![a-z0-9])|(?<![a-z0-9.,/])x\s?(\d+)(?![\da-z]|[.,/]\d)"
)
_WORD = re.compile(r"[a-z]{3,}")
_NOT_MODEL = {"pack", "set", "caja", "de", "ref", "mod", "x"}
_FILL = {"color", "tono", "pack", "set", "caja", "bolsa", "unidades", "unidad", "mod", "ref", "modelo", "pulg", "para", "con", "por", "del", "cuadrados", "watts", "volts"} | set(_LENGTH) | set(_MASS) | set(_VOLUME)


def folded(text: str | None) -> str:
    """Unescaped, lower case, no accents; inch marks as unit words."""
    t = html.unescape(text or "").lower()
    t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    t = t.replace("⁄", "/")
    return re.sub(r"''|\"|”|“|″", " in ", t)


def _value(s: str, unit: str = "") -> float:
    s = s.strip()
    if "/" in s:
        whole, _, frac = s.rpartition(" ")
        a, b = frac.split("/")
        return (float(whole) if whole.strip() else 0.0) + (float(a) / float(b) if float(b) else 0.0)
    if unit in _SMALL and re.fullmatch(r"[1-9]\d{0,2}(?:\.\d{3})+", s):
        return float(s.replace(".", ""))
    s = s.replace(",", ".")
    head, dot, tail = s.rpartition(".")
    return float(head.replace(".", "") + dot + tail)


def _digits(x: float, n: int) -> str:
    return f"{float(f'{x:.{n - 1}e}'):g}"


def _millimetres(x: float) -> str:
    return str(int(x + 0.5 + 1e-9)) if x < 1000 else _digits(x, 3)


def brand_key(brand: str | None) -> str:
    """The brand as letters only, without company form; '' if none is named."""
    b = re.sub(r"[®™©]", "", folded((brand or "").replace("™", "").replace("®", ""))).strip()
    b = _BRAND_TAIL.sub("", b)
    b = re.sub(r"[^a-z0-9]", "", b)
    return "" if b in _NO_BRAND else b


def parse_listing(name: str | None, brand: str | None) -> tuple[list[str], dict[str, str], str]:
    """(words, measures, brand key) of a listing; measures: colour, model, section, tile, small, large, mass, volume, power, volt, count."""
    t = _PRICE_PER.sub(" ", folded(name))
    got: dict[str, str] = {}

    def take(rx: re.Pattern, text: str, use) -> str:
        def one(m: re.Match) -> str:
            return " ; " if use(m) else m.group(0)

        return rx.sub(one, text)

    def section(m):
        return got.setdefault("section", _digits(_value(m[1]), 3))

    def tile(m):
        sides = sorted((_value(m[1], m[3]) * _LENGTH[m[3]], _value(m[2], m[3]) * _LENGTH[m[3]]))
        return got.setdefault("tile", "x".join(_millimetres(x) for x in sides))

    def measure(m):
        v, u = _value(m[1], m[2]), m[2]
        if u in _LENGTH:
            mm = v * _LENGTH[u]
            got.setdefault("small" if mm < 500 else "large", _millimetres(mm))
        elif u in _MASS:
            got.setdefault("mass", _digits(v * _MASS[u], 3))
        else:
            got.setdefault("volume", _digits(v * _VOLUME[u], 2))
        return True

    def count(m):
        got.setdefault("count", str(int(m[1] or m[2] or m[3])))
        return True

    def model(m):
        if m[1] in _NOT_MODEL or m[1] in _FILL:
            return False
        got.setdefault("model", m[1] + m[2])
        return True

    t = take(_SECTION, t, section)
    t = take(_TILE, t, tile)
    t = take(_ONE, t, measure)
    t = take(_POWER, t, lambda m: got.setdefault("power", _digits(_value(m[1]), 3)))
    t = take(_VOLT, t, lambda m: got.setdefault("volt", _digits(_value(m[1]), 3)))
    t = take(_COUNT, t, count)
    t = take(_MODEL, t, model)
    words = []
    for w in _WORD.findall(t):
        if w in COLOURS:
            got.setdefault("colour", COLOURS[w])
        elif w not in _FILL:
            words.append(w)
    return list(dict.fromkeys(words)), got, brand_key(brand)
