"""Reading quantities and units out of text, as Column expressions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from cotejo.functions.text import fold, let

# fixed values: conversions into the common unit of each magnitude
INCH, FOOT, POUND, GALLON = Decimal("0.0254"), Decimal("0.3048"), Decimal("0.45359237"), Decimal("3.785411784")
YARD, OUNCE, FLUID_OUNCE = 3 * FOOT, POUND / 16, GALLON / 128
CONVERSIONS: dict[str, list[Decimal]] = {
    "kg": [Decimal(1), Decimal("0.001"), Decimal(1000), POUND, OUNCE],
    "lt": [Decimal(1), Decimal("0.001"), Decimal(1000), GALLON, FLUID_OUNCE],
    "m": [Decimal(1), Decimal("0.01"), Decimal("0.001"), INCH, FOOT, YARD],
    "un": [Decimal(1), Decimal(2), Decimal(12), Decimal(100), Decimal(1000)],
    "m2": [Decimal(1), Decimal("0.0001"), FOOT * FOOT],
}
# fixed values: how units are written (folded text)
NAMES: dict[str, tuple[str, Decimal]] = {
    **dict.fromkeys(("kg", "kgs", "kilo", "kilos", "kilogramo", "kilogramos"), ("kg", Decimal(1))),
    **dict.fromkeys(("g", "gr", "grs", "gramo", "gramos"), ("kg", Decimal("0.001"))),
    **dict.fromkeys(("ton", "tonelada", "toneladas"), ("kg", Decimal(1000))),
    **dict.fromkeys(("lb", "lbs", "libra", "libras"), ("kg", POUND)),
    **dict.fromkeys(("l", "lt", "lts", "litro", "litros"), ("lt", Decimal(1))),
    **dict.fromkeys(("ml", "cc", "cm3", "mililitro", "mililitros"), ("lt", Decimal("0.001"))),
    **dict.fromkeys(("m3", "mt3", "metro cubico", "metros cubicos"), ("lt", Decimal(1000))),
    **dict.fromkeys(("gal", "gl", "galon", "galones"), ("lt", GALLON)),
    **dict.fromkeys(("m", "mt", "mts", "metro", "metros", "metro lineal", "metros lineales", "mt lineal", "mts lineales", "m lineal"), ("m", Decimal(1))),
    **dict.fromkeys(("cm", "cms", "centimetro", "centimetros"), ("m", Decimal("0.01"))),
    **dict.fromkeys(("mm", "mms", "milimetro", "milimetros"), ("m", Decimal("0.001"))),
    **dict.fromkeys(("in", "pulg", "pulgada", "pulgadas"), ("m", INCH)),
    **dict.fromkeys(("ft", "pie", "pies"), ("m", FOOT)),
    **dict.fromkeys(("un", "und", "unid", "unidad", "unidades", "u", "uni", "c/u", "cu", "pieza", "piezas", "pza"), ("un", Decimal(1))),
    **dict.fromkeys(("par", "pares"), ("un", Decimal(2))),
    **dict.fromkeys(("doc", "docena", "docenas"), ("un", Decimal(12))),
    **dict.fromkeys(("ciento", "cientos"), ("un", Decimal(100))),
    **dict.fromkeys(("millar", "millares"), ("un", Decimal(1000))),
    **dict.fromkeys(("m2", "mt2", "mts2", "metro cuadrado", "metros cuadrados"), ("m2", Decimal(1))),
    **dict.fromkeys(("cm2", "centimetro cuadrado", "centimetros cuadrados"), ("m2", Decimal("0.0001"))),
    **dict.fromkeys(("ft2", "pie2", "pies2", "pie cuadrado", "pies cuadrados"), ("m2", FOOT * FOOT)),
}
#: units so small that a dot before three digits separates thousands
SMALL = ("g", "gr", "grs", "gramo", "gramos", "ml", "cc", "cm3", "mm", "mms", "milimetros", "cm", "cms", "centimetros")

NUMBER = r"\d+(?:[.,]\d+)*(?:\s*/\s*\d+)?"
STEM = r"(?:c/u|[a-z]+[23]?(?:\s+(?:lineal(?:es)?|cuadrados?|cubicos?))?)"
#: [package word [de]] [(] [number] unit [.] [)]
PHRASE = rf"^(?:([a-z]+)\s+(?:de\s+)?)?\(?\s*({NUMBER})?\s*({STEM})\s*\.?\s*\)?$"
PRICE_PER = rf"(?:(?:precio|valor)\s+(?:por|x)\s+|\$\s*/\s*)((?:{NUMBER}\s*)?{STEM})"


def unit_map(part: int, common: str | None = None) -> Column:
    """Map literal from spelling to common unit (0) or factor (1)."""
    known = [(name, c, f) for name, (c, f) in NAMES.items() if common in (None, c)]
    cell = lambda c, f: f"'{c}'" if part == 0 else f"cast('{f}' as decimal(24,12))"
    return F.expr(f"map({', '.join(f"'{name}', {cell(c, f)}" for name, c, f in known)})")


def number(text: Column, stem: Column) -> Column:
    """A written number: fraction, decimal comma or dot, thousands dots before small units."""
    top = F.regexp_extract(text, r"^([\d.,]+)", 1)
    below = F.regexp_extract(text, r"/\s*(\d+)\s*$", 1)
    thousands = stem.isin(*SMALL) & top.rlike(r"^[1-9]\d{0,2}(?:\.\d{3})+$")
    plain = F.when(thousands, F.replace(top, F.lit("."), F.lit(""))).otherwise(F.replace(top, F.lit(","), F.lit(".")))
    value = plain.try_cast("decimal(18,6)")
    return F.when(below == "", value).otherwise(F.try_divide(value, below.try_cast("decimal(18,6)"))).cast("decimal(18,9)")


def unit_phrase(text: Column) -> Column:
    """struct<stem, quantity> of a text like 'kg', '1/2 gal' or 'caja (1,44 m2)'; null if it can't be read.

    A package word without stated contents ('caja') comes out as a stem that no
    unit has; a package word before a bare unit ('saco kg') can't be read.
    """
    def read(t: Column) -> Column:
        first, num, stem = (F.regexp_extract(t, PHRASE, k) for k in (1, 2, 3))
        whole = F.regexp_extract(t, rf"^({STEM})\s*\.?$", 1)  # 'metro lineal' is one stem, not package and unit
        one = F.lit(1).cast("decimal(18,9)")
        quantity = F.when(num == "", one).otherwise(number(num, stem))
        bare = F.when((whole != "") & whole.isin(*NAMES), F.struct(whole.alias("stem"), one.alias("quantity")))
        packed = F.when((stem != "") & ((first == "") | (num != "")), F.struct(stem.alias("stem"), quantity.alias("quantity")))
        return F.coalesce(bare, packed)

    return let(fold(text), read)


def price_phrase(name: Column) -> Column:
    """What a name says its price is per ('precio x kilo', '$/100 g'): the unit phrase, null if nothing."""
    return F.nullif(F.regexp_extract(fold(name), PRICE_PER, 1), F.lit(""))


_GROUPS = {
    "kg": r"kg|kgs|kilos?|kilogramos?|g|gr|gramos?|lbs?|libras?",  # not grs: shops also write the colour grey so
    "lt": r"l|lt|lts|litros?|ml|cc|cm3|gal|gl|galon|galones",
    "m": r"m|mt|mts|metros?|cm|cms|centimetros?",
    "un": r"un|und|unid|u|unidad|unidades",
}


def stated(name: Column, commons: tuple[str, ...] = ("kg", "lt", "m", "un")) -> Column:
    """Array of struct<common, amount>: the first quantity of each magnitude that a name states, in its common unit."""

    def first(t: Column, common: str) -> Column:
        side = r"(?<!\d\s{0,2}x\s{0,2})" if common == "m" else ""  # the side of a tile is no contents
        pattern = rf"(?<![\d.,/a-z]){side}({NUMBER})\s*({_GROUPS[common]})(?![a-z0-9])"
        found = F.struct(F.regexp_extract(t, pattern, 1).alias("n"), F.regexp_extract(t, pattern, 2).alias("s"))
        return let(found, lambda f: F.struct(F.lit(common).alias("common"), (number(f["n"], f["s"]) * F.element_at(unit_map(1, common), f["s"])).cast("decimal(28,12)").alias("amount")))

    return let(fold(name), lambda t: F.filter(F.array(*(first(t, c) for c in commons)), lambda q: q["amount"].isNotNull()))
