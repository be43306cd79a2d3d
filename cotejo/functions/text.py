"""Text folding as Column expressions (no Python per row)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: letters that fold one to one
ACCENTED = "áàâäãåāăąéèêëēėęěíìîïīįóòôöõøōőúùûüūůűñńňçćčýÿžźżšśřťďğłÁÀÂÄÃÅĀĂĄÉÈÊËĒĖĘĚÍÌÎÏĪĮÓÒÔÖÕØŌŐÚÙÛÜŪŮŰÑŃŇÇĆČÝŸŽŹŻŠŚŘŤĎĞŁ²³¹º°ª"
PLAIN = "aaaaaaaaaeeeeeeeeiiiiiioooooooouuuuuuunnncccyyzzzssrtdglAAAAAAAAAEEEEEEEEIIIIIIOOOOOOOOUUUUUUUNNNCCCYYZZZSSRTDGL231ooa"

SPACES = r"[\s   -     　]+"


def clean_text(x: Column) -> Column:
    """White space of any kind becomes one blank; outer blanks go."""
    return F.trim(F.regexp_replace(x, SPACES, " "))


def strip_accents(x: Column) -> Column:
    """Base letters for accented ones; combining marks vanish, superscript digits become digits."""
    return F.regexp_replace(F.translate(x, ACCENTED, PLAIN), r"[̀-ͯ]", "")


def html_unescape(x: Column) -> Column:
    """The entities that shop pages use; accented-letter entities become their base letter."""
    x = F.regexp_replace(x, r"(?i)&([a-z])(?:acute|grave|circ|tilde|uml|cedil|ring|slash);", "$1")
    for entity, char in (("&nbsp;", " "), ("&#160;", " "), ("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&sup2;", "2"), ("&sup3;", "3"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return x


def fold(x: Column) -> Column:
    """Unescaped, lower-cased, accent-free text with single blanks."""
    return clean_text(strip_accents(F.lower(html_unescape(x))))


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body(x) with ``x`` computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))
