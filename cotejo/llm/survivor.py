"""Best representative of each duplicate group: field-by-field survivorship.

Each attribute is decided by one aggregate over a composite struct (usable,
recency, source trust, id).  All attributes share a single aggregation, which
combines partially, so a group of any size is reduced before the exchange.
The structs are negated and the minimum is taken, which is the maximum of the
composite; that way text ids can break ties towards the smaller one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotejo.functions.text import fold

# fixed values: what stands in a brand field that names no brand (folded, letters and digits only)
NO_BRAND = ("", "sinmarca", "sm", "na", "nd", "noinforma", "noinformado", "noaplica", "generico", "generica", "sininformacion", "null", "none", "nan", "otro", "otros", "otra", "varios", "desconocido", "desconocida", "porconfirmar", "marcapropia", "unknown", "nobrand", "unbranded", "generic")
# fixed values: file names of stand-in pictures
STAND_IN = r"(?i)(placeholder|no[-_]?image|no[-_]?img|no[-_]?photo|no[-_]?picture|no[-_]?disponible|sin[-_]?(?:foto|imagen)|default|blank|spacer|pixel|1x1|dummy|notfound|not[-_]found|coming[-_]?soon)"


def usable_brand(brand: Column) -> Column:
    """Whether a brand field names a brand (null, blank and stand-ins don't)."""
    key = F.regexp_replace(fold(brand), r"[^a-z0-9]", "")
    return F.coalesce(~key.isin(*NO_BRAND), F.lit(False))


def usable_image(url: Column) -> Column:
    """Whether a field is an absolute http(s) address of a picture that is no stand-in."""
    u = F.trim(url)
    path = F.regexp_extract(u, r"(?i)^https?://[^/?#\s]+(/[^?#\s]*)", 1)
    return F.coalesce(path.rlike(r"(?i)\.(jpe?g|png|webp|gif|avif|bmp|tiff?|svg)$") & ~path.rlike(STAND_IN), F.lit(False))


def filled(x: Column) -> Column:
    """Whether a text field holds more than blanks."""
    return F.coalesce(F.regexp_replace(x, r"[\s ]+", "") != "", F.lit(False))


def survivors(candidates: DataFrame, group: str, ident: str, preference: Sequence[Column], usable: Mapping[str, Column], complete: Sequence[Column]) -> DataFrame:
    """One row for each group: ``base`` (most complete record) and for each attribute the preferred record with a usable value.

    preference: columns of which smaller is better, nulls last; ``ident`` breaks
    ties (smaller first).  usable: attribute -> condition; no usable value
    gives ''.  complete: conditions counted for the base record.  Candidates
    may repeat; those with a null ident count for nothing, and a group without
    any other candidate comes out with '' everywhere.
    """
    order = [x for p in preference for x in (p.isNull(), p)]
    exists = F.col(ident).isNotNull()
    score = sum((F.coalesce(c, F.lit(False)).cast("int") for c in complete), F.lit(0))

    def best(ok: Column, *first: Column) -> Column:
        cells = [*first, *order, F.col(ident)]
        return F.min(F.when(ok & exists, F.struct(*(c.alias(f"c{i}") for i, c in enumerate(cells)))))[f"c{len(cells) - 1}"]

    aggs = [F.coalesce(best(F.lit(True), -score), F.lit("")).alias("base")]
    aggs += [F.coalesce(best(ok), F.lit("")).alias(a) for a, ok in usable.items()]
    return candidates.groupBy(group).agg(*aggs)


def newest(rows: DataFrame, ident: str, date: str, fields: Sequence[str]) -> DataFrame:
    """Each record's row with the greatest date (missing and unreadable ones last); among equal dates the greatest field values, so the result is one defined row."""
    cells = [F.try_to_date(date).isNotNull(), F.try_to_date(date), *(F.col(f) for f in fields)]
    top = F.max(F.struct(*(c.alias(f"c{i}") for i, c in enumerate(cells)))).alias("_t")
    d = rows.filter(F.col(ident).isNotNull()).groupBy(ident).agg(top)
    return d.select(ident, F.col("_t.c1").cast("string").alias(date), *(F.col("_t")[f"c{i + 2}"].alias(f) for i, f in enumerate(fields)))
