"""Product listings describing the same item.

1. Every name is read into words and measures (size, colour, model, pieces ...).
2. Misspelt words are repaired against the vocabulary of the whole corpus.
3. Listings are blocked on their rarest word.  Inside a block no pairs of rows
   are formed: listings with the same brand and measures make a class, and a
   listing that states less is matched with the classes that state more by
   joining its measures with the subsets of theirs.  Listings also visit the
   blocks of their second rarest word and of words one edit from their rarest.
4. Each such candidate pair (listing, representative of a class) must pass a
   cosine of character n-grams weighted by inverse frequency, and is vetoed by
   conflicting measures, numbers or brands.  Listings that their representative
   turns away get a new one among themselves, until none is left.
5. Confirmed pairs are clustered by hash-to-min.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cotejo.llm.groups import hash_to_min
from cotejo.llm.parse import parse_listing
from cotejo.session import cut

#: cosine that a candidate pair needs
MIN_COSINE = 0.3
#: cosine that a pair needs if it met in a block that one side only visits
VISIT_COSINE = 0.5
#: words shorter than this are never repaired
REPAIR_LENGTH = 5
#: a word is repaired only into one that is so many times as frequent
REPAIR_RATIO = 2
#: prices of one article differ by less than this factor as a rule, and by less than WIDE almost always
NEAR, WIDE, APART = math.log(1.35), math.log(1.6), math.log(1.2)
#: distance that stands for "no price to compare"
NO_PRICE = 9.0


def read_listings(rows: DataFrame, ident: str, name: str, brand: str, price: Column) -> DataFrame:
    """``id``, ``words``, ``sig`` (sorted measures without the number of pieces), ``pieces``, ``brand``, ``lp`` (log price)."""
    slim = rows.select(F.col(ident).alias("id"), F.col(name).alias("name"), F.col(brand).alias("brand"), F.when(price > 0, F.log(price.cast("double"))).alias("lp"))
    slim = slim.filter("id is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, sigs, pieces, brands = [], [], [], []
            for n, br in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                w, got, key = parse_listing(n, br)
                pieces.append(got.pop("count", None))
                words.append(w)
                sigs.append(sorted(f"{k}={v}" for k, v in got.items()))
                brands.append(key or None)
            strings = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(words, strings), pa.array(sigs, strings), pa.array(pieces, pa.string()), pa.array(brands, pa.string()), b.column(3)],
                names=["id", "words", "sig", "pieces", "brand", "lp"],
            )

    return slim.mapInArrow(run, "id string, words array<string>, sig array<string>, pieces string, brand string, lp double")


def one_edit(words: DataFrame, wanted: Column) -> DataFrame:
    """``w``, ``dw``, ``u``, ``du``: words (``word``, ``df``) that are one insertion, deletion, substitution or swap apart, as far as ``wanted``."""
    n = F.length("word")
    variants = F.concat(F.array(F.col("word")), F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.substring(F.col("word"), i + 1, n))))
    keys = words.select("word", "df", F.explode(F.array_distinct(variants)).alias("key"))
    a = keys.select("key", F.col("word").alias("w"), F.col("df").alias("dw"))
    b = keys.select("key", F.col("word").alias("u"), F.col("df").alias("du"))
    letters = lambda c: F.array_sort(F.split(c, ""))
    near = F.levenshtein("w", "u")
    met = a.join(b, "key").filter(wanted & (F.col("w") != F.col("u")))
    return met.filter((near == 1) | ((near == 2) & (F.length("w") == F.length("u")) & (letters(F.col("w")) == letters(F.col("u"))))).drop("key")


def vocabulary(words: DataFrame) -> DataFrame:
    """``word``, ``fixed``, ``df``: each word of the corpus, its repaired form and that form's frequency.

    A word is repaired into the most frequent word that is one insertion,
    deletion, substitution or swap away and clearly more frequent.  Candidates
    share a deletion variant, so no pair of unrelated words is looked at.
    """
    df = cut(words.groupBy("word").agg(F.count(F.lit(1)).alias("df")), "words").df
    met = one_edit(df.filter(F.length("word") >= REPAIR_LENGTH), F.col("du") >= REPAIR_RATIO * F.col("dw"))
    fix = met.groupBy(F.col("w").alias("word")).agg(F.max(F.struct("du", "u")).alias("_b")).select("word", F.col("_b.u").alias("fixed"), F.col("_b.du").alias("fdf"))
    d = df.join(fix, "word", "left")
    return d.select("word", F.coalesce("fixed", "word").alias("fixed"), F.coalesce("fdf", "df").alias("df"))


def gram_weights(vocab: DataFrame, n_rows: int) -> np.ndarray:
    """Inverse-frequency weight of every character trigram of the repaired words, by trigram code.

    Words consist of the 26 letters and are marked at both ends, so there are at
    most 27**3 = 19683 trigrams whatever the corpus: the one vector that is
    gathered and broadcast has a proven size.
    """
    marked = F.concat(F.lit("`"), F.col("fixed"), F.lit("`"))  # the character before 'a'
    grams = F.transform(F.sequence(F.lit(1), F.length("fixed")), lambda i: F.substring(marked, i, F.lit(3)))
    w = vocab.groupBy("fixed").agg(F.max("df").alias("df"))
    got = w.select(F.explode(F.array_distinct(grams)).alias("g"), "df").groupBy("g").agg(F.sum("df").alias("df")).toPandas()
    out = np.zeros(GRAMS)
    for g, df in zip(got["g"], got["df"], strict=True):
        out[gram_codes(g)[0]] = math.log(1 + n_rows / df)
    return out


GRAMS = 27**3


def gram_codes(marked: str) -> list[int]:
    """Codes of the trigrams of a marked word."""
    x = [ord(c) - 96 for c in marked]
    return [a * 729 + b * 27 + c for a, b, c in zip(x, x[1:], x[2:], strict=False)]


def _subsets(sig: Column) -> Column:
    """All subsets of an array of measures (a name states a handful)."""
    masks = F.sequence(F.lit(0), (F.pow(F.lit(2), F.size(sig)) - 1).cast("int"))
    return F.transform(masks, lambda m: F.filter(sig, lambda x, i: F.pmod(F.floor(m / F.pow(F.lit(2), i)), F.lit(2)) == 1))


def visiting(known: DataFrame) -> DataFrame:
    """``id``, ``block`` of blocks that a listing visits: those of its second rarest word and of words one edit from its rarest.

    A misspelt line that no other word is more frequent than, or a stray word
    rarer than the line, would else hide a listing from its partners.  Two
    lines may differ by one letter, so the latter visit needs a stated measure.
    """
    blocks = known.groupBy("block").agg(F.count(F.lit(1)).alias("df"))
    near = one_edit(blocks.select(F.col("block").alias("word"), "df"), F.lit(True)).select(F.col("w").alias("block"), F.col("u").alias("to")).distinct()
    near = known.filter(F.size("sig") > 0).select("id", "block").join(near, "block").select("id", F.col("to").alias("block"))
    second = known.select("id", F.col("second").alias("block")).join(blocks.select("block"), "block", "left_semi")
    return second.select("id", "block").unionByName(near).distinct()


def told_brands(rows: DataFrame) -> DataFrame:
    """Add ``bk`` (brand in this block, '' if none) and ``open`` (null brand in a block of several that the name doesn't tell).

    rows: ``id``, ``block``, ``brand``, ``words``, ``home``.  A null brand is
    that of the block if it has one only, or else the one that the name holds:
    of the block's, or else a word of the name that is a brand elsewhere.
    """
    marks = rows.filter("home and brand is not null").select("block", "brand").distinct()
    count = marks.groupBy("block").agg(F.count(F.lit(1)).alias("_n"), F.min("brand").alias("_sole"))
    d = rows.join(count, "block", "left")
    several = d.filter("brand is null and _n > 1").select("id", "block", F.array_join("words", "").alias("_text"))
    named = several.join(marks, "block").filter(F.contains("_text", "brand")).groupBy("id", "block").agg(F.max(F.struct(F.length("brand").alias("l"), "brand"))["brand"].alias("_named"))
    said = d.filter("brand is null and _n > 1").select("id", "block", F.explode("words").alias("brand")).join(marks.select("brand").distinct(), "brand")
    said = said.groupBy("id", "block").agg(F.max(F.struct(F.length("brand").alias("l"), "brand"))["brand"].alias("_said"))
    d = d.join(named, ["id", "block"], "left").join(said, ["id", "block"], "left")
    bk = F.coalesce("brand", F.when(F.col("_n") == 1, F.col("_sole")), "_named", "_said", F.lit(""))
    return d.withColumn("bk", bk).withColumn("open", (F.coalesce("_n", F.lit(0)) > 1) & (F.col("bk") == "")).drop("_n", "_sole", "_named", "_said")


def candidate_links(rows: DataFrame) -> DataFrame:
    """(id, rep, home): each listing with the representative of the class that it belongs to, by brand and measures.

    rows: ``id``, ``block``, ``home`` (false for a visited block), ``sig``,
    ``pieces``, ``lp``, ``bk``, ``open``.  An article is a class whose measures
    no other class of its block and brand extends; visitors make no class.  A listing goes to the article that
    has its measures; where several do, the one whose median price is clearly
    nearest; where none is, it stays alone.  A listing with an open brand, and
    one that visits the block, meets the articles of all brands (of its own, if
    it names one).
    """
    classes = rows.filter("home").groupBy("block", "bk", "open", "sig", "pieces").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.percentile_approx("lp", 0.5).alias("med"))
    classes = cut(classes, "classes").df
    sigs = classes.select("block", "bk", "sig").distinct()
    below = sigs.select("block", "bk", F.explode(_subsets(F.col("sig"))).alias("sub"), "sig")
    covered = below.filter(F.size("sub") < F.size("sig")).select("block", "bk", F.col("sub").alias("sig")).distinct()
    articles = classes.join(sigs.join(covered, ["block", "bk", "sig"], "left_anti"), ["block", "bk", "sig"], "left_semi")
    offers = articles.select(
        "block", F.col("bk").alias("a_bk"), F.col("open").alias("a_open"), F.explode(_subsets(F.col("sig"))).alias("sub"), F.col("sig").alias("a_sig"), F.col("pieces").alias("a_pieces"), "rep", "n", "med"
    )
    met = rows.alias("k").join(offers.alias("o"), (F.col("k.block") == F.col("o.block")) & (F.col("k.sig") == F.col("o.sub")))
    met = met.filter(F.col("k.pieces").isNull() | F.col("k.pieces").eqNullSafe(F.col("o.a_pieces")))
    met = met.filter((F.col("k.bk") == F.col("o.a_bk")) | F.col("k.open") | (~F.col("home") & ((F.col("k.bk") == "") | (F.col("o.a_bk") == ""))))
    own = (F.col("o.a_sig") == F.col("k.sig")) & F.col("o.a_pieces").eqNullSafe(F.col("k.pieces")) & (F.col("k.bk") == F.col("o.a_bk")) & (F.col("home") | ~F.col("a_open"))
    itself = own & F.col("home") & (F.col("n") == 1)
    score = F.when(itself, F.lit(NEAR)).when(F.col("lp").isNull() | F.col("med").isNull(), F.lit(NO_PRICE)).otherwise(F.abs(F.col("lp") - F.col("med")))
    # those that nobody named a brand for are a last resort of their own kind
    last = F.col("k.open") & F.col("a_open")
    met = met.select("id", F.col("k.block").alias("block"), "lp", "home", "open", score.alias("s"), own.alias("own"), last.alias("last"), "rep", "n")
    # of any number of articles only the two nearest and the own one go on: ranks limit each task's rows before the exchange
    rank = F.row_number().over(Window.partitionBy("id", "block").orderBy("last", "s", "rep"))
    near = met.withColumn("_r", rank).filter("_r <= 2").groupBy("id", "block").agg(F.array_sort(F.collect_list(F.when(~F.col("last"), F.struct("s", "rep")))).alias("best"))
    mine = met.groupBy("id", "block", "lp", "home", "open").agg(F.max(F.when(F.col("own"), F.struct("s", "rep", "n"))).alias("mine"))
    each = mine.join(near, ["id", "block"])
    first, second = F.get("best", F.lit(0)), F.get("best", F.lit(1))
    stays = F.col("lp").isNull() | (first["rep"] == F.col("mine.rep")) | ((F.col("mine.s") < WIDE) & (F.col("mine.n") > 1)) | (first["s"] >= NEAR)
    alone = second.isNull() & ((first["s"] < WIDE) | (first["s"] == NO_PRICE))
    clear = (first["s"] < WIDE) & (second["s"] > first["s"] + APART)
    lone = F.when(alone | clear, first["rep"])
    settled = F.when(F.col("mine").isNotNull(), F.when(stays, F.col("mine.rep")).otherwise(first["rep"])).otherwise(lone)
    # a guest's price must fit the article that has its measures
    guest = F.when((F.col("mine.s") < WIDE) | (F.col("mine.s") == NO_PRICE), F.col("mine.rep")).otherwise(lone)
    rep = F.when(~F.col("home"), guest).when(F.col("open"), F.coalesce(lone, F.col("mine.rep"))).otherwise(settled)
    return each.select("id", rep.alias("rep"), "home").filter("rep is not null and rep <> id").groupBy("id", "rep").agg(F.max("home").alias("home"))


def batch_cosines(left: pa.ListArray, right: pa.ListArray, weights: np.ndarray, seen: dict[str, np.ndarray]) -> np.ndarray:
    """Cosine of the weighted trigrams of each pair of word lists; 0 where a side has none.  ``seen`` keeps the codes of words."""

    def sparse(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes, size = [], np.zeros(len(lists), dtype=np.int64)
        for i, words in enumerate(lists.to_pylist()):
            for w in words or ():
                c = seen.get(w)
                if c is None:
                    c = seen[w] = np.array(gram_codes(f"`{w}`"), dtype=np.int64)
                codes.append(c)
                size[i] += len(c)
        gram = np.concatenate(codes) if codes else np.zeros(0, dtype=np.int64)
        key = np.unique(np.repeat(np.arange(len(size)), size) * GRAMS + gram)
        w = weights[key % GRAMS]
        return key, w, np.bincount(key // GRAMS, weights=w * w, minlength=len(size))

    u, wu, nu = sparse(left)
    v, wv, nv = sparse(right)
    key, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    dot = np.bincount(key // GRAMS, weights=wu[i] * wv[j], minlength=len(left))
    norm = np.sqrt(nu * nv)
    return np.where(norm > 0, dot / np.where(norm > 0, norm, 1), 0.0)


def confirm(links: DataFrame, known: DataFrame, weights: np.ndarray, min_cosine: float = MIN_COSINE) -> DataFrame:
    """Candidate pairs (links: ``id``, ``rep``, ``home``) whose n-gram cosine is high enough and whose measures, pieces and brands don't conflict."""
    side = lambda p: known.select(F.col("id").alias(p), *(F.col(c).alias(f"{p}_{c}") for c in ("words", "sig", "pieces", "brand")))
    floor = F.when(F.col("home"), F.lit(min_cosine)).otherwise(F.lit(max(min_cosine, VISIT_COSINE)))
    both = links.withColumn("floor", floor).join(side("id"), "id").join(side("rep"), "rep")
    both = both.filter(F.col("id_brand").isNull() | F.col("rep_brand").isNull() | (F.col("id_brand") == F.col("rep_brand")))
    both = both.filter(F.col("id_pieces").isNull() | F.col("rep_pieces").isNull() | (F.col("id_pieces") == F.col("rep_pieces")))
    # a measure that both sides state must be the same
    key = lambda x: F.substring_index(x, "=", 1)
    clash = F.exists("id_sig", lambda x: F.exists("rep_sig", lambda y: (key(x) == key(y)) & (x != y)))
    both = both.filter(~clash).select("id", "rep", "id_words", "rep_words", "floor")
    shared = known.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for b in batches:
            if len(seen) > 200_000:
                seen.clear()
            ok = batch_cosines(b.column(2), b.column(3), shared.value, seen) >= b.column(4).to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok))

    return both.mapInArrow(run, "a string, b string")


def settle(links: DataFrame, known: DataFrame, weights: np.ndarray, min_cosine: float = MIN_COSINE) -> DataFrame:
    """Confirmed pairs of the links; members that their representative turned away elect another one among themselves until none is left."""
    done, left = None, links
    while True:
        pairs = cut(confirm(left, known, weights, min_cosine), "confirmed").df
        done = pairs if done is None else done.unionByName(pairs)
        vetoed = left.filter("home").join(pairs.select(F.col("a").alias("id"), F.col("b").alias("rep")), ["id", "rep"], "left_anti")
        heads = vetoed.groupBy("rep").agg(F.min("id").alias("head"))
        left = cut(vetoed.join(heads, "rep").filter("id <> head").select("id", F.col("head").alias("rep"), "home"), "vetoed").df
        if left.isEmpty():
            return done


def same_item_groups(rows: DataFrame, ident: str, name: str, brand: str, price: Column, min_cosine: float = MIN_COSINE) -> DataFrame:
    """``member``, ``group_id`` of every listing that shares its article with another one.

    rows: one row for each listing (repeated ids are harmless: the pairs of an
    id with itself link nothing).  A null or wordless name matches nothing; a
    null brand or price is unknown and conflicts with nothing.
    """
    read = cut(read_listings(rows, ident, name, brand, price), "read")
    words = read.df.select("id", F.explode("words").alias("word"))
    vocab = cut(vocabulary(words), "repaired")
    weights = gram_weights(vocab.df, max(1, read.df.count()))
    rare = F.slice(F.array_sort(F.collect_set(F.struct("df", "fixed"))), 1, 2)
    of = words.join(vocab.df, "word").groupBy("id").agg(rare.alias("_r"), F.collect_list("fixed").alias("words"))
    of = of.select("id", F.get("_r", F.lit(0))["fixed"].alias("block"), F.get("_r", F.lit(1))["fixed"].alias("second"), "words")
    known = cut(read.df.drop("words").join(of, "id"), "known")
    read.drop()
    vocab.drop()
    slim = known.df.select("id", "block", "words", "brand", "sig", "pieces", "lp")
    guests = visiting(known.df).join(slim.drop("block"), "id").withColumn("home", F.lit(False))
    placed = cut(told_brands(slim.withColumn("home", F.lit(True)).unionByName(guests)).drop("words", "brand"), "placed")
    links = cut(candidate_links(placed.df), "links")
    placed.drop()
    pairs = cut(settle(links.df, known.df, weights, min_cosine), "settled")
    links.drop()
    known.drop()
    groups = hash_to_min(pairs.df)
    pairs.drop()
    return groups


def all_pairs(groups: DataFrame, left: str, right: str) -> DataFrame:
    """Every pair within each group, smaller member first: what the caller asked to see, not a step of the search."""
    a, b = groups.select("group_id", F.col("member").alias(left)), groups.select("group_id", F.col("member").alias(right))
    return a.join(b, "group_id").filter(F.col(left) < F.col(right)).select(left, right)
