"""Mixing sources to target weights by dependent (pivotal) rounding.

Every document of a source is to appear c times on average, where c makes the
source reach its target.  The whole part of c is taken as it is; the fractional
parts are rounded in pairs: mass moves at random from one document to the other
until one of them is integral, weighted by their sizes, so that the source's
tokens stay exactly the same and each document keeps its expectation.  Buckets
of bounded size are rounded in parallel; each leaves at most one fractional
document, and these residuals are combined through a reduction tree.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo.session import cut

#: documents that one task rounds, on average
BUCKET = 4096
EPS = 1e-9


def targets(sources: list[tuple[str, float, int, int]], total: float) -> dict[str, float]:
    """Tokens that each source is to contribute to a mix of ``total`` tokens.

    sources: (source, target share, maximal repeats, available tokens).  A
    source that can't reach its share even when fully repeated gives all it can;
    the others take over the rest in proportion to their shares.
    """
    left = {s: (w, r * have) for s, w, r, have in sources if w > 0 and r > 0 and have > 0}
    got: dict[str, float] = {}
    rest = float(total)
    while left:
        weight = sum(w for w, _ in left.values())
        capped = {s: most for s, (w, most) in left.items() if most <= rest * w / weight}
        if not capped:
            return got | {s: rest * w / weight for s, (w, _) in left.items()}
        got |= capped
        rest -= sum(capped.values())
        left = {s: x for s, x in left.items() if s not in capped}
    return got


def pivot(prob: list[float], size: list[int], rnd: random.Random) -> None:
    """Round ``prob`` in place, keeping sum(prob * size); at most one entry stays fractional."""
    i = -1
    for j in range(len(prob)):
        if not EPS < prob[j] < 1 - EPS:
            prob[j] = float(round(prob[j]))
            continue
        if i < 0:
            i = j
            continue
        ratio = size[j] / size[i]
        up = min(1 - prob[i], prob[j] * ratio)  # i gains, j loses up / ratio
        down = min(prob[i], (1 - prob[j]) * ratio)
        if rnd.random() * (up + down) < down:
            prob[i], prob[j] = prob[i] + up, prob[j] - up / ratio
        else:
            prob[i], prob[j] = prob[i] - down, prob[j] + down / ratio
        for k in (i, j):
            if prob[k] < EPS or prob[k] > 1 - EPS:
                prob[k] = float(round(prob[k]))
        if not EPS < prob[i] < 1 - EPS:
            i = j if EPS < prob[j] < 1 - EPS else -1


def mix(sizes: DataFrame, target: DataFrame, seed: int = 17, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """(copies of every document, report of the shares reached).

    sizes: ``doc_id``, ``source``, ``tokens``.  target: ``source``,
    ``target_share``, ``max_repeats`` (one row for each source).  The mix is as
    large as the corpus.  Copies: doc_id, source, tokens, copies (0 included).
    Documents of a source without target, and without source, get 0 copies;
    documents without tokens carry no mass and get the whole part of their
    source's average.  Repeated rows are documents of their own.
    """
    spark = sizes.sparkSession
    base = cut(sizes.select("doc_id", "source", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens")).withColumn("_row", F.monotonically_increasing_id()), "sizes").df  # written, so that row numbers stay
    have = base.groupBy("source").agg(F.sum("tokens").alias("have"), F.count_if(F.col("tokens") > 0).alias("n"))
    goal = target.filter("source is not null").groupBy("source").agg(F.max("target_share").alias("w"), F.max("max_repeats").alias("r"))
    # one row for each row of the target table
    rows = goal.join(have, "source", "left").fillna(0, ["have", "n"]).collect()
    total = base.agg(F.sum("tokens")).first()[0] or 0
    want = targets([(r["source"], r["w"] or 0.0, r["r"] or 0, r["have"]) for r in rows], total)
    plan = []
    for r in rows:
        avg = want.get(r["source"], 0.0) / r["have"] if r["have"] else 0.0
        avg = min(avg, float(r["r"] or 0))
        whole = int(avg + EPS)
        plan.append((r["source"], whole, max(0.0, avg - whole) if avg - whole > EPS else 0.0, max(1, -(-r["n"] // bucket))))
    plan_df = spark.createDataFrame(plan, "source string, whole int, frac double, n_buckets long")
    d = base.join(plan_df, "source", "left").fillna(0, ["whole", "frac"]).fillna(1, ["n_buckets"])
    settled = d.filter("frac = 0 or tokens <= 0").select("doc_id", "source", "tokens", F.col("whole").alias("copies"))

    # the reduction tree: level by level, one bucket for each node
    open_ = d.filter("frac > 0 and tokens > 0").select("doc_id", "source", "tokens", "whole", F.col("frac").alias("p"), F.pmod(F.xxhash64("doc_id", "_row"), "n_buckets").alias("node"))
    schema = "doc_id long, source string, tokens long, whole int, p double, node long"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        source, node = key
        pdf = pdf.sort_values(["doc_id", "tokens"], kind="stable").reset_index(drop=True)
        rnd = random.Random(f"{seed}/{source}/{node}/{len(pdf)}")
        order = list(range(len(pdf)))
        rnd.shuffle(order)
        prob, size = [float(x) for x in pdf["p"].values[order]], [int(x) for x in pdf["tokens"].values[order]]
        pivot(prob, size, rnd)
        out = pdf.iloc[order].copy()
        out["p"] = prob
        return out

    nodes, done = max((x[3] for x in plan), default=1), []
    while True:
        level = cut(open_.groupBy("source", "node").applyInPandas(run, schema), "pivot").df
        done.append(level.filter("p = 0 or p = 1"))
        if nodes == 1:
            last = level.filter("p > 0 and p < 1")  # at most one document of each source
            chance = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "source"), F.lit(1_000_003)) / 1_000_003.0
            done.append(last.withColumn("p", (chance < F.col("p")).cast("double")))
            break
        nodes = -(-nodes // bucket)
        open_ = level.filter("p > 0 and p < 1").withColumn("node", F.floor(F.col("node") / bucket))
    copies = settled
    for x in done:
        copies = copies.unionByName(x.select("doc_id", "source", "tokens", (F.col("whole") + F.col("p")).cast("int").alias("copies")))

    used = copies.groupBy("source").agg(F.sum(F.col("copies") * F.col("tokens")).alias("mixed_tokens"), F.max("copies").alias("most_copies"))
    got = goal.join(have, "source", "left").join(used, "source", "left").fillna(0, ["have", "mixed_tokens", "most_copies"])
    everything = got.agg(F.sum("mixed_tokens").alias("_m"))
    report = got.crossJoin(everything).select(
        "source", F.col("w").alias("target_share"), F.round(F.try_divide("mixed_tokens", "_m"), 6).alias("actual_share"), F.col("have").alias("available_tokens"), "mixed_tokens", F.col("r").alias("max_repeats"), "most_copies",
    )
    return copies, report
