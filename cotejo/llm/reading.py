"""Reading level of each document by harmonic label propagation.

The graph is bipartite: sentences on one side, words and word pairs on the
other.  Sentences of graded examples are clamped to their grade; difficulty then
flows from sentences to words and back in rounds until no word changes by more
than a tolerance.  A word's say grows with the agreement of the sentences around
it.  At the end each sentence has a difficulty, and a document takes the level
of the bulk of its sentences.

Words are nodes under 64-bit keys, as many as the corpus has.  Their difficulties
are a table, never a vector on the driver.  Documents are kept in blocks of
bounded size, each with the list of its distinct nodes; a round asks for the
difficulties of those (one row for each block and node, however often it occurs),
and a block answers with its sums.  Blocks are bucketed by their id, so a round
moves the questions and answers but no sentences.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo.llm.mail import own_text
from cotejo.session import Cut, arrow_rows, cut, drop_path, shared_dir

#: documents and words that a block holds at most (a longer document is a block of its own)
BLOCK_DOCS, BLOCK_WORDS = 1000, 500_000
#: documents that Python gets at a time, and bytes of a row group of parsed ones: however large the row groups of the input, a task packs few blocks
BATCH_DOCS, GROUP_BYTES = 1000, 16 << 20
#: largest change of a word's difficulty at which rounds end, and rounds after which they fail
TOLERANCE, MAX_ROUNDS = 0.05, 100
#: weight and variance of a difficulty that a sentence passes on, beside a grade's 1 and 0: else the many ungraded sentences would level all words
PASSED_WEIGHT, PASSED_VARIANCE = 0.05, 0.3
#: variance that keeps a word of one opinion from an infinite say
FLOOR = 0.02
#: weight of the mean grade in a word's difficulty, in occurrences
PRIOR = 0.5
#: sentences count by the square root of their words
WEIGHT_POWER = 0.5
MIN_WORDS = 40
LEVELS = (1, 2, 3)

_WORD = re.compile(r"[^\W\d_]+")
_STOP = re.compile(r"[.;:!?]+")
_PAIR = np.uint64(0x9E3779B97F4A7C15)


class _Keys(dict):
    """64-bit keys of words, computed once each; emptied before it grows large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        key = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) - (1 << 63)
        return key


def sentence_words(text: str, keys: dict[str, int]) -> tuple[list[int], list[int]]:
    """(number of words of every sentence, keys of all words in order)."""
    sizes, out = [], []
    for s in _STOP.split(text.lower()):
        words = _WORD.findall(s)
        if words:
            sizes.append(len(words))
            out += [keys[w] for w in words]
    return sizes, out


def author_sentences(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, word counts of the author's sentences and keys of all their words.

    Documents with a null id or fewer than ``min_words`` own words are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = _Keys()
        for b in batches:
            ids, sizes, words = [], [], []
            for i, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if i is None:
                    continue
                own = own_text(raw.as_py())
                if len(own.split()) < min_words:
                    continue
                n, w = sentence_words(own, keys)
                ids.append(i)
                sizes.append(n)
                words.append(w)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.list_(pa.int32())), pa.array(words, pa.list_(pa.int64()))], names=["doc_id", "sizes", "words"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, sizes array<int>, words array<long>")


BLOCK = "block string, docs array<long>, grades array<double>, sentences array<int>, sizes array<int>, vocab array<long>, nodes array<int>"


def pair_keys(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Keys of the pairs of neighbouring words inside sentences."""
    if not len(words):
        return words
    of = np.repeat(np.arange(len(sizes)), sizes)
    left, right = words[:-1].view(np.uint64), words[1:].view(np.uint64)
    with np.errstate(over="ignore"):
        both = (left * _PAIR + (right ^ (right >> np.uint64(29)))).view(np.int64)
    return both[of[:-1] == of[1:]]


def blocks(graph: DataFrame, block_docs: int = BLOCK_DOCS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Documents (doc_id, sizes, words, grade) packed into blocks: see BLOCK; ``nodes`` are places in ``vocab`` of all words, then of all pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        weight = 0

        def flush() -> pa.RecordBatch:
            nonlocal n, held, weight
            sizes = np.concatenate([h[1] for h in held]).astype(np.int64)
            words = np.concatenate([h[2] for h in held]).astype(np.int64)
            vocab, at = np.unique(np.concatenate([words, pair_keys(words, sizes)]), return_inverse=True)
            lists = [[h[0] for h in held], [h[3] for h in held], [len(h[1]) for h in held], sizes, vocab, at]
            kinds = (pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
            out = pa.RecordBatch.from_arrays([pa.array([f"{part}-{n}"]), *(pa.array([x], pa.list_(k)) for x, k in zip(lists, kinds, strict=True))], names=["block", "docs", "grades", "sentences", "sizes", "vocab", "nodes"])
            n, held, weight = n + 1, [], 0
            return out

        for b in batches:
            for i, s, w, g in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3).to_pylist(), strict=True):
                sizes, words = s.values.to_numpy(), w.values.to_numpy()
                if held and (len(held) >= block_docs or weight + len(words) > block_words):
                    yield flush()
                held.append((i, sizes, words, np.nan if g is None else g))
                weight += len(words)
        if held:
            yield flush()

    return graph.select("doc_id", "sizes", "words", "grade").mapInArrow(run, BLOCK)


class _Block:
    """One block with the difficulties that it asked for."""

    def __init__(self, row: dict):
        arr = lambda k, t: row[k].values.to_numpy(zero_copy_only=False).astype(t, copy=False)
        self.ids, self.doc_grade, self.vocab = row["docs"].values, arr("grades", np.float64), arr("vocab", np.int64)
        per_doc, size = arr("sentences", np.int64), arr("sizes", np.int64)
        self.words, self.n = size.astype(np.float64), len(size)
        self.doc = np.repeat(np.arange(len(per_doc)), per_doc)
        self.grade = self.doc_grade[self.doc]
        self.nodes = arr("nodes", np.int64)
        every = np.arange(self.n)
        self.sentence = np.concatenate([np.repeat(every, size), np.repeat(every, np.maximum(size - 1, 0))])
        self.score, self.say = np.zeros(len(self.vocab)), np.zeros(len(self.vocab))
        if row["known"].is_valid:
            at = np.searchsorted(self.vocab, arr("known", np.int64))
            self.score[at], self.say[at] = arr("score", np.float64), arr("say", np.float64)

    def difficulty(self) -> np.ndarray:
        """Weighted mean over the words of each sentence; nan where no word is graded."""
        top = np.bincount(self.sentence, weights=(self.score * self.say)[self.nodes], minlength=self.n)
        all_ = np.bincount(self.sentence, weights=self.say[self.nodes], minlength=self.n)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(all_ > 0, top / all_, np.nan)


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
    for b in batches:
        for i in range(b.num_rows):
            yield _Block({n: b.column(k)[i] for k, n in enumerate(b.schema.names)})


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _blocks_of(batches):
        now = np.where(np.isnan(b.grade), b.difficulty(), b.grade)
        ok = ~np.isnan(now)[b.sentence]
        nodes, value, passed = b.nodes[ok], now[b.sentence[ok]], np.isnan(b.grade)[b.sentence[ok]]
        weight = np.where(passed, PASSED_WEIGHT, 1.0)
        square = value * value + np.where(passed, PASSED_VARIANCE, 0.0)
        sums = [np.bincount(nodes, weights=w, minlength=len(b.vocab)) for w in (weight, weight * value, weight * square)]
        at = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(b.vocab[at], pa.int64()), *(pa.array(s[at].astype(np.float64), pa.float64()) for s in sums)], names=["node", "n", "s", "q"])


def _by_grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What sentences of graded documents come out at: weighted sums of difficulty for each grade."""
    for b in _blocks_of(batches):
        d, w = b.difficulty(), b.words**WEIGHT_POWER
        ok = ~np.isnan(d) & ~np.isnan(b.grade)
        g = b.grade[ok].astype(int)
        size = int(g.max()) + 1 if len(g) else 0
        top, all_ = np.bincount(g, weights=(d * w)[ok], minlength=size), np.bincount(g, weights=w[ok], minlength=size)
        at = np.flatnonzero(all_)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(top[at].astype(np.float64), pa.float64()), pa.array(all_[at].astype(np.float64), pa.float64())], names=["grade", "top", "all"])


def level_bounds(answered: DataFrame) -> np.ndarray:
    """Difficulties between the levels: half-way between the mean difficulties of neighbouring grades' sentences.

    Propagation draws difficulties towards the middle, the more the fewer examples
    there are, so bounds half-way between the grades themselves would be too wide;
    they stand where a grade has no example.
    """
    got = answered.mapInArrow(_by_grade, "grade int, top double, all double").groupBy("grade").agg((F.sum("top") / F.sum("all")).alias("m")).filter(F.col("grade").isin(*LEVELS))
    mean = {r["grade"]: r["m"] for r in got.collect()}  # one row for each level
    bounds = [(mean[a] + mean[b]) / 2 if a in mean and b in mean else (a + b) / 2 for a, b in zip(LEVELS, LEVELS[1:], strict=False)]
    return np.maximum.accumulate(np.array(bounds))


def _grade(batches: Iterator[pa.RecordBatch], bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    lo = LEVELS[0]
    for b in _blocks_of(batches):
        d = b.difficulty()
        level = np.where(np.isnan(d), 2, np.searchsorted(bounds, d) + lo).astype(int)
        d = np.where(np.isnan(d), 2.0, d)
        w = b.words**WEIGHT_POWER
        votes = np.zeros((len(b.ids), len(LEVELS)))
        np.add.at(votes, (b.doc, level - lo), w)
        all_ = votes.sum(axis=1)
        avg = np.where(all_ > 0, np.bincount(b.doc, weights=d * w, minlength=len(b.ids)) / np.maximum(all_, 1e-12), 2.0)
        best = np.where(all_ > 0, votes.argmax(axis=1) + lo, 2)
        best = np.where(np.isnan(b.doc_grade), best, np.nan_to_num(b.doc_grade)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([b.ids, pa.array(best, pa.int32()), pa.array(np.round(avg, 4), pa.float64())], names=["doc_id", "nivel", "difficulty"])


def _answered(bucketed: DataFrame, scores: DataFrame) -> DataFrame:
    """Blocks with the difficulties of their nodes (``known``, ``score``, ``say``), as far as they have any."""
    asked = bucketed.select("block", F.explode("vocab").alias("node")).join(scores, "node")
    each = asked.groupBy("block").agg(F.collect_list(F.struct("node", "score", "say")).alias("_k"))
    each = each.select("block", F.col("_k.node").alias("known"), F.col("_k.score").alias("score"), F.col("_k.say").alias("say"))
    return bucketed.join(each.hint("shuffle_hash"), "block", "left")


def propagate(bucketed: DataFrame, tolerance: float = TOLERANCE, max_rounds: int | None = None, floor: float = FLOOR) -> tuple[Cut, int]:
    """(``node``, ``score``, ``say`` of all words that difficulty reaches, rounds): harmonic rounds until no word changes by more than ``tolerance``.

    ``max_rounds`` ends earlier; by default MAX_ROUNDS rounds without an end are an error.
    """
    spark = bucketed.sparkSession
    mean = bucketed.select(F.explode("grades").alias("g")).filter(~F.isnan("g")).agg(F.avg("g")).first()[0]
    scores = cut(spark.createDataFrame([], "node long, score double, say double, moved double"), "scores")
    if mean is None:  # nothing is graded
        return scores, 0
    for k in range(max_rounds or MAX_ROUNDS):
        sums = _answered(bucketed, scores.df.drop("moved")).mapInArrow(_gather, "node long, n double, s double, q double")
        got = sums.groupBy("node").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
        m = F.col("s") / F.col("n")
        score = (F.col("s") + F.lit(PRIOR * mean)) / (F.col("n") + PRIOR)
        say = 1 / (F.greatest(F.col("q") / F.col("n") - m * m, F.lit(0.0)) + floor)
        old = scores.df.select("node", F.col("score").alias("_old"))
        nxt = cut(got.join(old, "node", "left").select("node", score.alias("score"), say.alias("say"), F.abs(score - F.coalesce("_old", F.lit(0.0))).alias("moved")), "scores")
        scores.drop()
        scores = nxt
        if (scores.df.agg(F.max("moved")).first()[0] or 0.0) <= tolerance:
            return scores, k + 1
    if max_rounds is None:
        raise RuntimeError(f"difficulties not stable after {MAX_ROUNDS} rounds")
    return scores, max_rounds


def reading_levels(
    docs: DataFrame, graded: DataFrame, tolerance: float = TOLERANCE, max_rounds: int | None = None, min_words: int = MIN_WORDS, block_docs: int = BLOCK_DOCS
) -> DataFrame:
    """``doc_id``, ``nivel``, ``difficulty`` of every document with enough own text.

    graded: ``doc_id``, ``nivel`` examples (repeated ones: the highest counts;
    nulls are ignored).  Graded documents keep their grade.  Without any
    example, or where no word of a document is known, the level is 2.
    """
    spark = docs.sparkSession
    marks = graded.filter("doc_id is not null and nivel is not null").groupBy("doc_id").agg(F.max("nivel").cast("double").alias("grade"))
    name, path = f"cotejo_blocks_{uuid.uuid4().hex[:12]}", f"{shared_dir(spark)}/bucketed-{uuid.uuid4().hex[:12]}"
    with arrow_rows(spark, BATCH_DOCS):
        parsed = cut(author_sentences(docs, min_words), "sentences", {"parquet.block.size": str(GROUP_BYTES)})
        n, words = parsed.df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()
        # written once in buckets: joins by block move only what is asked and answered
        buckets = min(10_000, max(1, -(-n // block_docs), -(-words // BLOCK_WORDS)))
        blocks(parsed.df.join(marks, "doc_id", "left"), block_docs).write.bucketBy(buckets, "block").option("path", path).format("parquet").saveAsTable(name)
        parsed.drop()
    bucketed = spark.table(name)
    with arrow_rows(spark, 1):  # a bucket may hold several blocks
        scores, _ = propagate(bucketed, tolerance, max_rounds)
        answered = _answered(bucketed, scores.df.drop("moved"))
        bounds = level_bounds(answered)
        out = cut(answered.mapInArrow(lambda batches: _grade(batches, bounds), "doc_id long, nivel int, difficulty double"), "levels")
    scores.drop()
    spark.sql(f"DROP TABLE {name}")
    drop_path(spark, path)
    return out.df
