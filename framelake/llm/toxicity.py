"""Toxicity scoring by a counterfactual-regularised logistic classifier.

A document is the set of its words and of their leading bytes (so that forms of a word share evidence).  The features
are those whose document counts in toxic and other training rows differ most, by the z-score of their log-odds.  The
loss is the logistic one plus, for every training row that names a group, the squared change of its score when its
identity terms are swapped: a term that only happens to stand beside insults cannot keep weight, so neutral mentions are
not flagged.

Identity terms come from the training texts, whatever their language: words that stand in toxic rows more often than in
others, yet have most of their mentions in others.  Thousands of words are looked at, so a term's tie to the label must
hold against all of them: the threshold is the least one at which chance is expected to give no more than ``FALSE_SHARE``
of the words beyond it (Benjamini and Hochberg 1995), and all words beyond it are terms, none where labels and words are
independent.  Each is swapped for words that are interchangeable with it in
context - those without a tie to the label whose neighbouring words are most like its own.  ``identity`` may give groups of
terms instead, swapped for each other.  A term that stands beside one of its substitutes is swapped for another.  A
scorer tells its ``terms`` and how many rows had a ``counterfactuals``.

Learning reads at most ``SAMPLE`` labelled rows (chosen by id hash) outside the held-out fold; scoring
reads every text whole, in the task that reads it.  Labels, language, source and id are no inputs of a score.

Nulls and edge cases: a null text is empty and gets the score of a text without features; null labels and null ids
are not learned from; without any label the score is 0 everywhere; repeated rows are scored alike; an empty table
gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_stage, fold_of, slices, text_column, texts_of, write_stage
from .decontaminate import NORMAL
from .learners import HELD_OUT, Adam, labelled_sample, sigmoid

SAMPLE, FEATURES, LEAST_DOCUMENTS = 12_000, 2048, 3
PREFIXES = (3, 4, 5, 6, 7)
#: Features whose log-odds are this many standard errors from zero can have weight.
LEAST_Z = 2.8
THRESHOLD = 0.3
#: What a squared change of score under a swap weighs against the logistic loss.
FAIRNESS = 2.0
#: The most frequent words that may be substitutes, substitutes of a term, and counterfactuals of a row.
SUBSTITUTES, CHOICES, TURNS = 1024, 4, 2
#: The share of identity terms that may be there by chance.
FALSE_SHARE = 0.05
#: The most that a substitute's tie to the label may be, in standard errors.
FREE = 1.0
BINS = 64


def features(words: set[bytes], prefixes: Sequence[int] = PREFIXES) -> set[bytes]:
    """Words and, marked by their length, their leading bytes."""
    found = set(words)
    for n in prefixes:
        found |= {b"%d:%b" % (n, w[:n]) for w in words if len(w) > n}
    return found


def swaps(identity: Sequence[Sequence[str]]) -> dict[bytes, list[bytes]]:
    """Each term of the groups and the others of its group."""
    return {a.encode(): [b.encode() for b in group if b != a] for group in identity for a in group}


def swapped(words: set[bytes], swap: dict[bytes, list[bytes]], turn: int = 0) -> set[bytes] | None:
    """The words with identity terms exchanged for their ``turn``-th substitutes, new ones first; None where nothing changes."""
    named = words & swap.keys()
    out = words - named
    for word in sorted(named):
        fresh = [w for w in swap[word] if w not in words] or swap[word]
        if fresh:
            out.add(fresh[turn % len(fresh)])
    return out if out != words else None


class Scorer:
    """Weights of words and prefixes, and the constant."""

    def __init__(self, weights: dict[bytes, float], constant: float, terms: Sequence[bytes] = (), counterfactuals: int = 0) -> None:
        self.constant, self.terms, self.counterfactuals = constant, sorted(terms), counterfactuals
        self.words = {f: w for f, w in weights.items() if b":" not in f}
        self.prefixes = {n: {f.partition(b":")[2]: w for f, w in weights.items() if f.startswith(b"%d:" % n)} for n in PREFIXES}
        self.prefixes = {n: p for n, p in self.prefixes.items() if p}
        self.sets = {n: frozenset(p) for n, p in self.prefixes.items()}
        self.word_set = frozenset(self.words)

    def logit(self, text: bytes) -> float:
        """The log-odds of a text."""
        words = set(text.translate(NORMAL).split())
        total = self.constant + sum(self.words[w] for w in words & self.word_set)
        for n, weights in self.prefixes.items():
            total += sum(weights[p] for p in {w[:n] for w in words if len(w) > n} & self.sets[n])
        return total


def count_features(sample: DataFrame) -> DataFrame:
    """(``feature``, ``toxic``, ``other``): rows of each class that have it."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            names = list(counts[0].keys() | counts[1].keys())
            columns = [pa.array(names, pa.binary()), *(pa.array([counts[k][f] for f in names], pa.int64()) for k in (1, 0))]
            return pa.RecordBatch.from_arrays(columns, ["feature", "toxic", "other"])

        for part in slices(batches, "text"):
            for text, y in zip(texts_of(part, "text"), part.column("__y").to_pylist(), strict=True):
                counts[int(y > 0)].update(features(set(text.translate(NORMAL).split())))
            if len(counts[0]) + len(counts[1]) > 400_000:
                yield out()
                counts = (Counter(), Counter())
        yield out()

    counted = sample.select("text", "__y").mapInArrow(of, "feature binary, toxic long, other long")
    return counted.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def tie(positives: int, negatives: int) -> Column:
    """The log-odds of a counted feature in standard errors."""
    t, o = F.col("toxic") + 0.5, F.col("other") + 0.5
    odds = F.log(t / (positives - F.col("toxic") + 0.5)) - F.log(o / (negatives - F.col("other") + 0.5))
    return odds / F.sqrt(1 / t + 1 / o)


def chosen_features(counted: DataFrame, positives: int, negatives: int, n: int = FEATURES) -> list[bytes]:
    """The n features with the largest absolute z-score of their log-odds."""
    scored = counted.where(F.col("toxic") + F.col("other") >= LEAST_DOCUMENTS)
    scored = scored.withColumn("z", F.abs(tie(positives, negatives))).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "feature").limit(n)
    return [bytes(r.feature) for r in scored.select("feature").collect()]


def contexts(sample: DataFrame, words: list[bytes]) -> np.ndarray:
    """How often each of the words has which neighbours, by hashed bins of the word before and the word after."""
    number = {w: k for k, w in enumerate(words)}

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for part in slices(batches, "text"):
            for text in texts_of(part, "text"):
                found = text.translate(NORMAL).split()
                for i, word in enumerate(found):
                    if (k := number.get(word)) is not None:
                        counts[k, crc32(found[i - 1]) % BINS if i else 0] += 1
                        counts[k, BINS + (crc32(found[i + 1]) % BINS if i + 1 < len(found) else 0)] += 1
        rows = [(*key, n) for key, n in counts.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], ["word", "bin", "n"])

    table = sample.select("text").mapInArrow(of, "word long, bin long, n long").groupBy("word", "bin").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((len(words), 2 * BINS))
    out[table.column("word").to_numpy(), table.column("bin").to_numpy()] = table.column("n").to_numpy()
    return out


def tied(candidates: DataFrame, share: float = FALSE_SHARE) -> float:
    """The least tie ``z``, in hundredths, at which so few of the candidates beyond it are expected by chance."""
    steps = F.when(F.col("z").isNotNull(), F.least(F.floor(F.col("z") * 100), F.lit(4000))).cast("int")
    counts = candidates.groupBy(steps.alias("step")).agg(F.count("*").alias("n")).collect()  # at most 4001 steps above 0
    every = sum(r.n for r in counts)
    beyond, found = 0, math.inf
    for r in sorted((r for r in counts if r.step is not None and r.step > 0), key=lambda r: -r.step):
        beyond += r.n
        if every * 0.5 * math.erfc(r.step / 100 / math.sqrt(2)) <= share * beyond:
            found = r.step / 100
    return found


def derived_swaps(sample: DataFrame, counted: DataFrame, positives: int, negatives: int) -> dict[bytes, list[bytes]]:
    """Identity terms of the sample, each with the words that are most interchangeable with it in context."""
    words = counted.where(F.locate(":", F.col("feature").cast("string")) == 0).withColumn("z", tie(positives, negatives))
    candidates = words.where((F.col("other") > F.col("toxic")) & (F.col("toxic") >= LEAST_DOCUMENTS))
    terms = candidates.where(F.col("z") >= tied(candidates)).orderBy(F.desc("z"), "feature")
    free = words.where((F.abs("z") < FREE) & (F.col("other") >= LEAST_DOCUMENTS)).orderBy(F.desc("other"), "feature").limit(SUBSTITUTES)
    names, others = ([bytes(r.feature) for r in some.select("feature").collect()] for some in (terms, free))
    if not names or not others:
        return {}
    seen = np.sqrt(contexts(sample, names + others))
    seen /= np.maximum(np.linalg.norm(seen, axis=1, keepdims=True), 1e-9)
    alike = seen[: len(names)] @ seen[len(names) :].T
    return {name: [others[j] for j in np.argsort(-row, kind="stable")[:CHOICES]] for name, row in zip(names, alike, strict=True)}


def design(sample: DataFrame, names: list[bytes], swap: dict[bytes, list[bytes]]) -> tuple[np.ndarray, list[np.ndarray], list[list[np.ndarray]]]:
    """Labels, feature numbers of every sampled row, and those of its counterfactuals (none where it names no group)."""
    number = {f: k for k, f in enumerate(names)}

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbered = lambda words: [number[f] for f in features(words) if f in number]
        for part in slices(batches, "text"):
            own, other = [], []
            for text in texts_of(part, "text"):
                words = set(text.translate(NORMAL).split())
                own.append(numbered(words))
                other.append([numbered(changed) for turn in range(TURNS) if (changed := swapped(words, swap, turn)) is not None])
            yield pa.RecordBatch.from_arrays([part.column("__y"), pa.array(own, pa.list_(pa.int32())), pa.array(other, pa.list_(pa.list_(pa.int32())))], ["y", "own", "other"])

    table = sample.select("text", "__y").mapInArrow(of, "y int, own array<int>, other array<array<int>>").toArrow()
    own = [np.array(x, np.int64) for x in table.column("own").to_pylist()]
    other = [[np.array(x, np.int64) for x in rows] for rows in table.column("other").to_pylist()]
    return (table.column("y").to_numpy() > 0).astype(np.float64), own, other


def fit(y: np.ndarray, own: list[np.ndarray], other: list[list[np.ndarray]], size: int, fairness: float = FAIRNESS, l2: float = 5e-5, rounds: int = 800) -> tuple[np.ndarray, float]:
    """Weights and constant that minimise the regularised loss."""

    def sparse(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        lengths = [len(r) for r in rows]
        return np.repeat(np.arange(len(rows)), lengths), np.concatenate(rows) if sum(lengths) else np.zeros(0, np.int64)

    # A row stands in ``named`` once for each of its counterfactuals, which share its weight.
    named = np.array([k for k, rows in enumerate(other) for _ in rows], np.int64)
    share = 1 / np.array([len(other[k]) for k in named], np.float64)
    (row, column), (row2, column2) = sparse(own), sparse([r for rows in other for r in rows])
    w, b = np.zeros(size), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    adam = Adam(size + 1, 0.05)
    for _ in range(rounds):
        p = sigmoid(b + np.bincount(row, w[column], len(y)))
        slope = (p - y) / len(y)
        gradient, constant = l2 * w, 0.0
        if len(named):
            q = sigmoid(b + np.bincount(row2, w[column2], len(named)))
            gap = 2 * fairness * share * (p[named] - q) / len(y)
            slope += np.bincount(named, gap * p[named] * (1 - p[named]), len(y))
            back = -gap * q * (1 - q)
            gradient = gradient + np.bincount(column2, back[row2], size)
            constant = back.sum()
        gradient = gradient + np.bincount(column, slope[row], size)
        step = adam.step(np.append(gradient, slope.sum() + constant))
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def train(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", bound: int = SAMPLE,
    identity: Sequence[Sequence[str]] | None = None, fairness: float = FAIRNESS,
) -> Scorer:
    """A scorer learned from a bounded sample of the labelled rows outside the held-out fold."""
    texts = docs.select(F.col(id_col).alias("doc_id"), text_column(text_col).alias("text"))
    own = labels.select(F.col(id_col).alias("doc_id"), F.col(label).alias("label"))
    # Copies of a text count once: a large group of copies would pass its own words off as evidence.
    sample = labelled_sample(texts, own, "label", bound).withColumn("h", F.xxhash64("text"))
    sample = write_stage(sample.groupBy("h").agg(F.first("text").alias("text"), F.max("__y").alias("__y")).drop("h"), "labelled")
    size = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("__y") > 0).cast("long")), F.lit(0)).alias("t")).first()
    if not size.n:
        return Scorer({}, -60.0)
    counted = write_stage(count_features(sample), "features")
    names = chosen_features(counted, size.t, size.n - size.t)
    swap = derived_swaps(sample, counted, size.t, size.n - size.t) if identity is None else swaps(identity)
    y, rows, others = design(sample, names, swap)
    drop_stage(counted)
    drop_stage(sample)
    weights, constant = fit(y, rows, others, len(names), fairness)
    return Scorer({f: float(w) for f, w in zip(names, weights, strict=True)}, constant, list(swap), sum(bool(r) for r in others))


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id and ``score``."""
    kind = docs.schema[id_col].dataType
    sent = docs.sparkSession.sparkContext.broadcast(scorer)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            logits = np.array([sent.value.logit(t) for t in texts_of(part, "text")])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sigmoid(logits))], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), text_column(text_col).alias("text"))
    return rows.mapInArrow(of, T.StructType([T.StructField("doc_id", kind), T.StructField("score", T.DoubleType())]))


def query(spark, sf_dir: str) -> DataFrame:
    """Contract query of operator 4."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select("doc_id", (fold_of(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
