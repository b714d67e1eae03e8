"""Quality scoring by co-training a text-content view and a page-metadata view.

The content view measures the text (character classes, repetition of words and lines, word lengths); the metadata view
knows the source, the language and the recorded length in quarter octaves.  Each view is a logistic classifier.  Over
``ROUNDS`` rounds each labels the unlabelled rows that it is surest of, and these pseudo-labels join the other view's
training set.  What is surest is a share of each class: a view orders all unlabelled rows by its calibrated score, and its
top and bottom parts, ``SHARE`` times as large as the classes are among the labelled rows, are its good and bad ones, ties
taken whole.  So a view that separates little teaches as well, but only what it knows: a pseudo-label is the calibrated
probability, not a bare 0 or 1, and it weighs by how far it is from the share of good rows.  Those of a class weigh at most
``PSEUDO`` times the labelled rows of that class together, however many they are.  Newton steps take the upper bound of
the pseudo-labels' curvature, so they never overshoot where a sure view is told otherwise.  ``history`` says how many rows each view labelled in each round.  Both
views are then calibrated on labelled rows that neither learned from (a fifth, by id hash), and a logistic combination
of the calibrated log-odds scores every document.

Labels are learned from at most ``SAMPLE`` labelled rows outside the held-out fold.  Pseudo-labels cover all unlabelled
rows: their measures are written once, and a Newton step of the content view adds up gradient and curvature over them in
the tasks; the metadata view takes few values, so counting the values by pseudo-label is all it needs.  Scoring reads
every text whole, in the task that reads it.

Nulls and edge cases: a null text is empty, a null source or language is a value of its own, a null length is 0; null
labels and ids are not learned from; without any label every score is 0.5, which is kept; repeated rows are scored
alike; an empty table gives no rows.  Missing metadata columns are taken as null.  ``keep_good`` keeps all columns as
they are, whatever their names; ``score`` reads no others.
"""

from __future__ import annotations

import copy
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import beside, drop_stage, fold_of, slices, text_column, texts_of, write_stage
from .learners import HELD_OUT, fit_dense, labelled_sample, sigmoid, sums_of

SAMPLE, ROUNDS, SHARE, PSEUDO = 12_000, 3, 0.5, 0.3
#: Calibrated log-odds are counted in so many bins of equal width from -``WIDEST`` to ``WIDEST``.
BINS, WIDEST = 4096, 24.0
#: Newton steps of a view in a round; they go on from the round before.
STEPS = 2
#: One labelled row in so many calibrates.
CALIBRATE = 5
THRESHOLD = 0.5
METADATA = {"source": "string", "lang": "string", "n_chars": "double"}
SOURCES, LANGS, LENGTHS = 64, 16, 97
#: The class of every byte: lower case, upper case, digit, blank, line end, stop or comma, "!" or "?", "|", other ASCII, beyond ASCII.
CLASSES = np.full(256, 8, np.uint8)
for _codes, _class in ((range(97, 123), 0), (range(65, 91), 1), (range(48, 58), 2), ((32, 9), 3), ((10, 13), 4), (b".,", 5), (b"!?", 6), (b"|", 7), (range(128, 256), 9)):
    CLASSES[list(_codes)] = _class
N_CLASSES = 10


def content(text: bytes) -> list[float]:
    """Measures of one text."""
    n = len(text)
    shares = np.bincount(CLASSES[np.frombuffer(text, np.uint8)], minlength=N_CLASSES) / max(n, 1)
    words = text.split()
    lines = [line for line in text.split(b"\n") if line]
    many = max(len(words), 1)
    again = sum(map(bytes.__eq__, words, words[1:])) / many
    ends = sum(not w[-1:].isalnum() and w[-1] < 128 and w[-2:-1] == w[-1:] for w in words) / many
    return [
        *np.sqrt(shares), 1 - len(set(words)) / many, again, ends, 1 - len(set(lines)) / max(len(lines), 1),
        n / many / 10, np.log1p(len(words)) / 10, np.log1p(n / max(len(lines), 1)) / 10, float(not words),
    ]


def metadata(source: str | None, lang: str | None, n_chars: float | None) -> list[int]:
    """The slots of source, language and recorded length in the metadata view."""
    size = np.log2(1 + max(n_chars or 0, 0)) if n_chars is not None and np.isfinite(n_chars) else 0
    return [zlib.crc32(f"s{source}".encode()) % SOURCES, SOURCES + zlib.crc32(f"l{lang}".encode()) % LANGS, SOURCES + LANGS + int(4 * min(size, 24))]


def one_hot(slots: np.ndarray) -> np.ndarray:
    """Rows of slots as rows of zeros and ones."""
    out = np.zeros((len(slots), SOURCES + LANGS + LENGTHS))
    np.put_along_axis(out, slots.reshape(-1, 3), 1, axis=1)
    return out


def both_views(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The content measures and metadata slots of a batch with ``text`` and the metadata columns."""
    first = np.array([content(t) for t in texts_of(part, "text")])
    rows = zip(*(part.column(c).to_pylist() for c in METADATA), strict=True)
    return first, np.array([metadata(*r) for r in rows])


def inputs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(``doc_id``, ``text``, metadata) of every row."""
    return docs.select(F.col(id_col).alias("doc_id"), text_column(text_col).alias("text"), *own_metadata(docs))


def own_metadata(docs: DataFrame) -> list[Column]:
    """The metadata columns, null where the table lacks one."""
    return [(F.col(c) if c in docs.columns else F.lit(None)).cast(kind).alias(c) for c, kind in METADATA.items()]


class View:
    """A standardised logistic classifier with its calibration; ``x`` is always a dense matrix of inputs."""

    def __init__(self, x: np.ndarray, y: np.ndarray, squares: bool) -> None:
        self.squares = squares
        wide = self._wide(x)
        self.mean, self.scale = wide.mean(axis=0), np.maximum(wide.std(axis=0), 1e-3)
        self.w = fit_dense((wide - self.mean) / self.scale, y)
        self.slope, self.shift = 1.0, 0.0

    def _wide(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack((x, x**2)) if self.squares else x

    def design(self, x: np.ndarray) -> np.ndarray:
        """Standardised inputs and a column of ones."""
        return np.column_stack((np.clip((self._wide(x) - self.mean) / self.scale, -8, 8), np.ones(len(x))))

    def step(self, gradient: np.ndarray, curve: np.ndarray) -> None:
        """One Newton step with a ridge, of at most five in any weight."""
        ridge = np.append(np.ones(len(self.w) - 1), 1e-3)
        step = np.linalg.solve(curve + np.diag(ridge), gradient + ridge * self.w)
        self.w = self.w - step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.design(x) @ self.w, -20, 20)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        if len(y):
            self.slope, self.shift = fit_dense(self.logit(x)[:, None], y, l2=0.1)

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.logit(x) + self.shift


#: A view's cuts: rows in bins up to the first are bad, from the second on good.
Cuts = tuple[int, int]


def bins_of(logits: np.ndarray) -> np.ndarray:
    """The bins of calibrated log-odds."""
    return np.clip((logits + WIDEST) * (BINS / (2 * WIDEST)), 0, BINS - 1).astype(np.int64)


def cuts_of(counts: np.ndarray, prior: float, share: float = SHARE) -> Cuts:
    """The cuts at which the parts below and above have ``share`` of the rows that each class would have; a bin is taken whole,
    the outermost ones always.  Where the parts would meet, as for a view that gives one score to nearly all, the middle
    stays unlabelled."""
    filled = np.flatnonzero(counts)
    if len(filled) < 2:
        return -1, BINS
    below = np.cumsum(counts)
    total = below[-1]
    low = max(int(filled[0]), int(np.searchsorted(below, share * (1 - prior) * total, side="right")) - 1)
    above = total - below + counts
    high = min(int(filled[-1]), int(np.flatnonzero(above <= share * prior * total)[0]) if (above <= share * prior * total).any() else BINS)
    if low >= high:
        low, high = int(filled[0]), int(filled[-1])
    return low, high


def sure(logits: np.ndarray, cuts: Cuts) -> np.ndarray:
    """1 where a row is among the surely good, 0 among the surely bad, else -1."""
    at = bins_of(logits)
    return np.where(at >= cuts[1], 1, np.where(at <= cuts[0], 0, -1))


def reliability(p: np.ndarray, label: np.ndarray, prior: float) -> np.ndarray:
    """How far a pseudo-label's probability is from the prior, 0 to 1."""
    return np.clip(np.where(label == 1, (p - prior) / max(1 - prior, 1e-9), (prior - p) / max(prior, 1e-9)), 0.0, 1.0)


def score_counts(free: DataFrame, views: tuple[View, View]) -> np.ndarray:
    """For each view the unlabelled rows by bin of their calibrated log-odds."""
    sent = free.sparkSession.sparkContext.broadcast(views)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * BINS, np.int64)
        for batch in batches:
            if batch.num_rows:
                for k, x in enumerate((matrix(batch.column("a")), one_hot(matrix(batch.column("m")).astype(np.int64)))):
                    total[k * BINS : (k + 1) * BINS] += np.bincount(bins_of(sent.value[k].calibrated(x)), minlength=BINS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["k", "n"])

    summed = free.select("a", "m").mapInArrow(of, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(2 * BINS, np.int64)
    out[summed.column("k").to_numpy()] = summed.column("n").to_numpy()
    return out.reshape(2, BINS)


def pseudo_counts(free: DataFrame, content_view: View, cuts: Cuts, prior: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(slots, class, mean probability, weight, rows) of the unlabelled rows that the content view is sure of: as many as
    metadata has values."""
    sent = free.sparkSession.sparkContext.broadcast((content_view, cuts, prior))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        view, at, share = sent.value
        for batch in batches:
            if batch.num_rows:
                logits = view.calibrated(matrix(batch.column("a")))
                label = sure(logits, at)
                some = label >= 0
                slots, p = matrix(batch.column("m"))[some].astype(np.int64), sigmoid(logits[some])
                weight = reliability(p, label[some], share)
                values, where, n = np.unique(np.column_stack((slots, label[some])), axis=0, return_inverse=True, return_counts=True)
                sums = [pa.array(np.bincount(where.reshape(-1), v, len(values))) for v in (weight * p, weight)]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in values.T.reshape(4, -1)), *sums, pa.array(n, pa.int64())], list("abcypwn"))

    found = free.select("a", "m").mapInArrow(of, "a long, b long, c long, y long, p double, w double, n long")
    found = found.groupBy("a", "b", "c", "y").agg(F.sum("p").alias("p"), F.sum("w").alias("w"), F.sum("n").alias("n")).toArrow()
    columns = [found.column(c).to_numpy() for c in "abcypwn"]
    return np.column_stack(columns[:3]), columns[3], columns[4] / np.maximum(columns[5], 1e-12), columns[5], columns[6].astype(np.float64)


def pseudo_sums(free: DataFrame, content_view: View, metadata_view: View, cuts: Cuts, prior: float, w: np.ndarray) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """For the bad and good rows of the metadata view: how many, gradient and bounded curvature of the content view at ``w``."""
    sent = free.sparkSession.sparkContext.broadcast((content_view, metadata_view, cuts, prior, w))
    size = len(w)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, other, parts, share, at = sent.value
        total = np.zeros((2, 1 + size + size * size))
        for batch in batches:
            if not batch.num_rows:
                continue
            logits = other.calibrated(one_hot(matrix(batch.column("m")).astype(np.int64)))
            label, p = sure(logits, parts), sigmoid(logits)
            z = own.design(matrix(batch.column("a")))
            for y in (0, 1):
                mine = label == y
                gradient, curve = bounded_sums(z[mine], p[mine], at, reliability(p[mine], label[mine], share))
                total[y] += np.concatenate(([mine.sum()], gradient, curve.reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.reshape(-1))], ["k", "v"])

    summed = free.select("a", "m").mapInArrow(of, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    total = np.zeros(2 * (1 + size + size * size))
    total[summed.column("k").to_numpy()] = summed.column("v").to_numpy()
    return [(t[0], t[1 : 1 + size], t[1 + size :].reshape(size, size)) for t in total.reshape(2, -1)]


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


class CoTrained:
    """The two views and how they combine; ``None`` views score 0.5."""

    def __init__(self) -> None:
        self.views: tuple[View, View] | None = None
        self.combine = np.zeros(3)
        #: For each round the bad and good rows that the content view and the metadata view labelled.
        self.history: list[dict[str, tuple[int, int]]] = []

    def learn(self, views: tuple[np.ndarray, np.ndarray], y: np.ndarray, kept: np.ndarray, free: DataFrame | None, rounds: int = ROUNDS) -> CoTrained:
        """Co-trains on labelled views (``kept`` rows calibrate), exchanging pseudo-labels of the unlabelled ones: ``free``
        has their content measures ``a`` and metadata slots ``m``."""
        if not len(y):
            return self
        if kept.all() or not kept.any():
            kept = np.zeros(len(y), bool)
        fit, held = ~kept, kept if kept.any() else ~kept
        both = (views[0], one_hot(views[1]))
        first, second = View(both[0][fit], y[fit], True), View(both[1][fit], y[fit], False)
        self.views = (first, second)
        per_class = [PSEUDO * float((y[fit] == c).sum()) for c in (0, 1)]

        def calibrate() -> None:
            for view, x in zip(self.views, both, strict=True):
                view.calibrate(x[kept], y[kept])

        calibrate()
        prior = float(y[fit].mean())
        for _ in range(rounds if free is not None else 0):
            labelling = copy.deepcopy((first, second))
            cuts = [cuts_of(c, prior) for c in score_counts(free, labelling)]
            slots, label, target, weight, n = pseudo_counts(free, first, cuts[0], prior)
            taught = [n[label == c].sum() for c in (0, 1)]
            own, design = second.design(both[1][fit]), second.design(one_hot(slots))
            weight = weight * sum(per_class[c] * (label == c) / max(taught[c], 1) for c in (0, 1))
            for _ in range(STEPS):
                # The weights are on the rows of the design, once in the gradient and once in the curvature.
                sums = [sums_of(own, y[fit], second.w), bounded_sums(design, target, second.w, weight)]
                second.step(sums[0][0] + sums[1][0], sums[0][1] + sums[1][1])
            own, rows = first.design(both[0][fit]), [0.0, 0.0]
            for _ in range(STEPS):
                gradient, curve = sums_of(own, y[fit], first.w)
                for c, (rows[c], more, bend) in enumerate(pseudo_sums(free, *labelling, cuts[1], prior, first.w)):
                    gradient, curve = gradient + per_class[c] / max(rows[c], 1) * more, curve + per_class[c] / max(rows[c], 1) * bend
                first.step(gradient, curve)
            self.history.append({"content": tuple(map(int, taught)), "metadata": tuple(map(int, rows))})
            calibrate()
        x = np.column_stack([v.calibrated(view[held]) for v, view in zip(self.views, both, strict=True)])
        self.combine = fit_dense(x, y[held], l2=1.0)
        return self

    def scores(self, views: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Combined, content and metadata scores."""
        if self.views is None:
            half = np.full(len(views[0]), 0.5)
            return half, half, half
        own = [v.calibrated(x) for v, x in zip(self.views, (views[0], one_hot(views[1])), strict=True)]
        return sigmoid(np.column_stack(own) @ self.combine[:2] + self.combine[2]), sigmoid(own[0]), sigmoid(own[1])


def bounded_sums(z: np.ndarray, y: np.ndarray, w: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient at ``w`` with a weight for each row, and the curvature's upper bound, a quarter of the squares."""
    return z.T @ (weight * (sigmoid(z @ w) - y)), (z * (0.25 * weight)[:, None]).T @ z


def measured(rows: DataFrame, *carried: str) -> DataFrame:
    """``carried`` columns with content measures ``a`` and metadata slots ``m``; the measuring runs where the rows are."""
    schema = T.StructType([*(rows.schema[c] for c in carried), T.StructField("a", T.ArrayType(T.DoubleType())), T.StructField("m", T.ArrayType(T.IntegerType()))])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            a, m = both_views(part)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), pa.array(a.tolist(), pa.list_(pa.float64())), pa.array(m.tolist(), pa.list_(pa.int32()))], schema.names)

    return rows.select("text", *METADATA, *carried).mapInArrow(of, schema)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", bound: int = SAMPLE, rounds: int = ROUNDS) -> CoTrained:
    """Co-trained views from a bounded sample of labelled rows and all unlabelled ones."""
    rows = inputs(docs, id_col, text_col)
    own = labels.select(F.col(id_col).alias("doc_id"), F.col(label).alias("label"))
    sample = labelled_sample(rows, own, "label", bound).withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATE)) == 0)
    table = measured(sample, "__y", "held").toArrow()
    if not table.num_rows:
        return CoTrained()
    views = tuple(matrix(table.column(c).combine_chunks()) for c in "am")
    y, held = (table.column(c).to_numpy() for c in ("__y", "held"))
    known = own.where("doc_id is not null").select("doc_id").distinct()
    free = write_stage(measured(rows.where("doc_id is not null"), "doc_id").join(known, "doc_id", "left_anti").select("a", "m"), "views")
    model = CoTrained().learn((views[0], views[1].astype(np.int64)), (y > 0).astype(np.float64), held.astype(bool), free, rounds)
    drop_stage(free)
    return model


NEW = ("score", "score_content", "score_metadata")


def score_rows(rows: DataFrame, model: CoTrained, keep: str) -> DataFrame:
    """``keep`` and the scores of every row of (``keep``, ``text``, metadata)."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([rows.schema[keep], *(T.StructField(c, T.DoubleType()) for c in NEW)])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(keep), *(pa.array(s) for s in sent.value.scores(both_views(part)))], schema.names)

    return rows.mapInArrow(of, schema)


def score(docs: DataFrame, model: CoTrained, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id``, ``score``, ``score_content`` and ``score_metadata`` (0 to 1, higher is better)."""
    return score_rows(inputs(docs, id_col, text_col), model, "doc_id")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score below the threshold."""
    rows = beside(docs).select("row", "text", *((F.col("row").getField(c) if c in docs.columns else F.lit(None)).cast(kind).alias(c) for c, kind in METADATA.items()))
    return score_rows(rows, train(docs, labels), "row").where(F.col("score") >= threshold).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """Operator 6 over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = score(docs, model)
    held_out = (fold_of(F.col("doc_id")) == HELD_OUT).alias("held_out")
    return found.select("doc_id", held_out, *NEW, (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
