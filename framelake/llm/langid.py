"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

Texts are read as letters in words: lower-cased letters become one of 64 symbols (a-z for themselves, any other letter
by a hash of its code point), everything else is the one word break.  A letter's context is the up to three symbols
before it within its word.  Counts of four-symbol grams cover every training document: tasks count, Spark adds up.
From them each language gets an interpolated Kneser-Ney model (continuation counts at the lower orders).  Grams seen in
any language lie in one array sorted by hash with a column of log-probabilities for each language; unseen grams fall
back to dense three-symbol tables.  A document gets the language with the lowest cross-entropy per symbol.

The symbols bound a language's part of the model whatever the corpus: at most 64**4 hashes and 64**3 dense rows.  A
model of more than ``MOST_BYTES`` (a language column of hundreds of values) is an error before anything is sent.

The score is a softmax of the cross-entropies, its temperature fitted on at most ``CALIBRATION`` training documents of a
fiftieth chosen by id hash; those also give each language the cross-entropy beyond which a prediction is ``rejected``.
They are measured by a model that has not counted that fiftieth.  The final model counts all.

Nulls and edge cases: a null text or one without letters is ``und`` with score 0.  Rows with a null language are never
learned from.  Repeated rows count as often as they come.  Without any training row every prediction is ``und``.  A
null id is in training fold 0.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, drop_stage, fold_of, slices, text_column, write_stage

BITS, ORDER = 6, 4
SYMBOLS = 1 << BITS
HASH = np.uint32(2654435761)
CALIBRATION, CALIBRATE = 2000, 50
#: A model sent to every task is smaller than this.
MOST_BYTES = 1 << 30
UNKNOWN = "und"
HELD_OUT = 2
SLICE = 1 << 20
TABLE: list[np.ndarray] = []


def symbol_table() -> np.ndarray:
    """The symbol of every code point; built once in each process."""
    if not TABLE:
        points = np.array([ord(c) if (c := chr(p)).isalpha() else 0 for p in range(0x110000)], np.uint64)
        other = np.uint64(27) + (points * np.uint64(0x9E3779B1) >> np.uint64(7)) % np.uint64(SYMBOLS - 27)
        table = np.where(points > 0, other, np.uint64(0)).astype(np.uint8)
        table[ord("a") : ord("z") + 1] = np.arange(1, 27)
        TABLE.append(table)
    return TABLE[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Four-symbol grams of all texts end to end, and the n + 1 offsets of the texts in them."""
    lower = [t.lower() for t in texts]
    sizes = np.array([len(t) + 1 for t in lower], np.int64)
    points = np.frombuffer(("\n".join(lower) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = symbol_table()[points].astype(np.uint32)
    before = np.concatenate((np.zeros(1, np.uint32), symbols[:-1]))
    keep = (symbols > 0) | (before > 0)
    ends = np.cumsum(keep)[np.cumsum(sizes) - 1]
    s = symbols[keep]
    back1 = np.concatenate((np.zeros(1, np.uint32), s))[: len(s)]
    back2 = np.concatenate((np.zeros(2, np.uint32), s))[: len(s)] * (back1 > 0)
    back3 = np.concatenate((np.zeros(3, np.uint32), s))[: len(s)] * (back2 > 0)
    code = ((back3 << np.uint32(BITS) | back2) << np.uint32(BITS) | back1) << np.uint32(BITS) | s
    return code, np.concatenate(([0], ends))


def count_grams(rows: DataFrame) -> DataFrame:
    """(``lang``, ``held``, ``code``, ``n``) over all rows of (``lang``, ``held``, ``text``)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, bool], tuple[np.ndarray, np.ndarray]] = {}
        for part in slices(batches, "text", SLICE):
            codes, offsets = grams(part.column("text").to_pylist())
            kinds = list(zip(part.column("lang").to_pylist(), part.column("held").to_pylist(), strict=True))
            number = {kind: k for k, kind in enumerate(dict.fromkeys(kinds))}
            owner = np.repeat(np.array([number[kind] for kind in kinds]), np.diff(offsets))
            for kind, k in number.items():
                new, n = np.unique(codes[owner == k], return_counts=True)
                held[kind] = added(held[kind], (new, n)) if kind in held else (new, n)
        for (lang, own), (codes, n) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array([own] * len(codes)), pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "held", "code", "n"])

    counted = rows.mapInArrow(of, "lang string, held boolean, code long, n long")
    return counted.groupBy("lang", "held", "code").agg(F.sum("n").alias("n"))


def added(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of two sorted tables of counts."""
    codes, where = np.unique(np.concatenate((a[0], b[0])), return_inverse=True)
    return codes, np.bincount(where, np.concatenate((a[1], b[1])), len(codes)).astype(np.int64)


def discount(counts: np.ndarray) -> float:
    """The absolute discount from the counts of counts."""
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return once / (once + 2 * twice) if once and twice else 0.5


def lower_order(codes: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Interpolated continuation probabilities of one order, dense; ``below`` has those of the next lower order."""
    size = len(below) * SYMBOLS
    more = np.bincount(codes % size, minlength=size).astype(np.float64)
    d = discount(more[more > 0])
    by_context = more.reshape(-1, SYMBOLS)
    total, kinds = by_context.sum(axis=1, keepdims=True), (by_context > 0).sum(axis=1, keepdims=True)
    # A context's next shorter one drops its first symbol, so the lower order's rows repeat for every first symbol.
    rows = below.reshape(-1, SYMBOLS)
    tail = np.tile(rows, (len(by_context) // len(rows), 1))
    with np.errstate(invalid="ignore", divide="ignore"):
        smooth = np.maximum(by_context - d, 0) / total + d * kinds / total * tail
    return np.where(total > 0, smooth, tail).reshape(-1)


def check_size(langs: int, codes: int) -> None:
    """An error where so many languages and distinct grams make a model that is too large to send."""
    size = langs * 4 * (codes + 2 * SYMBOLS**3)
    if size > MOST_BYTES:
        raise ValueError(f"{langs} languages make a model of {size} bytes, more than {MOST_BYTES}: clean the language column")


class Model:
    """All languages' models; ``fit`` gets (code, count) of each language."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        self.langs = sorted(counts)
        every = np.unique(np.concatenate([c for c, _ in counts.values()])) if counts else np.zeros(0, np.int64)
        check_size(len(self.langs), len(every))
        hashed = every.astype(np.uint32) * HASH
        order = np.argsort(hashed)
        self.hashes = hashed[order]
        self.logs, self.third, self.weight = [], [], []
        for lang in self.langs:
            codes, n = counts[lang]
            uniform = np.full(SYMBOLS, 1 / SYMBOLS)
            # Distinct grams of each order are the types that the next lower order's continuation counts count.
            three = np.unique(codes)
            two = np.unique(codes % SYMBOLS**3)
            one = np.unique(codes % SYMBOLS**2)
            first = np.bincount(one % SYMBOLS, minlength=SYMBOLS).astype(np.float64)
            d = discount(first[first > 0])
            p1 = np.maximum(first - d, 0) / first.sum() + d * (first > 0).sum() / first.sum() * uniform
            p2 = lower_order(two, p1)
            p3 = lower_order(three, p2)
            d = discount(n)
            context = codes // SYMBOLS
            total = np.bincount(context, n, minlength=SYMBOLS**3)
            kinds = np.bincount(context, minlength=SYMBOLS**3)
            weight = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
            full = weight[every // SYMBOLS] * p3[every % SYMBOLS**3]
            at = np.searchsorted(every, codes)
            full[at] += np.maximum(n - d, 0) / total[context]
            self.logs.append(np.log(full[order]).astype(np.float32))
            self.third.append(np.log(p3).astype(np.float32))
            self.weight.append(np.log(weight).astype(np.float32))
        self.temperature, self.limits = 1.0, np.full(len(self.langs), np.inf)

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per symbol (nats) of every text under every language, and letters' grams of each text."""
        codes, offsets = grams(texts)
        out = np.full((len(texts), len(self.langs)), np.inf)
        sizes = np.diff(offsets)
        some = np.flatnonzero(sizes)
        if len(codes) and len(self.hashes):
            wanted = codes * HASH
            at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
            unseen = np.flatnonzero(self.hashes[at] != wanted)
            last = codes[unseen] % np.uint32(SYMBOLS**3)
            for k in range(len(self.langs)):
                values = self.logs[k][at]
                values[unseen] = self.weight[k][codes[unseen] // np.uint32(SYMBOLS)] + self.third[k][last]
                out[some, k] = -np.add.reduceat(values, offsets[some], dtype=np.float64) / sizes[some]
        return out, sizes

    def chances(self, entropies: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Calibrated probabilities of the languages."""
        logits = -entropies * np.sqrt(np.maximum(sizes, 1))[:, None] * self.temperature
        logits -= logits.max(axis=1, keepdims=True, initial=-np.inf)
        with np.errstate(invalid="ignore"):
            p = np.exp(np.nan_to_num(logits, nan=0.0))
        return p / p.sum(axis=1, keepdims=True)

    def calibrate(self, entropies: np.ndarray, sizes: np.ndarray, langs: list[str]) -> None:
        """Fits the temperature and the rejection limits on cross-entropies of texts of known language."""
        if not len(langs):
            return
        known = {lang: k for k, lang in enumerate(self.langs)}
        truth = np.array([known[lang] for lang in langs])
        losses = []
        for t in 2.0 ** np.arange(-4, 7):
            self.temperature = t
            p = self.chances(entropies, sizes)
            losses.append((-np.log(np.maximum(p[np.arange(len(truth)), truth], 1e-12)).mean(), t))
        self.temperature = min(losses)[1]
        own = entropies[np.arange(len(truth)), truth]
        for k in range(len(self.langs)):
            if (truth == k).sum() >= 5:
                values = own[truth == k]
                self.limits[k] = np.median(values) + 6 * max(np.median(np.abs(values - np.median(values))), 0.02)


def measured(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Cross-entropies, sizes and languages of a bounded sample, measured where its rows are."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            entropies, sizes = sent.value.entropies(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array(entropies.tolist(), pa.list_(pa.float64())), pa.array(sizes)], ["lang", "e", "n"])

    table = rows.select("lang", "text").mapInArrow(of, "lang string, e array<double>, n long").where("n > 0").toArrow()
    entropies = np.array(table.column("e").to_pylist(), np.float64).reshape(-1, len(model.langs))
    return entropies, table.column("n").to_numpy(), table.column("lang").to_pylist()


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of every document outside the held-out fold whose language is known."""
    rows = docs.where((fold_of(F.col(id_col)) != HELD_OUT) & F.col(lang_col).isNotNull())
    name = F.col(id_col).cast("string")
    held = F.coalesce(F.pmod(F.xxhash64(name), F.lit(CALIBRATE)) == 0, F.lit(False)) & name.isNotNull()
    rows = rows.select(name.alias("id"), held.alias("held"), F.col(lang_col).cast("string").alias("lang"), text_column(text_col).alias("text"))
    counted = write_stage(count_grams(rows.select("lang", "held", "text")), "grams")
    # Known before anything is sent: a dirty language column must not fill the driver.
    size = counted.agg(F.count_distinct("lang").alias("langs"), F.count_distinct("code").alias("codes")).first()
    check_size(size.langs, size.codes)
    table = counted.toArrow()
    drop_stage(counted)
    langs, apart, codes, n = (table.column(c).to_numpy() for c in ("lang", "held", "code", "n"))
    rest, every = {}, {}
    for lang in sorted(set(langs.tolist())):
        for own in (False, True):
            mine = (langs == lang) & (apart == own)
            if mine.any():
                order = np.argsort(codes[mine])
                counts = (codes[mine][order], n[mine][order])
                every[lang] = added(every[lang], counts) if lang in every else counts
                if not own:
                    rest[lang] = counts
    model = Model(every)
    if rest:
        ids = bounded_sample(rows.where("held").select("id").distinct(), CALIBRATION, "id")
        sample = rows.where("held").join(F.broadcast(ids), "id")
        sample = sample.groupBy("id").agg(F.min_by(F.struct("lang", "text"), F.xxhash64("lang", "text")).alias("row")).select("row.*")
        judge = Model(rest)
        judge.calibrate(*measured(sample.where(F.col("lang").isin(judge.langs)), judge))
        model.temperature = judge.temperature
        for lang, limit in zip(judge.langs, judge.limits, strict=True):
            model.limits[model.langs.index(lang)] = limit
    return model


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", reject: bool = True) -> DataFrame:
    """Per document: id, ``lang_pred``, ``score``, ``entropy`` and ``rejected``; ``reject`` makes rejected ones ``und``."""
    kind = docs.schema[id_col].dataType
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = sent.value
        for part in slices(batches, "text", SLICE):
            entropies, sizes = m.entropies(part.column("text").to_pylist())
            n = len(sizes)
            if m.langs:
                best = entropies.argmin(axis=1)
                least = entropies[np.arange(n), best]
                score = m.chances(entropies, sizes)[np.arange(n), best]
                refused = (sizes > 0) & (least > m.limits[best])
                unknown = (sizes == 0) | (refused & reject)
                names = np.where(unknown, UNKNOWN, np.array(m.langs, object)[best])
            else:
                names, least, refused, score = np.full(n, UNKNOWN, object), np.zeros(n), np.ones(n, bool), np.zeros(n)
            blank = sizes == 0
            arrays = [part.column("doc_id"), pa.array(names.tolist(), pa.string()), pa.array(np.where(blank, 0.0, score)), pa.array(np.where(blank, 0.0, least)), pa.array(refused | blank)]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return docs.select(F.col(id_col).alias("doc_id"), text_column(text_col).alias("text")).mapInArrow(of, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """Contract query of operator 7: rejection is reported, and every text with a letter gets a language."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, train(docs), reject=False)
    return found.select("doc_id", (fold_of(F.col("doc_id")) == HELD_OUT).alias("held_out"), "lang_pred", "score", "entropy", "rejected")
