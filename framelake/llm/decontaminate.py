"""Benchmark decontamination with a generalised suffix automaton of normalised test items.

The words of all test items of a block go into one suffix automaton over word numbers.  Training words stream through
it: the automaton keeps the longest match that ends at each word, however long, a match of a full window (13 words, or a
whole shorter item) hits its words, and every state knows the window that ends it, which knows the items that contain
it.  Words that no test item has reset the match, so only runs of known words are streamed.

Hit words that touch make a span, which has the length of its longest match and the largest share of an item that it
holds.  ``decontaminate`` leaves out documents by the share of their words that are hit; ``remove_spans`` keeps documents
and cuts out the spans whose longest match or whose share of an item is beyond a limit.

The automaton is sent to the tasks, so its size is bounded: items are dealt into blocks of at most ``BLOCK_WORDS``
words (an item longer than that is cut into parts that overlap by a window; a match across parts has the length of its longer
piece, and a share is of a part).  One block is one pass over the documents
in which nothing is shuffled and no document leaves its task.  With more blocks every pass reads the documents and puts
out the hits alone, by a digest of the text; they are merged and joined with the documents once, at the end.

Nulls and edge cases: a null text or item has no words; an item without words is no window; windows of an item without
an id hit words and name no item.  Items that share an id count once.  Repeated documents give repeated rows.  Tables
may be empty.  Other columns are not read by ``contamination``; ``decontaminate`` keeps them as they are, whatever their
names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import beside, slices, text_column, texts_of, write_stage

WINDOW = 13
#: A document is contaminated when hit words are at least one in this many.
COVERAGE = 20
#: A span is cut out when its longest match has so many words, or when it holds so large a share of an item.
LENGTH_LIMIT, SHARE_LIMIT = 20, 0.8
#: Words of test items in one automaton: two states a word, so some 200 MB in a task at the very most.
BLOCK_WORDS = 200_000
#: Keeps 0-9, a-z and all bytes of code points above 127; lower-cases A-Z; anything else is a space.
NORMAL = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))

#: What the contract query gives, in DuckDB's SQL: windows of words, joined.
ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[k : k + least(len(w), 13) - 1], ' ') AS s FROM i, unnest(range(1, greatest(len(w) - 12, 1) + 1)) u(k) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
found AS (SELECT rid, k, n, array_to_string(w[k : k + n - 1], ' ') AS s FROM (SELECT d.rid, d.w, sizes.n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes)),
hits AS (SELECT rid, k, n, item FROM found JOIN windows USING (n, s)),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT rid, k, n FROM hits), unnest(range(k, k + n)) u(p) GROUP BY rid),
named AS (SELECT rid, list_sort(list(DISTINCT item) FILTER (item IS NOT NULL)) AS items FROM hits GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)
"""


def words_of(text: bytes) -> list[bytes]:
    """The normalised words of a text."""
    return text.translate(NORMAL).split()


class Automaton:
    """Generalised suffix automaton of word sequences; ``windows`` knows the items of each window state."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.windows: dict[int, set[int]] = {}
        self.short: dict[int, dict[tuple[int, ...], set[int]]] = {}
        #: The ids and lengths of items, by their place.
        self.names = [item for item, _ in items]
        self.sizes = [len(words) for _, words in items]
        coded = []
        for item, (_, words) in enumerate(items):
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words]
            if len(ids) >= window:
                coded.append((item, ids))
                last = 0
                for i in ids:
                    last = self._extend(last, i)
            elif ids:
                self.short.setdefault(len(ids), {}).setdefault(tuple(ids), set()).add(item)
        self.window_of = self._window_states()
        for item, ids in coded:
            for _, _, state in self.matches(ids):
                self.windows.setdefault(state, set()).add(item)
        self.least = min([window, *self.short])

    def _new(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(edges)
        return len(self.next) - 1

    def _split(self, at: int, word: int) -> int:
        """The state that ``word`` leads to from ``at``, cut so that its longest string is one longer than at's."""
        to = self.next[at][word]
        if self.length[to] == self.length[at] + 1:
            return to
        copy = self._new(self.length[at] + 1, self.link[to], dict(self.next[to]))
        self.link[to] = copy
        while at >= 0 and self.next[at].get(word) == to:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        new = self._new(self.length[last] + 1, 0, {})
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        self.link[new] = self._split(at, word) if at >= 0 else 0
        return new

    def _window_states(self) -> list[int]:
        """For each state the one of the last full window of its strings: the ancestor that holds that length."""
        out = [0] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            if self.length[state] >= self.window:
                up = self.link[state]
                out[state] = state if self.length[up] < self.window else out[up]
        return out

    def matches(self, ids: list[int]) -> Iterator[tuple[int, int, int]]:
        """(index of the last word, longest match that ends there, state of its last window) of every match in ``ids`` of a
        window or more."""
        state = matched = 0
        for i, word in enumerate(ids):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state, matched = self.next[state][word], matched + 1
            if matched >= self.window:
                yield i, matched, self.window_of[state]

    def scan(self, words: list[bytes]) -> tuple[list[Span], set[str]]:
        """The spans of hit words, and the items whose windows occur."""
        get = self.number.get
        known = np.fromiter([get(w, 0) for w in words], np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (known > 0).view(np.int8), [0]))))
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= self.least
        found: list[tuple[int, int, int, set[int]]] = []
        for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            ids = known[a:b].tolist()
            if b - a >= self.window:
                found += [(a + i + 1 - self.window, a + i + 1, matched, self.windows[state]) for i, matched, state in self.matches(ids)]
            for size, wanted in self.short.items():
                for i in range(b - a - size + 1):
                    if (got := wanted.get(tuple(ids[i : i + size]))) is not None:
                        found.append((a + i, a + i + size, size, got))
        return self._spans(found), {self.names[k] for _, _, _, items in found for k in items if self.names[k] is not None}

    def _spans(self, found: list[tuple[int, int, int, set[int]]]) -> list[Span]:
        """Windows (start, end, longest match there, items) as spans."""
        out: list[Span] = []
        held: dict[int, tuple[int, int]] = {}  # for each item of the span its hit words and the end of the last ones
        for start, end, matched, items in sorted(found, key=lambda w: w[:2]):
            if not out or start > out[-1][1]:
                out.append((start, end, 0, 0.0))
                held = {}
            first, last, longest, share = out[-1]
            for k in items:
                words, upto = held.get(k, (0, 0))
                held[k] = (words + end - max(start, upto), max(end, upto))
                share = max(share, min(1.0, held[k][0] / self.sizes[k]))
            out[-1] = (first, max(last, end), max(longest, matched), share)
        return out


#: Hit words (start, end), the longest match within, the largest share of an item.
Span = tuple[int, int, int, float]


def merged(spans: list[Span]) -> list[Span]:
    """Spans of several blocks of items: overlapping or touching ones made one."""
    out: list[Span] = []
    for a, b, longest, share in sorted(spans):
        if out and a <= out[-1][1]:
            first, last, other, held = out[-1]
            out[-1] = (first, max(last, b), max(other, longest), max(held, share))
        else:
            out.append((a, b, longest, share))
    return out


def item_blocks(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """Test items in blocks of bounded size, streamed to the driver one partition at a time."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), text_column().alias("t"))
    block: list[tuple[str | None, list[bytes]]] = []
    size = 0
    for row in rows.toLocalIterator():
        words = words_of(row.t.encode())
        step = max(block_words - window + 1, 1)
        parts = [words] if len(words) <= block_words else [words[k : k + block_words] for k in range(0, len(words) - window + 1, step)]
        for part in filter(None, parts):
            if block and size + len(part) > block_words:
                yield block
                block, size = [], 0
            block.append((row.i, part))
            size += len(part)
    if block:
        yield block


FIELDS = (("start", T.LongType()), ("end", T.LongType()), ("longest", T.LongType()), ("share", T.DoubleType()))
SPANS, ITEMS = T.ArrayType(T.StructType([T.StructField(name, kind) for name, kind in FIELDS])), T.ArrayType(T.StringType())
SPAN_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("longest", pa.int64()), ("share", pa.float64())]))


def span_column(spans: list[list[Span]]) -> pa.Array:
    """Spans of several texts as a column."""
    return pa.array([[dict(zip(("start", "end", "longest", "share"), s, strict=True)) for s in own] for own in spans], SPAN_ARROW)


def span_rows(column: pa.Array) -> list[list[Span]]:
    """A column of spans as tuples."""
    return [[(s["start"], s["end"], s["longest"], s["share"]) for s in own or ()] for own in column.to_pylist()]


def scan_block(rows: DataFrame, automaton: Automaton, keep: str) -> DataFrame:
    """``keep``, ``n_words``, ``spans`` (of words) and ``items`` (sorted ids) of every row of (``keep``, ``text``)."""
    sent = rows.sparkSession.sparkContext.broadcast(automaton)
    schema = T.StructType([rows.schema[keep], T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", ITEMS)])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            n, spans, items = [], [], []
            for text in texts_of(part, "text"):
                words = words_of(text)
                found, names = sent.value.scan(words)
                n.append(len(words))
                spans.append(found)
                items.append(sorted(names))
            new = [pa.array(n, pa.int64()), span_column(spans), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([part.column(keep), *new], schema.names)

    return rows.select(keep, "text").mapInArrow(of, schema)


def with_hits(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """As ``scan_block`` gives them: rows of (``row``, ``text``) with the hits that all blocks found by their text's digest."""
    gathered = hits.groupBy("digest").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = rows.withColumn("digest", F.sha1("text")).join(gathered, "digest", "left").select("row", "text", "spans", "items")
    schema = T.StructType([rows.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", ITEMS)])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            n = [len(words_of(t)) for t in texts_of(part, "text")]
            spans = [merged(own) for own in span_rows(part.column("spans"))]
            items = [names or [] for names in part.column("items").to_pylist()]
            new = [pa.array(n, pa.int64()), span_column(spans), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([part.column("row"), *new], schema.names)

    return joined.mapInArrow(of, schema)


def scan(rows: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``row``, ``n_words``, ``n_hit``, ``hit_spans``, ``items`` and ``contaminated`` of every row of (``row``, ``text``)."""
    blocks = item_blocks(benchmark, window, block_words)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        found = scan_block(rows, Automaton(first, window), "row")
    else:
        hits = None
        texts = rows.select(F.sha1("text").alias("digest"), "text")
        for block in (b for some in ((first, second), blocks) for b in some):
            new = scan_block(texts, Automaton(block, window), "digest").where(F.size("spans") > 0)
            # Copies of a text have the same hits: one of them is enough.
            new = write_stage(new.groupBy("digest").agg(F.first("spans").alias("spans"), F.first("items").alias("items")), "hits")
            hits = new if hits is None else hits.unionByName(new)
        found = with_hits(rows, hits)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    found = found.select("row", "n_words", n_hit.alias("n_hit"), F.col("spans").alias("hit_spans"), "items")
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * coverage >= F.col("n_words")))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """Per document: ``doc_id``, ``n_words``, ``n_hit``, ``hit_spans``, ``items`` and ``contaminated``."""
    rows = beside(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).withColumn("row", F.struct("row.doc_id"))
    return scan(rows, benchmark, **limits).select("row.doc_id", "n_words", "n_hit", "hit_spans", "items", "contaminated")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **limits: int) -> DataFrame:
    """``docs`` without the rows that the rule calls contaminated; all other rows stay as they are."""
    return scan(beside(docs, text_col), benchmark, **limits).where(~F.col("contaminated")).select("row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", length_limit: int = LENGTH_LIMIT, share_limit: float = SHARE_LIMIT, **limits: int) -> DataFrame:
    """``docs`` with every span cut out of its text whose longest match has ``length_limit`` words or that holds
    ``share_limit`` of an item; what stands between the words of a span goes with it.  Other texts and columns stay."""
    far = F.filter("hit_spans", lambda s: (s["longest"] >= length_limit) | (s["share"] >= share_limit))
    found = scan(beside(docs, text_col), benchmark, **limits).select("row", F.col("row").getField(text_col).cast("string").alias("text"), far.alias("spans"))
    schema = T.StructType([found.schema["row"], T.StructField("cut", T.StringType())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column("text").to_pylist(), span_rows(batch.column("spans"))
            cut = [without(t, own) if own else t for t, own in zip(texts, spans, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(cut, pa.string())], schema.names)

    kept = [F.col("cut").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns]
    return found.mapInArrow(of, schema).select(*kept)


def without(text: str, spans: list[Span]) -> str:
    """A text without some spans of its words."""
    data = text.encode()
    places = [m.span() for m in re.finditer(rb"[^ ]+", data.translate(NORMAL))]
    out, at = [], 0
    for start, end, *_ in spans:
        out.append(data[at : places[start][0]])
        at = places[end - 1][1]
    return b"".join([*out, data[at:]]).decode()


def query(spark, sf_dir: str) -> DataFrame:
    """Contract query of operator 9."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )
