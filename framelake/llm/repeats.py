"""Exact repeats of at least ``LENGTH`` bytes anywhere in a corpus, by enhanced suffix arrays and interval trees.

A suffix array of a whole corpus fits no machine, so suffixes are dealt out by content first.  Every window of LENGTH
bytes chooses an anchor: the smallest of its K-byte hashes, leftmost among equals.  Equal windows choose equal anchors
at equal places, so a repeat is found by comparing only windows with one anchor hash.  Consecutive windows of one
anchor hash form an item, the stretch of text under them; items are some 185 windows long, and at most as long as an
anchor can serve, so a text of one letter has few items too.

* Items whose anchor hash occurs once have no repeats; they are dropped by a count that combines before the shuffle.  An
  item in which the hash stands at several places, as in periodic text, may repeat itself and counts twice.
* Items that are equal as a whole (by a 128-bit digest of their bytes) are put into their anchor's tree once, with their
  number: the suffixes of such an item are leaves that occur as often.  What the tree says of it is joined back to all.
* The text of the distinct items of an anchor meets in one task.  There windows that occur once are left out, and
  an enhanced suffix array over the rest (prefix doubling, common-prefix lengths from the doubled ranks, the byte to the
  left) is scanned with a stack.  It gives the common-prefix intervals, and an interval of depth >= LENGTH whose suffixes
  have different bytes to the left is a maximal repeat: all its occurrences are put out, not just neighbours in the array.
  A leaf of more than one occurrence at the head of its item is one too, to its full depth.  Every range that is removed
  is read from these intervals; those of one item that touch are merged before they leave the task.
* An anchor with more than ``GROUP`` distinct items would fill a task.  Its items are dealt out anew by anchors of more
  bytes, chosen within their windows by the same rule, level by level (``LEVELS``).  An anchor of the last level is a
  whole window, so a group there is the occurrences of one window, and any group ends small or as one leaf.

``remove_repeats`` takes the ranges that repeats cover out of the texts; ``repeat_groups`` lists the maximal repeats
themselves, of any length and with every occurrence.

Matches never cross documents.  Edge cases: a null text is empty; texts shorter than LENGTH have no repeats; a null id
keeps its row, and rows that share an id are told apart by a hash of their text; repeated rows repeat each other, so
both lose what is long enough.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_stage, slices, text_column, texts_of, utf8, write_stage

LENGTH, K = 400, 32
#: Bytes whose windows are hashed together, and bytes of text under one suffix array (a larger group stands alone).
PIECE, BLOCK = 1 << 20, 1 << 20
#: Distinct items of one anchor that meet in a task, some 600 bytes each; a larger group is split by longer anchors.
GROUP = 2048
#: Bytes of the anchors of each level; the last level's are whole windows.
LEVELS = (K, 128)
BASE = np.uint64(0x9E3779B97F4A7C15)
END = 255  # no byte of UTF-8
FAR = 1 << 40  # beyond any place in a stretch
#: What tells an item's bytes: its anchor and the two halves of its digest.
ITEM = ["anchor", "whole", "check"]

#: What the contract query gives, in DuckDB's SQL: the hexadecimal text of every window (cut from blocks of 100 places, since
#: places in a long text are slow to reach), counted by its MD5.
ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, hex(encode(coalesce(text, ''))) AS h FROM documents),
blocks AS (SELECT rid, b * 100 AS head, substring(h, 200 * b + 1, 1000) AS part FROM (SELECT rid, h, unnest(range(0, len(h) // 200 + 1)) AS b FROM d)),
places AS (SELECT rid, head + k AS pos, substring(part, 2 * k + 1, 2) AS byte, CASE WHEN len(part) >= 2 * k + 800 THEN md5_number(substring(part, 2 * k + 1, 800)) END AS s
  FROM (SELECT rid, head, part, unnest(range(0, least(len(part) // 2, 100))) AS k FROM blocks)),
often AS (SELECT s FROM places WHERE s IS NOT NULL GROUP BY s HAVING count(*) > 1),
marked AS (SELECT rid, pos, byte, coalesce(max(CASE WHEN often.s IS NOT NULL THEN pos END) OVER (PARTITION BY rid ORDER BY pos) > pos - 400, false) AS gone FROM places LEFT JOIN often USING (s)),
edges AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY rid ORDER BY pos), false) AS first FROM marked),
totals AS (SELECT rid, count(*) FILTER (gone) AS n_removed, count(*) FILTER (first) AS n_spans, string_agg(byte, '' ORDER BY pos) FILTER (NOT gone) AS kept FROM edges GROUP BY rid)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN totals USING (rid)
"""


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


POWERS: list[np.ndarray] = []


def hashes(data: np.ndarray, k: int = K) -> np.ndarray:
    """A mixed 64-bit hash of the k bytes at every place."""
    if not POWERS or len(POWERS[0]) < len(data):
        n = max(len(data), PIECE + 4 * LENGTH)
        POWERS[:] = [powers(int(BASE), n), powers(pow(int(BASE), -1, 1 << 64), n)]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * POWERS[0][: len(data)], out=sums[1:])
    h = (sums[k:] - sums[:-k]) * POWERS[1][: len(data) - k + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The smallest of every w consecutive values."""
    n = len(x)
    blocks = -(-n // w)
    padded = np.full(blocks * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    square = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(square, axis=1).reshape(-1)
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def items(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, ...]:
    """(document, first window, windows, anchor hash, whether it stands at several places) of every item of texts that lie
    end to end in ``data``."""
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    reach = length - k + 1
    for at in range(0, max(len(data) - length + 1, 0), PIECE):
        part = data[at : at + PIECE + length - 1]
        h = hashes(part, k)
        packed = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
        best = sliding_min(packed, reach)
        valid = np.zeros(len(best) + 1, bool)
        cut = np.zeros(len(best) + 1, bool)
        moved = best[1:] != best[:-1]
        value = h[(best & np.uint64((1 << 24) - 1)).astype(np.int64)]
        cut[1:-1] = value[1:] != value[:-1]
        first = max(int(np.searchsorted(offsets, at, side="right")) - 1, 0)
        for a, b in zip(offsets[first:-1].tolist(), offsets[first + 1 :].tolist(), strict=True):
            if a >= at + len(best):
                break
            lo, hi = max(a - at, 0), min(b - length + 1 - at, len(best))
            if hi > lo:
                valid[lo:hi] = True
                cut[lo] = cut[hi] = True
        places = np.flatnonzero(cut)
        # Where the anchor moves on to an equal one, the item goes on, but for no more windows than one anchor serves.
        sizes = np.diff(np.concatenate((places, [len(best)])))
        if (sizes > reach).any():
            more = [np.arange(a + reach, a + n, reach) for a, n in zip(places[sizes > reach].tolist(), sizes[sizes > reach].tolist(), strict=True)]
            cut[np.concatenate(more)] = True
            places = np.flatnonzero(cut)
        starts = places[valid[places]]
        moves = np.concatenate(([0], np.cumsum(moved), [moved.sum()]))  # how often the anchor has moved up to a window
        sizes = np.diff(np.concatenate((places, [len(best)])))[valid[places]]
        again = moves[starts + sizes - 1] > moves[starts]
        docs = np.searchsorted(offsets, starts + at, side="right") - 1
        for column, values in zip(out, (docs, starts + at - offsets[docs], sizes, value[starts], again), strict=True):
            column.append(values)
    return tuple(np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)


class SuffixBlock:
    """Enhanced suffix array over stretches of text.

    Only windows that occur twice at least (by a rolling hash, so some others may stay) take part: the runs of them are
    cut out, which loses nothing, since every later window under a common prefix is such a window too.  A suffix has
    its place ``starts`` in the array's text, the stretch ``owner`` and the place in it ``inside``.  A stretch that stands
    for several equal ones (``copies``) takes part as a whole; its suffixes are leaves that occur as often.
    """

    def __init__(self, stretches: list[bytes], length: int = LENGTH, copies: np.ndarray | None = None) -> None:
        self.length = length
        self.several = np.zeros(len(stretches), bool) if copies is None else copies > 1
        whole = bytes([END]).join(stretches)
        sizes = np.array([len(s) for s in stretches], np.int64)
        first = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
        runs = self._runs(np.frombuffer(whole, np.uint8), first, sizes)
        own, lo, windows = runs
        bytes_ = windows + length - 1
        at = (first[own] + lo).tolist()
        data = np.frombuffer(bytes([END]).join([whole[a : a + n] for a, n in zip(at, bytes_.tolist(), strict=True)]) + bytes([END]) * 8, np.uint8)
        n = len(data) - 7
        begin = np.concatenate(([0], np.cumsum(bytes_ + 1)))[:-1]
        run = np.repeat(np.arange(len(own)), windows)
        step = np.arange(len(run)) - np.repeat(np.cumsum(windows) - windows, windows)
        self.owner, self.inside = own[run], lo[run] + step
        self.starts = begin[run] + step
        self.remaining = bytes_[run] - step
        # At the head of a stretch the text to the left is another item's: always taken as different.
        before = np.frombuffer(whole, np.uint8)[np.maximum(first[self.owner] + self.inside - 1, 0)] if len(run) else np.zeros(0, np.uint8)
        self.left = np.where(self.inside == 0, -1 - self.owner, before.astype(np.int64))
        self._sort(data, n, int(bytes_.max(initial=0)))

    def _runs(self, data: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(stretch, first window, windows) of the runs of windows that occur more than once, by their hash or as copies."""
        windows = np.maximum(sizes - self.length + 1, 0)
        owner = np.repeat(np.arange(len(sizes)), windows)
        none = np.zeros(0, np.int64)
        if not len(owner):
            return none, none, none
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        own = hashes(data, self.length)[first[owner] + inside]
        ordered = np.sort(own)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        again = self.several[owner]
        if len(twice):
            again |= twice[np.minimum(np.searchsorted(twice, own), len(twice) - 1)] == own
        joined = again[1:] & again[:-1] & (owner[1:] == owner[:-1])
        heads = np.flatnonzero(again & ~np.concatenate(([False], joined)))
        tails = np.flatnonzero(again & ~np.concatenate((joined, [False])))
        return owner[heads], inside[heads], tails - heads + 1

    def _sort(self, data: np.ndarray, n: int, longest: int) -> None:
        key = np.zeros(n, np.uint64)
        for j in range(8):
            key = (key << np.uint64(8)) | data[j : j + n]
        ranks = []
        rank = np.unique(key, return_inverse=True)[1].astype(np.int32)
        size = 8
        # Order and common prefixes are exact up to three times the last size: doubled until the longest stretch fits.
        while size * 2 <= 256 or 3 * size < longest:
            ranks.append((size, rank))
            rank = self._double(rank, rank, size)
            size *= 2
        ranks.append((size, rank))
        ahead = np.minimum(self.starts + size, n - 1)
        own = rank[self.starts].astype(np.int64) * (n + 1) + rank[ahead] + 1
        ahead2 = np.minimum(self.starts + 2 * size, n - 1)
        wide = np.unique(own, return_inverse=True)[1].astype(np.int64)
        order = np.lexsort((rank[ahead2], wide)) if len(own) else np.zeros(0, np.int64)
        self.order = order
        a, b = self.starts[order[:-1]], self.starts[order[1:]]
        common = np.zeros(len(a), np.int64)
        live = wide[order[:-1]] == wide[order[1:]]
        common[live] = 2 * size
        for step, table in reversed(ranks):
            x, y = a + common, b + common
            ok = np.maximum(x, y) < n
            same = np.zeros(len(a), bool)
            same[ok] = table[x[ok]] == table[y[ok]]
            common[same] += step
        going = np.ones(len(a), bool)
        for _ in range(7):
            going &= data[np.minimum(a + common, n - 1)] == data[np.minimum(b + common, n - 1)]
            common[going] += 1
        room = self.remaining
        self.common = np.minimum(common, np.minimum(room[order[:-1]], room[order[1:]]))

    @staticmethod
    def _double(first: np.ndarray, second: np.ndarray, step: int) -> np.ndarray:
        n = len(first)
        key = first.astype(np.int64) * (n + 1)
        key[: max(n - step, 0)] += second[step:].astype(np.int64) + 1
        return np.unique(key, return_inverse=True)[1].astype(np.int32)

    def intervals(self) -> Iterator[tuple[int, np.ndarray]]:
        """(depth, suffixes) of every common-prefix interval that is a maximal repeat; suffixes index ``starts``."""
        # Copies of a stretch go apart at its ends alone, so a leaf of several is maximal at the head and nowhere else.
        for leaf in np.flatnonzero((self.inside == 0) & self.several[self.owner]).tolist():
            yield int(self.remaining[leaf]), np.array([leaf])
        deep = np.concatenate(([False], self.common >= self.length, [False]))
        edges = np.flatnonzero(deep[1:] != deep[:-1])
        lows, highs = edges[::2], edges[1::2]  # a run is suffixes low..high of the array
        if not len(lows):
            return
        left = self.left[self.order]
        bounds = np.stack((lows, highs + 1), axis=1).reshape(-1)
        ends = np.append(left, 0)
        least, most = np.minimum.reduceat(ends, bounds)[::2], np.maximum.reduceat(ends, bounds)[::2]
        mixed = least != most
        for low, high in zip(lows[mixed].tolist(), highs[mixed].tolist(), strict=True):
            yield from self._scan(low, high, left)

    def _scan(self, low: int, high: int, left: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Stack scan of one run: an open interval is [depth, low end, left byte or None when they differ]."""
        common = self.common[low:high].tolist() + [0]
        bytes_ = left[low : high + 1].tolist()
        stack: list[list] = []
        for i, depth in enumerate(common):
            at, byte = i, bytes_[i]
            while stack and stack[-1][0] > depth:
                closed, at, seen = stack.pop()
                byte = seen if seen == byte else None
                if byte is None:
                    yield closed, self.order[low + at : low + i + 1]
            if not stack or stack[-1][0] < depth:
                if depth:
                    stack.append([depth, at, byte])
            elif stack[-1][2] != byte:
                stack[-1][2] = None


def merged(owner: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges, ordered by owner and start, with those of one owner that touch or overlap made one."""
    if not len(owner):
        return owner, start, stop
    ends = np.maximum.accumulate(owner * FAR + stop)
    heads = np.flatnonzero(np.concatenate(([True], owner[1:] * FAR + start[1:] > ends[:-1])))
    tails = np.append(heads[1:] - 1, len(ends) - 1)
    return owner[heads], start[heads], ends[tails] - owner[heads] * FAR


def covered(block: SuffixBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, start, stop) of the ranges that maximal repeats cover, merged."""
    deepest = np.zeros(len(block.starts), np.int64)
    for depth, suffixes in block.intervals():
        deepest[suffixes] = np.maximum(deepest[suffixes], depth)
    where = np.flatnonzero(deepest)
    return merged(block.owner[where], block.inside[where], block.inside[where] + deepest[where])


def row_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(``doc_id``, ``own`` hash of the text, ``base``, ``copies``, ``text``): the first three tell texts apart."""
    text = text_column(text_col)
    one = F.lit(1).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("own"), F.lit(0).cast("long").alias("base"), one.alias("copies"), text.alias("text"))


def same_text(left: DataFrame, right: DataFrame) -> Column:
    """The join condition on texts; the right side's keys are ``r_id``, ``r_own`` and ``r_base``."""
    return left["doc_id"].eqNullSafe(right["r_id"]) & (left["own"] == right["r_own"]) & (left["base"] == right["r_base"])


def keyed(kind: T.DataType, *fields: tuple[str, T.DataType]) -> T.StructType:
    """A schema of a text's keys and other fields."""
    keys = [("doc_id", kind), ("own", T.LongType()), ("base", T.LongType())]
    return T.StructType([T.StructField(name, type_) for name, type_ in (*keys, *fields)])


def item_table(texts: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """Items of all texts: their text's keys and ``copies``, ``anchor``, ``whole`` and ``check`` (together a 128-bit
    digest of the item's bytes), first window in the row, windows, and whether the anchor stands ``again`` within."""
    longs = [(name, T.LongType()) for name in ("copies", "anchor", "whole", "check", "lo")]
    schema = keyed(texts.schema["doc_id"].dataType, *longs, ("n", T.IntegerType()), ("again", T.BooleanType()))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for part in slices(batches, "text", PIECE):
            data, offsets = utf8(part.column("text"))
            docs, lo, n, anchors, again = items(data, offsets, length, k)
            begin = offsets[docs] + lo
            view = memoryview(data)
            whole = b"".join([digest(view[a:b]) for a, b in zip(begin.tolist(), (begin + n + length - 1).tolist(), strict=True)])
            whole, check = np.frombuffer(whole, np.int64).reshape(-1, 2).T
            where = pa.array(docs.astype(np.int64))
            keys = [part.column(name).take(where) for name in ("doc_id", "own", "base", "copies")]
            lo = lo + keys[2].to_numpy()
            yield pa.RecordBatch.from_arrays([*keys, pa.array(anchors.view(np.int64)), pa.array(whole), pa.array(check), pa.array(lo, pa.int64()), pa.array(n, pa.int32()), pa.array(again.astype(bool))], schema.names)

    return texts.mapInArrow(of, schema)


def stretches_of(texts: DataFrame, wanted: DataFrame, length: int = LENGTH) -> DataFrame:
    """The text under representatives, as texts of their own: ``base`` is their first byte; also what they are in ``ITEM``
    and ``large``."""
    fields = [*ITEM, "lo", "n", "copies", "large"]
    listed = wanted.groupBy("r_id", "r_own", "r_base").agg(F.collect_list(F.struct(*fields)).alias("wanted"))
    joined = texts.join(listed, same_text(texts, listed)).select("doc_id", "own", "base", "text", "wanted")
    longs = [(name, T.LongType()) for name in ITEM]
    schema = keyed(texts.schema["doc_id"].dataType, ("copies", T.LongType()), ("text", T.BinaryType()), *longs, ("large", T.BooleanType()))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            lists = part.column("wanted")
            own = pa.array(np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False)))
            items_ = dict(zip(fields, lists.flatten().flatten(), strict=True))
            keys = {name: part.column(name).take(own) for name in ("doc_id", "own", "base")}
            head = items_["lo"].to_numpy() - keys["base"].to_numpy()
            texts_ = texts_of(part, "text")
            cut = [texts_[k][a:b] for k, a, b in zip(own.to_pylist(), head.tolist(), (head + items_["n"].to_numpy() + length - 1).tolist(), strict=True)]
            columns = {**keys, **items_, "base": items_["lo"], "text": pa.array(cut, pa.binary())}
            yield pa.RecordBatch.from_arrays([columns[name] for name in schema.names], schema.names)

    return joined.mapInArrow(of, schema)


def repeats_in_groups(stretches: DataFrame, length: int = LENGTH) -> DataFrame:
    """Ranges of items (``ITEM``, ``start`` and ``stop`` from the item's head) covered by the maximal repeats of their group."""
    schema = T.StructType([T.StructField(name, T.LongType()) for name in (*ITEM, "start", "stop")])
    grouped = stretches.select(*ITEM, "copies", "text").repartition("anchor").sortWithinPartitions(*ITEM)

    def found(batch: pa.RecordBatch) -> pa.RecordBatch:
        # Repeated rows bring a representative more than once; its copies count them.
        kinds = np.stack([batch.column(name).to_numpy() for name in ITEM])
        new = np.concatenate(([True], (kinds[:, 1:] != kinds[:, :-1]).any(axis=0)))
        batch = batch.filter(pa.array(new))
        block = SuffixBlock(batch.column("text").to_pylist(), length, batch.column("copies").to_numpy())
        owner, start, stop = covered(block)
        rows = pa.array(owner)
        return pa.RecordBatch.from_arrays([*(batch.column(name).take(rows) for name in ITEM), pa.array(start), pa.array(stop)], schema.names)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for part in slices(batches, "text", BLOCK):
            held = part if held is None else pa.concat_batches([held, part])
            if held.column("text").nbytes < BLOCK:
                continue
            others = np.flatnonzero(held.column("anchor").to_numpy() != held.column("anchor")[-1].as_py())
            if len(others):
                yield found(held.slice(0, int(others[-1]) + 1))
                held = held.slice(int(others[-1]) + 1)
        if held is not None and held.num_rows:
            yield found(held)

    return grouped.mapInArrow(of, schema)


def repeated_items(texts: DataFrame, length: int = LENGTH, k: int = K) -> tuple[DataFrame, DataFrame]:
    """Items whose anchor occurs again, with ``mixed`` where its items differ; and the representatives of the distinct
    ones: ``first`` (text's keys, ``lo``, ``n``), ``copies`` and ``mixed``.  Both are written."""
    table = write_stage(item_table(texts, length, k), "items")
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("whole", "check") for f in (F.min, F.max)]
    times = F.sum(F.col("copies") + F.col("again").cast("long"))
    often = table.groupBy("anchor").agg(times.alias("times"), F.max("again").alias("again"), *ends).where("times > 1")
    # Counts are written before the join, so that both of its sides are plain exchanges and a hot anchor can be split.
    often = write_stage(often.select("anchor", F.expr("again OR min_whole <> max_whole OR min_check <> max_check").alias("mixed")), "counted")
    often = write_stage(table.drop("again").join(often, "anchor"), "repeated")
    drop_stage(table)
    distinct = often.groupBy(*ITEM).agg(F.sum("copies").alias("copies"), F.min(F.struct("doc_id", "own", "base", "lo", "n")).alias("first"), F.max("mixed").alias("mixed"))
    return often, write_stage(distinct, "distinct")


def representatives(distinct: DataFrame, large: Column) -> DataFrame:
    """What ``stretches_of`` takes."""
    keys = [F.col(f"first.{name}").alias(alias) for name, alias in (("doc_id", "r_id"), ("own", "r_own"), ("base", "r_base"), ("lo", "lo"), ("n", "n"))]
    return distinct.select(*ITEM, *keys, "copies", large.alias("large"))


def repeated_ranges(texts: DataFrame, length: int = LENGTH, group: int = GROUP, levels: tuple[int, ...] | None = None) -> DataFrame:
    """Byte ranges of ``texts`` (as from ``row_keys``) covered by repeats: ``r_id``, ``r_own``, ``r_base``, ``start``, ``stop``."""
    k, *deeper = levels or (*(k for k in LEVELS if k < length), length)
    often, distinct = repeated_items(texts, length, k)
    sizes = distinct.groupBy("anchor").agg(F.count("*").alias("size")).where(F.lit(bool(deeper)) & (F.col("size") > group))
    wanted = representatives(distinct.join(sizes, "anchor", "left"), F.col("size").isNotNull())
    stretches = write_stage(stretches_of(texts, wanted, length), "stretches")
    found = repeats_in_groups(stretches.where("not large"), length)
    if deeper and not stretches.where("large").isEmpty():
        split = write_stage(stretches.where("large").drop("large").dropDuplicates(ITEM), "split")
        below = repeated_ranges(split.drop(*ITEM), length, group, tuple(deeper))
        below = below.join(split.select(*ITEM, "doc_id", "own", "base"), same_text(split, below))
        found = found.unionByName(below.select(*ITEM, (F.col("start") - F.col("base")).alias("start"), (F.col("stop") - F.col("base")).alias("stop")))
    keys = [F.col(name).alias(f"r_{alias}") for name, alias in (("doc_id", "id"), ("own", "own"), ("base", "base"))]
    return often.join(found, ITEM).select(*keys, (F.col("lo") + F.col("start")).alias("start"), (F.col("lo") + F.col("stop")).alias("stop"))


def without(text: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, int]:
    """The bytes outside the ranges, and the number of maximal runs that they make."""
    kept, at, runs, stop = [], 0, 0, -1
    for a, b in sorted(ranges):
        if a > stop:
            runs += 1
            kept.append(text[at:a])
        stop = max(stop, b)
        at = stop
    return b"".join([*kept, text[at:]]), runs


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Per document: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (the bytes that stay) and its SHA-256."""
    rows = row_keys(docs, id_col, text_col)
    ranges = repeated_ranges(rows, length, group).groupBy("r_id", "r_own").agg(F.collect_set(F.struct("start", "stop")).alias("ranges"))
    same = rows["doc_id"].eqNullSafe(ranges["r_id"]) & (rows["own"] == ranges["r_own"])
    joined = rows.join(ranges, same, "left").select("doc_id", "text", "ranges")
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            out: list[list] = [[] for _ in range(5)]
            for text, found in zip(texts_of(part, "text"), part.column("ranges").to_pylist(), strict=True):
                kept, runs = without(text, [(r["start"], r["stop"]) for r in found or ()])
                for column, value in zip(out, (len(text), len(text) - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    column.append(value)
            types = [pa.int64()] * 3 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], schema.names)

    return joined.mapInArrow(of, schema)


def repeat_starts(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """Every place (``r_id``, ``r_own``, ``start``) where a maximal repeat may begin, and some others.

    Inside an item the byte to the left is known, so a window there counts only if it has other bytes to the left in
    other items of its anchor; equal items are looked at once.  The head of an item always counts.
    """
    often, distinct = repeated_items(rows, length)
    stretches = stretches_of(rows, representatives(distinct.where("mixed"), F.lit(False)), length).select("anchor", "text")
    names = ["anchor", "whole", "window", "at", "left"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for part in slices(batches, "text", PIECE // 8):
            for anchor, text in zip(part.column("anchor").to_pylist(), texts_of(part, "text"), strict=True):
                n = len(text) - length + 1
                # Equal windows have equal hashes; unequal ones that share a hash only make a start too many.
                window = np.array([digest(text[k : k + length]) for k in range(n)], np.uint64)
                left = np.concatenate(([-1], np.frombuffer(text, np.uint8)[: n - 1])).astype(np.int32)
                whole = np.frombuffer(xxhash.xxh3_128_digest(text), np.int64)[:1]
                arrays = [pa.array(np.full(n, anchor, np.int64)), pa.array(np.repeat(whole, n)), pa.array(window.view(np.int64)), pa.array(np.arange(n)), pa.array(left)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    windows = write_stage(stretches.mapInArrow(of, "anchor long, whole long, window long, at long, left int"), "windows")
    diverse = windows.groupBy("window").agg(F.min("left").alias("a"), F.max("left").alias("b")).where("a <> b").select("window")
    inner = windows.where("at > 0").join(write_stage(diverse, "diverse"), "window").select("anchor", "whole", "at").distinct()
    inner = often.join(write_stage(inner, "inner"), ["anchor", "whole"]).select(F.col("doc_id").alias("r_id"), F.col("own").alias("r_own"), (F.col("lo") + F.col("at")).alias("start"))
    heads = often.select(F.col("doc_id").alias("r_id"), F.col("own").alias("r_own"), F.col("lo").alias("start"))
    return write_stage(heads.unionByName(inner).distinct(), "starts")


def stretch_digests(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (row key, ``start``, ``lo``, ``mid``, ``hi``, ``n_lo``, ``n_hi``) with ``copies`` of its row, the byte to
    the left (-1 at the head of a text) and the 128-bit hash of the ``mid`` bytes from ``start``, null past the end."""
    numbers = ["start", "lo", "mid", "hi", "n_lo", "n_hi"]
    listed = asked.groupBy("r_id", "r_own").agg(F.collect_list(F.struct(*numbers)).alias("asked"))
    same = texts["doc_id"].eqNullSafe(listed["r_id"]) & (texts["own"] == listed["r_own"])
    joined = texts.join(listed, same).select("doc_id", "own", "copies", "text", "asked")
    key = [T.StructField("r_id", texts.schema["doc_id"].dataType), T.StructField("r_own", T.LongType()), T.StructField("copies", T.LongType())]
    schema = T.StructType([*key, *(T.StructField(c, T.LongType()) for c in numbers), T.StructField("left", T.IntegerType()), T.StructField("hash", T.StringType())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", PIECE // 8):
            for k, text in enumerate(texts_of(part, "text")):
                view = memoryview(text)
                wanted = part.column("asked").slice(k, 1).flatten()
                columns = [wanted.field(c) for c in numbers]
                start, mid = columns[0].to_pylist(), columns[2].to_pylist()
                left = [text[a - 1] if a else -1 for a in start]
                found = [xxhash.xxh3_128_hexdigest(view[a : a + d]) if a + d <= len(text) else None for a, d in zip(start, mid, strict=True)]
                rows = pa.array(np.full(len(start), k))
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(rows) for c in ("doc_id", "own", "copies")), *columns, pa.array(left, pa.int32()), pa.array(found, pa.string())], schema.names)

    return joined.mapInArrow(of, schema)


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Maximal repeats of any length, a row for each occurrence: ``group``, ``length``, ``times``, row key and ``start``.

    The places that share a window form a group; with growing depth a group splits until its members stand alone, and
    each depth at which a group with different bytes to the left splits is a maximal repeat.  These depths are found by
    halving: when a group is as large at the end of a range of depths as at its start, no split lies between.  All
    members of a group ask for the same depths, groups are counted by hash with combining before the shuffle, and
    rounds are the logarithm of the longest text.  Equal rows give equal occurrences.  Groups can be nested, so a text
    that is periodic over n bytes has some n * n / 2 rows.
    """
    rows = row_keys(docs, id_col, text_col)
    texts = write_stage(rows.groupBy("doc_id", "own").agg(F.first("text").alias("text"), F.count("*").alias("copies")), "texts")
    longest = texts.agg(F.max(F.octet_length("text"))).first()[0] or 0
    width = 1
    while length + width <= longest:
        width *= 2
    one = F.lit(1).cast("long")
    depth = lambda d: F.lit(d).cast("long")
    asked = repeat_starts(rows, length).withColumns({"lo": depth(length - width), "mid": depth(length), "hi": depth(length + width), "n_lo": one, "n_hi": one})
    kept = ["r_id", "r_own", "start"]
    first = True
    while first or width > 1:
        found = write_stage(stretch_digests(texts, asked), "digests")
        left = F.min("left")
        counts = found.where("hash is not null").groupBy("mid", "hash").agg(F.sum("copies").alias("n"), ((left < 0) | (left != F.max("left"))).alias("diverse")).where("n > 1")
        found = found.join(write_stage(counts, "counts"), ["mid", "hash"], "left").withColumn("n_mid", F.coalesce("n", one))
        deeper = found.where("diverse and n_mid > n_hi").select(*kept, F.col("mid").alias("lo"), "hi", F.col("n_mid").alias("n_lo"), "n_hi")
        # The first depth has nothing above it; later ones halve the range.
        asked = deeper if first else deeper.unionByName(found.where("n_lo > n_mid").select(*kept, "lo", F.col("mid").alias("hi"), "n_lo", F.col("n_mid").alias("n_hi")))
        width, first = (width if first else width // 2), False
        asked = write_stage(asked.withColumn("mid", F.expr("(lo + hi) div 2")), "asked")
    found = stretch_digests(texts, asked.withColumn("mid", F.col("lo")))
    every = found.withColumn("copy", F.explode(F.sequence(one, F.col("copies"))))
    return every.select(F.col("hash").alias("group"), F.col("mid").alias("length"), F.col("n_lo").alias("times"), F.col("r_id").alias("doc_id"), F.col("r_own").alias("own"), "start")


def maximal_repeats(texts: list[bytes], length: int = LENGTH) -> list[tuple[int, list[tuple[int, int]]]]:
    """Maximal repeat groups (length, [(text, start)]) of a few texts, by one suffix block over whole texts."""
    kept = [(i, t) for i, t in enumerate(texts) if len(t) >= length]
    block = SuffixBlock([t for _, t in kept], length)
    groups = []
    for depth, suffixes in block.intervals():
        places = sorted((kept[o][0], at) for o, at in zip(block.owner[suffixes].tolist(), block.inside[suffixes].tolist(), strict=True))
        groups.append((depth, places))
    return groups


def query(spark, sf_dir: str) -> DataFrame:
    """Contract query of operator 10."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
