"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes.  Two fingerprints that differ in at most three bits differ in at
most three bytes, so they share at least five positional bytes: that is the guaranteed minimum of matches.  The index
posts every distinct fingerprint under each choice of five positions with its bytes there, so a pair that reaches the
minimum meets in some posting list; the shared bytes of a pair are tallied, pairs below the minimum are left out, and
the rest are verified by counting differing bits.  A pair is looked at only in the first list that its shared bytes
allow, so no link is found twice.

A posting list holds distinct fingerprints that agree in five bytes, so it has at most 2**24 members (128 MB), however
many documents there are; copies are folded into their fingerprint before anything is posted.  Inside a list links are
walked breadth first and only a spanning forest leaves the task.  Components come from alternating large-star and
small-star rounds on DataFrames; nothing is gathered on the driver but two numbers a round.

Nulls and edge cases: a null text is an empty one; a text without words has fingerprint zero and is linked like any
other.  A null ``doc_id`` keeps its row and never is a component's smallest id (a component of nulls alone gets null).
Repeated rows give repeated rows.  Other columns are not read, and ``deduplicate`` keeps them as they are, whatever their
names.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, beside, drop_stage, slices, text_column, texts_of, write_stage

BYTES, MOST_BITS = 8, 3
LEAST_SHARED = BYTES - MOST_BITS
#: The positions of every posting key, and the bits they cover.
SUBSETS = list(combinations(range(BYTES), LEAST_SHARED))
MASKS = np.array([sum(255 << (8 * p) for p in s) for s in SUBSETS], np.uint64)
#: For each set of shared byte positions (as 8 bits) the first posting key that it allows, or -1 below the minimum.
FIRST_KEY = np.array([next((k for k, s in enumerate(SUBSETS) if all(m >> p & 1 for p in s)), -1) for m in range(256)])
CHUNK = 1 << 15
#: A list of up to this many is compared densely; a longer one is probed with every pattern of up to three bits.
DENSE = 4096


def shingle_hashes(text: bytes, words: int = 3) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of every shingle of a text, in chunks."""
    found = text.translate(LOWER).split()
    if not found:
        return
    joined = b" ".join(found)
    if len(found) <= words:
        yield np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
        return
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate(([0], spaces + 1))[: len(found) - words + 1].tolist()
    ends = np.concatenate((spaces, [len(joined)]))[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), CHUNK):
        part = zip(starts[at : at + CHUNK], ends[at : at + CHUNK], strict=True)
        yield np.array([digest(joined[a:b], 42) for a, b in part], np.uint64)


def fingerprint(text: bytes, words: int = 3) -> int:
    """The 64 majority bits of a text's shingle hashes; 0 for a text without words."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, words):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
        n += len(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0]) if n else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """One row per document: its id, ``text_hash`` (64 bits of the text, to tell rows apart) and ``fp`` (long)."""
    kind = docs.schema[id_col].dataType
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_column(text_col)).alias("text_hash"), text_column(text_col).alias("text"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            prints = np.array([fingerprint(t, words) for t in texts_of(part, "text")], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(prints.view(np.int64))], ["doc_id", "text_hash", "fp"])

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("text_hash", T.LongType()), T.StructField("fp", T.LongType())])
    return chosen.mapInArrow(of, schema)


def patterns(bits: np.ndarray) -> np.ndarray:
    """Every non-empty pattern of up to three of the given bit positions."""
    ones = [1 << int(b) for b in bits]
    return np.array([sum(c) for n in range(1, MOST_BITS + 1) for c in combinations(ones, n)], np.uint64)


def shared_positions(x: np.ndarray) -> np.ndarray:
    """The positions of equal bytes, as 8 bits, of pairs given by their exclusive or."""
    return np.packbits(x.view(np.uint8).reshape(-1, 8) == 0, axis=1, bitorder="little")[:, 0]


def linked(x: np.ndarray, key: int) -> np.ndarray:
    """Which pairs reach the guaranteed matches, belong to this posting key, and differ in few enough bits."""
    return (FIRST_KEY[shared_positions(x)] == key) & (np.bitwise_count(x) <= MOST_BITS)


def forest(members: np.ndarray, key: int, dense: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links of one posting list of distinct fingerprints, in any order."""
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    free = np.array([b for p in range(BYTES) if p not in SUBSETS[key] for b in range(8 * p, 8 * p + 8)])
    probes = patterns(free) if len(members) > (DENSE if dense is None else dense) else None
    if probes is not None:
        # Spark sorts fingerprints as signed longs; the probes are looked up in unsigned order.
        members = np.sort(members)
    rest, queue = members, []
    seen = np.zeros(len(members), bool) if probes is not None else None
    at = 0
    while True:
        if not queue:
            if seen is None:
                if len(rest) < 2:
                    break
                queue, rest = [rest[0]], rest[1:]
            else:
                while at < len(members) and seen[at]:
                    at += 1
                if at == len(members):
                    break
                seen[at], queue = True, [members[at]]
        one = queue.pop()
        if seen is None:
            near = linked(rest ^ one, key)
            found, rest = rest[near], rest[~near]
        else:
            there = np.searchsorted(members, one ^ probes)
            there = there[(there < len(members))]
            ok = linked(members[there] ^ one, key) & ~seen[there]
            there = np.unique(there[ok])
            seen[there] = True
            found = members[there]
        if len(found):
            left.append(np.full(len(found), one, np.uint64))
            right.append(found)
            queue.extend(found)
    none = np.zeros(0, np.uint64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def links_of(batches: Iterator[pa.RecordBatch], dense: int | None = None) -> Iterator[pa.RecordBatch]:
    """Links of posting lists that come sorted by (key, bytes); a list may span batches."""
    held = (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint64))

    def found(keys: np.ndarray, shared: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero((np.diff(keys) != 0) | (np.diff(shared) != 0)) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(keys)]))
        two = starts[ends - starts == 2]
        x = prints[two] ^ prints[two + 1]
        ok = (FIRST_KEY[shared_positions(x)] == keys[two]) & (np.bitwise_count(x) <= MOST_BITS)
        left, right = [prints[two][ok]], [prints[two + 1][ok]]
        for a, b in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist(), strict=True):
            more = forest(prints[a:b], int(keys[a]), dense)
            left.append(more[0])
            right.append(more[1])
        pair = [pa.array(np.concatenate(s).view(np.int64)) for s in (left, right)]
        return pa.RecordBatch.from_arrays(pair, ["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        now = tuple(batch.column(i).to_numpy() for i in range(3))
        keys, shared, prints = (np.concatenate((h, n.view(h.dtype) if h.dtype != n.dtype else n)) for h, n in zip(held, now, strict=True))
        last = int(np.flatnonzero((keys != keys[-1]) | (shared != shared[-1]))[-1]) + 1 if keys[0] != keys[-1] or shared[0] != shared[-1] else 0
        if last:
            yield found(keys[:last], shared[:last], prints[:last])
        held = (keys[last:], shared[last:], prints[last:])
    if len(held[0]):
        yield found(*held)


def fingerprint_links(prints: DataFrame, dense: int = DENSE) -> DataFrame:
    """Links (``u``, ``v``) that connect all distinct values of ``fp`` at three or fewer differing bits."""
    posted = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(int(m))) for m in MASKS.view(np.int64)])).alias("key", "shared"))
    lists = posted.select("key", "shared", "fp").repartition("key", "shared").sortWithinPartitions("key", "shared", "fp")
    return lists.mapInArrow(lambda batches: links_of(batches, dense), "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(``fp``, ``root``) for every node of ``links``; nodes in one connected component have one root.

    Large-star joins every node to its smallest neighbour's side, small-star joins its smaller neighbours to the
    smallest; they alternate until the links are stars.  Each round is written to the shared folder.
    """
    now = write_stage(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        small = small.where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        last, now = now, write_stage(small, "links")
        drop_stage(last)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = now.select(F.col("u").alias("fp"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("fp"), "root").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """Per document: ``doc_id``, ``text_hash``, ``fp``, and its component's smallest id and kept (id, text hash)."""
    prints = write_stage(fingerprints(docs, id_col, text_col, words), "prints")
    first = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("text_hash").alias("h"))
    classes = write_stage(prints.groupBy("fp").agg(F.min(first).alias("first")), "classes")
    roots = components(fingerprint_links(classes.select("fp")))
    rooted = write_stage(classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    best = rooted.groupBy("root").agg(F.min("first").alias("best"))
    by_print = rooted.select("fp", "root").join(best, "root").select("fp", "best")
    return prints.join(by_print, "fp").select("doc_id", "text_hash", "fp", F.col("best.i").alias("component_id"), F.col("best.h").alias("kept_hash"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``docs`` with one row of each component: the smallest id, among equal ids the smallest text hash."""
    found = near_duplicates(docs, id_col, text_col, words)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("kept_hash")))
    kept = kept.select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash")).distinct()
    rows = beside(docs, text_col).select("row", F.col("row").getField(id_col).alias("id"), F.xxhash64("text").alias("own"))
    rows = rows.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("own") == F.col("kept_hash")), "left_semi")
    return rows.dropDuplicates(["id", "own"]).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """Contract query of operator 2."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
