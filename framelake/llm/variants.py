"""Spelling variants: all pairs of words one edit apart, by merging the light subtrees of a trie of the words.

The words are the leaves of a trie.  Of each node's children the one with most words below it is heavy, the others are
light; a word has at most log2(words) light edges on its way, since each at least halves the words below.  Two words one
edit apart part at one node, where at least one of them takes a light edge or ends.  So it is enough to merge, at every
node, the light subtrees into the rest, small into large, with one character skipped or replaced:

* replaced by the heavy child's character, a light word coincides with a word of the heavy subtree (a replacement);
* with its light character skipped, it coincides with a word of any other subtree (a deletion);
* with the heavy character before its own, it coincides with a word that is one longer (an insertion);
* with its light character replaced by a blank, it coincides with words of other light subtrees (replacements).

A word that ends at a node is merged into the heavy subtree by the heavy character (the light ones skip to it).  Every
pair is found once, at the node where its words part.

The trie is a table of edges (prefix, character) with the words below, counted with partial sums, so no subtree is in one
task.  Nodes of up to ``TOP_DEPTH`` characters, which most words pass, are at most 1 + 90 + 90**2 by the alphabet, and
are broadcast; deeper ones join by prefix.  Merging is equality of strings, so it is a join: a word has a bounded number
of strings one edit away (its length and the alphabet of 90 bound it), and coinciding terminals are never paired within a
group: of words that share one string with a blank (90 at most) each gets the group's count and its best.

Only sums and the largest neighbour leave the merge, so pairs are never written out.  A word's form is its near word of
largest count if that is ``TIMES`` as large; roots follow forms by doubling, and as counts grow fivefold with each step,
a few rounds suffice.

Nulls and edge cases: a null or empty text has no words; a null ``doc_id`` counts as an empty one where typos are drawn.
Repeated rows count again.  Tables may be empty.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, slices, text_column, write_stage

LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
#: One run in this many loses a character before it is counted.
TYPO = 199
#: Nodes of up to this many characters are broadcast.
TOP_DEPTH = 2
#: Words stay as they are in Latin-1 where they are letters (A-Z lower-cased); anything else is a blank.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs_of(text: str) -> list[bytes]:
    """The runs of letters of a text, A-Z lower-cased, in Latin-1: one byte is one code point."""
    return text.encode("latin-1", "replace").translate(LETTERS).split()


def count_into(counts: Counter, doc_id: str, text: str, least: int, typo: int) -> None:
    """Adds a text's words of at least ``least`` letters, with the typos that its id draws."""
    start = zlib.crc32(f"{doc_id}:".encode())
    for run, n in Counter(runs_of(text)).items():
        if len(run) < least:
            continue
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % typo:
            counts[run] += n
        elif len(run) > least:
            k = h % len(run)
            counts[run[:k] + run[k + 1 :]] += n


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH, count: int = LEAST_COUNT, typo: int = TYPO) -> DataFrame:
    """(``word``, ``n``): words of at least ``least`` letters that occur at least ``count`` times."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc_id"), text_column(text_col).alias("text"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            counts: Counter = Counter()
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                count_into(counts, doc_id, text, least, typo)
            if counts:
                found = [w.decode("latin-1") for w in counts]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    counted = rows.mapInArrow(of, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= count)


def light_edges(vocabulary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``word``, ``n``, ``d``, ``c``, ``h``) of every light edge on a word's way: the characters before it, its own and
    the heavy child's; and (``prefix``, ``h``, ``children``) of all nodes with children, written."""
    steps = vocabulary.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("d"))
    steps = steps.withColumns({"prefix": F.expr("substring(word, 1, d)"), "c": F.expr("substring(word, d + 1, 1)")})
    below = steps.groupBy("prefix", "c").agg(F.count("*").alias("below"))
    # The largest subtree; of equal ones that of the largest character.
    heavy = write_stage(below.groupBy("prefix").agg(F.max(F.struct("below", "c")).alias("m"), F.count("*").alias("children")).select("prefix", F.col("m.c").alias("h"), "children"), "heavy")
    forks = heavy.where("children > 1").select("prefix", "h")
    top = F.broadcast(forks.where(F.length("prefix") <= TOP_DEPTH))
    near_root = steps.where(F.col("d") <= TOP_DEPTH).join(top, "prefix")
    deeper = steps.where(F.col("d") > TOP_DEPTH).join(forks.where(F.length("prefix") > TOP_DEPTH), "prefix")
    light = near_root.unionByName(deeper).where("c <> h").select("word", "n", "d", "c", "h")
    return light, heavy


def neighbours(vocabulary: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(``word``, ``n_near``, ``best``) of every word with a near word: how many, and (-n, word) of its first by count; and
    the stages that it reads."""
    edges, heavy = light_edges(vocabulary)
    light = write_stage(edges, "light")
    before, after = "substring(word, 1, d)", "substring(word, d + 2)"
    merged = light.select(
        "word", "n",
        F.explode(F.array(
            F.expr(f"concat({before}, h, {after})"),
            F.expr(f"concat({before}, h, c, {after})"),
            # Skipping a character before its like is done at the like.
            F.expr(f"CASE WHEN substring(word, d + 2, 1) <> c THEN concat({before}, {after}) END"),
        )).alias("other"),
    ).where("other IS NOT NULL")
    ends = vocabulary.join(heavy, vocabulary["word"] == heavy["prefix"]).select("word", "n", F.concat("word", "h").alias("other"))
    held = vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    pairs = merged.unionByName(ends).join(held, "other")
    sides = F.array(*[F.struct(F.col(a).alias("word"), F.lit(1).cast("long").alias("near"), F.struct((-F.col(m)).alias("m"), F.col(b).alias("w")).alias("best")) for a, b, m in (("word", "other", "other_n"), ("other", "word", "n"))])
    found = pairs.select(F.inline(sides))
    # Words that differ in one light character: each of a group is near all others of it, its best the first but itself.
    holes = light.groupBy("d", F.expr(f"concat({before}, ' ', {after})").alias("hole")).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("word").alias("w")))).alias("own"))
    holes = holes.where(F.size("own") > 1).select("own", F.posexplode("own").alias("k", "one"))
    best = F.when(F.col("k") == 0, F.col("own")[1]).otherwise(F.col("own")[0])
    found = found.unionByName(holes.select(F.col("one.w").alias("word"), (F.size("own") - 1).cast("long").alias("near"), best.alias("best")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best")), [light, heavy]


def follow(forms: DataFrame) -> DataFrame:
    """(``word``, ``root``) of every word with a form: forms followed to the last, twice as far in each round."""
    stage = write_stage(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while True:
        further = stage.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = stage.select("word", "root").join(further, "root", "left")
        moved = joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        last, stage = stage, write_stage(moved, "roots")
        drop_stage(last)
        if not stage.where("moved").limit(1).count():
            return stage.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH, count: int = LEAST_COUNT, times: int = TIMES, typo: int = TYPO) -> DataFrame:
    """Per word: ``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root``."""
    vocabulary = write_stage(words(docs, id_col, text_col, least, count, typo), "words")
    found = group_words(vocabulary, times)
    drop_stage(vocabulary)
    return found


def group_words(vocabulary: DataFrame, times: int = TIMES) -> DataFrame:
    """As ``variants``, for a table of distinct words with their counts (``word``, ``n``)."""
    found, passing = neighbours(vocabulary)
    near = vocabulary.join(found, "word", "left")
    large = -F.col("best.m") >= times * F.col("n")
    formed = near.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(large, F.col("best.w")).alias("form"), F.when(large, -F.col("best.m")).alias("form_n"),
    )
    formed = write_stage(formed, "formed")
    for stage in passing:
        drop_stage(stage)
    roots = follow(formed.where("form IS NOT NULL"))
    return formed.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def query(spark, sf_dir: str) -> DataFrame:
    """Contract query of operator 12."""
    found = variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")
