"""Ranked lexical search over term-bucketed postings.

The texts are read once: a task counts the terms of each document and puts out postings (bucket, term, document,
occurrences, document length) and one row for the document itself.  ``bucket`` is a hash of the term; every file of the
index is sorted by bucket and term, so a search that asks for few terms reads few row groups, and the postings of a
frequent term lie in all files instead of one.  A search leaves out the postings that no item asks for before anything
is written.

Document frequencies, the number of documents and their terms are counts over the postings.  Item terms join the postings
by bucket and term, every match is scored in 64-bit integers, scores are summed by item and document, and ``row_number``
keeps the best.  Postings are dealt out by document once, before the join: the sums over (item, document), of which there
are many more than postings, then need no shuffle, and of each item only the best rows of a partition are gathered.  Item
terms are broadcast in blocks of a bounded size, by a hash of item and term; one block is the rule.

Nulls and edge cases: a null or empty text, or one without terms, has no postings and is not counted.  Every row is a
document of its own: repeated rows and rows that share a ``doc_id`` are ranked separately.  A null ``doc_id`` is ranked
behind others of its score.  Rows of the item table that share an ``item_id`` (null is an id too) are one item with the
terms of all; an item without terms or without a match has no rows.  Tables may be empty.  Other columns, whatever their
names, are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import slices, text_column, texts_of, write_stage
from .decontaminate import words_of

TOP = 20
BUCKETS = 1024
#: Item terms are broadcast in blocks of about this many bytes.
SENT_BYTES = 32 << 20
#: Postings of one Arrow batch.
BATCH = 1 << 17

#: What the contract query gives, in DuckDB's SQL.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
sizes AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
q AS (SELECT item_id, t, count(*) AS q FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL),
p AS (SELECT rid, doc_id, n, t, CAST(count(*) AS BIGINT) AS tf FROM (SELECT rid, doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
weights AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p, sizes GROUP BY t, n_docs),
scored AS (SELECT item_id, rid, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN p USING (t) JOIN weights USING (t), sizes GROUP BY item_id, rid, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, rid) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``rid``, ``doc_id``, ``n``, ``term``, ``tf``): every term of every document with its occurrences, and for each
    document with terms one row without a term.  ``rid`` tells rows apart that share an id; ``n`` counts a document's terms."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), text_column(text_col).alias("text"))
    schema = T.StructType([T.StructField("rid", T.LongType()), T.StructField("doc_id", rows.schema["doc_id"].dataType)])
    schema = schema.add("n", T.LongType()).add("term", T.StringType()).add("tf", T.LongType())

    def batch_of(part: pa.RecordBatch, at: list[int], counts: list[Counter]) -> pa.RecordBatch:
        lengths = np.fromiter(map(len, counts), np.int64, len(counts)) + 1
        totals = [sum(c.values()) for c in counts]
        terms = pa.array(list(chain.from_iterable((None, *c) for c in counts)), pa.binary()).view(pa.string())
        tf = np.fromiter(chain.from_iterable((0, *c.values()) for c in counts), np.int64, len(terms))
        rows = pa.array(np.repeat(np.array(at, np.int64), lengths))
        n = np.repeat(np.array(totals, np.int64), lengths)
        return pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(n), terms, pa.array(tf)], schema.names)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            at, counts, size = [], [], 0
            for k, text in enumerate(texts_of(part, "text")):
                if found := Counter(words_of(text)):
                    at.append(k)
                    counts.append(found)
                    size += len(found)
                if size >= BATCH:
                    yield batch_of(part, at, counts)
                    at, counts, size = [], [], 0
            if at:
                yield batch_of(part, at, counts)

    return rows.mapInArrow(of, schema)


def bucket_of(term: Column) -> Column:
    """The bucket of a term; the rows of documents are in bucket -1."""
    return F.coalesce(F.when(term.isNotNull(), F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")), F.lit(-1))


def bucketed(rows: DataFrame) -> DataFrame:
    """Postings with their ``bucket``, each partition sorted by bucket and term."""
    return rows.withColumn("bucket", bucket_of(F.col("term"))).sortWithinPartitions("bucket", "term")


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(``item_id``, ``bucket``, ``term``, ``q``): the terms of every item with their occurrences."""
    found = postings(items, id_col, text_col).where("term IS NOT NULL")
    counted = found.groupBy(F.col("doc_id").alias("item_id"), "term").agg(F.sum("tf").alias("q"))
    return counted.withColumn("bucket", bucket_of(F.col("term")))


def sent_blocks(wanted: DataFrame, sent_bytes: int) -> int:
    """Into how many blocks the item terms are dealt, so that each can be broadcast."""
    size = wanted.agg(F.sum(F.octet_length("term") + F.lit(48))).first()[0] or 0
    return 1 if size <= sent_bytes else 2 * -(-size // sent_bytes)


def asked_postings(docs: DataFrame, wanted: DataFrame, small: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The postings of the terms that items ask for, and the rows of all documents."""
    asked = wanted.select(F.col("term").alias("key")).distinct().withColumn("asked", F.lit(True))
    # A document's own row has a key that is no term, so that such rows are spread if the join is shuffled.
    rows = postings(docs, id_col, text_col).withColumn("key", F.coalesce("term", F.concat(F.lit(" "), F.col("rid").cast("string"))))
    return rows.join(F.broadcast(asked) if small else asked, "key", "left").where("term IS NULL OR asked").drop("key", "asked")


def search_postings(index: DataFrame, wanted: DataFrame, top: int = TOP, blocks: int = 1) -> DataFrame:
    """The ``top`` documents of every item over written postings: ``item_id``, ``rank``, ``rid``, ``doc_id``, ``score``."""
    n_docs, n_terms = index.where("bucket = -1").agg(F.count("*"), F.sum("n")).first()
    matches = index.where("bucket >= 0")
    held = matches.groupBy("bucket", "term").agg(F.count("*").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n_docs + 2) / (F.lit(2.0) * F.col("df") + 1))).cast("long")
    weighted = wanted.join(held, ["bucket", "term"]).select("bucket", "term", "item_id", (F.col("q") * weight).alias("w"))
    block = F.pmod(F.xxhash64("item_id", "term", F.lit(7)), F.lit(blocks))
    weighted = write_stage(weighted.where("w > 0").withColumn("block", block), "weighted")
    # 1000000000 * tf and 25 * n * n_docs stay below 2**63 for texts of up to 9 * 10**9 terms and corpora of 10**10 documents.
    part = f"(1000000000 * tf) div (1000 * tf + 12 * (75 + (25 * n * {n_docs}L) div {n_terms or 1}L))"
    dealt = matches.select("rid", "doc_id", "bucket", "term", F.expr(part).alias("part")).repartition("rid")
    joined = None
    for k in range(blocks):
        own = F.broadcast(weighted.where(F.col("block") == k).drop("block"))
        more = dealt.join(own, ["bucket", "term"]).select("item_id", "rid", "doc_id", (F.col("w") * F.col("part")).alias("s"))
        joined = more if joined is None else joined.unionByName(more)
    scores = joined.groupBy("item_id", "rid", "doc_id").agg(F.sum("s").alias("score")).where("score > 0")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "rid")
    ranked = scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "rid", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """The ``top`` documents of every item: ``item_id``, ``rank``, ``rid``, ``doc_id``, ``score``."""
    wanted = write_stage(item_terms(items), "item-terms")
    blocks = sent_blocks(wanted, sent_bytes)
    index = write_stage(bucketed(asked_postings(docs, wanted, blocks == 1)), "postings")
    return search_postings(index, wanted, top, blocks)


def write_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """The postings of all terms of ``docs``, for ``search_index``."""
    bucketed(postings(docs, id_col, text_col)).write.mode("overwrite").option("compression", "zstd").parquet(path)


def search_index(index: DataFrame, items: DataFrame, top: int = TOP, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """As ``search``, over an index that ``write_index`` has written and ``spark.read.parquet`` reads."""
    wanted = write_stage(item_terms(items), "item-terms")
    return search_postings(index, wanted, top, sent_blocks(wanted, sent_bytes))


def query(spark, sf_dir: str) -> DataFrame:
    """Contract query of operator 11."""
    found = search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("item_id", "rank", "doc_id", "score")
