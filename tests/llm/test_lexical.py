"""Ranked lexical search against a brute force of its contract."""

import collections
import math
import re

import duckdb
import pytest

from framelake.llm import lexical

SF = "/root/testdata/sf0.001"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, top=20):
    """(item, rank, doc, score) over lists of (id, text)."""
    counted = [(d, collections.Counter(terms(t))) for d, t in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df = collections.Counter(t for _, c, _ in counted for t in c)
    asked = collections.defaultdict(collections.Counter)
    for i, t in items:
        asked[i].update(terms(t))
    out = []
    for item, wanted in asked.items():
        scored = []
        for k, (d, c, n) in enumerate(counted):
            m = 75 + 25 * n * n_docs // n_terms
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t, q in wanted.items() if t in c)
            if score > 0:
                scored.append((-score, d is None, d, k))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0, x[3]))
        out += [(item, r, d, -s) for r, (s, _, d, _) in enumerate(scored[:top], 1)]
    return sorted(out, key=repr)


DOCS = [
    (1, None), (2, ""), (3, " ,.;!? "), (4, "Alpha beta"), (4, "Alpha beta"), (4, "beta gamma ALPHA alpha"), (None, "alpha beta"), (5, "alpha_beta x1y2 É漢字 alpha"),
    (6, "word " * 5000 + "alpha"), (7, "delta-delta alpha É漢字"), (8, "\U0001f600 alpha"), (9, "épsilon É"),
]
ITEMS = [(1, "Alpha, beta? alpha!"), (1, "gamma"), (2, None), (3, "..."), (None, "É漢字 delta"), (4, "nowhere to be found"), (5, "épsilon word \U0001f600")]


def rows_of(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=repr)


@pytest.mark.parametrize("sent_bytes", [1 << 20, 100])
def test_search(spark, sent_bytes):
    docs = spark.createDataFrame([(i, t, "x", 1, 2.0) for i, t in DOCS], "doc_id long, text string, term string, rid int, bucket double")
    items = spark.createDataFrame([(i, t, 3) for i, t in ITEMS], "item_id long, text string, w int")
    for top in (2, 20):
        # Rows that share an id and a score are told apart by where they stand, which a brute force need not follow.
        assert rows_of(lexical.search(docs, items, top, sent_bytes)) == brute(DOCS, ITEMS, top)
    assert lexical.search(docs.limit(0), items).count() == 0 and lexical.search(docs, items.limit(0)).count() == 0


def test_index_is_searched_like_the_documents(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    lexical.write_index(docs, str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert rows_of(lexical.search_index(index, items)) == brute(DOCS, ITEMS)
    found = index.where((index.bucket == 3) | (index.term == "alpha"))
    assert "PushedFilters" in found._jdf.queryExecution().toString()


def test_query_matches_sql(spark):
    got = rows_of(lexical.query(spark, SF))
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert got == sorted(c.execute(lexical.ORACLE).fetchall(), key=repr) and len(got) > 100
    # No pair of item and document is shuffled: of the exchanges before the last, none is by both.
    plan = lexical.query(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(item_id#" in plan and not any("item_id" in line and "rid" in line for line in plan.splitlines() if "Exchange hashpartitioning" in line)
