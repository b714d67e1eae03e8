"""Spelling variants against a brute force over all pairs of words."""

import collections
import re
import zlib

import numpy as np

from framelake.llm import variants

SF = "/root/testdata/sf0.001"


def brute_words(docs, least=6, count=5, typo=199):
    counts = collections.Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % typo == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least and n >= count}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(held, times=5):
    by_length = collections.defaultdict(list)
    for w in held:
        by_length[len(w)].append(w)
    out = {}
    for w, n in held.items():
        others = [o for k in (-1, 0, 1) for o in by_length[len(w) + k] if near(w, o)]
        best = min(others, key=lambda o: (-held[o], o), default=None)
        out[w] = (n, len(others), best if best is not None and held[best] >= times * n else None)
    def root(w):
        while out[w][2] is not None:
            w = out[w][2]
        return w
    return sorted((w, n, k, f, held[f] if f is not None else None, root(w)) for w, (n, k, f) in out.items())


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect())


def test_pairs_of_dense_tries(spark):
    rng = np.random.default_rng(8)
    held = {}
    for letters, n in (("ab", 200), ("abc", 300), ("abcdefghéÿÀ", 500)):
        for _ in range(n):
            held["".join(rng.choice(list(letters), rng.integers(1, 9)))] = int(2 ** rng.integers(0, 16))
    # Words with many spellings, runs of one letter, and words that begin all others.
    for stem in ("construction", "aaaaaaaa", "beginning"):
        for k in range(len(stem) + 1):
            for c in "abnz":
                held[stem[:k] + c + stem[k:]] = 3
                held[stem[:k] + c + stem[k + 1 :]] = 20
        held[stem] = 1000
    assert rows_of(variants.group_words(spark.createDataFrame(list(held.items()), "word string, n long"))) == brute(held)


def test_documents(spark):
    rng = np.random.default_rng(9)
    stems = ["Straße", "naïveté", "question", "answering", "ÀÉÿword", "letters", "lettres", "short", "x×y÷zab"]
    texts = []
    for k in range(300):
        text = []
        for s in rng.choice(stems, 12):
            at = int(rng.integers(0, len(s)))
            text.append(s if rng.random() < 0.8 else s[:at] + s[at + 1 :])
        texts.append((k if k % 9 else None, " ".join(text) + rng.choice([".", "\U0001f600", "漢字letters", "Āletters¿letters9letters"])))
    texts += [(5000, None), (5001, ""), (5002, "lettersletters" * 20000), *[(5003, "LETTERS letterz")] * 5]
    table = spark.createDataFrame([(d, t, 1, "w") for d, t in texts], "doc_id long, text string, n int, word string").repartition(3)
    for typo in (199, 7):
        got = rows_of(variants.variants(table, typo=typo))
        assert got == brute(brute_words(texts, typo=typo)) and any(r[3] for r in got)
    assert variants.variants(table.limit(0)).count() == 0


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = variants.query(spark, SF)
    assert rows_of(got) == brute(brute_words(docs))
    assert got.schema.simpleString() == "struct<word:string,form:string,root:string,n:bigint,n_near:bigint,form_n:bigint>"
