import math
import re
from collections import Counter

from pyspark.sql import functions as F

from landpanel.llm import lexical
from landpanel.llm.lexical import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k=20):
    held = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df, asked, out = Counter(t for _, c in held for t in c), {}, []
    for i, t in items:
        asked.setdefault(i, Counter()).update(TERM.findall((t or "").translate(LOWER)))
    for i, q in asked.items():
        scored = []
        for d, c in held:
            m = 75 + 25 * sum(c.values()) * n_docs // max(n_terms, 1)
            s = sum(a * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, a in q.items() if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(i, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_equals_brute_force(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert len(want) > 500 and found(search(docs, items)) == want


def test_small_shards_bundles_and_terms_that_are_joined(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(lexical, "SHARD", 16)
    monkeypatch.setattr(lexical, "ITEMS", 4)
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    docs, items = docs.repartition(3), items.where("item_id % 9 = 0")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 5)
    assert found(search(docs, items, k=5, most=0)) == want


def test_odd_rows(spark):
    long = "alpha " * 200_000 + "Ωmega Straße"
    rows = [(1, None), (2, ""), (3, "Alpha beta, alpha!"), (3, "alpha BETA"), (None, "alpha beta"), (5, long), (6, "alpha beta"), (7, "ALPHA beta"), (8, "-- ??"), (9, "straße Ωmega ωmega"), (10, "éa ÉA x²")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit(7) for c in ("shard", "term", "bundle", "score", "m", "df", "item_id", "rank", "owner")})
    asks = [(1, "beta alpha BETA"), (1, "gamma"), (2, None), (None, "alpha Straße"), (4, "nothing known"), (5, "x² É Éa"), (6, "")]
    items = spark.createDataFrame(asks, "item_id bigint, text string").withColumn("doc_id", F.lit(3))
    assert found(search(docs, items)) == brute(rows, asks)
    assert found(search(docs, items, k=2)) == brute(rows, asks, 2)
    assert search(docs.limit(0), items).count() == 0 and search(docs, items.limit(0)).count() == 0
    assert search(docs.where("doc_id < 3"), items).count() == 0
