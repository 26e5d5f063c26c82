import hashlib
import re

import pytest
from pyspark.sql import functions as F

from landpanel.llm.exact import Cuckoo, build, delete, exact_duplicates, insert, lookup


def sha(text):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()


def brute(rows):
    groups = {}
    for doc, text in rows:
        groups.setdefault(sha(text), []).append(doc)
    least = lambda ids: min((x for x in ids if x is not None), default=None)
    return {k: (least(v), len(v)) for k, v in groups.items()}


def test_filter_inserts_finds_deletes_and_grows():
    keys = [hashlib.sha256(str(k).encode()).hexdigest() for k in range(3000)]
    f, stored, grown = Cuckoo(64), set(), 0
    for key in keys:
        stored.add(key)
        if not f.add(key):
            f, grown = f.grown(stored), grown + 1
    assert grown >= 3 and f.buckets >= 1024 and all(k in f for k in keys)
    again = Cuckoo(table=f.table.tobytes())
    for key in keys[:1500]:
        again.remove(key)
    assert all(k in again for k in keys[1500:])
    assert sum(k in again for k in keys[:1500]) < 20  # chance hits of 16 bits only
    with pytest.raises(KeyError):
        for key in keys[:1500]:
            again.remove(key)


def test_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows)
    assert any(n > 1 for _, n in want.values())
    for shards in (None, 7):
        got = exact_duplicates(docs.repartition(5), shards=shards).collect()
        assert len(got) == len(rows)
        texts = dict(rows)
        for r in got:
            assert r.text_sha256 == sha(texts[r.doc_id]) and (r.keep_id, r.group_size) == want[r.text_sha256] and r.kept == (r.doc_id == r.keep_id)


def test_odd_rows(spark):
    long = "x y\n" * 300_000
    rows = [(5, None), (2, ""), (9, ""), (None, "a b"), (7, "a \t\n b"), (7, "a b"), (None, "only"), (None, "only"), (1, long), (3, long.replace("\n", "\x0b\x0c")), (4, " "), (6, "\r"), (8, " "), (8, " ")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit(1) for c in ("digest", "shard", "first", "n", "_at", "at", "keep_id", "new")})
    got = exact_duplicates(df.repartition(3)).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    assert all((r.keep_id, r.group_size) == want[r.text_sha256] for r in got)
    kept = [r for r in got if r.kept]
    assert len(kept) == len(want) and all(r.doc_id == r.keep_id for r in kept)
    assert exact_duplicates(df.limit(0)).count() == 0 and exact_duplicates(df.limit(0)).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_index_inserts_deletes_and_looks_up(spark):
    make = lambda ids: spark.createDataFrame([(i, f"text {i // 2}") for i in ids], "doc_id bigint, text string")
    index = build(make(range(0, 2000, 2)), shards=3)
    sizes = [len(r.table) for r in index.filters.collect()]
    assert len(sizes) == 3 and min(sizes) > 64 * 8  # began with 64 buckets and overflowed
    index, told = insert(index, make([1, 3, 5, 4000, 4001]))
    assert {r.doc_id: r.new for r in told.collect()} == {1: False, 3: False, 5: False, 4000: True, 4001: True}
    assert {r.doc_id: r.keep_id for r in lookup(index, make([0, 1, 7, 4001, 9000])).collect()} == {0: 0, 1: 0, 7: 6, 4001: 4000, 9000: None}
    index = delete(index, spark.createDataFrame([(0,), (6,), (4000,), (77777,)], "doc_id bigint"))
    assert {r.doc_id: r.keep_id for r in lookup(index, make([0, 7, 4001])).collect()} == {0: 1, 7: None, 4001: 4001}
    # what was deleted to the last row can come again
    index, told = insert(index, make([7]))
    assert told.first().new and lookup(index, make([6])).first().keep_id == 7


def test_chance_hits_are_told_from_copies(spark):
    """More digests than a filter of 16 bits can tell apart in one shard: all are found to be different."""
    rows = spark.range(60_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    assert exact_duplicates(rows, shards=1).where("kept AND group_size = 1").count() == 60_000
