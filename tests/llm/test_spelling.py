import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from landpanel.llm.spelling import Acceptors, near_in_partition, near_words, variants

RUN = re.compile(r"[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(words, w, letters):
    one = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + x + w[i:] for i in range(len(w) + 1) for x in letters} | {w[:i] + x + w[i + 1 :] for i in range(len(w)) for x in letters}
    return {x for x in one if x in words and x != w}


def brute(rows, least=3):
    n = Counter()
    for d, t in rows:
        for w in RUN.findall(t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= least}
    letters, forms, count = set("".join(n)), {}, {}
    for w in n:
        c = near(n, w, letters)
        best = min(c, key=lambda x: (-n[x], x), default=None)
        count[w], forms[w] = len(c), best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, n[w], count[w], n[forms[w]] if forms[w] else None))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def test_equals_brute_force_also_with_hot_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert len(want) > 1000 and any(r[1] and r[1] != r[2] for r in want)
    assert found(variants(docs)) == want
    assert found(variants(docs.repartition(3), most=8)) == want


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("abé", min_size=5, max_size=9), max_size=60))
def test_composition_finds_each_pair_once(words):
    met = Counter()
    for l in range(5, 10):  # noqa: E741
        for forward in (True, False):
            parts = {}
            for w in (w for w in words if len(w) in (l, l + 1)):
                key, tail = (w[: l // 2], w[l // 2 :]) if forward else (w[len(w) - l // 2 :], w[: len(w) - l // 2][::-1])
                parts.setdefault(key, []).append(tail)
            for key, tails in parts.items():
                for w, k, _, _ in near_in_partition(l, forward, key, sorted(tails), [1] * len(tails)):
                    met[w] += k
    assert met == Counter({w: k for w in words if (k := len(near(words, w, "abé")))})


def test_acceptor_is_minimal_and_shared():
    a = Acceptors()
    first, other = a.accept(["xaing", "ybing", "ycing"]), a.accept(["zaing"])
    # what follows: nothing, g, ng, ing, aing, bing or cing; and the two first states
    assert a.count[first] == 3 and len(a.arcs) == 8 and a.tails(first, other) == []


def test_odd_rows(spark):
    long = "k" * 30_000
    rows = [(1, None), (2, ""), (None, "Wörter wörter WÖRTER wörters"), (None, "wÖrter wörters wörters"), (3, "abcde " * 4 + "abcdef " * 9 + "abcdé " * 30), (3, "abcde×÷ œabcde"), (4, f"{long} {long} {long}"), (5, f"{long}k x{long} " * 3), (6, "aaaaa aaaaaa aaaaaaa " * 5), (7, "ab cd 12345 ?!")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit(7) for c in ("word", "n", "form", "root", "k", "tail", "open")})
    short = [r for r in rows if r[0] not in (4, 5)]
    assert found(variants(df.where("doc_id IS NULL OR doc_id NOT IN (4, 5)"))) == brute(short)
    got = {r.word: r for r in variants(df).collect()}
    assert got[long].n_near == got[long + "k"].n_near == got["x" + long].n_near == 2 and got[long].root == long
    assert variants(df.limit(0)).count() == 0 and variants(df.where("text = ''")).count() == 0


def test_hot_partitions_of_long_shared_starts(spark):
    rows = [("sharedstart" + w, 1 + k) for k, w in enumerate(["", "a", "b", "ab", "ba", "aab", "abb", "aba", "abab", "baab", "abba", "aaab", "bbab"])]
    df = spark.createDataFrame(rows, "word string, n bigint")
    want = sorted(map(tuple, near_words(df).collect()))
    assert want and sorted(map(tuple, near_words(df, most=1).collect())) == want == sorted(map(tuple, near_words(df, most=3).collect()))
