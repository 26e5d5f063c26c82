"""The line query against brute force over all lines, short ones among them."""

import hashlib
from collections import Counter

import corpus_pipeline
from landpanel.llm import lines
from landpanel.llm.queries import QUERIES


def brute_dedup(texts):
    """{doc_id: text without repeats} by comparing all lines: two edits from 24 characters on, one from 12, none below."""
    first = {}
    for k in sorted(x for x, t in texts.items() if t is not None):
        for at, line in enumerate(texts[k].split("\n")):
            if line.strip(" \t\n\r\x0b\x0c"):
                first.setdefault(line, (k, at))
    root = {x: x for x in first}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_length = {}
    for x in first:
        if len(x) >= 12:
            by_length.setdefault(len(x), []).append((x, Counter(x)))
    for n, those in by_length.items():
        e = 2 if n >= 24 else 1
        for d in range(e + 1):
            for i, (x, cx) in enumerate(those):
                for y, cy in those[i + 1 :] if d == 0 else by_length.get(n + d, ()):
                    if (cx - cy).total() <= e and (cy - cx).total() <= e and lines.edit_distance(x, y, e) <= e:
                        root[find(x)] = find(y)
    stays = {}
    for x, place in first.items():
        stays[find(x)] = min(place, stays.get(find(x), place))
    return {k: t and "\n".join(x for at, x in enumerate(t.split("\n")) if x not in first or stays[find(x)] == (k, at)) for k, t in texts.items()}


def test_the_query_drops_short_repeats_as_brute_force_does(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    want = brute_dedup(texts)
    short = Counter(x for t in texts.values() for x in (t or "").split("\n") if x.strip() and len(x) < 24)
    assert max(short.values()) > 1
    got = {r.doc_id: r.text_sha256 for r in QUERIES["op4_line_dedup"](spark, sf_dir).collect()}
    assert got == {k: None if t is None else hashlib.sha256(t.encode()).hexdigest() for k, t in want.items()}


def test_short_repeats_go_in_query_and_pipeline_and_blank_lines_stay(spark, tmp_path):
    rows = [(1, "short\n\nother"), (2, " \nshort\n\nshorn\n \nnew"), (3, "short")]
    docs = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want = {1: "short\n\nother", 2: " \n\nshorn\n \nnew", 3: ""}
    got = {r.doc_id: (r.n_dropped, r.text_sha256) for r in QUERIES["op4_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {k: (n, hashlib.sha256(want[k].encode()).hexdigest()) for k, n in ((1, 0), (2, 1), (3, 1))}
    left = {r.doc_id: (r.text, r.n_chars) for r in dict(corpus_pipeline.STAGES)["lines"](spark, docs, str(tmp_path)).collect()}
    assert left == {1: (want[1], 12), 2: (want[2], len(want[2]))}


def test_edits_follow_the_length_and_blank_lines_stay(spark):
    base = "abcdefghijklmnopqrstuvwxyz"
    rows = [
        (1, "\n".join([base[:11], base[:12], base[:23], base[:24], " " * 30, "", "\t" * 5])),
        (2, base[:10] + "X"), (3, base[:11] + "X"), (4, base[:10] + "XY"), (5, base[:21] + "XY"), (6, base[:22] + "X"), (7, base[:22] + "XY"),
        (8, base[:23] + "Q" + "R"), (9, base[:12] + "Q"), (10, base[:12] + "QR"), (11, " " * 30 + "\n\n" + "\t" * 5),
    ]
    got = {r.doc_id: r._line_dropped for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), short=True).collect()}
    want = {k: len(rows[k - 1][1].split("\n")) - len(t.split("\n")) if t else 1 for k, t in brute_dedup(dict(rows)).items()}
    assert got == want and got[2] == 0 and got[3] == 1 and got[4] == 0 and got[6] == 1 and got[7] == 1 and got[11] == 0


def test_long_lines_with_edits_at_both_ends_are_compared_in_few_steps():
    from time import process_time

    from landpanel.llm.lines import edit_distance

    line = "".join(chr(97 + k * k % 23) for k in range(100_000))
    start = process_time()
    for _ in range(100):
        assert edit_distance("x" + line + "y", "z" + line, 2) == 2
        assert edit_distance("x" + line + "yy", "z" + line, 2) == 3
    assert process_time() - start < 3  # character by character it is some 20 million steps
