import hashlib

from landpanel import plans


def test_prefer_longer_reads_all_rows_and_whole_texts(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: (r.text_md5, r.origin) for r in plans.QUERIES["t9_prefer_longer"](spark, sf_dir).collect()}
    want = {}
    for k, t in texts.items():
        rest = t if t is None else t.split("\n", 1)[-1]
        b = t is None or len(t.encode()) > len(rest.encode()) + 200
        chosen = t if b else rest
        want[k] = (chosen if chosen is None else hashlib.md5(chosen.encode()).hexdigest(), "b" if b else "a")
    assert got == want and {o for _, o in want.values()} == {"a", "b"}
    assert any(len(t or "") > 1100 for t in texts.values()) and any(k % 12 == 0 for k in texts)
