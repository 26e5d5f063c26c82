"""More than a thousand huge documents through the query's own operator and size."""

from landpanel.llm import token_counts
from landpanel.llm.queries import vocabulary


def test_many_huge_documents_equal_the_library(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect() if r.text and len(r.text) < 4000]
    made = []
    for k in range(1100):
        part = texts[k % len(texts) :] + texts[: k % len(texts)]
        text, j = "", 0
        while len(text) < token_counts.HUGE + (k * 37) % 1500:
            text, j = text + part[j] + ("\n", " ", "\t ", "")[(k + j) % 4], j + 1 + k % 3
        made.append((k, text))
    path = vocabulary("word_bpe_49k.json")
    want = token_counts.Counter.load(path).encoder
    got = {r.doc_id: r for r in token_counts.count_tokens(spark.createDataFrame(made, "doc_id bigint, text string").repartition(4), path).collect()}
    counts = [len(e.ids) for at in range(0, len(made), 100) for e in want.encode_batch([t for _, t in made[at : at + 100]], add_special_tokens=False)]
    assert [got[k].n_tokens for k, _ in made] == counts
    assert sum(r.n_chunks > 1 for r in got.values()) > 1090
