"""Extra columns whose names the operators use inside change nothing."""

from pyspark.sql import functions as F

from landpanel.llm import chat, topk


def test_top_k_and_chat_with_clashing_columns(spark, sf_dir):
    clash = {c: F.lit(7) for c in ("id", "v", "query", "qb", "rb", "rank", "score", "cut", "total", "ids", "m", "seg", "segment", "piece", "loss", "n", "start", "state", "digest", "_nth", "totals")}
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = lambda d: sorted(map(tuple, d.collect()), key=str)
    assert rows(topk.top_k(v.withColumns(clash))) == rows(topk.top_k(v))
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("conv_id < 20")
    assert rows(chat.digests(chat.segments(c.withColumns(clash)))) == rows(chat.digests(chat.segments(c)))
