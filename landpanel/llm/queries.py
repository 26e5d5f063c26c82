"""One query for each operator: production parameters, whole tables, whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix, words

    docs = cut(table(spark, sf_dir, "documents").select("doc_id", "source", words().alias("_words")))
    mixed = mix(docs, size_col="_words")
    rows = mixed.withColumn("place", F.try_element_at("_mix_copies.place", F.lit(1)))
    names = [F.col(f"_mix_{c}").alias(c) for c in ("size", "source_size", "target", "taken")]
    return rows.select("doc_id", *names, F.floor(F.col("place") * 1_000_000).cast("bigint").alias("place_ppm"), "place").orderBy("place", "doc_id").drop("place")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify, train

    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import dedup_lines

    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), short=True)
    return done.select("doc_id", F.col("_line_count").alias("n_lines"), F.col("_line_dropped").alias("n_dropped"), F.length("text").cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan, written

    found = scan(table(spark, sf_dir, "documents"))

    def count(k: int):  # a second argument of the lambda, also one with a default, would be the element's index
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(("assign", "access", "hex"))]
    return found.select("doc_id", *counts, F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"), F.size(F.filter("spans", lambda s: s["kind"] == 3)).cast("bigint").alias("n_markov"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode

    return encode(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import describe, pack

    d = describe(pack(table(spark, sf_dir, "documents")), ["doc_id", "n_bytes"], payload=True)
    keys = F.concat_ws(",", F.transform("keyframes", lambda k: F.concat_ws("+", k["start"], k["length"])))
    feature = F.concat_ws(";", F.concat(F.lit("codec="), F.trim("codec")), F.concat(F.lit("timescale="), "timescale"), F.concat(F.lit("duration="), "duration"), F.concat(F.lit("samples="), "n_samples"), F.concat(F.lit("keyframes="), F.size("keyframes")), F.concat(F.lit("ranges="), F.md5(keys)))
    return d.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), (F.col("duration") / F.col("timescale")).alias("seconds"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import digests, segments

    said = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    return digests(segments(rows.unionByName(more)))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import variants

    return variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_near_duplicates, op3_language, op4_line_dedup, op5_secrets, op6_pieces, op7_token_counts, op8_topk, op9_media, op10_chat, op11_lexical, op12_exact, op13_spelling)}
from .sql import SQL  # noqa: E402, F401
