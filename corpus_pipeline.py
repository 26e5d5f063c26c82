"""Documents to mixed, encoded training text: five stages, each written as Parquet and read again by the next.

Rows that a stage removes: texts without a told language; later copies of lines that repeat exactly or within two
edits, and documents of which nothing else, or less than a twentieth, was left; all but one document of each group of
near duplicates; copies beyond what the mix takes. Everything else is handed on whole. Documents that the mix takes twice
appear twice. The mix writes its rows in the order of training; the last stage returns each row's `place` in that order.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landpanel.llm.common import checkpoint_dir, table
from landpanel.llm.langid import keep_identified, train
from landpanel.llm.lines import dedup_lines
from landpanel.llm.mixing import in_order, mix
from landpanel.llm.neardup import drop_near_duplicates
from landpanel.llm.pieces import encode
from landpanel.llm.queries import vocabulary


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; null, empty and letterless texts go."""
    return keep_identified(docs, train(docs))


#: A document of which the line stage leaves less than this share of its characters is a copy of others, and goes.
LEAST_LEFT = 0.05


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of lines, with n_chars of what is left.

    A text that lost lines goes if all its words or 95 % of its characters went with them.
    """
    done = dedup_lines(docs, short=True)
    left = F.regexp("text", F.lit(r"\S")) & (F.length("text") >= LEAST_LEFT * F.col("_line_chars"))
    done = done.where((F.col("_line_dropped") == 0) | left)
    done = done.withColumn("n_chars", F.when(F.col("_line_dropped") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more on five-word shingles."""
    return drop_near_duplicates(docs, width=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once for each time, range-sorted by their place in training."""
    return in_order(mix(docs, whole=True)).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, the ids themselves, and the row's place in training.

    Columns of documents cannot say the order, files can: the range sort numbers its parts in order and each part keeps
    its rows in order, so `place` is the part's number times 2^33 plus the number of the row in it. It is null if
    `docs` does not come from files.
    """
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).try_cast("bigint")
    try:
        rows = docs.select("doc_id", "text", (F.shiftleft(part, 33) + F.col("_metadata.row_index")).alias("place"))
    except AnalysisException:
        rows = docs.select("doc_id", "text", F.lit(None).cast("bigint").alias("place"))
    return encode(rows, vocabulary("piece_bpe_32k.model"), with_ids=True, carry=["place"]).drop("decoded")


STAGES = [
    ("language", identified),
    ("lines", without_repeated_lines),
    ("near_duplicates", without_near_duplicates),
    ("mixing", mixed),
    ("pieces", encoded),
]

#: SQL has neither the classifier nor the sketches; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what stands between them is written to the shared folder.

    A stage's input goes once its output is written whole, so only the last stage's input stays.
    """
    docs, at, before = table(spark, sf_dir, "documents"), f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            here = f"{at}/{k}-{name}"
            docs.write.parquet(here)
            docs = spark.read.parquet(here)
            if before:
                old = spark._jvm.org.apache.hadoop.fs.Path(before)
                old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
            before = here
    return docs
