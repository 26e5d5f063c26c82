"""Helpers shared by the text operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the operators count as white space inside a text: the six ASCII characters.
WORD = r"[^\x20\x09-\x0D]+"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a folder of its own only where the session names none, as in tests."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local") or sc.master.startswith("local-cluster") and not shared:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and read them from there: lost executors lose nothing."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_blocks(df: DataFrame, columns: list[str], schema: str, block, rows: int = 128, chars: int = 4_000_000) -> DataFrame:
    """Map blocks of rows in Python workers: block(list of tuples of `columns`) -> list of tuples of `schema`.

    A block ends after `rows` rows or about `chars` characters, so what a worker holds does not grow with the batch.
    """
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        import pyarrow as pa

        def out(found):
            cols = list(zip(*found, strict=True)) or [()] * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

        for batch in batches:
            held, weight = [], 0
            for at in range(0, batch.num_rows, 32):
                part = batch.slice(at, 32)
                for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    held.append(row)
                    weight += sum(len(x) for x in row if isinstance(x, (str, bytes)))
                    if len(held) >= rows or weight >= chars:
                        yield out(block(held))
                        held, weight = [], 0
            if held:
                yield out(block(held))

    return df.select(*columns).mapInArrow(run, schema)


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: 8 for each column and array element, and the bytes of texts."""

    def of(c: Column, kind) -> Column:
        name = kind.typeName()
        if name in ("string", "binary"):
            return F.octet_length(c) + 8
        if name == "struct":
            return sum((of(c.getField(f.name), f.dataType) for f in kind), F.lit(0))
        if name == "array" and kind.elementType.typeName() in ("string", "binary", "struct", "array", "map") or name == "map":
            return F.octet_length(F.to_json(c)) + 8
        return F.size(c) * 8 + 8 if name == "array" else F.lit(8)

    return sum((F.coalesce(of(F.col(f"`{f.name}`"), f.dataType), F.lit(8)) for f in df.schema), F.lit(0)).cast("bigint")


def attach(df: DataFrame, side: DataFrame, keys: list[str], most: int = 2_000_000, how: str = "inner") -> DataFrame:
    """Join `side`, which has one row a key: broadcast if its rows are found to take at most `most` bytes, else by shuffle.

    The bound does not grow with the data. A shuffle join leaves hot keys to adaptive execution, which splits them.
    `side` is read once more for its size, so it should be cut if it is costly.
    """
    few = False
    if most > 0:
        n, held = side.select(row_bytes(side).alias("b")).limit(most // 8 + 1).agg(F.count("*"), F.coalesce(F.sum("b"), F.lit(0))).first()
        few = n <= most // 8 and held <= most
    return df.join(F.broadcast(side) if few else side.hint("merge"), keys, how)


_HELD: dict = {}


def only(name: str, forget) -> None:
    """Say that operator `name` works in this Python process: what the memos of others hold is let go, back to the system."""
    if name not in _HELD:
        others = list(_HELD)
        for other in others:
            _HELD.pop(other)()
        _HELD[name] = forget
        if others:
            import gc

            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # where the C library keeps freed memory for itself
                ctypes.CDLL(None).malloc_trim(0)
