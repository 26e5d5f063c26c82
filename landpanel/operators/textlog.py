"""Change logs, numbered text, log metrics and phrase scans as column work."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from .clean import running


def replay_log(events: DataFrame, key: str = "path", ranges: int | None = None) -> DataFrame:
    """(key, final, n_write, n_edit, n_warn): the state after all successful events in order of ts.

    Columns: key, ts, op ('write' or 'edit'), content, old, new, ok. An edit without a base or whose old text does not
    occur is a warning and changes nothing; it replaces the first occurrence. A write forgets what was before it, so a
    key's history falls apart at its writes: the number of writes so far, a running sum over ranges, tells the segment of
    an event, and each segment is folded by itself, as a sorted stream of which one event and one text are held. Counts
    are sums over segments; the text is the last segment's. A key with a third of all events is spread over tasks by its
    writes.
    """
    kind = events.schema[key].dataType.simpleString()
    columns = [key, "_seg", "final", "n_write", "n_edit", "n_warn"]

    def run(batches):
        import pyarrow as pa

        schema, last, s, done = None, None, None, []

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), schema, strict=True)], names=columns)

        for batch in batches:
            schema = schema or (batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            for at in range(0, batch.num_rows, 256):
                for name, seg, op, content, old, new in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    if last != (name, seg):
                        if last is not None:
                            done.append((*last, *s))
                        last, s = (name, seg), [None, 0, 0, 0]
                    if op == "write":
                        s[0], s[1] = content, s[1] + 1
                    elif op == "edit":
                        place = -1 if s[0] is None or old is None else s[0].find(old)
                        if place < 0:
                            s[3] += 1
                        else:
                            s[0], s[2] = None if new is None else s[0][:place] + new + s[0][place + len(old) :], s[2] + 1
                if len(done) >= 1024:
                    yield rows()
                    done = []
        if last is not None:
            done.append((*last, *s))
        if done:
            yield rows()

    order = ["ts", "op", "content", "old", "new"]
    e = running(events.where("ok").select(key, *order), [key, *order], {"_seg": (F.col("op") == "write").cast("bigint")}, ranges)
    e = e.withColumn("_seg", F.col("_seg") + (F.col("op") == "write").cast("bigint"))
    e = e.repartition(key, "_seg").sortWithinPartitions(key, "_seg", *order)
    folded = e.select(key, "_seg", "op", "content", "old", "new").mapInArrow(run, f"{key} {kind}, _seg bigint, final string, n_write bigint, n_edit bigint, n_warn bigint")
    total = [F.sum(c).cast("int").alias(c) for c in ("n_write", "n_edit", "n_warn")]
    return folded.groupBy(key).agg(F.max(F.struct("_seg", "final")).alias("_f"), *total).select(key, "_f.final", "n_write", "n_edit", "n_warn")


def freshness(changes: DataFrame, snapshots: DataFrame, key: str) -> DataFrame:
    """(key, last, snap, status): MISSING without a snapshot, STALE if the newest is not later than the last change."""
    a = changes.groupBy(key).agg(F.max("ts").alias("last"))
    b = snapshots.groupBy(key).agg(F.max("ts").alias("snap"))
    d = a.join(b, key, "left")
    return d.withColumn("status", scalar.ladder([(F.col("snap").isNull(), "MISSING"), (F.col("snap") <= F.col("last"), "STALE")], "OK"))


def parse_numbered(df: DataFrame, text: str = "text", key: str = "id") -> DataFrame:
    """(key, n_lines, first, last, contiguous, body): text whose lines begin with a number and a tab."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line"))
    num = F.regexp_extract("line", r"^\s*(\d+)\t", 1)
    d = lines.select(key, "at", F.when(num != "", num.cast("bigint")).alias("n"), F.regexp_replace("line", r"^\s*\d+\t", "").alias("rest")).where("n IS NOT NULL")
    return d.groupBy(key).agg(F.count("*").alias("n_lines"), F.min("n").alias("first"), F.max("n").alias("last"), ((F.max("n") - F.min("n") + 1 == F.count("*")) & (F.count_distinct("n") == F.count("*"))).alias("contiguous"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "rest"))), lambda x: x["rest"]), "\n").alias("body"))


def rewrite_text(c: Column, table: Sequence[tuple[str, str]]) -> Column:
    """Plain replacements in the given order."""
    for old, new in table:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def leftovers(c: Column, words: Sequence[str]) -> Column:
    """Which of the words still occur."""
    return F.array_compact(F.array(*(F.when(c.contains(w), F.lit(w)) for w in words)))


def extract_metrics(df: DataFrame, line: str = "line", pattern: str = r"^y(\d{4}): OA=([0-9.]+) macro-F1=([0-9.]+)") -> DataFrame:
    """(year, oa, macro_f1) from log lines; lines of another shape give nothing."""
    g = lambda k: F.regexp_extract(line, pattern, k)
    return df.where(F.col(line).rlike(pattern)).select(g(1).cast("int").alias("year"), F.expr(f"try_cast(regexp_extract({line}, r'{pattern}', 2) AS double)").alias("oa"), F.expr(f"try_cast(regexp_extract({line}, r'{pattern}', 3) AS double)").alias("macro_f1"))


def rewrite_changes(df: DataFrame, table: Sequence[tuple[str, str]], banned: Sequence[str], key: str, text: str = "text") -> DataFrame:
    """(key, changed, replaced, left): the texts that a rewrite changes or leaves with a banned phrase.

    `replaced` has, in the table's order, how many places each pair rewrote in what the pairs before it had made; `left`
    lists the banned phrases that are still there. A pair may rewrite a place and change nothing.
    """
    d, counts = df.select(key, F.col(text).alias("_t0")), []
    for k, (old, new) in enumerate(table):
        gone = F.length(f"_t{k}") - F.length(F.replace(F.col(f"_t{k}"), F.lit(old), F.lit("")))
        d = d.withColumn(f"_n{k}", F.floor(gone / len(old)).cast("bigint")).withColumn(f"_t{k + 1}", F.replace(F.col(f"_t{k}"), F.lit(old), F.lit(new)))
        counts.append(f"_n{k}")
    last = F.col(f"_t{len(table)}")
    d = d.select(key, (last != F.col("_t0")).alias("changed"), F.array(*counts).alias("replaced"), leftovers(last, banned).alias("left"))
    return d.where(F.col("changed") | (F.size("left") > 0))


def phrase_scan(df: DataFrame, phrases: Sequence[str], key: str, text: str = "text") -> DataFrame:
    """(key, line_no, phrase): lines that hold one of a few listed phrases."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line"))
    hit = F.array_compact(F.array(*(F.when(F.col("line").contains(p), F.lit(p)) for p in phrases)))
    return lines.select(key, (F.col("at") + 1).alias("line_no"), F.explode(hit).alias("phrase"))


def phrase_table_scan(df: DataFrame, phrases: DataFrame, key: str, text: str = "text", most: int = 4_000_000) -> DataFrame:
    """(key, line_no, phrase): lines that hold a phrase of a table (phrase), by one walk of an automaton over each text.

    A text costs the same for three phrases and for ten thousand. Tables of more than about `most` characters are taken in
    as many passes as they fill, so what a task holds is bounded. Empty phrases and phrases over several lines match nothing.
    """
    known = phrases.select(F.col("phrase").cast("string").alias("phrase")).where("phrase <> ''").where(~F.col("phrase").contains("\n")).distinct()
    size = known.agg(F.coalesce(F.sum(F.length("phrase") + 16), F.lit(0))).first()[0]
    passes = max(1, -(-size // most))
    kind = df.schema[key].dataType.simpleString()
    found = None
    for k in range(passes):
        mine = [r.phrase for r in (known if passes == 1 else known.where(F.pmod(F.xxhash64("phrase"), F.lit(passes)) == k)).collect()]
        one = df.select(key, text).where(F.col(text).isNotNull()).mapInArrow(walked(df.sparkSession.sparkContext.broadcast(mine), key), f"{key} {kind}, line_no int, phrase string")
        found = one if found is None else found.unionByName(one)
    return found


def walked(phrases, key: str):
    """A walk over texts for broadcast phrases; the automaton is made once a task."""

    def run(batches):
        import ahocorasick
        import numpy as np
        import pyarrow as pa

        machine = ahocorasick.Automaton()
        for p in phrases.value:
            machine.add_word(p, p)
        if not len(machine):
            return
        machine.make_automaton()
        for batch in batches:
            keys, lines, hits = [], [], []
            for at, x in enumerate(batch.column(1)):
                text = x.as_py()
                found = list(machine.iter(text))
                if not found:
                    continue
                ends = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 10)
                no = np.searchsorted(ends, [end for end, _ in found]) + 1
                for line, phrase in sorted({(int(line), phrase) for line, (_, phrase) in zip(no, found, strict=True)}):
                    keys.append(at)
                    lines.append(line)
                    hits.append(phrase)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), pa.array(lines, pa.int32()), pa.array(hits, pa.string())], names=[key, "line_no", "phrase"])

    return run


def missing_paths(df: DataFrame, manifest: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """(path): paths named in texts that the manifest does not list."""
    named = df.select(F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("path")).distinct()
    return named.join(manifest.select("path"), "path", "left_anti")


def prefer_longer(a: DataFrame, b: DataFrame, key: str, more: int = 200) -> DataFrame:
    """(key, text, origin): b where a is missing or b is more than `more` bytes longer, else a."""
    j = a.select(key, F.col("text").alias("_a")).join(b.select(key, F.col("text").alias("_b")), key, "full")
    take = F.col("_a").isNull() | (F.octet_length("_b") > F.octet_length("_a") + more)
    take = F.coalesce(take, F.lit(False))
    return j.select(key, F.when(take, F.col("_b")).otherwise(F.col("_a")).alias("text"), F.when(take, "b").otherwise("a").alias("origin"))


def best_per_key(df: DataFrame, key: str, text: str = "text", ts: str = "ts") -> DataFrame:
    """(key, text, ts): the longest candidate, the newest at a tie."""
    b = df.groupBy(key).agg(F.max(F.struct(F.length(text).alias("n"), F.col(ts).alias("t"), F.col(text).alias("x"))).alias("b"))
    return b.select(key, F.col("b.x").alias(text), F.col("b.t").alias(ts))


def parse_events(df: DataFrame, data: str = "data", fields: Mapping[str, str] = {"tool": "$.tool", "status": "$.state.status"}) -> DataFrame:  # noqa: B006
    """The named JSON fields of a text column as strings; bad JSON gives nulls."""
    return df.select("*", *(F.get_json_object(data, p).alias(n) for n, p in fields.items()))
