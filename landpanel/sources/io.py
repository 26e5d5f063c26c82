"""Sources and sinks: projected and tolerant scans, yearly layout, reports, manifests and idempotent exports."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def scan(spark: SparkSession, path: str, cols: list[str] | None = None, schema: StructType | None = None) -> DataFrame:
    """Parquet with only the columns asked for; a declared schema is checked at load."""
    d = spark.read.parquet(path)
    if schema is not None:
        kinds = dict(d.dtypes)
        bad = [f.name for f in schema if kinds.get(f.name) != f.dataType.simpleString()]
        if bad:
            raise ValueError(f"{path}: columns missing or of another type: {bad}")
    return d.select(*cols) if cols else d


def scan_year(spark: SparkSession, path: str, year: int, cols: list[str] | None = None, column: str = "year") -> DataFrame:
    """One year of a layout partitioned by year: only its folder is read. Other layouts filter on the column, never on row 0."""
    return scan(spark, path, cols).where(F.col(column) == year)


def build_index(spark: SparkSession, path: str, index: str, column: str = "year", key: str = "row_id") -> None:
    """Write (file, value, n, first, last): which values of `column` each file of `path` holds, how many rows and which range of keys.

    One pass over two columns; files that the index has already are not read again.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"))
    if exists(spark, index):
        files = files.join(spark.read.parquet(index).select("file").distinct(), "file", "left_anti")
    new = [r.file for r in files.collect()]
    if not new:
        return
    d = spark.read.parquet(*new)
    rows = d.groupBy(F.input_file_name().alias("file"), F.col(column).alias("value")).agg(F.count("*").alias("n"), F.min(key).alias("first"), F.max(key).alias("last"))
    plain = F.regexp_replace("file", "^file:/+", "file:/")
    rows.withColumn("file", plain).write.mode("append").parquet(index)


def scan_indexed(spark: SparkSession, path: str, index: str, values: list, cols: list[str] | None = None, column: str = "year", key: str = "row_id", keys: tuple | None = None) -> DataFrame:
    """The rows with one of `values`, and a key in the closed range `keys`, from the files alone that the index names for them.

    The files are chosen before the plan is made; inside them the column decides, never the file's first row.
    """
    i = spark.read.parquet(index).where(F.col("value").isin(*values))
    if keys is not None:
        i = i.where((F.col("last") >= keys[0]) & (F.col("first") <= keys[1]))
    files = [r.file for r in i.select("file").distinct().collect()]
    d = spark.read.parquet(*files) if files else spark.read.parquet(path).limit(0)
    d = d.where(F.col(column).isin(*values))
    if keys is not None:
        d = d.where(F.col(key).between(*keys))
    return d.select(*cols) if cols else d


def scan_between(spark: SparkSession, path: str, column: str, first: str, end: str, cols: list[str] | None = None) -> DataFrame:
    """Rows with `column` from `first` to before `end`, times written as text: a range that file and row-group statistics can rule out."""
    d = spark.read.parquet(path)
    kind = d.schema[column].dataType
    d = d.where((F.col(column) >= F.lit(first).cast(kind)) & (F.col(column) < F.lit(end).cast(kind)))
    return d.select(*cols) if cols else d


def footer_rows(spark: SparkSession, files: list[str]) -> list[tuple[str, int | None]]:
    """(file, rows that its footer declares, or None if it has no readable footer): footers alone are opened, many at a time."""
    from concurrent.futures import ThreadPoolExecutor

    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def rows(file: str) -> tuple[str, int | None]:
        try:
            reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(file), conf))
        except Py4JJavaError:
            return file, None
        try:
            return file, reader.getRecordCount()
        finally:
            reader.close()

    with ThreadPoolExecutor(16) as pool:
        return list(pool.map(rows, files))


def hashed(df: DataFrame, columns: list[str], *salt: Column) -> Column:
    """A 64-bit hash of the columns' values; maps, which have no order, by their text."""
    kinds = df.schema
    return F.xxhash64(*salt, *(F.to_json(F.col(f"`{c}`")) if kinds[c].dataType.typeName() == "map" else F.col(f"`{c}`") for c in columns))


def scan_tolerant(spark: SparkSession, path: str, pattern: str = "*.parquet", schema: StructType | None = None, whole: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, files skipped): files without a readable footer, or that give fewer rows than it declares, are left out and listed.

    A valid file without rows is not listed. To find files that break half-way their pages are read once more than for the
    rows themselves; without `whole` footers alone are looked at. What travels to the driver is the list of files, as in
    any scan.
    """
    r = spark.read.option("ignoreCorruptFiles", "true").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    there = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path")
    declared = spark.createDataFrame(footer_rows(spark, [x.path for x in there.collect()]), "file string, rows bigint")
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    if schema is None and declared.where("rows IS NOT NULL").isEmpty():
        return spark.createDataFrame([], "value string"), declared.select(plain("file").alias("file"))
    d = (r.schema(schema) if schema else r).parquet(path)
    if not whole:
        broken = cut(declared.where("rows IS NULL").select(plain("file").alias("file")))
        return d, broken
    # a hash of all columns, since a count alone comes from the footers
    read = d.groupBy(F.col("_metadata.file_path").alias("_f")).agg(F.count("*").alias("n"), F.max(hashed(d, d.columns)).alias("h")).select(plain("_f").alias("file"), F.when(F.col("h").isNotNull(), F.col("n")).alias("n"))
    broken = cut(declared.select(plain("file").alias("file"), "rows").join(read, "file", "left").where("rows IS NULL OR rows > coalesce(n, 0)").select("file"))
    kept = d.withColumn("_f", plain(F.col("_metadata.file_path"))).join(broken.withColumnRenamed("file", "_f"), "_f", "left_anti").drop("_f")
    return kept, broken


def save(df: DataFrame, path: str, by: str | None = "year", mode: str = "overwrite") -> None:
    """Parquet by year; with dynamic overwrite only the years in `df` are replaced."""
    w = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(by) if by else w).parquet(path)


def save_predictions(df: DataFrame, path: str) -> None:
    """Predictions by year, with the columns that the metrics read."""
    save(df.select("row_id", "year", "class_new", "pred", "src", "zone"), path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def holdout_keys(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, "block_keys array<bigint>").select(F.explode("block_keys").alias("block_key"))


def report_json(df: DataFrame) -> DataFrame:
    """One JSON text a row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def sanitize(df: DataFrame) -> DataFrame:
    """For interchange: complex columns become JSON text, infinities and NaN become null."""
    out = []
    for f in df.schema:
        kind = f.dataType.simpleString()
        if kind in ("double", "float"):
            out.append(F.when(~F.isnan(f.name) & (F.abs(f.name) < float("inf")), F.col(f.name)).alias(f.name))
        elif kind.startswith(("array", "map", "struct")):
            out.append(F.to_json(f.name).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def fingerprint(df: DataFrame) -> str:
    """Rows and two sums of 64-bit hashes of the rows: equal for equal rows in any order, in one pass without a shuffle of rows."""
    told = [F.concat(F.lit(i), *(F.col(f"`{c}`").isNull().cast("string") for c in df.columns)) for i in ("a", "b")]  # hashes skip nulls, so say where they are
    sums = [F.sum(hashed(df, df.columns, t).cast("decimal(38,0)")).alias(f"h{k}") for k, t in enumerate(told)]
    n = df.agg(F.count("*").alias("n"), *sums).first()
    names = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema)
    return f"{n.n} {n.h0} {n.h1} {names}"


def export_if_changed(df: DataFrame, path: str) -> bool:
    """Write unless the target holds the same rows; true if it was written.

    What the target holds is told by the fingerprint beside it. New rows are written next to the target and take its
    place by a rename; the fingerprint follows last, so a run that dies between is repeated.
    """
    spark = df.sparkSession
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    mark, now = f"{path}.fingerprint", fingerprint(df)
    if fs.exists(at(f"{path}/_SUCCESS")) and fs.exists(at(mark)) and spark.read.text(mark, wholetext=True).first()[0] == now:
        return False
    df.write.mode("overwrite").parquet(f"{path}.new")
    fs.delete(at(mark), False)
    fs.delete(at(path), True)
    fs.rename(at(f"{path}.new"), at(path))
    out = fs.create(at(mark), True)
    out.write(bytearray(now.encode()))
    out.close()
    return True


def export_until_idle(make, path: str, idle: int = 2, rounds: int = 100) -> int:
    """Export `make()` again and again until nothing has changed in `idle` rounds running; how often it was written."""
    written = quiet = 0
    for _ in range(rounds):
        done = export_if_changed(make(), path)
        written, quiet = written + done, 0 if done else quiet + 1
        if quiet == idle:
            break
    return written


def digest(spark: SparkSession, path: str, algorithm: str) -> Column:
    """The hexadecimal digest of the file that the column `path` names, read as a stream by the task that holds the row.

    A buffer is in memory, never the content, so a file may have any size. The calls are Catalyst's own, on classes that
    Spark brings, and open every file system that Spark reads. Opening is declared non-deterministic: two digests must not
    share a stream, and no plan may read a file twice for one of them.
    """
    jvm = spark._jvm
    e, column = jvm.org.apache.spark.sql.catalyst.expressions, jvm.org.apache.spark.sql.classic.ExpressionUtils
    cls = jvm.java.lang.Class.forName
    kind = lambda name: jvm.org.apache.spark.sql.types.ObjectType(cls(name))
    seq = lambda *x: jvm.PythonUtils.toSeq(list(x))
    literal = lambda value, name: e.Literal(value, kind(name))
    new = lambda name, *args: e.objects.NewInstance(cls(name), seq(*args), seq(), True, kind(name), jvm.scala.Option.empty())
    call = lambda on, name, gives, *args, sure=True: e.objects.Invoke(on, name, kind(gives), seq(*args), seq(), True, True, sure)
    settings = jvm.org.apache.spark.util.SerializableConfiguration(spark._jsparkSession.sessionState().newHadoopConf())
    conf = call(literal(settings, "org.apache.spark.util.SerializableConfiguration"), "value", "org.apache.hadoop.conf.Configuration")
    file = new("org.apache.hadoop.fs.Path", call(column.expression(F.col(path)._jc), "toString", "java.lang.String"))
    fs = call(file, "getFileSystem", "org.apache.hadoop.fs.FileSystem", conf)
    stream = new("org.apache.commons.io.input.AutoCloseInputStream", call(fs, "open", "org.apache.hadoop.fs.FSDataInputStream", file, sure=False))
    told = call(new("org.apache.commons.codec.digest.DigestUtils", literal(algorithm, "java.lang.String")), "digestAsHex", "java.lang.String", stream)
    text = e.objects.StaticInvoke(cls("org.apache.spark.unsafe.types.UTF8String"), jvm.org.apache.spark.sql.types.DataType.fromDDL("string"), "fromString", seq(told), seq(), True, True, True, jvm.scala.Option.empty())
    return Column(column.column(text))


def file_manifest(spark: SparkSession, path: str, pattern: str = "*", heavy: int | None = 1 << 30) -> DataFrame:
    """(path, bytes, mtime, md5, sha256): files above `heavy` bytes are registered without reading them, with null digests; None reads all.

    Files are read as streams, once for each digest, each by one task; large ones have a task of their own.
    """
    d = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    base = d.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime"))
    told = {name: digest(spark, "path", algorithm) for name, algorithm in (("md5", "MD5"), ("sha256", "SHA-256"))}
    return base.withColumns(told if heavy is None else {name: F.when(F.col("bytes") <= heavy, c) for name, c in told.items()})


def shard(df: DataFrame, n: int, c: str = "chunk_id") -> DataFrame:
    """Adds shard = chunk modulo n and deals the rows out by it."""
    return df.withColumn("shard", F.pmod(F.col(c), F.lit(n)).cast("int")).repartition(n, "shard")
