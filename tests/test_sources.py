import hashlib
import os

from landpanel.operators import clean
from landpanel.plans import QUERIES
from landpanel.sources import io


def test_tolerant_scan_tells_empty_files_from_broken_ones(spark, tmp_path):
    at = str(tmp_path / "t")
    rows = spark.range(2000).selectExpr("id", "repeat(uuid(), 40) AS text")
    for k in range(3):
        rows.where(f"id % 3 = {k}").coalesce(1).write.mode("append").parquet(at)
    rows.limit(0).coalesce(1).write.mode("append").parquet(at)
    files = sorted(f for f in os.listdir(at) if f.endswith(".parquet"))
    sizes = {f: os.path.getsize(f"{at}/{f}") for f in files}
    empty = min(sizes, key=sizes.get)
    whole, noise, half = (f for f in files if f != empty)
    with open(f"{at}/{noise}", "wb") as f:
        f.write(b"PAR1 not a file PAR1")
    with open(f"{at}/{half}", "r+b") as f:  # the footer is whole, what it points at is not
        f.seek(200)
        f.write(b"\xff" * (sizes[half] // 2))
    for f in os.listdir(at):
        if f.endswith(".crc"):
            os.remove(f"{at}/{f}")
    got, bad = io.scan_tolerant(spark, at, schema=rows.schema)
    assert {os.path.basename(r.file) for r in bad.collect()} == {noise, half}
    assert got.count() == spark.read.parquet(f"{at}/{whole}").count() > 0 and got.columns == ["id", "text"]


def test_changed_values_with_an_equal_count_are_exported(spark, tmp_path):
    at = str(tmp_path / "e")
    make = lambda x: spark.createDataFrame([(1, "a", None), (2, None, x), (2, None, x)], "k int, s string, v double")
    assert io.export_if_changed(make(1.0), at) and not io.export_if_changed(make(1.0).repartition(3), at)
    assert io.export_if_changed(make(2.0), at)
    assert sorted(r.v or 0 for r in spark.read.parquet(at).collect()) == [0, 2, 2]
    swapped = spark.createDataFrame([(1, None, None), (2, "a", 2.0), (2, None, 2.0)], "k int, s string, v double")
    assert io.export_if_changed(swapped, at)  # a null on another row
    assert io.export_if_changed(make(2.0).distinct(), at) and not os.path.exists(f"{at}.new")
    os.remove(f"{at}.fingerprint")
    assert io.export_if_changed(make(2.0).distinct(), at)  # a run that died before its mark is repeated


def test_export_ends_after_two_idle_rounds(spark, tmp_path):
    seen = iter([1, 1, 2, 2, 2, 3])
    assert io.export_until_idle(lambda: spark.range(next(seen)), str(tmp_path / "x")) == 2
    assert next(seen) == 3


def test_split_check_counts_both_ways(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (3, "z")], "k int, s string")
    b, c = spark.createDataFrame([(1, "x"), (2, None)], a.schema), spark.createDataFrame([(4, "q"), (2, None), (3, "z")], a.schema)
    assert tuple(clean.split_check(a, b, c).first()) == (1, 2)
    assert tuple(clean.split_check(a, a.limit(0), a).first()) == (0, 0)
    assert tuple(clean.split_check(a.limit(0), a.limit(0)).first()) == (0, 0)


def test_digests_hold_no_content(spark, tmp_path):
    made = {"long.parquet": os.urandom(3_000_001), "one.parquet": b"\0", "a b%20#+.parquet": b"\xef\xbb\xbfabc\r\n", "c.txt.gz": b"not packed\n"}
    for name, content in made.items():
        (tmp_path / name).write_bytes(content)
    want = {name: (len(x), hashlib.md5(x).hexdigest(), hashlib.sha256(x).hexdigest()) for name, x in made.items()}
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "5")  # Spark refuses to hold more of a file
    try:
        got = {os.path.basename(r.path): (r.bytes, r.md5, r.sha256) for r in io.file_manifest(spark, str(tmp_path)).collect()}
        assert got == want
        names = {r.name: (r.bytes, r.md5, r.sha256) for r in QUERIES["s10_file_manifest"](spark, str(tmp_path)).collect()}
        assert names == {name: x for name, x in want.items() if name.endswith(".parquet")}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_a_manifest_without_limit_reads_heavy_files(spark, tmp_path):
    heavy = (1 << 30) + 7
    with open(tmp_path / "x.parquet", "wb") as f:
        f.truncate(heavy)  # without blocks on the disk
    h = hashlib.md5()
    for n in [1 << 20] * (1 << 10) + [7]:
        h.update(bytes(n))
    assert io.file_manifest(spark, str(tmp_path)).first().md5 is None
    assert QUERIES["s10_file_manifest"](spark, str(tmp_path)).select("bytes", "md5").first() == (heavy, h.hexdigest())
