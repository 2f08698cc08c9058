import pytest
from pyspark.sql import functions as F

from ledgerlake.operators.buckets import BucketStore, compact_files, delete_files
from ledgerlake.operators.catalog import update_by_key
from ledgerlake.session import new_path

SCHEMA = "file_id string, sheet_id string, category string, n long"


def rows(spark, n=200, files=40):
    return spark.range(n).select(
        F.concat(F.lit("f"), F.col("id") % files).alias("file_id"), F.concat(F.lit("s"), "id").alias("sheet_id"),
        F.when(F.col("id") % 3 > 0, "old").alias("category"), F.col("id").alias("n"))


def store(spark, df, key="file_id", buckets=16):
    made = BucketStore(spark, new_path(spark, "store"), df.schema, key, ("sheet_id",) if "sheet_id" in df.columns else (), buckets)
    made.append(df)
    return made


def listed(made):
    return {(r.bucket, r.path): r.length for r in made.files().collect()}


def content(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("by", ["file_id", "sheet_id"])
def test_update_rewrites_touched_buckets_only(spark, by):
    df = rows(spark)
    # One row per key, so that either column can be changed by.
    df = df.where("n < 40")
    made = store(spark, df)
    changes = df.where("n in (3, 7)").select(by, F.lit("new").alias("category"))
    before = listed(made)
    hit = made.update(changes, by)
    after = listed(made)
    assert 1 <= len(hit) <= 2
    assert {k for k in before if k[0] not in hit} == {k for k in after if k[0] not in hit}
    assert not {k for k in before if k[0] in hit} & set(after)
    assert content(made.read()) == content(update_by_key(df, changes, by))


def test_changes_of_odd_rows(spark):
    df = rows(spark, 30, 5).unionByName(spark.createDataFrame([(None, "x", "old", 1), (None, "x", "old", 1), ("f1", None, None, None)], SCHEMA))
    made = store(spark, df)
    # Null keys and unknown ids reach nothing.
    odd = spark.createDataFrame([(None, "new"), ("nope", "new")], "file_id string, category string")
    assert made.update(odd.where("file_id is null")) == [] and made.delete(odd.where("file_id is null")) == []
    made.update(odd)
    assert content(made.read()) == content(df)
    # A null keeps the value, a key changed twice is an error, and so is a change of the key.
    made.update(spark.createDataFrame([("f1", None)], "file_id string, category string"))
    assert content(made.read()) == content(df)
    with pytest.raises(ValueError):
        made.update(spark.createDataFrame([("f1", "a"), ("f1", "b")], "file_id string, category string"))
    with pytest.raises(ValueError):
        made.update(spark.createDataFrame([("s1", "f2")], "sheet_id string, file_id string"), "sheet_id")
    with pytest.raises(ValueError):
        BucketStore(spark, "x", df.withColumn("bucket", F.lit(1)).schema, "file_id")


def test_empty_store(spark):
    df = rows(spark).where("false")
    made = store(spark, df)
    assert made.read().count() == 0 and made.crowded(1) == []
    assert made.update(rows(spark, 3).select("file_id", "category")) == [] and made.delete(rows(spark, 3)) == []


def test_one_key_reads_one_folder(spark):
    made = store(spark, rows(spark))
    one = made.of("f3")
    assert {r.n for r in one.collect()} == {3, 43, 83, 123, 163}
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(file_id,f3)" in plan


def test_delete_drops_empty_buckets(spark):
    df = rows(spark)
    made = store(spark, df, buckets=64)
    before = listed(made)
    hit = made.delete(df.where("file_id in ('f1', 'f2')"))
    after = listed(made)
    assert content(made.read()) == content(df.where("file_id not in ('f1', 'f2')"))
    assert {k for k in before if k[0] not in hit} == {k for k in after if k[0] not in hit}
    made.delete(df)
    assert made.read().count() == 0 and not listed(made)


def test_a_file_goes_with_all_it_has(spark):
    sheets = rows(spark).withColumn("table_name", F.concat(F.lit("t"), "n"))
    files = sheets.select("file_id").distinct()
    chunks = sheets.select("file_id", F.col("sheet_id").alias("chunk_id"))
    data = sheets.select("table_name", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("row"))
    s = {n: store(spark, d, k) for n, d, k in (
        ("files", files, "file_id"), ("sheets", sheets, "file_id"), ("chunks", chunks, "file_id"), ("data", data, "table_name"))}
    gone = spark.createDataFrame([("f1",), ("f1",), ("f9",), ("nope",), (None,)], "file_id string")
    for _ in range(2):  # A repeated run changes nothing.
        delete_files(s["files"], s["sheets"], s["chunks"], gone, s["data"])
        assert s["files"].read().count() == 38 and s["sheets"].read().count() == 190 and s["chunks"].read().count() == 190
        assert content(s["data"].read()) == content(data.join(sheets.where("file_id not in ('f1', 'f9')"), "table_name", "left_semi"))


def test_compaction_of_a_store(spark):
    df = rows(spark)
    made = store(spark, df.where("n % 10 = 0"), buckets=4)
    for i in range(1, 10):
        made.append(df.where(f"n % 10 = {i}"))
    before = listed(made)
    hit = made.compact()
    after = listed(made)
    assert hit == [0, 1, 2, 3] and len(before) > 20 and len(after) == 4
    assert content(made.read()) == content(df) and made.compact() == []
    for path in after:
        kept = [r.file_id for r in spark.read.parquet(path[1]).collect()]
        assert kept == sorted(kept)


@pytest.mark.parametrize("width", [10, 4000])
def test_files_near_a_byte_target(spark, width):
    """Files of random sizes come near the target, for narrow and for wide rows alike."""
    source, out, target = new_path(spark, "small"), new_path(spark, "packed"), 400_000
    n = 3_000_000 // width
    text = F.concat_ws("", *[F.sha2(F.concat(F.lit(str(i)), F.col("id").cast("string")), 256) for i in range(-(-width // 64))])
    spark.range(n).select("id", F.substring(text, 1, width).alias("t")).repartition(40).write.parquet(source)
    lengths = lambda p: [r.length for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(p).select("length").collect()]
    before = lengths(source)
    compact_files(spark, source, out, target)
    after = sorted(lengths(out))
    assert len(before) == 40 and len(after) <= -(-sum(before) // (target // 2))
    assert max(after) <= 1.1 * target and after[1] >= target / 2
    assert content(spark.read.parquet(out).agg(F.count("id"), F.sum("id"), F.sum(F.xxhash64("t") % 1000))) == content(
        spark.read.parquet(source).agg(F.count("id"), F.sum("id"), F.sum(F.xxhash64("t") % 1000)))
