import random

from ledgerlake.operators.catalog import assign_versions
from ledgerlake.session import new_path
from ledgerlake.streaming import jobs


def write_parts(spark, rows, schema, parts):
    path = new_path(spark, "in")
    step = -(-len(rows) // parts)
    for i in range(0, len(rows), step):
        spark.createDataFrame(rows[i:i + step], schema).coalesce(1).write.mode("append").parquet(path)
    return path


def test_chunk_stream_equals_batch(spark):
    rows = [(f"f{i}", "\n\n".join(f"paragraph {j} costs ${j}" for j in range(i * 20))) for i in range(6)]
    path = write_parts(spark, rows, "file_id string, text string", 3)
    base = new_path(spark, "out")
    source = lambda: spark.readStream.schema("file_id string, text string").option("maxFilesPerTrigger", 1).parquet(path)
    jobs.start_chunk_stream(source(), f"{base}/t", f"{base}/c").awaitTermination()
    got = sorted(map(str, spark.read.parquet(f"{base}/t").collect()))
    want = sorted(map(str, jobs.text_to_chunks(spark.createDataFrame(rows, "file_id string, text string")).collect()))
    assert got == want and got
    # Nothing new: a second run adds nothing.
    jobs.start_chunk_stream(source(), f"{base}/t", f"{base}/c").awaitTermination()
    assert spark.read.parquet(f"{base}/t").count() == len(got)


SCHEMA = "file_name string, arrival bigint, file_hash string"


def test_version_stream_equals_batch(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice(["n0", "n1", "n2", None]), i, rnd.choice(["A", "B", None])) for i in range(60)]
    path = write_parts(spark, rows[:45], SCHEMA, 3)
    base = new_path(spark, "versions")

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
        query = jobs.start_version_stream(stream, f"{base}/log", f"{base}/c")
        query.awaitTermination()
        return [p for p in query.recentProgress if p.numInputRows]

    assert len(run()) == 3
    # A later run goes on from the state that the one before it left.
    spark.createDataFrame(rows[45:], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    assert len(run()) == 1 and not run()
    want = sorted(map(tuple, assign_versions(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    assert sorted(map(tuple, jobs.read_versions(spark, f"{base}/log").collect()), key=repr) == want


def test_a_batch_writes_the_state_of_its_own_names(spark):
    many = [(f"n{i}", i, "A") for i in range(3000)]
    path = write_parts(spark, many + [("n5", 3000 + i, "B") for i in range(3000)], SCHEMA, 2)
    base = new_path(spark, "versions")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    query = jobs.start_version_stream(stream, f"{base}/log", f"{base}/c")
    query.awaitTermination()
    states = [p.stateOperators[0] for p in query.recentProgress if p.numInputRows]
    assert sorted(s.numRowsUpdated for s in states) == [1, 3000] and max(s.numRowsTotal for s in states) == 3000
