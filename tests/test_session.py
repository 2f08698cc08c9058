from pyspark.sql import functions as F

from ledgerlake import session
from ledgerlake.session import build_session, cut, new_path, release


def test_everything_written_lies_in_one_folder_that_can_be_released(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda spark: str(tmp_path))
    df = cut(spark.range(5).withColumn("x", F.lit(1)))
    assert df.count() == 5 and new_path(spark, "t").startswith(f"{tmp_path}/ledgerlake-")
    assert [p.name for p in tmp_path.iterdir()] == [f"ledgerlake-{spark.sparkContext.applicationId}"]
    release(spark)
    assert not list(tmp_path.iterdir())
    release(spark)


def test_same_session(spark):
    assert build_session("other").sparkContext is spark.sparkContext
