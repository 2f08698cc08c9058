"""Stored tables that are changed in place: rows lie in hash buckets of a key, and a change rewrites the buckets that it touches.

A bucket is one folder. A change finds its buckets first (their number is bounded, so the list comes to the driver), reads these alone
and overwrites their folders when the whole job is done; all other buckets keep their files. Large buckets, such as one with a key that
holds a third of all rows, are read and written by many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalog import update_by_key

BUCKET = "bucket"


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def packing_session(spark: SparkSession, target_bytes: int) -> SparkSession:
    """A session of the same application whose scans fill tasks with files up to ``target_bytes`` by the lengths listed."""
    own = spark.newSession()
    for name, value in {"maxPartitionBytes": target_bytes, "openCostInBytes": 0, "minPartitionNum": 1}.items():
        own.conf.set(f"spark.sql.files.{name}", str(value))
    return own


def compact_files(spark: SparkSession, source: str, path: str, target_bytes: int = 256 << 20) -> None:
    """Rewrite the Parquet files of ``source`` as files of some ``target_bytes`` each under ``path``, whatever the width of the rows.

    The scan packs files into tasks by their lengths and cuts longer ones at row groups, and a task writes one file. Nothing is
    shuffled. A row group longer than the target stays whole; an empty source gives an empty table.
    """
    packing_session(spark, target_bytes).read.parquet(source).write.mode("errorifexists").parquet(path)


@dataclass(frozen=True)
class BucketStore:
    """A table of ``schema`` under ``path``, in ``buckets`` buckets of ``key`` and sorted by ``key`` and ``order`` within files.

    Rows without a key lie in one bucket like those of any other key; no change by the key reaches them, as null equals nothing.
    """

    spark: SparkSession
    path: str
    schema: T.StructType
    key: str
    order: tuple[str, ...] = ()
    buckets: int = 64

    def __post_init__(self):
        if BUCKET in self.schema.names:
            raise ValueError(f"a stored table has no column {BUCKET} of its own")

    # Reading ----------------------------------------------------------------

    def _stored(self, spark: SparkSession | None = None, only: list[int] | None = None) -> DataFrame:
        rows = (spark or self.spark).read.schema(T.StructType([*self.schema, T.StructField(BUCKET, T.IntegerType())])).parquet(self.path)
        return rows if only is None else rows.where(F.col(BUCKET).isin(only))

    def read(self) -> DataFrame:
        return self._stored().drop(BUCKET)

    def of(self, value: str) -> DataFrame:
        """The rows of one key; the folder of its bucket alone is read."""
        kind = self.schema[self.key].dataType
        wanted = F.lit(value).cast(kind)
        return self._stored().where((F.col(BUCKET) == bucket_of(wanted, self.buckets)) & (F.col(self.key) == wanted)).drop(BUCKET)

    def files(self) -> DataFrame:
        """(path, length, bucket) of the stored files, from their listing."""
        listed = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(self.path)
        place = F.regexp_extract("path", rf"/{BUCKET}=(\d+)/[^/]*$", 1).cast("int")
        return listed.select("path", "length", place.alias(BUCKET))

    # Writing ----------------------------------------------------------------

    def _write(self, rows: DataFrame, replace: bool) -> None:
        """``rows`` with their bucket; adaptive execution splits large buckets and lets small ones share a task."""
        ordered = rows.select(*self.schema.names, BUCKET).hint("rebalance", F.col(BUCKET))
        self._save(ordered, replace)

    def _save(self, rows: DataFrame, replace: bool) -> None:
        sorted_rows = rows.sortWithinPartitions(BUCKET, self.key, *self.order)
        # Folders are exchanged when all tasks are done, so the rows may come from the same folders.
        writer = sorted_rows.write.mode("overwrite" if replace else "append").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(BUCKET).parquet(self.path)

    def append(self, rows: DataFrame) -> None:
        shaped = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema])
        self._write(shaped.withColumn(BUCKET, bucket_of(F.col(self.key), self.buckets)), replace=False)

    # Changes ----------------------------------------------------------------

    def touched(self, wanted: DataFrame, by: str) -> list[int]:
        """The buckets with rows whose ``by`` is in ``wanted``; two columns are scanned, none but folders if ``by`` is the key."""
        ids = wanted.select(F.col(by).cast(self.schema[by].dataType).alias(by)).where(F.col(by).isNotNull())
        if by == self.key:
            stored = self._stored().select(BUCKET).distinct()
            found = ids.select(bucket_of(F.col(by), self.buckets).alias(BUCKET)).distinct().join(stored, BUCKET, "left_semi")
        else:
            found = self._stored().select(by, BUCKET).join(ids, by, "left_semi").select(BUCKET).distinct()
        return sorted(r[0] for r in found.collect())

    def update(self, changes: DataFrame, by: str | None = None) -> list[int]:
        """Changed columns take the new value where there is one, as ``update_by_key`` says; returns the rewritten buckets.

        The key of the store itself cannot change, as its rows would lie in a wrong bucket.
        """
        by = by or self.key
        if self.key in changes.columns and self.key != by:
            raise ValueError(f"{self.key} places the rows and cannot be changed")
        hit = self.touched(changes, by)
        if hit:
            self._write(update_by_key(self._stored(only=hit), changes, by), replace=True)
        return hit

    def delete(self, gone: DataFrame, by: str | None = None) -> list[int]:
        """Rows whose ``by`` is in ``gone`` go; returns the buckets touched. Buckets left without rows lose their folder."""
        by = by or self.key
        hit = self.touched(gone, by)
        if not hit:
            return hit
        ids = gone.select(F.col(by).cast(self.schema[by].dataType).alias(by)).distinct()
        left = self._stored(only=hit).join(ids, by, "left_anti")
        filled = {r[0] for r in left.select(BUCKET).distinct().collect()}
        if filled:
            # Buckets without rows have no folder to put in the place of the old one.
            self._write(left, replace=True)
        self._drop([b for b in hit if b not in filled])
        return hit

    def _drop(self, buckets: list[int]) -> None:
        for b in buckets:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{BUCKET}={b}")
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    # Upkeep -----------------------------------------------------------------

    def crowded(self, target_bytes: int) -> list[int]:
        """Buckets that hold more than twice the files that their bytes need."""
        need = F.greatest(F.ceil(F.sum("length") / F.lit(target_bytes)), F.lit(1))
        found = self.files().groupBy(BUCKET).agg(F.count(F.lit(1)).alias("n"), need.alias("need")).where("n > 2 * need")
        return sorted(r[0] for r in found.select(BUCKET).collect())

    def compact(self, target_bytes: int = 256 << 20) -> list[int]:
        """Merge the many small files that appends leave in a bucket; returns the rewritten buckets.

        Each bucket is scanned by tasks of some ``target_bytes`` of listed files, and a task writes one file; nothing is shuffled.
        """
        hit = self.crowded(target_bytes)
        if hit:
            own = packing_session(self.spark, target_bytes)
            self._save(reduce(DataFrame.unionByName, [self._stored(own, [b]) for b in hit]), replace=True)
        return hit


def delete_files(
    files: BucketStore, sheets: BucketStore, chunks: BucketStore, deleted: DataFrame, data: BucketStore | None = None
) -> None:
    """Remove files with their sheets, chunks and data tables from the stores, which are in buckets of ``file_id`` (data: table name).

    The files themselves go last, so a run that stops in between can be repeated. ``deleted`` must not be read from the stores
    that change; ids that no store holds change nothing.
    """
    if data is not None:
        named = sheets.read().join(deleted.select("file_id").distinct(), "file_id", "left_semi")
        data.delete(named.select("table_name"))
    for store in (sheets, chunks, files):
        store.delete(deleted, "file_id")
