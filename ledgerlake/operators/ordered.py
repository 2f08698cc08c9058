"""Row numbers, previous values and running sums that hold up when one key owns most rows.

The rows are range-partitioned by key and order together, which cuts a large key into
many blocks of a bounded number of rows. Work happens per block, and only one summary
row per (key, block) is carried across blocks. Where no key has more rows than a block,
windows over the keys do.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut

BLOCK_ROWS_CONF = "ledgerlake.ordered.blockRows"
BLOCK_ROWS = 1_000_000
#: Shares that keys are hashed to, at least, to see whether one of them has more rows than a block.
KEY_SHARES = 4096
# What monotonically_increasing_id() leaves for the rows of a partition.
_ROW_BITS = 33


def _most_rows(rows: DataFrame, keys: list[str], blocks: int) -> int:
    """No key has more rows than this: the most that share a hash of the keys, counted without an exchange of keys."""
    share = F.pmod(F.xxhash64(*keys), F.lit(max(KEY_SHARES, 64 * blocks)))
    return rows.groupBy(share.alias("share")).count().agg(F.max("count")).first()[0]


class Ordered:
    """Rows of ``df`` in a total order within ``keys``; ``order`` must be unique per key.

    ``df`` is written once, as its size decides on the plan and range partitioning samples its input before it deals it out.
    ``blocked`` deals out few rows too, where later work per row is dear.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[Column], blocked: bool = False):
        self.keys, self.order = keys, order
        conf = df.sparkSession.conf
        rows = cut(df)
        size = int(conf.get(BLOCK_ROWS_CONF, str(BLOCK_ROWS)))
        blocks = math.ceil(rows.count() / size)
        self.one_block = not blocked and (blocks <= 1 or bool(keys) and _most_rows(rows, keys, blocks) <= size)
        if self.one_block:
            self.df = rows
            return
        blocks = max(blocks, int(conf.get("spark.sql.shuffle.partitions")))
        by = [*[F.col(k) for k in keys], *order]
        placed = rows.repartitionByRange(blocks, *by).sortWithinPartitions(*by)
        placed = placed.withColumn("_place", F.monotonically_increasing_id())
        # Written, as block numbers must survive a lost executor unchanged.
        self.df = cut(
            placed.withColumn("_block", F.shiftright("_place", _ROW_BITS))
            .withColumn("_place", F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
        )

    def _part(self) -> list[str]:
        return [*self.keys, "_block"]

    def _window(self):
        if self.one_block:
            return Window.partitionBy(*self.keys).orderBy(*self.order)
        return Window.partitionBy(*self._part()).orderBy("_place")

    def _across(self):
        return Window.partitionBy(*self.keys).orderBy("_block")

    def _with_summary(self, summary: DataFrame, name: str) -> DataFrame:
        """Attach one summary value per (key, block) to the rows."""
        on = self._part()
        right = summary.select(*[F.col(k).alias(f"_r_{k}") for k in on], name)
        cond = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in on]
        return self.df.join(right, cond, "left").drop(*[f"_r_{k}" for k in on])

    def number(self, out: str) -> Ordered:
        """``out`` = row number from 1 within the key: a row's place in its block tells it without a sort or window."""
        if self.one_block:
            self.df = self.df.withColumn(out, F.row_number().over(self._window()).cast("long"))
            return self
        before = self._across().rowsBetween(Window.unboundedPreceding, -1)
        summary = (
            self.df.groupBy(*self._part()).agg(F.min("_place").alias("_low"), F.count(F.lit(1)).alias("_rows"))
            .withColumn("_shift", F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_low") + 1)
        )
        self.df = self._with_summary(summary, "_shift").withColumn(out, F.col("_place") + F.col("_shift")).drop("_shift")
        return self

    def lag(self, name: str, out: str) -> Ordered:
        """``out`` = value of ``name`` in the previous row of the key, null on the first."""
        w = self._window()
        if self.one_block:
            self.df = self.df.withColumn(out, F.lag(name).over(w))
            return self
        summary = (
            self.df.groupBy(*self._part())
            .agg(F.max_by(F.struct(F.col(name).alias("v")), "_place").alias("_tail"))
            .withColumn("_carry", F.lag("_tail").over(self._across()))
        )
        self.df = (
            self._with_summary(summary, "_carry")
            .withColumn("_first", F.row_number().over(w) == 1)
            .withColumn(out, F.when(F.col("_first"), F.col("_carry.v")).otherwise(F.lag(name).over(w)))
            .drop("_carry", "_first")
        )
        return self

    def running_sum(self, value: Column, out: str) -> Ordered:
        """``out`` = sum of ``value`` over the key's rows up to and including this one."""
        frame = self._window().rowsBetween(Window.unboundedPreceding, 0)
        if self.one_block:
            self.df = self.df.withColumn(out, F.sum(value).over(frame))
            return self
        before = self._across().rowsBetween(Window.unboundedPreceding, -1)
        summary = (
            self.df.groupBy(*self._part()).agg(F.sum(value).alias("_sum"))
            .withColumn("_before", F.sum("_sum").over(before))
        )
        within = self._with_summary(summary, "_before").withColumn("_within", F.sum(value).over(frame))
        self.df = within.withColumn(
            out, F.when(F.col("_before").isNull(), F.col("_within"))
            .when(F.col("_within").isNull(), F.col("_before"))
            .otherwise(F.col("_before") + F.col("_within"))
        ).drop("_before", "_within")
        return self

    def done(self) -> DataFrame:
        return self.df.drop("_block", "_place")


def numbered(df: DataFrame, keys: list[str], order: list[Column], out: str) -> DataFrame:
    """Row number from 1 within ``keys``."""
    return Ordered(df, keys, order).number(out).done()
