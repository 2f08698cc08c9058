"""Connected components of an edge table by star contraction.

Each round links every node's larger neighbours to its smallest neighbour, then
every node and its smaller neighbours to the smallest one (Kiveris et al., 2014,
"Connected Components in MapReduce and Beyond"). The number of rounds grows with
the logarithm of the component size, not with its diameter, and a round only
takes minima and equi-joins, never a whole neighbourhood in one place: a node's
edges are dealt over salts, and its smallest neighbour is told to each salt that
has some of them, so the root of the largest component is no hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


SALTS = 32
#: Up to so many edges no node has more than a task can well take, and salts are left out.
FEW = 250_000


def _with_smallest(e: DataFrame, few: bool = False) -> DataFrame:
    """Edges (u, v) with ``m``, the smallest v of their u."""
    if few:
        return e.select("u", "v").join(e.groupBy("u").agg(F.min("v").alias("m")), "u")
    salted = e.select("u", "v", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int").alias("salt"))
    parts = salted.groupBy("u", "salt").agg(F.min("v").alias("part"))
    told = parts.select("u", "salt").join(parts.groupBy("u").agg(F.min("part").alias("m")), "u")
    return salted.join(told, ["u", "salt"]).select("u", "v", "m")


def _large_star(e: DataFrame, few: bool) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    m = F.least("u", "m")
    return _with_smallest(both, few).where((F.col("v") > F.col("u")) & (F.col("v") != m)).select(F.col("v").alias("u"), m.alias("v"))


def _small_star(e: DataFrame, few: bool) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # The edge to the smallest neighbour stays, the others hang on it from then on.
    return _with_smallest(down, few).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for all nodes of ``edges(u, v)``; the label is the smallest node of the component.

    ``u`` and ``v`` may be any orderable type.
    """
    e = cut(edges.where("u <> v").distinct())
    while True:
        # Two rounds per written table. A round makes no edges beyond those it has.
        few = e.count() <= FEW
        once = _small_star(_large_star(e, few), few).distinct()
        nxt = cut(_small_star(_large_star(once, few), few).distinct())
        e = nxt
        # Finished when every node hangs on one root and no root hangs on anything.
        ends = nxt.select("u", F.lit(1).alias("up")).unionByName(nxt.select(F.col("v").alias("u"), F.lit(0).alias("up")))
        degree = ends.groupBy("u").agg(F.sum("up").alias("ups"), F.min("up").alias("is_leaf"))
        if degree.where((F.col("ups") > 1) | ((F.col("ups") == 1) & (F.col("is_leaf") == 0))).limit(1).count() == 0:
            break
    return (
        e.select(F.col("u").alias("node"), F.col("v").alias("label"))
        .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
    )
