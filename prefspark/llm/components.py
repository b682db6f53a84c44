"""Connected components of an edge table, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from prefspark.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("centre"), F.least("least", "a").alias("m"))
    return both.join(least, F.col("a") == F.col("centre")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link the smaller neighbours of a node, and the node, to the least of them."""
    least = edges.groupBy(F.col("a").alias("centre")).agg(F.min("b").alias("m"))
    met = edges.join(least, F.col("a") == F.col("centre"))
    return met.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b")


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one node alone, and on none that hangs itself."""
    hung = F.struct(F.col("a").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("held"))
    held = F.struct(F.col("b").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("held"))
    ends = edges.select(F.explode(F.array(hung, held)).alias("end")).select("end.*")
    return not ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("held").alias("held")).where("hangs + held > 1 AND hangs > 0").agg(F.count("*")).first()[0]


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) for every node of (a, b) edges; a component is named by its least node.

    Self edges keep a lone node.  Each round is written once, so lineage stays short,
    and the rounds end as soon as all edges lead to the least nodes; their number
    is logarithmic in the size of a component.
    """
    given = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    now = given.where("a <> b")
    for _ in range(rounds):
        if _all_stars(now):
            break
        now = stored(_small_star(_large_star(now)).distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    own = now.select(F.col("b").alias("a"), "b").unionByName(given.where("a = b"))
    named = now.unionByName(own).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return stored(named, "components")
