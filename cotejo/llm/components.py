"""Connected components of a table of links, by alternating star operations.

Every round links the parents of a node to its smallest parent (small star) and moves each
node to the smallest parent of its parent (large star). Components become stars around
their smallest node in a number of rounds that grows with the logarithm of the longest
path. All links stay in Spark; hubs are combined map-side and joined by key, so that a
skewed hub can be split by adaptive execution. Lineage is cut once a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo.llm.common import cut_lineage


def _round(links: DataFrame) -> DataFrame:
    lowest = links.groupBy("child").agg(F.min("parent").alias("low"), F.count(F.lit(1)).alias("n"))
    both = links.join(lowest, "child").select(
        F.explode(
            F.array(
                F.struct(F.col("child"), F.col("low").alias("parent"), (F.col("n") > 1).alias("moved")),
                F.struct(F.col("parent").alias("child"), F.col("low").alias("parent"), (F.col("n") > 1).alias("moved")),
            )
        ).alias("x")
    ).select("x.*").filter("child <> parent")
    small = both.groupBy("child", "parent").agg(F.max("moved").alias("moved"))
    above = small.groupBy("child").agg(F.min("parent").alias("low")).withColumnRenamed("child", "parent")
    large = small.join(above, "parent", "left").select(
        "child", F.coalesce("low", "parent").alias("parent"), (F.col("moved") | F.col("low").isNotNull()).alias("moved")
    )
    return large.groupBy("child", "parent").agg(F.max("moved").alias("moved"))


def stars(links: DataFrame) -> DataFrame:
    """``child``, ``parent`` for every linked node but the smallest of each component.

    ``links`` has columns a and b of one ordered type; loops, both directions and repeats
    are allowed. An empty table gives an empty result.
    """
    current = links.select(F.greatest("a", "b").alias("child"), F.least("a", "b").alias("parent")).filter("child <> parent").distinct()
    current = cut_lineage(current)
    while True:
        current = cut_lineage(_round(current.select("child", "parent")))
        if not current.agg(F.max("moved")).first()[0]:
            return current.select("child", "parent")
