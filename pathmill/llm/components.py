"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathmill.llm.common import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: each node of the edges with the least node of its component.

    Every round a node takes the least root among its own and its neighbours', then the root of that root, so chains
    halve and a round costs joins of the edge table; each round's roots are kept in the shared folder. It ends when
    nothing changes.
    """
    both = cut(edges.where(F.col(a) != F.col(b)).select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(edges.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct())
    roots = cut(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("root")).withColumnRenamed("x", "node"))
    while True:
        near = both.join(roots, both["y"] == roots["node"]).groupBy("x").agg(F.min("root").alias("near"))
        offered = roots.join(near, roots["node"] == near["x"]).select("node", F.col("root").alias("old"), F.least("root", "near").alias("new"))
        up = roots.select(F.col("node").alias("at"), F.col("root").alias("above"))
        jumped = offered.join(up, offered["new"] == up["at"], "left").select("node", "old", F.least("new", F.coalesce("above", "new")).alias("root"))
        jumped = cut(jumped)
        changed = not jumped.where("root <> old").isEmpty()
        roots = jumped.select("node", "root")
        if not changed:
            return roots
