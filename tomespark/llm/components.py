"""Connected components of an edge list, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomespark.llm.common import cut, join_counted


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, class): every node of ``edges`` (a, b) with the smallest node that it is linked to.

    Each round, every node takes the smallest label among its neighbours and
    itself, and then the label of that label (pointer jumping), so long chains
    shrink by halves. Minima combine before the shuffle; each round's labels are
    cut from their lineage in the shared folder. Nodes of very many edges, and
    labels of very many nodes, are joined apart, so a component that holds a third
    of all nodes is no task of its own. Labels never go to the driver, only
    numbers of rows do. ``rounds`` is a guard, not a cap: reaching it raises an
    error. Loops and repeated edges change nothing; no edges give no rows.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    degrees = cut(both.groupBy("b").agg(F.count("*").alias("n_rows")))
    labels = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("class")).select(F.col("a").alias("node"), "class"))
    for _ in range(rounds):
        known = labels.select(F.col("node").alias("b"), "class").join(degrees, "b")
        near = join_counted(both, known, ["b"]).groupBy("a").agg(F.min("class").alias("near"))
        lower = cut(labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("class").alias("was"), F.least("class", "near").alias("class")))
        sizes = lower.groupBy("class").agg(F.count("*").alias("n_rows"))
        further = lower.select(F.col("node").alias("class"), F.col("class").alias("further")).join(sizes, "class")
        after = cut(join_counted(lower, further, ["class"]).select("node", "was", F.least("class", "further").alias("class")))
        changed = after.where("was <> class").limit(1).count()
        labels = after.select("node", "class")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
