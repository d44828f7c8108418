"""Connected components of a graph that stays in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stacklight.llm.common import kept, let_go


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """v, component: every vertex of edges (a, b) with the smallest vertex that it reaches.

    Each round a vertex takes the smallest label among its own and its neighbours' and then
    its label's label, so chains halve; it ends when a round changes nothing. Rounds are
    written to the shared folder, each in place of the one before. Labels of a vertex with very many edges are aggregated on
    the map side; joins on it may be split by adaptive execution.
    """
    both = kept(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = kept(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("v"), "label"))
    last = labels
    for _ in range(most_rounds):
        near = both.join(labels, both["b"] == labels["v"]).groupBy("a").agg(F.min("label").alias("near"))
        better = labels.join(near, labels["v"] == near["a"], "left").select("v", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = better.select(F.col("v").alias("label"), F.col("label").alias("top"))
        jumped = kept(better.join(up, "label", "left").select("v", "was", F.coalesce(F.least("label", "top"), "label").alias("label")))
        let_go(last)
        last, labels = jumped, jumped.select("v", "label")
        if jumped.where("was <> label").limit(1).count() == 0:
            let_go(both)
            return labels.select("v", F.col("label").alias("component"))
    raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
