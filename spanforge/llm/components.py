"""Connected components of a graph kept in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.storage import drop, if_small, materialise


def connect(nodes: DataFrame, edges: DataFrame, name: str = "components", most: int = 60) -> DataFrame:
    """nodes (id, label) with each label lowered to the smallest in the node's component. edges: (a, b), ids of nodes.

    label is a struct whose field `id` names a node of the component. In each round a node
    takes the smallest label among its own and its neighbours', then its label's label,
    so long chains close in a number of rounds that grows with their logarithm. Every round is
    written to the shared folder; only a count comes to the driver.
    """
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), name)
    now, last = nodes.select("id", "label"), None
    for _ in range(most):
        near = both.join(if_small(now, of=nodes if last is None else last), both["b"] == now["id"]).groupBy("a").agg(F.min("label").alias("other"))
        low = now.join(near, now["id"] == near["a"], "left").select("id", F.col("label").alias("was"), F.least("label", "other").alias("label"))
        low = materialise(low, name)
        to = low.select(F.col("id").alias("__id"), F.col("label").alias("next"))
        jumped = low.join(if_small(to, of=low), low["label"]["id"] == to["__id"], "left").select("id", "was", F.least("label", "next").alias("label"))
        jumped = materialise(jumped, name, moved=F.col("label") != F.col("was"))
        drop(low, *([last] if last is not None else []))
        now, last = jumped.select("id", "label"), jumped
        if not jumped.seen["moved"]:
            drop(both)
            now.stored_at, now.seen = jumped.stored_at, jumped.seen
            return now
    raise RuntimeError(f"components did not close in {most} rounds")
