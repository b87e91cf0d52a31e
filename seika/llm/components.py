"""Connected components of a link table, by joins.

Labels start at each node itself. A round gives every node and its present root the least label found among
its neighbours, then follows labels one step (pointer jumping), so long chains shrink by powers.
Each round is written to the shared folder; the loop ends when nothing changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seika.session import stage


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b); component: its smallest node."""
    both = stage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    label = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                  .select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = (both.join(label.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node"))
                .agg(F.min("label").alias("m")))
        step = label.join(near, "node").select("node", "label", F.least("label", "m").alias("m"))
        # The root of each node gets the node's new label as well.
        hooked = (step.select("node", "m").unionByName(step.where("m < label").select(F.col("label").alias("node"), "m"))
                  .groupBy("node").agg(F.min("m").alias("new")))
        jump = hooked.join(hooked.select(F.col("node").alias("new"), F.col("new").alias("far")), "new", "left")
        after = stage(jump.select("node", F.least("new", F.coalesce("far", "new")).alias("label")), "labels")
        changed = after.join(label.select("node", F.col("label").alias("old")), "node").where("label <> old").limit(1).count()
        label = after
        if not changed:
            return label.select("node", F.col("label").alias("component"))
