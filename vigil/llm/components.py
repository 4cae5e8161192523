"""Connected components of a graph held in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import stored
from vigil.plans.sizing import DEFAULT_MAX_BROADCAST_ROWS, is_small


def connected(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (a, b: long): root is the component's smallest vertex.

    Every round takes the least label among a vertex's neighbours and then the
    label of that label, so labels travel twice as far each time; it ends when
    no label changes.  A round's table is stored in the shared folder; only the
    count of changes reaches the driver.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                  .where("a <> b").distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("root")),
                    "labels")
    # the number of labels never changes: few are broadcast in every round, else they are shuffled
    side = F.broadcast if is_small(labels, DEFAULT_MAX_BROADCAST_ROWS) else (lambda df: df)
    while True:
        told = both.join(side(labels), both["b"] == labels["v"]).select(
            F.col("a").alias("v"), "root", F.lit(None).cast("long").alias("own"))
        own = labels.select("v", "root", F.col("root").alias("own"))
        step = told.unionByName(own).groupBy("v").agg(F.min("root").alias("root"), F.max("own").alias("old"))
        ahead = labels.select(F.col("v").alias("__v"), F.col("root").alias("__next"))
        step = step.join(side(ahead), step["root"] == F.col("__v"), "left") \
            .select("v", "old", F.least("root", F.coalesce("__next", "root")).alias("root"))
        step = stored(step, "labels")
        if not step.where("old <> root").limit(1).count():
            return step.select("v", "root")
        labels = step.select("v", "root")
