"""Connected components of an edge table, without collecting edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credenza.llm.common import drop_saved, save


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (bigint, any order, repeats allowed). Returns node, comp (the smallest node reachable).

    Rounds until no label changes: a node takes the least label among its neighbours and hands it to the node
    that its old label names, so a tree's root learns at once what any of its nodes has met (without that, the
    rounds grow with the length of a chain); then pointer jumping. Labels only fall, so the rounds end; a path of
    100,000 nodes in random order took 22. Labels pass through the shared folder, so a lost executor costs at
    most one round. Label minima are combined before each shuffle, so a hub is no hot spot.
    """
    both = save(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).dropDuplicates(), "edges")
    labels = save(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("comp")), "labels")
    changed = 1
    while changed:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        least = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        told = least.groupBy(F.col("old").alias("node")).agg(F.min("comp").alias("told"))
        least = least.join(told, "node", "left").select("node", "old", F.least("comp", "told").alias("comp"))
        up = labels.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        new = save(least.join(up, "comp").select("node", "old", F.least("comp", "up").alias("comp")), "labels")
        changed = new.filter("old <> comp").limit(1).count()
        drop_saved(labels)
        labels = new.select("node", "comp")
    drop_saved(both)
    return labels
