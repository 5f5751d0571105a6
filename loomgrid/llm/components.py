"""Connected components of a link table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, rows_of, settle, skewed_join


def components(links: DataFrame) -> DataFrame:
    """For links (a, b) of bigint nodes: node, component (the smallest node reachable), in a settled table.

    Each round takes the smallest label of a node and its neighbours, then the label of that label.
    Labels are combined by map tasks before they are shuffled; joins deal the links of a node with
    many links, and the members of a large component, over several tasks. Rounds grow with the
    logarithm of the longest shortest path; every round cuts the lineage and drops the one before."""
    both = settle(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = settle(both.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n"), F.min("b").alias("low")).select("node", "n", F.least("node", "low").alias("component")), "labels")
    degree, done = label, False
    while not done:
        ends = label.select(F.col("node").alias("a"), "component")
        near = skewed_join(both, ends, ["a"], degree.select(F.col("node").alias("a"), "n"), rows_of(label)).groupBy(F.col("b").alias("node")).agg(F.min("component").alias("low"))
        step = settle(label.select("node", "component").join(near, "node", "left").select("node", F.least("component", "low").alias("low"), F.col("component").alias("old")), "steps")
        up = step.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        new = skewed_join(step, up, ["low"], step.groupBy("low").agg(F.count("*").alias("n")), rows_of(step), "left")
        new = new.select("node", F.least("low", "lower").alias("component"), "old")
        changed = F.when(F.col("component") < F.col("old"), 1).otherwise(0)
        new = settle(new.select("node", "component", changed.alias("n")), "labels")
        done = not new._facts["total"]
        release(step, *([label] if label is not degree else []))
        label = new
    release(both, degree)
    return label
