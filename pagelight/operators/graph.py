"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written


def components(edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, node, root) of undirected edges (by, a, b) inside each value of `by`: root is the smallest node.

    Every node takes the least root among its own and its neighbours', then its root's root, until no root changes;
    hops double, so a chain of n nodes takes about log n rounds. A round is written to the shared folder; only
    a count comes to the driver. Nodes without edges aren't returned."""
    both = edges.select(*by, "a", "b").where("a <> b")
    both = written(both.unionByName(both.select(*by, F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    roots = written(both.groupBy(*by, F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")), "roots")
    while True:
        near = both.join(roots.withColumnsRenamed({"node": "b", "root": "r"}), [*by, "b"]).groupBy(*by, F.col("a").alias("node")).agg(F.min("r").alias("r"))
        least = roots.join(near, [*by, "node"]).select(*by, "node", "root", F.least("root", "r").alias("low"))
        # the root of a component learns of a lower one from any of its members
        told = least.groupBy(*by, F.col("root").alias("node")).agg(F.min("low").alias("told"))
        heard = least.join(told, [*by, "node"], "left").select(*by, "node", "root", F.least("low", F.coalesce("told", "low")).alias("low"))
        jump = heard.select(*by, F.col("node").alias("low"), F.col("low").alias("far"))
        new = heard.join(jump, [*by, "low"], "left").select(*by, "node", F.col("root").alias("was"), F.least("low", F.coalesce("far", "low")).alias("root"))
        new = written(new, "roots")
        roots = new.drop("was")
        if not new.where("was <> root").limit(1).count():
            return roots
