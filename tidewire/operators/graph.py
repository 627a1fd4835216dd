"""Connected components over an edge table, without gathering edges anywhere."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.plans.materialize import Stored


def min_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest reachable index of each of ``n`` nodes under the links ``a[i]``-``b[i]``."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the edges of each batch by a star per group of nodes that they join."""
    for batch in batches:
        u, v = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(u):
            continue
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        label = min_labels(at[: len(u)], at[len(u) :], len(nodes))
        keep = label != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(nodes[label[keep]])], ["u", "v"])


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars already: one parent each, and no parent that is a child."""
    n, children = edges.agg(F.count("*"), F.count_distinct("u")).first()
    if n != children:
        return False
    return n == 0 or edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node id reachable.

    Alternates large-star and small-star steps: each step joins a node's
    neighbours to the smallest of them, so a path of n nodes shrinks in O(log n)
    rounds. Minimums are combined before the shuffle and a hub is only ever a key
    of a join that can be split, so a group of any size spreads over tasks. Nulls
    and self-loops join nothing; an empty table gives an empty result.
    """
    e = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).where("u <> v")
    at = Stored(e.mapInArrow(_stars, "u long, v long").distinct(), "cc")
    for _ in range(max_rounds):
        if _settled(at.df):
            break
        both = at.df.unionByName(at.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # stored, so that both sides of the join are dealt anew and a hub's rows can be split over tasks
        low = Stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc-low")
        large = both.join(low.df, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = Stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "cc")
        at.drop(), low.drop()
        at = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = at.df.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return at.df.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
