"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from voxsift.operators.joins import not_broadcast
from voxsift.staging import stage

#: Times that a pointer is followed to its target's pointer in one round.
JUMPS = 2
#: Edges that one task joins by itself, some tens of MB: a round over all tasks is a dozen jobs, whose plans, broadcasts
#: and threads stay in the driver, and most rounds have few edges left.
ONE_TASK_EDGES = 200_000


def joined_in_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``id, to``: the smallest id of the component of each end of the edges ``a, b`` of one task."""
    to: dict[int, int] = {}

    def least(at: int) -> int:
        while (up := to.setdefault(at, at)) != at:
            to[at] = at = to[up]
        return at

    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
            a, b = least(a), least(b)
            to[max(a, b)] = min(a, b)
    yield pd.DataFrame({"id": list(to), "to": [least(at) for at in to]}, dtype="int64")


def connected(edges: DataFrame) -> DataFrame:
    """``id, label``: for every end of an edge ``a, b`` the smallest id of its component.

    Each round points every node at its smallest neighbour, follows pointers to pointers, and replaces the nodes by
    what they point at; edges within a node fall away. A round at least halves the nodes of a component, so the
    rounds grow with the logarithm of its size. Minima are taken where the edges are before they are shuffled, and
    each round is written, so lineage stays short. Once few edges are left, one task joins them. Only the number of
    edges left comes to the driver.
    """
    labels, left = None, edges
    while (n := left.count()) > ONE_TASK_EDGES:
        turned = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = stage(turned.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("to")), "pointers")
        for _ in range(JUMPS):
            to = to.join(not_broadcast(to.select(F.col("id").alias("to"), F.col("to").alias("next"))), "to", "left").select("id", F.coalesce("next", "to").alias("to"))
        to = stage(to, "pointers")
        if labels is None:
            labels = to.select("id", F.col("to").alias("label"))
        else:
            labels = stage(relabelled(labels, to.select("id", F.col("to").alias("new"))), "labels")
        moved = not_broadcast(to.select(F.col("id").alias("a"), F.col("to").alias("x")))
        ends = left.join(moved, "a").join(moved.select(F.col("a").alias("b"), F.col("x").alias("y")), "b")
        left = stage(ends.where("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "left")
    if labels is not None and not n:
        return labels
    last = stage(left.select("a", "b").repartition(1).mapInPandas(joined_in_task, "id long, to long"), "pointers")
    if labels is None:
        return last.select("id", F.col("to").alias("label"))
    return stage(relabelled(labels, last.select("id", F.col("to").alias("new"))), "labels")


def relabelled(labels: DataFrame, new: DataFrame) -> DataFrame:
    """``labels`` with each label replaced by its ``id, new``, where it has one."""
    return labels.join(not_broadcast(new.select(F.col("id").alias("label"), "new")), "label", "left").select("id", F.coalesce("new", "label").alias("label"))


def extended(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` of the components after further edges: only components that these join are worked on."""
    known = not_broadcast(labels)
    met = with_labels(with_labels(edges.select("a", "b"), known, "a", "x"), known, "b", "y").where("x != y")
    met = stage(met.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "met")
    if met.isEmpty():
        return labels
    joined = connected(met)
    fresh = joined.join(known, "id", "left_anti").select("id", "label")
    return stage(relabelled(labels, joined.withColumnRenamed("label", "new")).unionByName(fresh), "labels")


def with_labels(rows: DataFrame, labels: DataFrame, key: str = "id", name: str = "label") -> DataFrame:
    """Adds the component of ``key``: the key itself where it has no edge."""
    own = labels.select(F.col("id").alias(key), F.col("label").alias("_label"))
    return rows.join(own, key, "left").withColumn(name, F.coalesce("_label", key)).drop("_label")
