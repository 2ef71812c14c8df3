"""Connected components of link tables, as Spark joins and aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.tables import settled

_BATCHES = 64  # how many Arrow batches a task joins up at a time


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node that it is linked with) for the nodes of these links that aren't the least themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        new = new[label]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links that a task sees, reduced to one link for each node; in bounded portions."""

    def reduced(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        a, b = forest(rows.column("a").to_numpy(), rows.column("b").to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if len(held) == _BATCHES:
            yield reduced(held)
            held = []
    if held:
        yield reduced(held)


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes of links (a, b), both long; a component is named by its least node.

    Alternates large and small stars: every node's greater (then lesser) neighbours move to its least neighbour, until
    each node is linked with the least of its component only. The number of rounds grows with the logarithm of the size;
    each ends in a written table. Only the fact that nothing changed reaches the driver.
    """
    links = settled(links.where("a <> b").mapInArrow(_contracted, "a long, b long"))
    while True:
        both = _pairs(links, ("a", "b"), ("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a")
        large = _pairs(large, ("b", "m")).where("a <> b").repartition("a").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = settled(_pairs(large.join(lower, "a"), ("b", "m"), ("a", "m")).where("a <> b").distinct())
        # done when each node has one link and no node linked to is itself linked further
        ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"))))
        ways = small.select(ends.alias("e")).groupBy("e.node").agg(F.sum("e.up").alias("up"), F.min("e.up").alias("least"))
        if not ways.where("up > 1 or up = 1 and least = 0").count():
            break
        links = small
    named = _pairs(small, ("a", "b"), ("b", "b")).distinct()
    return named.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _pairs(rows: DataFrame, *columns: tuple[str, str]) -> DataFrame:
    """Rows (a, b) of each of these pairs of columns."""
    pairs = F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in columns])
    return rows.select(F.explode(pairs).alias("p")).select("p.a", "p.b")
