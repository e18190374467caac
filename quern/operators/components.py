"""Connected components of an edge table, without collecting edges or groups anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.scratch import Scratch


#: Edges that a task contracts at a time.
TASK_EDGES = 200_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a task as stars around the smallest node of each group they form: the same components, shorter paths, fewer edges."""
    parent: dict = {}

    def root(x):
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x] = top
            x = up
        return top

    def flush() -> pa.RecordBatch:
        nodes = [x for x in parent if x != root(x)]
        return pa.record_batch([pa.array(nodes, kind), pa.array([root(x) for x in nodes], kind)], names=["a", "b"])

    seen, kind = 0, None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                low, high = (a, b) if a < b else (b, a)
                parent[high] = low
                parent.setdefault(low, low)
        seen += batch.num_rows
        if seen >= TASK_EDGES:
            yield flush()
            parent.clear()
            seen = 0
    if parent:
        yield flush()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: no node has two smaller neighbours, and none is both end and centre."""
    roles = edges.select(F.col("a").alias("n"), F.lit(1).alias("end"), F.lit(0).alias("centre")).union(edges.select("b", F.lit(0), F.lit(1)))
    sums = roles.groupBy("n").agg(F.sum("end").alias("ends"), F.max("centre").alias("centre"))
    return sums.where("ends > 1 or (ends = 1 and centre = 1)").isEmpty()


def connected_components(edges: DataFrame, left: str, right: str, scratch: Scratch | None = None, max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node reachable over the undirected edges.

    Each task first contracts its own edges; then two star contractions alternate until only stars are left.
    The rounds grow with the logarithm of the longest path. Each step is a minimum per node (combined on the
    map side) and an equi-join that adaptive execution can split where a node is hot. Edges with a null end are
    ignored; a self edge alone still lists its node. No edges: an empty result.
    """
    scratch = scratch or Scratch(edges.sparkSession, "components")
    start = scratch.cut(edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a is not null and b is not null"), "edges")
    kind = start.schema["a"].dataType.simpleString()
    now = scratch.cut(start.where("a <> b").mapInArrow(_contract, f"a {kind}, b {kind}"), "contracted")
    for _ in range(max_rounds):
        if _settled(now):
            break
        now_next = scratch.cut(_small_star(_large_star(now)).mapInArrow(_contract, f"a {kind}, b {kind}"), "star")
        scratch.drop(now)
        now = now_next
    else:
        raise RuntimeError("components did not settle")
    # once settled, every edge leads from a node to its smallest reachable node
    roots = start.where("a = b").select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots).groupBy("node").agg(F.min("component").alias("component"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node are linked with its smallest neighbour."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    low = both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
    return (
        both.join(low, F.col("u") == F.col("n"))
        .where("v > u")
        .select(F.col("v").alias("a"), F.least("u", "m").alias("b"))
        .where("a <> b")
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of a node, and the node, are linked with its smallest neighbour."""
    low = edges.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
    joined = edges.join(low, F.col("a") == F.col("n"))
    return (
        joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
        .union(joined.select("a", "m"))
        .where("a <> b")
    )
