"""Parent-child links as full hierarchies: roots, depths, paths, descendants and loops.

Roots come from weighted disjoint-set forests. The links are range-partitioned
by child, so that partitions are of equal size however large one source is and
ids with a common prefix, which tend to be of one tree, lie together. Each
partition joins its own links into a forest with path compression, keeping the
offset (number of links) to each local root. Only local roots that have a
parent in another partition are left to be merged: their links double in reach
each round, so partitions merge like a tournament, in a number of rounds that
is the logarithm of the number of partition crossings. Loops need no bound on
the rounds: depths have no gaps, so once a round resolves no further node, the
rest is on or below a loop.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskiln.session import durable

#: Links of a local forest: what one task holds.
LINKS_PER_FOREST = 250_000
#: Roots that are broadcast, by their counted number; more are joined by salted keys.
BROADCAST_ROOTS = 200_000
SALTS = 32


def parent_links(df: DataFrame, node: str = "section_id", parent: str = "parent_id") -> DataFrame:
    """child, parent: one link for each node with a parent among the nodes.

    A node's parent is the least non-null parent of its rows that is itself a
    node; null nodes are left out. A node may be its own parent (a loop).
    """
    nodes = df.where(F.col(node).isNotNull()).select(F.col(node).alias("parent")).distinct()
    named = (
        df.where(F.col(node).isNotNull() & F.col(parent).isNotNull())
        .select(F.col(node).alias("child"), F.col(parent).alias("parent"))
        .distinct()
    )
    return named.join(nodes, "parent", "left_semi").groupBy("child").agg(F.min("parent").alias("parent"))


class WeightedForest:
    """A disjoint-set forest over parent links, with each node's offset to its root."""

    def __init__(self, links: dict[str, str]):
        self.up: dict[str, tuple[str, int]] = {c: (p, 1) for c, p in links.items()}
        self.done: dict[str, tuple[str | None, int]] = {}

    def find(self, node: str) -> tuple[str | None, int]:
        """(root, offset); (None, -1) on or below a loop."""
        trail, seen, at = [], set(), node
        while at in self.up and at not in self.done and at not in seen:
            seen.add(at)
            trail.append(at)
            at = self.up[at][0]
        if at in seen:
            root, offset = None, -1
        else:
            root, offset = self.done.get(at, (at, 0))
        for n in reversed(trail):
            offset = offset + self.up[n][1] if root is not None else -1
            self.done[n] = (root, offset)
        return self.done.get(node, (node, 0))


def _local_forest(batches):
    links: dict[str, str] = {}
    for batch in batches:
        links.update(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
    forest = WeightedForest(links)
    nodes = list(links)
    for i in range(0, len(nodes), 50_000):
        part = nodes[i : i + 50_000]
        found = [forest.find(n) for n in part]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.string()), pa.array([r for r, _ in found], pa.string()), pa.array([o for _, o in found], pa.int64())],
            names=["node", "root", "depth"],
        )


def _ends_joined(local: DataFrame, ends: DataFrame, count: int, most: int) -> DataFrame:
    """local with the merged end of each local root. All nodes of a giant tree may name one root, so a root is no key by itself: few ends are broadcast, more are copied to every salt."""
    if count <= most:
        return local.join(F.broadcast(ends), "root", "left")
    salted = ends.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return local.withColumn("_salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(salted, ["root", "_salt"], "left").drop("_salt")


def roots(links: DataFrame, partitions: int | None = None, broadcast_roots: int = BROADCAST_ROOTS) -> DataFrame:
    """node, root, depth for each child of links(child, parent), at most one row per child; root null and depth -1 on or below a loop.

    `partitions` sets the number of local forests; by default it follows from
    the counted links, LINKS_PER_FOREST each.
    """
    count = partitions or max(1, -(-links.count() // LINKS_PER_FOREST))
    local = durable(
        links.select("child", "parent").repartitionByRange(count, "child").mapInArrow(_local_forest, "node string, root string, depth long")
    )
    crossings = local.select(F.col("root").alias("node")).where("node is not null").distinct().join(local, "node", "left_semi")
    merged = durable(crossings.join(local, "node").select("node", "root", "depth", F.lit(False).alias("done")))
    left = merged.count()
    while left:
        target = merged.select(F.col("node").alias("root"), F.col("root").alias("_root"), F.col("depth").alias("_depth"), F.lit(True).alias("_inner"))
        looped = F.col("root").isNull() | (F.col("_inner").isNotNull() & F.col("_root").isNull())
        merged = durable(
            merged.join(target, "root", "left").select(
                "node",
                F.when(~looped, F.coalesce("_root", "root")).alias("root"),
                F.when(looped, F.lit(-1)).otherwise(F.col("depth") + F.coalesce("_depth", F.lit(0))).cast("long").alias("depth"),
                (looped | F.col("_inner").isNull()).alias("done"),
            )
        )
        now = merged.where("not done").count()
        if now == left:
            break
        left = now
    ends = merged.select(
        F.col("node").alias("root"),
        F.when(F.col("done"), F.col("root")).alias("_root"),
        F.when(F.col("done"), F.col("depth")).otherwise(F.lit(-1)).alias("_depth"),
        F.lit(True).alias("_inner"),
    )
    looped = F.col("root").isNull() | (F.col("_inner").isNotNull() & F.col("_root").isNull())
    return _ends_joined(local, ends, merged.count(), broadcast_roots).select(
        "node",
        F.when(~looped, F.coalesce("_root", "root")).alias("root"),
        F.when(looped, F.lit(-1)).otherwise(F.col("depth") + F.coalesce("_depth", F.lit(0))).cast("long").alias("depth"),
    )


def ancestor_chains(links: DataFrame, resolved: DataFrame) -> DataFrame:
    """node, chain: the ids from the root down to the node, for each node outside loops.

    Each round joins a node's chain with that of the chain's top, looked up in
    the index of chains by node, so the known length doubles: the rounds are
    the logarithm of the greatest depth. The result holds one id per node and
    level, which is the size of what is asked for.
    """
    good = resolved.where("root is not null")
    deepest = good.agg(F.max("depth")).first()[0] or 0
    known = links.join(good.select(F.col("node").alias("child")), "child", "left_semi")
    chains = durable(known.select(F.col("child").alias("node"), F.col("parent").alias("top"), F.array("parent").alias("above")))
    reach = 1
    while reach < deepest:
        index = chains.select(F.col("node").alias("top"), F.col("top").alias("_top"), F.col("above").alias("_above"))
        chains = durable(
            chains.join(index, "top", "left").select(
                "node", F.coalesce("_top", "top").alias("top"), F.concat(F.coalesce("_above", F.array().cast("array<string>")), F.col("above")).alias("above")
            )
        )
        reach *= 2
    return chains.select("node", F.concat("above", F.array("node")).alias("chain"))


def descendants(chains: DataFrame) -> DataFrame:
    """node, descendant, distance: every node below each node, from chains."""
    steps = F.size("chain") - 1
    return chains.select(F.posexplode(F.slice("chain", 1, steps)).alias("_level", "node"), F.col("node").alias("descendant"), steps.alias("_steps")).select(
        "node", "descendant", (F.col("_steps") - F.col("_level")).alias("distance")
    )
