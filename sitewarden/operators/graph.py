"""The navigation graph: breadth-first depths with deterministic parents, inbound links, connected components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitewarden.functions import urls as U
from sitewarden.operators.evidence import Evidence
from sitewarden.sources.tables import checkpoint


def navigation_edges(ev: Evidence) -> DataFrame:
    """(src, dst): distinct links between pages of the site, from anchors of complete pages; no loops on a page."""
    rows = ev.of_complete("links").where("element = 'a' and host_owner = 'same_host' and destination is not null")
    return rows.select(F.col("page_key").alias("src"), F.col("key").alias("dst")).where("src <> dst and dst <> ''").distinct()


def homepage(ev: Evidence) -> str | None:
    """The least address among the URL records of depth 0."""
    found = ev.urls.where("click_depth = 0").select(U.identity_of(F.coalesce("identity", "original")).alias("k")).agg(F.min("k")).first()
    return found[0] if found else None


def bfs(edges: DataFrame, root: str, max_depth: int = 10_000) -> DataFrame:
    """(node, depth, parent, rank) of the nodes reached from root; RuntimeError if some are deeper than max_depth.

    Nodes are visited in the order of a queue whose children are sorted: a node's parent is the neighbour that was
    visited first, its rank within its depth follows (parent's rank, node). Each level is a join of the frontier with
    the edges and an anti-join with what was seen; levels are checkpointed, and runs of as many levels are merged, so
    that a node is written again as often as the depth can be halved. Only the ranks of one level are put in order, by
    range partitions and not in one task."""
    spark = edges.sparkSession
    edges = checkpoint(edges)
    frontier = spark.createDataFrame([(root, 0, None, 0)], "node string, depth int, parent string, rank long")
    seen = [(1, frontier)]
    for depth in range(1, max_depth + 1):
        reached = edges.join(frontier.select(F.col("node").alias("src"), F.col("rank").alias("_r")), "src").join(_all(seen).select(F.col("node").alias("dst")), "dst", "left_anti")
        first = reached.groupBy("dst").agg(F.min(F.struct("_r", "src")).alias("p"))
        frontier = checkpoint(_ranked(first, depth))
        if frontier.isEmpty():
            return _all(seen)
        seen.append((1, frontier))
        while len(seen) > 1 and seen[-1][0] == seen[-2][0]:
            (n, last), (_, before) = seen.pop(), seen.pop()
            seen.append((2 * n, checkpoint(before.unionByName(last))))
    raise RuntimeError(f"there are nodes deeper than {max_depth}")


def _all(levels: list[tuple[int, DataFrame]]) -> DataFrame:
    return reduce(DataFrame.unionByName, (level for _, level in levels))


def _ranked(first: DataFrame, depth: int) -> DataFrame:
    """The level's nodes with dense ranks by (parent's rank, node)."""
    placed = first.select("dst", F.col("p.src").alias("parent"), F.col("p._r").alias("_r")).repartitionByRange("_r", "dst").sortWithinPartitions("_r", "dst")
    placed = checkpoint(placed.withColumn("_id", F.monotonically_increasing_id()))
    counts = placed.groupBy(F.shiftright("_id", 33).alias("_part")).agg(F.count("*").alias("_n"))
    starts = counts.withColumn("_start", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = placed.withColumn("_part", F.shiftright("_id", 33)).join(F.broadcast(starts), "_part")
    return ranked.select(F.col("dst").alias("node"), F.lit(depth).alias("depth"), "parent", (F.coalesce("_start", F.lit(0)) + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).alias("rank"))


def paths(tree: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, path array) from the root for the given nodes (node, depth).

    A row for each place of a path climbs to its ancestor by jumps of 1, 2, 4, ... parents, so that a path of any
    length takes as many rounds as its length can be halved."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    jump = tree.where("parent is not null").select(F.col("node").alias("_from"), F.col("parent").alias("_to"))
    rows = nodes.select("node", F.explode(F.sequence(F.lit(0), "depth")).alias("_up")).withColumn("_at", F.col("node"))
    for bit in range(deepest.bit_length()):
        if bit:
            again = jump.select(F.col("_from").alias("_to"), F.col("_to").alias("_next"))
            jump = checkpoint(jump.join(again, "_to").select("_from", F.col("_next").alias("_to")))
        climbs = F.shiftright("_up", bit).bitwiseAND(F.lit(1)) == 1
        rows = rows.join(jump, climbs & (F.col("_at") == F.col("_from")), "left").select("node", "_up", F.coalesce("_to", "_at").alias("_at"))
    steps = F.sort_array(F.collect_list(F.struct((-F.col("_up")).alias("i"), "_at")))
    return rows.groupBy("node").agg(F.transform(steps, lambda s: s["_at"]).alias("path"))


def inbound(edges: DataFrame) -> DataFrame:
    """(node, n, referrer): the number of distinct sources of a node, and the least of them."""
    return edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"), F.min("src").alias("referrer"))


def components(pairs: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of the graph of pairs (a, b), root the least node; alternating large and small stars."""
    edges = checkpoint(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    for _ in range(max_rounds):
        both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")
        large = both.where("v > u").join(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "u").where("v <> m").select(F.col("v").alias("x"), F.col("m").alias("y")).distinct()
        small = large.join(large.groupBy("x").agg(F.min("y").alias("m")), "x").select(F.explode(F.array(F.struct(F.col("x").alias("u"), "m"), F.struct(F.col("y").alias("u"), "m"))).alias("e"))
        edges = checkpoint(small.select(F.greatest("e.u", "e.m").alias("a"), F.least("e.u", "e.m").alias("b")).where("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("root")), F.struct(F.col("b").alias("node"), F.col("b").alias("root")))).alias("e")).select("e.*").distinct()
