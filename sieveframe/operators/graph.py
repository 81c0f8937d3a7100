"""Call graphs as node and edge DataFrames: filters, neighbours, closures and hop distances.

Searches advance a frontier by joins and keep what they have seen in the shared checkpoint folder; only counts reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut

MAX_DEPTH = 6
LIST = 1024


def reversed_edges(edges: DataFrame) -> DataFrame:
    """G02."""
    return edges.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))


def adjacency_lists(edges: DataFrame, key: str = "from_id", other: str = "to_id") -> DataFrame:
    """(key, others), cut off from its plan: what searches join at every hop. Lists hold at most ``LIST`` ends, so that a hop reads and moves
    a row for each node, not one for each edge, and no row grows with a node's edges."""
    return _lists(edges.select(key, other).distinct(), key, other)


def reversed_lists(lists: DataFrame) -> DataFrame:
    """`adjacency_lists` of the same edges backward."""
    return _lists(lists.select(F.explode("others").alias("from_id"), F.col("from_id").alias("to_id")), "from_id", "to_id")


def _lists(rows: DataFrame, key: str, other: str) -> DataFrame:
    at = F.row_number().over(Window.partitionBy(key).orderBy(key))
    return cut(rows.withColumn("list", F.floor((at - 1) / LIST)).groupBy(key, "list").agg(F.collect_list(other).alias("others")).select(key, "others"))


def _steps(edges: DataFrame) -> DataFrame:
    return edges if "others" in edges.columns else adjacency_lists(edges)


def depths(edges: DataFrame, seeds: DataFrame, limit: int | None = None) -> DataFrame:
    """(id, depth), the least number of hops from any seed(id); seeds are at 0. Cycles are harmless. edges:
    from_id and to_id, or their lists."""
    steps = _steps(edges)
    seen = new = cut(seeds.select(F.col("id")).distinct().withColumn("depth", F.lit(0)))
    at = 0
    while limit is None or at < limit:
        front = new.select(F.col("id").alias("from_id"))
        new = steps.join(front, "from_id").select(F.explode("others").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(at + 1))
        new = cut(new)
        if new.isEmpty():
            break
        seen = cut(seen.unionByName(new)) if at % 8 == 7 else seen.unionByName(new)
        at += 1
    return seen


def reachable(edges: DataFrame, seeds: DataFrame, limit: int | None = None) -> DataFrame:
    return depths(edges, seeds, limit).select("id")


def masks(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """seeds(id, mask) → (id, mask): for every node that any seed reaches, the bits of all seeds that reach it. One search for all bits, edges as for
    `depths`. A node is passed on again only with bits that are new to it."""
    steps = _steps(edges)
    seen = front = cut(seeds.groupBy("id").agg(F.bit_or("mask").alias("mask")))
    at = 0
    while True:
        got = steps.join(front.withColumnRenamed("id", "from_id"), "from_id").select(F.explode("others").alias("id"), "mask").groupBy("id").agg(F.bit_or("mask").alias("got"))
        known = seen.groupBy("id").agg(F.bit_or("mask").alias("known"))
        new = F.col("got").bitwiseAND(F.bitwise_not(F.coalesce("known", F.lit(0))))
        front = cut(got.join(known, "id", "left").select("id", new.alias("mask")).where("mask != 0"))
        if front.isEmpty():
            return seen.groupBy("id").agg(F.bit_or("mask").alias("mask"))
        seen, at = seen.unionByName(front), at + 1
        if at % 8 == 0:
            seen = cut(seen.groupBy("id").agg(F.bit_or("mask").alias("mask")))


@dataclass(frozen=True)
class CodeGraph:
    """nodes(project_id, cpg_version, node_id, node_type, name, file, line, code), edges(project_id, cpg_version, from_id, to_id, edge_type) of one project and version."""

    nodes: DataFrame
    edges: DataFrame

    @staticmethod
    def of(nodes: DataFrame, edges: DataFrame, project: str, version: str) -> CodeGraph:
        mine = (F.col("project_id") == project) & (F.col("cpg_version") == version)
        return CodeGraph(nodes.where(mine), edges.where(mine))

    def by_type(self, node_type: str) -> DataFrame:
        """F01."""
        return self.nodes.where(F.col("node_type") == node_type)

    def by_file(self, file: str, node_type: str = "METHOD") -> DataFrame:
        """F02."""
        return self.nodes.where((F.col("file") == file) & (F.col("node_type") == node_type))

    def calls(self) -> DataFrame:
        """F03."""
        return self.edges.where(F.col("edge_type") == "CALL")

    def edges_of(self, from_id: str = "", to_id: str = "") -> DataFrame:
        """F04."""
        if not from_id and not to_id:
            raise ValueError("edges_of needs an end")
        conditions: list[Column] = [F.col(c) == v for c, v in (("from_id", from_id), ("to_id", to_id)) if v]
        out = self.edges
        for c in conditions:
            out = out.where(c)
        return out

    def callers(self, node_id: str) -> DataFrame:
        """J01; ids made up for outside code (starting with -) have none."""
        ids = self.calls().where((F.col("to_id") == node_id) & ~F.lit(node_id).startswith("-")).select(F.col("from_id").alias("node_id"))
        return self.nodes.join(ids, "node_id", "left_semi").orderBy("node_id")

    def callees(self, node_id: str) -> DataFrame:
        """J02."""
        ids = self.calls().where((F.col("from_id") == node_id) & ~F.lit(node_id).startswith("-")).select(F.col("to_id").alias("node_id"))
        return self.nodes.join(ids, "node_id", "left_semi").orderBy("node_id")

    def adjacency(self) -> DataFrame:
        """A23, for display."""
        return self.calls().groupBy("from_id").agg(F.count_distinct("to_id").alias("n_callees"), F.array_sort(F.collect_set("to_id")).alias("callees"))

    def hubs(self, least: int = 50) -> DataFrame:
        """A24, G12."""
        return self.calls().groupBy("to_id").agg(F.count_distinct("from_id").alias("n_callers")).where(F.col("n_callers") >= least)

    def neighbours(self, root: str, depth: int) -> DataFrame:
        """Nodes within depth hops of root in either direction, without root."""
        if not root:
            raise ValueError("root is empty")
        if depth > MAX_DEPTH:
            raise ValueError(f"depth is over {MAX_DEPTH}")
        calls = self.calls().select("from_id", "to_id")
        near = depths(calls.unionByName(reversed_edges(calls)), self.nodes.sparkSession.createDataFrame([(root,)], "id string"), max(depth, 0)).where("depth > 0")
        return self.nodes.join(near.withColumnRenamed("id", "node_id"), "node_id").orderBy("node_id")

    def expand(self, changed: DataFrame) -> DataFrame:
        """Files changed(file), and those of direct callers and callees of their methods."""
        methods = self.nodes.where("node_type = 'METHOD'").select("node_id", "file")
        own = methods.join(changed.select("file").distinct(), "file", "left_semi").select(F.col("node_id").alias("id"))
        calls = self.calls().select("from_id", "to_id")
        both = calls.unionByName(reversed_edges(calls))
        near = both.join(own, both.from_id == own.id, "left_semi").select(F.col("to_id").alias("node_id")).distinct()
        return changed.select("file").unionByName(methods.join(near, "node_id", "left_semi").select("file")).distinct()

    def page(self, node_type: str, drop: int, take: int) -> DataFrame:
        """O08."""
        return self.by_type(node_type).orderBy("node_id").offset(drop).limit(take)

    def after(self, node_type: str, last: str, take: int) -> DataFrame:
        """A page by key: the next nodes after an id; nothing before it is sorted again."""
        return self.by_type(node_type).where(F.col("node_id") > last).orderBy("node_id").limit(take)

    def pages(self, node_type: str, take: int = 500) -> Iterator[list]:
        """SRC16: pages of rows until one is empty, for a reader outside of Spark."""
        last = ""
        while rows := self.after(node_type, last, take).collect():
            yield rows
            last = rows[-1]["node_id"]


def nearest_marks(callers: DataFrame, marks: DataFrame, hops: int) -> DataFrame:
    """(id, depth, low, high) of every node with a mark(id) at most ``hops`` up the callers(node_id, caller_id): the distance of the nearest ones, and the
    least and the greatest of these.

    One search for all nodes, from the marks down: the nearest marks of a node are those of its callers that are nearest themselves. Each node
    joins the frontier once, so that no pair of a node and what it meets is kept.
    """
    up = adjacency_lists(callers, "caller_id", "node_id")
    seen = front = cut(marks.select("id").dropna().distinct().select("id", F.lit(0).alias("depth"), F.col("id").alias("low"), F.col("id").alias("high")))
    for at in range(1, hops + 1):
        got = up.join(front.select(F.col("id").alias("caller_id"), "low", "high"), "caller_id").select(F.explode("others").alias("id"), "low", "high").groupBy("id").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        front = cut(got.join(seen.select("id"), "id", "left_anti").select("id", F.lit(at).alias("depth"), "low", "high"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def nearest_surface(sources: DataFrame, callers: DataFrame, surfaces: DataFrame, levels: int = 6, give_up: int = 2) -> DataFrame:
    """(source_id, surface_id) for sources with exactly one surface at the least distance up the callers.

    sources(source_id), callers(node_id, caller_id), surfaces(surface_id). Depth 0 is the source's own node. A source's search ends where
    it has met a surface; the whole search for a source stops after ``give_up`` + 1 caller levels without any.
    """
    near = nearest_marks(callers, surfaces.select(F.col("surface_id").alias("id")), min(levels, give_up + 1))
    one = near.where("low = high").select(F.col("id").alias("source_id"), F.col("low").alias("surface_id"))
    return sources.select("source_id").distinct().join(one, "source_id")


def first_route(methods: DataFrame, callers: DataFrame, routes: DataFrame, hops: int = 5) -> DataFrame:
    """(node_id, route_node, depth): the nearest node up the callers with a route, least id of equals."""
    near = nearest_marks(callers, routes.select(F.col("node_id").alias("id")), hops)
    return methods.select("node_id").distinct().join(near.select(F.col("id").alias("node_id"), F.col("low").alias("route_node"), "depth"), "node_id")


def taint_paths(flows: DataFrame, sources: DataFrame, sinks: DataFrame, limit: int = 1000, hops: int = 12) -> DataFrame:
    """G13 over a supplied data-flow edge table (an approximation of an outside engine): simple paths from sources(id) to sinks(id),
    shortest first, at most ``limit`` (O06)."""
    steps = cut(flows.select("from_id", "to_id").distinct())
    paths = sources.select(F.col("id").alias("source_id"), F.col("id").alias("at"), F.array("id").alias("path"))
    out = None
    for _ in range(hops):
        paths = cut(paths.join(steps, paths.at == steps.from_id).where(~F.array_contains("path", F.col("to_id"))).select("source_id", F.col("to_id").alias("at"), F.concat("path", F.array("to_id")).alias("path")))
        if paths.isEmpty():
            break
        hit = paths.join(sinks.select(F.col("id").alias("at")).distinct(), "at", "left_semi")
        out = hit if out is None else out.unionByName(hit)
        paths = paths.join(sinks.select(F.col("id").alias("at")).distinct(), "at", "left_anti")
    if out is None:
        out = paths
    return out.select("source_id", F.col("at").alias("sink_id"), "path", F.size("path").alias("hops")).orderBy("hops", "source_id", "sink_id", F.array_join("path", "/")).limit(limit)


def is_phantom(source_name: Column, names: Column, source_internal: tuple[str, ...], step_internal: tuple[str, ...]) -> Column:
    """paths that only run through internals. names: array of the intermediate names."""
    inside = lambda n: F.size(F.filter(F.slice(names, 1, n), lambda x: x.isin(*step_internal)))
    first = F.coalesce(F.get(names, F.lit(0)).isin(*step_internal), F.lit(False))
    return (source_name.isin(*source_internal) & (inside(5) >= 3)) | (inside(8) >= 4) | ((F.size(names) > 500) & first)
