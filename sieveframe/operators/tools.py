"""Bounded views of a code graph for a model that asks for them."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import CodeGraph

LIMIT, DEFAULT_DEPTH, MOST_DEPTH = 25, 2, 5


def bounded(nodes: DataFrame, limit: int = LIMIT) -> dict:
    """The first ``limit`` nodes by id, the true total and whether it is larger: a cut list must say so."""
    total = nodes.count()
    rows = nodes.select("node_id", "name", "file", "line", "code").orderBy("node_id").limit(limit).collect()
    return {"results": [r.asDict() for r in rows], "total": total, "truncated": total > len(rows)}


class GraphTools:
    """UDF4: the four tools by name, with JSON arguments; answers are kept, errors aren't."""

    def __init__(self, graph: CodeGraph):
        self.graph, self.kept = graph, {}
        self.tools: dict[str, Callable[[dict], DataFrame]] = {
            "get_callers": lambda a: graph.callers(a.get("function_id", "")),
            "get_callees": lambda a: graph.callees(a.get("function_id", "")),
            "get_neighbours_at_depth": lambda a: graph.neighbours(a.get("function_id", ""), self.depth(a.get("depth", 0))),
            "query_nodes_by_file": lambda a: graph.by_file(a.get("file", ""), a.get("node_type", "")),
        }

    @staticmethod
    def depth(asked: int) -> int:
        return DEFAULT_DEPTH if asked <= 0 else min(asked, MOST_DEPTH)

    def call(self, name: str, arguments: str) -> str:
        if (name, arguments) not in self.kept:
            try:
                if name not in self.tools:
                    raise ValueError(f"unknown tool {name!r}")
                self.kept[name, arguments] = json.dumps(bounded(self.tools[name](json.loads(arguments))), sort_keys=True)
            except ValueError as e:
                return json.dumps({"error": str(e)})
        return self.kept[name, arguments]


def first_nodes(edges: DataFrame, nodes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """O06 for many nodes at once: of each node's callers the first ``limit`` ids, the true total and ``truncated``.

    Per key a bounded array: partial lists are cut on the map side, a hub's callers are never all in one row.
    """
    calls = edges.join(nodes.select(F.col("node_id").alias("from_id")), "from_id", "left_semi").select("to_id", "from_id").distinct()
    part = F.pmod(F.xxhash64("from_id"), F.lit(64))
    some = calls.groupBy("to_id", part.alias("part")).agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list("from_id")), 1, limit).alias("ids"))
    out = some.groupBy("to_id").agg(F.sum("n").alias("total"), F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, limit).alias("results"))
    return out.withColumn("truncated", F.col("total") > F.size("results"))
