"""Scanners, tools, stores, retries and deadlines: small cases with nulls, failures and repeated rows."""

import json
import time

import pytest
from pyspark.sql import functions as F

from sieveframe import schemas
from sieveframe.functions import calls, lineage
from sieveframe.operators import dedup, graph, reports, scanners, tools
from sieveframe.sources import store


def test_registry(spark):
    files = spark.createDataFrame([("a.go",), ("b.py",)], "path string")
    stack = spark.createDataFrame([(["go"], [])], "languages array<string>, manifests array<string>")
    one = lambda rule: lambda f: f.select(F.lit(rule).alias("rule_id"), "path", F.lit(3).alias("line_start"), F.lit("CWE-1").alias("cwe"), F.lit(0.9).alias("conf"))
    late = F.udf(lambda x: 1 / 0, "string")
    r = scanners.Registry(scanners.Scanner("a", one("a")), scanners.Scanner("java", one("j"), lambda langs, _: "java" in langs), scanners.Scanner("missing", lambda f: f.select("nothing")), scanners.Scanner("late", lambda f: one("x")(f).withColumn("path", late("path"))))
    got = r.run(files, stack).collect()
    assert sorted((g.scanner, g.path, g.line_end, g.matched_code) for g in got) == [("a", "a.go", 3, ""), ("a", "b.py", 3, "")]
    assert scanners.Registry().run(files, stack) is None
    with pytest.raises(ValueError):
        r.add(scanners.Scanner("a", one("a")))


def test_filters(spark):
    f = spark.createDataFrame([(".x.go",), ("d/.hidden",), ("d/a.go",), ("d/a_test.go",), ("a.rs",), (None,)], "path string")
    assert {r.path for r in scanners.scannable(f).collect()} == {"d/a.go", "d/a_test.go", "a.rs"}
    assert {r.path for r in scanners.in_scope(f).collect()} == {".x.go", "d/a.go"}
    s = spark.createDataFrame([(1, " \n" + "x" * 49 + "\t"), (2, "é" * 25), (3, None), (4, "y" * 60)], "id int, code string")
    assert {r.id: r.is_stub for r in scanners.stubs(s).collect()} == {1: True, 2: False, 3: True, 4: False}


def test_models(spark):
    m = spark.createDataFrame([("1", "A", "h"), ("2", "a", "other"), ("3", None, "h"), ("4", "b", "h")], "path string, model_id string, sha256 string")
    r = spark.createDataFrame([("a", "h", 0), ("A", "late", 1)], "model_id string, sha256 string, ord int")
    assert {x.path: x.status for x in scanners.verified_models(m, r).collect()} == {"1": "PASS", "2": "BLOCK", "3": "WARN", "4": "WARN"}


def test_tools(spark):
    nodes = spark.createDataFrame([(f"n{k:02d}", "METHOD", f"f{k}", "a.go", k, "") for k in range(40)], "node_id string, node_type string, name string, file string, line int, code string")
    edges = spark.createDataFrame([(f"n{k:02d}", "n00", "CALL") for k in range(1, 31)] + [("n00", "n39", "CALL")], "from_id string, to_id string, edge_type string")
    t = tools.GraphTools(graph.CodeGraph(nodes, edges))
    got = json.loads(t.call("get_callers", '{"function_id": "n00"}'))
    assert got["total"] == 30 and got["truncated"] and [r["node_id"] for r in got["results"]] == [f"n{k:02d}" for k in range(1, 26)]
    assert json.loads(t.call("get_callees", '{"function_id": "n00"}')) == {"results": [{"node_id": "n39", "name": "f39", "file": "a.go", "line": 39, "code": ""}], "total": 1, "truncated": False}
    assert "error" in json.loads(t.call("nothing", "{}")) and "error" in json.loads(t.call("get_callers", "{")) and len(t.kept) == 2
    assert [t.depth(k) for k in (-1, 0, 1, 5, 9)] == [2, 2, 1, 5, 5]
    assert json.loads(t.call("query_nodes_by_file", '{"file": "a.go", "node_type": "METHOD"}'))["total"] == 40
    pages = list(graph.CodeGraph(nodes, edges).pages("METHOD", 16))
    assert [len(p) for p in pages] == [16, 16, 8] and [r.node_id for p in pages for r in p] == [f"n{k:02d}" for k in range(40)]


def test_masks(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "c")], "from_id string, to_id string")
    seeds = spark.createDataFrame([("a", 1), ("x", 2), ("a", 4), ("q", 8)], "id string, mask int")
    assert {r.id: r.mask for r in graph.masks(edges, seeds).collect()} == {"a": 7, "b": 7, "c": 7, "d": 7, "x": 2, "q": 8}


def test_stores(spark):
    runs = spark.createDataFrame([], schemas.TABLES["scan_runs"])
    new = spark.createDataFrame([("r", "p", 0, None, "", 0, 0, None), ("s", "p", 5, None, "deep", 0, 0, "done")], schemas.TABLES["scan_runs"])
    got = store.create_run(runs, new, 9)
    assert sorted((r.run_id, r.started_at, r.scan_mode, r.status) for r in got.collect()) == [("r", 9, "default", "running"), ("s", 5, "deep", "done")]
    assert store.finalize_run(got, "r", 11, 1, 2).where("run_id = 'r'").first().status == "complete"
    with pytest.raises(KeyError):
        store.finalize_run(got, "zz", 1, 1, 1)
    with pytest.raises(KeyError):
        store.one(got, run_id="zz")
    assert store.one(got, run_id="s").first().scan_mode == "deep" and store.exists(got, run_id="s", project_id="p") and not store.exists(got, run_id="s", project_id="q")


def test_null_confidences_and_rule_chains(spark, monkeypatch):
    f = spark.createDataFrame([(1, "HIGH", None, "a"), (2, "HIGH", 0.5, "a"), (3, None, None, "b"), (4, "BLOCK", None, "b")], "seq long, severity string, conf double, path string")
    assert {r.seq: r.position for r in reports.ordered(f).collect()} == {4: 1, 2: 2, 1: 3, 3: 4}
    rows = spark.createDataFrame([(1, "i1", "a/b.py", "CWE-1"), (2, "i2", "b.py", "CWE-2"), (3, "i3", "c/d/b.py", None)], "seq long, finding_id string, path string, cwe string")
    rules = spark.createDataFrame([(2, "", "", "", "rest"), (0, "i2", "", "cwe-2", "own"), (1, "", "a/*.p?", "", "glob")], "rule_idx int, id string, path string, cwe string, reason string")
    want = {1: "glob", 2: "own", 3: "rest"}
    assert {r.seq: r.rule_reason for r in dedup.first_rule(rows, rules).collect()} == want
    monkeypatch.setattr(dedup, "MAX_CHAIN", 1)  # by the join
    assert {r.seq: r.rule_reason for r in dedup.first_rule(rows, rules).collect()} == want
    assert {r.rule_reason for r in dedup.first_rule(rows, rules.where("false")).collect()} == {None}


def test_folds_with_pins_and_other_sources(spark):
    """Groups that the set function can't do: several pins, and sources of other names among crossing ones."""
    schema = "seq long, path string, cwe string, line int, conf double, src string, pinned boolean, severity string"
    rows = [(1, "a", "C", 1, 0.5, "PATTERN", True, "LOW"), (2, "a", "C", 1, 0.9, "SEMANTIC", True, "HIGH"), (3, "a", "C", 1, 0.9, "OTHER", False, "BLOCK"), (4, "b", "C", 1, 0.4, "OTHER", False, "LOW"), (5, "b", "C", 1, 0.6, "PATTERN", False, "LOW")]
    got = {r.path: (r.seq, r.conf, r.src, r.pinned, r.severity, r.n_merged) for r in dedup.merge_exact(dedup.with_defaults(spark.createDataFrame(rows, schema))).collect()}
    assert got == {"a": (2, 0.9, "BOTH", True, "LOW", 3), "b": (5, 0.6, "PATTERN", False, "LOW", 2)}


def test_retry_deadline_and_events(spark):
    tries = []

    def flaky(x):
        tries.append(x)
        if len(tries) < 3:
            raise calls.Transient("again")
        return x

    waits = []
    assert calls.with_retry(flaky, sleep=waits.append)(7) == 7 and len(waits) == 2
    with pytest.raises(calls.Transient):
        calls.with_retry(lambda: (_ for _ in ()).throw(calls.Transient()), attempts=2, sleep=lambda _: None)()
    with pytest.raises(KeyError):
        calls.with_retry({}.__getitem__)("x")
    slow = F.udf(lambda x: time.sleep(20) or x, "long")
    began = time.time()
    with pytest.raises(TimeoutError), calls.deadline(spark, 1.0):
        spark.range(4).select(slow("id")).collect()
    assert time.time() - began < 15
    with calls.deadline(spark, 60.0):
        assert spark.range(3).count() == 3
    e = calls.LossyEvents(2)
    assert [e.emit({"n": k}) for k in range(3)] == [True, True, False] and len(e.drain()) == 2
    e.close()
    assert not e.emit({}) and e.drain() == []


def test_checkpoint_folder(spark):
    assert lineage.is_local("local[4]") and lineage.is_local("local") and not lineage.is_local("local-cluster[2,1,1024]") and not lineage.is_local("yarn")
