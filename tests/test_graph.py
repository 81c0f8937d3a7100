import pytest

from sieveframe.operators import enrich, graph, targeting, taxonomy
from sieveframe.operators.graph import CodeGraph
from sieveframe import schemas


def build(spark, edges, nodes=None, project="p", version="v"):
    ids = nodes or sorted({i for e in edges for i in e})
    n = spark.createDataFrame([(project, version, i, "METHOD", i, "server.go" if i == "m1" else "util.go", 1, "") for i in ids], schemas.TABLES["cpg_nodes"])
    e = spark.createDataFrame([(project, version, a, b, "CALL") for a, b in edges], schemas.TABLES["cpg_edges"])
    return CodeGraph.of(n, e, project, version)


def ids(df):
    return {r.node_id for r in df.collect()}


def test_callers_and_callees(spark):
    g = build(spark, [("c1", "t"), ("c2", "t"), ("t", "x")])
    assert ids(g.callers("t")) == {"c1", "c2"} and ids(g.callees("t")) == {"x"} and ids(g.callers("-1")) == set()
    assert {r.from_id: r.n_callees for r in build(spark, [("a", "b"), ("a", "c"), ("b", "c")]).adjacency().collect()} == {"a": 2, "b": 1}
    assert {r.to_id for r in g.hubs(2).collect()} == {"t"}
    assert ids(build(spark, [("m1", "m2")]).by_file("server.go")) == {"m1"}
    with pytest.raises(ValueError):
        g.edges_of()
    assert g.edges_of(from_id="c1", to_id="t").count() == 1


def test_neighbours(spark):
    g = build(spark, [("root", "l1a"), ("root", "l1b"), ("l1a", "l2"), ("l2", "l3"), ("l3", "root"), ("root", "root")])
    assert ids(g.neighbours("root", 1)) == {"l1a", "l1b", "l3"}
    assert ids(g.neighbours("root", 2)) == {"l1a", "l1b", "l2", "l3"} and ids(g.neighbours("root", 0)) == set() == ids(g.neighbours("root", -1))
    for bad in (("", 1), ("root", 7)):
        with pytest.raises(ValueError):
            g.neighbours(*bad)


def test_projects_do_not_mix(spark):
    a, b = build(spark, [("x", "y")]), build(spark, [("x", "z")], project="q")
    g = CodeGraph.of(a.nodes.union(b.nodes), a.edges.union(b.edges), "q", "v")
    assert ids(g.callees("x")) == {"z"}


def test_closures_and_depths(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("d", "e"), ("a", "b")], "from_id string, to_id string")
    seeds = spark.createDataFrame([("a",), ("a",)], "id string")
    assert {(r.id, r.depth) for r in graph.depths(e, seeds).collect()} == {("a", 0), ("b", 1), ("c", 1)}
    chain = spark.createDataFrame([(str(k), str(k + 1)) for k in range(12)], "from_id string, to_id string")
    assert graph.reachable(chain, spark.createDataFrame([("0",)], "id string")).count() == 13
    assert graph.depths(chain, spark.createDataFrame([("0",)], "id string"), 3).count() == 4


def nearest(spark, callers, surfaces, sources):
    c = spark.createDataFrame(callers, "node_id string, caller_id string")
    return {tuple(r) for r in graph.nearest_surface(spark.createDataFrame([(s,) for s in sources], "source_id string"), c, spark.createDataFrame([(s,) for s in surfaces], "surface_id string")).collect()}


def test_nearest_surface(spark):
    long = [(f"n{k}", f"n{k + 1}") for k in range(11)]
    assert nearest(spark, long, ["n9"], ["n0"]) == set()  # gives up after three levels without a surface
    assert nearest(spark, long, ["n3"], ["n0"]) == {("n0", "n3")}
    assert nearest(spark, [("s", "a"), ("s", "b")], ["a", "b"], ["s"]) == set()  # two at the same depth
    assert nearest(spark, [("s", "a"), ("a", "b")], ["a", "b"], ["s"]) == {("s", "a")}
    assert nearest(spark, [("s", "a")], ["s", "a"], ["s"]) == {("s", "s")}


def test_nearest_marks_hold_no_pairs(spark):
    """Every node of a dense layer meets every one above it: what is kept is one row a node."""
    layers = [(f"a{k}", f"b{j}") for k in range(30) for j in range(30)] + [(f"b{k}", f"c{j}") for k in range(30) for j in range(30)]
    callers = spark.createDataFrame(layers + [("c0", "a0")], "node_id string, caller_id string")
    marks = spark.createDataFrame([("c7",), ("c3",), ("b5",)], "id string")
    got = {r.id: (r.depth, r.low, r.high) for r in graph.nearest_marks(callers, marks, 3).collect()}
    want = {f"a{k}": (1, "b5", "b5") for k in range(30)} | {f"b{k}": (1, "c3", "c7") for k in range(30)} | {"b5": (0, "b5", "b5"), "c3": (0, "c3", "c3"), "c7": (0, "c7", "c7"), "c0": (2, "b5", "b5")}
    assert got == want
    routes = graph.first_route(spark.createDataFrame([("b1",), ("a1",), ("c9",)], "node_id string"), callers, marks.withColumnRenamed("id", "node_id"), hops=1)
    assert {tuple(r) for r in routes.collect()} == {("b1", "c3", 1), ("a1", "b5", 1)}


def test_expand_and_routes(spark):
    g = build(spark, [("m2", "m1")])
    assert {r.file for r in g.expand(spark.createDataFrame([("server.go",)], "file string")).collect()} == {"server.go", "util.go"}
    callers = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d")], "node_id string, caller_id string")
    got = graph.first_route(spark.createDataFrame([("a",)], "node_id string"), callers, spark.createDataFrame([("c",), ("d",)], "node_id string")).collect()
    assert [tuple(r) for r in got] == [("a", "d", 1)]


def test_taint_paths(spark):
    e = spark.createDataFrame([("s", "a"), ("a", "k"), ("s", "k"), ("a", "s")], "from_id string, to_id string")
    got = graph.taint_paths(e, spark.createDataFrame([("s",)], "id string"), spark.createDataFrame([("k",)], "id string")).collect()
    assert [r.path for r in got] == [["s", "k"], ["s", "a", "k"]]


FILES = [("api/UserController.java", "import org.springframework.web.bind"), ("repo/UserRepo.java", "import org.springframework.data.jpa"), ("auth/JwtUtil.java", "import io.jsonwebtoken.Jwts"), ("x.txt", "import org.springframework.web")]
METHODS = [("ctrl1", "getResource", "api/UserController.java", ""), ("repo1", "findById", "repo/UserRepo.java", ""), ("auth1", "validateToken", "auth/JwtUtil.java", ""), ("svc1", "fetchRecord", "service/UserService.java", "")]


def surfaces(spark, edges):
    bits = targeting.boundary_bits(spark.createDataFrame(FILES, "path string, text string"))
    return targeting.all_surfaces(spark.createDataFrame(METHODS, "node_id string, name string, file string, code string"), spark.createDataFrame(edges, "from_id string, to_id string"), bits).collect()


def test_surfaces(spark):
    bits = {r.path: r.bits for r in targeting.boundary_bits(spark.createDataFrame(FILES, "path string, text string")).collect()}
    assert bits == {"api/UserController.java": 2, "repo/UserRepo.java": 4 + 16, "auth/JwtUtil.java": 8}
    path = [("ctrl1", "svc1"), ("svc1", "repo1")]
    got = {r.surface_id: r.kind for r in surfaces(spark, path)}
    assert got["svc1"] == "idor_candidate" and got["ctrl1"] == "idor_candidate"
    assert surfaces(spark, path)[0].kind == "idor_candidate"
    assert {r.surface_id: r.kind for r in surfaces(spark, [*path, ("svc1", "auth1")])}["svc1"] == "external_input"


def test_second_order_searches_backward_only(spark, monkeypatch):
    monkeypatch.setattr(targeting.graph, "depths", None)  # the search from sources
    bits = targeting.boundary_bits(spark.createDataFrame(FILES, "path string, text string"))
    methods = spark.createDataFrame(METHODS, "node_id string, name string, file string, code string")
    edges = spark.createDataFrame([("ctrl1", "svc1"), ("svc1", "repo1"), ("repo1", "auth1")], "from_id string, to_id string")
    got = targeting.second_order(methods, edges, bits)
    assert {(r.surface_id, r["name"]) for r in got.collect()} == {("ctrl1", "getResource"), ("svc1", "fetchRecord"), ("repo1", "findById")}


def test_taxonomy(spark):
    calls = spark.createDataFrame([(1, "java", "stmt.executeQuery"), (2, "java", "Runtime.exec"), (3, "python", "os.system"), (4, "go", "nothing"), (5, "java", "ProcessBuilder.start")], "call_id int, language string, call_name string")
    got = {r.call_id: (r.name, r.cwe) for r in taxonomy.classify(calls, taxonomy.rules(spark)).collect()}
    assert got == {1: ("executeQuery", "CWE-89"), 2: ("exec", "CWE-78"), 3: ("os.system", "CWE-78"), 5: ("ProcessBuilder.start", "CWE-78")}
    assert {r.call_id for r in taxonomy.sanitizes(spark.createDataFrame([(1, "python", "html.escape"), (2, "go", "x")], calls.schema)).where("sanitizes").collect()} == {1}
    files = spark.createDataFrame([("a.py", "python", "x = 1\nos.system (cmd)\ny")], "path string, language string, text string")
    assert [tuple(r) for r in taxonomy.flag_lines(files, taxonomy.rules(spark)).collect()] == [("a.py", 2, "os.system", "command")]


def test_cve_matching(spark):
    s = spark.createDataFrame([("a", "lib/log4j/Main.java", ""), ("b", "x/y.java", "import Requests now"), ("c", "x/y.java", "")], "surface_id string, file string, code string")
    p = enrich.cve_index(spark.createDataFrame([("C1", "org.apache:log4j-core", 10.0), ("C2", "requests", 7.5)], "cve string, package string, cvss double"))
    assert {tuple(r) for r in enrich.match_packages(s, p).collect()} == {("a", "C1", 10.0), ("b", "C2", 7.5)}


def test_cve_sets_with_many_surfaces_are_split(spark, monkeypatch):
    s = spark.createDataFrame([(f"s{k}", "lib/ring/x.java" if k % 3 else "lib/gear/x.java", "") for k in range(40)], "surface_id string, file string, code string")
    p = enrich.cve_index(spark.createDataFrame([(f"C{k}", "ring" if k % 2 else "gear", float(k)) for k in range(6)], "cve string, package string, cvss double"))
    want = {(f"s{k}", f"C{c}", float(c)) for k in range(40) for c in range(6) if bool(k % 3) == bool(c % 2)}
    monkeypatch.setattr(enrich, "CHUNK", 4)
    for most in (0, 1000):
        monkeypatch.setattr(enrich, "MAX_BROADCAST", most)
        got = [tuple(r) for r in enrich.match_packages(s, p).collect()]
        assert len(got) == len(want) and set(got) == want
        assert {(r.surface_id, r.cves) for r in enrich.best_of_sets(s, p).collect()} == {(f"s{k}", "C5,C3,C1" if k % 3 else "C4,C2,C0") for k in range(40)}


def test_searches_join_lists(spark):
    """A hop joins a row for each node, not one for each edge, and lists of a hub are cut; the reversed ones hold the same edges."""
    pairs = {("hub", f"n{k}") for k in range(2500)} | {(f"n{k}", "end") for k in range(1500)} | {("end", "hub")}
    edges = spark.createDataFrame([*pairs, ("end", "hub"), (None, "x"), ("end", None)], "from_id string, to_id string")
    lists = graph.adjacency_lists(edges)
    rows = lists.collect()
    assert sorted(len(r.others) for r in rows if r.from_id == "hub") == [452, 1024, 1024] and sum(r.from_id == "n7" for r in rows) == 1
    assert {(r.from_id, x) for r in rows if r.from_id for x in r.others} == pairs
    back = graph.reversed_lists(lists).collect()
    assert {(x, r.from_id) for r in back if r.from_id for x in r.others if x} == pairs and max(len(r.others) for r in back) == 1024
    seeds = spark.createDataFrame([("hub",)], "id string")
    for e in (edges, lists):
        got = {r.id: r.depth for r in graph.depths(e, seeds).collect()}
        assert got.pop("hub") == 0 and got.pop("end") == 2 and set(got.values()) == {1} and len(got) == 2500
        assert {r.mask for r in graph.masks(e, seeds.selectExpr("id", "4 as mask")).where("id is not null").collect()} == {4}


def test_surfaces_search_no_storage(spark, monkeypatch):
    from sieveframe.operators import targeting

    methods = spark.createDataFrame([(i, i, f"{i}.java", "") for i in "abcde"], "node_id string, name string, file string, code string")
    bits = spark.createDataFrame([("a.java", 2), ("c.java", 4), ("d.java", 8), ("e.java", 16)], "path string, bits int")
    calls = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d"), ("c", "e")], "from_id string, to_id string")
    looked_for, masks = [], graph.masks
    monkeypatch.setattr(graph, "masks", lambda edges, seeds: looked_for.append({(r.id, r.mask) for r in seeds.collect()}) or masks(edges, seeds))
    got = {(r.surface_id, r.kind, r.depth) for r in targeting.select_surfaces(methods, calls, bits).collect()}
    assert got == {("a", "external_input", 0), ("b", "external_input", 1), ("c", "external_input", 2)}
    assert looked_for == [{("c", 4), ("d", 8)}]
