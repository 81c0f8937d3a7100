"""Adapters take whole tables: small tables whose every row counts."""

from sieveframe.operators import enrich
from sieveframe.plans import catalogue


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_edges_take_every_line_item(spark, tmp_path):
    rows = [(o, k, 100 * o + k, 3 * o + k, "ANR"[(o + k) % 3]) for o in range(1, 8) for k in range(1, 5)]
    write(spark, tmp_path, "lineitem", rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string")
    write(spark, tmp_path, "part", [(r[2], f"red {r[2]}", "Brand#11", "TIN", 1) for r in rows], "p_partkey long, p_name string, p_brand string, p_type string, p_size int")
    want = {(f"p{100 * o + k}", f"p{100 * o + k + 1}") for o in range(1, 8) for k in range(1, 4)}
    run = lambda name: catalogue.QUERIES[name](spark, str(tmp_path)).collect()
    assert {(r.from_id, r.callees) for r in run("a23_call_graph")} == want
    assert {r.id for r in run("u06_distinct_union")} == {i for e in want for i in e}
    assert {(r.from_id, r.to_id) for r in run("snk02_edge_insert")} == want | {(b, a) for a, b in want}


def test_path_summary_takes_every_finding(spark, tmp_path):
    rows = [(k, 40 * (k % 2) + 2, ("view", "error", "click")[k // 2 % 3], float(k)) for k in range(1, 31)]
    write(spark, tmp_path, "events", rows, "event_id long, user_id long, event_type string, value double")
    cwe, want = {"view": "CWE-89", "error": "CWE-862", "click": "CWE-22"}, {}
    for _, _, kind, _ in rows:  # users 2 and 42 share a file
        want.setdefault(cwe[kind], None)
    got = catalogue.QUERIES["a20_path_summary"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [("src/m2.java", ",".join(want), 60)]


def test_path_summary_order_and_steps(spark):
    rows = [("s", 3, "b", "", 1, ["z"], True), ("s", 2, "b", "f2", 7, ["y", "w"], True), ("s", 1, "a", None, 5, ["x"], None), ("s", 4, "a", "f4", 9, None, True), (None, 1, None, "f", 2, [], True)]
    p = spark.createDataFrame(rows, "surface_id string, seq long, sink_name string, sink_file string, sink_line int, steps array<string>, sanitized boolean")
    got = {r.surface_id: tuple(r)[1:] for r in enrich.path_summary(p, with_steps=False).collect()}
    assert got == {"s": (["a", "b"], 4, False, "f2", 7), None: ([None], 0, True, "f", 2)}
    full = {r.surface_id: r.steps for r in enrich.path_summary(p.where("seq < 4")).collect()}
    assert full == {"s": ["x", "y", "w", "z"], None: []}


def test_every_part_is_a_cve(spark, tmp_path):
    rows = [(k, f"{a} {b}", "Brand#11", "TIN", k) for k, (a, b) in enumerate([("red", "ring"), ("blue", "gear"), ("red", "gear"), ("blue", "bolt")], 1)]
    write(spark, tmp_path, "part", rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int")
    # by force: a name's second word is the package, and lies in the path of each part of that name
    want = {(f"s{a[0]}", f"CVE-{b[0]}", b[4] / 5) for a in rows for b in rows if b[1].split()[1] in a[1]}
    run = lambda name: catalogue.QUERIES[name](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in run("j11_cve_packages")} == want
    got = {r.surface_id: (r.cves, r.top_cvss) for r in run("d27_best_cve")}
    assert got == {"s1": ("CVE-1", 0.2), "s2": ("CVE-3,CVE-2", 0.6), "s3": ("CVE-3,CVE-2", 0.6), "s4": ("CVE-4", 0.8)}
