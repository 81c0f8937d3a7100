import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sieveframe import schemas
from sieveframe.config import Config, load
from sieveframe.functions import expressions as X
from sieveframe.operators import changes, contracts, dedup, enrich, reconcile, reports
from sieveframe.sources import store

FIND = "seq bigint, path string, cwe string, line int, conf double, src string, severity string, pinned boolean"


def findings(spark, *rows):
    return spark.createDataFrame([(k, *r, *(("", False) if len(r) == 5 else ())) for k, r in enumerate(rows)], FIND)


def one(df, expr):
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(("conf", "band"), [(1.0, "BLOCK"), (0.92, "BLOCK"), (0.91, "HIGH"), (0.75, "HIGH"), (0.74, "MEDIUM"), (0.60, "MEDIUM"), (0.59, "LOW"), (0.30, "LOW"), (0.29, "SUPPRESSED"), (0.0, "SUPPRESSED")])
def test_bands(spark, conf, band):
    assert one(spark.range(1), X.severity(F.lit(conf))) == band


@pytest.mark.parametrize(("path", "why"), [
    ("internal/auth/handler_test.go", "test_file"), ("tests/test_auth.py", "test_file"), ("__tests__/auth.js", "test_file"), ("testdata/spring-boot-app/AuthController.java", "test_file"), ("spec/auth_spec.rb", "test_file"),
    ("app/migrations/0001_initial.py", "framework_safe"), ("src/main/java/com/app/SecurityConfig.java", "framework_safe"), ("gen/user.pb.go", "framework_safe"), ("internal/auth/handler.go", ""), ("a/b/migrations/x.py", ""), ("test_auth.py", ""),
])
def test_suppressed_paths(spark, path, why):
    got = dedup.run(findings(spark, (path, "CWE-89", 1, 0.7, "PATTERN"))).first()
    assert (got.suppress_reason, got.severity == "SUPPRESSED") == (why, bool(why))


def test_finding_id(spark):
    assert one(spark.range(1), X.finding_id(F.lit("CWE-89"), F.lit("src/db.go"), F.lit(5))) == "3a401d2a4906ec4566eb8d503195465cef93ba66609529dd6bba4b4eeaddc6a8"


@pytest.mark.parametrize(("rows", "n", "src", "conf", "sev"), [
    ([("api/auth.py", "CWE-89", 10, 0.70, "PATTERN"), ("api/auth.py", "CWE-89", 10, 0.70, "SEMANTIC")], 1, "BOTH", 0.90, "HIGH"),
    ([("a.py", "CWE-1", 10, 0.65, "PATTERN"), ("a.py", "CWE-1", 10, 0.80, "SEMANTIC")], 1, "BOTH", 0.95, "BLOCK"),
    ([("a.py", "CWE-1", 10, 0.7, "PATTERN"), ("a.py", "CWE-1", 20, 0.7, "PATTERN")], 2, "PATTERN", 0.7, "MEDIUM"),
    ([("a.py", "CWE-1", 10, 0.95, "PATTERN"), ("a.py", "CWE-1", 10, 0.95, "SEMANTIC")], 1, "BOTH", 0.95, "BLOCK"),
    ([("a.py", "CWE-1", 10, 0.70, "PATTERN"), ("a.py", "CWE-1", 10, 0.70, "PATTERN")], 1, "PATTERN", 0.70, "MEDIUM"),
    ([("a.py", "CWE-1", 10, 0.95, "SEMANTIC", "LOW", True)], 1, "SEMANTIC", 0.95, "LOW"),
])
def test_gate_one_and_score(spark, rows, n, src, conf, sev):
    got = dedup.run(findings(spark, *rows)).orderBy("seq").collect()
    assert len(got) == n and (got[0].src, got[0].severity) == (src, sev) and abs(got[0].conf - conf) < 1e-9


def test_merge_is_a_fold_in_order(spark):
    r = random.Random(1)
    rows, seq = [], 0
    for g in range(150):
        for _ in range(r.randint(1, 5)):
            rows.append((seq, f"f{g}", "CWE-1", 1, r.choice((0.5, 0.6, 0.7)), r.choice(("PATTERN", "SEMANTIC", "BOTH", "")), r.choice(("LOW", "HIGH", "")), r.random() < 0.35))
            seq += 1
    want = {}
    for s, path, _, _, c, src, sev, pin in rows:
        w = want.get(path)
        if w is None:
            want[path] = [s, c, src, sev, pin]
            continue
        cross = {w[2], src} == {"PATTERN", "SEMANTIC"} or "BOTH" in (w[2], src)
        win, lose = ([s, c, src, sev, pin], w) if c > w[1] else (w, [s, c, src, sev, pin])
        win = list(win)
        if cross:
            win[2] = "BOTH"
        if lose[4]:
            win[3], win[4] = lose[3], True
        want[path] = win
    got = dedup.merge_exact(dedup.with_defaults(spark.createDataFrame(rows, FIND).repartition(5))).collect()
    assert {g.path: [g.seq, g.conf, g.src, g.severity, g.pinned] for g in got} == want


def test_statistics_and_history(spark):
    f = dedup.with_defaults(findings(spark, ("a.py", "CWE-1", 1, 0.7, "PATTERN"), ("a.py", "CWE-1", 1, 0.7, "SEMANTIC"), ("api/util_test.go", "CWE-2", 1, 0.7, "PATTERN")))
    assert tuple(dedup.statistics(f, dedup.run(f)).first()) == (3, 2, 1, 1)
    stored = f.limit(0).select("finding_id", "severity", F.col("conf").alias("confidence"), "suppress_reason").unionByName(f.where("seq = 2").select("finding_id", "severity", F.col("conf").alias("confidence"), "suppress_reason"))
    assert {r.seq for r in dedup.without_history(f, stored).collect()} == {0, 1}


def test_rules_first_match(spark):
    rules = spark.createDataFrame([(0, "abc123", "", "", "known_false_positive"), (1, "", "migrations/*.py", "CWE-89", "orm_safe"), (2, "", "", "CWE-79", "late")], "rule_idx int, id string, path string, cwe string, reason string")
    f = dedup.with_defaults(findings(spark, ("migrations/0002.py", "cwe-89", 1, 0.7, "x"), ("migrations/0002.py", "CWE-79", 1, 0.7, "x"), ("migrations/a/b.py", "CWE-89", 1, 0.7, "x")))
    assert [r.rule_reason for r in dedup.first_rule(f, rules).orderBy("seq").collect()] == ["orm_safe", "late", None]
    everything = spark.createDataFrame([(0, "", "", "", "all")], rules.schema)
    assert {r.suppress_reason for r in dedup.apply_rules(f, everything).collect()} == {"all"}


def test_changes(spark):
    now = spark.createDataFrame([("same", "1"), ("new", "1"), ("mod", "2")], "file_path string, content_hash string")
    was = spark.createDataFrame([("same", "1"), ("mod", "1"), ("gone", "1")], now.schema)
    assert {tuple(r) for r in changes.diff(now, was).collect()} == {("new", "added"), ("mod", "modified"), ("gone", "removed")}
    assert changes.diff(now, was.limit(0)).count() == 3
    assert changes.scope(changes.diff(now, now), now).count() == 3


def test_upserts(spark, tmp_path):
    names = [c.split()[0] for c in schemas.TABLES["findings"].split(", ")]
    row = lambda **k: tuple(k.get(n, 0 if n in ("line_start", "line_end", "first_seen_at", "last_seen_at") else 0.5 if n == "confidence" else "") for n in names)
    old = spark.createDataFrame([row(finding_id="a", severity="LOW", patch="p", cwe="CWE-1", first_seen_at=1, last_seen_at=1), row(finding_id="b")], schemas.TABLES["findings"])
    new = spark.createDataFrame([row(finding_id="a", severity="HIGH", cwe="CWE-2", first_seen_at=9, last_seen_at=9), row(finding_id="c")], schemas.TABLES["findings"])
    got = {r.finding_id: r for r in store.upsert_findings(old, new).collect()}
    assert set(got) == {"a", "b", "c"} and (got["a"].severity, got["a"].cwe, got["a"].first_seen_at, got["a"].last_seen_at, got["a"].patch) == ("HIGH", "CWE-1", 1, 9, "p")
    assert store.upsert_findings(old, new, keep_empty_patch=False).where("finding_id = 'a'").first().patch == ""
    p = spark.createDataFrame([("id1", "/r", "go", 1, 1)], schemas.TABLES["projects"])
    q = spark.createDataFrame([("id2", "/r", "java", 5, 5)], schemas.TABLES["projects"])
    assert tuple(store.upsert_projects(p, q).first()) == ("id1", "/r", "java", 1, 5)
    with pytest.raises(KeyError):
        store.finalize_run(spark.createDataFrame([], schemas.TABLES["scan_runs"]), "x", 1, 1, 1)
    assert store.current(spark, str(tmp_path), "projects").count() == 0
    store.commit(spark, q, str(tmp_path), "projects")
    assert store.current(spark, str(tmp_path), "projects").first().project_id == "id2"
    edges = spark.createDataFrame([("p", "v", "a", "b", "")], schemas.TABLES["cpg_edges"])
    assert store.insert_edges(store.insert_edges(edges.limit(0), edges), edges).collect()[0].edge_type == "CALL"


def test_contracts(spark):
    book = contracts.rulebook(spark)
    rows = [
        ("viol", "external_input", ["x.executeQuery"], ["f"], "", False, "Violation", "CWE-89"), ("safe", "external_input", ["x.executeQuery"], ["prepareStatement"], "", False, "Safe", ""), ("nopath", "external_input", ["x.executeQuery"], [], "", False, "Inconclusive", "CWE-89"),
        ("none", "external_input", ["helper"], ["f"], "", False, "Inconclusive", "CWE-22"), ("clean", "external_input", ["x.executeQuery"], ["f"], "", True, "Safe", ""), ("auth", "auth_boundary", [], ["f"], "", False, "Inconclusive", "CWE-862"),
        ("code", "external_input", [], ["f"], "os.system(x)", False, "Violation", "CWE-78"), ("nosql", "external_input", [], ["f"], "executeQuery(x)", False, "Inconclusive", "CWE-22"), ("quoted", "external_input", [], ["f"], 'log("os.system")', False, "Inconclusive", "CWE-22"),
        ("tie", "external_input", ["Runtime.exec", "FileWriter"], ["f"], "", False, "Violation", "CWE-22"), ("sinkfirst", "external_input", ["Runtime.exec"], ["f"], "new File(x)", False, "Violation", "CWE-78"), ("crypto", "dangerous_sink", ["md5"], ["f"], "", False, "Violation", "CWE-327"),
    ]
    df = spark.createDataFrame([r[:6] for r in rows], "surface_id string, kind string, sink_nodes array<string>, call_path array<string>, code string, sanitized boolean")
    assert {tuple(r) for r in contracts.verdicts(df, book).collect()} == {(r[0], r[6], r[7]) for r in rows}


def test_reconcile_boundaries(spark):
    v = spark.createDataFrame([("a", "CWE-1", True, False, 0.70), ("b", "CWE-1", False, False, 0.75), ("c", "CWE-9", False, False, 0.9), ("d", "", False, True, 0.9), ("e", "CWE-1", True, False, 0.69), ("f", "CWE-1", True, False, 0.9)], "surface_id string, cwe string, exploitable boolean, taint_mismatch boolean, confidence double")
    w = spark.createDataFrame([(k, "CWE-1", "MEDIUM") for k in "abcde"], "surface_id string, cwe string, severity string")
    got = {r.surface_id: (r.action, r.severity, r.suppress_reason) for r in reconcile.reconcile(v, w).collect()}
    assert got == {"a": ("elevate", "MEDIUM", ""), "b": ("suppress", "SUPPRESSED", "safe"), "c": ("unchanged", "MEDIUM", ""), "d": ("suppress", "SUPPRESSED", "false_positive"), "e": ("unchanged", "MEDIUM", ""), "f": ("pass", "HIGH", "")}
    assert {r.surface_id for r in reconcile.unhandled(w, reconcile.reconcile(v, w)).collect()} == {"c", "e"}


def test_verdict_rules(spark):
    v = spark.createDataFrame([(0, True, True, True, 0.9, "sure"), (1, True, True, True, 0.9, "sure"), (2, True, True, True, 0.9, "It is Likely so"), (3, True, True, True, 0.9, "sure")], "n_tools int, has_graph boolean, in_rulebook boolean, exploitable boolean, confidence double, justification string")
    assert [r.confidence for r in reconcile.capped(v).orderBy("n_tools").collect()] == [0.5, 0.5, 0.5, 0.9]
    s = spark.createDataFrame([(True, 0.9, "NO"), (True, 0.95, "so:\nYES."), (True, 0.86, "no")], "exploitable boolean, confidence double, second_answer string")
    assert [(r.exploitable, round(r.confidence, 2)) for r in reconcile.self_consistent(s).collect()] == [(True, 0.6), (True, 0.95), (False, 0.56)]


@pytest.mark.parametrize(("reply", "score"), [("Category: PROBABLY_SAFE", 0.25), ("EXPLOITABLE", 1.0), ("0.8", 0.8), ("garbage", 0.5), ("It is safe.\nCategory: EXPLOITABLE", 1.0), ("probably_vulnerable", 0.75), ("1.0", 1.0)])
def test_triage(spark, reply, score):
    assert one(spark.range(1), X.triage_score(F.lit(reply))) == score


def test_scorer(spark):
    expected = spark.createDataFrame([("T1", "sqli", True, 89), ("T2", "sqli", False, 89), ("T3", "xss", True, 79), ("T4", "xss", False, 79), ("T5", "sqli", True, 89), ("T6", "xss", True, 79)], "test_name string, category string, real boolean, cwe int")
    f = spark.createDataFrame([("x/testcode/T1.java", "CWE-89: SQL", "PATTERN", "HIGH"), ("x/testcode/T1.java", "CWE-89", "SEMANTIC", "LOW"), ("x/testcode/T2.java", "CWE-89", "PATTERN", "HIGH"), ("x/testcode/T3.java", "CWE-22", "PATTERN", "HIGH"), ("x/testcode/T5.java", "CWE-89", "PATTERN", "SUPPRESSED"), ("other/T6.java", "CWE-79", "PATTERN", "HIGH"), ("x/testcode/T6.java", "none", "PATTERN", "HIGH")], "file_path string, cwe string, source_path string, severity string")
    rows = reports.detected(expected, f)
    got = {r.category: (r.tp, r.fp, r.fn, r.tn, r.precision, r.recall) for r in reports.confusion(rows).collect()}
    assert got == {None: (1, 1, 3, 1, 0.5, 0.25), "sqli": (1, 1, 1, 0, 0.5, 0.5), "xss": (0, 0, 2, 1, 0.0, 0.0)}
    assert [tuple(r) for r in reports.true_positives_by_layer(rows).collect()] == [("BOTH", 1)]


def test_enclosing_method(spark):
    m = spark.createDataFrame([("f", 3, "a"), ("f", 10, "b"), ("f", 10, "c"), ("g", 1, "z")], "file string, line int, method_id string")
    x = spark.createDataFrame([(1, "f", 2), (2, "f", 3), (3, "f", 9), (4, "f", 99), (5, "h", 1)], "fid int, file string, line int")
    assert {tuple(r) for r in enrich.enclosing(x, m).collect()} == {(1, None), (2, "a"), (3, "a"), (4, "c"), (5, None)}


def test_fan_in(spark):
    a = spark.createDataFrame([("hub", f"s{k}") for k in range(4)] + [("ok", "s0"), ("ok", "s1")], "sink_name string, surface_id string")
    assert {tuple(r) for r in enrich.fan_in_guard(a).collect()} == {("ok", "s0"), ("ok", "s1")}


def test_ssvc_and_ids(spark):
    f = spark.createDataFrame([("1", "CWE-89", 0.0, "C1"), ("2", "CWE-5", 8.0, "C2"), ("3", "CWE-918", 9.0, "")], "finding_id string, cwe string, cvss double, cve string")
    got = {r.finding_id: tuple(r)[1:] for r in enrich.ssvc(f, spark.createDataFrame([("C1",)], "cve string"), spark.createDataFrame([("C2", 0.2)], "cve string, epss double")).collect()}
    assert got == {"1": ("Active", "Yes", "Total"), "2": ("PoC", "No", "Total"), "3": ("None", "Yes", "Partial")}
    assert hashlib.sha256(b"/r").hexdigest()[:16] == one(spark.range(1), X.project_id(F.lit("/r")))


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"hub_callers": 7, "unknown": 1}')
    assert load(str(tmp_path / "c.json")).hub_callers == 7 and load().max_depth == 6
    with pytest.raises(ValueError):
        Config(pattern_floor=2.0).validate()


def test_similar_pairs_over_tiles(spark, monkeypatch):
    monkeypatch.setattr(dedup, "TILE", 8)
    odd = [None, [], [0.0, 0.0], [float("nan"), 1.0], [None, 1.0], [float("inf"), 1.0], [1.0]]
    rows = [(k, "ab"[k % 2], odd[k] if k < len(odd) else [float(k % 7 - 3), float(k % 5 - 2)]) for k in range(60)]
    v = spark.createDataFrame(rows, "id long, label string, v array<double>")
    a, b = v.alias("a"), v.alias("b")
    every = a.join(b, F.expr("a.label = b.label and a.id < b.id")).select("a.id", "b.id", X.cosine(F.col("a.v"), F.col("b.v")).alias("c")).where("c >= 0.3")
    assert sorted(map(repr, map(tuple, dedup.similar_pairs(v, "label", 0.8, 0.3).drop("kind").collect()))) == sorted(map(repr, map(tuple, every.collect())))
