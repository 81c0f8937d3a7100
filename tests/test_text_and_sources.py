import json

import pytest
from pyspark.sql import functions as F

from sieveframe.functions import expressions as X
from sieveframe.operators import contracts, routes, text
from sieveframe.sources import readers
from sieveframe.streaming import incremental
from sieveframe.sources import store


def frame(spark, *values):
    return spark.createDataFrame([(k, v) for k, v in enumerate(values)], "id int, s string")


def col(spark, f, *values):
    return [r.x for r in frame(spark, *values).select("id", f(F.col("s")).alias("x")).orderBy("id").collect()]


def test_scalars(spark):
    assert col(spark, X.language, "a/b.PY", "x.tsx", "noext", "a.b/c") == ["python", "typescript", "unknown", "unknown"]
    assert col(spark, X.cwe_number, "CWE-89: SQL", "none", None) == [89, None, None]
    assert col(spark, X.dir_name, "a/b/c.go", "c.go") == ["a/b", "."]
    assert col(spark, X.short_path, "a/b/c.go", "c.go") == ["b/c.go", "c.go"]
    assert col(spark, X.yes_vote, "no\nFinal: YES.", "yes\nno", "", "Yes") == [True, False, False, True]
    assert col(spark, X.null_text, "null", None, "<empty>", "x") == ["", "", "", "x"]
    assert col(spark, X.minified, "a\n\n // c\n# d\n b") == ["a\n b"] and col(spark, X.dedented, "  a\n\tb") == ["a\nb"]
    assert col(spark, X.printable, 'a\\b"c\né') == ["a b c  "]
    assert col(spark, lambda c: X.first_words(c, 2), "a b c", " a b ") == ["a b", " a b "]
    assert col(spark, lambda c: X.line_of(c, F.lit(4)), "é\nb\nc", "abcdef") == [2, 1]
    assert col(spark, X.generic_sink_kind, "executeCommand", "spawnIt", "x") == ["sql", "command", "unknown"]
    assert col(spark, X.is_scope_test, "src/FooTest.java", "testing.py", "src/it/x.java", "src/main/x.java") == [True, True, True, False]


@pytest.mark.parametrize(("a", "b", "want"), [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0], [1.0, 2.0], 0.0), ([], [], 0.0), ([0.0], [1.0], 0.0), ([3.0, 4.0], [4.0, 3.0], 0.96)])
def test_cosine(spark, a, b, want):
    assert abs(spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(X.cosine(F.col("a"), F.col("b")).alias("x")).first().x - want) < 1e-12


def test_windows_and_braces(spark):
    code = "\n".join(f"l{k}" for k in range(1, 11))
    files = spark.createDataFrame([("f", code)], "path string, text string")
    got = {r.id: (r.first_line, r.snippet.split("\n")[-1]) for r in text.window(spark.createDataFrame([(1, "f", 1), (2, "f", 5), (3, "f", 99)], "id int, path string, line int"), files, 2, 4).collect()}
    assert got == {1: (1, "l3"), 2: (3, "l7"), 3: (1, "l4")}
    src = 'class A {\n void f(int a,\n   int b)\n {\n  x("}"); // }\n  if (y) { z(); }\n }\n int c;\n}'
    ends = text.brace_end(spark.createDataFrame([(1, "f", 2), (2, "f", 8), (3, "f", 50)], "id int, path string, line int"), spark.createDataFrame([("f", src)], "path string, text string")).collect()
    assert {r.id: r.end_line for r in ends} == {1: 7, 2: None}


def test_bytes(spark):
    assert col(spark, lambda c: text.truncate_utf8(c, F.lit(3)), "éé", "abc", None, "日") == ["é", "abc", None, "日"]
    assert text.byte_window("aa\nbbbb\ncc\ndd", 1, 8) == "... [truncated head]\nbbbb\ncc\n... [truncated tail]" and text.byte_window("a", 9, 1) == "a" and text.byte_window("a\nb\nc", 1, 99) == "a\nb\nc"
    assert text.strip_code('x = "a//b"; // c\ny') == 'x = ""; \ny' and text.blank_strings("f('a', \"b\")") == "f('', \"\")"
    assert text.obfuscate('import x\n/* a\n b */\nfoo("s") \n// c') == 'foo("")'
    assert text.common_parent(["a/b/c", "a/b/d/e", "a/b/f"]) == "a/b"


@pytest.mark.parametrize(("reply", "want"), [('Sure: {"exploitable": true, "confidence": 0.8} ok', {"confidence": 0.8, "exploitable": True}), ('{"exploitable": false, "cwe": "CWE-1", "summ', {"cwe": "CWE-1", "exploitable": False}), ('{"confidence": 1}', None), ("nothing", None)])
def test_verdict_salvage(reply, want):
    got = text.parse_verdict(reply)
    assert (json.loads(got) if got else None) == want


def test_crypto(spark):
    cases = {
        "a": (10, "x\nMessageDigest.getInstance(\"MD5\")", [], {("CWE-327", 11, "MD5", 0.85)}),
        "b": (10, "MD5 describe", ["x.sha1sum"], {("CWE-327", 10, "sha1", 0.85)}),  # sinks come first, on the function's line
        "c": (3, 'describe desk\n\nString key = "abc"; salt = "x"', [], {("CWE-321", 5, 'key = "', 0.85)}),
        "d": (0, "int r = Math.random();", [], {("CWE-338", 1, "Math.random(", 0.85)}),
        "e": (1, "SecureRandom r; Math.random()", [], set()),
        "f": (1, "Math.random()", ["java.security.SecureRandom"], set()),
        "g": (7, "\nPBKDF2(password, 5000)\nbcrypt(4)", None, {("CWE-916", 8, "PBKDF2(password, 5000", 0.80)}),
        "h": (7, "pbkdf2 10000 and bcrypt 9", [], {("CWE-916", 7, "bcrypt 9", 0.80)}),
        "i": (7, None, None, set()),
    }
    df = spark.createDataFrame([(k, *v[:3]) for k, v in cases.items()], "surface_id string, line int, code string, sink_nodes array<string>")
    got = {}
    for r in text.crypto_findings(df).collect():
        got.setdefault(r.surface_id, set()).add((r.cwe, r.line, r.matched, r.conf))
    assert got == {k: v[3] for k, v in cases.items() if v[3]}


def test_crypto_is_compiled(spark):
    """No lambda, which Spark would interpret for every row; sinks are searched one by one all the same, and a null one says nothing."""
    cases = [(1, "random.random()", ["crypto", "/rand"]), (2, "", ["m", "d5"]), (3, "", [None, "use MD5"]), (4, "Math.random()", [None, "x"]), (5, "", ["new RANDOM(", "b"]), (6, 'keys ="k" PBKDF2', ["crypto/rand"])]
    df = text.crypto_findings(spark.createDataFrame([(i, 4, c, s) for i, c, s in cases], "surface_id int, line int, code string, sink_nodes array<string>"))
    assert {(r.surface_id, r.cwe, r.line, r.matched) for r in df.collect()} == {(1, "CWE-338", 4, "random.random("), (3, "CWE-327", 4, "md5"), (4, "CWE-338", 4, "Math.random("), (5, "CWE-338", 4, "new Random(")}
    assert "lambda" not in df._jdf.queryExecution().executedPlan().toString()


JAVA = """package x;
@RequestMapping(value = "/api/")
public class Users {

  @GetMapping("users/{id}")
  public User find(String id) {
    return db.find(id);
  }

  @RequestMapping (method = RequestMethod.POST, value = "/users")
  public void add(User u) {
  }

  @DeleteMapping()
  void drop() {
"""
PYTHON = """@app.route("/login", methods=["POST", "GET"])
def login():
    pass


@router.put('/items')
async def put(): pass


@app.route("")
def root(): pass
"""
EXPRESS = "app.get('/a', show)\nrouter . post('/x', other)\nrouter.post ( \"/b\" , save)\napp.get('/c', save)"
GO = 'http.HandleFunc("/h", handle)\nr.GET("/g", list)\nr.Post("/p", handle)'


def test_routes(spark):
    files = spark.createDataFrame([("U.java", "java", JAVA), ("v.py", "python", PYTHON), ("r.js", "js", EXPRESS), ("m.go", "go", GO)], "path string, language string, text string")
    rows = [("find", "U.java", 6), ("add", "U.java", 11), ("drop", "U.java", 15), ("none", "U.java", 1), ("login", "v.py", 2), ("put", "v.py", 7), ("root", "v.py", 11), ("show", "r.js", 9), ("save", "r.js", 9), ("lost", "r.js", 1), ("handle", "m.go", 1), ("list", "m.go", 1)]
    got = {r.node_id: (r.verb, r.route) for r in routes.routes(spark.createDataFrame([(n, n, f, k) for n, f, k in rows], "node_id string, name string, file string, line int"), files).collect()}
    assert got == {"find": ("GET", "/api/users/{id}"), "add": ("POST", "/api/users"), "drop": ("DELETE", "/api"), "login": ("POST", "/login"), "put": ("PUT", "/items"), "root": ("GET", "/"), "show": ("GET", "/a"), "save": ("POST", "/b"), "handle": ("GET", "/h"), "list": ("GET", "/g")}


def test_stripped_and_obfuscated(spark):
    code = ['x("a//b") // c', "it's 'executeQuery' `raw`", '"a \\" b" y // "z"', '"open', 'a // b\n"c\nd" e', '""z']
    assert col(spark, contracts.stripped, *code) == ["x() ", "it's 'executeQuery' `raw`", " y ", "", "a \n e", "z"]
    assert text.blank_strings("f('a', \"b\") 'it") == "f('', \"\") '" and text.blank_strings('"a\\"b" "c\\') == '"" "'
    assert text.obfuscate("package a;\nimport (\n \"x\"\n)\nint a = 1; /* open\n* gone\n*/ gone too\n * stays\n-- sql\n--i;\nfrom x import y\nimport z\n  s = 'v' /* c */ \n# h") == "* stays\n--i;\nfrom x import y\n  s = '' /* c */"
    lines = "\n".join(f"line{k}" for k in range(20))
    assert text.byte_window(lines, 10, 18) == "... [truncated head]\nline9\nline10\n... [truncated tail]".replace("line9\nline10", "line10\nline11") and text.byte_window(lines, 99, 5).endswith("\nline19")


def test_reports(spark):
    pattern = {"results": [{"check_id": "java.x", "path": "a.java", "start": {"line": 3, "col": 1, "offset": 0}, "end": {"line": 4}, "extra": {"severity": "ERROR", "metadata": {"cwe": ["CWE-89: S", "CWE-1"]}, "lines": "q"}}]}
    got = readers.pattern_findings(spark.createDataFrame([(json.dumps(pattern),)], "json string")).first()
    assert (got.cwe, got.conf, got.line_start, got.line_end) == ("CWE-89: S", 0.65, 3, 4)
    cves = {"Results": [{"Target": "t", "Vulnerabilities": [{"VulnerabilityID": "CVE-2021-44228", "PkgName": "log4j-core", "CVSS": {"nvd": {"V3Score": 10.0}, "ghsa": {"V3Score": 10.0}}}, {"VulnerabilityID": "GHSA-x", "PkgName": "urllib3", "CVSS": {"ghsa": {"V3Score": 6.1}}}]}]}
    assert {r.cve: r.cvss for r in readers.cve_report(spark.createDataFrame([(json.dumps(cves),)], "json string")).collect()} == {"CVE-2021-44228": 10.0, "GHSA-x": 6.1}
    secrets = [{"Description": "d", "StartLine": 2, "EndLine": 2, "File": "f", "RuleID": "r", "Secret": "s"}]
    assert readers.secret_findings(spark.createDataFrame([(json.dumps(secrets),)], "json string")).first().cwe == "CWE-798"
    assert {r.epss for r in readers.epss(spark.createDataFrame([('{"data": [{"cve": "a", "epss": "0.4"}, {"cve": "b", "epss": "x"}]}',)], "json string")).collect()} == {0.4, 0.0}
    assert readers.exploited(spark.createDataFrame([('{"vulnerabilities": [{"cveID": "C"}, {"cveID": "C"}]}',)], "json string")).count() == 1


def test_files(spark, tmp_path):
    (tmp_path / "src" / "vendor").mkdir(parents=True)
    (tmp_path / "src" / "a.py").write_text("x")
    (tmp_path / "src" / "vendor" / "b.py").write_text("y")
    (tmp_path / "src" / "c.png").write_bytes(b"z")
    (tmp_path / "src" / "go.mod").write_text("m")
    files = readers.tree(spark, str(tmp_path / "src"))
    assert {r.path for r in files.collect()} == {"a.py", "go.mod"}
    assert tuple(readers.stack(files).first()) == (["python"], ["go.mod"])
    (tmp_path / "rules.yaml").write_text("suppressions:\n  - path: 'migrations/*.py'\n    cwe: CWE-89\n    reason: orm\n  - id: abc\n")
    assert [tuple(r) for r in readers.suppression_rules(spark, str(tmp_path / "rules.yaml")).collect()] == [(0, "", "migrations/*.py", "CWE-89", "orm"), (1, "abc", "", "", "")]
    assert readers.suppression_rules(spark, str(tmp_path / "none.yaml")).count() == 0
    (tmp_path / "truth.csv").write_text("# test, category\nT1, sqli, true, 89, more\nT2,xss,false\n")
    assert [tuple(r) for r in readers.ground_truth(spark, str(tmp_path / "truth.csv")).collect()] == [("T1", "sqli", True, 89)]
    md = spark.createDataFrame([("intro\n## CWE-89\nbody\nmore\n## Other\nx\n## CWE-22\nlast",)], "text string")
    assert {tuple(r) for r in readers.sections(md).collect()} == {("CWE-89", "body\nmore"), ("CWE-22", "last")}


def test_stream_upserts(spark, tmp_path):
    schema = "project_id STRING, file_path STRING, content_hash STRING, last_scanned_at BIGINT"
    spark.createDataFrame([("p", "a", "1", 1), ("p", "b", "1", 1)], schema).write.json(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new and changes nothing
        incremental.upsert_stream(spark.readStream.schema(schema).json(str(tmp_path / "in")), str(tmp_path), "scan_state", str(tmp_path / "c"), "last_scanned_at").awaitTermination(120)
    spark.createDataFrame([("p", "a", "2", 2)], schema).write.mode("append").json(str(tmp_path / "in"))
    incremental.upsert_stream(spark.readStream.schema(schema).json(str(tmp_path / "in")), str(tmp_path), "scan_state", str(tmp_path / "c"), "last_scanned_at").awaitTermination(120)
    assert {(r.file_path, r.content_hash) for r in store.current(spark, str(tmp_path), "scan_state").collect()} == {("a", "2"), ("b", "1")}


def test_text_functions_run_without_python(spark):
    texts = ["package a;\nimport (\n \"x\"\n/* in\n*/\n y 'a' \n)\nimport \nz = \"it's\\\"\" 'open", "'" + "\\\"b" * 50_000, None, "　import (　\nimport x\nkept ", "a/* b */\n/* c\nd", "é日😀" * 3]
    df = spark.createDataFrame([(t, k + 4) for k, t in enumerate(texts)], "t string, n int")
    got = df.select(text.obfuscate_col(F.col("t")).alias("o"), text.blank_strings_col(F.col("t")).alias("b"), text.truncate_utf8(F.col("t"), F.col("n")).alias("h"))
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    want = [(None,) * 3 if t is None else (text.obfuscate(t), text.blank_strings(t), t.encode()[: k + 4].decode("utf-8", "ignore")) for k, t in enumerate(texts)]
    assert [tuple(r) for r in got.collect()] == want
