from pyspark.sql import functions as F

from sieveframe.functions import expressions as X
from sieveframe.operators import taxonomy


def test_taint_findings(spark):
    end = "struct<kind string, file string, line int, node_id string>".replace(" string", ":string").replace(" int", ":int")
    rows = [("java", ("http_param", "a.java", 3, "n1"), ("template", "b.java", 2, "n2"), ["x", "y"], True), ("", ("env", "c", 1, "n3"), ("other", "b.java", 9, "n4"), None, None)]
    p = spark.createDataFrame(rows, f"language string, source {end}, sink {end}, steps array<string>, sanitized boolean")
    a, b = taxonomy.taint_findings(p, spark.createDataFrame([("b.java", "one\n\t two() \n")], "path string, text string")).orderBy("source_node").collect()
    assert (a.path, a.line, a.cwe, a.conf, a.src, a.rule_id, a.matched_code) == ("b.java", 2, "CWE-79", 0.75, "PATTERN", "JOERN-TAINT-template", "two()")
    assert a.justification == "Taint flow from http_param (a.java:3) to sink template (b.java:2) [sanitized path]" and a.path_summary == "source (a.java:3) → sink (b.java:2) via 2 intermediate nodes"
    assert (b.cwe, b.matched_code, b.automatable, b.technical_impact) == ("CWE-200", "", "No", "Partial") and b.path_summary.endswith("via 0 intermediate nodes")


def test_proofs_and_patches(spark):
    rows = [("BLOCK", "a.go", 500, "ORA-1"), ("HIGH", "a.rs", 404, "ORA-1"), ("MEDIUM", "a.go", 500, "ok"), (None, None, None, None), ("HIGH", "A.TS", 599, "a PSQLException, at java.x")]
    f = spark.createDataFrame(rows, "severity string, path string, code int, body string")
    got = f.select(X.proof_status(F.col("severity"), F.col("path")), X.is_patchable(F.col("severity")), X.leaked_error(F.col("code"), F.col("body"))).collect()
    assert [tuple(r) for r in got] == [("", True, "ORA-"), ("language_unsupported", True, None), ("not_attempted", False, None), ("not_attempted", False, None), ("", True, "SQLException")]
