"""Sources: trees of files, scanner reports, reference tables, rule files and ground truth. Schemas are explicit throughout."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import expressions as X

# Binary files that aren't read.
BINARY = (".png", ".jpg", ".jpeg", ".gif", ".ico", ".pdf", ".zip", ".tar", ".gz", ".jar", ".war", ".class", ".exe", ".dll", ".so", ".dylib", ".bin", ".woff", ".woff2", ".ttf", ".mp4", ".mp3")


def tree(spark: SparkSession, root: str) -> DataFrame:
    """SRC01: path (below root), content_hash and text of the files of a tree, without skipped folders and binary files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", r"^[a-z]+:/*(?=/)|^[a-z]+:", "")
    rel = X.relative(path, F.lit(root.rstrip("/")))
    keep = ~F.arrays_overlap(F.split(rel, "/"), F.array(*map(F.lit, X.SKIPPED_DIRS))) & ~X.extension(rel).isin(*BINARY)
    return files.where(keep).select(rel.alias("path"), F.sha2("content", 256).alias("content_hash"), F.decode("content", "UTF-8").alias("text"))


def stack(files: DataFrame) -> DataFrame:
    """SRC03: languages and manifests of files(path)."""
    manifests = ("go.mod", "package.json", "pom.xml", "build.gradle", "requirements.txt", "pyproject.toml", "Cargo.toml", "composer.json", "Gemfile", "Dockerfile")
    lang, base = X.language(F.col("path")), X.base_name(F.col("path"))
    return files.agg(F.array_sort(F.collect_set(F.when(lang != "unknown", lang))).alias("languages"), F.array_sort(F.collect_set(F.when(base.isin(*manifests), base))).alias("manifests"))


def cwe_text(metadata: str = "metadata") -> Column:
    """The first CWE of a metadata object, whose value is a string or an array of strings."""
    v = F.get_json_object(metadata, "$.cwe")
    return F.coalesce(F.when(v.startswith("["), F.get_json_object(v, "$[0]")).otherwise(v), F.lit(""))


def pattern_findings(reports: DataFrame, column: str = "json") -> DataFrame:
    """SRC05, D20, F06 (paths): results of the pattern scanner."""
    r = reports.select(F.explode(F.from_json(column, schemas.PATTERN_JSON)["results"]).alias("r"))
    meta = F.get_json_object("r.extra.metadata", "$.confidence")
    return r.select(
        F.col("r.check_id").alias("rule_id"), F.col("r.path").alias("path"), F.col("r.start.line").alias("line_start"), F.col("r.end.line").alias("line_end"), cwe_text("r.extra.metadata").alias("cwe"),
        X.scanner_confidence(F.coalesce(meta, F.lit("")), F.coalesce("r.extra.severity", F.lit(""))).alias("conf"), F.lit("PATTERN").alias("src"), F.coalesce("r.extra.lines", F.lit("")).alias("matched_code"),
    )


def keep_finding(path: Column, rule_id: Column) -> Column:
    """not in CI folders, and a rule's language prefix must fit the file's language where both are known."""
    prefix, lang = F.substring_index(rule_id, ".", 1), X.language(path)
    ci = X.contains_any(path, (".github/", ".gitlab/", ".circleci/"))
    return ~ci & ((prefix == "") | (prefix == "generic") | (lang == "unknown") | ~prefix.isin(*set(X.LANGUAGES.values())) | (prefix == lang))


def secret_findings(reports: DataFrame, column: str = "json") -> DataFrame:
    """SRC06."""
    r = reports.select(F.explode(F.from_json(column, schemas.SECRETS_JSON)).alias("r"))
    return r.select(F.col("r.RuleID").alias("rule_id"), F.col("r.File").alias("path"), F.col("r.StartLine").alias("line_start"), F.col("r.EndLine").alias("line_end"), F.lit("CWE-798").alias("cwe"), F.lit(0.90).alias("conf"), F.lit("PATTERN").alias("src"))


def dependency_findings(reports: DataFrame, column: str = "json") -> DataFrame:
    """SRC07."""
    r = reports.select(F.explode(F.from_json(column, schemas.DEPENDENCY_JSON)["results"]).alias("r"))
    p = r.select(F.col("r.source.path").alias("path"), F.explode("r.packages").alias("p"))
    v = p.select("path", F.col("p.package.name").alias("package"), F.col("p.package.version").alias("version"), F.explode("p.vulnerabilities").alias("v"))
    cvss = F.coalesce("v.cvss_score", F.lit(0.0))
    return v.select("path", "package", "version", F.col("v.id").alias("cve"), cvss.alias("cvss"), F.coalesce(F.get("v.cwe_ids", F.lit(0))["cwe_id"], F.lit("CWE-1035")).alias("cwe"), X.dependency_confidence(cvss).alias("conf"))


def cve_report(reports: DataFrame, column: str = "json") -> DataFrame:
    """SRC08: cve, package, cvss (the vendor-neutral score, else the other), versions."""
    r = reports.select(F.explode(F.from_json(column, schemas.CVE_JSON)["Results"]).alias("r")).select("r.Target", F.explode("r.Vulnerabilities").alias("v"))
    nvd, other = F.coalesce("v.CVSS.nvd.V3Score", F.lit(0.0)), F.coalesce("v.CVSS.ghsa.V3Score", F.lit(0.0))
    return r.select(F.col("v.VulnerabilityID").alias("cve"), F.col("v.PkgName").alias("package"), F.when(nvd > 0, nvd).otherwise(other).alias("cvss"), F.col("v.InstalledVersion").alias("installed"), F.col("v.FixedVersion").alias("fixed"))


def exploited(reports: DataFrame, column: str = "json") -> DataFrame:
    """SRC09."""
    return reports.select(F.explode(F.from_json(column, schemas.EXPLOITED_JSON)["vulnerabilities"]).alias("v")).select(F.col("v.cveID").alias("cve")).distinct()


def epss(reports: DataFrame, column: str = "json") -> DataFrame:
    """SRC10: a missing or unreadable score is 0."""
    return reports.select(F.explode(F.from_json(column, schemas.EPSS_JSON)["data"]).alias("d")).select(F.col("d.cve").alias("cve"), F.coalesce(F.col("d.epss").try_cast("double"), F.lit(0.0)).alias("epss"))


def suppression_rules(spark: SparkSession, path: str) -> DataFrame:
    """SRC11: rule_idx, id, path, cwe, reason from a list of flat YAML maps (or JSON); none from a missing or bad file."""
    schema = "rule_idx int, id string, path string, cwe string, reason string"
    rows: list[dict] = []
    try:
        if os.path.exists(path):
            with open(path) as f:
                body = f.read()
            if body.lstrip().startswith(("[", "{")):
                got = json.loads(body)
                rows = got if isinstance(got, list) else got.get("suppressions", [])
            else:
                for line in body.splitlines():
                    m = re.match(r"\s*(-\s+)?(id|path|cwe|reason)\s*:\s*[\"']?(.*?)[\"']?\s*(?:#.*)?$", line)
                    if m:
                        if m[1]:
                            rows.append({})
                        if rows:
                            rows[-1][m[2]] = m[3]
    except (OSError, ValueError, AttributeError):
        rows = []
    return spark.createDataFrame([(k, *(str(r.get(c, "")) for c in ("id", "path", "cwe", "reason"))) for k, r in enumerate(rows)], schema)


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """SRC13."""
    return truth_rows(spark.read.text(path))


def truth_rows(lines: DataFrame) -> DataFrame:
    """Lines(value) of at least four fields, # comments left out."""
    parts = lines.where(~F.col("value").startswith("#")).select(F.split("value", ",").alias("p")).where(F.size("p") >= 4)
    at = lambda k: F.btrim(F.get("p", F.lit(k)))
    return parts.select(at(0).alias("test_name"), at(1).alias("category"), (F.lower(at(2)) == "true").alias("real_vuln"), at(3).try_cast("int").alias("cwe"))


def sections(documents: DataFrame) -> DataFrame:
    """SRC18: documents(text) with '## CWE-n' headers → cwe, body."""
    parts = documents.select(F.explode(F.split("text", r"(?m)^(?=## )")).alias("s")).where(F.col("s").rlike(r"^## CWE-\d+"))
    return parts.select(F.regexp_extract("s", r"^## (CWE-\d+)", 1).alias("cwe"), F.btrim(F.regexp_replace("s", r"^[^\n]*\n?", ""), F.lit(" \n\t")).alias("body"))


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """SRC15: a persisted table with its declared schema."""
    return spark.read.schema(schemas.TABLES[name]).parquet(path)


def binary_models(spark: SparkSession, path: str) -> DataFrame:
    """SRC17: sha256, and the format version of files that start with the model magic; the header alone is read in the expression."""
    f = spark.read.format("binaryFile").load(path)
    return f.select("path", F.sha2("content", 256).alias("sha256"), (F.substring("content", 1, 4) == F.lit(b"GGUF")).alias("is_model"), F.conv(F.concat(*[F.hex(F.substring("content", 8 - k, 1)) for k in range(4)]), 16, 10).cast("long").alias("version"))
