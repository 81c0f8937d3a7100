"""From model verdicts and contract violations to findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as X


def first_per_surface(rows: DataFrame) -> DataFrame:
    """rows(surface_id, bucket, seq): confirmed ones (bucket 0) before weak ones, then input order."""
    w = Window.partitionBy("surface_id").orderBy("bucket", "seq")
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def gate(rows: DataFrame) -> DataFrame:
    """F16: rows(sink_nodes, contract_cwe): confirmed, weak, or dropped."""
    tier = F.when(F.size("sink_nodes") > 0, F.lit("confirmed")).when(F.col("contract_cwe") != "", F.lit("weak"))
    return rows.withColumn("tier", tier).where("tier is not null")


def reconcile(verdicts: DataFrame, violations: DataFrame) -> DataFrame:
    """verdicts(surface_id, cwe, exploitable, taint_mismatch, confidence) against violations(surface_id, cwe, severity).

    action: suppress, elevate, unchanged (against a violation), or pass (without one).
    """
    v = violations.select("surface_id", F.col("cwe").alias("violation_cwe"), F.col("severity").alias("violation_severity"))
    j = verdicts.join(v, "surface_id", "left")
    mismatch = (F.col("cwe") != "") & (F.col("violation_cwe") != "") & (F.col("cwe") != F.col("violation_cwe"))
    action = (
        F.when(F.col("violation_cwe").isNull(), F.lit("pass")).when(~F.col("exploitable") & (F.col("confidence") >= 0.75) & ~mismatch, F.lit("suppress"))
        .when(F.col("exploitable") & (F.col("confidence") >= 0.7), F.lit("elevate")).otherwise(F.lit("unchanged"))
    )
    j = j.withColumn("action", action)
    sev = F.when(F.col("action") == "suppress", F.lit("SUPPRESSED")).when(F.col("action") == "elevate", X.severity(F.col("confidence"))).otherwise(F.coalesce("violation_severity", X.severity(F.col("confidence"))))
    reason = F.when(F.col("action") == "suppress", F.when(F.col("taint_mismatch"), F.lit("false_positive")).otherwise(F.lit("safe"))).otherwise(F.lit(""))
    return j.select("surface_id", "cwe", "confidence", "action", sev.alias("severity"), reason.alias("suppress_reason"), F.col("action").isin("suppress", "elevate").alias("pinned"))


def unhandled(violations: DataFrame, reconciled: DataFrame) -> DataFrame:
    """Violations that no verdict suppressed or elevated."""
    done = reconciled.where(F.col("action").isin("suppress", "elevate")).select("surface_id").distinct()
    return violations.join(done, "surface_id", "left_anti")


def violation_findings(violations: DataFrame) -> DataFrame:
    """violations(surface_id, cwe, file, window_start, sink_line)."""
    return violations.select("surface_id", "cwe", F.col("file").alias("path"), F.col("window_start").alias("line_start"), F.col("sink_line").alias("line_end"), F.lit("MEDIUM").alias("severity"), F.lit(0.65).alias("confidence"), X.finding_id(F.col("cwe"), F.col("file"), F.col("window_start")).alias("finding_id"))


KIND_CWE = {"idor_candidate": "CWE-862", "auth_boundary": "CWE-862"}


def verdict_findings(verdicts: DataFrame) -> DataFrame:
    """verdicts(surface_id, kind, contract_cwe, model_cwe, exploitable, confidence, sink_line, start_line, summary, justification, code)."""
    cwe = F.when(F.col("contract_cwe") != "", F.col("contract_cwe")).otherwise(X.choose([(F.col("kind") == k, F.lit(v)) for k, v in KIND_CWE.items()], F.col("model_cwe")))
    conf = F.when(F.coalesce("confidence", F.lit(0.0)) <= 0, F.lit(0.5)).otherwise(F.col("confidence"))
    line = F.when(F.col("sink_line") > 0, F.col("sink_line")).otherwise(F.col("start_line"))
    summary = F.when(X.text(F.col("summary")) != "", F.col("summary")).otherwise(X.first_words(X.text(F.col("justification")), 25))
    return verdicts.select("surface_id", cwe.alias("cwe"), line.alias("line"), conf.alias("confidence"), F.when(F.col("exploitable"), X.severity(conf)).otherwise(F.lit("LOW")).alias("severity"), (~F.col("exploitable")).alias("pinned"), summary.alias("summary"), F.array_join(F.slice(F.split("code", "\n"), 1, 30), "\n").alias("snippet"))


def capped(verdicts: DataFrame) -> DataFrame:
    """verdicts(n_tools, has_graph, in_rulebook, exploitable, confidence, justification): confidence at most 0.5 where it isn't earned."""
    graph = F.col("has_graph") & F.col("in_rulebook")
    cap = (graph & (F.col("n_tools") == 0)) | (graph & (F.col("n_tools") == 1) & F.col("exploitable") & (F.col("confidence") >= 0.85)) | (F.col("exploitable") & X.hedged(X.text(F.col("justification"))))
    return verdicts.withColumn("confidence", F.when(cap, F.least(F.col("confidence"), F.lit(0.5))).otherwise(F.col("confidence")))


def self_consistent(verdicts: DataFrame) -> DataFrame:
    """verdicts(exploitable, confidence, second_answer): a NO takes 0.3 off, and below 0.6 it isn't exploitable."""
    asked = F.col("exploitable") & (F.col("confidence") >= 0.85) & ~F.coalesce(X.yes_vote(F.col("second_answer")), F.lit(True))
    conf = F.when(asked, F.greatest(F.col("confidence") - 0.3, F.lit(0.0))).otherwise(F.col("confidence"))
    return verdicts.withColumns({"exploitable": F.when(asked & (conf < 0.6), F.lit(False)).otherwise(F.col("exploitable")), "confidence": conf})


def proven(findings: DataFrame) -> DataFrame:
    """findings(confidence, severity, proof_status): a proof adds 0.2 and never lowers."""
    ok = F.col("proof_status") == "confirmed"
    conf = F.when(ok, F.least(F.col("confidence") + 0.2, F.lit(1.0))).otherwise(F.col("confidence"))
    return findings.withColumns({"severity": F.when(ok & (X.severity_rank(X.severity(conf)) < X.severity_rank(F.col("severity"))), X.severity(conf)).otherwise(F.col("severity")), "confidence": conf})
