"""Schemas of the persisted tables, as DDL; ranks of the ordered enumerations."""

from __future__ import annotations

TABLES = {
    "projects": "project_id STRING, root_path STRING, primary_language STRING, first_seen_at BIGINT, last_scanned_at BIGINT",
    "scan_runs": "run_id STRING, project_id STRING, started_at BIGINT, finished_at BIGINT, scan_mode STRING, files_scanned INT, findings_total INT, status STRING",
    "findings": "finding_id STRING, project_id STRING, run_id STRING, file_path STRING, line_start INT, line_end INT, cwe STRING, severity STRING, confidence DOUBLE, source_path STRING, rule_id STRING, matched_code STRING, justification STRING, suppress_reason STRING, patch STRING, patch_status STRING, first_seen_at BIGINT, last_seen_at BIGINT",
    "ssvc_scores": "finding_id STRING, exploitation STRING, automatable STRING, technical_impact STRING",
    "poe_results": "finding_id STRING, status STRING, confidence DOUBLE, business_impact_tier STRING, exec_summary STRING",
    "cpg_cache": "project_id STRING, cpg_path STRING, scope_mode STRING, built_at BIGINT, changed_functions INT",
    "scan_state": "project_id STRING, file_path STRING, content_hash STRING, last_scanned_at BIGINT",
    "suppressions": "project_id STRING, finding_id STRING, reason STRING, suppressed_at BIGINT",
    "work_items": "scan_id STRING, component STRING, surface_id STRING, status STRING, payload STRING, created_at BIGINT, updated_at BIGINT",
    "pending_findings": "scan_id STRING, finding_id STRING, data STRING, created_at BIGINT",
    "cpg_nodes": "project_id STRING, cpg_version STRING, node_id STRING, node_type STRING, name STRING, file STRING, line INT, code STRING",
    "cpg_edges": "project_id STRING, cpg_version STRING, from_id STRING, to_id STRING, edge_type STRING",
    "cpg_builds": "project_id STRING, cpg_version STRING, changed_hash STRING, node_count INT, edge_count INT, built_at BIGINT",
}
KEYS = {
    "projects": ("project_id",), "scan_runs": ("run_id",), "findings": ("finding_id",), "ssvc_scores": ("finding_id",), "poe_results": ("finding_id",), "cpg_cache": ("project_id",),
    "scan_state": ("project_id", "file_path"), "suppressions": ("project_id", "finding_id"), "work_items": ("scan_id", "component", "surface_id"), "pending_findings": ("scan_id", "finding_id"),
    "cpg_nodes": ("project_id", "cpg_version", "node_id"), "cpg_edges": ("project_id", "cpg_version", "from_id", "to_id", "edge_type"), "cpg_builds": ("project_id",),
}
SEVERITIES = ("BLOCK", "HIGH", "MEDIUM", "LOW", "SUPPRESSED")
PATTERN_JSON = "results ARRAY<STRUCT<check_id STRING, path STRING, start STRUCT<line INT, col INT, offset INT>, `end` STRUCT<line INT, col INT, offset INT>, extra STRUCT<message STRING, severity STRING, metadata STRING, lines STRING>>>, errors ARRAY<STRUCT<code INT, message STRING, path STRING>>"
SECRETS_JSON = "ARRAY<STRUCT<Description STRING, StartLine INT, EndLine INT, File STRING, RuleID STRING, Secret STRING>>"
DEPENDENCY_JSON = "results ARRAY<STRUCT<source STRUCT<path STRING>, packages ARRAY<STRUCT<package STRUCT<name STRING, version STRING>, vulnerabilities ARRAY<STRUCT<id STRING, summary STRING, cvss_score DOUBLE, cwe_ids ARRAY<STRUCT<cwe_id STRING>>>>>>>>"
CVE_JSON = "Results ARRAY<STRUCT<Target STRING, Vulnerabilities ARRAY<STRUCT<VulnerabilityID STRING, PkgName STRING, InstalledVersion STRING, FixedVersion STRING, CVSS STRUCT<nvd STRUCT<V3Score DOUBLE>, ghsa STRUCT<V3Score DOUBLE>>>>>>"
EXPLOITED_JSON = "vulnerabilities ARRAY<STRUCT<cveID STRING>>"
EPSS_JSON = "data ARRAY<STRUCT<cve STRING, epss STRING>>"
VERDICT_JSON = "exploitable BOOLEAN, confidence DOUBLE, cwe STRING, summary STRING, evidence STRING"
