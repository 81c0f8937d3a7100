"""Scanners behind one interface, the union of what they find, and filters of what they are given and give."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions.lineage import cut

log = logging.getLogger(__name__)
FINDING = ("rule_id", "path", "line_start", "line_end", "cwe", "conf", "src", "matched_code")


@dataclass(frozen=True)
class Scanner:
    """UDF2: ``scan`` makes findings of files(path, ...); ``supports`` tells from a project's languages and manifests whether it applies."""

    name: str
    scan: Callable[[DataFrame], DataFrame]
    supports: Callable[[set[str], set[str]], bool] = lambda languages, manifests: True


class Registry:
    """Scanners by name, in the order in which they were added."""

    def __init__(self, *scanners: Scanner):
        self.scanners: dict[str, Scanner] = {}
        for s in scanners:
            self.add(s)

    def add(self, scanner: Scanner) -> None:
        if scanner.name in self.scanners:
            raise ValueError(f"{scanner.name} is registered already")
        self.scanners[scanner.name] = scanner

    def run(self, files: DataFrame, stack: DataFrame) -> DataFrame | None:
        """Findings of all scanners that apply, with ``scanner``; one that fails is logged and contributes nothing. None if none applies.

        stack: one row of languages and manifests. A scanner's result is cut off from its plan here, so that a failure shows here and not later.
        """
        row = stack.first()
        parts = []
        for s in self.scanners.values():
            if not s.supports(set(row["languages"]), set(row["manifests"])):
                continue
            try:
                parts.append(cut(_shaped(s.scan(files)).withColumn("scanner", F.lit(s.name))))
            except (PySparkException, ValueError, KeyError, OSError) as e:
                log.warning("scanner %s failed: %s", s.name, e)
        return union(*parts) if parts else None


def _shaped(findings: DataFrame) -> DataFrame:
    missing = {"line_end": F.col("line_start") if "line_start" in findings.columns else F.lit(None).cast("int"), "matched_code": F.lit(""), "src": F.lit("PATTERN")}
    return findings.select(*[F.col(c) if c in findings.columns else missing.get(c, F.lit(None)).alias(c) for c in FINDING])


def union(*parts: DataFrame) -> DataFrame:
    """U02, ST01: findings of several detection paths as one table; by name, so that their columns' order doesn't matter."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def scannable(files: DataFrame, column: str = "path") -> DataFrame:
    """without files whose name starts with a dot."""
    return files.where(~X.base_name(F.col(column)).startswith("."))


def in_scope(files: DataFrame, column: str = "path") -> DataFrame:
    """files of a language that data flow knows, without tests."""
    p = F.col(column)
    return files.where((X.taint_language(p) != "") & ~X.is_scope_test(p))


def scope_files(modules: DataFrame) -> DataFrame:
    """modules(scope_files) → the distinct files of all of them, sorted."""
    return modules.select(F.explode("scope_files").alias("path")).distinct().orderBy("path")


def high_confidence(findings: DataFrame, least: float = 0.85) -> DataFrame:
    """F07."""
    return findings.where(F.col("conf") >= least)


def stubs(surfaces: DataFrame, least: int = 50) -> DataFrame:
    """surfaces(code) with ``is_stub``: less code than that many bytes, white space around it not counted."""
    return surfaces.withColumn("is_stub", F.octet_length(F.regexp_replace(F.coalesce("code", F.lit("")), r"^\s+|\s+$", "")) < least)


def with_patches(findings: DataFrame, patches: DataFrame) -> DataFrame:
    """patches(finding_id, patch, patch_status), one for each finding at most; findings without keep what they have."""
    p = patches.select(F.col("finding_id").alias("__id"), F.col("patch").alias("__patch"), F.col("patch_status").alias("__status"))
    hit = F.col("__id").isNotNull()
    own = {"patch": F.when(hit, F.col("__patch")).otherwise(F.col("patch")), "patch_status": F.when(hit, F.col("__status")).otherwise(F.col("patch_status"))}
    return findings.join(p, F.col("finding_id") == F.col("__id"), "left").select(*[own[c].alias(c) if c in own else F.col(c) for c in findings.columns])


def verified_models(models: DataFrame, registry: DataFrame) -> DataFrame:
    """models(path, model_id, sha256; a null id if the header couldn't be read) against registry(model_id, sha256, ord).

    Ids meet whatever their case, the first entry of an id counts. PASS for the registered hash, BLOCK for another, WARN for unknown models.
    """
    known = registry.groupBy(F.lower("model_id").alias("key")).agg(F.min_by("sha256", "ord").alias("expected"))
    j = models.join(known, F.lower("model_id") == F.col("key"), "left")
    status = F.when(F.col("expected").isNull(), F.lit("WARN")).when(F.col("expected") == F.col("sha256"), F.lit("PASS")).otherwise(F.lit("BLOCK"))
    return j.select("path", "model_id", "sha256", F.coalesce("expected", F.lit("")).alias("expected"), status.alias("status"))
