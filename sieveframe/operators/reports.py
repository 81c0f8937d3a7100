"""Rollups of findings and the scorer against ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as X


def by_severity(findings: DataFrame) -> DataFrame:
    """A01, A03, A04."""
    return findings.groupBy("severity").agg(F.count("*").alias("n"))


def summary(findings: DataFrame) -> DataFrame:
    """A03 with its total (severity null) and A25: whether a build fails."""
    return findings.groupingSets([[F.col("severity")], []], F.col("severity")).agg(F.count("*").alias("n"), F.coalesce(F.bool_or(F.col("severity").isin("BLOCK", "HIGH")), F.lit(False)).alias("fails"))


def exit_code(findings: DataFrame, errors: bool = False) -> DataFrame:
    """A25."""
    return findings.agg(F.when(F.lit(errors), F.lit(2)).when(F.coalesce(F.bool_or(F.col("severity").isin("BLOCK", "HIGH")), F.lit(False)), F.lit(1)).otherwise(F.lit(0)).alias("exit_code"))


def ordered(findings: DataFrame) -> DataFrame:
    """O02, with position: severity, then confidence (null last), then input order. Positions come from sorted ranges, not from one task."""
    rows = findings.withColumn("rank", X.severity_rank(F.col("severity")))
    sizes = rows.groupBy("rank").agg(F.count("*").alias("n"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b.rank") < F.col("a.rank"), "left").groupBy(F.col("a.rank").alias("rank")).agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("offset"))
    w = Window.partitionBy("rank", "bucket").orderBy(F.desc_nulls_last("conf"), "seq")
    # a hundred steps of confidence in each severity: groups shrink with the spread of scores
    b = rows.withColumn("bucket", F.coalesce(-F.floor(F.col("conf") * 100), F.lit(1)))
    steps = b.groupBy("rank", "bucket").agg(F.count("*").alias("n"))
    starts = steps.withColumn("start", F.coalesce(F.sum("n").over(Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return b.withColumn("r", F.row_number().over(w)).join(starts, ["rank", "bucket"]).join(before, "rank").withColumn("position", (F.col("r") + F.col("start") + F.col("offset")).cast("long")).drop("r", "start", "offset", "bucket", "rank")


def title(summary: Column, justification: Column) -> Column:
    """The summary, else what a confirmation in the justification explains, else its first 120 characters."""
    j = F.coalesce(justification, F.lit(""))
    part = lambda mark: F.regexp_extract(j, rf"(?s)^.+?{mark}.*?\): (.*)$", 1)
    told = [F.when(j.rlike(rf"(?s)^.+?{m}.*?\): "), part(m)) for m in (r" — B5 confirmed \(conf=", " — B5 LLM confirmed")]
    short = F.when(F.octet_length(j) > 120, F.concat(F.substring(j, 1, 117), F.lit("..."))).otherwise(j)
    return F.when(F.coalesce(summary, F.lit("")) != "", summary).otherwise(F.coalesce(*told, short))


def work_counts(items: DataFrame, key: str = "scan_id") -> DataFrame:
    """items(status) by key, counted as pending, done and error."""
    s = F.col("status")
    return items.groupBy(key).agg(*[F.count_if(s == name).alias(name) for name in ("pending", "done", "error")])


def file_groups(findings: DataFrame) -> DataFrame:
    """Counts by file with the position at which the file first appears in the ordered list."""
    return ordered(findings).groupBy("path").agg(F.count("*").alias("n"), F.min("position").alias("first_position"))


def majority_language(paths: DataFrame) -> DataFrame:
    """The most frequent known language, the alphabetically first of equals."""
    langs = paths.select(X.language(F.col("path")).alias("lang")).where("lang != 'unknown'")
    return langs.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(1)


def by_directory(files: DataFrame) -> DataFrame:
    """A17."""
    return files.select(X.dir_name(F.col("path")).alias("dir"), "path").groupBy("dir").agg(F.array_join(F.array_sort(F.collect_set("path")), ",").alias("paths"))


def detected(expected: DataFrame, findings: DataFrame) -> DataFrame:
    """expected(test_name, category, real_vuln, cwe) with predicted and the layer that saw it.

    findings(file_path, cwe, source_path, severity): non-suppressed ones in test code whose base name and CWE number fit.
    """
    f = findings.where((F.col("severity") != "SUPPRESSED") & F.col("file_path").contains("/testcode/")).select(F.regexp_replace(X.base_name(F.col("file_path")), r"\.[^.]*$", "").alias("test_name"), X.cwe_number(F.col("cwe")).alias("cwe"), "source_path").where("cwe is not null")
    seen = f.groupBy("test_name", "cwe").agg(F.bool_or(F.col("source_path") == "BOTH").alias("both"), F.bool_or(F.col("source_path") == "SEMANTIC").alias("sem"), F.bool_or(F.col("source_path") == "PATTERN").alias("pat"))
    layer = F.when(F.col("both") | (F.col("sem") & F.col("pat")), F.lit("BOTH")).when(F.col("sem"), F.lit("SEMANTIC_ONLY")).when(F.col("pat"), F.lit("PATTERN_ONLY")).otherwise(F.lit("UNKNOWN"))
    return expected.join(seen, ["test_name", "cwe"], "left").withColumn("predicted", F.col("both").isNotNull()).withColumn("layer", F.when(F.col("predicted"), layer)).drop("both", "sem", "pat")


def confusion(rows: DataFrame) -> DataFrame:
    """rows(category, real, predicted): counts and ratios, overall (category null) and by category."""
    g = rows.groupingSets([[F.col("category")], []], F.col("category")).agg(
        F.count_if(F.col("real") & F.col("predicted")).alias("tp"), F.count_if(~F.col("real") & F.col("predicted")).alias("fp"),
        F.count_if(F.col("real") & ~F.col("predicted")).alias("fn"), F.count_if(~F.col("real") & ~F.col("predicted")).alias("tn"),
    )
    g = g.withColumn("p", X.ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("r", X.ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return g.select("category", "tp", "fp", "fn", "tn", F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round(X.ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), 6).alias("f1"))


def true_positives_by_layer(rows: DataFrame) -> DataFrame:
    """A11."""
    return rows.where("real and predicted").groupBy("layer").agg(F.count("*").alias("n"))


def triage_summary(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """scores(score)."""
    return scores.agg(F.count_if(F.col("score") >= threshold).alias("escalated"), F.count_if(F.col("score") < threshold).alias("dropped"), F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 6).alias("avg_score"))
