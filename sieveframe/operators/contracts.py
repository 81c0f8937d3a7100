"""Contract checks: per surface, the verdict over the CWEs that apply to its kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixed import ANCHORS, APPLICABLE, SAFE

NO_SINK = (862,)


def rulebook(spark: SparkSession) -> DataFrame:
    """kind, ord, cwe, anchors, safe, no_sink: a row for each kind and CWE, from the lists above."""
    rows = [(kind, k, cwe, list(ANCHORS.get(cwe, ())), list(SAFE.get(cwe, ())), cwe in NO_SINK) for kind, cwes in APPLICABLE.items() for k, cwe in enumerate(cwes)]
    return spark.createDataFrame(rows, "kind string, ord int, cwe int, anchors array<string>, safe array<string>, no_sink boolean")


def stripped(code: Column) -> Column:
    """X15, the variant on whole texts: without // comments and double-quoted strings (quotes too), which end at a quote that doesn't follow a backslash."""
    return F.regexp_replace(code, r'''//[^\n]*|"[\s\S]*?(?:(?<!\\)"|\z)''', "")


def verdicts(surfaces: DataFrame, book: DataFrame) -> DataFrame:
    """surfaces(surface_id, kind, sink_nodes, call_path, code, sanitized) → surface_id, verdict, cwe.

    The rulebook has some rows for each kind, in the code; each surface meets only its kind's.
    """
    s = surfaces.withColumn("sanitized", F.coalesce("sanitized", F.lit(False))).withColumn("bare", stripped(F.coalesce("code", F.lit(""))))
    j = s.join(F.broadcast(book), "kind")
    in_sinks = F.exists("anchors", lambda a: F.exists(F.coalesce("sink_nodes", F.array().cast("array<string>")), lambda n: n.contains(a)))
    in_code = (F.col("cwe") != 89) & (F.col("bare") != "") & F.exists("anchors", lambda a: F.col("bare").contains(a))
    safe = F.exists("safe", lambda a: F.exists(F.coalesce("call_path", F.array().cast("array<string>")), lambda n: n.contains(a)) | F.coalesce(F.col("code"), F.lit("")).contains(a))
    verdict = (
        F.when(F.col("no_sink"), F.when(F.col("sanitized"), F.lit("Safe")).otherwise(F.lit("Inconclusive")))
        .when(~(F.col("in_sinks") | F.col("in_code")), F.lit(None).cast("string"))
        .when(F.size(F.coalesce("call_path", F.array().cast("array<string>"))) == 0, F.lit("Inconclusive"))
        .when(F.col("sanitized") | F.col("is_safe"), F.lit("Safe")).otherwise(F.lit("Violation"))
    )
    j = j.withColumn("in_sinks", in_sinks).withColumn("in_code", in_code).withColumn("is_safe", safe).withColumn("verdict", verdict)
    rank = F.when(F.col("verdict") == "Violation", F.lit(3)).when(F.col("verdict") == "Safe", F.lit(2)).when(F.col("verdict") == "Inconclusive", F.lit(1)).otherwise(F.lit(0))
    viol = F.col("verdict") == "Violation"
    order = F.struct(rank.alias("rank"), F.when(viol, F.col("in_sinks").cast("int")).otherwise(F.lit(0)).alias("sink"), F.when(viol, -F.col("cwe")).otherwise(F.lit(0)).alias("low"), (-F.col("ord")).alias("first"))
    best = j.groupBy("surface_id").agg(F.max_by(F.struct("verdict", "cwe"), order).alias("b"))
    out = F.coalesce("b.verdict", F.lit("Inconclusive"))
    return best.select("surface_id", out.alias("verdict"), F.when(out == "Safe", F.lit("")).otherwise(F.concat(F.lit("CWE-"), F.col("b.cwe").cast("string"))).alias("cwe"))


def vote(votes: DataFrame) -> DataFrame:
    """votes(surface_id, yes BOOLEAN or null for an error) → safe only with more yes than no."""
    return votes.groupBy("surface_id").agg((F.count_if("yes") > F.count_if(~F.col("yes"))).alias("safe")).select("surface_id", F.when(F.col("safe"), F.lit("Safe")).otherwise(F.lit("Violation")).alias("verdict"))


def histogram(results: DataFrame) -> DataFrame:
    """results(verdict, evidence)."""
    return results.groupBy("verdict").agg(F.count("*").alias("n"), F.count_if(F.coalesce("evidence", F.lit("")) == "").alias("n_without_evidence"))
