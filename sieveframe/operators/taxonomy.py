"""Sources, sinks and sanitizers of calls by language: ordered rules, first match."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixed import CONSTRUCTOR_SINKS, SANITIZERS, SINKS, SOURCES

#: Template sinks of these languages are cross-site scripting rather than template injection.
_CWE = {"sql": "CWE-89", "command": "CWE-78", "deserialization": "CWE-502", "file_write": "CWE-22", "redirect": "CWE-601", "eval": "CWE-94"}


def cwe_of(language: str, kind: str) -> str:
    return _CWE.get(kind) or ("CWE-79" if language == "java" else "CWE-1336")


def rules(spark: SparkSession, table: dict[str, tuple] = SINKS, bare: bool = True) -> DataFrame:
    """rule_idx, language, name, needle (after the last dot for sinks), kind, cwe."""
    rows = []
    for language, items in table.items():
        for k, (name, kind) in enumerate(items):
            rows.append((k, language, name, name.rpartition(".")[2] if bare else name, kind, cwe_of(language, kind) if bare else ""))
    return spark.createDataFrame(rows, "rule_idx int, language string, name string, needle string, kind string, cwe string")


def classify(calls: DataFrame, table: DataFrame) -> DataFrame:
    """calls(call_id, language, call_name) with the first rule whose needle is part of the name; unmatched ones drop out.

    The rule table is a list in the code, some dozens of rows a language.
    """
    r = table.select("rule_idx", F.col("language").alias("rl"), "name", "needle", "kind", "cwe")
    hit = calls.join(F.broadcast(r), (F.col("language") == F.col("rl")) & F.col("call_name").contains(F.col("needle")))
    best = hit.groupBy("call_id").agg(F.min_by(F.struct("language", "call_name", "rule_idx", "name", "kind", "cwe"), "rule_idx").alias("b"))
    return best.select("call_id", "b.*")


def kinds(calls: DataFrame, table: DataFrame, sink: bool = True) -> DataFrame:
    """call_id and kind of every call: the taxonomy's for its language, else the generic one of sinks, or the name itself of sources."""
    from ..functions import expressions as X

    own = classify(calls, table).select("call_id", F.col("kind").alias("__kind"))
    name = F.col("call_name")
    return calls.join(own, "call_id", "left").select("call_id", F.coalesce("__kind", X.generic_sink_kind(name) if sink else name).alias("kind"))


def scope_calls(calls: DataFrame, scope: DataFrame, spark: SparkSession) -> DataFrame:
    """calls(call_id, file, language, call_name) of the files in scope(path), as role source or sink with its kind."""
    mine = calls.join(scope.select(F.col("path").alias("file")).distinct(), "file", "left_semi")
    role = lambda table, bare, name: classify(mine, rules(spark, table, bare)).select("call_id", F.lit(name).alias("role"), "kind")
    return role(SOURCES, False, "source").unionByName(role(SINKS, True, "sink"))


def all_sinks(calls: DataFrame, spark: SparkSession) -> DataFrame:
    """calls(call_id, language, call_name, full_name): sinks by name, and arguments of constructors (call name <init>) whose full name holds a sink type."""
    by_name = classify(calls, rules(spark)).select("call_id", "kind")
    made = calls.where("call_name = '<init>'").select("call_id", "language", F.col("full_name").alias("call_name"))
    return by_name.unionByName(classify(made, rules(spark, CONSTRUCTOR_SINKS, bare=False)).select("call_id", "kind")).distinct()


def sanitizes(calls: DataFrame) -> DataFrame:
    """call_id, sanitizes: whether any sanitizer of the language is part of the name."""
    from ..functions.expressions import any_of

    conds = [(F.col("language") == lang) & any_of([F.col("call_name").contains(n) for n in names]) for lang, names in SANITIZERS.items()]
    return calls.select("call_id", any_of(conds).alias("sanitizes"))


def flag_lines(files: DataFrame, table: DataFrame) -> DataFrame:
    """SRC20: files(path, language, text): for each line the first sink whose bare name is followed by a parenthesis."""
    lines = files.select("path", "language", F.posexplode(F.split("text", "\n")).alias("pos", "code")).where(F.col("code").contains("("))
    r = table.select("rule_idx", F.col("language").alias("rl"), "name", "kind", F.concat(F.lit("\\Q"), F.col("needle"), F.lit("\\E\\s*\\(")).alias("rx"))
    hit = lines.join(F.broadcast(r), (F.col("language") == F.col("rl")) & F.expr("code rlike rx"))
    return hit.groupBy("path", (F.col("pos") + 1).alias("line")).agg(F.min_by("name", "rule_idx").alias("name"), F.min_by("kind", "rule_idx").alias("kind"))


def taint_findings(paths: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """paths(language, source(kind, file, line, node_id), sink(same), steps, sanitized) as findings of confidence 0.75 at their sinks.

    files(path, text) give the sink's line; without it, or beyond the text, the code is empty.
    """
    from ..functions import expressions as X

    kind, at = F.col("sink.kind"), lambda end: F.concat(F.col(f"{end}.file"), F.lit(":"), F.col(f"{end}.line").cast("string"))
    cwe = F.when((F.col("language") == "java") & (kind == "template"), F.lit("CWE-79")).otherwise(X.sink_cwe(kind))
    code = F.lit("")
    if files is not None:
        paths = paths.join(files.select(F.col("path").alias("__path"), F.col("text").alias("__text")), F.col("sink.file") == F.col("__path"), "left")
        line = F.when(F.col("sink.line") >= 1, F.get(F.split("__text", "\n"), F.col("sink.line") - 1))
        code = F.coalesce(F.regexp_replace(line, r"^\s+|\s+$", ""), F.lit(""))
    why = F.concat(F.lit("Taint flow from "), F.col("source.kind"), F.lit(" ("), at("source"), F.lit(") to sink "), kind, F.lit(" ("), at("sink"), F.lit(")"), F.when(F.col("sanitized"), F.lit(" [sanitized path]")).otherwise(F.lit("")))
    n = F.coalesce(F.array_size("steps"), F.lit(0)).cast("string")
    return paths.select(
        F.col("sink.file").alias("path"), F.col("sink.line").alias("line"), cwe.alias("cwe"), F.lit(0.75).alias("conf"), F.lit("PATTERN").alias("src"), F.concat(F.lit("JOERN-TAINT-"), kind).alias("rule_id"), code.alias("matched_code"), why.alias("justification"),
        F.lit("None").alias("exploitation"), F.when(kind.isin("sql", "command", "eval"), F.lit("Yes")).otherwise(F.lit("No")).alias("automatable"), F.when(kind.isin("sql", "command", "deserialization", "eval"), F.lit("Total")).otherwise(F.lit("Partial")).alias("technical_impact"),
        F.col("source.node_id").alias("source_node"), F.col("sink.node_id").alias("sink_node"), F.concat(F.lit("source ("), at("source"), F.lit(") → sink ("), at("sink"), F.lit(") via "), n, F.lit(" intermediate nodes")).alias("path_summary"),
        F.concat(F.lit("Untrusted input reaches "), kind, F.lit(" sink without validation")).alias("required_conditions"),
    )
