"""Enrichment joins: CVEs by substring, reference tables, attribution and its guards, as-of lookups, sanitized paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as X

MIN_PART, MAX_PACKAGE = 4, 40
CHUNK, MAX_BROADCAST = 4096, 1_000_000  # surfaces of a set that go to one task, rows that a broadcast may hold


def cve_index(report: DataFrame) -> DataFrame:
    """SRC08: report(cve, package, cvss) under the full and the short key of the package."""
    short = X.tail(F.col("package"), "[:/]")
    return report.withColumn("key", F.explode(F.array_distinct(F.array(F.col("package"), short)))).where("key != ''")


def match_sets(surfaces: DataFrame, packages: DataFrame, max_packages: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """J11, J12 in two parts: surfaces(surface_id, file, code) × packages(key, cve, cvss) → (surface_id, keys) and (keys, cve, cvss).

    Surfaces that meet the same set of names have the same CVEs, so these are found once for each set.

    A part of the file's path of at least four bytes contains or lies in the package's name, or the code's head holds it. Such a join has no
    key; distinct parts and names meet instead of rows, and names only by broadcast while they are few (a report lists one project's).
    """
    names = packages.select(F.lower("key").alias("key"), "cve", "cvss").distinct()
    few = F.broadcast if names.select("key").distinct().limit(max_packages + 1).count() <= max_packages else (lambda df: df)
    keys = names.select("key").distinct()
    parts = surfaces.select("surface_id", F.explode(X.path_tokens(F.lower("file"))).alias("part")).where(F.octet_length("part") >= MIN_PART)
    by_part = parts.select("part").distinct().join(few(keys), F.col("part").contains(F.col("key")) | F.col("key").contains(F.col("part")))
    via_path = parts.join(by_part, "part").select("surface_id", "key")
    heads = surfaces.select("surface_id", F.lower(F.substring("code", 1, 4096)).alias("head"))
    via_code = heads.join(few(keys.where((F.octet_length("key") < MAX_PACKAGE) & ~F.col("key").contains(":"))), F.col("head").contains(F.col("key"))).select("surface_id", "key")
    sets = via_path.unionByName(via_code).groupBy("surface_id").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    found = sets.select("keys").distinct().withColumn("key", F.explode("keys")).join(names, "key").groupBy("keys", "cve").agg(F.max("cvss").alias("cvss"))
    return sets, found


def join_sets(sets: DataFrame, by_set: DataFrame, n: int) -> DataFrame:
    """sets(surface_id, keys) with by_set(keys, ...), made from n rows. A few sets may hold all surfaces, so no task gets a whole one.

    By broadcast, over rows that are dealt to all tasks, while n is at most MAX_BROADCAST; else about CHUNK surfaces of a set are a group of their own,
    for which its side is repeated.
    """
    if n <= MAX_BROADCAST:
        spark = sets.sparkSession  # a number of tasks that isn't lowered for few bytes: rows become very many here
        tasks = max(spark.sparkContext.defaultParallelism * 4, int(spark.conf.get("spark.sql.shuffle.partitions")))
        return sets.repartition(tasks, "surface_id").join(F.broadcast(by_set), "keys")
    sizes = sets.groupBy("keys").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    own = sets.join(sizes, "keys").withColumn("chunk", F.pmod(F.xxhash64("surface_id"), F.col("chunks"))).drop("chunks")
    each = by_set.join(sizes, "keys").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).drop("chunks")
    return own.join(each, ["keys", "chunk"]).drop("chunk")


def match_packages(surfaces: DataFrame, packages: DataFrame, max_packages: int = 50_000) -> DataFrame:
    """surface_id, cve, cvss."""
    sets, found = match_sets(surfaces, packages, max_packages)
    return join_sets(sets, found, found.count()).select("surface_id", "cve", "cvss")


def best_of_sets(surfaces: DataFrame, packages: DataFrame, max_packages: int = 50_000) -> DataFrame:
    """O03, D27 of `match_packages`: the lists are made once for each set."""
    sets, found = match_sets(surfaces, packages, max_packages)
    best = best_cve(found.withColumnRenamed("keys", "surface_id")).withColumnRenamed("surface_id", "keys")
    return join_sets(sets, best, found.count()).drop("keys")


def best_cve(matches: DataFrame) -> DataFrame:
    """Per surface CVEs by CVSS, the best, and whether it is flagged."""
    g = matches.groupBy("surface_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("cvss")).alias("neg"), "cve"))).alias("a"))
    top = -F.col("a")[0]["neg"]
    return g.select("surface_id", F.array_join(F.transform("a", lambda x: x["cve"]), ",").alias("cves"), top.alias("top_cvss"), (top >= 7.0).alias("auto_flagged"), X.cve_severity(top).alias("severity"))


def ssvc(findings: DataFrame, exploited: DataFrame, epss: DataFrame) -> DataFrame:
    """D06, J13, J14, SRC09, SRC10: findings(finding_id, cwe, cvss, cve)."""
    f = findings.join(exploited.select("cve").distinct().withColumn("kev", F.lit(True)), "cve", "left").join(epss.groupBy("cve").agg(F.max("epss").alias("epss")), "cve", "left")
    return f.select("finding_id", X.exploitation(F.coalesce("kev", F.lit(False)), F.coalesce("epss", F.lit(0.0))).alias("exploitation"), X.automatable(F.col("cwe")).alias("automatable"), X.technical_impact(F.col("cwe"), F.col("cvss")).alias("technical_impact"))


def enclosing(findings: DataFrame, methods: DataFrame) -> DataFrame:
    """J15, as-of backward: findings(fid, file, line) with the method(file, line, method_id) of greatest line not after it.

    One pass over both, sorted by file and line, carrying the last method along: no pair of rows is ever made.
    """
    a = methods.select("file", "line", F.lit(0).alias("side"), "method_id", F.lit(None).cast(findings.schema["fid"].dataType).alias("fid"))
    b = findings.select("file", "line", F.lit(1).alias("side"), F.lit(None).cast(methods.schema["method_id"].dataType).alias("method_id"), "fid")
    w = Window.partitionBy("file").orderBy("line", "side", "method_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return a.unionByName(b).withColumn("found", F.last("method_id", ignorenulls=True).over(w)).where("side = 1").select("fid", F.col("found").alias("method_id"))


def fan_in_guard(attributions: DataFrame, limit: int = 3) -> DataFrame:
    """attributions(sink_name, surface_id) without sinks that more than ``limit`` surfaces claim."""
    fair = attributions.groupBy("sink_name").agg(F.count_distinct("surface_id").alias("n")).where(F.col("n") <= limit).select("sink_name")
    return attributions.join(fair, "sink_name", "left_semi")


def coverage(surfaces: DataFrame, attributed: DataFrame) -> DataFrame:
    """A15."""
    n = surfaces.agg(F.count_distinct("surface_id").alias("n_surfaces")).crossJoin(attributed.agg(F.count_distinct("surface_id").alias("n_attributed")))
    return n.withColumn("gap_percent", F.round(100 * X.ratio(F.col("n_surfaces") - F.col("n_attributed"), F.col("n_surfaces")), 6))


def path_summary(paths: DataFrame, with_steps: bool = True) -> DataFrame:
    """paths(surface_id, seq, sink_name, sink_file, sink_line, steps, sanitized).

    Sinks in order of their first path, number of steps, whether all is sanitized, and the first named sink's place. Partial aggregates, so
    that a surface with many paths is no large array; only ``with_steps``, whose result is one, collects all steps.
    """
    named = F.when(F.coalesce(F.col("sink_file"), F.lit("")) != "", F.struct("seq", "sink_name", "sink_file", "sink_line"))
    by_sink = paths.groupBy("surface_id", "sink_name").agg(F.min(F.struct("seq")).alias("first"), F.sum(F.coalesce(F.array_size("steps"), F.lit(0))).alias("n"), F.bool_and(F.coalesce("sanitized", F.lit(False))).alias("clean"), F.min(named).alias("named"))
    g = by_sink.groupBy("surface_id").agg(F.array_sort(F.collect_list(F.struct("first", "sink_name"))).alias("a"), F.sum("n").alias("n_steps"), F.bool_and("clean").alias("sanitized"), F.min("named").alias("named"))
    out = g.select("surface_id", F.transform("a", lambda x: x["sink_name"]).alias("sinks"), "n_steps", "sanitized", F.col("named.sink_file").alias("sink_file"), F.col("named.sink_line").alias("sink_line"))
    if not with_steps:
        return out
    steps = paths.groupBy(F.col("surface_id").alias("__id")).agg(F.array_sort(F.collect_list(F.struct("seq", "sink_name", "sink_file", "sink_line", "steps", "sanitized"))).alias("a"))
    return out.join(steps, F.col("surface_id").eqNullSafe(F.col("__id"))).select("surface_id", "sinks", F.flatten(F.transform("a", lambda x: x["steps"])).alias("steps"), "n_steps", "sanitized", "sink_file", "sink_line")


def filter_sinks(surfaces: DataFrame) -> DataFrame:
    """surfaces(sinks, call_path): sinks that occur in a call of the path; all of them if none does."""
    kept = F.filter("sinks", lambda s: F.exists("call_path", lambda c: c.contains(s)))
    return surfaces.withColumn("sinks", F.when(F.size(kept) == 0, F.col("sinks")).otherwise(kept))


def normalise_path(paths: DataFrame) -> DataFrame:
    """paths(source, sink, steps): a sink without file takes the source's, and one on line 0 that of the first step in its file."""
    file = F.when(X.text(F.col("sink.file")) == "", F.col("source.file")).otherwise(F.col("sink.file"))
    near = F.get(F.filter("steps", lambda s: (s["file"] == F.col("__file")) & (s["line"] > 0)), F.lit(0))["line"]
    p = paths.withColumn("__file", file)
    return p.withColumn("sink_line", F.when(F.col("sink.line") > 0, F.col("sink.line")).otherwise(F.coalesce(near, F.lit(0)))).withColumnRenamed("__file", "sink_file")
