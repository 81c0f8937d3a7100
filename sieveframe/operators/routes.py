"""HTTP routes of handler methods, from the source around their declarations or from registrations in the same file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import contains_any

# Route declarations.
JAVA_MAPPING = r"@(Get|Post|Put|Delete|Patch|Request)Mapping\s*\(([^)]*)\)"
JAVA_PREFIX = r'@RequestMapping\s*\(\s*(?:value\s*=\s*)?"([^"]*)"'
JAVA_CLASS = r"\b(?:class|interface)\s+\w+"
JAVA_VERB = r"RequestMethod\.(GET|POST|PUT|DELETE|PATCH)"
FLASK = r"""@\w+\.route\s*\(\s*["']([^"']*)["'](?:.*methods\s*=\s*\[([^\]]*)\])?"""
FASTAPI = r"""@\w+\.(get|post|put|delete|patch)\s*\(\s*["']([^"']*)["']"""
VERB = r"""["'](GET|POST|PUT|DELETE|PATCH)["']"""
EXPRESS = r"""(?:app|router)\.(get|post|put|delete|patch)\s*\(\s*["']([^"']*)["']\s*,\s*(\w+)"""
GO = r'\.(HandleFunc|Handle|GET|POST|PUT|DELETE|PATCH|Get|Post|Put|Delete|Patch)\s*\(\s*"([^"]*)"\s*,\s*(\w+)'


def join_path(prefix: Column, path: Column) -> Column:
    """One slash between the two."""
    return F.concat(F.regexp_replace(prefix, "/$", ""), F.when((path != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path))


def above(lines: Column, line: Column, n: int) -> Column:
    """W03's kind of window: the n lines that end with a line (from 1), as one text."""
    start = F.greatest(line - n, F.lit(0))
    return F.array_join(F.slice(lines, start + 1, F.greatest(F.least(line, F.size(lines)) - start, F.lit(0))), "\n")


def annotated(lines: Column, line: Column, marks: tuple[str, ...]) -> Column:
    """Whether one of the marks stands on the lines from line - 6 (from 0) up to line + 4, that one left out."""
    start = F.greatest(line - 6, F.lit(0))
    part = F.slice(lines, start + 1, F.greatest(F.least(line + 4, F.size(lines)) - start, F.lit(0)))
    return F.coalesce((line > 0) & F.exists(part, lambda x: contains_any(x, marks)), F.lit(False))


def class_line(lines: Column, line: Column) -> Column:
    """The last line (from 1) up to the method's that declares a class or interface; null without."""
    at = F.filter(F.transform(F.slice(lines, 1, F.greatest(F.least(line, F.size(lines)), F.lit(0))), lambda x, k: F.when(x.rlike(JAVA_CLASS), k + 1)), lambda k: k.isNotNull())
    return F.array_max(at)


def _verb(name: Column) -> Column:
    return F.when(name.isin("HandleFunc", "Handle"), F.lit("GET")).otherwise(F.upper(name))


def _registered(text: Column, rx: str, name: Column) -> Column:
    """(verb, path) of the first registration whose handler has the name."""
    all_ = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(rx), F.lit(k)).alias(f"g{k}") for k in (1, 2, 3)])
    hit = F.get(F.filter(all_, lambda m: m["g3"] == name), F.lit(0))
    return F.when(hit.isNotNull(), F.struct(_verb(hit["g1"]).alias("verb"), hit["g2"].alias("path")))


def routes(methods: DataFrame, files: DataFrame) -> DataFrame:
    """methods(node_id, name, file, line) and files(path, language, text) → node_id, verb, route of those that have one.

    Java and Python handlers are declared below their annotation, the others are registered by name somewhere in their file.
    """
    j = methods.join(files.select(F.col("path").alias("file"), "language", "text"), "file").withColumn("lines", F.split("text", "\n"))
    j = j.withColumn("near", above(F.col("lines"), F.col("line"), 4)).withColumn("class_at", class_line(F.col("lines"), F.col("line")))
    name, args = F.regexp_extract("near", JAVA_MAPPING, 1), F.regexp_extract("near", JAVA_MAPPING, 2)
    path = F.regexp_extract(args, '"([^"]*)"', 1)
    asked = F.regexp_extract(args, JAVA_VERB, 1)
    head = above(F.col("lines"), F.col("class_at"), 5)
    joined = F.when(F.col("class_at").isNotNull() & head.rlike(JAVA_PREFIX), join_path(F.regexp_extract(head, JAVA_PREFIX, 1), path)).otherwise(path)
    slash = lambda c: F.when(c == "", F.lit("/")).otherwise(c)
    java = F.when(name != "", F.struct(F.when(name != "Request", F.upper(name)).when(asked != "", asked).otherwise(F.lit("GET")).alias("verb"), slash(joined).alias("path")))
    fast = F.when(F.col("near").rlike(FASTAPI), F.struct(F.upper(F.regexp_extract("near", FASTAPI, 1)).alias("verb"), slash(F.regexp_extract("near", FASTAPI, 2)).alias("path")))
    listed = F.regexp_extract(F.regexp_extract("near", FLASK, 2), VERB, 1)
    flask = F.when(F.col("near").rlike(FLASK), F.struct(F.when(listed != "", listed).otherwise(F.lit("GET")).alias("verb"), slash(F.regexp_extract("near", FLASK, 1)).alias("path")))
    found = (
        F.when(F.col("language") == "java", java).when(F.col("language") == "python", F.coalesce(fast, flask))
        .when(F.col("language") == "js", _registered(F.col("text"), EXPRESS, F.col("name"))).when(F.col("language") == "go", _registered(F.col("text"), GO, F.col("name")))
    )
    return j.withColumn("r", found).where("r is not null").select("node_id", F.col("r.verb").alias("verb"), F.col("r.path").alias("route"))
