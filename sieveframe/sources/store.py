"""Sinks: keyed tables as Parquet snapshots. A mutation is a DataFrame of the new state; ``commit`` writes it beside the old one and swaps.

All keyed writes shuffle once on the key; nothing is collected.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas

#: Columns that a conflict updates; the others keep what is stored.
FINDING_UPDATES = ("run_id", "severity", "confidence", "justification", "suppress_reason", "patch", "patch_status", "last_seen_at")


def upsert(stored: DataFrame, new: DataFrame, keys: tuple[str, ...], order: str | None = None) -> DataFrame:
    """U*, SNK01, SNK03, SNK07-SNK09: new rows replace stored ones of the same key; of several new ones the last by ``order`` counts."""
    tagged = stored.withColumn("__new", F.lit(0)).unionByName(new.select(*stored.columns, *([order] if order and order not in stored.columns else [])).withColumn("__new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc("__new"), *([F.desc(order)] if order else []))
    return tagged.withColumn("__n", F.row_number().over(w)).where("__n = 1").select(*stored.columns)


def insert_new(stored: DataFrame, new: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """SNK02, SNK10: stored rows stay, of new ones a row for each key that isn't stored."""
    fresh = new.dropDuplicates(list(keys)).join(stored.select(*keys), list(keys), "left_anti")
    return stored.unionByName(fresh.select(*stored.columns))


def insert_edges(stored: DataFrame, new: DataFrame) -> DataFrame:
    """SNK02: a blank type is CALL."""
    return insert_new(stored, new.withColumn("edge_type", F.when(F.coalesce("edge_type", F.lit("")) == "", F.lit("CALL")).otherwise(F.col("edge_type"))), schemas.KEYS["cpg_edges"])


def upsert_findings(stored: DataFrame, new: DataFrame, keep_empty_patch: bool = True) -> DataFrame:
    """SNK06: on conflict only FINDING_UPDATES change. An empty new patch keeps the stored one unless ``keep_empty_patch`` is off."""
    n = new.select(*[F.col(c).alias(f"n_{c}") for c in stored.columns])
    j = stored.join(n, stored.finding_id == n.n_finding_id, "full_outer")
    out = []
    for c in stored.columns:
        was_new = F.col("n_finding_id").isNotNull()
        fresh = F.col(f"n_{c}")
        if c in ("patch", "patch_status") and keep_empty_patch:
            fresh = F.coalesce(F.nullif(fresh, F.lit("")), F.col(c), fresh)
        value = F.when(was_new & (F.col("finding_id").isNull() | F.lit(c in FINDING_UPDATES)), fresh).otherwise(F.col(c))
        out.append(value.alias(c))
    return j.select(*out)


def upsert_projects(stored: DataFrame, new: DataFrame) -> DataFrame:
    """SNK04: a known root keeps its id and first_seen_at; language and last_scanned_at are the new ones."""
    old = stored.select("root_path", F.col("project_id").alias("o_id"), F.col("first_seen_at").alias("o_first"))
    n = new.join(old, "root_path", "left").withColumn("project_id", F.coalesce("o_id", "project_id")).withColumn("first_seen_at", F.coalesce("o_first", "first_seen_at"))
    return upsert(stored, n, ("root_path",))


def create_run(runs: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """SNK05: new runs with their defaults: started now, status running, mode default."""
    own = {"started_at": F.when(F.coalesce("started_at", F.lit(0)) == 0, F.lit(now)).otherwise(F.col("started_at")).cast("long"), "status": F.when(F.coalesce("status", F.lit("")) == "", F.lit("running")).otherwise(F.col("status")), "scan_mode": F.when(F.coalesce("scan_mode", F.lit("")) == "", F.lit("default")).otherwise(F.col("scan_mode"))}
    return runs.unionByName(new.select(*[own[c].alias(c) if c in own else F.col(c) for c in runs.columns]))


def finalize_run(runs: DataFrame, run_id: str, finished_at: int, files: int, findings: int, status: str = "complete") -> DataFrame:
    """SNK05: error if the run isn't there."""
    if runs.where(F.col("run_id") == run_id).isEmpty():
        raise KeyError(run_id)
    mine = F.col("run_id") == run_id
    new = {"finished_at": F.lit(finished_at).cast("long"), "files_scanned": F.lit(files), "findings_total": F.lit(findings), "status": F.lit(status)}
    return runs.select(*[F.when(mine, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in runs.columns])


def delete(stored: DataFrame, gone: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """SNK08, SNK11."""
    return stored.join(gone.select(*keys).distinct(), list(keys), "left_anti").select(*stored.columns)


def pending(items: DataFrame, scan: str, component: str) -> DataFrame:
    """SNK10."""
    return items.where((F.col("scan_id") == scan) & (F.col("component") == component) & (F.col("status") == "pending")).orderBy("created_at", "surface_id")


def mark(items: DataFrame, done: DataFrame, status: str, now: int) -> DataFrame:
    """SNK10, SNK12: rows whose key is in ``done`` get the status."""
    keys = schemas.KEYS["work_items"]
    hit = items.join(done.select(*keys).distinct().withColumn("__hit", F.lit(True)), list(keys), "left")
    return hit.select(*[F.when(F.col("__hit"), F.lit(status)).otherwise(F.col(c)).alias(c) if c == "status" else F.when(F.col("__hit"), F.lit(now).cast("long")).otherwise(F.col(c)).alias(c) if c == "updated_at" else F.col(c) for c in items.columns])


def finding_rows(findings: DataFrame, project: str, run: str, now: int) -> DataFrame:
    """F20, SNK13: scored findings as rows of the findings table."""
    own = {
        "finding_id": F.col("finding_id"), "project_id": F.lit(project), "run_id": F.lit(run), "file_path": F.col("path"), "line_start": F.col("line"), "line_end": F.col("line"), "cwe": F.col("cwe"), "severity": F.col("severity"), "confidence": F.col("conf"),
        "source_path": F.col("src"), "suppress_reason": F.col("suppress_reason"), "first_seen_at": F.lit(now).cast("long"), "last_seen_at": F.lit(now).cast("long"),
    }
    names = [part.split()[0] for part in schemas.TABLES["findings"].split(", ")]
    return findings.select(*[own.get(c, F.lit("")).alias(c) for c in names])


def persist(stored: dict[str, DataFrame], scored: DataFrame, project: str, run: str, now: int) -> dict[str, DataFrame]:
    """SNK13: the new states of findings, ssvc_scores and poe_results.

    Children are written only for findings that are: a row without an id is none. A score is written if any of its parts is set, a proof if it has a status.
    """
    good = scored.where("finding_id is not null and finding_id != ''")
    filled = lambda *names: F.concat(*[F.coalesce(F.col(n), F.lit("")) if n in scored.columns else F.lit("") for n in names]) != ""
    out = {"findings": upsert_findings(stored["findings"], finding_rows(good, project, run, now))}
    for name, marks in (("ssvc_scores", ("exploitation", "automatable", "technical_impact")), ("poe_results", ("poe_status",))):
        if name in stored:
            rows = good.where(filled(*marks))
            own = {"status": "poe_status", "confidence": "poe_confidence"} if name == "poe_results" else {}
            cols = [F.col(own.get(c, c)).alias(c) if own.get(c, c) in scored.columns else F.lit(None).cast(stored[name].schema[c].dataType).alias(c) for c in stored[name].columns]
            out[name] = upsert(stored[name], rows.select(*cols), schemas.KEYS[name])
    return out


def newest(findings: DataFrame, project: str, severity: str | None = None) -> DataFrame:
    """A project's findings, of one severity if given, the newest first."""
    mine = F.col("project_id") == project
    return findings.where(mine if severity is None else mine & (F.col("severity") == severity)).orderBy(F.desc("first_seen_at"), "finding_id")


def one(rows: DataFrame, **key: str) -> DataFrame:
    """the row with that key, as a table of one row; KeyError if there is none."""
    for name, value in key.items():
        rows = rows.where(F.col(name) == value)
    got = rows.limit(1)
    if got.isEmpty():
        raise KeyError(key)
    return got


def exists(rows: DataFrame, **key: str) -> bool:
    """A19."""
    for name, value in key.items():
        rows = rows.where(F.col(name) == value)
    return not rows.limit(1).isEmpty()


def commit(spark: SparkSession, state: DataFrame, root: str, name: str) -> str:
    """Write a snapshot beside the others and point to it; readers of the old one are undisturbed."""
    path = f"{root}/{name}/v-{uuid.uuid4().hex}"
    state.write.parquet(path)
    spark.createDataFrame([(path,)], "path string").coalesce(1).write.mode("overwrite").json(f"{root}/{name}/_current")
    return path


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The snapshot last committed, or an empty table."""
    from pyspark.errors import AnalysisException

    try:
        path = spark.read.schema("path string").json(f"{root}/{name}/_current").first()["path"]
    except AnalysisException:
        return spark.createDataFrame([], schemas.TABLES[name])
    return spark.read.schema(schemas.TABLES[name]).parquet(path)
