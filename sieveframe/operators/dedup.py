"""Finding dedup and scoring: history, exact key, optional similarity gates, scores, suppression.

Findings: seq BIGINT (input order, unique), path, cwe, line, conf, src (PATTERN, SEMANTIC, BOTH or other), severity,
pinned BOOLEAN, exploitable BOOLEAN, cvss DOUBLE, cve STRING and whatever else the caller carries; ``with_defaults`` adds what is missing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import expressions as X

MAX_CHAIN = 100
TILE, STRIP = 2048, 256  # vectors of a tile, and rows of it that meet another tile at once
DEFAULTS = {"finding_id": None, "severity": "", "pinned": False, "exploitable": False, "cvss": 0.0, "cve": "", "suppress_reason": "", "matched_code": ""}


def with_defaults(findings: DataFrame) -> DataFrame:
    out = findings
    for name, value in DEFAULTS.items():
        if name not in findings.columns:
            out = out.withColumn(name, X.finding_id(F.col("cwe"), F.col("path"), F.col("line")) if name == "finding_id" else F.lit(value))
        elif value is not None:
            out = out.withColumn(name, F.coalesce(name, F.lit(value)))
    return out


def without_history(findings: DataFrame, stored: DataFrame) -> DataFrame:
    """Drop what a stored row equals in id, severity, confidence and reason."""
    same = stored.select(F.col("finding_id"), F.col("severity"), F.col("confidence").alias("conf"), F.col("suppress_reason")).distinct()
    return findings.join(same, ["finding_id", "severity", "conf", "suppress_reason"], "left_anti").select(*findings.columns)


def merge_exact(findings: DataFrame) -> DataFrame:
    """Gate 1 (D03, D04, A07): one row for each (cwe, path, line), with n_merged.

    The winner is the most confident, the first of equals. With at most one pinned row and known sources the fold is a set
    function, which the map side can combine; groups with more pins, or with other sources among crossing ones, are folded in input order.
    """
    key = X.gate_key(F.col("cwe"), F.col("path"), F.col("line"))
    rows = findings.withColumn("__key", key)
    both = F.bool_or(F.col("src") == "BOTH")
    cross = F.bool_or(F.col("src") == "PATTERN") & F.bool_or(F.col("src") == "SEMANTIC")
    groups = rows.groupBy("__key").agg(
        F.max_by(F.struct(*[F.col(c) for c in findings.columns]), F.struct(F.col("conf"), -F.col("seq"))).alias("w"),
        F.count("*").alias("n"), (cross | both).alias("crossed"), F.count_if("pinned").alias("pins"), F.bool_or(~F.col("src").isin("PATTERN", "SEMANTIC", "BOTH")).alias("others"), F.max_by("severity", F.when(F.col("pinned"), F.col("seq"))).alias("pin_sev"),
    )
    out = groups.withColumn("src", F.when((F.col("n") > 1) & F.col("crossed"), F.lit("BOTH")).otherwise(F.col("w.src")))
    out = out.withColumn("pinned", F.col("pins") > 0).withColumn("sev", F.when(F.col("pins") > 0, F.col("pin_sev")).otherwise(F.col("w.severity")))
    special = {"src": F.col("src"), "pinned": F.col("pinned"), "severity": F.col("sev")}
    whole = lambda df: df.select(*[special.get(c, F.col(f"w.{c}")).alias(c) for c in findings.columns], F.col("n").alias("n_merged"))
    if findings.where(F.col("pinned") | ~F.col("src").isin("PATTERN", "SEMANTIC", "BOTH")).isEmpty():
        return whole(out)  # no group can need the fold: one shuffle of the rows is all
    many = rows.groupBy("__key").agg(F.count_if("pinned").alias("pins"), F.bool_or(~F.col("src").isin("PATTERN", "SEMANTIC", "BOTH")).alias("others"), (cross | both).alias("crossed")).where("pins > 1 or (others and crossed)").select("__key")
    folded = rows.join(many, "__key").groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("seq", F.col("conf").alias("c"), F.col("src").alias("s"), F.col("pinned").alias("p"), F.col("severity").alias("sev")))).alias("a"))
    fold = """aggregate(slice(a, 2, greatest(size(a) - 1, 0)), struct(a[0].c as c, a[0].s as s, a[0].p as p, a[0].sev as sev), (w, r) -> struct(
      if(r.c > w.c, r.c, w.c) as c,
      case when 'BOTH' in (w.s, r.s) or (w.s in ('PATTERN', 'SEMANTIC') and r.s in ('PATTERN', 'SEMANTIC') and w.s <> r.s) then 'BOTH' when r.c > w.c then r.s else w.s end as s,
      w.p or r.p as p, case when r.c > w.c then if(w.p, w.sev, r.sev) else if(r.p, r.sev, w.sev) end as sev))"""
    out = out.join(folded.select("__key", F.expr(fold).alias("f")), "__key", "left").withColumn("sev", F.coalesce("f.sev", "sev")).withColumn("src", F.coalesce("f.s", "src"))
    return whole(out)


def scored(findings: DataFrame, exploited: Column | None = None, epss: Column | None = None, cfg: Config = Config()) -> DataFrame:
    """Conf after boosts and floors, and its severity unless pinned. exploited, epss: columns of a lookup, if any."""
    f = findings.withColumn("exploitation", X.exploitation(exploited if exploited is not None else F.lit(False), epss if epss is not None else F.lit(0.0), cfg.epss_active, cfg.epss_poc))
    f = f.withColumn("automatable", X.automatable(F.col("cwe"))).withColumn("technical_impact", X.technical_impact(F.col("cwe"), F.col("cvss")))
    conf = F.when((F.col("src") == "BOTH") & (F.col("conf") < 0.92), F.least(F.col("conf") + cfg.cross_path_boost, F.lit(1.0))).otherwise(F.col("conf"))
    f = f.withColumn("conf", conf)
    f = f.withColumn("conf", F.when(F.col("cvss") > 0, F.greatest(F.col("conf"), F.col("cvss") / 10)).otherwise(F.col("conf")))
    reach = F.col("exploitable") | (F.col("src") == "BOTH")
    f = f.withColumn("conf", F.when(reach & (F.col("exploitation") == "Active"), F.least(F.col("conf") + cfg.active_boost, F.lit(1.0))).otherwise(F.col("conf")))
    f = f.withColumn("conf", F.when(reach & (F.col("automatable") == "Yes"), F.least(F.col("conf") + cfg.automatable_boost, F.lit(1.0))).otherwise(F.col("conf")))
    f = f.withColumn("conf", F.when(F.col("src") == "PATTERN", F.greatest(F.col("conf"), F.lit(cfg.pattern_floor))).otherwise(F.col("conf")))
    return f.withColumn("severity", F.when(F.col("pinned"), F.col("severity")).otherwise(X.severity(F.col("conf"))))


def suppressed(findings: DataFrame) -> DataFrame:
    """Test files, then framework files; even pinned ones."""
    why = F.when(X.is_test_file(F.col("path")), F.lit("test_file")).when(X.is_framework_safe(F.col("path")), F.lit("framework_safe"))
    return findings.withColumn("__why", why).withColumn("suppress_reason", F.coalesce("__why", "suppress_reason")).withColumn("severity", F.when(F.col("__why").isNotNull(), F.lit("SUPPRESSED")).otherwise(F.col("severity"))).drop("__why")


def first_rule(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """The first suppression rule (rule_idx) whose selectors all match, as rule_reason; null without one.

    rules(rule_idx, id, path, cwe, reason): an empty selector matches everything; paths are globs tried on the whole path
    and the base name; cwe ignores case. The rules are a hand-written list: up to MAX_CHAIN of them become one chain of conditions, whose
    patterns are compiled once; more are joined.
    """
    own = rules.select("rule_idx", "id", "path", "cwe", "reason").orderBy("rule_idx").limit(MAX_CHAIN + 1).collect()
    if len(own) <= MAX_CHAIN:
        path, chain = F.col("path"), []
        for r in own:
            selectors = [F.col("finding_id") == r.id] * bool(r.id) + [F.upper("cwe") == r.cwe.upper()] * bool(r.cwe) + [X.glob_match(path, (r.path,))] * bool(r.path)
            chain.append((reduce(lambda a, b: a & b, selectors, F.lit(True)), F.lit(r.reason)))
        return findings.withColumn("rule_reason", X.choose(chain, F.lit(None).cast("string")))
    glob = F.concat(F.lit("^"), F.replace(F.replace(F.regexp_replace("rp", r"([.^$+()\[\]{}|\\])", r"\\$1"), F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]")), F.lit("$"))
    r = rules.select("rule_idx", F.col("id").alias("rid"), F.col("path").alias("rp"), F.upper("cwe").alias("rc"), "reason").withColumn("rx", glob)
    hit = ((F.col("rid") == "") | (F.col("rid") == F.col("finding_id"))) & ((F.col("rc") == "") | (F.col("rc") == F.upper("cwe"))) & ((F.col("rp") == "") | F.expr("path rlike rx") | F.expr("substring_index(path, '/', -1) rlike rx"))
    best = findings.select("seq", "finding_id", "path", "cwe").join(r, hit).groupBy("seq").agg(F.min_by("reason", "rule_idx").alias("rule_reason"))
    return findings.join(best, "seq", "left")


def apply_rules(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Only what isn't suppressed yet."""
    f = first_rule(findings, rules)
    on = (F.col("severity") != "SUPPRESSED") & F.col("rule_reason").isNotNull()
    return f.withColumn("suppress_reason", F.when(on, F.col("rule_reason")).otherwise(F.col("suppress_reason"))).withColumn("severity", F.when(on, F.lit("SUPPRESSED")).otherwise(F.col("severity"))).drop("rule_reason")


def run(findings: DataFrame, stored: DataFrame | None = None, rules: DataFrame | None = None, exploited: DataFrame | None = None, epss: DataFrame | None = None, cfg: Config = Config()) -> DataFrame:
    """The gates in order. exploited(cve), epss(cve, epss): reference tables."""
    f = with_defaults(findings)
    if stored is not None:
        f = without_history(f, stored)
    f = merge_exact(f)
    if exploited is not None:
        f = f.join(exploited.select(F.col("cve").alias("__x")).distinct(), F.col("cve") == F.col("__x"), "left").withColumn("__known", F.col("__x").isNotNull()).drop("__x")
    if epss is not None:
        f = f.join(epss.groupBy("cve").agg(F.max("epss").alias("__epss")), "cve", "left")
    f = scored(f, F.col("__known") if exploited is not None else None, F.coalesce("__epss", F.lit(0.0)) if epss is not None else None, cfg)
    f = suppressed(f.drop("__known", "__epss"))
    return f if rules is None else apply_rules(f, rules)


def statistics(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row of n_in, n_out, n_merged, n_suppressed."""
    return before.agg(F.count("*").alias("n_in")).crossJoin(after.agg(F.count("*").alias("n_out"), F.coalesce(F.sum(F.col("n_merged") - 1), F.lit(0)).cast("long").alias("n_merged"), F.count_if(F.col("severity") == "SUPPRESSED").alias("n_suppressed")))


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed component by component as X.cosine sums."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def _pairs_between(a: np.ndarray, b: np.ndarray, near: float, upper: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of a, row of b, cosine) of pairs of equally long vectors that reach ``near``, in strips; upper: b is a, each pair once.

    A matrix product finds what may reach it; these are counted again exactly. What isn't a number reaches everything, as in SQL.
    """
    own, other = _dots(a, a), _dots(b, b)
    for at in range(0, len(a), STRIP):
        norm = own[at : at + STRIP, None] * other[None, :]
        maybe = ~(a[at : at + STRIP] @ b.T < (near - 1e-9) * np.sqrt(norm)) | ~((norm > 1e-200) & (norm < np.inf))
        i, j = np.nonzero(np.triu(maybe, at + 1) if upper else maybe)
        norm = norm[i, j]
        cosine = np.divide(_dots(a[i + at], b[j]), np.sqrt(norm), out=np.zeros(len(i)), where=norm != 0)
        kept = ~(cosine < near)
        yield i[kept] + at, j[kept], cosine[kept]


def _unit_pairs(unit: pa.Table, near: float) -> pa.Table:
    """id_a, id_b, cosine of two tiles, or within one."""
    ids, vectors, tile = unit["id"].combine_chunks(), unit["v"].combine_chunks(), unit["tile"].to_numpy()
    length = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    whole = np.ones(len(length), dtype=bool)  # without null components
    whole[pc.list_parent_indices(vectors).to_numpy(zero_copy_only=False)[pc.list_flatten(vectors).is_null().to_numpy(zero_copy_only=False)]] = False
    low, high = tile.min(), tile.max()
    rows = {(t, n): np.flatnonzero((tile == t) & (length == n)) for t in {low, high} for n in np.unique(length)}
    matrix = lambda r, n: pc.list_flatten(vectors.take(pa.array(r))).to_numpy(zero_copy_only=False).reshape(len(r), n)
    found = [(np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0),)]
    with np.errstate(all="ignore"):
        for n in np.unique(length):
            a, b = (r[whole[r]] for r in (rows[low, n], rows[high, n]))
            if n and len(a) and len(b):
                found += [(a[i], b[j], c) for i, j, c in _pairs_between(matrix(a, n), matrix(b, n), near, low == high)]
            if near <= 0:  # empty vectors and those of another length have cosine 0
                a = rows[low, n]
                for m in np.unique(length):
                    b = rows[high, m]
                    if m != n or not n:
                        i, j = np.repeat(a, len(b)), np.tile(b, len(a))
                        once = i < j if low == high else np.ones(len(i), dtype=bool)
                        found.append((i[once], j[once], np.zeros(int(once.sum()))))
    i, j, cosine = (np.concatenate(x) for x in zip(*found, strict=True))
    names = ids.to_numpy(zero_copy_only=False)
    a, b = names[i], names[j]
    apart = a != b
    a, b, cosine = a[apart], b[apart], cosine[apart]
    return pa.table({"id_a": pa.array(np.where(a < b, a, b), type=ids.type), "id_b": pa.array(np.where(a < b, b, a), type=ids.type), "cosine": cosine})


def similar_pairs(vectors: DataFrame, block: str, same: float, near: float) -> DataFrame:
    """D11, off by default: pairs within a block whose cosine reaches ``near``; kind says whether it reaches ``same``.

    All pairs are compared, as is the job. A block is dealt into tiles of about TILE vectors, and each pair of tiles is a unit of its own: any
    block spreads over the cluster, and a task holds two tiles and what they find.
    """
    v = vectors.select("id", F.col(block).alias("block"), F.col("v").cast("array<double>").alias("v")).dropna()
    sizes = v.groupBy("block").agg(F.ceil(F.count("*") / TILE).alias("tiles"))
    dealt = v.join(sizes, "block").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    units = dealt.select("block", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "id", "v").groupBy("block", "low", "high")

    def pairs(unit: pa.Table) -> pa.Table:
        return _unit_pairs(unit, near)

    kind = vectors.schema["id"].dataType.simpleString()
    return units.applyInArrow(pairs, f"id_a {kind}, id_b {kind}, cosine double").withColumn("kind", F.when(F.col("cosine") >= same, F.lit("same")).otherwise(F.lit("near")))
