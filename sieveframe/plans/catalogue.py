"""The registered queries and, for each that SQL can express, its equivalent for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import changes, contracts, dedup, enrich, graph, reconcile, reports, targeting, taxonomy, text
from ..sources import readers, store
from .adapters import Tables, with_adapters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of Tables under its name, with the oracle's text."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = with_adapters(sql)
        return f

    return add


def _d(x: str) -> str:
    return f"round({x}, 6)"


# Gate 1 as sets, then scores and suppression, shared by several oracles.
AUTO = ", ".join(f"'CWE-{n}'" for n in X.AUTOMATABLE)
TOTAL = ", ".join(f"'CWE-{k}'" for k, v in X.IMPACT.items() if v == "Total")
PARTIAL = ", ".join(f"'CWE-{k}'" for k, v in X.IMPACT.items() if v == "Partial")
BAND = "case when {c} >= 0.92 then 'BLOCK' when {c} >= 0.75 then 'HIGH' when {c} >= 0.6 then 'MEDIUM' when {c} >= 0.3 then 'LOW' else 'SUPPRESSED' end"
MERGED = """
grouped as (
  select cwe, path, line, count(*) as n_merged, bool_or(src = 'PATTERN') and bool_or(src = 'SEMANTIC') as crossed from findings group by cwe, path, line),
ranked as (
  select *, row_number() over (partition by cwe, path, line order by conf desc, seq) as rn from findings),
merged as (
  select r.seq, r.path, r.cwe, r.line, r.conf, case when g.n_merged > 1 and g.crossed then 'BOTH' else r.src end as src, r.exploitable, r.cvss, r.cve, g.n_merged
  from ranked r join grouped g using (cwe, path, line) where rn = 1)"""
SCORED = f"""{MERGED},
s1 as (select *, case when src = 'BOTH' and conf < 0.92 then least(conf + 0.15, 1.0) else conf end as c1 from merged),
s2 as (select *, case when cvss > 0 then greatest(c1, cvss / 10) else c1 end as c2 from s1),
s3 as (select *, case when (exploitable or src = 'BOTH') and cwe in ({AUTO}) then least(c2 + 0.05, 1.0) else c2 end as c3 from s2),
s4 as (select *, case when src = 'PATTERN' then greatest(c3, 0.6) else c3 end as c4 from s3),
scored as (
  select seq, path, cwe, line, src, n_merged, cvss, cve, c4 as conf, case when path like '%\\_test.go' escape '\\' then 'SUPPRESSED' else {BAND.format(c="c4")} end as severity,
    case when path like '%\\_test.go' escape '\\' then 'test_file' else '' end as suppress_reason from s4)"""


def _scored(t: Tables) -> DataFrame:
    return dedup.run(t.findings)


@query(f"with {SCORED} select severity, count(*) as n, bool_or(severity in ('BLOCK', 'HIGH')) as fails from scored group by grouping sets ((severity), ())")
def a03_scan_summary(t: Tables) -> DataFrame:
    return reports.summary(_scored(t))


@query(f"with {MERGED} select seq, path, cwe, line, conf, src, n_merged from merged")
def d04_exact_merge(t: Tables) -> DataFrame:
    return dedup.merge_exact(dedup.with_defaults(t.findings)).select("seq", "path", "cwe", "line", "conf", "src", "n_merged")


@query(f"with {SCORED} select seq, sha256(concat(cwe, ':', path, ':', cast(line as varchar))) as finding_id, path, cwe, src, round(conf, 6) as conf, severity, suppress_reason from scored")
def d09_scored_findings(t: Tables) -> DataFrame:
    return _scored(t).select("seq", "finding_id", "path", "cwe", "src", F.round("conf", 6).alias("conf"), "severity", "suppress_reason")


@query(f"with {SCORED}, b as (select count(*) as n_in from findings) select n_in, count(*) as n_out, cast(sum(n_merged - 1) as bigint) as n_merged, count(*) filter (severity = 'SUPPRESSED') as n_suppressed from scored, b group by n_in")
def a26_dedup_statistics(t: Tables) -> DataFrame:
    return dedup.statistics(t.findings, _scored(t))


@query(f"select strftime(ts, '%Y-%m-%d') as run_day, case when value >= 80 then 'BLOCK' when value >= 40 then 'HIGH' when value >= 15 then 'MEDIUM' else 'LOW' end as severity, count(*) as n from events group by all")
def a01_severity_by_run(t: Tables) -> DataFrame:
    v = F.col("value")
    sev = X.choose([(v >= 80, F.lit("BLOCK")), (v >= 40, F.lit("HIGH")), (v >= 15, F.lit("MEDIUM"))], F.lit("LOW"))
    return t.events.select(F.date_format("ts", "yyyy-MM-dd").alias("run_day"), sev.alias("severity")).groupBy("run_day", "severity").agg(F.count("*").alias("n"))


@query("select user_id, count(*) filter (event_type = 'view') as pending, count(*) filter (event_type in ('purchase', 'signup')) as done, count(*) filter (event_type = 'error') as error from events group by user_id")
def a02_work_item_counts(t: Tables) -> DataFrame:
    e = F.col("event_type")
    return t.events.groupBy("user_id").agg(F.count_if(e == "view").alias("pending"), F.count_if(e.isin("purchase", "signup")).alias("done"), F.count_if(e == "error").alias("error"))


@query(f"with {SCORED} select src, severity, count(*) as n from scored group by src, severity")
def a04_counts_by_source(t: Tables) -> DataFrame:
    return _scored(t).groupBy("src", "severity").agg(F.count("*").alias("n"))


RANKED = f"""{SCORED}, placed as (select *, row_number() over (order by case severity when 'BLOCK' then 0 when 'HIGH' then 1 when 'MEDIUM' then 2 when 'LOW' then 3 else 4 end, conf desc, seq) as position from scored)"""


@query(f"with {RANKED} select seq, severity, round(conf, 6) as conf, position from placed")
def o02_report_order(t: Tables) -> DataFrame:
    return reports.ordered(_scored(t)).select("seq", "severity", F.round("conf", 6).alias("conf"), "position")


@query(f"with {RANKED} select path, count(*) as n, min(position) as first_position from placed group by path")
def a05_file_groups(t: Tables) -> DataFrame:
    return reports.file_groups(_scored(t))


@query(f"with {SCORED} select case when bool_or(severity in ('BLOCK', 'HIGH')) then 1 else 0 end as exit_code from scored")
def a25_exit_code(t: Tables) -> DataFrame:
    return reports.exit_code(_scored(t))


@query("select seq from findings f where not exists (select 1 from findings g where g.seq % 2 = 1 and f.seq % 2 = 0 and g.cwe = f.cwe and g.path = f.path and g.line = f.line + 1 and g.conf = f.conf) and f.seq % 2 = 0")
def j06_historical_no_op(t: Tables) -> DataFrame:
    f = dedup.with_defaults(t.findings)
    new = f.where("seq % 2 = 0").withColumn("finding_id", X.finding_id(F.col("cwe"), F.col("path"), F.col("line") + 1))
    old = f.where("seq % 2 = 1").select("finding_id", "severity", F.col("conf").alias("confidence"), "suppress_reason")
    return dedup.without_history(new, old).select("seq")


@query("""with c as (select file_path, sha256(text) as h from current_files), p as (select file_path, sha256(text) as h from previous)
select file_path, case when p.h is null then 'added' when c.h is null then 'removed' else 'modified' end as change_type from c full join p using (file_path) where c.h is null or p.h is null or c.h <> p.h""")
def j07_file_diff(t: Tables) -> DataFrame:
    h = lambda df: df.select("file_path", F.sha2("text", 256).alias("content_hash"))
    return changes.diff(h(t.current_files), h(t.previous))


@query("""with last as (select *, row_number() over (partition by user_id, event_type order by event_id desc) as n, min(event_id) over (partition by user_id, event_type) as first_event from events)
select concat(cast(user_id as varchar), '/', event_type) as finding_id, concat('run', cast(event_id as varchar)) as run_id, concat('line', cast(first_event as varchar)) as matched_code, round(value, 6) as confidence from last where n = 1""")
def snk06_finding_upsert(t: Tables) -> DataFrame:
    """First and last events by user and type as two scans: the first stored, the last upserted."""
    names = [c.split()[0] for c in store.schemas.TABLES["findings"].split(", ")]
    e = t.events.withColumn("finding_id", F.concat_ws("/", F.col("user_id").cast("string"), "event_type"))
    keyed = lambda pick: e.groupBy("finding_id").agg(pick(F.struct("event_id", "value", "ts")).alias("x")).select("finding_id", "x.*")
    own = {"finding_id": F.col("finding_id"), "run_id": F.concat(F.lit("run"), F.col("event_id").cast("string")), "matched_code": F.concat(F.lit("line"), F.col("event_id").cast("string")), "confidence": F.col("value")}
    rows = lambda df: df.select(*[own.get(c, F.lit("")).alias(c) for c in names])
    return store.upsert_findings(rows(keyed(F.min)), rows(keyed(F.max))).select("finding_id", "run_id", "matched_code", F.round("confidence", 6).alias("confidence"))


@query("select node_id, name, case when line >= 25 then concat(code, '!') else code end as code from nodes")
def snk01_node_upsert(t: Tables) -> DataFrame:
    n = t.nodes.select("node_id", "name", "code")
    return store.upsert(n, n.join(t.nodes.where("line >= 25").select("node_id"), "node_id", "left_semi").withColumn("code", F.concat("code", F.lit("!"))), ("node_id",))


@query("select from_id, to_id, edge_type from edges union select to_id, from_id, 'CALL' from edges")
def snk02_edge_insert(t: Tables) -> DataFrame:
    own = lambda df: df.select(F.lit("p").alias("project_id"), F.lit("v").alias("cpg_version"), "from_id", "to_id", "edge_type")
    back = graph.reversed_edges(t.edges).withColumn("edge_type", F.lit(""))
    return store.insert_edges(own(t.edges), own(back)).select("from_id", "to_id", "edge_type")


@query("select file_path from current_files where file_path not in (select file_path from previous where file_path like '%3')")
def snk08_state_delete(t: Tables) -> DataFrame:
    return store.delete(t.current_files.select("file_path"), t.previous.where(F.col("file_path").endswith("3")), ("file_path",))


ROOT = "(select from_id from edges group by from_id order by count(*) desc, from_id limit 1)"


def _graph(t: Tables) -> graph.CodeGraph:
    return graph.CodeGraph(t.nodes, t.edges)


def _root(t: Tables) -> str:
    return t.edges.groupBy("from_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "from_id").first()["from_id"]


@query(f"select n.node_id, n.name, n.file, n.line from edges e join nodes n on n.node_id = e.from_id where e.to_id = (select to_id from edges group by to_id order by count(*) desc, to_id limit 1)")
def j01_callers(t: Tables) -> DataFrame:
    top = t.edges.groupBy("to_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "to_id").first()["to_id"]
    return _graph(t).callers(top).select("node_id", "name", "file", "line")


@query(f"select n.node_id, n.name, n.file, n.line from edges e join nodes n on n.node_id = e.to_id where e.from_id = {ROOT}")
def j02_callees(t: Tables) -> DataFrame:
    return _graph(t).callees(_root(t)).select("node_id", "name", "file", "line")


@query("select from_id, count(distinct to_id) as n_callees, string_agg(distinct to_id, ',' order by to_id) as callees from edges group by from_id")
def a23_call_graph(t: Tables) -> DataFrame:
    return _graph(t).adjacency().withColumn("callees", F.array_join("callees", ","))


@query("select to_id, count(distinct from_id) as n_callers from edges group by to_id having count(distinct from_id) >= 2")
def a24_hubs(t: Tables) -> DataFrame:
    return _graph(t).hubs(2)


@query("select node_id, name from nodes where node_type = 'METHOD'")
def f01_nodes_by_type(t: Tables) -> DataFrame:
    return _graph(t).by_type("METHOD").select("node_id", "name")


@query("select node_id, name from nodes where file = 'src/Brand1.java' and node_type = 'METHOD'")
def f02_nodes_by_file(t: Tables) -> DataFrame:
    return _graph(t).by_file("src/Brand1.java").select("node_id", "name")


@query("select node_id, name from nodes where node_type = 'METHOD' order by node_id limit 500 offset 500")
def o08_page(t: Tables) -> DataFrame:
    return _graph(t).page("METHOD", 500, 500).select("node_id", "name")


BOTH = "both_ways as (select from_id as a, to_id as b from edges union select to_id, from_id from edges)"


@query(f"with recursive {BOTH}, near(id, d) as (select {ROOT}, 0 union select b, d + 1 from near join both_ways on id = a where d < 2) select node_id, name, min(d) as depth from near join nodes on node_id = id where d > 0 and id <> {ROOT} group by node_id, name")
def g03_neighbours(t: Tables) -> DataFrame:
    return _graph(t).neighbours(_root(t), 2).select("node_id", "name", "depth")


SEEDS = "select from_id as id from edges where from_id like '%7'"


@query(f"with recursive r(id) as ({SEEDS} union select to_id from r join edges on id = from_id) select id from r")
def g01_reach_forward(t: Tables) -> DataFrame:
    return graph.reachable(t.edges, t.sql(SEEDS))


@query(f"with recursive r(id, d) as (select distinct id, 0 from ({SEEDS}) s union select to_id, d + 1 from r join edges on id = from_id where d < 30) select id, min(d) as depth from r group by id")
def g04_reach_depths(t: Tables) -> DataFrame:
    return graph.depths(t.edges, t.sql(SEEDS))


@query("select file, count(*) as n from nodes join (select distinct e.to_id as i from edges e join nodes m on m.node_id = e.from_id where m.file = 'src/Brand1.java' and m.node_type = 'METHOD' union select distinct e.from_id from edges e join nodes m on m.node_id = e.to_id where m.file = 'src/Brand1.java' and m.node_type = 'METHOD') x on i = node_id where node_type = 'METHOD' and file <> 'src/Brand1.java' group by file")
def j17_change_expansion(t: Tables) -> DataFrame:
    g = _graph(t)
    changed = t.spark.createDataFrame([("src/Brand1.java",)], "file string")
    own = g.by_file("src/Brand1.java").select(F.col("node_id").alias("id"))
    calls = t.edges.select("from_id", "to_id")
    near = calls.unionByName(graph.reversed_edges(calls)).join(own, F.col("from_id") == F.col("id"), "left_semi").select(F.col("to_id").alias("node_id")).distinct()
    files = g.expand(changed).where("file <> 'src/Brand1.java'")
    return g.by_type("METHOD").join(near, "node_id", "left_semi").join(files, "file", "left_semi").groupBy("file").agg(F.count("*").alias("n"))


BITS = """bits as (select path, (case when text like '%springframework.web%' then 2 else 0 end) + (case when text like '%java.sql%' or text like '%org.hibernate%' then 4 else 0 end)
  + (case when text like '%io.jsonwebtoken%' then 8 else 0 end) + (case when text like '%org.hibernate%' then 16 else 0 end) as bits from files)"""


@query(f"with {BITS} select path, bits from bits where bits > 0")
def a18_boundary_bits(t: Tables) -> DataFrame:
    return targeting.boundary_bits(t.files)


SURFACES = f"""{BITS},
m as (select node_id, name, file, code, coalesce(bits, 0) as bits from nodes left join bits on path = file where node_type = 'METHOD'),
fwd(id, d) as (select node_id, 0 from m where bits & 2 > 0 union select to_id, d + 1 from fwd join edges on id = from_id where d < 30),
f as (select id, min(d) as depth from fwd group by id),
bwd(id) as (select node_id from m where bits & 4 > 0 union select from_id from bwd join edges on id = to_id),
aut(id) as (select node_id from m where bits & 8 > 0 union select from_id from aut join edges on id = to_id),
sto(id) as (select node_id from m where bits & 16 > 0 union select from_id from sto join edges on id = to_id),
surf as (select node_id as surface_id, name, file, depth, case when bits & 8 > 0 then 'auth_boundary'
  when node_id not in (select id from aut) and (lower(name) like '%item%' or lower(name) like '%order%' or lower(file) like '%item%') then 'idor_candidate' else 'external_input' end as kind
  from m join f on f.id = node_id where node_id in (select id from bwd)),
second as (select id as surface_id from sto where id in (select id from bwd))"""


def _methods(t: Tables) -> DataFrame:
    return t.nodes.where("node_type = 'METHOD'")


@query(f"with recursive {SURFACES} select surface_id, name, file, kind, depth from surf")
def g07_surfaces(t: Tables) -> DataFrame:
    return targeting.select_surfaces(_methods(t), t.edges, targeting.boundary_bits(t.files))


@query(f"with recursive {SURFACES} select surface_id from second")
def g09_second_order(t: Tables) -> DataFrame:
    return targeting.second_order(_methods(t), t.edges, targeting.boundary_bits(t.files)).select("surface_id")


@query(f"with recursive {SURFACES} select surface_id, kind, depth from surf union all select surface_id, 'external_input', 0 from second where surface_id not in (select surface_id from surf)")
def u05_all_surfaces(t: Tables) -> DataFrame:
    return targeting.all_surfaces(_methods(t), t.edges, targeting.boundary_bits(t.files)).select("surface_id", "kind", "depth")


CALLS = """select event_id as call_id, case user_id % 4 when 0 then 'java' when 1 then 'python' when 2 then 'js' else 'go' end as language,
  case event_id % 10 when 0 then 'stmt.executeQuery' when 1 then 'Runtime.exec' when 2 then 'request.args.get' when 3 then 'getParameter' when 4 then 'subprocess.run' when 5 then 'res.redirect' when 6 then 'db.QueryRow' when 7 then 'yaml.load' when 8 then 'innerHelper' else 'req.query' end as call_name from events"""


def _rule_values(table: dict[str, tuple], bare: bool) -> str:
    out = []
    for lang, items in table.items():
        for k, (name, kind) in enumerate(items):
            out.append(f"({k}, '{lang}', '{name}', '{name.rpartition('.')[2] if bare else name}', '{kind}')")
    return ", ".join(out)


def _classified(table: dict[str, tuple], bare: bool) -> str:
    return f"""with calls as ({CALLS}), rules(rule_idx, rl, name, needle, kind) as (values {_rule_values(table, bare)}),
hit as (select *, row_number() over (partition by call_id order by rule_idx) as n from calls join rules on language = rl and contains(call_name, needle))
select call_id, language, call_name, rule_idx, name, kind from hit where n = 1"""


@query(_classified(taxonomy.SINKS, True))
def j21_sinks(t: Tables) -> DataFrame:
    return taxonomy.classify(t.sql(CALLS), taxonomy.rules(t.spark)).drop("cwe")


@query(_classified(taxonomy.SOURCES, False))
def j21_sources(t: Tables) -> DataFrame:
    return taxonomy.classify(t.sql(CALLS), taxonomy.rules(t.spark, taxonomy.SOURCES, bare=False)).drop("cwe")


@query(f"with calls as ({CALLS}) select call_id, case " + " ".join(f"when {' or '.join(f'''contains(lower(call_name), '{w.lower()}')''' for w in words)} then '{kind}'" for kind, words in X.SINK_GROUPS) + f" else 'unknown' end as kind from calls")
def d22_generic_sink_kind(t: Tables) -> DataFrame:
    return t.sql(CALLS).select("call_id", X.generic_sink_kind(F.col("call_name")).alias("kind"))


RULES = ((0, "", "*.py", "CWE-89", "orm_safe"), (1, "", "src/m2*.java", "", "generated"), (2, "", "m3?.java", "cwe-22", "reviewed"), (3, "", "", "CWE-327", "accepted"))


@query("""select seq, case when path like '%.py' and cwe = 'CWE-89' then 'orm_safe' when regexp_matches(path, '^src/m2[^/]*\\.java$') then 'generated' when regexp_matches(path, '(^|/)m3[^/]\\.java$') and cwe = 'CWE-22' then 'reviewed' when cwe = 'CWE-327' then 'accepted' end as rule_reason from findings""")
def j23_suppression_rules(t: Tables) -> DataFrame:
    rules = t.spark.createDataFrame(RULES, "rule_idx int, id string, path string, cwe string, reason string")
    return dedup.first_rule(dedup.with_defaults(t.findings), rules).select("seq", "rule_reason")


@query("""select odd_path, count(*) as n, bool_or(regexp_matches(odd_path, '^[^/]*/migrations/[^/]*\\.py$') or regexp_matches(odd_path, '^[^/]*/settings\\.py$') or regexp_matches(odd_path, '(^|/)[^/]*SecurityConfig(uration)?\\.java$') or regexp_matches(odd_path, '(^|/)[^/]*\\.pb\\.go$')) as safe from findings group by odd_path""")
def j26_framework_safe(t: Tables) -> DataFrame:
    return t.findings.groupBy("odd_path").agg(F.count("*").alias("n"), F.bool_or(X.is_framework_safe(F.col("odd_path"))).alias("safe"))


@query("""select path, bool_or(path like '%\\_test.go' escape '\\' ) as auto, bool_or(path like '%\\_test.go' escape '\\') as scope, bool_or(contains(path, '/src/test/')) as pipeline from findings group by path""")
def f09_test_files(t: Tables) -> DataFrame:
    p = F.col("path")
    return t.findings.groupBy("path").agg(F.bool_or(X.is_test_file(p)).alias("auto"), F.bool_or(X.is_scope_test(p)).alias("scope"), F.bool_or(X.is_pipeline_test(p)).alias("pipeline"))


CVES = "select concat('CVE-', cast(p_partkey as varchar(9))) as cve, split_part(p_name, ' ', 2) as package, cast(p_size as double) / 5 as cvss from part"
CODE = "select concat('s', cast(p_partkey as varchar(9))) as surface_id, concat('lib/', p_name, '/', replace(p_brand, '#', ''), '.java') as file, concat('use ', p_type, ' ', p_name) as code from part"
MATCHED = f"""k as (select distinct lower(package) as key, cve, cvss from ({CVES}) c), s as ({CODE}),
parts as (select surface_id, unnest(string_split_regex(lower(file), '[/\\\\.]')) as part from s),
hits as (select distinct surface_id, key from parts join (select distinct key from k) x on contains(part, key) or contains(key, part) where octet_length(encode(part)) >= 4 and part <> ''
  union select surface_id, key from s join (select distinct key from k) x on contains(lower(substring(code, 1, 4096)), key) where octet_length(encode(key)) < 40 and not contains(key, ':')),
matched as (select surface_id, cve, max(cvss) as cvss from hits join k using (key) group by surface_id, cve)"""


def _matches(t: Tables) -> DataFrame:
    return enrich.match_packages(t.sql(CODE), enrich.cve_index(t.sql(CVES)))


@query(f"with {MATCHED} select surface_id, cve, round(cvss, 6) as cvss from matched")
def j11_cve_packages(t: Tables) -> DataFrame:
    return _matches(t).withColumn("cvss", F.round("cvss", 6))


@query(f"with {MATCHED} select surface_id, string_agg(cve, ',' order by cvss desc, cve) as cves, round(max(cvss), 6) as top_cvss, max(cvss) >= 7 as auto_flagged, case when max(cvss) >= 9 then 'BLOCK' when max(cvss) >= 7 then 'HIGH' when max(cvss) >= 4 then 'MEDIUM' else 'LOW' end as severity from matched group by surface_id")
def d27_best_cve(t: Tables) -> DataFrame:
    return enrich.best_of_sets(t.sql(CODE), enrich.cve_index(t.sql(CVES))).withColumn("top_cvss", F.round("top_cvss", 6))


@query(f"""with kev as (select distinct cve from findings where cve <> '' and seq % 3 = 0), e as (select cve, max(cast(seq % 100 as double) / 100) as epss from findings where cve <> '' and seq % 5 = 0 group by cve)
select seq, case when kev.cve is not null or coalesce(epss, 0) >= 0.5 then 'Active' when coalesce(epss, 0) >= 0.1 then 'PoC' else 'None' end as exploitation, case when cwe in ({AUTO}) then 'Yes' else 'No' end as automatable,
  case when cwe in ({TOTAL}) then 'Total' when cwe in ({PARTIAL}) then 'Partial' when cvss >= 7 then 'Total' else 'Partial' end as technical_impact from findings left join kev using (cve) left join e using (cve)""")
def d06_ssvc(t: Tables) -> DataFrame:
    f = t.findings.withColumn("finding_id", F.col("seq"))
    kev = f.where("cve <> '' and seq % 3 = 0").select("cve")
    epss = f.where("cve <> '' and seq % 5 = 0").select("cve", (F.col("seq") % 100 / 100).alias("epss"))
    return enrich.ssvc(f, kev, epss).withColumnRenamed("finding_id", "seq")


@query("""with m as (select user_id, ts, event_id from events where event_type = 'signup'), f as (select event_id as fid, user_id, ts from events where event_type = 'error')
select fid, coalesce(m.event_id, -1) as method_id from f asof left join m on f.user_id = m.user_id and f.ts >= m.ts""")
def j15_enclosing_as_of(t: Tables) -> DataFrame:
    own = lambda kind, name: t.events.where(F.col("event_type") == kind).select(F.col("user_id").alias("file"), F.col("ts").alias("line"), F.col("event_id").alias(name))
    return enrich.enclosing(own("error", "fid"), own("signup", "method_id")).withColumn("method_id", F.coalesce("method_id", F.lit(-1).cast("long")))


@query("with fair as (select to_id from edges group by to_id having count(distinct from_id) <= 1) select to_id as sink_name, from_id as surface_id from edges where to_id in (select to_id from fair)")
def j20_fan_in_guard(t: Tables) -> DataFrame:
    return enrich.fan_in_guard(t.edges.select(F.col("to_id").alias("sink_name"), F.col("from_id").alias("surface_id")), 1)


@query("""select surface_id, case when kind = 'auth_boundary' then case when sanitized then 'Safe' else 'Inconclusive' end when a is null then 'Inconclusive' when hop = 0 then 'Inconclusive' when sanitized or safe then 'Safe' else 'Violation' end as verdict,
  case when kind = 'auth_boundary' then case when sanitized then '' else 'CWE-862' end when a is null then 'CWE-22' when hop > 0 and (sanitized or safe) then '' else a end as cwe from (
  select seq as surface_id, case when seq % 9 = 0 then 'auth_boundary' else 'external_input' end as kind, case seq % 4 when 0 then 'CWE-89' when 1 then 'CWE-78' when 2 then 'CWE-918' end as a, seq % 5 as hop, seq % 6 = 0 as sanitized,
    case seq % 4 when 0 then seq % 10 = 1 or seq % 10 = 6 when 1 then seq % 10 = 2 or seq % 10 = 7 else false end as safe from findings) x where not (kind = 'auth_boundary' and coalesce(a, '') in ('CWE-89', 'CWE-78'))""")
def d13_contract_verdicts(t: Tables) -> DataFrame:
    """Surfaces made of findings: the anchor by seq % 4, the call path by seq % 5 and a safe call by seq % 10."""
    s = t.findings.select(
        F.col("seq").alias("surface_id"), F.when(F.expr("seq % 9 = 0"), F.lit("auth_boundary")).otherwise(F.lit("external_input")).alias("kind"),
        F.expr("case seq % 4 when 0 then array('x.executeQuery') when 1 then array('java.Runtime.exec') when 2 then array('axios.get') else array('helper') end").alias("sink_nodes"),
        F.expr("case when seq % 5 = 0 then array() else array(case when seq % 10 in (1, 6) then 'prepareStatement' when seq % 10 in (2, 7) then 'shlex.quote' else 'next' end) end").alias("call_path"),
        F.lit("").alias("code"), F.expr("seq % 6 = 0").alias("sanitized"),
    ).where("not (kind = 'auth_boundary' and seq % 4 in (0, 1))")
    return contracts.verdicts(s, contracts.rulebook(t.spark))


@query("select path as surface_id, case when count(*) filter (conf >= 0.5) > count(*) filter (conf < 0.5) then 'Safe' else 'Violation' end as verdict from findings group by path")
def a08_votes(t: Tables) -> DataFrame:
    return contracts.vote(t.findings.select(F.col("path").alias("surface_id"), (F.col("conf") >= 0.5).alias("yes")))


RECONCILED = f"""v as (select seq as surface_id, cwe, exploitable, seq % 4 = 0 as taint_mismatch, conf as confidence from findings), w as (select seq as surface_id, case when seq % 13 = 0 then 'CWE-1' else cwe end as violation_cwe, 'MEDIUM' as vs from findings where seq % 3 = 0),
a as (select *, case when violation_cwe is null then 'pass' when not exploitable and confidence >= 0.75 and not (cwe <> '' and violation_cwe <> '' and cwe <> violation_cwe) then 'suppress' when exploitable and confidence >= 0.7 then 'elevate' else 'unchanged' end as action from v left join w using (surface_id))"""


def _reconciled(t: Tables) -> tuple[DataFrame, DataFrame]:
    v = t.findings.select(F.col("seq").alias("surface_id"), "cwe", "exploitable", F.expr("seq % 4 = 0").alias("taint_mismatch"), F.col("conf").alias("confidence"))
    w = t.findings.where("seq % 3 = 0").select(F.col("seq").alias("surface_id"), F.expr("case when seq % 13 = 0 then 'CWE-1' else cwe end").alias("cwe"), F.lit("MEDIUM").alias("severity"))
    return reconcile.reconcile(v, w), w


@query(f"with {RECONCILED} select surface_id, action, case action when 'suppress' then 'SUPPRESSED' when 'elevate' then {BAND.format(c='confidence')} else coalesce(vs, {BAND.format(c='confidence')}) end as severity, case when action = 'suppress' then case when taint_mismatch then 'false_positive' else 'safe' end else '' end as suppress_reason from a")
def d15_reconcile(t: Tables) -> DataFrame:
    return _reconciled(t)[0].select("surface_id", "action", "severity", "suppress_reason")


@query(f"with {RECONCILED} select surface_id, violation_cwe as cwe from a where violation_cwe is not null and action not in ('suppress', 'elevate')")
def j09_unhandled_violations(t: Tables) -> DataFrame:
    done, w = _reconciled(t)
    return reconcile.unhandled(w, done).select("surface_id", "cwe")


@query("select path as surface_id, seq from (select *, row_number() over (partition by path order by case when conf >= 0.5 then 0 else 1 end, seq) as n from findings) x where n = 1")
def w01_first_per_surface(t: Tables) -> DataFrame:
    return reconcile.first_per_surface(t.findings.select(F.col("path").alias("surface_id"), F.when(F.col("conf") >= 0.5, F.lit(0)).otherwise(F.lit(1)).alias("bucket"), "seq")).select("surface_id", "seq")


TRUTH = """truth as (select d.doc_id, d.lang as category, l.toxic = 1 as real, d.n_chars % 3 = 0 as sem, d.n_chars % 5 = 0 as pat from documents d join labels l using (doc_id)),
rated as (select *, sem or pat as predicted, case when sem and pat then 'BOTH' when sem then 'SEMANTIC_ONLY' when pat then 'PATTERN_ONLY' end as layer from truth)"""


def _rated(t: Tables) -> DataFrame:
    d = t.documents.join(t.labels, "doc_id")
    expected = d.select(F.col("doc_id").cast("string").alias("test_name"), F.col("lang").alias("category"), (F.col("toxic") == 1).alias("real"), F.lit(79).alias("cwe"))
    seen = lambda k, src: d.where(F.col("n_chars") % k == 0).select(F.concat(F.lit("a/testcode/"), F.col("doc_id").cast("string"), F.lit(".java")).alias("file_path"), F.lit("CWE-79: x").alias("cwe"), F.lit(src).alias("source_path"), F.lit("HIGH").alias("severity"))
    return reports.detected(expected, seen(3, "SEMANTIC").unionByName(seen(5, "PATTERN")))


@query(f"""with {TRUTH}, c as (select category, count(*) filter (real and predicted) as tp, count(*) filter (not real and predicted) as fp, count(*) filter (real and not predicted) as fn, count(*) filter (not real and not predicted) as tn from rated group by grouping sets ((category), ())),
r as (select *, case when tp + fp = 0 then 0.0::double else tp / (tp + fp) end as p, case when tp + fn = 0 then 0.0::double else tp / (tp + fn) end as q from c)
select category, tp, fp, fn, tn, round(p, 6) as precision, round(q, 6) as recall, round(case when p + q = 0 then 0.0::double else 2 * p * q / (p + q) end, 6) as f1 from r""")
def a09_confusion_matrix(t: Tables) -> DataFrame:
    return reports.confusion(_rated(t))


@query(f"with {TRUTH} select layer, count(*) as n from rated where real and predicted group by layer")
def a11_true_positives_by_layer(t: Tables) -> DataFrame:
    return reports.true_positives_by_layer(_rated(t))


@query("select doc_id, cast(length(text) - length(replace(text, chr(10), '')) as bigint) as loc from documents")
def a16_lines_of_code(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.loc(F.col("text")).cast("long").alias("loc"))


@query("""with l as (select doc_id, string_split(text, chr(10)) as a from documents)
select doc_id, cast(greatest(1, case when 3 <= len(a) then 3 - 5 else 1 end) as int) as first_line, case when 3 <= len(a) then array_to_string(a[1:8], chr(10)) else array_to_string(a[1:20], chr(10)) end as snippet from l""")
def w02_line_window(t: Tables) -> DataFrame:
    files = t.documents.select(F.col("doc_id").alias("path"), "text")
    return text.window(files.select(F.col("path").alias("id"), "path", F.lit(3).alias("line")), files).withColumnRenamed("id", "doc_id")


@query("select doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda s: trim(s, ' ' || chr(9) || chr(13)) <> '' and not starts_with(trim(s, ' ' || chr(9) || chr(13)), '//') and not starts_with(trim(s, ' ' || chr(9) || chr(13)), '#')), chr(10)) as code from documents")
def x17_minified(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.minified(F.col("text")).alias("code"))


@query("with w as (select doc_id, text, string_split_regex(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '\\s+') as a from documents) select doc_id, case when len(a) > 25 then array_to_string(a[1:25], ' ') else text end as summary from w")
def x13_first_words(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.first_words(F.col("text"), 25).alias("summary"))


@query("select page_id, regexp_replace(html, '[^\\x20-\\x7E]|[\\\\\"]', ' ', 'g') as clean from pages")
def x22_printable(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.printable(F.col("html")).alias("clean"))


REPLIES = """select conv_id, turn, case when turn % 5 = 0 then concat('Category: probably_safe', chr(10), text) when turn % 5 = 1 then concat(text, ' EXPLOITABLE') when turn % 5 = 2 then '0.8' when turn % 5 = 3 then concat('Reason.', chr(10), 'My answer: yes.') else 'nothing' end as reply from conversations"""


@query(f"with r as ({REPLIES}) select conv_id, turn, cast(case turn % 5 when 0 then 0.25 when 1 then 1.0 when 2 then 0.8 else 0.5 end as double) as score from r")
def d28_triage_score(t: Tables) -> DataFrame:
    return t.sql(REPLIES).select("conv_id", "turn", X.triage_score(F.col("reply")).alias("score"))


@query(f"with r as ({REPLIES}) select conv_id, turn, upper(regexp_extract(string_split(trim(reply, ' ' || chr(10)), chr(10))[-1], '([A-Za-z]+)[^A-Za-z]*$', 1)) = 'YES' as yes from r")
def x21_yes_votes(t: Tables) -> DataFrame:
    return t.sql(REPLIES).select("conv_id", "turn", X.yes_vote(F.col("reply")).alias("yes"))


@query(f"with s as (select cast(case turn % 5 when 0 then 0.25 when 1 then 1.0 when 2 then 0.8 else 0.5 end as double) as score from conversations) select count(*) filter (score >= 0.5) as escalated, count(*) filter (score < 0.5) as dropped, round(avg(score), 6) as avg_score from s")
def a13_triage_summary(t: Tables) -> DataFrame:
    return reports.triage_summary(t.sql(REPLIES).select(X.triage_score(F.col("reply")).alias("score")))


@query("""select event_id, concat('r', event_type) as rule_id, concat('src/a', cast(user_id as varchar), '.py') as path, cast(user_id as int) as line_start, case when event_id % 2 = 0 then 'CWE-89: SQL' else 'CWE-79' end as cwe,
  cast(case event_id % 4 when 0 then 0.90 when 1 then 0.65 when 2 then 0.40 else case when event_type = 'error' then 0.65 else 0.40 end end as double) as conf from events""")
def src05_pattern_reports(t: Tables) -> DataFrame:
    """Each event as a report of one result, read back."""
    meta = F.to_json(F.struct(F.when(F.expr("event_id % 2 = 0"), F.lit("CWE-89: SQL")).otherwise(F.lit("CWE-79")).alias("cwe"), F.expr("element_at(array('HIGH', 'MEDIUM', 'LOW', null), cast(event_id % 4 as int) + 1)").alias("confidence")))
    result = F.struct(
        F.concat(F.lit("r"), "event_type").alias("check_id"), F.concat(F.lit("src/a"), F.col("user_id").cast("string"), F.lit(".py")).alias("path"), F.struct(F.col("user_id").cast("int").alias("line")).alias("start"),
        F.struct(F.col("user_id").cast("int").alias("line")).alias("end"), F.struct(F.when(F.col("event_type") == "error", F.lit("ERROR")).otherwise(F.lit("INFO")).alias("severity"), meta.alias("metadata"), F.col("event_id").cast("string").alias("lines")).alias("extra"),
    )
    reports_ = t.events.select(F.to_json(F.struct(F.array(result).alias("results"))).alias("json"))
    return readers.pattern_findings(reports_).select(F.col("matched_code").cast("long").alias("event_id"), "rule_id", "path", "line_start", "cwe", "conf")


@query("""select event_id, concat('pkg', cast(user_id as varchar)) as package, round(cast(event_id % 100 as double) / 10, 6) as cvss, case when event_id % 3 = 0 then 'CWE-1035' else 'CWE-79' end as cwe,
  cast(case when event_id % 100 >= 90 then 0.95 when event_id % 100 >= 70 then 0.85 when event_id % 100 >= 40 then 0.65 when event_id % 100 > 0 then 0.40 else 0.85 end as double) as conf from events""")
def src07_dependency_reports(t: Tables) -> DataFrame:
    v = F.struct(F.col("event_id").cast("string").alias("id"), (F.col("event_id") % 100 / 10).alias("cvss_score"), F.when(F.expr("event_id % 3 <> 0"), F.array(F.struct(F.lit("CWE-79").alias("cwe_id")))).alias("cwe_ids"))
    p = F.struct(F.struct(F.concat(F.lit("pkg"), F.col("user_id").cast("string")).alias("name"), F.lit("1").alias("version")).alias("package"), F.array(v).alias("vulnerabilities"))
    rows = t.events.select(F.to_json(F.struct(F.array(F.struct(F.struct(F.lit("go.mod").alias("path")).alias("source"), F.array(p).alias("packages"))).alias("results"))).alias("json"))
    return readers.dependency_findings(rows).select(F.col("cve").cast("long").alias("event_id"), "package", F.round("cvss", 6).alias("cvss"), "cwe", "conf")


@query("""select concat('CVE-', cast(event_id as varchar)) as cve, concat('g:', event_type) as package, event_type as key, round(cast(case when event_id % 2 = 0 then event_id % 10 else 3 end as double), 6) as cvss from events where not (event_id % 2 = 0 and event_id % 10 = 0)
union all select concat('CVE-', cast(event_id as varchar)), concat('g:', event_type), event_type, 3.0 from events where event_id % 10 = 0
union all select concat('CVE-', cast(event_id as varchar)), concat('g:', event_type), concat('g:', event_type), case when event_id % 2 = 0 and event_id % 10 <> 0 then cast(event_id % 10 as double) else 3.0 end from events""")
def src08_cve_reports(t: Tables) -> DataFrame:
    v = F.struct(
        F.concat(F.lit("CVE-"), F.col("event_id").cast("string")).alias("VulnerabilityID"), F.concat(F.lit("g:"), "event_type").alias("PkgName"),
        F.struct(F.struct(F.when(F.expr("event_id % 2 = 0"), (F.col("event_id") % 10).cast("double")).otherwise(F.lit(0.0)).alias("V3Score")).alias("nvd"), F.struct(F.lit(3.0).alias("V3Score")).alias("ghsa")).alias("CVSS"),
    )
    rows = t.events.select(F.to_json(F.struct(F.array(F.struct(F.lit("x").alias("Target"), F.array(v).alias("Vulnerabilities"))).alias("Results"))).alias("json"))
    return enrich.cve_index(readers.cve_report(rows)).select("cve", "package", "key", F.round("cvss", 6).alias("cvss"))


@query("""with v as (select vec_id as id, label, embedding from embeddings)
select a.id as id_a, b.id as id_b, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 5) as cosine, case when list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.4 then 'same' else 'near' end as kind
from v a join v b on a.label = b.label and a.id < b.id where list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.3""")
def d11_similar_pairs(t: Tables) -> DataFrame:
    """Off by default in dedup; here with thresholds that these vectors reach."""
    return dedup.similar_pairs(t.embeddings.select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v")), "label", 0.4, 0.3).withColumn("cosine", F.round("cosine", 5))


@query("select path, case when path like '%.go' then 'go' when path like '%.py' then 'python' else 'java' end as lang, regexp_extract(path, '([^/]*)$', 1) as base, count(*) as n from findings group by path")
def x03_languages(t: Tables) -> DataFrame:
    p = F.col("path")
    return t.findings.groupBy("path").agg(F.count("*").alias("n")).select("path", X.language(p).alias("lang"), X.base_name(p).alias("base"), "n")


@query("select case when path like '%.go' then 'go' when path like '%.py' then 'python' else 'java' end as lang, count(*) as n from findings group by 1 order by n desc, lang limit 1")
def a06_majority_language(t: Tables) -> DataFrame:
    return reports.majority_language(t.findings)


@query("select regexp_extract(odd_path, '^(.*)/[^/]*$', 1) as dir, string_agg(distinct odd_path, ',' order by odd_path) as paths from findings group by 1")
def a17_files_by_directory(t: Tables) -> DataFrame:
    return reports.by_directory(t.findings.select(F.col("odd_path").alias("path")))


@query("select seq, cast(regexp_extract(cwe, 'CWE-(\\d+)', 1) as int) as number, sha256(concat(cwe, ':', path, ':', cast(line as varchar))) as finding_id, substr(sha256(concat(cwe, '|', path, '|', cast(line as varchar))), 1, 16) as gate_key from findings")
def d02_identities(t: Tables) -> DataFrame:
    c, p, n = F.col("cwe"), F.col("path"), F.col("line")
    return t.findings.select("seq", X.cwe_number(c).alias("number"), X.finding_id(c, p, n).alias("finding_id"), X.gate_key(c, p, n).alias("gate_key"))


@query(f"select seq, cast(case when cvss >= 9 then 0.95 when cvss >= 7 then 0.82 when cvss >= 4 then 0.68 else 0 end as double) as conf, round(case when cvss < 4 then 0 else 1 / (1 + exp(-(0.8 * cvss - 5))) end, 6) as platt from findings")
def d14_cvss_confidence(t: Tables) -> DataFrame:
    return t.findings.select("seq", X.cvss_confidence(F.col("cvss")).alias("conf"), F.round(X.platt(F.col("cvss"), 0.8, -5.0), 6).alias("platt"))


@query("select from_id as id from edges intersect select to_id from edges")
def u03_intersection(t: Tables) -> DataFrame:
    return t.edges.select(F.col("from_id").alias("id")).intersect(t.edges.select("to_id"))


@query("select from_id as id from edges union select to_id from edges")
def u06_distinct_union(t: Tables) -> DataFrame:
    return t.edges.select(F.col("from_id").alias("id")).union(t.edges.select("to_id")).distinct()


@query("""with s as (select path, seq, cwe, line from findings) select path as surface_id, string_agg(cwe, ',' order by f) as sinks, cast(sum(n) as bigint) as n_steps from (select path, cwe, min(seq) as f, count(*) * 2 as n from s group by path, cwe) x group by path""")
def a20_path_summary(t: Tables) -> DataFrame:
    p = t.findings.select(F.col("path").alias("surface_id"), "seq", F.col("cwe").alias("sink_name"), F.col("path").alias("sink_file"), F.col("line").alias("sink_line"), F.array(F.lit("a"), F.lit("b")).alias("steps"), F.lit(False).alias("sanitized"))
    return enrich.path_summary(p, with_steps=False).select("surface_id", F.array_join("sinks", ",").alias("sinks"), F.col("n_steps").cast("long").alias("n_steps"))


PATHS = """select event_id, case user_id % 3 when 0 then 'java' when 1 then 'python' else 'go' end as language, case event_id % 8 when 0 then 'sql' when 1 then 'command' when 2 then 'deserialization' when 3 then 'file_write' when 4 then 'template' when 5 then 'redirect' when 6 then 'eval' else 'other' end as kind,
  concat('src/m', cast(user_id as varchar(20))) as file, cast(event_id % 90 as int) + 1 as line, event_id % 4 = 0 as sanitized from events"""


@query(f"""with p as ({PATHS}) select source_node, file as path, line, case when kind = 'template' and language = 'java' then 'CWE-79' else case kind when 'sql' then 'CWE-89' when 'command' then 'CWE-78' when 'deserialization' then 'CWE-502' when 'file_write' then 'CWE-22' when 'template' then 'CWE-1336' when 'redirect' then 'CWE-601' when 'eval' then 'CWE-94' else 'CWE-200' end end as cwe,
  cast(0.75 as double) as conf, 'PATTERN' as src, concat('JOERN-TAINT-', kind) as rule_id, concat('Taint flow from http_param (in:1) to sink ', kind, ' (', file, ':', cast(line as varchar), ')', case when sanitized then ' [sanitized path]' else '' end) as justification from (select *, cast(event_id as varchar) as source_node from p) x""")
def d21_taint_findings(t: Tables) -> DataFrame:
    end = lambda kind, file, line: F.struct(kind.alias("kind"), file.alias("file"), line.alias("line"), F.col("event_id").cast("string").alias("node_id"))
    p = t.sql(PATHS).select("language", end(F.lit("http_param"), F.lit("in"), F.lit(1)).alias("source"), end(F.col("kind"), F.col("file"), F.col("line")).alias("sink"), F.array(F.lit("a")).alias("steps"), "sanitized")
    return taxonomy.taint_findings(p).select("source_node", "path", "line", "cwe", "conf", "src", "rule_id", "justification")


RESPONSES = """select event_id, cast(case event_id % 3 when 0 then 500 when 1 then 503 else 404 end as int) as status, case event_id % 5 when 0 then 'x ORA-00933 y' when 1 then 'java.sql.SQLException: syntax error' when 2 then 'at java.lang' when 3 then 'fine' end as body from events"""


@query(f"with r as ({RESPONSES}) select event_id, case when status >= 500 then case event_id % 5 when 0 then 'ORA-' when 1 then 'SQLException' when 2 then 'at java.' end end as leak, status >= 500 and event_id % 5 < 3 as confirmed from r")
def d26_error_leaks(t: Tables) -> DataFrame:
    leak = X.leaked_error(F.col("status"), F.col("body"))
    return t.sql(RESPONSES).select("event_id", leak.alias("leak"), leak.isNotNull().alias("confirmed"))


@query(f"with {SCORED}, x as (select seq, severity, case when seq % 4 = 0 then concat(path, '.rs') else path end as path from scored) select seq, case when severity not in ('BLOCK', 'HIGH') then 'not_attempted' when path like '%.rs' then 'language_unsupported' else '' end as status from x")
def f14_proof_eligibility(t: Tables) -> DataFrame:
    path = F.when(F.expr("seq % 4 = 0"), F.concat("path", F.lit(".rs"))).otherwise(F.col("path"))
    return _scored(t).select("seq", X.proof_status(F.col("severity"), path).alias("status"))


@query(f"with {SCORED} select seq, case when severity in ('BLOCK', 'HIGH') then '' else 'not_attempted' end as status from scored")
def f15_patch_eligibility(t: Tables) -> DataFrame:
    return _scored(t).select("seq", F.when(X.is_patchable(F.col("severity")), F.lit("")).otherwise(F.lit("not_attempted")).alias("status"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After dedup and scoring: how many findings of each severity, and does the build fail?"""
    return QUERIES["a03_scan_summary"](spark, sf_dir)
