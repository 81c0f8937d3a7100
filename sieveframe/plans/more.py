"""Further registered queries: row functions, filters, rollups, graph searches and stores, one for each operator.

Inputs are made of whole tables by case distinctions on their keys; each oracle states the expected result of a case by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import expressions as X
from ..operators import changes, contracts, dedup, enrich, graph, reconcile, reports, routes, scanners, targeting, taxonomy, text, tools
from ..sources import readers, store
from .adapters import Tables
from .catalogue import CALLS, ORACLES, QUERIES, _graph, _root, query

__all__ = ["ORACLES", "QUERIES"]


def cases(key: str, values: list[str], name: str) -> str:
    """SQL: the value at key modulo their number."""
    return "case " + " ".join(f"when {key} % {len(values)} = {k} then '{v}'" for k, v in enumerate(values)) + f" end as {name}"


PATH_CASES = ["src/it/A.java", "src/main/UserTest.java", "src/main/Tester.java", "pkg/testing.py", "pkg/a_test.go", "web/x.spec.ts", "web/x.jsx", "src/test/java/B.kt", "app/.hidden.go", "app/main.rs", "lib/core.py", "lib/androidTest/C.kt"]
FILES = f"select event_id, {cases('event_id', PATH_CASES, 'path')} from events"


def _files(t: Tables) -> DataFrame:
    return t.sql(FILES)


# filters ----------------------------------------------------------------------------------------------------------------
@query("select from_id, to_id from edges where edge_type = 'CALL'")
def f03_calls(t: Tables) -> DataFrame:
    return _graph(t).calls().select("from_id", "to_id")


@query("select from_id, to_id from edges where from_id = (select from_id from edges group by from_id order by count(*) desc, from_id limit 1)")
def f04_edges_of(t: Tables) -> DataFrame:
    return _graph(t).edges_of(from_id=_root(t)).select("from_id", "to_id")


@query("select node_id from nodes where node_id = '-7' and node_id <> '-7'")
def f05_synthetic_node(t: Tables) -> DataFrame:
    """A node made up for outside code has no callers, even where an edge says so."""
    more = t.edges.select(F.col("from_id"), F.lit("-7").alias("to_id"), F.lit("CALL").alias("edge_type"))
    return graph.CodeGraph(t.nodes, t.edges.unionByName(more)).callers("-7").select("node_id")


RULE_CASES = ["python.sql", "java.sql", "generic.secret", "custom.thing", ".x", "go.rand"]


@query(f"""with f as ({FILES}), g as (select event_id, path, {cases('event_id', RULE_CASES, 'rule')} from f), h as (select event_id, case when event_id % 5 = 0 then concat('.github/', path) else path end as path, rule, regexp_extract(path, '\\.([a-z]+)$', 1) as ext from g)
select event_id from h where path not like '.github/%' and (rule in ('generic.secret', 'custom.thing', '.x') or ext not in ('py', 'java', 'go', 'ts', 'kt', 'rs') or (rule = 'python.sql' and ext = 'py') or (rule = 'java.sql' and ext = 'java') or (rule = 'go.rand' and ext = 'go'))""")
def f06_kept_findings(t: Tables) -> DataFrame:
    f = t.sql(f"select event_id, case when event_id % 5 = 0 then concat('.github/', path) else path end as path, {cases('event_id', RULE_CASES, 'rule')} from ({FILES})")
    return f.where(readers.keep_finding(F.col("path"), F.col("rule"))).select("event_id")


@query("select seq from findings where conf >= 0.85")
def f07_high_confidence(t: Tables) -> DataFrame:
    return scanners.high_confidence(t.findings).select("seq")


@query("select event_id from events where event_id % 12 in (0, 1, 3, 4, 5, 7, 11)")
def f08_scope_tests(t: Tables) -> DataFrame:
    return _files(t).where(X.is_scope_test(F.col("path"))).select("event_id")


@query("select event_id from events where event_id % 12 = 7")
def f10_pipeline_tests(t: Tables) -> DataFrame:
    return _files(t).where(X.is_pipeline_test(F.col("path"))).select("event_id")


@query("select event_id, event_id % 6 in (1, 3, 4) as phantom from events")
def f11_phantom_paths(t: Tables) -> DataFrame:
    """In turn: short, three internals of five after an internal source, the same after another, four of eight, over 500 names, the same with another first."""
    steps = "case event_id % 6 when 0 then array('x') when 1 then array('in', 'in', 'x', 'in', 'y') when 2 then array('in', 'in', 'x', 'in', 'y') when 3 then array('x', 'in', 'in', 'y', 'in', 'in', 'z', 'z') when 4 then concat(array('in'), array_repeat('x', 500)) else array_repeat('x', 501) end"
    e = t.events.select("event_id", F.expr("case when event_id % 6 = 1 then 'src' else 'other' end").alias("source"), F.expr(steps).alias("names"))
    return e.select("event_id", graph.is_phantom(F.col("source"), F.col("names"), ("src",), ("in",)).alias("phantom"))


@query("select event_id from events where event_id % 12 in (2, 6, 8, 10)")
def f12_scope(t: Tables) -> DataFrame:
    return scanners.in_scope(_files(t)).select("event_id")


@query("select event_id from events where event_id % 12 <> 8")
def f13_without_dotfiles(t: Tables) -> DataFrame:
    return scanners.scannable(_files(t)).select("event_id")


@query("select event_id, case when event_id % 4 = 0 then 'confirmed' else 'weak' end as tier from events where event_id % 4 <> 3")
def f16_taint_gate(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", F.expr("case when event_id % 4 = 0 then array('s') else array() end").alias("sink_nodes"), F.expr("case when event_id % 4 = 3 then '' else 'CWE-1' end").alias("contract_cwe"))
    return reconcile.gate(rows).select("event_id", "tier")


@query("select event_id, case when event_type = 'view' then event_id % 50 < 25 else true end as is_stub from events")
def f17_stubs(t: Tables) -> DataFrame:
    """Twice as many bytes as characters, with blanks around them."""
    code = F.when(F.col("event_type") == "view", F.concat(F.lit("  \n"), F.repeat(F.lit("é"), (F.col("event_id") % 50).cast("int")), F.lit("\t ")))
    return scanners.stubs(t.events.select("event_id", code.alias("code"))).select("event_id", "is_stub")


STORED = ("finding_id", "project_id", "severity", "first_seen_at")
NEWEST = "select concat('f', cast(event_id as varchar(20))) as finding_id, concat('p', cast(user_id % 3 as varchar(9))) as project_id, case when value >= 40 then 'HIGH' else 'LOW' end as severity, event_id % 97 as first_seen_at from events"


@query(f"select finding_id, first_seen_at from ({NEWEST}) x where project_id = 'p1' and severity = 'HIGH'")
def f18_newest_of_severity(t: Tables) -> DataFrame:
    return store.newest(t.sql(NEWEST), "p1", "HIGH").select("finding_id", "first_seen_at")


@query("select concat('d', cast(max(doc_id) as varchar(20))) as finding_id from documents")
def f19_point_lookup(t: Tables) -> DataFrame:
    f = t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("finding_id"))
    last = t.documents.agg(F.max("doc_id").alias("m")).first()["m"]
    return store.one(f, finding_id=f"d{last}")


@query("select sha256(concat(cwe, ':', path, ':', cast(line as varchar))) as finding_id, 'p' as project_id, 'r' as run_id, path as file_path, line as line_start, line as line_end, cwe, conf as confidence, src as source_path, 77 as last_seen_at from findings")
def f20_finding_rows(t: Tables) -> DataFrame:
    rows = store.finding_rows(dedup.with_defaults(t.findings), "p", "r", 77)
    return rows.select("finding_id", "project_id", "run_id", "file_path", "line_start", "line_end", "cwe", "confidence", "source_path", "last_seen_at")


# row functions ----------------------------------------------------------------------------------------------------------
@query(f"select path, case event_id % 12 when 3 then 'python' when 10 then 'python' when 4 then 'go' when 8 then 'go' when 5 then 'js' when 6 then 'js' when 7 then '' when 9 then '' when 11 then '' else 'java' end as lang, count(*) as n from ({FILES}) x group by all")
def x04_taint_language(t: Tables) -> DataFrame:
    return _files(t).groupBy("path", X.taint_language(F.col("path")).alias("lang")).agg(F.count("*").alias("n"))


@query(f"select distinct path, regexp_extract(path, '([^/]*/[^/]*)$', 1) as short, regexp_extract(path, '[^/]*$') as base, regexp_extract(path, '^(.*)/[^/]*$', 1) as dir, regexp_extract(path, '\\.[^./]*$') as ext from ({FILES}) x")
def x05_path_parts(t: Tables) -> DataFrame:
    p = F.col("path")
    return _files(t).select("path", X.short_path(p).alias("short"), X.base_name(p).alias("base"), X.dir_name(p).alias("dir"), X.extension(p).alias("ext")).distinct()


@query(f"select distinct path, case when path like 'src/%' then substr(path, 5) else path end as below from ({FILES}) x")
def x06_relative(t: Tables) -> DataFrame:
    return _files(t).select("path", X.relative(F.col("path"), F.lit("src")).alias("below")).distinct()


@query(f"select distinct path, regexp_matches(path, '^src/[^/]*/[^/]*\\.java$') or regexp_matches(path, '^(.*/)?[^/]_[^/]*\\.go$') as hit from ({FILES}) x")
def x07_globs(t: Tables) -> DataFrame:
    return _files(t).select("path", X.glob_match(F.col("path"), ("src/*/*.java", "?_*.go")).alias("hit")).distinct()


@query("select p_partkey, regexp_extract(concat(p_brand, '.', p_type), '[^.]*$') as tail, regexp_extract(concat('g:', p_type, '/', p_brand), '[^:/]*$') as short from part")
def x08_tails(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.tail(F.concat("p_brand", F.lit("."), "p_type")).alias("tail"), X.tail(F.concat(F.lit("g:"), "p_type", F.lit("/"), "p_brand"), "[:/]").alias("short"))


@query(f"select event_id, array_to_string(list_filter(string_split_regex(path, '[/.]'), lambda x: x <> ''), ',') as tokens from ({FILES}) x")
def x09_path_tokens(t: Tables) -> DataFrame:
    return _files(t).select("event_id", F.array_join(X.path_tokens(F.col("path")), ",").alias("tokens"))


@query("select seq, cast(replace(cwe, 'CWE-', '') as int) as number, concat('https://cwe.mitre.org/data/definitions/', replace(cwe, 'CWE-', ''), '.html') as url from findings")
def x10_x11_cwe(t: Tables) -> DataFrame:
    c = F.concat("cwe", F.lit(": name"))
    return t.findings.select("seq", X.cwe_number(c).alias("number"), X.cwe_url(c).alias("url"))


@query("select doc_id, left(text, cast(list_max(list_filter(range(0, 201), lambda i: octet_length(encode(left(text, cast(i as bigint)))) <= 200)) as bigint)) as head from documents")
def x12_truncated(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.truncate_utf8(F.col("text"), F.lit(200)).alias("head"))


QUOTED = """select doc_id, concat('call("', lang, '\\"in"); // note "x', chr(10), replace(text, 'a', '"'), chr(10), 'it''s // "gone', chr(10), 'end "open') as code from documents"""


@query("""select doc_id, regexp_replace(concat('call("', lang, chr(92), '"in"); // note "x', chr(10), replace(text, 'a', '"'), chr(10), 'it''s // "gone', chr(10), 'end "open'), '//[^\\n]*|"(?:[^"]*\\\\")*[^"]*(?:"|\\z)', '', 'g') as bare from documents""")
def x15_stripped(t: Tables) -> DataFrame:
    d = t.documents
    code = F.concat(F.lit('call("'), "lang", F.lit('\\"in"); // note "x\n'), F.replace("text", F.lit("a"), F.lit('"')), F.lit('\nit\'s // "gone\nend "open'))
    return d.select("doc_id", contracts.stripped(code).alias("bare"))


@query("""select doc_id, concat('f("", '''') ', replace(replace(replace(text, chr(10), ' '), '"', ''), '''', ''), ' ""') as code from documents""")
def x16_blank_strings(t: Tables) -> DataFrame:
    body = F.replace(F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit('"'), F.lit("")), F.lit("'"), F.lit(""))
    return t.documents.select("doc_id", text.blank_strings_col(F.concat(F.lit('f("a\\"b", \'x\') '), body, F.lit(' "'), "lang", F.lit('"'))).alias("code"))


@query("select doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda s: regexp_replace(concat('  ', chr(9), s), '^[ \\t]+', '')), chr(10)) as code from documents")
def x18_dedented(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.dedented(F.array_join(F.transform(F.split("text", "\n"), lambda s: F.concat(F.lit("  \t"), s)), "\n")).alias("code"))


@query("""select doc_id, concat('int a = f("", ''''); ', chr(10), ' * ', lang, chr(10), 's = ""') as code from documents""")
def x19_obfuscated(t: Tables) -> DataFrame:
    """Lines of every kind around three that stay."""
    head = F.concat(F.lit('package a;\nimport (\n  "'), "lang", F.lit('"\n)\nimport x\n/* open\n * in\nend */ gone\n// c\n# h\n-- sql\n\n  int a = f("'), "lang", F.lit("\", 'x'); \n * "), "lang", F.lit('\nx /* opens\n'), F.replace("text", F.lit("*/"), F.lit("")), F.lit('\n*/\ns = "'), F.substring(F.replace(F.replace("text", F.lit('"'), F.lit("")), F.lit("\n"), F.lit(" ")), 1, 40), F.lit('"  '))
    return t.documents.select("doc_id", text.obfuscate_col(head).alias("code"))


@query("""select event_id, case event_id % 4 when 0 then '{"confidence": 0.5, "exploitable": true}' when 1 then '{"cwe": "CWE-1", "exploitable": false}' end as verdict from events""")
def x20_verdicts(t: Tables) -> DataFrame:
    """Whole, cut off, without the field, without braces."""
    reply = F.expr("""case event_id % 4 when 0 then concat('Sure: {"exploitable": true, "confidence": 0.5} ', event_type) when 1 then '{"exploitable": false, "cwe": "CWE-1", "summ' when 2 then '{"confidence": 1}' else event_type end""")
    return t.events.select("event_id", text.parse_verdict_col(reply).alias("verdict"))


@query("select event_id, case event_id % 3 when 0 then event_id when 1 then event_id % 7 else -1 end as n, concat('val x = ', event_type) as plain from events")
def x23_console(t: Tables) -> DataFrame:
    answer = F.expr("case event_id % 3 when 0 then concat('val res2: Int = ', cast(event_id as string), chr(10)) when 1 then concat(' ', cast(event_id % 7 as string)) else 'none' end")
    return t.events.select("event_id", F.coalesce(text.method_count(answer), F.lit(-1)).alias("n"), text.strip_ansi(F.concat(F.lit("\x1b[1;32mval x = \x1b[0m"), "event_type")).alias("plain"))


@query("select event_id, case event_id % 3 when 0 then concat('-', event_type, chr(10)) when 1 then concat('x', event_type, chr(10)) else '' end as block from events")
def x24_fenced_blocks(t: Tables) -> DataFrame:
    reply = F.expr("case event_id % 3 when 0 then concat('a ```go\nq\n``` ```diff\n-', event_type, '\n```') when 1 then concat('```\nx', event_type, '\n``` end') else event_type end")
    return t.events.select("event_id", text.fenced_block(reply).alias("block"))


@query("select vec_id, round(list_cosine_similarity(embedding::double[], list_reverse(embedding::double[])), 5) as cosine, 0.0::double as other from embeddings")
def x27_cosine(t: Tables) -> DataFrame:
    v = F.col("embedding")
    return t.embeddings.select("vec_id", F.round(X.cosine(v, F.reverse(v)), 5).alias("cosine"), X.cosine(v, F.slice(v, 1, 3)).alias("other"))


@query("with h as (select doc_id, hex(encode(text)) as h from documents) select doc_id, cast(len(list_filter(range(1, 101), lambda i: substr(h, cast(2 * i - 1 as bigint), 2) = '0A')) + 1 as int) as line from h")
def x28_line_of_offset(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.line_of(F.col("text"), F.lit(100)).alias("line"))


@query("select p_partkey, concat(case when p_size % 2 = 0 then '/api' else '' end, '/', p_brand) as route from part")
def x29_joined_paths(t: Tables) -> DataFrame:
    prefix, path = F.expr("case when p_size % 2 = 0 then '/api/' else '' end"), F.expr("concat(case when p_size % 3 = 0 then '/' else '' end, p_brand)")
    return t.part.select("p_partkey", routes.join_path(prefix, path).alias("route"))


@query("select event_id, case event_id % 6 when 0 then 'header' when 1 then 'header' when 2 then 'hunk' when 3 then 'add' when 4 then 'del' else 'context' end as kind from events")
def x30_diff_lines(t: Tables) -> DataFrame:
    line = F.expr("concat(element_at(array('+++ ', '--- ', '@@ ', '+', '-', ' '), cast(event_id % 6 as int) + 1), event_type)")
    return t.events.select("event_id", text.diff_class(line).alias("kind"))


@query("select event_id, case event_id % 4 when 0 then event_type when 1 then concat('why: ', event_type) when 2 then concat(repeat('j', 117), '...') else event_type end as title from events")
def x31_titles(t: Tables) -> DataFrame:
    summary = F.expr("case when event_id % 4 = 0 then event_type else '' end")
    why = F.expr("case event_id % 4 when 1 then concat('found — B5 confirmed (conf=0.9): why: ', event_type) when 2 then repeat('j', 130) else event_type end")
    return t.events.select("event_id", reports.title(summary, why).alias("title"))


@query("select event_id, case event_id % 4 when 0 then 'a,b' when 1 then 'b' when 2 then 'a,b' else 'a' end as sinks from events")
def x33_filtered_sinks(t: Tables) -> DataFrame:
    s = t.events.select("event_id", F.array(F.lit("a"), F.lit("b")).alias("sinks"), F.expr("case event_id % 4 when 0 then array('x.a', 'b()') when 1 then array('q', 'xby') when 2 then array('q') else array('a', 'q') end").alias("call_path"))
    return enrich.filter_sinks(s).select("event_id", F.array_join("sinks", ",").alias("sinks"))


@query("select event_id, case when event_id % 4 = 3 then event_type else '' end as clean from events")
def x34_null_text(t: Tables) -> DataFrame:
    return t.events.select("event_id", X.null_text(F.expr("case event_id % 4 when 0 then null when 1 then 'null' when 2 then '<empty>' else event_type end")).alias("clean"))


@query("""with recursive d as (select doc_id, string_split(text, chr(10)) as a from documents),
g(doc_id, lo, hi, size, grew) as (select doc_id, least(3, len(a) - 1), least(3, len(a) - 1), octet_length(encode(a[least(3, len(a) - 1) + 1])), true from d
  union all select doc_id, case when down then lo - 1 else lo end, h1, s1 + case when down then octet_length(encode(a[lo])) + 1 else 0 end, up or down from (
    select *, lo >= 1 and s1 + octet_length(encode(a[greatest(lo, 1)])) + 1 <= 400 as down from (
      select doc_id, a, lo, up, case when up then hi + 1 else hi end as h1, size + case when up then octet_length(encode(a[hi + 2])) + 1 else 0 end as s1 from (
        select g.doc_id, a, lo, hi, size, hi + 1 < len(a) and size + octet_length(encode(coalesce(a[hi + 2], ''))) + 1 <= 400 as up from g join d using (doc_id) where grew) x) y) z)
select doc_id, concat(case when lo > 0 then concat('... [truncated head]', chr(10)) else '' end, array_to_string(a[lo + 1:hi + 1], chr(10)), case when hi < len(a) - 1 then concat(chr(10), '... [truncated tail]') else '' end) as part
from g join d using (doc_id) where not grew""")
def w06_byte_windows(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.byte_window_col(F.col("text"), F.lit(3), F.lit(400)).alias("part"))


CODE_LINES = "concat('package x;', chr(10), '@RequestMapping(\"/', p_brand, '/\")', chr(10), case when p_size % 5 = 0 then 'void c' else 'public class C' end, ' ', chr(123), chr(10), case when p_size % 3 = 0 then '@Secured' else '' end, chr(10), case p_size % 4 when 0 then '@GetMapping(\"it\")' when 1 then '@RequestMapping(method = RequestMethod.PUT)' when 2 then '@PostMapping(\"/x\")' else 'none' end, chr(10), ' public void f() ', chr(123))"


@query("""select p_partkey as node_id, case p_size % 4 when 0 then 'GET' when 1 then 'PUT' else 'POST' end as verb, case when p_size % 5 = 0 then case p_size % 4 when 0 then 'it' when 1 then '/' else '/x' end else concat('/', p_brand, case p_size % 4 when 0 then '/it' when 1 then '' else '/x' end) end as route from part where p_size % 4 <> 3""")
def x14_route_of_method(t: Tables) -> DataFrame:
    src = t.sql(f"select p_partkey, {CODE_LINES} as text from part")
    files = src.select(F.col("p_partkey").cast("string").alias("path"), F.lit("java").alias("language"), "text")
    methods = src.select(F.col("p_partkey").alias("node_id"), F.lit("f").alias("name"), F.col("p_partkey").cast("string").alias("file"), F.lit(6).alias("line"))
    return routes.routes(methods, files)


@query("select p_partkey, case event when 0 then 'GET' when 1 then 'POST' end as verb, case event when 0 then concat('/', p_brand) when 1 then '/s' end as route from (select *, p_size % 3 as event from part) x where event < 2")
def j25_registered_routes(t: Tables) -> DataFrame:
    src = t.sql("select p_partkey, concat('app.get(''/a'', other)', chr(10), case p_size % 3 when 0 then concat('router.get( \"/', p_brand, '\" , mine)') when 1 then 'app.post(''/s'', mine)' else '' end, chr(10), 'app.put(''/z'', mine2)') as text from part")
    files = src.select(F.col("p_partkey").cast("string").alias("path"), F.lit("js").alias("language"), "text")
    methods = src.select(F.col("p_partkey").alias("node_id"), F.lit("mine").alias("name"), F.col("p_partkey").cast("string").alias("file"), F.lit(1).alias("line"))
    return routes.routes(methods, files).withColumnRenamed("node_id", "p_partkey")


@query("select p_partkey, p_size % 3 = 0 as secured, case when p_size % 5 <> 0 then 3 else 0 end as class_line from part")
def w03_w08_annotations(t: Tables) -> DataFrame:
    src = t.sql(f"select p_partkey, {CODE_LINES} as text from part").withColumn("lines", F.split("text", "\n"))
    return src.select("p_partkey", routes.annotated(F.col("lines"), F.lit(6), X.AUTH_ANNOTATIONS).alias("secured"), F.coalesce(routes.class_line(F.col("lines"), F.lit(6)), F.lit(0)).alias("class_line"))


@query("select p_partkey, case when p_size % 2 = 0 then 4 else 0 end as end_line from part")
def w04_brace_ends(t: Tables) -> DataFrame:
    src = t.sql("select p_partkey, translate(concat('void f()', chr(10), '< x(\">\"); // >', chr(10), ' if (y) < z(); >', chr(10), case when p_size % 2 = 0 then '>' else '<>' end, chr(10), 'int c;'), '<>', concat(chr(123), chr(125))) as text from part").withColumn("path", F.col("p_partkey").cast("string"))
    return text.brace_end(src.select(F.col("p_partkey").alias("id"), "path", F.lit(1).alias("line")), src.select("path", "text")).select(F.col("id").alias("p_partkey"), F.coalesce("end_line", F.lit(0)).alias("end_line"))


CRYPTO = """select event_id as surface_id, cast(event_id % 30 as int) as line, case event_id % 8 when 0 then concat('x', chr(10), 'use MD5') when 1 then 'describe desk' when 2 then concat('a', chr(10), chr(10), 'key = "k"; salt = "s"') when 3 then 'Math.random()' when 4 then 'SecureRandom; Math.random()' when 5 then 'PBKDF2(p, 5000)' when 6 then 'bcrypt 12' else 'iv= "z" and RC4' end as code,
  case when event_id % 16 = 1 then 'a.SHA1x' else 'b' end as sink from events"""


@query(f"""with s as ({CRYPTO}), f as (
  select surface_id, 'CWE-327' as cwe, greatest(1, line + case when surface_id % 8 = 0 and line > 0 then 1 else 0 end) as line, case when surface_id % 8 = 0 then 'MD5' when surface_id % 8 = 7 then 'RC4' else 'sha1' end as matched, 0.85 as conf from s where surface_id % 8 in (0, 7) or surface_id % 16 = 1
  union all select surface_id, 'CWE-321', greatest(1, line + case when surface_id % 8 = 2 and line > 0 then 2 else 0 end), case when surface_id % 8 = 2 then 'key = "' else 'iv= "' end, 0.85 from s where surface_id % 8 in (2, 7)
  union all select surface_id, 'CWE-338', greatest(1, line), 'Math.random(', 0.85 from s where surface_id % 8 = 3
  union all select surface_id, 'CWE-916', greatest(1, line), 'PBKDF2(p, 5000', 0.80 from s where surface_id % 8 = 5)
select surface_id, cwe, cast(line as int) as line, matched, cast(conf as double) as conf from f""")
def d24_crypto(t: Tables) -> DataFrame:
    return text.crypto_findings(t.sql(CRYPTO).withColumn("sink_nodes", F.array("sink")))


# joins and decisions ----------------------------------------------------------------------------------------------------
@query("""select seq as surface_id, case seq % 6 when 0 then 'Violation' when 2 then 'Safe' when 3 then 'Violation' else 'Inconclusive' end as verdict, case seq % 6 when 2 then '' when 3 then 'CWE-79' else 'CWE-22' end as cwe from findings""")
def j22_anchors_in_code(t: Tables) -> DataFrame:
    """Code anchors: in code, in a comment, safe, in single quotes (which count), in double quotes (which don't), of SQL (never by code)."""
    code = F.expr("""element_at(array('new File(x)', '// new File(x)', 'Paths.get(x).normalize()', "x('innerHTML')", 'x("pickle.load")', 'executeQuery(q)'), cast(seq % 6 as int) + 1)""")
    s = t.findings.select(F.col("seq").alias("surface_id"), F.lit("external_input").alias("kind"), F.array().cast("array<string>").alias("sink_nodes"), F.array(F.lit("next")).alias("call_path"), code.alias("code"), F.lit(False).alias("sanitized"))
    return contracts.verdicts(s, contracts.rulebook(t.spark))


@query("select seq, case when seq % 3 = 0 then concat('p', cast(seq as varchar)) else 'old' end as patch, case when seq % 3 = 0 then 'ok' else '' end as patch_status from findings")
def j10_patches(t: Tables) -> DataFrame:
    f = t.findings.select("seq", F.col("seq").cast("string").alias("finding_id"), F.lit("old").alias("patch"), F.lit("").alias("patch_status"))
    p = t.findings.where("seq % 3 = 0").select(F.col("seq").cast("string").alias("finding_id"), F.concat(F.lit("p"), F.col("seq").cast("string")).alias("patch"), F.lit("ok").alias("patch_status"))
    return scanners.with_patches(f, p).select("seq", "patch", "patch_status")


@query("""with f as (select event_id, concat('id', cast(user_id as varchar(9))) as cve, case when event_type = 'error' then 'CWE-89' else 'CWE-1' end as cwe, value from events), k as (select distinct concat('id', cast(user_id as varchar(9))) as cve from events where user_id % 4 = 0)
select event_id, f.cve in (select cve from k) as exploited from f""")
def j13_exploited(t: Tables) -> DataFrame:
    f = t.events.select(F.col("event_id").alias("finding_id"), F.concat(F.lit("id"), F.col("user_id").cast("string")).alias("cve"), F.lit("CWE-1").alias("cwe"), F.lit(0.0).alias("cvss"))
    known = t.events.where("user_id % 4 = 0").select(F.concat(F.lit("id"), F.col("user_id").cast("string")).alias("cve"))
    none = known.where("false").withColumn("epss", F.lit(0.0))
    return enrich.ssvc(f, known, none).select(F.col("finding_id").alias("event_id"), (F.col("exploitation") == "Active").alias("exploited"))


@query("""select event_id, case event_id % 6 when 0 then 'Yes' when 1 then 'Yes' else 'No' end as automatable, case event_id % 6 when 0 then 'Total' when 1 then 'Partial' when 2 then 'Total' when 3 then 'Partial' when 4 then 'Total' else 'Partial' end as impact from events""")
def j14_impact(t: Tables) -> DataFrame:
    """By CWE: both tables, the second alone, neither with a high and a low score."""
    cwe = F.expr("element_at(array('CWE-89', 'CWE-918', 'CWE-120', 'CWE-190', 'CWE-1', 'CWE-1'), cast(event_id % 6 as int) + 1)")
    f = t.events.select(F.col("event_id").alias("finding_id"), cwe.alias("cwe"), F.expr("case when event_id % 6 = 4 then 7.0D else 6.9D end").alias("cvss"), F.lit("").alias("cve"))
    none = f.where("false").select("cve")
    return enrich.ssvc(f, none, none.withColumn("epss", F.lit(0.0))).select(F.col("finding_id").alias("event_id"), "automatable", F.col("technical_impact").alias("impact"))


@query("""select doc_id, case when n_chars % 3 = 0 and n_chars % 5 = 0 then 'BOTH' when n_chars % 3 = 0 then 'SEMANTIC_ONLY' when n_chars % 5 = 0 then 'PATTERN_ONLY' end as layer from documents""")
def j16_ground_truth(t: Tables) -> DataFrame:
    """Findings outside of test code, suppressed ones and those of another CWE don't count."""
    d = t.documents.select("doc_id", "n_chars", F.col("doc_id").cast("string").alias("name"))
    expected = d.select("doc_id", F.col("name").alias("test_name"), F.lit(79).alias("cwe"))
    found = lambda rows, folder, src, sev, cwe: rows.select(F.concat(F.lit(folder), "name", F.lit(".java")).alias("file_path"), F.lit(cwe).alias("cwe"), F.lit(src).alias("source_path"), F.lit(sev).alias("severity"))
    rows = scanners.union(found(d.where("n_chars % 3 = 0"), "a/testcode/", "SEMANTIC", "LOW", "CWE-79"), found(d.where("n_chars % 5 = 0"), "a/testcode/", "PATTERN", "HIGH", "CWE-79: x"), found(d, "a/", "PATTERN", "HIGH", "CWE-79"), found(d, "a/testcode/", "BOTH", "SUPPRESSED", "CWE-79"), found(d, "a/testcode/", "BOTH", "HIGH", "CWE-89"))
    return reports.detected(expected, rows).select("doc_id", "layer")


@query("select path as surface_id, count(distinct cwe) as n_sinks, bool_and(seq % 2 = 0) as sanitized, arg_min(line, seq) filter (seq % 3 = 0) as sink_line from findings group by path")
def j18_surface_paths(t: Tables) -> DataFrame:
    """The first sink with a file gives the place; sanitized only if every path is."""
    p = t.findings.select(F.col("path").alias("surface_id"), "seq", F.col("cwe").alias("sink_name"), F.expr("case when seq % 3 = 0 then path else '' end").alias("sink_file"), F.col("line").alias("sink_line"), F.array(F.lit("a")).alias("steps"), F.expr("seq % 2 = 0").alias("sanitized"))
    return enrich.path_summary(p, with_steps=False).select("surface_id", F.size("sinks").cast("long").alias("n_sinks"), "sanitized", "sink_line")


MODELS = "select event_id, case event_id % 4 when 0 then concat('Model-', cast(user_id as varchar(9))) when 1 then concat('MODEL-', cast(user_id as varchar(9))) when 2 then 'unlisted' end as model_id, case when event_id % 8 < 4 then 'good' else 'bad' end as sha256 from events"


@query(f"select event_id, case when event_id % 4 >= 2 then 'WARN' when sha256 = 'good' then 'PASS' else 'BLOCK' end as status from ({MODELS}) x")
def j24_d29_models(t: Tables) -> DataFrame:
    m = t.sql(MODELS).withColumn("path", F.col("event_id").cast("string"))
    registry = t.events.groupBy("user_id").agg(F.count("*")).select(F.concat(F.lit("model-"), F.col("user_id").cast("string")).alias("model_id"), F.explode(F.array(F.struct(F.lit("good").alias("sha256"), F.lit(0).alias("ord")), F.struct(F.lit("late").alias("sha256"), F.lit(1).alias("ord")))).alias("x")).select("model_id", "x.*")
    return scanners.verified_models(m, registry).select(F.col("path").cast("long").alias("event_id"), "status")


@query(f"select call_id, case call_name when 'getParameter' then 'source' when 'request.args.get' then 'source' else 'sink' end as role from ({CALLS}) x where (call_id % 3 = 0) and ((language = 'java' and call_name in ('stmt.executeQuery', 'Runtime.exec', 'getParameter')) or (language = 'python' and call_name in ('request.args.get', 'subprocess.run', 'yaml.load')))")
def j27_scope_calls(t: Tables) -> DataFrame:
    calls = t.sql(CALLS).where("language in ('java', 'python') and ((language = 'java') = (call_name in ('stmt.executeQuery', 'Runtime.exec', 'getParameter', 'innerHelper')))").withColumn("file", F.expr("concat('f', call_id % 3)"))
    own = calls.where("(language = 'java') or call_name in ('request.args.get', 'subprocess.run', 'yaml.load', 'innerHelper')")
    return taxonomy.scope_calls(own, t.spark.createDataFrame([("f0",)], "path string"), t.spark).select("call_id", "role")


@query("select seq, greatest(0, len(path)) as n from findings where seq < 0")
def j12_long_names(t: Tables) -> DataFrame:
    """Names of 40 bytes and more, and those with a colon, are never looked for in code."""
    s = t.findings.select(F.col("seq").cast("string").alias("surface_id"), F.lit("a/b").alias("file"), F.concat(F.repeat(F.lit("x"), 45), F.lit(" g:z")).alias("code"))
    p = t.spark.createDataFrame([("x" * 45, "C1", 1.0), ("g:z", "C2", 2.0)], "key string, cve string, cvss double")
    return enrich.match_packages(s, p).select(F.col("surface_id").cast("long").alias("seq"), F.length("cve").cast("long").alias("n"))


@query("select event_id, case event_id % 5 when 0 then 'http_param' when 1 then 'http_body' when 2 then 'stdin' when 3 then 'mystery' else 'mystery' end as source, case event_id % 5 when 0 then 'sql' when 1 then 'command' when 2 then 'unknown' when 3 then 'redirect' else 'eval' end as sink from events")
def d23_kinds(t: Tables) -> DataFrame:
    """By language; the last two unlisted: the name itself, and generic sinks."""
    names = "array('getParameter', 'request.form', 'input', 'mystery', 'mystery'), array('stmt.executeQuery', 'os.system', 'nothing', 'forwardTo', 'evalX'), array('java', 'python', 'python', 'java', 'cobol')"
    pick = lambda k: F.expr(f"element_at({['array(' + p for p in names.split('array(')[1:]][k].rstrip(', ')}, cast(event_id % 5 as int) + 1)")
    e = t.events.select(F.col("event_id").alias("call_id"), pick(0).alias("a"), pick(1).alias("b"), pick(2).alias("language"))
    sources = taxonomy.kinds(e.select("call_id", "language", F.col("a").alias("call_name")), taxonomy.rules(t.spark, taxonomy.SOURCES, bare=False), sink=False)
    sinks = taxonomy.kinds(e.select("call_id", "language", F.col("b").alias("call_name")), taxonomy.rules(t.spark))
    return sources.withColumnRenamed("kind", "source").join(sinks.withColumnRenamed("kind", "sink"), "call_id").withColumnRenamed("call_id", "event_id")


@query("select event_id as call_id, case event_id % 4 when 0 then 'sql' when 1 then 'file_write' else 'command' end as kind from events where event_id % 4 < 3")
def u07_all_sinks(t: Tables) -> DataFrame:
    c = t.events.select(F.col("event_id").alias("call_id"), F.lit("java").alias("language"), F.expr("case event_id % 4 when 0 then 'executeQuery' else '<init>' end").alias("call_name"), F.expr("case event_id % 4 when 1 then 'java.io.FileWriter.<init>:void' when 2 then 'java.lang.ProcessBuilder.<init>' else 'java.util.ArrayList.<init>' end").alias("full_name"))
    return taxonomy.all_sinks(c, t.spark)


@query("""select event_id, user_id % 5 = 0 as is_suppressed, case when user_id % 5 = 0 then case when user_id % 3 = 0 then 'framework_safe' else 'test_file' end else '' end as reason from events""")
def d07_automatic_suppression(t: Tables) -> DataFrame:
    f = t.events.select("event_id", F.expr("case when user_id % 5 = 0 then case when user_id % 3 = 0 then 'x/migrations/1.py' else 'a/tests/x.go' end else 'a/b.go' end").alias("path"), F.lit("HIGH").alias("severity"), F.lit("").alias("suppress_reason"))
    return dedup.suppressed(f).select("event_id", (F.col("severity") == "SUPPRESSED").alias("is_suppressed"), F.col("suppress_reason").alias("reason"))


@query("""select seq, case when seq % 4 = 0 then 'SUPPRESSED' when cwe = 'CWE-89' then 'SUPPRESSED' else 'HIGH' end as severity, case when seq % 4 = 0 then 'test_file' when cwe = 'CWE-89' then 'orm' else '' end as reason from findings""")
def d08_sidecar_rules(t: Tables) -> DataFrame:
    f = dedup.with_defaults(t.findings).withColumn("severity", F.expr("case when seq % 4 = 0 then 'SUPPRESSED' else 'HIGH' end")).withColumn("suppress_reason", F.expr("case when seq % 4 = 0 then 'test_file' else '' end"))
    rules = t.spark.createDataFrame([(0, "", "", "cwe-89", "orm")], "rule_idx int, id string, path string, cwe string, reason string")
    return dedup.apply_rules(f, rules).select("seq", "severity", F.col("suppress_reason").alias("reason"))


@query("select a.n_name as a, b.n_name as b, round(1 - levenshtein(a.n_name, b.n_name) / greatest(length(a.n_name), length(b.n_name)), 6) as similarity from nation a, nation b")
def d12_edit_similarity(t: Tables) -> DataFrame:
    n = t.nation.select("n_name")
    both = n.withColumnRenamed("n_name", "a").crossJoin(F.broadcast(n.withColumnRenamed("n_name", "b")))  # a dimension table of 25 rows
    return both.select("a", "b", F.round(X.edit_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query("select seq as surface_id, cwe, path, line as line_start, line + 4 as line_end, 'MEDIUM' as severity, cast(0.65 as double) as confidence, sha256(concat(cwe, ':', path, ':', cast(line as varchar))) as finding_id from findings")
def d16_violation_findings(t: Tables) -> DataFrame:
    v = t.findings.select(F.col("seq").alias("surface_id"), "cwe", F.col("path").alias("file"), F.col("line").alias("window_start"), (F.col("line") + 4).alias("sink_line"))
    return reconcile.violation_findings(v)


@query("""select seq as surface_id, case when seq % 3 = 0 then 'CWE-9' when seq % 2 = 0 then 'CWE-862' else cwe end as cwe, case when seq % 4 = 0 then line else 99 end as line, case when conf <= 0 then 0.5 else conf end as confidence,
  case when not exploitable then 'LOW' when (case when conf <= 0 then 0.5 else conf end) >= 0.92 then 'BLOCK' when conf >= 0.75 then 'HIGH' when conf >= 0.6 then 'MEDIUM' when (case when conf <= 0 then 0.5 else conf end) >= 0.3 then 'LOW' else 'SUPPRESSED' end as severity, not exploitable as pinned, case when seq % 5 = 0 then 'short' else 'a long reason' end as summary from findings""")
def d17_verdict_findings(t: Tables) -> DataFrame:
    v = t.findings.select(F.col("seq").alias("surface_id"), F.expr("case when seq % 2 = 0 then 'idor_candidate' else 'external_input' end").alias("kind"), F.expr("case when seq % 3 = 0 then 'CWE-9' else '' end").alias("contract_cwe"), F.col("cwe").alias("model_cwe"), "exploitable", F.col("conf").alias("confidence"),
        F.expr("case when seq % 4 = 0 then line else 0 end").alias("sink_line"), F.lit(99).alias("start_line"), F.expr("case when seq % 5 = 0 then 'short' else '' end").alias("summary"), F.lit("a long reason").alias("justification"), F.lit("code").alias("code"))
    return reconcile.verdict_findings(v).select("surface_id", "cwe", "line", "confidence", "severity", "pinned", "summary")


@query("select seq, case when seq % 5 = 0 or (seq % 5 = 1 and exploitable and conf >= 0.85) or (seq % 5 = 2 and exploitable) then least(conf, 0.5) else conf end as confidence from findings")
def d18_capped(t: Tables) -> DataFrame:
    """In turn: no tool call, a single one, a hedge, outside of the rulebook, well investigated."""
    v = t.findings.select("seq", F.expr("cast(case seq % 5 when 0 then 0 when 1 then 1 when 3 then 0 else 3 end as int)").alias("n_tools"), F.lit(True).alias("has_graph"), F.expr("seq % 5 <> 3").alias("in_rulebook"), "exploitable", F.col("conf").alias("confidence"), F.expr("case when seq % 5 = 2 then 'It is Probably so' else 'sure' end").alias("justification"))
    return reconcile.capped(v).select("seq", "confidence")


@query("select seq, round(case when exploitable and conf >= 0.85 and seq % 2 = 0 then conf - 0.3 else conf end, 6) as confidence, exploitable and not (conf >= 0.85 and seq % 2 = 0 and conf - 0.3 < 0.6) as exploitable from findings")
def d19_self_consistent(t: Tables) -> DataFrame:
    v = t.findings.select("seq", "exploitable", F.col("conf").alias("confidence"), F.expr("case when seq % 2 = 0 then 'I say\nNO.' else 'YES' end").alias("second_answer"))
    return reconcile.self_consistent(v).select("seq", F.round("confidence", 6).alias("confidence"), "exploitable")


@query("""with x as (select seq, conf, case when seq % 3 = 0 then least(conf + 0.2, 1.0) else conf end as c from findings), b as (select *, case when c >= 0.92 then 0 when c >= 0.75 then 1 when c >= 0.6 then 2 when c >= 0.3 then 3 else 4 end as r from x)
select seq, round(c, 6) as confidence, case when seq % 3 = 0 and r < 2 then case r when 0 then 'BLOCK' else 'HIGH' end else 'MEDIUM' end as severity from b""")
def d25_proven(t: Tables) -> DataFrame:
    f = t.findings.select("seq", F.col("conf").alias("confidence"), F.lit("MEDIUM").alias("severity"), F.expr("case when seq % 3 = 0 then 'confirmed' else 'failed' end").alias("proof_status"))
    return reconcile.proven(f).select("seq", F.round("confidence", 6).alias("confidence"), "severity")


@query("select file_path from current_files")
def d30_full_scan(t: Tables) -> DataFrame:
    """Nothing changed: everything is scanned."""
    h = t.current_files.select("file_path", F.sha2("text", 256).alias("content_hash"))
    return changes.scope(changes.diff(h, h), h)


@query("with c as (select file_path, sha256(text) as h from current_files), p as (select file_path, sha256(text) as h from previous) select file_path from p where file_path not in (select file_path from c)")
def u04_removed(t: Tables) -> DataFrame:
    h = lambda df: df.select("file_path", F.sha2("text", 256).alias("content_hash"))
    return changes.diff(h(t.current_files), h(t.previous)).where("change_type = 'removed'").select("file_path")


# rollups and order -------------------------------------------------------------------------------------------------------
@query("select case when user_id % 3 = 0 then 'Safe' else 'Violation' end as verdict, count(*) as n, count(*) filter (value < 20) as n_without_evidence from events group by 1")
def a14_verdict_histogram(t: Tables) -> DataFrame:
    return contracts.histogram(t.events.select(F.expr("case when user_id % 3 = 0 then 'Safe' else 'Violation' end").alias("verdict"), F.expr("case when value < 20 then '' else 'e' end").alias("evidence")))


@query("select count(distinct user_id) as n_surfaces, count(distinct user_id) filter (event_type = 'signup') as n_attributed, round(cast(100.0 * (count(distinct user_id) - count(distinct user_id) filter (event_type = 'signup')) as double) / count(distinct user_id), 6) as gap_percent from events")
def a15_coverage(t: Tables) -> DataFrame:
    own = t.events.select(F.col("user_id").alias("surface_id"), "event_type")
    return enrich.coverage(own, own.where("event_type = 'signup'"))


@query("select to_id as sink_name, count(distinct from_id) as n from edges group by to_id")
def a12_claimants(t: Tables) -> DataFrame:
    """Claimants by sink, over what the guard keeps at a limit that drops none."""
    a = enrich.fan_in_guard(t.edges.select(F.col("to_id").alias("sink_name"), F.col("from_id").alias("surface_id")), 1 << 30)
    return a.groupBy("sink_name").agg(F.count_distinct("surface_id").alias("n"))


@query("select cast(event_id % 2 = 0 as boolean) as known from events where event_id <= 2")
def a19_exists(t: Tables) -> DataFrame:
    s = t.events.where("event_id % 2 = 0").select(F.lit("p").alias("project_id"), F.col("event_id").cast("string").alias("finding_id"))
    ids = [r.event_id for r in t.events.where("event_id <= 2").select("event_id").collect()]
    return t.spark.createDataFrame([(store.exists(s, project_id="p", finding_id=str(i)),) for i in ids], "known boolean")


@query("select path as surface_id, count(*) * 2 as n, array_to_string(list_sort(list(distinct concat('s', cast(line as varchar)))), ',') as names from findings group by path")
def a21_step_names(t: Tables) -> DataFrame:
    p = t.findings.select(F.col("path").alias("surface_id"), "seq", F.col("cwe").alias("sink_name"), F.col("path").alias("sink_file"), F.col("line").alias("sink_line"), F.array(F.concat(F.lit("s"), F.col("line").cast("string")), F.concat(F.lit("s"), F.col("line").cast("string"))).alias("steps"), F.lit(False).alias("sanitized"))
    out = enrich.path_summary(p)
    return out.select("surface_id", F.size("steps").cast("long").alias("n"), F.array_join(F.array_sort(F.array_distinct("steps")), ",").alias("names"))


@query("select path as surface_id, bool_and(line > 1) as sanitized from findings group by path")
def a22_sanitized(t: Tables) -> DataFrame:
    p = t.findings.select(F.col("path").alias("surface_id"), "seq", F.col("cwe").alias("sink_name"), F.col("path").alias("sink_file"), F.col("line").alias("sink_line"), F.array(F.lit("a")).alias("steps"), (F.col("line") > 1).alias("sanitized"))
    return enrich.path_summary(p, with_steps=False).select("surface_id", "sanitized")


WORK = "select concat('s', cast(user_id % 50 as varchar(9))) as scan_id, 'triage' as component, cast(event_id as varchar(20)) as surface_id, case event_type when 'view' then 'pending' when 'error' then 'error' else 'done' end as status, '' as payload, event_id % 11 as created_at, 0 as updated_at from events"


@query(f"select scan_id, count(*) filter (status = 'pending') as pending, count(*) filter (status = 'done') as done, count(*) filter (status = 'error') as error from ({WORK}) x group by scan_id")
def a02_work_counts(t: Tables) -> DataFrame:
    return reports.work_counts(t.sql(WORK))


@query("select strftime(ts, '%Y-%m-%d') as run_id, case when value >= 40 then 'HIGH' else 'LOW' end as severity, count(*) as n from events where strftime(ts, '%Y-%m-%d') = (select min(strftime(ts, '%Y-%m-%d')) from events) group by all")
def a01_severity_of_run(t: Tables) -> DataFrame:
    e = t.events.select(F.date_format("ts", "yyyy-MM-dd").alias("run_id"), F.expr("case when value >= 40 then 'HIGH' else 'LOW' end").alias("severity"))
    first = e.agg(F.min("run_id").alias("m")).first()["m"]
    return reports.by_severity(e.where(F.col("run_id") == first)).withColumn("run_id", F.lit(first))


@query("select seq, case when seq % 3 = 0 then null else conf end as conf, row_number() over (order by case when seq % 3 = 0 then null else conf end desc nulls last, seq) as position from findings")
def o02_null_confidences(t: Tables) -> DataFrame:
    f = t.findings.select("seq", F.lit("HIGH").alias("severity"), F.expr("case when seq % 3 = 0 then null else conf end").alias("conf"), "path")
    return reports.ordered(f).select("seq", "conf", "position")


@query(f"select finding_id, first_seen_at from ({NEWEST}) x where project_id = 'p2' order by first_seen_at desc, finding_id limit 100")
def o04_newest_first(t: Tables) -> DataFrame:
    return store.newest(t.sql(NEWEST), "p2").select("finding_id", "first_seen_at").limit(100)


@query("""with c as (select to_id, from_id, row_number() over (partition by to_id order by from_id) as k, count(*) over (partition by to_id) as total from (select distinct to_id, from_id from edges where from_id in (select node_id from nodes)) x)
select to_id, max(total) as total, string_agg(from_id, ',' order by from_id) filter (k <= 3) as results, max(total) > 3 as truncated from c group by to_id""")
def o06_first_callers(t: Tables) -> DataFrame:
    """The feature is the cap: three of each node's callers, with the true total."""
    return tools.first_nodes(t.edges, t.nodes, 3).withColumn("results", F.array_join("results", ","))


@query(f"select path, min(event_id) as first from ({FILES}) x group by path order by path")
def o10_scope_files(t: Tables) -> DataFrame:
    modules = _files(t).groupBy(F.expr("event_id % 7").alias("m")).agg(F.collect_set("path").alias("scope_files"))  # a dozen paths
    return scanners.scope_files(modules).join(_files(t).groupBy("path").agg(F.min("event_id").alias("first")), "path")


@query("select event_type as scanner, count(*) as n from events where event_type in ('view', 'click', 'error') group by event_type")
def u01_registry(t: Tables) -> DataFrame:
    """Three scanners find something, one doesn't apply, one fails."""

    def finds(kind: str):
        return lambda files: files.where(F.col("event_type") == kind).select(F.lit("r").alias("rule_id"), F.col("event_type").alias("path"), F.lit(1).alias("line_start"), F.lit("CWE-1").alias("cwe"), F.lit(0.5).alias("conf"))

    def fails(files: DataFrame) -> DataFrame:
        raise ValueError("no binary")

    own = [scanners.Scanner(k, finds(k)) for k in ("view", "click", "error")]
    r = scanners.Registry(*own, scanners.Scanner("rust", finds("signup"), lambda langs, manifests: "rust" in langs), scanners.Scanner("broken", fails))
    stack = t.spark.createDataFrame([(["go"], ["go.mod"])], "languages array<string>, manifests array<string>")
    return r.run(t.events, stack).groupBy("scanner").agg(F.count("*").alias("n"))


@query("select 'a' as path_kind, count(*) as n from events where event_id % 2 = 0 union all select 'b', count(*) from events where event_id % 3 = 0 union all select 'c', count(*) from events where event_id % 5 = 0")
def u02_detection_paths(t: Tables) -> DataFrame:
    own = lambda kind, k: t.events.where(f"event_id % {k} = 0").select(F.lit(kind).alias("path_kind"), "event_id")
    return scanners.union(own("a", 2), own("b", 3).select("event_id", "path_kind"), own("c", 5)).groupBy("path_kind").agg(F.count("*").alias("n"))


@query("select path as surface_id, min(case when conf >= 0.5 then 0 else 1 end) as bucket from findings group by path")
def u08_confirmed_first(t: Tables) -> DataFrame:
    rows = scanners.union(t.findings.where("conf >= 0.5").withColumn("bucket", F.lit(0)), t.findings.where("conf < 0.5").withColumn("bucket", F.lit(1)))
    return reconcile.first_per_surface(rows.select(F.col("path").alias("surface_id"), "bucket", "seq")).select("surface_id", "bucket")


@query("select from_id as id from edges intersect select to_id from edges")
def u03_on_paths(t: Tables) -> DataFrame:
    """Nodes that something reaches and that reach something: the forward and the backward search meet."""
    forward = graph.depths(t.edges, t.edges.select(F.col("from_id").alias("id")).distinct(), 1).where("depth >= 0").select("id")
    has_caller = t.edges.select(F.col("to_id").alias("id")).distinct()
    has_callee = t.edges.select(F.col("from_id").alias("id")).distinct()
    return forward.join(has_caller, "id", "left_semi").join(has_callee, "id", "left_semi")


# graphs ------------------------------------------------------------------------------------------------------------------
@query("select to_id as from_id, from_id as to_id from edges")
def g02_reversed(t: Tables) -> DataFrame:
    return graph.reversed_edges(t.edges)


@query("""with recursive r(s, id, d) as (select distinct to_id, to_id, 0 from edges union select s, from_id, d + 1 from r join edges on to_id = id where d < 3),
m as (select s, id, min(d) as d from r group by s, id), h as (select s, id, d, min(d) over (partition by s) as nearest from m where id like '%3' and id in (select from_id from edges))
select s as source_id, min(id) as surface_id from h where d = nearest group by s having count(*) = 1""")
def g05_nearest_surface(t: Tables) -> DataFrame:
    sources = t.edges.select(F.col("to_id").alias("source_id")).distinct()
    callers = t.edges.select(F.col("to_id").alias("node_id"), F.col("from_id").alias("caller_id"))
    return graph.nearest_surface(sources, callers, t.edges.where("from_id like '%3'").select(F.col("from_id").alias("surface_id")).distinct())


@query("""with recursive r(s, id, d) as (select node_id, node_id, 0 from nodes where file = 'src/Brand1.java' union select s, from_id, d + 1 from r join edges on to_id = id where d < 3),
m as (select s, id, min(d) as d from r group by s, id), h as (select *, row_number() over (partition by s order by d, id) as k from m where id like '%9')
select s as node_id, id as route_node, d as depth from h where k = 1""")
def g06_first_route(t: Tables) -> DataFrame:
    callers = t.edges.select(F.col("to_id").alias("node_id"), F.col("from_id").alias("caller_id"))
    return graph.first_route(t.nodes.where("file = 'src/Brand1.java'"), callers, t.nodes.where("node_id like '%9'"), hops=3)


@query("select node_id, regexp_matches(lower(name), 'auth|login|logout|token|verify|validate|permission|access|security|credential|principal|session|jwt') or line % 7 = 0 as is_auth from nodes")
def g10_auth_methods(t: Tables) -> DataFrame:
    code = F.expr("case when line % 7 = 0 then concat(code, ' @RolesAllowed') else code end")
    return t.nodes.select("node_id", targeting.is_auth_method(F.col("name"), code).alias("is_auth"))


@query("select distinct file from (select 'src/Brand1.java' as file union all select m.file from edges e join nodes n on n.node_id = e.from_id join nodes m on m.node_id = e.to_id where n.file = 'src/Brand1.java' and n.node_type = 'METHOD' and m.node_type = 'METHOD' union all select m.file from edges e join nodes n on n.node_id = e.to_id join nodes m on m.node_id = e.from_id where n.file = 'src/Brand1.java' and n.node_type = 'METHOD' and m.node_type = 'METHOD') x")
def g11_expanded_files(t: Tables) -> DataFrame:
    return _graph(t).expand(t.spark.createDataFrame([("src/Brand1.java",)], "file string"))


@query("select to_id, count(distinct from_id) as n_callers from edges group by to_id having count(distinct from_id) >= 50")
def g12_hubs_force_a_full_build(t: Tables) -> DataFrame:
    return _graph(t).hubs()


@query("select event_id, case when event_id % 3 = 0 then 'a.java' else 'b.java' end as sink_file, case when event_id % 2 = 0 then 9 when event_id % 3 = 0 then 4 else 0 end as sink_line from events")
def g14_normalised_paths(t: Tables) -> DataFrame:
    """A sink without file lies in the source's, one without line on that of the first step in its file."""
    place = lambda file, line: F.struct(file.alias("file"), line.cast("int").alias("line"))
    p = t.events.select("event_id", place(F.lit("a.java"), F.lit(1)).alias("source"), place(F.expr("case when event_id % 3 = 0 then '' else 'b.java' end"), F.expr("case when event_id % 2 = 0 then 9 else 0 end")).alias("sink"), F.array(place(F.lit("c.java"), F.lit(3)), place(F.lit("a.java"), F.lit(0)), place(F.lit("a.java"), F.lit(4))).alias("steps"))
    return enrich.normalise_path(p).select("event_id", "sink_file", "sink_line")


@query("select node_id from nodes where node_type = 'CALL'")
def src16_pages(t: Tables) -> DataFrame:
    """Read page by page until one is empty."""
    rows = [(r["node_id"],) for page in _graph(t).pages("CALL", 500) for r in page]
    return t.spark.createDataFrame(rows, "node_id string")


# sources -----------------------------------------------------------------------------------------------------------------
@query("select doc_id as path, cast(unnest(range(1, len(string_split(text, chr(10))) + 1)) as int) as line, unnest(string_split(text, chr(10))) as code from documents")
def src04_lines(t: Tables) -> DataFrame:
    return text.lines(t.documents.select(F.col("doc_id").alias("path"), "text"))


@query(f"select array_to_string(list_sort(list(distinct lang)), ',') as languages, 'go.mod,pom.xml' as manifests from (select case event_id % 12 when 3 then 'python' when 10 then 'python' when 4 then 'go' when 8 then 'go' when 5 then 'typescript' when 7 then 'kotlin' when 11 then 'kotlin' when 9 then 'rust' when 6 then 'java' else 'java' end as lang from ({FILES}) x) y")
def src03_stack(t: Tables) -> DataFrame:
    extra = t.spark.createDataFrame([("a/go.mod",), ("pom.xml",), ("pom.xml.bak",)], "path string")
    s = readers.stack(_files(t).select("path").unionByName(extra))
    return s.select(F.array_join("languages", ",").alias("languages"), F.array_join("manifests", ",").alias("manifests"))


@query("select event_id, concat('r', event_type) as rule_id, concat('src/', event_type) as path, cast(user_id as int) as line_start, 'CWE-798' as cwe, cast(0.9 as double) as conf from events")
def src06_secret_reports(t: Tables) -> DataFrame:
    r = F.struct(F.lit("d").alias("Description"), F.col("user_id").cast("int").alias("StartLine"), F.col("event_id").cast("int").alias("EndLine"), F.concat(F.lit("src/"), "event_type").alias("File"), F.concat(F.lit("r"), "event_type").alias("RuleID"), F.lit("s").alias("Secret"))
    got = readers.secret_findings(t.events.select(F.to_json(F.array(r)).alias("json")))
    return got.select(F.col("line_end").cast("long").alias("event_id"), "rule_id", "path", "line_start", "cwe", "conf")


@query("select distinct concat('CVE-', cast(user_id as varchar)) as cve from events")
def src09_exploited(t: Tables) -> DataFrame:
    return readers.exploited(t.events.select(F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("CVE-"), F.col("user_id").cast("string")).alias("cveID"))).alias("vulnerabilities"))).alias("json")))


@query("select concat('CVE-', cast(event_id as varchar)) as cve, case when event_id % 3 = 0 then 0.0 else cast(event_id % 100 as double) / 100 end as epss from events")
def src10_epss(t: Tables) -> DataFrame:
    score = F.expr("case when event_id % 3 = 0 then 'n/a' else cast(event_id % 100 / 100 as string) end")
    return readers.epss(t.events.select(F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("CVE-"), F.col("event_id").cast("string")).alias("cve"), score.alias("epss"))).alias("data"))).alias("json")))


@query("select concat('T', cast(event_id as varchar)) as test_name, event_type as category, event_id % 2 = 0 as real_vuln, cast(event_id % 900 as int) as cwe from events where event_id % 5 <> 0")
def src13_ground_truth(t: Tables) -> DataFrame:
    """Ragged rows: a fifth has too few fields, some have more, and there are comments."""
    line = F.expr("case when event_id % 5 = 0 then concat('T', event_id, ',x') else concat('T', event_id, ', ', event_type, ',', event_id % 2 = 0, ' ,', event_id % 900, case when event_id % 7 = 0 then ',more' else '' end) end")
    rows = t.events.select(line.alias("value")).unionByName(t.events.where("event_id % 100 = 1").select(F.lit("# a, b, c, d").alias("value")))
    return readers.truth_rows(rows)


@query("select doc_id, concat('CWE-', cast(doc_id as varchar)) as cwe, 'body' as body from documents")
def src18_sections(t: Tables) -> DataFrame:
    doc = F.concat(F.lit("intro\n## CWE-"), F.col("doc_id").cast("string"), F.lit("\nbody\n\n## Other\n"), F.replace("text", F.lit("#"), F.lit("")))
    return readers.sections(t.documents.select(doc.alias("text"))).select(F.substring("cwe", 5, 20).cast("long").alias("doc_id"), "cwe", "body")


@query("select p_partkey, 2 as line, 'sql' as kind from part where p_size % 4 = 0 union all select p_partkey, 3, 'command' from part where p_size % 4 = 1")
def src20_flagged_lines(t: Tables) -> DataFrame:
    src = t.sql("select p_partkey, concat('x', chr(10), case when p_size % 4 = 0 then 's.executeQuery (q)' else 'executeQuery' end, chr(10), case when p_size % 4 = 1 then 'Runtime.exec(c)' else 'y()' end) as text from part")
    got = taxonomy.flag_lines(src.select(F.col("p_partkey").alias("path"), F.lit("java").alias("language"), "text"), taxonomy.rules(t.spark))
    return got.select(F.col("path").alias("p_partkey"), "line", "kind")


# sinks -------------------------------------------------------------------------------------------------------------------
def _rows(df: DataFrame, name: str, **own: Column) -> DataFrame:
    """Rows of a declared table; columns without a value are null."""
    fields = [part.split() for part in schemas.TABLES[name].split(", ")]
    return df.select(*[own[c].cast(kind).alias(c) if c in own else F.lit(None).cast(kind).alias(c) for c, kind in fields])


@query("select concat('p', cast(user_id as varchar)) as project_id, max(event_id) as built_at from events group by user_id")
def snk03_build_upsert(t: Tables) -> DataFrame:
    per = lambda pick: t.events.groupBy("user_id").agg(pick("event_id").alias("e"))
    rows = lambda df: _rows(df, "cpg_builds", project_id=F.concat(F.lit("p"), F.col("user_id").cast("string")), built_at=F.col("e"))
    return store.upsert(rows(per(F.min)), rows(per(F.max)), schemas.KEYS["cpg_builds"]).select("project_id", "built_at")


@query("select concat('root', cast(user_id as varchar)) as root_path, concat(case when user_id % 2 = 0 then 'old' else 'new' end, cast(user_id as varchar)) as project_id, cast(case when user_id % 2 = 0 then 1 else 2 end as bigint) as first_seen_at, cast(2 as bigint) as last_scanned_at from events group by user_id")
def snk04_project_upsert(t: Tables) -> DataFrame:
    users = t.events.select("user_id").distinct()
    rows = lambda df, name, at: _rows(df, "projects", root_path=F.concat(F.lit("root"), F.col("user_id").cast("string")), project_id=F.concat(F.lit(name), F.col("user_id").cast("string")), first_seen_at=F.lit(at), last_scanned_at=F.lit(at))
    return store.upsert_projects(rows(users.where("user_id % 2 = 0"), "old", 1), rows(users, "new", 2)).select("root_path", "project_id", "first_seen_at", "last_scanned_at")


@query("select concat('r', cast(user_id as varchar)) as run_id, cast(7 as bigint) as started_at, case when user_id = (select min(user_id) from events) then 'complete' else 'running' end as status, 'default' as scan_mode, cast(case when user_id = (select min(user_id) from events) then 5 else 0 end as int) as findings_total from events group by user_id")
def snk05_scan_runs(t: Tables) -> DataFrame:
    new = _rows(t.events.select("user_id").distinct(), "scan_runs", run_id=F.concat(F.lit("r"), F.col("user_id").cast("string")))
    runs = store.create_run(new.where("false"), new, 7)
    first = t.events.agg(F.min("user_id").alias("m")).first()["m"]
    return store.finalize_run(runs, f"r{first}", 9, 3, 5).select("run_id", "started_at", "status", "scan_mode", F.coalesce("findings_total", F.lit(0)).alias("findings_total"))


@query("select concat('f', cast(user_id as varchar)) as finding_id, max(event_type) as exploitation from events group by user_id")
def snk07_score_replace(t: Tables) -> DataFrame:
    per = lambda pick: _rows(t.events.groupBy("user_id").agg(pick("event_type").alias("e")), "ssvc_scores", finding_id=F.concat(F.lit("f"), F.col("user_id").cast("string")), exploitation=F.col("e"))
    return store.upsert(per(F.min), per(F.max), schemas.KEYS["ssvc_scores"]).select("finding_id", "exploitation")


@query("select distinct concat('f', cast(user_id as varchar)) as finding_id, 'again' as reason from events")
def snk09_suppression_upsert(t: Tables) -> DataFrame:
    rows = lambda why: _rows(t.events.select("user_id").distinct(), "suppressions", project_id=F.lit("p"), finding_id=F.concat(F.lit("f"), F.col("user_id").cast("string")), reason=F.lit(why))
    once = store.upsert(rows("first"), rows("again"), schemas.KEYS["suppressions"])
    return store.upsert(once, rows("again"), schemas.KEYS["suppressions"]).select("finding_id", "reason")


@query(f"select surface_id, case when cast(surface_id as bigint) % 2 = 0 then 'done' else 'pending' end as status from ({WORK}) x where scan_id = 's7' and status = 'pending'")
def snk10_work_queue(t: Tables) -> DataFrame:
    """Insert-ignore twice, poll, mark half of it."""
    items = t.sql(WORK)
    queue = store.insert_new(items, items.withColumn("status", F.lit("new")), schemas.KEYS["work_items"])
    polled = store.pending(queue, "s7", "triage")
    return store.mark(polled, polled.where("cast(surface_id as bigint) % 2 = 0"), "done", 9).select("surface_id", "status")


@query("select concat('s', cast(user_id % 4 as varchar)) as scan_id, count(*) as n from events where user_id % 4 <> 1 group by 1")
def snk11_pending_findings(t: Tables) -> DataFrame:
    rows = _rows(t.events, "pending_findings", scan_id=F.expr("concat('s', user_id % 4)"), finding_id=F.col("event_id").cast("string"))
    kept = store.delete(store.insert_new(rows.where("false"), rows, schemas.KEYS["pending_findings"]), t.spark.createDataFrame([("s1",)], "scan_id string"), ("scan_id",))
    return kept.groupBy("scan_id").agg(F.count("*").alias("n"))


PERSISTED = "select concat('f', cast(seq as varchar(20))) as finding_id, path, cwe, line, conf, src, 'HIGH' as severity, '' as suppress_reason, case when seq % 2 = 0 then 'Active' else '' end as exploitation, case when seq % 3 = 0 then 'confirmed' else '' end as poe_status from findings"


@query(f"select finding_id, poe_status <> '' as has_proof, exploitation <> '' as has_score from ({PERSISTED}) x")
def snk13_three_tables(t: Tables) -> DataFrame:
    empty = {n: t.spark.createDataFrame([], schemas.TABLES[n]) for n in ("findings", "ssvc_scores", "poe_results")}
    rows = t.sql(PERSISTED)
    orphan = rows.limit(1).withColumn("finding_id", F.lit(None).cast("string"))  # a row that can't be stored has no children either
    out = store.persist(empty, rows.unionByName(orphan), "p", "r", 1)
    flag = lambda name, c: out[name].select("finding_id", F.lit(True).alias(c))
    j = out["findings"].select("finding_id").join(flag("poe_results", "has_proof"), "finding_id", "left").join(flag("ssvc_scores", "has_score"), "finding_id", "left")
    return j.select("finding_id", F.coalesce("has_proof", F.lit(False)).alias("has_proof"), F.coalesce("has_score", F.lit(False)).alias("has_score"))
