"""Domain tables from the driver's tables: each adapter is one SQL text that both engines run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

FINDINGS = """
select event_id as seq,
  concat('src/m', cast(user_id % 40 as varchar(9)), case when user_id % 5 = 0 then '_test.go' when user_id % 5 = 1 then '.py' else '.java' end) as path,
  case event_type when 'view' then 'CWE-89' when 'click' then 'CWE-22' when 'error' then 'CWE-862' when 'signup' then 'CWE-918' else 'CWE-327' end as cwe,
  cast(event_id % 12 as int) + 1 as line,
  round(cast(event_id % 101 as double) / 100, 2) as conf,
  case when cast(floor(value) as int) % 3 = 0 then 'SEMANTIC' else 'PATTERN' end as src,
  event_id % 7 = 0 as exploitable,
  case when event_id % 11 = 0 then cast(event_id % 100 as double) / 10 else cast(0 as double) end as cvss,
  case when event_id % 11 = 0 then concat('CVE-2024-', cast(event_id % 30 as varchar(9))) else '' end as cve,
  concat('src/', case when user_id % 4 = 0 then 'app/migrations/0001.py' when user_id % 4 = 1 then 'main/SecurityConfig.java' when user_id % 4 = 2 then 'gen/user.pb.go' else 'core/Deep.java' end) as odd_path
from events"""

EDGES = """
select distinct concat('p', cast(a.l_partkey as varchar(20))) as from_id, concat('p', cast(b.l_partkey as varchar(20))) as to_id, 'CALL' as edge_type
from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1"""

NODES = """
select concat('p', cast(p_partkey as varchar(20))) as node_id, case when p_size % 10 = 0 then 'CALL' else 'METHOD' end as node_type, p_name as name,
  concat('src/', replace(p_brand, '#', ''), case when p_size % 3 = 0 then '.java' when p_size % 3 = 1 then '.py' else '.go' end) as file, p_size as line, concat(p_type, '(', p_name, ')') as code
from part"""

#: Files of the nodes, each with an import that makes it a source, sink, auth or storage file, or none.
FILES = """
select distinct file as path, concat('package x', chr(10), case cast(substring(file, 10, 1) as varchar(1))
  when '1' then 'import org.springframework.web.bind' when '2' then 'import java.sql.Connection' when '3' then 'import io.jsonwebtoken.Jwts' when '4' then 'import org.hibernate.Session' else 'import java.util.List' end) as text
from nodes where file like '%.java'"""

#: The state of documents one scan earlier: a tenth missing, a seventh altered, some that are gone since.
PREVIOUS = """
select concat('d', cast(doc_id as varchar(20))) as file_path, case when doc_id % 7 = 0 then concat(coalesce(text, ''), '!') else coalesce(text, '') end as text from documents where doc_id % 10 <> 0
union all select concat('gone', cast(item_id as varchar(20))) as file_path, coalesce(text, '') as text from benchmark"""

CURRENT = "select concat('d', cast(doc_id as varchar(20))) as file_path, coalesce(text, '') as text from documents"

ADAPTERS = {"findings": FINDINGS, "edges": EDGES, "nodes": NODES, "files": FILES, "previous": PREVIOUS, "current_files": CURRENT}


def with_adapters(sql: str) -> str:
    """A query's text with the adapters it names (and those they name) as common table expressions."""
    used: list[str] = []

    def add(text: str) -> None:
        for name, body in ADAPTERS.items():
            if name not in used and re.search(rf"\b(?:from|join)\s+{name}\b", text):
                add(body)
                used.append(name)

    add(sql)
    head = ",\n".join(f"{n} as ({ADAPTERS[n]})" for n in used)
    if not head:
        return sql
    body = sql.strip()
    recursive = re.match(r"with\s+recursive\s+", body, re.I)
    if recursive:
        return f"with recursive {head},\n{body[recursive.end() :]}"
    plain = re.match(r"with\s+", body, re.I)
    return f"with {head},\n{body[plain.end() :]}" if plain else f"with {head}\n{body}"


class Tables:
    """Driver tables and adapters of one folder, read as they are used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        if name in ADAPTERS:
            return self.sql(f"select * from {name}")
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        """Tables go in as parameters, so that no view is left behind."""
        full = with_adapters(text)
        used = [t for t in TABLES if re.search(rf"\b(?:from|join)\s+{t}\b", full)]
        for t in used:
            full = re.sub(rf"\b(from|join)\s+{t}\b", rf"\1 {{{t}}}", full)
        return self.spark.sql(full, **{t: getattr(self, t) for t in used})
