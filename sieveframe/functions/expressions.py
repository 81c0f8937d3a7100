"""Column builders: scalar functions and predicates, all of them built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import SEVERITIES

# Lists whose order and content decide results.
TEST_SUFFIXES = ("_test.go", "_test.py", "test_.py", "_spec.rb", "_spec.js", "_spec.ts", ".test.js", ".test.ts", ".test.jsx", ".test.tsx", ".spec.js", ".spec.ts")
TEST_SEGMENTS = ("__tests__", "testdata", "tests", "test", "spec")
SCOPE_TEST_SUFFIXES = ("Test.java", "Tests.java", "IT.java", "Spec.kt", "Test.kt", "_test.go", "_test.py", ".test.js", ".spec.js", ".test.ts", ".spec.ts")
SCOPE_TEST_SEGMENTS = ("test", "tests", "__tests__", "androidTest", "testFixtures", "it")
PIPELINE_TEST_PARTS = ("/src/test/", "/src/it/", "/test/java/", "/tests/java/")
FRAMEWORK_GLOBS = ("*/migrations/*.py", "*/settings.py", "*SecurityConfig.java", "*SecurityConfiguration.java", "*.pb.go", "*_grpc.pb.go", "*/alembic/versions/*.py", "*/database/migrations/*.php")
AUTH_WORDS = ("auth", "login", "logout", "token", "verify", "validate", "permission", "authorize", "authenticate", "access", "security", "credential", "principal", "session", "jwt", "oauth")
AUTH_ANNOTATIONS = ("@PreAuthorize", "@Secured", "@RolesAllowed", "@WithMockUser")
HEDGES = ("typically", "likely", "probably", "presumably", "may be", "usually", "uncertain", "leans toward", "leaning toward", "not entirely sure", "can't be certain", "cannot be certain", "might be", "could be")
IDOR_SIGNALS = ("getById", "findById", "loadById", "fetchById", "getBy", "findBy", "fetchBy", "byId", "byUsername", "byEmail", "byUser", "resource", "profile", "account", "order", "invoice", "document", "record", "item", "asset")
SINK_GROUPS = (
    ("sql", ("query", "execute", "find", "raw", "sql")), ("command", ("exec", "system", "popen", "spawn", "fork", "shell")), ("deserialization", ("readObject", "unserialize", "deserialize", "pickle", "yaml.load")),
    ("file_write", ("write", "FileWriter", "FileOutputStream", "Create", "copy")), ("template", ("render", "Template")), ("redirect", ("redirect", "forward")), ("eval", ("eval", "compile")),
)
SINK_CWE = {"sql": "CWE-89", "command": "CWE-78", "deserialization": "CWE-502", "file_write": "CWE-22", "template": "CWE-1336", "redirect": "CWE-601", "eval": "CWE-94"}
LANGUAGES = {".py": "python", ".java": "java", ".go": "go", ".js": "javascript", ".mjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".rs": "rust", ".kt": "kotlin", ".kts": "kotlin", ".swift": "swift", ".cs": "csharp"}
TAINT_LANGUAGES = {".java": "java", ".py": "python", ".js": "js", ".jsx": "js", ".ts": "js", ".tsx": "js", ".mjs": "js", ".cjs": "js", ".go": "go"}
AUTOMATABLE = ("20", "22", "77", "78", "79", "89", "90", "94", "200", "287", "306", "352", "400", "434", "502", "601", "611", "639", "918")
IMPACT = {**dict.fromkeys(("77", "78", "89", "94", "120", "287", "306", "502", "611"), "Total"), **dict.fromkeys(("190", "200", "400", "918"), "Partial")}
TRIAGE = (("PROBABLY_SAFE", 0.25), ("PROBABLY_VULNERABLE", 0.75), ("EXPLOITABLE", 1.0), ("UNCERTAIN", 0.5), ("SAFE", 0.0))
ERROR_LEAKS = ("SQLException", "syntax error", "ORA-", "PSQLException", "stack trace", "at java.", "at org.springframework.")
PROOF_LANGUAGES = ("java", "python", "javascript", "typescript", "go")
SKIPPED_DIRS = (".git", "vendor", "node_modules", ".cache", "__pycache__", ".pytest_cache", ".venv", "venv")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def choose(pairs: list[tuple[Column, Column]], default: Column) -> Column:
    """Ordered first match."""
    out = None
    for cond, value in pairs:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return default if out is None else out.otherwise(default)


def mapped(key: Column, table: dict[str, str], default: str) -> Column:
    """By a constant map, so that the key is evaluated once however many entries there are."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key), F.lit(default))


def text(c: Column) -> Column:
    """Missing strings are empty ones."""
    return F.coalesce(c, F.lit(""))


def contains_any(c: Column, needles: tuple[str, ...]) -> Column:
    return any_of([c.contains(n) for n in needles])


def severity(conf: Column) -> Column:
    """D01."""
    return choose([(conf >= 0.92, F.lit("BLOCK")), (conf >= 0.75, F.lit("HIGH")), (conf >= 0.60, F.lit("MEDIUM")), (conf >= 0.30, F.lit("LOW"))], F.lit("SUPPRESSED"))


def severity_rank(sev: Column) -> Column:
    return choose([(sev == s, F.lit(k)) for k, s in enumerate(SEVERITIES)], F.lit(len(SEVERITIES)))


def proof_status(sev: Column, path: Column, least: str = "HIGH", languages: tuple[str, ...] = PROOF_LANGUAGES) -> Column:
    """'' where a proof is worth an attempt, else why not; an unknown least severity counts as HIGH."""
    least = least if least in SEVERITIES else "HIGH"
    return choose([(severity_rank(sev) > SEVERITIES.index(least), F.lit("not_attempted")), (~language(path).isin(*languages), F.lit("language_unsupported"))], F.lit(""))


def is_patchable(sev: Column) -> Column:
    """F15."""
    return F.coalesce(sev.isin("BLOCK", "HIGH"), F.lit(False))


def leaked_error(status: Column, body: Column) -> Column:
    """The first error detail that a 5xx response holds, which confirms the exploit; null without."""
    return F.when(status >= 500, choose([(body.contains(w), F.lit(w)) for w in ERROR_LEAKS], F.lit(None).cast("string")))


def finding_id(cwe: Column, path: Column, line: Column) -> Column:
    """D02."""
    return F.sha2(F.concat_ws(":", cwe, path, line.cast("string")), 256)


def gate_key(cwe: Column, path: Column, line: Column) -> Column:
    """D03."""
    return F.substring(F.sha2(F.concat_ws("|", cwe, path, line.cast("string")), 256), 1, 16)


def project_id(root: Column) -> Column:
    return F.substring(F.sha2(root, 256), 1, 16)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    """Everything before the last slash; '.' without one."""
    return F.when(F.instr(path, "/") == 0, F.lit(".")).otherwise(F.regexp_extract(path, "^(.*)/[^/]*$", 1))


def extension(path: Column) -> Column:
    """From the last dot of the base name, lower-cased; empty without one."""
    return F.lower(F.regexp_extract(base_name(path), r"(\.[^.]*)$", 1))


def language(path: Column) -> Column:
    """X03."""
    return mapped(extension(path), LANGUAGES, "unknown")


def taint_language(path: Column) -> Column:
    """X04, the taint engine's map."""
    return mapped(extension(path), TAINT_LANGUAGES, "")


def short_path(path: Column) -> Column:
    """The last two segments."""
    return F.substring_index(path, "/", -2)


def relative(path: Column, root: Column) -> Column:
    """X06."""
    prefix = F.concat(root, F.lit("/"))
    return F.when(path.startswith(prefix), F.substring(path, F.length(prefix) + 1, F.length(path))).otherwise(path)


def tail(name: Column, marks: str = "[.]") -> Column:
    """After the last mark."""
    return F.regexp_extract(name, f"([^{marks.strip('[]')}]*)$", 1)


def path_tokens(path: Column) -> Column:
    """X09."""
    return F.filter(F.split(path, r"[/\\\\.]"), lambda t: t != "")


def cwe_number(cwe: Column) -> Column:
    """Null without a number."""
    return F.nullif(F.regexp_extract(cwe, r"CWE-(\d+)", 1), F.lit("")).try_cast("int")


def cwe_url(cwe: Column) -> Column:
    """X11."""
    return F.concat(F.lit("https://cwe.mitre.org/data/definitions/"), F.regexp_extract(cwe, r"CWE-(\d+)", 1), F.lit(".html"))


def first_words(c: Column, n: int) -> Column:
    """The text itself unless it has more words."""
    words = F.split(F.btrim(c, F.lit(" \t\n\r")), r"\s+")
    return F.when(F.size(words) > n, F.array_join(F.slice(words, 1, n), " ")).otherwise(c)


def glob_regex(glob: str) -> str:
    """A star or a question mark never crosses a slash."""
    special = {"*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(special.get(c, "\\" + c if c in ".^$+()[]{}|\\" else c) for c in glob) + "$"


def glob_match(path: Column, globs: tuple[str, ...]) -> Column:
    """Full path first, then the base name."""
    return any_of([path.rlike(glob_regex(g)) | base_name(path).rlike(glob_regex(g)) for g in globs])


def is_test_file(path: Column) -> Column:
    """F09, for automatic suppression."""
    low = F.lower(path)
    return any_of([low.endswith(s) for s in TEST_SUFFIXES]) | F.arrays_overlap(F.split(low, "/"), F.array(*map(F.lit, TEST_SEGMENTS)))


def is_scope_test(path: Column) -> Column:
    """F08, for scope and seeds: case counts."""
    base = base_name(path)
    return any_of([base.endswith(s) for s in SCOPE_TEST_SUFFIXES]) | base.startswith("test") | F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, SCOPE_TEST_SEGMENTS)))


def is_pipeline_test(path: Column) -> Column:
    """F10."""
    return contains_any(path, PIPELINE_TEST_PARTS)


def is_framework_safe(path: Column) -> Column:
    """J26."""
    return glob_match(path, FRAMEWORK_GLOBS)


def generic_sink_kind(name: Column) -> Column:
    """The first group one of whose words the name holds, whatever their case."""
    low = F.lower(name)
    return choose([(any_of([low.contains(w.lower()) for w in words]), F.lit(kind)) for kind, words in SINK_GROUPS], F.lit("unknown"))


def sink_cwe(kind: Column) -> Column:
    return mapped(kind, SINK_CWE, "CWE-200")


def automatable(cwe: Column) -> Column:
    return F.when(F.regexp_extract(cwe, r"^CWE-(\d+)$", 1).isin(*AUTOMATABLE), F.lit("Yes")).otherwise(F.lit("No"))


def technical_impact(cwe: Column, cvss: Column) -> Column:
    own = mapped(F.regexp_extract(cwe, r"^CWE-(\d+)$", 1), IMPACT, "")
    return F.when(own != "", own).when(cvss >= 7, F.lit("Total")).otherwise(F.lit("Partial"))


def exploitation(exploited: Column, epss: Column, active: float = 0.5, poc: float = 0.1) -> Column:
    return choose([(exploited, F.lit("Active")), (epss >= active, F.lit("Active")), (epss >= poc, F.lit("PoC"))], F.lit("None"))


def cvss_confidence(cvss: Column) -> Column:
    """D14."""
    c = F.coalesce(cvss, F.lit(5.0))
    return choose([(c >= 9, F.lit(0.95)), (c >= 7, F.lit(0.82)), (c >= 4, F.lit(0.68))], F.lit(0.0))


def platt(cvss: Column, slope: float, offset: float) -> Column:
    return F.when(cvss < 4, F.lit(0.0)).otherwise(1 / (1 + F.exp(-(F.lit(slope) * cvss + F.lit(offset)))))


def scanner_confidence(metadata: Column, level: Column) -> Column:
    """D20, pattern scanner."""
    return choose([(metadata == "HIGH", F.lit(0.90)), (metadata == "MEDIUM", F.lit(0.65)), (metadata == "LOW", F.lit(0.40)), (level == "ERROR", F.lit(0.65))], F.lit(0.40))


def dependency_confidence(cvss: Column) -> Column:
    """D20, dependency scanner."""
    return choose([(cvss >= 9, F.lit(0.95)), (cvss >= 7, F.lit(0.85)), (cvss >= 4, F.lit(0.65)), (cvss > 0, F.lit(0.40))], F.lit(0.85))


def cve_severity(cvss: Column) -> Column:
    """D27."""
    return choose([(cvss >= 9, F.lit("BLOCK")), (cvss >= 7, F.lit("HIGH")), (cvss >= 4, F.lit("MEDIUM"))], F.lit("LOW"))


def triage_score(reply: Column) -> Column:
    """The category line first, then a category anywhere, then a bare decimal, else 0.5."""
    up = F.upper(reply)
    line = F.regexp_extract(up, r"CATEGORY:[ *]*([A-Z_]+)", 1)
    by_line = [(line == k, F.lit(v)) for k, v in TRIAGE]
    anywhere = [(up.contains(k), F.lit(v)) for k, v in TRIAGE]
    bare = F.regexp_extract(F.btrim(reply, F.lit(" \t\n\r")), r"^(0(?:\.[0-9]+)?|1(?:\.0+)?)$", 1)
    return choose([*by_line, *anywhere, (bare != "", bare.cast("double"))], F.lit(0.5))


def yes_vote(reply: Column) -> Column:
    """Whether the last word of the last line says yes."""
    last = F.element_at(F.split(F.btrim(reply, F.lit(" \t\n\r")), "\n"), -1)
    return F.upper(F.regexp_extract(last, r"([A-Za-z]+)[^A-Za-z]*$", 1)) == "YES"


def hedged(c: Column) -> Column:
    return contains_any(F.lower(c), HEDGES)


def printable(c: Column) -> Column:
    """X22."""
    return F.regexp_replace(c, r'[^\x20-\x7E]|[\\"]', " ")


def loc(c: Column) -> Column:
    """Line feeds."""
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def minified(c: Column) -> Column:
    """Without blank and comment lines."""
    return F.array_join(F.filter(F.split(c, "\n"), lambda s: (F.btrim(s, F.lit(" \t\r")) != "") & ~F.btrim(s, F.lit(" \t\r")).startswith("//") & ~F.btrim(s, F.lit(" \t\r")).startswith("#")), "\n")


def dedented(c: Column) -> Column:
    """No blanks or tabs at the start of lines."""
    return F.array_join(F.transform(F.split(c, "\n"), lambda s: F.regexp_replace(s, "^[ \t]+", "")), "\n")


def line_of(c: Column, offset: Column) -> Column:
    """1-based line of a 0-based byte offset."""
    head = F.substring(F.encode(c, "UTF-8"), F.lit(1), offset.cast("int"))
    return F.size(F.split(F.decode(head, "ISO-8859-1"), "\n"))


def null_text(c: Column) -> Column:
    """X34."""
    return F.when(c.isNull() | c.isin("null", "<empty>"), F.lit("")).otherwise(c)


def cosine(a: Column, b: Column) -> Column:
    """0 if lengths differ, either is empty or has no norm."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    sq = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    norm = sq(a) * sq(b)
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0) | (norm == 0), F.lit(0.0)).otherwise(dot / F.sqrt(norm))


def ratio(a: Column, b: Column) -> Column:
    """0 for a zero denominator."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def edit_similarity(a: Column, b: Column) -> Column:
    """D12."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)
