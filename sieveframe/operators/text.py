"""Line and byte level operations on source text. Sequential ones run as Arrow batches; the rest are expressions."""

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as X


def lines(files: DataFrame) -> DataFrame:
    """SRC04: files(path, text) → path, line (from 1), code."""
    return files.select("path", F.posexplode(F.split("text", "\n")).alias("pos", "code")).select("path", (F.col("pos") + 1).alias("line"), "code")


def window(targets: DataFrame, files: DataFrame, n: int = 5, fallback: int = 20) -> DataFrame:
    """targets(id, path, line): the lines from line - n to line + n; the file's first ones if the line isn't in it.

    Lines are sliced out of the split text where the file is: no line is a row of its own.
    """
    t = targets.join(files.select("path", "text"), "path").withColumn("all", F.split("text", "\n"))
    inside = (F.col("line") >= 1) & (F.col("line") <= F.size("all"))
    start = F.when(inside, F.greatest(F.lit(1), F.col("line") - n)).otherwise(F.lit(1))
    size = F.when(inside, F.least(F.col("line") + n, F.size("all")) - F.greatest(F.lit(1), F.col("line") - n) + 1).otherwise(F.least(F.lit(fallback), F.size("all")))
    return t.select("id", start.alias("first_line"), F.array_join(F.slice("all", start, size), "\n").alias("snippet"))


def brace_end(methods: DataFrame, files: DataFrame) -> DataFrame:
    """methods(id, path, line): the line on which the braces opened from there are closed again; null if they aren't.

    Depth runs within a method's own lines, so groups are as long as a file at most.
    """
    j = methods.join(files.select("path", "text"), "path").select("id", "line", F.posexplode(F.split("text", "\n")).alias("pos", "code")).where(F.col("pos") + 1 >= F.col("line"))
    bare = F.regexp_replace("code", r"""//.*$|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'""", "")
    j = j.withColumn("up", F.length(bare) - F.length(F.replace(bare, F.lit("{"), F.lit("")))).withColumn("down", F.length(bare) - F.length(F.replace(bare, F.lit("}"), F.lit(""))))
    w = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    j = j.withColumn("depth", F.sum(F.col("up") - F.col("down")).over(w)).withColumn("opened", F.sum("up").over(w) > 0)
    return j.groupBy("id").agg(F.min(F.when(F.col("opened") & (F.col("depth") <= 0), F.col("pos") + 1)).alias("end_line"))


def truncate_utf8(s: Column, n: Column) -> Column:
    """At most n bytes, never half a character: cut before the last byte that begins a character, if the next one doesn't."""
    raw, most = F.encode(s, "utf-8"), F.greatest(n, F.lit(0))
    inside = lambda k: F.hex(F.substring(raw, most - k + 1, F.lit(1))).between("80", "BF")
    cut = F.when(~inside(0), most).when(~inside(1), most - 1).when(~inside(2), most - 2).otherwise(most - 3)
    return F.when(F.octet_length(s) <= most, s).otherwise(F.substring(raw, F.lit(1), cut).cast("string"))


def strip_code(code: str) -> str:
    """X15, per line: no // comments, quoted text emptied, quotes kept."""
    out = []
    for line in code.split("\n"):
        kept, quote, i = [], "", 0
        while i < len(line):
            c = line[i]
            if quote:
                if c == "\\":
                    i += 1
                elif c == quote:
                    kept.append(c)
                    quote = ""
            elif c in "\"'":
                quote = c
                kept.append(c)
            elif line.startswith("//", i):
                break
            else:
                kept.append(c)
            i += 1
        out.append("".join(kept))
    return "\n".join(out)


_STRING = re.compile(r"""(["'])(?:\\.?|(?!\1)[^\\])*(\1?)""", re.S)


def blank_strings(line: str) -> str:
    """String literals of both kinds emptied; of one that isn't closed only the opening quote stays."""
    return _STRING.sub(r"\1\2", line)


def obfuscate(code: str) -> str:
    """Without comments, packages, imports and string contents; blank lines go.

    A line that opens a block comment without closing it goes whole, and so do all lines up to the one that closes it. An import block ends at a
    line that is a closing parenthesis.
    """
    out, state = [], ""
    for line in code.split("\n"):
        s = line.strip()
        if state == "comment":
            state = "" if "*/" in s else state
        elif "/*" in s and "*/" not in s:
            state = "comment"
        elif s.startswith("package "):
            pass
        elif s.startswith("import "):
            state = "imports" if s == "import (" else ""
        elif state == "imports":
            state = "" if s == ")" else state
        elif s and not s.startswith(("//", "#", "-- ")):
            out.append(blank_strings(line))
    return "\n".join(out).strip()


def byte_window(code: str, line: int, budget: int) -> str:
    """Lines around a line (from 0), grown by one after and one before it in turn while they fit the budget of bytes, with marks
    where the text goes on."""
    rows = code.split("\n")
    size = [len(r.encode()) for r in rows]
    low = high = min(max(line, 0), len(rows) - 1)
    used, more = size[low], True
    while more:
        more = False
        for at in (high + 1, low - 1):
            if 0 <= at < len(rows) and used + size[at] + 1 <= budget:
                low, high, used, more = min(low, at), max(high, at), used + size[at] + 1, True
    return "... [truncated head]\n" * (low > 0) + "\n".join(rows[low : high + 1]) + "\n... [truncated tail]" * (high < len(rows) - 1)


def _by_text(f: Callable[[str], str | None]) -> Callable[[Column], Column]:
    """A column function from one of strings, in Arrow batches; made when it is used, as workers import this module too."""

    def column(c: Column) -> Column:
        def run(s: pd.Series) -> pd.Series:
            return s.map(f, na_action="ignore")

        return F.pandas_udf(run, "string")(c)

    return column


strip_code_col = _by_text(strip_code)


def blank_strings_col(c: Column) -> Column:
    """`blank_strings` as an expression. The repetition is possessive, so that long literals take no stack; nothing after it could ask it to give back."""
    return F.regexp_replace(c, r"""(?s)(["'])(?:[^"'\\]++|\\.?|(?!\1)["'])*+(\1?)""", "$1$2")


# what str.strip() takes for white space
_SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_S = "[" + _SPACE.replace("\n", "") + "]*+"
_TO_LAST = r"(?![^\n])"
# a comment that is opened on a line and not closed there, up to the line that closes it
_COMMENT = r"(?<![^\n])(?=[^\n]*?/\*)(?![^\n]*?\*/)[^\n]*+(?:\n(?![^\n]*?\*/)[^\n]*+)*+(?:\n[^\n]*+)?"
# an import block, up to its closing parenthesis, another import or a comment, which is a bare /* by then
_IMPORTS = rf"(?<![^\n]){_S}import \({_S}{_TO_LAST}(?:\n(?!{_S}\){_S}{_TO_LAST})(?!{_S}import {_S}[^\n])(?!/\*{_TO_LAST})[^\n]*+)*+(?:\n{_S}\){_S}{_TO_LAST})?"


def obfuscate_col(c: Column) -> Column:
    """`obfuscate` as an expression: block comments become a line of their own, then import blocks go, then lines by themselves."""
    bare = F.regexp_replace(F.regexp_replace(c, _COMMENT, "/*"), _IMPORTS, "")

    def stays(line: Column) -> Column:
        s = F.btrim(line, F.lit(_SPACE))
        return (s != "") & (line != "/*") & ~X.any_of([s.startswith(w) for w in ("package ", "import ", "//", "#", "-- ")])

    return F.btrim(F.array_join(F.transform(F.filter(F.split(bare, "\n"), stays), blank_strings_col), "\n"), F.lit(_SPACE))


def _windows(s: pd.Series, line: pd.Series, budget: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else byte_window(v, int(n), int(b)) for v, n, b in zip(s, line, budget, strict=True)])


def byte_window_col(s: Column, line: Column, budget: Column) -> Column:
    return F.pandas_udf(_windows, "string")(s, line, budget)


def parse_verdict(reply: str) -> str | None:
    """JSON between the first { and the last }, else what fields can be salvaged; null without ``exploitable``."""
    start, end = reply.find("{"), reply.rfind("}")
    if 0 <= start < end:
        try:
            got = json.loads(reply[start : end + 1])
            if isinstance(got, dict) and isinstance(got.get("exploitable"), bool):
                return json.dumps({k: got[k] for k in sorted(got)})
        except ValueError:
            pass
    m = re.search(r'"exploitable"\s*:\s*(true|false)', reply)
    if not m:
        return None
    out: dict = {"exploitable": m[1] == "true"}
    if c := re.search(r'"confidence"\s*:\s*([0-9.]+)', reply):
        out["confidence"] = float(c[1])
    for k in ("cwe", "summary", "evidence"):
        if c := re.search(rf'"{k}"\s*:\s*"((?:[^"\\]|\\.)*)"', reply):
            out[k] = c[1]
    return json.dumps({k: out[k] for k in sorted(out)})


parse_verdict_col = _by_text(parse_verdict)


def strip_ansi(c: Column) -> Column:
    """X23, part: terminal colours."""
    return F.regexp_replace(c, "\x1b\\[[0-9;]*[A-Za-z]", "")


def method_count(c: Column) -> Column:
    """X23, part: the number at the end of a console's answer, after its last " = " if it has one; null if it isn't one."""
    return F.btrim(F.element_at(F.split(F.btrim(c, F.lit(" \t\n\r")), " = "), -1), F.lit(" \t\n\r")).try_cast("long")


def fenced_block(c: Column, language: str = "diff") -> Column:
    """The first fenced block of that language, else the first of any."""
    own = F.regexp_extract(c, f"(?s)```{language}\\s*\\n(.*?)```", 1)
    return F.when(own != "", own).otherwise(F.regexp_extract(c, r"(?s)```[A-Za-z]*\s*\n(.*?)```", 1))


def diff_class(line: Column) -> Column:
    """X30."""
    return F.when(line.startswith("+++") | line.startswith("---"), F.lit("header")).when(line.startswith("@@"), F.lit("hunk")).when(line.startswith("+"), F.lit("add")).when(line.startswith("-"), F.lit("del")).otherwise(F.lit("context"))


# Names of weak algorithms (in sinks whatever their case, in code as written), safe and weak generators, and key patterns, as tried.
WEAK_SINKS = ("MessageDigest.getInstance", "md5", "sha1", "sha-1", "DES", "RC4", "ECB", "crypto.MD5", "crypto.SHA1", "des", "rc4")
WEAK_CODE = ("MD5", "SHA-1", "DES", "RC4", "ECB")
SAFE_RANDOM = ("crypto/rand", "crypto.rand", "SecureRandom", "cryptoRandom")
WEAK_RANDOM = ("math/rand", "math.rand", "new Random(", "Math.random(", "random.random(")
KEY_NAMES = ("key", "iv", "secret", "password", "salt")
LOW_ROUNDS = (("pbkdf2", 10000, "low PBKDF2 iterations"), ("bcrypt", 10, "low bcrypt work factor"))


def crypto_findings(surfaces: DataFrame) -> DataFrame:
    """surfaces(surface_id, line, code, sink_nodes) → surface_id, cwe, line, matched, conf of each weakness, at most one of a kind.

    line: of the function, to which line feeds before the match are added; a match in a sink is on the function's line. Matches are cut at 120
    characters. CWE-327: weak algorithms, sinks first. CWE-321: a literal key. CWE-338: weak generators, none if a safe one is seen. CWE-916: few rounds.
    """
    # All sinks as one text, of which no word holds a line feed: a search in it is compiled code, one by a lambda isn't. What several
    # searches need, and each kind's match, is a column of its own, so that it is made once a row.
    sinks = F.array_join(F.coalesce("sink_nodes", F.array().cast("array<string>")), "\n")
    texts = surfaces.select("surface_id", "line", F.coalesce("code", F.lit("")).alias("code"), sinks.alias("sinks")).select("*", F.lower("sinks").alias("low_sinks"), F.lower("code").alias("low_code"))
    code = F.col("code")
    hit = lambda cond, matched, at: F.when(cond, F.struct(matched.alias("matched"), at.cast("int").alias("at")))
    sunk = lambda w: hit(F.col("low_sinks").contains(w.lower()), F.lit(w), F.lit(0))
    told = lambda w: hit(code.contains(w), F.lit(w), F.instr(code, w))
    # a pattern is tried on texts that hold its name only
    found = lambda named, rx: hit(named & code.rlike(rx), F.regexp_extract(code, rx, 0), F.regexp_instr(code, F.lit(rx)))
    few = lambda name, least: F.col("low_code").contains(name) & F.regexp_extract(code, rf"(?i){name}.*?\b([0-9]+)\b", 1).try_cast("long").between(1, least - 1)
    kinds = {
        "CWE-327": F.coalesce(*map(sunk, WEAK_SINKS), *map(told, WEAK_CODE)),
        "CWE-321": F.coalesce(*[found(code.contains(k), rf'{k}\s*=\s*"') for k in KEY_NAMES]),
        "CWE-338": F.when(~X.contains_any(code, SAFE_RANDOM) & ~X.contains_any(F.col("sinks"), SAFE_RANDOM), F.coalesce(*[f(w) for w in WEAK_RANDOM for f in (sunk, told)])),
        "CWE-916": F.coalesce(*[found(few(name, least), rf"(?i){name}.*?\b([0-9]+)\b") for name, least, _ in LOW_ROUNDS]),
    }
    got = texts.select("surface_id", "line", "code", *[match.alias(cwe) for cwe, match in kinds.items()])
    rows = got.select("surface_id", "line", "code", F.explode(F.array(*[F.struct(F.lit(cwe).alias("cwe"), F.col(f"`{cwe}`.matched").alias("matched"), F.col(f"`{cwe}`.at").alias("at")) for cwe in kinds])).alias("f")).where("f.matched is not null")
    above = F.when((F.col("f.at") > 0) & (F.col("line") > 0), F.size(F.split(F.expr("substring(code, 1, f.at - 1)"), "\n")) - 1).otherwise(0)
    return rows.select("surface_id", F.col("f.cwe").alias("cwe"), F.greatest(F.lit(1), F.coalesce("line", F.lit(0)) + above).cast("int").alias("line"), F.substring("f.matched", 1, 120).alias("matched"), F.when(F.col("f.cwe") == "CWE-916", F.lit(0.80)).otherwise(F.lit(0.85)).alias("conf"))


def common_parent(paths: list[str]) -> str:
    """X32."""
    parts = [p.split("/")[:-1] for p in paths]
    out: list[str] = []
    for level in zip(*parts, strict=False):
        if len(set(level)) > 1:
            break
        out.append(level[0])
    return "/".join(out)
