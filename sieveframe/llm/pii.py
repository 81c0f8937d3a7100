"""Personal data: overlapping candidates from high-recall generators, chosen by boosted trees.

Base spans (email, ip, card, phone by the patterns of the contract) always stay. Further generators propose spelled-out
addresses, IPv6, national phone numbers, account numbers (iban), social security numbers (ssn) and credentials (secret),
overlapping as they may. A forest scores each candidate by its format (digits, groups, check sums, mix of characters) and
its context (words before it, what adjoins it); per kind, a threshold calibrated for ``PRECISION`` selects. Of candidates that
overlap the better one stays, and none stays that meets a base span, unless it holds more than that whole span (a key whose
digits happen to pass for a card number).

No table labels personal data, so the forest learns from ``EXAMPLES`` generated sentences, seeded: true items and look-alikes (dates,
versions, prices, order numbers, hashes, times, ratios). A fifth of them is held out to calibrate thresholds.

Positions are code points, end exclusive. Defined results: null and empty texts have no spans; rows with a null id are read
like others; repeated rows get equal results; other columns, whatever their names, are ignored; an empty table gives an empty result. Texts are
read whole, in time linear but for sorting.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from functools import lru_cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Forest, fit, threshold_for_precision
from .common import map_rows, texts

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "secret")
EXAMPLES, PRECISION, SEED = 6000, 0.98, 20


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    base: bool
    score: float


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only start where a run of digits does, and takes whole runs: possessive, so linear
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[A-Za-z0-9-]{1,63})+", re.I)
_IPV6 = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])")
_NATIONAL = re.compile(r"(?<![0-9+.\-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9-])")
# French in pairs, Spanish mobile, and a trunk zero with an undivided rest as in German and British numbers
_PAIRS = re.compile(r"(?<![0-9+.\-])0[1-9](?:[ .-]?[0-9]{2}){4}(?![0-9-])")
_MOBILE = re.compile(r"(?<![0-9+.\-])[6-9][0-9]{2}(?:[ .-][0-9]{2}){3}(?![0-9-])")
_TRUNK = re.compile(r"(?<![0-9+.\-])\(?0[1-9][0-9]{1,3}\)?[ /-][0-9]{5,8}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?([^\s\"'<>]{6,}+)", re.I)
_KEY = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk[-_](?:live|test|proj)?[-_]?[A-Za-z0-9]{20,}+)(?![A-Za-z0-9])")
_DIGIT = re.compile("[0-9]")
_CUES = {
    "email": ("mail", "contact", "write", "address"), "ip": ("ip", "host", "server", "address"), "card": ("card", "visa", "pay", "credit"), "phone": ("tel", "phone", "call", "fax", "mobile", "cell", "contact", "whatsapp"),
    "iban": ("iban", "account", "bank", "konto", "transfer"), "ssn": ("ssn", "social", "security", "tax"), "secret": ("password", "passwd", "pwd", "secret", "token", "key"),
}
_AGAINST = ("version", "order", "invoice", "isbn", "date", "page", "fig", "ratio", "total", "item", "no.", "commit", "chapter", "from", "between", "room", "score")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(code: str) -> bool:
    code = code.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def base_spans(text: str) -> list[Span]:
    """Leftmost, non-overlapping per kind; matches that fail their check are consumed, not retried."""
    out = []
    if "@" in text:
        done, at = 0, text.find("@")
        while at >= 0:
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            m = _DOMAIN.match(text, at) if start < at else None
            if m:
                out.append(Span("email", start, m.end(), True, 1.0))
                done = m.end()
            at = text.find("@", done if m else at + 1)
    if _DIGIT.search(text):
        if "." in text:
            out += [Span("ip", m.start(), m.end(), True, 1.0) for m in _IP.finditer(text) if all(len(d := p.lstrip("0")) < 4 and int(d or "0") <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m.group().replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append(Span("card", m.start(), m.end(), True, 1.0))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                    out.append(Span("phone", m.start(), m.end(), True, 1.0))
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """What further generators propose; spans may overlap."""
    out = []
    low = text.lower()
    if "at)" in low or "at]" in low:
        out += [("email", m.start(), m.end()) for m in _SPELLED.finditer(text)]
    if ":" in text and text.count(":") > 1:
        out += [("ip", m.start(), m.end()) for m in _IPV6.finditer(text) if m.end() - m.start() > 3]
    if _DIGIT.search(text):
        out += [("phone", m.start(), m.end()) for p in (_NATIONAL, _PAIRS, _MOBILE, _TRUNK) for m in p.finditer(text)]
        out += [("iban", m.start(), m.end()) for m in _IBAN.finditer(text)]
        out += [("ssn", m.start(), m.end()) for m in _SSN.finditer(text)]
    if any(k in low for k in ("pass", "pwd", "secret", "token", "key")):
        out += [("secret", m.start(1), m.end(1)) for m in _SECRET.finditer(text)]
    out += [("secret", m.start(), m.end()) for m in _KEY.finditer(text)] if any(k in text for k in ("AKIA", "gh", "sk")) else []
    return out


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a candidate."""
    s = text[start:end]
    n = len(s)
    digits = sum("0" <= c <= "9" for c in s)
    groups = re.findall("[0-9]+", s)
    count = Counter(s)
    entropy = -sum(c / n * math.log2(c / n) for c in count.values())
    before, after = text[max(0, start - 32) : start].lower(), text[end : end + 12].lower()
    year = any(1900 <= int(g) <= 2100 for g in groups if len(g) == 4)
    plain = s.replace(" ", "")
    return [
        float(KINDS.index(kind)), n, digits / n, float(len(groups)), float(max(map(len, groups), default=0)), float(min(map(len, groups), default=0)), sum(c.isupper() for c in s) / n, sum(c.isalpha() for c in s) / n, entropy,
        float(any(k in before for k in _CUES[kind])), float(any(k in before for k in _AGAINST)), float(year), float(kind == "iban" and mod97(plain) if plain.isalnum() and plain.isascii() else False),
        float(kind == "ssn" and groups[0] not in ("000", "666") and groups[0] < "900" and groups[-1] != "0000"), float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before[-1:] in "$€£#/=" and before != ""), float(after[:1] in "%/" and after != ""),
        float("(" in s or "-" in s), float("::" in s or s.count(":") == 7), float("dot" in s.lower()), float(bool(re.fullmatch("[0-9a-fA-F]+", s))), float(s.isalpha()),
    ]


#: Never against: a cue before it, a valid check sum; never for: a word for something else before it.
MONOTONE = tuple([0] * 9 + [1, -1, 0, 1, 1] + [0] * 9)


def _examples(n: int, seed: int) -> list[tuple[str, str, int, int, int]]:
    """(text, kind, start, end, true): sentences with an item that the generators propose."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    w = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(3, 9)))
    a = lambda k: "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(k))
    h = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))

    def iban(valid: bool) -> str:
        body = d(r.choice((12, 14, 18)))
        c = r.choice(("DE", "FR", "ES", "GB", "NL", "IT"))
        check = 98 - int(body + str(int(c[0], 36)) + str(int(c[1], 36)) + "00") % 97
        s = f"{c}{check if valid else (check + r.randint(1, 90)) % 97:02d}{body}"
        return " ".join(s[k : k + 4] for k in range(0, len(s), 4)) if r.random() < 0.5 else s

    makers = (
        ("email", 1, lambda: f"{w()}.{w()} (at) {w()} (dot) {r.choice(('com', 'org', 'de'))}"), ("email", 1, lambda: f"{w()} [at] {w()}.com"), ("email", 0, lambda: f"{w()} (at) {w()}.{d(1)}"), ("email", 0, lambda: f"{w()} [at] {w()}. {w().title()}"),
        ("ip", 1, lambda: ":".join(h(4) for _ in range(8))), ("ip", 1, lambda: f"2001:{h(3)}::{h(4)}"), ("ip", 0, lambda: f"{d(2)}:{d(2)}:{d(2)}"), ("ip", 0, lambda: f"{d(1)}:{d(1)}:{d(1)}"), ("ip", 0, lambda: "::".join(("std", "", ""))[5:] + "::"),
        ("phone", 1, lambda: f"({d(3)}) {d(3)}-{d(4)}"), ("phone", 1, lambda: f"{d(3)}-{d(3)}-{d(4)}"), ("phone", 1, lambda: f"0{d(3)} {d(3)} {d(4)}"), ("phone", 1, lambda: f"0{r.randint(1, 9)}" + (sep := r.choice(" -")) + sep.join(d(2) for _ in range(4))), ("phone", 1, lambda: f"0{r.randint(10, 999)} {d(r.randint(6, 8))}"), ("phone", 1, lambda: f"6{d(2)} {d(2)} {d(2)} {d(2)}"), ("phone", 0, lambda: f"0{r.randint(100, 999)} {d(5)}"),
        ("phone", 0, lambda: f"{d(2)} {d(3)} {d(3)}"), ("phone", 0, lambda: f"{d(3)}.{d(3)}.{d(3)}"), ("phone", 0, lambda: f"{d(2)}-{d(3)}-{r.randint(1900, 2050)}"), ("phone", 0, lambda: f"{d(4)} {d(4)} {d(4)}"),
        ("iban", 1, lambda: iban(True)), ("iban", 0, lambda: iban(False)), ("iban", 0, lambda: f"{r.choice(('SN', 'ID', 'PO'))}{d(2)}{a(8).upper()}"),
        ("ssn", 1, lambda: f"{r.randint(1, 665):03d}-{d(2)}-{r.randint(1, 9999):04d}"), ("ssn", 0, lambda: f"9{d(2)}-{d(2)}-{d(4)}"), ("ssn", 0, lambda: f"{d(3)} {d(2)} {d(4)}"),
        ("secret", 1, lambda: h(r.randint(16, 40))), ("secret", 1, lambda: a(r.randint(12, 40))), ("secret", 1, lambda: "AKIA" + a(16).upper()), ("secret", 1, lambda: f"eyJ{a(r.randint(12, 40))}.{a(r.randint(60, 900))}.{a(43)}"), ("secret", 1, lambda: "sk-" + a(r.randint(20, 160))), ("secret", 0, lambda: ".".join(w() for _ in range(r.randint(4, 120)))),
        ("secret", 0, lambda: w() + w()), ("secret", 0, lambda: r.choice(("required", "changeme,", "<none>", "function(x)", "undefined", "self.token", "os.environ[x]"))),
    )
    out = []
    for _ in range(n):
        kind, true, make = r.choice(makers)
        item = make()
        cue, anti = r.choice(_CUES[kind]), r.choice(_AGAINST)
        if kind == "secret" and not item.startswith(("AKIA", "sk-")):
            lead = f"{r.choice(('password', 'token', 'secret', 'api_key'))}{r.choice(('=', ': ', ' = '))}" + r.choice(("", '"'))
        elif true:
            lead = r.choice((f"{cue} ", f"{cue}: ", f"{w()} {cue} {w()} ", f"{w()} ", f"{w()} ") if kind != "ssn" else (f"{cue} ", f"{cue}: ", f"{w()} "))
        else:
            lead = r.choice((f"{anti} ", f"{w()} ", f"{w()} ", f"{anti}: ", "$", "#"))
        head = " ".join(w() for _ in range(r.randint(1, 6))) + " " + lead
        tail = r.choice((" ", ". ", ", ", '" ' if lead.endswith('"') else " ", "% " if not true else " ")) + " ".join(w() for _ in range(r.randint(1, 5)))
        text = head + item + tail
        for k, s, e in candidates(text):
            if k == kind and s < len(head) + len(item) and e > len(head):
                out.append((text, k, s, e, true))
    return out


@lru_cache(maxsize=1)
def model(n: int = EXAMPLES, seed: int = SEED, precision: float = PRECISION) -> tuple[Forest, dict[str, float]]:
    """Forest and thresholds; some seconds, on the driver, once."""
    rows = _examples(n, seed)
    x, y = np.array([features(*row[:4]) for row in rows]), np.array([row[4] for row in rows], float)
    held = np.arange(len(rows)) % 5 == 0
    forest = fit(x[~held], y[~held], MONOTONE, trees=80)
    p = forest.predict(x[held])
    kinds = np.array([row[1] for row in rows])[held]
    return forest, {k: max(0.5, threshold_for_precision(p[kinds == k], y[held][kinds == k], precision)) for k in KINDS}


def select(base: list[Span], scored: list[Span], thresholds: dict[str, float]) -> list[Span]:
    """Base spans, and of the others those above their threshold that meet no better one, nor a base span but in whole and as a part."""
    low, high = [], []  # base spans, merged
    for s in sorted(base, key=lambda s: s.start):
        if high and s.start < high[-1]:
            high[-1] = max(high[-1], s.end)
        else:
            low.append(s.start)
            high.append(s.end)
    starts, ends = [], []  # of what else is taken: disjoint, ascending
    kept = list(base)
    for s in sorted((s for s in scored if s.score >= thresholds[s.kind]), key=lambda s: (-s.score, s.start, -s.end, s.kind)):
        first, behind = bisect_right(high, s.start), bisect_left(low, s.end)
        if first < behind and (low[first] < s.start or high[behind - 1] > s.end or (low[first], high[behind - 1]) == (s.start, s.end)):
            continue
        at = bisect_right(ends, s.start)  # the first that ends after it starts
        if at == len(starts) or s.end <= starts[at]:
            starts.insert(at, s.start)
            ends.insert(at, s.end)
            kept.append(s)
    return sorted(kept, key=lambda s: (KINDS.index(s.kind), s.start, s.end))


def find_all(many: list[str | None], forest: Forest, thresholds: dict[str, float]) -> list[list[Span]]:
    """Spans of each text; all candidates of the texts are scored at once."""
    many = [t or "" for t in many]
    found = [(n, *c) for n, t in enumerate(many) for c in candidates(t)]
    p = forest.predict(np.array([features(many[n], *c) for n, *c in found])) if found else []
    scored: dict[int, list[Span]] = {}
    for (n, kind, start, end), s in zip(found, p, strict=True):
        scored.setdefault(n, []).append(Span(kind, start, end, False, round(float(s), 6)))
    return [select(base_spans(t), scored.get(n, []), thresholds) for n, t in enumerate(many)]


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= at:
            out += [text[at : s.start], f"<{s.kind}>"]
        at = max(at, s.end)
    return "".join(out) + text[at:]


_SPANS = "spans array<struct<kind:string,start:bigint,end:bigint,base:boolean,score:double>>"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id and spans (by kind, then start), and with ``with_text`` the redacted text, for each row of docs."""
    forest, thresholds = model()

    def rows(columns: list) -> list[tuple]:
        out = []
        for i, t, spans in zip(*columns, find_all(columns[1], forest, thresholds), strict=True):
            row = (i, [s._asdict() for s in spans])
            out.append((*row, redact(t, spans)) if with_text else row)
        return out

    return map_rows(texts(docs, id_col, text_col), f"doc_id bigint, {_SPANS}" + ", redacted string" * with_text, rows)


def digest(found: DataFrame) -> DataFrame:
    """The columns of the contract from find_pii's rows."""
    base = F.filter("spans", lambda s: s["base"])
    told = lambda ss: F.array_join(F.transform(ss, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def span_digest(spans: list[Span]) -> str:
    return hashlib.sha256(",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans if s.base).encode()).hexdigest()
