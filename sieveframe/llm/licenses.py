"""License scans: ordered signature rules behind a keyword prefilter.

A text's A-Z are lower-cased and its words joined by blanks. One pass of a keyword automaton over them tells which
rules can match at all; only these run. Detections are then taken in order of priority (longer, then earlier, first)
and one that lies within the words of a detection already taken is suppressed. Base phrases are found by the same rules
engine, are never suppressed, and suppress nothing but detections of their own label.

Defined results: null and empty texts have no words, no detection, score 0; rows with a null id are scanned
like others; repeated rows get equal results; other columns, whatever their names, are ignored; an empty table gives an
empty result. Texts are scanned whole; the time for overlapping detections grows with their number, not its square.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, texts
from .license_rules import RULES, TAGS

#: Base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Everything but [0-9a-z] and bytes of other alphabets separates words; A-Z is lower-cased.
_FLAT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Rule(NamedTuple):
    label: str
    priority: int
    keyword: str
    pattern: re.Pattern


class Detection(NamedTuple):
    label: str
    priority: int
    first: int  # word, from 0
    last: int
    base: bool


def _words(tag: str) -> str:
    return " ".join(re.findall("[0-9a-z]+", tag.lower()))


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """In order of priority; ties in the order written."""
    out = []
    for line in RULES.strip().splitlines():
        label, priority, keyword, pattern = (x.strip() for x in line.split(" | "))
        out.append(Rule(label, int(priority), keyword, re.compile(rf"(?<!\S)(?:{pattern})(?!\S)")))
    for tag in TAGS.split():
        out.append(Rule(tag.lower(), 88, f"license identifier {_words(tag)}", re.compile(rf"(?<!\S)(?:spdx )?license identifier {_words(tag)}(?!\S)")))
        out.append(Rule(tag.lower(), 39, f"license {_words(tag)}", re.compile(rf"(?<!\S)license {_words(tag)}(?!\S)")))
    return tuple(sorted(out, key=lambda r: -r.priority))


@lru_cache(maxsize=1)
def _gate():
    import ahocorasick

    gate = ahocorasick.Automaton()
    by: dict[str, list[int]] = {}
    for i, r in enumerate(rules()):
        by.setdefault(r.keyword, []).append(i)
    for k, phrase in enumerate(BASE):
        by.setdefault(phrase, []).append(-1 - k)
    for word, which in by.items():
        gate.add_word(word, which)
    gate.make_automaton()
    return gate, [(label, re.compile(rf"(?<!\S){phrase}(?!\S)")) for phrase, label in BASE.items()]


def scan(text: str | None) -> tuple[int, list[Detection]]:
    """Number of words, and the detections that stay, by first word."""
    words = (text or "").encode().translate(_FLAT).split()
    if not words:
        return 0, []
    # bytes as Latin-1 characters: a position is a byte, and letters of other alphabets stay apart from blanks
    flat = b" ".join(words).decode("latin-1").replace("\xa0", "\xa1").replace("\x85", "\x84")
    gate, base = _gate()
    hits = {i for _, which in gate.iter(flat) for i in which}
    if not hits:
        return len(words), []
    starts = [0]
    for w in words:
        starts.append(starts[-1] + len(w) + 1)
    at = lambda pos: bisect_right(starts, pos) - 1
    found = []
    for i in sorted(hits):
        if i < 0:
            label, pattern = base[-1 - i]
            # all places, overlapping ones too
            pos = 0
            while m := pattern.search(flat, pos):
                found.append(Detection(label, 100, at(m.start()), at(m.end() - 1), True))
                pos = m.start() + 1
        else:
            r = rules()[i]
            found += [Detection(r.label, r.priority, at(m.start()), at(m.end() - 1), False) for m in r.pattern.finditer(flat)]
    return len(words), resolve(found)


def resolve(found: list[Detection]) -> list[Detection]:
    """Interval containment: drop what lies within a detection of higher priority, or of its own that is longer or found before.

    Base detections stay, and hide only others of their own label. One sweep by first word: of what began so far, the furthest last word by
    priority (and of base detections by label) tells whether a detection lies within another.
    """
    kept: list[Detection] = []
    far: dict[int, int] = {}
    own: dict[str, int] = {}
    for d in sorted(found, key=lambda d: (d.first, -d.last, not d.base, -d.priority)):
        if d.base:
            own[d.label] = max(own.get(d.label, -1), d.last)
        elif own.get(d.label, -1) >= d.last or any(p >= d.priority and last >= d.last for p, last in far.items()):
            continue
        else:
            far[d.priority] = max(far.get(d.priority, -1), d.last)
        kept.append(d)
    return sorted(kept, key=lambda d: (d.first, d.last, d.label))


def score(found: list[Detection]) -> float:
    """Chance that the text states a license: detections count as independent, each by its priority."""
    miss = 1.0
    for label in {d.label for d in found}:
        miss *= 1 - min(0.99, max(d.priority for d in found if d.label == label) / 100)
    return round(1 - miss, 6)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words and detections (label, priority, first, last, base) with score, for each row of docs."""

    def rows(columns: list) -> list[tuple]:
        out = []
        for i, text in zip(*columns, strict=True):
            n, found = scan(text)
            out.append((i, n, [d._asdict() for d in found], score(found)))
        return out

    return map_rows(texts(docs, id_col, text_col), "doc_id bigint, n_words bigint, detections array<struct<label:string,priority:int,first:bigint,last:bigint,base:boolean>>, score double", rows)


def digest(scanned: DataFrame) -> DataFrame:
    """The columns of the contract from scan_licenses' rows."""
    base = F.filter("detections", lambda d: d["base"])
    join = lambda ds: F.array_join(F.array_sort(F.array_distinct(F.transform(ds, lambda d: d["label"]))), ",")
    return scanned.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(F.transform(base, lambda d: d["first"])).alias("first_word"), F.array_max(F.transform(base, lambda d: d["first"])).alias("last_word"), join(base).alias("base_labels"), join(F.col("detections")).alias("labels"), "score", F.size("detections").cast("long").alias("n_detections"))
