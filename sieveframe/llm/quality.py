"""Quality rules: boosted trees over document statistics, flattened for vectorised scoring.

The statistics of the contract decide ``base_failed``; a forest over them and a few more decides the rest. It learns
from ``labels.quality`` on at most ``SAMPLE`` labelled documents (those whose id has the smallest hash: a bound, whatever the
corpus). It may never like a document better for more symbols, repeated lines or repeated words. A document is
rejected if its score is below a threshold that keeps ``KEEP`` of the good documents of the sample's held-out fifth.

Words are [^\\x20\\x09-\\x0D]+. Defined results: null and empty texts have no words, all counts 0, and fail; rows with a null
id are scored like others and teach nothing; of different texts with one labelled id the one with the smallest hash teaches; repeated
rows get equal results; without labels only the base rules decide; an empty table gives an empty result; texts of any length are
read whole; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Forest, fit, threshold_for_recall
from .common import map_rows, materialize, texts

SAMPLE = 20_000
KEEP = 0.999
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "punct_share", "stop_share", "distinct_share", "mean_line", "end_mark_share", "bang_share", "pipe_share")
MONOTONE = (0, 0, -1, -1, -1, 0, 0, 0, 0, 0, 0, 0, 0, 0)
#: Frequent words of the four languages, as a sign of running text.
STOP = frozenset(b"the of and to in is that a for on with as was it be by le la de et les des un une est du que pour dans der die und in den von zu das mit ist ein eine el los las y en que del se por con para".split())


def repeat_words(words: list[bytes]) -> int:
    """Words within 3-word windows that occur twice or more, the first time included."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) == n:
        return 0
    v = len(ids)
    pair = code[:-1] * v + code[1:]  # below 2**62 for any text under 2**31 words
    if v > 2_000_000:
        pair = np.unique(pair, return_inverse=True)[1]
    _, where, count = np.unique(pair[:-1] * v + code[2:], return_inverse=True, return_counts=True)
    start = count[where] > 1
    if not start.any():
        return 0
    mark = np.zeros(n, bool)
    for k in range(3):
        mark[k : n - 2 + k] |= start
    return int(mark.sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """COUNTS and FEATURES of a whole text."""
    text = text or ""
    data = text.encode()
    words = data.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\f\r"))
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    symbols = int(hist[list(SYMBOLS)].sum())
    lines = [x for x in data.split(b"\n") if x.strip()]
    dups = len(lines) - len(set(lines))
    repeats = repeat_words(words)
    per = 1 / max(1, chars)
    upper, digits = int(hist[65:91].sum()), int(hist[48:58].sum())
    letters = max(1, chars - digits)
    ends = sum(1 for x in lines if x.rstrip()[-1:] in b".!?\"')")
    features = [
        np.log1p(n), chars / max(1, n), symbols * per, dups / max(1, len(lines)), repeats / max(1, n), upper / letters, digits * per,
        int(hist[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]].sum()) * per, sum(1 for w in words if w in STOP) / max(1, n), len(set(words)) / max(1, n),
        np.log1p(n / max(1, len(lines))), ends / max(1, len(lines)), int(hist[33]) * per, int(hist[124]) * per,
    ]
    return [n, chars, symbols, dups, repeats], [float(v) for v in features]


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, keep: float = KEEP) -> tuple[Forest, float]:
    """Forest and threshold. Only numbers of at most ``sample`` documents come to the driver."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    chosen = materialize(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    # at most `sample` rows of two numbers: safe to broadcast
    rows = texts(docs).join(F.broadcast(chosen.select("doc_id", "quality")), "doc_id").withColumn("th", F.xxhash64("text"))

    def measured(columns: list) -> list[tuple]:
        return [(i, th, int(q), statistics(t)[1]) for i, t, q, th in zip(*columns, strict=True)]

    got = map_rows(rows, "doc_id bigint, th bigint, quality int, features array<double>", measured).groupBy("doc_id").agg(F.min_by("features", "th").alias("features"), F.max("quality").alias("quality")).collect()
    got.sort(key=lambda r: r.doc_id)
    x, y = np.array([r.features for r in got]).reshape(len(got), len(FEATURES)), np.array([r.quality for r in got], float)
    held = np.arange(len(got)) % 5 == 0
    forest = fit(x[~held], y[~held], MONOTONE)
    if not len(forest.roots):
        return forest, -1.0
    return forest, min(0.5, threshold_for_recall(forest.predict(x[held]), y[held], keep))


def scorer(forest: Forest, threshold: float) -> Callable[[list], list[tuple]]:
    def rows(columns: list) -> list[tuple]:
        found = [statistics(t) for t in columns[1]]
        score = forest.predict(np.array([f for _, f in found]).reshape(len(found), len(FEATURES)))
        out = []
        for i, (c, _), s in zip(columns[0], found, score.tolist(), strict=True):
            failed = base_failed(c[0], c[4])
            out.append((i, *c, failed, round(s, 9), not failed and s >= threshold))
        return out

    return rows


def rate_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, keep: float = KEEP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts, base_failed, score and kept for each row of docs."""
    rows = texts(docs, id_col, text_col)
    forest, threshold = train(rows, labels, sample, keep)
    return map_rows(rows, "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, score double, kept boolean", scorer(forest, threshold))
