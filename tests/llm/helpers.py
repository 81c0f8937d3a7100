"""Small corpora with every odd case: nulls, empty and very long texts, copies, near copies, repeated rows, clashing names."""

import random

from pyspark.sql import types as T

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, drops string, owner string, n_words int"


def words(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijkl") for _ in range(r.randint(2, 7))) for _ in range(n)]


def corpus(n: int = 60) -> list[tuple]:
    texts: list[str | None] = []
    for k in range(n):
        w = words(k, 80)
        texts.append("\n".join(" ".join(w[i : i + 12]) for i in range(0, len(w), 12)))
    base = texts[3]
    texts += [base, base, base.replace(texts[3].split()[40], "changed", 1), base.upper()]  # copies, a near copy
    texts += [None, "", "   \n\t", "one", "one", "a b c d", " ".join(words(99, 30_000)), "é ü ñ 日本\n" * 30]
    texts += ["A shared line of text\n" + t for t in texts[:5]] + [" a shared LINE of text \nanother"]
    rows = [(k, t, "en" if k % 2 else None, f"s{k % 4}" if k % 7 else None, len(t or "")) for k, t in enumerate(texts)]
    rows += [rows[2], (None, "no id at all here\nA shared line of text", "en", "s1", 3), (None, None, None, None, None)]
    return rows


def docs(spark, rows=None):
    rows = corpus() if rows is None else rows
    return spark.createDataFrame([(*r, 0.5, "x", "y", 1) for r in rows], T._parse_datatype_string(DOCS)).repartition(3)
