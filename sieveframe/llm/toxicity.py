"""Toxicity: nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

* Terms are words (runs of letters, lower-cased), all of them; a term's weight in a text is (1 + log n) * idf * association.
  Document frequencies are counted over all documents. The association (G^2 / (G^2 + c))^2 comes from the examples, c being what chance gives
  the best of so many terms (2 log of ten times their number); copies and most near copies of a text count once. It cuts no term off, but terms that
  go with neither label weigh little, and those that no example holds weigh nothing, in a text's length neither.
* Examples are at most ``EXAMPLES`` labelled documents (smallest hash of the id) with at most ``POSTINGS`` different terms together.
  Their vectors make an inverted index whose postings are cut into blocks of examples with each term's largest weight. A query visits
  blocks by their bound and stops when none can reach the k-th best cosine. It does so with heavy terms; light ones, which hold most postings
  and little of any vector, have a bound of their own, and what it leaves is compared in full, so the result is exact.
* The k nearest vote with their cosine as weight (examples tied at the k-th place share the places left). The vote goes through a
  logistic curve fitted leave-one-out on at most ``CALIBRATION`` of the examples. Texts with no term of any example get the smoothed
  share of toxic ones among such examples.

Never inputs: labels of the held-out rows (crc32(doc_id as text) mod 5 = 0), lang, source and doc_id; the id only names evidence.

Defined results: null and empty texts have no terms; rows with a null id are scored (held_out false) and teach nothing; of different texts with one
labelled id the one with the smallest hash teaches; a label given several times counts as toxic if any is; without any labelled row every score is 0;
repeated rows get equal results; other columns, whatever their names, are ignored; an empty table gives an empty result. Texts are read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialize, texts
from .ngram_join import shingles

EXAMPLES, POSTINGS, CALIBRATION, K, BLOCK = 3000, 5_000_000, 1500, 15, 64
LIGHT, NEAR = 0.05, 2e-9  # the vectors' length in light terms; difference of cosines that may be the same when rounded
_WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def terms_of(text: str | None) -> Counter:
    return Counter(_WORD.findall((text or "").lower()))


class BlockMaxIndex:
    """Vectors of examples by term; for each term and block of examples the largest weight and the run of postings."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = BLOCK):
        self.n, self.block = len(vectors), block
        self.n_blocks = -(-self.n // block)
        term = np.concatenate([t for t, _ in vectors]) if vectors else np.empty(0, np.int64)
        weight = np.concatenate([w for _, w in vectors]) if vectors else np.empty(0)
        owner = np.repeat(np.arange(self.n), [len(t) for t, _ in vectors])
        by = np.lexsort((owner, term))
        term, self.weight, self.owner = term[by], weight[by], owner[by].astype(np.int32)
        key = term * max(1, self.n_blocks) + self.owner // block
        at = np.nonzero(np.concatenate(([True], key[1:] != key[:-1])))[0] if len(key) else np.empty(0, np.int64)
        self.run = np.append(at, len(key))  # postings of entry e: run[e] to run[e + 1]
        self.entry_block = (self.owner[at] // block).astype(np.int32)
        self.top = np.maximum.reduceat(self.weight, at) if len(at) else np.empty(0)
        self.entries = np.searchsorted(term[at], np.arange(n_terms + 1))  # entries of term t: entries[t] to entries[t + 1]
        # the vectors themselves: that of example i from vector[i] to vector[i + 1]
        self.vector = np.concatenate(([0], np.cumsum([len(t) for t, _ in vectors], dtype=np.int64)))
        self.vector_term = np.concatenate([t for t, _ in vectors]).astype(np.int32) if vectors else np.empty(0, np.int32)
        self.vector_weight = np.concatenate([w for _, w in vectors]) if vectors else np.empty(0)
        self.query: np.ndarray | None = None  # by term; 0 between searches
        # light terms: those with the least squares a posting, as long as they hold no more than LIGHT of the vectors' length
        squares, held = np.bincount(term, self.weight**2, n_terms), np.bincount(term, minlength=n_terms)
        by = np.argsort(squares / np.maximum(1, held), kind="stable")
        self.light = np.zeros(n_terms, bool)
        self.light[by[np.cumsum(squares[by]) <= LIGHT**2 * squares.sum()]] = True
        less = np.where(self.light[term], self.weight, 0.0)
        self.length = np.zeros(self.n_blocks * block)  # of each vector's light terms
        self.length[: self.n] = np.sqrt(np.bincount(self.owner, less**2, self.n))

    def nearest(self, ts: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Examples whose cosine is at least the k-th best (all of those tied) and above 0, best first, with cosines.

        Blocks are visited for heavy terms, whose postings are few. What light terms add to a cosine is by Cauchy and Schwarz at most the product of
        the lengths that they have in both vectors, so that few examples can be among the best; these get their cosines from whole vectors.
        """
        less = self.light[ts]
        most = math.sqrt(q[less] @ q[less]) * self.length
        sims, kth = self._visit(ts[~less], q[~less], k, most)
        found = np.nonzero(sims + most >= kth - NEAR)[0]  # those without heavy terms in common among them
        if kth <= NEAR or 8 * len(found) > self.n:  # too many: by all terms
            sims, kth = self._visit(ts, q, k, np.zeros(len(most)))
            found = np.nonzero((sims > 0) & (sims >= kth - NEAR))[0]
        sims = np.round(self._cosines(found, ts, q), 9)
        found, sims = found[sims > 0], sims[sims > 0]
        if len(found) > k:
            best = sims >= np.partition(sims, len(found) - k)[len(found) - k]
            found, sims = found[best], sims[best]
        by = np.lexsort((found, -sims))
        return found[by], sims[by]

    def _visit(self, ts: np.ndarray, q: np.ndarray, k: int, most: np.ndarray) -> tuple[np.ndarray, float]:
        """What the terms add to the cosines in the blocks visited, and the k-th best of it (0 if there are fewer). Examples of the blocks
        left out can't reach that with ``most`` more."""
        low, high = self.entries[ts], self.entries[ts + 1]
        n = high - low
        entry = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        w, of = np.repeat(q, n), self.entry_block[entry]
        bound = np.bincount(of, w * self.top[entry], self.n_blocks)
        bound = np.where(bound > 0, bound + most.reshape(-1, self.block).max(1), 0.0)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        sims, done, step, kth = np.zeros(self.n_blocks * self.block), 0, 4, 0.0
        while done < len(order):
            left = order[done:][bound[order[done:]] >= kth - NEAR]  # a bound is a sum in another order than a cosine: allow for rounding
            if not len(left):
                break
            now = left if done and 4 * len(left) > self.n_blocks else left[:step]
            chosen = np.zeros(self.n_blocks, bool)
            chosen[now] = True
            mine = np.nonzero(chosen[of])[0]
            e = entry[mine]
            m = self.run[e + 1] - self.run[e]
            at = np.repeat(self.run[e] - np.concatenate(([0], np.cumsum(m)[:-1])), m) + np.arange(m.sum())
            sims += np.bincount(self.owner[at], np.repeat(w[mine], m) * self.weight[at], len(sims))
            done, step = done + len(now), 2 * step
            seen = sims[sims > 0]
            kth = np.partition(seen, len(seen) - k)[len(seen) - k] if len(seen) >= k else 0.0
        return sims, kth

    def _cosines(self, found: np.ndarray, ts: np.ndarray, q: np.ndarray) -> np.ndarray:
        if not len(found):
            return np.empty(0)
        if self.query is None:
            self.query = np.zeros(len(self.entries) - 1)
        self.query[ts] = q
        m = self.vector[found + 1] - self.vector[found]  # no example is without terms
        first = np.concatenate(([0], np.cumsum(m)[:-1]))
        at = np.repeat(self.vector[found] - first, m) + np.arange(m.sum())
        out = np.add.reduceat(self.query[self.vector_term[at]] * self.vector_weight[at], first)
        self.query[ts] = 0.0
        return out


class Model:
    """Everything that scoring needs; bounded by EXAMPLES and POSTINGS.

    examples: (id, label, key shared by copies, indices of terms, their counts); df: documents with each term, of ``total``.
    """

    def __init__(self, names: list[str], df: np.ndarray, total: int, examples: list[tuple[int, int, int, np.ndarray, np.ndarray]], k: int = K, calibration: int = CALIBRATION):
        self.names, self.k = names, k
        self.vocabulary: dict[str, int] | None = None
        self.weights = np.log(1 + total / (1 + df)) * association(len(names), examples)
        empty = [y for _, y, _, t, _ in examples if not len(t)]
        self.blank = (sum(empty) + 0.5) / (len(empty) + 2) if examples else 0.0
        # an order by content, so that ids and the order of rows have no part in the result
        own = sorted((e for e in examples if len(e[3])), key=lambda e: (e[3].tobytes(), e[4].tobytes(), e[1], e[0]))
        self.ids, self.toxic = [e[0] for e in own], np.array([e[1] for e in own], float)
        vectors = [self.vector(e[3], e[4]) for e in own]
        self.index = BlockMaxIndex(vectors, len(names)) if own else None
        self.curve = (0.0, 0.0)
        if own:
            of = np.arange(len(own))[:: -(-len(own) // calibration)]
            self.curve = _logistic(np.array([self._vote(*self.index.nearest(*vectors[n], k + 1), without=n) for n in of]), self.toxic[of])
            self.index.query = None  # not to be sent along

    def vector(self, ts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(counts)) * self.weights[ts]
        keep = w > 0
        ts, w = ts[keep], w[keep]
        return ts, w / np.sqrt(w @ w) if len(w) else w

    def _vote(self, i: np.ndarray, s: np.ndarray, without: int = -1) -> float:
        if without >= 0:
            s, i = s[i != without], i[i != without]
        if not len(i):
            return 0.5
        kth = s[min(self.k, len(s)) - 1]
        share = np.ones(len(s))
        tied = s == kth
        share[tied] = (min(self.k, len(s)) - (s > kth).sum()) / tied.sum()
        w = share * s
        return float((w @ self.toxic[i] + 0.5 * self.blank) / (w.sum() + 0.5))

    def score(self, text: str | None) -> tuple[float, list[int], list[str]]:
        """Calibrated chance of the toxic label, up to three nearest examples, and the text's heaviest terms."""
        if self.vocabulary is None:
            self.vocabulary = {t: i for i, t in enumerate(self.names)}
        counts = terms_of(text)
        ts = np.fromiter(map(self.vocabulary.get, counts, repeat(-1)), np.int64, len(counts))
        known = ts >= 0
        ts = ts[known]
        if self.index is None or not len(ts):
            return round(self.blank, 9), [], []
        ts, w = self.vector(ts, np.fromiter(counts.values(), float, len(counts))[known])
        if not len(ts):
            return round(self.blank, 9), [], []
        a, b = self.curve
        i, s = self.index.nearest(ts, w, self.k)
        p = 1 / (1 + math.exp(-max(-40.0, min(40.0, a * self._vote(i, s) + b))))
        return round(p, 9), [self.ids[n] for n in i[:3]], [self.names[ts[n]] for n in np.argsort(-w, kind="stable")[:3]]


def association(n_terms: int, examples: list[tuple[int, int, int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """From 0 to 1 for each term: how surely it goes with a label, whichever. Examples with one key and label count once."""
    distinct = {(key, y): t for _, y, key, t, _ in sorted(examples, key=lambda e: (e[2], e[1], e[3].tobytes()), reverse=True)}
    n = np.array([sum(1 for _, y in distinct if y == label) for label in (0, 1)], float)
    seen = [np.bincount(np.concatenate([np.empty(0, np.int64), *(t for (_, y), t in distinct.items() if y == label)]), minlength=n_terms).astype(float) for label in (0, 1)]
    g, both = np.zeros(n_terms), seen[0] + seen[1]
    for count, size in zip(seen, n, strict=True):
        for had, of in ((count, both), (size - count, n.sum() - both)):
            expected = of * size / max(1.0, n.sum())
            g += np.where(had > 0, 2 * had * np.log(np.where(had > 0, had, 1) / np.where(expected > 0, expected, 1)), 0.0)
    g = np.maximum(g, 0.0)
    return (g / (g + 2 * math.log(10 * max(2, n_terms)))) ** 2


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and offset by Newton's method, towards smoothed targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((p - t) * x).sum() + 1e-3 * (a - 8), (p - t).sum() + 1e-3 * b])
        w = p * (1 - p) + 1e-9
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = max(0.0, a - step[0]), b - step[1]
    return float(a), float(b)


def _sample(docs: DataFrame, labels: DataFrame, examples: int, postings: int) -> tuple[list[str], list[tuple[int, int, int, np.ndarray, np.ndarray]]]:
    """Terms of the examples and the examples themselves, on the driver: at most ``examples`` with ``postings`` terms."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out(F.col("doc_id")))
    chosen = materialize(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples))
    # at most `examples` rows of two numbers: safe to broadcast
    rows = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def count(columns: list) -> list[tuple]:
        out = []
        for i, y, text in zip(*columns, strict=True):
            got = sorted(terms_of(text).items())
            # near copies mostly share their smallest shingle, other texts don't
            key = shingles(text)[:1]
            out.append((i, int(bool(y)), int(key[0]) - 2**63 if len(key) else 0, [t for t, _ in got], [n for _, n in got]))
        return out

    counted = materialize(map_rows(rows, "doc_id bigint, toxic int, key bigint, terms array<string>, counts array<bigint>", count).withColumn("place", F.xxhash64("doc_id")))
    sizes = sorted((r.place, r.doc_id, r.n) for r in counted.select("place", "doc_id", F.size("terms").alias("n")).collect())
    fit = [(place, i) for (place, i, _), total in zip(sizes, np.cumsum([n for *_, n in sizes]), strict=True) if total <= postings]
    if not fit:
        return [], []
    last = fit[-1]
    got = counted.where((F.col("place") < last[0]) | (F.col("place") == last[0]) & (F.col("doc_id") <= last[1])).select("doc_id", "toxic", "key", "terms", "counts").toArrow().combine_chunks()
    lists, counts = got.column("terms").combine_chunks(), got.column("counts").combine_chunks()
    lists, counts = (c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in (lists, counts))
    coded = lists.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    rank = np.argsort(np.argsort(np.array(names, object), kind="stable"), kind="stable")
    ids, n, ends = rank[coded.indices.to_numpy()] if names else np.empty(0, np.int64), counts.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
    parts = [(ids[a:b], n[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
    return sorted(names), [(i, y, key, t, c) for i, y, key, (t, c) in zip(*(got.column(x).to_pylist() for x in ("doc_id", "toxic", "key")), parts, strict=True)]


def _frequencies(docs: DataFrame, names: list[str]) -> tuple[np.ndarray, int]:
    """Of all documents, how many hold each term, and their number. A task counts in one array and tells of it once."""
    known = docs.sparkSession.sparkContext.broadcast(names)  # bounded by POSTINGS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {t: i for i, t in enumerate(known.value)}
        df, total = np.zeros(len(index) + 1, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total += 1
                had = set(_WORD.findall(text.lower()))
                df[np.fromiter(map(index.get, had, repeat(len(index))), np.int64, len(had))] += 1
        df[-1] = total
        some = np.nonzero(df)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(df[some], pa.int64())], ["term", "n"])

    got = docs.select("text").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(names) + 1, np.int64)
    out[got.column("term").to_numpy()] = got.column("n").to_numpy()
    known.unpersist()
    return out[:-1], int(out[-1])


def train(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, k: int = K, postings: int = POSTINGS) -> Model:
    """docs: doc_id and text, as `texts` gives them."""
    names, sample = _sample(docs, labels, examples, postings)
    df, total = _frequencies(docs, names) if names else (np.zeros(0, np.int64), 0)
    return Model(names, df, total, sample, k)


def score_toxicity(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (ids of nearest examples) and heavy (the text's heaviest terms) for each row of docs."""
    rows = texts(docs, id_col, text_col)
    return apply(train(rows, labels, examples, k), rows)


def apply(model: Model, docs: DataFrame) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by EXAMPLES and POSTINGS

    def rows(columns: list) -> list[tuple]:
        m = shared.value
        known: dict[str, tuple] = {}  # of this chunk: copies recur
        out = []
        for i, text in zip(*columns, strict=True):
            if text not in known:
                known[text] = m.score(text)
            p, near, heavy = known[text]
            out.append((i, p, int(p >= 0.5), near, heavy))
        return out

    scored = map_rows(docs.select("doc_id", "text"), "doc_id bigint, score double, predicted int, evidence array<bigint>, heavy array<string>", rows)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence", "heavy")


def without_toxic(model: Model, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that aren't predicted to be toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            yield batch.filter(pa.array([m.score(t)[0] < 0.5 for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
