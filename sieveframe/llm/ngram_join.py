"""N-gram Jaccard join with Bayesian candidate pruning.

Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; a document is the set of its runs of ``n`` words, each a 64-bit
hash (a text of fewer words is one run). Two documents link if the Jaccard similarity of their sets is at least ``t``.

1. One pass gives each document the 128-bit hash of its set and MinHash values. Rows with equal sets form a class, one node of the
   graph: copies never meet as pairs. Nodes are numbered in order of their smallest doc_id.
2. Candidates share ``ROWS`` values of one of ``BANDS`` bands: at 0.8 a pair is missed with probability
   (1 - 0.8**4)**24 = 3e-6. Within a bucket, MinHash values (a byte of each) are compared ``STEP`` at a time; with a uniform prior, m
   matches of k leave a Beta(m + 1, k - m + 1) posterior, and a pair is dropped once it gives a similarity of t or more a probability
   below ``TOLERANCE``. A bucket returns a spanning forest of the pairs that are left, never the pairs, and pairs that the forest
   already joins aren't compared. What the forests join is a cluster; texts that only share a bucket are not.
3. A cluster's sets are dealt to blocks of about ``BLOCK`` hashes and ``MEMBERS`` sets. Each pair of blocks is one unit of work, so a
   cluster of any size is spread over many tasks, and each pair of documents is compared in one of them: by all MinHash values as
   above, then exactly. A unit returns counts and a spanning forest.
4. Components of the links by alternating stars.

Buckets, classes and components that hold more than one in ``HOT_SHARE`` of the rows they are joined to (so there are fewer than that) are
broadcast, others joined by a shuffle: no key's rows must meet in one task.

Result: one row per row of the input: doc_id, class_id (smallest doc_id with the same set), n_links (other rows that link to it, copies too),
component_id (smallest doc_id in reach), kept, and text_hash (xxhash64 of the text). Of each component the rows of one doc_id and text are kept:
of the smallest doc_id, and where that has several texts, one of them.

Defined results: texts without words (null, empty, white space) link with nothing and are each kept; rows with a null
doc_id get null ids, no links and kept = true; repeated rows count as copies and all have the same result (a caller that
wants one row of them drops repeated rows); rows with one doc_id and different texts are different documents, each with the links of its own
text; other columns, whatever their names, are ignored; an empty table gives an empty result. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, texts
from .graph import connected_components

N, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 4
STEP, TOLERANCE = 16, 1e-6
#: Hashes in a block (8 MB), and sets in it at most; sets in a block of a bucket, where a set is a byte for each MinHash value.
BLOCK, MEMBERS, BUCKET = 1_000_000, 1000, 8192
#: Clusters of a few hundred sets are dealt to so many blocks, of LEAST sets at least, lest one task holds most of a small corpus.
SPREAD, LEAST = 8, 200
#: Keys with more than one in so many of the rows are broadcast; there are fewer than this.
HOT_SHARE = 2000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64, size=n, dtype=np.uint64) | np.uint64(1)


def shingles(text: str | None, n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of n words of the whole text."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter(map(digest, words), np.uint64, len(words))
    if len(h) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 1)], np.uint64)
    mul = _odd(11, n)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        x = h[k : len(h) - n + 1 + k] * mul[k]
        out = (out ^ (x ^ (x >> np.uint64(32)))) * np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    return np.unique(out)


def minhash(s: np.ndarray, k: int = BANDS * ROWS) -> np.ndarray:
    """k MinHash values of a set; 2048 hashes at a time, so that long texts need no more memory."""
    mul, add = _odd(5, k)[:, None], _odd(6, k)[:, None]
    low = np.full(k, 2**32 - 1, np.uint32)
    for at in range(0, len(s), 2048):
        x = mul * s[None, at : at + 2048]
        x += add
        np.minimum(low, (x.min(axis=1) >> np.uint64(32)).astype(np.uint32), out=low)
    return low


@lru_cache(maxsize=8)
def least_matches(k: int, t: float, tolerance: float) -> tuple[int, ...]:
    """For STEP, 2 * STEP, ... values compared: the fewest matches at which P(similarity >= t) isn't below the tolerance."""
    out = []
    for n in range(STEP, k + 1, STEP):
        # P(S >= t | m of n) under Beta(m + 1, n - m + 1) is P(Binomial(n + 1, t) <= m)
        tail, m = 0.0, -1
        while tail < tolerance and m < n:
            m += 1
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def signatures(docs: DataFrame, n: int = N) -> DataFrame:
    """doc_id, th (hash of the text), s1, s2 (hash of the set, null without words), n_shingles and sig (MinHash values as bytes)."""
    schema = "doc_id bigint, th bigint, s1 bigint, s2 bigint, n_shingles bigint, sig binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                s1, s2, count, sig = [], [], [], []
                for text in part.column(2).to_pylist():
                    s = shingles(text, n)
                    count.append(len(s))
                    if len(s):
                        one, two = set_hash(s)
                        s1.append(one), s2.append(two), sig.append(minhash(s).tobytes())
                    else:
                        s1.append(None), s2.append(None), sig.append(None)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(count, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "th", "s1", "s2", "n_shingles", "sig"])

    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, schema)


def set_hash(s: np.ndarray) -> tuple[int, int]:
    data = s.tobytes()
    return xxhash.xxh3_64_intdigest(data) - 2**63, xxhash.xxh3_64_intdigest(data, 1) - 2**63


def join_hot(rows: DataFrame, keyed: DataFrame, on: list[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined to keyed, which has one row for each key and how many rows have it in column ``n``.

    The keys of more than total / HOT_SHARE rows number fewer than HOT_SHARE and are broadcast; only the others are shuffled.
    """
    hot = F.col(n) > max(total / HOT_SHARE, 64)
    few, rest = F.broadcast(keyed.where(hot)), keyed.where(~hot)
    return rows.join(few, on).unionByName(rows.join(few.select(*on), on, "left_anti").join(rest, on, how))


def _forest(sig: np.ndarray, left: np.ndarray, right: np.ndarray | None, need: tuple[int, ...]) -> np.ndarray:
    """For each row of sig the smallest row that pairs (of left, or of left and right) which aren't dropped join it to."""
    label = np.arange(len(sig))
    for a in left:
        others = np.arange(a + 1, len(sig)) if right is None else right
        others = others[label[others] != label[a]]
        hits = np.zeros(len(others), np.int32)
        for step, at in enumerate(range(0, sig.shape[1], STEP)):
            if not len(others):
                break
            hits += (sig[others, at : at + STEP] == sig[a, at : at + STEP]).sum(axis=1, dtype=np.int32)
            stay = hits >= need[step]
            others, hits = others[stay], hits[stay]
        if len(others):
            met = np.unique(np.append(label[others], label[a]))
            label[np.isin(label, met)] = met[0]
    return label


def bucket_forests(members: DataFrame, parts: int, t: float, tolerance: float) -> DataFrame:
    """(u, v) edges of the forests of buckets; members: band, n (members of the bucket), node, sig8. See step 2."""
    n_blocks = F.ceil(F.col("n") / BUCKET).cast("int")
    dealt = members.select("band", "node", "sig8", n_blocks.alias("n_blocks")).withColumn("block", F.pmod(F.xxhash64(F.lit(4), "node"), F.col("n_blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).select("band", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "sig8")
    dealt = dealt.repartition(parts, "band", "low", "high").sortWithinPartitions("band", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, unit = None, []
        out: tuple[list, list] = ([], [])

        def close() -> None:
            if len(unit) < 2:
                return
            unit.sort()
            nodes = np.array([x[0] for x in unit])
            blocks = np.array([x[1] for x in unit])
            sig = np.frombuffer(b"".join(x[2] for x in unit), np.uint8).reshape(len(unit), -1)
            low, high = key[1:]
            left, right = (np.arange(len(unit)), None) if low == high else (np.nonzero(blocks == low)[0], np.nonzero(blocks == high)[0])
            label = _forest(sig, left, right, least_matches(sig.shape[1], t, tolerance))
            got = np.nonzero(label != np.arange(len(label)))[0]
            out[0].extend(nodes[got].tolist())
            out[1].extend(nodes[label[got]].tolist())

        def flush() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["u", "v"])
            for c in out:
                c.clear()
            return got

        for batch in batches:
            for band, low, high, block, node, sig in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (band, low, high):
                    close()
                    if len(out[0]) > 50_000:
                        yield flush()
                    key, unit = (band, low, high), []
                unit.append((node, block, sig))
        close()
        yield flush()

    return dealt.mapInArrow(run, "u bigint, v bigint").distinct()


def _loaded(members: DataFrame, n: int) -> DataFrame:
    """Member texts as sorted hashes and MinHash values, as bytes; texts of the same doc_id but another class are left out."""
    schema = "cluster bigint, n_blocks int, block int, node bigint, copies bigint, hashes binary, sig binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                own = zip(*(part.column(k).to_pylist() for k in (5, 6, 7)), strict=True)
                sets = [s if len(s) and set_hash(s) == (s1, s2) else None for s, s1, s2 in ((shingles(t, n), s1, s2) for s1, s2, t in own)]
                keep = pa.array([s is not None for s in sets])
                sets = [s for s in sets if s is not None]
                left = [c.filter(keep) for c in part.columns[:5]]
                yield pa.RecordBatch.from_arrays([*left, pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([minhash(s).tobytes() for s in sets], pa.binary())], ["cluster", "n_blocks", "block", "node", "copies", "hashes", "sig"])

    return members.select("cluster", "n_blocks", "block", "node", "copies", "s1", "s2", "text").mapInArrow(run, schema)


class _Unit:
    """The rows of one pair of blocks, gathered from a sorted stream, and their links."""

    def __init__(self, key: tuple[int, int, int], t: float, tolerance: float):
        self.key, self.t, self.tolerance = key, t, tolerance
        self.ids: list[int] = []
        self.seen: set[int] = set()
        self.copies: list[int] = []
        self.blocks: list[int] = []
        self.sets: list[np.ndarray] = []
        self.sigs: list[np.ndarray] = []

    def links(self) -> tuple[list[int], list[int], list[int]]:
        """ids, links found here (copies counted) and the root of each in this unit's forest, for ids with links."""
        _, low, high = self.key
        order = np.argsort(np.array(self.ids))
        ids, copies = np.array(self.ids)[order], np.array(self.copies)[order]
        blocks = np.array(self.blocks)[order]
        sets, sig = [self.sets[i] for i in order], np.stack(self.sigs)[order]
        size = np.array([len(s) for s in sets])
        k = sig.shape[1]
        need = least_matches(k, self.t, self.tolerance)
        n, root = np.zeros(len(ids), np.int64), np.arange(len(ids))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        left = range(len(ids)) if low == high else np.nonzero(blocks == low)[0]
        right = None if low == high else np.nonzero(blocks == high)[0]
        mark = np.concatenate(sets)
        owner = np.repeat(np.arange(len(ids)), size)
        by = np.argsort(mark, kind="stable")
        mark, owner = mark[by], owner[by]
        for a in left:
            others = np.arange(a + 1, len(ids)) if right is None else right
            small, large = np.minimum(size[others], size[a]), np.maximum(size[others], size[a])
            others = others[small >= self.t * large]  # the bound by size is exact
            hits = np.zeros(len(others), np.int32)
            for step, at in enumerate(range(0, k, STEP)):
                if not len(others):
                    break
                hits += (sig[others, at : at + STEP] == sig[a, at : at + STEP]).sum(axis=1, dtype=np.int32)
                stay = hits >= need[step]
                others, hits = others[stay], hits[stay]
            if not len(others):
                continue
            if len(others) > 32:  # all intersections at once, through the merged hashes
                at, to = np.searchsorted(mark, sets[a], "left"), np.searchsorted(mark, sets[a], "right")
                n_at = to - at
                flat = np.repeat(at - np.concatenate(([0], np.cumsum(n_at)[:-1])), n_at) + np.arange(n_at.sum())
                common = np.bincount(owner[flat], minlength=len(ids))[others]
            else:
                common = np.array([_common(sets[a], sets[b]) for b in others])
            for b in others[common >= self.t * (size[a] + size[others] - common) - 1e-9]:
                n[a] += copies[b]
                n[b] += copies[a]
                x, y = find(a), find(b)
                if x != y:
                    root[max(x, y)] = min(x, y)
        got = np.nonzero(n)[0]
        return ids[got].tolist(), n[got].tolist(), [int(ids[find(i)]) for i in got]


def _common(a: np.ndarray, b: np.ndarray) -> int:
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def cluster_links(loaded: DataFrame, parts: int, t: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(id, links, root) of nodes per unit of work: see step 3."""
    k = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    units = loaded.withColumn("other", k).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other", "n_blocks")
    dealt = units.repartition(parts, "cluster", "low", "high").sortWithinPartitions("cluster", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit: _Unit | None = None
        out: tuple[list, list, list] = ([], [], [])

        def flush() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["id", "links", "root"])
            for c in out:
                c.clear()
            return got

        def close() -> None:
            if unit is not None and len(unit.ids) > 1:
                for c, more in zip(out, unit.links(), strict=True):
                    c.extend(more)

        for batch in batches:
            c = batch.to_pydict()
            for cluster, block, i, copies, hashes, sig, low, high in zip(*(c[x] for x in ("cluster", "block", "node", "copies", "hashes", "sig", "low", "high")), strict=True):
                if unit is None or unit.key != (cluster, low, high):
                    close()
                    if len(out[0]) > 50_000:
                        yield flush()
                    unit = _Unit((cluster, low, high), t, tolerance)
                if i in unit.seen:  # a repeated row
                    continue
                unit.seen.add(i)
                unit.ids.append(i)
                unit.copies.append(copies)
                unit.blocks.append(block)
                unit.sets.append(np.frombuffer(hashes, np.uint64))
                unit.sigs.append(np.frombuffer(sig, np.uint32))
        close()
        yield flush()

    return dealt.mapInArrow(run, "id bigint, links bigint, root bigint")


def near_duplicates(docs: DataFrame, n: int = N, t: float = THRESHOLD, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """See above: doc_id, class_id, n_links, component_id, kept, text_hash for each row of docs."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = texts(docs, id_col, text_col)
    all_sigs = materialize(signatures(rows, n))
    sigs = all_sigs.where("s1 is not null and doc_id is not null")
    classes = sigs.groupBy("s1", "s2").agg(F.min("doc_id").alias("id"), F.min_by("th", "doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    # nodes in order of id: the smallest node of a component has its smallest doc_id. The numbers are fixed by the checkpoint
    classes = materialize(classes.orderBy("id", "s1", "s2").withColumn("node", F.monotonically_increasing_id()))
    width = 4 * ROWS
    bands = classes.select("node", F.explode(F.array(*[F.xxhash64(F.lit(b), F.expr(f"substring(sig, {b * width + 1}, {width})")) for b in range(BANDS)])).alias("band"))
    buckets = materialize(bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"))
    n_classes = classes.count()
    shared = join_hot(bands, buckets, ["band"], "n", n_classes * BANDS)
    # the lowest byte of each MinHash value: chance matches only keep pairs
    bytes_of = F.concat(*[F.expr(f"substring(sig, {4 * k + 1}, 1)") for k in range(BANDS * ROWS)])
    edges = materialize(bucket_forests(shared.join(classes.select("node", bytes_of.alias("sig8")), "node"), parts, t, tolerance))
    plain = classes.drop("sig")
    clusters = materialize(connected_components(edges).join(plain, "node").withColumnRenamed("component", "cluster"))
    n_blocks = F.ceil(F.greatest(F.sum("n_shingles") / BLOCK, F.count("*") / MEMBERS, F.least(F.lit(float(SPREAD)), F.count("*") / LEAST))).cast("int")
    blocks = materialize(clusters.groupBy("cluster").agg(n_blocks.alias("n_blocks"), F.count("*").alias("n")))
    members = join_hot(clusters, blocks, ["cluster"], "n", n_classes).withColumn("block", F.pmod(F.xxhash64(F.lit(3), "node"), F.col("n_blocks")).cast("int"))
    held = rows.join(members, rows.doc_id == members.id)
    found = materialize(cluster_links(_loaded(held, n), parts, t, tolerance))
    per = found.groupBy(F.col("id").alias("node")).agg(F.sum("links").alias("links"))
    components = materialize(connected_components(found.select(F.col("id").alias("u"), F.col("root").alias("v"))))
    heads = components.groupBy("component").agg(F.count("*").alias("n")).join(plain.select(F.col("node").alias("component"), F.col("id").alias("head")), "component")
    of = join_hot(components, materialize(heads), ["component"], "n", n_classes).select("node", "component", "head")
    info = plain.join(per, "node", "left").join(of, "node", "left")
    info = materialize(info.select("s1", "s2", "id", "rep", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("head", "id").alias("head"), (F.coalesce("component", "node") == F.col("node")).alias("first")))
    light = all_sigs.select("doc_id", "th", F.when(F.col("doc_id").isNotNull(), F.col("s1")).alias("s1"), "s2")
    out = join_hot(light, info, ["s1", "s2"], "copies", all_sigs.count(), "left")
    kept = F.col("first") & (F.col("doc_id") == F.col("id")) & (F.col("th") == F.col("rep"))
    return out.select("doc_id", F.coalesce("id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("head", "doc_id").alias("component_id"), F.coalesce(kept, F.lit(True)).alias("kept"), F.col("th").alias("text_hash"))
