"""Embedding near-dedup over an inverted multi-index.

* Vectors are scaled to length one in double precision; copies of a vector form a class of which one goes on.
* Two codebooks, one for each half, fitted by k-means on at most ``SAMPLE`` vectors (smallest hash of the id), form a product
  grid with about one cell for ``CELL`` vectors. Every vector lies in the cell of its nearest centroid in either half.
* A query visits cells in multi-sequence order of the sum of its halves' excesses (squared distance to a centroid less that to the
  nearest one) up to a limit. The limit is the least that reaches the target recall for the hardest pairs, those of exactly the threshold's
  cosine: sampled vectors are turned by that angle in random directions, and the excess of the cell they land in is measured.
  Closer pairs land in nearer cells, so the recall of all links is above the target.
* Cells are dealt as pairs of blocks of at most about ``BLOCK`` vectors, so that a cell with very many vectors (a group of near
  copies) is spread over tasks. Each (query, vector) pair is verified in one of them, by cosine in double precision; a unit
  returns counts and a spanning forest, never its pairs. Where the vector, as a query, doesn't visit the other's cell, the unit
  counts the link for both, so that a link found from one end counts at both.
* Vectors of another length are another index. Lengths with at most ``SMALL`` vectors make one cell each, all of them in one pass.

The fitted part is two codebooks of at most ``CENTROIDS`` half vectors and one number; up to CENTROIDS ** 2 * CELL vectors (17 billion) cells
keep their size. Larger cells move fewer copies of a vector and compare more: CELL is where both are small.

Result: one row per row of the input: vec_id, n_links (other rows linked), component_id, kept. Defined results: vectors that are null,
empty or zero or hold null or non-finite components link with nothing and are kept; vectors of different lengths don't link; rows with a null id get null ids, no links and kept = true; repeated
rows are copies of each other; other columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .graph import connected_components

THRESHOLD, RECALL = 0.95, 0.999
CELL, CENTROIDS, SAMPLE, BLOCK, SMALL = 1024, 4096, 50_000, 2048, 4096


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    r = np.random.Generator(np.random.PCG64(seed))
    k = min(k, len(x))
    c = x[r.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([_distances(x[at : at + 1024], c).argmin(1) for at in range(0, len(x), 1024)])
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared, less the same number for all centroids of a row."""
    return (c * c).sum(1)[None] - 2 * x @ c.T


def multi_sequence(a: list[float], b: list[float], limit: float) -> Iterator[tuple[int, int]]:
    """Index pairs of two ascending sequences by their sum, least first, while the sum is at most ``limit``."""
    if not len(a) or not len(b):
        return
    queue, seen = [(a[0] + b[0], 0, 0)], {(0, 0)}
    while queue and queue[0][0] <= limit:
        _, i, j = heapq.heappop(queue)
        yield i, j
        for x in ((i + 1, j), (i, j + 1)):
            if x[0] < len(a) and x[1] < len(b) and x not in seen:
                seen.add(x)
                heapq.heappush(queue, (a[x[0]] + b[x[1]], *x))


class Grid:
    """Codebooks of the halves, and the excess up to which a query visits cells."""

    def __init__(self, books: tuple[np.ndarray, np.ndarray]):
        self.books, self.limit = books, 0.0

    def _halves(self, x: np.ndarray) -> list[np.ndarray]:
        h = self.books[0].shape[1]
        return [_distances(part, book) for part, book in zip((x[:, :h], x[:, h:]), self.books, strict=True)]

    def own(self, x: np.ndarray) -> np.ndarray:
        i, j = (d.argmin(1) for d in self._halves(x))
        return i * len(self.books[1]) + j

    def excesses(self, x: np.ndarray) -> list[np.ndarray]:
        return [d - d.min(1)[:, None] for d in self._halves(x)]

    def calibrate(self, x: np.ndarray, t: float, recall: float) -> None:
        """See above; x: unit vectors."""
        r = np.random.Generator(np.random.PCG64(9))
        turn = r.standard_normal(x.shape)
        turn -= (turn * x).sum(1)[:, None] * x
        norm = np.sqrt((turn * turn).sum(1))[:, None]
        y = t * x + np.sqrt(max(0.0, 1 - t * t)) * turn / np.where(norm > 0, norm, 1)
        cell, (a, b) = self.own(y), self.excesses(x)
        row = np.arange(len(x))
        self.limit = float(np.quantile(a[row, cell // len(self.books[1])] + b[row, cell % len(self.books[1])], recall, method="higher"))

    def visits(self, x: np.ndarray) -> list[list[int]]:
        """For each vector the cells within the limit, nearest first."""
        out = []
        for a, b in zip(*self.excesses(x), strict=True):
            i, j = (k[np.argsort(e[k], kind="stable")] for e in (a, b) for k in (np.nonzero(e <= self.limit)[0],))
            out.append([int(i[m]) * len(self.books[1]) + int(j[n]) for m, n in multi_sequence(a[i].tolist(), b[j].tolist(), self.limit)])
        return out

    def visited(self, x: np.ndarray, own: int, cells: np.ndarray) -> np.ndarray:
        """Whether vectors x of the cell ``own`` visit the cells, as queries: a row for each vector."""
        out, width, h = np.zeros((len(x), len(cells))), len(self.books[1]), self.books[0].shape[1]
        for part, book, mine, there in ((x[:, :h], self.books[0], own // width, cells // width), (x[:, h:], self.books[1], own % width, cells % width)):
            out += _distances(part, book[there]) - _distances(part, book[[mine]])
        return out <= self.limit


def unit_vectors(values: list[list[float] | None]) -> list[np.ndarray | None]:
    """Scaled to length one; None for what links with nothing."""
    out: list[np.ndarray | None] = []
    for v in values:
        if not v or None in v:
            out.append(None)
            continue
        x = np.array(v, float)
        top = np.abs(x).max()
        if not np.isfinite(x).all() or top == 0:
            out.append(None)
            continue
        x = x / top  # so that squares neither overflow nor vanish
        out.append(x / np.sqrt(x @ x))
    return out


def _units(vectors: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = unit_vectors(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if v is None else len(v) for v in got], pa.int32()), pa.array([None if v is None else v.tobytes() for v in got], pa.binary())], ["vec_id", "dim", "unit"])

    return vectors.mapInArrow(run, "vec_id bigint, dim int, unit binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(b, float) for b in column.to_pylist()])


def _links(units: DataFrame, t: float, grid: Grid | None) -> DataFrame:
    """(id, links, root) of each unit of work: rows of one (cell, member block, query block), members first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, copies, froms, vecs = None, [], [], [], []

        def close() -> pa.RecordBatch | None:
            home = np.array(froms)  # of a query its own cell, -1 for a member
            q = home >= 0
            if not len(q) or q.all() or not q.any():
                return None
            x, i, n = np.stack(vecs), np.array(ids), np.array(copies)
            m_id, m_n, m_x = i[~q], n[~q], x[~q]
            cells, place = np.unique(home[q], return_inverse=True)
            back = None if grid is None else grid.visited(m_x, key[0], cells)
            root = {}

            def find(v: int) -> int:
                while root.setdefault(v, v) != v:
                    root[v] = root[root[v]]
                    v = root[v]
                return v

            links, other = [], np.zeros(len(m_id), np.int64)
            for at in range(0, int(q.sum()), 512):
                q_id, q_n, q_x = i[q][at : at + 512], n[q][at : at + 512], x[q][at : at + 512]
                hit = (q_x @ m_x.T >= t) & (q_id[:, None] != m_id[None])
                links.append((q_id, hit @ m_n))
                if back is not None:
                    other += q_n @ (hit & ~back[:, place[at : at + 512]].T)
                for r in np.nonzero(hit.any(1))[0]:
                    others = m_id[hit[r]]
                    a = find(int(q_id[r]))
                    for b in np.unique([find(int(o)) for o in others]) if len(others) > 1 else [find(int(others[0]))]:
                        b = find(int(b))
                        if a != b:
                            root[max(a, b)] = min(a, b)
                            a = min(a, b)
            own: dict[int, int] = {}
            for who, count in (*links, (m_id, other)):
                for w, c in zip(who.tolist(), count.tolist(), strict=True):
                    if c:
                        own[w] = own.get(w, 0) + c
            told = sorted(set(own) | set(root))
            return pa.RecordBatch.from_arrays([pa.array(told, pa.int64()), pa.array([own.get(v, 0) for v in told], pa.int64()), pa.array([find(v) for v in told], pa.int64())], ["id", "links", "root"])

        for batch in batches:
            c = batch.to_pydict()
            for cell, mb, qb, i, n, home, unit in zip(*(c[k] for k in ("cell", "mb", "qb", "id", "copies", "home", "unit")), strict=True):
                if key != (cell, mb, qb):
                    got = close()
                    if got is not None:
                        yield got
                    key, ids, copies, froms, vecs = (cell, mb, qb), [], [], [], []
                ids.append(i)
                copies.append(n)
                froms.append(home)
                vecs.append(np.frombuffer(unit, float))
        got = close()
        if got is not None:
            yield got

    return units.mapInArrow(run, "id bigint, links bigint, root bigint")


def _pairs(asked: DataFrame, members: DataFrame, t: float, grid: Grid | None) -> DataFrame:
    """Links of queries (id, copies, unit, home, cell) to members (id, copies, unit, cell): every pair of a cell's blocks is a unit."""
    sizes = materialize(members.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    own = members.join(sizes, "cell").withColumn("mb", F.pmod(F.xxhash64(F.lit(5), "id"), F.col("blocks")).cast("int"))
    asked = asked.join(sizes, "cell")
    queries = materialize(asked.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("qblocks")))
    q = asked.join(queries, "cell").withColumn("qb", F.pmod(F.xxhash64(F.lit(6), "id"), F.col("qblocks")).cast("int"))
    q = q.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("mb"), "qb", "id", "copies", "home", "unit")
    m = own.join(queries, "cell").select("cell", "mb", F.explode(F.sequence(F.lit(0), F.col("qblocks") - 1)).alias("qb"), "id", "copies", F.lit(-1).cast("long").alias("home"), "unit")
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _links(m.unionByName(q).repartition(parts, "cell", "mb", "qb").sortWithinPartitions("cell", "mb", "qb"), t, grid)


def _grid(classes: DataFrame, t: float, recall: float, cell: int, sample: int) -> Grid:
    """Codebooks and limit from a bounded sample, with as many centroids as all vectors ask for."""
    x = np.stack([np.frombuffer(r.unit, float) for r in classes.orderBy(F.xxhash64("id"), "id").limit(sample).select("unit").collect()])
    k = min(CENTROIDS, max(1, int(np.ceil(np.sqrt(classes.count() / cell)))))
    h = x.shape[1] - x.shape[1] // 2
    grid = Grid((_kmeans(x[:, :h], k, 1), _kmeans(x[:, h:], k, 2)))
    grid.calibrate(x, t, recall)
    return grid


def _placed(classes: DataFrame, grid: Grid) -> tuple[DataFrame, DataFrame]:
    """Queries (one row for each cell visited, with their own as ``home``) and members."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(grid.own(_matrix(part.column(2))), pa.int64())], ["id", "copies", "unit", "cell"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = _matrix(part.column(2))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(grid.own(x), pa.int64()), pa.array(grid.visits(x), pa.list_(pa.int64()))], ["id", "copies", "unit", "home", "cells"])

    rows = classes.select("id", "copies", "unit")
    members = materialize(rows.mapInArrow(assign, "id bigint, copies bigint, unit binary, cell bigint"))
    asked = rows.mapInArrow(visit, "id bigint, copies bigint, unit binary, home bigint, cells array<bigint>").select("id", "copies", "unit", "home", F.explode("cells").alias("cell"))
    return asked, members


def near_duplicates(vectors: DataFrame, t: float = THRESHOLD, recall: float = RECALL, cell: int = CELL, sample: int = SAMPLE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """See above: vec_id, n_links, component_id, kept for each row."""
    rows = materialize(_units(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))).withColumn("h1", F.xxhash64("unit")).withColumn("h2", F.xxhash64(F.lit(7), "unit")))
    valid = rows.where("vec_id is not null and unit is not null")
    classes = materialize(valid.groupBy("dim", "h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("unit").alias("unit")))
    lengths = materialize(classes.groupBy("dim").count())
    few = lengths.where(F.col("count") <= SMALL).select("dim", F.col("dim").cast("long").alias("cell"))
    rare = classes.join(few, "dim").select("id", "copies", "unit", "cell")
    found = _pairs(rare.withColumn("home", F.col("cell")), rare, t, None)
    for dim in sorted(r.dim for r in lengths.where(F.col("count") > SMALL).collect()):
        same = classes.where(F.col("dim") == dim)
        grid = _grid(same, t, recall, cell, sample)
        found = found.unionByName(_pairs(*_placed(same, grid), t, grid))
    found = materialize(found)
    per = found.groupBy("id").agg(F.sum("links").alias("links"))
    components = connected_components(found.where("id != root").select(F.col("id").alias("u"), F.col("root").alias("v")))
    info = materialize(classes.select("dim", "h1", "h2", "id", "copies").join(per, "id", "left").join(components, F.col("id") == F.col("node"), "left").select("dim", "h1", "h2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "id").alias("component")))
    light = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("dim")).alias("dim"), "h1", "h2")
    out = light.join(info, ["dim", "h1", "h2"], "left")
    c = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), c.alias("component_id"), F.coalesce(F.col("vec_id") == c, F.lit(True)).alias("kept"))
