"""SentencePiece encoding and decoding by a weighted transducer.

The model file is compiled into machines over the tropical semiring (weights add along a path, the least path wins):

* the normaliser: blanks become U+2581, runs of them shrink and one is put before a text that isn't empty, as the model says. A table of
  character rules (a precompiled charsmap) isn't compiled, and a model that has one is refused;
* the pieces: one arc per piece, labelled with its characters. In a unigram model an arc weighs the piece's negative score, and there is one state.
  In a BPE model the state is the last piece: an arc from piece a to piece b weighs 0 if "ab" is segmented as a|b and infinity if not. BPE
  is local: a sequence of pieces is its result exactly if every two neighbours are, taken alone;
* byte fallback: a character that no piece spells yields its UTF-8 bytes (or the unknown piece), at the weight that the model gives unknown pieces
  (1 in a BPE model, where it is the only way);
* user-defined pieces, which are cut out of the text first (BPE) or weigh less than all others of their length (unigram).

Each input is composed with them as it is read, and the least path taken: in a unigram model by forward relaxation, in a BPE model, where all finite
paths weigh the same, by the first one that is found, depth first, longest arc first; states shown to have no finite way on are kept, so
the search is linear in the arcs of the composition.

Inputs are cut before blanks, between a word and punctuation after it, and around line feeds and tabs, where the
pieces show that no arc crosses; the segments' results are kept in a bounded table per worker.

Nulls and empty texts give no ids; rows with a null id are encoded like others; repeated rows get equal results; an empty table gives an empty
result; other columns come along if asked for, whatever their names. Ids of unknown numbers raise IndexError when decoded. Texts of any length
are encoded whole. Lone surrogates can't occur in Arrow strings.
"""

from __future__ import annotations

import heapq
import re
import string
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
INFINITY = float("inf")
#: How much worse than the worst piece of a unigram model an unknown character is.
UNKNOWN_PENALTY = 10.0
#: Segments kept per worker, in two generations of this size at most.
CACHE = 250_000


def default_model() -> str:
    """The installed public model; any other path may be given instead."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            n = number() if kind == 2 else {5: 4, 1: 8}[kind]
            yield key >> 3, data[at : at + n]
            at += n


class Machine:
    """The compiled transducer of one model file."""

    def __init__(self, path: str):
        import struct

        with open(path, "rb") as f:
            data = f.read()
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.prefix, self.unknown, self.squeeze, self.unigram = True, 0, True, True
        for k, v in _fields(data):
            if k == 1:
                got = dict(_fields(v))
                self.pieces.append(got[1].decode())
                self.scores.append(struct.unpack("<f", got[2])[0] if 2 in got else 0.0)
                self.kinds.append(got.get(3, NORMAL))
            elif k == 2:
                kind = dict(_fields(v)).get(3, 1)
                if kind not in (1, 2):
                    raise ValueError("only unigram and BPE models are supported")
                self.unigram = kind == 1
            elif k == 3:
                got = dict(_fields(v))
                if got.get(2):
                    raise ValueError("character rules of a normaliser are not supported")
                self.prefix, self.squeeze = bool(got.get(3, 1)), bool(got.get(4, 1))
        kinds = list(zip(self.pieces, self.kinds, strict=True))
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(kinds) if k == BYTE}
        self.unknown = self.kinds.index(UNKNOWN)
        self.ids = {p: i for i, (p, k) in enumerate(kinds) if k == NORMAL}
        self.user = {p: i for i, (p, k) in enumerate(kinds) if k == USER}
        if self.unigram:
            own = [self.scores[i] for i in self.ids.values()] or [0.0]
            self.arc_weights = {p: -self.scores[i] for p, i in self.ids.items()} | {p: 0.1 - len(p.encode()) * max(0.0, *own) for p in self.user}
            self.ids |= self.user
            self.missing = UNKNOWN_PENALTY - min(own)
            self.heads = {p[:k] for p in self.ids for k in range(1, len(p) + 1)}
        self.apart = re.compile("(" + "|".join(map(re.escape, sorted(self.user, key=len, reverse=True))) + ")") if self.user and not self.unigram else None
        self.longest = max(map(len, self.ids), default=1)
        self.inner = frozenset(c for p in self.ids if len(p) > 1 for c in p)
        self.split: dict[int, tuple[int, int]] = {}
        self.arcs: dict[str, int] = {}
        self.lengths: dict[str, tuple[int, ...]] = {}
        if not self.unigram:
            self._compile()
        blank = lambda p: p.replace(BLANK, " ").encode()
        self.surface = [b"" if k == CONTROL else bytes([int(p[3:5], 16)]) if k == BYTE else b" \xe2\x81\x87 " if k == UNKNOWN else blank(p) for p, k in kinds]
        self.weights: dict[int, float] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.cut = re.compile("(?s).+") if any(BLANK in p.lstrip(BLANK) for p in self.ids) else self._cuts()

    def _compile(self) -> None:
        """Keep the pieces that the merges can make, with their last merge, and the arcs' lengths by their first two and three characters."""
        lengths: dict[str, set[int]] = {}
        for p, i in self.ids.items():
            if len(p) > 1:
                got = self.merges(p, self.split)
                if got != [p]:
                    continue
            self.arcs[p] = i
        for p in self.arcs:
            for head in {p[:2], p[:3]} if len(p) > 1 else ():
                lengths.setdefault(head, {1}).add(len(p))
        for head in lengths:
            if head[:2] in self.arcs:
                lengths[head].add(2)
        self.lengths = {k: tuple(sorted(v, reverse=True)) for k, v in lengths.items()}

    def _cuts(self) -> re.Pattern:
        """Segments: blanks, then marks, then other characters; each line feed and tab by itself.

        A mark is ASCII punctuation that no piece has right after a character other than blanks and marks, so no
        arc crosses a cut between the two.
        """
        marks, before = set(string.punctuation), {}
        for p in self.ids:
            for a, b in zip(p, p[1:], strict=False):
                before.setdefault(b, set()).add(a)
        while bad := {c for c in marks if before.get(c, set()) - marks - {BLANK}}:
            marks -= bad
        mark = "".join(map(re.escape, sorted(marks))) or "(?!)"
        alone = "".join({"\n", "\t"} - self.inner)
        run = f"{BLANK}+[{mark}]*[^{BLANK}{alone}{mark}]*|[{mark}]+[^{BLANK}{alone}{mark}]*|[^{BLANK}{alone}{mark}]+" if marks else f"{BLANK}+[^{BLANK}{alone}]*|[^{BLANK}{alone}]+"
        return re.compile(run + (f"|[{alone}]" if alone else ""))

    def merges(self, text: str, split: dict | None = None) -> list[str]:
        """Segments by merging the best-scored neighbours, the leftmost of equals: the definition, used for compiling."""
        ids, scores = self.ids, self.scores
        part: list[str | None] = list(text)
        left, right = list(range(-1, len(part) - 1)), list(range(1, len(part) + 1))
        queue: list[tuple[float, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(part) and (i := ids.get(both := part[a] + part[b])) is not None:
                heapq.heappush(queue, (-scores[i], a, both))

        for k in range(len(part) - 1):
            offer(k, k + 1)
        while queue:
            _, a, both = heapq.heappop(queue)
            b = right[a]
            if part[a] is None or b >= len(part) or part[a] + part[b] != both:
                continue
            if split is not None and both == text and part[a] in ids and part[b] in ids:
                split[ids[both]] = (ids[part[a]], ids[part[b]])
            part[a], part[b] = both, None
            right[a] = right[b]
            if right[b] < len(part):
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [p for p in part if p is not None]

    def weight(self, a: int, b: int) -> float:
        """Of the arc from piece a to piece b: 0 if they stay apart when their texts meet, that is if no merge across the seam comes before both are whole."""
        key = a << 20 | b
        got = self.weights.get(key)
        if got is None:
            if len(self.weights) > 1_000_000:
                self.weights.clear()
            got = self.weights[key] = 0.0 if self._joins(a, b) else INFINITY
        return got

    def _joins(self, a: int, b: int) -> bool:
        # Follow the seam back in time: of the two pieces at it, undo the one merged last. A merge across the seam
        # at that time must not come before the merge undone (leftmost first among equals: a left merge precedes the seam).
        pieces, ids, scores, split = self.pieces, self.ids, self.scores, self.split
        limit: tuple[float, int] | None = None  # the merge next in time: (-score, 0 left of the seam, 2 right of it)
        while True:
            across = ids.get(pieces[a] + pieces[b])
            if across is not None and (limit is None or (-scores[across], 1) < limit):
                return False
            at_a = (-scores[a], 0) if a in split else None
            at_b = (-scores[b], 2) if b in split else None
            if at_a is None and at_b is None:
                return True
            if at_b is None or at_a is not None and at_a > at_b:
                limit, a = at_a, split[a][1]
            else:
                limit, b = at_b, split[b][0]

    def shortest(self, text: str) -> list[int]:
        """Ids of the least path through the composition with a normalised text."""
        return self._relaxed(text) if self.unigram else self._first(text)

    def _relaxed(self, text: str) -> list[int]:
        """Tropical distances from the start, position by position; of equal ones the first found stays."""
        n, heads, weights = len(text), self.heads, self.arc_weights
        best, back = [0.0] + [INFINITY] * n, [0] * (n + 1)
        for at in range(n):
            here, single = best[at], False
            for k in range(at + 1, n + 1):
                p = text[at:k]
                if p not in heads:
                    break
                w = weights.get(p)
                if w is not None:
                    single = single or k == at + 1
                    if here + w < best[k]:
                        best[k], back[k] = here + w, at
            if not single and here + self.missing < best[at + 1]:
                best[at + 1], back[at + 1] = here + self.missing, at
        cuts, at = [], n
        while at:
            cuts.append(text[back[at] : at])
            at = back[at]
        return [i for p in reversed(cuts) for i in self._piece(p)]

    def _first(self, text: str) -> list[int]:
        n, arc, lengths, known = len(text), self.arcs.get, self.lengths.get, self.weights.get
        path: list[int | list[int]] = []
        back: list[tuple[Iterator[int], int, int]] = []  # arcs left to try, position and last piece before each step
        dead: set[tuple[int, int]] = set()
        at, last = 0, -1
        while at < n:
            tries = iter(lengths(text[at : at + 3]) or lengths(text[at : at + 2], (1,)))
            while True:
                for k in tries:
                    i = arc(text[at : at + k])
                    if i is None:
                        if k > 1:
                            continue
                        back.append((tries, at, last))
                        path.append(self._piece(text[at]))
                        at, last = at + 1, -1
                        break
                    if last >= 0:
                        w = known(last << 20 | i)
                        if (self.weight(last, i) if w is None else w) == INFINITY:
                            continue
                    if at + k > n or dead and (at + k, i) in dead:
                        continue
                    back.append((tries, at, last))
                    path.append(i)
                    at, last = at + k, i
                    break
                else:  # no finite way on: one step back
                    if not path:
                        raise RuntimeError("no finite path")
                    dead.add((at, last))
                    path.pop()
                    tries, at, last = back.pop()
                    continue
                break
        return [x for p in path for x in (p if isinstance(p, list) else (p,))] if any(isinstance(p, list) for p in path) else path

    def _piece(self, p: str) -> list[int]:
        i = self.ids.get(p)
        if i is not None:
            return [i]
        return [self.byte[b] for b in p.encode()] if self.byte else [self.unknown]

    def normalise(self, text: str | None) -> str:
        if not text:
            return ""
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        return (BLANK if self.prefix and text else "") + text.replace(" ", BLANK)

    def encode(self, text: str | None) -> bytes:
        """Ids as native 32-bit numbers."""
        young, old, out = self.young, self.old, []
        text = self.normalise(text)
        parts = self.cut.findall(text) if self.apart is None else [x for k, p in enumerate(self.apart.split(text)) for x in ((p,) if k % 2 else self.cut.findall(p))]
        for part in parts:
            got = young.get(part)
            if got is None:
                got = old.get(part)
                if got is None:
                    own = self.user.get(part)
                    got = array("i", self.shortest(part) if own is None else [own]).tobytes()
                if len(part) <= 64:
                    if len(young) >= CACHE:
                        self.old, self.young = young, {}
                        young, old = self.young, self.old
                    young[part] = got
            out.append(got)
        if self.byte:
            return b"".join(out)
        ids = array("i", b"".join(out))  # a run of unknown pieces is one
        return array("i", [i for k, i in enumerate(ids) if i != self.unknown or not k or ids[k - 1] != i]).tobytes()

    def decode(self, ids: array | list[int]) -> str:
        surface = self.surface
        out = b"".join([surface[i] for i in ids]).decode("utf-8", "replace")
        return out[1:] if self.prefix and out[:1] == " " else out


@lru_cache(maxsize=2)
def machine(path: str) -> Machine:
    return Machine(path)


SCHEMA = "doc_id bigint, n_tokens bigint, n_bytes bigint, ids array<int>"


def encode(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), decode: bool = True) -> DataFrame:
    """One row per row of docs: the id (and the columns in ``keep``), n_tokens, n_bytes (ids from byte fallback), ids, and with ``decode`` their decoding.

    A map without shuffle: every text goes through the transducer of its worker, which is compiled once.
    """
    from pyspark.sql import functions as F
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    path = model or default_model()
    kept = docs.select(*[F.col(c) for c in keep]).schema
    schema = StructType([*kept.fields, *StructType.fromDDL(SCHEMA + ", decoded string" * decode).fields])
    arrow = to_arrow_schema(schema)
    rows = docs.select(*[F.col(c) for c in keep], F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(path)
        low, high = min(m.byte.values(), default=0), max(m.byte.values(), default=-1)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ends, parts, n_bytes, decoded = [0], [], [], []
                for text in part.column(len(keep) + 1).to_pylist():
                    got = m.encode(text)
                    ids = array("i", got)
                    parts.append(got)
                    ends.append(ends[-1] + len(ids))
                    if decode:
                        decoded.append(m.decode(ids))
                    n_bytes.append(sum(1 for i in ids if low <= i <= high) if high >= 0 else 0)
                values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(parts))])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                counts = pa.array([b - a for a, b in zip(ends, ends[1:], strict=False)], pa.int64())
                own = [part.column(len(keep)), counts, pa.array(n_bytes, pa.int64()), lists.cast(arrow.field("ids").type), *([pa.array(decoded, pa.string())] if decode else [])]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*part.columns[: len(keep)], *own], arrow, strict=True)], schema=arrow)

    return rows.mapInArrow(run, schema)
