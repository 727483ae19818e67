"""Exact top-k vector search through an index of blocks with score bounds.

The candidates become a written table of blocks.  Vectors are ordered by the signs of random
projections, each stretch of this order is halved by two means until its parts fit a block, so that
a block holds neighbours, and equal vectors are stored once with the list of their ids.  A block keeps its centre, the largest distance of a member from it and the largest
norm, hence for a query q every member x has ``q·x <= min(q·centre + |q| radius, |q| norm)``.  For
cosines all vectors are divided by their norms first.

Queries are packed into chunks.  A chunk first scores the few blocks whose centres suit it best;
the k-th score found so far is what a query's other blocks have to reach, and only the pairs of
query and block whose bound does are scored.  Blocks, chunks and bounds meet in Spark joins: the
summaries of the blocks in slices of ``SLICE_BLOCKS``, the blocks themselves by their number, so
neither the candidates nor their summaries pass through the driver; whether a side is small enough
to be broadcast is decided by its measured size.  An index of up to ``PROBES`` blocks has nothing to
skip and is scored at once.

After the first blocks, chunks and blocks meet in tiles (:func:`tiled`): a task takes up to
``TILE_BYTES`` of neighbouring chunks and as much of the index, so a block is sent once for many
chunks and a chunk once for many blocks, and a query leaves a tile with one list.

Candidates are ranked by the score rounded to ``RANK_DIGITS``, so float summation order cannot swap
ties, then by ascending id; bounds have ``SLACK`` to spare for rounding.  Pairs are scored in single
precision first: those that miss the score needed by more than the error bound of that
(:func:`narrowed`) are out, the others are scored in double precision (:func:`pair_scores`).  Seen
candidates are masked in the tasks.  There is one row for each key on the left side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankfold.session import materialize, release

# rounding applied before ranking so that float summation order cannot swap ties
RANK_DIGITS = 9
SLACK = 4e-9
# different vectors and ids of a block
BLOCK_VECTORS = 4096
BLOCK_IDS = 1 << 20
# vectors, in blocks, among which a task looks for neighbours
BUFFER_BLOCKS = 32
# queries of a chunk, and the seen ids after which a chunk ends
CHUNK_ROWS = 2048
CHUNK_SEEN = 1 << 20
# blocks that a chunk scores before any bound is known
PROBES = 4
SLICE_BLOCKS = 4096
PROJECTIONS = 24
# scores held per scoring step (rows x candidates), bounding task memory, and those of single precision, which stay in a core's cache
SCORE_BLOCK_ELEMENTS = 4_000_000
NARROW_ELEMENTS = 1 << 19
# products of norms between which single precision has its usual relative error
NARROW_MOST = 1e30
NARROW_LEAST = 1e-30
# candidates whose maxima bound a first k-th score from below: at least so many groups
LEAST_GROUPS = 64
# bytes of chunks and of blocks of a tile, and the tiles for each core that a smaller search is cut into
TILE_BYTES = 64 << 20
TILES_PER_CORE = 8
TILE_TASKS = 1 << 14

_BLOCK = "block long, n int, ids binary, starts binary, matrix binary, centre binary, radius double, norm double"
_CHUNK = "chunk long, keys binary, limits binary, queries binary, seen_at binary, seen binary"
_TILE_FOUND = [("_l", pa.int64()), ("_r", pa.int64()), ("_s", pa.float64()), ("_k", pa.int32())]
_FOUND = "_l long, _r long, _s double, _k int, chunk long, block long"


def l2_norm(vec: str | Column) -> Column:
    v = F.col(vec) if isinstance(vec, str) else vec
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def vectors_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column of equal lengths as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(column), -1)


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows divided by their norms; zero rows stay zero."""
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms > 0, norms, 1.0)


def _place(cosine: bool):
    """(_r, _rv) with the vector as it is scored, the cell of its projections and a hash of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = vectors_of(batch.column("_rv")) + 0.0  # no negative zeros
            vectors = unit_rows(vectors) if cosine else vectors
            rng = np.random.default_rng([7, vectors.shape[1]])
            signs = vectors @ rng.standard_normal((vectors.shape[1], PROJECTIONS)) > 0
            cell = signs @ (1 << np.arange(PROJECTIONS)[::-1])
            odd = rng.integers(0, 2**63, vectors.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            h = (np.ascontiguousarray(vectors).view(np.uint64) * odd).sum(axis=1, dtype=np.uint64).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1) * vectors.shape[1], pa.int32()), pa.array(vectors.reshape(-1)))
            others = [batch.column(c) for c in batch.schema.names if c != "_rv"]
            names = [c for c in batch.schema.names if c != "_rv"]
            yield pa.RecordBatch.from_arrays([*others, lists, pa.array(cell.astype(np.int64)), pa.array(h)], names=[*names, "_rv", "cell", "h"])

    return run


def _halves(vectors: np.ndarray) -> np.ndarray:
    """Which vectors go to the second half: two means from two far vectors, or the median along them
    where one half would hold less than an eighth."""
    far = vectors[np.argmax(np.linalg.norm(vectors - vectors.mean(axis=0), axis=1))]
    ends = np.stack([far, vectors[np.argmax(np.linalg.norm(vectors - far, axis=1))]])
    for _ in range(4):
        along = vectors @ (ends[1] - ends[0])
        second = along > (ends.sum(axis=0) / 2) @ (ends[1] - ends[0])
        if not 0 < second.sum() < len(vectors):
            break
        ends = np.stack([vectors[~second].mean(axis=0), vectors[second].mean(axis=0)])
    if min(second.sum(), len(second) - second.sum()) * 8 < len(second):
        second = np.zeros(len(vectors), dtype=bool)
        second[np.argsort(along, kind="stable")[len(vectors) // 2 :]] = True
    return second


def _groups(vectors: np.ndarray, counts: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Rows of ``vectors`` in groups of neighbours, of at most ``most`` vectors and ``BLOCK_IDS`` ids
    (a vector with more ids stays alone)."""
    todo = [np.arange(len(vectors))]
    while todo:
        rows = todo.pop()
        if len(rows) <= most and (counts[rows].sum() <= BLOCK_IDS or len(rows) == 1):
            yield rows
        else:
            second = _halves(vectors[rows])
            todo += [rows[~second], rows[second]]


def _pack_blocks(block_vectors: int):
    def block(number: int, ids: np.ndarray, counts: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
        starts = np.cumsum(counts) - counts
        if len(starts) == len(ids):  # no repeated vector: in id order
            order = np.argsort(ids, kind="stable")
            ids, vectors = ids[order], vectors[order]
        centre = vectors.mean(axis=0)
        row = (
            (TaskContext.get().partitionId() << 32) | number, len(ids), ids.tobytes(), starts.astype(np.int64).tobytes(), np.ascontiguousarray(vectors).tobytes(),
            centre.tobytes(), float(np.linalg.norm(vectors - centre, axis=1).max()), float(np.linalg.norm(vectors, axis=1).max()),
        )
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in _BLOCK.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0

        def blocks(ids: np.ndarray, matrix: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal number
            starts = np.flatnonzero(np.append(True, (matrix[1:] != matrix[:-1]).any(axis=1)))
            # a vector with very many ids is cut into parts
            starts = np.unique(np.concatenate([starts, np.arange(0, len(ids), BLOCK_IDS)]))
            counts, vectors = np.diff(np.append(starts, len(ids))), matrix[starts]
            for rows in _groups(vectors, counts, block_vectors):
                n = counts[rows]
                at = np.arange(n.sum()) + np.repeat(starts[rows] - (np.cumsum(n) - n), n)
                yield block(number, ids[at], n, vectors[rows])
                number += 1

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            if batch.num_rows:
                held.append((batch.column("_r").to_numpy(), vectors_of(batch.column("_rv"))))
            if sum(len(ids) for ids, _ in held) >= BUFFER_BLOCKS * block_vectors:
                yield from blocks(*map(np.concatenate, zip(*held, strict=True)))
                held = []
        if held:
            yield from blocks(*map(np.concatenate, zip(*held, strict=True)))

    return run


def build_index(right: DataFrame, key: str, vec: str, cosine: bool, block_vectors: int | None = None) -> DataFrame:
    """The blocks of a table of vectors, one row each, written under the checkpoint folder."""
    table = right.select(F.col(key).cast("long").alias("_r"), F.col(vec).cast("array<double>").alias("_rv"))
    order = ["cell", "h", "_r"]
    placed = table.mapInArrow(_place(cosine), "_r long, _rv array<double>, cell long, h long")
    ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order).select("_r", "_rv")
    return materialize(ordered.mapInArrow(_pack_blocks(block_vectors or BLOCK_VECTORS), _BLOCK), "index", compression="uncompressed")


def _pack_chunks(exclude_same_key: bool):
    names = [c.split()[0] for c in _CHUNK.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            seen = batch.column("_seen")
            keys, limits = batch.column("_l").to_numpy(), batch.column("_k").to_numpy().astype(np.int32)
            queries = vectors_of(batch.column("_rv"))
            at = seen.offsets.to_numpy().astype(np.int64)
            flat = seen.values.to_numpy(zero_copy_only=False)
            first = 0
            while first < len(keys):
                last = min(first + CHUNK_ROWS, len(keys), max(first + 1, int(np.searchsorted(at, at[first] + CHUNK_SEEN))))
                counts = np.diff(at[first : last + 1])
                own = flat[at[first] : at[last]]
                if exclude_same_key:
                    own = np.insert(own, np.cumsum(counts), keys[first:last])
                    counts = counts + 1
                row = (
                    (TaskContext.get().partitionId() << 32) | number, keys[first:last].tobytes(), limits[first:last].tobytes(), queries[first:last].tobytes(),
                    np.concatenate([[0], np.cumsum(counts)]).astype(np.int64).tobytes(), own.astype(np.int64).tobytes(),
                )
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if i == 0 else pa.binary()) for i, v in enumerate(row)], names=names)
                number, first = number + 1, last

    return run


def pack_chunks(rows: DataFrame, cosine: bool, exclude_same_key: bool = False) -> DataFrame:
    """Chunks of queries (_l, _rv, _k, _seen), neighbours together."""
    placed = rows.mapInArrow(_place(cosine), "_l long, _k int, _seen array<long>, _rv array<double>, cell long, h long")
    ordered = placed.repartitionByRange("cell", "_l").sortWithinPartitions("cell", "_l").select("_l", "_rv", "_k", "_seen")
    return materialize(ordered.mapInArrow(_pack_chunks(exclude_same_key), _CHUNK), "chunks", compression="uncompressed")


@dataclass
class Chunk:
    keys: np.ndarray
    limits: np.ndarray
    queries: np.ndarray
    seen_at: np.ndarray
    seen: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Chunk:
        keys = np.frombuffer(row["keys"], dtype=np.int64)
        return cls(
            keys, np.frombuffer(row["limits"], dtype=np.int32), np.frombuffer(row["queries"]).reshape(len(keys), -1),
            np.frombuffer(row["seen_at"], dtype=np.int64), np.frombuffer(row["seen"], dtype=np.int64),
        )

    def pick(self, rows: np.ndarray) -> Chunk:
        counts = np.diff(self.seen_at)[rows]
        at = np.concatenate([[0], np.cumsum(counts)])
        inside = np.arange(at[-1]) + np.repeat(self.seen_at[rows] - at[:-1], counts)
        return Chunk(self.keys[rows], self.limits[rows], self.queries[rows], at, self.seen[inside])


@dataclass
class Block:
    ids: np.ndarray
    starts: np.ndarray
    matrix: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Block:
        starts = np.frombuffer(row["starts"], dtype=np.int64)
        return cls(np.frombuffer(row["ids"], dtype=np.int64), starts, np.frombuffer(row["matrix"]).reshape(len(starts), -1))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(np.append(self.starts, len(self.ids)))

    @cached_property
    def norm(self) -> float:
        return float(np.linalg.norm(self.matrix, axis=1).max())

    @cached_property
    def single(self) -> np.ndarray:
        return self.matrix.astype(np.float32)


def pair_scores(queries: np.ndarray, rows: np.ndarray, matrix: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The scores of pairs of a row of ``queries`` and one of ``matrix``; a pair has the same number in
    whatever company it is scored."""
    step = max(1, SCORE_BLOCK_ELEMENTS // max(queries.shape[1], 1))
    parts = [np.einsum("ij,ij->i", queries[rows[i : i + step]], matrix[columns[i : i + step]]) for i in range(0, len(rows), step)]
    return np.concatenate(parts) if parts else np.zeros(0)


def narrowed(queries: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries and candidates as they are multiplied first, and for each query how far such a score can be from
    the true one: (dim + 2) roundings of the product of the norms, for any order of the sum.  Single
    precision, or double where norms are out of its range."""
    size = np.linalg.norm(queries, axis=1)
    largest = size.max(initial=0.0) * block.norm
    narrow = largest == 0 or (NARROW_LEAST < largest < NARROW_MOST and size.max(initial=0.0) < NARROW_MOST and block.norm < NARROW_MOST)
    unit, least = (2.0**-24, 1e-37) if narrow else (2.0**-53, 0.0)
    error = 1.02 * (queries.shape[1] + 3) * (unit * size * block.norm + least)
    error[~np.isfinite(error)] = 0.0
    return (queries.astype(np.float32), block.single, error) if narrow else (queries, block.matrix, error)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}


def best_rows(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, rank) of each row's ``k`` best columns by (rounded score desc, column asc);
    minus infinity is never taken."""
    n_rows, n_columns = scores.shape
    k = min(k, n_columns)
    if k <= 0 or not n_rows:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    keys = np.round(scores, RANK_DIGITS)
    cut = np.partition(keys, n_columns - k, axis=1)[:, n_columns - k][:, None]
    above, equal = keys > cut, keys == cut
    room = k - above.sum(axis=1)
    crowded = np.flatnonzero(equal.sum(axis=1) > room)
    if len(crowded):  # of the candidates that tie at the cut the smallest columns are taken
        tied = equal[crowded]
        equal[crowded] = tied & (np.cumsum(tied, axis=1, dtype=np.int32) <= room[crowded][:, None])
    rows, columns = np.nonzero((above | equal) & np.isfinite(keys))
    order = np.lexsort((columns, -keys[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    first = np.searchsorted(rows, np.arange(n_rows))
    return rows, columns, np.arange(len(rows)) - first[rows] + 1


def _best_of_repeated(chunk: Chunk, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, score) of each query's best ids where vectors have lists of ids: the best vectors are expanded
    until there are enough unseen ids, and no vector gives more ids than a query can need."""
    scores = chunk.queries @ block.matrix.T
    keys = np.round(scores, RANK_DIGITS)
    order = np.argsort(-keys, axis=1, kind="stable")
    counts = block.counts
    need = chunk.limits + np.diff(chunk.seen_at)
    enough = np.cumsum(np.minimum(counts[order], need[:, None]), axis=1)
    out = []
    for row in range(len(chunk.keys)):
        k = int(chunk.limits[row])
        if k <= 0:
            continue
        key = keys[row]
        last = min(int(np.searchsorted(enough[row], need[row])), len(counts) - 1)
        vectors = np.flatnonzero(key >= key[order[row, last]])
        n = np.minimum(counts[vectors], need[row])
        at = np.arange(n.sum()) + np.repeat(block.starts[vectors] - (np.cumsum(n) - n), n)
        ids, own = block.ids[at], np.repeat(vectors, n)
        seen = chunk.seen[chunk.seen_at[row] : chunk.seen_at[row + 1]]
        if len(seen):
            free = ~np.isin(ids, seen)
            ids, own = ids[free], own[free]
        best = np.lexsort((ids, -key[own]))[:k]
        out.append((np.full(len(best), row), ids[best], scores[row, own[best]]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _evaluate(cosine: bool):
    """Pairs of a chunk and a block to the best ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            chunk, block = Chunk.of(row), Block.of(row)
            lists = _Lists(chunk, np.full(len(chunk.keys), -np.inf))
            _score_into(lists, np.flatnonzero(_able(chunk, cosine)), block)
            lists.settle()
            n = len(lists.rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(chunk.keys[lists.rows]), pa.array(lists.ids), pa.array(lists.scores), pa.array(chunk.limits[lists.rows]), pa.array(np.full(n, row["chunk"])), pa.array(np.full(n, row["block"]))],
                names=["_l", "_r", "_s", "_k", "chunk", "block"],
            )

    return run


def _able(chunk: Chunk, cosine: bool) -> np.ndarray:
    """Queries that have a list: with a limit and, for cosines, a direction."""
    able = chunk.limits > 0
    return able & (np.abs(chunk.queries).max(axis=1, initial=0.0) > 0) if cosine else able


class _Summaries:
    """The summaries of a slice of blocks."""

    def __init__(self, summaries: list[dict]):
        self.blocks = np.array([s["block"] for s in summaries])
        self.centres = np.stack([np.frombuffer(s["centre"]) for s in summaries])
        self.radius = np.array([s["radius"] for s in summaries])
        self.norm = np.array([s["norm"] for s in summaries])

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        size = np.linalg.norm(queries, axis=1)[:, None]
        return np.minimum(queries @ self.centres.T + size * self.radius, size * self.norm) * (1 + 1e-12) + SLACK


def _first_routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk the blocks that most of its queries would try first."""
    for row in rows_of(batches):
        chunk, known = Chunk.of(row), _Summaries(row["summaries"])
        first = np.argmax(chunk.queries @ known.centres.T, axis=1)
        votes = np.bincount(first, minlength=len(known.blocks))
        best = np.argsort(-votes, kind="stable")[:PROBES]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), row["chunk"])), pa.array(known.blocks[best])], names=["chunk", "block"])


def _least(chunk: Chunk, reached: list[dict] | None) -> np.ndarray:
    """The rounded score that each query's other candidates have to reach."""
    least = {r["_l"]: r["least"] for r in reached or [] if r["least"] is not None}
    return np.array([least.get(k, -np.inf) for k in chunk.keys.tolist()])


def _other_routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks that a query of the chunk has to see, and the number of these queries."""
    for row in rows_of(batches):
        chunk, known = Chunk.of(row), _Summaries(row["summaries"])
        able = (known.bounds(chunk.queries) >= _least(chunk, row["reached"])[:, None]) & (chunk.limits > 0)[:, None]
        able[:, np.isin(known.blocks, row["tried"] or [])] = False
        out = [(int(known.blocks[b]), int(able[:, b].sum())) for b in np.flatnonzero(able.any(axis=0))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([row["chunk"]] * len(out), pa.int64()), pa.array([b for b, _ in out], pa.int64()), pa.array([n for _, n in out], pa.int64())],
            names=["chunk", "block", "n_picked"],
        )


class _Lists:
    """The best candidates of a chunk's queries so far, and the score that others have to reach; candidates
    are taken into the lists some at a time."""

    def __init__(self, chunk: Chunk, least: np.ndarray):
        self.chunk, self.least = chunk, least.copy()
        self.rows, self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_waiting = 0
        owner = np.repeat(np.arange(len(chunk.keys)), np.diff(chunk.seen_at))
        self.seen_ids, place = np.unique(chunk.seen, return_inverse=True)
        self.seen_pairs = np.sort(owner * len(self.seen_ids) + place)

    def unseen(self, rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which pairs of a query and an id are not among the query's seen ids."""
        if not len(self.seen_ids):
            return np.ones(len(rows), dtype=bool)
        place = np.minimum(np.searchsorted(self.seen_ids, ids), len(self.seen_ids) - 1)
        pair = rows * len(self.seen_ids) + place
        at = np.minimum(np.searchsorted(self.seen_pairs, pair), len(self.seen_pairs) - 1)
        return (self.seen_ids[place] != ids) | (self.seen_pairs[at] != pair)

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        able = np.round(scores, RANK_DIGITS) >= self.least[rows]
        if not able.any():
            return
        self.waiting.append((rows[able], ids[able], scores[able]))
        self.n_waiting += int(able.sum())
        if self.n_waiting >= 4 * len(self.chunk.keys) or not np.isfinite(self.least[rows]).all():
            self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        rows, ids, scores = (np.concatenate(x) for x in zip((self.rows, self.ids, self.scores), *self.waiting, strict=True))
        self.waiting, self.n_waiting = [], 0
        keys = np.round(scores, RANK_DIGITS)
        order = np.lexsort((ids, -keys, rows))
        rows, keys = rows[order], keys[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows) + 1
        limits = self.chunk.limits[rows]
        last, kept = rank == limits, rank <= limits
        self.least[rows[last]] = np.maximum(self.least[rows[last]], keys[last])
        self.rows, self.ids, self.scores = rows[kept], ids[order][kept], scores[order][kept]


def _kth_at_least(scores: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """A number that each row's ``limits``-th best score reaches: that of the maxima of groups of candidates,
    minus infinity where there are too few."""
    n = scores.shape[1]
    groups = min(n, max(LEAST_GROUPS, 4 * int(limits.max(initial=0))))
    # neighbours of one group would share the best places: a group takes every so manieth candidate
    maxima = scores[:, : n // groups * groups].reshape(len(scores), n // groups, groups).max(axis=1)
    maxima = -np.sort(-maxima, axis=1)
    kth = maxima[np.arange(len(scores)), np.minimum(limits, groups) - 1]
    return np.where(limits <= groups, kth, -np.inf)


def _score_into(lists: _Lists, rows: np.ndarray, block: Block) -> None:
    """Candidates of a block for the queries ``rows`` of a chunk: those that reach the score needed."""
    repeated = len(block.ids) != len(block.matrix)
    chunk = lists.chunk
    step = max(1, NARROW_ELEMENTS // max(len(block.matrix), 1))
    for first in range(0, len(rows), step):
        mine = rows[first : first + step]
        queries, matrix, error = narrowed(chunk.queries[mine], block)
        scores = queries @ matrix.T
        if scores.dtype != np.float32:  # norms out of range
            scores[~np.isfinite(scores)] = -np.inf
        needed = lists.least[mine] - SLACK - error
        open_ = np.flatnonzero(~np.isfinite(needed))
        if len(open_) and not repeated:  # a query without a full list yet
            part = chunk.pick(mine[open_])
            owner = np.repeat(open_, np.diff(part.seen_at))
            at = np.minimum(np.searchsorted(block.ids, part.seen), len(block.ids) - 1)
            known = block.ids[at] == part.seen
            scores[owner[known], at[known]] = -np.inf
            needed[open_] = _kth_at_least(scores[open_], part.limits).astype(float) - 2 * error[open_] - SLACK
        # what is added below may lie a rounding of the smaller type under the limit
        needed = np.nextafter(needed.astype(scores.dtype), scores.dtype.type(-np.inf))
        some = np.flatnonzero(scores.max(axis=1) >= needed)
        if not len(some):
            continue
        if repeated:  # lists of ids
            wide = max(1, SCORE_BLOCK_ELEMENTS // max(len(block.matrix), 1))
            for i in range(0, len(some), wide):
                picked = mine[some[i : i + wide]]
                r, ids, found = _best_of_repeated(chunk.pick(picked), block)
                lists.add(picked[r], ids, found)
            continue
        r, column = np.nonzero(scores[some] >= needed[some, None])
        r = mine[some[r]]
        new = lists.unseen(r, block.ids[column])
        r, column = r[new], column[new]
        lists.add(r, block.ids[column], pair_scores(chunk.queries, r, block.matrix, column))


def _search_tile(cosine: bool):
    def run(chunks: pa.Table, blocks: pa.Table) -> pa.Table:
        summaries = list(rows_of(blocks.to_batches()))
        known, parsed = _Summaries(summaries), [Block.of(row) for row in summaries]
        out = [pa.table([[]] * 4, schema=pa.schema(_TILE_FOUND))]
        for row in rows_of(chunks.to_batches()):
            chunk = Chunk.of(row)
            lists = _Lists(chunk, _least(chunk, row["reached"]))
            bounds, able = known.bounds(chunk.queries), _able(chunk, cosine)
            tried = np.isin(known.blocks, row["tried"] or [])
            for b in np.argsort(-bounds.mean(axis=0), kind="stable"):  # the likeliest first
                rows = np.flatnonzero(able & (bounds[:, b] >= lists.least))
                if len(rows) and not tried[b]:
                    _score_into(lists, rows, parsed[b])
            lists.settle()
            out.append(pa.table([chunk.keys[lists.rows], lists.ids, lists.scores, chunk.limits[lists.rows]], schema=pa.schema(_TILE_FOUND)))
        return pa.concat_tables(out)

    return run


def on_slices(chunks: DataFrame, index: DataFrame, n_blocks: int) -> DataFrame:
    """Each chunk beside every slice of block summaries."""
    slices = -(-n_blocks // SLICE_BLOCKS)
    summaries = index.select(F.pmod(F.xxhash64("block"), F.lit(slices)).cast("int").alias("slice"), F.struct("block", "centre", "radius", "norm").alias("s"))
    packed = summaries.groupBy("slice").agg(F.collect_list("s").alias("summaries"))
    return chunks.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).join(packed, "slice").drop("slice")


def paired(routes: DataFrame, chunks: DataFrame, index: DataFrame) -> DataFrame:
    return routes.join(chunks, "chunk").join(index.select("block", "ids", "starts", "matrix"), "block")


def tiled(
    chunks: DataFrame, more: DataFrame | None, index: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str, routes: DataFrame | None = None, tile_bytes: int | None = None
) -> DataFrame:
    """``work(chunks, blocks)``, the chunks with the columns of ``more`` (chunk, ...), on tiles of neighbouring chunks and neighbouring blocks, two Arrow tables
    that hold every pair of ``routes`` (chunk, block), by default every pair of all.

    The bytes sent are those of the chunks for each column of tiles and those of the index for each row
    of tiles, where pairs sent alone would take both for each pair."""
    size = {
        "chunk": F.length("keys") + F.length("queries") + F.length("seen"),
        "block": F.length("ids") + F.length("starts") + F.length("matrix"),
    }
    sizes = {key: table.select(key, size[key].cast("long").alias("_bytes")) for key, table in (("chunk", chunks), ("block", index))}
    total = {key: table.agg(F.sum("_bytes")).first()[0] or 0 for key, table in sizes.items()}
    wanted = TILES_PER_CORE * chunks.sparkSession.sparkContext.defaultParallelism
    most = tile_bytes or max(1, min(TILE_BYTES, int((total["chunk"] * total["block"] / wanted) ** 0.5)))

    def strip(key: str, out: str) -> DataFrame:
        # one row for each chunk or block
        before = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
        return sizes[key].select(key, F.floor(F.coalesce(F.sum("_bytes").over(before), F.lit(0)) / most).cast("int").alias(out))

    rows, columns = strip("chunk", "_row"), strip("block", "_column")
    across, down = (int(total[key] // most) + 1 for key in ("block", "chunk"))
    tile = (F.col("_row").cast("long") * across + F.col("_column")).alias("_tile")
    if routes is None:
        tiles = rows.select("_row").distinct().crossJoin(columns.select("_column").distinct())
        left, right = tiles.join(rows, "_row"), tiles.join(columns, "_column")
    else:
        routed = routes.join(rows, "chunk").join(columns, "block")
        left, right = routed.select("_row", "_column", "chunk").distinct(), routed.select("_row", "_column", "block").distinct()
    whole = chunks if more is None else chunks.join(more, "chunk", "left")
    left = left.select(tile, "chunk").join(whole, "chunk").withColumn("_side", F.lit(0))
    right = right.select(tile, "block").join(index, "block").withColumn("_side", F.lit(1))
    # a task for each tile: hashed, some tasks would take several tiles and others none
    tasks = min(across * down, TILE_TASKS)
    dealt = left.unionByName(right, allowMissingColumns=True).repartitionById(tasks, F.pmod(F.col("_tile"), F.lit(tasks)).cast("int"))
    return dealt.sortWithinPartitions("_tile", "_side").mapInArrow(_on_tiles(work), schema)


def _on_tiles(work: Callable[[pa.Table, pa.Table], pa.Table]):
    """Rows by tile and side to ``work`` on the chunks and blocks of each tile."""

    def done(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        n = int((table.column("_side").to_numpy() == 0).sum())
        if 0 < n < table.num_rows:
            yield from work(table.slice(0, n), table.slice(n)).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            tiles = batch.column("_tile").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(tiles)) + 1, [len(tiles)]])
            for first, last in zip(edges[:-1], edges[1:], strict=True):
                if first == last:
                    continue
                if held and held[0].column("_tile")[0].as_py() != tiles[first]:
                    yield from done(held)
                    held = []
                held.append(batch.slice(first, last - first))
        if held:
            yield from done(held)

    return run


def search(chunks: DataFrame, index: DataFrame, cosine: bool, report: dict | None = None) -> DataFrame:
    """Partial lists (_l, _r, _s, _k) that hold every query's best ids.  ``report`` takes
    the pairs of query and block in all and those that were scored."""
    evaluate = _evaluate(cosine)
    n_blocks = index.count()
    if not n_blocks:
        return index.sparkSession.createDataFrame([], _FOUND)
    if n_blocks <= PROBES:
        numbers = [r["block"] for r in index.select("block").collect()]
        found = chunks.withColumn("block", F.explode(F.array(*[F.lit(b) for b in numbers]))).join(index.select("block", "ids", "starts", "matrix"), "block")
        if report is not None:
            n = chunks.agg(F.sum(F.length("keys") / 8)).first()[0] or 0
            report.update(blocks=n_blocks, pairs=int(n) * n_blocks, scored=int(n) * n_blocks)
        return found.mapInArrow(evaluate, _FOUND)
    first = materialize(on_slices(chunks, index, n_blocks).mapInArrow(_first_routes, "chunk long, block long"), "routes")
    found = materialize(paired(first, chunks, index).mapInArrow(evaluate, _FOUND), "probed")
    kth = F.get(F.sort_array(F.collect_list(F.round("_s", RANK_DIGITS)), asc=False), F.first("_k") - 1)
    reached = found.groupBy("chunk", "_l").agg(kth.alias("least")).groupBy("chunk").agg(F.collect_list(F.struct("_l", "least")).alias("reached"))
    tried = first.groupBy("chunk").agg(F.collect_list("block").alias("tried"))
    known = materialize(tried.join(reached, "chunk", "left"), "reached")
    ready = chunks.join(known, "chunk", "left")
    others = materialize(on_slices(ready, index, n_blocks).mapInArrow(_other_routes, "chunk long, block long, n_picked long"), "routes")
    more = tiled(chunks, known, index, _search_tile(cosine), "_l long, _r long, _s double, _k int", others.select("chunk", "block"))
    if report is not None:
        sizes = chunks.select("chunk", (F.length("keys") / 8).cast("long").alias("n"))
        all_, probed = sizes.agg(F.sum("n")).first()[0] or 0, first.join(sizes, "chunk").agg(F.sum("n")).first()[0] or 0
        report.update(blocks=n_blocks, pairs=all_ * n_blocks, scored=probed + (others.agg(F.sum("n_picked")).first()[0] or 0))
    return found.select("_l", "_r", "_s", "_k").unionByName(more)


def top_scores(
    left: DataFrame,
    right: DataFrame,
    k: int | str,
    left_key: str,
    right_key: str,
    left_vec: str = "vec",
    right_vec: str = "vec",
    cosine: bool = True,
    seen: DataFrame | None = None,
    exclude_same_key: bool = False,
    block_vectors: int | None = None,
    out_key: str = "neighbor",
    out_score: str = "score",
    report: dict | None = None,
) -> DataFrame:
    """(left_key, out_key, out_score, rank): each left row's best ``k`` right rows by (score desc,
    right key asc), without those it has in ``seen`` (left_key, right_key).  ``k`` is a number or a
    column of ``left``.  Cosine: a zero candidate scores 0, a zero left row has no list.  A left row's
    seen keys are one list, no longer than the candidates."""
    keep = F.col(k) if isinstance(k, str) else F.lit(k)
    rows = left.select(F.col(left_key).cast("long").alias("_l"), F.col(left_vec).cast("array<double>").alias("_rv"), keep.cast("int").alias("_k"))
    none = F.array().cast("array<bigint>")
    if seen is not None:
        lists = seen.select(F.col(left_key).cast("long").alias("_l"), F.col(right_key).cast("long").alias("_r")).distinct().groupBy("_l").agg(
            F.collect_list("_r").alias("_seen")
        )
        rows = rows.join(lists, "_l", "left").withColumn("_seen", F.coalesce("_seen", none))
    else:
        rows = rows.withColumn("_seen", none)
    index = build_index(right, right_key, right_vec, cosine, block_vectors)
    chunks = pack_chunks(rows.select("_l", "_k", "_seen", "_rv"), cosine, exclude_same_key)
    found = search(chunks, index, cosine, report)
    merged = Window.partitionBy("_l").orderBy(F.round("_s", RANK_DIGITS).desc(), F.col("_r").asc())
    best = found.withColumn("rank", F.row_number().over(merged)).where(F.col("rank") <= F.col("_k"))
    done = materialize(
        best.select(F.col("_l").alias(left_key), F.col("_r").alias(out_key), F.col("_s").alias(out_score), F.col("rank").cast("int").alias("rank")), "scores"
    )
    release(index, chunks)
    return done


def blocked_topk(
    vectors: DataFrame,
    n: int,
    item_col: str = "item_idx",
    vec_col: str = "vec",
    block_vectors: int | None = None,
    exclude_self: bool = True,
    report: dict | None = None,
) -> DataFrame:
    """(item, neighbor, cosine, rank): top-n cosine neighbours of every item."""
    return top_scores(
        vectors, vectors, n, item_col, item_col, vec_col, vec_col, cosine=True, exclude_same_key=exclude_self, block_vectors=block_vectors,
        out_key="neighbor", out_score="cosine", report=report,
    )
