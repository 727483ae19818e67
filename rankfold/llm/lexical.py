"""Ranked lexical search over posting lists that are blocked by document similarity.

The documents are cut into segments of ``SEGMENT`` rows, in the order they are read, and every
segment is indexed by itself, so the list of a word that stands in every document is spread over
all segments.  A segment's row in the index holds its document vectors and, for each term, the
posting list in blocks: documents are projected into ``DIMENSIONS`` dimensions, every list takes
evenly spaced members as representatives, and each member joins the nearest one.  A block keeps the
coordinatewise maximum of its document vectors, rounded up to a multiple of a 255th of its largest
value, so its product with a query is never below the score of a member.

A search reads the index row by row.  For each query the lists are probed in the order of the most
that a term can add; it stops when all terms left together cannot reach the tenth score found so
far, and skips a block when the product with its summary cannot.  Equal bounds are followed, so
ties are exact.  Lists of up to ``SHORT`` documents have no summary: scoring them costs less.
Each task returns the best of its segments, and one window takes the best of all.

Only terms of the queries are indexed.  Queries are taken in blocks of at most ``BLOCK_TERMS`` terms
(or one item), each of which is broadcast and released before the next.

Terms are the runs of letters and digits and of all characters beyond ASCII, with A-Z lower-cased,
compared as strings.  Defined results: null and empty texts and items have no terms, are not counted
and never found; documents with null ids are ranked behind equal scores; repeated rows are
documents or items of their own; empty tables give an empty result; further columns are ignored.
Document ids and items must be whole numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankfold.llm import batches as B
from rankfold.llm import textops as X
from rankfold.operators.ordering import running_totals
from rankfold.session import materialize, release

SEGMENT = 8192
BLOCK = 256
SHORT = 32
DIMENSIONS = 16
BLOCK_TERMS = 200_000
K = 10

_TERM = np.zeros(256, dtype=bool)
_TERM[0x30:0x3A] = _TERM[0x41:0x5B] = _TERM[0x61:0x7B] = _TERM[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

_FORWARD = "doc_id bigint, n bigint, terms array<int>, counts array<int>"
_INDEX = "doc_ids array<bigint>, vectors binary, terms array<int>, most array<int>, lists array<binary>"
_FOUND = "query bigint, doc_id bigint, score bigint"


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets with documents beyond ``X.PIECE`` bytes cut between terms, and each piece's document."""
    cuts, owners = [0], []
    for i in range(len(offsets) - 1):
        at, end = int(offsets[i]), int(offsets[i + 1])
        while end - at > X.PIECE:
            cut = at + X.PIECE
            while cut < end and _TERM[data[cut]]:
                cut += 1
            cuts.append(cut)
            owners.append(i)
            at = cut
        cuts.append(end)
        owners.append(i)
    return np.array(cuts, dtype=np.int64), np.array(owners, dtype=np.int64)


def split_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms of documents back to back, and the offsets of the documents in them."""
    inside = _TERM[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = inside[inner]
    starts = np.flatnonzero(first)
    if not len(starts):
        return pa.array([], pa.large_binary()), np.zeros(len(offsets), dtype=np.int64)
    ends = np.cumsum(np.add.reduceat(inside, starts, dtype=np.int64))
    letters = np.ascontiguousarray(_LOWER[data[inside]])
    bounds = np.concatenate([[0], ends])
    terms = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(letters)])
    return terms, np.searchsorted(starts, offsets).astype(np.int64)


def _forward(vocabulary):
    """Per document: the number of its terms, and those of the vocabulary with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            data, offsets = X.text_bytes(batch.column("text"))
            cuts, owners = _pieces(data, offsets)
            n = np.zeros(batch.num_rows, dtype=np.int64)
            keys, counts = [], []
            for first, last in X.slices(cuts):
                part = cuts[first : last + 1]
                terms, at = split_terms(data[part[0] : part[-1]], part - part[0])
                doc = np.repeat(owners[first:last], np.diff(at))
                np.add.at(n, owners[first:last], np.diff(at))
                ids = pc.fill_null(pc.index_in(terms, value_set=known), -1).to_numpy(zero_copy_only=False)
                hit = ids >= 0
                key, count = np.unique(doc[hit] * len(known) + ids[hit], return_counts=True)
                keys.append(key)
                counts.append(count)
            key, where = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_inverse=True)
            total = np.bincount(where, np.concatenate([np.zeros(0), *counts]), minlength=len(key)).astype(np.int32)
            doc, ids = np.divmod(key, max(len(known), 1))
            at = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), _lists(ids.astype(np.int32), at), _lists(total, at)], names=["doc_id", "n", "terms", "counts"]
            )

    return run


def _lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, pa.int32()))


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... of every range, back to back."""
    before = np.cumsum(counts) - counts
    return np.arange(counts.sum()) + np.repeat(starts - before, counts)


@dataclass
class Statistics:
    """What scores need of the whole corpus."""

    n_documents: int
    n_terms: int
    weights: np.ndarray  # of each term of the vocabulary

    def impacts(self, n: np.ndarray, counts: np.ndarray, of: np.ndarray) -> np.ndarray:
        """The factor of each term of each document that its weight is multiplied by."""
        m = 25 + 75 * n * self.n_documents // self.n_terms
        tf = counts.astype(np.int64)
        return 10**9 * tf // (1000 * tf + 8 * np.repeat(m, of))


def _projections(vocabulary: int) -> np.ndarray:
    bits = X.random_words(41, max(vocabulary, 1))
    return ((bits[:, None] >> np.arange(DIMENSIONS, dtype=X.U64)) & X.U64(1)).astype(np.float32) * 2 - 1


def _blocks(members: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A posting list in the order of its blocks, and the sizes of these."""
    n = -(-len(members) // BLOCK)
    if n < 2:
        return members, np.array([len(members)])
    heads = members[(np.arange(n) * len(members)) // n]
    nearest = np.argmax(points[members] @ points[heads].T, axis=1)
    order = np.argsort(nearest, kind="stable")
    sizes = []
    for size in np.bincount(nearest, minlength=n).tolist():
        parts = -(-size // (2 * BLOCK))  # many copies of one document
        sizes += [size * (p + 1) // parts - size * p // parts for p in range(parts)]
    return members[order], np.array([s for s in sizes if s])


def _index(statistics):
    """Document vectors → one row for each segment."""

    def segment(projections: np.ndarray, ids: list, n: list, at: list, terms: list, counts: list) -> pa.RecordBatch:
        stats: Statistics = statistics.value
        of = np.concatenate(at)
        term, count = np.concatenate(terms), np.concatenate(counts)
        impact = stats.impacts(np.concatenate(n), count, of)
        start = np.concatenate([[0], np.cumsum(of)])
        weight = (impact * stats.weights[term]).astype(np.float32)
        points = np.add.reduceat(projections[term] * weight[:, None], start[:-1], axis=0)
        points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-9)
        by_term = np.argsort(term, kind="stable")
        doc = np.repeat(np.arange(len(of)), of)[by_term]
        names, first = np.unique(term[by_term], return_index=True)
        last = np.append(first[1:], len(term))
        most = np.maximum.reduceat(impact[by_term], first)
        largest = np.zeros(len(stats.weights), dtype=np.int64)
        lists = []
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            members, sizes = _blocks(doc[a:b], points)
            parts = [np.array([len(sizes), len(members)]), sizes, members]
            if b - a > SHORT:
                widths, steps, coordinates, values = [], [], [], []
                stop = 0
                for size in sizes.tolist():
                    block = members[stop : stop + size]
                    stop += size
                    inside = _ranges(start[block], of[block])
                    np.maximum.at(largest, term[inside], impact[inside])
                    there = np.flatnonzero(largest)
                    step = max(1, -(-int(largest.max(initial=0)) // 255))
                    widths.append(len(there))
                    steps.append(step)
                    coordinates.append(np.diff(there, prepend=0))
                    values.append(-(-largest[there] // step))
                    largest[there] = 0
                parts += [np.array(widths), np.array(steps), np.concatenate(coordinates), np.concatenate(values)]
            lists.append(B.pack(np.concatenate(parts)))
        vectors = B.pack(np.concatenate([[len(of)], of, term, impact]))
        return pa.RecordBatch.from_arrays(
            [pa.array([v], t) for v, t in (
                (pa.concat_arrays(ids).to_pylist(), pa.list_(pa.int64())), (vectors, pa.binary()), (names.tolist(), pa.list_(pa.int32())),
                (most.tolist(), pa.list_(pa.int32())), (lists, pa.list_(pa.binary())))],
            names=["doc_ids", "vectors", "terms", "most", "lists"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        projections = _projections(len(statistics.value.weights))
        held: list[list] = [[], [], [], [], []]
        rows = 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, SEGMENT - rows)
                batch = batch.slice(part.num_rows)
                rows += part.num_rows
                of = pc.list_value_length(part.column("terms")).to_numpy(zero_copy_only=False).astype(np.int64)
                for kept, new in zip(held, (part.column("doc_id"), part.column("n").to_numpy(), of, _flat(part.column("terms")), _flat(part.column("counts"))), strict=True):
                    kept.append(new)
                if rows == SEGMENT:
                    yield segment(projections, *held)
                    held, rows = [[], [], [], [], []], 0
        if rows:
            yield segment(projections, *held)

    return run


class _Segment:
    """A row of the index; lists are unpacked when they are first probed."""

    def __init__(self, row: dict):
        packed = B.unpack(row["vectors"])
        n = int(packed[0])
        self.of = packed[1 : n + 1]
        term, impact = np.split(packed[n + 1 :], 2)
        self.term, self.impact = term, impact
        self.start = np.cumsum(self.of) - self.of
        self.missing = np.array([i is None for i in row["doc_ids"]])
        self.ids = np.array([i or 0 for i in row["doc_ids"]], dtype=np.int64)
        self.place = {t: i for i, t in enumerate(row["terms"])}
        self.most, self.packed, self.open = row["most"], row["lists"], {}

    def list_of(self, place: int) -> tuple:
        found = self.open.get(place)
        if found is None:
            values = B.unpack(self.packed[place])
            blocks, members = int(values[0]), int(values[1])
            cut = np.cumsum([2, blocks, members])
            sizes, documents = values[cut[0] : cut[1]], values[cut[1] : cut[2]]
            summary = None
            if len(values) > cut[2]:
                widths, steps = values[cut[2] : cut[2] + blocks], values[cut[2] + blocks : cut[2] + 2 * blocks]
                gaps, maxima = np.split(values[cut[2] + 2 * blocks :], 2)
                at = np.cumsum(widths) - widths
                coordinates = np.cumsum(gaps)
                # gaps start anew in every block
                coordinates -= np.repeat(np.concatenate([[0], coordinates[at[1:] - 1]]), widths)
                summary = coordinates, maxima * np.repeat(steps, widths), at
            found = self.open[place] = sizes, documents, summary
        return found

    def scores(self, documents: np.ndarray, query: np.ndarray) -> np.ndarray:
        of = self.of[documents]
        inside = _ranges(self.start[documents], of)
        return np.add.reduceat(query[self.term[inside]] * self.impact[inside], np.cumsum(of) - of)


class _Best:
    """The ``k`` highest scores above 0 of one query; equal ones by id, null ids last."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.ids, self.missing = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def least(self) -> int:
        """What a document must reach."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        take = score >= self.least
        if not take.any():
            return
        score = np.concatenate([self.score, score[take]])
        ids, missing = np.concatenate([self.ids, ids[take]]), np.concatenate([self.missing, missing[take]])
        order = np.lexsort((ids, missing, -score))[: self.k]
        self.score, self.ids, self.missing = score[order], ids[order], missing[order]


def probe(segment: _Segment, terms: np.ndarray, weights: np.ndarray, query: np.ndarray, best: _Best) -> int:
    """Add a segment's best documents to ``best``; returns the number of documents scored.

    ``query`` holds the ``weights`` of the distinct ``terms`` at their places, 0 elsewhere.
    """
    lists = [(int(w) * segment.most[p], p) for t, w in zip(terms.tolist(), weights.tolist(), strict=True) if (p := segment.place.get(t)) is not None]
    lists.sort(reverse=True)
    left = sum(bound for bound, _ in lists)
    seen = np.zeros(len(segment.of), dtype=bool)
    scored = 0
    for bound, place in lists:
        if left < best.least:
            break
        left -= bound
        sizes, documents, summary = segment.list_of(place)
        if summary is None:
            blocks, bounds = [0], [best.least]
            sizes = np.array([len(documents)])
        else:
            coordinates, maxima, at = summary
            bounds = np.add.reduceat(query[coordinates] * maxima, at)
            blocks = np.argsort(-bounds, kind="stable").tolist()
        stops = np.cumsum(sizes)
        for b in blocks:
            if bounds[b] < best.least:
                break
            members = documents[stops[b] - sizes[b] : stops[b]]
            members = members[~seen[members]]
            if len(members):
                seen[members] = True
                scored += len(members)
                best.add(segment.scores(members, query), segment.ids[members], segment.missing[members])
    return scored


def _search(queries, n_terms: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {number: _Best(k) for number, _, _ in queries.value}
        dense = np.zeros(n_terms, dtype=np.int64)
        for row in B.rows_of(batches):
            segment = _Segment(row)
            for number, terms, weights in queries.value:
                dense[terms] = weights
                probe(segment, terms, weights, dense, found[number])
                dense[terms] = 0
        for number, best in found.items():
            if len(best.score):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(best.score), number)), pa.array(best.ids, mask=best.missing), pa.array(best.score)], names=["query", "doc_id", "score"]
                )

    return run


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = X.text_bytes(batch.column("text"))
        terms, at = split_terms(data, offsets)
        lists = pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), terms.cast(pa.large_string())).cast(pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), lists, pa.array(np.diff(at))], names=["item_id", "terms", "w"])


def build_index(docs: DataFrame, terms: pa.Array) -> tuple[DataFrame, Statistics]:
    """(index, statistics) of ``docs`` (doc_id, text) over the given different terms, a row for each
    segment.  The index is a written table; :func:`rankfold.session.release` deletes it."""
    sc = docs.sparkSession.sparkContext
    vocabulary = sc.broadcast(terms.cast(pa.large_binary()))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    forward = materialize(texts.mapInArrow(_forward(vocabulary), _FORWARD), "vectors")
    total = forward.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    # one row for each term of the block
    held = forward.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    df = np.zeros(len(terms), dtype=np.int64)
    df[[r["term"] for r in held]] = [r["count"] for r in held]
    weights = [math.floor(1000 * math.log((2 * total[0] + 2) / (2 * d + 1))) for d in df.tolist()]
    statistics = Statistics(total[0], total[1], np.array(weights, dtype=np.int64))
    shared = sc.broadcast(statistics)
    index = materialize(forward.where(F.size("terms") > 0).mapInArrow(_index(shared), _INDEX), "blocks", compression="uncompressed")
    release(forward)
    vocabulary.destroy()
    shared.destroy()
    return index, statistics


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every row of ``items``."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    texts = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    split = texts.mapInArrow(_item_terms, "item_id bigint, terms array<string>, w bigint").where("w > 0")
    split = split.withColumn("h", F.xxhash64("terms"))
    placed = running_totals(split, ["item_id", "h"], ["w"]).withColumn("block", F.floor((F.col("w_cum") - 1) / BLOCK_TERMS).cast("int"))
    placed = materialize(placed.withColumn("query", F.monotonically_increasing_id()), "items")
    found = []
    # one number for each block, then one bounded block at a time
    for (block,) in sorted(placed.select("block").distinct().collect()):
        rows = placed.where(F.col("block") == block).select("query", "terms").collect()
        names = pa.array(sorted({t for r in rows for t in r["terms"]}), pa.large_string())
        place = {t: i for i, t in enumerate(names.to_pylist())}
        index, statistics = build_index(docs, names)
        queries = []
        for r in rows:
            ids, times = np.unique([place[t] for t in r["terms"]], return_counts=True)
            queries.append((r["query"], ids, statistics.weights[ids] * times))
        shared = sc.broadcast(queries)
        found.append(materialize(index.mapInArrow(_search(shared, len(names), k), _FOUND), "found"))
        release(index)
        shared.destroy()
    if not found:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    every = found[0]
    for part in found[1:]:
        every = every.unionAll(part)
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(placed.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")
