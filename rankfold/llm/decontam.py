"""Benchmark decontamination: size-partitioned MinHash containment search with exact checks.

Test items are short and documents long, so whole-document MinHash would compare sets of very
different size.  Items are therefore partitioned by size into classes of doubling width, and for
each class every document is cut into overlapping windows of two blocks of that width: a passage
with the item lies inside one window whose size is within a small factor of the item's.  Block
minima of each hash function are computed once for the narrowest class and merged upwards.  A
window that shares a minimum with an item of its class is a candidate (the number of hash functions
is chosen for the target recall), and the document is then checked exactly: the share of the
item's distinct shingles that the whole document contains.

The index is a table of (key, item), a key for each minimum and class; it is never gathered.  What the
tasks that read the documents receive is a bit filter over the keys, of at most ``FILTER_BITS`` bits
whatever the size of the benchmark, built by one aggregate.  Documents are read once: those with a
window that passes the filter are written as suspects, with the keys that passed and their shingles.
Keys and index, then pairs, shingles and items meet in joins, and the pairs are checked in the tasks.
A filter that is too full only lets more keys pass; the join decides.

Defined results: null and empty texts and items have no shingles and never match; an item or a
text shorter than a shingle is one shingle of all its words; rows with null ids are searched like
any other; repeated documents and items, and items of equal ids, match one by one; empty tables give
an empty result; further columns of either table are ignored by :func:`leaks`, those of the documents
kept by :func:`decontaminate`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankfold.llm import textops as X
from rankfold.llm.batches import rows_of
from rankfold.session import materialize, release

CONTAINMENT = 0.8
WIDTH = 5
RECALL = 0.9999
#: a class of block width B takes items of up to B / SLACK shingles, which leaves room for
#: words inserted into a copied passage
SLACK = 1.25
#: bits of the filter at most (32 MB), and for each key
FILTER_BITS = 1 << 28
BITS_PER_KEY = 1 << 10
PROBES = 3

_SPREAD = X.random_words(33, PROBES) | X.U64(1)


def hash_count(containment: float, recall: float) -> int:
    """Hash functions with which the smallest item of a class is found in a window of two blocks."""
    smallest = 1 / (2 * SLACK)  # of an item, in blocks
    shared = containment * smallest
    jaccard = shared / (2 + smallest - shared)
    return int(np.ceil(np.log(1 - recall) / np.log(1 - jaccard)))


def _functions(containment: float, recall: float) -> tuple[np.ndarray, np.ndarray]:
    k = hash_count(containment, recall)
    return X.random_words(31, k) | X.U64(1), X.random_words(32, k)


def _keys(minima: np.ndarray, level: np.ndarray | int) -> np.ndarray:
    """One number for a minimum in a class of block width 2 ** level."""
    return X.mix(minima + (np.asarray(level, dtype=X.U64) + X.U64(1)) * X.U64(0x9E3779B97F4A7C15))


def _places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """The bits of each key in a filter of 2 ** bits."""
    return [(keys * factor) >> X.U64(64 - bits) for factor in _SPREAD]


_ITEM = "item bigint, item_id bigint, n bigint, level int, keys array<bigint>, shingles binary"


def _item_sets(containment: float, recall: float, width: int):
    factors, shifts = _functions(containment, recall)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = X.text_bytes(batch.column("text"))
            for first, last in X.slices(offsets, X.PIECE):
                part = offsets[first : last + 1]
                words, at = X.word_hashes(data[part[0] : part[-1]], part - part[0])
                sets, at = X.distinct_in_documents(*X.shingles(words, at, width))
                sizes = np.diff(at)
                level = np.maximum(np.ceil(np.log2(np.maximum(sizes, 1) * SLACK)), 0).astype(np.int64)
                keys = _keys(X.minhashes(sets, at, factors, shifts), level[:, None])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("item").slice(first, last - first), batch.column("item_id").slice(first, last - first), pa.array(sizes), pa.array(level, pa.int32()),
                        X.list_of(keys.reshape(-1), np.arange(last - first + 1) * len(factors)), pa.array([sets[at[i] : at[i + 1]].tobytes() for i in range(last - first)], pa.binary()),
                    ],
                    names=["item", "item_id", "n", "level", "keys", "shingles"],
                )

    return run


@dataclass(frozen=True)
class Filter:
    """Bits of the keys of an index, and the levels of its classes."""

    levels: tuple[int, ...]
    bits: int
    words: np.ndarray

    def passes(self, keys: np.ndarray) -> np.ndarray:
        ok = np.ones(len(keys), dtype=bool)
        for place in _places(keys, self.bits):
            at = np.flatnonzero(ok)
            ok[at] = (self.words[place[at] >> X.U64(6)] >> (place[at] & X.U64(63))) & X.U64(1) == 1
        return ok


def _bit_places(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy().view(X.U64)
            place = np.concatenate(_places(keys, bits))
            yield pa.RecordBatch.from_arrays(
                [pa.array((place >> X.U64(6)).astype(np.int64)), pa.array((X.U64(1) << (place & X.U64(63))).view(np.int64))], names=["word", "bit"]
            )

    return run


def build_filter(items: DataFrame, postings: DataFrame) -> Filter:
    """The filter of an index.  The driver receives its words that are not zero (32 MB at most)."""
    n = postings.count()
    bits = int(np.clip(np.ceil(np.log2(max(n, 1) * BITS_PER_KEY)), 16, np.log2(FILTER_BITS)))
    rows = postings.select("key").mapInArrow(_bit_places(bits), "word bigint, bit bigint").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(1 << (bits - 6), dtype=X.U64)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(X.U64)
    levels = tuple(sorted(r[0] for r in items.select("level").distinct().collect()))
    return Filter(levels, bits, words)


def passing_keys(values: np.ndarray, at: np.ndarray, factors: np.ndarray, shifts: np.ndarray, known: Filter) -> tuple[np.ndarray, np.ndarray]:
    """(document, key) of all windows' keys that pass; ``values`` are the shingles of each document."""
    lowest = known.levels[0]
    width = 1 << lowest
    n_blocks = -(-np.diff(at) // width)
    blocks_at = np.concatenate([[0], np.cumsum(n_blocks)])
    doc = np.repeat(np.arange(len(n_blocks)), n_blocks)
    starts = np.repeat(at[:-1], n_blocks) + (np.arange(len(doc)) - np.repeat(blocks_at[:-1], n_blocks)) * width
    minima = np.empty((len(doc), len(factors)), dtype=X.U64)
    for k, (a, b) in enumerate(zip(factors, shifts, strict=True)):
        minima[:, k] = np.minimum.reduceat(values * a + b, starts)
    docs, keys = [], []
    for level in range(lowest, known.levels[-1] + 1):
        if level > lowest:
            even = np.flatnonzero((np.arange(len(doc)) - np.repeat(blocks_at[:-1], n_blocks)) % 2 == 0)
            minima, doc = np.minimum.reduceat(minima, even, axis=0), doc[even]
            n_blocks = (n_blocks + 1) // 2
            blocks_at = np.concatenate([[0], np.cumsum(n_blocks)])
        if level not in known.levels:
            continue
        windows = minima.copy()
        joined = doc[1:] == doc[:-1]
        windows[:-1][joined] = np.minimum(minima[:-1][joined], minima[1:][joined])
        key = _keys(windows, level).reshape(-1)
        hit = np.flatnonzero(known.passes(key))
        docs.append(doc[hit // len(factors)])
        keys.append(key[hit])
    pairs = np.unique(np.stack([np.concatenate(docs).astype(X.U64), np.concatenate(keys)]), axis=1)
    return pairs[0].astype(np.int64), pairs[1]


_SUSPECT = "doc_id bigint, text_key binary, keys array<bigint>, shingles binary"


def _suspects(shared, containment: float, recall: float, width: int):
    factors, shifts = _functions(containment, recall)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Filter = shared.value
        for batch in batches:
            data, offsets = X.text_bytes(batch.column("text"))
            for first, last in X.slices(offsets, X.PIECE):
                part = offsets[first : last + 1]
                words, at = X.word_hashes(data[part[0] : part[-1]], part - part[0])
                values, at = X.shingles(words, at, width)
                if not len(values):
                    continue
                doc, keys = passing_keys(values, at, factors, shifts, known)
                found, begins = np.unique(doc, return_index=True)
                sets = [np.unique(values[at[d] : at[d + 1]]).tobytes() for d in found.tolist()]
                where = pa.array(first + found)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(where), batch.column("text_key").take(where), X.list_of(keys, np.append(begins, len(keys))), pa.array(sets, pa.binary())],
                    names=["doc_id", "text_key", "keys", "shingles"],
                )

    return run


def _check(containment: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, shared = [], []
            for i, row in enumerate(rows_of(iter([batch.select(["shingles", "wanted", "n"])]))):
                n = len(np.intersect1d(np.frombuffer(row["shingles"], dtype=X.U64), np.frombuffer(row["wanted"], dtype=X.U64), assume_unique=True))
                if n >= containment * row["n"] - 1e-9:
                    keep.append(i)
                    shared.append(n)
            found = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [found.column("doc_id"), found.column("text_key"), found.column("item_id"), found.column("n"), pa.array(shared, pa.int64())],
                names=["doc_id", "text_key", "item_id", "n_item", "n_shared"],
            )

    return run


def _text_key() -> Column:
    """128 bits of a text; null is a text of its own."""
    text = F.col("text").cast("string")
    return F.unhex(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), text.isNull(), text)), 16, "0") for seed in (1, 2)]))


def _found(docs: DataFrame, benchmark: DataFrame, containment: float, recall: float, width: int) -> DataFrame:
    """(doc_id, text_key, item_id, n_item, n_shared) of every document that holds an item, written."""
    sc = docs.sparkSession.sparkContext
    numbered = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = materialize(numbered.mapInArrow(_item_sets(containment, recall, width), _ITEM).where("n > 0"), "items")
    schema = "doc_id bigint, text_key binary, item_id bigint, n_item bigint, n_shared bigint"
    if items.isEmpty():
        return docs.sparkSession.createDataFrame([], schema)
    postings = items.select("item", F.explode(F.array_distinct("keys")).alias("key"))
    shared = sc.broadcast(build_filter(items, postings))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _text_key().alias("text_key"), F.col("text").cast("string").alias("text"))
    suspects = materialize(
        texts.mapInArrow(_suspects(shared, containment, recall, width), _SUSPECT).withColumn("row", F.monotonically_increasing_id()), "suspects"
    )
    shared.destroy()
    pairs = suspects.select("row", F.explode("keys").alias("key")).join(postings, "key").select("row", "item").distinct()
    wanted = items.select("item", "item_id", "n", F.col("shingles").alias("wanted"))
    both = pairs.join(wanted, "item").join(suspects.drop("keys"), "row").select("doc_id", "text_key", "item_id", "n", "shingles", "wanted")
    found = materialize(both.mapInArrow(_check(containment), schema), "leaks")
    release(suspects, items)
    return found


def leaks(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT, recall: float = RECALL, width: int = WIDTH) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of every document that holds an item."""
    found = _found(docs, benchmark, containment, recall, width)
    return found.drop("text_key").withColumn("containment", F.col("n_shared") / F.col("n_item"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT, recall: float = RECALL, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` that hold no item of the benchmark; texts are told apart by 128 bits."""
    gone = _found(docs, benchmark, containment, recall, width).select("text_key").distinct()
    key = X.free_name(docs.columns, "_text_key")
    left = docs.withColumn(key, _text_key()).join(gone.withColumnRenamed("text_key", key), key, "left_anti")
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
