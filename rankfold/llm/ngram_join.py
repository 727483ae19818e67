"""N-gram Jaccard join: MinHash banding, then exact verification on full shingle sets.

1. Every text becomes its set of word shingles.  Rows with equal sets collapse to one node
   (a 128-bit fingerprint of the set), so copies never meet as pairs.
2. The signature is cut into bands (:func:`textops.band_count` for the target recall); rows are
   shuffled on (band, band hash) and each node of a bucket is linked to the bucket's smallest.
   The components of these links are the candidate groups: nodes that share a band share a group.
3. Each candidate group is cut into blocks of bounded size; every pair of blocks is one unit of
   work that leaves out the nodes without a common band across the two and counts exact
   intersections of the others' full shingle sets with matrix products.  It returns
   one row per node (number of linked rows) and a spanning forest of the links, not the pairs.
4. The components of the verified links are the classes.

Bands have so many rows that texts which only share a template (``NOISE`` of the similarity) hardly
ever share one (``NOISE_SHARE``), so a family of different texts under one template does not become a
group.  The number of unit tasks of a candidate group grows with the square of its *different* sets
over the square of the block size; the rows emitted grow linearly.  Pairs below the recall of the
banding that share no band and no candidate group are the only ones that can be missed.

Defined results: null and empty texts have no shingles, no links and their own doc_id as class;
a text shorter than a shingle is one shingle of all its words; rows with a null doc_id are kept
and have the smallest doc_id of their class (null if none, so class_id does not tell classes of
null or repeated doc_ids apart; ``component`` does); repeated rows are copies of each other and each is returned; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankfold.llm import textops as X
from rankfold.llm.graph import connected_components
from rankfold.session import materialize

SIMILARITY = 0.8
WIDTH = 5
RECALL = 0.9999
#: pairs of this part of the similarity share a band with at most this probability
NOISE, NOISE_SHARE = 0.35, 0.001
BLOCK_NODES = 128
BLOCK_SHINGLES = 1_000_000
#: columns of the dense product at a time
COLUMNS = 8192


def _signatures(width: int, bands: int, rows: int):
    factors = X.random_words(21, bands * rows) | X.U64(1)
    shifts = X.random_words(22, bands * rows)
    band_factors = X.random_words(23, rows) | X.U64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = X.text_bytes(batch.column("text"))
            for first, last in X.slices(offsets, X.PIECE):
                part = offsets[first : last + 1]
                words, word_offsets = X.word_hashes(data[part[0] : part[-1]], part - part[0])
                sets, at = X.distinct_in_documents(*X.shingles(words, word_offsets, width))
                counts = np.diff(at)
                signature = X.minhashes(sets, at, factors, shifts)
                keys = np.empty((last - first, bands), dtype=X.U64)
                for band in range(bands):
                    keys[:, band] = X.mix((signature[:, band * rows : (band + 1) * rows] * band_factors).sum(axis=1, dtype=X.U64) + X.U64(band))
                node = np.zeros((last - first, 2), dtype=X.U64)
                filled = np.flatnonzero(counts > 0)
                if len(filled):
                    node[filled, 0] = np.add.reduceat(X.mix(sets * factors[0]), at[filled])
                    node[filled, 1] = np.add.reduceat(X.mix(sets * factors[1]), at[filled])
                raw = node.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, last - first),
                        batch.column("text_key").slice(first, last - first),
                        pa.array([raw[16 * i : 16 * i + 16] if counts[i] else None for i in range(last - first)], pa.binary()),
                        pa.array(counts, pa.int64()),
                        X.list_of(keys.reshape(-1), np.arange(last - first + 1, dtype=np.int64) * bands),
                    ],
                    names=["doc_id", "text_key", "node", "n_shingles", "bands"],
                )

    return run


def _shingle_sets(width: int):
    """Texts of candidate nodes to their sorted shingle sets, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = X.text_bytes(batch.column("text"))
            rest = [name for name in batch.schema.names if name not in ("text", "bands")]
            lists = batch.column("bands")
            bands = lists.flatten().to_numpy().reshape(batch.num_rows, -1)
            for first, last in X.slices(offsets, X.PIECE):
                part = offsets[first : last + 1]
                words, word_offsets = X.word_hashes(data[part[0] : part[-1]], part - part[0])
                sets, at = X.distinct_in_documents(*X.shingles(words, word_offsets, width))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(name).slice(first, last - first) for name in rest), pa.array([b.tobytes() for b in bands[first:last]], pa.binary()),
                        pa.array([sets[at[i] : at[i + 1]].tobytes() for i in range(last - first)], pa.binary()),
                    ],
                    names=[*rest, "bands", "shingles"],
                )

    return run


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left with every right set (distinct sorted values)."""
    out = np.zeros((len(left), len(right)), dtype=np.float64)
    a, b = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(a, b)
    if not len(shared):
        return out

    def coordinates(sets: list[np.ndarray], values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(shared, values), len(shared) - 1)
        keep = shared[at] == values
        at, row = at[keep], row[keep]
        order = np.argsort(at, kind="stable")
        return at[order], row[order]

    ca, ra = coordinates(left, a)
    cb, rb = coordinates(right, b)
    for first in range(0, len(shared), COLUMNS):
        last = min(first + COLUMNS, len(shared))
        parts = []
        for columns, rows, n in ((ca, ra, len(left)), (cb, rb, len(right))):
            lo, hi = np.searchsorted(columns, [first, last])
            dense = np.zeros((n, last - first), dtype=np.float32)
            dense[rows[lo:hi], columns[lo:hi] - first] = 1
            parts.append(dense)
        out += parts[0] @ parts[1].T
    return out


def candidates(left: np.ndarray, right: np.ndarray, same: bool) -> np.ndarray:
    """Which rows of ``left`` share a band with which of ``right``; not with themselves."""
    near = np.zeros((len(left), len(right)), dtype=bool)
    for band in range(left.shape[1]):
        near |= left[:, band][:, None] == right[:, band][None, :]
    if same:
        np.fill_diagonal(near, False)
    return near


def _roots(linked: np.ndarray) -> np.ndarray:
    """Smallest index of the component of each node of a symmetric link matrix."""
    n = len(linked)
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], n).min(axis=1, initial=n))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verify(similarity: float):
    """Units of work arrive sorted by (group, first block, second block, side, node)."""

    def unit(nodes: list[bytes], sides: np.ndarray, copies: np.ndarray, bands: np.ndarray, sets: list[np.ndarray]):
        left = np.flatnonzero(sides == 0)
        right = np.flatnonzero(sides == 1)
        same = not len(right)
        right = left if same else right
        near = candidates(bands[left], bands[right], same)
        left, right = left[near.any(axis=1)], right[near.any(axis=0)]
        if not len(left):
            return
        sizes = np.array([len(s) for s in sets])
        shared = intersections([sets[i] for i in left], [sets[i] for i in right])
        linked = shared >= similarity * (sizes[left][:, None] + sizes[right][None, :] - shared) - 1e-9
        if same:  # sharing a band is mutual, so both sides are the same nodes
            np.fill_diagonal(linked, False)
        links = np.zeros(len(nodes), dtype=np.int64)
        links[left] = linked @ copies[right].astype(np.float64)
        every = np.zeros((len(nodes), len(nodes)), dtype=bool)
        every[np.ix_(left, right)] = linked
        if not same:
            links[right] = copies[left].astype(np.float64) @ linked
            every |= every.T
        for i in np.flatnonzero(links):
            yield nodes[i], None, int(links[i])
        roots = _roots(every)
        for i in np.flatnonzero(roots != np.arange(len(nodes))):
            yield nodes[i], nodes[roots[i]], 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sides, copies, bands, sets = None, [], [], [], [], []
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            rows, out[:] = list(out), []
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())],
                names=["node", "other", "links"],
            )

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("grp", "first", "second", "node", "side", "copies", "bands", "shingles")]
            for g, first, second, node, side, n, own, raw in zip(*columns, strict=True):
                if (g, first, second) == key and (node, side) == (nodes[-1], sides[-1]):
                    continue  # a repeated row of the input
                if (g, first, second) != key:
                    if nodes:
                        out.extend(unit(nodes, np.array(sides), np.array(copies), np.stack(bands), sets))
                    key, nodes, sides, copies, bands, sets = (g, first, second), [], [], [], [], []
                    if len(out) > 10_000:
                        yield flush()
                nodes.append(node)
                sides.append(side)
                copies.append(n)
                bands.append(np.frombuffer(own, dtype=np.int64))
                sets.append(np.frombuffer(raw, dtype=X.U64))
        if nodes:
            out.extend(unit(nodes, np.array(sides), np.array(copies), np.stack(bands), sets))
        yield flush()

    return run


def _row_key() -> Column:
    """128 bits of (doc_id, text): a join key that is never null, so no rows crowd on it, and that no two
    rows share (64 bits would be shared by a few among 10^10)."""
    doc_id, text = F.col("doc_id").cast("bigint"), F.col("text").cast("string")
    halves = [F.lpad(F.hex(F.xxhash64(F.lit(seed), doc_id.isNull(), doc_id, text.isNull(), text)), 16, "0") for seed in (1, 2)]
    return F.unhex(F.concat(*halves))


def ngram_join(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_copies, n_links, n_shingles, text_key, component), one row per row of ``docs``.

    class_id: smallest doc_id of the rows joined by chains of links.  n_copies: rows with the
    same shingle set, itself included.  n_links: other rows at ``similarity`` or more.
    component: fingerprint of the class (null without words).
    """
    bands, rows = X.band_count(similarity, recall, NOISE * similarity, NOISE_SHARE)
    texts = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), _row_key().alias("text_key"), F.col("text").cast("string").alias("text")
    )
    signatures = materialize(
        texts.mapInArrow(
            _signatures(width, bands, rows), "doc_id bigint, text_key binary, node binary, n_shingles bigint, bands array<bigint>"
        ),
        "signatures",
    )
    # one row of each different set; its bands are those of any of its rows
    nodes = materialize(
        signatures.where("node IS NOT NULL").groupBy("node").agg(
            F.min(F.struct("doc_id", "text_key")).alias("chosen"), F.min("doc_id").alias("least_id"),
            F.count(F.lit(1)).alias("copies"), F.max("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"),
        ),
        "nodes",
    )
    banded = nodes.select("node", F.explode("bands").alias("key"))
    hubs = materialize(
        banded.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "hubs"
    )
    stars = banded.join(hubs, "key").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    sized = materialize(connected_components(stars).join(nodes.drop("least_id"), "node"), "members")
    blocks = materialize(
        sized.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s")).select(
            "component",
            F.greatest(F.ceil(F.col("n") / BLOCK_NODES), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int").alias("n_blocks"),
        ),
        "blocks",
    )
    members = materialize(
        sized.join(blocks, "component").select(
            "node", "component", "copies", "n_blocks", "chosen.doc_id", "chosen.text_key", "bands",
            F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int").alias("block"),
        ),
        "blocked",
    )
    # a shuffle at every size: whether the members could be broadcast changes with the input
    grouped = texts.select("text_key", "text").join(members.hint("merge"), "text_key").select(
        "node", "component", "copies", "n_blocks", "block", "bands", "text"
    )
    sets = grouped.mapInArrow(
        _shingle_sets(width), "node binary, component binary, copies bigint, n_blocks int, block int, bands binary, shingles binary"
    )
    unit = ["grp", "first", "second"]
    units = (
        sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        .select(
            F.col("component").alias("grp"), F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"),
            F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"), "node", "copies", "bands", "shingles",
        )
        .repartition(*unit).sortWithinPartitions(*unit, "side", "node")
    )
    verified = materialize(units.mapInArrow(_verify(similarity), "node binary, other binary, links bigint"), "verified")
    classes = connected_components(
        verified.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b"))
    )
    links = verified.where("other IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    named = materialize(
        nodes.drop("bands").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node")), "named"
    )
    least = materialize(named.groupBy("component").agg(F.min("least_id").alias("class_id")), "classes")
    found = materialize(
        named.join(least, "component").join(links, "node", "left").select(
            "node", "component", "class_id", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
        ),
        "found",
    )
    return signatures.select("doc_id", "text_key", "node", "n_shingles").join(found, "node", "left").select(
        "doc_id",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("copies", F.lit(1)).alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        "n_shingles", "text_key", "component",
    )


def one_of_each_class(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs`` that stay when one row of each class stays: a row of its smallest
    doc_id (of several texts under that doc_id, the one of the smallest text hash).  Rows
    without words are classes of their own and stay.  Columns are kept as they are.
    """
    joined = ngram_join(docs, similarity, width, recall)
    best = (
        joined.where("n_shingles > 0").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("k"))
        .select(F.col("k.text_key").alias("_keep"))
    )
    key = X.free_name(docs.columns, "_keep")
    keyed = docs.withColumn(key, _row_key())
    empty = ~F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(X.WORD_PATTERN)
    # of repeated rows one stays; the join has partitioned them by the same key
    names = [F.col(f"`{c}`") for c in docs.columns]
    once = keyed.where(~empty).join(best.withColumnRenamed("_keep", key).hint("merge"), key).dropDuplicates([key]).select(*names)
    return once.unionByName(docs.where(empty))
