"""Repeated passages: equal windows of ``LENGTH`` bytes, found by sampled digits and a window hash.

The radix passes over all suffixes are replaced (README: a digit for every position would by itself
exceed the disk budget).  What is left of them is their order, from the coarse to the fine, and that
each pass drops what is alone and only divides what is large:

1. The first digit of a window is its *anchor*: the smallest hash among its substrings of
   ``DIGIT`` bytes.  Equal windows have equal anchors, wherever they stand, and consecutive
   windows mostly share theirs, so only one value for about thirteen windows is shuffled.  Anchors
   that stand in one document only are dropped; the others go back to their batches.
2. Runs of windows with a surviving anchor are shuffled by it, each different run once for each
   batch and with its smallest document.  An anchor with more than ``HOT_RUNS`` runs (a line between ever
   different neighbours) is divided again: its windows go by a hash of their own ``LENGTH`` bytes.  In a
   bucket windows are ordered by that hash, and equal neighbours are compared byte by byte.  Each group
   of equal windows gets its smallest document; runs that have a smaller one elsewhere go back.

Documents travel as batches of a few MB (compressed, in a table bucketed by batch, so the later
passes join without moving texts; the buckets follow the bytes).  A passage that very many documents
share counts once for each batch in both shuffles.  A document is never divided between batches.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts in a document with a
smaller doc_id, judged on the input.

Defined results: null and empty texts have no bytes and nothing removed; rows with equal doc_id
do not remove each other's bytes (repeated rows lose the same); a null doc_id comes after all
others; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfold.llm import textops as X
from rankfold.llm.batches import groups_of, pack, range_slices, record, rows_of, unpack
from rankfold.session import delete_files, ensure_checkpoint_dir, materialize, release

LENGTH = 50
DIGIT = 25
BATCH_BYTES = 4 << 20
BATCH_DOCS = 60_000
#: text bytes for each bucket of the two exchanges; windows need several numbers each
BUCKET_BYTES = 8 << 20
RUN_BUCKET_BYTES = 2 << 20
PIECE = 1 << 18
#: text bytes for each task
TASK_BYTES = 64 << 20
#: runs from which the windows of an anchor are dealt one by one
HOT_RUNS = 4096
NULL_ID = np.iinfo(np.int64).max

_U48 = X.U64(16)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a task to batches: ids, lengths and the compressed texts back to back."""
    compress = zstandard.ZstdCompressor(level=1).compress
    ids: list[int] = []
    nulls: list[bool] = []
    lengths: list[int] = []
    texts: list[bytes] = []

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays(
            [
                pa.array([np.array(ids, dtype=np.int64).tobytes()], pa.binary()),
                pa.array([np.array(nulls, dtype=bool).tobytes()], pa.binary()),
                pa.array([np.array(lengths, dtype=np.int64).tobytes()], pa.binary()),
                pa.array([sum(lengths)], pa.int64()),
                pa.array([compress(b"".join(texts))], pa.binary()),
            ],
            names=["ids", "nulls", "lengths", "n_bytes", "data"],
        )
        for x in (ids, nulls, lengths, texts):
            x.clear()
        return out

    size = 0
    for batch in batches:
        data, offsets = X.text_bytes(batch.column("text"))
        for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
            n = int(offsets[i + 1] - offsets[i])
            if ids and (size + n > BATCH_BYTES or len(ids) >= BATCH_DOCS):
                yield flush()
                size = 0
            ids.append(NULL_ID if doc_id is None else doc_id)
            nulls.append(doc_id is None)
            lengths.append(n)
            texts.append(data[offsets[i] : offsets[i + 1]].tobytes())
            size += n
    if ids:
        yield flush()


def _sliding_minimum(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    span = 1
    while span * 2 <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    rest = width - span
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def anchor_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of consecutive windows of one document with one anchor: (anchor, start of the first
    window, number of windows, hash of the run's bytes, document)."""
    found: list[tuple[np.ndarray, ...]] = []
    total = len(data) - LENGTH + 1
    ends = offsets[1:] - LENGTH + 1  # the first start that is not a window of the document
    stops = np.unique(np.concatenate([offsets[:-1], ends]))
    for a in range(0, max(total, 0), PIECE):
        b = min(a + PIECE, total)
        sums, down = X.prefix_hash(data[a : b + LENGTH - 1])
        n = b - a + LENGTH - DIGIT
        h = X.mix((sums[DIGIT : DIGIT + n] - sums[:n]) * down[:n])
        low = _sliding_minimum(h, LENGTH - DIGIT + 1)
        first = np.empty(b - a, dtype=bool)
        first[0] = True
        np.not_equal(low[1:], low[:-1], out=first[1:])
        inside = stops[(stops > a) & (stops < b)]
        first[inside - a] = True
        starts = np.flatnonzero(first)
        counts = np.diff(np.append(starts, b - a))
        doc = np.searchsorted(offsets, starts + a, side="right") - 1
        keep = starts + a < ends[doc]
        starts, counts, doc = starts[keep], counts[keep], doc[keep]
        content = X.mix((sums[starts + counts + LENGTH - 1] - sums[starts]) * down[starts] + counts.astype(X.U64) * X.U64(0x9E3779B97F4A7C15))
        # minima crowd at the lower end; mixed again they spread evenly over the buckets
        found.append((X.mix(low[starts]), starts + a, counts, content, doc))
    if not found:
        none = np.zeros(0, np.int64)
        return none.view(X.U64), none, none, none.view(X.U64), none
    return tuple(np.concatenate([f[i] for f in found]) for i in range(5))


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(np.frombuffer(row["lengths"], dtype=np.int64))]).astype(np.int64)
    raw = zstandard.ZstdDecompressor().decompress(row["data"], max_output_size=max(int(offsets[-1]), 1)) if offsets[-1] else b""
    return ids, offsets, np.frombuffer(raw, dtype=np.uint8)


def _six_bytes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def _anchors(buckets: int):
    """The different anchors of each batch, those of one and those of several of its documents apart, with
    the number of different runs of each."""
    schema = {"bucket": pa.int32(), "batch": pa.int64(), "once": pa.binary(), "often": pa.binary(), "once_runs": pa.binary(), "often_runs": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            _, offsets, data = _unpack(row)
            anchor, _, _, content, doc = anchor_runs(data, offsets)
            if not len(anchor):
                continue
            anchor = anchor >> _U48
            order = np.lexsort((content, anchor))
            sorted_anchor, content = anchor[order], content[order]
            fresh = np.append(True, sorted_anchor[1:] != sorted_anchor[:-1])
            at = np.flatnonzero(fresh)
            runs = np.add.reduceat(fresh | np.append(True, content[1:] != content[:-1]), at, dtype=np.int64)
            first, last = (f.reduceat(doc[order], at) for f in (np.minimum, np.maximum))
            often, values = first < last, sorted_anchor[at]
            yield record(schema, [
                (
                    bucket, row["batch"], *[_six_bytes(values[i:j][of]) for of in (~often[i:j], often[i:j])], *[pack(runs[i:j][of]) for of in (~often[i:j], often[i:j])],
                )
                for bucket, i, j in range_slices(values, buckets, 48)
            ])

    return run


def _shared_anchors(hot_runs: int):
    """Per bucket: the anchors of each batch that stand in a second document anywhere, those with very
    many runs apart."""
    schema = {"batch": pa.int64(), "anchors": pa.binary(), "hot": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, "bucket"):
            once = [_from_six(r["once"]) for r in group]
            often = [_from_six(r["often"]) for r in group]
            every = np.sort(np.concatenate(once))
            shared = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], *often]))
            del every
            if not len(shared):
                continue
            hits, runs = [], np.zeros(len(shared), dtype=np.int64)
            for r, a, b in zip(group, once, often, strict=True):
                at = np.minimum(np.searchsorted(shared, a), len(shared) - 1)
                known = shared[at] == a
                at = np.concatenate([at[known], np.searchsorted(shared, b)])
                runs += np.bincount(at, weights=np.concatenate([unpack(r["once_runs"])[known], unpack(r["often_runs"])]), minlength=len(shared)).astype(np.int64)
                hits.append(at)
            hot = runs > hot_runs
            out = [(r["batch"], _six_bytes(shared[at[~hot[at]]]), _six_bytes(shared[at[hot[at]]])) for r, at in zip(group, hits, strict=True) if len(at)]
            if out:
                yield record(schema, out)

    return run


def _windows_apart(data: np.ndarray, start: np.ndarray, count: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs as runs of one window each, with a hash of its bytes: (hash, start, count, document)."""
    before = np.cumsum(count) - count
    starts = np.repeat(start - before, count) + np.arange(count.sum())
    order = np.argsort(starts, kind="stable")
    keys = np.empty(len(starts), dtype=X.U64)
    keys[order] = window_hashes(data, starts[order])
    return keys, starts, np.ones(len(starts), dtype=np.int64), np.repeat(doc, count)


def _surviving(row: dict, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray] | None:
    """Runs with a shared anchor, and the number of each run's content in the batch."""
    normal, hot = (np.sort(np.concatenate([_from_six(x) for x in row[c] or []] or [np.zeros(0, X.U64)])) for c in ("anchors", "hot"))
    if not len(normal) + len(hot):
        return None
    anchor, start, count, content, doc = anchor_runs(data, offsets)
    anchor = anchor >> _U48
    own, apart = (among[np.minimum(np.searchsorted(among, anchor), len(among) - 1)] == anchor if len(among) else np.zeros(len(anchor), dtype=bool) for among in (normal, hot))
    parts = [tuple(x[own] for x in (anchor, start, count, content, doc))]
    if apart.any():
        keys, starts, ones, docs = _windows_apart(data, start[apart], count[apart], doc[apart])
        parts.append((keys >> _U48, starts, ones, keys, docs))
    anchor, start, count, content, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
    if not len(anchor):
        return None
    # numbered in the order of (anchor, content), so that a bucket's runs are neighbours
    order = np.lexsort((content, anchor))
    new = np.append(True, (content[order][1:] != content[order][:-1]) | (anchor[order][1:] != anchor[order][:-1]))
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return {"anchor": anchor, "start": start, "count": count, "doc": doc, "number": number, "order": order, "first": np.flatnonzero(new)}


def _runs_out(buckets: int):
    schema = {"bucket": pa.int32(), "batch": pa.int64(), "first_number": pa.int64(), "counts": pa.binary(), "least": pa.binary(), "bytes": pa.binary(), "n_bytes": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=1).compress
        for row in rows_of(batches):
            ids, offsets, data = _unpack(row)
            s = _surviving(row, data, offsets)
            if s is None:
                continue
            least = np.minimum.reduceat(ids[s["doc"]][s["order"]], s["first"])
            chosen = s["order"][s["first"]]
            start, count = s["start"][chosen], s["count"][chosen]
            for bucket, i, j in range_slices(s["anchor"][chosen], buckets, 48):
                size = count[i:j] + LENGTH - 1
                at = np.repeat(start[i:j] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                content = data[at].tobytes()
                yield record(schema, [(
                    bucket, row["batch"], i, count[i:j].astype(np.int32).tobytes(), least[i:j].tobytes(), compress(content), len(content),
                )])

    return run


def _unaligned_words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position on, as numbers."""
    return np.ndarray(shape=(max(len(data) - 7, 0),), dtype="<u8", buffer=data, strides=(1,))


def window_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of the window at each of the ascending ``starts``."""
    keys = np.empty(len(starts), dtype=X.U64)
    first = 0
    while first < len(starts):  # stretches of at most PIECE bytes
        base = int(starts[first])
        last = int(np.searchsorted(starts, base + PIECE))
        part = starts[first:last]
        sums, down = X.prefix_hash(data[base : int(part[-1]) + LENGTH])
        at = part - base
        keys[first:last] = X.mix((sums[at + LENGTH] - sums[at]) * down[at])
        first = last
    return keys


def group_windows(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first of each group) of the windows at ``starts``, equal windows side by side."""
    keys = window_hashes(data, starts)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    same = keys[1:] == keys[:-1]
    words = _unaligned_words(data)
    depths = [*range(0, LENGTH - 7, 8), LENGTH - 8]
    pair = np.flatnonzero(same)
    left, right = starts[order[pair]], starts[order[pair + 1]]
    if any((words[left + d] != words[right + d]).any() for d in depths):  # a collision: order by the bytes
        order = np.lexsort([words[starts + d] for d in reversed(depths)])
        left, right = starts[order[:-1]], starts[order[1:]]
        same = np.logical_and.reduce([words[left + d] == words[right + d] for d in depths])
    return order, np.flatnonzero(np.append(True, ~same))


def _least_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per bucket: stretches of windows whose smallest document is below that of their batch."""
    schema = {"batch": pa.int64(), "number": pa.binary(), "at": pa.binary(), "n": pa.binary()}
    for group in groups_of(batches, "bucket"):
        raw = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(r["bytes"], max_output_size=r["n_bytes"]) for r in group), dtype=np.uint8)
        counts = np.concatenate([np.frombuffer(r["counts"], dtype=np.int32) for r in group]).astype(np.int64)
        least = np.concatenate([np.frombuffer(r["least"], dtype=np.int64) for r in group])
        sizes = counts + LENGTH - 1
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        firsts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        starts = np.repeat(begins - firsts, counts) + np.arange(counts.sum())
        order, groups = group_windows(raw, starts)
        del raw, starts
        own = np.repeat(least, counts)
        smallest = np.empty(len(own), dtype=np.int64)
        smallest[order] = np.repeat(np.minimum.reduceat(own[order], groups), np.diff(np.append(groups, len(own))))
        del order, groups
        below = smallest < own
        del smallest
        run_of = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        edge = np.append(True, (below[1:] != below[:-1]) | (run_of[1:] != run_of[:-1]))
        edges = np.flatnonzero(edge)
        n = np.diff(np.append(edges, len(own)))
        edges, n = edges[below[edges]], n[below[edges]]
        runs = run_of[edges]
        at = edges - firsts[runs]
        rows, base = [], 0
        for r in group:
            m = len(r["counts"]) // 4
            i, j = np.searchsorted(runs, [base, base + m])
            if i < j:
                number = runs[i:j] - base + r["first_number"]
                rows.append((r["batch"], number.astype(np.int32).tobytes(), at[i:j].astype(np.int32).tobytes(), n[i:j].astype(np.int32).tobytes()))
            base += m
        if rows:
            yield record(schema, rows)


def removed_spans(row: dict, ids: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of the maximal removed spans of a batch, in order."""
    s = _surviving(row, data, offsets)
    if s is None:
        none = np.zeros(0, np.int64)
        return none, none, none
    least = np.minimum.reduceat(ids[s["doc"]][s["order"]], s["first"])
    later = ids[s["doc"]] > least[s["number"]]
    start, end, doc = [s["start"][later]], [s["start"][later] + s["count"][later]], [s["doc"][later]]
    back = [np.concatenate([np.frombuffer(x, dtype=np.int32) for x in row[c] or []] or [np.zeros(0, np.int32)]).astype(np.int64) for c in ("number", "at", "n")]
    if len(back[0]):
        order = np.argsort(back[0], kind="stable")
        number, at, n = (x[order] for x in back)
        own = np.flatnonzero(~later)
        i, j = np.searchsorted(number, s["number"][own], side="left"), np.searchsorted(number, s["number"][own], side="right")
        run = np.repeat(own, j - i)
        k = np.repeat(i - np.concatenate([[0], np.cumsum(j - i)[:-1]]), j - i) + np.arange((j - i).sum())
        start.append(s["start"][run] + at[k])
        end.append(s["start"][run] + at[k] + n[k])
        doc.append(s["doc"][run])
    start, end, doc = np.concatenate(start), np.concatenate(end) + LENGTH - 1, np.concatenate(doc)
    if not len(start):
        return doc, start, end
    order = np.argsort(start, kind="stable")
    start, end, doc = start[order], end[order], doc[order]
    reach = np.maximum.accumulate(end)
    new = np.append(True, (start[1:] > reach[:-1]) | (doc[1:] != doc[:-1]))
    firsts = np.flatnonzero(new)
    return doc[firsts], start[firsts], reach[np.append(firsts[1:] - 1, len(reach) - 1)]


def _results(keep_text: bool):
    schema = {
        "doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(),
        "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "kept_sha256": pa.string(), "kept": pa.binary(),
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            ids, offsets, data = _unpack(row)
            nulls = np.frombuffer(row["nulls"], dtype=bool)
            doc, start, end = removed_spans(row, ids, data, offsets)
            raw = memoryview(data.tobytes())
            at = np.searchsorted(doc, np.arange(len(ids) + 1))
            out = []
            for d in range(len(ids)):
                base, stop = int(offsets[d]), int(offsets[d + 1])
                spans = [(int(a), int(b)) for a, b in zip(start[at[d] : at[d + 1]], end[at[d] : at[d + 1]], strict=True)]
                digest, parts, last = hashlib.sha256(), [], base
                for a, b in [*spans, (stop, stop)]:
                    digest.update(raw[last:a])
                    if keep_text:
                        parts.append(bytes(raw[last:a]))
                    last = b
                out.append((
                    None if nulls[d] else int(ids[d]), stop - base, sum(b - a for a, b in spans),
                    [{"start": a - base, "end": b - base} for a, b in spans], digest.hexdigest(), b"".join(parts) if keep_text else None,
                ))
            yield record(schema, out)

    return run


def remove_repeats(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept_sha256, kept): the maximal removed byte spans of each
    row of ``docs`` and, if asked for, the remaining bytes (null else)."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))
    packed = texts.mapInArrow(_pack, "ids binary, nulls binary, lengths binary, n_bytes bigint, data binary")
    # bucketed by batch: the two joins below read it in place
    table = f"rankfold_batches_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{table}"
    packed.withColumn("batch", F.monotonically_increasing_id()).write.format("parquet").option("path", path).bucketBy(
        partitions, "batch"
    ).saveAsTable(table)
    try:
        batches = spark.table(table)
        buckets = max(partitions, -(-total // BUCKET_BYTES))
        anchors = batches.mapInArrow(_anchors(buckets), "bucket int, batch bigint, once binary, often binary, once_runs binary, often_runs binary")
        shared = materialize(
            anchors.repartition(partitions, "bucket").sortWithinPartitions("bucket")
            .mapInArrow(_shared_anchors(HOT_RUNS), "batch bigint, anchors binary, hot binary")
            .repartition(partitions, "batch").groupBy("batch").agg(F.collect_list("anchors").alias("anchors"), F.collect_list("hot").alias("hot")),
            "anchors",
        )
        runs = batches.join(shared.hint("merge"), "batch").mapInArrow(
            _runs_out(max(partitions, -(-total // RUN_BUCKET_BYTES))),
            "bucket int, batch bigint, first_number bigint, counts binary, least binary, bytes binary, n_bytes bigint",
        )
        smaller = materialize(
            runs.repartition(partitions, "bucket").sortWithinPartitions("bucket")
            .mapInArrow(_least_documents, "batch bigint, number binary, at binary, n binary")
            .repartition(partitions, "batch").groupBy("batch").agg(*[F.collect_list(c).alias(c) for c in ("number", "at", "n")]),
            "smaller",
        )
        back = shared.join(smaller.hint("merge"), "batch", "left")
        found = materialize(
            batches.join(back.hint("merge"), "batch", "left").mapInArrow(
                _results(keep_text),
                "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<start: bigint, end: bigint>>, kept_sha256 string, kept binary",
            ),
            "repeats",
        )
        release(shared, smaller)
        return found
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        delete_files(spark, path)
