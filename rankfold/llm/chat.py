"""Chat formatting over a prefix tree of conversations.

Conversations that begin with the same turns share those turns: each different prefix is one node
of a tree, and every node's text is emitted once, in depth-first order.  A node carries its start
in that order, its first position id (the length of its ancestors) and the stretches of the order
that its ancestors cover, which together with its own earlier tokens are all it may attend to.

The tree is never gathered.  A node's key is a digest chained over the turns of its prefix, and a
conversation's path is the sequence of its keys; in the byte order of the paths every conversation
stands next to those it shares most with, so it adds exactly the nodes beyond the prefix that it
has in common with its predecessor.  Starts are a distributed running sum over (rank, depth).

Template: ``<|role|>\\n text \\n<|end|>\\n`` without the blanks; inside roles and texts a backslash
precedes every backslash and bar, so no text can form a mark, and it is undone by dropping it.

Lengths are in tokens of the given tokenizer file, or in code points without one.

Defined results: null roles and texts count as empty, and null conv_ids as one conversation; turns
are in the order (turn, role, text), nulls first; repeated rows are turns of their own; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankfold.operators.ordering import positions, running_totals
from rankfold.session import materialize

KEY = 16
LEARNED = "assistant"

_MARKED = re.compile(r"[\\|]")
_ESCAPED = re.compile(r"\\(.)", re.S)
_HEAD = re.compile(r"<\|((?:[^\\|]|\\.)*+)\|>\n", re.S)
_BODY = re.compile(r"(?:[^\\|]|\\.)*+", re.S)
_END = "\n<|end|>\n"


def escape(text: str) -> str:
    return _MARKED.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def segment(role: str, text: str) -> tuple[str, int, int]:
    """(formatted turn, start and end of the part that is learned)."""
    head = f"<|{escape(role)}|>\n"
    body = escape(text)
    end = len(head) + len(body)
    return head + body + _END, len(head) if role == LEARNED else end, end


def read_segment(formatted: str) -> tuple[str, str]:
    """(role, text) of a formatted turn."""
    head = _HEAD.match(formatted)
    body = formatted[head.end() : -len(_END)] if head else ""
    if head is None or not formatted.endswith(_END) or not _BODY.fullmatch(body):
        raise ValueError("not a formatted turn")
    return unescape(head[1]), unescape(body)


def _turns(tokenizer_path: str | None):
    """Rows arrive by conversation, in order; the path stands at a conversation's last turn."""
    kinds = {
        "conv_id": pa.int64(), "depth": pa.int32(), "node": pa.binary(), "segment": pa.string(), "loss_start": pa.int32(),
        "loss_end": pa.int32(), "length": pa.int64(), "tokens": pa.list_(pa.int32()), "path": pa.binary(),
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        if tokenizer_path:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(tokenizer_path)
            tokenizer.encode_special_tokens = True
            encode = lambda s: tokenizer.encode(s, add_special_tokens=False).ids
        out: list[list] = []
        last: list | None = None  # the latest row, until it is known whether its conversation goes on
        keys: list[bytes] = []
        started = False

        def flush() -> pa.RecordBatch:
            rows, out[:] = list(out), []
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())], names=list(kinds))

        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if last is not None:
                    if conv_id != last[0]:
                        last[-1] = b"".join(keys)
                        keys = []
                    out.append(last)
                started = True
                formatted, a, b = segment(role or "", text or "")
                digest = hashlib.blake2b(keys[-1] if keys else b"", digest_size=KEY)
                digest.update(formatted.encode())
                ids = encode(formatted) if encode else None
                last = [conv_id, len(keys), digest.digest(), formatted, a, b, len(ids) if encode else len(formatted), ids, None]
                keys.append(last[2])
            if len(out) > 1000:
                yield flush()
        if started:
            last[-1] = b"".join(keys)
            out.append(last)
        yield flush()

    return run


_TURNS = "conv_id bigint, depth int, node binary, segment string, loss_start int, loss_end int, length bigint, tokens array<int>, path binary"


def prefix_tree(turns: DataFrame, tokenizer_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, paths) of conversation rows (conv_id, turn, role, text).

    nodes: node, parent, depth, segment, loss_start, loss_end, length, tokens, start, position,
    attends (array of start, end).  paths: conv_id, path (the keys of its nodes back to back).
    """
    ordered = (
        turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
        .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    )
    formatted = materialize(ordered.mapInArrow(_turns(tokenizer_path), _TURNS), "turns")
    paths = formatted.where("path IS NOT NULL").select("conv_id", "path")
    texts = materialize(
        formatted.groupBy("node").agg(*[F.first(c).alias(c) for c in ("segment", "loss_start", "loss_end", "length", "tokens")]), "segments"
    )
    lengths = texts.select("node", "length")

    ranked = materialize(positions(paths.select("path").distinct(), ["path"], out="rank"), "paths")
    before = ranked.select((F.col("rank") + 1).alias("rank"), F.col("path").alias("before"))
    # keys are chained, so equality at a depth means equality up to it: the shared prefix is as long
    # as the number of equal keys
    both = F.expr(f"cast(least(length(path), coalesce(length(before), 0)) / {KEY} as int)")
    equal = F.expr(f"size(filter(sequence(0, both - 1), i -> substring(path, {KEY} * i + 1, {KEY}) = substring(before, {KEY} * i + 1, {KEY})))")
    adds = materialize(
        ranked.join(before, "rank", "left").withColumn("both", both)
        .select("rank", "path", F.when(F.col("both") > 0, equal).otherwise(F.lit(0)).alias("shared")),
        "adds",
    )

    def key(depth: str) -> Column:
        return F.expr(f"substring(path, {KEY} * {depth} + 1, {KEY})")

    nodes_of = F.expr(f"cast(length(path) / {KEY} as int)")
    new = (
        adds.where(F.col("shared") < nodes_of)
        .select("rank", "path", F.explode(F.sequence("shared", nodes_of - 1)).alias("depth"))
        .select("rank", "depth", key("depth").alias("node"), F.when(F.col("depth") > 0, key("(depth - 1)")).alias("parent"))
        .join(lengths, "node")
    )
    placed = materialize(
        running_totals(new, ["rank", "depth"], ["length"]).withColumn("start", (F.col("length_cum") - F.col("length")).cast("bigint")).drop("length_cum"),
        "placed",
    )
    # ancestors of a path's first new node: the shared part, as stretches of the order
    starts = placed.select("node", "start", "length")
    ancestors = (
        adds.where("shared > 0").select("rank", "path", F.explode(F.sequence(F.lit(0), F.col("shared") - 1)).alias("depth"))
        .select("rank", "depth", key("depth").alias("node"))
        .join(starts, "node").select("rank", "depth", "start", "length")
    )
    interval = "array<struct<start: bigint, end: bigint>>"
    shared = ancestors.groupBy("rank").agg(F.sort_array(F.collect_list(F.struct("depth", "start", "length"))).alias("a"), F.sum("length").alias("above")).select(
        "rank", "above",
        F.expr(f"""aggregate(a, cast(array() as {interval}), (acc, x) ->
            IF(size(acc) > 0 AND element_at(acc, -1).end = x.start,
               concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', x.start + x.length))),
               concat(acc, array(named_struct('start', x.start, 'end', x.start + x.length)))))""").alias("shared"),
    )
    shared = materialize(shared, "ancestors")
    empty = F.expr(f"cast(array() as {interval})")
    above = F.coalesce("shared", empty)
    merged = F.expr(f"""CASE WHEN start = run THEN coalesce(shared, cast(array() as {interval}))
        WHEN size(coalesce(shared, cast(array() as {interval}))) > 0 AND element_at(shared, -1).end = run
          THEN concat(slice(shared, 1, size(shared) - 1), array(named_struct('start', element_at(shared, -1).start, 'end', start)))
        ELSE concat(coalesce(shared, cast(array() as {interval})), array(named_struct('start', run, 'end', start))) END""")
    tree = (
        placed.withColumn("run", F.min("start").over(Window.partitionBy("rank"))).join(shared, "rank", "left").withColumn("shared", above)
        .select("node", "parent", "depth", "start", "length", (F.coalesce("above", F.lit(0)) + F.col("start") - F.col("run")).alias("position"), merged.alias("attends"))
    )
    nodes = materialize(tree.join(texts.drop("length"), "node"), "nodes")
    return nodes.select("node", "parent", "depth", "segment", "loss_start", "loss_end", "length", "tokens", "start", "position", "attends"), paths


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, depth, segment, loss_start, loss_end) by conversation, in order."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    out: list[tuple] = []
    state: list | None = None

    def flush() -> pa.RecordBatch:
        rows, out[:] = list(out), []
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    def done() -> None:
        out.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

    for batch in batches:
        for conv_id, formatted, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss_start", "loss_end")), strict=True):
            if state is None or conv_id != state[0]:
                if state is not None:
                    done()
                state = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = read_segment(formatted)
            learned = unescape(formatted[a:b])
            state[1] += 1
            state[2].update(f"{role}\n{text}\n".encode())
            state[3] += len(learned)
            state[4].update(learned.encode())
            state[5] += len(formatted)
        if len(out) > 1000:
            yield flush()
    if state is not None:
        done()
    yield flush()


def read_back(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Every conversation read from the tree: turns and learned text as digests, and its length."""
    steps = paths.select(
        "conv_id", F.posexplode(F.expr(f"transform(sequence(0, cast(length(path) / {KEY} as int) - 1), i -> substring(path, {KEY} * i + 1, {KEY}))")).alias("depth", "node")
    )
    return (
        steps.join(nodes.select("node", "segment", "loss_start", "loss_end"), "node")
        .select("conv_id", "depth", "segment", "loss_start", "loss_end")
        .repartition("conv_id").sortWithinPartitions("conv_id", "depth").drop("depth")
        .mapInArrow(_read_back, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
    )
