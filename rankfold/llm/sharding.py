"""Sharding: a Feistel permutation with cycle walking over global row numbers.

Rows get consecutive numbers 0..n-1 in the order (doc_id, size, crc, text hash).  A keyed Feistel
network permutes the smallest power of two that is at least n; images outside 0..n-1 are walked
on until they fall inside, which is again a permutation of 0..n-1.  Position p of the shuffled
order is shard ``p % shards`` and slot ``p // shards``: shard sizes differ by at most one, slots
have no gaps, and both can be computed from (row number, n, seed) alone, in Spark
(:func:`permuted`) or on one machine (:func:`position_of`, :func:`row_at`).

Defined results: null and empty texts have size 1 and crc32 0; a null doc_id sorts first; repeated
rows get different numbers (which of them gets which cannot be told apart); an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankfold.operators.ordering import positions
from rankfold.session import materialize

ROUNDS = 6
SEED = 20240229
WALK = 32
LOW31 = (1 << 31) - 1


def _constants(seed: int) -> list[tuple[int, int, int]]:
    """(factor, shift, factor) of each round, all below 2**31 so that products fit 63 bits."""
    out = []
    for r in range(ROUNDS):
        raw = hashlib.sha256(f"{seed}:{r}".encode()).digest()
        a, b, c = (int.from_bytes(raw[4 * i : 4 * i + 4], "big") & LOW31 for i in range(3))
        out.append((a | 1, b, c | 1))
    return out


def widths(n: int) -> tuple[int, int]:
    """Bits of the left and right half for ``n`` rows."""
    bits = max(2, (max(n, 1) - 1).bit_length())
    return (bits + 1) // 2, bits // 2


def _scramble(x: int, a: int, b: int, c: int) -> int:
    v = x * a + b
    v = ((v ^ (v >> 15)) & LOW31) * c
    return v >> 16


def _network(p: int, n: int, seed: int, backwards: bool = False) -> int:
    left_bits, right_bits = widths(n)
    left, right = p >> right_bits, p & ((1 << right_bits) - 1)
    rounds = list(enumerate(_constants(seed)))
    for r, (a, b, c) in reversed(rounds) if backwards else rounds:
        if r % 2 == 0:
            left ^= _scramble(right, a, b, c) & ((1 << left_bits) - 1)
        else:
            right ^= _scramble(left, a, b, c) & ((1 << right_bits) - 1)
    return (left << right_bits) | right


def position_of(row: int, n: int, seed: int = SEED) -> int:
    """Shuffled position of a row number."""
    p = _network(row, n, seed)
    while p >= n:
        p = _network(p, n, seed)
    return p


def row_at(position: int, n: int, seed: int = SEED) -> int:
    """Row number at a shuffled position (the inverse of :func:`position_of`)."""
    row = _network(position, n, seed, backwards=True)
    while row >= n:
        row = _network(row, n, seed, backwards=True)
    return row


def _encrypt(p: Column, n: int, seed: int) -> Column:
    left_bits, right_bits = widths(n)
    rounds = F.array(*[F.struct(F.lit(r).alias("r"), *[F.lit(v).cast("bigint").alias(k) for k, v in zip("abc", abc, strict=True)]) for r, abc in enumerate(_constants(seed))])
    start = F.struct(F.shiftright(p, right_bits).alias("l"), p.bitwiseAND(F.lit((1 << right_bits) - 1).cast("bigint")).alias("h"))

    def scramble(x: Column, k: Column) -> Column:
        # x < 2**31, so that x * a + b and the second product stay below 2**63
        v = F.transform(F.array(x * k["a"] + k["b"]), lambda y: y.bitwiseXOR(F.shiftright(y, 15)).bitwiseAND(F.lit(LOW31).cast("bigint")) * k["c"])
        return F.shiftright(F.get(v, F.lit(0)), 16)

    def one(state: Column, k: Column) -> Column:
        even = k["r"] % 2 == 0
        left = state["l"].bitwiseXOR(scramble(state["h"], k).bitwiseAND(F.lit((1 << left_bits) - 1).cast("bigint")))
        right = state["h"].bitwiseXOR(scramble(state["l"], k).bitwiseAND(F.lit((1 << right_bits) - 1).cast("bigint")))
        return F.struct(F.when(even, left).otherwise(state["l"]).alias("l"), F.when(even, state["h"]).otherwise(right).alias("h"))

    return F.aggregate(rounds, start, one, lambda s: F.shiftleft(s["l"], right_bits).bitwiseOR(s["h"]))


def _walk(p: Column, n: int, seed: int, steps: int) -> Column:
    """Up to ``steps`` more steps for images outside 0..n-1."""
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)), p, lambda at, _: F.when(at < n, at).otherwise(_encrypt(at, n, seed))
    )


def permuted(rows: DataFrame, row: str, n: int, out: str, seed: int = SEED) -> DataFrame:
    """Append the shuffled position of ``row`` (0..n-1).  Half of the images at most lie outside, so
    ``WALK`` steps nearly always do; they are doubled until no image is left outside."""
    number = F.col(row).cast("bigint")
    if n <= 1:
        return rows.withColumn(out, number)
    steps = WALK
    while not rows.where(_walk(_encrypt(number, n, seed), n, seed, steps) >= n).isEmpty():
        steps *= 2
    return rows.withColumn(out, _walk(_encrypt(number, n, seed), n, seed, steps))


def assign_shards(docs: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """(doc_id, size, text_crc32, row, position, shard, slot), one row per row of ``docs``."""
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = materialize(
        docs.select(
            F.col("doc_id"), (F.octet_length(text).cast("bigint") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("_text_hash"),
        ).withColumn("_at", F.monotonically_increasing_id()),
        "sizes",
    )
    numbered = positions(narrow, ["doc_id", "size", "text_crc32", "_text_hash", "_at"], out="row").drop("_text_hash", "_at")
    n = narrow.count()
    return permuted(numbered, "row", n, "position", seed).select(
        "doc_id", "size", "text_crc32", "row", "position",
        (F.col("position") % shards).cast("int").alias("shard"),
        F.expr(f"position div {int(shards)}").alias("slot"),
    )
