"""Vectorised word and shingle hashing over Arrow string columns.

Words are ``[^\\x20\\x09-\\x0D]+`` over the UTF-8 bytes of a text.  All functions take
whole texts; the work is done in pieces of about ``PIECE`` bytes, so memory besides the
result does not grow with the length of a document.  Hash arithmetic is modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SEPARATOR_PATTERN = r"[\x20\x09-\x0D]+"

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

U64 = np.uint64


def free_name(columns: list[str], name: str) -> str:
    """``name`` with as many underscores before it as no column has (names ignore case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def random_words(seed: int, n: int) -> np.ndarray:
    """``n`` fixed 64-bit numbers of ``seed``."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64, size=n, dtype=U64)


_BYTE_VALUE = random_words(11, 256)
_BASE = int(random_words(12, 1)[0]) | 1
_BASE_INVERSE = pow(_BASE, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U64(base), dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the base and of its inverse, grown on demand."""

    up = _powers(_BASE, 16)
    down = _powers(_BASE_INVERSE, 16)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, PIECE + PIECE // 8)
            cls.up, cls.down = _powers(_BASE, size), _powers(_BASE_INVERSE, size)
        return cls.up[:n], cls.down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit (in place)."""
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts back to back and the n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64, count=n + 1 + column.offset)[column.offset :]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = 4 * PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``size`` bytes together (a longer document alone)."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def prefix_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running polynomial sums ``S`` (n + 1 values) and inverse powers: bytes [s, e) hash to
    ``(S[e] - S[s]) * down[s]``, wherever they stand."""
    up, down = _Powers.of(len(data) + 1)
    sums = np.empty(len(data) + 1, dtype=U64)
    sums[0] = 0
    np.cumsum(_BYTE_VALUE[data] * up[: len(data)], out=sums[1:])
    return sums, down


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every document, and the n + 1 offsets of the documents in them."""
    if len(data) == 0:
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    separator = _SEPARATOR[data]
    before = np.empty(len(data), dtype=bool)
    before[0] = True
    before[1:] = separator[:-1]
    after = np.empty(len(data), dtype=bool)
    after[-1] = True
    after[:-1] = separator[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = True
    after[inner - 1] = True
    starts = np.flatnonzero(before & ~separator)
    ends = np.flatnonzero(after & ~separator) + 1
    del before, after, separator
    out = np.empty(len(starts), dtype=U64)
    first = 0
    while first < len(starts):
        base = int(starts[first])
        last = max(int(np.searchsorted(ends, base + PIECE, side="right")), first + 1)
        stop = int(ends[last - 1])
        sums, down = prefix_hash(data[base:stop])
        s, e = starts[first:last] - base, ends[first:last] - base
        out[first:last] = (sums[e] - sums[s]) * down[s]
        first = last
    return mix(out), np.searchsorted(starts, offsets).astype(np.int64)


_SHINGLE_FACTORS = random_words(13, 64) | U64(1)


def shingles(words: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word shingles of every document and their offsets.

    A document of 1 to ``width`` - 1 words has one shingle of all its words, an empty one none.
    """
    counts = np.diff(offsets)
    per_doc = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    out_offsets = np.concatenate([[0], np.cumsum(per_doc)]).astype(np.int64)
    total = int(out_offsets[-1])
    if not total:
        return np.zeros(0, U64), out_offsets
    starts = np.arange(total, dtype=np.int64) + np.repeat(offsets[:-1] - out_offsets[:-1], per_doc)
    padded = np.concatenate([words, np.zeros(width, U64)])
    short = (counts > 0) & (counts < width)
    out = np.zeros(total, dtype=U64)
    if short.any():
        left = np.repeat(np.where(short, counts, width), per_doc)
        for j in range(width):
            out += np.where(j < left, padded[starts + j], U64(j + 1)) * _SHINGLE_FACTORS[j]
    else:
        for j in range(width):
            out += padded[starts + j] * _SHINGLE_FACTORS[j]
    return mix(out), out_offsets


def distinct_in_documents(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each document in ascending order, and their offsets."""
    n = len(offsets) - 1
    if not len(values):
        return values, offsets
    doc = np.repeat(np.arange(n), np.diff(offsets))
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    counts = np.bincount(doc[keep], minlength=n)
    return values[keep], np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def minimum_by_document(values: np.ndarray, offsets: np.ndarray, empty: int) -> np.ndarray:
    """Smallest value of each document (``empty`` for none)."""
    out = np.full(len(offsets) - 1, U64(empty), dtype=U64)
    filled = np.flatnonzero(np.diff(offsets) > 0)
    if len(filled):
        out[filled] = np.minimum.reduceat(values, offsets[filled])
    return out


def minhashes(values: np.ndarray, offsets: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """MinHash signature: one row for each document, one column for each hash function."""
    out = np.empty((len(offsets) - 1, len(factors)), dtype=U64)
    for k, (a, b) in enumerate(zip(factors, shifts, strict=True)):
        out[:, k] = minimum_by_document(values * a + b, offsets, 2**64 - 1)
    return out


def band_count(similarity: float, recall: float, noise: float = 0.4, noise_share: float = 0.25) -> tuple[int, int]:
    """(bands, rows): the fewest hash functions that find a pair of ``similarity`` with
    probability ``recall`` and one of similarity ``noise`` with at most ``noise_share``."""
    best: tuple[int, int] | None = None
    for rows in range(1, 33):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))
        if 1 - (1 - noise**rows) ** bands <= noise_share and (best is None or bands * rows < best[0] * best[1]):
            best = bands, rows
    if best is None:
        raise ValueError("no banding meets both probabilities")
    return best


def list_of(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Arrow list<int64> column of the parts of ``values``."""
    return pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(values.view(np.int64))).cast(pa.list_(pa.int64()))
