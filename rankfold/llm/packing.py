"""Best-fit packing of tokenised documents into sequences, with swap-based local search.

A document's token ids end with ``end_id``; only documents longer than a sequence are cut, from the
back, into pieces of a whole sequence, so that the first piece takes what is left.  Whole pieces are
sequences of their own.  The others are dealt at random to groups of about ``GROUP`` pieces, a task
for each: best-fit decreasing lays them out, then local search works on the underfull bins.  The
emptiest bin gives away documents: it moves one, exchanges one for a shorter one, one for two shorter
ones together, or two for a shorter one, always the exchange that moves most tokens and increases the
sum of squared fills, until it is empty or no exchange is left.  The search ends when the number of
bins meets a lower bound (total size, or documents over half a sequence that cannot share one) or
when a pass over the bins exchanges nothing, at most ``PASSES`` passes.

In further rounds the underfull bins of all groups are dealt anew, whole, to groups, and the search
goes on between them, as long as a round empties bins (at most ``ROUNDS``).  Only the small rows of
pieces are shuffled; tokens are not, except by :func:`sequences`.

Exchanges are found through the roomiest bin that holds a document (or two documents) of a given
size: an array over sizes, so a group's memory is that of its pieces.

Texts are cut where the word pattern of byte-level tokenizers always splits, so each different word
of a worker is encoded once; other tokenizers encode whole texts.
Strings that look like special tokens are ordinary text.

Defined results: null and empty texts are one token, the end; null ids stay and repeated rows are
documents of their own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import array
import functools
import heapq
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankfold.llm import textops as X
from rankfold.session import materialize

LENGTH = 2048
END_ID = 0
GROUP = 1 << 16
ROUNDS = 4
PASSES = 8
#: words that a worker remembers
CACHE = 1 << 19

_PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def splits_words(tokenizer_json: str) -> bool:
    """Whether a tokenizer file splits texts by the usual word pattern of byte-level tokenizers."""
    rules = json.loads(tokenizer_json)
    words = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    return rules.get("normalizer") is None and words.items() <= (rules.get("pre_tokenizer") or {}).items() and all(t["special"] for t in rules["added_tokens"])


_SPACE, _VISIBLE, _ALNUM, _MARK = (np.zeros(256, dtype=bool) for _ in range(4))
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VISIBLE[0x21:0x7F] = True
_ALNUM[0x30:0x3A] = _ALNUM[0x41:0x5B] = _ALNUM[0x61:0x7B] = True
_MARK[0x21:0x7F] = True
_MARK[_ALNUM] = _MARK[0x27] = False  # an apostrophe can begin the end of a word


def _word_starts(data: np.ndarray) -> np.ndarray:
    """Places where the usual word pattern always splits: white space behind a visible character, a
    mark behind a letter or digit, and a letter or digit behind a single newline."""
    if len(data) < 3:
        return np.zeros(0, dtype=np.int64)
    last, own = data[1:-1], data[2:]
    lead = data[:-2]
    latin = (lead == 0xC3) & (last >= 0x80) & (last < 0xC0) & (last != 0x97) & (last != 0xB7)
    word = _ALNUM[last] | latin
    found = (_SPACE[own] & (word | _VISIBLE[last])) | (_MARK[own] & word) | ((last == 0x0A) & _VISIBLE[lead] & _ALNUM[own])
    return np.flatnonzero(found) + 2


class Encoder:
    """Token ids of many texts.  Texts are cut into words where the tokenizer always splits; each
    different word is encoded once and remembered, up to ``CACHE`` words."""

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.encode_special_tokens = True
        self.in_words = splits_words(self.tokenizer.to_str())
        self.known: dict[str, bytes] = {}

    def _encode(self, words: list[str]) -> list[bytes]:
        known = self.known
        if len(known) > CACHE:
            known.clear()
        fresh = [w for w in words if w not in known]
        for word, found in zip(fresh, self.tokenizer.encode_batch_fast(fresh, add_special_tokens=False), strict=True):
            known[word] = array.array("I", found.ids).tobytes()
        return [known[w] for w in words]

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts back to back, and the offsets of the texts in them."""
        if not len(data):
            return np.zeros(0, dtype="<u4"), np.zeros_like(offsets)
        starts_here = np.zeros(len(data), dtype=bool)
        starts_here[offsets[:-1][np.diff(offsets) > 0]] = True
        if self.in_words:
            starts_here[_word_starts(data)] = True
        starts = np.flatnonzero(starts_here)
        bounds = np.append(starts, len(data))
        words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
        encoded = words.dictionary_encode()
        ids = self._encode(encoded.dictionary.to_pylist())
        of = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), dtype=np.uint32).astype("<u4", copy=False)
        first = np.cumsum(of) - of
        at = encoded.indices.to_numpy()
        n = of[at]
        before = np.concatenate([[0], np.cumsum(n)])
        out = flat[np.arange(before[-1]) + np.repeat(first[at] - before[:-1], n)]
        return out, before[np.searchsorted(starts, offsets)]


@functools.lru_cache(maxsize=2)
def worker_encoder(tokenizer_path: str) -> Encoder:
    """One encoder for all tasks of a Python worker, so that they share its known words."""
    return Encoder(tokenizer_path)


def _parts(data: np.ndarray, offsets: np.ndarray, in_words: bool) -> tuple[np.ndarray, np.ndarray]:
    """Offsets with texts beyond ``X.PIECE`` bytes cut where the tokenizer splits, and each part's text."""
    sizes = np.diff(offsets)
    if not in_words or not len(sizes) or sizes.max() <= X.PIECE:
        return offsets, np.arange(len(sizes))
    cuts, owners = [0], []
    for i in range(len(sizes)):
        at, end = int(offsets[i]), int(offsets[i + 1])
        while end - at > X.PIECE:
            ahead, width = at + X.PIECE, X.PIECE
            found = _word_starts(data[ahead : ahead + width])
            while not len(found) and ahead + width < end:
                width *= 2
                found = _word_starts(data[ahead : ahead + width])
            if not len(found) or ahead + int(found[0]) >= end:
                break
            at = ahead + int(found[0])
            cuts.append(at)
            owners.append(i)
        cuts.append(end)
        owners.append(i)
    return np.array(cuts), np.array(owners)


def _cut(tokenizer_path: str, length: int, end_id: int, keep_ids: bool):
    names = [*(c.split()[0] for c in _PIECE.split(", ")), *(["ids"] if keep_ids else [])]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_encoder(tokenizer_path)
        for batch in batches:
            ids = batch.column("doc_id")
            data, offsets = X.text_bytes(batch.column("text"))
            for first, last in X.slices(offsets):
                own = offsets[first : last + 1]
                parts, owners = _parts(data[own[0] : own[-1]], own - own[0], encode.in_words)
                encoded: list[list[np.ndarray]] = [[] for _ in range(last - first)]
                for a, b in X.slices(parts):
                    part = parts[a : b + 1]
                    tokens, at = encode(data[own[0] + part[0] : own[0] + part[-1]], part - part[0])
                    for i, owner in enumerate(owners[a:b].tolist()):
                        encoded[owner].append(tokens[at[i] : at[i + 1]])
                out: list[list] = [[] for _ in names]
                for i, found in enumerate(encoded):
                    tokens = np.concatenate([*found, np.array([end_id], dtype="<u4")])
                    n = -(-len(tokens) // length)
                    stop = len(tokens) - (n - 1) * length
                    start = 0
                    for piece in range(n):
                        piece_ids = tokens[start:stop]
                        row = [ids[first + i].as_py(), piece, start, len(piece_ids), zlib.crc32(piece_ids.tobytes())]
                        for column, value in zip(out, [*row, piece_ids.astype(np.int64)], strict=False):
                            column.append(value)
                        start, stop = stop, stop + length
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=False)], names=names)

    return run


def pieces(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document's pieces."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_cut(tokenizer_path, length, end_id, keep_ids), _PIECE + (", ids array<bigint>" if keep_ids else ""))


def lower_bound(sizes: np.ndarray, length: int) -> int:
    """Sequences that any packing needs: for every threshold a, documents over half a sequence need
    one each, and those from a up only fit beside the ones that leave a free."""
    count = np.bincount(sizes, minlength=length + 1)
    many, total = np.cumsum(count[::-1])[::-1], np.cumsum((count * np.arange(length + 1))[::-1])[::-1]
    many, total = np.append(many, 0), np.append(total, 0)
    half = length // 2 + 1  # sizes of which two do not fit
    a = np.arange(length // 2 + 1)
    open_room = (many[half] - many[length - a + 1]) * length - (total[half] - total[length - a + 1])
    rest = total[a] - total[half] - open_room
    return int((many[half] + np.maximum(0, -(-rest // length))).max())


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Bins of item numbers: each item, the largest first, into the fullest bin that takes it."""
    bins: list[list[int]] = []
    with_room: list[list[int]] = [[] for _ in range(length + 1)]
    rooms = 0  # bit r: a bin with room r
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[item]
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
            bins[b].append(item)
        else:
            room, b = length, len(bins)
            bins.append([item])
        room -= size
        if room:
            with_room[room].append(b)
            rooms |= 1 << room
    return bins


class _Roomiest:
    """For every size, the bin with most room among those that hold it; entries are checked when
    they are read."""

    def __init__(self, length: int, current):
        self.heaps: list[list] = [[] for _ in range(length + 1)]
        self.room = np.zeros(length + 1, dtype=np.int64)
        self.current = current  # (size, bin) → the bin's room, or 0 if it does not hold the size

    def add(self, size: int, room: int, b: int) -> None:
        heapq.heappush(self.heaps[size], (-room, b))
        if room > self.room[size]:
            self.room[size] = room

    def bin_of(self, size: int) -> int | None:
        heap = self.heaps[size]
        while heap and self.current(size, heap[0][1]) != -heap[0][0]:
            heapq.heappop(heap)
        self.room[size] = -heap[0][0] if heap else 0
        return heap[0][1] if heap else None

    def smallest_for(self, amount: int) -> tuple[int, int] | None:
        """The least size that can be given back for ``amount``, and the bin that takes the difference."""
        while True:
            sizes = np.flatnonzero(self.room[1:amount] >= np.arange(amount - 1, 0, -1))
            if not len(sizes):
                return None
            size = int(sizes[0]) + 1
            b = self.bin_of(size)
            if self.room[size] >= amount - size:
                return size, b


class LocalSearch:
    """Exchanges between underfull bins of one group."""

    def __init__(self, sizes: list[int], bins: list[list[int]], length: int):
        self.sizes, self.bins, self.length = sizes, bins, length
        self.fill = [sum(sizes[i] for i in items) for items in bins]
        self.donor = -1
        self.single = _Roomiest(length, lambda size, b: self._room(b) if size in self._sizes_in(b) else 0)
        self.double = _Roomiest(length, lambda size, b: self._room(b) if size in self._pairs_in(b) else 0)
        self.by_room: list[set[int]] = [set() for _ in range(length + 1)]
        self.rooms = 0
        for b in range(len(bins)):
            self._enter(b)

    def _room(self, b: int) -> int:
        return 0 if b == self.donor else self.length - self.fill[b]

    def _sizes_in(self, b: int) -> dict[int, int]:
        return {self.sizes[i]: i for i in self.bins[b]}

    def _pairs_in(self, b: int) -> dict[int, tuple[int, int]]:
        """Sums of two documents, through the different sizes (few fit into one bin)."""
        by_size: dict[int, list[int]] = {}
        for i in self.bins[b]:
            by_size.setdefault(self.sizes[i], []).append(i)
        kept = sorted(by_size)
        found = {}
        for x, small in enumerate(kept):
            if len(by_size[small]) > 1:
                found[2 * small] = tuple(by_size[small][:2])
            for large in kept[x + 1 :]:
                found[small + large] = (by_size[small][0], by_size[large][0])
        return found

    def _enter(self, b: int) -> None:
        room = self.length - self.fill[b]
        if not room or not self.bins[b]:
            return
        self.by_room[room].add(b)
        self.rooms |= 1 << room
        for size in self._sizes_in(b):
            self.single.add(size, room, b)
        for size in self._pairs_in(b):
            self.double.add(size, room, b)

    def _leave(self, b: int) -> None:
        room = self.length - self.fill[b]
        self.by_room[room].discard(b)
        if not self.by_room[room]:
            self.rooms &= ~(1 << room)

    def _best(self, donor: int):
        """The exchange that increases the squared fills most: (gain, bin, given items, taken items)."""
        best = None
        fill = self.fill[donor]

        def offer(b: int, moved: int, given, taken) -> None:
            nonlocal best
            gain = 2 * moved * (self.fill[b] - fill + moved)
            if gain > 0 and (best is None or gain > best[0]):
                best = gain, b, given, taken

        for size, item in self._sizes_in(donor).items():
            fitting = self.rooms >> size
            if fitting:
                offer(next(iter(self.by_room[size + (fitting & -fitting).bit_length() - 1])), size, (item,), ())
                continue
            for index, kind in ((self.single, self._sizes_in), (self.double, self._pairs_in)):
                found = index.smallest_for(size)
                if found:
                    back = kind(found[1])[found[0]]
                    offer(found[1], size - found[0], (item,), back if isinstance(back, tuple) else (back,))
        for size, items in self._pairs_in(donor).items():
            found = self.single.smallest_for(size)
            if found:
                offer(found[1], size - found[0], items, (self._sizes_in(found[1])[found[0]],))
        return best

    def _empty(self, donor: int) -> int:
        """Exchanges that one bin makes as the giving side."""
        self._leave(donor)
        self.donor = donor
        made = 0
        while self.bins[donor] and (found := self._best(donor)):
            _, b, given, taken = found
            self._leave(b)
            moved = sum(self.sizes[i] for i in given) - sum(self.sizes[i] for i in taken)
            self.bins[donor] = [i for i in self.bins[donor] if i not in given] + list(taken)
            self.bins[b] = [i for i in self.bins[b] if i not in taken] + list(given)
            self.fill[donor] -= moved
            self.fill[b] += moved
            self._enter(b)
            made += 1
        self.donor = -1
        self._enter(donor)
        return made

    def run(self, least: int, passes: int = PASSES) -> None:
        left = sum(1 for items in self.bins if items)
        for _ in range(passes):
            made = 0
            for b in sorted(range(len(self.bins)), key=self.fill.__getitem__):
                if left <= least:
                    return
                if 0 < self.fill[b] < self.length:
                    made += self._empty(b)
                    left -= not self.bins[b]
            if not made:
                return


def pack_group(sizes: list[int], length: int, bins: list[list[int]] | None = None) -> list[list[int]]:
    """Bins of item numbers; ``bins`` is a packing to start from (emptied ones stay as empty lists)."""
    bins = best_fit_decreasing(sizes, length) if bins is None else bins
    search = LocalSearch(sizes, bins, length)
    search.run(lower_bound(np.array(sizes, dtype=np.int64), length))
    return search.bins


def _pack(length: int):
    """A partition is a group; ``sequence_id`` is null for pieces that stand in no bin yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        sizes = table["length"].to_pylist()
        given = table["sequence_id"].to_numpy()
        if table["sequence_id"].null_count:
            bins = pack_group(sizes, length)
            ids = (table["grp"][0].as_py() << 32) + np.arange(len(bins))
        else:
            ids, where = np.unique(given, return_inverse=True)
            order = np.argsort(where, kind="stable")
            bins = pack_group(sizes, length, [part.tolist() for part in np.split(order, np.cumsum(np.bincount(where))[:-1])])
        sequence, offset, fill = (np.zeros(len(sizes), dtype=np.int64) for _ in range(3))
        for number, items in zip(ids.tolist(), bins, strict=True):
            own = [sizes[i] for i in items]
            sequence[items], fill[items] = number, sum(own)
            offset[items] = np.cumsum(own) - own
        kept = [table[c].combine_chunks() for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
        kept = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in kept]
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array(sequence), pa.array(offset), pa.array(fill)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "fill"]
        )

    return run


_PACKED = _PIECE + ", sequence_id bigint, offset bigint, fill bigint"


def pack(cut: DataFrame, length: int = LENGTH, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of :func:`pieces`."""
    cut = materialize(cut.select("doc_id", "piece", "start", "length", "ids_crc32").withColumn("row", F.monotonically_increasing_id()), "pieces")
    whole = cut.where(F.col("length") == length).select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    done = [whole]
    left = cut.where(F.col("length") < length).withColumn("sequence_id", F.lit(None).cast("bigint"))
    salt = F.col("row")
    bins = None
    for turn in range(1 + rounds):
        n = left.count()
        if not n:
            break
        groups = -(-n // group)
        dealt = left.withColumn("grp", F.pmod(F.xxhash64(salt, F.lit(turn)), F.lit(groups)).cast("int")).drop("row")
        packed = materialize(dealt.repartitionById(groups, "grp").mapInArrow(_pack(length), _PACKED), "packed")
        now = packed.agg(F.count_if(F.col("offset") == 0)).first()[0]
        if groups == 1 or turn == rounds or bins == now:
            done.append(packed.drop("fill"))
            break
        done.append(packed.where(F.col("fill") == length).drop("fill"))
        bins = packed.where(F.col("fill") < length).agg(F.count_if(F.col("offset") == 0)).first()[0]
        left, salt = packed.where(F.col("fill") < length).drop("offset", "fill"), F.col("sequence_id")
    every = done[0]
    for part in done[1:]:
        every = every.unionByName(part)
    return every


def sequences(cut: DataFrame, packed: DataFrame, length: int = LENGTH) -> DataFrame:
    """(sequence_id, ids, starts): the token ids of every sequence and where its pieces begin.

    ``cut`` is a written table of :func:`pieces` with ids; pieces that are equal in every column
    pair off in any order, since their tokens are equal."""
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    same = Window.partitionBy(*key)
    texts = cut.withColumn("_n", F.row_number().over(same.orderBy("ids")))
    places = packed.withColumn("_n", F.row_number().over(same.orderBy("sequence_id", "offset")))
    both = [texts[c].eqNullSafe(places[c]) for c in [*key, "_n"]]
    joined = places.join(texts, both).select(places["sequence_id"], places["offset"], texts["ids"])
    rows = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return joined.groupBy("sequence_id").agg(rows.alias("_rows")).select(
        "sequence_id", F.flatten(F.col("_rows.ids")).alias("ids"), F.col("_rows.offset").alias("starts")
    )
