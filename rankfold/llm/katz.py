"""Katz backoff: a trigram model with Good-Turing discounts and exact backoff weights.

    p(w | g h) = d(r) r / c(g h)        if the triple stands r > 0 times in the training texts
               = alpha(g h) p(w | h)    otherwise, with p(w | h) = d(r) r / c(h) for seen pairs and
                                        alpha(h) p(w) for others; p(w) itself is a discounted
                                        unigram with one class of unknown words for what is left

A context that was never seen passes its word on to the shorter one; the first token of a text has
the start alone as its context.  ``order`` 2 stops at pairs.

Discounts d(1)..d(5) of each level are Good-Turing ratios from its counts of counts (where these give
none between 0 and 1, (r - 1/2) / r); larger counts are kept.  A context, or the word level, without any
count up to five has one more in its denominator, so that it too leaves something to back off to.  alpha
is the discounted mass of a context over what the shorter context leaves to the words not seen after
it, both summed over all of its followers, so the probabilities after every context sum to one.

Texts become batches of word numbers once.  Each level is one exchange: a batch sends its different
words (pairs, triples) with their training counts to the buckets of a partitioned table, every bucket
sums them, and sends back what the batch needs to score its own texts: total counts, and for the
contexts of held-out tokens their sums over all followers.  An item is sent once for each batch, not
for each use.  What a batch knows by itself is not sent: items after a context that no other batch
has; items whose shorter form was seen once in training, here, and is in no held-out text (they are
seen once, and enter the sums of their context as a number); contexts that no held-out text has.  The
followers of a frequent context are spread over buckets by their number, so neither a frequent word nor
a large source meets in one task.  Statistics that reach the driver are the counts of counts, the
number of tokens and the number of words.

Defined results: null and empty texts are the end alone; a null doc_id counts as held out; repeated
rows are scored and counted one by one; without training texts every token is unknown, with
probability one by this model and log10(0.1 / 0.1) by the base; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfold.llm import textops as X
from rankfold.llm.batches import groups_of, pack, range_slices, record, rows_of, unpack
from rankfold.session import delete_files, ensure_checkpoint_dir, materialize, release

BATCH_BYTES = 6 << 20
BATCH_DOCS = 200_000
#: text bytes for each bucket of an exchange
BUCKET_BYTES = 8 << 20
#: text bytes for each task
TASK_BYTES = 64 << 20
DISCOUNTED = 5
#: the batch of the buckets' statistics, of which there is one row each
STATISTICS = -1
#: numbers of the sentence marks among the word hashes
START, END = (int(x) for x in X.random_words(41, 2))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class Level:
    """Totals of one level: tokens, different items, and the number of items seen 1..6 times."""

    tokens: int
    different: int
    seen: tuple[int, ...]

    @property
    def size(self) -> int:
        """The denominator of the level: one more where no count is discounted, so that unknown items
        have some probability as well."""
        return self.tokens + (not any(self.seen[:DISCOUNTED]))

    @property
    def rest(self) -> float:
        """The probability left for items that were not seen."""
        d = self.discounts()
        low = [r * self.seen[r - 1] for r in range(1, DISCOUNTED + 1)]
        kept = sum(d[r] * n for r, n in enumerate(low, start=1)) + self.tokens - sum(low)
        return 1.0 - kept / self.size

    def discounts(self) -> np.ndarray:
        """d(0)..d(5); d(0) is not used."""
        out = np.ones(DISCOUNTED + 1)
        n = (0, *self.seen)
        common = (DISCOUNTED + 1) * n[DISCOUNTED + 1] / n[1] if n[1] else 1.0
        for r in range(1, DISCOUNTED + 1):
            ratio = (r + 1) * n[r + 1] / (r * n[r]) if n[r] else 0.0
            d = (ratio - common) / (1 - common) if common < 1 else 0.0
            out[r] = d if 0 < d < 1 else (r - 0.5) / r
        return out


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(counts <= DISCOUNTED, d[np.minimum(counts, DISCOUNTED)], 1.0) * counts


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


_BATCH = {
    "ids": pa.binary(), "nulls": pa.binary(), "held_out": pa.binary(), "lengths": pa.binary(), "tokens": pa.binary(),
    "words": pa.binary(), "n_bytes": pa.int64(),
}


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a task to batches of word numbers; words are numbered by frequency."""
    ids: list = []
    hashes: list[np.ndarray] = []
    lengths: list[int] = []
    size = 0

    def flush() -> pa.RecordBatch:
        words, tokens, counts = np.unique(np.concatenate([*hashes, [X.U64(START)]]), return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        number = np.empty(len(order), dtype=np.int64)
        number[order] = np.arange(len(order))
        out = record(_BATCH, [(
            np.array([0 if i is None else i for i in ids], dtype=np.int64).tobytes(), np.array([i is None for i in ids]).tobytes(),
            np.array([held_out(i) for i in ids]).tobytes(), np.array(lengths, dtype=np.int64).tobytes(),
            pack(number[tokens[:-1]]), words[order].tobytes(), size,
        )])
        for x in (ids, hashes, lengths):
            x.clear()
        return out

    end = np.array([END], dtype=X.U64)
    for batch in batches:
        data, offsets = X.text_bytes(batch.column("text"))
        doc_ids = batch.column("doc_id").to_pylist()
        for first, last in X.slices(offsets, X.PIECE):
            part = offsets[first : last + 1]
            words, at = X.word_hashes(_LOWER[data[part[0] : part[-1]]], part - part[0])
            for i in range(last - first):
                n = int(part[i + 1] - part[i])
                if ids and (size + n > BATCH_BYTES or len(ids) >= BATCH_DOCS):
                    yield flush()
                    size = 0
                ids.append(doc_ids[first + i])
                hashes += [words[at[i] : at[i + 1]], end]
                lengths.append(int(at[i + 1] - at[i]) + 1)
                size += n
    if ids:
        yield flush()


class _Batch:
    """One batch: tokens as local numbers, and which of them are training tokens."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], dtype=np.int64)
        self.nulls = np.frombuffer(row["nulls"], dtype=bool)
        self.held_out = np.frombuffer(row["held_out"], dtype=bool)
        self.lengths = np.frombuffer(row["lengths"], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.tokens = unpack(row["tokens"])
        self.words = np.frombuffer(row["words"], dtype=X.U64)
        self.learned = np.repeat(~self.held_out, self.lengths)
        self.start = int(np.flatnonzero(self.words == X.U64(START))[0])
        self.by_hash = np.argsort(self.words)

    def counts(self) -> np.ndarray:
        """Training count of each word; that of the start is the number of training texts."""
        out = np.bincount(self.tokens[self.learned], minlength=len(self.words))
        out[self.start] = int((~self.held_out).sum())
        return out

    def held_words(self) -> np.ndarray:
        """Which words stand in held-out texts; the start if there is any."""
        out = np.zeros(len(self.words), dtype=bool)
        out[self.tokens[~self.learned]] = True
        out[self.start] = self.held_out.any()
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Different (context, word) pairs, their training counts, and the pair of each token."""
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.starts] = self.start
        n = len(self.words)
        keys, pair = np.unique(before * n + self.tokens, return_inverse=True)
        return keys // n, keys % n, np.bincount(pair, weights=self.learned, minlength=len(keys)).astype(np.int64), pair.astype(np.int32)


def _send_words(buckets: int):
    schema = {"bucket": pa.int32(), "batch": pa.int64(), "words": pa.binary(), "counts": pa.binary(), "held": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            b = _Batch(row)
            words, counts, held = (x[b.by_hash] for x in (b.words, b.counts(), b.held_words()))
            yield record(schema, [(k, row["batch"], words[i:j].tobytes(), pack(counts[i:j]), pack(held[i:j])) for k, i, j in range_slices(words, buckets, 64)])

    return run


def _sum_words(buckets: int):
    """Numbers and totals of every word, to each batch that has it; the bucket's statistics."""
    schema = {"batch": pa.int64(), "bucket": pa.int32(), "numbers": pa.binary(), "totals": pa.binary(), "alone": pa.binary(), "held": pa.binary(), "stats": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, "bucket"):
            words = [np.frombuffer(r["words"], dtype=X.U64) for r in group]
            counts = np.concatenate([unpack(r["counts"]) for r in group])
            different, at = np.unique(np.concatenate(words), return_inverse=True)
            totals = np.bincount(at, weights=counts, minlength=len(different)).astype(np.int64)
            own = totals[(totals > 0) & (different != X.U64(START))]
            seen = np.bincount(own[own <= DISCOUNTED + 1], minlength=DISCOUNTED + 2)[1:]
            bucket = group[0]["bucket"]
            alone = np.bincount(at, minlength=len(different)) == 1
            held = np.bincount(at, weights=np.concatenate([unpack(r["held"]) for r in group]), minlength=len(different)) > 0
            rows = [(STATISTICS, bucket, None, None, None, None, [int(own.sum()), len(own), *map(int, seen)])]
            first = 0
            for r, w in zip(group, words, strict=True):
                mine = at[first : first + len(w)]
                first += len(w)
                rows.append((r["batch"], bucket, pack(mine * buckets + bucket), pack(totals[mine]), pack(alone[mine]), pack(held[mine]), None))
            yield record(schema, rows)

    return run


class _Words:
    """What the word level sends back to a batch: number and total of each local word."""

    def __init__(self, b: _Batch, row: dict):
        parts = sorted(row["words_back"], key=lambda p: p["bucket"])
        self.number = np.empty(len(b.words), dtype=np.int64)
        self.total = np.empty(len(b.words), dtype=np.int64)
        self.number[b.by_hash] = np.concatenate([unpack(p["numbers"]) for p in parts])
        self.total[b.by_hash] = np.concatenate([unpack(p["totals"]) for p in parts])
        self.alone, self.held = (np.empty(len(b.words), dtype=bool) for _ in range(2))
        self.alone[b.by_hash] = np.concatenate([unpack(p["alone"]) for p in parts]).astype(bool)
        self.held[b.by_hash] = np.concatenate([unpack(p["held"]) for p in parts]).astype(bool)


def _sums(contexts: int, context: np.ndarray, counts: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per context: items seen 1..5 times and the sum of larger counts; the lower-order mass of the items."""
    sums = np.zeros((contexts, DISCOUNTED + 1), dtype=np.int64)
    for r in range(1, DISCOUNTED + 1):
        sums[:, r - 1] = np.bincount(context[counts == r], minlength=contexts)
    sums[:, DISCOUNTED] = np.bincount(context, weights=np.where(counts > DISCOUNTED, counts, 0), minlength=contexts)
    # of no items bincount gives whole numbers
    return sums, np.bincount(context, weights=np.where(counts > 0, lower, 0.0), minlength=contexts).astype(np.float64)


def _seen(counts: np.ndarray) -> np.ndarray:
    """How many items were seen 1..6 times."""
    return np.bincount(counts[counts <= DISCOUNTED + 1], minlength=DISCOUNTED + 2)[1:]


class _Items:
    """The different items (context, follower) of a batch at one level, and how they are sent.

    ``names`` identify a context in every batch, ``totals`` are its training counts, ``local`` tells
    that no other batch has it, ``held`` that some held-out text has it.  ``lower`` is the count of each
    item one level below, ``lower_held`` whether that is in a held-out text, ``lower_size`` the denominator
    there; ``own_held`` tells of the item itself, in this batch.  A context seen more than ``share`` times is cut into parts by the follower's
    number, and every part of an asked context is asked for its sums."""

    def __init__(
        self, names: list[np.ndarray], totals: np.ndarray, local: np.ndarray, held: np.ndarray, asked: np.ndarray, context: np.ndarray, follower: np.ndarray,
        learned: np.ndarray, lower: np.ndarray, lower_held: np.ndarray, own_held: np.ndarray, lower_size: np.ndarray, buckets: int, share: int,
    ):
        self.context, self.n = context.astype(np.int32), len(totals)  # a batch has fewer items than 2**31
        self.learned, self.lower, self.lower_size = learned.astype(np.int32), lower, lower_size
        self.totals, self.own_held = totals, own_held
        possible = (totals[context] > 0) & (lower > 0)
        self.here = np.flatnonzero(possible & local[context])
        single = possible & ~local[context] & (learned > 0) & (lower == 1) & ~lower_held
        self.single = np.flatnonzero(single)
        self.sent = np.flatnonzero(possible & ~local[context] & ~single)
        singles = np.bincount(context[self.single], minlength=self.n)
        # contexts of up to five have low counts in any case
        wanted = ~local & (totals > 0) & (asked | (held & (singles > 0)) | (totals > DISCOUNTED))
        wanted[context[self.sent]] = True
        contexts = np.flatnonzero(wanted)
        parts = 1 + totals[contexts] // share
        first = np.full(self.n, -1, dtype=np.int64)
        first[contexts] = np.cumsum(parts) - parts
        n_parts = np.ones(self.n, dtype=np.int64)
        n_parts[contexts] = parts
        part_of = np.repeat(contexts, parts)
        salt = np.arange(len(part_of)) - first[part_of]
        key = salt.astype(X.U64) + X.U64(1)
        for name in names:
            key = X.mix(key + name[part_of].astype(X.U64) * X.U64(0x9E3779B97F4A7C15))
        bucket = (key % X.U64(buckets)).astype(np.int64)
        # parts of one context can share a bucket and are told apart by the bits above the number
        first_names = names[0][part_of] | (salt << 40)
        order = np.lexsort((names[-1][part_of], first_names, bucket))
        self.contexts = part_of[order]  # of each sent part
        self.names = [first_names[order], names[-1][self.contexts]]
        self.asked = asked[self.contexts]
        self.singles = np.where(salt[order] == 0, singles[self.contexts], 0)
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        at = place[first[context[self.sent]] + follower[self.sent] % n_parts[context[self.sent]]]
        by_part = np.argsort(at, kind="stable")
        self.sent, at = self.sent[by_part], at[by_part]
        self.followers = follower[self.sent]
        self.n_followers = np.bincount(at, minlength=len(order))
        self.edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        self.follower_edges = np.concatenate([[0], np.cumsum(self.n_followers)])[self.edges]

    def records(self, schema: dict, batch: int) -> Iterator[pa.RecordBatch]:
        """One row for each bucket that gets something, and one for what is counted here."""
        own = np.concatenate([self.learned[self.here], np.ones(len(self.single), dtype=np.int64)])
        own = own[own > 0]
        yield record(schema, [(-1, batch, *[None] * 10, [int(own.sum()), len(own), *map(int, _seen(own))])])
        for k in np.flatnonzero(np.diff(self.edges)).tolist():
            i, j = self.edges[k], self.edges[k + 1]
            p, q = self.follower_edges[k], self.follower_edges[k + 1]
            sent = self.sent[p:q]
            yield record(schema, [(
                k, batch, pack(np.diff(self.names[0][i:j], prepend=0)), pack(self.names[1][i:j]), pack(self.asked[i:j]), pack(self.lower_size[self.contexts[i:j]]),
                pack(self.singles[i:j]), pack(self.n_followers[i:j]), pack(self.followers[p:q]), pack(self.learned[sent]), pack(self.lower[sent]),
                pack(self.own_held[sent]), None,
            )])

    def counted(self, parts: list[dict], d_lower: np.ndarray) -> _Counted:
        """The whole counts, from what the buckets sent back and from what is counted here."""
        parts = sorted(parts, key=lambda p: p["bucket"])
        count = np.zeros(len(self.context), dtype=np.int64)
        count[self.here] = self.learned[self.here]
        count[self.single] = 1
        alone = np.zeros(len(self.context), dtype=bool)
        alone[self.here] = alone[self.single] = True
        held = self.own_held.copy()
        context = self.context[self.here]
        sums, mass = _sums(self.n, context, self.learned[self.here], discounted(self.lower[self.here], d_lower) / self.lower_size[context])
        low = sums[:, :DISCOUNTED].any(axis=1) | ((self.totals > 0) & (self.totals <= DISCOUNTED))
        low[self.context[self.single]] = True
        if parts:
            count[self.sent] = np.concatenate([unpack(p["totals"]) for p in parts])
            alone[self.sent] = np.concatenate([unpack(p["alone"]) for p in parts]).astype(bool)
            held[self.sent] = np.concatenate([unpack(p["held"]) for p in parts]).astype(bool)
            low[self.contexts[np.concatenate([unpack(p["low"]) for p in parts]).astype(bool)]] = True
            asked = self.contexts[self.asked]
            np.add.at(sums, asked, np.concatenate([unpack(p["sums"]).reshape(DISCOUNTED + 1, -1).T for p in parts]))
            np.add.at(mass, asked, np.concatenate([np.frombuffer(p["mass"]) for p in parts]))
        return _Counted(count, alone, held, low, sums, mass)


@dataclass
class _Counted:
    """Per item: its training count, whether no other batch has it, and whether a held-out text does.  Per
    context: whether it has low counts, and for asked ones the sums over followers."""

    count: np.ndarray
    alone: np.ndarray
    held: np.ndarray
    low: np.ndarray
    sums: np.ndarray
    mass: np.ndarray

    def weights(self, totals: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(denominator, alpha) of each context; alpha is one for contexts never seen."""
        size = (totals + ~self.low).astype(np.float64)  # a context without low counts has one more
        kept = (self.sums[:, :DISCOUNTED] * (d[1:] * np.arange(1, DISCOUNTED + 1))).sum(axis=1) + self.sums[:, DISCOUNTED]
        with np.errstate(divide="ignore", invalid="ignore"):
            return size, np.where(totals > 0, (1.0 - kept / size) / (1.0 - self.mass), 1.0)


@dataclass(frozen=True)
class _Plan:
    """What all tasks know: the exchange's layout and the statistics of the levels counted so far."""

    buckets: int
    share: int
    unigram: Level
    bigram: Level | None = None


class _Scorer:
    """One batch with what the levels below have sent back to it."""

    def __init__(self, row: dict, plan: _Plan):
        self.plan, self.b = plan, _Batch(row)
        self.w = _Words(self.b, row)
        b = self.b
        before = np.empty_like(b.tokens)
        before[1:] = b.tokens[:-1]
        before[b.starts] = b.start
        self.pair_context, self.pair_word, self.pair_learned, self.pair = b.pairs()
        asked = np.zeros(len(b.words), dtype=bool)
        asked[before[~b.learned]] = True
        w, unigram = self.w, plan.unigram
        held = np.zeros(len(self.pair_context), dtype=bool)
        held[self.pair[~b.learned]] = True
        self.pairs = _Items(
            [w.number], w.total, w.alone, w.held, asked, self.pair_context, w.number[self.pair_word], self.pair_learned, w.total[self.pair_word],
            w.held[self.pair_word], held, np.full(len(b.words), unigram.size), plan.buckets, plan.share,
        )

    def count_pairs(self, row: dict) -> None:
        self.two = self.pairs.counted(row["pairs_back"] or [], self.plan.unigram.discounts())
        self.size_of_word = self.w.total + ~self.two.low
        # triples: tokens with at least one token of the text before them, after the pair of that one
        inner = np.ones(len(self.b.tokens), dtype=bool)
        inner[self.b.starts] = False
        self.inner = np.flatnonzero(inner).astype(np.int32)
        after, own = self.pair[self.inner - 1], self.pair[self.inner]
        n = len(self.b.words)
        keys, triple = np.unique(after.astype(np.int64) * n + self.b.tokens[self.inner], return_inverse=True)
        self.triple = triple.astype(np.int32)
        del triple
        first = np.zeros(len(keys), dtype=np.int64)
        first[self.triple] = own
        learned = np.bincount(self.triple, weights=self.b.learned[self.inner], minlength=len(keys)).astype(np.int64)
        asked = np.zeros(len(self.pair_context), dtype=bool)
        asked[after[~self.b.learned[self.inner]]] = True
        number = self.w.number
        self.triple_context, self.triple_pair = (keys // n).astype(np.int32), first.astype(np.int32)
        self.triples = _Items(
            [number[self.pair_context], number[self.pair_word]], self.two.count, self.two.alone, self.two.held, asked, self.triple_context, number[keys % n],
            learned, self.two.count[first], self.two.held[first], np.zeros(len(keys), dtype=bool), self.size_of_word[self.pair_word],
            self.plan.buckets, self.plan.share,
        )

    def probabilities(self, row: dict, trigram: Level | None) -> np.ndarray:
        """The model's probability of every token."""
        w, unigram, bigram = self.w, self.plan.unigram, self.plan.bigram
        d2 = bigram.discounts()
        p1 = np.where(w.total > 0, discounted(w.total, unigram.discounts()) / unigram.size, unigram.rest)
        size, alpha = self.two.weights(w.total, d2)
        with np.errstate(divide="ignore", invalid="ignore"):
            p2 = np.where(self.two.count > 0, discounted(self.two.count, d2) / size[self.pair_context], alpha[self.pair_context] * p1[self.pair_word])
            out = p2[self.pair]
            if trigram is not None:
                d3 = trigram.discounts()
                three = self.triples.counted(row["triples_back"] or [], d2)
                size, alpha = three.weights(self.two.count, d3)
                p3 = np.where(three.count > 0, discounted(three.count, d3) / size[self.triple_context], alpha[self.triple_context] * p2[self.triple_pair])
                out[self.inner] = p3[self.triple]
        return out


_SENT = (
    "bucket int, batch bigint, a binary, b binary, asked binary, sizes binary, singles binary, n_followers binary, followers binary, counts binary, lower binary, "
    "held binary, stats array<bigint>"
)
_SENT_ARROW = {
    c.split()[0]: {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}[c.split()[1]] for c in _SENT.split(", ")
}


def _send(plan: _Plan, order: int):
    """Pairs (order 2) or triples (order 3) of the batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            scorer = _Scorer(row, plan)
            if order == 3:
                scorer.count_pairs(row)
            yield from (scorer.pairs if order == 2 else scorer.triples).records(_SENT_ARROW, row["batch"])

    return run


_BACK = "batch bigint, bucket int, totals binary, alone binary, held binary, low binary, sums binary, mass binary, stats array<bigint>"


def _sum_items(d_lower: np.ndarray):
    """Totals of every item, to each batch that has it, and the sums of each context part."""
    schema = {
        "batch": pa.int64(), "bucket": pa.int32(), "totals": pa.binary(), "alone": pa.binary(), "held": pa.binary(), "low": pa.binary(), "sums": pa.binary(), "mass": pa.binary(),
        "stats": pa.list_(pa.int64()),
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, "bucket"):
            if group[0]["bucket"] < 0:  # what the batches counted themselves
                yield record(schema, [(STATISTICS, -1, *[None] * 6, [sum(s) for s in zip(*(r["stats"] for r in group), strict=True)])])
                continue
            context = [np.cumsum(unpack(r["a"])) for r in group]
            n_followers = [unpack(r["n_followers"]) for r in group]
            a, at_a = np.unique(np.concatenate(context), return_inverse=True)
            b, at_b = np.unique(np.concatenate([unpack(r["b"]) for r in group]), return_inverse=True)
            known, first, context_at = np.unique(at_a * len(b) + at_b, return_index=True, return_inverse=True)
            sizes = np.concatenate([unpack(r["sizes"]) for r in group])[first]
            of_follower = np.repeat(context_at, np.concatenate(n_followers))
            followers, follower_at = np.unique(np.concatenate([unpack(r["followers"]) for r in group]), return_inverse=True)
            lower = np.concatenate([unpack(r["lower"]) for r in group])
            items, first, at = np.unique(of_follower * max(len(followers), 1) + follower_at, return_index=True, return_inverse=True)
            counts = np.bincount(at, weights=np.concatenate([unpack(r["counts"]) for r in group]), minlength=len(items)).astype(np.int64)
            alone = np.bincount(at, minlength=len(items)) == 1
            owner = of_follower[first]
            held = np.bincount(at, weights=np.concatenate([unpack(r["held"]) for r in group]), minlength=len(items)) > 0
            sums, mass = _sums(len(known), owner, counts, discounted(lower[first], d_lower) / sizes[owner])
            singles = np.bincount(context_at, weights=np.concatenate([unpack(r["singles"]) for r in group]), minlength=len(known)).astype(np.int64)
            sums[:, 0] += singles
            mass += singles * d_lower[1] / sizes
            low = sums[:, :DISCOUNTED].any(axis=1)
            seen = counts[counts > 0]
            bucket = group[0]["bucket"]
            rows = [(STATISTICS, bucket, *[None] * 6, [int(seen.sum()), len(seen), *map(int, _seen(seen))])]
            f = g = 0
            for r, own, n in zip(group, context, n_followers, strict=True):
                mine = context_at[f : f + len(own)]
                total = int(n.sum())
                here = at[g : g + total]
                asked = mine[unpack(r["asked"]).astype(bool)]
                rows.append((
                    r["batch"], bucket, pack(counts[here]), pack(alone[here]), pack(held[here]), pack(low[mine]), pack(sums[asked].T.reshape(-1)), mass[asked].tobytes(), None,
                ))
                f += len(own)
                g += total
            yield record(schema, rows)

    return run


def _score(plan: _Plan, trigram: Level | None):
    schema = {
        "doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(),
        "base_score": pa.float64(), "score": pa.float64(),
    }
    unigram = plan.unigram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            scorer = _Scorer(row, plan)
            scorer.count_pairs(row)
            b, total = scorer.b, scorer.w.total
            logs = np.log10(scorer.probabilities(row, trigram))
            base = np.log10((total + 0.1) / (unigram.tokens + 0.1 * (unigram.different + 1)))[b.tokens]
            known = (total > 0)[b.tokens]
            yield record(schema, list(zip(
                [None if x else int(i) for i, x in zip(b.ids, b.nulls, strict=True)], b.held_out.tolist(), b.lengths.tolist(),
                np.add.reduceat(known.astype(np.int64), b.starts).tolist(), [unigram.tokens] * len(b.ids),
                np.add.reduceat(base, b.starts).tolist(), np.add.reduceat(logs, b.starts).tolist(), strict=True,
            )))

    return run


def _level(back: DataFrame) -> Level:
    """The sums of the buckets' statistics (eight numbers)."""
    rows = back.where(F.col("batch") == STATISTICS).select(F.explode("back.stats").alias("stats"))
    sums = rows.agg(*[F.sum(F.col("stats")[i]) for i in range(DISCOUNTED + 3)]).first()
    tokens, different, *seen = [int(x or 0) for x in sums]
    return Level(tokens, different, tuple(seen))


def score_texts(docs: DataFrame, order: int = 3) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of
    ``docs``; the model of ``order`` 2 or 3 learns from the rows that are not held out."""
    if order not in (2, 3):
        raise ValueError(f"order is 2 or 3, not {order}")
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))
    buckets = max(partitions, -(-total // BUCKET_BYTES))
    table = f"rankfold_numbers_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{table}"
    (
        texts.mapInArrow(_number, "ids binary, nulls binary, held_out binary, lengths binary, tokens binary, words binary, n_bytes bigint")
        .withColumn("batch", F.monotonically_increasing_id())
        .write.format("parquet").option("path", path).bucketBy(partitions, "batch").saveAsTable(table)
    )

    def exchange(sent: DataFrame, sums, schema: str, name: str) -> tuple[Level, DataFrame]:
        """What the buckets sum: the level's statistics, and the parts that go back to each batch."""
        parts = sent.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(sums, schema)
        fields = [c.split()[0] for c in schema.split(", ") if c.split()[0] != "batch"]
        back = materialize(parts.repartition(partitions, "batch").groupBy("batch").agg(F.collect_list(F.struct(*fields)).alias("back")), name)
        return _level(back), back

    def with_parts(known: DataFrame, back: DataFrame, name: str, how: str = "left") -> DataFrame:
        return known.join(back.withColumnRenamed("back", name).hint("merge"), "batch", how)

    try:
        batches = spark.table(table)
        unigram, words = exchange(
            batches.mapInArrow(_send_words(buckets), "bucket int, batch bigint, words binary, counts binary, held binary"), _sum_words(buckets),
            "batch bigint, bucket int, numbers binary, totals binary, alone binary, held binary, stats array<bigint>", "words",
        )
        plan = _Plan(buckets, 1 + unigram.tokens // (4 * buckets), unigram)
        known = with_parts(batches, words, "words_back", "inner")
        bigram, pairs = exchange(known.mapInArrow(_send(plan, 2), _SENT), _sum_items(unigram.discounts()), _BACK, "pairs")
        plan = replace(plan, bigram=bigram)
        known = with_parts(known, pairs, "pairs_back")
        trigram = None
        if order == 3:
            trigram, triples = exchange(known.mapInArrow(_send(plan, 3), _SENT), _sum_items(bigram.discounts()), _BACK, "triples")
            known = with_parts(known, triples, "triples_back")
        scores = materialize(
            known.mapInArrow(
                _score(plan, trigram), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
            ),
            "scores",
        )
        release(words, pairs, *([triples] if order == 3 else []))
        return scores
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        delete_files(spark, path)
